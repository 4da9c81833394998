"""Prompt texts. Ids and hole names are fixed values callers rely on; the wording is ours."""

from __future__ import annotations

PROMPTS = {
    "PLANNER_CREATE_PLAN": (
        "Plan how to pull data from one web page.\nPage address: {targetUrl}\nWanted: {extractionGoal}\n"
        "Page source:\n{htmlSample}\nAnswer under the headings of your instructions."
    ),
    "SELECTOR_GENERATE": (
        "Find selectors for data on a page.\nData: {targetData}\nPurpose: {extractionGoal}\n"
        "Page source:\n{htmlSample}\nGive CSS and XPath selectors that outlive small layout changes."
    ),
    "SELECTOR_GENERATE_MULTI": (
        "Find selectors for several fields.\n{targetsDescription}\nPage source:\n{htmlContext}\n"
        "Preferred kind: {preferredType}. Start each answer line with the field name and a colon."
    ),
    "SELECTOR_REFINE": (
        "Tighten these selectors.\nCSS: {currentCssSelector}\nXPath: {currentXPathSelector}\nData: {targetData}\nPage source:\n{htmlContext}"
    ),
    "EXTRACTOR_EXTRACT_DATA": (
        "Turn this page source into records.\nFields:\n{schema}\nCSS: {cssSelector}\nXPath: {xpathSelector}\n"
        "Page source:\n{htmlContent}\nAnswer with JSON only."
    ),
    "VALIDATOR_CHECK_DATA": "Check records against their fields.\nFields:\n{schema}\nRecords:\n{extractedData}\nPage source:\n{htmlSample}",
    "ERROR_RECOVERY_DIAGNOSE": (
        "Reading a page failed.\nError: {errorMessage}\nCSS: {cssSelector}\nXPath: {xpathSelector}\n"
        "Purpose: {extractionGoal}\nPage source:\n{htmlContext}\nName the cause and other ways in."
    ),
    "MULTIPAGE_PLAN": (
        "Plan data collection over a series of pages.\nFirst page: {mainPageUrl}\nWanted: {dataToCollect}\n"
        "Known paging: {paginationPattern}\nPage source:\n{htmlSample}\nSay how to reach each page and how to join the results."
    ),
    "PLAN_REFINE": "Revise this plan.\n{currentPlan}\nRemarks: {feedback}\nPage source:\n{htmlSample}\nKeep what works.",
    "SELECTOR_IMPROVE": "Better selectors are needed.\nNow:\n{currentSelectors}\nRemarks: {feedback}\nPage source:\n{htmlContext}",
    "SELECTOR_CONVERT": "Rewrite this {fromType} selector as {toType}:\n`{selector}`\nAnswer with the selector only.",
    "SELECTOR_ROBUST": (
        "Selectors must outlive layout changes.\nElement: {targetDescription}\nPage source:\n{htmlSample}\n"
        "Prefer ids, data attributes and roles; give several of each kind."
    ),
    "RECOVERY_ALTERNATIVES": (
        "A CSS selector found nothing.\nField: {description} ({type})\nSelector: \"{failedSelector}\"\nError: {errorMessage}\n"
        "Notes: {notes}\nPage source:\n{htmlSample}\nAnswer with a JSON array of up to three other selectors."
    ),
}

SYSTEM_PROMPTS = {
    "PLANNER": (
        "You plan web data extraction. Answer with these headings, one per line:\n- Extraction Goal:\n- Data Structure:\n"
        "- Key Fields: one per line, as name [type]\n- Target Elements:\n- Extraction Strategy:\n- Potential Challenges:"
    ),
    "SELECTOR": "You write selectors. List CSS Selectors: and XPath Selectors:, each with Primary: and Alternate: lines, then an explanation.",
    "EXTRACTOR": "You turn page source into JSON records that follow the given fields.",
    "VALIDATOR": "You judge records. Report Validation Status, Schema Compliance, Completeness, Issues Found and Recommendations.",
    "ERROR_RECOVERY": "You repair failed extraction. Name the cause, then fixes, then a fallback.",
    "ORCHESTRATOR": "You order the steps of an extraction and say what to do when one fails.",
}

# Sampling temperature and answer size per prompt kind.
SETTINGS = {
    "PLANNER_CREATE_PLAN": ("PLANNER", 0.3, 2048),
    "PLAN_REFINE": ("PLANNER", 0.2, 2048),
    "MULTIPAGE_PLAN": ("PLANNER", 0.3, 2048),
    "SELECTOR_GENERATE": ("SELECTOR", 0.2, 1024),
    "SELECTOR_GENERATE_MULTI": ("SELECTOR", 0.2, 2048),
    "SELECTOR_IMPROVE": ("SELECTOR", 0.2, 1024),
    "SELECTOR_CONVERT": ("SELECTOR", 0.1, 256),
    "SELECTOR_ROBUST": ("SELECTOR", 0.2, 1024),
    "EXTRACTOR_EXTRACT_DATA": ("EXTRACTOR", 0.2, 4096),
    "RECOVERY_ALTERNATIVES": (None, 0.3, None),
}
