"""Free model-response text -> plans, selectors, JSON records, usage.

Everything is a Column expression over a ``responses`` table, except the
strict JSON check: Spark's JSON readers accept trailing text after the first
value, so that one test runs as an Arrow-batched function.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.scalars import first_match, js_trim, nullif
from gleanery.functions.transforms import type_setting

# Headings of a plan response and the order they come in.
GOAL, STRUCTURE, FIELDS = "Extraction Goal", "Data Structure", "Key Fields"
ELEMENTS, STRATEGY, CHALLENGES = "Target Elements", "Extraction Strategy", "Potential Challenges"

# The words that announce pagination facts (a tuple where any of them will do), and what selectors start with and are quoted by.
NEXT_PAGE = ("next", "page", ("button", "link", "selector"))
PAGE_NUMBERS = ("page", "numbers", ("are in", "selector"))
URL_PATTERNS = (("pagination", "pattern"), ("page", "url", "pattern"))
MOST_PAGES = (("max", "maximum", "total"),)
STARTS, QUOTES = ".#/", "`'"
DEFAULT_MAX_PAGES = 10


def _phrase(words: tuple) -> str:
    """A pattern for words in a row with any white space between them."""
    def spaced(w: str) -> str:
        return r"\s+".join(w.split())

    return r"\s+".join(spaced(w) if isinstance(w, str) else "(?:" + "|".join(map(spaced, w)) + ")" for w in words)


def _said(text: Column, words: tuple, value: str) -> Column:
    """What follows the first such announcement, with or without a colon."""
    return js_trim(first_match(text, rf"(?i){_phrase(words)}:?\s*{value}"))


def _selector_said(text: Column, words: tuple) -> Column:
    """A selector, quoted or not, to its closing quote or the end of the line."""
    return _said(text, words, rf"[{QUOTES}]?([{STARTS}][^{QUOTES}\n]+)")


def _line(text: Column, heading: str) -> Column:
    return js_trim(first_match(text, rf"(?i){heading}:?\s*([^\n]+)"))


def _section(text: Column, heading: str, *until: str) -> Column:
    stop = "|".join([f"{u}:" for u in until] + [r"\z"])
    return js_trim(first_match(text, rf"(?is){heading}:?\s*(.*?)(?={stop})"))


def _bullets(section: Column) -> Column:
    lines = F.transform(F.split(section, "\n"), lambda s: F.regexp_replace(js_trim(s), r"^-\s*", ""))
    return F.filter(lines, lambda s: s != "")


def plan_goal(text: Column) -> Column:
    return _line(text, GOAL)


def plan_structure(text: Column) -> Column:
    return _line(text, STRUCTURE)


def plan_fields(text: Column) -> Column:
    """ARRAY<STRUCT<name, type>> of the key-fields section.

    A type counts only in square brackets: ``price: number`` is a string field.
    """
    signs = "[:\\[\\]]"

    def one(s: Column) -> Column:
        # name, then what stands right behind it
        bare = F.regexp_replace(s, rf"^{signs}+", "")
        name = F.split(bare, signs, 2)[0]
        behind = F.substr(bare, F.length(name) + 1)
        kind = F.substring_index(F.substr(behind, F.lit(2)), "]", 1)
        typed = (name != "") & behind.startswith("[") & (kind != "") & F.contains(F.substr(behind, F.lit(2)), F.lit("]"))
        return F.struct(
            js_trim(F.when(name == "", s).otherwise(name)).alias("name"),
            F.when(typed, F.lower(js_trim(kind))).otherwise(F.lit("string")).alias("type"),
        )

    fields = F.transform(_bullets(_section(text, FIELDS, ELEMENTS, STRATEGY, CHALLENGES)), one)
    return F.filter(fields, lambda f: f["name"] != "")


def plan_elements(text: Column) -> Column:
    return _bullets(_section(text, ELEMENTS, STRATEGY, CHALLENGES))


def plan_challenges(text: Column) -> Column:
    return _bullets(_section(text, CHALLENGES))


def plan_strategy(text: Column) -> Column:
    """Strategy text; the bullet dash of a following heading is not part of it."""
    return js_trim(F.regexp_replace(_section(text, STRATEGY, CHALLENGES), r"\n\s*-\s*\z", ""))


@F.pandas_udf(T.StringType())
def first_json(candidates: pd.Series) -> pd.Series:
    """The first candidate that is one complete JSON value; NaN and Infinity are not JSON."""

    def reject(_):
        raise ValueError

    def pick(texts):
        for t in texts if texts is not None else ():
            try:
                json.loads(t, parse_constant=reject)
                return t
            except (ValueError, TypeError, RecursionError):
                continue
        return None

    return candidates.map(pick)


def plan_schema_json(text: Column) -> Column:
    """The JSON object in a fenced block, or NULL if it does not parse (E5)."""
    block = first_match(text, r'(?s)```(?:json)?\s*(\{\s*"[^}]+".*?\})\s*```')
    return F.when(block.isNotNull(), first_json(F.array(block)))


def plan_schema_rows(plans: DataFrame, key: str) -> DataFrame:
    """plans(key, text) -> (key, field, attribute, transform, source).

    A schema given as JSON wins; without one it is derived from the fields.
    """
    parsed = plans.select(key, plan_schema_json(F.col("text")).alias("_given"), plan_fields(F.col("text")).alias("_fields"))
    entry = "map<string,struct<selector:string,attribute:string,transform:string>>"
    given = parsed.filter(F.col("_given").isNotNull()).select(key, F.explode(F.from_json("_given", entry)).alias("field", "_c"))
    given = given.select(key, "field", "_c.attribute", "_c.transform", F.lit("given").alias("source"))
    derived = parsed.filter(F.col("_given").isNull()).select(key, F.explode("_fields").alias("_f"))
    derived = derived.select(key, F.col("_f.name").alias("field"), F.col("_f.type").alias("type")).dropDuplicates()
    derived = derived.select(
        key, "field", type_setting(F.col("type"), 0).alias("attribute"), type_setting(F.col("type"), 1).alias("transform"),
        F.lit("derived").alias("source"),
    )
    return given.unionByName(derived)


def parse_plans(responses: DataFrame, key: str = "plan_id") -> DataFrame:
    """One row per plan response with all parsed parts."""
    t = F.col("text")
    return responses.select(
        key,
        plan_goal(t).alias("goal"),
        plan_structure(t).alias("structure"),
        plan_fields(t).alias("fields"),
        plan_elements(t).alias("elements"),
        plan_strategy(t).alias("strategy"),
        plan_challenges(t).alias("challenges"),
        plan_schema_json(t).alias("schema_json"),
    )


def pagination(text: Column) -> Column:
    """STRUCT<type, next_selector, url_pattern, numbers_selector, max_pages, has_pagination>."""
    nxt, numbers = _selector_said(text, NEXT_PAGE), _selector_said(text, PAGE_NUMBERS)
    pattern = F.coalesce(*[_said(text, words, "([^.]+)") for words in URL_PATTERNS])
    kind = F.coalesce(
        F.when(nxt.isNotNull(), F.lit("next-button")),
        F.when(pattern.isNotNull(), F.lit("url-pattern")),
        F.when(numbers.isNotNull(), F.lit("page-numbers")),
    )
    most = first_match(text, rf"(?i){_phrase(MOST_PAGES)}(?:\s+of)?\s+(\d+)\s+pages")
    limit = F.coalesce(most.try_cast("int"), F.lit(DEFAULT_MAX_PAGES))
    return F.struct(
        kind.alias("type"),
        nxt.alias("next_selector"),
        pattern.alias("url_pattern"),
        numbers.alias("numbers_selector"),
        limit.alias("max_pages"),
        kind.isNotNull().alias("has_pagination"),
    )


# The words of a selector answer.
KINDS = ("css", "xpath")
LISTED, LOGIC = ("primary", "alternate"), ("selector", "logic")


def _named_selectors(text: Column, name: str) -> Column:
    """Ordered distinct selectors that are announced by a kind's name.

    First those in back quotes, then bare ones to the end of their line, then the
    ones that are listed under the kind's heading. What is left of a heading itself is no selector.
    """
    (other,) = [k for k in KINDS if k != name]
    heading = lambda kind: _phrase((kind, "selectors"))
    forms = {"quoted": "`([^`]+)`", "bare": r"([^\n`]+)"}
    after = [F.regexp_extract_all(text, F.lit(rf"(?i){name}(?:\s+selector)?:?\s*{form}"), 1) for form in forms.values()]
    ends = "|".join([rf"{heading(other)}:", rf"\n\s*-?\s*{_phrase(LOGIC)}", r"\z"])
    under = F.regexp_extract(text, rf"(?is){heading(name)}:(.*?)(?={ends})", 1)
    listed = F.regexp_extract_all(under, F.lit(rf"(?i){_phrase((LISTED,))}:\s*`?([^`\n]+)"), 1)
    found = F.transform(F.concat(*after, listed), lambda s: js_trim(s))
    return F.array_distinct(F.filter(found, lambda s: ~F.lower(s).isin("", "s", ":", "s:")))


def css_selectors(text: Column) -> Column:
    return _named_selectors(text, "css")


def xpath_selectors(text: Column) -> Column:
    return _named_selectors(text, "xpath")


def explanation(text: Column, words: str = "explanation") -> Column:
    """Text after the word up to the first blank line."""
    return js_trim(first_match(text, rf"(?i)(?:{words}):?\s*([^\n]*(?:\n(?!\n)[^\n]*)*)"))


def multi_field_selectors(responses: DataFrame, key: str, targets: list[str]) -> DataFrame:
    """(key, field, css, xpath, explanation) per target named in the response.

    A field's section runs to the next line that starts with a target name
    and a colon. Names are matched literally.
    """
    names = [t.lower() for t in targets]
    any_name = "|".join(rf"\Q{n}\E" for n in names)
    t = F.col("text")
    sections = F.array(
        *[
            F.struct(
                F.lit(n).alias("field"),
                first_match(t, rf"(?is)\Q{n}\E[:\s]*(.*?)(?=\n\s*(?:{any_name})\s*:|\z)").alias("body"),
            )
            for n in names
        ]
    )
    rows = responses.select(key, F.explode(sections).alias("s")).filter(F.col("s.body").isNotNull())
    return rows.select(key, "s.field", css_selectors(F.col("s.body")).alias("css"), xpath_selectors(F.col("s.body")).alias("xpath"), explanation(F.col("s.body")).alias("explanation"))


def clean_converted(text: Column) -> Column:
    """The quoted part of a one-selector answer."""
    head = F.regexp_replace(js_trim(text), r"""(?s)\A.*?[`"']""", "")
    return F.regexp_replace(head, r"""(?s)[`"'].*\z""", "")


def selector_kind(selector: Column) -> Column:
    return F.when(selector.startswith("/"), F.lit("xpath")).otherwise(F.lit("css"))


def alternatives(text: Column) -> Column:
    """ARRAY of proposed selectors; anything but an array of strings gives none."""
    bare = js_trim(F.regexp_replace(text, r"\A```json\s*|```\s*\z", ""))
    item = r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
    strings = bare.rlike(rf"\A\[\s*(?:{item}\s*(?:,\s*{item}\s*)*+)?\]\z")
    got = F.when(strings, F.from_json(bare, "array<string>"))
    return F.filter(F.coalesce(got, F.array().cast("array<string>")), lambda s: js_trim(s) != "")


def response_json(text: Column) -> Column:
    """The JSON value in a response, or NULL.

    A fenced block decides alone. Otherwise the widest object or array is
    tried, the one that opens first coming first, then the whole text.
    """
    fenced = first_match(text, r"(?s)```(?:json)?\s*(.*?)```")
    obj = first_match(text, r"(?s)\{.*\}", 0)
    arr = first_match(text, r"(?s)\[.*\]", 0)
    obj_first = F.instr(text, "{") < F.instr(text, "[")
    open_tries = F.when(obj_first, F.array(obj, arr, text)).otherwise(F.array(arr, obj, text))
    return first_json(F.when(fenced.isNotNull(), F.array(fenced)).otherwise(open_tries))


def response_records(responses: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, rec_no, one column per field) from JSON answers; bad JSON gives no row."""
    schema = "array<struct<" + ",".join(f"`{f}`:string" for f in fields) + ">>"
    j = F.col("_json")
    as_array = F.when(js_trim(j).startswith("["), j).otherwise(F.concat(F.lit("["), j, F.lit("]")))
    parsed = responses.select(key, response_json(F.col("text")).alias("_json")).filter(j.isNotNull())
    rows = parsed.select(key, F.posexplode(F.from_json(as_array, schema)).alias("pos", "r"))
    return rows.select(key, (F.col("pos") + 1).alias("rec_no"), *[F.col(f"r.{f}").alias(f) for f in fields])


def response_failures(responses: DataFrame, key: str) -> DataFrame:
    bad = responses.select(key, "text", response_json(F.col("text")).alias("_json")).filter(F.col("_json").isNull())
    return bad.select(
        key, F.lit("response_not_json").alias("code"), F.lit("Failed to parse JSON from LLM response").alias("issue"), F.col("text").alias("value")
    )


def normalise_usage(responses: DataFrame) -> DataFrame:
    """Token counts with 0 for missing and total = sum where absent."""
    p, c = F.coalesce("prompt_tokens", F.lit(0)), F.coalesce("completion_tokens", F.lit(0))
    return responses.withColumns({"prompt_tokens": p, "completion_tokens": c, "total_tokens": F.coalesce("total_tokens", p + c)})


def token_usage(responses: DataFrame) -> DataFrame:
    """Usage per provider and model with subtotals."""
    sums = [F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    return normalise_usage(responses).rollup("provider", "model").agg(
        F.grouping_id().alias("level"), F.count("*").alias("n_calls"), *sums
    )


def with_fallback(responses: DataFrame, key: str, primary: str, fallback: str | None) -> DataFrame:
    """One answer per prompt: the primary's, else one hop to the fallback.

    When both failed, the fallback's error is what is reported.
    """
    order = [primary] + ([fallback] if fallback and fallback != primary else [])
    tried = responses.filter(F.col("provider").isin(order)).withColumn(
        "_hop", F.when(F.col("provider") == primary, F.lit(0)).otherwise(F.lit(1))
    )
    bad = F.col("error").isNotNull()
    # good answers first by hop; among failures the last hop
    rank = F.when(bad, F.lit(10) - F.col("_hop")).otherwise(F.col("_hop"))
    best = tried.groupBy(key).agg(F.min_by(F.struct("provider", "text", "error"), rank).alias("_r"))
    return best.select(key, "_r.*")


def prompt_key(prompt: Column, model: Column, system: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (prompt, model, system)]
    sizes = [F.length(c).cast("string") for c in parts]  # lengths keep the parts apart
    return F.sha2(F.concat_ws("|", *sizes, *parts), 256)


def distinct_prompts(prompts: DataFrame, key: str, cache: DataFrame | None = None) -> DataFrame:
    """Each identical prompt once, those already answered left out."""
    keyed = prompts.withColumn("cache_key", prompt_key(F.col("prompt"), F.col("model"), F.col("system")))
    once = keyed.groupBy("cache_key").agg(F.min(key).alias(key), F.count("*").alias("n_copies"))
    return once.join(cache.select("cache_key"), "cache_key", "left_anti") if cache is not None else once


def ask(prompts: DataFrame, answer_batch, schema: str) -> DataFrame:
    """Prompt table -> response table through a caller's batch function."""
    return prompts.mapInPandas(lambda batches: (answer_batch(b) for b in batches), schema)


def multi_page_plans(responses: DataFrame) -> DataFrame:
    """All columns of each parsed plan with its pagination facts as ``paging`` (M3)."""
    paging = responses.select("plan_id", pagination(F.col("text")).alias("paging"))
    return parse_plans(responses).join(paging, "plan_id").withColumn("is_multi_page", F.lit(True))
