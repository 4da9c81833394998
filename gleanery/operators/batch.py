"""Jobs over many pages and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.scalars import first_match, resolve_url, url_host, url_path
from gleanery.functions.transforms import transformed_by
from gleanery.operators.dom import with_text
from gleanery.operators.extract import NO_MATCH, REC, Field, extract_records
from gleanery.operators.selector_table import matches_on
from gleanery.operators.selectors import select_css, select_or_empty, within
from gleanery.session import written
from gleanery.sources.nodes import elements


def url_shape(url: Column) -> Column:
    """Path with digit runs as ``{n}`` and without a trailing slash."""
    return F.regexp_replace(F.regexp_replace(url_path(url), r"\d+", "{n}"), r"/\z", "")


def with_group(pages: DataFrame) -> DataFrame:
    return pages.withColumns({"host": url_host(F.col("url")), "shape": url_shape(F.col("url"))})


def url_groups(pages: DataFrame) -> DataFrame:
    """Pages per host and URL shape (M1)."""
    return with_group(pages.select("page_id", "url")).groupBy("host", "shape").agg(
        F.count("*").alias("n_pages"), F.min("page_id").alias("first_page")
    )


# What a place of a path that varies is called, by what all its values look like.
PLACES = (("{date}", r"^\d{4}-\d{2}-\d{2}\z"), ("{n}", r"^\d+\z"))


def url_templates(pages: DataFrame, fixed: int = 20, share: float = 0.5, least: int = 5) -> DataFrame:
    """(host, path, template): URL templates that are learned from the paths of each host (M1).

    Paths form a tree, walked from the top: a place below one template varies if it has more than
    ``fixed`` different values, or at least ``least`` that are new in at least ``share`` of its
    pages. A place that varies becomes ``{date}``, ``{n}`` or ``{text}``, and what lies
    below its values is one subtree from then on; so language codes and sections stay, dates, numbers and
    slugs go. Each level folds distinct paths to counts; nothing of a host is gathered.
    """
    parts = F.filter(F.split(url_path(F.col("url")), "/"), lambda x: x != "")
    now = written(
        pages.filter(F.col("url").isNotNull()).groupBy(url_host(F.col("url")).alias("host"), parts.alias("parts")).agg(F.count("*").alias("n_pages")).withColumn("template", F.lit("")), "url-tree"
    )
    deepest = now.agg(F.max(F.size("parts"))).first()[0] or 0
    for level in range(1, deepest + 1):
        part = F.try_element_at("parts", F.lit(level))
        values = now.filter(F.size("parts") >= level).groupBy("host", "template", part.alias("part")).agg(F.sum("n_pages").alias("n"))
        looks = [F.bool_and(F.col("part").rlike(pattern)).alias(name) for name, pattern in PLACES]
        places = values.groupBy("host", "template").agg(F.count("*").alias("k"), F.sum("n").alias("n"), *looks)
        varies = (F.col("k") > fixed) | ((F.col("k") >= least) & (F.col("k") >= share * F.col("n")))
        kind = F.lit("{text}")
        for name, _ in reversed(PLACES):
            kind = F.when(F.col(name), F.lit(name)).otherwise(kind)
        known = places.filter(varies).select("host", "template", kind.alias("kind"))
        step = F.when(F.size("parts") >= level, F.concat(F.lit("/"), F.coalesce("kind", part))).otherwise(F.lit(""))
        now = written(now.join(known, ["host", "template"], "left").select("host", "parts", "n_pages", F.concat("template", step).alias("template")), "url-tree")
    return now.select("host", F.concat(F.lit("/"), F.array_join("parts", "/")).alias("path"), "template", "n_pages")


def host_profile(pages: DataFrame) -> DataFrame:
    """Approximate distinct URLs per host (G7); sketches merge, so a hot host is cheap."""
    return pages.groupBy(url_host(F.col("url")).alias("host")).agg(
        F.count("*").alias("n_pages"), F.approx_count_distinct("url", 0.02).alias("approx_urls")
    )


def page_structure(nodes: DataFrame) -> DataFrame:
    """(page_id, signature): hash of the set of tag paths in the page (M2).

    ``bit_xor`` of one hash per distinct path: no path list is collected.
    """
    paths = elements(nodes).select("page_id", "path").distinct()
    return paths.groupBy("page_id").agg(F.bit_xor(F.xxhash64("path")).alias("signature"), F.count("*").alias("n_paths"))


def structure_groups(nodes: DataFrame) -> DataFrame:
    return page_structure(nodes).groupBy("signature", "n_paths").agg(
        F.count("*").alias("n_pages"), F.min("page_id").alias("first_page")
    )


def near_structure_groups(nodes: DataFrame, bands: int = 8, rows: int = 3, overlap: float = 0.7) -> DataFrame:
    """(page_id, leader): pages whose tag-path sets are alike share a leader page (M2).

    Two path sets are alike if they overlap by ``overlap`` (shared paths over all
    paths), and groups are closed under that. First MinHash by plain ``min``
    aggregates over distinct structures: each band bucket points at its smallest
    structure, and pointers that hold form groups. Then what they missed: alike sets
    share one of their rarest paths (prefix filter), so structures of different
    groups that meet there are compared. Groups that MinHash found whole are not
    expanded into pairs, as buckets of one group are left out.
    """
    sig = page_structure(nodes)
    reps = written(sig.groupBy("signature").agg(F.min("page_id").alias("page_id")), "structures")
    sets = written(elements(nodes).select("page_id", "path").distinct().join(reps.select("page_id"), "page_id"), "structure-paths")
    sizes = sets.groupBy("page_id").agg(F.count("*").alias("n"))
    mins = sets.groupBy("page_id").agg(
        *[F.min(F.xxhash64(F.lit(i), "path")).alias(f"h{i}") for i in range(bands * rows)]
    )
    keys = F.array(
        *[F.xxhash64(F.lit(b), *[F.col(f"h{b * rows + r}") for r in range(rows)]) for b in range(bands)]
    )
    banded = mins.select("page_id", F.posexplode(keys).alias("band", "bucket"))
    lead = banded.groupBy("band", "bucket").agg(F.min("page_id").alias("leader"))
    links = banded.join(lead, ["band", "bucket"]).select(F.col("page_id").alias("a"), F.col("leader").alias("b")).where("a != b").distinct()
    real = written(_alike(links, sets, sizes, overlap), "alike")
    found = _closed(reps.select("page_id"), real)
    # a set of n paths shares at least overlap * n of them with each alike set, so one of its other n - overlap * n + 1
    rarest = Window.partitionBy("page_id").orderBy("used", "path")
    ranked = sets.join(sets.groupBy("path").agg(F.count("*").alias("used")), "path").withColumn("_rank", F.row_number().over(rarest))
    prefix = ranked.join(sizes, "page_id").where(F.col("_rank") <= F.col("n") - F.ceil(F.col("n") * overlap - 1e-6) + 1)
    meeting = written(prefix.join(found, "page_id").select("page_id", "path", "n", "leader"), "prefixes")
    mixed = meeting.groupBy("path").agg(F.min("leader").alias("_low"), F.max("leader").alias("_high")).where("_low != _high").select("path")
    left = meeting.join(mixed, "path").select("path", F.col("page_id").alias("a"), F.col("n").alias("n_a"), F.col("leader").alias("l_a"))
    right = meeting.select("path", F.col("page_id").alias("b"), F.col("n").alias("n_b"), F.col("leader").alias("l_b"))
    fits = (F.col("n_a") >= F.col("n_b") * overlap - 1e-6) & (F.col("n_b") >= F.col("n_a") * overlap - 1e-6)
    missed = left.join(right, "path").where((F.col("l_a") != F.col("l_b")) & (F.col("a") < F.col("b")) & fits).select("a", "b").distinct()
    leader = _closed(reps.select("page_id"), real.unionByName(written(_alike(missed, sets, sizes, overlap), "alike")))
    best = reps.join(leader, "page_id").select("signature", "leader")
    return sig.select("page_id", "signature").join(best, "signature").select("page_id", "leader")


def _alike(links: DataFrame, sets: DataFrame, sizes: DataFrame, overlap: float) -> DataFrame:
    """The ``links (a, b)`` whose path sets overlap enough."""
    shared = links.join(sets.withColumnRenamed("page_id", "a"), "a").join(sets.withColumnRenamed("page_id", "b"), ["b", "path"]).groupBy("a", "b").agg(F.count("*").alias("both"))
    for side in ("a", "b"):
        shared = shared.join(sizes.select(F.col("page_id").alias(side), F.col("n").alias(f"n_{side}")), side)
    return shared.where(F.col("both") >= overlap * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def _closed(points: DataFrame, links: DataFrame) -> DataFrame:
    """(page_id, leader): the smallest page that links reach; every round lets each page take the smallest leader around it and that one's leader."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now, before = written(points.select("page_id", F.col("page_id").alias("leader")), "leaders"), None
    while True:
        around = both.join(now.select(F.col("page_id").alias("b"), "leader"), "b").groupBy(F.col("a").alias("page_id")).agg(F.min("leader").alias("_near"))
        near = now.join(around, "page_id", "left").select("page_id", F.least("leader", "_near").alias("leader"))
        jump = now.select(F.col("page_id").alias("leader"), F.col("leader").alias("_far"))
        now = written(near.join(jump, "leader").select("page_id", F.least("leader", "_far").alias("leader")), "leaders")
        # leaders only get smaller; hashes are summed, since page ids may be as large as their type
        total = now.agg(F.sum(F.xxhash64("page_id", "leader").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return now
        before = total


def pagination_series(pages: DataFrame, limit: int | Column | None = None) -> DataFrame:
    """Pages of ``?page=N`` series in page order (M4).

    ``limit``: pages kept per base URL, a number or a column of ``pages`` (as a
    plan's ``max_pages``); without it a series is whole.
    """
    number = first_match(F.col("url"), r"[?&]page=(\d+)").try_cast("int")
    base = F.regexp_replace(F.col("url"), r"([?&])page=\d+&?", "$1")
    base = F.regexp_replace(F.regexp_replace(base, r"#.*\z", ""), r"[?&]\z", "")
    most = limit if isinstance(limit, Column) else F.lit(limit).cast("int")
    series = pages.select("page_id", base.alias("base_url"), number.alias("page_no"), most.alias("_most")).filter(F.col("page_no").isNotNull())
    rank = F.row_number().over(Window.partitionBy("base_url").orderBy("page_no", "page_id"))
    placed = series.withColumn("place", rank)
    if isinstance(limit, int):  # a plain number reaches below the shuffle
        placed = placed.filter(F.col("place") <= limit)
    elif limit is not None:
        placed = placed.filter(F.col("_most").isNull() | (F.col("place") <= F.col("_most")))
    return placed.drop("_most")


def next_page_links(pages: DataFrame, nodes: DataFrame, selector: str | None = None) -> DataFrame:
    """The first next-page link of each page, absolute (M5): by CSS or XPath selector, else by link text.

    An unusable selector finds nothing (B2).
    """
    if selector:
        chosen = select_or_empty(nodes, selector, "attrs")
    else:
        chosen = with_text(select_css(nodes, "a[href]", "attrs", "text"), nodes).filter(F.col("value").rlike(r"(?i)^(next|next page|older|›|»|→)\s*[›»→]?\z")).drop("value")
    first = chosen.groupBy("page_id").agg(F.min_by(F.try_element_at("attrs", F.lit("href")), "pre").alias("href"))
    return first.join(pages.select("page_id", "url"), "page_id").select(
        "page_id", "href", resolve_url(F.col("href"), F.col("url")).alias("next_url")
    )


def group_containers(nodes: DataFrame, page_groups: DataFrame, plans: DataFrame, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(containers, issues): record containers of each page by its group's selectors (M6).

    page_groups(page_id, grp); plans(grp, css, xpath), any number of groups. A
    page takes its group's CSS selector, and the XPath where that finds nothing.
    Pages whose group has no plan, or whose selectors find nothing, give an issue.
    """
    asked = page_groups.join(plans, "grp", "left").select("page_id", "grp", "css", "xpath", (F.col("css").isNotNull() | F.col("xpath").isNotNull()).alias("planned"))
    both = asked.select("page_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("css").alias("selector")), F.struct(F.lit(1).alias("side"), F.col("xpath").alias("selector")))).alias("_s"))
    wanted = written(both.select("page_id", "_s.*").filter(F.col("selector").isNotNull()), "batch-selectors")
    found = written(matches_on(nodes, wanted).join(wanted, ["page_id", "selector"]).select("page_id", "side", "pre"), "batch-matches")
    first = found.groupBy("page_id").agg(F.min("side").alias("side"))
    recs = found.join(first, ["page_id", "side"]).join(elements(nodes).select("page_id", "pre", "text", "attrs"), ["page_id", "pre"])
    recs = recs.withColumn("rec_no", F.row_number().over(Window.partitionBy("page_id").orderBy("pre")))
    if cap is not None:
        recs = recs.filter(F.col("rec_no") <= cap)
    missed = asked.join(first, "page_id", "left_anti").select(
        "page_id", "grp", F.when(F.col("planned"), F.lit("no_match")).otherwise(F.lit("no_plan")).alias("code"),
        F.when(F.col("planned"), F.lit(NO_MATCH)).otherwise(F.lit("No plan for this group of pages")).alias("issue"),
    )
    return recs.withColumnRenamed("pre", "rec_pre"), missed


def batch_extract(nodes: DataFrame, page_groups: DataFrame, plans: DataFrame, fields: list[Field], page_urls: DataFrame, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, issues): each group's own selectors on all of its pages, the same fields for all (M6)."""
    recs, missed = group_containers(nodes, page_groups, plans, cap)
    records = extract_records(nodes, recs, fields, page_urls).join(page_groups.select("page_id", "grp"), "page_id")
    return records, missed


def batch_records(nodes: DataFrame, page_groups: DataFrame, plans: DataFrame, plan_fields: DataFrame, page_urls: DataFrame, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, issues): each group's own containers and its own fields.

    plan_fields(grp, field, selector, attribute, transform): a field is looked up inside the
    container, or is the container itself where it has no selector. Records
    are long, (page_id, grp, rec_pre, rec_no, field, value, num, flag), one row for each
    field of the group and record; a miss is NULL. ``num`` and ``flag`` hold what number and
    boolean transforms give. Fields are rows, so plans do not grow with groups or fields.
    """
    recs, missed = group_containers(nodes, page_groups, plans, cap)
    # read for own fields, for containment and for the rows of the result
    recs = written(recs.join(page_groups.select("page_id", "grp"), "page_id"), "group-containers")
    used = recs.select("page_id", "grp").distinct().join(plan_fields, "grp")
    asked = written(used.filter(F.col("selector").isNotNull()).select("page_id", "field", "selector").distinct(), "group-fields")
    els = elements(nodes).select("page_id", "pre", "anc", "attrs", "text")
    hits = matches_on(nodes, asked).join(asked, ["page_id", "selector"]).join(els, ["page_id", "pre"])
    inside = within(hits, recs.select("page_id", F.col("rec_pre").alias("pre"))).withColumnRenamed("ctx_pre", "rec_pre")
    first = inside.groupBy(*REC, "field").agg(F.min_by(F.struct("pre", "attrs", "text"), "pre").alias("_e")).select(*REC, "field", "_e.*")
    grid = recs.select(*REC, "rec_no", "grp").join(plan_fields, "grp")
    own = recs.join(plan_fields.filter(F.col("selector").isNull()).select("grp", "field"), "grp").select(*REC, "field", F.col("rec_pre").alias("pre"), "attrs", "text")
    longs = grid.join(written(first.unionByName(own), "group-values"), [*REC, "field"], "left").join(page_urls.select("page_id", "url"), "page_id", "left")
    # only fields that read text need it put together
    by_text = F.col("attribute").isNull() & F.col("pre").isNotNull()
    read = with_text(longs.filter(by_text), nodes).unionByName(longs.filter(~by_text).withColumn("value", F.try_element_at("attrs", F.lower("attribute"))).drop("text"))
    return read.select(*REC, "rec_no", "grp", "field", *transformed_by(F.col("transform"), F.col("value"), F.col("url"))), missed


def first_of_group(page_groups: DataFrame) -> DataFrame:
    """The first page of each group (M7); a plain min, so a hot group is pre-aggregated."""
    return page_groups.groupBy("grp").agg(F.min("page_id").alias("page_id"))


def apply_templates(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Pages with the saved template of their host.

    No broadcast hint: the planner broadcasts templates when they measure
    small, and AQE splits a hot host otherwise.
    """
    return pages.withColumn("host", url_host(F.col("url"))).join(templates, "host")


def template_extract(pages: DataFrame, nodes: DataFrame, templates: DataFrame, name: str, fields: list[Field]) -> tuple[DataFrame, DataFrame]:
    """Apply the selectors that were saved under a name to new pages of the same hosts (A11): (records, issues).

    templates(name, host, css, xpath).
    """
    saved = templates.filter(F.col("name") == name).select(F.col("host").alias("grp"), "css", "xpath")
    return batch_extract(nodes, pages.select("page_id", url_host(F.col("url")).alias("grp")), saved, fields, pages)


def lineage(versions: DataFrame) -> DataFrame:
    """versions(version_id, parent_id) -> (version_id, original, depth): the chain of refinements behind each version.

    Every round doubles how far each version looks back, so a chain of n
    versions takes log2(n) rounds. Both sides of the join are the whole table, which
    packs well as a file; the hint keeps it from being sent through the driver for that.
    """
    now = written(
        versions.select(
            "version_id", F.coalesce("parent_id", "version_id").alias("original"), F.when(F.col("parent_id").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("depth")
        ),
        "lineage",
    )
    before = None
    while True:
        up = now.select(F.col("version_id").alias("original"), F.col("original").alias("_far"), F.col("depth").alias("_more"))
        now = written(now.join(up.hint("merge"), "original", "left").select("version_id", F.coalesce("_far", "original").alias("original"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")), "lineage")
        total = now.agg(F.sum("depth")).first()[0]
        if total == before:
            return now
        before = total


def selector_history(versions: DataFrame) -> DataFrame:
    """(field, selector, first_selector, n_improved, is_robust): where each selector in use comes from.

    versions(selector_id, field, selector, improved_from, is_robust): a selector keeps which one it improves
    and whether it was asked to be robust. In use is what nothing improves, so of branches all ends are.
    A version that improves an unknown one starts a way of its own.
    """
    known = versions.select(F.col("selector_id").alias("improved_from"), F.lit(True).alias("_known"))
    own = versions.join(known, "improved_from", "left").withColumn("improved_from", F.when(F.col("_known"), F.col("improved_from"))).drop("_known")
    own = written(own, "selector-versions")
    way = lineage(own.select(F.col("selector_id").alias("version_id"), F.col("improved_from").alias("parent_id")))
    last = own.join(own.select(F.col("improved_from").alias("selector_id")), "selector_id", "left_anti")
    first = own.select(F.col("selector_id").alias("original"), F.col("selector").alias("first_selector"))
    out = last.join(way.withColumnRenamed("version_id", "selector_id"), "selector_id").join(first, "original")
    return out.select("field", "selector", "first_selector", F.col("depth").alias("n_improved"), F.coalesce("is_robust", F.lit(False)).alias("is_robust"))


def run_diff(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """Records added, removed, changed or kept between two runs."""
    a = old.select(*key, F.col(value).alias("old_value"), F.lit(True).alias("_a"))
    b = new.select(*key, F.col(value).alias("new_value"), F.lit(True).alias("_b"))
    tag = (
        F.when(F.col("_a").isNull(), F.lit("added"))
        .when(F.col("_b").isNull(), F.lit("removed"))
        .when(F.col("old_value").eqNullSafe(F.col("new_value")), F.lit("same"))
        .otherwise(F.lit("changed"))
    )
    return a.join(b, key, "full").select(*key, "old_value", "new_value", tag.alias("change"))


def run_trend(runs: DataFrame, key: str, value: str) -> DataFrame:
    """Change of each key's value from one run to the next.

    runs(run_ts, key, value) holds one row per key and run, so a key's window
    is as long as the number of runs.
    """
    before = F.lag(value).over(Window.partitionBy(key).orderBy("run_ts"))
    return runs.select(key, "run_ts", value, before.alias("previous"), (F.col(value) - before).alias("delta"))


def accuracy(got: DataFrame, gold: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Share of gold values reproduced per field (M13); missing records count as wrong."""
    pair = gold.select(*key, *[F.col(f).alias(f"_g_{f}") for f in fields]).join(got.select(*key, *fields), key, "left")
    hits = pair.agg(F.count("*").alias("n"), *[F.count_if(F.col(f).eqNullSafe(F.col(f"_g_{f}"))).alias(f) for f in fields])
    return hits.select("n", F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])).alias("field", "n_right")).select(
        "field", "n", "n_right", F.round(F.col("n_right") / F.col("n"), 6).alias("accuracy")
    )


def latest_versions(versions: DataFrame, key: str) -> DataFrame:
    """Latest version of each plan, how many there were, and what it refines."""
    best = F.max_by(F.struct("ts", "parent_ts", "body"), F.struct("ts", "version_id"))
    return versions.groupBy(key).agg(best.alias("_v"), F.count("*").alias("n_versions")).select(
        key, F.col("_v.ts").alias("ts"), F.col("_v.parent_ts").alias("parent_ts"), F.col("_v.body").alias("body"), "n_versions",
        F.col("_v.parent_ts").isNotNull().alias("refined"),
    )
