"""URL filter lists: host-suffix and path-prefix expressions, short hash prefixes, full digests, longest rule first.

A rule has a host, a path prefix and an action. A URL fits it if its host is the
rule's or a subdomain of it and its path starts with the rule's. Each URL is
expanded into every expression ``host suffix + path prefix`` that a rule could
be written as; expressions meet rules in an equi-join on the first 32 bits of
their SHA-256 digests, and the full digests then confirm a hit. The longest rule
that fits wins; of equally long ones a block wins over an allow.

Defined results: a null URL or one without ``://`` has an empty host and path
and fits no rule; a host of nothing but dots has no suffixes beyond itself; rows
may repeat and keep their number; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.base import query, table

#: (host, path prefix, action)
RULES: tuple[tuple[str, str, str], ...] = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
_PREFIX_DIGITS = 8


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, labels: Sequence[int]) -> Column:
    """The host's endings of the given numbers of labels, itself among them; others cannot be a rule's host."""
    wanted = F.array(*[F.lit(n) for n in labels]).cast("array<int>")
    has = F.size(F.split(host, r"\.", -1))
    dots = F.filter(wanted, lambda n: n <= has)
    return F.transform(dots, lambda n: F.call_function("substring_index", host, F.lit("."), -n))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules as a table: ``rule, action, digest, prefix, path_len, labels``. A large list comes as a table with the first two columns."""
    rows = F.array(*[F.struct(F.lit(ascii_host + path).alias("rule"), F.lit(path).alias("path"), F.lit(ascii_host.count(".") + 1).alias("labels"), F.lit(action).alias("action")) for ascii_host, path, action in rules])
    listed = spark.range(1).select(F.explode(rows).alias("r")).select("r.*")
    digest = F.sha2(F.col("rule"), 256)
    return listed.select("rule", "action", digest.alias("digest"), F.substring(digest, 1, _PREFIX_DIGITS).alias("prefix"), F.length("path").alias("path_len"), "labels")


def path_prefixes(path: Column, lengths: Sequence[int]) -> Column:
    """The path's prefixes of the given lengths. A rule may end anywhere in a segment, so lengths count, not slashes."""
    wanted = F.array(*[F.lit(n) for n in lengths])
    return F.transform(F.filter(wanted, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))


def judge(urls: DataFrame, id_col: str, url_col: str, rules: DataFrame, lengths: Sequence[int] | None = None, default: str = "allow") -> DataFrame:
    """``id, host, path, rule, verdict`` for each row. ``lengths``: path lengths of the rules to heed, all by default.

    Equal rows are folded to one with a count before they are expanded, so that a
    URL held by a large share of the rows is expanded once. Spark broadcasts the
    rules only while it knows them to be small; else both sides shuffle on the
    hash prefix, and a prefix that many URLs share is split by skew handling.
    """
    # which lengths of paths and numbers of labels occur among the rules: no more than the longest rule is long
    lengths = lengths if lengths is not None else sorted(r[0] for r in rules.select("path_len").distinct().collect())
    labels = sorted(r[0] for r in rules.select("labels").distinct().collect())
    rows = urls.groupBy(F.col(id_col), F.col(url_col).alias("_url")).agg(F.count(F.lit(1)).alias("_n"))
    parts = rows.select(id_col, "_url", "_n", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    pairs = F.flatten(F.transform(host_suffixes(F.col("host"), labels), lambda h: F.transform(path_prefixes(F.col("path"), lengths), lambda p: F.concat(h, p))))
    expanded = parts.select("*", F.explode_outer(F.when(F.col("host") != "", pairs)).alias("_expr"))
    hashed = expanded.withColumn("_digest", F.sha2(F.col("_expr"), 256)).withColumn("_prefix", F.substring("_digest", 1, _PREFIX_DIGITS)).drop("_expr")
    r = rules.select(F.col("rule").alias("_rule"), F.col("action").alias("_action"), F.col("digest").alias("_rdigest"), F.col("prefix").alias("_rprefix"))
    met = hashed.join(r, F.col("_prefix") == F.col("_rprefix"), "left")
    fits = F.when(
        F.col("_digest") == F.col("_rdigest"),
        F.struct(F.length("_rule").alias("len"), (F.col("_action") == "block").cast("int").alias("block"), F.col("_rule").alias("rule"), F.col("_action").alias("action")),
    )
    won = met.groupBy(id_col, "_url", "_n", "host", "path").agg(F.max(fits).alias("_won"))
    out = won.select(
        id_col, "host", "path", F.col("_won.rule").alias("rule"), F.coalesce("_won.action", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_copy"),
    )
    return out.drop("_copy")


_SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_RULES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)


@query(
    "op5_url_verdicts",
    f"""
WITH rules(rhost, rpath, action) AS (VALUES {_SQL_RULES}),
parts AS (
  SELECT page_id, row_number() OVER () AS rn, {_SQL_LOWER.format("coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '')")} AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
),
won AS (
  SELECT p.rn, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM parts p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY p.rn
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN won USING (rn)
""",
)
def op5_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, "page_id", "url", rule_table(spark, RULES))
