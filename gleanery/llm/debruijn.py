"""Repeated word spans, by runs of windows in place of a de Bruijn graph.

What runs here is ``repeats``: neighbouring 50-word windows that share an anchor form
one run, runs are grouped by digests, and only runs of one anchor with different
contents are cut into single windows. There are no nodes, degrees or compaction
joins; an edge for each k-mer would be a row for each word, and the README has the
figures why that was not built. The results are those of the graph: a window is removed
exactly if its word sequence also starts in a document with a smaller id.

A word is removed if an edge over it also starts in a document with a smaller id.
Windows are judged on the input.

Defined results: null or empty text has no words; texts under 50 words lose
nothing; rows with equal ids never count against each other; a null id comes
after all others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import repeats
from gleanery.llm.base import query, table

WINDOW = 50
GRAM = 16


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, keep_text: bool = True) -> DataFrame:
    """``id, n_words, n_removed, kept_sha256`` and, if asked for, ``kept_text``."""
    plan = repeats.Plan(words=True, window=window, gram=min(gram, window), earlier=True)
    rows = repeats.marked(docs, plan, "debruijn", id_col, text_col, keep_text)
    out = rows.select(F.col("_row.rest")[id_col].alias(id_col), F.col("_size").alias("n_words"), F.col("_gone").alias("n_removed"), F.col("_sha").alias("kept_sha256"), F.col("_kept").alias("kept_text"))
    return out if keep_text else out.drop("kept_text")


@query(
    "op9_debruijn_words",
    f"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
windows AS (
  SELECT rn, doc_id, i, md5(array_to_string(w[i + 1 : i + {WINDOW}], ' ')) AS h FROM words, unnest(range(len(w) - {WINDOW - 1})) AS t(i)
),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
starts AS (SELECT rn, list(i) AS starts FROM windows JOIN firsts USING (h) WHERE doc_id > first GROUP BY rn),
gone AS (SELECT rn, list_distinct(flatten(list_transform(starts, lambda i: range(i, i + {WINDOW})))) AS gone FROM starts),
gone_words AS (SELECT rn, unnest(gone) AS i FROM gone),
flat AS (SELECT rn, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM words),
kept AS (SELECT rn, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n_kept FROM flat ANTI JOIN gone_words USING (rn, i) GROUP BY rn)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (rn)
""",
)
def op9_debruijn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
