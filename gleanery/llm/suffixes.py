"""Repeated byte strings, by runs of windows in place of a radix sort of suffixes.

What runs here is ``repeats``: neighbouring 400-byte windows that share an anchor
(their least 64-byte gram) form one run, and runs are grouped by digests of all
bytes they cover. Runs that partly equal others are cut into blocks of 16 windows, and those
into single windows. No suffix is ordered and no digit is compared; a row for each suffix
is a row for each byte, and the README has the figures why that was not built. The
results are those of the sort: the groups of equal strings at the threshold depth.

A byte is removed if a 400-byte string over it also starts anywhere else, in the
same document too. Strings are judged on the input; none crosses documents.

Defined results: null text is empty; texts under 400 bytes lose nothing; repeated
rows count as separate documents; rows with a null id keep it; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import repeats
from gleanery.llm.base import query, table

WINDOW = 400
#: Threshold in words, where texts are cut by words.
WORDS = 50
GRAM = 64
BLOCK = 16


def remove_repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, block: int = BLOCK, keep_text: bool = True
) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept_text`` (without bytes of characters cut in two)."""
    plan = repeats.Plan(words=False, window=window, gram=min(gram, window), earlier=False, block=min(block, window))
    rows = repeats.marked(docs, plan, "suffixes", id_col, text_col, keep_text)
    out = rows.select(
        F.col("_row.rest")[id_col].alias(id_col), F.col("_size").alias("n_bytes"), F.col("_gone").alias("n_removed"), F.col("_spans").alias("n_spans"),
        F.col("_sha").alias("kept_sha256"), F.col("_kept").alias("kept_text"),
    )
    return out if keep_text else out.drop("kept_text")


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars: str = "n_chars", words: bool = True, window: int = WORDS, gram: int = 16, block: int = 0
) -> DataFrame:
    """``docs`` with what is left of each text, and its length in ``n_chars`` if there is such a column; a null text stays null.

    Tokens are words between ASCII white space, or bytes. What is not removed stays as it was, white space included.
    """
    rows = repeats.marked(docs, repeats.Plan(words=words, window=window, gram=gram, earlier=False, block=block), "suffixes", id_col, text_col, True)
    text = F.when(~F.col("_row.empty"), F.col("_kept"))
    new = {text_col: text, n_chars: F.when(~F.col("_row.empty"), F.length("_kept").cast("long"))}
    return rows.select(*[(new[c] if c in new else F.col("_row.rest")[c]).alias(c) for c in docs.columns])


@query("op10_radix_suffixes")
def op10_radix_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
