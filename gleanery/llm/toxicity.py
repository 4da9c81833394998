"""Toxicity scores by weak supervision.

Many voters look at a text: fixed lexicons, patterns, and terms (whole words and
word beginnings) mined from a labelled sample. A generative label model estimates
by expectation-maximisation how often each voter fires on toxic and on clean
texts, and how voters correlate given the class; correlated voters share their
weight. Given labels enter as one more voter that is silent where there are none.
A logistic regression is then trained on the posterior labels and scores every
whole text.

The sample has at most SAMPLE labelled rows of each class, the first by hash of
the id, weighted back to the class sizes among all labelled rows. Rows whose
crc32(id as text) mod 4 is 2 are held out and never read for labels. At most
MINED terms are mined. Nothing else is bounded: every text is scored as a whole.

Defined results: null and empty texts get the score of a text in which no voter
fires; without labels, or with one class only, the fixed voters decide alone;
repeated rows get equal scores; an empty table gives an empty result; further
columns of both tables, labels among them, never enter a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.base import packed, query, small_batches, table, unpacked
from gleanery.session import written

#: Most labelled rows of each class in the training sample.
SAMPLE = 6000
#: Most mined terms.
MINED = 400
THRESHOLD = 0.3
HELD_OUT = 2

# Word lists of the lexicon voters.
LEXICONS: dict[str, tuple[str, ...]] = {
    "stupidity": ("idiot", "idiots", "stupid", "moron", "morons", "dumb", "imbecile", "fool"),
    "worth": ("worthless", "pathetic", "loser", "losers", "useless", "failure"),
    "disgust": ("disgusting", "scum", "trash", "garbage", "filth", "vermin", "vile"),
    "ridicule": ("clown", "clowns", "joke", "laughable", "freak"),
    "violence": ("kill", "die", "hang", "strangle", "murder"),
    "obscenity": ("bastard", "bitch", "shit", "crap", "damn", "fuck", "fucking", "asshole"),
    "german": ("dumm", "dummkopf", "abschaum", "ekelhaft", "wertlos", "versager", "müll", "trottel", "arschloch", "scheiße"),
    "french": ("stupide", "imbécile", "ordure", "pathétique", "dégoûtant", "crétin", "connard", "merde", "minable"),
    "spanish": ("idiota", "estúpido", "basura", "patético", "asqueroso", "imbécil", "inútil", "mierda", "payaso"),
}
# Pattern voters, over lower-cased text.
PATTERNS: dict[str, str] = {
    "address": r"\b(?:you|your|du|ihr|tu|vous|eres)\s+(?:are|bist|seid|es|êtes|un|una|a|an)?\s*(?:\w+\s)?(?:idiot|stupid|pathetic|worthless|loser|moron|dumm|nul)",
    "marks": r"!{3,}",
    "asterisks": r"\b[a-z]\*{2,}[a-z]*",
}

_WORD = re.compile(r"[^\W\d_]+")
_LENGTHS = (3, 4, 5, 6)


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text))


def terms_of(word: str) -> list[str]:
    """The word itself, marked by its end, and its beginnings."""
    return [word + "$", *(word[:k] for k in _LENGTHS if len(word) > k)]


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str, size: int) -> DataFrame:
    """``_text, _y, _w``: at most ``size`` rows of each class, weighted to stand for all labelled rows that are not held out."""
    known = labels.where(~held_out(id_col) & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    totals = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two numbers
    some = None
    for y, n in sorted(totals.items()):
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(size).withColumn("_w", F.lit(n / min(n, size)))
        some = part if some is None else some.unionByName(part)
    if some is None:
        return docs.sparkSession.createDataFrame([], "_text string, _y int, _w double")
    # at most 2 x size rows of three numbers
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(some), "_id").select("_text", "_y", "_w")


def mine(sample: DataFrame, most: int) -> list[str]:
    """Terms that mark the toxic rows of the sample: frequent among them and rare elsewhere."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a term and task."""
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found: set[str] = set()
                for w in words_of(text.lower()):
                    found.update(terms_of(w))
                seen[y].update(found)
        keys = sorted(seen[0].keys() | seen[1].keys())
        for at in range(0, len(keys), 20000):
            part = keys[at : at + 20000]
            cols = [pa.array(part), pa.array([seen[1][k] for k in part], pa.int64()), pa.array([seen[0][k] for k in part], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["term", "pos", "neg"])

    sample = sample.groupBy("_text").agg(F.max("_y").alias("_y"))
    n = sample.agg(F.sum("_y"), F.sum(F.lit(1) - F.col("_y"))).first()
    if not n[0] or not n[1]:
        return []
    rates = F.log((F.col("pos") + 0.5) / (F.lit(n[0]) + 1.0)) - F.log((F.col("neg") + 0.5) / (F.lit(n[1]) + 1.0))
    counted = sample.select("_text", "_y").mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # few texts prove nothing: they may be copies of each other
    strong = counted.where(F.col("pos") >= max(4.0, 0.01 * n[0])).withColumn("gain", rates).where("gain > 2").withColumn("score", F.col("gain") * F.sqrt("pos"))
    best = strong.orderBy(F.desc("score"), "term").limit(4 * most).collect()  # at most 4 x MINED rows
    kept: dict[str, int] = {}
    for r in best:
        # a term inside a kept beginning adds nothing if it marks hardly more
        inside = [kept[r.term[:k]] for k in _LENGTHS if r.term[:k] in kept and r.term[:k] != r.term]
        if not inside and len(kept) < most:
            kept[r.term] = r.pos
    return list(kept)


class Voters:
    """Which voters fire on a text: lexicons, patterns, then mined terms."""

    def __init__(self, mined: list[str]):
        self.mined = mined
        self.size = len(LEXICONS) + len(PATTERNS) + len(mined)
        self.patterns = [re.compile(p) for p in PATTERNS.values()]
        self.terms: dict[str, list[int]] = {}
        for i, ws in enumerate(LEXICONS.values()):
            for w in ws:
                self.terms.setdefault(w + "$", []).append(i)
        for i, t in enumerate(mined):
            self.terms.setdefault(t, []).append(len(LEXICONS) + len(PATTERNS) + i)
        self.known: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[word] = tuple(i for t in terms_of(word) for i in self.terms.get(t, ()))
        return got

    def fired(self, text: str) -> list[int]:
        low = text.lower()
        out: set[int] = set()
        for w in words_of(low):
            out.update(self.of_word(w))
        out.update(len(LEXICONS) + i for i, p in enumerate(self.patterns) if p.search(low))
        return sorted(out)


def label_model(votes: np.ndarray, gold: np.ndarray, weight: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior of the toxic class for each row, and what was estimated.

    ``votes``: rows x voters, 0 or 1. ``gold``: 1, 0 or -1 (silent). Each voter has
    a firing rate in either class; the discount of a voter is the reciprocal of
    one plus its positive correlations, given the class, with the others.
    """
    n, m = votes.shape
    v = votes.astype(np.float64)
    spoken = gold >= 0
    fixed = v[:, : len(LEXICONS)].max(axis=1, initial=0) if m else np.zeros(n)
    q = np.where(spoken, np.where(gold == 1, 0.97, 0.03), 0.05 + 0.85 * fixed)
    share = np.ones(m)
    right = 0.97
    total = weight.sum()
    for r in range(rounds):
        pos, neg = weight * q, weight * (1 - q)
        prior = (pos.sum() + 1) / (total + 20)
        hit = (pos @ v + 0.5) / (pos.sum() + 5)
        false = (neg @ v + 0.05) / (neg.sum() + 5)
        hit, false = np.clip(hit, 1e-4, 1 - 1e-4), np.clip(false, 1e-5, 1 - 1e-4)
        if r % 5 == 0 and m:
            rest = v - (q[:, None] * hit + (1 - q)[:, None] * false)
            cov = (rest * weight[:, None]).T @ rest
            sd = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
            corr = cov / sd[:, None] / sd[None, :]
            np.fill_diagonal(corr, 0)
            share = 1 / (1 + np.where(corr > 0.1, corr, 0).sum(axis=1))
        odds = np.log(prior / (1 - prior)) + v @ (share * np.log(hit / false)) + (1 - v) @ (share * np.log((1 - hit) / (1 - false)))
        said = np.log(right / (1 - right))
        odds += np.where(spoken, np.where(gold == 1, said, -said), 0)
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if spoken.any():
            agree = np.where(gold == 1, q, 1 - q)[spoken]
            right = float(np.clip((weight[spoken] @ agree + 9.7) / (weight[spoken].sum() + 10), 0.8, 0.999))
    return q, {"hit": hit, "false": false, "share": share, "prior": np.array([prior]), "gold": np.array([right])}


def _features(votes: np.ndarray) -> np.ndarray:
    """Votes, the number of voters that fired on a log scale, whether any did, and a constant."""
    n = votes.sum(axis=1, dtype=np.float64)
    return np.concatenate([votes.astype(np.float64), np.log1p(n)[:, None], (n > 0)[:, None], np.ones((len(votes), 1))], axis=1)


def train(votes: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on soft targets by Newton steps; the last coefficient is the constant."""
    x = _features(votes)
    b = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (target - p)) - keep * b
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(curve, grad)
        b += step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return b


def _votes(rows: list[list[int]], size: int) -> np.ndarray:
    out = np.zeros((len(rows), size), np.uint8)
    for i, r in enumerate(rows):
        out[i, r] = 1
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", size: int = SAMPLE, most: int = MINED) -> tuple[list[str], np.ndarray]:
    """Mined terms and coefficients."""
    small_batches(docs.sparkSession)
    sample = written(training_rows(docs, labels, id_col, text_col, label, size), "toxicity-sample")
    mined = mine(sample, most)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(mined)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([voters.fired(t) for t in b.column(0).to_pylist()], pa.list_(pa.int32())), b.column(1), b.column(2)], ["fired", "y", "w"])

    rows = sample.select("_text", "_y", "_w").mapInArrow(vote, "fired array<int>, y int, w double").toArrow()  # at most 2 x SAMPLE rows
    voters = Voters(mined)
    ordered = sorted(zip(*(rows.column(c).to_pylist() for c in ("fired", "y", "w"))))  # sums do not depend on the order of arrival
    fired, gold, weight = [r[0] for r in ordered], np.array([r[1] for r in ordered], int), np.array([r[2] for r in ordered], float)
    if len(set(gold.tolist())) < 2:
        # nothing to learn from: ten rows for each lexicon alone and as many silent ones say what the lists mean
        n = 10 * len(LEXICONS)
        votes = _votes([[i % len(LEXICONS)] for i in range(n)] + [[]] * n, voters.size)
        return mined, train(votes, np.repeat([0.95, 0.02], n), np.ones(2 * n))
    votes = _votes(fired, voters.size)
    q, _ = label_model(votes, gold, weight)
    return mined, train(votes, q, weight)


def score(docs: DataFrame, mined: list[str], coefficients: np.ndarray, text_col: str = "text") -> DataFrame:
    """``rest`` and ``text`` (see ``packed``) with ``score``."""
    coefs = coefficients.tolist()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(mined)
        for b in batches:
            out = []
            for t in b.column(1):
                fired = voters.fired(t.as_py() or "")
                z = coefs[-1] + (coefs[-3] * np.log1p(len(fired)) + coefs[-2] if fired else 0.0) + sum(coefs[i] for i in fired)
                out.append(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], ["rest", "text", "score"])

    rows = packed(docs, text_col)
    return rows.mapInArrow(rate, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    return score(docs, *fit(docs, labels), text_col).where(F.col("score") < threshold).select(*unpacked(docs.columns, text_col))


@query("op1_toxicity_scores")
def op1_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated = score(docs.select("doc_id", "text"), *fit(docs, table(spark, sf_dir, "labels")))
    return rated.select("rest.doc_id", held_out("rest.doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
