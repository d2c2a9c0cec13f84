"""Operator 4: quality classifier by regularised quadratic discriminant analysis.

One Arrow pass turns each whole text into transformed statistics (logs, square roots of
rates). Sums of each class's training rows (counts, first and second moments) are
aggregated in Spark and only they come to the driver. Class covariances are shrunk towards
the pooled one and its diagonal; their Cholesky factors are cached in the model, and a score
is the logistic of the difference of the two log-densities (Mahalanobis distances by
triangular products) plus the log-odds of the classes.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_batch, batches, stash, table, text_or_empty
from .quality_rules import STOPWORDS

FEATURES = (
    "log_words", "log_chars", "word_length", "word_spread", "symbols", "capitals", "digits", "shouting", "stops",
    "distinct", "pairs_distinct", "stopwords", "top_word", "dup_lines", "line_length", "non_ascii", "entropy", "short_words",
)
DIM = len(FEATURES)
#: Share of the pooled covariance in each class's, then of its diagonal, then of the identity.
TO_POOLED, TO_DIAGONAL, RIDGE = 0.80, 0.01, 1e-3
#: Rows of pseudo-count in the class shares, so that a missing class gives a defined score.
PSEUDO = 1.0

_SPACE = bytes(32 if 9 <= b <= 13 else b for b in range(256))
_STOP = frozenset(w.encode() for w in STOPWORDS)


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text; all defined for an empty one."""
    raw = text.encode("utf-8", "surrogatepass")
    words = [w for w in raw.translate(_SPACE).lower().split(b" ") if w]
    n, size = len(words), len(raw)
    of = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256).astype(np.float64)
    per_word = 1.0 / max(n, 1)
    per_byte = 1.0 / max(size, 1)
    lens = np.fromiter(map(len, words), dtype=np.float64, count=n) if n else np.zeros(1)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    p = of[of > 0] * per_byte
    root = lambda x: math.sqrt(min(max(x, 0.0), 4.0))
    return [
        math.log1p(n),
        math.log1p(size),
        math.log1p(float(lens.mean())),
        math.log1p(float(lens.std())),
        root(sum(of[ord(c)] for c in "#*$%&|<>") * per_word),
        root(of[65:91].sum() * per_byte),
        root(of[48:58].sum() * per_byte),
        root(of[ord("!")] * per_word),
        root((of[ord(".")] + of[ord(",")]) * per_word),
        len(seen) * per_word,
        len(set(zip(words, words[1:], strict=False))) * per_word,
        root(sum(c for w, c in seen.items() if w in _STOP) * per_word),
        root(max(seen.values(), default=0) * per_word),
        root((len(lines) - len(set(lines))) / max(len(lines), 1)),
        math.log1p(size / max(len(lines), 1)),
        root(of[128:].sum() * per_byte),
        float(-(p * np.log(p)).sum()) if size else 0.0,
        root(float((lens <= 2).mean()) if n else 0.0),
    ]


_X_SCHEMA = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])


def document_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    def run(it):
        for b in batches(it, 256):
            yield as_batch({"doc_id": b.column(0), "x": [statistics(t) for t in b.column(1).to_pylist()]}, _X_SCHEMA)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(docs, text_column).alias("t")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    log_odds: float
    mean: np.ndarray  # 2 x d
    whiten: np.ndarray  # 2 x d x d: inverse Cholesky factors
    log_det: np.ndarray  # 2

    def score(self, x: np.ndarray) -> np.ndarray:
        part = [((x - self.mean[c]) @ self.whiten[c].T) for c in (0, 1)]
        delta = self.log_odds + 0.5 * ((part[0] ** 2).sum(axis=1) + self.log_det[0] - (part[1] ** 2).sum(axis=1) - self.log_det[1])
        return 1.0 / (1.0 + np.exp(-np.clip(delta, -500, 500)))


def solve(n: np.ndarray, first: np.ndarray, second: np.ndarray) -> Discriminant:
    """From counts (2), sums (2 x d) and sums of products (2 x d x d) of the classes. Without rows of a class its mean and covariance are the pooled ones."""
    d = first.shape[1]
    total = n.sum()
    if total == 0:
        return Discriminant(0.0, np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2))
    whole = first.sum(axis=0) / total
    mean = np.stack([first[c] / n[c] if n[c] else whole for c in (0, 1)])
    scatter = [second[c] - n[c] * np.outer(mean[c], mean[c]) for c in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / total
    floor = RIDGE * (np.trace(pooled) / d + 1e-6) * np.eye(d)
    whiten, log_det = [], []
    for c in (0, 1):
        own = scatter[c] / n[c] if n[c] > 1 else pooled
        cov = (1 - TO_POOLED) * own + TO_POOLED * pooled
        cov = (1 - TO_DIAGONAL) * cov + TO_DIAGONAL * np.diag(np.diag(cov)) + floor
        low = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(low))
        log_det.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(math.log((n[1] + PSEUDO) / (n[0] + PSEUDO)), mean, np.stack(whiten), np.array(log_det))


_PART_SCHEMA = pa.schema([("c", pa.int32()), ("k", pa.int32()), ("v", pa.float64())])


def fit(rows: DataFrame) -> Discriminant:
    """From rows (x, quality 0/1): partial sums in each partition, then one row for each class and moment (2 x 343)."""
    d = DIM

    def sums(it):
        acc = np.zeros((2, 1 + d + d * d))
        for b in it:
            x = np.array(b.column(0).flatten().to_numpy(zero_copy_only=False)).reshape(-1, d)
            y = b.column(1).to_numpy()
            for c in (0, 1):
                z = x[y == c]
                acc[c] += np.concatenate(([len(z)], z.sum(axis=0), (z.T @ z).ravel()))
        for c in (0, 1):
            if acc[c, 0]:
                yield as_batch({"c": [c] * acc.shape[1], "k": range(acc.shape[1]), "v": acc[c]}, _PART_SCHEMA)

    got = np.zeros((2, 1 + d + d * d))
    for c, k, v in rows.select("x", F.col("quality").cast("int")).mapInArrow(sums, "c int, k int, v double").groupBy("c", "k").agg(F.sum("v")).collect():
        got[c, k] = v
    return solve(got[:, 0], got[:, 1 : 1 + d], got[:, 1 + d :].reshape(2, d, d))


def held_out() -> F.Column:
    """crc32 of the doc_id as text is 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


_S_SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``.

    Learns only from labelled rows that are not held out; repeated labels of an id count once
    (the larger), null labels not at all. Null text: as empty, which has a score too. Without
    labels every score is 0.5. Repeated rows are scored alike; an empty table gives no rows.
    """
    stats = stash(document_statistics(docs), "op4-stats")
    marks = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    train = stats.filter(~held_out()).join(marks, "doc_id")
    model = fit(train)

    def run(it):
        for b in it:
            x = np.array(b.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, DIM)
            yield as_batch({"doc_id": b.column(0), "score": model.score(x)}, _S_SCHEMA)

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects.

    The statistics are written beside the rows, so that texts are read by Python once; scores depend on them alone.
    """
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("_x_", T.ArrayType(T.DoubleType()))])

    def run(it):
        for b in batches(it, 256):
            x = pa.array([statistics(t or "") for t in b.column(at).to_pylist()], type=pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, x], names=[*b.schema.names, "_x_"])

    rows = stash(docs.mapInArrow(run, schema), "op4-rows")
    marks = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_x_").alias("x"))
    model = fit(known.filter(~held_out()).join(marks, "doc_id"))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else [])

    return rows.filter(score("_x_") >= 0.5).drop("_x_")
