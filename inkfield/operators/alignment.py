"""Global alignment of two versions of a text, sentence by sentence."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Twice the scores, so that they are whole numbers.
MATCH, MISMATCH, GAP = 2, -1, -1


def _rows(top: np.ndarray, a: np.ndarray, b: np.ndarray):
    """The rows of best scores that follow ``top``, one for each of ``a``: a pair or a gap from above first, then gaps from the left, whose best start is a running maximum."""
    slope = np.arange(len(top)) * GAP
    row = top
    for x in a:
        here = np.concatenate(([row[0] + GAP], np.maximum(row[:-1] + np.where(b == x, MATCH, MISMATCH), row[1:] + GAP)))
        row = np.maximum.accumulate(here - slope) + slope
        yield row


def align(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Needleman-Wunsch: index pairs in order, None for a gap; of equal ways a pair before a gap in ``b`` before one in ``a``.

    Every root-th row of scores is kept, and the way back fills in one strip of rows at a time: memory is that of two strips, the longer side times twice the root of the
    shorter, and each score is taken twice.
    """
    if len(a) > len(b):  # the longer side along the rows; ties are the same, as a pair comes first either way
        turned = _traced(b, a, True)
        return [(j, i) for i, j in turned]
    return _traced(a, b, False)


def _traced(a: list[str], b: list[str], turned: bool) -> list[tuple[int | None, int | None]]:
    number = {s: k for k, s in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.fromiter(map(number.__getitem__, s), dtype=np.int64, count=len(s)) for s in (a, b))
    strip = math.isqrt(len(x)) + 1
    kept = {0: np.arange(len(y) + 1, dtype=np.int64) * GAP}
    for i, row in enumerate(_rows(kept[0], x, y), 1):
        if i % strip == 0:
            kept[i] = row
    out: list[tuple[int | None, int | None]] = []
    i, j = len(x), len(y)
    while i:
        begin = (i - 1) // strip * strip
        rows = [kept[begin], *_rows(kept[begin], x[begin:i], y)]
        while i > begin:
            here, above = rows[i - begin], rows[i - begin - 1]
            up, left = here[j] == above[j] + GAP, j > 0 and here[j] == here[j - 1] + GAP
            if j and here[j] == above[j - 1] + (MATCH if x[i - 1] == y[j - 1] else MISMATCH):
                i, j = i - 1, j - 1
                out.append((i, j))
            elif up and not (turned and left):
                i -= 1
                out.append((i, None))
            else:
                j -= 1
                out.append((None, j))
    out += [(None, k) for k in range(j - 1, -1, -1)]
    return out[::-1]


def alignment_score(a: list[str], b: list[str], pairs: list[tuple[int | None, int | None]]) -> float:
    """What an alignment scores: 1 a match, -0.5 a changed sentence or a gap."""
    return sum(GAP if i is None or j is None else MATCH if a[i] == b[j] else MISMATCH for i, j in pairs) / 2


def align_versions(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, n, i, j, kind) for each key's two sentence tables (key, n, text): same, changed, deleted or inserted.

    Each key's two versions meet in one task, whose memory grows with the longer version times the root of the shorter.
    """

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        s, t = x.sort_values("n")["text"].tolist(), y.sort_values("n")["text"].tolist()
        k = (x if len(x) else y)[key].iloc[0]
        kind = lambda i, j: "inserted" if i is None else "deleted" if j is None else "same" if s[i] == t[j] else "changed"
        rows = [(k, n, -1 if i is None else i, -1 if j is None else j, kind(i, j)) for n, (i, j) in enumerate(align(s, t))]
        return pd.DataFrame(rows, columns=[key, "n", "i", "j", "kind"])

    kind = a.schema[key].dataType.simpleString()
    return a.select(key, "n", "text").groupBy(key).cogroup(b.select(key, "n", "text").groupBy(key)).applyInPandas(run, f"{key} {kind}, n int, i int, j int, kind string")


def constrained(aligned: DataFrame, similarity: DataFrame, key: str, least: float = 0.7) -> DataFrame:
    """(key, i, j, score): aligned pairs that are similar enough; ``similarity`` has (key, i, j, score)."""
    return aligned.filter("i >= 0 AND j >= 0").select(key, "i", "j").join(similarity.filter(F.col("score") >= least), [key, "i", "j"])


def alignment_scores(aligned: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """(key, score, unmatched_a, unmatched_b): the mean of the kept pairs (0 without any), and how many sentences of each side have none."""
    sides = aligned.groupBy(key).agg(F.sum((F.col("i") >= 0).cast("long")).alias("n_a"), F.sum((F.col("j") >= 0).cast("long")).alias("n_b"))
    got = kept.groupBy(key).agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return sides.join(got, key, "left").select(key, F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"), (F.col("n_a") - n).alias("unmatched_a"), (F.col("n_b") - n).alias("unmatched_b"))


def difference_kind(a: Column, b: Column, normal_a: Column, normal_b: Column, plain_a: Column, plain_b: Column) -> Column:
    """The class of a difference of two texts; ``normal`` are they with variants folded, ``plain`` with taboo characters put back."""
    chars = lambda c: F.array_sort(F.split(c, ""))
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(a.eqNullSafe(b), "SAME").when(empty(a), "INSERTION").when(empty(b), "DELETION").when(normal_a == normal_b, "VARIANT")
        .when(plain_a == plain_b, "TABOO").when(chars(a) == chars(b), "TRANSPOSITION").otherwise("SUBSTITUTION")
    )


def judged(differences: DataFrame) -> DataFrame:
    """Differences (kind, a, b, year_a, year_b, original) with ``choice``, ``rule`` and ``confidence``, by the first rule that holds.

    Taboo: the original character; variant: the shorter text; known years: the earlier version; else the first text.
    """
    taboo, variant = F.col("kind") == "TABOO", F.col("kind") == "VARIANT"
    dated = F.col("year_a").isNotNull() & F.col("year_b").isNotNull()
    by = lambda t, v, d, o: F.when(taboo, t).when(variant, v).when(dated, d).otherwise(o)
    shorter = F.when(F.length("b") < F.length("a"), F.col("b")).otherwise(F.col("a"))
    earlier = F.when(F.col("year_b") < F.col("year_a"), F.col("b")).otherwise(F.col("a"))
    return differences.withColumns({
        "choice": by(F.col("original"), shorter, earlier, F.col("a")),
        "rule": by(F.lit("TABOO_FIRST"), F.lit("GRAPHIC_SIM"), F.lit("CHRONOLOGY"), F.lit("CONTEXT_SCORE")),
        "confidence": by(F.lit(0.9), F.lit(0.85), F.lit(0.75), F.lit(0.3)),
    })


def difference_kinds(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
