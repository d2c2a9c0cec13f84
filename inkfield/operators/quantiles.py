"""Exact order statistics by refined histograms: some scans with counts of a fixed size, no map of all values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a histogram.
BINS = 4_096


def at_ranks(values: DataFrame, column: str, ranks: list[int], bins: int = BINS) -> dict[int, float]:
    """The values of some ranks (from 0, in ascending order) of a numeric column without nulls and NaN.

    Each scan counts every open interval in bins of even width, with the bins' extremes; a bin that holds one value is settled, the others that hold a wanted
    rank are the next scan's intervals. An interval's extremes lie in different bins, so each scan narrows it; two or three do for
    most columns.
    """
    v = values.select(F.col(column).cast("double").alias("v"))
    n, low, high = v.agg(F.count("v"), F.min("v"), F.max("v")).first()
    found: dict[int, float] = {}
    # (low, high, rows before it): the intervals that hold wanted ranks.
    todo = {(low, high, 0): sorted(set(ranks))} if n else {}
    while todo:
        spans = []
        for (low, high, before), own in todo.items():
            if low == high:
                found |= dict.fromkeys(own, low)
            else:
                spans.append((low, high, before, own))
        todo = {}
        if not spans:
            break
        # Of a value, its interval and its bin; quarters of very large values, as their difference may not be a double.
        which, bin_ = F.lit(None).cast("int"), F.lit(None).cast("long")
        for k, (low, high, _, _) in enumerate(spans):
            inside = F.col("v").between(low, high)
            part = 4.0 if max(-low, high) > 1e300 else 1.0
            share = (F.col("v") / part - F.lit(low / part)) / F.lit(high / part - low / part)
            which = F.when(inside, k).otherwise(which)
            bin_ = F.when(inside, F.floor(share * bins)).otherwise(bin_)
        counted = v.select(which.alias("k"), bin_.alias("bin"), "v").filter("k IS NOT NULL").groupBy("k", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        rows = sorted(tuple(r) for r in counted.collect())  # BINS + 1 rows an interval, one or two intervals a wanted share
        for k, (_, _, before, own) in enumerate(spans):
            at, left = before, list(own)
            for kk, _, n, low, high in rows:
                if kk == k:
                    here = [r for r in left if at <= r < at + n]
                    if here:
                        todo[low, high, at] = here
                    at += n
    return found


def percentiles(values: DataFrame, column: str, shares: list[float], bins: int = BINS) -> list[float | None]:
    """Exact percentiles with linear interpolation between neighbours; nulls and NaN are left out. Without values: None."""
    kept = values.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    n = kept.count()
    if not n:
        return [None] * len(shares)
    places = [share * (n - 1) for share in shares]
    got = at_ranks(kept, "v", [r for p in places for r in (int(p), min(int(p) + 1, n - 1))], bins)
    return [got[int(p)] + (got[min(int(p) + 1, n - 1)] - got[int(p)]) * (p - int(p)) for p in places]
