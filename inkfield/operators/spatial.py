"""A stored layout in Z-order: a box becomes some ranges of the order, and only files that these meet are read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pages import FILE_ROWS, Pages, store
from .relational import in_box, parse_box

#: Bits of each coordinate in the order; ranges that a box becomes, about.
BITS, RANGES = 16, 64


def interleaved(x: Column, y: Column) -> Column:
    """Bits of two whole numbers of ``BITS`` bits, taken in turn."""

    def spread(v: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def box_ranges(x0: int, y0: int, x1: int, y1: int, bits: int = BITS, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges (first, last) of the order that together hold a box of whole coordinates, ends included; squares at its border are split while there are fewer than ``most``."""
    found, border = [], [(0, 0, 0, bits)]
    while border:
        if len(border) + len(found) >= most:
            return _merged(found + [(z, z + (1 << 2 * b) - 1) for z, _, _, b in border])
        nearer = []
        for z, x, y, b in border:
            side = (1 << b) - 1
            if x > x1 or y > y1 or x + side < x0 or y + side < y0:
                continue
            if x0 <= x and y0 <= y and x + side <= x1 and y + side <= y1:
                found.append((z, z + (1 << 2 * b) - 1))
            else:
                half, quarter = 1 << (b - 1), 1 << 2 * (b - 1)
                nearer += [(z + k * quarter, x + half * (k & 1), y + half * (k >> 1), b - 1) for k in range(4)]
        border = nearer
    return _merged(found)


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


@dataclass
class Layout:
    spark: SparkSession
    path: str

    def __post_init__(self):
        self.pages = Pages(self.spark, f"{self.path}/points", ["_z", "uri"])
        self.extent = self.spark.read.parquet(f"{self.path}/extent").first().asDict()

    def box(self, box: str) -> tuple[DataFrame, DataFrame]:
        """(points inside "x0,y0,x1,y1", bounds included; one row of files, files_read, rows, rows_read)."""
        x0, y0, x1, y1 = parse_box(box)
        files, e = self.pages.files, self.extent
        low = [_whole(v, e[f"lo{c}"], e[f"hi{c}"]) for v, c in ((x0, "x"), (y0, "y"))]
        high = [_whole(v, e[f"lo{c}"], e[f"hi{c}"]) for v, c in ((x1, "x"), (y1, "y"))]
        met = F.lit(False)
        for first, last in box_ranges(*low, *high) if e["lox"] is not None else []:
            met = met | ((F.col("low._z") <= last) & (F.col("high._z") >= first))
        chosen = files.withColumn("met", met)
        parts = [r["part"] for r in chosen.filter("met").select("part").collect()]
        report = chosen.agg(F.count(F.lit(1)).alias("files"), F.count_if("met").alias("files_read"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("met"), F.col("n"))), F.lit(0)).alias("rows_read"))
        return in_box(self.pages._of(parts), box).drop("_z"), report


def _whole(v: float, low: float | None, high: float | None) -> int:
    """A coordinate as a whole number of ``BITS`` bits; what lies outside the extent goes to its edge."""
    if low is None or high <= low:
        return 0
    return min(max(int((v - low) / (high - low) * ((1 << BITS) - 1)), 0), (1 << BITS) - 1)


def store_layout(points: DataFrame, path: str, file_rows: int = FILE_ROWS) -> Layout:
    """Write points (uri, x, y and more) in Z-order. Points without a coordinate are in no box and are left out; an empty table gives an empty layout."""
    spark = points.sparkSession
    kept = points.filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    kept.agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))]).write.parquet(f"{path}/extent")
    e = spark.read.parquet(f"{path}/extent").first().asDict()

    def whole(c: str) -> Column:
        low, high = e[f"lo{c}"], e[f"hi{c}"]
        if low is None or high <= low:
            return F.lit(0).cast("long")
        share = (F.col(c).cast("double") - F.lit(float(low))) / F.lit(float(high) - float(low)) * F.lit(float((1 << BITS) - 1))
        return share.cast("long")

    store(kept.withColumn("_z", interleaved(whole("x"), whole("y"))), f"{path}/points", ["_z", "uri"], file_rows)
    return Layout(spark, path)
