"""Operator 2: SimHash near-duplicates by a self-join of binary tries.

Fingerprints. One Arrow pass over whole texts; equal fingerprints are pre-aggregated, so a
group of exact copies is one row from there on.

Join. Two fingerprints within 4 of 64 bits agree on one of 5 blocks of bits, and on two of 6: the
keys are single blocks, or pairs of blocks once there are so many fingerprints that a block's values are few for them.
For each key, the distinct fingerprints that share its value form a binary trie (their sorted bits, a
single shared block rotated to the front). The trie is joined with itself: pairs of nodes are
traversed together, differing bits are accumulated, and a pair is pruned once they exceed
the budget, or once both of its subtrees already lie in the same component. The second rule
is why a dense cluster emits a spanning forest (at most one link a fingerprint) and never
all of its pairs; no connection is lost.

A value that holds more than ``PER_TASK`` fingerprints is dealt to several tasks:
its fingerprints are salted into c classes, and each task joins two of the classes.

Components. Links become components by alternating star contraction (``operators.graph.contracted``).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import graph
from .common import as_batch, batches, join_counted, pieces, shuffle_width, stash, table, text_or_empty

SEED = 42
SHINGLE = 4
BUDGET = 4
#: Lengths of the blocks of bits; one more block than bits may differ, or two more.
FIVE, SIX = (13, 13, 13, 13, 12), (11, 11, 11, 11, 10, 10)
#: Fingerprints up to which single blocks are the keys; and fingerprints of one key that are joined in one task.
SINGLE_UP_TO, PER_TASK = 1 << 26, 1 << 16
#: Hot values that are broadcast at most.
MOST_HOT = 1_000_000
ROWS_PER_TASK = 400_000
#: Trie nodes of at most this many fingerprints are compared outright.
LEAF = 8
FRONTIER = 200_000

#: Stands for a null id in joins, beside a flag.
NO_ID = -1

_LOWER = bytes(b + 32 if 65 <= b <= 90 else (32 if 9 <= b <= 13 else b) for b in range(256))


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n <= SHINGLE:
        h = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: n - SHINGLE + 1].tolist()
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n - SHINGLE + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65_536):
        ones += np.unpackbits(h[at : at + 65_536].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


_FP_SCHEMA = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp): one row for each row of ``docs``; fp is the fingerprint as a signed long. A null text counts as empty."""

    def run(it):
        for b in batches(it, 256):
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield as_batch({"doc_id": b.column(0), "fp": fps}, _FP_SCHEMA)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(docs, text_column).alias("t")).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- trie self-join


def _roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after uniting the sets of labels ``a`` and ``b`` pairwise; a set's label is its smallest member."""
    parent = np.arange(len(label))
    a, b = label[a], label[b]
    while len(a):
        ra, rb = parent[a], parent[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        keep = low != high
        if not keep.any():
            break
        a, b, low, high = a[keep], b[keep], low[keep], high[keep]
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent[label]


def join_tries(group: np.ndarray, bits: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For each of the entries, the index of the smallest entry of its component.

    ``group`` and ``bits`` (uint64) must be sorted together, group first. Two entries link if
    they are of one group and differ in at most ``budget`` bits. All tries are traversed at
    once; the stack holds blocks of node pairs, deepest on top, so memory is bounded by
    the depth times ``FRONTIER`` pairs.
    """
    n = len(bits)
    label = np.arange(n)
    if n < 2:
        return label
    edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    lo, hi = edge[:-1], edge[1:]
    big = hi - lo > 1
    # A stack entry: depth, and arrays lo1, hi1, lo2, hi2, bits spent. Node [lo, hi) shares its first ``depth`` bits.
    stack = [(0, lo[big], hi[big], lo[big], hi[big], np.zeros(int(big.sum()), dtype=np.int64))]
    changes = np.zeros(n + 1, dtype=np.int64)

    def relabel(a, b):
        nonlocal label
        label = _roots(label, a, b)
        np.cumsum(np.concatenate(([0, 0], label[1:] != label[:-1])), out=changes)

    relabel(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
    while stack:
        depth, l1, h1, l2, h2, spent = stack.pop()
        if len(l1) > FRONTIER:
            stack.append((depth, l1[FRONTIER:], h1[FRONTIER:], l2[FRONTIER:], h2[FRONTIER:], spent[FRONTIER:]))
            l1, h1, l2, h2, spent = (x[:FRONTIER] for x in (l1, h1, l2, h2, spent))
        # Prune pairs whose subtrees are whole in one component.
        one = (changes[h1] == changes[l1 + 1]) & (changes[h2] == changes[l2 + 1]) & (label[l1] == label[l2])
        if one.any():
            l1, h1, l2, h2, spent = (x[~one] for x in (l1, h1, l2, h2, spent))
        if not len(l1):
            continue
        n1, n2 = h1 - l1, h2 - l2
        small = (n1 * n2 <= LEAF * LEAF) | (depth >= 64)
        if small.any():
            a, b = _outright(l1[small], n1[small], l2[small], n2[small])
            ok = np.bitwise_count(bits[a] ^ bits[b]) <= budget
            relabel(a[ok], b[ok])
            l1, h1, l2, h2, spent = (x[~small] for x in (l1, h1, l2, h2, spent))
        if not len(l1):
            continue
        m1, m2 = _split(bits, l1, h1, depth), _split(bits, l2, h2, depth)
        same = l1 == l2
        cross = [(l1, m1, m2, h2, spent + 1)]
        cross += [(m1[~same], h1[~same], l2[~same], m2[~same], spent[~same] + 1)]
        straight = [(l1, m1, l2, m2, spent), (m1, h1, m2, h2, spent)]
        for parts in (cross, straight):
            q = [np.concatenate([p[k] for p in parts]) for k in range(5)]
            alive = (q[0] < q[1]) & (q[2] < q[3]) & (q[4] <= budget) & ~((q[0] == q[2]) & (q[1] - q[0] < 2))
            if alive.any():
                stack.append((depth + 1, *(x[alive] for x in q)))
    return label


def _outright(l1, n1, l2, n2):
    """All index pairs of small node pairs (a node with itself: each pair at least once)."""
    size = n1 * n2
    total = int(size.sum())
    which = np.repeat(np.arange(len(size)), size)
    k = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    return l1[which] + k // n2[which], l2[which] + k % n2[which]


def _split(bits, lo, hi, depth):
    """First index in each [lo, hi) whose bit at ``depth`` is set (bits above are equal there)."""
    lo, hi, at = lo.copy(), hi.copy(), np.uint64(63 - depth)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        one = (bits[np.minimum(mid, len(bits) - 1)] >> at) & np.uint64(1) == 1
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


_LINK_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def block_keys(n: int) -> list[tuple[list[str], int]]:
    """Keys for ``n`` fingerprints: the SQL terms of a key's value, and the bits to turn left so that a single block is in front (0 for pairs)."""
    lengths, of = (FIVE, 1) if n <= SINGLE_UP_TO else (SIX, 2)
    begin = [sum(lengths[:k]) for k in range(len(lengths))]
    out = []
    for chosen in combinations(range(len(lengths)), of):
        terms, up = [], 0
        for k in reversed(chosen):
            terms.append(f"shiftleft(shiftrightunsigned(fp, {64 - begin[k] - lengths[k]}) & {(1 << lengths[k]) - 1}L, {up})")
            up += lengths[k]
        out.append((terms, begin[chosen[0]] if of == 1 else 0))
    return out


def trie_links(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(a, b): links between distinct fingerprints that keep every connection of the Hamming graph.

    ``fps`` has one column fp of distinct longs. At most one link a fingerprint, key and class.
    """
    if budget != BUDGET:
        raise ValueError("the blocks are laid out for a budget of 4")
    spark = fps.sparkSession
    n = fps.count()
    keys = block_keys(n)
    values = F.array(*[F.struct(F.lit(k).alias("block"), F.expr(" | ".join(f"({part})" for part in parts)).alias("value")) for k, (parts, _) in enumerate(keys)])
    keyed = fps.select("fp", F.explode(values).alias("k")).select("fp", "k.block", "k.value")
    counted = keyed.groupBy("block", "value").count().filter(F.col("count") > PER_TASK)
    hot = stash(counted.select("block", "value", "count", F.ceil(F.col("count") / PER_TASK).cast("int").alias("c")), "simhash-hot")
    if hot.count() <= MOST_HOT:
        spread = keyed.join(F.broadcast(hot.drop("count")), ["block", "value"], "left")
    else:
        spread = join_counted(keyed, hot, ["block", "value"], "count", len(keys) * n, "left").drop("count")
    salted = (
        spread.withColumn("c", F.coalesce("c", F.lit(1)))
        .withColumn("s", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        .select("fp", "block", "value", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"))
    )
    parts = pieces(len(keys) * n, ROWS_PER_TASK, shuffle_width(spark))
    dealt = salted.repartition(parts, "block", "value", "i", "j").select(
        "fp", F.xxhash64("block", "value", "i", "j").alias("g"), "block"
    )
    turn = np.array([at for _, at in keys], dtype=np.uint64)

    def run(it):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in it]
        if not got:
            return
        fp, g, block = (np.concatenate([x[k] for x in got]) for k in range(3))
        u = fp.view(np.uint64)
        r = turn[block]
        bits = np.where(r == 0, u, (u << r) | (u >> ((np.uint64(64) - r) & np.uint64(63))))
        order = np.lexsort((bits, g))
        fp, g, bits = fp[order], g[order], bits[order]
        label = join_tries(g, bits)
        own = np.flatnonzero(label != np.arange(len(label)))
        for at in range(0, len(own), 50_000):
            k = own[at : at + 50_000]
            yield as_batch({"a": fp[k], "b": fp[label[k]]}, _LINK_SCHEMA)

    return dealt.mapInArrow(run, "a long, b long").distinct()


# ---------------------------------------------------------------- components


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fp (signed long), component_id and root (the component's least fingerprint), one row for each row of ``docs``.

    Texts without words have fingerprint 0 and link like any other. Null text: as empty.
    Repeated rows give repeated rows. A null doc_id never becomes a component's id unless all
    of its ids are null (component_id is then null). Empty table: no rows.
    """
    return grouped(stash(fingerprints(docs, id_column, text_column), "simhash-fp"))


def grouped(fp_of: DataFrame) -> DataFrame:
    """``near_duplicates`` of rows (doc_id, fp). Rows of a crowded fingerprint or component meet its name by broadcast."""
    classes = stash(fp_of.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    links = trie_links(classes.select("fp"))
    tied = graph.contracted(links)
    rooted = stash(classes.join(tied, classes.fp == tied.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    names = stash(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "simhash-names")
    total, rows = rooted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    named = stash(join_counted(rooted, names, ["root"], "members", total).select("fp", "component_id", "root", "n"), "simhash-named")
    return join_counted(fp_of, named, ["fp"], "n", rows).select("doc_id", "fp", "component_id", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest doc_id's (null only if all are), of rows with that id the first by text.

    Rows are told apart by id and fingerprint, so other rows of an id stay unless they are near-duplicates too.
    Fingerprints are written beside the rows, so that texts are read by Python once.
    """
    names = docs.columns
    at = names.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("_own_fp_", T.LongType())])

    def run(it):
        for b in batches(it, 256):
            fps = np.array([fingerprint(t or "") for t in b.column(at).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps)], names=[*b.schema.names, "_own_fp_"])

    own = stash(docs.mapInArrow(run, schema), "simhash-rows")
    first_id = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("fp").alias("f"))
    found = grouped(own.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_own_fp_").alias("fp"))).groupBy("root").agg(F.min(first_id).alias("k"))
    kept = stash(found.select(F.coalesce(F.col("k.i"), F.lit(NO_ID)).alias("_id_"), F.col("k.n").alias("_none_"), F.col("k.f").alias("_own_fp_")), "simhash-kept")
    keyed = own.withColumns({"_none_": F.col("doc_id").isNull(), "_id_": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))})
    chosen = keyed.join(kept, ["_id_", "_none_", "_own_fp_"], "left_semi")
    # Of rows with one id and fingerprint, the first by text.
    first = Window.partitionBy("_id_", "_none_", "_own_fp_").orderBy(F.xxhash64("text"), "text")
    return chosen.withColumn("_nth_", F.row_number().over(first)).filter("_nth_ = 1").select(*names)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
