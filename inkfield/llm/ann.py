"""Operator 8: approximate nearest neighbours by cross-polytope hashing.

Equal vectors are one entry first (with their smallest ids, as many as a result can use).
Each of several tables applies pseudo-random rotations, three rounds of random signs and a
fast Hadamard transform each, to the unit vector and files it under the nearest signed axis of each: a
bucket is one axis of each rotation, and there are as many rotations in a table as keep buckets small
(``hashes_for``). A query probes, in every table, the buckets whose axes have the largest sums of signed
coordinates. Buckets are dealt by their leading axes to cells of about ``PER_CELL`` entries, so that a query's buckets share cells; entries and queries meet by (table, cell), where a
query carries its probed buckets; a cell that crowded buckets overfill is salted over several tasks.

Every query is compared with a bounded sample of the entries too: its k-th best there is a lower bound
of its k-th best of all, and what probing finds below it is dropped at once. The rest is merged.

Nothing is capped. Norms fall into bands within which the largest inner products
are the smallest angles, up to ``BAND``; the tables hold every row of the bands that are
large enough for probing to find the best of each. The rows of small bands, such as a few
long vectors that may be best at any angle, are compared with every query.
"""

from __future__ import annotations

import math
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_batch, pieces, shuffle_width, stash, table

N_NEAREST = 20
#: Tables; buckets of two axes that a query probes in each at 2,000 entries, and the power of the entries by which they grow fewer,
#: as the nearest get nearer; buckets of three and four axes.
TABLES = 16
PROBES, PROBES_POWER, PROBES_3, PROBES_4 = 300, -0.3, 2_000, 12_000
#: Entries of one bucket on average, up to which a table needs no further rotation.
BUCKET_ENTRIES = 64
#: Entries that every query is compared with, about, and never more than an eighth of all.
SAMPLE = 2_048
SEED = 7_001
#: Entries of a cell; one with twice as many is salted. Salted cells that are broadcast at most.
PER_CELL, MOST_SALTED = 8_192, 1_000_000
ROWS_PER_TASK = 100_000
#: Ratio of the norms in one band, and the entries from which on a band is probed rather than scanned.
BAND, PROBED_FROM = 1.1, 1_024
#: Entries, and queries, of one block of a scan.
SCAN_ENTRIES, SCAN_QUERIES = 8_192, 1_024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the orthonormal Hadamard matrix, in n log n; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, which: int, seed: int = SEED) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64([seed, which]))
    for _ in range(3):
        x = hadamard(x * rng.choice(np.array([-1.0, 1.0]), x.shape[1]))
    return x


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Unit vectors padded to a power of two."""
    out = np.zeros((len(x), 1 << max(0, (x.shape[1] - 1).bit_length())))
    out[:, : x.shape[1]] = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return out


def axes(x: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` signed axes nearest to each row, nearest first: 2 * axis, plus 1 on the positive side."""
    signed = np.stack([-x, x], axis=2).reshape(len(x), -1)
    probes = min(probes, signed.shape[1])
    near = np.argpartition(-signed, probes - 1, axis=1)[:, :probes]
    order = np.argsort(-np.take_along_axis(signed, near, axis=1), axis=1, kind="stable")
    return np.take_along_axis(near, order, axis=1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def hashes_for(n: int, width: int) -> int:
    """Axes in a bucket for ``n`` entries and ``width`` signed axes: two at least."""
    return next((k for k in (2, 3) if n <= BUCKET_ENTRIES * width**k), 4)


def probes_for(n: int, k: int) -> int:
    """Buckets of ``k`` axes that a query probes in each table of ``n`` entries."""
    return {3: PROBES_3, 4: PROBES_4}.get(k) or math.ceil(PROBES * (n / 2_000) ** PROBES_POWER)


@cache
def rank_tuples(k: int, probes: int, width: int) -> np.ndarray:
    """Ranks of axes (0: the nearest), k at a time, among which the ``probes`` best sums are: those that have no ``probes`` others at least as good in every place."""
    rows: list[tuple] = [()]
    for _ in range(k):
        rows = [(*r, i) for r in rows for i in range(width) if math.prod(x + 1 for x in r) * (i + 1) <= probes]
    return np.array(rows)


def buckets(x: np.ndarray, table: int, k: int) -> np.ndarray:
    """The number of each unit vector's bucket in a table: its nearest axes, one after the other."""
    code = np.zeros(len(x), dtype=np.int64)
    for j in range(k):
        code = code * (2 * x.shape[1]) + axes(rotate(x, table + 1_000 * j), 1)[:, 0]
    return code


def probed(x: np.ndarray, table: int, k: int, probes: int) -> np.ndarray:
    """The numbers of the buckets that each unit vector probes in a table, one row each."""
    width = 2 * x.shape[1]
    ranks = rank_tuples(k, probes, width)
    total, order = np.zeros((len(x), len(ranks))), []
    for j in range(k):
        y = rotate(x, table + 1_000 * j)
        signed = np.stack([-y, y], axis=2).reshape(len(x), -1)
        order.append(np.argsort(-signed, axis=1, kind="stable"))
        total += np.take_along_axis(signed, order[j], axis=1)[:, ranks[:, j]]
    some = min(probes, len(ranks))
    best = np.argpartition(-total, some - 1, axis=1)[:, :some]
    code = np.zeros(best.shape, dtype=np.int64)
    for j in range(k):
        code = code * width + np.take_along_axis(order[j], ranks[:, j][best], axis=1)
    return code


def cells(code: np.ndarray, table: int, n_cells: int, k: int, width: int) -> np.ndarray:
    """The cells that buckets of ``k`` axes are dealt to: by the leading axis, and by the second one where there are more cells than axes.

    The buckets that a query probes share few leading axes, so it goes to few cells.
    """

    def mixed(x: np.ndarray, n: int) -> np.ndarray:
        x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return ((x >> np.uint64(33)) % np.uint64(n)).astype(np.int64)

    first = code // width ** (k - 1)
    if n_cells <= width or k == 1:
        return table * n_cells + mixed(first, n_cells)
    each = -(-n_cells // width)
    return table * (each * width) + first * each + mixed(code // width ** (k - 2), each)


def _vector_type(double: bool) -> pa.DataType:
    return pa.list_(pa.float64() if double else pa.float32())


def file_entries(entries: DataFrame, dim: int, k: int, tables: int, n_cells: int) -> DataFrame:
    """Each entry once in every table, with its cell and bucket."""
    double = dict(entries.dtypes)["embedding"] == "array<double>"
    schema = pa.schema([("gid", pa.int64()), ("cell", pa.int64()), ("bucket", pa.int64()), ("embedding", _vector_type(double)), ("ids", pa.list_(pa.int64()))])

    def run(it):
        for b in it:
            for at in range(0, b.num_rows, 2048):
                c = b.slice(at, 2048)
                u = unit_rows(_matrix(c.column(1), dim))
                for t in range(tables):
                    code = buckets(u, t, k)
                    yield as_batch({"gid": c.column(0), "cell": cells(code, t, n_cells, k, 2 * u.shape[1]), "bucket": code, "embedding": c.column(1), "ids": c.column(2)}, schema)

    return entries.select("gid", "embedding", "ids").mapInArrow(run, f"gid long, cell long, bucket long, embedding array<{'double' if double else 'float'}>, ids array<long>")


def filled(entries: DataFrame, dim: int, k: int, tables: int, n_cells: int) -> DataFrame:
    """(cell, n): how many entries each cell has; vectors do not move for this."""

    def run(it):
        for b in it:
            u = unit_rows(_matrix(b.column(0), dim))
            for t in range(tables):
                cell, n = np.unique(cells(buckets(u, t, k), t, n_cells, k, 2 * u.shape[1]), return_counts=True)
                yield pa.RecordBatch.from_pydict({"cell": cell, "n": n.astype(np.int64)})

    return entries.select("embedding").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def file_queries(queries: DataFrame, dim: int, k: int, tables: int, probes: int, n_cells: int) -> DataFrame:
    """Each query (gid, embedding, bound) once for every cell that it probes, with the probed buckets there."""
    double = dict(queries.dtypes)["embedding"] == "array<double>"
    schema = pa.schema([("gid", pa.int64()), ("cell", pa.int64()), ("buckets", pa.list_(pa.int64())), ("embedding", _vector_type(double)), ("bound", pa.float64())])
    step = max(1, min(256, (1 << 22) // len(rank_tuples(k, probes, 2 << (dim - 1).bit_length()))))  # sums of ranks stay in memory

    def run(it):
        for b in it:
            for at in range(0, b.num_rows, step):
                c = b.slice(at, step)
                u = unit_rows(_matrix(c.column(1), dim))
                for t in range(tables):
                    code = probed(u, t, k, probes)
                    row, code = np.repeat(np.arange(len(u)), code.shape[1]), code.ravel()
                    cell = cells(code, t, n_cells, k, 2 * u.shape[1])
                    order = np.lexsort((cell, row))
                    row, cell, code = row[order], cell[order], code[order]
                    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (cell[1:] != cell[:-1]))))
                    which = pa.array(row[first])
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate((first, [len(code)])), type=pa.int32()), pa.array(code, type=pa.int64()))
                    yield as_batch({"gid": c.column(0).take(which), "cell": cell[first], "buckets": lists, "embedding": c.column(1).take(which), "bound": c.column(2).take(which)}, schema)

    return queries.select("gid", "embedding", "bound").mapInArrow(run, f"gid long, cell long, buckets array<long>, embedding array<{'double' if double else 'float'}>, bound double")


def with_bounds(queries: DataFrame, sample: list, dim: int, keep: int) -> DataFrame:
    """Queries with ``met`` (their ``keep`` best of a sample of entries) and ``bound``, the score of the last of these (-inf if there are fewer)."""
    x = np.array([r["embedding"] for r in sample], dtype=np.float64).reshape(-1, dim)
    ids = [r["ids"] for r in sample]
    kind = dict(queries.dtypes)["embedding"]
    schema = pa.schema([("gid", pa.int64()), ("embedding", _vector_type(kind == "array<double>")), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64())), ("bound", pa.float64())])

    def run(it):
        for b in it:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                best = best_rows(_matrix(c.column(1), dim), x, ids, keep)
                bound = [s[-1] if len(s) == keep else -math.inf for _, s in best]
                yield as_batch({"gid": c.column(0), "embedding": c.column(1), "ids": [i for i, _ in best], "scores": [s for _, s in best], "bound": bound}, schema)

    return queries.select("gid", "embedding").mapInArrow(run, f"gid long, embedding {kind}, ids array<long>, scores array<double>, bound double")


_NEAR = "qid long, vec_id long, score double"
_NEAR_SCHEMA = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _flat(qids: np.ndarray, best: list[tuple[list[int], list[float]]]) -> pa.RecordBatch:
    return as_batch({"qid": np.repeat(qids, [len(i) for i, _ in best]), "vec_id": [v for i, _ in best for v in i], "score": [v for _, s in best for v in s]}, _NEAR_SCHEMA)


def best_rows(q: np.ndarray, x: np.ndarray, ids: list, keep: int) -> list[tuple[list[int], list[float]]]:
    """For each query the ``keep`` best (ids, scores) among the entries' rows, larger inner product first, ties to smaller ids."""
    out = []
    rough = q @ x.T
    some = min(len(x), keep + 12)
    pick = np.argpartition(-rough, some - 1, axis=1)[:, :some] if some < len(x) else np.broadcast_to(np.arange(len(x)), rough.shape)
    for i, cand in enumerate(pick):
        exact = (x[cand] * q[i]).sum(axis=1)  # one order of summation, so that equal vectors score alike everywhere
        rows = sorted((-s, v) for s, c in zip(exact.tolist(), cand.tolist(), strict=True) for v in ids[c])[:keep]
        out.append(([v for _, v in rows], [-s for s, _ in rows]))
    return out


def _groups(it, dim: int):
    """The rows of a task as one table, and the places of each (cell, salt)'s entries and queries."""
    got = [b for b in it if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got).combine_chunks()
    cell = t["cell"].to_numpy().astype(np.int64) * 1_000_000 + t["salt"].to_numpy()
    is_q, x = t["q"].to_numpy(zero_copy_only=False), _matrix(t["embedding"].combine_chunks(), dim)
    order = np.lexsort((is_q, cell))
    for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
        e, q = own[~is_q[own]], own[is_q[own]]
        if len(e) and len(q):
            yield t, x, e, q


#: Pairs whose products are taken at a time.
PAIRS = 1 << 17


#: Results that a task holds before it drops all but the best of each query.
HELD = 1 << 20


def best_of_each(qid: np.ndarray, vec_id: np.ndarray, score: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` best of each query, each once, ties to smaller ids."""
    order = np.lexsort((vec_id, -score, qid))
    qid, vec_id, score = qid[order], vec_id[order], score[order]
    new = np.flatnonzero(np.concatenate(([True], (qid[1:] != qid[:-1]) | (vec_id[1:] != vec_id[:-1]))))
    qid, vec_id, score = qid[new], vec_id[new], score[new]
    first = np.flatnonzero(np.concatenate(([True], qid[1:] != qid[:-1])))
    place = np.arange(len(qid)) - np.repeat(first, np.diff(np.concatenate((first, [len(qid)]))))
    return qid[place < keep], vec_id[place < keep], score[place < keep]


def rerank(entries: DataFrame, queries: DataFrame, parts: int, dim: int, keep: int) -> DataFrame:
    """qid, vec_id, score: of each query and the entries in the buckets that it probes, where the score reaches its bound, the ``keep`` best of each task."""
    e = entries.select("cell", "salt", F.lit(False).alias("q"), "gid", "embedding", F.array("bucket").alias("buckets"), "ids", F.lit(0.0).alias("bound"))
    q = queries.select("cell", "salt", F.lit(True).alias("q"), "gid", "embedding", "buckets", F.array().cast("array<long>").alias("ids"), "bound")

    def run(it):
        held: list[tuple] = []
        size_held, most = 0, HELD
        for t, x, e, q in _groups(it, dim):
            lists = t["buckets"].combine_chunks()
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            own = flat[at[e]]
            order = np.argsort(own, kind="stable")
            e, own = e[order], own[order]
            n = at[q + 1] - at[q]
            asked = flat[np.repeat(at[q] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            low, high = np.searchsorted(own, asked), np.searchsorted(own, asked, side="right")
            size = high - low
            who = np.repeat(np.arange(len(q)), n)
            ids, gid, bound = t["ids"].combine_chunks(), t["gid"].to_numpy(), t["bound"].to_numpy()
            ends = np.cumsum(size)
            a = 0
            while a < len(size):
                z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
                m, part = int(size[a:z].sum()), size[a:z]
                pe = e[np.repeat(low[a:z] - (np.cumsum(part) - part), part) + np.arange(m)]
                pq = q[np.repeat(who[a:z], part)]
                score = (x[pe] * x[pq]).sum(axis=1)  # one order of summation, so that equal vectors score alike everywhere
                good = np.flatnonzero(score >= bound[pq])
                if len(good):
                    named = ids.take(pa.array(pe[good]))
                    many = np.diff(named.offsets.to_numpy())
                    held.append((np.repeat(gid[pq[good]], many), named.flatten().to_numpy(), np.repeat(score[good], many)))
                    size_held += len(held[-1][0])
                    if size_held > most:
                        held = [best_of_each(*map(np.concatenate, zip(*held, strict=True)), keep)]
                        size_held = len(held[0][0])
                        most = max(HELD, 2 * size_held)
                a = z
        if held:
            best = best_of_each(*map(np.concatenate, zip(*held, strict=True)), keep)
            for at in range(0, len(best[0]), 50_000):
                yield as_batch(dict(zip(_NEAR_SCHEMA.names, (c[at : at + 50_000] for c in best), strict=True)), _NEAR_SCHEMA)

    return e.unionByName(q).repartition(parts, "cell", "salt").mapInArrow(run, _NEAR)


def compare(entries: DataFrame, queries: DataFrame, parts: int, dim: int, keep: int) -> DataFrame:
    """qid, vec_id, score: the ``keep`` best of each query among all entries of each (cell, salt) that both are in."""
    row = lambda df, q: df.select("cell", "salt", F.lit(q).alias("q"), "gid", "embedding", F.array().cast("array<long>").alias("ids") if q else F.col("ids"))

    def run(it):
        for t, x, e, q in _groups(it, dim):
            ids, gid = t["ids"].to_pylist(), t["gid"].to_numpy()
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                yield _flat(gid[part], best_rows(x[part], x[e], [ids[i] for i in e], keep))

    return row(entries, False).unionByName(row(queries, True)).repartition(parts, "cell", "salt").mapInArrow(run, _NEAR)


def scan(entries: DataFrame, queries: DataFrame, dim: int, keep: int) -> DataFrame:
    """qid, vec_id, score: the ``keep`` best of each query in each block of entries; blocks of entries by blocks of queries."""
    n, asked = entries.count(), queries.count()
    blocks, groups = (max(1, -(-a // b)) for a, b in ((n, SCAN_ENTRIES), (asked, SCAN_QUERIES)))
    block = lambda m: F.pmod(F.xxhash64("gid"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    e = entries.select(block(blocks).alias("cell"), every(groups).alias("salt"), "gid", "embedding", "ids")
    q = queries.select(every(blocks).alias("cell"), block(groups).alias("salt"), "gid", "embedding")
    return compare(e, q, pieces(n * groups + asked * blocks, ROWS_PER_TASK, shuffle_width(entries.sparkSession)), dim, keep)


def merge(pairs: DataFrame, keep: int) -> DataFrame:
    """qid and its ``keep`` best of all pairs, in order; a pair met in several cells counts once."""
    best = pairs.groupBy("qid", "vec_id").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= keep)
    return best.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))


def nearest(vectors: DataFrame, is_query, k: int = N_NEAREST, tables: int | None = None, probes: int | None = None, hashes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among all other rows; a query that met fewer is compared with all.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id. Rows whose
    vector is null, empty, zero, of another length than most, or with null or non-finite
    components take no part, nor do null ids. Equal vectors tie and go by id; repeated rows
    (same id and vector) count once. Fewer candidates than k: all of them. Empty table: no
    rows.
    """
    spark = vectors.sparkSession
    sound = "vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND x = x AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"  # moved as they are; products are of doubles
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>").alias("embedding")).filter(sound)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return empty
    dim = int(lengths["d"])
    rows = rows.filter(F.size("embedding") == dim).withColumn("h", F.xxhash64("embedding"))
    # Equal vectors: salted first, so that a vector shared by many rows is cut down before it meets in one task.
    by_salt = Window.partitionBy("h", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    by_all = Window.partitionBy("h", "embedding").orderBy("vec_id")
    few = rows.distinct().withColumn("n", F.row_number().over(by_salt)).filter(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(by_all)).filter(F.col("n") <= k + 1)
    groups = few.groupBy("h", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    band = F.round(F.log(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))) / math.log(BAND)).cast("int")
    groups = stash(groups.select(F.element_at("ids", 1).alias("gid"), "h", "embedding", "ids", band.alias("band")), "ann-entries")
    asked = stash(rows.filter(is_query).select("vec_id", "h", "embedding").distinct().join(groups.select("gid", "h", "embedding"), ["h", "embedding"]).select("vec_id", "gid"), "ann-queries")
    asked_groups = groups.join(asked.select("gid").distinct(), "gid", "left_semi")

    # One count for each band: their number depends on the range of the norms, not on the rows.
    sizes = dict(groups.groupBy("band").count().collect())
    small = F.col("band").isin([x for x, n in sizes.items() if n < PROBED_FROM])
    near = []
    n_probed = sum(n for n in sizes.values() if n >= PROBED_FROM)
    if n_probed:
        width = 2 * unit_rows(np.ones((1, dim))).shape[1]
        axes_of = hashes or hashes_for(n_probed, width)
        tables, probes = tables or TABLES, probes or probes_for(n_probed, axes_of)
        sample = groups.filter(F.pmod(F.xxhash64("gid", F.lit(SEED)), F.lit(max(8, n_probed // SAMPLE))) == 0).select("embedding", "ids").collect()
        bounded = stash(with_bounds(asked_groups, sample, dim, k + 1), "ann-bounds")
        near.append(bounded.select(F.col("gid").alias("qid"), F.explode(F.arrays_zip("ids", "scores")).alias("p")).select("qid", F.col("p.ids").alias("vec_id"), F.col("p.scores").alias("score")))
        probed_rows, n_cells = groups.filter(~small), pieces(n_probed, PER_CELL, 1)
        over = stash(filled(probed_rows, dim, axes_of, tables, n_cells).filter(F.col("n") > 2 * PER_CELL).select("cell", F.ceil(F.col("n") / PER_CELL).cast("int").alias("salts")), "ann-over")
        hint = F.broadcast if over.count() <= MOST_SALTED else lambda df: df
        salted = lambda rows: rows.join(hint(over), "cell", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        entries = salted(file_entries(probed_rows, dim, axes_of, tables, n_cells)).withColumn("salt", F.pmod(F.xxhash64("gid"), F.col("salts")).cast("int"))
        queries = salted(file_queries(bounded, dim, axes_of, tables, probes, n_cells)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        near.append(rerank(entries, queries, pieces(tables * n_probed, ROWS_PER_TASK, shuffle_width(spark)), dim, k + 1))
    if min(sizes.values()) < PROBED_FROM:
        near.append(scan(groups.filter(small), asked_groups, dim, k + 1))
    best = stash(merge(reduce(DataFrame.unionByName, near), k + 1), "ann-best")
    # Queries that met too few, which is rare, are compared with all entries.
    total = groups.agg(F.sum(F.size("ids"))).first()[0]
    enough = best.filter(F.size("best") >= min(k + 1, total))
    short = asked_groups.join(enough, asked_groups.gid == enough.qid, "left_anti")
    if not short.isEmpty():
        best = enough.unionByName(merge(scan(groups, short, dim, k + 1), k + 1))
    each = asked.join(best, asked.gid == best.qid).select(F.col("vec_id").alias("query_id"), F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("vec_id")), 1, k).alias("best"))
    return each.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20, against all rows."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
