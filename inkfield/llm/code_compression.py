"""Operator 11: vectors as product codes, learnt by a tree aggregation over columnar blocks.

Components become integers and rows become blocks: one NumPy array of integers a block, dimension
after dimension, in the smallest integer type that holds it, written once. A vector is cut into equal
parts and each part position has a codebook. A round is one ``treeAggregate`` over the blocks: squared distances accumulate
dimension by dimension for all entries of a codebook, ``np.add.at`` adds the parts' components
and ones into int64 tensors (parts x entries x width, parts x entries), and these merge through a reduction
tree. Integers throughout, so neither the order of rows nor the shape of the tree changes a bit.

The driver holds codebooks and one tensor for each branch at the tree's root, whatever the number of rows. A lost executor's blocks are read
again from the shared folder.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batch, join_counted, stash, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of a block, at most; levels of the reduction tree.
BLOCK_ROWS, DEPTH = 4_096, 3

_BLOCKS = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("width", pa.int32()), ("kind", pa.string()), ("data", pa.binary())])


def sound(column: str) -> str:
    """The condition that a vector is there and has neither null nor non-finite components."""
    return f"`{column}` IS NOT NULL AND forall(`{column}`, x -> x IS NOT NULL AND x = x AND abs(x) < double('Infinity'))"


def whole_numbers(column: pa.Array, scale: int) -> np.ndarray:
    """Rows of floor(scale * x), a column of lists of one length; raises where lengths differ or squared distances would not fit 64 bits."""
    sizes = np.unique(np.diff(column.offsets.to_numpy()))
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes.tolist()}")
    width = int(sizes[0]) if len(sizes) else 0
    x = np.floor(scale * np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)).reshape(len(column), width)
    if x.size and 4.0 * width * np.abs(x).max() ** 2 >= 2.0**62:
        raise OverflowError("components are too large for squared distances of 64 bits")
    return x.astype(np.int64)


def to_blocks(vectors: DataFrame, id_column: str, vector_column: str, label_column: str, scale: int) -> DataFrame:
    """Sound vectors in blocks: ids, labels as text ("" for null, else "=" and the label), and integers, dimension after dimension."""
    label = F.coalesce(F.concat(F.lit("="), F.col(label_column).cast("string")), F.lit(""))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"), label.alias("label")).filter(sound("v"))

    def run(it):
        for b in it:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                c = b.slice(at, BLOCK_ROWS)
                x = whole_numbers(pa.concat_arrays([c.column(1)]), scale)
                most = int(np.abs(x).max()) if x.size else 0
                kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if most <= np.iinfo(k).max)
                one = lambda a, t: pa.array([a.to_pylist()], type=t)
                columns = [one(c.column(0), _BLOCKS.field(0).type), one(c.column(2), _BLOCKS.field(1).type), pa.array([x.shape[1]], pa.int32()), pa.array([kind]), pa.array([np.ascontiguousarray(x.T).astype(kind).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=_BLOCKS)

    return rows.mapInArrow(run, "ids array<long>, labels array<string>, width int, kind string, data binary")


def columns_of(data: bytes, kind: str, width: int, parts: int) -> np.ndarray:
    """A block as int64, parts x dimensions of a part x rows."""
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    x = np.frombuffer(data, dtype=kind)
    return x.reshape(parts, width // parts, -1).astype(np.int64) if width else np.zeros((parts, 0, 0), dtype=np.int64)


def assigned(x: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a block's parts, the nearest entries (ties to the lower index) and the squared distances: parts x rows each."""
    n = x.shape[2]
    code, error = np.zeros((len(x), n), dtype=np.int64), np.zeros((len(x), n), dtype=np.int64)
    for p, part in enumerate(x):
        far = np.zeros((codebooks.shape[1], n), dtype=np.int64)
        for j, component in enumerate(part):
            apart = component[None, :] - codebooks[p, :, j][:, None]
            far += apart * apart
        code[p] = far.argmin(axis=0)
        error[p] = far[code[p], np.arange(n)]
    return code, error


def tallied(total: tuple[np.ndarray, np.ndarray], x: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's sums and counts added to the tensors."""
    sums, counts = total
    code, _ = assigned(x, codebooks)
    for p, part in enumerate(x):
        np.add.at(counts[p], code[p], 1)
        for j, component in enumerate(part):
            np.add.at(sums[p, :, j], code[p], component)
    return sums, counts


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def learn(blocks: DataFrame, first: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks (parts x entries x components) after some rounds from the first ones; unused entries stay."""
    codebooks, parts = first, len(first)
    rows = blocks.select("data", "kind", "width").rdd
    for _ in range(rounds):
        zero = (np.zeros(codebooks.shape, dtype=np.int64), np.zeros(codebooks.shape[:2], dtype=np.int64))
        add = lambda total, r, now=codebooks: tallied(total, columns_of(bytes(r[0]), r[1], r[2], parts), now)
        sums, counts = rows.treeAggregate(zero, add, merged, depth=DEPTH)
        codebooks = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], codebooks)
    return codebooks


def encoded(blocks: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(id, label, code, error): each row's entries in part order and its squared distances, summed."""
    schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("code", pa.list_(pa.int16())), ("error", pa.int64())])
    parts = len(codebooks)

    def run(it):
        for b in it:
            for i in range(b.num_rows):
                width = b.column(2)[i].as_py()
                ids = b.column(0)[i].values
                if not width:  # vectors without components: every part is the first entry, at no distance
                    code, error = np.zeros((parts, len(ids)), dtype=np.int64), np.zeros((parts, len(ids)), dtype=np.int64)
                else:
                    code, error = assigned(columns_of(b.column(4)[i].as_py(), b.column(3)[i].as_py(), width, parts), codebooks)
                flat = pa.array(np.ascontiguousarray(code.T).ravel().astype(np.int16))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * parts, type=pa.int32()), flat)
                yield as_batch({"id": ids, "label": b.column(1)[i].values, "code": lists, "error": error.sum(axis=0)}, schema)

    return blocks.select("ids", "labels", "width", "kind", "data").mapInArrow(run, "id long, label string, code array<short>, error long")


def decoded(codes: DataFrame, codebooks: np.ndarray, scale: int = SCALE, code: str = "code", out: str = "vector") -> DataFrame:
    """``codes`` with the vectors that the codes stand for: the middles of the entries' components."""
    books = F.array(*[F.array(*[F.array(*[F.lit((int(x) + 0.5) / scale) for x in entry]) for entry in book]) for book in codebooks])
    return codes.withColumn(out, F.flatten(F.transform(code, lambda c, i: F.get(F.get(books, i), c.cast("int")))))


def compress(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error, label_error), codebooks) of every sound vector.

    Rows whose vector is null or has null or non-finite components are dropped; vectors of different lengths, or of
    one that ``parts`` does not divide, raise. Repeated rows count as often as they occur. The first codebooks are the
    parts of the rows with the smallest ids (null ids last, equal ids by vector); fewer rows than entries give fewer
    entries. ``label`` is text, null for null labels, which are one group; a label of very many rows is summed and joined without
    meeting in one task. Other columns are not read. An empty table: no rows, codebooks without entries.
    """
    blocks = stash(to_blocks(vectors, id_column, vector_column, label_column, scale), "op11-blocks")
    v = F.col(vector_column).cast("array<double>").alias("v")
    low = vectors.select(F.col(id_column).cast("long").alias("id"), v).filter(sound("v")).orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    first = whole_numbers(pa.array([r["v"] for r in low], type=pa.list_(pa.float64())), scale)
    if first.shape[1] % parts:
        raise ValueError(f"vectors of {first.shape[1]} components cannot be cut into {parts} equal parts")
    codebooks = np.ascontiguousarray(first.reshape(len(low), parts, first.shape[1] // parts).transpose(1, 0, 2))
    if codebooks.size:
        codebooks = learn(blocks, codebooks, rounds)
    codes = stash(encoded(blocks, codebooks), "op11-codes")
    per_label = stash(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "op11-labels")
    total = per_label.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    both = join_counted(codes, per_label, ["label"], "n", total)
    label = F.when(F.col("label") != "", F.substr("label", F.lit(2)))
    return both.select("id", label.alias("label"), "code", "error", "label_error"), codebooks


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all entries' components, decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def op11_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 8 parts, 16 entries, 6 rounds, 4,096 steps a unit. See ``compress`` for nulls, repeats and empty tables."""
    codes, codebooks = compress(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    return codes.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def oracle() -> str:
    """The same rounds as common table expressions, for unique ids and 64 components."""
    width = 64 // PARTS
    sql = f"""WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[part * {width} + 1:part * {width} + {width}] AS x FROM k, range({PARTS}) t(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {ENTRIES}))"""
    far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for i in range(ROUNDS + 1):
        sql += f""",
a{i} AS MATERIALIZED (SELECT vec_id, part, x, e, far FROM (SELECT vec_id, part, x, e, {far} AS far FROM p JOIN c{i} USING (part)) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY far, e) = 1)"""
        if i < ROUNDS:
            sql += f""",
m{i} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM (SELECT part, e, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, {width + 1}) t(j) GROUP BY ALL) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT part, e, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (part, e))"""
    return sql + f""",
r AS (SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{ROUNDS} GROUP BY ALL),
b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r JOIN k USING (vec_id), b"""
