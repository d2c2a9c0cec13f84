"""Operator 12: hard negatives by partial products in an orthogonal PCA rotation.

Vectors become integers, so a score is an exact integer product. The rotation is the eigenvectors of the
integers' second moments (one small matrix a task), largest first. Anchors and rows meet in a
grid: anchors in groups of bounded size, rows in shards by a hash of id and vector; each row goes once to every
group, each anchor once to every shard. A task holds one group and reads its shard in batches:

* products are accumulated over the leading components, a stage at a time;
* what the rest can add is at most the product of both residual norms, plus a slack for rounding and for
  the rotation's departure from orthogonality; pairs that cannot reach the anchor's running bound, or cannot fall below the highest
  score it accepts, are discarded, and rows or anchors without any pair left leave the stage;
* survivors are verified by integer products, and the best of each anchor raise the bounds.

Two passes: positives (rows of the anchor's label), then negatives in the windows that the positives' scores
give. Each task passes on k rows an anchor (and positive); nothing is capped, and ties go by id. A label, or copies of one vector, with a third of all rows
only make shards by hash longer evenly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .code_compression import sound, whole_numbers
from .common import as_batch, shuffle_width, stash, table

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
#: Anchors of a group; rows of a shard, about.
GROUP, SHARD_ROWS = 8_192, 1 << 20
#: Rows, and anchors, whose products are taken at a time; pairs that are verified at a time.
ROWS_AT_ONCE, ANCHORS_AT_ONCE, PAIRS = 2_048, 1_024, 1 << 16
#: The residual's share of the second moments at which each stage ends; below this share of pairs left, they are verified at once.
RESIDUALS, FEW = (0.5, 0.25, 0.125, 0.05), 0.02
_NONE = np.iinfo(np.int64).max


def sound_rows(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part."""
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return kept.filter("vec_id IS NOT NULL AND label IS NOT NULL").filter(sound("v"))


def whole_rows(rows: DataFrame, scale: int, kind: str) -> DataFrame:
    """(vec_id, label, v) with components floor(scale * x) as bytes of integers of one type."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("v", pa.binary())])

    def run(it):
        for b in it:
            for at in range(0, b.num_rows, ROWS_AT_ONCE):
                c = b.slice(at, ROWS_AT_ONCE)
                x = whole_numbers(pa.concat_arrays([c.column(2)]), scale).astype(kind)
                yield as_batch({"vec_id": c.column(0), "label": c.column(1), "v": [r.tobytes() for r in x]}, schema)

    return rows.mapInArrow(run, "vec_id long, label string, v binary")


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1).astype(np.int64)


def moments(rows: DataFrame, kind: str, width: int) -> np.ndarray:
    """The sum of the outer products of all rows with themselves: one matrix a task, summed cell by cell. Rounding moves the rotation a little, never a result."""

    def run(it):
        total = np.zeros((width, width))
        for b in it:
            x = matrix(b.column(0), kind).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"m": pa.array([total.ravel()], type=pa.list_(pa.float64()))})

    cells = rows.select("v").mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("cell", "m")).groupBy("cell").agg(F.sum("m").alias("m"))
    out = np.zeros(width * width)
    for r in cells.collect():  # width x width of them
        out[r["cell"]] = r["m"]
    return out.reshape(width, width)


class Rotation:
    """Eigenvectors of the second moments, largest first; ``ends`` of the stages; ``slack`` by which a product of rotated vectors may be off, of the product of the norms."""

    def __init__(self, second: np.ndarray):
        values, vectors = np.linalg.eigh(second)
        order = np.argsort(-values, kind="stable")
        width, rest = len(values), np.maximum(values[order], 0.0)
        self.axes = np.ascontiguousarray(vectors[:, order])
        left = 1.0 - np.cumsum(rest) / max(rest.sum(), 1e-300)
        self.ends = sorted({min(int(np.searchsorted(-left, -share)) + 1, width) for share in RESIDUALS} | {width}) if width else []
        off = np.abs(self.axes @ self.axes.T - np.eye(width)).sum(axis=1).max() if width else 0.0
        self.slack = 2.0 * float(off) + 64.0 * (width + 1) * np.finfo(float).eps

    def turned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rotated rows, the norms of what follows each stage (a little too large), and whole norms."""
        y = x.astype(np.float64) @ self.axes
        rest = np.stack([np.sqrt((y[:, end:] ** 2).sum(axis=1)) for end in self.ends], axis=1) if self.ends else np.zeros((len(x), 0))
        return y, rest * (1.0 + 1e-9), np.sqrt((y * y).sum(axis=1)) * (1.0 + 1e-9)


def surviving(rotation: Rotation, q: tuple, e: tuple, alive: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row) that may score from ``least`` to ``most`` of their anchor; ``alive`` says which pairs count at all."""
    (yq, rq, nq), (ye, re, ne) = q, e
    anchors, rows = np.arange(alive.shape[0]), np.arange(alive.shape[1])
    partial, begin = np.zeros(alive.shape), 0
    for stage, end in enumerate(rotation.ends):
        partial += yq[anchors, begin:end] @ ye[rows, begin:end].T
        reach = rq[anchors, stage][:, None] * re[rows, stage][None, :] + rotation.slack * nq[anchors][:, None] * ne[rows][None, :]
        alive &= (partial + reach >= least[anchors][:, None]) & (partial - reach <= most[anchors][:, None])
        begin, left = end, np.count_nonzero(alive)
        if left <= FEW * alive.size:
            break
        a, r = alive.any(axis=1), alive.any(axis=0)
        if a.sum() * r.sum() <= 0.75 * alive.size:
            anchors, rows, alive, partial = anchors[a], rows[r], alive[np.ix_(a, r)], partial[np.ix_(a, r)]
    i, j = np.nonzero(alive)
    return anchors[i], rows[j]


def verified(q: np.ndarray, e: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer products of pairs."""
    return np.concatenate([np.einsum("ij,ij->i", q[i[at : at + PAIRS]], e[j[at : at + PAIRS]]) for at in range(0, max(len(i), 1), PAIRS)])


class Best:
    """The k best (score, id) of each key, larger scores first, ties to smaller ids; a (key, id, score) counts once. ``bound`` is the k-th best score, or the least there is."""

    def __init__(self, keys: int, k: int):
        self.k, self.bound = k, np.full(keys, -_NONE)
        self.held, self.pending, self.waiting = [np.zeros(0, dtype=np.int64)] * 3, [], 0

    def add(self, key: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        if len(key):
            self.pending.append((key, score, vec_id))
            self.waiting += len(key)
            if self.waiting >= max(PAIRS, len(self.held[0]) // 4) or len(self.held[0]) == 0:
                self.settle()

    def settle(self) -> list[np.ndarray]:
        if self.pending:
            key, score, vec_id = (np.concatenate(c) for c in zip(self.held, *self.pending, strict=True))
            order = np.lexsort((vec_id, -score, key))
            key, score, vec_id = key[order], score[order], vec_id[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (score[1:] != score[:-1]) | (vec_id[1:] != vec_id[:-1])
            key, score, vec_id = key[new], score[new], vec_id[new]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            place = np.arange(len(key)) - np.repeat(first, np.diff(np.concatenate((first, [len(key)]))))
            self.held = [key[place < self.k], score[place < self.k], vec_id[place < self.k]]
            self.bound[key[place == self.k - 1]] = score[place == self.k - 1]
            self.pending, self.waiting = [], 0
        return self.held


class Anchors:
    """One group of anchors in a task, rotated; of each its own label, positives' windows (or none), and the best met so far."""

    def __init__(self, batch: pa.Table, rotation: Rotation, kind: str, k: int, windows: tuple[int, int] | None):
        self.ids = batch["vec_id"].to_numpy()
        self.labels = batch["label"].combine_chunks()
        self.x = matrix(batch["v"].combine_chunks(), kind)
        self.turned = rotation.turned(self.x)
        names, self.named = np.unique(np.array(self.labels.to_pylist(), dtype=object), return_inverse=True)
        self.names = pa.array(names.tolist(), type=pa.string())
        self.windows = windows is not None
        if windows:
            scores = batch["scores"].combine_chunks()
            n = np.diff(scores.offsets.to_numpy())
            self.slots = int(n.max()) if len(n) else 0
            at = np.arange(self.slots)[None, :] < n[:, None]
            self.low, self.high = np.full(at.shape, _NONE), np.full(at.shape, -_NONE)
            p = scores.flatten().to_numpy()
            self.low[at], self.high[at] = -(-windows[0] * p // 100), windows[1] * p // 100
            self.best = Best(at.size, k)
        else:
            self.slots, self.best = 1, Best(len(self.ids), k)

    def meet(self, batch: pa.Table, rotation: Rotation, kind: str) -> None:
        x, ids = matrix(batch["v"].combine_chunks(), kind), batch["vec_id"].to_numpy()
        label = pc.fill_null(pc.index_in(batch["label"].combine_chunks(), value_set=self.names), -1).to_numpy()
        turned = rotation.turned(x)
        for at in range(0, len(self.ids), ANCHORS_AT_ONCE):
            part = np.arange(at, min(at + ANCHORS_AT_ONCE, len(self.ids)))
            if self.windows:
                self._negatives(part, x, ids, label, turned, rotation)
            else:
                for name in np.unique(self.named[part]):
                    rows = np.flatnonzero(label == name)
                    if len(rows):
                        self._positives(part[self.named[part] == name], x[rows], ids[rows], [t[rows] for t in turned], rotation)

    def _pairs(self, part, x, turned, rotation, alive, least, most):
        i, j = surviving(rotation, [t[part] for t in self.turned], turned, alive, least, most)
        return part[i], j, verified(self.x, x, part[i], j)

    def _positives(self, part, x, ids, turned, rotation) -> None:
        i, j, score = self._pairs(part, x, turned, rotation, self.ids[part][:, None] != ids[None, :], self.best.bound[part].astype(float), np.full(len(part), np.inf))
        good = score >= self.best.bound[i]
        self.best.add(i[good], score[good], ids[j[good]])

    def _negatives(self, part, x, ids, label, turned, rotation) -> None:
        alive = (self.named[part][:, None] != label[None, :]) & (self.ids[part][:, None] != ids[None, :])
        bound = np.maximum(self.low, self.best.bound.reshape(self.low.shape))
        # A slot that wants nothing any more asks for more than its window allows.
        want = np.where(bound <= self.high, bound, _NONE)[part]
        i, j, score = self._pairs(part, x, turned, rotation, alive, want.min(axis=1).astype(float), np.where(want < _NONE, self.high[part], -_NONE).max(axis=1).astype(float))
        for slot in range(self.slots):
            good = (score >= bound[i, slot]) & (score <= self.high[i, slot])
            self.best.add(i[good] * self.slots + slot, score[good], ids[j[good]])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor's id, slot, row's id and score."""
        key, score, vec_id = self.best.settle()
        return self.ids[key // self.slots], key % self.slots, vec_id, score


def met(anchors: DataFrame, rows: DataFrame, rotation: Rotation, kind: str, k: int, windows: tuple[int, int] | None = None) -> DataFrame:
    """(anchor_id, slot, vec_id, score): the k best of each anchor and slot in every cell of the grid. Without windows, rows of the anchor's label; with them, rows of other labels in the window of each of the anchor's ``scores``."""
    n, asked = rows.count(), anchors.count()
    groups = max(1, -(-asked // GROUP))
    shards = max(1, -(-n // SHARD_ROWS), min(-(-n // ROWS_AT_ONCE), -(-shuffle_width(rows.sparkSession) // groups)))
    deal = lambda m, *c: F.pmod(F.xxhash64(*c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    scores = F.col("scores") if windows else F.lit(None).cast("array<long>")
    a = anchors.select(every(shards).alias("shard"), deal(groups, "vec_id").alias("group"), F.lit(False).alias("row"), "vec_id", "label", "v", scores.alias("scores"))
    e = rows.select(deal(shards, "vec_id", "v").alias("shard"), every(groups).alias("group"), F.lit(True).alias("row"), "vec_id", "label", "v", F.lit(None).cast("array<long>").alias("scores"))
    schema = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(it):
        cell, waiting, group = None, [], None

        def done():
            if group is not None:
                anchor_id, slot, vec_id, score = group.found()
                for at in range(0, len(anchor_id), 50_000):
                    to = slice(at, at + 50_000)
                    yield as_batch({"anchor_id": anchor_id[to], "slot": slot[to].astype(np.int32), "vec_id": vec_id[to], "score": score[to]}, schema)

        for b in it:
            key = b.column(0).to_numpy().astype(np.int64) * groups + b.column(1).to_numpy()
            is_row = b.column(2).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(is_row.astype(int)) != 0)) + 1).tolist(), len(key)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if begin == end:
                    continue
                if key[begin] != cell:
                    yield from done()
                    cell, waiting, group = key[begin], [], None
                if not is_row[begin]:
                    waiting.append(b.slice(begin, end - begin))
                    continue
                if waiting:  # all of the group's anchors come before the first row
                    group, waiting = Anchors(pa.Table.from_batches(waiting), rotation, kind, k, windows), []
                if group is not None:
                    for at in range(begin, end, ROWS_AT_ONCE):
                        group.meet(pa.Table.from_batches([b.slice(at, min(ROWS_AT_ONCE, end - at))]), rotation, kind)
        yield from done()

    together = a.unionByName(e).repartition(shards * groups, "shard", "group").sortWithinPartitions("shard", "group", "row")
    return together.mapInArrow(run, "anchor_id long, slot int, vec_id long, score long")


def mine(rows: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and each of its positives.

    ``rows`` has vec_id, label and embedding; ``is_anchor`` is a condition on vec_id. A score is the integer product of
    floor(scale * x). Positives: the first other rows of the anchor's label. Negatives: the first rows of other labels whose score is between ``low`` and ``high``
    percent of the positive's. First: larger scores, then smaller ids.

    Rows without id, label or sound vector take no part; vectors of different lengths raise. Rows that share the
    anchor's id are never its positives or negatives. Repeated rows (same id and score) count once; of several rows that share an
    anchor's id, the smallest label, then vector, is the anchor. Anchors without positives, and positives without negatives, have no rows. Other columns are not read. An empty table: no rows.
    """
    spark = rows.sparkSession
    kept = sound_rows(rows)
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    shortest, longest, most = kept.agg(F.min(F.size("v")), F.max(F.size("v")), F.coalesce(F.max(largest), F.lit(0.0))).first()
    if shortest is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if shortest != longest:
        raise ValueError(f"vectors of different lengths: {shortest} to {longest}")
    most = scale * most + 1.0
    if 100.0 * shortest * most**2 >= 2.0**62:
        raise OverflowError("components are too large for scores of 64 bits")
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if most <= np.iinfo(k).max)
    small = stash(whole_rows(kept, scale, kind), "op12-rows")
    rotation = Rotation(moments(small, kind, shortest))
    first = small.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a"))
    anchors = stash(first.select("vec_id", "a.label", "a.v"), "op12-anchors")
    order = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    near = met(anchors, small, rotation, kind, positives).select("anchor_id", "vec_id", "score").distinct()
    chosen = near.withColumn("n", F.row_number().over(order("anchor_id"))).filter(F.col("n") <= positives)
    chosen = stash(chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("p")), "op12-positives")
    asking = stash(anchors.join(chosen, anchors.vec_id == chosen.anchor_id).select("vec_id", "label", "v", F.col("p.score").alias("scores"), "p"), "op12-asking")
    hard = met(asking, small, rotation, kind, negatives, (low, high)).distinct()
    ranked = hard.withColumn("rank", F.row_number().over(order("anchor_id", "slot"))).filter(F.col("rank") <= negatives)
    named = ranked.join(asking.select(F.col("vec_id").alias("anchor_id"), "p"), "anchor_id").withColumn("p", F.get("p", F.col("slot")))
    return named.select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by 100, against all rows; labels of ids divisible by 7 are moved on by one first (``%`` keeps the sign)."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


def oracle() -> str:
    """All scores of the anchors, for unique ids."""
    return f"""WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, list_sum(list_transform(list_zip(a.v, e.v), lambda z: z[1] * z[2]))::BIGINT AS score FROM e a, e WHERE a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= {NEGATIVES}"""
