"""Operator 10: packing token sequences by a grouping genetic algorithm.

Documents are tokenised once (an Arrow pass with a cache of space-separated strings, which
the tokenizer's pre-tokenizer never joins), documents over the limit are cut, and from then on
only lengths move. Pieces are dealt by hash into blocks of bounded size. For each block,
several islands evolve populations of packings whose genes are whole bins: crossover injects
well-filled bins of one parent into the other, removes the bins that now hold duplicates, and
best-fits the displaced pieces. After an epoch each island's elite migrates to the next
island of its block; after the last epoch the best packing of the block wins. Its well-filled
bins are final; pieces of the others go to a next round, in fewer blocks, so that the loss at
block borders vanishes. A population that meets the lower bound stops at once.
"""

from __future__ import annotations

import os
import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_batch, pieces, portions, shuffle_width, stash, table, text_or_empty

LIMIT = 4096
END = 1
#: A token of the vocabulary that no plain text gives unless it spells it out.
PARTING = "<|startoftext|>"
PIECES_PER_BLOCK = 2_000
ISLANDS, POPULATION, GENERATIONS, EPOCHS = 2, 6, 10, 2
#: Bins at least this full are final after a round; in the last round all are.
WELL_FILLED = 0.998
MOST_ROUNDS = 8
SEED = 10_007
#: Strings in a worker process's cache.
CACHE = 1_000_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class CachedTokenizer:
    """Ids of whole texts, string by string between spaces and line ends. White space separates tokens, so this equals encoding the text at once.

    The strings of a batch are told apart by Arrow and looked up once each; ids are gathered by arrays. New
    strings are reduced before they are encoded, together: a last full stop or comma after a letter is a
    token of its own, and ASCII letters are lower-cased anyway. The cache is emptied when full; it never
    changes a result.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.token_to_id(PARTING)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self):
        #: Of each known string, three times its row, plus 1 or 2 if a stop or a comma follows.
        self.code: dict[str, int] = {"": 0}
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.start, self.size = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
        self.n, self.used = 1, 0  # row 0 is the empty string's
        self._encode([".", ","])
        self.stops = np.array([0, *(self.ids[self.start[self.code[c] // 3]] for c in ".,")], dtype=np.uint32)

    def many(self, texts) -> list[np.ndarray]:
        """Ids of each text, and the end token."""
        if len(self.code) > CACHE:
            self._clear()
        texts = pa.array(texts, type=pa.string()) if isinstance(texts, list) else texts
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        strings = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn([s for s in strings if s not in self.code])
        code = np.fromiter(map(self.code.__getitem__, strings), dtype=np.int64, count=len(strings))[coded.indices.to_numpy()]
        row, stop = code // 3, code % 3
        size = self.size[row]
        # Ids of every string, then a place for its stop; the last string's of a text is followed by one for the end.
        room = size + (stop > 0)
        last = np.cumsum(pc.list_value_length(split).to_numpy()) - 1
        room[last] += 1
        ends = np.cumsum(room)
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint32)
        at = np.repeat(ends - room - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out[at] = self.ids[np.repeat(self.start[row] - (np.cumsum(size) - size), size) + np.arange(len(at))]
        stopped = np.flatnonzero(stop)
        out[(ends - room + size)[stopped]] = self.stops[stop[stopped]]
        out[ends[last] - 1] = END
        return np.split(out, ends[last][:-1])

    def _learn(self, new: list[str]) -> None:
        known = self.code
        reduced = []
        for s in new:
            stop = 1 + ".,".index(s[-1]) if s[-1] in ".," and s[-2:-1].isalpha() else 0
            core = s[:-1] if stop else s
            if core.isascii() and core.isalpha():
                core = core.lower()
            reduced.append((s, core, stop))
        need = list({c: None for _, c, _ in reduced if c not in known})
        for at in range(0, len(need), 4096):
            self._encode(need[at : at + 4096])
        for s, core, stop in reduced:
            known[s] = known[core] + stop

    def _encode(self, strings: list[str]) -> None:
        """Encode strings together: those of letters, one word each, parted by spaces; others by a special token; strings that hold that token go alone."""
        words, others = [s for s in strings if s.isalpha()], [s for s in strings if not s.isalpha()]
        if words:
            ids = self._ids(" ".join(words))
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(words):
                self._add(words, ids, np.diff(ends, prepend=0))
            else:  # some letters are no words to this tokenizer
                others = strings
        plain = [s for s in others if PARTING not in s]
        if plain:
            ids = self._ids(PARTING.join(plain))
            marks = np.flatnonzero(ids == self.mark)
            self._add(plain, ids[ids != self.mark], np.diff(np.concatenate(([-1], marks, [len(ids)]))) - 1)
        for s in others if len(plain) < len(others) else ():
            if PARTING in s:
                ids = self._ids(s)
                self._add([s], ids, np.array([len(ids)]))

    def _ids(self, text: str) -> np.ndarray:
        (got,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(got.ids, dtype=np.uint32)

    def _add(self, strings: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n, used = self.n + len(size), self.used + len(ids)
        for name, need in (("ids", used), ("start", n), ("size", n)):
            old = getattr(self, name)
            if len(old) < need:
                setattr(self, name, np.concatenate([old, np.zeros(max(need, 2 * len(old)) - len(old), dtype=old.dtype)]))
        self.ids[self.used : used] = ids
        self.size[self.n : n] = size
        self.start[self.n : n] = self.used + np.cumsum(size) - size
        self.code.update((s, 3 * k) for k, s in enumerate(strings, self.n))
        self.n, self.used = n, used


_tokenizers: dict[str, CachedTokenizer] = {}


def tokenizer(path: str) -> CachedTokenizer:
    """One for each worker process, so that later tasks find what earlier ones learned."""
    if path not in _tokenizers:
        _tokenizers[path] = CachedTokenizer(path)
    return _tokenizers[path]


_PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each piece of each document; a null text counts as empty and is the end token alone."""
    path = path or tokenizer_path()

    def run(it):
        tok = tokenizer(path)
        for b in portions(it, 1, 1024):
            rows = []
            for d, ids in zip(b.column(0).to_pylist(), tok.many(b.column(1)), strict=True):
                for k, at in enumerate(range(0, len(ids), limit)):
                    part = ids[at : at + limit]
                    rows.append((d, k, at, len(part), zlib.crc32(part.tobytes())))
            if rows:
                yield as_batch(dict(zip(_PIECE_SCHEMA.names, map(list, zip(*rows, strict=True)), strict=True)), _PIECE_SCHEMA)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(docs, text_column).alias("t")).mapInArrow(run, _PIECES)


# ---------------------------------------------------------------- the genetic algorithm

Packing = list[list[int]]  # bins of indices into the lengths, which descend


def best_fit(lengths: list[int], bins: Packing, rest: list[int], limit: int) -> Packing:
    """Add the pieces ``rest``, in their order, each to the fullest bin with room, or to a new one."""
    rooms = sorted((limit - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for i in rest:
        at = bisect_left(rooms, (lengths[i], -1))
        if at < len(rooms):
            room, k = rooms.pop(at)
            bins[k].append(i)
            insort(rooms, (room - lengths[i], k))
        else:
            insort(rooms, (limit - lengths[i], len(bins)))
            bins.append([i])
    return bins


def fitness(lengths: list[int], packing: Packing, limit: int) -> tuple[int, float]:
    """Smaller is better: bins, then minus the mean square of their fill."""
    return len(packing), -sum((sum(lengths[i] for i in b) / limit) ** 2 for b in packing) / max(len(packing), 1)


def crossover(lengths: list[int], a: Packing, b: Packing, limit: int, rng: random.Random) -> Packing:
    """Well-filled bins of ``b`` injected into ``a``."""
    fill = [sum(lengths[i] for i in x) for x in b]
    order = sorted(range(len(b)), key=lambda k: -fill[k] + rng.random() * limit * 0.02)
    take = [b[k] for k in order[: max(1, int(len(b) * rng.uniform(0.2, 0.6)))]]
    inside = {i for x in take for i in x}
    kept, displaced = [], []
    for x in a:
        if inside.isdisjoint(x):
            kept.append(x[:])
        else:
            displaced += [i for i in x if i not in inside]
    # Mutation: a few of the emptiest bins are dissolved too.
    kept.sort(key=lambda x: -sum(lengths[i] for i in x))
    for _ in range(min(len(kept), rng.randrange(1, 4))):
        displaced += kept.pop()
    displaced.sort()  # indices ascend as lengths descend
    return best_fit(lengths, [x[:] for x in take] + kept, displaced, limit)


def evolve(lengths: list[int], start: list[Packing], limit: int, seed: int, population: int = POPULATION, generations: int = GENERATIONS) -> list[Packing]:
    """An epoch on one island: packings, best first. ``lengths`` descend; ``start`` are immigrants."""
    rng = random.Random(seed)
    least = -(-sum(lengths) // limit)
    rate = lambda p: fitness(lengths, p, limit)
    people = [(rate(p), p) for p in start]
    if not people or min(r for r, _ in people)[0] > least:
        p = best_fit(lengths, [], list(range(len(lengths))), limit)
        people.append((rate(p), p))
        while len(people) < population and min(r for r, _ in people)[0] > least:
            order = sorted(range(len(lengths)), key=lambda i: -lengths[i] * rng.uniform(0.8, 1.25))
            p = best_fit(lengths, [], order, limit)
            people.append((rate(p), p))
    people.sort(key=lambda x: x[0])
    for _ in range(generations):
        if people[0][0][0] <= least:
            break
        for _ in range(population // 2):
            a, b = (min(rng.sample(people, min(2, len(people))), key=lambda x: x[0])[1] for _ in range(2))
            child = crossover(lengths, a, b, limit, rng)
            people.append((rate(child), child))
        people.sort(key=lambda x: x[0])
        del people[population:]
    return [p for _, p in people]


def _as_array(packing: Packing, n: int) -> list[int]:
    of = [0] * n
    for k, b in enumerate(packing):
        for i in b:
            of[i] = k
    return of


def _as_packing(of) -> Packing:
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(of):
        bins.setdefault(int(k), []).append(i)
    return list(bins.values())


def _round(items: DataFrame, blocks: int, limit: int, seed: int) -> DataFrame:
    """(_uid_, length, block, bin, place, fill) of the best packing of each block; ``items`` are (_uid_, length)."""
    spark = items.sparkSession
    width = pieces(items.count() * ISLANDS, 20_000, shuffle_width(spark))
    dealt = items.select("_uid_", "length", F.pmod(F.xxhash64("_uid_", F.lit(seed)), F.lit(blocks)).cast("int").alias("block"))
    on_islands = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    kind = "block int, island int, bins int, fill double, of array<int>"

    def sort(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(["length", "_uid_"], ascending=[False, True], ignore_index=True)

    def epoch(rows: pd.DataFrame, elite: pd.DataFrame, key, number: int) -> pd.DataFrame:
        block, island = int(key[0]), int(key[1])
        lengths = sort(rows)["length"].tolist()
        start = [_as_packing(of) for of in elite.sort_values(["bins", "fill"])["of"]] if len(elite) else []
        best = evolve(lengths, start, limit, hash((seed, block, island, number)))[:2]
        out = [(block, island, *fitness(lengths, p, limit), _as_array(p, len(lengths))) for p in best]
        return pd.DataFrame(out, columns=["block", "island", "bins", "fill", "of"])

    def later(number: int):
        return lambda key, rows, best: epoch(rows, best, key, number)

    elite = on_islands.groupBy("block", "island").applyInPandas(lambda key, rows: epoch(rows, pd.DataFrame(), key, 0), kind)
    for number in range(1, EPOCHS):
        elite = stash(elite, "pack-elite")
        # The best of an island stay, and migrate to the next one.
        moved = elite.unionByName(elite.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int")))
        one = on_islands.repartition(width, "block", "island").groupBy("block", "island")
        other = moved.repartition(width, "block", "island").groupBy("block", "island")
        elite = one.cogroup(other).applyInPandas(later(number), kind)
    winner = stash(elite, "pack-elite").groupBy("block").agg(F.min_by("of", F.struct("bins", "fill", "island")).alias("of"))

    def lay_out(key, rows: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        rows = sort(rows)
        rows["bin"] = np.asarray(best["of"].iloc[0], dtype=np.int32)
        ends = rows.groupby("bin")["length"].cumsum()
        rows["place"] = ends - rows["length"]
        rows["fill"] = rows.groupby("bin")["length"].transform("sum")
        return rows[["_uid_", "length", "block", "bin", "place", "fill"]]

    return dealt.groupBy("block").cogroup(winner.groupBy("block")).applyInPandas(lay_out, "_uid_ long, length long, block int, bin int, place long, fill long")


def pack(cut_pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add sequence_id and offset to rows that have ``length`` (1 to ``limit``); any other columns stay (these two are replaced).

    Equal lengths, repeated rows and null ids are told apart by a row number of our own. Empty table: no
    rows. Every row is packed, none twice, and offsets leave no gaps. After ``MOST_ROUNDS`` rounds all bins
    are final, however full: that can cost sequences, never rows.
    """
    cut_pieces = cut_pieces.drop("sequence_id", "offset")
    rows = stash(cut_pieces.withColumn("_uid_", F.monotonically_increasing_id()), "pack-pieces")
    placed = [rows.filter(F.col("length") >= limit).select("_uid_", F.col("_uid_").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left = rows.filter(F.col("length") < limit).select("_uid_", "length")
    n = left.count()
    for number in range(MOST_ROUNDS):
        if not n:
            break
        blocks = pieces(n, PIECES_PER_BLOCK, 1)
        done = stash(_round(left, blocks, limit, SEED + number), f"pack-round{number}")
        final = blocks == 1 or number == MOST_ROUNDS - 1
        full = F.lit(True) if final else F.col("fill") >= WELL_FILLED * limit
        # Whole documents' sequences have ids from 0 up; a round's begin at its number plus one times -2**56.
        name = F.lit(-(number + 1) * (1 << 56)) + F.col("block").cast("long") * (1 << 24) + F.col("bin")
        placed.append(done.filter(full).select("_uid_", name.alias("sequence_id"), F.col("place").alias("offset")))
        if final:
            break
        left = done.filter(~full).select("_uid_", "length")
        n = left.count()
    every = placed[0]
    for p in placed[1:]:
        every = every.unionByName(p)
    return rows.join(every, "_uid_").drop("_uid_")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all documents in sequences of at most 4096 tokens."""
    return packed_documents(table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame) -> DataFrame:
    return pack(cut(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
