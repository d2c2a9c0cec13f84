"""Operator 6: removal of repeated passages by suffix sorting.

Every byte under a window (a string of 400 bytes) that starts more than once in the corpus goes. Sorting
every suffix of the corpus would move many times its size, so exact steps first cut it down to
what can repeat (sizes for 400 bytes):

1. Equal texts are one text with a count.
2. Anchors: of the 337 64-byte strings inside a window, the one with the least hash
   (leftmost of ties). Equal windows have equal anchors. Anchors of every text are counted over the
   corpus; an anchor met once belongs to no repeated window.
3. Windows whose anchor repeats are cut out as *items*: up to 128 neighbouring starts that share
   an anchor. All windows of an item share 273 bytes; their hash is the item's key, and
   equal windows always meet under one key. Equal items are pre-aggregated.
4. Items under one key that differ are sorted by external induced sorting. The shared bytes are one
   symbol of the reduced string: suffixes that begin with it are ordered by what follows, and those
   further left are induced from them, carrying common prefixes; neighbours that share a whole
   window mark both starts. (``repeated_starts`` sorts all suffixes of any strings the same way.)

A key with more than ``CROWDED`` different items (the edges of a passage that very many texts share, say) is not
sorted by one task: its items are split into items of an eighth of the starts, which share more bytes and so fall
under many keys, until no key is crowded or a window is an item of its own.

Sizes are a parameter (``Windows``). *Passages* are stretches of at least ``PASSAGE_WORDS`` words that repeat,
found with windows of 200 bytes; the query finds them first, and as every 400-byte window that repeats lies in a
repeated stretch of 200-byte windows, only stretches from 400 bytes on are searched for those.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batch, join_counted, pieces, shuffle_width, stash, table, text_or_empty
from .induced_sorting import repeated_around, suffix_order


@dataclass(frozen=True)
class Windows:
    """Bytes of a window, of an anchor (a power of two), and starts in an item at most."""

    size: int
    gram: int
    bucket: int

    @property
    def grams(self) -> int:
        return self.size - self.gram + 1

    @property
    def shared(self) -> int:
        """Bytes that all windows of an item share."""
        return self.size - self.bucket + 1


EXACT = Windows(400, 64, 128)
PASSAGE = Windows(200, 32, 64)
WINDOW = EXACT.size
#: Whole words from which on a repeated stretch is a passage; at 4 bytes a word, spaces included, it fills a window of ``PASSAGE``.
PASSAGE_WORDS = 50
#: Places in one piece of text; longer texts are scanned in pieces that overlap by a window.
_PLACE_BITS = 24
_PIECE = 1 << 22
#: Bytes of items sorted in one task.
TASK_BYTES = 16 << 20
#: Different items of one key that are sorted together; more are split, each into so many. 
CROWDED, SPLIT = 128, 8
#: Keys that are broadcast at most, to pick the contents of their items where these lie; and items that a task remembers having written.
MOST_KEYS, REMEMBERED = 1_000_000, 500_000


# ---------------------------------------------------------------- anchors


def _gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    cur, size, base = b.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while size < gram:
        cur = cur[:-size] * np.uint64(pow(base, size, 1 << 64)) + cur[size:]
        size *= 2
    cur ^= cur >> np.uint64(33)
    cur *= np.uint64(0xFF51AFD7ED558CCD)
    cur ^= cur >> np.uint64(29)
    cur *= np.uint64(0xC4CEB9FE1A85EC53)
    return cur ^ (cur >> np.uint64(32))


def _sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, from least-so-far in blocks, forwards and backwards."""
    n = len(v)
    pad = -n % w
    blocks = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(texts: list[bytes], w: Windows = EXACT) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: (hash, place, first start, last start) of its anchors, by start; the starts are those of the windows an anchor stands for."""
    empty = tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.int64, np.int64, np.int64))
    out: list = [empty] * len(texts)
    segments = []  # text, offset, bytes
    for k, t in enumerate(texts):
        if len(t) >= w.size:
            for at in range(0, len(t) - w.size + 1, _PIECE):
                segments.append((k, at, t[at : at + _PIECE + w.size - 1]))
    group: list = []
    size = 0
    found: dict[int, list] = {}
    for seg in [*segments, None]:
        if group and (seg is None or size + len(seg[2]) > 2 * _PIECE):
            for k, part in _anchors_of(group, w):
                found.setdefault(k, []).append(part)
            group, size = [], 0
        if seg is not None:
            group.append(seg)
            size += len(seg[2])
    for k, parts in found.items():
        out[k] = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    return out


def _anchors_of(group, w):
    b = np.frombuffer(b"".join(s for _, _, s in group), dtype=np.uint8)
    ends = np.cumsum([len(s) for _, _, s in group])
    begins = np.concatenate(([0], ends[:-1]))
    h = _gram_hashes(b, w.gram)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = _sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), w.grams)
    step = np.zeros(len(b) + 1, dtype=np.int8)
    step[begins] += 1
    step[ends - w.size + 1] -= 1
    starts = np.flatnonzero(np.cumsum(step[: len(least)]) > 0)
    place = (least[starts] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1))))
    first, last = starts[new], starts[np.concatenate((new[1:], [len(starts)])) - 1]
    place = place[new]
    of = np.searchsorted(ends, first, side="right")
    edge = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True])))
    for a, z in zip(edge[:-1], edge[1:], strict=True):
        k, at, _ = group[of[a]]
        shift = at - begins[of[a]]
        yield k, (h[place[a:z]], place[a:z] + shift, first[a:z] + shift, last[a:z] + shift)


def text_keys(text) -> list:
    """Columns k1 and k2: 128 bits that stand for a text or a string of bytes."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


_FACTS = "row long, k1 long, k2 long, wordy boolean, once array<long>, more array<long>"
_FACTS_SCHEMA = pa.schema([("row", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("wordy", pa.bool_()), ("once", pa.list_(pa.int64())), ("more", pa.list_(pa.int64()))])


def _portions(b: pa.RecordBatch, column: int, most: int = 4 << 20):
    """Slices of a batch with at most about ``most`` bytes of text."""
    at, size = 0, 0
    for i, x in enumerate(b.column(column)):
        size += len(x.as_buffer()) if x.is_valid else 0
        if size >= most:
            yield b.slice(at, i + 1 - at)
            at, size = i + 1, 0
    if at < b.num_rows:
        yield b.slice(at)


def text_facts(rows: DataFrame, w: Windows) -> DataFrame:
    """Row numbers, keys, whether the whole text would be a passage, and the hashes of anchors that a text has once, and more than once (text of a short period has one many times)."""

    def run(it):
        for batch in it:
            for b in _portions(batch, 3):
                raw = [x.as_buffer().to_pybytes() for x in b.column(3)]
                hashes = [np.unique(a[0].view(np.int64), return_counts=True) for a in anchors(raw, w)]
                wordy = [len(x) >= PASSAGE.size and len(x.split(None, PASSAGE_WORDS)) >= PASSAGE_WORDS for x in raw]
                yield as_batch({"row": b.column(0), "k1": b.column(1), "k2": b.column(2), "wordy": wordy, "once": [h[n == 1] for h, n in hashes], "more": [h[n > 1] for h, n in hashes]}, _FACTS_SCHEMA)

    return rows.select("row", "k1", "k2", "raw").mapInArrow(run, _FACTS)


# ---------------------------------------------------------------- items


def items_of(raw: bytes, repeated: np.ndarray, w: Windows = EXACT):
    """(key, first start, bytes, place of the shared bytes in them) of a text's items. ``repeated``: the hashes of its anchors that the corpus has more than once."""
    h, place, first, last = anchors([raw], w)[0]
    ok = np.isin(h.view(np.int64), repeated)
    for k in np.flatnonzero(ok).tolist():
        p, lo, hi, name = int(place[k]), int(first[k]), int(last[k]), int(h[k]).to_bytes(8, "little")
        # Starts p - d with d in [zone, zone + w.bucket): all of their windows hold the bytes from p - zone.
        for bucket in range((p - hi) // w.bucket, (p - lo) // w.bucket + 1):
            zone = bucket * w.bucket
            a, z = max(lo, p - zone - w.bucket + 1), min(hi, p - zone)
            if a <= z:
                shared = raw[p - zone : p - zone - w.bucket + 1 + w.size]
                yield xxhash.xxh3_64_intdigest(shared + name + bytes([bucket])) - (1 << 63), a, raw[a : z + w.size], p - zone - a


_ITEMS = "key long, digest long, span int, left binary, right binary, k1 long, k2 long, first int"
_ITEMS_SCHEMA = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("span", pa.int32()), ("left", pa.binary()), ("right", pa.binary()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int32())])


def _listed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return as_batch(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema)


def cut_items(texts: DataFrame, w: Windows) -> DataFrame:
    """Items of texts (k1, k2, raw, hashes). What is left and right of the shared bytes is null where the task has written it before; the digest stands for all of it."""

    def run(it):
        written: set[int] = set()
        for b in it:
            rows = []
            for i in range(b.num_rows):
                raw = b.column(2)[i].as_buffer().to_pybytes()
                k1, k2 = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                for key, first, content, core in items_of(raw, np.asarray(b.column(3)[i].as_py(), dtype=np.int64), w):
                    digest = xxhash.xxh3_64_intdigest(content) - (1 << 63)
                    name = key << 64 ^ digest
                    new = name not in written
                    if new:
                        written.add(name)
                    rows.append((key, digest, len(content) - w.size, content[:core] if new else None, content[core + w.shared :] if new else None, k1, k2, first))
                if len(rows) > 4000 or (rows and i == b.num_rows - 1):
                    yield _listed(rows, _ITEMS_SCHEMA)
                    rows = []
            if len(written) > REMEMBERED:
                written.clear()

    return texts.select("k1", "k2", "raw", "hashes").mapInArrow(run, _ITEMS)


# ---------------------------------------------------------------- suffix sorting


def repeated_starts(contents: list[bytes], window: int = WINDOW) -> list[list[int]]:
    """For each of several strings, the starts of ``window``-byte strings that start anywhere else among them."""
    m = len(contents)
    text: list[int] = []
    end: list[int] = []
    owner: list[int] = []
    for k, c in enumerate(contents):
        at = len(text)
        text += [m + x for x in c]
        text.append(k)  # a separator of its own, smaller than every byte
        end += [at + len(c)] * (len(c) + 1)
        owner.append(at)
    blob = b"\0".join(contents) + b"\0"

    def common(i: int, j: int) -> int:
        most = min(end[i] - i, end[j] - j, window)
        if blob[i : i + most] == blob[j : j + most]:
            return most
        low, high = 0, most
        while high - low > 1:
            mid = (low + high) // 2
            if blob[i + low : i + mid] == blob[j + low : j + mid]:
                low = mid
            else:
                high = mid
        return low

    order, prefix = suffix_order(text, common)
    hit = [False] * len(text)
    for k in range(1, len(order)):
        if prefix[k] >= window:
            hit[order[k - 1]] = hit[order[k]] = True
    return [[i - at for i in range(at, at + len(c) - window + 1) if hit[i]] for at, c in zip(owner, contents, strict=True)]


def as_ranges(starts: list[int]) -> list[tuple[int, int]]:
    """Neighbouring starts as (first, last)."""
    out: list[list[int]] = []
    for s in starts:
        if out and s == out[-1][1] + 1:
            out[-1][1] = s
        else:
            out.append([s, s])
    return [(a, b) for a, b in out]


_MARKS = "key long, digest long, n long, ranges array<struct<a:int,z:int>>"
_MARKS_SCHEMA = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("n", pa.int64()), ("ranges", pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())])))])


def marks_of(group: dict[tuple, list], w: Windows = EXACT) -> list[tuple]:
    """(key, digest, n, ranges) of one key's items: (key, digest) with left, right, n (rows) and copies."""
    rows = []
    names = list(group)
    found = repeated_around([group[x][0] for x in names], [group[x][1] for x in names], w.bucket) if len(group) > 1 else [[]]
    for (key, digest), before in zip(names, found, strict=True):
        left, right, n, copies = group[key, digest]
        ranges = [(0, len(left) + w.shared + len(right) - w.size)] if copies > 1 else as_ranges(sorted({len(left) - d for d in before}))
        if ranges:
            rows.append((key, digest, n, [{"a": a, "z": z} for a, z in ranges]))
    return rows


def mark_repeats(items: DataFrame, w: Windows) -> DataFrame:
    """(key, digest, n, ranges): repeated starts a to z of each item that has any. ``items`` (key, digest, left, right, n, copies), each once, lie together by key."""

    def run(it):
        group: dict[tuple, list] = {}
        rows: list[tuple] = []
        at = None
        for b in it:
            for key, digest, *own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != at:
                    if group:
                        rows += marks_of(group, w)
                    group, at = {}, key
                group[key, digest] = own
            if len(rows) > 10_000:
                yield _listed(rows, _MARKS_SCHEMA)
                rows = []
        if group:
            rows += marks_of(group, w)
        if rows:
            yield _listed(rows, _MARKS_SCHEMA)

    return items.select("key", "digest", "left", "right", "n", "copies").mapInArrow(run, _MARKS)


_PARTS = "key long, digest long, span int, left binary, right binary, copies long, parent long, own long, shift int"
_PARTS_SCHEMA = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("span", pa.int32()), ("left", pa.binary()), ("right", pa.binary()), ("copies", pa.int64()), ("parent", pa.int64()), ("own", pa.int64()), ("shift", pa.int32())])


def parts_of(key: int, digest: int, left: bytes, right: bytes, copies: int, bucket: int, step: int):
    """Items of ``step`` starts out of one of ``bucket``: those that begin d bytes before the shared ones, zone by zone of d."""
    name = key.to_bytes(8, "little", signed=True)
    for zone in range(0, bucket, step):
        more = bucket - zone - step  # bytes on the right that all windows of the zone hold
        if len(left) < zone or len(right) < more:
            continue
        at = len(left) - zone
        a, z = left[max(0, at - step + 1) : at], right[more : more + step - 1]
        new = xxhash.xxh3_64_intdigest(name + zone.to_bytes(2, "little") + left[at:] + right[:more]) - (1 << 63)
        span = len(a) + len(z) - step + 1
        if span >= 0:
            yield new, xxhash.xxh3_64_intdigest(bytes([len(a)]) + a + z) - (1 << 63), span, a, z, copies, key, digest, at - len(a)


def split_items(items: DataFrame, bucket: int, step: int) -> DataFrame:
    def run(it):
        for b in it:
            for at in range(0, b.num_rows, 512):
                rows = [p for row in zip(*(c.to_pylist() for c in b.slice(at, 512).columns), strict=True) for p in parts_of(*row, bucket, step)]
                if rows:
                    yield _listed(rows, _PARTS_SCHEMA)

    return items.select("key", "digest", "left", "right", "copies").mapInArrow(run, _PARTS)


def marked(items: DataFrame, w: Windows, label: str) -> DataFrame:
    """(key, digest, n, ranges) of the items (key, digest, span, left, right, copies) that hold repeated windows; n counts their rows in ``items``.

    Only counts of (key, digest) are shuffled for all items; contents only for keys with different items.
    """
    counts = stash(items.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies"), F.first("span").alias("span")), f"{label}-counts")
    several = stash(counts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), f"{label}-keys")
    n_keys, most = several.agg(F.count(F.lit(1)), F.coalesce(F.max("kinds"), F.lit(0))).first()
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("span").alias("z")))
    if n_keys <= MOST_KEYS:
        among = lambda rows, keys, how: rows.join(F.broadcast(keys), "key", how)
    else:
        among = lambda rows, keys, how: join_counted(rows, keys, ["key"], "kinds", rows.count(), how)
    kinds = among(counts, several, "left").withColumn("kinds", F.coalesce("kinds", F.lit(1)))
    alone = kinds.filter("kinds = 1 AND copies > 1").select("key", "digest", "n", whole.alias("ranges"))
    # Keys with different items: each item once, with its contents, from the first of the tasks that wrote them.
    contents = among(items.filter("left IS NOT NULL").select("key", "digest", "left", "right"), several, "left_semi")
    none = F.lit(None)
    contents = contents.select("*", *[none.cast("long").alias(c) for c in ("n", "copies", "kinds")])
    numbers = kinds.filter("kinds > 1").select("key", "digest", *[none.cast("binary").alias(c) for c in ("left", "right")], "n", "copies", "kinds")
    own = contents.unionByName(numbers).groupBy("key", "digest").agg(F.first("left", True).alias("left"), F.first("right", True).alias("right"), *[F.max(c).alias(c) for c in ("n", "copies", "kinds")])
    own = stash(own, f"{label}-own")
    parts = pieces(n_keys * 8 * w.bucket, TASK_BYTES, shuffle_width(items.sparkSession))
    marks = alone.unionByName(mark_repeats(own.filter(F.col("kinds") <= CROWDED).repartition(parts, "key").sortWithinPartitions("key"), w))
    if most > CROWDED:
        crowd = own.filter(F.col("kinds") > CROWDED)
        step = max(1, w.bucket // SPLIT)
        split = stash(split_items(crowd, w.bucket, step), f"{label}-split")
        hits = join_counted(split.select("key", "digest", "parent", "own", "shift"), marked(split, Windows(w.size, w.gram, step), label), ["key", "digest"], "n", split.count())
        found = hits.groupBy(F.col("parent").alias("key"), F.col("own").alias("digest")).agg(F.flatten(F.collect_list(moved("shift"))).alias("ranges"))
        marks = marks.unionByName(found.join(crowd.select("key", "digest", "n"), ["key", "digest"]).select("key", "digest", "n", "ranges"))
    return stash(marks, f"{label}-marks")


def moved(by: str):
    """``ranges``, each by the places in column ``by`` further on."""
    return F.transform("ranges", lambda r: F.struct((r["a"] + F.col(by)).cast("int").alias("a"), (r["z"] + F.col(by)).cast("int").alias("z")))


# ---------------------------------------------------------------- the operator


def covered(ranges: list[tuple[int, int]], size: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal runs [from, to) of the bytes under windows whose first to last starts are given."""
    out: list[list[int]] = []
    for a, z in sorted(ranges):
        to = min(z + window, size)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], to)
        else:
            out.append([a, to])
    return [(a, b) for a, b in out]


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, keep = 0, []
    for a, b in runs:
        keep.append(raw[at:a])
        at = b
    return b"".join(keep) + raw[at:]


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def passages(raw: bytes, runs: list[tuple[int, int]], least: int = PASSAGE_WORDS) -> list[tuple[int, int]]:
    """The runs that hold at least so many whole words of the text."""
    out = []
    for a, b in runs:
        cut = (a > 0 and not raw[a - 1 : a].isspace() and not raw[a : a + 1].isspace()) + (b < len(raw) and not raw[b - 1 : b].isspace() and not raw[b : b + 1].isspace())
        if sum(1 for _ in _WORD.finditer(raw, a, b)) - cut >= least:
            out.append((a, b))
    return out


def repeated_ranges(rows: DataFrame, w: Windows, label: str) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts (k1, k2, copies, wordy: they would be a passage as a whole), and the texts that share windows with others or repeat their own: (k1, k2, raw, ranges).

    ``rows``: (row, k1, k2, raw); rows of one number and key are copies. Null numbers are allowed. ``ranges`` are
    the starts of repeated windows; of a class of several copies, those that repeat in other texts too.
    """
    facts = text_facts(rows, w)
    classes = stash(
        facts.groupBy("k1", "k2").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"), F.max("wordy").alias("wordy"), F.first("once").alias("once"), F.first("more").alias("more")),
        f"{label}-classes",
    )
    # Copies of a text count as one, so that their anchors are not counted, nor joined, again and again.
    tagged = lambda name, flag: F.transform(name, lambda h: F.struct(h.alias("anchor"), F.lit(flag).alias("more")))
    met = classes.select("k1", "k2", F.explode(F.concat(tagged("once", False), tagged("more", True))).alias("a")).select("k1", "k2", "a.anchor", "a.more")
    n_met = classes.agg(F.coalesce(F.sum(F.size("once") + F.size("more")), F.lit(0))).first()[0]
    often = stash(met.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("more").alias("more")).filter("n > 1 OR more").select("anchor", "n"), f"{label}-often")
    hashes = join_counted(met.select("k1", "k2", "anchor"), often, ["anchor"], "n", n_met, "left_semi").groupBy("k1", "k2").agg(F.collect_list("anchor").alias("hashes"))
    wanted = hashes.join(classes.select("k1", "k2", "row"), ["k1", "k2"])
    # Rows without a number are looked up by their text alone, each text once.
    numbered = rows.filter("row IS NOT NULL").join(wanted.filter("row IS NOT NULL"), ["row", "k1", "k2"])
    others = rows.filter("row IS NULL").dropDuplicates(["k1", "k2"]).join(wanted.filter("row IS NULL").drop("row"), ["k1", "k2"])
    kept = ["k1", "k2", "raw", "hashes"]
    # Repeated rows may be met twice here; they are copies, which are told by their class.
    texts = stash(numbered.select(*kept).unionByName(others.select(*kept)), f"{label}-texts")
    items = stash(cut_items(texts, w), f"{label}-items")
    marks = marked(items.select("key", "digest", "span", "left", "right", F.lit(1).cast("long").alias("copies")), w, label)
    hits = join_counted(items.select("key", "digest", "k1", "k2", "first"), marks, ["key", "digest"], "n", items.count())
    ranges = hits.groupBy("k1", "k2").agg(F.flatten(F.collect_list(moved("first"))).alias("ranges"))
    return classes.select("k1", "k2", "copies", "wordy"), texts.select("k1", "k2", "raw").join(ranges, ["k1", "k2"])


def document_rows(docs: DataFrame) -> DataFrame:
    """Rows for ``repeated_ranges``: null texts as empty."""
    text = text_or_empty(docs)
    return docs.select(F.col("doc_id").cast("long").alias("row"), *text_keys(text), text.cast("binary").alias("raw"))


_RUNS = "k1 long, k2 long, raw binary, n_passage long, stretches array<struct<at:int,raw:binary>>"
_RUNS_SCHEMA = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("raw", pa.binary()), ("n_passage", pa.int64()), ("stretches", pa.list_(pa.struct([("at", pa.int32()), ("raw", pa.binary())])))])
_CUTS = "k1 long, k2 long, n_removed long, n_spans long, kept binary"
_CUTS_SCHEMA = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _pairs(found) -> list[tuple[int, int]]:
    return [(x["a"], x["z"]) for x in found]


def stretches(found: DataFrame) -> DataFrame:
    """Of texts with repeated ``PASSAGE`` windows: the bytes under passages, and the stretches that can hold an ``EXACT`` window."""

    def run(it):
        for b in it:
            for part in _portions(b, 2):
                rows = []
                for k1, k2, raw, ranges in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    runs = covered(_pairs(ranges), len(raw), PASSAGE.size)
                    long = [{"at": a, "raw": raw[a:z]} for a, z in runs if z - a >= EXACT.size]
                    rows.append((k1, k2, raw if long else b"", sum(z - a for a, z in passages(raw, runs)), long))
                if rows:
                    yield _listed(rows, _RUNS_SCHEMA)

    return found.select("k1", "k2", "raw", "ranges").mapInArrow(run, _RUNS)


def exact_ranges(runs: DataFrame) -> DataFrame:
    """(k1, k2, ranges): starts of repeated ``EXACT`` windows of texts, from their ``stretches``."""
    at = stash(runs.select("k1", "k2", F.explode("stretches").alias("s")).select("k1", "k2", "s.at", "s.raw"), "op6-stretches")
    named = at.select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), "at", F.octet_length("raw").alias("n"), *text_keys(F.col("raw")))
    rows = at.select(F.xxhash64("k1", "k2", "at").alias("row"), *text_keys(F.col("raw")), "raw")
    classes, found = repeated_ranges(rows, EXACT, "op6-exact")
    # A stretch of several texts repeats as a whole.
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - EXACT.size).alias("z")))
    copied = classes.join(found.select("k1", "k2", "ranges"), ["k1", "k2"], "left").filter("copies > 1 OR ranges IS NOT NULL")
    got = join_counted(named, stash(copied, "op6-found"), ["k1", "k2"], "copies", named.count())
    got = got.withColumn("ranges", F.when(F.col("copies") > 1, whole).otherwise(F.col("ranges")))
    return got.groupBy(F.col("t1").alias("k1"), F.col("t2").alias("k2")).agg(F.flatten(F.collect_list(moved("at"))).alias("ranges"))


def cuts_of(found: DataFrame, runs_of, digest: bool) -> DataFrame:
    """What texts (k1, k2, raw, ranges) lose: ``runs_of`` gives the runs; ``kept`` is the SHA-256 of what is left, or that itself, without broken characters."""

    def run(it):
        for b in it:
            for part in _portions(b, 2):
                rows = []
                for k1, k2, raw, ranges in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if runs := runs_of(raw, _pairs(ranges)):
                        left = without(raw, runs)
                        rows.append((k1, k2, sum(z - a for a, z in runs), len(runs), hashlib.sha256(left).digest() if digest else left.decode("utf-8", "ignore").encode()))
                if rows:
                    yield _listed(rows, _CUTS_SCHEMA)

    return found.select("k1", "k2", "raw", "ranges").mapInArrow(run, _CUTS).dropDuplicates(["k1", "k2"])


def removed_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage: one row for each row of ``docs``.

    ``n_passage``: bytes of passages (at least ``PASSAGE_WORDS`` words under repeated 200-byte windows), shorter ones than 400 bytes too.
    Null text: as empty. Texts under 400 bytes lose nothing. Copies of a text, repeated rows
    included, lose all of it (from 400 bytes on), as each of its windows starts elsewhere. Null
    and repeated ids are allowed. Empty table: no rows.
    """
    classes, found = repeated_ranges(document_rows(docs), PASSAGE, "op6")
    runs = stash(stretches(found), "op6-runs")
    cuts = cuts_of(runs.select("k1", "k2", "raw").join(exact_ranges(runs), ["k1", "k2"]), lambda raw, ranges: covered(ranges, len(raw)), True)
    lost = runs.select("k1", "k2", "n_passage").dropDuplicates(["k1", "k2"]).join(cuts, ["k1", "k2"], "left")
    known = stash(classes.join(lost, ["k1", "k2"], "left").filter("copies > 1 OR n_passage IS NOT NULL"), "op6-cuts")
    text = text_or_empty(docs)
    facts = docs.select(F.col("doc_id").cast("long"), *text_keys(text), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"))
    facts = stash(facts, "op6-facts")
    joined = join_counted(facts, known, ["k1", "k2"], "copies", facts.count(), "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= WINDOW)
    passage = (F.col("copies") > 1) & F.col("wordy")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    none = F.lit(0).cast("long")
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", none)).cast("long").alias("n_spans"),
        F.when(gone, empty).when(F.col("kept").isNotNull(), F.lower(F.hex("kept"))).otherwise(F.col("whole")).alias("kept_sha256"),
        F.when(passage, F.col("n_bytes")).otherwise(F.coalesce("n_passage", none)).alias("n_passage"),
    )


def cut_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without the bytes of passages, n_chars following; null texts stay null.

    A character that loses some of its bytes goes whole. Texts are looked up by their key, so copies lose alike:
    of a text that is there more than once, whatever its length, all from ``PASSAGE_WORDS`` words on.
    """
    classes, found = repeated_ranges(document_rows(docs), PASSAGE, "op6")
    cuts = cuts_of(found, lambda raw, ranges: passages(raw, covered(ranges, len(raw), PASSAGE.size)), False)
    known = classes.join(cuts.select("k1", "k2", "kept"), ["k1", "k2"], "left").filter("copies > 1 OR kept IS NOT NULL")
    known = stash(known.select(F.col("k1").alias("_k1_"), F.col("k2").alias("_k2_"), F.col("copies").alias("_copies_"), ((F.col("copies") > 1) & F.col("wordy")).alias("_gone_"), F.col("kept").alias("_kept_")), "op6-lost")
    one, two = text_keys(text_or_empty(docs))
    keyed = docs.withColumns({"_k1_": one, "_k2_": two, "_old_": F.col("text")})
    joined = join_counted(keyed, known, ["_k1_", "_k2_"], "_copies_", classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0], "left")
    text = F.when(F.col("_copies_").isNull() | F.col("_old_").isNull(), F.col("_old_")).when(F.col("_gone_"), F.lit("")).when(F.col("_kept_").isNotNull(), F.decode(F.col("_kept_"), "UTF-8")).otherwise(F.col("_old_"))
    done = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("text").eqNullSafe(F.col("_old_")), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return done.select(*docs.columns)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_bytes(table(spark, sf_dir, "documents"))
