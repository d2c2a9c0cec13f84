"""Operator 13: byte-level BPE by a monoid of encodings, reduced as a tree.

Two texts' encodings can be joined without encoding their whole again, so encoding is a reduction: encode
halves, join neighbours. It is done on two levels, each with its own proof of where a join has settled.

*Merges inside a match of the pattern.* Bytes are merged as the ranks say: the lowest rank first, the leftmost of equal ones. A pair of
neighbouring tokens is stable if merging their bytes alone gives the two again. A sequence of tokens is the encoding of its bytes
if and only if all of its neighbours are stable: consider the first merge over any border between them. Until then the tokens on both sides have
evolved as they do alone, for no merge outside touches them and the order of the merges inside is kept; so the pair alone would merge there too. The same
argument, read backwards, makes neighbours in an encoding stable. Hence if a window, cut from the last tokens of the left side and the
first of the right side, is encoded again and its outermost tokens come out as they were, every border of the joined sequence is
stable and the join is the encoding. Windows grow until that holds, or until they hold both sides.

*Matches inside a text.* The pattern looks at most ``MARGIN`` characters behind a match's end, so all matches that end earlier
than that before the border stand. From the first that does not, matching goes on into the right side, over growing windows, until one begins where a
match of the right side began: what follows a place depends on nothing before it.

Decoding concatenates halves up the same tree. Texts stay in their rows, nothing is shuffled; long texts are read in leaves of ``LEAF``
characters, so memory beyond the text and its ids is bounded. Matches of many texts are encoded together, their trees level by level over arrays.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import portions, table, text_or_empty

#: Characters after a match's end that the pattern may look at: the longest contraction has three, the look-ahead and a run's end one.
MARGIN = 3
#: Characters of a text's leaf, bytes of a match's, and tokens of a leaf when decoding; bytes of a window up to which merges go step by step over arrays rather than by a heap.
LEAF, OWN_LEAF, IDS_LEAF, LISTED = 1 << 16, 8, 1 << 12, 48
#: Strings of a kind that a worker process remembers, about; matches that are encoded at a time.
REMEMBERED, AT_ONCE = 300_000, 16_384


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


class Merges:
    """Encodings of many byte strings at once, under a table of ranks; tokens are their ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.base = max(ranks.values(), default=0) + 1
        own = [b""] * self.base
        for t, r in ranks.items():
            own[r] = t
        self.tokens = own
        self.sizes = np.fromiter(map(len, own), dtype=np.int64, count=self.base)
        self.ends = np.cumsum(self.sizes)
        self.single = np.array([ranks[bytes([c])] for c in range(256)], dtype=np.int64)
        self.bytes = self.single[np.frombuffer(b"".join(own), dtype=np.uint8)]  # of each token, its bytes' tokens
        # Every pair of tokens whose bytes together are a token, and that token.
        pairs = [(x * self.base + y, r) for t, r in ranks.items() for k in range(1, len(t)) if (x := ranks.get(t[:k])) is not None and (y := ranks.get(t[k:])) is not None]
        table = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        self.keys, self.joined = np.append(table[:, 0], np.iinfo(np.int64).max), np.append(table[:, 1], self.base)

    def encode(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all strings, one after the other, and how many each has: leaves first, then joins of neighbours, level by level."""
        size = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        levels = np.ceil(np.log2(np.maximum(size, 1) / OWN_LEAF)).clip(0).astype(np.int64)
        nodes = np.int64(1) << levels  # leaves of a string: its halves' halves
        which = np.repeat(np.arange(len(strings)), nodes)
        i = np.arange(len(which)) - np.repeat(np.cumsum(nodes) - nodes, nodes)
        leaf = (i + 1) * size[which] // nodes[which] - i * size[which] // nodes[which]
        tokens, count = self.merged(self.single[np.frombuffer(b"".join(strings), dtype=np.uint8)], leaf)
        while (nodes > 1).any():
            which = np.repeat(np.arange(len(nodes)), nodes)
            i = np.arange(len(which)) - np.repeat(np.cumsum(nodes) - nodes, nodes)
            left = np.flatnonzero((nodes[which] > 1) & (i % 2 == 0))
            tokens, count = self._joined(tokens, count, left)
            count = np.delete(count, left + 1)
            nodes = np.maximum(nodes // 2, 1)
        return tokens, count

    def _joined(self, tokens: np.ndarray, count: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each node of ``left`` joined with the next one; its count is then of both (the next one's is left to the caller)."""
        border = np.cumsum(count)[left]
        n_left, n_right = count[left], count[left + 1]
        i, j = np.minimum(1, n_left), np.minimum(1, n_right)
        open_, starts, stops, news, sizes = np.arange(len(left)), [], [], [], []
        while len(open_):
            start, stop = border[open_] - i[open_], border[open_] + j[open_]
            flat, size = self.merged(*self._bytes_of(tokens, start, stop))
            first, last = np.cumsum(size) - size, np.cumsum(size) - 1
            safe = np.minimum(first, max(len(flat) - 1, 0))
            left_stands = (i[open_] == n_left[open_]) | (size > 0) & (flat[safe] == tokens[np.minimum(start, len(tokens) - 1)])
            right_stands = (j[open_] == n_right[open_]) | (size > 0) & (flat[last] == tokens[stop - 1])
            done = left_stands & right_stands
            starts.append(start[done]), stops.append(stop[done]), sizes.append(size[done])
            news.append(flat[np.repeat(done, size)])
            i[open_] = np.where(left_stands, i[open_], np.minimum(2 * i[open_], n_left[open_]))
            j[open_] = np.where(right_stands, j[open_], np.minimum(2 * j[open_], n_right[open_]))
            count[left[open_[done]]] += count[left[open_[done]] + 1] - (stop - start)[done] + size[done]
            open_ = open_[~done]
        start, stop, size, new = map(np.concatenate, (starts, stops, sizes, news))
        order = np.argsort(start)
        new = new[np.argsort(np.repeat(np.argsort(order), size), kind="stable")]
        start, stop, size = start[order], stop[order], size[order]
        # Windows' tokens go, their encodings come in their place.
        gone = np.zeros(len(tokens) + 1, dtype=np.int64)
        np.add.at(gone, start, 1), np.add.at(gone, stop, -1)
        kept = np.cumsum(gone[:-1]) == 0
        place = np.concatenate(([0], np.cumsum(kept)))[start]
        return np.insert(tokens[kept], np.repeat(place, size), new), count

    def _bytes_of(self, tokens: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The single-byte tokens of windows of tokens, and how many each window has."""
        n = stop - start
        inside = tokens[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        size = self.sizes[inside]
        upto = np.concatenate(([0], np.cumsum(size)))
        flat = self.bytes[np.repeat(self.ends[inside] - upto[1:], size) + np.arange(int(upto[-1]))]
        window = np.concatenate(([0], np.cumsum(n)))
        return flat, upto[window[1:]] - upto[window[:-1]]

    def merged(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges in all stretches of single-byte tokens, one a stretch and step; long stretches go by a heap each."""
        out, count = flat.copy(), size.copy()
        which = np.repeat(np.arange(len(size)), size)
        alive = np.ones(len(flat), dtype=bool)
        begin = np.cumsum(size) - size
        for k in np.flatnonzero(size > LISTED):
            a, n = begin[k], size[k]
            got = self.merged_by_heap(flat[a : a + n])
            out[a : a + len(got)], alive[a + len(got) : a + n], count[k] = got, False, len(got)
        at = np.flatnonzero(size[which] <= LISTED)  # places of stretches that still merge
        rank = self._ranks(out, which, at, np.arange(len(at)))  # of each place with the next
        while len(at) > 1:
            own = which[at]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            least, n = np.minimum.reduceat(rank, first), np.diff(np.append(first, len(at)))
            hits = np.flatnonzero((rank == np.repeat(least, n)) & (rank < self.base))
            if not len(hits):
                break
            hits = hits[np.concatenate(([True], own[hits][1:] != own[hits][:-1]))]  # the leftmost of each stretch
            out[at[hits]] = rank[hits]
            alive[at[hits + 1]] = False
            count[own[hits]] -= 1
            still = np.repeat(least < self.base, n)
            still[hits + 1] = False
            now = np.cumsum(still)[hits] - 1
            at, rank = at[still], rank[still]
            for k in (now, now[now > 0] - 1):  # only ranks beside a merge change
                rank[k] = self._ranks(out, which, at, k)
        return out[alive], count

    def _ranks(self, out: np.ndarray, which: np.ndarray, at: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Of some of the places, the token that each makes with the next place of its stretch, or ``base``."""
        if not len(at):
            return np.zeros(0, dtype=np.int64)
        here, after = at[k], at[np.minimum(k + 1, len(at) - 1)]
        key = out[here] * self.base + out[after]
        found = np.searchsorted(self.keys, key)
        return np.where((self.keys[found] == key) & (which[here] == which[after]) & (here != after), self.joined[found], self.base)

    def merged_by_heap(self, flat: np.ndarray) -> list[int]:
        """The tokens of one long stretch: pieces are linked, and candidates wait in a heap by rank and place."""
        n, ranks, own = len(flat), self.ranks, b"".join([self.tokens[t] for t in flat.tolist()])
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(own[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, stop = heapq.heappop(heap)
            m = after[k]
            if end[k] < 0 or m >= n or end[m] != stop:  # one of the two has been merged since
                continue
            end[k], end[m], after[k] = stop, -1, after[m]
            if after[k] < n:
                before[after[k]] = k
                if (r := ranks.get(own[k : end[after[k]]])) is not None:
                    heapq.heappush(heap, (r, k, end[after[k]]))
            if before[k] >= 0 and (r := ranks.get(own[before[k] : stop])) is not None:
                heapq.heappush(heap, (r, before[k], stop))
        out, k = [], 0
        while k < n:
            out.append(ranks[own[k : end[k]]])
            k = after[k]
        return out


class Part:
    """A stretch of a text: where its matches begin, and their ids as bytes, in blocks of some matches each."""

    __slots__ = ("begin", "end", "starts", "ids")

    def __init__(self, begin: int, end: int, starts: list[np.ndarray], ids: list[list[bytes]]):
        self.begin, self.end, self.starts, self.ids = begin, end, starts, ids


class ByteBpe:
    """Ids of whole texts and the bytes of ids."""

    def __init__(self, path: str, split: str):
        import regex

        self.merges = Merges(read_ranks(path))
        self.split = regex.compile(split)
        #: Of matches, and of strings behind a space, the ids as little-endian 32-bit bytes.
        self.matches: dict[str, bytes] = {}
        self.spaced: dict[str, bytes | None] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, little-endian, 32 bits each; strings that the texts share are encoded once.

        A match begins at every space between two characters that are not white space: no class of the pattern ends with a
        space before another character, and all take one in front. So texts are cut there; those with other white space at a space are read whole.
        """
        if len(self.matches) > REMEMBERED or len(self.spaced) > REMEMBERED:
            self.matches, self.spaced = {}, {}
        cut = [t.split(" ") if len(t) <= LEAF else [t] for t in texts]
        self._learn_spaced(set().union(*[c[1:] for c in cut]).difference(self.spaced))
        known = self.spaced.__getitem__
        behind = [list(map(known, c[1:])) for c in cut]
        whole = [len(t) <= LEAF and (None in b or c[0] != c[0].rstrip()) for t, c, b in zip(texts, cut, behind, strict=True)]
        firsts = [self.split.findall(t if w else c[0]) if len(t) <= LEAF else [] for t, c, w in zip(texts, cut, whole, strict=True)]
        self._learn(set().union(*firsts).difference(self.matches))
        known, out = self.matches.__getitem__, []
        for t, first, rest, w in zip(texts, firsts, behind, whole, strict=True):
            if len(t) > LEAF:
                out.append(b"".join(b"".join(block) for block in self._tree(t, 0, len(t)).ids))
            else:
                out.append(b"".join(map(known, first)) + (b"" if w else b"".join(rest)))
        return out

    def _learn_spaced(self, strings: set[str]) -> None:
        """Strings behind a space, where no match can reach over their ends; none if one is empty or begins or ends with white space."""
        found = {s: None if s != s.strip() or not s else self.split.findall(" " + s) for s in strings}
        self._learn(set().union(*filter(None, found.values())).difference(self.matches))
        known = self.matches.__getitem__
        self.spaced.update((s, None if f is None else b"".join(map(known, f))) for s, f in found.items())

    def _learn(self, new: set[str]) -> None:
        ranks, rest = self.merges.ranks, []
        for m in new:
            own = m.encode()
            r = ranks.get(own)
            if r is None:
                rest.append((m, own))
            else:  # a match that is a token is that token, as in the library
                self.matches[m] = r.to_bytes(4, "little")
        for at in range(0, len(rest), AT_ONCE):
            part = rest[at : at + AT_ONCE]
            tokens, count = self.merges.encode([own for _, own in part])
            ids, at_byte = tokens.astype("<u4").tobytes(), 0
            for (m, _), n in zip(part, count.tolist(), strict=True):
                self.matches[m] = ids[at_byte : at_byte + 4 * n]
                at_byte += 4 * n

    def _scan(self, text: str, begin: int, end: int) -> Part:
        """The matches of a stretch read by itself."""
        found = self.split.findall(text, begin, end)
        self._learn(set(found).difference(self.matches))
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return Part(begin, end, [begin + np.cumsum(sizes) - sizes], [list(map(self.matches.__getitem__, found))])

    def _tree(self, text: str, begin: int, end: int) -> Part:
        if end - begin <= LEAF:
            return self._scan(text[begin:end], 0, end - begin) if begin == 0 else self._moved(self._scan(text[begin:end], 0, end - begin), begin)
        half = (begin + end) // 2
        return self._join(text, self._tree(text, begin, half), self._tree(text, half, end))

    @staticmethod
    def _moved(part: Part, by: int) -> Part:
        return Part(part.begin + by, part.end + by, [s + by for s in part.starts], part.ids)

    def _join(self, text: str, left: Part, right: Part) -> Part:
        """The matches of both stretches read as one."""
        border = left.end
        # Matches of the left side that end MARGIN before the border stand: those before the last match that begins by then.
        starts, ids = list(left.starts), list(left.ids)
        cut = border - MARGIN
        while starts and (not len(starts[-1]) or (len(starts) > 1 and starts[-1][0] > cut)):
            starts.pop(), ids.pop()
        keep = max(int(np.searchsorted(starts[-1], cut, side="right")) - 1, 0)
        at = int(starts[-1][keep])
        starts[-1], ids[-1] = starts[-1][:keep], ids[-1][:keep]
        reach = 64
        while True:
            stop = min(border + reach, right.end)
            window = self._moved(self._scan(text[at:stop], 0, stop - at), at)
            found = window.starts[0]
            # A match of the window stands if the window shows what the pattern may look at behind it, or ends where the text does.
            sure = found if stop == right.end else found[: max(int(np.searchsorted(found, stop - MARGIN, side="right")) - 1, 0) + 1]
            own = np.concatenate(right.starts)
            both = np.intersect1d(sure, own, assume_unique=True)
            if len(both):
                first = int(both[0])
                n = int(np.searchsorted(found, first))
                rest_starts, rest_ids = self._from(right, first)
                return Part(left.begin, right.end, [*starts, found[:n], *rest_starts], [*ids, window.ids[0][:n], *rest_ids])
            if stop == right.end:
                return Part(left.begin, right.end, [*starts, found], [*ids, window.ids[0]])
            reach *= 4

    @staticmethod
    def _from(part: Part, first: int) -> tuple[list[np.ndarray], list[list[bytes]]]:
        """The blocks of a part from the match that begins at a place."""
        for k, s in enumerate(part.starts):
            if len(s) and s[-1] >= first:
                i = int(np.searchsorted(s, first))
                return [s[i:], *part.starts[k + 1 :]], [part.ids[k][i:], *part.ids[k + 1 :]]
        return [], []

    def decode(self, ids: np.ndarray) -> bytes:
        return concatenated(ids, self.merges.tokens)


def concatenated(ids: np.ndarray, tokens: list[bytes]) -> bytes:
    """The bytes of ids: halves, decoded alike, concatenated. Unknown ids raise."""
    if len(ids) <= IDS_LEAF:
        return b"".join(map(tokens.__getitem__, ids.tolist()))
    half = len(ids) // 2
    return concatenated(ids[:half], tokens) + concatenated(ids[half:], tokens)


@lru_cache(maxsize=2)
def tokens_of(path: str) -> list[bytes]:
    """The bytes of every id, by id; ids that the table skips are empty."""
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for t, r in ranks.items():
        tokens[r] = t
    return tokens


@lru_cache(maxsize=2)
def bpe(path: str, split: str) -> ByteBpe:
    """One a worker process."""
    return ByteBpe(path, split)


def _through(rows: DataFrame, column: str, out: str, call) -> DataFrame:
    """``rows`` with a binary column made from another, batch by batch; a column named ``out`` is replaced."""
    kept = [c for c in rows.columns if c != out]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{column}`").alias("x"))
    kind = packed.schema["row"].dataType.simpleString()

    def run(it):
        for b in portions(it, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(call(b.column(1).to_pylist()), type=pa.binary())], names=["row", "out"])

    return packed.mapInArrow(run, f"row {kind}, out binary").select("row.*", F.col("out").alias(out))


def encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, split: str | None = None) -> DataFrame:
    """``docs`` with the ids of every whole text, little-endian 32-bit integers in one binary; special tokens' strings are plain text.

    A null text counts as empty, an empty text has no ids. Nulls, repeated rows and other columns stay as they are; a column named
    ``out`` is replaced. An empty table: no rows. ``split`` is a pattern of the kind of the given one: its matches cover the text, look at most ``MARGIN``
    characters behind their end, and take a single space in front of what follows it.
    """
    path, split = path or ranks_path(), split or pattern()
    plain = docs.withColumn("_bpe_text", text_or_empty(docs, text))
    return _through(plain, "_bpe_text", out, lambda texts: bpe(path, split).encode(texts)).drop("_bpe_text")


def decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``rows`` with the bytes that the ids stand for; null ids: no bytes. Ids that the table does not have raise."""
    path = path or ranks_path()
    return _through(rows, ids, out, lambda many: [concatenated(np.frombuffer(x or b"", dtype="<u4"), tokens_of(path)) for x in many])


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and the bytes that they decode to. Null text: empty; every row has one row, null and repeated ids too."""
    back = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    n = (F.octet_length("ids") / 4).cast("long")
    return back.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
