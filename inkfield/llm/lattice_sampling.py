"""Operator 7: SentencePiece encoding, decoding, and sampling of segmentations without replacement.

A text splits into units (line ends, and runs of spaces with the word after them); no piece of the
vocabulary spans a unit's border, so its lattice is the chain of its units' lattices. The plain encoding
of a unit is the library's. Sampling is from the whole lattice: a segmentation's probability is
the exponential of ``ALPHA`` times the sum of its piece scores over that sum for all
segmentations. Sums from the end of each unit turn this into a choice of the next edge at each
node, so that a text is drawn edge by edge, all its units at once.

Gumbel top-k: the largest perturbed log-probability of the whole space is drawn top-down; its
argument is one sampled segmentation. What remains splits into disjoint regions (the same up
to an edge, another edge there, anything after), whose maxima are Gumbels truncated at the
value just emitted. A queue of regions by these maxima is the perturbed A* frontier: each pop
emits the next segmentation, always a new one, in falling order. The value after the last one
wanted is the threshold from which each sample's inclusion probability follows. All draws
come from the row's key; how rows lie in batches changes nothing.

Work inside a task is by arrays: the distinct units of a batch are looked up once, new ones are walked through
a trie of all pieces together, and so are the paths of all texts of a batch.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_batch, portions, table, text_or_empty

SAMPLES = 2
#: Nats for each point of a piece's score (scores are minus the rank of the merge).
ALPHA = 0.001
#: Points lost for each byte of a character that is spelled out in bytes.
BYTE_COST = 32_000.0
SEED = 70_007
#: Units, and edges of their lattices, that a worker process remembers; when full, the cache keeps at most half, units seen in most batches. It never changes a result.
CACHE, CACHED_EDGES = 500_000, 7_000_000
#: Characters of new units that are learned together, and ids that are decoded together: bounds for memory.
LEARNED, DECODED = 1 << 16, 1 << 20
#: Walks under this number go edge by edge, more of them side by side.
FEW_WALKS = 4

SPACE = "▁"
_UNITS = re.compile(r" *[^ \n]+| +|\n")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def units(text: str) -> list[str]:
    """The text's units: line ends alone, words with their leading spaces; the first has the encoder's dummy space. An empty text has none."""
    if not text:
        return []
    if text[0] not in " \n" and text[-1] not in " \n" and "  " not in text and "\0" not in text and " \n" not in text:
        return [u for u in (" " + text.replace(" ", "\0 ").replace("\n", "\0\n\0")).split("\0") if u]
    return _UNITS.findall(" " + text)


def marked(text: str) -> str:
    """The text's units, each ended or parted by zero characters; the text has none itself."""
    if text and text[0] not in " \n" and text[-1] not in " \n" and "  " not in text and " \n" not in text:
        return " " + text.replace(" ", "\0 ").replace("\n", "\0\n\0")
    return "\0".join(units(text))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def runs(sizes: list[int], most: int) -> list[slice]:
    """Runs of neighbouring items whose sizes sum up to ``most`` and one item at most."""
    cuts = np.flatnonzero(np.diff(np.cumsum([0, *sizes])[:-1] // most)) + 1
    return [slice(a, z) for a, z in pairwise([0, *cuts.tolist(), len(sizes)])]


class Edges:
    """Edges by node: next node (-1: the end), content, log-probability at the node, and that of all others there."""

    def __init__(self, room: int = 4096):
        self.n_nodes = self.n_edges = 0
        self.first = np.zeros(room // 4 + 1, dtype=np.int64)  # of each node, and after the last one
        self.next, self.content = np.empty(room, dtype=np.int32), np.empty(room, dtype=np.int32)
        self.cum, self.logp, self.others = np.empty(room), np.empty(room), np.empty(room)

    def keep(self, roots: np.ndarray, sizes: np.ndarray) -> None:
        """Only these lattices, by their roots and numbers of nodes, in this order; their nodes are numbered anew."""
        nodes, first = ranges(roots, sizes), self.first[roots]
        count = self.first[roots + sizes] - first
        some = ranges(first, count)
        degree = self.first[nodes + 1] - self.first[nodes]
        after = self.next[some]
        after = np.where(after >= 0, after + np.repeat(np.cumsum(sizes) - sizes - roots, count), -1)
        self.n_nodes, self.n_edges = len(nodes), len(some)
        self.next[: len(some)] = after
        for a in (self.content, self.cum, self.logp, self.others):
            a[: len(some)] = a[some]
        self.first[1 : len(nodes) + 1] = np.cumsum(degree)

    def add(self, degree: np.ndarray, after: np.ndarray, content: np.ndarray, logp: np.ndarray) -> None:
        """More nodes, numbered on, by their numbers of edges (one at least), and these edges, node by node."""
        start = np.cumsum(degree) - degree
        p = np.exp(logp)
        left, right, cum = np.empty_like(p), np.empty_like(p), np.empty_like(p)
        with_edge, some = [], np.arange(len(degree))
        for j in range(int(degree.max())):
            some = some[degree[some] > j]
            with_edge.append(some)
        # Sums of the edges on both sides: differences from 1 would lose small ones.
        sums = np.zeros(len(degree))
        for j, some in enumerate(with_edge):
            e = start[some] + j
            left[e] = before = sums[some]
            sums[some] = cum[e] = before + p[e]
        total, sums = sums, np.zeros(len(degree))
        for j, some in reversed(list(enumerate(with_edge))):
            e = start[some] + j
            right[e] = behind = sums[some]
            sums[some] = behind + p[e]
        cum /= np.repeat(total, degree)
        cum[start + degree - 1] = np.inf
        a, b = self.n_edges, self.n_edges + len(p)
        self._room(b, self.n_nodes + len(degree))
        with np.errstate(divide="ignore"):
            self.others[a:b] = np.log(left + right)
        self.cum[a:b], self.logp[a:b], self.next[a:b], self.content[a:b] = cum, logp, after, content
        self.first[self.n_nodes : self.n_nodes + len(degree)] = a + start
        self.n_nodes, self.n_edges = self.n_nodes + len(degree), b
        self.first[self.n_nodes] = b

    def _room(self, edges: int, nodes: int) -> None:
        for name, need in (("first", nodes + 1), ("next", edges), ("content", edges), ("cum", edges), ("logp", edges), ("others", edges)):
            old = getattr(self, name)
            if len(old) < need:
                setattr(self, name, np.concatenate([old, np.empty(max(need, len(old) + len(old) // 2) - len(old), dtype=old.dtype)]))

    def walk(self, starts: np.ndarray, shift: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges drawn from each start to its end, start by start, and the number of each one's start.

        ``u[shift + node]`` is the random number that a walk uses at a node.
        """
        own, edges, paths = [], [], []
        which, node = np.arange(len(starts)), starts
        while len(which) > FEW_WALKS:
            x = u[shift[which] + node]
            e = self.first[node]
            on = np.flatnonzero(x >= self.cum[e])
            while len(on):
                e[on] += 1
                on = on[x[on] >= self.cum[e[on]]]
            own.append(which)
            edges.append(e)
            node = self.next[e]
            going = np.flatnonzero(node >= 0)
            which, node = which[going], node[going]
        for w, n in zip(which.tolist(), node.tolist(), strict=True):
            path, at = [], int(shift[w])
            while n >= 0:
                e, x = int(self.first[n]), u[at + n]
                while x >= self.cum[e]:
                    e += 1
                path.append(e)
                n = int(self.next[e])
            paths.append((w, path))
        size = np.zeros(len(starts), dtype=np.int64)
        for w in own:
            size[w] += 1
        for w, path in paths:
            size[w] += len(path)
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), dtype=np.int64)
        for level, (w, e) in enumerate(zip(own, edges, strict=True)):
            out[at[w] + level] = e
        for w, path in paths:
            out[at[w] + len(own) : at[w] + size[w]] = path
        return np.repeat(np.arange(len(starts)), size), out


class Pool:
    """Sequences of ids end to end, for gathering many of them at once."""

    def __init__(self):
        self.ids, self.start, self.size = np.zeros(1 << 16, dtype="<u2"), Numbers(), Numbers()
        self.used = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids)), dtype="<u2")])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start.add(self.used + np.cumsum(sizes) - sizes)
        self.size.add(sizes)
        self.used += len(ids)

    def take(self, which: np.ndarray) -> np.ndarray:
        return self.ids[ranges(self.start[which], self.size[which])]

    def keep(self, which: np.ndarray) -> None:
        ids, sizes = self.take(which), self.size[which]
        self.used = self.start.n = self.size.n = 0
        self.add(ids, sizes)


class Numbers:
    """A growing array of integers."""

    def __init__(self):
        self.n, self.all = 0, np.zeros(1024, dtype=np.int64)

    def add(self, more) -> None:
        if self.n + len(more) > len(self.all):
            self.all = np.concatenate([self.all, np.zeros(max(len(more), len(self.all)), dtype=np.int64)])
        self.all[self.n : self.n + len(more)] = more
        self.n += len(more)

    def __getitem__(self, which):
        return self.all[which]


class Lattices:
    """Lattices of units, with caches: for each known unit four times its row, and the number of the stop that ends it (0: none); tables by row."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.cost = {}
        for i, p in enumerate(self.pieces):
            s = self.model.get_score(i)
            if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)) and s > -1e8:
                self.cost[p] = (-s * ALPHA, (i,))
        self.cost.setdefault(SPACE, (BYTE_COST * ALPHA, (self.model.piece_to_id(SPACE),)))
        # Line ends never lie inside a piece; nor, as it happens, a full stop or comma after a letter, which then part lattices too.
        if any("\n" in p for p in self.cost):
            raise ValueError("a piece of this vocabulary spans a line end")
        self.stops = [c for c in ".," if c in self.cost and not any(c in p and re.search(rf"[^\W\d_]{re.escape(c)}", p) for p in self.cost)]
        self.byte = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.encode() for i, p in enumerate(self.pieces)]
        self.contents = [np.array([i], dtype="<u2").tobytes() for i in range(n)]
        self.spelled: dict[tuple[int, ...], int] = {}
        self.shown = pa.array([b.replace(SPACE.encode(), b" ") for b in self.raw], type=pa.large_binary())
        self._make_trie({p: hit[1][0] for p, hit in self.cost.items() if hit})
        self.points = np.zeros(n)
        for cost, (i,) in filter(None, self.cost.values()):
            self.points[i] = cost
        self.line_end = self.byte[10]
        self._clear()

    def _make_trie(self, pieces: dict[str, int]) -> None:
        """Tables of the trie of all pieces: its nodes are their beginnings, 0 is none, 1 the root; characters of longer pieces have classes."""
        letters = sorted({c for p in pieces if len(p) > 1 for c in p})
        self.classes = np.zeros(0x110000, dtype=np.int16)
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.alone = np.full(0x110000, -1, dtype=np.int32)  # the piece that a character is
        number = {"": 1}
        for p in pieces:
            if len(p) > 1:
                for j in range(1, len(p) + 1):
                    number.setdefault(p[:j], len(number) + 1)
            else:
                self.alone[ord(p)] = pieces[p]
        self.width = len(letters) + 1
        self.step = np.zeros((len(number) + 1) * self.width, dtype=np.uint16 if len(number) < 65_535 else np.int32)
        self.piece_at = np.full(len(number) + 1, -1, dtype=np.int32)
        for p, k in number.items():
            if p:
                self.step[number[p[:-1]] * self.width + int(self.classes[ord(p[-1])])] = k
                self.piece_at[k] = pieces.get(p, -1)

    def _clear(self):
        self.row: dict[str, int] = {}
        self.plain = Pool()
        self.roots, self.sizes, self.batches = Numbers(), Numbers(), Numbers()
        self.edges = Edges(CACHED_EDGES + CACHED_EDGES // 8)
        # The first rows, which are never forgotten: a line end, and the stops.
        alone = [self.line_end, *(self.cost[c][1][0] for c in self.stops)]
        self.fixed = np.arange(len(alone))
        self.row["\n"] = 0
        self.plain.add(np.array(alone), np.ones_like(self.fixed))
        self._add_rows(self.fixed, np.ones_like(self.fixed))
        self.edges.add(np.ones_like(self.fixed), np.full(len(alone), -1), np.array(alone), np.zeros(len(alone)))

    def _add_rows(self, roots: np.ndarray, sizes: np.ndarray) -> None:
        self.roots.add(roots)
        self.sizes.add(sizes)
        self.batches.add(np.zeros_like(sizes))

    def _forget(self) -> None:
        """Keep the rows seen in most batches, of those in two at least, and half of what may be remembered at most."""
        n = self.roots.n
        value = np.fromiter(self.row.values(), dtype=np.int64, count=len(self.row))
        roots, sizes, batches = self.roots[:n], self.sizes[:n], self.batches[:n]
        edges, names = self.edges.first[roots + sizes] - self.edges.first[roots], np.bincount(value >> 2, minlength=n)
        order = np.argsort(-batches, kind="stable")
        few = (2 * np.cumsum(edges[order]) <= CACHED_EDGES) & (2 * np.cumsum(names[order]) <= CACHE) & (batches[order] > 1)
        stay = np.zeros(n, dtype=bool)
        stay[order[few]] = stay[self.fixed] = True
        rows = np.flatnonzero(stay)
        self.edges.keep(roots[rows], sizes[rows])
        self.plain.keep(rows)
        sizes, batches = sizes[rows], batches[rows] // 2  # what is no longer seen goes in time
        self.roots.n = self.sizes.n = self.batches.n = 0
        self._add_rows(np.cumsum(sizes) - sizes, sizes)
        self.batches.all[: len(rows)] = batches
        value = np.where(stay[value >> 2], (np.cumsum(stay) - 1)[value >> 2] * 4 + (value & 3), -1)
        self.row = {u: v for u, v in zip(self.row, value.tolist(), strict=True) if v >= 0}

    def _content(self, ids: tuple[int, ...]) -> int:
        """The number of an edge's ids: a piece's own, further ones for characters in bytes."""
        if len(ids) == 1:
            return ids[0]
        if ids not in self.spelled:
            self.spelled[ids] = len(self.contents)
            self.contents.append(np.array(ids, dtype="<u2").tobytes())
        return self.spelled[ids]

    def rows(self, texts_units: list[list[str]]) -> list[np.ndarray]:
        """The rows of every text's units, new ones learned first."""
        flat = pa.array(list(chain.from_iterable(texts_units)), type=pa.string())
        return self.rows_of(flat, np.fromiter(map(len, texts_units), dtype=np.int64, count=len(texts_units)))

    def rows_of(self, flat: pa.Array, n_units: np.ndarray) -> list[np.ndarray]:
        """``flat`` are the units of texts, end to end."""
        if len(self.row) > CACHE or self.edges.n_edges > CACHED_EDGES:
            self._forget()
        coded = flat.dictionary_encode()
        value = self._know(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        self.batches.all[value >> 2] += 1
        value = value[coded.indices.to_numpy()]
        stop = value & 3
        at = np.cumsum(1 + (stop > 0))
        every = np.empty(int(at[-1]) if len(at) else 0, dtype=np.int64)
        every[at - 1] = stop  # a stop's row is its number
        every[at - 1 - (stop > 0)] = value >> 2
        return np.split(every, np.concatenate(([0], at))[np.cumsum(n_units)][:-1])

    def rows_of_texts(self, texts: list[str]) -> list[np.ndarray]:
        """The rows of every text's units."""
        if any("\0" in t for t in texts):
            return self.rows([units(t) for t in texts])
        parts = pc.split_pattern(pa.array(map(marked, texts), type=pa.large_string()), "\0")
        flat, cuts = parts.values, parts.offsets.to_numpy()
        some = pc.binary_length(flat).to_numpy() > 0
        n_units = np.diff(np.concatenate(([0], np.cumsum(some)))[cuts])
        return self.rows_of(flat.filter(pa.array(some)), n_units)

    def _know(self, distinct: list[str]) -> np.ndarray:
        """Values for units, new ones learned first."""
        known, stops = self.row, {c: k for k, c in enumerate(self.stops, 1)}
        value = np.fromiter(map(known.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        missing = np.flatnonzero(value < 0)
        new = [distinct[i] for i in missing.tolist()]
        ended = {u: u[:-1] for u in new if u[-1] in stops and u[-2:-1].isalpha()}
        whole = list(dict.fromkeys(w for u in new if (w := ended.get(u, u)) not in known))
        for run in runs(list(map(len, whole)), LEARNED):
            self._learn(whole[run])
        for u, w in ended.items():
            known[u] = known[w] + stops[u[-1]]
        value[missing] = np.fromiter(map(known.__getitem__, new), dtype=np.int64, count=len(new))
        return value

    def _learn(self, new: list[str]) -> None:
        """Plain encodings and lattices of new units."""
        if not new:
            return
        new = self._add_plain(new)
        # Characters of all units, each unit closed by a line end, which no piece has. A unit that is a line end comes alone.
        size = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
        joined = "\n".join(new).replace(" ", SPACE) + "\n"
        point = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        of = self.classes[point].astype(np.int64)
        close = np.cumsum(size + 1) - 1
        inner = np.ones(len(point), dtype=bool)
        inner[close] = False
        chars = np.flatnonzero(inner)
        node = np.cumsum(inner) - 1  # of each character
        # Pieces from each character on, by their length.
        first = self.alone[point[chars]]
        spelled = np.flatnonzero(first < 0)  # in bytes, where no piece is the one character
        cost = self.points[first]
        for k in spelled.tolist():
            raw = chr(point[chars[k]]).encode("utf-8", "surrogatepass")
            first[k] = self._content(tuple(self.byte[b] for b in raw))
            cost[k] = BYTE_COST * ALPHA * len(raw)
        found = [(chars, first, cost)]
        at, state = chars, self.step[self.width + of[chars]].astype(np.int64)
        while len(at):
            on = np.flatnonzero(state)
            at = at[on]
            state = self.step[state[on] * self.width + of[at + len(found)]].astype(np.int64)
            piece = self.piece_at[state]
            hit = np.flatnonzero(piece >= 0)
            found.append((at[hit], piece[hit], self.points[piece[hit]]))
        degree = np.bincount(np.concatenate([node[f] for f, _, _ in found]), minlength=len(chars))
        free = np.cumsum(degree) - degree
        m = int(degree.sum())
        start, end, piece, cost = (np.empty(m, dtype=t) for t in (np.int64, np.int64, np.int32, np.float64))
        for length in range(len(found), 0, -1):  # long ones, which are likely, first
            f, c, w = found[length - 1]
            e = free[node[f]]
            free[node[f]] += 1
            start[e], end[e], piece[e], cost[e] = f, f + length, c, w
        # Sums from each unit's end, all units at once, by the distance from the end.
        far = np.repeat(close, size + 1) - np.arange(len(point))
        by = far[start]
        order = np.argsort(by.astype(np.int16) if far.max() < 32_000 else by, kind="stable")
        tail = np.zeros(len(point))
        weight = np.empty(m)
        from_, to, paid = start[order], end[order], cost[order]
        cut = np.flatnonzero(np.concatenate(([True], np.diff(by[order]) != 0, [True])))
        head = np.flatnonzero(np.concatenate(([True], np.diff(from_) != 0)))
        heads = np.searchsorted(head, cut)
        for a, z, ha, hz in zip(cut[:-1].tolist(), cut[1:].tolist(), heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            w = tail[to[a:z]] - paid[a:z]
            weight[order[a:z]] = w
            tail[from_[head[ha:hz]]] = np.logaddexp.reduceat(w, head[ha:hz] - a)
        base = self.edges.n_nodes
        after = np.where(inner[end], base + node[end], -1)
        self.edges.add(degree, after, piece, weight - tail[start])
        self.row.update(zip(new, range(4 * self.roots.n, 4 * (self.roots.n + len(new)), 4), strict=True))
        self._add_rows(base + np.cumsum(size) - size, size)

    def _add_plain(self, new: list[str]) -> list[str]:
        """The units in the order in which the library's ids of them are added; it encodes them together with line ends between them, and puts a space before the first, as the units have one."""
        spaced, bare, space = [u for u in new if u[0] == " " and u != " "], [u for u in new if u[0] != " "], [u for u in new if u == " "]
        for own in filter(None, (spaced, bare)):
            text = "\n".join(own)
            ids = np.array(self.model.encode(text[1:] if own is spaced else "\n" + text), dtype="<u2")
            ends = np.concatenate((np.flatnonzero(ids == self.line_end), [len(ids)]))
            starts = np.concatenate(([0], ends[:-1] + 1))[-len(own) :]
            ids, ends = ids[starts[0] :], ends[-len(own) :]
            self.plain.add(ids[ids != self.line_end], ends - starts)
        if space:
            self.plain.add(np.array(self.cost[SPACE][1]), np.ones(1, dtype=np.int64))
        return spaced + bare + space

    def ids(self, paths: list[np.ndarray]) -> list[np.ndarray]:
        """The ids of each path's edges."""
        if not paths:
            return []
        c = self.edges.content[np.concatenate(paths)]
        cuts = np.cumsum([len(p) for p in paths])[:-1]
        if not len(c) or c.max() < len(self.pieces):
            return np.split(c.astype("<u2"), cuts)
        return [np.frombuffer(b"".join(map(self.contents.__getitem__, own.tolist())), dtype="<u2") for own in np.split(c, cuts)]

    def shown_bytes(self, ids: np.ndarray) -> bytes:
        """What ids of an encoding decode to, in UTF-8: pieces without the dummy space."""
        return next(self.each_shown([ids]))

    def each_shown(self, sequences: list[np.ndarray]) -> Iterator[bytes]:
        """``shown_bytes`` of every sequence."""
        for run in runs(list(map(len, sequences)), DECODED):
            _, offsets, raw = self.shown.take(pa.array(np.concatenate(sequences[run]).astype(np.int32))).buffers()
            at = np.frombuffer(offsets, dtype=np.int64)[np.cumsum([0, *map(len, sequences[run])])].tolist()
            raw = raw.to_pybytes() if raw else b""
            yield from (raw[a + raw.startswith(b" ", a, z) : z] for a, z in pairwise(at))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces, with bytes joined to characters and the dummy space taken away."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


_lattices: dict[str, Lattices] = {}


def lattices(path: str) -> Lattices:
    if path not in _lattices:
        _lattices[path] = Lattices(path)
    return _lattices[path]


class Chain:
    """The search for one text's best perturbed paths: a chain of lattices by their roots and numbers of nodes."""

    def __init__(self, edges: Edges, roots: np.ndarray, sizes: np.ndarray, k: int, rng: np.random.Generator):
        self.edges, self.roots, self.k, self.rng = edges, roots, k, rng
        self.shift = np.cumsum(sizes) - sizes - roots  # from a node to its own random number
        self.nodes = int(sizes.sum())
        self.queue: list = []
        self.found: list[tuple[float, float, np.ndarray]] = []
        self.pushed = 0
        # What the next path shares with one before, its first edge of its own, and where the walk goes on.
        self.kept = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0))
        self.at, self.closed = 0, frozenset()
        self.value = float(-np.log(-np.log(rng.random())))
        self.starts, self.units = roots, np.arange(len(roots))

    def next_start(self) -> bool:
        """Take the best region that is left, and its first edge; false if there is none or enough are found."""
        if len(self.found) >= self.k or not self.queue:
            return False
        value, _, own, base, at, closed = heapq.heappop(self.queue)
        every, p = self._open(base[at], closed)
        edge = every[min(int((self.rng.random() * p.sum() >= np.cumsum(p)).sum()), int(np.flatnonzero(p)[-1]))]
        unit, mid = int(own[at]), int(self.edges.next[edge])
        self.value, self.at, self.closed = -value, at, closed
        path = np.append(base[:at], edge)
        self.kept = np.append(own[:at], unit), path, self.edges.logp[path], self.edges.others[path[at:]]
        inside = mid >= 0
        self.starts = np.concatenate(([mid], self.roots[unit + 1 :])) if inside else self.roots[unit + 1 :]
        self.units = np.arange(unit if inside else unit + 1, len(self.roots))
        return True

    def add(self, which: np.ndarray, walked: np.ndarray, logp: np.ndarray, others: np.ndarray) -> None:
        """The path that was walked, or whose rest was, with its edges' logarithms; the regions beside it go into the queue."""
        own = self.units[which]
        if len(self.kept[0]):
            own, walked, logp, others = map(np.concatenate, zip(self.kept, (own, walked, logp, others), strict=True))
        self.found.append((self.value, float(logp.sum()), walked))
        for top, at, shut in self._regions(walked, logp, others):
            heapq.heappush(self.queue, (-top, self.pushed, own, walked, at, shut))
            self.pushed += 1

    def _regions(self, path: np.ndarray, own: np.ndarray, others: np.ndarray) -> list[tuple[float, int, frozenset]]:
        """The best regions beside ``path`` in the region that it came from; ``others`` from that region's edge on."""
        frm, closed, k = self.at, self.closed, self.k
        if frm >= len(path):
            return []
        mass = (np.cumsum(own) - own)[frm:] + others
        shut = closed | {int(path[frm])}
        if closed:
            left = self._open(path[frm], shut)[1].sum()
            mass[0] = own[:frm].sum() + math.log(left) if left > 0 else -np.inf
        top = mass - np.log(np.exp(np.minimum(mass - self.value, 700)) + self.rng.standard_exponential(len(mass)))
        # Only so many can still be taken, or be the threshold.
        few = k - len(self.found) + 1
        if few < 4:
            some = []
            for _ in range(min(few, len(top))):
                i = int(top.argmax())
                some.append((float(top[i]), i))
                top[i] = -np.inf
        else:
            best = np.argpartition(-top, few - 1)[:few] if few < len(top) else np.arange(len(top))
            some = [(top[i], int(i)) for i in best[np.argsort(-top[best], kind="stable")]]
        return [(float(v), frm + i, shut if i == 0 else frozenset({int(path[frm + i])})) for v, i in some if v > -np.inf]

    def _open(self, edge: int, closed: frozenset) -> tuple[np.ndarray, np.ndarray]:
        edges = self.edges
        node = np.searchsorted(edges.first[: edges.n_nodes + 1], edge, side="right") - 1
        every = [e for e in range(int(edges.first[node]), int(edges.first[node + 1])) if e not in closed]
        return every, np.exp(edges.logp[every])


def top_paths(edges: Edges, chains: list[Chain]) -> None:
    """Fill ``found`` of each chain with its distinct paths, by falling perturbed value; all chains take each step together."""
    going = chains
    while going:
        u = np.concatenate([c.rng.random(c.nodes) for c in going])
        begin = np.cumsum([0] + [c.nodes for c in going])
        shift = np.concatenate([c.shift[c.units] + b for c, b in zip(going, begin[:-1].tolist(), strict=True)])
        which, walked = edges.walk(np.concatenate([c.starts for c in going]), shift, u)
        logp, others = edges.logp[walked], edges.others[walked]
        first = np.cumsum([0] + [len(c.starts) for c in going])
        cuts = np.searchsorted(which, first)
        for c, f, a, z in zip(going, first[:-1].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            c.add(which[a:z] - f, walked[a:z], logp[a:z], others[a:z])
        del u, shift, which, walked, logp, others  # long texts' arrays
        going = [c for c in going if c.next_start()]


def threshold_of(chain_: Chain) -> float:
    """The perturbed value after the last path found (-inf: there are no more)."""
    return -chain_.queue[0][0] if chain_.queue else -math.inf


def gumbel_top_k(logp: np.ndarray, k: int, rng: np.random.Generator) -> tuple[list[tuple[float, float, np.ndarray]], float]:
    """k distinct draws from a product of choices: ``logp[u]`` are the log-probabilities of unit u's choices (-inf: no such choice)."""
    unit, choice = np.nonzero(np.isfinite(logp))
    edges = Edges()
    edges.add(np.bincount(unit, minlength=len(logp)), np.full(len(unit), -1), choice, logp[unit, choice])
    c = Chain(edges, np.arange(len(logp)), np.ones(len(logp), dtype=np.int64), k, rng)
    top_paths(edges, [c])
    return [(value, lp, edges.content[path]) for value, lp, path in c.found], threshold_of(c)


def inclusion(log_prob: float, threshold: float) -> float:
    """The probability that a segmentation's perturbed value exceeds the threshold; 1 if nothing was left out."""
    return 1.0 if threshold == -math.inf else float(-np.expm1(-np.exp(min(log_prob - threshold, 700.0))))


_OUT = "doc_id long, draw int, n_tokens long, ids_crc32 long, log_prob double, perturbed double, inclusion double, decoded_crc32 long, round_trip boolean"
_OUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("draw", pa.int32()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("decoded_crc32", pa.int64()), ("round_trip", pa.bool_())])
#: With ids, for callers that want the sequences themselves.
_IDS_OUT = _OUT + ", ids array<int>"
_IDS_SCHEMA = _OUT_SCHEMA.append(pa.field("ids", pa.list_(pa.int32())))


def segmentations(lat: Lattices, keys: list[int | None], rows: list[np.ndarray], k: int = SAMPLES) -> list[list[tuple]]:
    """For each text (draw, ids, log-probability, perturbed value, inclusion): draw 0 is the plain encoding, then the samples."""
    chains = []
    for key, own in zip(keys, rows, strict=True):
        rng = np.random.Generator(np.random.PCG64([SEED, (key or 0) & (2**64 - 1)]))
        chains.append(Chain(lat.edges, lat.roots[own], lat.sizes[own], k, rng))
    top_paths(lat.edges, [c for c in chains if len(c.roots)])
    out, ids = [], iter(lat.ids([path for c in chains for _, _, path in c.found]))
    plains = np.split(lat.plain.take(np.concatenate(rows)), np.cumsum([int(lat.plain.size[own].sum()) for own in rows])[:-1]) if rows else []
    for c, plain in zip(chains, plains, strict=True):
        if len(c.roots):
            least = threshold_of(c)
            out.append([(0, plain, None, None, None), *((i, next(ids), logp, value, inclusion(logp, least)) for i, (value, logp, _) in enumerate(c.found, 1))])
        else:
            out.append([(0, plain, None, None, None), (1, plain, 0.0, c.value, 1.0)])
    return out


def sample_segmentations(docs: DataFrame, path: str | None = None, k: int = SAMPLES, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row: draw 0 (the plain encoding) and up to ``k`` distinct sampled segmentations, draws 1, 2, ...

    Null text: as empty, which has one segmentation (no tokens). A text with fewer than ``k``
    segmentations has that many draws, each with inclusion 1. Rows with the same id and text
    are drawn alike. Empty table: no rows. The ids of every draw are decoded: ``decoded_crc32`` is of
    the decoded text in UTF-8, ``round_trip`` whether it is the text (a "▁" in it decodes as a space).
    """
    path = path or model_path()
    schema = _IDS_SCHEMA if with_ids else _OUT_SCHEMA

    def run(it):
        lat = lattices(path)
        for b in portions(it, 1):
            keys, whole = b.column(0).to_pylist(), b.column(1).to_pylist()
            found = segmentations(lat, keys, lat.rows_of_texts(whole), k)
            shown = lat.each_shown([ids for own in found for _, ids, *_ in own])
            out: dict[str, list] = {n: [] for n in schema.names}
            for key, text, own in zip(keys, whole, found, strict=True):
                raw = text.encode()
                for draw, ids, logp, value, incl in own:
                    decoded = next(shown)
                    row = (key, draw, len(ids), zlib.crc32(ids.astype("<u4")), logp, value, incl, zlib.crc32(decoded), decoded == raw) + ((ids.astype(np.int32),) if with_ids else ())
                    for name, x in zip(schema.names, row, strict=True):
                        out[name].append(x)
            yield as_batch(out, schema)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(docs, text_column).alias("t")).mapInArrow(run, _IDS_OUT if with_ids else _OUT)


def decode_ids(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Add ``decoded`` to rows that have ``ids``; null ids give null."""
    path = path or model_path()
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])
    at = rows.columns.index("ids")

    def run(it):
        lat = lattices(path)
        for b in it:
            text = pa.array([None if i is None else lat.decode(i) for i in b.column(at).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text], names=[*b.schema.names, "decoded"])

    return rows.mapInArrow(run, schema)


def op7_lattice_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain encoding and two sampled segmentations of every whole text, with what each decodes to."""
    return sample_segmentations(table(spark, sf_dir, "documents"))
