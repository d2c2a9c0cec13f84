"""Suffix order with common-prefix values by external induced sorting.

The text is a list of integer symbols. Suffixes smaller (S) or larger (L) than their right
neighbour are told apart; those S suffixes with an L suffix on their left (the *seeds*) are
sorted first: their substrings up to the next seed are named in order, and if names repeat,
the string of names is sorted by the same procedure, recursively. From the sorted seeds all L
suffixes are induced in ascending order, and from these all S suffixes in descending order.

Both inductions run on a priority queue of tuples (symbol, turn, position, common prefix). A
suffix that is taken out puts its left neighbour in, with the symbol in front, the turn at which
it came, and the common prefix with the previous one of that symbol: one more than the
least common prefix met since. The queue keeps a bounded heap in memory and writes the rest
as sorted runs to a temporary file of the task (removed with it), from which they are merged.
"""

from __future__ import annotations

import heapq
import marshal
import tempfile
from bisect import bisect_left

#: Tuples in memory before a sorted run is written, and tuples of a run read at once.
IN_MEMORY, CHUNK = 500_000, 8_192


class DiskQueue:
    """A priority queue of tuples of integers, smallest first, whose memory is bounded."""

    def __init__(self, in_memory: int = IN_MEMORY):
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []  # (tuple, run): the smallest of each run on disk
        self.readers: list = []
        self.file = None
        self.in_memory = in_memory

    def __len__(self) -> int:
        return len(self.heap) + len(self.heads)

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.in_memory:
            self._spill()

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            item, run = self.heads[0]
            after = next(self.readers[run], None)
            if after is None:
                heapq.heappop(self.heads)
            else:
                heapq.heapreplace(self.heads, (after, run))
            return item
        return heapq.heappop(self.heap)

    def _spill(self) -> None:
        """Write all but the smallest half as a run; what comes out next stays in memory."""
        self.heap.sort()
        half = len(self.heap) // 2
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        places = []
        for at in range(half, len(self.heap), CHUNK):
            raw = marshal.dumps(self.heap[at : at + CHUNK])
            places.append((self.file.tell(), len(raw)))
            self.file.write(raw)
        del self.heap[half:]
        self.readers.append(self._read(places))
        run = len(self.readers) - 1
        heapq.heappush(self.heads, (next(self.readers[run]), run))

    def _read(self, places):
        for at, size in places:
            self.file.seek(at)
            yield from marshal.loads(self.file.read(size))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Least:
    """The least value since any earlier turn: a stack of falling minima."""

    def __init__(self):
        self.turns: list[int] = []
        self.values: list[int] = []

    def add(self, turn: int, value: int) -> None:
        while self.values and self.values[-1] >= value:
            self.values.pop()
            self.turns.pop()
        self.values.append(value)
        self.turns.append(turn)

    def since(self, turn: int) -> int:
        """Least of the values added after ``turn``."""
        return self.values[bisect_left(self.turns, turn + 1)]


def suffix_order(text: list[int], common, in_memory: int = IN_MEMORY) -> tuple[list[int], list[int]]:
    """The suffixes' starts in order, and each one's common prefix with the one before (0 for the first).

    ``common(i, j)`` gives the common prefix of two suffixes; it is asked only where no value can be
    carried: between neighbouring seeds, and where the L and the S suffixes of a symbol meet. The
    text's last symbol must occur only there.
    """
    n = len(text)
    if n < 2:
        return list(range(n)), [0] * n
    small = bytearray(n)  # 1: S
    for i in range(n - 2, -1, -1):
        small[i] = text[i] < text[i + 1] or (text[i] == text[i + 1] and small[i + 1])
    seeds = [i for i in range(1, n) if small[i] and not small[i - 1]]
    seeds = _sorted_seeds(text, seeds, in_memory)
    between = [0] + [common(a, b) for a, b in zip(seeds, seeds[1:], strict=False)]
    large = _induce(text, small, seeds, between, common, True, in_memory)
    full = _induce(text, small, None, large, common, False, in_memory)
    return full


def _sorted_seeds(text: list[int], seeds: list[int], in_memory: int) -> list[int]:
    if len(seeds) < 2:
        return seeds
    ends = seeds[1:] + [len(text) - 1]
    # Where one part goes on and an equal one ends, the latter is larger (its last suffix is S, the other's L).
    top = (max(text) + 1,)
    parts = [(*text[a : b + 1], *top) for a, b in zip(seeds, ends, strict=True)]
    name = {p: k for k, p in enumerate(sorted(set(parts)), 1)}
    if len(name) == len(parts):
        return [s for _, s in sorted(zip(parts, seeds, strict=True))]
    reduced = [name[p] for p in parts] + [0]
    order, _ = suffix_order(reduced, lambda i, j: 0, in_memory)
    return [seeds[k] for k in order if k < len(seeds)]


def _induce(text, small, seeds, given, common, ascending: bool, in_memory: int):
    """One induction. Ascending: ``given`` are the common prefixes of the sorted seeds; returns (L suffixes, prefixes).
    Descending: ``given`` is that pair; returns all suffixes in ascending order with their prefixes."""
    n = len(text)
    sign = 1 if ascending else -1
    queue = DiskQueue(in_memory)
    least = _Least()
    last_push: dict[int, int] = {}  # symbol -> turn of its latest entry
    turn = 0
    if ascending:
        first, shared = seeds, given
        queue.push((text[n - 1], -1, n - 1, 0))  # the last suffix is an L suffix without a cause
    else:
        first = given[0][::-1]
        shared = [0, *given[1][:0:-1]]  # prefix with the next larger L suffix
    out: list[int] = []
    prefix: list[int] = []
    at = 0
    before, before_kind, before_pos = None, None, None
    while at < len(first) or len(queue):
        # Induced suffixes of a symbol come before the given ones: L before S ascending, S before L descending.
        if len(queue):
            item = queue.pop()
            if at < len(first) and sign * text[first[at]] < item[0]:
                queue.push(item)
                item = None
        else:
            item = None
        if item is None:
            pos, value, kind = first[at], shared[at], 1
            at += 1
        else:
            pos, value, kind = item[2], item[3], 0
        symbol = text[pos]
        if symbol != before:
            value = 0
        elif kind != before_kind:
            value = common(before_pos, pos)
        least.add(turn, value)
        if kind == 0 or not ascending:
            out.append(pos)
            prefix.append(value)
        if pos and small[pos - 1] != ascending:
            c = text[pos - 1]
            seen = last_push.get(c)
            carried = 0 if seen is None else 1 + least.since(seen)
            queue.push((sign * c, turn, pos - 1, carried))
            last_push[c] = turn
        before, before_kind, before_pos = symbol, kind, pos
        turn += 1
    queue.close()
    if ascending:
        return out, prefix
    out.reverse()
    prefix.reverse()
    return out, [0, *prefix[:-1]]


def repeated_around(lefts: list[bytes], rights: list[bytes], window: int, in_memory: int = IN_MEMORY) -> list[list[int]]:
    """Repeats among texts left + core + right whose cores are equal and count as one symbol.

    For each text, the numbers d of symbols before the core at which a ``window``-symbol string
    starts that another of the texts has too, at the same d. The suffixes at the cores are the seeds,
    ordered by what follows; those d symbols before them are induced from those d - 1 before, level by
    level, by the queue's tuples (d, symbol, turn, text, common prefix). A suffix that shares nothing
    with its neighbours in the order is not carried on: nothing further left can repeat.
    """
    found: list[list[int]] = [[] for _ in lefts]
    order = sorted(range(len(rights)), key=rights.__getitem__)
    queue = DiskQueue(in_memory)
    before = b""
    for turn, k in enumerate(order):
        queue.push((0, 0, turn, k, 1 + _shared(before, rights[k], window)))
        before = rights[k]
    least, turn, last_push = _Least(), 0, {}
    held = None  # the suffix taken out last, put on once its right neighbour is known
    level = symbol = -1
    while True:
        item = queue.pop() if len(queue) else None
        value = 0
        if item is not None and item[0] == level and item[1] == symbol:
            value = item[4]
        if held is not None and (held[1] or value):
            k, _ = held
            d = level + 1
            if len(lefts[k]) >= d:
                c = lefts[k][-d]
                seen = last_push.get(c)
                queue.push((d, c, turn, k, 0 if seen is None else 1 + least.since(seen)))
                last_push[c] = turn
                if item is not None and queue.heap and item > queue.heap[0]:
                    queue.push(item)
                    item = queue.pop()
                    value = item[4] if item[0] == level and item[1] == symbol else 0
        if item is None:
            if not len(queue):
                break
            held = None
            continue
        if item[0] != level:
            last_push = {}
        if value >= window:
            if not found[held[0]] or found[held[0]][-1] != item[0]:
                found[held[0]].append(item[0])
            found[item[3]].append(item[0])
        level, symbol = item[0], item[1]
        turn += 1
        least.add(turn, value)
        held = (item[3], value)
    queue.close()
    return found


def _shared(a: bytes, b: bytes, most: int) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b), most) + 1
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low
