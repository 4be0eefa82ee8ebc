"""Suffix and common-prefix arrays by external induced sorting.

The two passes of induced sorting read and feed priority queues: a suffix that is
taken from the front hands its left neighbour to the bucket of that neighbour's
first symbol, together with the common prefix of the bucket's last two members.
Within a bucket the order of arrival is the order of the suffixes, so the queue
keyed by (symbol, arrival) is one first-in-first-out file a symbol: ``BucketQueue``
holds the newest tuples in memory and the others on disk.  Blocks of a bucket are
worked on with numpy.  In memory are the text, its types, one block and what the queue holds.

Substrings between leftmost S positions are sorted by the same passes, named, and
where names repeat their sequence is sorted in turn: by recursion, or by doubling
once it is ``in_memory`` long or less.  Common prefixes are counted up to ``cap``
(at most 255), and suffixes that share ``cap`` symbols may stand in any order.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

TUPLE = np.dtype([("at", "<i8"), ("lcp", "u1")])
BLOCK = 1 << 18
_NONE = np.zeros(0, np.int64)


class BucketQueue:
    """Tuples (suffix, common prefix with the one before), by symbol and then by arrival."""

    def __init__(self, folder: str, held: int):
        self.folder, self.held, self.n = folder, held, 0
        self.parts: dict[int, list[np.ndarray]] = {}
        self.files: dict[int, list] = {}
        os.makedirs(folder)

    def push(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        rows = np.empty(len(at), TUPLE)
        rows["at"], rows["lcp"] = at, lcp
        self.parts.setdefault(symbol, []).append(rows)
        self.n += len(rows)
        if self.n > self.held:
            for s, parts in self.parts.items():
                file = self.files.setdefault(s, [f"{self.folder}/{s}", 0, 0])
                with open(file[0], "ab") as f:
                    for rows in parts:
                        rows.tofile(f)
                        file[2] += len(rows)
            self.parts, self.n = {}, 0

    def pop(self, symbol: int) -> np.ndarray | None:
        """The oldest tuples of a bucket; None if it is empty now."""
        file = self.files.get(symbol)
        if file:  # what is on disk came before what is in memory
            rows = np.fromfile(file[0], TUPLE, BLOCK, offset=file[1] * TUPLE.itemsize)
            file[1] += len(rows)
            if file[1] == file[2]:
                os.unlink(file[0])
                del self.files[symbol]
            return rows
        parts = self.parts.pop(symbol, None)
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else np.concatenate(parts)
        self.n -= len(rows)
        return rows


def range_min(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Smallest value in each closed range, by a sparse table."""
    span = (end - start + 1).astype(np.int64)
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(start), values.dtype)
    table, width = values, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[start[own]], table[end[own] - width + 1])
        if len(table) > width:
            table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


class _Feed:
    """Gives the left neighbours of a stream of sorted suffixes to their buckets."""

    def __init__(self, queue: BucketQueue, text: np.ndarray, s_type: np.ndarray, kind: bool, symbols: int, cap: int, prefixes: bool):
        self.queue, self.text, self.s_type, self.kind, self.cap, self.prefixes = queue, text, s_type, kind, cap, prefixes
        #: Smallest common prefix in the stream since the bucket's last member came, and whether one came.
        self.least, self.begun = np.zeros(symbols, np.uint8), np.zeros(symbols, bool)

    def give(self, at: np.ndarray, lcp: np.ndarray) -> None:
        place = np.flatnonzero(at > 0)
        place = place[self.s_type[at[place] - 1] == self.kind]
        targets = self.text[at[place] - 1]
        order = np.argsort(targets, kind="stable")
        place, targets = place[order], targets[order]
        edges = np.flatnonzero(np.concatenate([[True], targets[1:] != targets[:-1]])) if len(place) else _NONE
        hit = targets[edges]
        if self.prefixes:
            start = np.zeros(len(place), np.int64)
            start[1:] = place[:-1] + 1
            start[edges] = 0
            low = range_min(lcp, start, place)
            low[edges] = np.minimum(low[edges], self.least[hit])
            value = np.minimum(low.astype(np.int64) + 1, self.cap).astype(np.uint8)
            value[edges[~self.begun[hit]]] = 0
            self.begun[hit] = True
            np.minimum(self.least, lcp.min(), out=self.least)
            last = place[np.concatenate([edges[1:], [len(place)]]).astype(np.int64) - 1] if len(place) else _NONE
            behind = np.minimum.accumulate(lcp[::-1])[::-1]
            self.least[hit] = np.where(last + 1 < len(lcp), behind[np.minimum(last + 1, len(lcp) - 1)], 255)
        else:
            value = np.zeros(len(place), np.uint8)
        ends = np.concatenate([edges[1:], [len(place)]]) if len(place) else _NONE
        for symbol, a, b in zip(hit.tolist(), edges.tolist(), ends.tolist()):
            self.queue.push(symbol, at[place[a:b]] - 1, value[a:b])


class _Sorted:
    """The sorted suffixes of one type, on disk by bucket."""

    def __init__(self, path: str):
        self.path, self.file, self.n = path, open(path, "wb"), 0
        self.buckets: dict[int, list[int]] = {}

    def add(self, symbol: int, rows: np.ndarray) -> None:
        own = self.buckets.setdefault(symbol, [self.n, self.n])
        rows.tofile(self.file)
        self.n += len(rows)
        own[1] = self.n

    def done(self) -> _Sorted:
        self.file.close()
        self.rows = np.memmap(self.path, TUPLE, "r") if self.n else np.zeros(0, TUPLE)
        return self

    def bucket(self, symbol: int) -> np.ndarray:
        a, b = self.buckets.get(symbol, (0, 0))
        return self.rows[a:b]


def _run(text: np.ndarray, at: int, cap: int) -> int:
    """Times that the symbol at a place repeats from there on."""
    part = text[at : at + cap + 1]
    other = np.flatnonzero(part != part[0])
    return min(cap, int(other[0]) if len(other) else len(part))


def _seam(text: np.ndarray, a: int, b: int, cap: int) -> int:
    """Common prefix of an L and an S suffix of the same bucket: the shorter of their first runs."""
    return min(_run(text, a, cap), _run(text, b, cap))


class _Level:
    def __init__(self, text: np.ndarray, symbols: int, folder: str, held: int, cap: int):
        self.text, self.symbols, self.folder, self.held, self.cap = text, symbols, folder, held, cap
        n = len(text)
        differs = np.flatnonzero(text[1:] != text[:-1])
        up = text[differs] < text[differs + 1]
        s_type = np.repeat(up, np.diff(np.concatenate([[-1], differs])))
        self.s_type = np.concatenate([s_type, np.ones(n - len(s_type), bool)])
        self.s_type[n - 1] = True  # the text ends with its one smallest symbol
        lms = np.zeros(n, bool)
        lms[1:] = self.s_type[1:] & ~self.s_type[:-1]
        self.lms = lms
        self.present = np.flatnonzero(np.bincount(text, minlength=symbols)).tolist()
        os.makedirs(folder)

    def induce(self, seeds: np.ndarray, lcp: np.ndarray, prefixes: bool, name: str) -> tuple[_Sorted, _Sorted]:
        """L and S suffixes in order (S: the largest of a bucket first), from the leftmost S suffixes in order."""
        text, cap = self.text, self.cap
        symbols = text[seeds]
        begin = np.searchsorted(symbols, np.arange(self.symbols + 1)) if self.symbols < len(seeds) + 2 else None
        queue = BucketQueue(f"{self.folder}/{name}-l", self.held)
        feed, large = _Feed(queue, text, self.s_type, False, self.symbols, cap, prefixes), _Sorted(f"{self.folder}/{name}.l")
        for c in self.present:
            last = None
            while (rows := queue.pop(c)) is not None:
                large.add(c, rows)
                feed.give(rows["at"], rows["lcp"])
                last = int(rows["at"][-1])
            a, b = (int(begin[c]), int(begin[c + 1])) if begin is not None else np.searchsorted(symbols, [c, c + 1]).tolist()
            if b > a:
                own = lcp[a:b].copy()
                own[0] = _seam(text, last, int(seeds[a]), cap) if last is not None and prefixes else 0
                for i in range(0, b - a, BLOCK):
                    feed.give(seeds[a + i : min(b, a + i + BLOCK)], own[i : i + BLOCK])
        large.done()
        queue = BucketQueue(f"{self.folder}/{name}-s", self.held)
        feed, small = _Feed(queue, text, self.s_type, True, self.symbols, cap, prefixes), _Sorted(f"{self.folder}/{name}.s")
        for c in reversed(self.present):
            last = None
            while (rows := queue.pop(c)) is not None:
                small.add(c, rows)
                feed.give(rows["at"], rows["lcp"])
                last = int(rows["at"][-1])
            rows = large.bucket(c)
            for end in range(len(rows), 0, -BLOCK):
                start = max(0, end - BLOCK)
                at = rows["at"][start:end][::-1]
                down = np.empty(end - start, np.uint8)
                down[1:] = rows["lcp"][start + 1 : end][::-1]
                if end < len(rows):
                    down[0] = rows["lcp"][end]
                else:
                    down[0] = _seam(text, int(at[0]), last, cap) if last is not None and prefixes else 0
                feed.give(np.ascontiguousarray(at), down)
        return large, small.done()

    def named(self, order: np.ndarray) -> tuple[np.ndarray, int]:
        """Names of the leftmost S substrings, in the order of the text; ``order`` has them sorted."""
        places = np.flatnonzero(self.lms)
        lengths = np.diff(np.concatenate([places, [len(self.text)]])) + 1
        lengths[-1] = 1
        of = np.searchsorted(places, order)
        own = lengths[of]
        a, b = order[:-1], order[1:]
        same = own[1:] == own[:-1]
        live, k, longest = np.flatnonzero(same), 0, own[1:]
        while len(live):
            equal = self.text[a[live] + k] == self.text[b[live] + k]
            same[live[~equal]] = False
            live, k = live[equal], k + 1
            live = live[longest[live] > k]
        name = np.concatenate([[0], np.cumsum(~same)])
        out = np.empty(len(places), np.int64)
        out[of] = name
        return out, int(name[-1]) + 1 if len(name) else 0


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a sequence in the order of their first ``depth`` names at least, by doubling."""
    rank, k, n = names + 1, 1, len(names)
    order = np.argsort(rank, kind="stable")
    while k < depth:
        key = rank << 32
        key[:-k] |= rank[k:]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[1], 1 + np.cumsum(ordered[1:] != ordered[:-1])])
        rank[order] = new
        if new[-1] == n:
            break
        k *= 2
    return order


def _packed(text: np.ndarray) -> np.ndarray:
    """Seven symbols of nine bits from each place on, the first in the highest bits."""
    out = np.zeros(len(text), np.uint64)
    for k in range(min(7, len(text))):
        out[: len(text) - k] |= text[k:].astype(np.uint64) << np.uint64(9 * (6 - k))
    return out


def _prefixes(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before; symbols are below 512."""
    out = np.zeros(len(order), np.uint8)
    words = _packed(text)
    a, b = order[:-1], order[1:]
    live, k, n = np.arange(len(a)), 0, len(text)
    while len(live) and k < cap:
        x, y = a[live] + k, b[live] + k
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        differ = words[x] ^ words[y]
        other = differ != 0
        lead = (62 - np.frexp(differ[other].astype(np.float64))[1] + 1) // 9
        # a float may round up to the next power of two: look again at the symbol before
        lead = np.where(lead < 0, 0, lead)
        xs, ys = x[other], y[other]
        wrong = (text[np.minimum(xs + lead, n - 1)] == text[np.minimum(ys + lead, n - 1)]) & (xs + lead < n) & (ys + lead < n)
        lead = lead + wrong
        out[1 + live[other]] = np.minimum(k + lead, cap)
        live, k = live[~other], k + 7
        out[1 + live] = min(k, cap)
    return out


def _order(level: _Level, in_memory: int, depth: int) -> np.ndarray:
    """The leftmost S suffixes of a level in order."""
    places = np.flatnonzero(level.lms)
    seeds = places[np.argsort(level.text[places], kind="stable")]
    _, small = level.induce(seeds, np.zeros(len(seeds), np.uint8), False, "names")
    parts = [np.array([len(level.text) - 1])]  # the end, which nothing induces
    for c in level.present:
        at = small.bucket(c)["at"][::-1]
        parts.append(at[level.lms[at]])
    order = np.concatenate(parts)
    names, distinct = level.named(order)
    if distinct == len(names):
        return order
    if len(names) <= in_memory:
        return places[_doubled(names, max(1, depth // 2))]
    below = _Level(names, distinct, f"{level.folder}/below", level.held, level.cap)
    at = _order(below, in_memory, max(1, depth // 2))
    # all suffixes of the sequence of names, not only its own leftmost S ones
    large, small = below.induce(at, np.zeros(len(at), np.uint8), False, "all")
    parts = [np.array([len(names) - 1])]
    for c in below.present:
        parts += [large.bucket(c)["at"], small.bucket(c)["at"][::-1]]
    shutil.rmtree(below.folder)
    return places[np.concatenate(parts)]


def suffix_array(text: np.ndarray, symbols: int, cap: int, folder: str | None = None, held: int = 1 << 20, in_memory: int = 1 << 23):
    """Blocks of (suffixes, common prefix of each with the one before) in the order of the suffixes.

    ``text`` has symbols below ``symbols`` (512 at most), ends with 0 and has no other 0.
    ``held`` tuples stay in memory in a queue; ``in_memory`` names are sorted at once.
    Working files lie in a new folder under ``folder`` (this machine's temporary folder: they
    live as long as the task) and are removed at the end.
    """
    root = tempfile.mkdtemp(prefix="induced-", dir=folder)
    try:
        if len(text) == 1:
            yield np.zeros(1, np.int64), np.zeros(1, np.uint8)
            return
        level = _Level(text, symbols, f"{root}/0", held, cap)
        seeds = _order(level, in_memory, cap)
        large, small = level.induce(seeds, _prefixes(text, seeds, cap), True, "suffixes")
        yield np.array([len(text) - 1]), np.zeros(1, np.uint8)
        for c in level.present:
            rows, last = large.bucket(c), None
            for i in range(0, len(rows), BLOCK):
                part = np.array(rows[i : i + BLOCK])
                yield part["at"], part["lcp"]
                last = int(part["at"][-1])
            rows = small.bucket(c)
            for end in range(len(rows), 0, -BLOCK):
                start = max(0, end - BLOCK)
                at = np.array(rows["at"][start:end][::-1])
                up = np.empty(end - start, np.uint8)
                up[1:] = rows["lcp"][start + 1 : end][::-1]
                up[0] = rows["lcp"][end] if end < len(rows) else _seam(text, last, int(at[0]), cap) if last is not None else 0
                yield at, up
    finally:
        shutil.rmtree(root, ignore_errors=True)
