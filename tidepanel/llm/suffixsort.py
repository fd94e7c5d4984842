"""External induced sorting of suffixes with their common prefixes.

The suffixes that begin a falling-rising turn of the text (leftmost S-type) are sorted by induction
over the substrings between turns, named, and sorted by the same procedure on the string of names,
down to a string whose names all differ or that fits in memory, where doubling sorts it. All other
suffixes follow from them in two scans.

A scan moves tuples (position, common prefix with the tuple before) through a priority queue over
(symbol, arrival). A batch leaves in order and the suffixes one to the left enter under their own
symbol; their common prefixes are one more than the minimum over the tuples in between. Common
prefixes of the turns come from those of the names. What the queues, the texts and the seeds need
beyond `memory` bytes each lies in temporary files of the task, gone when it ends.

Common prefixes are cut at depth, and suffixes that agree on as many symbols may stand in any order.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

MEMORY_BYTES = 4 << 20
#: bytes of memory that doubling takes for each name
_BASE_BYTES = 64
#: tuples handled at a time
CHUNK = 1 << 15
#: alphabets up to this size get a bucket for each symbol
FLAT = 1024
_LOG = np.r_[0, np.floor(np.log2(np.arange(1, CHUNK + 1)))].astype(np.int64)
_FALLING, _RISING, _NONE = 0, 1, 2


def space(n: int, dtype, memory: int) -> np.ndarray:
    """An array of n items, in a temporary file if it takes more than the memory given."""
    if n * np.dtype(dtype).itemsize <= memory or not n:
        return np.empty(n, dtype)
    return np.memmap(tempfile.TemporaryFile(), dtype, shape=(n,))


def chunks(n: int, size: int = 1 << 20) -> Iterator[slice]:
    for at in range(0, n, size):
        yield slice(at, min(n, at + size))


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal neighbours."""
    cuts = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()
    return zip([0, *cuts], [*cuts, len(keys)], strict=True)


def _stable(keys: np.ndarray) -> np.ndarray:
    """A stable order of unsigned integers below 2**32."""
    if keys.itemsize <= 2 or len(keys) < 256:
        return np.argsort(keys, kind="stable")
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    return order[np.argsort((keys >> 16).astype(np.uint16)[order], kind="stable")]


class BucketQueue:
    """First-in first-out tuples for each bucket; what exceeds `memory` bytes lies in a temporary file.

    With many buckets, pushes go to groups of them, and a group is dealt out when it is entered.
    """

    def __init__(self, buckets: int, memory: int, place: np.dtype, bucket_of: Callable[[np.ndarray], np.ndarray]):
        self.wide = 1 if buckets <= FLAT else math.isqrt(buckets)
        self.groups: list[list] = [[] for _ in range(-(-buckets // self.wide))]
        self.fine: dict[int, list] = {}
        self.entered, self.bucket_of = -1, bucket_of
        self.memory, self.held, self.file, self.place = memory, 0, None, np.dtype(place)
        self.spilled = 0

    def _add(self, parts: list, pos: np.ndarray, lcp: np.ndarray) -> None:
        parts.append((pos.copy(), lcp.copy()))
        self.held += pos.nbytes + lcp.nbytes

    def push(self, buckets: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Add tuples; buckets ascend."""
        groups = buckets if self.wide == 1 else buckets // self.wide
        for lo, hi in _runs(groups):
            group = int(groups[lo])
            if group == self.entered:
                self._deal(buckets[lo:hi], pos[lo:hi], lcp[lo:hi])
            else:
                self._add(self.groups[group], pos[lo:hi], lcp[lo:hi])
        if self.held > self.memory:
            self._spill()

    def append(self, bucket: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Add tuples to one bucket."""
        self.push(np.full(len(pos), bucket), pos, lcp) if len(pos) else None

    def _deal(self, buckets: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        for lo, hi in _runs(buckets):
            self._add(self.fine.setdefault(int(buckets[lo]), []), pos[lo:hi], lcp[lo:hi])

    def enter(self, bucket: int) -> None:
        """Make the bucket ready for take()."""
        group = bucket // self.wide
        if self.wide == 1 or group == self.entered:
            return
        parts, self.groups[group], self.entered, self.fine = self.groups[group], [], group, {}
        for part in parts:
            pos, lcp = self._load(part)
            buckets = self.bucket_of(pos)
            order = _stable(buckets)
            self._deal(buckets[order], pos[order], lcp[order])

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for parts in (*self.groups, *self.fine.values()):
            inside = [k for k, part in enumerate(parts) if isinstance(part[0], np.ndarray)]
            if not inside:
                continue
            at = self.file.seek(0, 2)
            pos, lcp = (np.concatenate([parts[k][i] for k in inside]) for i in (0, 1))
            self.file.write(pos.tobytes())
            self.file.write(lcp.tobytes())
            low, middle = at, at + pos.nbytes
            for k in inside:
                n = len(parts[k][0])
                parts[k] = (low, middle, n)
                low, middle = low + n * self.place.itemsize, middle + 2 * n
            self.spilled += pos.nbytes + lcp.nbytes
        self.held = 0

    def _load(self, part: tuple) -> tuple[np.ndarray, np.ndarray]:
        if len(part) == 2:
            self.held -= part[0].nbytes + part[1].nbytes
            return part
        low, middle, n = part
        self.file.seek(low)
        pos = np.frombuffer(self.file.read(n * self.place.itemsize), self.place)
        self.file.seek(middle)
        return pos, np.frombuffer(self.file.read(2 * n), np.int16)

    def _parts(self, bucket: int) -> list:
        return self.groups[bucket] if self.wide == 1 else self.fine.get(bucket, [])

    def has(self, bucket: int) -> bool:
        return bool(self._parts(bucket))

    def take(self, bucket: int, most: int = CHUNK, last: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The first parts (or the last ones) of the bucket in order of arrival, about `most` tuples; they leave the queue."""
        parts = self._parts(bucket)
        count = total = 0
        for part in reversed(parts) if last else parts:
            if total >= most:
                break
            total, count = total + (len(part[0]) if len(part) == 2 else part[2]), count + 1
        taken = parts[len(parts) - count :] if last else parts[:count]
        if last:
            del parts[len(parts) - count :]
        else:
            del parts[:count]
        loaded = [self._load(p) for p in taken]
        if len(loaded) == 1:
            return loaded[0]
        if not loaded:
            return np.zeros(0, self.place), np.zeros(0, np.int16)
        return np.concatenate([p for p, _ in loaded]), np.concatenate([c for _, c in loaded])


def _window_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low..high]) for every pair; at most CHUNK values."""
    level = _LOG[high - low + 1]
    n, deep = len(values), int(level.max(initial=0)) + 1
    table = np.empty((deep, n), values.dtype)
    table[0] = values
    for k in range(1, deep):
        half = 1 << (k - 1)
        np.minimum(table[k - 1, : n - 2 * half + 1], table[k - 1, half : n - half + 1], out=table[k, : n - 2 * half + 1])
    flat, base = table.ravel(), level * n
    return np.minimum(flat[base + low], flat[base + high - (1 << level) + 1])


class _Scan:
    """Pushes the left neighbours of one type of the tuples that pass, with their common prefixes.

    For each symbol: the number of the chunk that last pushed under it and the minimum in that chunk since.
    Minima of whole chunks stand in a stack of rising values, at most depth + 1 of them.
    """

    def __init__(self, text: Text, queue: BucketQueue, kind: int, depth: int, with_common: bool):
        self.text, self.queue, self.kind, self.depth, self.with_common = text, queue, kind, depth, with_common
        if with_common:
            self.last, self.tail = np.full(text.symbols, -1, np.int32), np.zeros(text.symbols, np.int16)
            self.turn = self.top = 0
            self.at, self.low = np.zeros(depth + 2, np.int64), np.zeros(depth + 2, np.int16)

    def run(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        for part in chunks(len(pos), CHUNK):
            self._chunk(pos[part], lcp[part])

    def _chunk(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        left = self.text.left[pos]
        index = np.flatnonzero((left & 3) == self.kind)
        if len(index):
            symbols = left[index] >> 2
            order = _stable(symbols)
            own, symbols = index[order], symbols[order]
            found = self._common(lcp, own, symbols) if self.with_common else np.zeros(len(own), np.int16)
            self.queue.push(self.text.range_of[symbols], pos[own] - 1, found)
        if self.with_common:
            least = lcp.min()
            self.top = int(np.searchsorted(self.low[: self.top], least))
            self.at[self.top], self.low[self.top] = self.turn, least
            self.top += 1
            self.turn += 1

    def _common(self, lcp: np.ndarray, own: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        head = np.empty(len(own), bool)
        head[0] = True
        np.not_equal(symbols[1:], symbols[:-1], out=head[1:])
        first, rest = np.flatnonzero(head), np.flatnonzero(~head)
        out = np.empty(len(own), np.int16)
        if len(rest):
            out[rest] = _window_minima(lcp, own[rest - 1] + 1, own[rest])
        names = symbols[first]
        before = self.last[names]
        least = np.minimum(self.tail[names], np.minimum.accumulate(lcp)[own[first]])
        if self.top:
            k = np.searchsorted(self.at[: self.top], before + 1)
            inside = k < self.top
            least[inside] = np.minimum(least[inside], self.low[k[inside]])
        least[before < 0] = -1  # nothing before it under this symbol
        out[first] = least
        since = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.int16(self.depth))
        self.tail[names] = since[own[np.append(first[1:], len(own)) - 1] + 1]
        self.last[names] = self.turn
        return np.minimum(out + 1, self.depth).astype(np.int16)


class Text:
    """A string of symbols, the last a 0 that stands nowhere else, with types and buckets of symbols.

    left[i] holds the symbol before place i and its type; symbols share a bucket if none of them
    neighbours another of it in the text, so that a bucket never feeds itself unless it is one symbol.
    """

    def __init__(self, values: np.ndarray, symbols: int, memory: int):
        n = self.n = len(values)
        self.values, self.symbols, self.memory = values, symbols, memory
        self.place = np.int32 if n < 1 << 31 else np.int64
        self.left = space(n + 1, np.uint16 if symbols < 1 << 14 else np.uint32, memory)
        self.left[0], self.left[n] = _NONE, _RISING
        following = True  # whether the suffix after the chunk is smaller than the one after it
        turns = []
        for part in reversed(list(chunks(n - 1))):
            own, after = values[part].astype(np.int64), values[part.start + 1 : part.stop + 1].astype(np.int64)
            at = np.arange(len(own))
            known = np.where(own != after, at, len(own))
            turn = np.minimum.accumulate(known[::-1])[::-1]
            rising = np.append(own < after, following)[turn]
            types = np.append(rising, following)
            turns.append(np.flatnonzero(types[1:] & ~types[:-1]) + part.start + 1)
            self.left[part.start + 1 : part.stop + 1] = (own << 2) | rising
            following = bool(rising[0])
        count = sum(map(len, turns))
        self.turns = space(count, self.place, memory)
        at = 0
        while turns:
            part = turns.pop()
            self.turns[at : at + len(part)] = part
            at += len(part)
        self._plan()

    def _plan(self) -> None:
        n, symbols = self.n, self.symbols
        if symbols <= FLAT:
            self.starts = np.arange(symbols + 1)
        else:
            below, alone, count = np.full(symbols, -1, np.int64), np.zeros(symbols, bool), np.zeros(symbols, np.int64)
            for part in chunks(n - 1):
                a, b = self.values[part], self.values[part.start + 1 : part.stop + 1]
                np.maximum.at(below, np.maximum(a, b), np.minimum(a, b).astype(np.int64))
                alone[a[a == b]] = True
                count += np.bincount(a, minlength=symbols)
            below[alone] = np.arange(symbols)[alone] - 1
            alone |= count > CHUNK
            alone[0] = True
            starts, start, size = [0], 0, 0
            for symbol, (low, single, weight) in enumerate(zip(below.tolist(), alone.tolist(), count.tolist(), strict=True)):
                if symbol and (low >= start or single or self_alone or size > CHUNK):
                    starts.append(symbol)
                    start, size = symbol, 0
                size += weight
                self_alone = single
            self.starts = np.array([*starts, symbols])
        self.single = (np.diff(self.starts) == 1).tolist()
        self.range_of = np.repeat(np.arange(len(self.starts) - 1, dtype=np.uint32), np.diff(self.starts))

    def bucket_of(self, pos: np.ndarray) -> np.ndarray:
        return self.range_of[self.values[pos]]

    def queue(self) -> BucketQueue:
        return BucketQueue(len(self.starts) - 1, self.memory, self.place, self.bucket_of)

    def rising(self, pos: np.ndarray) -> np.ndarray:
        return (self.left[pos + 1] & 3) == _RISING

    def run_length(self, pos: np.ndarray, depth: int) -> np.ndarray:
        """How often the symbol at pos repeats from there on, cut at depth."""
        out, active, symbol = np.ones(len(pos), np.int64), np.arange(len(pos)), self.values[pos]
        for off in range(1, depth):
            active = active[pos[active] + off < self.n]
            active = active[self.values[pos[active] + off] == symbol[active]]
            if not len(active):
                break
            out[active] += 1
        return out

    def seam(self, falling: np.ndarray, rising: np.ndarray, depth: int) -> np.ndarray:
        """Common prefixes of falling and rising suffixes of one symbol: the symbol's shorter run, as what follows differs."""
        return np.minimum(np.minimum(self.run_length(falling, depth), self.run_length(rising, depth)), depth)

    def extend(self, a: np.ndarray, b: np.ndarray, known: np.ndarray, most: np.ndarray | int) -> np.ndarray:
        """Common prefixes of the suffixes at a and b, of which `known` symbols agree, cut at `most`."""
        out = np.minimum(known, most).astype(np.int64)
        most = np.broadcast_to(most, out.shape)
        active = np.flatnonzero(out < most)
        while len(active):
            x, y = a[active] + out[active], b[active] + out[active]
            inside = np.maximum(x, y) < self.n
            active, x, y = active[inside], x[inside], y[inside]
            active = active[self.values[x] == self.values[y]]
            out[active] += 1
            active = active[out[active] < most[active]]
        return out


def _induce(text: Text, seeds: np.ndarray, seed_lcp: np.ndarray, depth: int, with_common: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From the sorted turns all suffixes, the largest first, with their common prefixes with the one after each."""
    buckets = len(text.single)
    bounds = np.zeros(buckets + 1, np.int64)
    for part in chunks(len(seeds)):
        bounds[1:] += np.bincount(text.bucket_of(seeds[part]), minlength=buckets)
    bounds = np.cumsum(bounds).tolist()
    queue, falling = text.queue(), text.queue()
    scan = _Scan(text, queue, _FALLING, depth, with_common)

    def joined(pos, lcp, mine, order_keys):
        """Tuples of several symbols in order, seams filled in; mine: those whose seam is with a tuple before."""
        order = _stable(order_keys)
        pos, lcp, mine, keys = pos[order], lcp[order], mine[order], order_keys[order]
        if with_common:
            met = np.flatnonzero(mine[1:] & ~mine[:-1] & (keys[1:] == keys[:-1])) + 1
            if len(met):
                lcp[met] = text.seam(pos[met - 1], pos[met], depth)
        return pos, lcp, mine

    for r in range(buckets):
        queue.enter(r)
        own, own_lcp = seeds[bounds[r] : bounds[r + 1]], seed_lcp[bounds[r] : bounds[r + 1]]
        if text.single[r]:
            end = None
            while queue.has(r):
                pos, lcp = queue.take(r)
                falling.append(r, pos, lcp)
                scan.run(pos, lcp)
                end = pos[-1:]
            if len(own):
                own_lcp = own_lcp.copy()
                own_lcp[0] = text.seam(end, own[:1], depth)[0] if end is not None and with_common else 0
                scan.run(own, own_lcp)
            continue
        pos, lcp = queue.take(r, text.n)
        if not len(pos) and not len(own):
            continue
        pos, lcp = np.concatenate([pos, own]), np.concatenate([lcp, own_lcp])
        mine = np.arange(len(pos)) >= len(pos) - len(own)
        pos, lcp, mine = joined(pos, lcp, mine, text.values[pos])
        falling.append(r, pos[~mine], lcp[~mine])
        scan.run(pos, lcp)

    #: from the largest down; a tuple's common prefix is with the one after it
    queue = text.queue()
    scan = _Scan(text, queue, _RISING, depth, with_common)
    for r in range(buckets - 1, -1, -1):
        queue.enter(r)
        falling.enter(r)
        if text.single[r]:
            end = None
            while queue.has(r):
                pos, lcp = queue.take(r)
                scan.run(pos, lcp)
                yield pos, lcp
                end = pos[-1:]
            if r == 0:  # the end of the text, which no neighbour brings in
                pos, lcp = np.array([text.n - 1], text.place), np.zeros(1, np.int16)
                scan.run(pos, lcp)
                yield pos, lcp
            joint = None
            while falling.has(r):
                pos, lcp = falling.take(r, last=True)
                if joint is None:
                    joint = text.seam(pos[-1:], end, depth).astype(np.int16) if end is not None and with_common else np.zeros(1, np.int16)
                pos, back = pos[::-1], np.concatenate([joint, lcp[:0:-1]])
                joint = lcp[:1]
                scan.run(pos, back)
                yield pos, back
            continue
        up, up_lcp = queue.take(r, text.n)
        down, down_lcp = falling.take(r, text.n)
        if not len(up) and not len(down):
            continue
        pos = np.concatenate([up, down[::-1]])
        lcp = np.concatenate([up_lcp, np.zeros(min(1, len(down)), np.int16), down_lcp[:0:-1]])
        pos, lcp, _ = joined(pos, lcp, np.arange(len(pos)) >= len(up), (text.symbols - text.values[pos].astype(np.int64)).astype(np.uint32))
        scan.run(pos, lcp)
        yield pos, lcp


def _names(text: Text, order: np.ndarray) -> tuple[np.ndarray, int]:
    """(names of the turns in text order, their number) by the sorted substrings from turn to turn."""
    turns, memory = text.turns, text.memory
    m = len(turns)
    #: turns are two places apart at least
    length, name = space(text.n // 2 + 1, text.place, memory), space(text.n // 2 + 1, np.uint32, memory)
    for part in chunks(m):
        ends = turns[part.start + 1 : part.stop + 1]
        length[turns[part.start : part.start + len(ends)] >> 1] = ends - turns[part.start : part.start + len(ends)] + 1
    length[turns[m - 1] >> 1] = 1
    name[order[0] >> 1] = last = 0
    for part in chunks(m - 1, 1 << 18):
        a, b = order[part], order[part.start + 1 : part.stop + 1]
        size, other = length[a >> 1], length[b >> 1]
        fresh = size != other
        even = np.flatnonzero(~fresh)
        fresh[even] = text.extend(a[even], b[even], np.zeros(len(even), np.int64), size[even].astype(np.int64)) < size[even]
        own = last + np.cumsum(fresh)
        name[b >> 1] = own
        last = int(own[-1])
    reduced = space(m, np.uint32, memory)
    for part in chunks(m):
        reduced[part] = name[turns[part] >> 1]
    return reduced, last + 1


def _by_doubling(names: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The result of sorted_suffixes() for a string in memory, by ranks of prefixes of 1, 2, 4 ... names."""
    n, reach = len(names), 1
    order = np.argsort(names, kind="stable")
    ordered, places, rank, ranks = names[order], np.arange(n), np.empty(n, np.int64), []
    while True:
        #: a rank is the first place of a group of equals; only groups of several are sorted again
        heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        sizes = np.diff(np.r_[heads, len(ordered)])
        rank[order[places]] = np.repeat(places[heads], sizes)
        ranks.append(rank.astype(np.int32))
        places = places[np.repeat(sizes > 1, sizes)]
        if reach >= depth or not len(places):
            break
        items = order[places]
        keys = rank[items] * (n + 1) + np.where(items + reach < n, rank[np.minimum(items + reach, n - 1)] + 1, 0)
        again = np.argsort(keys, kind="stable")
        order[places], ordered = items[again], keys[again]
        reach *= 2
    for part in reversed(list(chunks(n, 1 << 18))):
        a, b = order[part], order[np.minimum(np.arange(part.start + 1, part.stop + 1), n - 1)]
        common = np.zeros(len(a), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            x, y = a + common, b + common
            same = (np.maximum(x, y) < n) & (a != b)
            same[same] = ranks[k][x[same]] == ranks[k][y[same]]
            common[same] += 1 << k
        yield a[::-1], np.minimum(common, depth)[::-1].astype(np.int16)


def sorted_suffixes(values: np.ndarray, symbols: int, depth: int, memory: int = MEMORY_BYTES, base: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes from the largest down, in batches of (places, common prefixes with the suffix after each).

    values: integers below `symbols`, the last a 0 that stands nowhere else.
    base: bytes of memory for a string that need not recurse, 24 * memory where it is 0.
    """
    if len(values) == 1:
        yield np.zeros(1, np.int32), np.zeros(1, np.int16)
        return
    base = base or 24 * memory
    text = Text(values, symbols, memory)
    m = len(text.turns)
    seeds, seed_lcp = space(m, text.place, memory), space(m, np.int16, memory)
    seed_lcp[:] = 0
    if m == 1:
        seeds[:] = text.turns
    else:
        order = _sorted_by_symbol(text)
        at = m
        for pos, _ in _induce(text, order, seed_lcp, depth, False):
            pos = pos[((text.left[pos] & 3) == _FALLING) & text.rising(pos)]
            seeds[at - len(pos) : at] = pos[::-1]
            at -= len(pos)
        reduced, kinds = _names(text, seeds)
        known = np.zeros(m, np.int16)
        if kinds < m:
            at = m
            deeper = depth // 2 + 1
            found = _by_doubling(reduced, deeper) if m * _BASE_BYTES <= base else sorted_suffixes(reduced, kinds, deeper, memory, base)
            for pos, names in found:
                begin = text.turns[pos]
                alike = text.turns[np.minimum(pos + names, m - 1)] - begin
                seeds[at - len(pos) : at] = begin[::-1]
                known[at - len(pos) : at] = np.minimum(alike, depth)[::-1]
                at -= len(pos)
        for part in chunks(m - 1, 1 << 18):
            seed_lcp[part.start + 1 : part.stop + 1] = text.extend(seeds[part], seeds[part.start + 1 : part.stop + 1], known[part], depth)
    yield from _induce(text, seeds, seed_lcp, depth, True)


def _sorted_by_symbol(text: Text) -> np.ndarray:
    """The turns by their first symbol."""
    m = len(text.turns)
    count = np.zeros(text.symbols + 1, np.int64)
    for part in chunks(m):
        count[1:] += np.bincount(text.values[text.turns[part]], minlength=text.symbols)
    free, out = np.cumsum(count), space(m, text.place, text.memory)
    for part in chunks(m):
        symbols = text.values[text.turns[part]]
        order = _stable(symbols)
        symbols = symbols[order]
        first = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        sizes = np.diff(np.r_[first, len(symbols)])
        out[np.repeat(free[symbols[first]] - first, sizes) + np.arange(len(symbols))] = text.turns[part][order]
        free[symbols[first]] += sizes
    return out


def suffix_order(values: np.ndarray, symbols: int, depth: int, memory: int = MEMORY_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(order of all suffixes, common prefix of each with the one before) as arrays in memory."""
    found = list(sorted_suffixes(values, symbols, depth, memory))
    order = np.concatenate([p for p, _ in found])[::-1]
    after = np.concatenate([c for _, c in found])[::-1]
    return order, np.append(np.int16(0), after[:-1]).astype(np.int16)
