"""External induced sorting of suffixes with their common-prefix values.

Buckets are queues of (suffix, common prefix with the one before) tuples, taken in the order of their first byte, which
makes them one priority queue; whatever exceeds a memory budget, queues and arrays alike, is in unlinked files. All of
a block is induced at once: its predecessors are dealt stably to their buckets, and the common prefix of two that meet
there is one more than the least value scanned between them (a table of range minima).

One pass over unsorted leftmost S-suffixes sorts their substrings; the names they get make a shorter string, which is
sorted in the same way, down to one whose names are all different; a second pass carries its order to all suffixes. On
the text itself the second pass carries common prefixes too. Everything is read and written by blocks: besides the
budget, memory holds a few blocks, and of the shorter strings the suffixes of one range of names.
"""

from __future__ import annotations

import tempfile
from collections import deque

import numpy as np

BATCH = 1 << 17
BUDGET = 16 << 20
#: Bytes of spilled blocks that share a file.
SEGMENT = 4 << 20
#: Ranges of names that a queue of the shorter strings has about, and suffixes that a range of several names has at least.
RANGES, RANGE = 256, 1 << 14


class _Segment:
    """A part of the spilled blocks; its file goes with it, once all its blocks are read."""

    def __init__(self):
        self.file, self.size = tempfile.TemporaryFile(), 0


class Spill:
    """Blocks and arrays, in memory up to a budget, beyond it in files that are gone when nothing reads them any more."""

    def __init__(self, budget: int = BUDGET):
        self.left, self.segment, self.spilled = budget, None, 0

    def array(self, n: int, kind) -> np.ndarray:
        """An array of zeros. Those beyond the budget are mapped from a file of their own."""
        size = n * np.dtype(kind).itemsize
        if size <= self.left:
            self.left -= size
            return np.zeros(n, kind)
        self.spilled += size
        with tempfile.TemporaryFile() as f:
            return np.asarray(np.memmap(f, kind, "w+", shape=(n,)))

    def done(self, *arrays: np.ndarray) -> None:
        """Arrays that no one needs any more give their memory back to the budget."""
        self.left += sum(a.nbytes for a in arrays if a.base is None)  # mapped ones are views

    def put(self, *arrays):
        size = sum(a.nbytes for a in arrays)
        if size <= self.left:
            self.left -= size
            return arrays
        if self.segment is None or self.segment.size > SEGMENT:
            self.segment = _Segment()
        at, s = self.segment.size, self.segment
        s.file.seek(at)
        for a in arrays:
            s.file.write(np.ascontiguousarray(a).data)
        s.size += size
        self.spilled += size
        return s, at, [(a.dtype, len(a)) for a in arrays]

    def get(self, held):
        if isinstance(held[0], np.ndarray):
            self.left += sum(a.nbytes for a in held)
            return held
        s, at, kinds = held
        s.file.seek(at)
        return tuple(np.frombuffer(s.file.read(k.itemsize * n), k) for k, n in kinds)


def _blocks(n: int) -> list[tuple[int, int]]:
    return [(i, min(i + BATCH, n)) for i in range(0, n, BATCH)]


def _bounds(values: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of equal neighbours."""
    if not len(values):
        return []
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(cuts, cuts[1:]))


def _minima(values: np.ndarray) -> list[np.ndarray]:
    table, width = [values], 1
    while 2 * width <= len(values):
        table.append(np.minimum(table[-1][:-width], table[-1][width:]))
        width *= 2
    return table


def _least(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of values[lo:hi], none empty."""
    k = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.empty(len(lo), table[0].dtype)
    for level in np.unique(k):
        m = k == level
        t = table[level]
        out[m] = np.minimum(t[lo[m]], t[hi[m] - (1 << level)])
    return out


class _Pass:
    """Predecessors of scanned suffixes, by bucket. wanted: which suffixes this pass induces."""

    def __init__(self, text, wanted, cap, spill, prefixes):
        self.text, self.wanted, self.cap, self.spill, self.prefixes = text, wanted, cap, spill, prefixes
        self.queues = [deque() for _ in range(256)]
        self.least, self.seen = np.full(256, cap, np.uint16), np.zeros(256, bool)

    def scan(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        for i in range(0, len(pos), BATCH):
            self._scan(pos[i : i + BATCH], lcp[i : i + BATCH])

    def _scan(self, pos, lcp):
        q = pos - 1
        at = np.flatnonzero((q >= 0) & self.wanted(np.maximum(q, 0)))
        c = self.text[q[at]]
        order = np.argsort(c, kind="stable")
        at, c = at[order], c[order]
        heads = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
        values = np.zeros(len(at), np.uint16)
        if self.prefixes:
            if len(at):
                table = _minima(lcp)
                head = np.zeros(len(at), bool)
                head[heads] = True
                rest = np.flatnonzero(~head)
                if len(rest):
                    values[rest] = _least(table, at[rest - 1] + 1, at[rest] + 1)
                values[heads] = np.minimum(self.least[c[heads]], np.minimum.accumulate(lcp)[at[heads]])
                values = np.minimum(values, self.cap - 1) + np.uint16(1)
                values[heads[~self.seen[c[heads]]]] = 0
            self.least = np.minimum(self.least, lcp.min())
            if len(at):
                tails = np.concatenate([heads[1:], [len(at)]]) - 1
                after = np.concatenate([np.minimum.accumulate(lcp[::-1])[::-1], [self.cap]]).astype(np.uint16)
                self.least[c[tails]] = after[at[tails] + 1]
                self.seen[c[heads]] = True
        found = q[at]
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(at)]):
            self.queues[c[a]].append(self.spill.put(found[a:b], values[a:b]))


def _drain(queue: deque, spill: Spill) -> tuple[np.ndarray, ...]:
    """The next blocks of a queue, as one of about BATCH tuples."""
    parts, n = [], 0
    while queue and n < BATCH:
        parts.append(spill.get(queue.popleft()))
        n += len(parts[-1][0])
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts))


def _passes(text, kinds, runs, seeds, cap, spill, prefixes, visit):
    """Both passes. seeds: per first byte a queue of (leftmost S-suffixes, common prefixes), in order if prefixes.

    visit is given all suffixes from the largest down, by blocks; with prefixes, with what each shares with the next.
    """
    up, down = _Pass(text, lambda q: ~kinds[q], cap, spill, prefixes), _Pass(text, lambda q: kinds[q], cap, spill, prefixes)
    larger = [[] for _ in range(256)]  # L-suffixes of each bucket, in order
    ends = np.full(256, -1, np.int64)
    for c in range(256):
        queue = up.queues[c]
        while queue:
            pos, lcp = _drain(queue, spill)
            up.scan(pos, lcp)
            larger[c].append(spill.put(pos, lcp))
            ends[c] = pos[-1]
        first = True
        while seeds[c]:
            pos, lcp = _drain(seeds[c], spill)
            if first:
                lcp = lcp.copy()
                lcp[0] = min(runs[ends[c]], runs[pos[0]], cap) if ends[c] >= 0 else 0
                first = False
            up.scan(pos, lcp)
    for c in range(255, -1, -1):
        queue, last = down.queues[c], -1
        while queue:
            pos, lcp = _drain(queue, spill)
            visit(pos, lcp)
            down.scan(pos, lcp)
            last = pos[-1]
        carried = min(runs[last], runs[ends[c]], cap) if last >= 0 and ends[c] >= 0 else 0
        for held in reversed(larger[c]):
            pos, lcp = spill.get(held)
            turned = np.concatenate([[carried], lcp[:0:-1]]).astype(np.uint16)
            carried = lcp[0]
            visit(pos[::-1], turned)
            down.scan(pos[::-1], turned)


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on."""
    return np.lib.stride_tricks.as_strided(np.asarray(text).view(np.uint8)[:8].view(np.uint64), (len(text) - 7,), (1,))


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes, up to cap, of suffixes of a text that is padded by cap + 8 zeros."""
    words, out, live = _words(text), np.full(len(a), cap, np.int64), np.arange(len(a))
    for k in range(0, cap, 8):
        x = words[a[live] + k] ^ words[b[live] + k]
        differ = x != 0
        if differ.any():
            low = x[differ] & (~x[differ] + np.uint64(1))
            out[live[differ]] = np.minimum(k + (np.frexp(low.astype(np.float64))[1] - 1) // 8, cap)
            live = live[~differ]
        if not len(live):
            break
    return out


def _alike(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Are the strings of these sizes equal? The text is padded by eight zeros."""
    words, equal, live = _words(text), np.ones(len(a), bool), np.arange(len(a))
    for k in range(0, int(size.max()), 8):
        live = live[size[live] > k]
        x = (words[a[live] + k] ^ words[b[live] + k]) << (8 * (8 - np.minimum(size[live] - k, 8))).astype(np.uint64)
        equal[live[x != 0]] = False
        live = live[x == 0]
    return equal


def _classify(s: np.ndarray, spill: Spill, kind, lengths: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """S-suffixes, lengths of the runs of equal values from each place on (if wanted), and leftmost S-suffixes."""
    n = len(s)
    kinds, runs = spill.array(n, bool), spill.array(n, kind) if lengths else None
    after, is_s, length = None, True, 0  # of what follows the block
    for a, b in reversed(_blocks(n)):
        x = np.asarray(s[a:b])
        ends = np.concatenate([np.flatnonzero(x[1:] != x[:-1]), [len(x) - 1]])
        sizes = np.diff(np.concatenate([[-1], ends]))
        beyond = np.concatenate([x[ends[:-1] + 1], [x[-1] if after is None else after]])
        smaller = x[ends] < beyond
        run = ends - np.concatenate([[-1], ends[:-1]])
        add = np.zeros(len(ends), np.int64)
        if after is None:
            smaller[-1] = True
        elif after == x[-1]:
            smaller[-1], add[-1] = is_s, length
        kinds[a:b] = np.repeat(smaller, sizes)
        if lengths:
            runs[a:b] = np.repeat(ends + add, sizes) - np.arange(len(x)) + 1
        after, is_s, length = x[0], bool(smaller[0]), int(run[0] + add[0])
    count = sum(int((kinds[max(a, 1) : b] & ~kinds[max(a, 1) - 1 : b - 1]).sum()) for a, b in _blocks(n))
    lms, at = spill.array(count, kind), 0
    for a, b in _blocks(n):
        a = max(a, 1)
        found = np.flatnonzero(kinds[a:b] & ~kinds[a - 1 : b - 1]) + a
        lms[at : at + len(found)] = found
        at += len(found)
    return kinds, runs, lms


def _levels(pos: np.ndarray, back: np.ndarray):
    """pos and the rest of their runs of equal names, of which `back` lie before each: first these, then what is one before them, and so on, by blocks."""
    while len(pos):
        deep = max(1, BATCH // len(pos))
        times = np.minimum(back, deep - 1) + 1
        level = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        yield (np.repeat(pos, times) - level)[np.argsort(level, kind="stable")]
        more = back >= deep
        pos, back = pos[more] - deep, back[more] - deep


def _sweep(s, ranges, alone, wanted, back, feed, spill, visit):
    """Induces by ranges of names, which ascend in s. feed: per range, blocks of suffixes that follow the induced ones of their name.

    visit is given the range, its suffixes in order, by blocks, and which of them were induced. A range of one name is a
    queue; one of several is in memory, where suffixes induced from within it join until there are no more. A run of
    equal names (back: how many lie before a place) is induced at once, as its suffixes follow each other by levels.
    """
    queues = [deque() for _ in alone]

    def before(pos):
        """Wanted predecessors of another name, and whose they are."""
        at = np.flatnonzero((pos > 0) & (back[pos] == 0))
        at = at[wanted(pos[at] - 1)]
        return pos[at] - 1, at

    def scan(pos, least):
        for a, b in _blocks(len(pos)):
            q, _ = before(pos[a:b])
            r = ranges(s(q))
            q, r = q[r >= least], r[r >= least]
            order = np.argsort(r, kind="stable")
            q, r = q[order], r[order]
            for i, j in _bounds(r):
                queues[r[i]].append(spill.put(q[i:j]))

    for r, single in enumerate(alone):
        if single:
            now = queues[r]
            while now:
                pos, later = _drain(now, spill)[0], deque()
                if not now:
                    for part in _levels(pos, back[pos]):
                        visit(r, part, np.ones(len(part), bool))
                        scan(part, r + 1)
                    break
                while True:  # more than a block: a level at a time
                    visit(r, pos, np.ones(len(pos), bool))
                    scan(pos, r + 1)
                    if (back[pos] > 0).any():
                        later.append(spill.put(pos[back[pos] > 0] - 1))
                    if not now:
                        break
                    pos = _drain(now, spill)[0]
                now = later
            while feed[r]:
                pos = _drain(feed[r], spill)[0]
                visit(r, pos, np.zeros(len(pos), bool))
                scan(pos, r + 1)
            continue
        parts = [[spill.get(q.popleft())[0] for _ in range(len(q))] for q in (queues[r], feed[r])]
        if not parts[0] and not parts[1]:
            continue
        first = np.concatenate(parts[0] + parts[1])
        n = len(first)
        fed = np.arange(n) >= sum(map(len, parts[0]))

        def whole(pos, came, source, fed):
            """With the rest of their runs: suffixes, levels, arrivals, sources, whether fed."""
            times = np.where(fed, 1, back[pos] + 1)
            level = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            return [np.repeat(pos, times) - level, level, *(np.repeat(x, times) for x in (came, source, fed))]

        held = whole(first, np.arange(n), np.full(n, -1), fed)
        new = np.arange(len(held[0]))
        while True:
            pos, level, came, source, fed = held
            name = s(pos).astype(np.int64)
            order = np.lexsort((came, (2 * (name - name.min()) + fed) * (int(level.max()) + 1) + level))
            q, at = before(pos[new])
            at = at[ranges(s(q)) == r]
            if not len(at):
                break
            rank = np.empty(len(pos), np.int64)
            rank[order] = np.arange(len(pos))
            at = new[at]
            more = whole(pos[at] - 1, np.zeros(len(at), np.int64), at, np.zeros(len(at), bool))
            new = np.arange(len(pos), len(pos) + len(more[0]))
            held = [np.concatenate(x) for x in zip(held, more)]
            within = held[3] >= 0  # after what came from lower ranges, in the order of what induced them
            held[2][within] = n + rank[held[3][within]]
        visit(r, pos[order], ~fed[order])
        scan(pos[order], r + 1)


def _both(s, k, ranges, alone, kinds, back, feed, spill, visit):
    """Both sweeps over a string of names below k. visit is given all suffixes but the closing one from the largest down, by blocks."""
    larger = [[] for _ in alone]
    _sweep(lambda p: s[p], lambda c: ranges[c], alone, lambda q: ~kinds[q], back, feed, spill, lambda r, pos, induced: larger[r].append(spill.put(pos[induced])) if induced.any() else None)
    turned = [deque() for _ in alone]
    last = len(alone) - 1
    for r, blocks in enumerate(larger):
        while blocks:
            turned[last - r].append(spill.put(spill.get(blocks.pop())[0][::-1].copy()))
    _sweep(lambda p: k - 1 - s[p], lambda c: last - ranges[k - 1 - c], alone[::-1], lambda q: kinds[q], back, turned, spill, lambda r, pos, induced: visit(pos))


def _named(place: np.ndarray, lms: np.ndarray, n: int, same, spill: Spill, kind) -> tuple[np.ndarray, int]:
    """The shorter string: a name per leftmost S-substring, in the text's order, and the number of names. place: their sorted order."""
    names, name, before = spill.array(len(lms), kind), -1, None
    for a, b in _blocks(len(place)):
        pos = place[a:b]
        j = np.searchsorted(lms, pos)
        size = np.concatenate([lms, [n - 1]])[j + 1] - pos + 1 if len(lms) < BATCH else np.where(j + 1 < len(lms), lms[np.minimum(j + 1, len(lms) - 1)], n - 1) - pos + 1
        prior = (np.concatenate([[-1], pos[:-1]]), np.concatenate([[0], size[:-1]])) if before is None else (np.concatenate([[before[0]], pos[:-1]]), np.concatenate([[before[1]], size[:-1]]))
        fresh = np.ones(len(pos), bool)
        alike = np.flatnonzero((size == prior[1]) & (prior[0] >= 0))
        if len(alike):
            fresh[alike[same(pos[alike], prior[0][alike], size[alike])]] = False
        found = name + np.cumsum(fresh)
        names[j] = found
        name, before = int(found[-1]), (pos[-1], size[-1])
    return names, name + 1


def _sorted_names(s: np.ndarray, k: int, spill: Spill, kind) -> np.ndarray:
    """Order of all suffixes of a string of names below k that ends with its only 0; recursive."""
    n = len(s)
    out = spill.array(n, kind)
    if k == n:
        for a, b in _blocks(n):
            out[s[a:b]] = np.arange(a, b)
        return out
    counts = spill.array(k, kind)
    for a, b in _blocks(n):
        np.add.at(counts, s[a:b], 1)
    # Ranges of names: one name with many suffixes alone, else names with about `width` suffixes in all.
    width = max(RANGE, n // RANGES)
    ranges, alone, block, total, lone = spill.array(k, np.int32), [], -1, 0, False
    for a, b in _blocks(k):
        c = np.asarray(counts[a:b], np.int64)
        heavy = c > width
        end = (total + np.cumsum(np.where(heavy, 0, c))) // width
        change = np.concatenate([[end[0] != block or lone], (end[1:] != end[:-1]) | heavy[:-1]]) | heavy
        ranges[a:b] = len(alone) - 1 + np.cumsum(change)
        alone += heavy[change].tolist()
        block, lone, total = end[-1], bool(heavy[-1]), total + int(c[~heavy].sum())
    spill.done(counts)
    kinds, _, lms = _classify(s, spill, kind, False)
    back, start, last = spill.array(n, kind), 0, None
    for a, b in _blocks(n):
        x = np.asarray(s[a:b])
        fresh = np.concatenate([[last is None or x[0] != last], x[1:] != x[:-1]])
        starts = np.maximum.accumulate(np.where(fresh, np.arange(a, b), start))
        back[a:b] = np.arange(a, b) - starts
        start, last = starts[-1], x[-1]
    feed = [deque() for _ in alone]

    def deal(pos):
        r = ranges[s[pos]]
        order = np.argsort(r, kind="stable")
        pos, r = pos[order], r[order]
        for i, j in _bounds(r):
            feed[r[i]].append(spill.put(pos[i:j]))

    for a, b in _blocks(len(lms)):
        deal(np.asarray(lms[a:b]))
    place, at = spill.array(len(lms), kind), len(lms)

    def leftmost(pos):
        nonlocal at
        pos = pos[pos > 0]
        pos = pos[kinds[pos] & ~kinds[pos - 1]]
        place[at - len(pos) : at] = pos[::-1]
        at -= len(pos)

    _both(s, k, ranges, alone, kinds, back, feed, spill, leftmost)
    place[0] = n - 1

    def same(a, b, size):
        equal, live = np.ones(len(a), bool), np.arange(len(a))
        for i in range(int(size.max())):
            live = live[size[live] > i]
            differ = s[a[live] + i] != s[b[live] + i]
            equal[live[differ]] = False
            live = live[~differ]
            if not len(live):
                break
        return equal

    names, m = _named(place, lms, n, same, spill, kind)
    spill.done(place)
    shorter = _sorted_names(names, m, spill, kind)
    for a, b in _blocks(len(lms)):
        deal(lms[shorter[a:b]])
    spill.done(names, shorter)
    at = n

    def every(pos):
        nonlocal at
        out[at - len(pos) : at] = pos[::-1]
        at -= len(pos)

    _both(s, k, ranges, alone, kinds, back, feed, spill, every)
    out[0] = n - 1
    spill.done(ranges, kinds, back, lms)
    return out


def repeated(text: np.ndarray, cap: int, spill: Spill | None = None) -> np.ndarray:
    """Which suffixes share their first `cap` bytes with another suffix.

    text: unsigned bytes from 1 on, without the closing zero. A byte that is no content (a separator) may be shared too;
    callers look only at suffixes that have cap bytes of content.
    """
    spill = spill or Spill()
    n = len(text) + 1
    kind = np.int32 if n < 2**31 else np.int64
    t = spill.array(n + cap + 8, np.uint8)
    for a, b in _blocks(n - 1):
        t[a:b] = text[a:b]
    body = t[:n]
    kinds, runs, lms = _classify(body, spill, kind, True)
    mark = spill.array(n, bool)
    seeds = [deque() for _ in range(256)]

    def deal(pos, lcp):
        c = body[pos]
        order = np.argsort(c, kind="stable")
        for i, j in _bounds(c[order]):
            seeds[c[order[i]]].append(spill.put(pos[order[i:j]], lcp[order[i:j]]))

    for a, b in _blocks(len(lms)):
        deal(np.asarray(lms[a:b]), np.zeros(b - a, np.uint16))
    if len(lms) > 1:
        place, at = spill.array(len(lms), kind), len(lms)

        def leftmost(pos, _):
            nonlocal at
            pos = pos[pos > 0]
            pos = pos[kinds[pos] & ~kinds[pos - 1]]
            place[at - len(pos) : at] = pos[::-1]
            at -= len(pos)

        _passes(body, kinds, runs, seeds, cap, spill, False, leftmost)
        place[0] = n - 1

        names, m = _named(place, lms, n, lambda a, b, size: _alike(t, a, b, size), spill, kind)
        spill.done(place)
        order, before = _sorted_names(names, m, spill, kind), None
        spill.done(names)
        for a, b in _blocks(len(lms)):
            pos = lms[order[a:b]]
            lcp = np.zeros(len(pos), np.uint16)
            lcp[1:] = common(t, pos[1:], pos[:-1], cap)
            if before is not None:
                lcp[0] = common(t, pos[:1], before, cap)[0]
            before = pos[-1:]
            deal(pos, lcp)
        spill.done(order)
    larger = -1

    def visit(pos, lcp):
        nonlocal larger
        equal = lcp >= cap
        mark[pos[equal]] = True
        if equal[0] and larger >= 0:
            mark[larger] = True
        mark[pos[:-1][equal[1:]]] = True
        larger = pos[-1]

    _passes(body, kinds, runs, seeds, cap, spill, True, visit)
    return mark[: n - 1]


def repeated_names(names: np.ndarray, k: int, cap: int, spill: Spill | None = None) -> np.ndarray:
    """The same for a string of names below k, all of which occur, that ends with its only 0."""
    spill = spill or Spill()
    n = len(names)
    kind = np.int32 if n < 2**31 else np.int64
    mark, order, before = spill.array(n, bool), _sorted_names(names, k, spill, kind), np.zeros(0, kind)
    for a, b in _blocks(n):
        pos = np.concatenate([before, order[a:b]])
        p, q = pos[1:], pos[:-1]
        live = np.flatnonzero(np.maximum(p, q) + cap <= n)
        for i in range(cap):
            live = live[names[p[live] + i] == names[q[live] + i]]
        mark[p[live]] = True
        mark[q[live]] = True
        before = pos[-1:]
    return mark
