"""External induced sorting of suffixes, with common-prefix lengths.

Suffixes are sorted by induction from the leftmost suffixes of ascending runs (LMS). Their substrings are named in
order; unless all names differ, the string of names (half as long at most) is sorted by the same procedure, level after
level, until a string of names fits in memory and rank doubling ends the recursion. Then two scans induce all other
suffixes: going up, each suffix hands its left neighbour, if that is of type L, to a priority queue; going down, the
same for type S. A queue entry is a tuple (first character, position, common prefix with the entry before it in its
bucket): two neighbours induced by a and b share one character more than the least common prefix between a and b.

Memory is bounded by ``held``, the entries of a queue, block or buffer that may be in memory at once, whatever the
length of the text:

- types are never stored: a scan over blocks from the right finds the LMS positions, and during induction a left
  neighbour's type follows from its character (in the bucket of c: type L if it is c or larger going up);
- LMS positions, names and orders longer than ``held`` are memory-mapped temporary files;
- substrings are named by an external distribution sort on packed characters;
- queues keep buckets of a range of characters each; what does not fit goes to a file, sorted by bucket, and a bucket is
  read back block by block, or split further if it holds several characters and is too large;
- where the alphabet is large (names), neighbouring buckets are handled together up to the first one that a member of
  them induces into; where it is small (bytes), a bucket is handled in blocks.

Common prefixes are counted up to ``depth`` only, and suffixes equal for ``depth`` characters may come in any order.
"""

from __future__ import annotations

import os
import tempfile
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np

#: Entries of a queue, block or buffer in memory.
HELD = 1 << 18
#: Longest string of names that rank doubling sorts in memory (about 40 bytes a name).
SMALL = 1 << 18
#: Buckets of a queue.
FAN = 256
#: Entries of neighbouring buckets that are looked at together.
BATCH = 2048


class Store:
    """Where long arrays live: in memory up to ``held`` entries, beyond it in memory-mapped files of ``folder``."""

    def __init__(self, folder: str, held: int):
        self.folder, self.held = folder, held

    def array(self, n: int, kind) -> np.ndarray:
        if n <= self.held:
            return np.zeros(n, kind)
        f, path = tempfile.mkstemp(dir=self.folder)
        os.close(f)
        try:
            return np.asarray(np.memmap(path, kind, "w+", shape=(n,)))
        finally:
            os.remove(path)  # the mapping keeps the data

    def blocks(self, n: int) -> Iterator[tuple[int, int]]:
        return ((a, min(a + self.held, n)) for a in range(0, n, self.held))

    def spool(self) -> Spool:
        return Spool(self.folder, 8 * self.held)


class Spool:
    """Arrays appended to a file, read back by slices."""

    def __init__(self, folder: str, most: int):
        self.file, self.at = tempfile.SpooledTemporaryFile(most, dir=folder), 0

    def put(self, columns: list[np.ndarray]) -> list[tuple[int, np.dtype]]:
        self.file.seek(self.at)
        placed = []
        for c in columns:
            placed.append((self.at, c.dtype))
            self.at += self.file.write(np.ascontiguousarray(c).tobytes())
        return placed

    def get(self, placed: list[tuple[int, np.dtype]], a: int, b: int) -> list[np.ndarray]:
        out = []
        for at, kind in placed:
            self.file.seek(at + a * kind.itemsize)
            out.append(np.frombuffer(self.file.read((b - a) * kind.itemsize), kind))
        return out


def index_kind(n: int):
    return np.int32 if n < (1 << 31) - 8 else np.int64


class Run:
    """Columns sorted by bucket, in memory or in a spool."""

    def __init__(self, columns: list[np.ndarray]):
        self.columns, self.spool, self.placed = columns, None, None

    def send(self, spool: Spool) -> None:
        self.spool, self.placed, self.columns = spool, spool.put(self.columns), None

    def get(self, a: int, b: int) -> list[np.ndarray]:
        return [c[a:b] for c in self.columns] if self.columns is not None else self.spool.get(self.placed, a, b)


class BucketQueue:
    """A disk-backed priority queue of (key, position[, prefix]) tuples; equal keys leave in order of arrival.

    Buckets are ranges of keys. The *open* bucket is the one that entries are taken from; its own arrivals join it at
    once, all others wait until they are many or a bucket is opened, make a run sorted by bucket, and go to the spool
    once the runs in memory have ``held`` entries.
    """

    def __init__(self, store: Store, low: int, high: int):
        self.store, self.low = store, low
        self.width = max(1, -(-(high - low + 1) // FAN))
        self.counts = np.zeros(-(-(high - low + 1) // self.width), np.int64)
        self.fresh: list[list[np.ndarray]] = []
        self.n_fresh, self.open = 0, -1
        self.spool = store.spool()
        self.runs: list[Run] = []
        self.n_runs = 0
        #: bucket -> slices (run, begin, end), in order of arrival.
        self.slices: dict[int, deque] = {}
        self.front: list[np.ndarray] | None = None
        self.late: list[list[np.ndarray]] = []
        self.n_late = 0
        self.child: BucketQueue | None = None
        self.size = 0

    def push(self, columns: list[np.ndarray]) -> None:
        """Add entries; columns: keys, positions and, if prefixes are carried, prefixes."""
        if not len(columns[0]):
            return
        self.size += len(columns[0])
        bucket = (columns[0] - self.low) // self.width
        own = bucket == self.open
        if own.any():
            self._arrive([c[own] for c in columns])
            if own.all():
                return
            columns, bucket = [c[~own] for c in columns], bucket[~own]
        self.counts += np.bincount(bucket, minlength=len(self.counts))
        self.fresh.append(columns)
        self.n_fresh += len(bucket)
        if self.n_fresh >= self.store.held:
            self._settle()

    def _arrive(self, columns: list[np.ndarray]) -> None:
        if self.child:
            self.child.push(columns)
            return
        self.late.append(columns)
        self.n_late += len(columns[0])
        if self.width == 1 and self.n_late >= self.store.held:
            rows = [np.concatenate(c) for c in zip(*self.late, strict=True)]
            run = Run(rows)
            run.send(self.spool)
            self.slices.setdefault(self.open, deque()).append((run, 0, len(rows[0])))
            self.late, self.n_late = [], 0
        elif self.width > 1 and self.n_late + (len(self.front[0]) if self.front else 0) > 2 * self.store.held:
            self._merge_late()
            rows, self.front = self.front, None
            self._divide([rows])

    def _divide(self, parts) -> None:
        """Split the open bucket further."""
        low = self.low + self.open * self.width
        self.child = BucketQueue(self.store, low, low + self.width - 1)
        for rows in parts:
            self.child.push(rows)

    def _settle(self) -> None:
        """Make a run of what waits."""
        if not self.n_fresh:
            return
        rows = [np.concatenate(c) for c in zip(*self.fresh, strict=True)]
        self.fresh, self.n_fresh = [], 0
        bucket = (rows[0] - self.low) // self.width
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        run = Run([c[order] for c in rows])
        self.runs.append(run)
        self.n_runs += len(order)
        if self.n_runs >= self.store.held:
            for r in self.runs:
                r.send(self.spool)
            self.runs, self.n_runs = [], 0
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for b, i, j in zip(bucket[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True):
            self.slices.setdefault(b, deque()).append((run, i, j))

    def _read(self, most: int) -> list[np.ndarray] | None:
        """The next ``most`` entries (or a few more) of the open bucket's slices."""
        waiting, parts, n = self.slices.get(self.open, ()), [], 0
        while waiting and n < most:
            run, a, b = waiting.popleft()
            cut = min(b, a + self.store.held)
            if cut < b:
                waiting.appendleft((run, cut, b))
            parts.append(run.get(a, cut))
            n += cut - a
        return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else None

    def _merge_late(self) -> None:
        if self.late:
            rows = [np.concatenate(c) for c in zip(*self.late, strict=True)]
            self.late, self.n_late = [], 0
            if self.width > 1:
                order = np.argsort(rows[0], kind="stable")
                rows = [c[order] for c in rows]
                if self.front is not None:
                    place = np.searchsorted(self.front[0], rows[0], "right")
                    rows = [np.insert(f, place, c) for f, c in zip(self.front, rows, strict=True)]
            self.front = rows

    def _fill(self) -> bool:
        """Have entries of the open bucket in ``front``, if it has any."""
        if self.child:
            return self.child.size > 0
        if self.front is not None and not len(self.front[0]):
            self.front = None
        if self.width > 1:
            self._merge_late()
        elif self.front is None:
            self.front = self._read(self.store.held)
            if self.front is None:
                self._merge_late()
        return self.front is not None

    def _enter(self, bucket: int) -> None:
        self._settle()
        self.slices.pop(self.open, None)
        self.open, self.front, self.child = bucket, None, None
        n, self.counts[bucket] = int(self.counts[bucket]), 0
        if self.width > 1 and n:
            if n > self.store.held:
                self._divide(iter(lambda: self._read(self.store.held), None))
            else:
                rows = self._read(n)
                order = np.argsort(rows[0], kind="stable")
                self.front = [c[order] for c in rows]

    def peek(self, limit: int | None) -> int | None:
        """The smallest key; buckets beyond that of ``limit`` are not opened, and None is returned if only they have entries."""
        while True:
            if self.open >= 0 and self._fill():
                return self.child.peek(limit) if self.child else int(self.front[0][0])
            later = np.flatnonzero(self.counts)
            most = len(self.counts) if limit is None else (limit - self.low) // self.width
            if not len(later) or later[0] > most:
                if limit is not None and self.open < most < len(self.counts):
                    self._enter(most)
                return None
            self._enter(int(later[0]))

    def has(self, key: int) -> bool:
        """Whether the next entry has this key, which lies in the open bucket."""
        if self.open < 0 or not self._fill():
            return False
        return self.child.has(key) if self.child else int(self.front[0][0]) == key

    def window(self, most: int) -> tuple[list[np.ndarray] | None, int]:
        """The next entries, ``most`` of them if there are, and the largest key up to which they are complete."""
        if self.child:
            return self.child.window(most)
        end = self.low + (self.open + 1) * self.width - 1
        if self.open < 0 or not self._fill():
            return None, end
        rows = [c[:most] for c in self.front]
        more = len(self.front[0]) > most or self.late or self.slices.get(self.open)
        return rows, int(rows[0][-1]) - 1 if more else end

    def drop(self, n: int) -> None:
        self.size -= n
        if self.child:
            self.child.drop(n)
        elif n:
            self.front = [c[n:] for c in self.front]


class Sequence:
    """A sorted sequence of (key, position[, prefix]) rows that ``read`` hands out part by part; None at its end."""

    def __init__(self, read: Callable[[], list[np.ndarray] | None]):
        self.read, self.rows, self.ended = read, None, False

    def _fill(self, most: int) -> bool:
        n = len(self.rows[0]) if self.rows is not None else 0
        if not self.ended and n < most:
            parts = [self.rows] if n else []
            while n < 4 * most and not self.ended:
                more = self.read()
                if more is None:
                    self.ended = True
                else:
                    parts.append(more)
                    n += len(more[0])
            if parts:
                self.rows = [np.concatenate(c) for c in zip(*parts, strict=True)] if len(parts) > 1 else parts[0]
        return self.rows is not None and len(self.rows[0]) > 0

    def peek(self) -> int | None:
        return int(self.rows[0][0]) if self._fill(1) else None

    def window(self, most: int) -> tuple[list[np.ndarray] | None, int | None]:
        """The next ``most`` rows, and the largest key up to which they are complete (None: any)."""
        if not self._fill(most + 1):
            return None, None
        rows = [c[:most] for c in self.rows]
        return rows, int(rows[0][-1]) - 1 if len(self.rows[0]) > most else None

    def drop(self, n: int) -> None:
        if n:
            self.rows = [c[n:] for c in self.rows]


class Kept:
    """Rows of the upward scan on disk; ``read`` gives them back from the last to the first, prefixes moved along."""

    def __init__(self, store: Store, top: int):
        self.spool, self.parts, self.top, self.after = store.spool(), [], top, 0
        self.wait: list[list[np.ndarray]] = []
        self.n_wait, self.most = 0, min(store.held, 1 << 15)

    def put(self, keys: np.ndarray, columns: list[np.ndarray]) -> None:
        self.wait.append([*columns, keys])
        self.n_wait += len(keys)
        if self.n_wait >= self.most:
            self.settle()

    def settle(self) -> None:
        if self.n_wait:
            *columns, keys = (np.concatenate(c) for c in zip(*self.wait, strict=True))
            single = keys[0] == keys[-1]
            self.parts.append((int(keys[0]) if single else None, len(keys), self.spool.put(columns if single else [*columns, keys])))
            self.wait, self.n_wait = [], 0

    def read(self) -> list[np.ndarray] | None:
        if not self.parts:
            return None
        key, n, placed = self.parts.pop()
        columns = self.spool.get(placed, 0, n)
        keys = np.full(n, key, np.int64) if key is not None else columns.pop().astype(np.int64)
        out = [self.top - keys[::-1], columns[0][::-1]]
        if len(columns) > 1:  # a prefix now belongs to the pair with the row above, which the order reversed puts before
            out.append(np.concatenate([[self.after], columns[1][:0:-1]]).astype(np.int32))
            self.after = int(columns[1][0])
        return out


class Carry:
    """The least common prefix among inducers since each bucket's last entry."""

    def __init__(self, depth: int):
        self.depth = depth
        #: bucket -> least prefix since its last entry; buckets not listed never had one.
        self.low: dict[int, int] = {}

    def induced(self, chars: np.ndarray, at: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
        """Prefixes of the entries that inducers number ``at`` (ascending) push to the buckets ``chars``.

        ``prefixes`` are those of all inducers of the batch, each with the inducer before it.
        """
        n = len(prefixes)
        out = np.zeros(len(chars), np.int32)
        overall = int(prefixes.min()) if n else self.depth
        order = np.argsort(chars, kind="stable")
        c, a = chars[order], at[order]
        seen = {}
        if len(c):
            # For each entry the minimum over (inducer of the entry before it in the bucket, its own inducer].
            starts = np.concatenate([[True], c[1:] != c[:-1]])
            before = np.where(starts, -1, np.concatenate([[-1], a[:-1]]))
            least = range_minimum(prefixes, before + 1, a + 1)
            first = np.flatnonzero(starts)
            for i in first.tolist():
                known = self.low.get(int(c[i]))
                least[i] = -1 if known is None else min(known, int(least[i]))
            out[order] = np.minimum(least + 1, self.depth)
            last = np.concatenate([first[1:] - 1, [len(c) - 1]])
            after = range_minimum(prefixes, a[last] + 1, np.full(len(last), n), self.depth)
            seen = dict(zip(c[last].tolist(), after.tolist(), strict=True))
        if overall < self.depth:
            for k, v in self.low.items():
                if v > overall:
                    self.low[k] = overall
        self.low |= seen
        return out


def range_minimum(x: np.ndarray, begin: np.ndarray, end: np.ndarray, empty: int = 1 << 30) -> np.ndarray:
    """Minima of x[begin:end], ``empty`` where a range is empty."""
    out = np.full(len(begin), empty, np.int64)
    size = end - begin
    some = np.flatnonzero(size > 0)
    if not len(some):
        return out
    out[some[size[some] == 1]] = x[begin[some[size[some] == 1]]]
    some = some[size[some] > 1]
    if len(some):
        top = int(size[some].max()).bit_length() - 1
        table, level = np.asarray(x, np.int32), np.frexp(size[some].astype(float))[1] - 1
        for k in range(top + 1):
            own = some[level == k]
            if len(own):
                out[own] = np.minimum(table[begin[own]], table[end[own] - (1 << k)])
            if k < top:
                table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
    return out


def leftmost(text: np.ndarray, store: Store) -> np.ndarray:
    """The LMS positions, ascending: type S with a left neighbour of type L. The end counts as the smallest."""
    n = len(text)
    kind = index_kind(n)
    found = store.array(n // 2 + 1, kind)
    at, next_s = len(found), False
    for a in range((n - 1) // store.held * store.held if n else -1, -1, -store.held):
        b = min(a + store.held, n)
        part = np.asarray(text[a : b + 1])
        change = np.flatnonzero(part[1:] != part[:-1]) + 1
        is_s = np.repeat(np.append(part[change] > part[change - 1], b < n and next_s), np.diff(np.append(change, b - a), prepend=0))
        here = np.flatnonzero(np.append(is_s[1:], b < n and next_s) & ~is_s) + (a + 1)
        found[at - len(here) : at] = here.astype(kind)
        at, next_s = at - len(here), bool(is_s[0])
    return found[at:]


def names(text: np.ndarray, lms: np.ndarray, depth: int, store: Store) -> tuple[np.ndarray, int]:
    """Ranks of the substrings from each LMS position to the next (inclusive), and how many differ.

    An external distribution sort: as many characters as fit into 63 bits make a key; up to ``held`` substrings are
    sorted in memory, more are dealt out by sampled splitters, those equal to a splitter apart, and go on with their next
    characters. An ended substring follows any that goes on with the same characters: there the other has type L. The
    end of the text precedes everything. Substrings equal for ``depth`` characters count as equal.
    """
    n, m = len(text), len(lms)
    beyond = 1 + max((int(np.max(text[a:b])) for a, b in store.blocks(n)), default=0) + 1
    bits = int(beyond).bit_length()
    per, ended = 63 // bits, (1 << bits) - 1
    out = store.array(m, index_kind(m))

    def keys(which: np.ndarray, k: int) -> np.ndarray:
        begin = lms[which].astype(np.int64)
        last = which + 1 < m
        stop = np.where(last, lms[np.minimum(which + 1, m - 1)].astype(np.int64), n) + 1
        key = np.zeros(len(which), np.int64)
        for j in range(k, k + per):
            at = begin + j
            digit = np.where(at < n, text[np.minimum(at, n - 1)].astype(np.int64) + 1, 0)
            key = key << bits | np.where(at >= stop, beyond, digit)
        return key

    def settle(which: np.ndarray, k: int, first: int) -> int:
        """Name these, equal up to character k, from ``first`` on; return the next free name."""
        rank, tied = np.zeros(len(which), np.int64), np.arange(len(which))
        while len(tied):
            key, r = keys(which[tied], k), rank[tied]
            order = np.lexsort((key, r)) if k and r.any() else np.argsort(key, kind="stable")
            tied, key, r = tied[order], key[order], r[order]
            new_group = np.concatenate([[True], r[1:] != r[:-1]])
            fresh = new_group | np.concatenate([[True], key[1:] != key[:-1]])
            head, at = np.flatnonzero(new_group), np.flatnonzero(fresh)
            size = np.diff(np.append(at, len(r)))
            # Ranks count the smaller substrings, so that ranks of groups that aren't touched stay right.
            rank[tied] = r + np.repeat(at, size) - np.repeat(head, np.diff(np.append(head, len(r))))
            k += per
            tied = tied[(np.repeat(size, size) > 1) & (key & ended != beyond)] if k < depth else tied[:0]
        seen = np.zeros(len(which), bool)
        seen[rank] = True
        dense = np.cumsum(seen) - 1
        out[which] = first + dense[rank]
        return first + int(dense[-1]) + 1

    def dealt(parts: Callable[[], Iterator[np.ndarray]], count: int, k: int) -> list[tuple]:
        """Work items in order: (which substrings, how many, character, all equal)."""
        picked = np.concatenate([keys(p[:: max(1, count >> 12)], k) for p in parts()])
        splitters = np.unique(np.sort(picked)[:: max(1, len(picked) // 64)])
        spool, slices = store.spool(), [[] for _ in range(2 * len(splitters) + 1)]
        for p in parts():
            key = keys(p, k)
            at = np.searchsorted(splitters, key)
            goal = 2 * at + (splitters[np.minimum(at, len(splitters) - 1)] == key)
            order = np.argsort(goal, kind="stable")
            goal, placed = goal[order], spool.put([p[order]])
            starts = np.flatnonzero(np.concatenate([[True], goal[1:] != goal[:-1]]))
            for g, i, j in zip(goal[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(goal)], strict=True):
                slices[g].append((placed, i, j))
        items = []
        for g, own in enumerate(slices):
            if own:
                same = bool(g % 2)
                over = same and (int(splitters[g // 2]) & ended == beyond or k + per >= depth)
                read = lambda own=own: (spool.get(*s)[0] for s in own)
                items.append((read, sum(j - i for _, i, j in own), k + per * same, over))
        return items

    first, work = 0, [(lambda: (np.arange(a, b) for a, b in store.blocks(m)), m, 0, False)]
    while work:
        parts, count, k, same = work.pop()
        if same:
            for p in parts():
                out[p] = first
            first += 1
        elif count <= store.held:
            first = settle(np.concatenate([*parts()]), k, first)
        else:
            work += reversed(dealt(parts, count, k))
    return out, first


def doubled(name: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names, for ``depth`` names at least, by rank doubling in memory."""
    n = len(name)
    kind = index_kind(n)
    order = np.argsort(name, kind="stable").astype(kind)
    value = name[order]
    head = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])).astype(kind)
    rank = np.empty(n, kind)
    rank[order] = np.repeat(head, np.diff(np.append(head, kind(n))))
    del value, head
    h = 1
    while h < depth:
        held = rank[order]
        single = np.concatenate([[True], held[1:] != held[:-1]]) & np.concatenate([held[1:] != held[:-1], [True]])
        open_ = np.flatnonzero(~single).astype(kind)
        if not len(open_):
            break
        at = order[open_]
        following = np.where(at < n - h, rank[np.minimum(at, max(n - 1 - h, 0)) + min(h, n - 1)] + kind(1), kind(0))
        group = held[open_]
        del held, single
        by = np.lexsort((following, group)).astype(kind)
        at, following = at[by], following[by]
        order[open_] = at
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (following[1:] != following[:-1])])
        first = np.flatnonzero(fresh).astype(kind)
        rank[at] = np.repeat(open_[first], np.diff(np.append(first, kind(len(at)))))
        h *= 2
    return order


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of the suffixes at a and b, up to ``depth``, eight bytes at a time."""
    n = len(text)
    if n < 8:
        text = np.concatenate([text, np.zeros(8 - n, np.uint8)])
    top = len(text) - 8
    words = np.ndarray((top + 1,), ">u8", buffer=text, strides=(1,))

    def word(p: np.ndarray) -> np.ndarray:
        """The eight bytes from p on, zeros beyond the end."""
        inside = np.minimum(p, top)
        return words[inside].astype(np.uint64) << ((p - inside) << 3).astype(np.uint64)

    out = np.full(len(a), depth, np.int64)
    open_ = np.arange(len(a))
    a, b = a.astype(np.int64), b.astype(np.int64)
    k = 0
    while len(open_) and k < depth:
        p, q = a[open_] + k, b[open_] + k
        over = np.maximum(p, q) >= n
        x = word(np.minimum(p, n - 1)) ^ word(np.minimum(q, n - 1))
        ended = over | (x != 0)
        lead = np.where(over[ended], 0, (64 - bit_length(x[ended])) >> 3)
        out[open_[ended]] = np.minimum(k + lead, n - np.maximum(p, q)[ended] + k)
        open_ = open_[~ended]
        k += 8
    return np.minimum(out, depth)


def bit_length(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x | x >> np.uint64(s)
    return np.bitwise_count(x).astype(np.int64)


def sorted_lms(text: np.ndarray, depth: int, store: Store, small: int) -> np.ndarray:
    """The LMS positions in the order of their suffixes."""
    lms = leftmost(text, store)
    m = len(lms)
    if not m:
        return lms
    name, different = names(text, lms, depth, store)
    star = store.array(m, lms.dtype)
    if different == m:
        for a, b in store.blocks(m):
            star[name[a:b]] = lms[a:b]
    elif m <= small:
        order = doubled(np.asarray(name), depth // 2 + 2)
        for a, b in store.blocks(m):
            star[a:b] = lms[order[a:b]]
    else:
        end = m
        for positions, _ in induced(name, depth // 2 + 2, store, small, False):
            star[end - len(positions) : end] = lms[positions[::-1]]
            end -= len(positions)
    return star


def scan(text: np.ndarray, key_of: Callable, queue: BucketQueue, stream: Sequence, depth: int, carry: Carry | None) -> Iterator[tuple]:
    """Yield (keys, positions, prefixes or None, whether from the queue) of all suffixes in the order of their keys.

    Of one key, the queue's entries come before those of the sorted stream. Each entry hands its left neighbour to the
    queue: the queue's own if the neighbour's key isn't smaller, the stream's if it is larger.
    """

    def neighbours(keys: np.ndarray, positions: np.ndarray, strict) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the left neighbours, and which of them go to the queue."""
        left = key_of(text[np.maximum(positions, 1) - 1])
        return left, (positions > 0) & (left >= keys + strict)

    def hand_on(keys: np.ndarray, positions: np.ndarray, prefixes: np.ndarray | None, strict: int) -> None:
        left, wanted = neighbours(keys, positions, strict)
        at = np.flatnonzero(wanted)
        rows = [left[at], positions[at] - positions.dtype.type(1)]
        queue.push(rows if carry is None else [*rows, carry.induced(rows[0], at, prefixes)])

    def run(p: int) -> int:
        part = np.asarray(text[p : p + depth])
        other = np.flatnonzero(part != part[0])
        return int(other[0]) if len(other) else len(part)

    def many() -> Iterator[tuple]:
        """Whole buckets that none of their members induces into, as many as there are; nothing if the first isn't one."""
        (own, end), (given, most) = queue.window(BATCH), stream.window(BATCH)
        end = end if most is None else min(end, most)
        n, g = (int(np.searchsorted(x[0], end, "right")) if x is not None else 0 for x in (own, given))
        if not n + g:
            return
        parts = [[c[:k] for c in x] for x, k in ((own, n), (given, g)) if k]
        keys, positions = (np.concatenate(c) for c in zip(*parts, strict=True))
        strict = np.repeat([0, 1], [n, g])
        order = np.argsort(keys * 2 + strict, kind="stable")
        keys, positions, strict = keys[order], positions[order], strict[order]
        left, wanted = neighbours(keys, positions, strict)
        least = np.minimum.accumulate(np.where(wanted, left, np.iinfo(np.int64).max))
        last = np.flatnonzero(np.append(keys[1:] != keys[:-1], True))
        whole = int((least[last] > keys[last]).sum())
        if not whole:
            return
        k = int(last[whole - 1]) + 1
        queue.drop(int(k - strict[:k].sum()))
        stream.drop(int(strict[:k].sum()))
        at = np.flatnonzero(wanted[:k])
        queue.push([left[at], positions[at] - positions.dtype.type(1)])
        yield keys[:k], positions[:k], None, strict[:k] == 0

    while True:
        following = stream.peek()
        first = queue.peek(following)
        if first is None and following is None:
            return
        if carry is None:
            done = False
            for rows in many():
                done = True
                yield rows
            if done:
                continue
        key = min(x for x in (first, following) if x is not None)
        last = None
        while queue.has(key):
            rows = queue.window(queue.store.held)[0]
            n = int(np.searchsorted(rows[0], key, "right"))
            keys, positions, *prefixes = (c[:n] for c in rows)
            queue.drop(n)
            x = prefixes[0].astype(np.int32) if prefixes else None
            if x is not None and last is None:
                x[0] = 0
            last = int(positions[-1])
            yield keys, positions, x, np.ones(n, bool)
            hand_on(keys, positions, x, 0)
        begun = False
        while stream.peek() == key:
            rows = stream.window(queue.store.held)[0]
            n = int(np.searchsorted(rows[0], key, "right"))
            keys, positions, *prefixes = (c[:n] for c in rows)
            stream.drop(n)
            x = prefixes[0].astype(np.int32) if prefixes else None
            if x is not None and not begun:
                x[0] = min(run(int(positions[0])), run(last)) if last is not None else 0
            begun = True
            yield keys, positions, x, np.zeros(n, bool)
            hand_on(keys, positions, x, 1)


def induced(text: np.ndarray, depth: int, store: Store, small: int = SMALL, prefixes: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Yield (positions, prefixes) of all suffixes, from the largest to the smallest.

    A prefix is that with the suffix yielded before it. ``prefixes`` False leaves them out (for strings of names); else
    the text must be bytes.
    """
    n = len(text)
    if not n:
        return
    top = max(int(np.max(text[a:b])) for a, b in store.blocks(n))
    kind, prefix_kind = index_kind(n), np.uint16 if depth < 1 << 16 else np.int32
    star, cuts = sorted_lms(text, depth, store, small), store.blocks
    places = cuts(len(star))

    def stars() -> list[np.ndarray] | None:
        cut = next(places, None)
        if cut is None:
            return None
        own = np.asarray(star[slice(*cut)])
        rows = [text[own].astype(np.int64), own]
        if prefixes:
            before = np.concatenate([own[:1] if not cut[0] else star[cut[0] - 1 : cut[0]], own[:-1]])
            rows.append(common(text, before, own, depth).astype(np.int32))
        return rows

    # Going up: type L. The end of the text induces the last suffix.
    queue, carry = BucketQueue(store, 0, top), Carry(depth) if prefixes else None
    end = [np.array([int(text[n - 1])]), np.array([n - 1], kind)]
    queue.push([*end, np.zeros(1, np.int32)] if prefixes else end)
    if prefixes:
        carry.low[int(text[n - 1])] = 0
    kept = Kept(store, top)
    for keys, positions, x, own in scan(text, lambda c: c.astype(np.int64), queue, Sequence(stars), depth, carry):
        if own.any():
            kept.put(keys[own], [positions[own], *([x[own].astype(prefix_kind)] if prefixes else [])])
    kept.settle()
    del queue, star
    # Going down: type S, from the largest suffix. Prefixes now belong to the pair (entry, the one above it).
    queue, carry = BucketQueue(store, 0, top), Carry(depth) if prefixes else None
    for _, positions, x, _ in scan(text, lambda c: top - c.astype(np.int64), queue, Sequence(kept.read), depth, carry):
        yield positions, x


def repeated(text: np.ndarray, depth: int, folder: str, small: int = SMALL, held: int = HELD) -> np.ndarray:
    """Whether each position's suffix shares ``depth`` characters with another one: its neighbours in the order decide."""
    store, text = Store(folder, held), np.asarray(text)
    flags, above = store.array(len(text), bool), 0
    for positions, prefixes in induced(text, depth, store, small):
        same = np.flatnonzero(prefixes >= depth)
        flags[positions[same]] = True
        flags[np.concatenate([[above], positions[:-1]])[same]] = True
        above = int(positions[-1])
    return flags
