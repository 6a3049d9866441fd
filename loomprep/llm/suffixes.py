"""External induced sorting of suffixes, to a given depth, with their common prefixes.

The suffixes that start at a local minimum of the text (a symbol smaller than what follows, after a greater one) are sorted
first. What lies between two minima becomes one symbol of a shorter text, named by its rank among all such substrings, and
that text is sorted in the same way: every level halves the length at least, and after log2(depth) levels a symbol alone is
as long as the depth. Back on a level, the order of all its suffixes is induced from that of the minima: a suffix is told
by the symbols up to its next minimum and the rank of that minimum's suffix.

Tuples go through priority queues that sort runs, write them to disk beyond a memory bound and merge them when they are
emptied. The length of the common prefix with the suffix before is carried along: between suffixes with equal symbols up to
their minima it is that stretch and the least common prefix between the ranks of the two minima.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np

BLOCK = 1 << 18  # positions that are worked on at a time


class Space:
    """Where a sort keeps its arrays and queues: memory up to a bound each, files of ``folder`` beyond it."""

    def __init__(self, folder: str, memory: int) -> None:
        self.folder, self.memory, self.files = Path(folder), memory, 0

    def file(self) -> Path:
        self.files += 1
        return self.folder / f"{self.files}.bin"

    def array(self, n: int, dtype: type) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.memory:
            return np.zeros(n, dtype)
        return np.memmap(self.file(), dtype, "w+", shape=(n,))


def sorting(key: np.ndarray, sub: np.ndarray) -> np.ndarray:
    """Order by key, then sub; rows that agree in both in any order."""
    low, high = key.min(), key.max()
    if low == high:
        return np.argsort(sub)
    if sub.min() == sub.max():
        return np.argsort(key)
    # One number for both, by the ranks of sub, is sorted faster than one after the other.
    order = np.argsort(sub)
    ordered = sub[order]
    rank = np.zeros(len(sub), np.uint64)
    rank[order[1:]] = np.cumsum(ordered[1:] != ordered[:-1], dtype=np.uint64)
    ranks = int(rank.max()) + 1
    if int(high) * ranks >= 1 << 64:
        return np.lexsort((sub, key))
    return np.argsort(key * np.uint64(ranks) + rank)


class Queue:
    """Priority queue of rows (key, sub, ...) that takes in blocks and gives out blocks in ascending order."""

    def __init__(self, space: Space) -> None:
        self.space, self.rows, self.bytes, self.runs = space, [], 0, []

    def push(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.rows.append(columns)
            self.bytes += sum(c.nbytes for c in columns)
            if self.bytes > self.space.memory:
                self._write()

    def _sorted(self, rows: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
        order = sorting(*columns[:2])
        return [c[order] for c in columns]

    def _write(self) -> None:
        run = []
        for column in self._sorted(self.rows):
            path = self.space.file()
            column.tofile(path)
            run.append((np.memmap(path, column.dtype, "r"), path))
        self.runs.append(run)
        self.rows, self.bytes = [], 0

    def pop(self) -> Iterator[list[np.ndarray]]:
        """All rows in order; the queue is empty afterwards."""
        if not self.runs:
            rows, self.rows, self.bytes = self.rows, [], 0
            if rows:
                columns = self._sorted(rows)
                del rows
                for low in range(0, len(columns[0]), BLOCK):
                    yield [c[low : low + BLOCK] for c in columns]
            return
        if self.rows:
            self._write()
        runs, self.runs = self.runs, []
        width = sum(c.itemsize for c, _ in runs[0])
        at_once = max(1024, self.space.memory // (width * len(runs)))
        at = [0] * len(runs)
        while live := [i for i, run in enumerate(runs) if at[i] < len(run[0][0])]:
            # What is not above the least last row of the runs' next blocks comes before all that is not seen yet.
            heads = {i: [np.asarray(c[at[i] : at[i] + at_once]) for c, _ in runs[i]] for i in live}
            key, sub = min((h[0][-1], h[1][-1]) for h in heads.values())
            taken = []
            for i, head in heads.items():
                low, high = np.searchsorted(head[0], key, "left"), np.searchsorted(head[0], key, "right")
                end = low + np.searchsorted(head[1][low:high], sub, "right")
                at[i] += end
                if end:
                    taken.append(tuple(c[:end] for c in head))
            yield self._sorted(taken)
        for run in runs:
            for _, path in run:
                path.unlink()


class Placed:
    """Values that arrive in any order of their places and are read in the order of places."""

    def __init__(self, space: Space, n: int, dtype: type) -> None:
        self.out, self.n = space.array(n, dtype), n
        self.queue = Queue(space) if isinstance(self.out, np.memmap) else None

    def push(self, places: np.ndarray, values: np.ndarray) -> None:
        if self.queue is None:
            self.out[places] = values
        else:
            self.queue.push(np.zeros(len(places), np.uint64), places.astype(np.uint64), values)

    def read(self) -> np.ndarray:
        low = 0
        for _, _, values in self.queue.pop() if self.queue else ():
            self.out[low : low + len(values)] = values
            low += len(values)
        return self.out


def stars(space: Space, text: np.ndarray) -> np.ndarray:
    """Whether each position is a local minimum; beyond the end stands a symbol smaller than all."""
    n = len(text)
    found = space.array(n, bool)
    after, after_small = -1, False
    for low in reversed(range(0, n, BLOCK)):
        x = np.asarray(text[low : low + BLOCK], np.int64)
        following = np.append(x[1:], after)
        # A symbol's suffix is smaller than the next when the next other symbol is greater.
        other = np.where(x != following, np.arange(len(x)), len(x))
        other = np.minimum.accumulate(other[::-1])[::-1]
        small = np.append(x < following, after_small)[other]
        before = np.concatenate([[text[low - 1] if low else -1], x[:-1]])
        found[low : low + len(x)] = small & (before > x)
        after, after_small = x[0], small[0]
    return found


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix at positions a and b, up to ``depth``."""
    out = np.zeros(len(a), np.uint8)
    live = np.arange(len(a))
    for _ in range(depth):
        inside = np.maximum(a, b) < len(text)
        a, b, live = a[inside], b[inside], live[inside]
        equal = text[a] == text[b]
        a, b, live = a[equal] + 1, b[equal] + 1, live[equal]
        if not len(live):
            break
        out[live] += 1
    return out


class Least:
    """Least value of ranges of an array, by the minima of all stretches of 1, 2, 4, ... entries."""

    def __init__(self, space: Space, values: np.ndarray) -> None:
        self.rows, step = [values], 1
        while 2 * step <= len(values):
            last = self.rows[-1]
            row = space.array(len(last) - step, np.uint8)
            for low in range(0, len(row), BLOCK):
                high = min(len(row), low + BLOCK)
                row[low:high] = np.minimum(last[low:high], last[low + step : high + step])
            self.rows.append(row)
            step *= 2

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = np.frexp((last - first + 1).astype(float))[1] - 1
        out = np.zeros(len(first), np.uint8)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.rows[k][first[at]], self.rows[k][last[at] - (1 << int(k)) + 1])
        return out


def named(space: Space, symbols: np.ndarray, wanted: Iterator[tuple[np.ndarray, np.ndarray]], total: int, limit: int) -> np.ndarray:
    """Names of the stretches from q to e (both included) of the blocks (q, e): equal for equal stretches, ascending in the
    order of the suffixes they begin. Only the first ``limit`` symbols are looked at.

    A stretch that is the beginning of a longer one is greater: its last symbol is a minimum, so it goes on upwards, where
    the longer one goes down.
    """
    n, small = len(symbols), np.int32 if max(len(symbols), total) < 1 << 31 else np.int64
    greatest = max((int(symbols[low : low + BLOCK].max()) for low in range(0, n, BLOCK)), default=0)
    bits = (greatest + 3).bit_length()
    beyond, each = (1 << bits) - 1, 63 // bits

    def word(q: np.ndarray, e: np.ndarray, turn: int) -> np.ndarray:
        out = np.zeros(len(q), np.uint64)
        for t in range(each):
            i = q + (turn * each + t)
            code = symbols[np.minimum(i, n - 1)].astype(np.uint64) + np.uint64(1)
            if len(i) and i.max() >= n:
                code[i == n] = 0
            code[i > e] = beyond
            out = (out << np.uint64(bits)) | code
        return out

    names = Placed(space, total, np.int64)
    queue, slot, turn = Queue(space), 0, 0
    for q, e in wanted:
        queue.push(np.zeros(len(q), np.uint64), word(q, e, 0), np.arange(slot, slot + len(q), dtype=small), q.astype(small), e.astype(small))
        slot += len(q)
    while True:
        further, seen, empty = Queue(space), 0, True
        group_key, group_at, value_sub, value_at = None, 0, None, 0
        held = None  # the last row of a block waits for the next one
        goes_on = (turn + 1) * each < limit
        blocks = queue.pop()
        block = next(blocks, None)
        while block is not None:
            following = next(blocks, None)
            if held is not None:
                block = [np.concatenate([h, c]) for h, c in zip(held, block, strict=True)]
            key, sub, slots, q, e = block
            new_group = np.concatenate([[group_key is None or key[0] != group_key], key[1:] != key[:-1]])
            new_value = new_group | np.concatenate([[value_sub is None or sub[0] != value_sub], sub[1:] != sub[:-1]])
            at = np.arange(seen, seen + len(key))
            groups = np.maximum.accumulate(np.where(new_group, at, group_at))
            values = np.maximum.accumulate(np.where(new_value, at, value_at))
            name = key.astype(np.int64) + (values - groups)
            alone = new_value & np.append(new_value[1:], True)
            more = ~alone & ((sub & np.uint64(beyond)) != np.uint64(beyond)) if goes_on else np.zeros(len(key), bool)
            done = len(key) if following is None else len(key) - 1
            held = None if following is None else [c[done:] for c in block]
            if done:
                again, over = np.flatnonzero(more[:done]), np.flatnonzero(~more[:done])
                names.push(slots[over], name[over])
                further.push(name[again].astype(np.uint64), word(q[again], e[again], turn + 1), slots[again], q[again], e[again])
                empty &= not len(again)
                group_key, group_at, value_sub, value_at = key[done - 1], groups[done - 1], sub[done - 1], values[done - 1]
                seen += done
            block = following
        if empty:
            return names.read()
        queue, turn = further, turn + 1


def suffixes(
    space: Space, symbols: np.ndarray, depth: int, want: np.ndarray | None = None, text: np.ndarray | None = None, at: np.ndarray | None = None, level: int = 0
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (index, common): the wanted suffixes in order, each with the common prefix with the one before.

    ``symbols`` are integers from 0. Suffixes that agree in their first ``depth`` symbols stand together in any order, with a
    common prefix of ``depth``. ``want`` marks positions (default: all); index counts the wanted ones from 0. The other
    arguments are for the levels below the text: its own symbols and the place of each symbol in it.
    """
    if not 0 < depth < 256:
        raise ValueError("depth is 1 to 255")
    n = len(symbols)
    text = symbols if text is None else text

    def place(i: np.ndarray) -> np.ndarray:
        return i if at is None else at[i]

    if 1 << level >= depth:
        queue, index = Queue(space), 0
        for low in range(0, n, BLOCK):
            x = np.asarray(symbols[low : low + BLOCK])
            q = np.arange(len(x)) if want is None else np.flatnonzero(want[low : low + BLOCK])
            queue.push(np.zeros(len(q), np.uint64), x[q].astype(np.uint64), np.arange(index, index + len(q)), q + low)
            index += len(q)
        last, last_q = None, None
        for _, x, index, q in queue.pop():
            pair_x = np.concatenate([x[:1] if last is None else [last], x])
            pair_q = np.concatenate([q[:1] if last is None else [last_q], q])
            shared = np.full(len(q), depth, np.uint8)
            differ = np.flatnonzero(pair_x[1:] != pair_x[:-1])
            shared[differ] = common(text, place(pair_q[differ]), place(pair_q[differ + 1]), depth)
            if last is None:
                shared[0] = 0
            last, last_q = x[-1], q[-1]
            yield index, shared
        return
    star = stars(space, symbols)
    m = sum(int(star[low : low + BLOCK].sum()) for low in range(0, n, BLOCK))
    minima = space.array(m + 1, np.int64)
    filled = 0
    for low in range(0, n, BLOCK):
        found = np.flatnonzero(star[low : low + BLOCK]) + low
        minima[filled : filled + len(found)] = found
        filled += len(found)
    minima[m] = n

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(q, number of its next minimum, q is a minimum) of all positions that need a name."""
        passed = 0
        for low in range(0, n, BLOCK):
            s = np.asarray(star[low : low + BLOCK])
            q = np.arange(len(s)) if want is None else np.flatnonzero(s | want[low : low + BLOCK])
            yield q + low, (passed + np.cumsum(s))[q], s[q]
            passed += int(s.sum())

    total = sum(len(q) for q, _, _ in blocks())
    names = named(space, symbols, ((q, minima[k]) for q, k, _ in blocks()), total, (depth >> level) + 2)
    shorter, low, slot = space.array(m, np.int64), 0, 0
    for q, _, is_star in blocks():
        own = names[slot : slot + len(q)][is_star]
        shorter[low : low + len(own)] = own
        low, slot = low + len(own), slot + len(q)
    below = space.array(m + 1, np.int64)
    for low in range(0, m + 1, BLOCK):
        below[low : low + BLOCK] = place(minima[low : low + BLOCK]) if at is not None else minima[low : low + BLOCK]
    # Rank 0 is the end of the text.
    ranks, shared, rank = Placed(space, m + 1, np.int64), space.array(m + 1, np.uint8), 1
    if m:
        for index, prefix in suffixes(space, shorter, depth, None, text, below, level + 1):
            ranks.push(index, np.arange(rank, rank + len(index)))
            shared[rank : rank + len(index)] = prefix
            rank += len(index)
        shared[1] = 0
    ranks.push(np.array([m]), np.array([0]))
    ranks = ranks.read()
    least = Least(space, shared)
    queue, slot, index, small = Queue(space), 0, 0, np.int32 if n < 1 << 31 else np.int64
    for q, k, _ in blocks():
        name, keep = names[slot : slot + len(q)], slice(None)
        slot += len(q)
        if want is not None:
            keep = np.flatnonzero(want[q])
        q, k, name = q[keep], k[keep], name[keep]
        stretch = np.minimum(place(minima[k]) - place(q), depth)
        end = np.where(stretch < depth, ranks[k], 0)
        queue.push(name.astype(np.uint64) * np.uint64(m + 1) + end.astype(np.uint64), np.zeros(len(q), np.uint64), np.arange(index, index + len(q), dtype=small), q.astype(small), stretch.astype(np.uint8))
        index += len(q)
    last = None
    for key, _, index, q, stretch in queue.pop():
        pair_key, pair_q = (np.concatenate([c[:1] if last is None else [last[i]], c]) for i, c in enumerate((key, q)))
        name, end = (pair_key // np.uint64(m + 1)).astype(np.int64), (pair_key % np.uint64(m + 1)).astype(np.int64)
        same = name[1:] == name[:-1]
        prefix = np.zeros(len(q), np.uint8)
        differ = np.flatnonzero(~same)
        prefix[differ] = common(text, place(pair_q[differ]), place(pair_q[differ + 1]), depth)
        full = same & (stretch >= depth)
        prefix[full] = depth
        rest = np.flatnonzero(same & ~full & (end[1:] > end[:-1]))
        prefix[rest] = np.minimum(depth, stretch[rest].astype(np.int64) + least.of(end[rest] + 1, end[rest + 1]).astype(np.int64))
        if last is None:
            prefix[0] = 0
        last = (key[-1], q[-1])
        yield index, prefix
