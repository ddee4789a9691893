"""Which signatures of two bounded parts are the same footage (J18), decided exactly.

Sums come first and drop nearly all pairs: totals must be close, and by how much the sums of a stretch of two timelines differ, the timelines
differ at least. For blocks of pairs a matrix product gives the root of the squares of these differences, which is no more than their sum; the pairs
left are taken one by one. Values are added up in the order of the timeline, as Spark's aggregate does, so a distance is the same double.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle

#: When two contents are the same footage.
SAME_DURATION, SAME_SECONDS, SAME_FLOOR, SAME_LABELLED, SAME_TIMELINE, TIMELINE_BUCKET = 0.02, 0.06, 2.0, 30.0, 0.10, 10.0

#: Rows of the left part that meet the right part at once, stretches of the longest timeline, values held for exact distances, pairs a batch.
ROWS, STRETCHES, VALUES, BATCH = 64, 18, 1_000_000, 100_000

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors needn't have the package


class Part:
    """Signatures as arrays: totals (duration, mixed, seconds of each label, 0 where a label is missing), timelines end to end, their running sums."""

    def __init__(self, rows: pa.Table, labels: list):
        self.rows = rows
        lists, maps = rows["timeline"].combine_chunks(), rows["seconds"].combine_chunks()
        number = lambda c: np.asarray(c.cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=float)
        seconds = np.zeros((rows.num_rows, len(labels)))
        ends = np.asarray(maps.offsets)
        keys = maps.keys.slice(ends[0], ends[-1] - ends[0]).to_pylist()
        at = {x: i for i, x in enumerate(labels)}
        held = np.nan_to_num(number(maps.items.slice(ends[0], ends[-1] - ends[0])))
        seconds[np.repeat(np.arange(rows.num_rows), np.diff(ends)), [at[x] for x in keys]] = held
        self.totals = np.column_stack([number(rows["duration"].combine_chunks()), number(rows["mixed"].combine_chunks()), seconds])
        ends = np.asarray(lists.offsets).astype(np.int64)
        self.values = number(lists.values.slice(ends[0], ends[-1] - ends[0]))
        self.start, self.size = ends[:-1] - ends[0], np.diff(ends)
        self.empty = (self.size == 0) & np.asarray(lists.is_valid())
        # one more sum than values a row, so that a row's sums begin at start + its number
        known = np.nan_to_num(self.values)
        sums, sizes = np.concatenate([[0.0], np.cumsum(known)]), np.concatenate([[0.0], np.cumsum(np.abs(known))])
        self.sums_at = self.start + np.arange(rows.num_rows)
        within = np.arange(len(known) + rows.num_rows) - np.repeat(np.arange(rows.num_rows), self.size + 1)
        self.sums = sums[within] - np.repeat(sums[self.start], self.size + 1)
        self.mass = sizes[self.start + self.size] - sizes[self.start]
        self.slack = 1e-9 * (1 + sizes[-1])


def limits(x: np.ndarray, share: float, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Between these lie all values that are close to x, and few others."""
    slack = 1e-6 * (1 + np.abs(x))
    return np.minimum(x * (1 - share), x - floor) - slack, np.maximum(x / (1 - share), x + floor) + slack


def rules(columns: int) -> list[tuple[float, float]]:
    return [(SAME_DURATION, 0.0)] + [(SAME_SECONDS, SAME_FLOOR)] * (columns - 1)


def shifts_of(duration: np.ndarray) -> np.ndarray:
    return np.ceil(duration * SAME_DURATION / TIMELINE_BUCKET).astype(np.int64)


def stretches(part: Part, rows: np.ndarray, start: int, width: int, n: int) -> np.ndarray:
    """Sums of the first n stretches of timelines from `start` on."""
    at = part.sums_at[rows, None] + start + width * np.arange(n + 1)
    return np.diff(part.sums[at], axis=1)


def products(left: Part, lefts: np.ndarray, right: Part, rights: np.ndarray, width: int, stretches_left: int, stretches_right: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """For each shift two matrices whose product is the sum of squared differences of stretches that both timelines hold, or a little less; None if a shift leaves no stretch."""
    most = int(shifts_of(np.maximum(np.nanmax(left.totals[lefts, 0]), np.nanmax(right.totals[rights, 0]))))
    out = []
    for k in range(-most, most + 1):
        x0, y0 = max(-k, 0), max(k, 0)
        n = min(stretches_left - -(-x0 // width), stretches_right - -(-y0 // width))
        if n <= 0:
            return None
        x, y = stretches(left, lefts, x0, width, n), stretches(right, rights, y0, width, n)
        square = lambda z: (z * z).sum(axis=1, keepdims=True) * (1 - 1e-5)
        out.append(tuple(np.hstack(z).astype(np.float32) for z in ([-2 * x, square(x), np.ones((len(x), 1))], [y, np.ones((len(y), 1)), square(y)])))
    return out


def near_by_sums(left: Part, right: Part, same: bool, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with totals and stretches that are close or nearly so; all of the same footage are among them. same: both are one part, and a pair comes once."""
    bounds = [limits(left.totals[:, c], *rule) for c, rule in enumerate(rules(left.totals.shape[1]))]
    reach = []
    for c, (lo, hi) in enumerate(bounds):
        v = np.sort(right.totals[:, c])
        reach.append((np.searchsorted(v, hi, "right") - np.searchsorted(v, lo)).sum())
    first = int(np.argmin(reach))  # the total that leaves the fewest pairs
    most = [((SAME_TIMELINE * p.mass * (1 + 1e-5) + left.slack + right.slack) ** 2).astype(np.float32) * np.float32(1 + 1e-5) for p in (left, right)]
    left_size, right_size = left.size // width, right.size // width
    for p in np.unique(left_size):
        for q in np.unique(right_size):
            if same and q < p:
                continue
            one = same and p == q
            lefts, rights = (rows[np.argsort(part.totals[rows, first], kind="stable")] for part, rows in ((left, np.flatnonzero(left_size == p)), (right, np.flatnonzero(right_size == q))))
            v = right.totals[rights, first]
            others = [(c, right.totals[rights, c].astype(np.float32)) for c in np.argsort(reach)]
            shifts = products(left, lefts, right, rights, width, int(p), int(q))
            for b in range(0, len(lefts), ROWS):
                i = lefts[b : b + ROWS]
                low, high = np.searchsorted(v, np.nanmin(bounds[first][0][i])), np.searchsorted(v, np.nanmax(bounds[first][1][i]), "right")
                if one:
                    low = max(low, b)
                if low >= high:
                    continue
                met = np.ones((len(i), high - low), dtype=bool)
                if one:
                    met &= np.arange(low, high) > np.arange(b, b + len(i))[:, None]
                for c, w in others:
                    lo, hi = (x[i, None].astype(np.float32) for x in bounds[c])
                    met &= (w[low:high] >= lo) & (w[low:high] <= hi)
                if shifts is not None and met.any():
                    apart = np.maximum(most[0][i, None], most[1][rights[low:high]])
                    some = np.zeros_like(met)
                    for x, y in shifts:
                        some |= ~(x[b : b + ROWS] @ y[low:high].T > apart)
                    met &= some
                x, y = np.nonzero(met)
                yield i[x], rights[low + y]


def close(left: Part, right: Part, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.ones(len(i), dtype=bool)
    for c, (share, floor) in enumerate(rules(left.totals.shape[1])):
        x, y = left.totals[i, c], right.totals[j, c]
        out &= np.abs(x - y) <= np.maximum(np.maximum(x, y) * share, floor)
    return out


def near(left: Part, right: Part, i: np.ndarray, j: np.ndarray, x0: int, y0: int, n: np.ndarray) -> np.ndarray:
    """Whether n values of the timelines from x0 and y0 on differ by at most the share."""
    out = np.zeros(len(i), dtype=bool)
    step = max(1, VALUES // int(n.max(initial=1)))
    for b in range(0, len(i), step):
        e = slice(b, b + step)
        to = np.arange(n[e].max())
        in_both = to < n[e, None]
        x = np.where(in_both, left.values[np.minimum(left.start[i[e], None] + x0 + to, len(left.values) - 1)], 0.0)
        y = np.where(in_both, right.values[np.minimum(right.start[j[e], None] + y0 + to, len(right.values) - 1)], 0.0)
        total = lambda z: np.cumsum(z, axis=1)[:, -1]
        most = np.maximum(total(x), total(y))
        out[e] = (most > 0) & (total(np.abs(x - y)) / most <= SAME_TIMELINE)
    return out


def shifted(left: Part, right: Part, i: np.ndarray, j: np.ndarray, width: int) -> np.ndarray:
    """Whether two timelines are near in some shift, or one of them is empty."""
    out = left.empty[i] | right.empty[j]
    shifts = shifts_of(np.maximum(left.totals[i, 0], right.totals[j, 0]))
    most = np.maximum(left.mass[i], right.mass[j])
    most = SAME_TIMELINE * most * (1 + 1e-6) + left.slack + right.slack
    xs, ys, x_size, y_size = left.sums_at[i], right.sums_at[j], left.size[i], right.size[j]
    for k in sorted(range(-int(shifts.max(initial=0)), int(shifts.max(initial=0)) + 1), key=abs):
        x0, y0 = max(-k, 0), max(k, 0)
        n = np.minimum(x_size - x0, y_size - y0)
        at = np.flatnonzero((n > 0) & (shifts >= abs(k)) & ~out)
        n, x, y, bound = n[at], xs[at] + x0, ys[at] + y0, most[at]
        apart, before = np.zeros(len(at)), left.sums[x] - right.sums[y]
        end = 0
        while len(at) and end < n.max():
            end += width
            cut = np.minimum(end, n)
            now = left.sums[x + cut] - right.sums[y + cut]
            apart += np.abs(now - before)
            stay = apart <= bound
            at, n, x, y, bound, apart, before = (a[stay] for a in (at, n, x, y, bound, apart, now))
        out[at[near(left, right, i[at], j[at], x0, y0, n)]] = True
    return out


def found(left: Part, right: Part, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the same footage."""
    if not left.rows.num_rows or not right.rows.num_rows:
        return
    width = max(1, -(-int(max(left.size.max(), right.size.max())) // STRETCHES))
    with np.errstate(all="ignore"):
        for i, j in near_by_sums(left, right, same, width):
            for b in range(0, len(i), BATCH):
                x, y = i[b : b + BATCH], j[b : b + BATCH]
                ok = shifted(left, right, x, y, width) & close(left, right, x, y)
                if ok.any():
                    yield x[ok], y[ok]


def pairs(rows: pa.Table, same: bool, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns of both signatures of each pair, those of the first under a_, of the other under b_."""
    labels = sorted({x for c in rows["seconds"].chunks for x in c.keys.unique().to_pylist()})
    left, right = (Part(rows.filter(m), labels) for m in (pa.compute.invert(rows["_right"]), rows["_right"]))
    for i, j in found(left, left if same else right, same):
        a, b = left.rows.take(pa.array(i)), (left if same else right).rows.take(pa.array(j))
        both = pa.table([t[c] for t in (a, b) for c in columns], [f"{p}{c}" for p in ("a_", "b_") for c in columns])
        yield from both.combine_chunks().to_batches()
