"""What an id's rows tell of each of them, all frames in one pass over Arrow batches.

Spark's sliding frames are added up anew for every row and each frame apart. Here rows lie by id and date, and a
frame's k-th row is the same column moved by k, so sums of all rows go side by side. The steps and their order
are those of Spark's aggregates (`windows` has the same as columns), so results are equal to the last bit. A
task holds a batch, the rows before it that frames reach, and those that wait for the rows after them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.operators.windows import MIN_ROWS, VOL_EPS, VOL_FLOOR

#: Rows of a momentum's deviation at least.
VOL_ROWS = 20
#: Rows of the autocorrelation, and values it needs.
AUTO_ROWS, AUTO_LEAST = 21, 10


class _Rows:
    """Returns of rows by id and date: values, which are there, and each row's place from the start and the end of its id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, there: np.ndarray):
        n = len(x)
        edges = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1], True]) if n else np.zeros(1, np.int64)
        length = np.diff(edges)
        self.x, self.there = x, there
        self.place = np.arange(n) - np.repeat(edges[:-1], length)
        self.left = np.repeat(length, length) - 1 - self.place

    def back(self, v: np.ndarray, k: int, fill: float = 0.0) -> np.ndarray:
        """Each row's value k rows before, whatever id that is of."""
        return np.concatenate([np.full(min(k, len(v)), fill, v.dtype), v[: max(0, len(v) - k)]]) if k else v

    def behind(self, k: int) -> np.ndarray:
        """Whether the row k before is of the same id and has a return."""
        return (self.place >= k) & self.back(self.there, k, False)

    def total(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sum and number of the n returns before each row."""
        total, count = np.zeros(len(self.x)), np.zeros(len(self.x), np.int64)
        for k in range(n, 0, -1):
            on = self.behind(k)
            total += np.where(on, self.back(self.x, k), 0.0)
            count += on
        return total, count

    def spread(self, n: int, last: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Sample deviation and number of the n returns up to the row `last` before each; NaN below two."""
        mean, squares, count = (np.zeros(len(self.x)) for _ in range(3))
        for k in range(n - 1 + last, last - 1, -1):
            on = self.behind(k)
            count += on
            off = np.where(on, self.back(self.x, k) - mean, 0.0)
            step = off / np.maximum(count, 1.0)
            mean += step
            squares += off * (off - step)
        return _root(squares, count), count

    def correlation(self, n: int) -> np.ndarray:
        """Correlation of the last n - 1 returns with those a row before; NaN where there is none."""
        a, b = np.zeros(len(self.x)), np.zeros(len(self.x))
        aa, bb, ab, count = (np.zeros(len(self.x)) for _ in range(4))
        for k in range(n - 2, -1, -1):
            on = self.behind(k) & self.behind(k + 1)
            count += on
            some = np.maximum(count, 1.0)
            u, v = self.back(self.x, k), self.back(self.x, k + 1)
            off_a, off_b = np.where(on, u - a, 0.0), np.where(on, v - b, 0.0)
            step_a, step_b = off_a / some, off_b / some
            a += step_a
            b += step_b
            ab += np.where(on, off_a * (v - b), 0.0)
            aa += off_a * (off_a - step_a)
            bb += off_b * (off_b - step_b)
        both = _root(aa, count) * _root(bb, count)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where((count > 1) & (both != 0), ab / (count - 1) / both, np.nan)

    def forward(self, horizons: Sequence[int]) -> dict[int, np.ndarray]:
        """Compound return of the next h rows for each h, a missing one as 0; NaN if there are fewer."""
        grown, out = np.ones(len(self.x)), {}
        step = 1 + np.where(self.there, self.x, 0.0)
        for k in range(1, max(horizons, default=0) + 1):
            ahead = np.concatenate([step[k:], np.ones(min(k, len(step)))])
            grown = grown * np.where(self.left >= k, ahead, 1.0)
            if k in horizons:
                out[k] = np.where(self.left >= k, grown - 1, np.nan)
        return out


def _root(squares: np.ndarray, count: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(count > 1, np.sqrt(squares / (count - 1)), np.nan)


def _told(rows: _Rows, windows: Sequence[int], horizons: Sequence[int]) -> dict[str, pa.Array]:
    """The new columns of rows."""
    own, seen = rows.spread(VOL_ROWS)
    spread = {n: rows.spread(n, 1) for n in dict.fromkeys(max(VOL_ROWS, w) for w in windows)}
    out = {}
    for w in windows:
        (total, count), (sd, of) = rows.total(w), spread[max(VOL_ROWS, w)]
        sd = np.where((of >= MIN_ROWS) & ~((of < 2) | (sd < VOL_FLOOR)), sd, VOL_FLOOR)
        out[f"mom_w{w}"] = pa.array(total / (sd + VOL_EPS), pa.float64(), mask=count < MIN_ROWS)
    out["ret_vol20"] = pa.array(np.where(seen >= MIN_ROWS, own, 0.0), pa.float64())
    values = sum((rows.behind(k).astype(np.int64) for k in range(AUTO_ROWS)), np.zeros(len(rows.x), np.int64))
    r = rows.correlation(AUTO_ROWS)
    out["ret_autocorr"] = pa.array(np.where((values >= AUTO_LEAST) & ~np.isnan(r), r, 0.0), pa.float64())
    ahead = rows.forward(horizons)
    return out | {f"y_h{h}": pa.array(ahead[h], pa.float64(), mask=rows.left < h) for h in horizons}


def own_features(active: DataFrame, windows: Sequence[int], horizons: Sequence[int]) -> DataFrame:
    """`active` with mom_w*, ret_vol20, ret_autocorr and y_h* of each id's rows in order of date."""
    before, after = max([VOL_ROWS, AUTO_ROWS, *windows]), max(horizons, default=0)
    names = [*(f"mom_w{w}" for w in windows), "ret_vol20", "ret_autocorr", *(f"y_h{h}" for h in horizons)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        done = 0

        def told(table: pa.Table, final: bool) -> tuple[pa.RecordBatch | None, int]:
            codes = table.column("id").combine_chunks().dictionary_encode()
            codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
            ids, ret = codes.indices.to_numpy(zero_copy_only=False), table.column("ret").combine_chunks().cast(pa.float64())
            ret = ret.chunk(0) if isinstance(ret, pa.ChunkedArray) else ret
            there = ret.is_valid().to_numpy(zero_copy_only=False)
            rows = _Rows(ids, ret.fill_null(0.0).to_numpy(zero_copy_only=False), there)
            end = len(ids) if final else int(max(done, len(ids) - min(after, rows.place[-1] + 1)))
            made = table.slice(done, end - done)
            for name, column in _told(rows, windows, horizons).items():
                made = made.append_column(name, column.slice(done, end - done))
            return made.combine_chunks(), end

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            made, end = told(held, False)
            yield from made.to_batches()
            # Frames of the rows that wait reach `before` rows back.
            kept = max(0, end - before)
            held, done = held.slice(kept), end - kept
        if held is not None and held.num_rows > done:
            yield from told(held, True)[0].to_batches()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in active.schema), *(f"{n} double" for n in names)])
    return active.repartition("id").sortWithinPartitions("id", "date").mapInArrow(work, schema)
