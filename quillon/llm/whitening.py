"""Whitening of embeddings by the singular values of their centred, distributed rows.

Entries become integers, so sums, centred rows and deviations are exact: a row is centred as n x - S and
divided by n once. `RowMatrix.computeSVD` over the centred rows gives the components; a singular value
squared and divided by n is the variance along one. Total variance doesn't come from the singular values
but from the rows' exact deviations. The driver holds numbers by dimension only: the sums, and the
components (dimensions times components, and the Gram matrix of `computeSVD`, dimensions squared).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.storage import cut

#: An entry c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: A scaled entry from here on has no exact long.
_LARGEST = float(1 << 62)
#: Singular values below this share of the largest are rounding, not variance.
RESOLUTION = 1e-7


@dataclass(frozen=True)
class Whitening:
    """Rows fitted on, sums by dimension, components (a column each), their variances, the total variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors, all of one length, as integers."""
    for batch in batches:
        if batch.num_rows:
            vectors = batch.column(batch.schema.get_field_index("v"))
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield batch, np.floor(SCALE * flat).astype(np.int64).reshape(batch.num_rows, -1) + SHIFT


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per dimension for the whole partition: rows, exact sum, least and largest value."""
    n, sums, low, high = 0, None, None, None
    for _, x in _rows(batches):
        least, most = x.min(axis=0), x.max(axis=0)
        safe = max(abs(int(least.min())), abs(int(most.max()))) < (1 << 62) // max(len(x), 1)
        own = np.array((x if safe else x.astype(object)).sum(axis=0).tolist(), dtype=object)
        n, sums = n + len(x), own if sums is None else sums + own
        low, high = least if low is None else np.minimum(low, least), most if high is None else np.maximum(high, most)
    if sums is not None:
        d = len(sums)
        columns = [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0)), pa.array(low), pa.array(high)]
        yield pa.RecordBatch.from_arrays(columns, names=["dim", "n", "s", "low", "high"])


def _center(n: int, sums: list[int], wide: bool):  # noqa: ANN202
    """For mapInArrow: (vec_id, deviation, spread, z), z being the centred vector and spread the deviation as a double.

    `wide` asks for numbers of any length, where 64 bits might not hold n x - S or the sum of its squares.
    """
    short = np.array([0 if wide else s for s in sums], dtype=np.int64)
    long = np.array(sums, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _rows(batches):
            y = x.astype(object) * n - long if wide else x * np.int64(n) - short  # 64 bits may wrap on the way, the difference fits
            deviation = (y * y).sum(axis=1)
            fits = [int(v) if -(1 << 63) <= int(v) < 1 << 63 else None for v in deviation] if wide else deviation
            z = y.astype(np.float64) / n
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fits, pa.int64()), pa.array(deviation.astype(np.float64)), lists], names=["vec_id", "deviation", "spread", "z"])

    return run


def _project(matrix: np.ndarray):  # noqa: ANN202
    """For mapInArrow: z becomes w, its projections; the other columns pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = batch.column(batch.schema.get_field_index("z")).flatten().to_numpy().reshape(batch.num_rows, -1)
                w = z @ matrix
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["vec_id", "deviation", "w"])

    return run


def usable(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows whose vector is neither null nor holds a null, NaN or infinite entry.

    Entries beyond 2 ** 56, which have no exact scaled integer, count as infinite. Empty vectors, and those of
    another length than most (ties: the longer), have no place among the others and go as well.
    """
    v = F.col(f"`{column}`").cast("array<double>")
    good = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c * SCALE) < _LARGEST), F.lit(False)))
    rows = embeddings.select(F.col("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & good)
    # A row per length: the driver reads the first.
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == (length[0]["d"] if length else 0))


def _gram(rows: DataFrame, column: str) -> np.ndarray:
    """The sum of outer products of the vectors in an array column, added up over a tree of tasks."""
    return RowMatrix(_vectors(rows, column)).computeGramianMatrix().toArray()


def _vectors(rows: DataFrame, column: str) -> DataFrame:
    return MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")


def fit(embeddings: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> tuple[Whitening, DataFrame] | None:
    """The whitening of all usable rows, and their centred rows (vec_id, deviation, spread, z), written; None if there is no row."""
    rows = usable(embeddings, column)
    found = rows.mapInArrow(_sum_up, "dim int, n long, s decimal(38,0), low long, high long")
    told = found.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").collect()
    if not told:
        return None
    n, sums = told[0]["n"], [int(r["s"]) for r in told]
    most = max(max(abs(n * r["low"] - s), abs(n * r["high"] - s)) for r, s in zip(told, sums, strict=True))
    wide = most * most * len(sums) >= 1 << 63
    kind = rows.schema["vec_id"].dataType.simpleString()
    centred = cut(rows.mapInArrow(_center(n, sums, wide), f"vec_id {kind}, deviation long, spread double, z array<double>"), "centred")
    total = float(centred.agg(F.sum("spread")).first()[0]) / n**3  # deviations are n ** 2 times squared distances
    svd = RowMatrix(_vectors(centred, "z"), n, len(sums)).computeSVD(min(components, len(sums)), False, RESOLUTION)
    values = svd.s.toArray()
    real = values > max(float(values.max(initial=0.0)) * RESOLUTION, 0.0)
    return Whitening(n, sums, svd.V.toArray()[:, : len(values)][:, real], values[real] ** 2 / n, total), centred


def _whitened(model: Whitening, centred: DataFrame) -> DataFrame:
    kind = centred.schema["vec_id"].dataType.simpleString()
    return centred.select("vec_id", "deviation", "z").mapInArrow(_project(model.components / np.sqrt(model.variances)), f"vec_id {kind}, deviation long, w array<double>")


def identity_error(whitened: DataFrame, n: int, column: str = "w") -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity; rows are centred by their mean first."""
    mean = whitened.select(vector_to_array(Summarizer.mean(array_to_vector(column))).alias("m")).first()["m"]
    own = F.array(*[F.lit(float(m)) for m in mean])
    moved = whitened.select(F.zip_with(column, own, lambda a, b: a - b).alias("w"))
    return float(np.abs(_gram(moved, "w") / n - np.eye(len(mean))).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """(vec_id, deviation, whitened array, n, explained array, identity_error) of every usable row.

    Components come by falling variance, `components` of them at most, fewer where rows vary in fewer directions
    (a direction without variance can't have variance 1; below RESOLUTION of the largest singular value there is
    rounding only): with no row, one row or equal rows there are none and the table is empty. Rows are dropped as in
    `usable`; null and repeated vec_ids stay, equal vectors get equal values up to rounding, other columns are left
    out. `deviation` is null where it doesn't fit a long.
    """
    fitted = fit(embeddings, components, column)
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    names = f"vec_id {kind}, deviation long, whitened array<double>, n long, explained array<double>, identity_error double"
    if fitted is None or not len(fitted[0].variances):
        return embeddings.sparkSession.createDataFrame([], names)
    model, centred = fitted
    white = _whitened(model, centred)
    shares = F.array(*[F.lit(float(e / model.total)) for e in model.variances])
    return white.select("vec_id", "deviation", F.col("w").alias("whitened"), F.lit(model.n).cast("long").alias("n"), shares.alias("explained"), F.lit(identity_error(white, model.n)).alias("identity_error"))


def whitening_digest(embeddings: DataFrame) -> DataFrame:
    """The contract's columns, a row per usable row and component; odd input as in `whiten`."""
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("p", "c")
    return whiten(embeddings).select("vec_id", "n", "deviation", "identity_error", pairs).select(
        "vec_id", (F.col("p") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error"
    )
