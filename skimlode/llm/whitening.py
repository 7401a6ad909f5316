"""Whitening of embeddings: singular values, vectors and means of partitions, merged along a tree.

A task keeps what a decomposition of its centred rows gives, in all dimensions. Two such states are merged by another
decomposition: of both sets of scaled vectors and one row for the difference of their means, so nothing is lost and no
product of rows is formed. A state holds dimension squared numbers at most, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Steps of a unit, components of a result, states that are merged at once, and cells of vectors that are held at once.
UNIT, COMPONENTS, MERGED, CELLS = 256, 4, 8, 1 << 21
#: A component whose singular value is no more than this share of the largest one has no variance.
NO_VARIANCE = 1e-12
_STATE = "node long, n long, sums array<decimal(38,0)>, values binary, vectors binary"


@dataclass
class State:
    """n rows, their exact sums, and singular values and right vectors of the centred rows."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> State:
        safe = len(x) * max(abs(int(x.min())), abs(int(x.max()))) < 1 << 62
        sums = [int(s) for s in (x if safe else x.astype(object)).sum(axis=0)]
        return cls(len(x), sums, *_decomposed(x - _mean(sums, len(x))))

    def merged(self, other: State) -> State:
        """Both together: the last row is what the difference of their means adds to the sums of squares."""
        scale = float(self.n) * other.n * (self.n + other.n)
        shift = np.array([float(a * other.n - b * self.n) for a, b in zip(self.sums, other.sums)]) / np.sqrt(scale)
        rows = np.vstack((self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, shift[None]))
        return State(self.n + other.n, [a + b for a, b in zip(self.sums, other.sums)], *_decomposed(rows))

    def batch(self, node: int) -> pa.RecordBatch:
        sums = pa.array([[Decimal(s) for s in self.sums]], pa.list_(pa.decimal128(38, 0)))
        ids = (pa.array([node], pa.int64()), pa.array([self.n], pa.int64()))
        return pa.RecordBatch.from_arrays([*ids, sums, pa.array([self.values.tobytes()], pa.binary()), pa.array([self.vectors.tobytes()], pa.binary())], ["node", "n", "sums", "values", "vectors"])

    @classmethod
    def read(cls, n: int, sums: list[Decimal], values: bytes, vectors: bytes) -> State:
        return cls(n, [int(s) for s in sums], np.frombuffer(values), np.frombuffer(vectors).reshape(-1, len(sums)))


def _mean(sums: list[int], n: int) -> np.ndarray:
    return np.array([float(Fraction(s, n)) for s in sums])


def _decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, values, vectors = np.linalg.svd(rows, full_matrices=False)
    return values, vectors


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of lists of one length."""
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def _slices(b: pa.RecordBatch, column: int, dims: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CELLS // dims)
    for lo in range(0, b.num_rows, step):
        yield b.slice(lo, step)


def _leaf(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state: State | None = None
        for b in batches:
            for part in _slices(b, 0, dims):
                own = State.of(_matrix(part.column(0)))
                state = own if state is None else state.merged(own)
        if state is not None:
            yield state.batch(TaskContext.get().partitionId())

    return common.releasing(run)


def _united(key, table: pa.Table) -> pa.Table:
    state: State | None = None
    for r in sorted(table.to_pylist(), key=lambda r: r["at"]):
        own = State.read(r["n"], r["sums"], r["values"], r["vectors"])
        state = own if state is None else state.merged(own)
    return pa.Table.from_batches([state.batch(key[0].as_py())])


@dataclass
class Whitening:
    """What transform() needs: n and sums of the fit list, components by falling eigenvalue, their total, and the error that was measured."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    eigenvalues: np.ndarray
    total: float
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return _mean(self.sums, self.n)

    @property
    def scales(self) -> np.ndarray:
        """What a projection is multiplied with; NaN for components without variance."""
        least = NO_VARIANCE**2 * self.eigenvalues[:1].sum()
        return np.array([1 / np.sqrt(e) if e > least else np.nan for e in self.eigenvalues])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors.T * self.scales


def _usable(c):
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def steps(vectors: DataFrame, vector_col: str = "embedding", unit: int = UNIT, to: str = "x") -> DataFrame:
    """All columns and the vector in whole steps, floor(unit * entry): of rows whose vector is neither null nor empty and has finite entries only."""
    name = common.fresh(vectors, to)
    ok = vectors[vector_col].isNotNull() & (F.size(vectors[vector_col]) > 0) & F.forall(vectors[vector_col], _usable)
    return vectors.where(ok).withColumn(name, F.transform(vectors[vector_col], lambda c: F.floor(c.cast("double") * unit).cast("long")))


def fit(vectors: DataFrame, components: int | None = COMPONENTS, vector_col: str = "embedding", unit: int = UNIT) -> Whitening | None:
    """Fitted to each distinct vector of steps once; None if there is none.

    Vectors of a length other than the most frequent one among the distinct ones (of ties the largest) are left out.
    components: how many to keep (None: all). Every dimension takes part in every merge. The largest entry of a
    component is positive. The driver gets one state: the square of the dimension in numbers.
    """
    raw = steps(vectors, vector_col, unit)
    distinct = common.stored(raw.select(F.col(raw.columns[-1]).alias("x")).distinct(), "distinct")
    sizes = distinct.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if sizes is None:
        return None
    dims = sizes.dims
    rows = distinct.where(F.size("x") == dims)
    states, left = rows.mapInArrow(_leaf(dims), _STATE), rows.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // MERGED)
        states = states.withColumn("at", F.col("node")).withColumn("node", F.lit(0).cast("long") if left <= 1 else F.floor(F.col("node") / MERGED)).groupBy("node").applyInArrow(common.releasing_group(_united), _STATE)
    r = states.first()
    state = State.read(r.n, r.sums, bytes(r["values"]), bytes(r.vectors))
    full = np.zeros((dims, dims))  # fewer rows than dimensions leave some without variance
    full[: len(state.vectors)] = state.vectors
    e = np.zeros(dims)
    e[: len(state.values)] = state.values**2 / state.n
    for v in full:
        v *= 1 if v[np.abs(v).argmax()] >= 0 else -1
    keep = dims if components is None else min(components, dims)
    model = Whitening(state.n, state.sums, full[:keep], e[:keep], float(e.sum()))
    model.identity_error = _identity_error(rows, model)
    return model


def _identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """The largest entry by which the covariance of whitened vectors differs from the identity, over components with variance."""
    known = np.flatnonzero(~np.isnan(model.scales)).tolist()
    if not known:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b, 0, len(model.sums)):
                w = model.project(_matrix(part.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in known], [f"w{k}" for k in known])

    white = rows.mapInArrow(run, ", ".join(f"w{k} double" for k in known))
    entries = [(i, j) for i in known for j in known if i <= j]
    found = white.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in entries]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, entries))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over dimensions of (n * x - sum) ** 2, exact; None where they don't fit into 64 bits."""
    about = ((n * x.astype(float) - np.array([float(s) for s in sums])) ** 2).sum(axis=1)
    out: list[int | None] = [None] * len(x)
    small = about < 2.0**62.5 if max((abs(s) for s in sums), default=0) < 1 << 62 else np.zeros(len(x), bool)
    small &= np.abs(x.astype(float)).max(axis=1) * n < 2.0**62
    at = np.flatnonzero(small)
    for k, v in zip(at.tolist(), ((n * x[at] - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist() if len(at) else ()):
        out[k] = v
    for k in np.flatnonzero(~small & (about < 2.0**63.5)).tolist():
        exact = sum((n * int(c) - s) ** 2 for c, s in zip(x[k], sums))
        out[k] = exact if exact < 1 << 63 else None
    return out


def transform(vectors: DataFrame, model: Whitening | None, vector_col: str = "embedding", unit: int = UNIT) -> DataFrame:
    """All columns of the usable rows, and deviation and whitened (an array, a component each; null where it has no variance).

    Rows whose vector is null, empty, of another length than fitted or holds null or non-finite entries go. deviation is
    the sum over dimensions of (n * x - sum) ** 2, null beyond 64 bits. Repeated rows give the same; columns of these
    names are replaced. Entries from 2^55 on count as Spark's floor() to long gives them.
    """
    kept = vectors.drop("deviation", "whitened")
    schema = T.StructType([*kept.schema.fields, T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    raw = steps(vectors, vector_col, unit)
    raw = raw.where(F.size(raw.columns[-1]) == len(model.sums)).select(*kept.columns, raw.columns[-1])
    width = len(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b, width, len(model.sums)):
                x = _matrix(part.column(width))
                white = model.project(x)
                flat = pa.array(white.ravel(), from_pandas=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(_deviations(x, model.n, model.sums), pa.int64()), lists], [*part.schema.names[:width], "deviation", "whitened"])

    return raw.mapInArrow(common.releasing(run), schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = fit(vectors)
    rows = transform(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    n, total, e = (model.n, model.total, model.eigenvalues.tolist()) if model else (0, 0.0, [])
    shares = F.array(*[F.lit(v / total if total else None).cast("double") for v in e]).cast("array<double>")
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )


QUERIES = {"op12_whitening": op12_whitening}
ORACLES: dict[str, str] = {}
