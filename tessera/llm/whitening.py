"""Embedding whitening from the polarisation covariance.

Method: entries become integers, ``floor(scale * entry)``; each distinct integer
vector is counted once.  With ``n`` of them and sums ``S`` by dimension, the
centred integers ``y = n*x - S`` are exact.  Spark adds up the exact squares of
``y[i]`` for every dimension and of ``y[i] + y[j]`` for every pair; half the
difference of variances, ``(var(i+j) - var(i) - var(j)) / 2``, is the covariance
of ``i`` and ``j``.  The matrix is assembled from whole numbers, rounded once to
double and handed to ``eigh``; rows are projected on its leading eigenvectors.

What runs at scale: one shuffle of packed distinct vectors (two bytes an entry
where they fit), written once; the squares are added up per task (24-bit limbs,
so no sum overflows or rounds) and only sums by (dimension, dimension) are
shuffled.  The driver gets d*(d+1)/2 of them and holds d*d doubles: bounded by
the dimension, not by the rows.

Rows: a null vector, or one with a null or non-finite entry, is dropped.  Vectors
shorter than the longest one count as padded with zeros.  Repeated vectors are
fitted once, and each of their rows is returned.  Components of no variance (a
single distinct vector, or fewer than ``components`` independent directions)
have null ``whitened``; ``explained`` is null if there is no variance at all and
``identity_error`` covers the components with variance.  Very long vectors cost
d*d/2 sums each.  Entries beyond the range of 64-bit integers count as its ends.
An empty table gives no rows.  Only the id and the vector are read, so other
columns clash with nothing; null and repeated ids are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.storage import materialise

SCALE, COMPONENTS = 256, 4
CELLS = 1 << 17  # entries of a slice of rows
LIMB = 24
WIDE = Context(prec=60)
EXACT = T.DecimalType(38, 0)


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def quantise(col: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows that hold a finite vector, and the integer vector of each."""
    lists = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    flat = pc.list_flatten(lists)
    c = pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False)  # a null entry becomes NaN
    ends = np.cumsum(sizes)
    bad = np.append(0, np.cumsum(~np.isfinite(c)))
    ok = np.asarray(pc.is_valid(lists)) & (bad[ends] == bad[ends - sizes])
    with np.errstate(invalid="ignore", over="ignore"):
        f = np.floor(c * scale)
        x = np.where(np.abs(f) < 2.0**63, f, 0).astype(np.int64)
        x[f >= 2.0**63] = np.iinfo(np.int64).max
        x[f <= -(2.0**63)] = np.iinfo(np.int64).min + 1
    rows = np.flatnonzero(ok)
    return rows, [x[ends[r] - sizes[r]:ends[r]] for r in rows]


def pack(x: np.ndarray) -> bytes:
    """One vector as bytes: no zeros at the end, two bytes an entry if they fit, else eight, the width behind."""
    used = np.flatnonzero(x)
    x = x[:used[-1] + 1] if len(used) else x[:0]
    small = not len(x) or (x.min() >= -32768 and x.max() <= 32767)
    return x.astype("<i2" if small else "<i8").tobytes() + (b"\2" if small else b"\x08")


def unpack(values: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors as rows of ``dim`` integers."""
    out = np.zeros((len(values), dim), np.int64)
    for r, v in enumerate(values):
        x = np.frombuffer(v, "<i2" if v[-1] == 2 else "<i8", count=(len(v) - 1) // v[-1])
        out[r, :len(x)] = x
    return out


def _slices(values: list, dim: int) -> Iterator[list]:
    step = min(4096, max(1, CELLS // max(dim, 1)))
    return (values[i:i + step] for i in range(0, len(values), step))


def centred(x: np.ndarray, n: int, sums: list[int], top: int) -> np.ndarray:
    """``n*x - sums``: 64-bit integers where twice the result surely fits, else Python integers."""
    if n * top + max(map(abs, sums), default=0) < 1 << 61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def square_sums(y: np.ndarray, bits: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(i, shift, sums): for j = i, i+1, ... the part at ``shift`` of the sum of squares of y[i] (j = i) or y[i] + y[j]."""
    dim = y.shape[1]
    for i in range(dim):
        t = y[:, i:] + y[:, i:i + 1]
        t[:, 0] = y[:, i]
        if y.dtype == object:
            total = (t * t).sum(0)
            for k in range(3):
                part = total >> 90 * k if k == 2 else (total >> 90 * k) & ((1 << 90) - 1)
                yield i, 90 * k, part
            continue
        limbs = []
        for _ in range(-(-(bits + 1) // LIMB) - 1):
            limbs.append(t & ((1 << LIMB) - 1))
            t = t >> LIMB
        limbs.append(t)  # the highest limb has the sign
        for p in range(2 * len(limbs) - 1):
            part = np.zeros(dim - i, np.int64)
            for a in range(max(0, p - len(limbs) + 1), p // 2 + 1):
                s = np.einsum("rj,rj->j", limbs[a], limbs[p - a])
                part += s if 2 * a == p else 2 * s
            yield i, LIMB * p, part


def _distinct(vectors: DataFrame, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = quantise(batch.column(0), scale)[1]
            yield pa.RecordBatch.from_arrays([pa.array([pack(v) for v in x], pa.binary()), pa.array([len(v) for v in x], pa.int32())], names=["x", "d"])

    packed = vectors.select("embedding").mapInArrow(run, "x binary, d int")
    return materialise(packed.groupBy("x").agg(F.max("d").alias("d")), "vectors")


def _moments(fit: DataFrame, dim: int) -> tuple[list[int], int]:
    """Exact sums of the dimensions and the largest absolute entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, top = np.zeros(dim, np.int64), np.zeros(dim, np.int64), 0
        for batch in batches:
            for part in _slices(batch.column(0).to_pylist(), dim):
                x = unpack(part, dim)
                low += (x & 0xFFFFFFFF).sum(0)
                high += (x >> 32).sum(0)
                top = max(top, int(np.abs(x).max(initial=0)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dim), pa.int32()), _decimals([(int(h) << 32) + int(v) for h, v in zip(high, low)]), pa.array([top] * dim, pa.int64())],
            names=["i", "s", "top"])

    rows = fit.select("x").mapInArrow(run, "i int, s decimal(38,0), top long").groupBy("i").agg(
        F.sum("s").alias("s"), F.max("top").alias("top")).collect()
    sums = {r["i"]: int(r["s"]) for r in rows}
    return [sums[i] for i in range(dim)], max((r["top"] for r in rows), default=0)


def _squares(fit: DataFrame, dim: int, n: int, sums: list[int], top: int) -> dict[tuple[int, int], int]:
    """Exact sums of squares of the centred dimensions (i, i) and pair sums (i, j)."""
    bits = (n * top + max(map(abs, sums), default=0)).bit_length() + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}  # shift -> sums by pair, kept as high and low halves
        for batch in batches:
            for part in _slices(batch.column(0).to_pylist(), dim):
                for i, shift, s in square_sums(centred(unpack(part, dim), n, sums, top), bits):
                    if shift not in found:
                        found[shift] = np.zeros((2, dim, dim), object if s.dtype == object else np.int64)
                    half = found[shift]
                    half[0, i, i:] += s >> 32
                    half[1, i, i:] += s & 0xFFFFFFFF
        i, j = np.triu_indices(dim)
        for shift, half in found.items():
            values = [(int(h) << 32) + int(v) for h, v in zip(half[0, i, j], half[1, i, j])]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([shift] * len(i), pa.int32()), _decimals(values)],
                                             names=["i", "j", "shift", "s"])

    rows = fit.select("x").mapInArrow(run, "i int, j int, shift int, s decimal(38,0)").groupBy("i", "j", "shift").agg(F.sum("s").alias("s")).toArrow()
    out: dict[tuple[int, int], int] = {}
    for i, j, shift, s in zip(*(rows[c].to_pylist() for c in ("i", "j", "shift", "s"))):
        out[i, j] = out.get((i, j), 0) + (int(s) << shift)
    return out


def covariance(squares: dict[tuple[int, int], int], dim: int, n: int) -> np.ndarray:
    """Covariance of x from exact sums of squares, each entry rounded once."""
    v = np.zeros((dim, dim))
    for (i, j), q in squares.items():
        both = 2 * q if i == j else q - squares[i, i] - squares[j, j]
        v[i, j] = v[j, i] = both / (2 * n**3)
    return v


def fit(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> dict:
    """The model: n, sums, covariance, leading components (columns of ``axes``) and their eigenvalues."""
    xs = _distinct(vectors, scale)
    head = xs.agg(F.count("*").alias("n"), F.max("d").alias("d")).first()
    n, dim = head["n"], head["d"] or 0
    if not dim:
        return {"n": n, "dim": 0, "sums": [], "top": 0, "axes": np.zeros((0, 0)), "values": np.zeros(0), "trace": 0.0, "cov": np.zeros((0, 0)), "xs": xs}
    sums, top = _moments(xs, dim)
    cov = covariance(_squares(xs, dim, n, sums, top), dim, n)
    values, axes = np.linalg.eigh(cov)
    lead = np.argsort(values)[::-1][:components]
    return {"n": n, "dim": dim, "sums": sums, "top": top, "axes": axes[:, lead], "values": values[lead], "trace": float(np.trace(cov)), "cov": cov, "xs": xs}


def _projector(model: dict):
    """Integer rows -> whitened coordinates (NaN for components of no variance) and centred integers."""
    n, sums, top, values = model["n"], model["sums"], model["top"], model["values"]
    live = values > max(values.max(initial=0.0) * len(sums) * 1e-15, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        axes = np.where(live, model["axes"] / np.sqrt(np.where(live, values, 1.0)), np.nan)

    def run(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Rows outside the fit list do not occur, so ``top`` bounds them too.
        y = centred(x, n, sums, top)
        return (y / n).astype(np.float64) @ axes, y
    return run, live


def identity_error(model: dict) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured on the list."""
    project, live = _projector(model)
    at = np.flatnonzero(live)
    if not len(at):
        return None
    dim, names = model["dim"], [f"w{k}" for k in at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch.column(0).to_pylist(), dim):
                w = project(unpack(part, dim))[0]
                yield pa.RecordBatch.from_arrays([pa.array(w[:, k], pa.float64()) for k in at], names=names)

    pairs = [(a, b) for a in names for b in names if a <= b]
    row = model["xs"].select("x").mapInArrow(run, ", ".join(f"{c} double" for c in names)).agg(
        *[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs]).first()
    return max(abs(row[f"{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE) -> DataFrame:
    """One row for each kept vector and component: id, ``component`` (from 1), ``n``, ``deviation`` (exact decimal, null
    beyond 38 digits), ``whitened``, ``explained``, ``identity_error``."""
    src = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    model = fit(src, components, scale)
    error = identity_error(model)
    project, live = _projector(model)
    xs = model.pop("xs")
    sent = xs.sparkSession.sparkContext.broadcast({**model, "error": error, "live": live})
    schema = T.StructType([src.schema["vec_id"], T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("deviation", EXACT), T.StructField("whitened", T.DoubleType()),
                           T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        dim, k = m["dim"], len(m["values"])
        put, alive = _projector(m)
        for batch in batches:
            rows, vectors_ = quantise(batch.column(1), scale)
            for part in _slices(list(zip(rows, vectors_)), dim):
                if not k:
                    continue
                x = np.zeros((len(part), dim), np.int64)
                for r, (_, v) in enumerate(part):
                    x[r, :len(v)] = v
                w, y = put(x)
                wide = y.dtype == object or float(np.abs(y).max(initial=0)) ** 2 * dim >= 2.0**62
                dev = ((y.astype(object) if wide else y) ** 2).sum(1)
                exact = [None if abs(int(v)) >= 10**38 else WIDE.create_decimal(int(v)) for v in dev]
                ids = batch.column(0).take(pa.array(np.repeat([r for r, _ in part], k), pa.int64()))
                share = m["values"] / m["trace"] if m["trace"] > 0 else np.full(k, np.nan)
                null = lambda a: pa.array(a, pa.float64(), mask=~np.isfinite(a))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))), pa.array([m["n"]] * (k * len(part)), pa.int64()),
                     pa.array(exact, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(part)), k))), null(w.ravel()),
                     null(np.tile(share, len(part))), pa.array([m["error"]] * (k * len(part)), pa.float64())], names=schema.names)

    return src.mapInArrow(run, schema)
