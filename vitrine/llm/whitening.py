"""Embedding whitening by QDWH spectral divide-and-conquer.

Entries become integers, x = floor(scale * c) + shift, so counts, sums and
second moments are exact whatever order tasks finish in. Two passes fit: the
first takes n and the sums S, the second the products of the entries centred by
the whole part of the mean (small integers, multiplied exactly as doubles); the
part below one unit is taken out of the sums exactly, so each entry of the
covariance V is rounded once.

V has one row per dimension and is diagonalised on the driver without an
eigensolver. The QDWH iteration (QR based where ill-conditioned, Cholesky
where not) gives the orthogonal polar factor U of V - shift * I; (I + U) / 2
projects on the invariant subspace above the shift. Orthonormal bases of both
subspaces split V in two, and both parts are split again, the upper one first,
until the components asked for are single vectors. The components, at most
``top`` by dimensions, are then broadcast and every vector is projected.

Defined results: rows whose vector is null, empty or holds null or non-finite
entries are dropped; so are rows whose length is not the commonest one (the
shorter of two equally common); null ids and repeated rows count each for
itself; an eigenvalue that is zero to rounding has no whitened component and
gives no rows; an empty table gives an empty result; an entry whose x doesn't
fit 2 ** 53 is an error; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import stash

TOP, SCALE, SHIFT = 8, 1024, 100_000
EPS = float(np.finfo(float).eps)


# ------------------------------------------------- QDWH divide-and-conquer
def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by the QDWH iteration:
    dynamically weighted Halley steps, for which ``low`` bounds the smallest
    singular value from below. Singular values of zero count as rounding."""
    d = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    low, eye = EPS, np.eye(d)
    for _ in range(40):
        l2 = low * low
        dd = (4 * (1 - l2) / (l2 * l2)) ** (1 / 3)
        root = math.sqrt(1 + dd)
        wa = root + 0.5 * math.sqrt(8 - 4 * dd + 8 * (2 - l2) / (l2 * root))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        before = x
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([math.sqrt(wc) * x, eye]))
            x = (wb / wc) * x + (wa - wb / wc) / math.sqrt(wc) * (q[:d] @ q[d:].T)
        else:
            z = np.linalg.cholesky(eye + wc * (x.T @ x))
            x = (wb / wc) * x + (wa - wb / wc) * np.linalg.solve(z.T, np.linalg.solve(z, x.T)).T
        x = (x + x.T) / 2
        low = min(1.0, low * (wa + wb * l2) / (1 + wc * l2))
        if abs(1 - low) < 10 * EPS and np.linalg.norm(x - before) < 10 * EPS ** (1 / 3):
            break
    return x


def _basis(projector: np.ndarray, rank: int, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal basis of the range of a projector, by subspace iteration."""
    q = rng.standard_normal((len(projector), rank))
    for _ in range(3):
        q, _ = np.linalg.qr(projector @ q)
    return q


def _split(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of two invariant subspaces, the one of larger eigenvalues first;
    None if no shift parts the eigenvalues (all are one value to rounding)."""
    d, size = len(a), np.linalg.norm(a)
    diagonal = np.sort(np.diag(a))
    spread = np.linalg.norm(a - np.eye(d) * diagonal.mean())
    if spread <= 4 * EPS * max(size, np.finfo(float).tiny):
        return None
    # the mean lies strictly between the extreme eigenvalues; the median halves better
    for shift in (float(np.median(diagonal)), float(diagonal.mean()), float(diagonal.mean() + spread / (2 * d)), float(diagonal.mean() - spread / (2 * d))):
        u = polar(a - shift * np.eye(d))
        above = (np.eye(d) + u) / 2
        rank = int(round(float(np.trace(above))))
        if not 0 < rank < d:
            continue
        both, _ = np.linalg.qr(np.hstack([_basis(above, rank, rng), _basis(np.eye(d) - above, d - rank, rng)]))
        return both[:, :rank], both[:, rank:]
    return None


def eigen(v: np.ndarray, top: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` largest eigenvalues of a symmetric matrix, falling, and
    their unit eigenvectors as columns."""
    rng, out = np.random.default_rng(seed), []
    todo = [np.eye(len(v))]
    while todo and len(out) < top:
        basis = todo.pop()
        part = basis.T @ v @ basis
        part = (part + part.T) / 2
        halves = _split(part, rng) if len(part) > 1 else None
        if halves is None:
            out += [basis[:, i] for i in range(basis.shape[1])]
        else:
            todo += [basis @ halves[1], basis @ halves[0]]
    vectors = np.array(out[:top]).reshape(-1, len(v))
    vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    values = np.einsum("ij,jk,ik->i", vectors, v, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[order].T


# ------------------------------------------------------------ distributed fit
@dataclass
class Whitening:
    """A fit: ``n`` vectors with sums ``s``, the trace of their covariance,
    eigenvalues and the components as columns."""

    n: int
    s: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows whose vector can be used, as doubles."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.size(v) > 0
    fine = fine & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(fine).select(F.col(id_col).alias("vec_id"), v.alias("v"))


def _matrix(b: pa.RecordBatch, dims: int, scale: int, shift: int) -> np.ndarray:
    """The integers x of a batch, as doubles."""
    lists = b.column("v")
    x = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)) + shift
    if x.size and np.abs(x).max() > 2**53:
        raise ValueError("an entry is too large to be taken as an integer")
    return x


def _sums(rows: DataFrame, dims: int, scale: int, shift: int, centre: list[int] | None) -> DataFrame:
    """One row (i, totals) per matrix row and task: sums of x for no centre,
    sums of products of centred entries else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = _matrix(b, dims, scale, shift)
            if centre is None:
                part = [[int(c) for c in x.sum(axis=0)]] if np.abs(x).sum() < 2**53 else [[sum(int(c) for c in x[:, j]) for j in range(dims)]]
            else:
                y = x - np.array(centre, dtype=float)
                exact = np.abs(y).max(initial=0) ** 2 * max(1, len(y)) < 2**53
                part = (y.T @ y).astype(np.int64).tolist() if exact else [[sum(int(p) * int(q) for p, q in zip(y[:, i], y[:, j])) for j in range(dims)] for i in range(dims)]
            total = part if total is None else [[p + q for p, q in zip(r, s)] for r, s in zip(total, part)]
        for i, r in enumerate(total or []):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([[str(c) for c in r]], pa.list_(pa.string()))], ["i", "totals"])

    return rows.select("v").mapInArrow(run, "i int, totals array<string>")


def _total(parts: DataFrame) -> dict[int, list[int]]:
    """Sums over the tasks, entry by entry; one row per matrix row."""
    each = parts.select("i", F.posexplode("totals").alias("j", "x")).select("i", "j", F.col("x").cast("decimal(38,0)").alias("x"))
    rows = each.groupBy("i", "j").agg(F.sum("x").alias("x")).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "x"))).alias("r")).collect()
    return {r["i"]: [int(e["x"]) for e in r["r"]] for r in rows}


def fit(rows: DataFrame, top: int = TOP, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """The whitening of all ``rows`` (of :func:`usable`, of one length)."""
    sized = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    n, dims = sized["n"], sized["dims"]
    if not n:
        return None
    s = _total(_sums(rows, dims, scale, shift, None))[0]
    centre = [c // n for c in s]
    rest = [c % n for c in s]
    c = _total(_sums(rows, dims, scale, shift, centre))
    v = np.array([[float(Fraction(n * c[i][j] - rest[i] * rest[j], n * n)) for j in range(dims)] for i in range(dims)])
    trace = float(sum(Fraction(n * c[i][i] - rest[i] ** 2, n * n) for i in range(dims)))
    values, vectors = eigen(v, top)
    some = values > 64 * EPS * dims * trace
    return Whitening(n, s, trace, values[some], vectors[:, some])


def project(rows: DataFrame, model: Whitening, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, squares, cross, w) of every row: w is the whitened vector;
    ``squares`` and ``cross`` are the exact sums of y^2 and y * rest, where
    n * x - S = n * y - rest."""
    n, s = model.n, model.s
    dims = len(s)
    centre, rest = [c // n for c in s], [c % n for c in s]
    # (x - S / n) . u / sqrt(e), with the mean's part below one unit apart
    turn = model.vectors / np.sqrt(model.values)
    below = (np.array([r / n for r in rest]) @ turn).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _matrix(b, dims, scale, shift) - np.array(centre, dtype=float)
            w = y @ turn - np.array(below)
            small = np.abs(y).max(initial=0) ** 2 * dims < 2**53 and np.abs(y).max(initial=0) * n * dims < 2**62
            if small:
                z = y.astype(np.int64)
                squares, cross = (z * z).sum(axis=1).tolist(), (z @ np.array(rest, dtype=np.int64)).tolist()
            else:
                whole = [[int(c) for c in r] for r in y]
                squares, cross = [sum(c * c for c in r) for r in whole], [sum(c * t for c, t in zip(r, rest)) for r in whole]
            arrays = [b.column("vec_id"), pa.array([str(c) for c in squares]), pa.array([str(c) for c in cross]), pa.array(w.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "squares", "cross", "w"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, squares string, cross string, w array<double>")


def identity_error(w: DataFrame, width: int) -> float:
    """Largest absolute entry of the covariance of an array column ``w`` less
    the identity, centred before multiplying."""
    at = lambda i: F.get("w", F.lit(i))
    m = w.agg(*[F.avg(at(i)).alias(f"m{i}") for i in range(width)]).first()
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    v = w.agg(*[F.avg((at(i) - m[i]) * (at(j) - m[j])).alias(f"v{i}_{j}") for i, j in pairs]).first()
    return max(abs(x - (1.0 if i == j else 0.0)) for (i, j), x in zip(pairs, v))


def whiten(vectors: DataFrame, top: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error):
    one row per usable vector and component, the components numbered from 1.
    ``deviation`` is the sum over dimensions of (n x - S)^2, as decimal(38, 0)."""
    rows = usable(vectors, id_col, vec_col)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    nothing = vectors.sparkSession.createDataFrame([], schema)
    if lengths is None:
        return nothing
    rows = rows.where(F.size("v") == lengths["d"])
    model = fit(rows, top, scale, shift)
    if not len(model.values):
        return nothing
    done = stash(project(rows, model, scale, shift), "whitening")
    error = identity_error(done, len(model.values))
    n, rest = F.lit(model.n).cast("decimal(20,0)"), sum((c % model.n) ** 2 for c in model.s)
    big = lambda c: F.col(c).cast("decimal(38,0)")
    deviation = (n * (n * big("squares") - 2 * big("cross")).cast("decimal(38,0)")).cast("decimal(38,0)") + F.lit(str(rest)).cast("decimal(38,0)")
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    each = done.select("vec_id", deviation.cast("decimal(38,0)").alias("deviation"), F.posexplode("w").alias("i", "whitened"))
    return each.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))
