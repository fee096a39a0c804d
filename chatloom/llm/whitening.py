"""Whitening of embeddings by an incremental eigendecomposition.

Each partition keeps the eigenvalues and eigenvectors of what it has read so far. A vector changes
the scatter matrix by one centred rank-one term, so its new eigenvalues are the roots of a secular
equation between the old ones, and terms that change nothing are deflated. Partitions' spectra are
combined in groups on Spark, again by rank-one updates: one for each eigenpair and one for the
difference of the means. A last distributed pass projects all vectors on the combined basis
(Rayleigh-Ritz), which removes what rounding has left in it; only matrices of the vectors' length
reach the driver.

Components are numerical but for sums that have to be exact: entries are whole numbers, and
deviations from the mean are kept as ``n x - S``.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.workers import arrow_map, group_map
from chatloom.session import pinned, unpin

COMPONENTS = 16
#: An entry c becomes floor(SCALE c) + SHIFT; beyond this size it stays at it.
SCALE, SHIFT, LARGEST = 64, 1_000_000, 2 ** 53
#: Spectra that one task combines.
FAN_IN = 16
_EPS = np.finfo(float).eps
_LOW = 26

SPECTRUM = "slot long, n long, mean array<double>, spectrum array<double>, basis array<double>"
WHITENED = (
    "vec_id long, component int, n long, deviation string, whitened double, explained double, identity_error double"
)


# ---------------------------------------------------------------------------- rank-one updates

def secular_roots(d: np.ndarray, z2: np.ndarray) -> np.ndarray:
    """Differences ``root_i - d_j`` (row i, column j) for the roots of 1 + sum z2_j / (d_j - x).

    ``d`` ascends strictly and ``z2`` is positive; root i lies between d_i and d_(i+1). Each root is
    kept as its distance from the nearer pole, so differences lose no digits. Steps replace the
    terms on either side by one pole each and are halved back into a bracket where they leave it.
    """
    k = len(d)
    upper = np.append(d[1:], d[-1] + z2.sum())
    row = np.arange(k)
    middle = (d + upper) / 2
    at_middle = 1 + (z2 / (d - middle[:, None])).sum(axis=1)
    to_left = at_middle >= 0  # the root is in the left half
    to_left[-1] = True
    origin = np.where(to_left, d, upper)
    poles = d - origin[:, None]
    gap = upper - d
    low, high = np.where(to_left, 0.0, -gap / 2), np.where(to_left, np.where(row == k - 1, gap, gap / 2), 0.0)
    x = (low + high) / 2
    is_left = row[None, :] <= row[:, None]
    own, following = poles[row, row], np.append(poles[row[:-1], row[1:]], upper[-1] - origin[-1])
    for _ in range(100):
        delta = poles - x[:, None]
        term = z2 / delta
        slope = term / delta
        value = 1 + term.sum(axis=1)
        bound = 8 * k * _EPS * (1 + np.abs(term).sum(axis=1))
        open_ = np.abs(value) > bound
        if not open_.any():
            break
        low, high = np.where(value < 0, x, low), np.where(value < 0, high, x)
        left = (slope * is_left).sum(axis=1)
        all_ = slope.sum(axis=1)
        a, b = own - x, following - x
        p = (a + b) * value - a * b * all_
        q = a * b * value
        c = value - a * left - b * (all_ - left)
        root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
        new = x + step
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        if (new == x)[open_].all():
            break
        x = np.where(open_, new, x)
    return x[:, None] - poles


def deflated(d: np.ndarray, q: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Turns ``q`` and ``z`` in place until equal eigenvalues share one entry of ``z``; which entries matter."""
    limit = 8 * _EPS * max(float(np.abs(d).max()), float(z @ z))
    near = np.diff(d) <= limit
    if near.any():
        bounds = np.flatnonzero(~near) + 1
        for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), len(d)], strict=True):
            if b - a > 1 and (size := np.sqrt(z[a:b] @ z[a:b])) > 0:
                # a reflection that leaves all of these entries in the last one
                sign = 1.0 if z[b - 1] <= 0 else -1.0
                v = z[a:b].copy()
                v[-1] -= sign * size
                q[:, a:b] -= np.outer(q[:, a:b] @ v, v) * (2 / (v @ v))
                z[a:b] = 0
                z[b - 1] = sign * size
    return np.flatnonzero(np.abs(z) * np.sqrt(z @ z) > limit)


def rank_one(d: np.ndarray, q: np.ndarray, vector: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of ``q diag(d) q' + weight vector vector'``."""
    z = (vector @ q) * np.sqrt(weight)
    if not z.any():
        return d, q
    d, q = d.copy(), q.copy()
    active = deflated(d, q, z)
    if not len(active):
        return d, q
    old, z = d[active], z[active]
    apart = secular_roots(old, z * z)
    k = len(old)
    if k == 1:
        d[active] = old + z * z
    else:
        # the entries for which the roots are exact (Gu and Eisenstat), so that vectors stay orthogonal
        between = old[:, None] - old
        ratio = np.ones((k, k))
        row = np.arange(k)
        lower, upper = row[:, None] < row, row[:, None] >= row
        shifted = np.vstack((between[1:], np.ones(k)))
        ratio[lower] = apart[lower] / between[lower]
        ratio[upper] = apart[upper] / shifted[upper]
        exact = np.sqrt(np.abs(ratio.prod(axis=0))) * np.sign(z)
        with np.errstate(divide="ignore"):
            turn = exact / -apart
        turn /= np.sqrt((turn * turn).sum(axis=1))[:, None]
        q[:, active] = q[:, active] @ turn.T
        d[active] = old + apart[row, row]
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


class Spectrum:
    """Count, mean and eigenpairs of the scatter matrix of some vectors."""

    def __init__(self, size: int):
        self.n, self.mean = 0, np.zeros(size)
        self.d, self.q = np.zeros(size), np.eye(size)

    def add(self, vector: np.ndarray) -> None:
        if self.n:
            step = vector - self.mean
            self.d, self.q = rank_one(self.d, self.q, step, self.n / (self.n + 1))
            self.mean = self.mean + step / (self.n + 1)
        else:
            self.mean = vector.copy()
        self.n += 1

    def combine(self, other: "Spectrum") -> None:
        for value, vector in zip(other.d, other.q.T, strict=True):
            if value > 0:
                self.d, self.q = rank_one(self.d, self.q, vector, value)
        n, step = self.n + other.n, other.mean - self.mean
        self.d, self.q = rank_one(self.d, self.q, step, self.n * other.n / n)
        self.n, self.mean = n, self.mean + step * (other.n / n)


# ---------------------------------------------------------------------------- Spark

def whole_entries(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``x``: entries as whole numbers; rows with a null, or anything not finite, go."""
    c = F.col("embedding").cast("array<double>")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    limit = F.lit(float(LARGEST))
    whole = F.transform(
        c, lambda v: F.greatest(F.least(F.floor(F.greatest(F.least(v * SCALE, limit), -limit)) + SHIFT, F.lit(LARGEST)), F.lit(-LARGEST))
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"), finite.alias("finite"))
    return rows.where("finite").drop("finite").where(F.size("x") > 0)


def _entries(batch, name: str = "x") -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _sums(batches):
    count, high, low = 0, 0, 0
    for batch in batches:
        if batch.num_rows:
            x = _entries(batch)
            count += len(x)
            high, low = high + (x >> _LOW).sum(axis=0), low + (x & ((1 << _LOW) - 1)).sum(axis=0)
    if count:
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(high)), pa.int32()), pa.array([count] * len(high), pa.int64()), pa.array(high), pa.array(low)],
            names=["at", "n", "high", "low"],
        )


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S`` exactly: as 64-bit numbers where they are large enough, else as Python's."""
    if n * max(int(np.abs(x).max(initial=0)), 1) < 1 << 62 and max(map(abs, sums)) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squared_sums(t: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    if t.dtype == object or np.abs(t).max(initial=0) >= 1 << 2 * _LOW or t.shape[1] > 1 << 8:
        return [sum(v * v for v in row) for row in t.tolist()]
    high, low = t >> _LOW, t & ((1 << _LOW) - 1)
    parts = ((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))
    return [(a << 2 * _LOW) + (b << _LOW + 1) + c for a, b, c in zip(*(p.tolist() for p in parts), strict=True)]


def _spectra(shift: np.ndarray):
    def run(batches):
        found = None
        for batch in batches:
            if batch.num_rows:
                x = _entries(batch) - shift
                found = found or Spectrum(x.shape[1])
                for vector in x.astype(float):
                    found.add(vector)
        if found is not None:
            yield pa.RecordBatch.from_pandas(_row(TaskContext.get().partitionId(), found), preserve_index=False)

    return run


def _row(slot: int, found: Spectrum) -> pd.DataFrame:
    return pd.DataFrame({
        "slot": [slot], "n": [found.n], "mean": [found.mean], "spectrum": [found.d], "basis": [found.q.ravel()],
    })


def _spectrum(n, mean, values, basis) -> Spectrum:
    out = Spectrum(len(mean))
    out.n, out.mean, out.d = int(n), np.array(mean), np.array(values)
    out.q = np.array(basis).reshape(len(mean), -1)
    return out


def _combine(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("slot")
    total = None
    for n, mean, values, basis in zip(rows["n"], rows["mean"], rows["spectrum"], rows["basis"], strict=True):
        found = _spectrum(n, mean, values, basis)
        if total is None:
            total = found
        else:
            total.combine(found)
    return _row(int(rows["slot"].iloc[0]) // FAN_IN, total)


def combined_spectrum(fit_list: DataFrame, shift: np.ndarray) -> Spectrum:
    """The spectrum of all rows: each partition's own, then groups of ``FAN_IN`` until one is left."""
    spectra = pinned(arrow_map(fit_list, _spectra(shift), SPECTRUM), "spectra")
    while spectra.count() > 1:
        groups = spectra.groupBy(F.floor(F.col("slot") / FAN_IN).alias("group"))
        more = pinned(group_map(fit_list.sparkSession, groups, _combine, SPECTRUM), "spectra")
        unpin(spectra)
        spectra = more
    row = spectra.head()
    unpin(spectra)
    return _spectrum(row["n"], row["mean"], row["spectrum"], row["basis"])


def _gram(n: int, sums: list[int], basis: np.ndarray):
    def run(batches):
        total = np.zeros((basis.shape[1] + 1, basis.shape[1]))
        for batch in batches:
            if batch.num_rows:
                y = (centred(_entries(batch), n, sums).astype(float) / n) @ basis
                total += np.vstack((y.T @ y, y.sum(axis=0)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(total.size), pa.int64()), pa.array(total.ravel())], names=["at", "value"]
        )

    return run


def projected_covariance(fit_list: DataFrame, n: int, sums: list[int], basis: np.ndarray) -> np.ndarray:
    """The covariance, with divisor ``n``, of the centred rows of ``fit_list`` projected on ``basis``."""
    k = basis.shape[1]
    entries = arrow_map(fit_list, _gram(n, sums, basis), "at long, value double")
    found = entries.groupBy("at").agg(F.sum("value").alias("value")).toPandas().sort_values("at")["value"].to_numpy()
    gram, mean = found[:k * k].reshape(k, k) / n, found[k * k:] / n
    return gram - np.outer(mean, mean)


class Whitening:
    """What is fitted: ``n``, exact ``sums``, ``components`` in columns, their eigenvalues, all shares."""

    def __init__(self, fit_list: DataFrame, components: int = COMPONENTS):
        rows = arrow_map(fit_list, _sums, "at int, n long, high long, low long").groupBy("at").agg(
            F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low"))
        ).orderBy("at").collect()
        self.n = int(rows[0]["n"])
        self.sums = [(int(r["high"]) << _LOW) + int(r["low"]) for r in rows]
        shift = np.array([round(s / self.n) for s in self.sums], np.int64)
        basis = np.linalg.qr(combined_spectrum(fit_list, shift).q)[0]
        small = projected_covariance(fit_list, self.n, self.sums, basis)
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values, kind="stable")[:components]
        self.eigenvalues = np.maximum(values[order], 0)
        self.components = basis @ turn[:, order]
        trace = float(np.trace(small))
        # beyond the rank there is no direction to scale; such components are zero
        real = self.eigenvalues > trace * len(shift) * 8 * _EPS
        self.explained = np.where(real, self.eigenvalues / (trace or 1.0), 0.0)
        scale = np.where(real, 1 / np.sqrt(np.where(real, self.eigenvalues, 1)), 0.0)
        self.projection = self.components * scale
        error = projected_covariance(fit_list, self.n, self.sums, self.projection) - np.diag(real.astype(float))
        self.identity_error = float(np.abs(error).max())


def _apply(fitted: dict):
    n, sums, projection = fitted["n"], fitted["sums"], fitted["projection"]
    explained, error = fitted["explained"], fitted["identity_error"]
    k = projection.shape[1]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                some = batch.slice(i, 4096)
                t = centred(_entries(some), n, sums)
                rows = len(t)
                white = (t.astype(float) / n) @ projection
                deviation = pa.array(map(str, squared_sums(t)), pa.string())
                each = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays(
                    [some.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                     pa.array(np.full(rows * k, n)), deviation.take(each), pa.array(white.ravel()),
                     pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Each vector on the first principal components of the distinct vectors, scaled to variance one.

    ``vectors`` needs ``vec_id`` and ``embedding``; other columns are ignored. Vectors that are null
    or hold a null or an entry that is not finite are left out, and empty ones have no component.
    Repeated rows are all returned, but distinct vectors count once in the fit. Vectors of another
    length are fitted by themselves. Entries beyond 2^53 count as that. A component without any
    variance is zero with nothing explained. ``deviation`` is exact and in decimal digits, since it
    may have more of them than a number of 64 bits. An empty table gives no row.
    """
    spark = vectors.sparkSession
    rows = whole_entries(vectors)
    distinct = pinned(rows.select("x").distinct(), "distinct-vectors")
    out = spark.createDataFrame([], WHITENED)
    for size in sorted(r[0] for r in distinct.select(F.size("x")).distinct().collect()):
        fit = Whitening(distinct.where(F.size("x") == size), components)
        values = {"n": fit.n, "sums": fit.sums, "projection": fit.projection, "explained": fit.explained,
                  "identity_error": fit.identity_error}
        out = out.unionByName(arrow_map(rows.where(F.size("x") == size), _apply(values), WHITENED))
    unpin(distinct)
    return out
