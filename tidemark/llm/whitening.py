"""Embedding whitening from an exact scatter matrix.

Vectors are whole numbers after scaling. Each task multiplies its residues by several primes as
floating-point matrices, without any rounding; the sums over tasks are put together by the Chinese
remainder theorem into the exact scatter of n x - S, which is centred before it is multiplied.
Only then is it divided, and its eigenvectors are found in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, need

#: What entries are multiplied by before they are rounded down.
SCALE = 256
COMPONENTS = 4
#: Entries from here on don't fit the grid; rows that have one are left out.
LARGEST = float(1 << 52)
#: Residues are below 2^PRIME_BITS, so a product of BLOCK rows stays below 2^53.
PRIME_BITS, BLOCK = 20, 8192
#: Rows turned into an array at a time.
STEP = 4096
#: Eigenvalues below this share of the variance count as none.
NONE = 1e-12


@dataclass
class Fit:
    """What is learnt of the fit list: its size, sums, leading components (one a row), their
    eigenvalues, the variance of all dimensions, and the measured error of the whitened list."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    variance: float
    error: float = 0.0


def primes(above: int) -> list[int]:
    """The largest primes below 2^PRIME_BITS whose product is over `above`."""
    found, candidate = [], (1 << PRIME_BITS) - 1
    while prod(found) <= above:
        if all(candidate % k for k in range(3, int(candidate**0.5) + 1, 2)):
            found.append(candidate)
        candidate -= 2
    return found


def grid(vector: Column) -> Column:
    """A vector's entries as whole numbers; null if there is none, or an entry is null, not finite,
    or beyond LARGEST."""
    wide = F.transform(vector, lambda c: c.cast("double") * SCALE)
    bad = F.exists(wide, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(wide, lambda c: F.floor(c).cast("long")))


def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches with their x as a matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def gathered(rows: DataFrame) -> tuple[int, list[int], int]:
    """n, the sums and the largest magnitude of an entry; one row a dimension is gathered."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, most = 0, 0, 0
        for _, x in arrays(batches):
            # Halves of an entry can be added without overflow, whatever the size of the batch.
            high, low = x >> 26, x & ((1 << 26) - 1)
            n, sums, most = n + len(x), sums + np.stack([high.sum(0), low.sum(0)]), max(most, int(np.abs(x).max()))
        if n:
            d = sums.shape[1]
            yield pa.RecordBatch.from_pydict({"k": range(d), "n": [n] * d, "high": sums[0], "low": sums[1], "most": [most] * d}, pa.schema([(c, pa.int64()) for c in ("k", "n", "high", "low", "most")]))

    parts = rows.select("x").mapInArrow(partial, "k long, n long, high long, low long, most long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = sorted(parts.groupBy("k").agg(F.sum("n").alias("n"), wide("high"), wide("low"), F.max("most").alias("most")).collect())
    if not found:
        return 0, [], 0
    return found[0]["n"], [(int(r["high"]) << 26) + int(r["low"]) for r in found], max(r["most"] for r in found)


def scatter(rows: DataFrame, n: int, sums: list[int], most: int) -> list[list[int]]:
    """The sum over rows of (n x - S)(n x - S)', exactly. Gathered are d x d residues a prime."""
    d = len(sums)
    moduli = primes(2 * n * (2 * n * most) ** 2)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = {p: np.zeros((d, d), np.int64) for p in moduli}
        for _, x in arrays(batches):
            for p in moduli:
                r = (((x % p) * (n % p) - np.array([s % p for s in sums])) % p).astype(np.float64)
                for at in range(0, len(r), BLOCK):
                    block = r[at : at + BLOCK]
                    out[p] = (out[p] + (block.T @ block).astype(np.int64)) % p
        for p, m in out.items():
            if m.any():
                yield pa.RecordBatch.from_pydict({"p": [p] * d, "i": range(d), "m": list(m)}, pa.schema([("p", pa.int64()), ("i", pa.int64()), ("m", pa.list_(pa.int64()))]))

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows of one p and i follow each other; one running row is held.
        key, held = None, None
        for batch in batches:
            for p, i, m in batch.itertuples(index=False):
                if (p, i) != key:
                    if key is not None:
                        yield pd.DataFrame({"p": [key[0]], "i": [key[1]], "m": [held]})
                    key, held = (p, i), 0
                held = (held + np.asarray(m)) % p
        if key is not None:
            yield pd.DataFrame({"p": [key[0]], "i": [key[1]], "m": [held]})

    parts = rows.select("x").mapInArrow(partial, "p long, i long, m array<long>")
    sent = parts.repartition("p", "i").sortWithinPartitions("p", "i").mapInPandas(total, "p long, i long, m array<long>").collect()
    whole = prod(moduli)
    out = [[0] * d for _ in range(d)]
    for p, i, m in sent:
        rest = whole // p
        weight = rest * pow(rest, -1, p)
        out[i] = [(a + weight * b) % whole for a, b in zip(out[i], m, strict=True)]
    return [[v - whole if 2 * v > whole else v for v in row] for row in out]


def white(x: np.ndarray, fit: Fit) -> np.ndarray:
    """The whitened rows of x, each component in a column."""
    mean = np.array([s / fit.n for s in fit.sums])
    return (x - mean) @ (fit.components / np.sqrt(fit.values)[:, None]).T


def fitted(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The fit of distinct rows x of one length; None where there are none or all are one."""
    n, sums, most = gathered(rows)
    if n == 0:
        return None
    exact = scatter(rows, n, sums, most)
    covariance = np.array([[v / n**3 for v in row] for row in exact])
    values, vectors = np.linalg.eigh(covariance)
    variance = sum(exact[i][i] for i in range(len(sums))) / n**3
    kept = [k for k in range(len(values))[::-1] if values[k] > NONE * variance][:components]
    if not kept:
        return None
    lead = vectors[:, kept].T
    # Eigenvectors have either sign; the largest entry is made positive.
    lead = lead * np.sign(lead[np.arange(len(lead)), np.abs(lead).argmax(1)])[:, None]
    fit = Fit(n, sums, lead, values[kept], variance)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for _, x in arrays(batches):
            w = white(x, fit)
            total = total + w.T @ w
        if not isinstance(total, int):
            i, j = (k.ravel() for k in np.indices(total.shape))
            yield pa.RecordBatch.from_pydict({"i": i, "j": j, "v": total.ravel()})

    sent = rows.select("x").mapInArrow(products, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v")).collect()
    fit.error = max(abs(v / n - (i == j)) for i, j, v in sent)
    return fit


def deviations(x: np.ndarray, fit: Fit) -> list[int | None]:
    """The sum of (n x - S)^2 of each row; None where no long holds it."""
    most = max(fit.n * int(np.abs(x).max(initial=0)) + max(map(abs, fit.sums)), 1)
    if most * most * x.shape[1] < 1 << 63:
        y = fit.n * x - np.array(fit.sums)
        return (y * y).sum(1).tolist()
    out = [sum((fit.n * int(v) - s) ** 2 for v, s in zip(row, fit.sums, strict=True)) for row in x]
    return [v if v < 1 << 63 else None for v in out]


def whiten(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: for each row and each
    leading component, the row's place along it in standard deviations.

    Rows are left out whose vector is null, empty, or holds an entry that is null, not finite or
    beyond LARGEST; then those of another length than most rows have (of equally many the longer).
    Repeated vectors count once for the fit and are all whitened; null ids stay. Components without
    variance have no rows, so neither have an empty table or one vector repeated. Components of
    equal variance are any basis of their plane. A deviation that no long holds is null.
    """
    scratch = Scratch(table.sparkSession)
    usable = need(table, vec_id, vector).select(F.col(f"`{vec_id}`").alias("vec_id"), grid(F.col(f"`{vector}`")).alias("x")).where(F.size("x") > 0)
    kind = table.schema[vec_id].dataType
    schema = f"vec_id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    best = usable.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if best is None:
        return table.sparkSession.createDataFrame([], schema)
    rows = usable.where(F.size("x") == best["d"])
    # Equal vectors are folded in the tasks that read them before they are shuffled.
    fit = fitted(scratch.save(rows.select("x").distinct()), components)
    if fit is None:
        return table.sparkSession.createDataFrame([], schema)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fit.values)
        for part, x in arrays(batches):
            rows = len(x)
            yield pa.RecordBatch.from_arrays([
                part.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, fit.n)),
                pa.array([v for v in deviations(x, fit) for _ in range(k)], pa.int64()), pa.array(white(x, fit).ravel()), pa.array(np.tile(fit.values / fit.variance, rows)), pa.array(np.full(rows * k, fit.error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
