"""What the vector operators share: current usable records, unit rows, hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSION = 128


def current_records(docs: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """``(id, vector)``: the usable current record of each id, once.

    The current record is the row with the greatest ``updated_at`` (null
    counts as the least); among rows that tie, the greatest vector stands for
    all. An id whose current record is not usable (null, wrong length, NaN,
    infinite or all zero) is left out, as are rows without an id.
    """
    last = (
        docs.select("id", "updated_at", "vector")
        .filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max(F.struct("updated_at", "vector")).alias("r"))
        .select("id", F.col("r.vector").alias("vector"))
    )
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    return last.filter((F.size("vector") == dimension) & fine & some)


def matrix(batch: pa.RecordBatch | pa.Table, name: str = "vector", dimension: int = DIMENSION) -> np.ndarray:
    """The list column `name` as a two-dimensional array without a copy per row."""
    col = batch.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros((0, dimension), np.float32)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dimension)


def unit(x: np.ndarray, dtype=np.float32) -> np.ndarray:
    """Rows scaled to length 1, by way of double precision."""
    y = x.astype(np.float64)
    y /= np.abs(y).max(axis=1, keepdims=True)
    y /= np.sqrt((y * y).sum(axis=1, keepdims=True))
    return y.astype(dtype)


def rotations(seed: int, count: int, dimension: int = DIMENSION) -> np.ndarray:
    """`count` random orthogonal matrices, equal for equal seeds."""
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.standard_normal((dimension, dimension)))[0] for _ in range(count)]).astype(np.float32)


def cross_polytope(u: np.ndarray, rot: np.ndarray, width: int) -> np.ndarray:
    """Cross-polytope hash values of unit rows, one byte a value.

    Each rotation gives ``dimension / width`` values: the rotated row is cut
    into stretches of `width` coordinates and each gives the place and sign of
    its greatest coordinate (below ``2 * width``, at most 256 values).
    """
    n, d = u.shape
    out = np.empty((n, len(rot) * (d // width)), np.uint8)
    for r, m in enumerate(rot):
        z = (u @ m).reshape(n, d // width, width)
        at = np.abs(z).argmax(axis=2)
        sign = np.take_along_axis(z, at[:, :, None], 2)[:, :, 0] < 0
        out[:, r * (d // width) : (r + 1) * (d // width)] = at + width * sign
    return out


def fold64(values: np.ndarray, salt: int) -> np.ndarray:
    """One 64-bit number for each row of small integers, by multiplicative mixing."""
    h = np.full(len(values), (salt * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for c in range(values.shape[1]):
        h = (h ^ (values[:, c].astype(np.uint64) + np.uint64(0x9E3779B9))) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def pair_cosine(pairs: DataFrame) -> DataFrame:
    """Adds ``sim``, the cosine in double precision, to rows with ``va`` and ``vb``; drops both."""
    keep = [c for c in pairs.columns if c not in ("va", "vb")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name in keep) + ", sim double"

    def run(batches):
        for b in batches:
            if b.num_rows:
                sim = np.einsum("ij,ij->i", unit(matrix(b, "va"), np.float64), unit(matrix(b, "vb"), np.float64))
                yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(sim)], names=[*keep, "sim"])

    return pairs.mapInArrow(run, schema)


def hash_head(rows: DataFrame, want: int, n: int) -> DataFrame:
    """The first `want` of `n` rows in the order of ``h``, ``id``, where ``h`` is a 64-bit hash.

    Rows beyond the expected place and six standard deviations are dropped first, so
    that tasks send about `want` rows to the driver in all rather than each.
    """
    share = min(1.0, (want + 6 * want**0.5 + 16) / max(1, n))
    if share < 1:
        rows = rows.filter(F.col("h") <= int(-(2**63) + share * 2**64))
    return rows.orderBy("h", "id").limit(want)
