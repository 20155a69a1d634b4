"""Arrow columns of vectors as matrices, for the operators that count in whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def finite_rows(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector: the rows whose vector is neither null nor empty and holds no null and nothing that is not finite."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False)  # null becomes NaN
    good = np.isfinite(values)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    bad = np.concatenate(([0], np.cumsum(~good)))
    whole = (lengths > 0) & (bad[starts[1:]] == bad[starts[:-1]])
    out = []
    for d in np.unique(lengths[whole]).tolist():
        rows = np.flatnonzero(whole & (lengths == d))
        out.append((rows, values[starts[rows][:, None] + np.arange(d)]))
    return out


def scaled_floor(matrix: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * c) as int64; what does not fit stops at the ends of the range."""
    with np.errstate(over="ignore"):
        x = np.floor(matrix * factor)
    x = np.clip(x, -(2.0**63), 2.0**63)
    top = x >= 2.0**63
    return np.where(top, np.iinfo(np.int64).max, np.where(top, 0.0, x).astype(np.int64))


def exact(x: np.ndarray, most: int) -> np.ndarray:
    """The same whole numbers, as Python's own where 64 bits could overflow: ``most`` is how large a result may grow at most."""
    return x.astype(object) if most >= 1 << 62 else x


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
