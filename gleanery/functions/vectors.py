"""Vector similarity, in double precision on float vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Similarities are rounded here, below the accuracy of float vectors, so that
#: equal vectors tie exactly whatever block they are computed in.
SIM_DIGITS = 9
_BLOCK = 2048


def vector_block(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have a vector, those vectors as one float matrix)."""
    present = np.asarray(vectors.is_valid())
    kept = vectors.drop_null()
    lengths = np.asarray(pa.compute.list_value_length(kept))
    if (lengths != dim).any():
        raise ValueError(f"different vector dimensions: {sorted(set(lengths))} and {dim}")
    return present, np.asarray(kept.flatten()).reshape(-1, dim)


def clamp_cosine(dots: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Cosine clamped to 0..1; a zero vector has no angle and counts as 1."""
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = dots / norms
    return np.round(np.where(np.isnan(cosine), 1.0, np.clip(cosine, 0.0, 1.0)), SIM_DIGITS)


def cosine_sim(vector: Column, query: Sequence[float] | None) -> Column:
    """Similarity to one query vector; rows without a vector get 0.

    Without a query vector, every row gets 0.
    """
    if query is None:
        return F.lit(0.0)
    wanted = np.asarray(query, dtype=np.float32).astype(np.float64)
    wanted_norm = math.sqrt(float(wanted @ wanted))

    @F.arrow_udf("double")
    def similarity(vectors: pa.Array) -> pa.Array:
        present, block = vector_block(vectors, len(wanted))
        sims = np.empty(len(block))
        for at in range(0, len(block), _BLOCK):
            rows = block[at : at + _BLOCK].astype(np.float64)
            norms = np.sqrt(np.einsum("ij,ij->i", rows, rows)) * wanted_norm
            sims[at : at + _BLOCK] = clamp_cosine(rows @ wanted, norms)
        out = np.zeros(len(present))
        out[present] = sims
        return pa.array(out)

    return similarity(vector)


def cosine_sim_sql(left: Column, right: Column) -> Column:
    """The same for two vector columns, in built-in functions only."""

    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)

    norm = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    cosine = F.when(norm == 0, 1.0).otherwise(dot(left, right) / F.nullif(norm, F.lit(0.0)))
    clamped = F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0))
    return F.round(
        F.when(left.isNull() | right.isNull(), 0.0).otherwise(clamped), SIM_DIGITS
    )


def has_dim(vector: Column, dim: int) -> Column:
    """Whether a vector fits a table of this dimension; no vector always fits."""
    return vector.isNull() | (F.size(vector) == dim)
