"""Rows of integer vectors, for the operators that compare them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components beyond this could overflow the 64-bit sums of products; such a table is refused.
LARGEST = 1 << 28


def whole(vector: str | Column) -> Column:
    """Whether a vector is there and every component is a finite number."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(True))


def integers(vector: str, scale: int = 256) -> Column:
    """Each component times ``scale``, rounded down."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def integer_rows(rows: DataFrame, vector: str, *keep: Column, scale: int = 256) -> DataFrame:
    """``keep`` and ``v``, the integer components, of the rows whose vector is whole."""
    return rows.where(whole(vector)).select(*keep, integers(vector, scale).alias("v"))


def checked(v: np.ndarray) -> np.ndarray:
    """``v``, unless a component is out of range."""
    if v.size and (v.max() > LARGEST or v.min() < -LARGEST):
        raise ValueError(f"a vector component times its scale lies beyond {LARGEST}; scores would not fit 64 bits")
    return v
