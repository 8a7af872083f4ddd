"""Access to VARIANT columns.

A key can be absent, JSON null, or hold a value.  A field decoded as VARIANT
keeps the three apart: NULL, a variant null, or the value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def get(v: Column | str, path: str, dtype: str) -> Column:
    """Typed value at ``$.path``; NULL when absent, JSON null or of another type."""
    return F.try_variant_get(v, f"$.{path}", dtype)


def scalar(v: Column | str, dtype: str) -> Column:
    """The variant itself as ``dtype``; NULL when it is JSON null or of another type."""
    return F.try_variant_get(v, "$", dtype)


def with_default(v: Column | str, dtype: str, default) -> Column:
    """``default`` for an absent key only: a JSON null stays NULL."""
    return F.when(F.isnull(v), F.lit(default)).otherwise(scalar(v, dtype))
