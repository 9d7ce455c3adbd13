"""Sort keys.  Where nulls go depends on the type: numbers before null, all else after it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.values import Value


def key(v: Value, desc: bool) -> Column:
    if v.kind == "bool":  # false, null, true
        col = F.coalesce(v.col.cast("int") * 2, F.lit(1))
        return col.desc() if desc else col.asc()
    if v.kind in V.NUMBERS:
        col = V.as_double(v) if v.kind == "exact" else v.col
        return col.desc_nulls_first() if desc else col.asc_nulls_last()
    col = V.output(v)
    return col.desc_nulls_last() if desc else col.asc_nulls_first()
