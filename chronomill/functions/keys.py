"""Deterministic ids and explicit sort orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The column that operators number rows by for themselves; tables have none of that name.
HELPER = "_chronomill_n"


def natural_id(*parts: Column) -> Column:
    """A UUID-shaped id from a natural key, the same on every run; null parts differ from empty ones."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])
    h = F.sha2(text, 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def ascending(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_last() for n in names]


def descending(*names: str) -> list[Column]:
    return [F.col(n).desc_nulls_first() for n in names]
