"""Key-value settings with types, bounds and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def typed(rows: DataFrame, owner: str, schema: dict[str, tuple[str, object]]) -> DataFrame:
    """One row for each owner from rows (owner, key, value): each key cast to its type, its default where it is missing or malformed."""
    maps = rows.where("key is not null").groupBy(owner, "key").agg(F.max("value").alias("value")).groupBy(owner).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    return maps.select(owner, *(F.coalesce(F.try_element_at("m", F.lit(k)).try_cast(t), F.lit(d).cast(t)).alias(k) for k, (t, d) in schema.items()))


def allowed(value: Column, values: list[str], default: str) -> Column:
    return F.when(value.isin(*values), value).otherwise(default)


def bounded(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
