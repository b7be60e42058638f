"""Keyed tables on plain Parquet: the last write of a key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str | list[str], *order) -> DataFrame:
    """The last row of each key by the given order."""
    keys = [key] if isinstance(key, str) else key
    w = W.partitionBy(*keys).orderBy(*(o.desc() for o in order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: str, on_conflict: str = "replace", order: list[str] | None = None) -> DataFrame:
    """old with new's rows: a key in both takes new's row ("replace") or keeps old's ("first").

    Of new's rows of one key the last ("replace") or the first stays, by `order` or as the frame has them.
    """
    if on_conflict not in ("replace", "first"):
        raise ValueError("on_conflict is replace or first")
    by = F.struct(*([F.col(c) for c in order] if order else [F.monotonically_increasing_id()]))
    pick = F.max_by if on_conflict == "replace" else F.min_by
    new = new.withColumn("__order", by).groupBy(F.col(key).alias("__key")).agg(pick(F.struct(*new.columns), "__order").alias("r")).select("r.*")
    keep, give = (new, old) if on_conflict == "replace" else (old, new)
    return keep.unionByName(give.join(keep.select(key), key, "left_anti").select(*give.columns), allowMissingColumns=True)


def resume(rows: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """rows whose `on` isn't in `done`; rows with a null one stay."""
    return rows.join(done.select(on).distinct(), on, "left_anti")


def with_vectors(chunks: DataFrame, vector: str = "embedding") -> DataFrame:
    return chunks.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
