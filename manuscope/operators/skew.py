"""Joins of facts with a keyed table when one key may hold a third of the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import BROADCAST_BYTES, stored_bytes

#: A key is hot if it holds more than one in so many facts; hence there are at most so many.
HOT_SHARE = 1000
SALTS = 32


def lookup(facts: DataFrame, table: DataFrame, key: str, row_id: str, how: str = "left") -> DataFrame:
    """``facts`` joined with ``table`` (at most one row a key) on ``key``.

    A small table is broadcast after a check of its size.  Else the rows of hot keys are dealt by a hash of
    ``row_id`` to 32 salts, for which only those keys' table rows are repeated.  Null keys match
    nothing and are salted too.  Row counts are those of the plain join.
    """
    if stored_bytes(table) <= BROADCAST_BYTES:
        return facts.join(F.broadcast(table), key, how)
    total = facts.count()
    hot = [r[0] for r in facts.groupBy(key).count().where(F.col("count") > max(1000, total // HOT_SHARE)).select(key).collect()]
    is_hot = F.col(key).isNull() | F.col(key).isin([x for x in hot if x is not None]) if hot else F.col(key).isNull()
    salted = facts.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(row_id), F.lit(SALTS)).cast("int")).otherwise(0))
    repeated = table.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")
