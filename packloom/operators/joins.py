"""Joins of a big table to a table of facts per key, safe when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.operators.saving import measured

# A key left to the shuffled join of `lookup_join` holds at most 1/HEAVY_KEYS of the big table.
HEAVY_KEYS = 1000
SALTS = 32
BROADCAST_BYTES = 64 * 1024 * 1024


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread_on: list[str],
                how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Shuffled join where ``small`` is so much smaller that replicating it ``salts`` times costs little.

    Each key of ``big`` is spread over ``salts`` partitions.  The merge hint keeps Catalyst from
    broadcasting a ``big`` that it takes for small because it cannot foresee an explode.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_on), F.lit(salts)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return salted.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def fits_broadcast(small: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> bool:
    """May the table be sent to every executor?"""
    return measured(small)["bytes"] <= broadcast_bytes


def unique_join(big: DataFrame, small: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join to a saved table on keys unique on both sides, which cannot be skewed; broadcast if it fits."""
    return big.join(F.broadcast(small) if fits_broadcast(small) else small, keys, how)


def measured_join(big: DataFrame, small: DataFrame, keys: list[str], spread_on: list[str], how: str = "inner",
                  broadcast_bytes: int = BROADCAST_BYTES, part_of: DataFrame | None = None) -> DataFrame:
    """Join a big table to a saved table that is usually small, whatever its size turns out to be.

    ``small`` is broadcast if it (or the saved table it is a part of) fits, so that ``big`` stays
    where it is, and otherwise joined with salts.
    """
    if fits_broadcast(small if part_of is None else part_of, broadcast_bytes):
        return big.join(F.broadcast(small), keys, how)
    return salted_join(big, small, keys, spread_on, how)


def lookup_join(big: DataFrame, facts: DataFrame, keys: list[str], weight: str, spread_on: list[str],
                heavy_keys: int = HEAVY_KEYS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Left join to saved ``facts`` (one row per key) that may be too many to replicate.

    ``weight`` is a column of ``facts`` that counts the rows of ``big`` per key.  If the facts do
    not fit a broadcast, the ``heavy_keys`` heaviest, a fixed number, are broadcast; all other
    keys go through a shuffled join in which each holds at most 1/heavy_keys of ``big``.  Rows
    served by the broadcast still pass the shuffle, spread evenly by their own hash.
    """
    values = [c for c in facts.columns if c not in keys and c != weight]
    if fits_broadcast(facts, broadcast_bytes):
        return big.join(F.broadcast(facts.drop(weight)), keys, "left").select(*big.columns, *values)
    heavy = facts.orderBy(F.desc(weight), *keys).limit(heavy_keys).select(
        *keys, F.struct(*values).alias("_heavy"))
    light = facts.select(*keys, F.struct(*values).alias("_light"), F.lit(0).cast("bigint").alias("_spread"))
    marked = big.join(F.broadcast(heavy), keys, "left").withColumn(
        "_spread",
        F.when(F.col("_heavy").isNull(), F.lit(0).cast("bigint"))
        .otherwise(F.pmod(F.xxhash64(*spread_on), F.lit(2**31)) + 1),
    )
    joined = marked.join(light, [*keys, "_spread"], "left")
    return joined.select(*big.columns, *[F.coalesce(f"_heavy.{v}", f"_light.{v}").alias(v) for v in values])


def spread_work(rows: DataFrame, *keys: str) -> DataFrame:
    """Spread rows that are short but long to work on evenly over ``spark.sql.shuffle.partitions`` tasks.

    The number is given outright: AQE would merge such short rows into few partitions by size.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
