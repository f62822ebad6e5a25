"""A left lookup join that stays balanced when one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from custlens.functions.stages import written

# A key is hot from 1/2000 of all rows, so there are at most 2000 hot keys.
HOT_KEYS = 2000
SALTS = 4096


def lookup_join(
    facts: DataFrame, lookup: DataFrame, keys: Sequence[str], weight: str, spread_by: Sequence[str]
) -> DataFrame:
    """Left-joins ``facts`` to ``lookup`` (unique on ``keys``).

    ``weight`` is the number of fact rows of a key. Hot keys, at most
    ``HOT_KEYS`` by arithmetic, are broadcast; their fact rows and those with a
    null key then carry a salt, so that the shuffle join of the rest spreads
    them. The facts are read once; the lookup is read three times and is
    therefore written first.
    """
    keys = list(keys)
    lookup = written(lookup, "lookup")
    values = [c for c in lookup.columns if c not in (*keys, weight)]
    total = lookup.agg(F.sum(weight).alias("total")).scalar()
    is_hot = F.col(weight) * F.lit(HOT_KEYS) >= total
    packed = F.struct(*values)
    hot = lookup.filter(is_hot).select(*keys, packed.alias("_hot"))
    cold = lookup.filter(~is_hot).select(
        *keys, packed.alias("_cold"), F.lit(0).cast("bigint").alias("_salt")
    )
    spread = F.col("_hot").isNotNull()
    for key in keys:
        spread = spread | F.col(key).isNull()
    salt = F.when(
        spread, F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)) + F.lit(1)
    ).otherwise(F.lit(0)).cast("bigint")
    return (
        facts.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", salt)
        .join(cold, [*keys, "_salt"], "left")
        .withColumn("_found", F.coalesce("_hot", "_cold"))
        .select(*facts.columns, *[F.col(f"_found.{v}").alias(v) for v in values])
    )
