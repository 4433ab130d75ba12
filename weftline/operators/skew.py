"""Per-key results over keys of which a few hold most rows (problem 5).

Eager aggregation through the join: both inputs are reduced to one compact state a key before they meet, so that a join of m and n
rows of a key never forms m * n pairs. Spark aggregates each partition before its shuffle, so a hot key sends at most one state a
partition; the counts and sums of the pairs follow algebraically from the two states. A roll-up to a coarser key is one more
aggregation of the states.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

LEFT_N, RIGHT_N = "left_rows", "right_rows"


def key_states(df: DataFrame, keys: Mapping[str, Column], sums: Mapping[str, Column], count: str) -> DataFrame:
    """One row a key: its row count and the sums (null if the key has no value; null keys form one group)."""
    return df.select(
        *[c.alias(k) for k, c in keys.items()],
        *[c.alias(s) for s, c in sums.items()],
    ).groupBy(*keys).agg(F.count(F.lit(1)).alias(count), *[F.sum(s).alias(s) for s in sums])


def eager_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_sums: Sequence[str] = (),
    right_sums: Sequence[str] = (),
    how: str = "full",
) -> DataFrame:
    """The join of two tables of states. Besides the states it has ``pairs`` (the rows that the join of the raw tables would have)
    and, for each sum ``s``, ``s_over_pairs`` (its sum over those rows). Keys that are null on both sides meet.
    Columns of the same name other than the keys must be renamed before; the function raises a ValueError otherwise."""
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    met = left.join(r, [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys], how)
    out = met.select(
        *[F.coalesce(F.col(k), F.col(f"_r_{k}")).alias(k) for k in keys],
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) if c in (LEFT_N, RIGHT_N) else F.col(c) for c in met.columns if c not in keys and not c.startswith("_r_")],
    )
    return out.withColumns(
        {"pairs": F.col(LEFT_N) * F.col(RIGHT_N)}
        | {f"{s}_over_pairs": F.col(s) * F.col(RIGHT_N) for s in left_sums}
        | {f"{s}_over_pairs": F.col(s) * F.col(LEFT_N) for s in right_sums}
    )


def roll_up(states: DataFrame, keys: Mapping[str, Column], columns: Sequence[str]) -> DataFrame:
    """States of finer keys summed to coarser ones."""
    return states.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(*[F.sum(c).alias(c) for c in columns])


#: Rows of a table up to which it is broadcast, and copies of its rows beyond that.
BROADCAST_ROWS, SALTS = 100_000, 16


def lookup(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``df`` with the columns of the row of ``small`` that has its keys (null keys meet null ones). ``small`` has a row a key; it is broadcast if a count
    allows it, else each of its rows meets a part of the key's rows, so that a hot key is spread. Columns of both sides must differ but for the keys."""
    clash = (set(df.columns) & set(small.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    r = small.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys])
    same = [df[k].eqNullSafe(r[f"_k{i}"]) for i, k in enumerate(keys)]
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(r), same, how).drop(*[f"_k{i}" for i in range(len(keys))])
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys] or keys), F.lit(SALTS)).cast("int"))
    r = r.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = left.join(r, [left[k].eqNullSafe(r[f"_k{i}"]) for i, k in enumerate(keys)] + [left["_salt"] == r["_s"]], how)
    return met.drop("_salt", "_s", *[f"_k{i}" for i in range(len(keys))])
