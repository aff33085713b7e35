"""Sharding by a permutation-filled lookup table. DataFrame functions only on the main path.

Each shard has its own order of the slots of a prime-sized table, from two hashes of its name. The shards take turns,
each claiming its first slot that is still free, until none is. A row goes to the shard that holds the slot of its
key's hash. A table of at least 100 slots a shard keeps shards even to about one in a hundred, and a shard more or
less moves few other slots. The table's size follows from the number of shards alone, so it is broadcast; rows of a
hot key are placed one by one and need no shuffle.

Edge cases: a null key counts as empty text; repeated keys share a shard; an empty table gives no rows; columns named
slot or shard in the input are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

N_SHARDS = 16


def table_size(n_shards: int) -> int:
    """The least prime of at least 100 slots a shard."""
    m = max(101, 100 * n_shards)
    while any(m % d == 0 for d in range(2, int(m**0.5) + 1)):
        m += 1
    return m


def _hashed(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:7], 16)


def fill(names: list[str], m: int) -> list[int]:
    """The shard of each slot; m steps of claims, on the driver, whatever the number of rows."""
    starts = [_hashed(f"{x}:start") % m for x in names]
    skips = [_hashed(f"{x}:skip") % (m - 1) + 1 for x in names]
    table, at, taken = [-1] * m, [0] * len(names), 0
    while True:
        for i in range(len(names)):
            while table[slot := (starts[i] + at[i] * skips[i]) % m] >= 0:
                at[i] += 1
            table[slot] = i
            if (taken := taken + 1) == m:
                return table


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def lookup(spark: SparkSession, names: list[str]) -> DataFrame:
    """slot, shard: as many rows as the table has slots."""
    filled = ",".join(map(str, fill(names, table_size(len(names)))))
    return spark.range(1).select(F.posexplode(F.split(F.lit(filled), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int"))


def assign_shards(df: DataFrame, key: str, n_shards: int = N_SHARDS) -> DataFrame:
    m = table_size(n_shards)
    slot = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 7), 16, 10).cast("long") % m
    return df.drop("slot", "shard").withColumn("slot", slot.cast("int")).join(F.broadcast(lookup(df.sparkSession, shard_names(n_shards))), "slot")


def write_shards(df: DataFrame, key: str, folder: str, n_shards: int = N_SHARDS) -> None:
    """One folder a shard; tasks write what they hold, so a hot shard is spread over many files."""
    assign_shards(df, key, n_shards).drop("slot").write.partitionBy("shard").parquet(folder)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir).select("doc_id"), "doc_id").select("doc_id", "slot", "shard")


OP7_SQL = r"""
WITH RECURSIVE names AS (SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 5, '0') AS name FROM range(16) t(i)),
params AS (SELECT list(CAST('0x' || substr(md5(name || ':start'), 1, 7) AS BIGINT) % 1601 ORDER BY i) AS starts,
  list(CAST('0x' || substr(md5(name || ':skip'), 1, 7) AS BIGINT) % 1600 + 1 ORDER BY i) AS skips FROM names),
claims(turn, slot, claimed) AS (
  SELECT 0, starts[1], [starts[1]] FROM params
  UNION ALL
  SELECT turn + 1, nxt, list_append(claimed, nxt) FROM (
    SELECT turn, claimed, list_filter(list_transform(range(1601), lambda j: (starts[(turn + 1) % 16 + 1] + j * skips[(turn + 1) % 16 + 1]) % 1601), lambda s: NOT list_contains(claimed, s))[1] AS nxt
    FROM claims, params WHERE turn < 1600))
SELECT doc_id, CAST(slot AS INTEGER) AS slot, CAST(turn % 16 AS INTEGER) AS shard
FROM documents JOIN claims ON slot = CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 7) AS BIGINT) % 1601
"""
