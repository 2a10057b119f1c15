"""Sharding by a keyed permutation of global row numbers.

Rows are numbered from 0 in the order of given columns: a range shuffle, the rows' places within their ranges, and the ranges' row
counts (one number a partition comes to the driver). The number goes through a Feistel network over the smallest power of two that
holds all numbers; a result beyond the table walks on through the network until it falls inside (cycle walking). So numbers 0 to
n-1 map to each other one to one, and place p lies in shard p mod ``shards`` at slot p div ``shards``. Shards differ by one
row at most (law ``rows``). Shard and slot can be computed from a row's number alone, and the number from shard and slot
(``row_of``), without reading the table.

The order columns alone decide, not the layout of files or partitions, so a shuffle can be repeated and a lost task
computed anew. Rows alike in all order columns have numbers next to each other in the order of their input; they are dealt to ranges by that order
too, so that no range grows with a repeated key.

Defined results: null order columns come first; null texts count as empty; repeated rows get a slot each; an empty table gives no rows; one
row gets shard 0, slot 0; new columns whose names the table has get underscores before them.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh_name

SHARDS, SEED, ROUNDS = 16, 2024, 8
#: Two odd multipliers below 2^32 of a published 32-bit mixing function, with its shifts 16, 15, 16.
MIX_A, MIX_B = 0x7FEB352D, 0x846CA68B
_LOW = np.uint64(0xFFFFFFFF)


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    return [int(sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16) for i in range(rounds)]


def half_bits(rows: int) -> tuple[int, int]:
    """Bits of the upper and the lower half of a row number."""
    bits = max(2, (rows - 1).bit_length())
    return bits - bits // 2, bits // 2


def _mixed(half: np.ndarray, key: int) -> np.ndarray:
    v = (half + np.uint64(key)) & _LOW
    for shift, factor in ((16, MIX_A), (15, MIX_B)):
        v ^= v >> np.uint64(shift)
        v = (v * np.uint64(factor)) & _LOW
    return v ^ (v >> np.uint64(16))


@dataclass(frozen=True)
class RowPermutation:
    """A permutation of 0 to ``rows`` - 1."""

    rows: int
    seed: int = SEED

    def _network(self, x: np.ndarray, keys: list[tuple[int, int]]) -> np.ndarray:
        upper, lower = half_bits(self.rows)
        high, low = x >> np.uint64(lower), x & np.uint64((1 << lower) - 1)
        for i, key in keys:  # each round changes one half by the other, so it undoes itself
            if i % 2:
                low = low ^ (_mixed(high, key) & np.uint64((1 << lower) - 1))
            else:
                high = high ^ (_mixed(low, key) & np.uint64((1 << upper) - 1))
        return (high << np.uint64(lower)) | low

    def _walked(self, x: np.ndarray, keys: list[tuple[int, int]]) -> np.ndarray:
        if ((x < 0) | (x >= self.rows)).any():
            raise ValueError(f"a row number or place is not within 0 to {self.rows - 1}")
        out = self._network(x.astype(np.uint64), keys)
        while (beyond := out >= np.uint64(self.rows)).any():
            out[beyond] = self._network(out[beyond], keys)
        return out.astype(np.int64)

    def place_of(self, row: np.ndarray) -> np.ndarray:
        return self._walked(np.asarray(row), list(enumerate(round_keys(self.seed))))

    def row_at(self, place: np.ndarray) -> np.ndarray:
        return self._walked(np.asarray(place), list(enumerate(round_keys(self.seed)))[::-1])

    def shard_and_slot(self, row: np.ndarray, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
        place = self.place_of(row)
        return place % shards, place // shards

    def row_of(self, shard: np.ndarray, slot: np.ndarray, shards: int = SHARDS) -> np.ndarray:
        return self.row_at(np.asarray(slot) * shards + np.asarray(shard))


def row_numbers(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, str, int]:
    """The rows with their global number in the order of the columns; also the new column's name and the number of rows."""
    tie, part, place = (fresh_name(df, x) for x in ("tie", "part", "place"))
    number = fresh_name(df, name)
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in order] + [F.col(tie)]
    sorted_rows = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie)
    ranged = checkpointed(sorted_rows.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    starts, rows = [], 0
    for p, n in sorted(ranged.groupBy(part).count().collect()):  # one number a partition
        starts.append((p, rows))
        rows += n
    offsets = df.sparkSession.createDataFrame(starts, f"`{part}` int, `{number}` long")
    return ranged.join(F.broadcast(offsets), part).withColumn(number, F.col(number) + F.col(place)).drop(part, place), number, rows


def place_column(number: Column, permutation: RowPermutation) -> Column:
    """The permuted place of a row number column."""

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permutation.place_of(row.to_numpy()))

    return place(number)


def shuffled_shards(df: DataFrame, order: list[str], shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, str, str]:
    """The rows with the shard and slot of a keyed shuffle; also the two columns' names."""
    numbered, number, rows = row_numbers(df, order)
    place, shard, slot = (fresh_name(df, x) for x in ("place", "shard", "slot"))
    placed = numbered.withColumn(place, place_column(F.col(number), RowPermutation(rows, seed)))
    dealt = placed.withColumns({shard: (F.col(place) % shards).cast("int"), slot: F.expr(f"`{place}` div {shards}")})
    return dealt.drop(number, place), shard, slot


def write_shards(df: DataFrame, path: str, shard: str, slot: str, rows_per_file: int = 1_000_000) -> None:
    """A folder per shard, whose files hold ``rows_per_file`` slots each, in order. A shard of any size is dealt to as many tasks as it has files."""
    stretch = fresh_name(df, "stretch")
    (df.withColumn(stretch, F.expr(f"`{slot}` div {rows_per_file}")).repartitionByRange(F.col(f"`{shard}`"), F.col(stretch), F.col(f"`{slot}`"))
     .sortWithinPartitions(shard, stretch, slot).drop(stretch).write.partitionBy(shard).option("maxRecordsPerFile", rows_per_file).parquet(path))


def op11_feistel_shards(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt, shard, slot = shuffled_shards(sized, ["doc_id", "size", "text_crc32"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col(shard).alias("shard"), F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op11_sql(shards: int = SHARDS, seed: int = SEED) -> str:
    """CRC-32 by its table of byte remainders, the network round by round, the walk as a recursion."""
    all_bits = "4294967295::UBIGINT"
    network = "SELECT n, step, lower_bits, upper_mask, lower_mask, place >> lower_bits AS high, place & lower_mask AS low FROM walking, bits WHERE step = 0 OR place >= n_rows"
    for i, key in enumerate(round_keys(seed)):
        half, other, mask = ("low", "high", "lower_mask") if i % 2 else ("high", "low", "upper_mask")
        network = f"SELECT *, ({other} + {key}::UBIGINT) & {all_bits} AS v FROM ({network})"
        for shift, factor in ((16, MIX_A), (15, MIX_B)):
            network = f"SELECT * REPLACE ((xor(v, v >> {shift}) * {factor}::UBIGINT) & {all_bits} AS v) FROM ({network})"
        network = f"SELECT * EXCLUDE (v) REPLACE (xor({half}, xor(v, v >> 16) & {mask}) AS {half}) FROM ({network})"
    return f"""
WITH RECURSIVE remainders AS (
  SELECT list(list_reduce(list_prepend(byte, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY byte) AS t
  FROM (SELECT range::UBIGINT AS byte FROM range(256))
), sized AS (
  SELECT doc_id, octet_length(bytes) + 1 AS size,
    xor({all_bits}, list_reduce(list_prepend({all_bits}, list_transform(regexp_extract_all(hex(bytes), '..'), lambda x: ('0x' || x)::UBIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])))::BIGINT AS text_crc32
  FROM (SELECT doc_id, encode(coalesce(text, '')) AS bytes FROM documents), remainders
), numbered AS (
  SELECT *, (row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1)::UBIGINT AS n FROM sized
), bits AS (
  SELECT n_rows, k // 2 AS lower_bits, (1::UBIGINT << (k - k // 2)) - 1 AS upper_mask, (1::UBIGINT << (k // 2)) - 1 AS lower_mask
  FROM (SELECT count(*)::UBIGINT AS n_rows, greatest(2, length(to_base(greatest(count(*) - 1, 1), 2)))::UBIGINT AS k FROM documents)
), walking AS (
  SELECT n, 0 AS step, n AS place FROM numbered
  UNION ALL
  SELECT n, step + 1, (high << lower_bits) | low FROM ({network})
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place % {shards})::INT AS shard, (place // {shards})::BIGINT AS slot, NULL::INT AS grown_shard
FROM numbered JOIN walking USING (n), bits WHERE step > 0 AND place < n_rows
"""
