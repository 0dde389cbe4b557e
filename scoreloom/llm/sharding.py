"""Sharding by the minimax contiguous partition (operator 8).

Groups of equal texts are atomic and ordered by their smallest doc_id.  The smallest feasible shard capacity is
found by searching between the obvious bounds: a capacity is feasible when greedy filling needs no more than the
wanted number of shards.  Greedy filling only asks for "the last prefix sum up to x", so many capacities are
tested at once by one aggregate over the stored prefix sums, and no ordered list reaches the driver.

Defined results: a null text counts as empty (size 1, CRC 0) and groups with empty ones; repeated doc_ids stay
separate rows, and different texts with one smallest doc_id separate groups, in order of their digests; a text all
of whose rows have a null doc_id comes after those with ids; an empty table gives an empty result; one group larger than the fair share makes one large shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

SHARDS = 8
#: Capacities tested by one pass; the search space shrinks by this factor each time.
TESTED = 16


def _ranged(df: DataFrame, order: list[str | Column], owner: str) -> DataFrame:
    """``df`` written in range partitions of ``order``, with the partition's number in ``_part``."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return scratch.written(ranged.withColumn("_part", F.spark_partition_id()), owner)


def prefix_sums(groups: DataFrame, owner: str) -> DataFrame:
    """``groups`` (first_doc, key, bytes) with ``upto``, the running sum of bytes in order of first_doc (nulls last)
    and key.

    Sums run inside range partitions; each partition then adds the total of those before it.
    """
    order = [F.col("first_doc").asc_nulls_last(), F.col("key").asc()]
    ranged = _ranged(groups, order, owner)
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = ranged.groupBy("_part").agg(F.sum("bytes").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    summed = ranged.withColumn("_upto", F.sum("bytes").over(inside)).join(parts, "_part")
    return scratch.written(summed.select("key", "bytes", (F.col("_upto") + F.col("_before")).alias("upto")).sortWithinPartitions("upto"), owner)


def _fill(sums: DataFrame, capacities: list[int], shards: int, largest: int, total: int) -> list[list[int]]:
    """For each capacity the prefix sums at which greedy filling cuts, ``shards`` of them.

    Prefix sums stand at most ``largest`` apart, so the last one up to x lies in (x - largest, x]; as the files are in
    their order, a step reads the row groups around its limits and no others.
    """
    cuts: list[list[int]] = [[] for _ in capacities]
    for _ in range(shards):
        limits = [min((c[-1] if c else 0) + cap, total) for c, cap in zip(cuts, capacities, strict=True)]
        near = F.lit(False)
        for x in limits:
            near = near | ((F.col("upto") > x - largest) & (F.col("upto") <= x))
        row = sums.filter(near).agg(
            *[F.max(F.when(F.col("upto") <= x, F.col("upto"))).alias(f"c{i}") for i, x in enumerate(limits)]
        ).first()
        for i, c in enumerate(cuts):
            c.append(row[i] if row[i] is not None else (c[-1] if c else 0))
    return cuts


def smallest_capacity(sums: DataFrame, shards: int = SHARDS) -> tuple[int, list[int]]:
    """The smallest capacity that needs at most ``shards`` shards, and the prefix sums where they end."""
    total, largest = sums.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest
    while low < high:
        step = max(1, (high - low) // TESTED)
        tested = list(range(low, high, step))[: TESTED + 1]
        ends = [c[-1] >= total for c in _fill(sums, tested, shards, largest, total)]
        if True in ends:
            first = ends.index(True)
            low, high = (tested[first - 1] + 1 if first else low), tested[first]
        else:
            low = tested[-1] + 1
    return high, _fill(sums, [high], shards, largest, total)[0] if total else [0] * shards


def sharded(docs: DataFrame, owner: str = "sharding", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("key"),
    )
    rows = _ranged(rows, ["doc_id", "text_crc32"], owner)
    groups = rows.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.sum("size").alias("bytes"))
    groups = scratch.written(groups, owner)
    sums = prefix_sums(groups, owner)
    _, cuts = smallest_capacity(sums, shards)
    shard = sum([(F.col("upto") > c).cast("int") for c in cuts[:-1]], F.lit(0))
    of_group = sums.select("key", shard.alias("shard"))
    placed = scratch.written(rows.join(of_group, "key").drop("key"), owner)
    # Slots: number the rows inside (range partition, shard), then add what earlier partitions put into the shard.
    counts = placed.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part", "shard").orderBy("doc_id", "text_crc32")
    out = placed.withColumn("_at", F.row_number().over(inside) - 1).join(counts, ["shard", "_part"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("_at") + F.col("_before")).alias("slot"))


def op8_minimax_shards(spark, sf_dir: str) -> DataFrame:
    out = sharded(scratch.table(spark, sf_dir, "documents"), "op8")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


# The CRC table comes from its polynomial; capacities are halved down to the smallest with which greedy filling, one
# shard a step, ends within 8 shards.
OP8_SQL = """
WITH RECURSIVE crc_bits AS (
  SELECT i, 0 AS step, i AS c FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, step + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_bits WHERE step < 8),
crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM crc_bits WHERE step = 8),
texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h
  FROM documents),
octets AS (SELECT r, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM texts),
checked AS (
  SELECT r, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(crcs[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) AS crc
  FROM octets, crc_table),
grouped AS (SELECT t, min(doc_id) AS first_doc, sum(n + 1)::BIGINT AS bytes FROM texts GROUP BY t),
sums AS (SELECT t, bytes, (sum(bytes) OVER (ORDER BY first_doc NULLS LAST, sha256(t) ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM grouped),
every AS (SELECT list(upto) AS sums, max(bytes) AS largest, sum(bytes)::BIGINT AS total FROM sums),
search AS (
  SELECT greatest(largest, (total + 7) // 8) AS low, (total + 7) // 8 + largest AS high, 0 AS k, 0::BIGINT AS cut FROM every
  UNION ALL
  SELECT CASE WHEN k = 8 AND cut < total THEN (low + high) // 2 + 1 ELSE low END,
         CASE WHEN k = 8 AND cut >= total THEN (low + high) // 2 ELSE high END,
         CASE WHEN k = 8 THEN 0 ELSE k + 1 END,
         CASE WHEN k = 8 THEN 0 ELSE coalesce(list_max(list_filter(sums, lambda x: x <= cut + (low + high) // 2)), 0) END
  FROM search, every WHERE low < high),
capacity AS (SELECT min(high) AS most FROM search),
cuts AS (
  SELECT 0 AS k, 0::BIGINT AS cut
  UNION ALL
  SELECT k + 1, coalesce(list_max(list_filter(sums, lambda x: x <= cut + most)), 0) FROM cuts, every, capacity WHERE k < 7),
ends AS (SELECT list(cut) AS ends FROM cuts WHERE k > 0),
placed AS (
  SELECT doc_id, n + 1 AS size, crc, len(list_filter(ends, lambda x: x < upto)) AS shard
  FROM texts JOIN checked USING (r) JOIN sums USING (t), ends)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
       (row_number() OVER (PARTITION BY shard ORDER BY doc_id, crc) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""
