"""Sharding by longest-processing-time scheduling of groups that must stay together.

Law ``bytes``: shard sizes come out near equal. Groups are equal texts (or any key). A group whose size is at
least ``total / (shards * grain)`` is scheduled on its own; there are at most ``shards * grain`` of these. The
smaller groups are dealt by hash into ``shards * grain`` bundles, so the heap on the driver sees at most
``2 * shards * grain`` items however many groups there are. Items go in order of size, largest first, each to
the least-loaded shard. A group larger than ``total / shards`` makes its shard larger than the mean; the
condition that equal texts share a shard leaves no other way.

Slots are dealt without putting a shard into one task: rows are numbered in sub-buckets of a shard, as many as
the number of rows asks for, and shifted by the counts of the sub-buckets before. Rows fall into sub-buckets by their
number in the written table, so no key can fill one.

Defined results
    null text: a group of its own (all null texts together), 0 bytes plus the fixed cost, crc32 0.
    empty text: 0 bytes plus the fixed cost. Ties are broken by group hash, then by shard number.
    repeated rows, null or equal doc_ids: each row gets a slot of its own. very long texts: read whole.
    empty table: empty result. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import workspace

ROW_COST = 16
#: Rows that one task numbers, about; the table of sub-buckets that is broadcast has a row for as many rows.
SUB_ROWS = 50_000


def schedule(items: list[tuple[int, str]], shards: int) -> list[int]:
    """Shard of each (size, name) item: largest first, each to the least-loaded shard of a heap."""
    order = sorted(range(len(items)), key=lambda i: (-items[i][0], items[i][1]))
    heap = [(0, s) for s in range(shards)]
    out = [0] * len(items)
    for i in order:
        load, s = heapq.heappop(heap)
        out[i] = s
        heapq.heappush(heap, (load + items[i][0], s))
    return out


def assign_shards(rows: DataFrame, shards: int, grain: int = 64, sub_rows: int = SUB_ROWS) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows with columns ``g1``, ``g2`` (group hash) and ``size``."""
    spark = rows.sparkSession
    rows = workspace.written(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    sub_buckets = max(1, -(-rows.count() // (shards * sub_rows)))
    groups = rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"))
    groups = workspace.written(groups, "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") >= F.lit(max(1, -(-total // (shards * grain))))
    alone = groups.filter(large).select("g1", "g2", "bytes").collect()
    bundle = F.pmod(F.xxhash64("g2", "g1"), F.lit(shards * grain)).cast("int")
    bundles = groups.filter(~large).groupBy(bundle.alias("bundle")).agg(F.sum("bytes").alias("bytes")).collect()
    items = [(r.bytes, f"g{r.g1}/{r.g2}") for r in alone] + [(r.bytes, f"b{r.bundle}") for r in bundles]
    placed = schedule(items, shards)
    own = spark.createDataFrame([(r.g1, r.g2, s) for r, s in zip(alone, placed)], "g1 bigint, g2 bigint, own int")
    dealt = spark.createDataFrame([(r.bundle, s) for r, s in zip(bundles, placed[len(alone) :])], "bundle int, dealt int")
    # both tables have at most shards * grain rows
    out = (
        rows.withColumn("bundle", bundle)
        .join(F.broadcast(own), ["g1", "g2"], "left")
        .join(F.broadcast(dealt), "bundle", "left")
        .withColumn("shard", F.coalesce("own", "dealt"))
        .withColumn("sub", F.pmod(F.xxhash64("row"), F.lit(sub_buckets)).cast("int"))
        .drop("bundle", "own", "dealt")
    )
    counts = out.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("row"))
    # base has at most shards * sub_buckets rows, about one for sub_rows rows
    return (
        out.withColumn("rank", rank)
        .join(F.broadcast(base), ["shard", "sub"])
        .withColumn("slot", (F.col("base") + F.col("rank") - 1).cast("long"))
        .drop("rank", "base", "sub", "row")
    )


def shard_documents(docs: DataFrame, shards: int, text: Column | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) with equal texts in one shard."""
    text = F.col("text") if text is None else text
    rows = docs.select(
        F.xxhash64(text).alias("g1"),
        F.xxhash64(F.lit(3), text).alias("g2"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_COST).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.col("doc_id"),
    )
    return assign_shards(rows, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents into 40 shards of near equal bytes."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 40)
