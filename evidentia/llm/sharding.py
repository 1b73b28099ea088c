"""Sharding by longest-processing-time scheduling.

Groups that must stay together (equal texts) are sorted by size and go, largest first, to the least-loaded
shard through a heap. The scheduler runs on the driver over a bounded number of items: a group of at least
1/64 of an even shard is an item of its own (there can be at most 64 x n_shards of them); all smaller groups are
first bound together by the hash of their text into 256 x n_shards composite groups, each of which is an item.
So the driver holds at most 320 x n_shards items whatever the input, every group stays whole, and shards end
within about one composite group of each other unless one single group is larger than an even shard.

Cases: a null text is the empty text (0 bytes plus the overhead) and shares its group; a null id is kept;
equal rows are shared out as the copies they are; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import ADDRESS, addressed, discard, for_texts, materialize, pick, text_hashes

LARGE = 64
BINS = 256
SUBS = 256


def lpt(items: list[tuple[int, object]], n_shards: int) -> dict[object, int]:
    """Largest first, each to the least-loaded shard; ties by key and by shard number."""
    heap = [(0, s) for s in range(n_shards)]
    placed = {}
    for size, key in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        load, shard = heapq.heappop(heap)
        placed[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def _rows(docs: DataFrame, overhead: int, *more) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2 = text_hashes(text)
    size = (F.octet_length(text) + F.lit(overhead)).cast("long")
    return docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), h1.alias("h1"), h2.alias("h2"), *more)


def _schedule(rows: DataFrame, n_shards: int) -> tuple[DataFrame, DataFrame]:
    """The shard of each large group, and of each composite group; both bounded by n_shards."""
    spark = rows.sparkSession
    groups = materialize(rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") * (LARGE * n_shards) >= F.lit(total)
    alone = groups.where(large).select("h1", "h2", "bytes").collect()  # at most LARGE x n_shards rows
    bound = groups.where(~large).groupBy(_bin(n_shards).alias("bin")).agg(F.sum("bytes").alias("bytes")).collect()  # at most BINS x n_shards
    placed = lpt([(r.bytes, (r.h1, r.h2)) for r in alone] + [(r.bytes, r.bin) for r in bound], n_shards)
    discard(groups)
    own = spark.createDataFrame([(*k, s) for k, s in placed.items() if isinstance(k, tuple)], "h1 long, h2 long, own_shard int")
    bins = spark.createDataFrame([(k, s) for k, s in placed.items() if not isinstance(k, tuple)], "bin int, bin_shard int")
    return own, bins


def _bin(n_shards: int):
    return F.pmod(F.col("h1"), F.lit(BINS * n_shards)).cast("int")


def _with_shard(rows: DataFrame, schedule: tuple[DataFrame, DataFrame], n_shards: int) -> DataFrame:
    own, bins = schedule
    rows = rows.withColumn("bin", _bin(n_shards)).join(F.broadcast(bins), "bin", "left").join(F.broadcast(own), ["h1", "h2"], "left")
    return rows.withColumn("shard", F.coalesce("own_shard", "bin_shard")).withColumn("sub", F.pmod(F.xxhash64("doc_id", "h1"), F.lit(SUBS)).cast("int")).drop("bin", "bin_shard", "own_shard")


def _with_slot(rows: DataFrame, skinny: DataFrame) -> DataFrame:
    """Adds slot. Each shard is cut into SUBS parts by hash, so no task numbers a whole shard; the parts' offsets come from their counts."""
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    at = skinny.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n")).select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("shard", "sub").orderBy(F.col("doc_id").asc_nulls_last(), "h1", "h2"))
    numbered = rows.withColumn("rank", rank).join(F.broadcast(at), ["shard", "sub"])  # SUBS rows a shard
    return numbered.withColumn("slot", (F.col("offset") + F.col("rank") - 1).cast("long")).drop("sub", "offset", "rank")


def _placed(rows: DataFrame, n_shards: int) -> DataFrame:
    rows = materialize(rows, "shard-rows")
    rows = _with_shard(rows, _schedule(rows, n_shards), n_shards)
    return _with_slot(rows, rows)


def shard_documents(docs: DataFrame, n_shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, h1, h2 (the group's identity), shard, slot (gapless from 0 in each shard)."""
    for_texts(docs.sparkSession)
    return _placed(_rows(docs, overhead), n_shards)


def place(docs: DataFrame, n_shards: int = 40, overhead: int = 16) -> DataFrame:
    """docs with all its columns, and shard and slot (columns of these names in docs are replaced). Texts are met by their rows' addresses."""
    for_texts(docs.sparkSession)
    rows = addressed(docs)
    narrow = rows.select(F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"), *ADDRESS)
    places = _placed(_rows(narrow, overhead, *ADDRESS), n_shards).select(*ADDRESS, "shard", "slot")
    rest = [F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    return pick(rows, places).select(*rest, "shard", "slot")


def query(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
