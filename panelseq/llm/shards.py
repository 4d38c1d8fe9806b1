"""Contiguous shards of equal bytes from global prefix sums.

The rows are put in order by one range shuffle of (id, size, checksum); texts stay where they are. Each
range partition gives its totals, their running sums give the offset of each partition, and a row's own
offset follows inside its partition. A row belongs to the shard in whose byte range it starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelseq.llm.common import narrow, safe_text, shuffle_partitions
from panelseq.session import cut


def shard_of(start: str, total: str, shards: int) -> Column:
    """floor(start * shards / total) in integers: a decimal quotient is rounded to six places and can reach the next shard."""
    return F.expr(f"(cast(`{start}` as decimal(38,0)) * {shards}) div cast(`{total}` as decimal(38,0))").cast("int")


def byte_shards(docs: DataFrame, shards: int, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) in order of id.

    Size is the text's UTF-8 bytes (null: none) plus ``overhead``. No shard's bytes differ from
    total / shards by more than the largest row. ``slot`` counts the rows of a shard from 0 in order.
    Equal and null ids are ordered by checksum, size and their place in the input, so that a repeated
    row is no problem for the balance. More shards than rows leave some shards empty.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.encode(safe_text("text"), "UTF-8")
    rows = narrow(docs, id_col, text_col).toDF("doc_id", "text").select(
        "doc_id", (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"))
    order = ["doc_id", "text_crc32", "size", "place"]
    placed = cut(rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
                 .withColumn("part", F.spark_partition_id()))
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(every).alias("all_bytes"))
    inside = Window.partitionBy("part").orderBy(*order)
    at = placed.withColumn("own_bytes", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    at = at.withColumn("own_row", F.row_number().over(inside) - 1).join(F.broadcast(offsets), "part")
    at = at.withColumn("start", F.col("bytes_before") + F.col("own_bytes"))
    at = at.withColumn("shard", shard_of("start", "all_bytes", shards)).withColumn("row", F.col("rows_before") + F.col("own_row"))
    at = at.select("doc_id", "size", "text_crc32", "shard", "row")
    first = at.groupBy("shard").agg(F.min("row").alias("first_row"))
    return at.join(F.broadcast(first), "shard").select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"))
