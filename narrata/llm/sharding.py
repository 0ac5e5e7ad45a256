"""Sharding: a minimax contiguous partition of documents, so that the fullest shard holds as few bytes as possible.

Texts are ordered by their MD5; texts with the same leading bits form one atomic group, so equal texts always stay
together. With 2**bits groups (65,536 by default, whatever the input) their sizes are a bounded table. The smallest
feasible capacity is found by binary search; a capacity is feasible if filling shards greedily in order needs no more
than n of them. The cuts of that filling are the shards' bounds. Everything is a DataFrame expression, but for the
search over the bounded table of group sizes on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one atomic group are numbered in so many parts, so that a group with a third of all rows is no single task.
PARTS = 64


def greedy(sizes: list[int], capacity: int) -> list[int]:
    """First group of each shard when each takes groups in order as long as they fit."""
    cuts, full = [0], 0
    for k, size in enumerate(sizes):
        if full and full + size > capacity:
            cuts.append(k)
            full = 0
        full += size
    return cuts


def minimax(sizes: list[int], n: int) -> tuple[int, list[int]]:
    """The smallest capacity for which n shards suffice, and the first group of each shard (up to n of them)."""
    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if len(greedy(sizes, middle)) <= n else (middle + 1, high)
    return low, greedy(sizes, low)


def group(text: Column, bits: int) -> Column:
    """Number of a text's atomic group, in the order of the MD5; a null text goes with the empty one."""
    head = F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 8), 16, 10).cast("bigint")
    return F.shiftright(head, 32 - bits).cast("int")


def assign(docs: DataFrame, n: int = 16, bits: int = 16) -> DataFrame:
    """All columns given, with size, shard (0 to n - 1) and slot (gapless from 0 in each shard).

    size: UTF-8 bytes of the text (null: none) plus 1. Rows keep their order by group, part and doc_id in a shard; equal
    rows may swap slots, which gives the same table; null ids come first. An empty table gives an empty result. Columns
    of the input named size, shard or slot give way to the new ones; all others are kept, whatever their names.
    """
    if not 1 <= bits <= 24:
        raise ValueError("bits must be from 1 to 24: the driver holds one number for each group")
    kept = [F.col(f"`{name}`") for name in docs.columns if name not in ("size", "shard", "slot")]
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint")
    grouped = docs.select(F.struct(*kept).alias("row"), F.col("doc_id").alias("id"), size.alias("size"), group(F.col("text"), bits).alias("group"), F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("part"))
    counts = grouped.groupBy("group", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    groups = sorted((row[0], row[1]) for row in counts.groupBy("group").agg(F.sum("bytes")).collect())
    _, firsts = minimax([x for _, x in groups], n)
    cuts = [groups[k][0] for k in firsts[1:] if groups]
    shard = reduce(lambda a, b: a + b, [(F.col("group") >= c).cast("int") for c in cuts], F.lit(0))
    before = Window.partitionBy("shard").orderBy("group", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("shard", shard).select(F.col("group").alias("g"), F.col("part").alias("p"), "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("group", "part").orderBy("id")
    numbered = grouped.withColumn("nth", F.row_number().over(inside) - 1)
    placed = numbered.join(starts, (F.col("group") == F.col("g")) & (F.col("part") == F.col("p")))
    return placed.select("row.*", "size", "shard", (F.col("start") + F.col("nth")).cast("bigint").alias("slot"))


def digest(docs: DataFrame, n: int = 16, bits: int = 16) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot and grown_shard, which this law leaves null."""
    narrow = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return assign(narrow, n, bits).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, path: str, n: int = 16, bits: int = 16) -> None:
    """Writes shards as Parquet folders shard=0, shard=1 ...; several files a shard, each a range of slots."""
    assign(docs, n, bits).write.partitionBy("shard").parquet(path)
