"""Mixing sources to target weights.

Every source's documents stand one after another as a stream of words, cut into blocks of a fixed number of words.
Each output shard draws how many blocks it takes from each source: a multinomial draw by what the sources' targets have
left, so that shards differ by chance and the sums meet the targets to a block. A source's slots are numbered through all shards; slot i takes block P(i mod N), where N is the source's number of
blocks and P its own pseudorandom permutation (a Feistel network that walks its cycles down to N). Slots join
the documents' pieces by (source, block).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.llm.common import BROADCAST_ROWS, WORD, settle, words

#: Words in a block, output shards, times that a source may be repeated at most.
BLOCK, SHARDS, MOST = 64, 16, 3
#: A source is ordered in parts, each for itself: so many, or more where they would hold more rows than these on average.
PARTS, PART_ROWS = 256, 100_000
#: Slots that one row of the slot plan stands for at most, and that one task makes.
RUN, TASK = 1_000_000, 200_000


def targets(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Shares of the sum of sizes by weight; none over `most` times its size, the excess reshared by weight among the rest."""
    left, out = float(sum(sizes)), [0.0] * len(sizes)
    weight = float(sum(w for s, w in zip(sizes, weights, strict=True) if s))
    for k in sorted((k for k in range(len(sizes)) if sizes[k]), key=lambda k: most * sizes[k] / weights[k]):
        out[k] = min(float(most * sizes[k]), left * weights[k] / weight)
        left, weight = left - out[k], weight - weights[k]
    return out


def draws(sizes: list[int], wanted: list[float], block: int, shards: int, seed: int, most: int = MOST) -> np.ndarray:
    """Blocks that each shard takes from each source, as an array of shards by sources.

    A source's blocks over all shards are fixed beforehand: its target in blocks, rounded, and `most` of each at most.
    Shards are as large as each other (to one block). Each draws its counts from a multinomial whose probabilities are
    what the sources have left; what a source has no more is drawn again from the others; the last shard has what is
    left. So every shard's mix is random around the weights while the sums meet the targets.
    """
    n = np.array([-(-s // block) for s in sizes], dtype=np.int64)
    mean = np.array([s / k if k else 1.0 for s, k in zip(sizes, n, strict=True)])
    left = np.minimum(np.rint(np.array(wanted) / mean).astype(np.int64), most * n)
    out = np.zeros((shards, len(sizes)), dtype=np.int64)
    for shard in range(shards):
        rng, due = np.random.default_rng([seed, shard]), int(left.sum()) // (shards - shard)
        while due:
            drawn = np.minimum(rng.multinomial(due, left / left.sum()), left) if shard < shards - 1 else left.copy()
            out[shard], left, due = out[shard] + drawn, left - drawn, due - int(drawn.sum())
    return out


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of 0 to n - 1, one for each key, sends the indices."""
    half = np.maximum(1, np.ceil(np.ceil(np.log2(np.maximum(n, 2))) / 2)).astype(np.uint64)
    mask, out, todo = (np.uint64(1) << half) - np.uint64(1), index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, x, k = half[todo], mask[todo], out[todo], key[todo].astype(np.uint64)
        a, b = x >> h, x & m
        for turn in range(4):
            z = b * np.uint64(0x9E3779B97F4A7C15) + k + np.uint64(turn * 0xBF58476D1CE4E5B9 % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            a, b = b, (a ^ (z >> np.uint64(31))) & m
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def slots(plans: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(sid, block) of each slot of the plan's runs."""
    for plan in plans:
        for row in plan.itertuples():
            at = np.arange(row.first, row.first + row.count, dtype=np.int64)
            n = np.full(len(at), row.n, dtype=np.int64)
            yield pd.DataFrame({"sid": np.full(len(at), row.sid, dtype=np.int32), "block": permute(at % row.n, n, np.full(len(at), row.key, dtype=np.int64))})


class Mix:
    """A mix of `docs` (doc_id, text, lang, source, n_chars) to weights; the same rows give the same mix.

    weights: one number for each source in code point order, null last, repeating. A null or empty text, or one of
    white space only, has no words and is never taken. Equal rows are documents of their own. A source without words has
    target 0. An empty table gives an empty mix. Other columns of the input are not read.

    Source totals are collected to the driver, one row a source; they are bounded by `max_sources`.
    """

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), block: int = BLOCK, shards: int = SHARDS, seed: int = 17, max_sources: int = 1_000_000) -> None:
        self.docs, self.block, spark = docs, block, docs.sparkSession
        size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint")
        narrow = settle(docs.select("doc_id", "source", F.xxhash64("text", "lang", "n_chars").alias("text_key"), size.alias("size")))
        totals = narrow.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).limit(max_sources + 1).collect()
        if len(totals) > max_sources:
            raise ValueError(f"over {max_sources} sources")
        totals.sort(key=lambda r: (r.source is None, r.source or ""))
        sizes = [r.n for r in totals]
        wanted = targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))])
        counts = draws(sizes, wanted, block, shards, seed)
        plan, rows = [], []
        for sid, row in enumerate(totals):
            n, first = -(-row.n // block), 0
            key = int.from_bytes(hashlib.md5(f"{seed}/{row.source}".encode()).digest()[:7], "big")
            rows.append((row.source, sid, row.n, wanted[sid]))
            for shard in range(shards):
                for start in range(0, int(counts[shard, sid]), RUN):
                    length = min(RUN, int(counts[shard, sid]) - start)
                    plan.append((sid, shard, first + start, length, n, key))
                first += int(counts[shard, sid])
        self.sources = spark.createDataFrame(rows, "source string, sid int, source_size bigint, target double")
        #: Tasks that make the slots: a number of its own, or Spark would take the plan's few rows for one task's work.
        self.tasks = max(1, min(len(plan), -(-int(counts.sum()) // TASK)))
        parts = max(PARTS, sum(r.rows for r in totals) // PART_ROWS)
        self.plan = spark.createDataFrame(plan, "sid int, shard int, first bigint, count bigint, n bigint, key bigint")
        few = F.broadcast(self.sources) if len(rows) <= BROADCAST_ROWS else self.sources
        own = narrow.join(few.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        own = own.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(parts)))
        starts = own.groupBy("sid", "part").agg(F.sum("size").alias("n")).select(
            F.col("sid").alias("_sid"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
        )
        inside = Window.partitionBy("sid", "part").orderBy("doc_id", "text_key").rowsBetween(Window.unboundedPreceding, 0)
        placed = own.withColumn("until", F.sum("size").over(inside)).withColumn("copy", F.row_number().over(Window.partitionBy("sid", "part").orderBy("doc_id", "text_key")))
        placed = placed.join(starts, (F.col("sid") == F.col("_sid")) & (F.col("part") == F.col("_part"))).drop("_sid", "_part")
        #: One row a document: where its words start in its source's stream. (part, copy) tells equal rows apart.
        self.placed = placed.withColumn("start", F.col("before") + F.col("until") - F.col("size")).drop("before", "until")

    def times(self) -> DataFrame:
        """(sid, block, times): how often the mix takes each block; blocks not taken are absent."""
        return self.plan.repartition(self.tasks, "sid", "shard", "first").mapInPandas(slots, "sid int, block bigint").groupBy("sid", "block").agg(F.count("*").alias("times"))

    def pieces(self) -> DataFrame:
        """One row for each document and block it has words in: the words' range in the document, and times taken."""
        last = F.floor((F.col("start") + F.col("size") - 1) / self.block)
        spans = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / self.block), last))
        each = self.placed.withColumn("block", F.explode_outer(spans))
        each = each.withColumn("first", F.greatest(F.lit(0), F.col("block") * self.block - F.col("start"))).withColumn("end", F.least(F.col("size"), (F.col("block") + 1) * self.block - F.col("start")))
        # The planner takes the slots for as few as the plan's rows and would broadcast them; they grow with the corpus.
        return each.join(self.times().hint("merge"), ["sid", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))

    def taken(self) -> DataFrame:
        """One row a document: doc_id, size, source_size, target and taken, the words that the mix takes from it."""
        keys = ["doc_id", "source", "size", "source_size", "target", "sid", "part", "copy"]
        summed = self.pieces().groupBy(*keys).agg(F.sum(F.coalesce((F.col("end") - F.col("first")) * F.col("times"), F.lit(0))).alias("taken"))
        return summed.select("doc_id", "source", "size", "source_size", "target", "taken")

    def documents(self) -> DataFrame:
        """The mix as documents: a row for each time that a document, or the part of it that is taken so often, is taken.

        A text taken whole keeps its form; of others the taken words stay, joined by blanks. n_chars is counted anew.
        """
        runs = self.pieces().where(F.col("times") > 0).groupBy("doc_id", "text_key", "sid", "part", "copy", "size").agg(F.sort_array(F.collect_list(F.struct("first", "end", "times"))).alias("runs"))
        nth = Window.partitionBy("doc_id", "text_key").orderBy("sid", "part", "copy")
        runs = runs.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), F.col("size").alias("_size"), "runs", F.row_number().over(nth).alias("_n"))
        own = self.docs.select("doc_id", "text", "lang", "source", "n_chars", F.xxhash64("text", "lang", "n_chars").alias("_key"))
        own = own.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id", "_key").orderBy(F.col("source").isNull(), "source")))
        met = own.join(runs, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")) & (F.col("_nth") >= F.col("_n")) & (F.col("_nth") <= F.col("_n")))
        met = met.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("bigint"), F.array_max("runs.times"))))
        now = F.filter("runs", lambda r: r["times"] >= F.col("_time"))
        whole = F.aggregate(now, F.lit(0).cast("bigint"), lambda acc, r: acc + r["end"] - r["first"]) == F.col("_size")
        part = F.array_join(F.flatten(F.transform(now, lambda r: F.slice(words(F.col("text")), (r["first"] + 1).cast("int"), (r["end"] - r["first"]).cast("int")))), " ")
        return met.withColumn("text", F.when(whole, F.col("text")).otherwise(part)).select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))
