"""Benchmark decontamination: documents that contain test items, found by size-partitioned MinHash.

Items are partitioned by their number of five-word shingles; the partition sets a window width. A document of any
length is cut into windows of that many shingles, side by side, and each gives its MinHashes under two permutations
(the least and the greatest shingle hash); an item gives those of every window of that width, at every offset. A pair
with an equal MinHash is a candidate. Candidates are verified by the exact containment of the item's distinct shingles.

What is found for certain: a run of 2 * width - 1 shingles that both have holds a whole window, whose MinHashes are
equal on both sides. The widths are chosen so that one copy of an item, edited in places, always leaves such a run
while the threshold of shingles is left: an edit inside a text removes at least four shingles, so few edits fit under
the threshold, and the longest run left is long. Items of under nine shingles, and items that say a shingle twice,
take width 1, where every shared shingle is a candidate. What is assumed: that a document holds an item as a passage.
A document that holds 80 % of an item's shingles scattered in runs shorter than two windows is a candidate only if
some window of it shares an extreme hash with one of the item's; tests measure the recall on such sets.
Everything is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import BROADCAST_ROWS, NEAR, SHINGLE, let, plain_words, settle, shingles, small

#: (least shingles of an item, window width), for a threshold of 0.8 or more: the longest run left is at least
#: 0.8 n / (0.05 n + 1) from 20 shingles on and 0.8 n below, where no edit inside the item fits.
PARTITIONS = [(1, 1), (9, 4), (40, 6), (200, 8)]


def minima(hashes: Column, width: int, step: int) -> Column:
    """MinHashes, under two permutations, of each whole window of `width` shingles, `step` apart."""
    count = lambda h: F.floor((F.size(h) - width) / step).cast("int")
    both = lambda w: F.array(F.array_min(w), F.array_max(w))
    each = lambda h: F.flatten(F.transform(F.sequence(F.lit(0), count(h)), lambda j: let(F.slice(h, j * step + 1, width), both)))
    return let(hashes, lambda h: F.when(F.size(h) >= width, h if width == step == 1 else each(h)).otherwise(F.array().cast("array<bigint>")))


def containment(docs: DataFrame, items: DataFrame, threshold: float = NEAR, n: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, item_id, n_shared, n_item, containment) of every document that holds an item.

    docs: doc_id, text; items: item_id, text. text_key is xxhash64 of the document's text, for ids that occur twice.
    Null and empty texts, and items of fewer than n words, have no shingles and match nothing. Equal rows of either
    table count once; null ids are kept as an id; empty tables give an empty result; other columns are not read.
    """
    if threshold < NEAR:
        raise ValueError(f"the windows are proven for thresholds from {NEAR}")
    own = items.select("item_id", shingles(plain_words(F.col("text")), n).alias("h")).where(F.size("h") > 0)
    own = settle(own.groupBy("item_id", "h").agg(F.array_distinct("h").alias("set")))
    ranges = [(low, width, PARTITIONS[k + 1][0] if k + 1 < len(PARTITIONS) else None) for k, (low, width) in enumerate(PARTITIONS)]
    own = own.withColumn("part", F.when(F.size("h") == F.size("set"), F.size("h")).otherwise(F.lit(1)))
    sizes = own.select(F.col("part").alias("n"))
    used = [r for r in ranges if sizes.where((F.col("n") >= r[0]) & (F.lit(True) if r[2] is None else F.col("n") < r[2])).head(1)]
    if not used:
        used = ranges[:1]
    keys = [
        own.where((F.col("part") >= low) & (F.lit(True) if high is None else F.col("part") < high)).select(F.lit(width).alias("width"), F.explode(minima(F.col("h"), width, 1)).alias("m"), "item_id")
        for low, width, high in used
    ]
    probes = keys[0]
    for more in keys[1:]:
        probes = probes.unionByName(more)
    probes = small(probes.distinct())
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    every = hashed.select("doc_id", "text_key", shingles(plain_words(F.col("text")), n).alias("h"))
    cut = lambda width: F.transform(minima(F.col("h"), width, width), lambda m: F.struct(F.lit(width).alias("width"), m.alias("m")))
    windows = every.select("doc_id", "text_key", F.explode(F.flatten(F.array(*[cut(width) for _, width, _ in used]))).alias("w")).select("doc_id", "text_key", "w.width", "w.m")
    found = settle(windows.join(probes, ["width", "m"]).select("doc_id", "text_key", "item_id").distinct())
    return verified(hashed, own, found, threshold, n)


def verified(hashed: DataFrame, own: DataFrame, found: DataFrame, threshold: float, n: int) -> DataFrame:
    """Of the pairs found, those whose exact containment reaches the threshold."""
    keys = found.select("doc_id", "text_key").distinct()
    keys = F.broadcast(keys) if found.count() <= BROADCAST_ROWS else keys
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
    likely = hashed.join(keys, same(hashed, keys), "left_semi").select("doc_id", "text_key", F.explode(F.array_distinct(shingles(plain_words(F.col("text")), n))).alias("s"))
    parts = small(own.select("item_id", F.size("set").alias("n_item"), F.explode("set").alias("s")))
    shared = likely.distinct().join(parts, "s").groupBy("doc_id", "text_key", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    right = found.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.col("item_id").alias("i"))
    met = shared.join(right, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")) & F.col("item_id").eqNullSafe(F.col("i")), "left_semi")
    ratio = F.col("n_shared") / F.col("n_item")
    return met.select("doc_id", "text_key", "item_id", "n_shared", F.col("n_item").cast("bigint").alias("n_item"), ratio.alias("containment")).where(ratio >= threshold)


def filter_documents(docs: DataFrame, items: DataFrame, threshold: float = NEAR) -> DataFrame:
    """The documents that contain no item; columns doc_id, text, lang, source and n_chars.

    Only ids and hashes of contaminated documents are joined back: broadcast if few, else by shuffle.
    """
    bad = settle(containment(docs, items, threshold).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).distinct())
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return own.join(bad, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_k")), "left_anti")
