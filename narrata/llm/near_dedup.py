"""MinHash near-dedup with BagMinHash: signatures whose equal parts estimate the weighted Jaccard similarity of bags.

A document's bag is its five-word shingles with their counts. For each shingle, Poisson processes run over a grid of
weights that is cut in halves of doubling length, (0, 1], (1, 2], (2, 4] ...: every point has a time, a signature
component and a weight, and counts for bags whose count of the shingle reaches that weight. A component keeps its
earliest point. Points come in order of time and a process stops once it is later than the latest component, so a
weight costs its logarithm and most shingles a point or two.

Signatures are cut in bands; documents with an equal band are compared by the exact overlap of their bags. Exact
copies (equal words in equal order) are one node from the start. First all nodes of a bucket are compared with one
leader, which differs between bands. The nodes of buckets that still hold more than one group then meet wherever an
exact prefix, position and length filter allows a similarity that high and the groups differ: in rounds with the
centre of each shared element, until nearly all that belongs together is one group, and what is still allowed in
pairs. So no link between groups is lost, a large group costs few comparisons, and a passage that many documents
share costs none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import BROADCAST_ROWS, NEAR, SHINGLE, plain_words, settle

#: A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8 ** 5) ** 30, which is 0.999993.
BANDS, ROWS = 30, 5
#: Orders that pick the leaders, one for every so many bands: a node meets up to this many leaders in the first round.
LEADERS = 4
#: Rounds, at most, in which nodes of open buckets meet centres before the pairs that are left are compared.
ROUNDS = 3
#: Edges that the driver may join to components itself: 32 bytes each.
FEW_EDGES = 20_000
#: Ids that may be broadcast as single keys, at most: a hash table of some 100 MB. They are counted first.
SINGLE_KEYS = 2_000_000
#: Words that the signature code holds in memory at a time; one longer document is taken alone.
CHUNK = 400_000
#: An odd number: a shingle's hash is a polynomial of its words' hashes, mixed.
MULTIPLIER = np.uint64(0x9FB21C651E98DF25)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers."""
    z = x + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def bags(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of each distinct shingle of each document."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    starts = np.flatnonzero(new)
    return doc[starts], values[starts], np.diff(np.append(starts, len(doc)))


def signatures(values: np.ndarray, lengths: np.ndarray, m: int) -> np.ndarray:
    """BagMinHash signatures, one row of m 64-bit numbers a document; documents without shingles get zeros."""
    doc, feature, count = bags(values, lengths)
    when, what = np.full((len(lengths), m), np.inf), np.zeros((len(lengths), m), dtype=np.uint64)
    of = feature.astype(np.uint64)
    # Every point of the first grid cell, (0, 1], counts: nearly all shingles have no other.
    ended(when, what, m, of ^ mix64(np.zeros(1, dtype=np.uint64)), doc)
    often = np.flatnonzero(count > 1)
    levels = np.ceil(np.log2(count[often])).astype(np.int64)
    at = np.repeat(often, levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels) + 1
    low = 2.0 ** (level - 1)
    ended(when, what, m, of[at] ^ mix64(level.astype(np.uint64)), doc[at], low, count[at])
    return what


def ended(when: np.ndarray, what: np.ndarray, m: int, seed: np.ndarray, owner: np.ndarray, low: np.ndarray | None = None, most: np.ndarray | None = None) -> None:
    """Runs processes of documents (owner) to their ends, and keeps the earliest point of each component in when and what.

    Processes are over (0, 1] with all points counting, or over (low, 2 low] with those of a weight below `most`.
    """
    seed, time, turn = mix64(seed), np.zeros(len(seed)), 0
    first, points = when.reshape(-1), what.reshape(-1)
    docs = np.unique(owner)
    latest = np.full(len(when), np.inf)
    while len(owner):
        turn += 1
        r = mix64(seed + np.uint64(turn * 0xD1342543DE82EF95 % 2**64))
        u = ((r >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
        time = time - np.log(u) / (m if low is None else m * low)
        latest[docs] = when[docs].max(axis=1)
        live = np.flatnonzero(time <= latest[owner])
        if len(live) < len(owner):
            seed, owner, time, r = seed[live], owner[live], time[live], r[live]
            low, most = (None, None) if low is None else (low[live], most[live])
            docs = docs[np.bincount(owner, minlength=len(when))[docs] > 0]
        s = mix64(r)
        cell = owner * m + ((s & np.uint64(0xFFFFFFFF)).astype(np.uint32) % np.uint32(m))
        t, v = time, r
        if low is not None:
            hit = low + low * ((s >> np.uint64(32)).astype(np.float64) / 2.0**32) < most
            cell, t, v = cell[hit], t[hit], v[hit]
        near = np.flatnonzero(t < first[cell])
        cell, t, v = cell[near], t[near], v[near]
        np.minimum.at(first, cell, t)
        won = t == first[cell]
        points[cell[won]] = v[won]


def chunks(column: pa.ListArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents, of lists of their words' hashes, of about CHUNK words: first, end, their shingles and how many
    each has."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        end = min(end, len(column))
        yield first, end, *shingled(values[offsets[first] : offsets[end]], np.diff(offsets[first : end + 1]))
        first = end


def shingled(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles of documents, and how many each has; one to four words make one shingle of all."""
    padded = np.append(words, np.zeros(SHINGLE - 1, dtype=np.uint64))
    found = padded[: len(words)].copy()
    for k in range(1, SHINGLE):
        found *= MULTIPLIER
        found += padded[k : k + len(words)]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    kept = np.arange(len(words)) + (SHINGLE - 1) < np.repeat(ends, lengths)
    for start, n in zip(*(x[(lengths > 0) & (lengths < SHINGLE)].tolist() for x in (starts, lengths)), strict=True):
        value = n
        for word in words[start : start + n].tolist():
            value = (value * int(MULTIPLIER) + word) % 2**64
        found[start], kept[start] = value, True
    return mix64(found[kept]).view(np.int64), np.where(lengths < SHINGLE, np.minimum(lengths, 1), lengths - (SHINGLE - 1)).astype(np.int64)


def list_column(batch: pa.RecordBatch, name: str) -> pa.ListArray:
    column = batch.column(name)
    return column.cast(pa.list_(pa.int64())) if not pa.types.is_list(column.type) else column


def band_rows(bands: int, rows: int):  # noqa: ANN201
    """A function for mapInArrow: adds a document's band hashes and bag size, drops its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, values, lengths in chunks(list_column(batch, "h")):
                signature = signatures(values, lengths, bands * rows).reshape(-1, bands, rows)
                hashed = np.full(signature.shape[:2], np.uint64(7))
                for k in range(rows):
                    hashed = mix64(hashed ^ signature[:, :, k])
                flat = pa.array(hashed.reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (end - first) * bands + 1, bands, dtype=np.int32)), flat)
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), pa.array(lengths.astype(np.int64)), lists], ["doc_id", "node", "n", "bands"])

    return run


def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: a bag as a set of distinct numbers, one for each shingle and each time it occurs."""
    for batch in batches:
        for first, end, values, lengths in chunks(list_column(batch, "h")):
            doc, feature, count = bags(values, lengths)
            at = np.repeat(np.arange(len(doc)), count)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            marked = np.where(nth == 0, feature[at].astype(np.uint64), mix64(feature[at].astype(np.uint64) + mix64(nth.astype(np.uint64)))).view(np.int64)
            flat = pa.array(marked)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.slice(first, end - first).column("node"), lists], ["node", "bag"])


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text's words and node: the MD5 of the words in order, 16 bytes; null for a text without words."""
    found = docs.select("doc_id", plain_words(F.col("text")).alias("words"))
    return found.withColumn("node", node(F.col("words")))


def node(found: Column) -> Column:
    return F.when(F.size(found) > 0, F.unhex(F.md5(F.array_join(found, " "))))


def word_hashes(found: Column) -> Column:
    """Hashes of words in order; shingles are made of these in Python, so that a word is hashed once and not five times."""
    return F.transform(found, lambda w: F.xxhash64(w))


def parted(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of docs whose doc_id is among the ids (one column), and all others; nulls are equal.

    Ids are broadcast up to SINGLE_KEYS of them, so that no text is shuffled; beyond that Spark joins by shuffle.
    """
    keys = settle(ids.toDF("_id").distinct())
    some = F.col("_id").isNotNull()
    known = keys.where(some)
    known = F.broadcast(known) if known.count() <= SINGLE_KEYS else known
    named, same = docs.where("doc_id is not null"), F.col("doc_id") == F.col("_id")
    within, without, nameless = named.join(known, same, "left_semi"), named.join(known, same, "left_anti"), docs.where("doc_id is null")
    return (within.unionByName(nameless), without) if keys.where(~some).head(1) else (within, without.unionByName(nameless))


def least_of_component(edges: list[tuple[bytes, bytes]]) -> dict[bytes, bytes]:
    """The least node of each node's component, by union of sets."""
    above: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above.setdefault(up, up)
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        above[max(x, y)] = min(x, y)
    return {x: top(x) for x in list(above)}


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node of its component.

    Labels fall to the least neighbour and jump to their label's label, so chains halve each round; at most `few` edges
    are joined by the driver instead, which saves it the plans of those rounds. Empty edges give an empty result.
    """
    edges = edges.select("a", "b")
    if len(some := edges.limit(few + 1).toArrow()) <= few:
        found = least_of_component(list(zip(*(some.column(k).to_pylist() for k in "ab"), strict=True)))
        table = pa.table({"node": pa.array(list(found), pa.binary()), "root": pa.array(list(found.values()), pa.binary())})
        return settle(edges.sparkSession.createDataFrame(table))
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        moved = labels.join(seen, labels["node"] == seen["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = moved.select(F.col("node").alias("n"), F.col("root").alias("up"))
        jumped = settle(moved.join(up, moved["root"] == up["n"], "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root")))
        labels = jumped.select("node", "root")
        if not jumped.where("root <> old").head(1):
            return labels


def entries(nodes: DataFrame, threshold: float) -> DataFrame:
    """(e, node, n, lim): the elements by which nodes (node, bag) may meet, under an exact prefix and position filter.

    Elements are ordered by how many of these bags have them, rarest first. If e is the first element that bags a and
    b share, their overlap is at most what a has from e on. Similarity t needs t / (1 + t) * (n_a + n_b), so b's size
    is at most lim, and at least t * n_a, or e cannot be the first: such entries are left out, and so are elements of
    a single bag. A passage that thousands of bags share stands at the end of their orders and mostly drops out.
    """
    each = nodes.select("node", F.size("bag").alias("n"), F.explode("bag").alias("e"))
    counts = each.groupBy("e").agg(F.count("*").alias("c")).where("c > 1")
    ordered = each.join(counts, "e", "left").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "e"))).alias("o"))
    prefix = F.slice("o", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    placed = ordered.select("node", "n", F.posexplode(prefix).alias("i", "p")).where("p.c > 1")
    most = F.floor((F.col("n") - F.col("i")) * ((1 + threshold) / threshold) + 1e-9) - F.col("n")
    return placed.select(F.col("p.e").alias("e"), "node", "n", most.alias("lim"))


def crossing(found: DataFrame) -> DataFrame:
    """Of entries with roots, those that some entry of the same element and another root may go with by both limits.

    For each element only the least size and the greatest limit of the best root, and of all others, are kept: sums of
    constant size, however many nodes share the element.
    """
    best = found.groupBy("e").agg(F.min(F.struct("n", "root")).alias("s"), F.max(F.struct("lim", "root")).alias("g"))
    both = found.join(best, "e")
    other = both.groupBy("e").agg(F.min(F.when(F.col("root") != F.col("s.root"), F.col("n"))).alias("n2"), F.max(F.when(F.col("root") != F.col("g.root"), F.col("lim"))).alias("lim2"))
    both = both.join(other.where("n2 is not null"), "e")
    least = F.when(F.col("root") != F.col("s.root"), F.col("s.n")).otherwise(F.col("n2"))
    most = F.when(F.col("root") != F.col("g.root"), F.col("g.lim")).otherwise(F.col("lim2"))
    return both.where((least <= F.col("lim")) & (most >= F.col("n"))).select("e", "node", "n", "lim", "root")


def central(found: DataFrame) -> DataFrame:
    """Pairs (a, b) of each entry and its element's centre: the node with the greatest share of its bag from there on,
    which is the one with the least of its own. What is similar to anything there is mostly similar to the centre."""
    lead = found.groupBy("e").agg(F.max(F.struct((F.col("lim") / F.col("n")).alias("share"), "node", "n", "lim", "root")).alias("l"))
    met = found.join(lead, "e").where((F.col("root") != F.col("l.root")) & (F.col("n") <= F.col("l.lim")) & (F.col("l.n") <= F.col("lim")))
    return met.select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")).distinct()


def remaining(found: DataFrame) -> DataFrame:
    """Pairs (a, b) of all entries of one element and different roots that both limits allow."""
    right = found.select("e", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("lim").alias("lx"), F.col("root").alias("rx"))
    met = found.join(right, "e").where((F.col("node") < F.col("x")) & (F.col("root") != F.col("rx")) & (F.col("nx") <= F.col("lim")) & (F.col("n") <= F.col("lx")))
    return met.select(F.col("node").alias("a"), F.col("x").alias("b")).distinct()


def open_links(nodes: DataFrame, bag: DataFrame, threshold: float) -> DataFrame | None:
    """Links (a, b) between the roots of nodes (node, root, bag), as many as join all that belong together; None if none.

    Rounds compare entries with their element's centre and put together what is linked, until a round links nothing or
    ROUNDS are over; each leaves fewer entries that cross roots. All pairs still allowed are then compared. Every
    comparison is of whole bags.
    """
    home = nodes.select("node", "root")
    found, now, merges = settle(entries(nodes.select("node", "bag"), threshold)), home, None
    for turn in range(ROUNDS + 1):
        crossed = settle(crossing(crossing(found.join(now, "node"))))
        links = settle(similar(remaining(crossed) if turn == ROUNDS else central(crossed), bag, threshold).select("a", "b"))
        if not links.head(1):
            if turn < ROUNDS:
                links = settle(similar(remaining(crossed), bag, threshold).select("a", "b"))
            turn = ROUNDS
        ends = [home.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab"]
        added = links.join(ends[0], "a").join(ends[1], "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        merges = settle((merges.unionByName(added) if merges else added).distinct())
        if turn == ROUNDS:
            return merges if merges.head(1) else None
        top = components(merges).select(F.col("node").alias("root"), F.col("root").alias("top"))
        now = home.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def similar(pairs: DataFrame, bag: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b), those whose bags overlap by the threshold or more: exact weighted Jaccard similarity."""
    met = pairs.join(bag.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b").join(bag.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a")
    shared = F.size(F.array_intersect("bag_a", "bag_b"))
    met = met.withColumn("similarity", shared / (F.size("bag_a") + F.size("bag_b") - shared))
    return met.where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def classes(docs: DataFrame, threshold: float = NEAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row a document: doc_id, node, class_id (least doc_id of its group), class_size and kept.

    Documents are linked if their bags' weighted Jaccard similarity is at least `threshold`; groups are connected
    components. One row of each group is kept: the least doc_id (of equal ids, the least node, one row of those).
    A text that is null or without words is in no group: it is its own class and kept. A null doc_id is the
    greatest; a group of null ids has class null. An empty table gives an empty result; other columns are not read.
    """
    found = identified(docs).select("doc_id", "node", word_hashes(F.col("words")).alias("h"))
    signed = settle(found.mapInArrow(band_rows(bands, rows), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node binary, n bigint, bands array<bigint>"))
    nodes = settle(signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    every = nodes.select("node", "n", F.posexplode("bands").alias("band", "hash"))
    shared = every.groupBy("band", "hash").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    buckets = settle(every.join(shared, ["band", "hash"]))
    wanted = settle(buckets.select("node").distinct().join(nodes.select("node", "least"), "node"))
    # By id first, so that words are cut only for the rows that are wanted and no text is shuffled; other rows of an id
    # that several texts share drop out by their nodes.
    # No filter by node here: Spark would push it into the scan and find the words of every row.
    texts = identified(parted(docs.select("doc_id", "text"), wanted.select("least"))[0]).select("node", word_hashes(F.col("words")).alias("h"))
    bags_made = texts.mapInArrow(elements, "node binary, bag array<bigint>").groupBy("node").agg(F.first("bag").alias("bag"))
    bag = settle(bags_made.join(wanted.select("node"), "node", "left_semi"))
    near = F.least("n", "nx") >= threshold * F.greatest("n", "nx")
    ends = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    lead = buckets.groupBy("band", "hash").agg(F.min_by(F.struct("node", "n"), F.xxhash64("node", F.col("band") % LEADERS)).alias("lead"))
    met = buckets.join(lead, ["band", "hash"]).select(F.col("lead.node").alias("x"), F.col("lead.n").alias("nx"), F.col("node").alias("y"), "n")
    edges = settle(similar(met.where(F.col("x") != F.col("y")).where(near).select(*ends).distinct(), bag, threshold))
    roots = components(edges)
    rooted = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rooted.groupBy("band", "hash").agg((F.min("root") != F.max("root")).alias("open")).where("open").select("band", "hash")
    left = settle(rooted.join(split, ["band", "hash"]).select("node", "root").distinct().join(bag, "node"))
    merges = open_links(left, bag, threshold)
    first = F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("top")
    rooted = nodes.select("node", "least", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if merges:
        top = components(merges).select(F.col("node").alias("root"), F.col("root").alias("_top"))
        rooted = rooted.join(top, "root", "left").withColumn("root", F.coalesce("_top", "root")).drop("_top")
    tops = rooted.groupBy("root").agg(first, F.sum("copies").alias("class_size"))
    by_node = rooted.join(tops, "root").select(F.col("node").alias("_node"), F.col("top.least").alias("class_id"), F.col("top.node").alias("top_node"), "class_size")
    alone = F.col("node").isNull()
    joined = signed.select("doc_id", "node").join(by_node, F.col("node") == F.col("_node"), "left")
    top = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("top_node"))
    return joined.select(
        "doc_id", "node", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce(alone | top, F.lit(False)).alias("kept")
    )


def filter_documents(docs: DataFrame, threshold: float = NEAR) -> DataFrame:
    """The documents kept, with their texts: one of each group; of equal rows of one id one stays.

    Rows are parted by ids that have a dropped or repeated row. Most have none: these pass as they are, their words
    unread. Only of the rest words are made and joined with what was found, and only rows whose (doc_id, words) occur
    twice among the kept are always shuffled with their texts.
    """
    found = settle(classes(docs, threshold).where("node is not null").groupBy("doc_id", "node").agg(F.first("kept").alias("kept"), F.count("*").alias("c")).where("not kept or c > 1"))
    marks = found.select(F.col("doc_id").alias("_d"), F.col("node").alias("_k"), F.col("kept").alias("_kept"))
    marks = F.broadcast(marks) if found.count() <= BROADCAST_ROWS else marks
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    some, rest = parted(docs.select(*columns), found.select("doc_id"))
    # Settled, or the filters of both branches would be pushed into the scan and find the words of every row.
    own = settle(some.withColumn("_node", node(plain_words(F.col("text")))))
    joined = own.join(marks, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_node") == F.col("_k")), "left")
    single = joined.where("_kept is null")
    twice = joined.where("_kept").dropDuplicates(["doc_id", "_node"])
    return rest.unionByName(single.select(*columns)).unionByName(twice.select(*columns))
