"""Property-graph operators on nodes (id, document_id, document_order ...) and edges (src, dst, edge_type ...)."""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.operators.lineage import settle

#: The edge types that order events.
CAUSAL = ["CAUSES", "ENABLES", "PREVENTS", "HAPPENS_BEFORE"]
SYSTEM = ["HAS_FACET", "BELONGS_TO_THREAD", "HAS_STATE", "CHANGES_TO", "HAS_ARC", "INCLUDES_STATE"]
#: Target nodes of a component that one task answers for.
BLOCK = 4096
#: Starts whose bits are made pairs at a time.
STARTS = 256


def active(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges not deleted whose ends are both there and not deleted."""
    ends = nodes.where(~F.col("deleted")).select("id")
    return edges.where(~F.col("deleted")).join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")


def expand(edges: DataFrame, both: bool = False) -> DataFrame:
    """(node, other, edge_type, direction): out edges, and with `both` in edges too."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "edge_type", F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "edge_type", F.lit("in").alias("direction"))) if both else out


def reachable(starts: DataFrame, edges: DataFrame, hops: int | None = None) -> DataFrame:
    """(start, node): nodes at one edge or more from each start, each once; at most `hops` edges away if that is given.

    Without a limit, components are closed as a whole, see paths(). With one, only the newest pairs are extended, and
    pairs seen are taken out by an anti join, so a round costs its frontier.
    """
    step = settle(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    if hops is None:
        return paths(step, starts.select("start", F.lit(None).cast(step.schema["dst"].dataType).alias("node")).where("start is not null").distinct())
    front = settle(starts.select("start").join(step, F.col("start") == F.col("src")).select("start", F.col("dst").alias("node")).distinct())
    seen = front
    for _ in range(hops - 1):
        if not front.head(1):
            break
        grown = front.join(step, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        front = settle(grown.join(seen, ["start", "node"], "left_anti"))
        seen = seen.unionByName(front)
    return seen


def strong_parts(first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, int]:
    """The strongly connected part of each node and how many there are, numbered so that edges lead to lower numbers or
    stay; node k's successors are after[first[k] : first[k + 1]]. Tarjan's search without recursion."""
    n, begin, to = len(first) - 1, first.tolist(), after.tolist()
    turn, low, part, at = [0] * n, [0] * n, [-1] * n, begin[:-1].copy()
    open_, count, parts = [], 0, 0
    for root in range(n):
        if turn[root]:
            continue
        count += 1
        turn[root] = low[root] = count
        open_.append(root)
        todo = [root]
        while todo:
            k = todo[-1]
            if at[k] < begin[k + 1]:
                b = to[at[k]]
                at[k] += 1
                if not turn[b]:
                    count += 1
                    turn[b] = low[b] = count
                    open_.append(b)
                    todo.append(b)
                elif part[b] < 0:
                    low[k] = min(low[k], turn[b])
                continue
            todo.pop()
            if todo:
                low[todo[-1]] = min(low[todo[-1]], low[k])
            if low[k] == turn[k]:
                while True:
                    b = open_.pop()
                    part[b] = parts
                    if b == k:
                        break
                parts += 1
    return np.array(part, dtype=np.int64), parts


def closed(src: np.ndarray, dst: np.ndarray, block: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of a component, those of its nodes that are in one block, each node's strong part, and by part a row of bits
    of the block's nodes that a path of one edge or more leads to."""
    nodes, both = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = both[: len(src)], both[len(src) :]
    order = np.argsort(a, kind="stable")
    part, parts = strong_parts(np.searchsorted(a[order], np.arange(len(nodes) + 1)), b[order])
    here = nodes[block * size : (block + 1) * size]
    own = np.zeros((parts, size // 8), dtype=np.uint8)
    column = np.arange(len(here))
    np.bitwise_or.at(own, (part[block * size : block * size + len(here)], column // 8), (128 >> (column % 8)).astype(np.uint8))
    links = np.unique(np.stack([part[a], part[b]], axis=1), axis=0)
    begin = np.searchsorted(links[:, 0], np.arange(parts + 1))
    reach, around = np.zeros_like(own), np.zeros_like(own)
    for k in range(parts):
        after = links[begin[k] : begin[k + 1], 1]
        # A part leads to itself only by an edge inside; its bits are then those of its own nodes.
        around[k] = own[k]
        if len(after):
            reach[k] = np.bitwise_or.reduce(around[after], axis=0)
            around[k] |= reach[k]
    return nodes, here, part, reach


def paths(step: DataFrame, asked: DataFrame, size: int = BLOCK) -> DataFrame:
    """Of the pairs (start, node) asked for, those that a path of one edge or more of step (src, dst) joins; a null node
    asks for all nodes there are. No limit of length.

    Each weakly connected component goes to tasks with its edges, one task for each block of target nodes: strong parts
    first, then, from the last to the first, a part's targets are those of what follows it, as rows of bits. So a path
    costs no round however long it is, and a block costs its edges times `size` bits (a multiple of 8), besides what is given out.
    """
    kind, one, other = step.schema["src"].dataType.simpleString(), F.lit(False), F.lit(True)
    roots = components(step.select(F.col("src").alias("id")).unionByName(step.select(F.col("dst").alias("id"))).distinct(), step)
    sizes = roots.groupBy("root").agg(F.ceil(F.count("*") / size).alias("blocks"))
    homes = settle(roots.join(sizes, "root"))
    edges = step.join(homes, F.col("src") == F.col("id")).select("root", "blocks", one.alias("ask"), F.col("src").alias("x"), F.col("dst").alias("y"))
    asks = asked.join(homes, F.col("start") == F.col("id")).select("root", "blocks", other.alias("ask"), F.col("start").alias("x"), F.col("node").alias("y"))
    rows = edges.unionByName(asks).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))).drop("blocks")

    def work(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        link = pc.invert(table.column("ask"))
        src, dst = (table.filter(link).column(k).to_numpy() for k in "xy")
        nodes, here, part, reach = closed(src, dst, key[1].as_py(), size)
        wanted = table.filter(table.column("ask"))
        free = pc.is_null(wanted.column("y"))
        starts = wanted.filter(free).column("x").to_numpy()
        rows_of = part[np.searchsorted(nodes, starts)]
        for k in range(0, len(starts), STARTS):
            some = np.unpackbits(reach[rows_of[k : k + STARTS]], axis=1)
            i, j = np.nonzero(some)
            yield pa.RecordBatch.from_arrays([pa.array(starts[k + i]), pa.array(here[j])], ["start", "node"])
        pairs = wanted.filter(pc.invert(free))
        x, y = pairs.column("x").to_numpy(), pairs.column("y").to_numpy()
        if len(x):
            at = np.minimum(np.searchsorted(here, y), len(here) - 1)
            met = (here[at] == y) & (reach[part[np.searchsorted(nodes, x)], at // 8] & (128 >> (at % 8)).astype(np.uint8) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(x[met]), pa.array(y[met])], ["start", "node"])

    return rows.groupBy("root", "block").applyInArrow(work, f"start {kind}, node {kind}")


def would_cycle(edges: DataFrame, proposed: DataFrame, hops: int | None = None) -> DataFrame:
    """Proposed edges (id, src, dst) with cycle: whether a causal path leads from dst back to src, or src is dst.

    Only the pairs asked for are answered, those that one edge answers without a search.
    """
    causal = edges.where(F.col("edge_type").isin(CAUSAL)).select("src", "dst")
    if hops is not None:
        found = reachable(proposed.select(F.col("dst").alias("start")).distinct(), causal, hops)
    else:
        step = causal.where("src is not null and dst is not null").distinct()
        direct = step.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("_direct"))
        # What one edge answers is settled in one join: edges are read once more only if something is left to search for.
        proposed = settle(proposed.select("id", "src", "dst").join(direct, ["src", "dst"], "left").select("id", "src", "dst", "_direct"))
        rest = proposed.where("_direct is null and src <> dst").select(F.col("dst").alias("start"), F.col("src").alias("node")).distinct()
        if not rest.head(1):
            return proposed.select("id", (F.coalesce("_direct", F.lit(False)) | (F.col("src") == F.col("dst"))).alias("cycle"))
        found = proposed.where("_direct").select(F.col("dst").alias("start"), F.col("src").alias("node")).distinct().unionByName(paths(settle(step), rest))
    back = found.select(F.col("start").alias("dst"), F.col("node").alias("src"), F.lit(True).alias("_met"))
    return proposed.join(back, ["src", "dst"], "left").select("id", (F.coalesce("_met", F.lit(False)) | (F.col("src") == F.col("dst"))).alias("cycle"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): weakly connected components, named by their least node.

    Labels fall to the least neighbour's and jump to their label's label each round, so long chains close quickly.
    """
    both = settle(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = settle(nodes.select("id", F.col("id").alias("root")))
    while True:
        near = both.join(labels.select(F.col("id").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("root").alias("near"))
        fallen = labels.join(near, "id", "left").select("id", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        up = fallen.select(F.col("id").alias("root"), F.col("root").alias("up"))
        jumped = settle(fallen.join(up, "root", "left").select("id", "old", F.least("root", F.coalesce("up", "root")).alias("root")))
        labels = jumped.select("id", "root")
        if not jumped.where("root <> old").head(1):
            return labels


def threads(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(document_id, id, thread): causal components of each document; nodes alone share the thread Uncategorized."""
    own = nodes.where(~F.col("deleted"))
    inside = within(own, active(nodes, edges).where(F.col("edge_type").isin(CAUSAL)))
    named = own.select("document_id", "id").join(components(own, inside), "id")
    sizes = named.groupBy("root").agg(F.count("*").alias("n"))
    return named.join(sizes, "root").select("document_id", "id", F.when(F.col("n") > 1, F.col("root").cast("string")).otherwise("Uncategorized").alias("thread"))


def within(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between nodes of one document, with its id."""
    source, target = nodes.select(F.col("id").alias("src"), "document_id"), nodes.select(F.col("id").alias("dst"), F.col("document_id").alias("_d"))
    return edges.join(source, "src").join(target, "dst").where("document_id = _d").drop("_d")


def kahn(ids: list[int], orders: list[float | None], edges: list[tuple[int, int]]) -> list[int]:
    """Topological order in which free nodes come by order (none last), then first come first; nodes at the start tie by id."""
    rank = {i: float("inf") if o is None or o != o else float(o) for i, o in zip(ids, orders, strict=True)}
    after, waits = defaultdict(list), dict.fromkeys(ids, 0)
    for a, b in edges:
        if a in rank and b in rank:
            after[a].append(b)
            waits[b] += 1
    turn, heap, out = 0, [], []

    def free(found: list[int]) -> None:
        nonlocal turn
        for i in found:
            heapq.heappush(heap, (rank[i], turn, i))
            turn += 1

    free(sorted((i for i in ids if not waits[i]), key=lambda i: (rank[i], i)))
    while heap:
        node = heapq.heappop(heap)[2]
        out.append(node)
        ready = []
        for b in after[node]:
            waits[b] -= 1
            if not waits[b]:
                ready.append(b)
        free(sorted(ready, key=lambda i: rank[i]))
    return out


def cut_nodes(ids: list[int], edges: list[tuple[int, int]]) -> list[int]:
    """Nodes whose removal leaves more components: a depth-first search without recursion."""
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    depth, low, cuts = {}, {}, set()
    for root in ids:
        if root in depth:
            continue
        depth[root] = low[root] = 0
        children, stack = 0, [(root, None, iter(near[root]))]
        while stack:
            node, parent, rest = stack[-1]
            for other in rest:
                if other not in depth:
                    depth[other] = low[other] = depth[node] + 1
                    children += node == root
                    stack.append((other, node, iter(near[other])))
                    break
                if other != parent:
                    low[node] = min(low[node], depth[other])
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[node])
                    if parent != root and low[node] >= depth[parent]:
                        cuts.add(parent)
        if children > 1:
            cuts.add(root)
    return sorted(cuts)


def by_document(nodes: DataFrame, edges: DataFrame, work, schema: str) -> DataFrame:  # noqa: ANN001
    """Runs `work` on the nodes and causal edges of each document: a document's graph is one task's unit."""
    own = nodes.where(~F.col("deleted")).select("document_id", "id", "document_order")
    inside = within(own, active(nodes, edges).where(F.col("edge_type").isin(CAUSAL))).select("document_id", "id", "src", "dst")
    links = inside.select(F.col("document_id").alias("doc"), F.col("id").alias("edge"), "src", "dst")
    return own.groupBy("document_id").cogroup(links.groupBy("doc")).applyInPandas(work, schema)


def causal_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(document_id, id, position): a topological order of each document; nodes on or behind a cycle have no row."""

    def work(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        order = kahn(n.id.tolist(), n.document_order.tolist(), list(e.sort_values("edge")[["src", "dst"]].itertuples(index=False, name=None)))
        return pd.DataFrame({"document_id": [n.document_id.iloc[0]] * len(order) if len(n) else [], "id": order, "position": range(len(order))})

    return by_document(nodes, edges, work, "document_id bigint, id bigint, position bigint")


def pivotal(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(document_id, id): nodes whose removal splits a document's causal graph further."""

    def work(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        found = cut_nodes(n.id.tolist(), list(e[["src", "dst"]].itertuples(index=False, name=None)))
        return pd.DataFrame({"document_id": [n.document_id.iloc[0]] * len(found) if len(n) else [], "id": found})

    return by_document(nodes, edges, work, "document_id bigint, id bigint")


def guarded(edges: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed causal edges (id, document_id, src, dst) that are added one after another, by id: those that close a
    cycle with edges before them are left out. One document is one unit of work."""

    def work(e: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        after, kept = defaultdict(set), []
        for a, b in e[["src", "dst"]].itertuples(index=False, name=None):
            after[a].add(b)
        for row in p.sort_values("id").itertuples():
            todo, seen = [row.dst], {row.dst}
            while todo and row.src not in seen:
                for b in after[todo.pop()] - seen:
                    seen.add(b)
                    todo.append(b)
            if row.src not in seen:
                after[row.src].add(row.dst)
                kept.append(row.id)
        return p[p.id.isin(kept)][["document_id", "id", "src", "dst"]]

    left = edges.select("document_id", "src", "dst").groupBy("document_id")
    return left.cogroup(proposed.select("document_id", "id", "src", "dst").groupBy("document_id")).applyInPandas(work, "document_id bigint, id bigint, src bigint, dst bigint")


def purge(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges left after removing the nodes `gone` (id); an edge goes if either end does."""
    kept = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(gone.select("id"), "id", "left_anti"), kept


def update(nodes: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """Partial property updates: values that are given replace, null ones keep what is there."""
    new = changes.select("id", *[F.col(k).alias(f"_{k}") for k in columns])
    return nodes.join(new, "id", "left").withColumns({k: F.coalesce(f"_{k}", k) for k in columns}).drop(*[f"_{k}" for k in columns])


def applied(nodes: DataFrame, created: DataFrame, changes: DataFrame, removed: DataFrame, columns: list[str], key: tuple[str, ...] = ("id",)) -> DataFrame:
    """Nodes after creation, partial updates and removal, in this order; a key that exists is not created again.

    Updates and removals go by id, whatever else the key has.
    """
    names = nodes.columns
    fresh = created.select(*names).join(nodes.select(*key), list(key), "left_anti").select(*names)
    return update(nodes.unionByName(fresh), changes, columns).join(removed.select("id"), "id", "left_anti").select(*names)


def edges_after(nodes: DataFrame, edges: DataFrame, created: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges (src, dst, edge_type) after creation, which needs both ends, and removal by ends and type."""
    there = lambda side: nodes.select(F.col("id").alias(side))
    fresh = created.select("src", "dst", "edge_type").join(there("src"), "src", "left_semi").join(there("dst"), "dst", "left_semi")
    every = edges.select("src", "dst", "edge_type").unionByName(fresh.select("src", "dst", "edge_type"))
    return every.join(removed.select("src", "dst", "edge_type"), ["src", "dst", "edge_type"], "left_anti").select("src", "dst", "edge_type")


#: The second label of a node by its kind; any other kind is Other.
LABELS = {"character": "Character", "location": "Location", "event": "Event", "concept": "Concept"}


def typed(nodes: DataFrame) -> DataFrame:
    """Adds the two labels that a created node gets."""
    second = F.coalesce(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[F.col("kind")], F.lit("Other"))
    return nodes.withColumn("labels", F.array(F.lit("StoryNode"), second))


def renamed(facets: DataFrame, mentions: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facets with new contents (id, content), and the names that the nodes of renamed name facets then have.

    Facets that share an id are renamed together, and of several new contents for an id the greatest counts; names are
    elected anew only for nodes that are touched.
    """
    new = renames.groupBy("id").agg(F.max("content").alias("_new"))
    after = facets.join(new, "id", "left").withColumn("_touched", F.col("_new").isNotNull() & (F.col("kind") == "name")).withColumn("content", F.coalesce("_new", "content"))
    nodes = after.where("_touched").select("node_id").distinct()
    return after.select(*facets.columns), primary_names(after.join(nodes, "node_id", "left_semi").select(*facets.columns), mentions)


def linked(left: DataFrame, right: DataFrame, wanted: DataFrame, strict: bool = False) -> DataFrame:
    """Relationships wanted (src, dst) with created: whether both ends exist. strict raises for those that do not."""
    ends = wanted.join(left.select(F.col("id").alias("src"), F.lit(True).alias("_l")).distinct(), "src", "left").join(right.select(F.col("id").alias("dst"), F.lit(True).alias("_r")).distinct(), "dst", "left")
    made = F.coalesce(F.col("_l") & F.col("_r"), F.lit(False))
    if strict:
        made = F.when(made, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("0 relationships created from "), F.col("src").cast("string"), F.lit(" to "), F.col("dst").cast("string"))).cast("boolean"))
    return ends.select("src", "dst", made.alias("created"))


def transitions(states: DataFrame) -> DataFrame:
    """(character_id, src, dst): each state and the next of its character by document order, then id."""
    following = F.lead("id").over(Window.partitionBy("character_id").orderBy("document_order", "id"))
    return states.select("character_id", F.col("id").alias("src"), following.alias("dst")).where("dst is not null")


def moved_facets(characters: DataFrame, facets: DataFrame, states: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, node_id, state, how): the state that each state facet of a character moves to.

    Without states it is the default one, which is created (state null, how "default"); a single state takes all; of
    several it is the latest at the place of the facet's first mention, else of the character's; before all states the
    first, and without any mention the last. characters: id; facets: id, node_id; states: id, character_id,
    document_order; mentions: node_id, facet_id, start_at.
    """
    from narrata.operators.relational import as_of

    own = facets.select("id", "node_id").distinct().join(characters.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi")
    counts = states.groupBy(F.col("character_id").alias("node_id")).agg(F.count("*").alias("n"), F.max(F.struct("document_order", "id"))["id"].alias("last"))
    by_facet = mentions.where("facet_id is not null").groupBy(F.col("facet_id").alias("id"), "node_id").agg(F.min("start_at").alias("here"))
    by_node = mentions.groupBy("node_id").agg(F.min("start_at").alias("first"))
    placed = own.join(counts, "node_id", "left").join(by_facet, ["id", "node_id"], "left").join(by_node, "node_id", "left").withColumn("at", F.coalesce("here", "first"))
    by_place = as_of(placed.withColumnRenamed("node_id", "character_id"), states.withColumnRenamed("id", "state"), "character_id", "at", "document_order", "state", "first").withColumnRenamed("character_id", "node_id")
    how = F.when(F.col("n").isNull(), "default").when(F.col("n") == 1, "single").when(F.col("at").isNull(), "last").otherwise("position")
    return by_place.select("id", "node_id", F.when(how == "default", None).when(how.isin("single", "last"), F.col("last")).otherwise(F.col("state")).alias("state"), how.alias("how"))


def thread_members(members: DataFrame, added: DataFrame, removed: DataFrame, places: DataFrame) -> DataFrame:
    """(thread, member, place) after events are added at the end, removed, and given new places.

    A member that is there is not added again; a new place takes the member to before those that hold it. Places come
    out gapless from 1.
    """
    own = members.select("thread", "member", F.col("place").cast("double").alias("place"), F.lit(0).alias("new"))
    fresh = added.select("thread", "member").distinct().join(members.select("thread", "member"), ["thread", "member"], "left_anti").select("thread", "member", F.lit(float("inf")).alias("place"), F.lit(1).alias("new"))
    left = own.unionByName(fresh).join(removed.select("thread", "member"), ["thread", "member"], "left_anti")
    set_ = left.join(places.select("thread", "member", F.col("place").alias("to")), ["thread", "member"], "left").withColumn("at", F.coalesce(F.col("to").cast("double"), "place"))
    order = Window.partitionBy("thread").orderBy("at", F.col("to").isNull(), "new", "member")
    return set_.select("thread", "member", F.row_number().over(order).cast("bigint").alias("place"))


def primary_names(facets: DataFrame, mentions: DataFrame) -> DataFrame:
    """(node_id, name): of each node's name facets the most mentioned, proper nouns first, then by the alphabet;
    pronouns are left out."""
    from narrata.functions import text as tx

    counts = mentions.where("facet_id is not null").groupBy(F.col("facet_id").alias("id")).agg(F.count("*").alias("n"))
    names = facets.where("kind = 'name'").where(~tx.pronoun(F.col("content"))).join(counts, "id", "left")
    order = [F.coalesce("n", F.lit(0)).desc(), tx.proper_noun(F.col("content")).desc(), F.col("content"), F.col("id")]
    ranked = names.withColumn("r", F.row_number().over(Window.partitionBy("node_id").orderBy(*order))).where("r = 1")
    every = facets.select("node_id").distinct()
    return every.join(ranked.select("node_id", F.col("content").alias("name")), "node_id", "left").fillna({"name": "Unknown Entity"})


#: Labels and edge types that may appear in a query, and what a property name looks like.
KNOWN_LABELS = ["StoryNode", "Character", "Location", "Event", "Concept", "Other", "NarrativeThread", "Facet", "CharacterState", "Arc"]
OTHER_TYPES = ["PARTICIPATES_IN", "LOCATED_AT", "PART_OF", "MEMBER_OF", "POSSESSES", "CONNECTED_TO", "OPPOSES", "ABOUT", "RELATED_TO"]
PROPERTY = "[A-Za-z_][A-Za-z0-9_]*"


def allowed(what: Column, name: Column) -> Column:
    """Whether a label, edge type or property name, as `what` says, may appear in a query; other kinds may not."""
    types = [*CAUSAL, *SYSTEM, *OTHER_TYPES]
    return F.coalesce(F.when(what == "label", name.isin(KNOWN_LABELS)).when(what == "edge type", name.isin(types)).when(what == "property", name.rlike(f"^{PROPERTY}$")), F.lit(False))


def check_allowed(labels: list[str] | None = None, edge_types: list[str] | None = None, properties: list[str] | None = None) -> None:
    """Raises ValueError for a label, edge type or property name that may not appear in a query; runs before any plan."""
    for what, given, known in (("label", labels, KNOWN_LABELS), ("edge type", edge_types, [*CAUSAL, *SYSTEM, *OTHER_TYPES])):
        if wrong := sorted(set(given or []) - set(known)):
            raise ValueError(f"unknown {what}: {', '.join(wrong)}")
    if wrong := [p for p in properties or [] if not re.fullmatch(PROPERTY, p)]:
        raise ValueError(f"invalid property name: {', '.join(wrong)}")
