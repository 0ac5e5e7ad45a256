"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a line of a document, or a run of adjacent lines of a paragraph (a line without words ends one) that begins
at any line and goes on while the lines between its first and last hold no more words than the longest template: a
sentence wrapped over lines lies whole in such a run. A block's set is its distinct plain words. A template is found
in a block that holds at least `threshold` of the template's words. Tokens are ordered by how many documents have them, rarest first.
A block that reaches the threshold must hold one of the template's first size - ceil(threshold * size) + 1 tokens
(prefix), at least ceil(threshold * size) words (length), and enough later tokens (position); those that pass are
compared whole. Everything is a DataFrame expression.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import BROADCAST_ROWS, PLAIN, let, plain_words, settle, small

#: Phrases of the base labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Usual license sentences and the labels they give.
TEMPLATES = [
    ("agpl", "this program is licensed under the gnu affero general public license"),
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work cc0"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
THRESHOLD = 0.9


def least(size: Column, threshold: float) -> Column:
    """Words that a block must share with a template of that size."""
    return F.ceil(size * threshold - 1e-9).cast("int")


def token_sets(given: list[tuple[str, str]]) -> list[list[str]]:
    """The distinct words of each template."""
    return [sorted(set(re.findall(PLAIN, text.lower()))) for _, text in given]


def surveyed(docs: DataFrame, given: list[tuple[str, str]]) -> DataFrame:
    """One row a document, from one pass over its words: doc_id, text_key, n_words, spots of base phrases, and `set`,
    the distinct words that some template has."""
    vocabulary = sorted({w for tokens in token_sets(given) for w in tokens})
    found = docs.select("doc_id", F.xxhash64("text").alias("text_key"), plain_words(F.col("text")).alias("words"))
    spots = F.array(*[F.struct(F.lit(label).alias("label"), places(F.col("words"), p).alias("at")) for p, label in PHRASES.items()])
    none = F.array().cast("array<struct<label: string, at: array<int>>>")
    firsts = F.array(*[F.lit(p.split(" ")[1]) for p in PHRASES])
    return settle(
        found.select(
            "doc_id",
            "text_key",
            F.size("words").cast("bigint").alias("n_words"),
            F.when(F.arrays_overlap("words", firsts), F.filter(spots, lambda s: F.size(s["at"]) > 0)).otherwise(none).alias("spots"),
            F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary))).alias("set"),
        )
    )


def prefixes(seen: DataFrame, given: list[tuple[str, str]], threshold: float) -> DataFrame:
    """(token, place, template, label, ordered, need): the prefix tokens of each template in global order.

    Tokens are ordered by the number of documents that have them; tasks sum before the shuffle.
    """
    rows = [(k, label, tokens) for k, ((label, _), tokens) in enumerate(zip(given, token_sets(given), strict=True))]
    own = seen.sparkSession.createDataFrame(rows, "template int, label string, tokens array<string>")
    counts = seen.select(F.explode("set").alias("token")).groupBy("token").count()
    order = own.select("template", "label", F.explode("tokens").alias("token")).join(F.broadcast(counts), "token", "left")
    ranked = order.groupBy("template", "label").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token"))).alias("t"))
    ranked = ranked.select("template", "label", F.col("t.token").alias("ordered")).withColumn("need", least(F.size("ordered"), threshold))
    return ranked.select("template", "label", "ordered", "need", F.posexplode(F.slice("ordered", F.lit(1), F.size("ordered") - F.col("need") + 1)).alias("place", "token"))


def blocks(low: Column, likely: str, longest: int) -> Column:
    """(line, block) of a text: each line, and from each line the longest run of two or more, that has a `likely` word.

    A run holds at most `longest` words between its first and last line, so it has at most longest + 2 lines; runs
    begin that near to a likely line. Lines are searched and counted once.
    """

    def reach(part: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            on = acc["on"] & (x["n"] > 0) & (acc["inner"] <= longest)
            inner = F.when(acc["n"] == 0, F.lit(0)).otherwise(acc["inner"] + x["n"])
            return F.struct((acc["n"] + on.cast("int")).alias("n"), inner.alias("inner"), on.alias("on"))

        return F.aggregate(part, F.struct(F.lit(0).alias("n"), F.lit(0).alias("inner"), F.lit(True).alias("on")), step, lambda acc: acc["n"])

    def all_of(xs: Column) -> Column:
        hits = F.filter(xs, lambda x: x["hit"])
        starts = F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(F.greatest(x["line"] - (longest + 1), F.lit(0)), x["line"]))))
        whole = lambda part: F.slice(part, F.lit(1), reach(part))
        parts = F.transform(starts, lambda i: let(F.slice(xs, i + 1, longest + 2), whole))
        several = F.filter(parts, lambda part: (F.size(part) > 1) & F.exists(part, lambda x: x["hit"]))
        text = lambda x: x["block"]
        joined = F.transform(several, lambda part: F.struct(F.element_at(part, 1)["line"].alias("line"), F.array_join(F.transform(part, text), "\n").alias("block")))
        return F.concat(F.transform(hits, lambda x: F.struct(x["line"].alias("line"), x["block"].alias("block"))), joined)

    each = lambda line, i: F.struct(i.alias("line"), line.alias("block"), F.regexp_count(line, F.lit(PLAIN)).alias("n"), line.rlike(likely).alias("hit"))
    return let(F.transform(F.split(low, "\n"), each), all_of)


def matches(docs: DataFrame, given: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, seen: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_key, line, template, label, containment): every block that reaches a template's threshold.

    line is the first of the block. text_key is xxhash64 of the text, for documents of equal id. Null and empty texts
    have no blocks; equal rows give one set of matches; other columns are not read; an empty table or template list
    gives an empty result. `seen` is the survey of the same documents, if there is one already: only documents that
    have enough words of some template, anywhere, are cut in blocks.
    """
    seen = surveyed(docs, given) if seen is None else seen
    prefix = small(prefixes(seen, given, threshold))
    wanted = sorted({row[0] for row in prefix.select("token").collect()})
    if not wanted:
        wanted = ["\x00"]
    around = r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])(?:" + "|".join(map(re.escape, wanted)) + r")(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"
    enough = [F.size(F.array_intersect("set", F.lit(tokens))) >= least(F.lit(len(tokens)), threshold) for tokens in token_sets(given) if tokens]
    keys = settle(seen.where(reduce(lambda a, b: a | b, enough, F.lit(False))).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).distinct())
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    own = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    low = own.join(keys, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")), "left_semi").select("doc_id", "text_key", F.lower("text").alias("low"))
    longest = max(len(re.findall(PLAIN, text.lower())) for _, text in given) if given else 0
    found = low.select("doc_id", "text_key", F.explode(blocks(F.col("low"), around, longest)).alias("b"))
    sets = found.select("doc_id", "text_key", "b.line", F.array_distinct(plain_words(F.col("b.block"))).alias("set"))
    probes = sets.withColumn("token", F.explode(F.array_intersect("set", F.lit(wanted))))
    met = probes.join(prefix, "token").where(F.size("set") >= F.col("need"))
    # A block meets a template at the first prefix token it holds; the tokens from that place on must suffice.
    first = F.size(F.array_intersect("set", F.slice("ordered", F.lit(1), F.col("place")))) == 0
    met = met.where((F.size("ordered") - F.col("place") >= F.col("need")) & first)
    shared = met.withColumn("shared", F.size(F.array_intersect("set", "ordered"))).where(F.col("shared") >= F.col("need"))
    return shared.select("doc_id", "text_key", "line", "template", "label", (F.col("shared") / F.size("ordered")).alias("containment")).distinct()


def places(found: Column, phrase: str) -> Column:
    """Places, from 0, where the phrase's words stand one after another."""
    want = phrase.split(" ")
    at = lambda w, i: reduce(lambda a, b: a & b, [F.element_at(w, i + k + 1) == x for k, x in enumerate(want)])
    here = lambda w: F.when(F.size(w) >= len(want), F.filter(F.sequence(F.lit(0), F.size(w) - len(want)), lambda i: at(w, i))).otherwise(F.array().cast("array<int>"))
    return let(found, here)


def scan(docs: DataFrame, given: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    score is 1 where a base phrase stands, else the largest containment of a template found, else 0. A null text
    counts as empty: no words, no places, no labels. Equal rows are scanned alike and each keeps its row. Lower-casing
    goes beyond A-Z; only the Kelvin sign and the dotted capital I become or begin with an ASCII letter by it, which
    parts no word and makes none of the phrases.
    """
    seen = surveyed(docs, given)
    base = seen.withColumn("at", F.flatten(F.col("spots.at"))).select(
        "doc_id",
        "text_key",
        "n_words",
        F.size("at").cast("bigint").alias("n_base"),
        F.array_min("at").cast("bigint").alias("first_word"),
        F.array_max("at").cast("bigint").alias("last_word"),
        F.array_sort(F.array_distinct(F.col("spots.label"))).alias("base"),
    )
    hits = matches(docs, given, threshold, seen).groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("most"))
    hits = hits.withColumnRenamed("doc_id", "hit_id").withColumnRenamed("text_key", "hit_key")
    both = base.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & F.col("text_key").eqNullSafe(F.col("hit_key")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )
