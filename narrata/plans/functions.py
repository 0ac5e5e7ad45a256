"""Scalar functions: names, texts, dates, numbers, maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions import calendar as cal
from narrata.functions import text as tx
from narrata.plans.registry import query
from narrata.sources.model import Model

c, lit = F.col, F.lit


def norm_sql(x: str) -> str:
    """The normalised name in DuckDB SQL."""
    out = f"trim(lower({x}))"
    for pattern in (tx.ARTICLE, tx.TITLE, tx.EPITHET):
        out = f"regexp_replace({out}, '{pattern}', '')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


def title_sql(x: str) -> str:
    return f"nullif(lower(regexp_extract({x}, '(?i){tx.TITLE}', 1)), '')"


TOKENS = "list_filter(string_split(n, ' '), lambda w: length(w) > 1)"
#: Each name with the next one of its document: the pairs that two-name functions are tried on.
PAIRS = f""", pairs AS (SELECT id, name AS a, lead(name) OVER (PARTITION BY document_id ORDER BY id) AS b FROM names),
p AS (SELECT *, {norm_sql("a")} AS na, {norm_sql("b")} AS nb, {title_sql("a")} AS ta, {title_sql("b")} AS tb FROM pairs WHERE b IS NOT NULL),
q AS (SELECT *, list_distinct(list_filter(string_split(na, ' '), lambda w: length(w) > 1)) AS xa, list_distinct(list_filter(string_split(nb, ' '), lambda w: length(w) > 1)) AS xb FROM p),
s AS (SELECT *, CASE WHEN len(xa) > 0 AND len(xb) > 0 THEN len(list_intersect(xa, xb)) / len(list_distinct(list_concat(xa, xb))) ELSE 0 END AS jaccard,
  length(na) >= 2 AND length(nb) >= 2 AND (contains(na, nb) OR contains(nb, na)) AS inside FROM q)"""
SCORE = "CASE WHEN na = nb THEN 1.0 WHEN inside THEN 0.85 WHEN ta = tb THEN 0.7 WHEN jaccard > 0 THEN 0.5 + jaccard * 0.3 ELSE 0 END"


def pairs(m: Model) -> DataFrame:
    following = F.lead("name").over(Window.partitionBy("document_id").orderBy("id"))
    return m.names.select("id", c("name").alias("a"), following.alias("b")).where("b is not null")


@query("f1_normalise_name", f"SELECT id, {norm_sql('name')} AS normal FROM names")
def _(m: Model) -> DataFrame:
    return m.names.select("id", tx.normalise_name(c("name")).alias("normal"))


@query("f2_title_epithet", f"SELECT id, {title_sql('name')} AS title, nullif(lower(regexp_extract(name, '(?i){tx.EPITHET}', 1)), '') AS epithet FROM names")
def _(m: Model) -> DataFrame:
    return m.names.select("id", tx.title(c("name")).alias("title"), tx.epithet(c("name")).alias("epithet"))


@query("f3_name_tokens", f"SELECT id, {TOKENS} AS tokens FROM (SELECT id, {norm_sql('name')} AS n FROM names)")
def _(m: Model) -> DataFrame:
    return m.names.select("id", tx.name_tokens(c("name")).alias("tokens"))


@query("f4_token_jaccard", f"{PAIRS} SELECT id, CAST(jaccard AS DOUBLE) AS jaccard FROM s")
def _(m: Model) -> DataFrame:
    return pairs(m).select("id", tx.token_overlap(c("a"), c("b")).alias("jaccard"))


@query("f5_substring_match", f"{PAIRS} SELECT id, inside FROM s")
def _(m: Model) -> DataFrame:
    return pairs(m).select("id", tx.substring_match(c("a"), c("b")).alias("inside"))


@query("f6_same_title", f"{PAIRS} SELECT id, coalesce(ta = tb, false) AS same FROM s")
def _(m: Model) -> DataFrame:
    return pairs(m).select("id", tx.share_title(c("a"), c("b")).alias("same"))


@query("f7_likely_epithet", r"SELECT id, (starts_with(lower(name), 'the ') AND len(string_split(lower(name), ' ')) >= 3) OR regexp_matches(lower(name), 'who \w+|of the |the \w+ one') AS likely FROM names")
def _(m: Model) -> DataFrame:
    return m.names.select("id", tx.likely_epithet(c("name")).alias("likely"))


@query("f8_alias_variants", f""", v AS (SELECT id, name, n, {TOKENS} AS t, ti FROM (SELECT id, name, {norm_sql('name')} AS n, {title_sql('name')} AS ti FROM names))
SELECT id, list_sort(list_distinct(list_filter([lower(name), n, ti, 'the ' || ti, CASE WHEN len(t) > 1 THEN t[1] END, CASE WHEN len(t) > 1 THEN t[-1] END], lambda x: x IS NOT NULL))) AS variants FROM v""")
def _(m: Model) -> DataFrame:
    return m.names.select("id", F.array_sort(tx.alias_variants(c("name"))).alias("variants"))


@query("f9_alias_score", f"{PAIRS} SELECT id, CAST({SCORE} AS DOUBLE) AS score FROM s")
def _(m: Model) -> DataFrame:
    return pairs(m).select("id", tx.alias_score(c("a"), c("b")).alias("score"))


@query("f11_edit_similarity", "SELECT id, levenshtein(a, b) AS distance, CASE WHEN greatest(length(a), length(b)) > 0 THEN 1.0::DOUBLE - levenshtein(a, b) / greatest(length(a), length(b)) ELSE 1 END AS similarity FROM (SELECT id, name AS a, lead(name) OVER (PARTITION BY document_id ORDER BY id) AS b FROM names) WHERE b IS NOT NULL")
def _(m: Model) -> DataFrame:
    return pairs(m).select("id", F.levenshtein("a", "b").cast("bigint").alias("distance"), tx.edit_similarity(c("a"), c("b")).alias("similarity"))


#: The head of each text beside the head of the next: what overlaps are tried on.
HEADS = r""", h AS (SELECT id, body AS a, lead(body) OVER (PARTITION BY source ORDER BY id) AS b FROM texts),
g AS (SELECT id, list_filter(regexp_split_to_array(lower(a), '\s+'), lambda x: x <> '') AS wa, list_filter(regexp_split_to_array(lower(b), '\s+'), lambda x: x <> '') AS wb FROM h WHERE b IS NOT NULL),
k AS (SELECT *, list_distinct(wa) AS da, list_distinct(list_transform(range(1, len(wa) - 1), lambda i: concat(wa[i], ' ', wa[i+1], ' ', wa[i+2]))) AS ga, list_transform(range(1, len(wb) - 1), lambda i: concat(wb[i], ' ', wb[i+1], ' ', wb[i+2])) AS gb,
  list_distinct(list_filter(wa, lambda x: length(x) > 2)) AS la, list_distinct(list_filter(wb, lambda x: length(x) > 2)) AS lb FROM g)"""


def heads(m: Model) -> DataFrame:
    """Each whole text beside the whole next one of its source."""
    return m.texts.select("id", c("body").alias("a"), F.lead("body").over(Window.partitionBy("source").orderBy("id")).alias("b")).where("b is not null")


@query("f12_overlaps", f"{HEADS} SELECT id, CASE WHEN len(da) > 0 THEN len(list_intersect(da, wb)) / len(da) ELSE 0 END AS words, CASE WHEN len(ga) > 0 THEN len(list_intersect(ga, gb)) / len(ga) ELSE 1 END AS trigrams FROM k")
def _(m: Model) -> DataFrame:
    return heads(m).select("id", tx.word_overlap(c("a"), c("b")).alias("words"), tx.trigram_overlap(c("a"), c("b")).alias("trigrams"))


@query("f13_segment_overlap", f"{HEADS} SELECT id, CASE WHEN len(la) > 0 AND len(lb) > 0 THEN len(list_intersect(la, lb)) / greatest(len(la), len(lb)) ELSE 0 END AS overlap FROM k")
def _(m: Model) -> DataFrame:
    return heads(m).select("id", tx.segment_overlap(c("a"), c("b")).alias("overlap"))


@query("f14_hashes", "SELECT id, sha256(body) AS text_hash, substr(sha256(body), 1, 16) AS segment_hash FROM texts")
def _(m: Model) -> DataFrame:
    return m.texts.select("id", tx.text_hash(c("body")).alias("text_hash"), tx.segment_hash(c("body")).alias("segment_hash"))


@query("f15_proper_noun", r"SELECT id, trim(name) <> '' AND NOT regexp_matches(lower(trim(name)), '^(the|a|an)\s') AND substr(trim(name), 1, 1) = upper(substr(trim(name), 1, 1)) AS proper FROM names")
def _(m: Model) -> DataFrame:
    return m.names.select("id", tx.proper_noun(c("name")).alias("proper"))


@query("f16_pronoun_filter", f"SELECT id, w FROM (SELECT id, unnest(string_split(body, ' ')) AS w FROM texts) WHERE lower(trim(w)) NOT IN ({', '.join(repr(x) for x in tx.PRONOUNS)}) AND w <> ''")
def _(m: Model) -> DataFrame:
    split = m.texts.select("id", F.explode(F.split("body", " ")).alias("w"))
    return split.where(~tx.pronoun(c("w")) & (c("w") != ""))


@query("f17_description", "SELECT node_id, nullif(substr(string_agg(content, ', ' ORDER BY id, content), 1, 200), '') AS description FROM facets WHERE kind <> 'name' GROUP BY node_id")
def _(m: Model) -> DataFrame:
    """Facets in order of id, then of content where ids are equal."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("id", "content"))), lambda x: x["content"])
    return m.facets.where("kind <> 'name'").groupBy("node_id").agg(tx.describe(parts).alias("description"))


@query("f18_token_estimate", "SELECT id, CAST(ceil(length(body) / 3.3::DOUBLE) AS BIGINT) AS tokens, CAST(ceil(length(body) / 4.0::DOUBLE) AS BIGINT) AS quarter FROM texts")
def _(m: Model) -> DataFrame:
    return m.texts.select("id", tx.token_estimate(c("body")).alias("tokens"), tx.token_estimate(c("body"), 4.0).alias("quarter"))


@query("f19_registry_entry", "SELECT id, CASE id % 3 WHEN 0 THEN concat('[', CAST(id AS STRING), '] ', name, ' (', kind, '): ', coalesce(description, '')) WHEN 1 THEN concat('[', CAST(id AS STRING), '] ', name, ' (', kind, ')') ELSE name END AS entry FROM names")
def _(m: Model) -> DataFrame:
    head = F.format_string("[%d] %s (%s)", "id", "name", "kind")
    return m.names.select("id", F.when(c("id") % 3 == 0, F.concat(head, lit(": "), F.coalesce("description", lit("")))).when(c("id") % 3 == 1, head).otherwise(c("name")).alias("entry"))


def weak_sql(x: str) -> str:
    weak = " OR ".join(f"regexp_matches({x}, '{p}')" for p in tx.WEAK)
    return f"CASE WHEN description IS NULL OR description = '' THEN 'none' WHEN {weak} OR (length({x}) < 15 AND NOT regexp_matches({x}, '{tx.AUXILIARY}')) THEN 'weak' ELSE 'strong' END"


@query("f20_causation", f"SELECT id, {weak_sql('trim(lower(description))')} AS level FROM (SELECT id, CASE id % 4 WHEN 0 THEN 'Something happens here' WHEN 1 THEN 'The person leaves' WHEN 2 THEN 'short' ELSE description END AS description FROM names)")
def _(m: Model) -> DataFrame:
    said = F.when(c("id") % 4 == 0, "Something happens here").when(c("id") % 4 == 1, "The person leaves").when(c("id") % 4 == 2, "short").otherwise(c("description"))
    return m.names.select("id", tx.causation(said).alias("level"))


@query("f21_plot_flags", "SELECT id, contains(t, 'gapdetected') OR contains(t, 'plot hole') OR contains(t, 'missing trigger') AS hole, contains(t, 'weak') OR contains(t, 'vague causation') OR contains(t, 'generic') AS weak FROM (SELECT id, lower(split_part('A plot hole here|gapDetected: yes|Weak link|too Generic|fine', '|', CAST(id % 5 AS INT) + 1)) AS t FROM names)")
def _(m: Model) -> DataFrame:
    said = F.split_part(lit("A plot hole here|gapDetected: yes|Weak link|too Generic|fine"), lit("|"), (c("id") % 5 + 1).cast("int"))
    return m.names.select("id", tx.plot_flags(said).alias("f")).select("id", c("f.plot_hole").alias("hole"), c("f.weak_causation").alias("weak"))


@query("f23_embedding_text", "SELECT n.id, concat(n.name, ': ', coalesce(n.description, ''), CASE WHEN t IS NULL THEN '' ELSE concat(' | ', t) END) AS embedded FROM names n LEFT JOIN (SELECT node_id, string_agg(content, ' ' ORDER BY id) AS t FROM facets WHERE kind = 'name' GROUP BY node_id) f ON f.node_id = n.id")
def _(m: Model) -> DataFrame:
    said = m.facets.where("kind = 'name'").groupBy(c("node_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "content"))), lambda x: x["content"]).alias("said"))
    return m.names.join(said, "id", "left").select("id", tx.embedding_text(c("name"), c("description"), c("said")).alias("embedded"))


@query("t19_span_context", "SELECT id, substr(body, greatest(id % 400 - 50, 0) + 1, id % 400 + 20 + 50 - greatest(id % 400 - 50, 0)) AS context FROM texts")
def _(m: Model) -> DataFrame:
    start = c("id") % 400
    return m.texts.select("id", tx.span_context(c("body"), start, start + 20).alias("context"))


# --- dates and numbers


@query("d1_calendar", "SELECT id, strftime(day, '%Y-%m-%d') AS key, CAST(CAST(date_trunc('month', day) AS DATE) AS STRING) AS month_start, CAST(DATE '2026-01-01' - day AS BIGINT) AS age, CAST(CAST(day + INTERVAL '1' MONTH AS DATE) AS STRING) AS clamped, CAST(day - 7 AS STRING) AS week_ago, CAST(day + 1 AS STRING) AS tomorrow FROM usage")
def _(m: Model) -> DataFrame:
    day = c("day")
    return m.usage.select("id", cal.day_key(day).alias("key"), F.trunc(day, "month").cast("string").alias("month_start"), cal.age_days(day, lit("2026-01-01").cast("date")).cast("bigint").alias("age"), F.add_months(day, 1).cast("string").alias("clamped"), F.date_sub(day, 7).cast("string").alias("week_ago"), F.date_add(day, 1).cast("string").alias("tomorrow"))


@query("d2_month_overflow", "SELECT id, CAST(CAST(date_trunc('month', day) + INTERVAL '1' MONTH AS DATE) + CAST(day_of - 1 AS INT) AS STRING) AS next FROM (SELECT id, day, extract('day' FROM day) AS day_of FROM usage)")
def _(m: Model) -> DataFrame:
    return m.usage.select("id", cal.add_month_overflowing(c("day")).cast("string").alias("next"))


@query("m1_curves_and_units", "SELECT id, round(0.5 * (1 - cos(pi() * greatest(0, least(1, x)))), 9) AS s, round(exp(-abs(x * 1000 - 300) / 1000), 9) AS near, CAST(ceil(x * 5 * 1000) AS BIGINT) AS units, CAST(least(1000 * pow(2, id % 6), 30000) AS BIGINT) AS backoff FROM (SELECT id, (id % 120) / 100.0::DOUBLE AS x FROM usage)")
def _(m: Model) -> DataFrame:
    x = (c("id") % 120) / 100.0
    return m.usage.select("id", F.round(cal.s_curve(x), 9).alias("s"), F.round(cal.proximity(x * 1000 - 300), 9).alias("near"), cal.usage_units(x).alias("units"), cal.backoff(c("id") % 6).alias("backoff"))
