"""Quality rules: a document is kept if its character classes and common words look like its language's own.

For each value of `lang` (null counts as a language of its own) the corpus gives two references: the share of each
character class over all its documents, and the share of each word of the language's list of common words. A document's two histograms
are held against these by Jensen-Shannon distance (base 2, so 0 to 1). Distances count only for texts long enough to
have a histogram: the guards are `min_chars` and `min_words`. Everything is a DataFrame expression.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import let, settle, small, words

CLASSES = ("space", "upper", "digit", "point", "symbol", "letter")
#: Common words of each language, fixed values; a caller may give others.
COMMON = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a"],
}
#: Signs that stand for a common word in a document's code string.
CODES = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Masks the places out of a window's packed hash.
PLACES = ~(2**21 - 1)
DEFAULTS = {"min_chars": 200, "min_words": 100, "max_char_distance": 0.21, "max_word_distance": 0.27}


def repeated_words(found: Column) -> Column:
    """Words inside 3-word windows that a text holds twice or more, each word counted once.

    Windows are first sorted as longs, 43 bits of hash over 21 of place, which finds all that may repeat; only these
    are then compared by their whole hashes. The cost is n log n whatever repeats. Texts of over 2**21 words go
    straight to the second step.
    """

    def windows(w: Column, at: Column) -> Column:
        return F.xxhash64(F.element_at(w, at), F.element_at(w, at + 1), F.element_at(w, at + 2))

    def twins(s: Column, key: Callable[[Column], Column]) -> Column:
        same = lambda x, k: F.coalesce(key(F.get(s, k + 1)) == key(x), F.lit(False)) | F.coalesce(key(F.get(s, k - 1)) == key(x), F.lit(False))
        return F.filter(s, same)

    def covered(w: Column) -> Column:
        every = F.sequence(F.lit(1), F.size(w) - 2)
        packed = F.array_sort(F.transform(every, lambda i: windows(w, i).bitwiseAND(F.lit(PLACES)).bitwiseOR(i.cast("bigint"))))
        likely = let(packed, lambda s: F.transform(twins(s, lambda x: F.shiftright(x, 21)), lambda x: x.bitwiseAND(F.lit(~PLACES)).cast("int")))
        exact = F.sort_array(F.transform(F.when(F.size(w) < 2**21, likely).otherwise(every), lambda i: F.struct(windows(w, i).alias("h"), i.alias("i"))))
        places = let(exact, lambda s: F.transform(twins(s, lambda x: x["h"]), lambda x: x["i"]))
        return F.when(F.size(w) >= 3, F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))).otherwise(F.lit(0))

    return let(found, covered).cast("bigint")


def repeated_lines(text: Column) -> Column:
    """Lines holding a word that equal an earlier line of the text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def statistics(docs: DataFrame) -> DataFrame:
    """Adds base counts and character-class counts to documents: one pass, nothing shuffled."""
    found = docs.withColumn("_words", words(F.col("text")))
    rest = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[a-z\x09-\x0D\x20]+", "")
    found = found.withColumn("_rest", rest)
    only = lambda kept: F.length(F.regexp_replace("_rest", f"[^{kept}]+", "")).cast("bigint")
    found = (
        found.withColumn("n_words", F.size("_words").cast("bigint"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("bigint"))
        .withColumn("n_symbols", only(r"#*$%&|<>"))
        .withColumn("n_dup_lines", repeated_lines(F.col("text")))
        .withColumn("n_repeat_words", repeated_words(F.col("_words")))
        .withColumn("_n", F.coalesce(F.length("text"), F.lit(0)).cast("bigint"))
        .withColumn("_upper", only(r"\p{Lu}"))
        .withColumn("_digit", only("0-9"))
        .withColumn("_point", only(r".,;:?!'\"()\-"))
        .withColumn("_symbol", only(r"#*$%&|<>=+_@/\\^~{}\[\]"))
    )
    space = F.col("_n") - F.col("word_chars")
    letter = F.col("word_chars") - F.col("_upper") - F.col("_digit") - F.col("_point") - F.col("_symbol")
    return found.withColumn("_chars", F.array(space, "_upper", "_digit", "_point", "_symbol", letter)).drop("_rest", "_upper", "_digit", "_point", "_symbol")


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of equal length, given as counts; 0 if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)

    def of(a: Column) -> Column:
        term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
        halves = F.zip_with(a["p"], a["q"], lambda x, y: let(F.struct((x / a["n"]).alias("x"), (y / a["m"]).alias("y")), lambda z: term(z["x"], (z["x"] + z["y"]) / 2) + term(z["y"], (z["x"] + z["y"]) / 2)))
        return F.when((a["n"] > 0) & (a["m"] > 0), F.sqrt(F.greatest(F.lit(0.0), total(halves) / 2))).otherwise(F.lit(0.0))

    return let(F.struct(p.cast("array<double>").alias("p"), q.cast("array<double>").alias("q"), total(p).alias("n"), total(q).alias("m")), of)


def common_counts(found: Column, lang: Column, common: dict[str, list[str]]) -> Column:
    """Counts of a language's common words among a text's words, then of all others; null for a language without a list."""

    def of(top: list[str]) -> Column:
        code = lambda w: F.substring(F.lit(CODES), F.array_position(F.lit(top), F.lower(w)).cast("int"), F.lit(1))
        known = F.transform(F.filter(found, lambda w: F.length(w) <= max(map(len, top))), lambda w: F.when(F.array_contains(F.lit(top), F.lower(w)), code(w)).otherwise(F.lit("")))
        counts = lambda s: F.array(*[F.length(s) - F.length(F.replace(s, F.lit(c), F.lit(""))) for c in CODES[: len(top)]], F.size(found) - F.length(s))
        return let(F.array_join(known, ""), counts)

    return reduce(lambda rest, x: F.when(lang == x[0], of(x[1])).otherwise(rest), common.items(), F.lit(None).cast("array<int>"))


def judge(docs: DataFrame, common: dict[str, list[str]] = COMMON, **parameters: float) -> DataFrame:
    """Documents with base counts, both distances and the verdict.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance, base_failed and
    kept to doc_id, lang, source and n_chars. Null and empty texts have no words and fail the base rules; equal rows
    are judged alike, each keeps its row; texts shorter than a guard are not held against that reference, and neither
    are the words of a language without a list; an empty table gives an empty result; other columns of the input are
    not read.
    """
    found = measured(docs, common)
    return verdict(settle(found.drop("text", "_words")), common, **parameters)


def filter_documents(docs: DataFrame, common: dict[str, list[str]] = COMMON, **parameters: float) -> DataFrame:
    """The documents that judge() keeps, with their texts: one pass measures them, one filters what it left in the shared folder.

    A filter on what is only planned would be pushed into the scan, which then finds words and repeats twice. Texts are
    never shuffled. Nulls, ties and empty tables as in judge().
    """
    found = settle(measured(docs, common).select("doc_id", "text", "lang", "source", "n_chars", "_lang", "n_words", "n_repeat_words", "_n", "_chars", "_common"))
    kept = verdict(found, common, **parameters).where("kept")
    return kept.select("doc_id", "text", "lang", "source", "n_chars")


def measured(docs: DataFrame, common: dict[str, list[str]]) -> DataFrame:
    own = docs.select("doc_id", "text", "lang", "source", "n_chars", F.coalesce("lang", F.lit("\x00")).alias("_lang"))
    return statistics(own).withColumn("_common", common_counts(F.col("_words"), F.col("lang"), common))


def verdict(found: DataFrame, common: dict[str, list[str]], **parameters: float) -> DataFrame:
    """Adds both distances, base_failed and kept to measured documents."""
    cfg, width = DEFAULTS | parameters, max([len(x) for x in common.values()], default=0) + 1
    sums = [F.sum(F.get("_chars", F.lit(k))).alias(f"c{k}") for k in range(len(CLASSES))] + [F.sum(F.get("_common", F.lit(k))).alias(f"w{k}") for k in range(width)]
    reference = found.groupBy("_lang").agg(*sums).select(
        "_lang", F.array(*[f"c{k}" for k in range(len(CLASSES))]).alias("_ref_chars"), F.filter(F.array(*[f"w{k}" for k in range(width)]), lambda x: x.isNotNull()).alias("_ref_words")
    )
    judged = found.join(small(reference), "_lang")
    judged = judged.withColumn("char_distance", F.when(F.col("_n") >= cfg["min_chars"], distance(F.col("_chars"), F.col("_ref_chars"))).otherwise(F.lit(0.0)))
    known = F.col("_common").isNotNull() & (F.col("n_words") >= cfg["min_words"])
    judged = judged.withColumn("word_distance", F.when(known, distance(F.col("_common"), F.col("_ref_words"))).otherwise(F.lit(0.0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = judged.withColumn("base_failed", failed)
    good = ~failed & (F.col("char_distance") <= cfg["max_char_distance"]) & (F.col("word_distance") <= cfg["max_word_distance"])
    return judged.withColumn("kept", good)


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
