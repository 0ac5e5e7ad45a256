"""Name, text and span functions as Spark column expressions; none leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that decide results.
TITLES = "mr mrs ms miss dr professor prof sir lord lady count countess duke duchess king queen prince princess captain general colonel major sergeant detective officer father mother brother sister uncle aunt grandpa grandma grandfather grandmother".split()
ARTICLES = "the a an that this".split()
EPITHETS = ["the great", "the terrible", "the wise", "the brave", "the bold", "the elder", "the younger", "the first", "the second", "the third", "jr", "junior", "sr", "senior"]
PRONOUNS = [
    "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "mine", "your", "yours", "his", "hers", "its", "our", "ours",
    "their", "theirs", "myself", "yourself", "himself", "herself", "itself", "ourselves", "yourselves", "themselves", "this", "that", "these",
    "those", "anyone", "anybody", "anything", "everyone", "everybody", "everything", "someone", "somebody", "something", "nobody", "no one",
    "nothing", "one", "ones", "another", "other", "others", "who", "whom", "whose", "what", "which",
]
WEAK = [
    r"^an? (event|thing|action|change) (occurs?|happens?)",
    r"^something (occurs?|happens?)",
    r"^(it|this) (occurs?|happens?)",
    r"^(the )?(character|person|entity)",
    r"^[a-z]+ changes?$",
    r"^transition",
]
AUXILIARY = r"(do|does|is|are|was|were|have|has|had|can|will|would|should|may|might|must)"
# Fixed values that decide results, each pattern with what takes its place, in this order.
PAGE = [
    (r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""), (r"<[^>]+>", " "), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"),
    ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("&#39;", "'"), (r"\s+", " "),
]
MARKDOWN = [(r"(?m)^#{1,6}\s+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"`([^`]+)`", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1")]
EXPORT = [
    (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), (r"(?is)<script[^>]*>.*?</script>", ""), (r'<[^>]+data-type="mention"[^>]*data-label="([^"]*)"[^>]*>.*?</[^>]+>', "@$1"),
    (r'<[^>]+data-type="mention"[^>]*>([^<]*)</[^>]+>', "@$1"), (r'style="[^"]*var\([^"]*"', ""),
]
EMAIL, USERNAME, SPECIAL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$", r"^[a-zA-Z0-9_]{3,50}$", r"[!@#$%^&*()_+\-=\[\]{}|;:,.<>?]"

TITLE = f"^({'|'.join(TITLES)})\\.?\\s+"
ARTICLE = f"^({'|'.join(ARTICLES)})\\s+"
EPITHET = f",?\\s+({'|'.join(EPITHETS)})$"


def normalise_name(name: Column) -> Column:
    """Lower case without a leading article, a leading title and an epithet at the end, in that order, each once."""
    low = F.trim(F.lower(name))
    for pattern in (ARTICLE, TITLE, EPITHET):
        low = F.regexp_replace(low, pattern, "")
    return F.trim(F.regexp_replace(low, r"\s+", " "))


def title(name: Column) -> Column:
    """The leading title in lower case, or null."""
    return F.nullif(F.lower(F.regexp_extract(name, f"(?i){TITLE}", 1)), F.lit(""))


def epithet(name: Column) -> Column:
    """The epithet at the end in lower case, or null."""
    return F.nullif(F.lower(F.regexp_extract(name, f"(?i){EPITHET}", 1)), F.lit(""))


def name_tokens(name: Column) -> Column:
    """Words of more than one letter of a normalised name."""
    return F.filter(F.split(normalise_name(name), " "), lambda w: F.length(w) > 1)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two word sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def token_overlap(a: Column, b: Column) -> Column:
    return jaccard(F.array_distinct(name_tokens(a)), F.array_distinct(name_tokens(b)))


def substring_match(a: Column, b: Column) -> Column:
    """One normalised name holds the other; both of two letters or more."""
    x, y = normalise_name(a), normalise_name(b)
    return (F.length(x) >= 2) & (F.length(y) >= 2) & (F.contains(x, y) | F.contains(y, x))


def share_title(a: Column, b: Column) -> Column:
    return F.coalesce(title(a) == title(b), F.lit(False))


def likely_epithet(name: Column) -> Column:
    low = F.lower(name)
    return (F.startswith(low, F.lit("the ")) & (F.size(F.split(low, " ")) >= 3)) | low.rlike(r"who \w+|of the |the \w+ one")


def alias_variants(name: Column) -> Column:
    """Lower-cased forms that may stand for a name: itself, normalised, its title with and without "the", first and last word."""
    tokens, own = name_tokens(name), title(name)
    several = F.size(tokens) > 1
    forms = F.array(
        F.lower(name), normalise_name(name), own, F.concat(F.lit("the "), own), F.when(several, F.get(tokens, F.lit(0))), F.when(several, F.get(tokens, F.size(tokens) - 1))
    )
    return F.array_distinct(F.filter(forms, lambda v: v.isNotNull()))


def name_parts(name: Column) -> Column:
    """What names are compared by: n, normalised; t, the title or null; w, the distinct tokens."""
    return F.struct(normalise_name(name).alias("n"), title(name).alias("t"), F.array_distinct(name_tokens(name)).alias("w"))


def parts_alias(x: Column, y: Column) -> Column:
    """alias_score of two names given by their parts."""
    overlap, inside = jaccard(x["w"], y["w"]), (F.length(x["n"]) >= 2) & (F.length(y["n"]) >= 2) & (F.contains(x["n"], y["n"]) | F.contains(y["n"], x["n"]))
    same = F.coalesce(x["t"] == y["t"], F.lit(False))
    return F.when(x["n"] == y["n"], F.lit(1.0)).when(inside, F.lit(0.85)).when(same, F.lit(0.7)).when(overlap > 0, 0.5 + overlap * 0.3).otherwise(F.lit(0.0))


def alias_score(a: Column, b: Column) -> Column:
    """1 for equal normalised names, .85 if one holds the other, .7 for one title, .5 + .3 * overlap, else 0."""
    # Bound once, or each comparison would normalise both names again.
    return F.get(F.transform(F.array(F.struct(name_parts(a).alias("a"), name_parts(b).alias("b"))), lambda p: parts_alias(p["a"], p["b"])), F.lit(0))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the Levenshtein distance over the longer length; 1 if both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1.0 - F.levenshtein(a, b) / longest).otherwise(F.lit(1.0))


def text_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def word_overlap(anchor: Column, other: Column) -> Column:
    """Share of the anchor's distinct words that the other text has; 0 without words."""
    a = F.array_distinct(text_words(anchor))
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, text_words(other))) / F.size(a)).otherwise(F.lit(0.0))


def trigrams(text: Column) -> Column:
    # The words are bound once: named inside the inner lambda, the text would be split again for each trigram.
    grams = lambda w: F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, 3), " "))).otherwise(F.array().cast("array<string>"))
    return F.get(F.transform(F.array(text_words(text)), grams), F.lit(0))


def trigram_overlap(anchor: Column, other: Column) -> Column:
    """Share of the anchor's distinct word trigrams that the other text has; 1 if the anchor has under three words."""
    a = F.array_distinct(trigrams(anchor))
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, trigrams(other))) / F.size(a)).otherwise(F.lit(1.0))


def segment_overlap(a: Column, b: Column) -> Column:
    """Shared distinct words of over two letters over the larger set; 0 if either has none."""
    x, y = (F.array_distinct(F.filter(text_words(t), lambda w: F.length(w) > 2)) for t in (a, b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))).otherwise(F.lit(0.0))


def text_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def segment_hash(text: Column) -> Column:
    return F.substring(text_hash(text), 1, 16)


def proper_noun(name: Column) -> Column:
    """No leading the, a or an, and a first letter that is its own upper case."""
    own = F.trim(name)
    first = F.substring(own, 1, 1)
    return (own != "") & ~F.lower(own).rlike(r"^(the|a|an)\s") & (first == F.upper(first))


def pronoun(name: Column) -> Column:
    return F.lower(F.trim(name)).isin(PRONOUNS)


def describe(facets: Column, limit: int = 200, joint: str = ", ") -> Column:
    """Facets joined and cut to a limit; null if nothing is left."""
    return F.nullif(F.substring(F.array_join(facets, joint), 1, limit), F.lit(""))


def token_estimate(text: Column, per_token: float = 3.3) -> Column:
    return F.ceil(F.length(text) / F.lit(per_token)).cast("bigint")


def causation(description: Column) -> Column:
    """none, weak (a stock phrase, or short without an auxiliary verb) or strong."""
    low = F.trim(F.lower(description))
    weak = reduce(lambda a, b: a | b, [low.rlike(p) for p in WEAK]) | ((F.length(low) < 15) & ~low.rlike(AUXILIARY))
    return F.when(description.isNull() | (description == ""), F.lit("none")).when(weak, F.lit("weak")).otherwise(F.lit("strong"))


def plot_flags(reasoning: Column) -> Column:
    """Struct of plot_hole and weak_causation, from words in a conflict's reasoning."""
    low = F.lower(reasoning)
    any_of = lambda *found: reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in found])
    return F.struct(any_of("gapdetected", "plot hole", "missing trigger").alias("plot_hole"), any_of("weak", "vague causation", "generic").alias("weak_causation"))


def embedding_text(name: Column, description: Column, mentions: Column) -> Column:
    """name: description | mentions; without mentions the bar is left out."""
    said = F.trim(F.array_join(F.coalesce(mentions, F.array().cast("array<string>")), " "))
    return F.concat(name, F.lit(": "), F.coalesce(description, F.lit("")), F.when(said != "", F.concat(F.lit(" | "), said)).otherwise(F.lit("")))


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def replaced(text: Column, patterns: list[tuple[str, str]]) -> Column:
    return reduce(lambda out, p: F.regexp_replace(out, *p), patterns, text)


def html_text(html: Column) -> Column:
    """Text of a page: scripts and styles dropped, tags as blanks, six entities decoded, white space collapsed."""
    return F.trim(replaced(html, PAGE))


def markdown_text(text: Column) -> Column:
    """Markdown without heading marks, bold, italic, code and link targets."""
    return replaced(text, MARKDOWN)


def clean_html(html: Column) -> Column:
    """Markup for export: control characters, scripts and styles that use variables go; mentions become @label."""
    return replaced(html, EXPORT)


def span_context(text: Column, start: Column, end: Column, around: int = 50) -> Column:
    """A span with up to `around` characters on each side."""
    first = F.greatest(start - around, F.lit(0))
    return F.substring(text, (first + 1).cast("int"), (end + around - first).cast("int"))


def valid_email(text: Column) -> Column:
    return text.rlike(EMAIL)


def valid_username(text: Column) -> Column:
    return text.rlike(USERNAME)


def valid_password(text: Column) -> Column:
    """Eight characters or more, and under sixteen a special one."""
    return (F.length(text) >= 8) & ((F.length(text) >= 16) | text.rlike(SPECIAL))
