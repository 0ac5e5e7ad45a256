"""Toxicity: a weighted finite-state grammar of patterns over clauses.

A tagger reads the words of a clause: it gives insults of a learned lexicon (words and stems, each with its weight)
and the words of closed classes their tags. Five transducers rewrite such tag sequences and weigh them: `picked`
takes one insult or threat of the clause, where the tagger reads the others as plain words; `threats` lets a chosen threat through only
after a word of intent and before a target; `targeted` weighs a chosen insult by a target before it or in the three
words behind it; `negated` and `reported` lower what stands after a negation or a verb of saying. compose() joins
them, once, into one machine over tags. Weights multiply along a path and the best path counts (max-times semiring):
that is the clause's weight, whatever its length. A document's score is the chance that at least one clause is
toxic, as if clauses were independent.

The insult lexicon is learned from labelled documents: a word or stem (its first letters) is taken if nearly all
labelled documents that have it are toxic. Its weight is the smoothed share of toxic documents among those with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import plain_words, settle

#: Labelled documents learned from, at most: those with the least hash of their id.
SAMPLE = 10_000
#: Letters of a stem, least toxic documents that hold a term (and share of them), and least weight.
STEMS, LEAST, SHARE, WEIGHT = (4, 5, 6), 4, 0.012, 0.97
#: Words of the grammar's closed classes in English, German, French and Spanish.
NEGATION = frozenset("not no never none nobody isn't aren't wasn't weren't don't doesn't didn't nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás ningún ninguna tampoco".split())
REPORTED = frozenset("said says say called calls claimed claims wrote quoted quote reported allegedly sagte sagt nannte schrieb behauptet dit disait appelé écrit prétend dijo dice llamó escribió afirma".split())
TARGET = frozenset("you your you're u he she they him her them his their du dich dir ihr euch sie er tu te toi vous il elle ils elles tú ti usted ustedes él ella ellos ellas".split())
THREAT = frozenset("kill murder hurt stab shoot hang beat burn destroy töten umbringen schlagen erschießen tuer frapper brûler égorger matar golpear quemar apuñalar".split())
INTENT = frozenset("will gonna going shall should must werde wird soll vais va doit voy va debe".split())
#: Factors of an insult's weight: without a target, next to one, negated, reported; and a threat's own weight.
PLAIN_FACTOR, TARGET_FACTOR, NEGATED_FACTOR, REPORTED_FACTOR, THREAT_WEIGHT = 0.9, 1.0, 0.2, 0.3, 0.7
CLAUSE = re.compile(r"[.!?;:\n…]+")
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


#: Tags; OTHER stands for all words without one, SCORED for an insult or threat that is weighed already.
OTHER, NEGATE, SAY, AIM, INTEND, HARM, INSULT, SCORED = "other", "negate", "say", "aim", "intend", "harm", "insult", "scored"
CLOSED = {word: tag for tag, words in ((NEGATE, NEGATION), (SAY, REPORTED), (AIM, TARGET), (INTEND, INTENT)) for word in words}
#: Words after an insult or threat among which a target counts as its own.
REACH = 3


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, tag read) to (tag written, weight, next state) of each arc; a path ends in a state of `ends`."""

    start: object
    arcs: dict[tuple, list[tuple]]
    ends: frozenset


def transducer(start: object, ends: set, special: dict[tuple, list[tuple]], states: set) -> Transducer:
    """In each state a tag without arcs of its own is copied with weight 1."""
    arcs = {(s, t): special.get((s, t), [(t, 1.0, s)]) for s in states for t in (OTHER, NEGATE, SAY, AIM, INTEND, HARM, INSULT, SCORED)}
    return Transducer(start, arcs, frozenset(ends))


def picked() -> Transducer:
    """Takes one insult or threat; the tagger reads the others as other words."""
    return transducer(0, {1}, {(0, t): [(t, 1.0, 1)] for t in (INSULT, HARM)} | {(1, t): [] for t in (INSULT, HARM)}, {0, 1})


def waiting(special: dict, weight: float) -> dict:
    """Adds the states 1 to REACH, words left in which a target must come; then "done"."""
    for left in range(1, REACH + 1):
        for tag in (OTHER, NEGATE, SAY, INTEND, SCORED):
            special[left, tag] = [(tag, 1.0, left - 1)] if left > 1 else []
        special[left, AIM] = [(AIM, weight, "done")]
    return special


def threats() -> Transducer:
    """A chosen threat needs a word of intent before it and a target behind it."""
    special = waiting({("calm", INTEND): [(INTEND, 1.0, "intent")], ("calm", HARM): [], ("intent", HARM): [(SCORED, THREAT_WEIGHT, REACH)]}, 1.0)
    return transducer("calm", {"calm", "intent", "done"}, special, {"calm", "intent", "done", *range(1, REACH + 1)})


def targeted() -> Transducer:
    """A chosen insult weighs more by a target earlier in the clause or close behind."""
    special = waiting({("none", AIM): [(AIM, 1.0, "aimed")], ("none", INSULT): [(SCORED, PLAIN_FACTOR, "done"), (SCORED, TARGET_FACTOR, REACH)], ("aimed", INSULT): [(SCORED, TARGET_FACTOR, "done")]}, 1.0)
    return transducer("none", {"none", "aimed", "done"}, special, {"none", "aimed", "done", *range(1, REACH + 1)})


def lowered(by: str, factor: float) -> Transducer:
    """What is scored after a word tagged `by` loses weight."""
    return transducer(0, {0, 1}, {(0, by): [(OTHER, 1.0, 1)], (1, by): [(OTHER, 1.0, 1)], (1, SCORED): [(SCORED, factor, 1)]}, {0, 1})


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that reads what `first` reads and writes what `second` makes of first's output."""
    start = (first.start, second.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for (a, read), ways in first.arcs.items():
            if a != state[0]:
                continue
            found = arcs.setdefault((state, read), [])
            for written, weight, after in ways:
                for out, more, end in second.arcs[state[1], written]:
                    found.append((out, weight * more, (after, end)))
                    if (after, end) not in seen:
                        seen.add((after, end))
                        todo.append((after, end))
    return Transducer(start, arcs, frozenset(s for s in seen if s[0] in first.ends and s[1] in second.ends))


@cache
def machine() -> tuple[int, dict[str, list[list[tuple[float, int]]]], frozenset]:
    """The composed transducers: start, next (weight, state) by tag and state, and ends; states that reach no end are cut."""
    whole = reduce(compose, [picked(), threats(), targeted(), lowered(NEGATE, NEGATED_FACTOR), lowered(SAY, REPORTED_FACTOR)])
    useful, grown = set(whole.ends), True
    while grown:
        more = {s for (s, _), ways in whole.arcs.items() if any(w[2] in useful for w in ways)} - useful
        useful, grown = useful | more, bool(more)
    number = {s: k for k, s in enumerate(sorted(useful, key=repr))}
    tags = {}
    for (s, tag), ways in whole.arcs.items():
        if s in number:
            tags.setdefault(tag, [[] for _ in number])[number[s]] = [(w, number[n]) for _, w, n in ways if n in number]
    return number[whole.start], tags, frozenset(number[s] for s in whole.ends)


@dataclass
class Grammar:
    """A lexicon (term to weight) of whole words and of stems: the tagger before the composed machine."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def insult(self, word: str) -> float:
        """Weight with which the tagger takes a word for an insult; 0 if it does not."""
        best = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) >= n:
                best = max(best, self.stems.get(word[:n], 0.0))
        return best

    def tags(self, word: str) -> list[tuple[str, float]]:
        """Tags of a word, each with its weight: a closed class alone, or an insult, a threat, and a word like others."""
        word = word.replace("’", "'")
        if word in CLOSED:
            return [(CLOSED[word], 1.0)]
        weight, harm = self.insult(word), word in THREAT
        return [(INSULT, weight)] * (weight > 0) + [(HARM, 1.0)] * harm + [(OTHER, 1.0)]

    def clause(self, tokens: list[str]) -> float:
        """Weight of the best path of the composed machine over a clause's words; 0 if it has none."""
        start, arcs, ends = machine()
        live = {start: 1.0}
        for word in tokens:
            now: dict[int, float] = {}
            for tag, weight in self.tags(word):
                ways = arcs[tag]
                for state, so_far in live.items():
                    for w, after in ways[state]:
                        if (value := so_far * weight * w) > now.get(after, 0.0):
                            now[after] = value
            live = now
        return max((w for s, w in live.items() if s in ends), default=0.0)

    def score(self, text: str | None, hits: list[int]) -> float:
        """Score of a lower-cased text, given where insults and threats begin; each clause is read once, and whole."""
        clean, begin, k = 1.0, 0, 0
        for end, after in [*((m.start(), m.end()) for m in CLAUSE.finditer(text)), (len(text), len(text))] if hits else []:
            held = k
            while k < len(hits) and hits[k] < end:
                k += 1
            if k > held:
                clean *= 1.0 - min(self.clause(TOKEN.findall(text, begin, end)), 0.999)
            begin = after
            if k == len(hits):
                break
        return 1.0 - clean


def scorer(grammar: Grammar):  # noqa: ANN201
    """A function for mapInArrow from (doc_id, low) to (doc_id, score): every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for term in {*grammar.words, *grammar.stems, *THREAT}:
            found.add_word(term, len(term))
        found.make_automaton()
        begins = lambda text: sorted({end - n + 1 for end, n in found.iter(text) if end == n - 1 or not (text[end - n].isalnum())})
        for batch in batches:
            scores = [grammar.score(text, begins(text)) if text else 0.0 for text in (x.as_py() for x in batch.column("low"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def terms(text: Column) -> Column:
    """Distinct words of letters of a text, and their stems marked by a star."""
    found = F.array_distinct(F.filter(plain_words(text), lambda w: F.length(w) >= 3))
    return F.array_union(found, F.array_distinct(F.concat(*[prefixes(found, n) for n in STEMS])))


def prefixes(found: Column, n: int) -> Column:
    return F.transform(F.filter(found, lambda w: F.length(w) >= n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Grammar:
    """Learns the lexicon from labelled documents for which `learn` (a condition on doc_id) holds.

    Rows with a null id, label or text teach nothing; an id with several labels is toxic if any is; equal texts count
    once. At most `sample` labelled documents are used, which bounds the lexicon too: all terms that pass are taken.
    Without toxic documents the lexicon is empty.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = settle(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    train = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy(F.xxhash64("text").alias("k")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    train = settle(train.select("toxic", terms(F.col("text")).alias("terms")))
    sizes = dict(train.groupBy("toxic").count().collect())
    bad = sizes.get(1, 0)
    if not bad:
        return Grammar()
    seen = train.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("b"), F.sum(1 - F.col("toxic")).alias("g"))
    kept = seen.where((F.col("b") >= max(LEAST, int(SHARE * bad))) & ((F.col("b") + 0.1) / (F.col("b") + F.col("g") + 0.2) >= WEIGHT)).collect()
    weight = lambda r: (r.b + 0.1) / (r.b + r.g + 0.2)
    stems = {r.term[:-1]: weight(r) for r in kept if r.term.endswith("*")}
    found = {r.term: weight(r) for r in kept if not r.term.endswith("*")}
    return Grammar(found, stems)


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text, however long its clauses are.

    Null and empty texts score 0, and so does everything under an empty lexicon but threats; equal rows score alike and
    each keeps its row; null ids are kept; an empty table gives an empty result; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.lower("text").alias("low")).mapInArrow(scorer(grammar), f"doc_id {kind}, score double")
