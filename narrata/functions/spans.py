"""Span functions on one text: plain Python, run in Arrow batches where offsets depend on what came before.

Offsets count characters.
"""

from __future__ import annotations

import difflib
import hashlib
import math
import re
from bisect import bisect_left

# Fixed values that decide results.
ABBREVIATIONS = frozenset("mr mrs ms dr prof sr jr st ave blvd vs etc i.e e.g cf al vol no pp inc ltd corp co fig approx dept est".split())
SHORTEST_SENTENCE = 10
SHORT_DOCUMENT, LEAST_SEGMENT, USUAL_SEGMENT, LARGEST_SEGMENT, SNAP = 4000, 750, 6000, 8000, 200
SCENE = re.compile(r"(?:\*{3,}|-{3,}|#{1,3}\s+.+)$|(?:INT\.|EXT\.|FADE\s+(?:IN|OUT|TO))")
STOP = re.compile(r"([.!?]+)(\s+|$)")


def sentences(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, sentence, sha256): stops after abbreviations do not end a sentence; those under ten characters are dropped."""
    if not text or not text.strip():
        return []
    spans, begin = [], 0
    for stop in STOP.finditer(text):
        last = re.split(r"\s+", text[begin : stop.start()])[-1]
        if last.lower().removesuffix(".") in ABBREVIATIONS:
            continue
        spans.append((begin, stop.end(1)))
        begin = stop.end()
    if begin < len(text):
        spans.append((begin, len(text)))
    kept = [(a, b, text[a:b].strip()) for a, b in spans]
    kept = [x for x in kept if len(x[2]) >= SHORTEST_SENTENCE]
    if not kept and len(text.strip()) >= SHORTEST_SENTENCE:
        kept = [(0, len(text), text.strip())]
    return [(*x, hashlib.sha256(x[2].encode()).hexdigest()) for x in kept]


def boundaries(text: str) -> list[tuple[int, str]]:
    """(position, kind), sorted: ends of blank lines, and lines that mark a scene."""
    found = [(m.end(), "double_newline") for m in re.finditer(r"\n\s*\n", text)]
    at = 0
    for line in text.split("\n"):
        if SCENE.match(line.strip()):
            found.append((at, "scene_marker"))
        at += len(line) + 1
    return sorted(found, key=lambda x: x[0])


def spaced(found: list[tuple[int, str]], least: int = LEAST_SEGMENT) -> list[tuple[int, str]]:
    """Boundaries at least so far from the last one kept."""
    kept, last = [], 0
    for at, kind in found:
        if at - last >= least:
            kept.append((at, kind))
            last = at
    return kept


def snap(text: str, target: int, low: int, high: int) -> int:
    """Just after the first white space at or after the target, else the last before it, within reach."""
    ahead = re.compile(r"\s").search(text, target, min(high, target + SNAP))
    if ahead:
        return ahead.end()
    for at in range(target, max(low, target - SNAP), -1):
        if at < len(text) and text[at].isspace():
            return at + 1
    return target


def split_large(found: list[tuple[int, str]], text: str) -> list[tuple[int, str]]:
    """Adds cuts where a segment would be over the largest size."""
    out, last = list(found), 0
    for end in [at for at, _ in found] + [len(text)]:
        if end - last > LARGEST_SEGMENT:
            while end - last > USUAL_SEGMENT:
                last = snap(text, last + USUAL_SEGMENT, last, end)
                out.append((last, "size_split"))
        last = end
    return sorted(out, key=lambda x: x[0])


def segments(text: str | None) -> list[tuple[int, int]]:
    """Half-open segments that cover a text; one for a short document, none for an empty one."""
    if not text:
        return []
    if len(text) < SHORT_DOCUMENT:
        return [(0, len(text))]
    cuts = [at for at, _ in split_large(spaced(boundaries(text)), text)]
    edges = sorted({0, *[c for c in cuts if 0 < c < len(text)], len(text)})
    return list(zip(edges, edges[1:], strict=False))


def similar_segment(a: tuple[int, int, str], b: tuple[int, int, str], length: int) -> float:
    """Likeness of an old and a new segment (start, end, text): place .4, size .2, words .4; without old words .6 and .4."""
    place = max(0.0, 1 - abs(a[0] - b[0]) / max(length, 1))
    one, two = a[1] - a[0], b[1] - b[0]
    size = min(one, two) / max(one, two, 1)
    if len(a[2]) <= 20:
        return 0.6 * place + 0.4 * size
    x, y = ({w for w in t.lower().split() if len(w) > 2} for t in (a[2], b[2]))
    return 0.4 * place + 0.2 * size + 0.4 * (len(x & y) / max(len(x), len(y)) if x and y else 0.0)


def reuse_ids(old: list[tuple[str, int, int, str]], new: list[tuple[int, int, str]], length: int, least: float = 0.7) -> list[str]:
    """An id for each new segment: the most similar old one's not taken yet, if similar enough, else one from its text."""
    free, out = list(old), []
    for piece in new:
        best = max(free, key=lambda o: similar_segment(o[1:], piece, length), default=None)
        if best and similar_segment(best[1:], piece, length) >= least:
            free.remove(best)
            out.append(best[0])
        else:
            out.append(hashlib.sha256(f"{piece[0]}:{piece[2]}".encode()).hexdigest()[:16])
    return out


def validate(pieces: list[tuple[int, int]], length: int) -> list[str]:
    """What is wrong with a list of segments: ranges, gaps, overlaps and ends."""
    errors = [] if pieces or not length else ["no segments"]
    for k, (a, b) in enumerate(pieces):
        if a < 0 or b > length:
            errors.append(f"segment {k} is out of bounds")
        if a >= b:
            errors.append(f"segment {k} is empty")
        if k and pieces[k - 1][1] > a:
            errors.append(f"segment {k} overlaps the one before")
        elif k and pieces[k - 1][1] < a:
            errors.append(f"there is a gap before segment {k}")
    return errors


def occurrences(text: str, name: str, aliases: list[str] | None = None, excluded: list[tuple[int, int]] | None = None, least: int = 70) -> list[tuple[int, int, str, int]]:
    """(start, end, matched, confidence) of a name and its aliases, case aside: at word bounds, outside excluded spans,
    without overlaps (the earlier, then the surer one stays)."""
    found = []
    for term in [t for t in [name, *(aliases or [])] if t]:
        bounds = (r"\b" if re.match(r"\w", term) else "", r"\b" if re.search(r"\w$", term) else "")
        for m in re.finditer(bounds[0] + re.escape(term) + bounds[1], text, re.IGNORECASE):
            if any(m.start() < b and m.end() > a for a, b in excluded or []):
                continue
            same = m.group().lower()
            sure = 95 if same == name.lower() else 85 if same == term.lower() else 75
            if sure >= least:
                found.append((m.start(), m.end(), m.group(), sure))
    out, last = [], -1
    for match in sorted(found, key=lambda x: (x[0], -x[3])):
        if match[0] >= last:
            out.append(match)
            last = match[1]
    return out


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, by rows."""
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def likeness(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 1.0 - edit_distance(a, b) / longest if longest else 1.0


def grams(text: str) -> set[tuple[str, ...]]:
    w = text.lower().split()
    return set(zip(w, w[1:], w[2:], strict=False))


def relocate(text: str, source: str, start: int, end: int) -> tuple[int, int, float] | None:
    """Where a passage is now: at its old place, anywhere, or in the most similar window (at least half alike).

    Windows a third of the passage apart must share 30 % of its words and of its word trigrams before they are
    compared letter by letter. Of several that are only half alike, nearness to the old place counts 30 %.
    """
    if not source:
        return None
    if text[start:end] == source:
        return start, end, 1.0
    if (at := text.find(source)) >= 0:
        return at, at + len(source), 1.0
    n = len(source)
    w, g = set(source.lower().split()), grams(source)
    scored = []
    at = 0
    while at < len(text) - n / 2:
        window = text[at : at + int(n * 1.3)]
        near = set(window.lower().split())
        if w and len(w & near) / len(w) >= 0.3 and (not g or len(g & grams(window)) / len(g) >= 0.3):
            scored.append((likeness(source, window[:n]), at))
        at += max(1, n // 3)
    best = max(scored, key=lambda s: (s[0], -s[1]), default=(0.0, 0))
    if best[0] < 0.5:
        return None
    viable = [s for s in scored if s[0] >= 0.5]
    if best[0] < 0.7 and len(viable) > 1:
        mixed = [(0.7 * s + 0.3 * math.exp(-abs(p - start) / 1000), p) for s, p in viable]
        best = max(mixed, key=lambda s: (s[0], -s[1]))
    return best[1], best[1] + n, best[0]


def relocate_in(text: str, source: str, start: int, end: int, segment: tuple[int, int] | None) -> tuple[int, int, float] | None:
    """relocate() in a segment first; the whole document if that is not at least 70 % alike."""
    if segment:
        a, b = segment
        found = relocate(text[a:b], source, start - a, end - a)
        if found and found[2] >= 0.7:
            return a + found[0], a + found[1], found[2]
    return relocate(text, source, start, end)


def resolve(text: str, source: str, digest: str, start: int, end: int, segment: tuple[int, int] | None) -> tuple[int, int, float, str] | None:
    """A mention's place and how it was found: still valid by its hash, in its segment, in the document, or lost (None)."""
    if hashlib.sha256(text[start:end].encode()).hexdigest() == digest:
        return start, end, 1.0, "valid"
    found = relocate_in(text, source, start, end, segment)
    if found is None:
        return None
    inside = segment is not None and segment[0] <= found[0] < segment[1]
    return (*found, "segment" if inside else "document")


def tolerance(n: int) -> float:
    """Share by which a passage found may differ in length."""
    return 0.1 if n < 50 else 0.2 if n < 200 else 0.3


def event_range(text: str, first: str, last: str) -> tuple[int, int] | None:
    """From the start of one marker to the end of another; None if either is lost or they are out of order."""
    a, b = relocate(text, first, 0, len(first)), relocate(text, last, 0, len(last))
    return (a[0], b[1]) if a and b and a[0] < b[1] and a[0] <= b[0] else None


def nearest_stop(text: str, target: int) -> int:
    """The sentence end nearest to an offset; the offset itself if there is none."""
    ends = [s[1] for s in sentences(text)]
    if not ends:
        return target
    k = bisect_left(ends, target)
    return min(ends[max(0, k - 1) : k + 1], key=lambda e: abs(e - target))


def diff(old: str, new: str) -> str:
    """Unified diff by lines with all context kept apart from unchanged runs."""
    return "\n".join(difflib.unified_diff(old.split("\n"), new.split("\n"), lineterm="", n=3))


def hunks(patch: str) -> list[tuple[int, list[str]]]:
    """(first old line from 0, marked lines) of each hunk."""
    out: list[tuple[int, list[str]]] = []
    for line in patch.split("\n"):
        if m := re.match(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@", line):
            first = int(m[1])
            out.append((first if m[2] == "0" else first - 1, []))
        elif out and line[:1] in ("+", "-", " "):
            out[-1][1].append(line)
    return out


def apply_diff(old: str, patch: str) -> str:
    lines, out, at = old.split("\n"), [], 0
    for first, marked in hunks(patch):
        out += lines[at:first]
        at = first
        for line in marked:
            if line[0] != "+":
                if at >= len(lines) or lines[at] != line[1:]:
                    raise ValueError("the patch does not fit the text")
                at += 1
            if line[0] != "-":
                out.append(line[1:])
    return "\n".join(out + lines[at:])


def invert_diff(patch: str) -> str:
    """The diff that leads back. Lines before the first hunk are headers; in a hunk every line is content by its first sign."""
    out, inside = [], False
    for line in patch.split("\n"):
        if m := re.match(r"@@ (-\S+) (\+\S+) @@", line):
            inside = True
            out.append(f"@@ -{m[2][1:]} +{m[1][1:]} @@")
        else:
            out.append({"+": "-", "-": "+"}.get(line[:1], line[:1]) + line[1:] if inside else line)
    return "\n".join(out)


def significant(patch: str, least: int = 1) -> bool:
    """At least so many lines added or removed."""
    return sum(line[0] in "+-" for _, marked in hunks(patch) for line in marked) >= least


def rebuild(current: str, patches: list[str]) -> str:
    """An older version: the patches that led to the current one, newest first, undone one after another."""
    for patch in patches:
        current = apply_diff(current, invert_diff(patch)) if patch else current
    return current
