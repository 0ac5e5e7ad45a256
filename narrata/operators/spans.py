"""Span operators: functions of one text applied to whole tables in Arrow batches; nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.functions import spans as sp
from narrata.operators.relational import containing


#: Arrow types of the column types that span functions give.
TYPES = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def spread(frame: DataFrame, columns: list[str], work: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """For each row, rows of (the first column, *result) for every result of `work` on the other columns; in Arrow
    batches, column by column."""
    fields = [part.split() for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [work(*values) for values in zip(*(column.to_pylist() for column in batch.columns[1:]), strict=True)]
            at = pa.array([k for k, rows in enumerate(found) for _ in rows], pa.int64())
            flat = [row for rows in found for row in rows]
            results = zip(*flat, strict=True) if flat else [()] * (len(fields) - 1)
            arrays = [pa.array(values, TYPES[kind]) for values, (_, kind) in zip(results, fields[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at).cast(TYPES[fields[0][1]]), *arrays], [name for name, _ in fields])

    return frame.select(*columns).mapInArrow(run, schema)


def sentences(frame: DataFrame, key: str = "id", text: str = "body") -> DataFrame:
    """(id, idx, start, end, sentence, hash) of every sentence."""
    return spread(frame, [key, text], lambda t: [(k, *s) for k, s in enumerate(sp.sentences(t))], "id bigint, idx int, start int, end int, sentence string, hash string")


def boundaries(frame: DataFrame, keep: Callable = lambda found, text: found, key: str = "id", text: str = "body") -> DataFrame:  # noqa: ANN001
    """(id, position, kind) of segment boundaries, after `keep` has chosen among them."""
    return spread(frame, [key, text], lambda t: keep(sp.boundaries(t or ""), t or ""), "id bigint, position int, kind string")


def segments(frame: DataFrame, key: str = "id", text: str = "body") -> DataFrame:
    """(id, idx, start, end, hash) of every segment."""
    from hashlib import sha256

    return spread(frame, [key, text], lambda t: [(k, a, b, sha256(t[a:b].encode()).hexdigest()[:16]) for k, (a, b) in enumerate(sp.segments(t))], "id bigint, idx int, start int, end int, hash string")


def occurrences(frame: DataFrame, name: str, aliases: str | None = None, key: str = "id", text: str = "body") -> DataFrame:
    """(id, start, end, matched, confidence) of the name in each row's text."""
    work = lambda t, n, *a: sp.occurrences(t or "", n or "", list(a[0]) if a and a[0] is not None else None)
    return spread(frame, [key, text, name, *([aliases] if aliases else [])], work, "id bigint, start int, end int, matched string, confidence int")


def linked_mentions(frame: DataFrame, facets: DataFrame, name: str, aliases: str, key: str = "id", text: str = "body") -> DataFrame:
    """(id, idx, relative_start, relative_end, matched, confidence, facet_id): mention rows of each text's name.

    Occurrences of the name and its aliases, placed in the text's segments (those that no segment holds have no row);
    facet_id is that of the name facet (facets: id of the text as node_id, id, content) whose content is what was
    matched, case and outer blanks aside; of several the greatest id counts, and null if there is none.
    """
    found = occurrences(frame, name, aliases, key, text).withColumnRenamed("start", "at")
    pieces = segments(frame, key, text).select("id", "idx", F.col("start").alias("start_at"), F.col("end").alias("end_at"))
    placed = containing(found, pieces, "id", "at", width=4096)
    said = lambda x: F.lower(F.trim(x))
    known = facets.groupBy(F.col("node_id").alias("id"), said("content").alias("_said")).agg(F.max("id").alias("facet_id"))
    named = placed.withColumn("_said", said(F.col("matched"))).join(known, ["id", "_said"], "left")
    return named.select("id", "idx", (F.col("at") - F.col("start_at")).alias("relative_start"), (F.col("end") - F.col("start_at")).alias("relative_end"), "matched", "confidence", "facet_id")


def fuzzy(frame: DataFrame, key: str = "id") -> DataFrame:
    """(id, start, end, confidence) of each row's source in its whole body: at its old place, anywhere, or the most
    similar window; passages that are lost have no row."""
    work = lambda text, source, a, b: [found] if (found := sp.relocate(text or "", source or "", int(a), int(b))) else []
    return spread(frame, [key, "body", "source", "start_at", "end_at"], work, "id bigint, start int, end int, confidence double")


def segment_first(frame: DataFrame, key: str = "id") -> DataFrame:
    """As fuzzy(), but in the row's segment (seg_start, seg_end; null: none) first; the whole body counts only if
    nothing there is at least 70 % alike."""

    def work(text, source, a, b, c, d):  # noqa: ANN001, ANN202
        found = sp.relocate_in(text or "", source or "", int(a), int(b), None if c is None else (int(c), int(d)))
        return [found] if found else []

    return spread(frame, [key, "body", "source", "start_at", "end_at", "seg_start", "seg_end"], work, "id bigint, start int, end int, confidence double")


def split_overflow(frame: DataFrame, capacity: int) -> DataFrame:
    """(batch, id, part, start, end, how): how batches of segments (batch, id, body) are sent if `capacity` characters fit.

    A batch that fits goes whole; of others each segment goes alone; a segment that does not fit goes in halves, cut at
    the sentence end nearest to its middle (it stays whole if that would leave a half empty). Null bodies count 0.
    """
    size = F.coalesce(F.length("body"), F.lit(0))
    totals = frame.groupBy("batch").agg(F.sum(size).alias("_total"))
    sized = frame.withColumn("_n", size).join(totals, "batch")
    how = F.when(F.col("_total") <= capacity, "batch").when(F.col("_n") <= capacity, "segment")
    fit = sized.where(how.isNotNull()).select("batch", "id", F.lit(0).alias("part"), F.lit(0).alias("start"), F.col("_n").alias("end"), how.alias("how"))

    def halves(text: str) -> list[tuple]:
        cut = sp.nearest_stop(text, len(text) // 2)
        return [(0, 0, cut, "half"), (1, cut, len(text), "half")] if 0 < cut < len(text) else [(0, 0, len(text), "segment")]

    large = sized.where(how.isNull())
    cut = spread(large, ["id", "body"], halves, "id bigint, part int, start int, end int, how string")
    return fit.unionByName(cut.join(large.select("batch", "id"), "id").select("batch", "id", "part", "start", "end", "how"))


def relocated(frame: DataFrame, key: str = "id") -> DataFrame:
    """(id, start, end, confidence, how) for rows of body, source, digest, start_at, end_at, seg_start and seg_end;
    passages that are lost have no row."""

    def work(text, source, digest, a, b, c, d):  # noqa: ANN001, ANN202
        segment = None if c is None else (int(c), int(d))
        found = sp.resolve(text or "", source or "", digest or "", int(a), int(b), segment)
        return [found] if found else []

    return spread(frame, [key, "body", "source", "digest", "start_at", "end_at", "seg_start", "seg_end"], work, "id bigint, start int, end int, confidence double, how string")
