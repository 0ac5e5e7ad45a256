"""Relational operators of the knowledge base as DataFrame compositions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conjunction(*conditions: Column | None) -> Column:
    """AND of the conditions that are given; true if none is."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def not_in(value: Column, options: list) -> Column:
    """Not one of the options; null passes."""
    return value.isNull() | ~value.isin(options)


def page(frame: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows `offset` to `offset + limit` in order, each with the total and has_more.

    The total is an aggregate of one row, joined to at most `limit` rows.
    """
    total = frame.agg(F.count("*").alias("total"))
    top = frame.orderBy(*order).offset(offset).limit(limit)
    return top.join(F.broadcast(total)).withColumn("has_more", F.lit(offset + limit) < F.col("total"))


def latest(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in order."""
    return frame.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace by key: rows of `changes` win; keys of `changes` are unique or latest() of them."""
    return base.join(changes, keys, "left_anti").unionByName(changes)


def insert_missing(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` whose key `base` lacks: an insert that does nothing on conflict."""
    return new.join(base, keys, "left_anti")


def cascade(frame: DataFrame, gone: DataFrame, column: str, key: str = "id") -> DataFrame:
    """What is left of a table after the deletion of the rows it refers to."""
    return frame.join(gone.select(F.col(key).alias(column)), column, "left_anti")


def with_defaults(left: DataFrame, right: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left outer join whose missing values get defaults; Spark broadcasts the right side if it is small."""
    return left.join(right, key, "left").fillna(defaults)


def as_of(points: DataFrame, states: DataFrame, key: str, at: str, order: str, value: str, before_first: str = "null", width: int = 64) -> DataFrame:
    """For each point the value of the latest state at or before it; ties go to the greater value.

    Both sides are merged and swept by key and bin of `width` positions, so a key with many states costs no product and
    one with most of the points is many tasks; what a bin begins with is carried over from the bins before by a sweep of
    one row a bin. before_first says what a point before all states gets: null, or the first state.
    """
    both = points.withColumn("_at", F.col(at)).withColumn("_is", F.lit(1)).withColumn("_v", F.lit(None).cast(states.schema[value].dataType))
    marks = states.select(F.col(key), F.col(order).alias("_at"), F.lit(0).alias("_is"), F.col(value).alias("_v"))
    swept = both.unionByName(marks, allowMissingColumns=True).withColumn("_bin", F.floor(F.col("_at") / width))
    inside = Window.partitionBy(key, "_bin").orderBy("_at", "_is", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = swept.withColumn("_found", F.last("_v", ignorenulls=True).over(inside)).where("_is = 1")
    ends = swept.groupBy(F.col(key).alias("_k"), F.col("_bin").alias("_b")).agg(F.max(F.when(F.col("_is") == 0, F.struct("_at", "_v")))["_v"].alias("_last"))
    earlier = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carry", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
    whole = found.join(carried, F.col(key).eqNullSafe(F.col("_k")) & F.col("_bin").eqNullSafe(F.col("_b"))).drop("_k", "_b")
    out = F.coalesce("_found", "_carry")
    if before_first == "first":
        first = states.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(order, value))[value].alias("_first"))
        whole, out = whole.join(first, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k"), F.coalesce(out, "_first")
    return whole.withColumn(value, out).drop("_at", "_is", "_v", "_bin", "_found", "_carry", "_first")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column, closed: bool = False) -> Column:
    """Whether two ranges overlap; half-open ranges that touch do not, closed ones do."""
    return ~((a_end < b_start) | (a_start > b_end)) if closed else (a_start < b_end) & (a_end > b_start)


def binned(frame: DataFrame, start: str, end: str, width: int, name: str = "_bin") -> DataFrame:
    """A row for each bin of `width` positions that a range touches."""
    return frame.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: int = 64, closed: bool = False) -> DataFrame:
    """Pairs of overlapping ranges (start_at, end_at) within a key: an equi join on key and bin, each pair once.

    The right side's columns other than the key come out with the prefix r_.
    """
    named = right.select(key, *[F.col(c).alias(f"r_{c}") for c in right.columns if c != key])
    pairs = binned(left, "start_at", "end_at", width).join(binned(named, "r_start_at", "r_end_at", width), [key, "_bin"])
    first = F.greatest(F.floor(F.col("start_at") / width), F.floor(F.col("r_start_at") / width))
    return pairs.where((F.col("_bin") == first) & overlaps(F.col("start_at"), F.col("end_at"), F.col("r_start_at"), F.col("r_end_at"), closed)).drop("_bin")


def containing(points: DataFrame, ranges: DataFrame, key: str, at: str, width: int = 64) -> DataFrame:
    """Points with the half-open range of their key that holds them: an equi join on key and bin."""
    spread = binned(ranges.withColumn("_last", F.col("end_at") - 1).where("_last >= start_at"), "start_at", "_last", width).drop("_last")
    placed = points.withColumn("_bin", F.floor(F.col(at) / width))
    return placed.join(spread, [key, "_bin"]).where((F.col("start_at") <= F.col(at)) & (F.col(at) < F.col("end_at"))).drop("_bin")


def rollup(frame: DataFrame, measures: dict[str, Column], breakdowns: list[str], user: str = "user_id", day: str = "day") -> DataFrame:
    """Daily totals by user, and over all users (user null), each with counts by value of the breakdown columns.

    Counts by (user, day, values) come first, in one partial aggregation; both levels are sums of those.
    """
    fine = frame.groupBy(user, day, *breakdowns).agg(F.count("*").alias("n"), *[m.alias(k) for k, m in measures.items()])
    levels = fine.unionByName(fine.withColumn(user, F.lit(None).cast(frame.schema[user].dataType)))
    totals = levels.groupBy(user, day).agg(F.sum("n").alias("operations"), *[F.sum(k).alias(k) for k in measures])
    for name in breakdowns:
        counts = levels.groupBy(user, day, name).agg(F.sum("n").alias("n")).groupBy(user, day).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, "n")))).alias(f"{name}_breakdown"))
        right = counts.select(F.col(user).alias("_u"), F.col(day).alias("_d"), f"{name}_breakdown")
        totals = totals.join(right, F.col(user).eqNullSafe(F.col("_u")) & (F.col(day) == F.col("_d"))).drop("_u", "_d")
    return totals


def changed(old: DataFrame, new: DataFrame, key: str = "id", value: str = "hash") -> DataFrame:
    """Each key as added, modified, removed or unchanged."""
    both = old.select(key, F.col(value).alias("_old")).join(new.select(key, F.col(value).alias("_new")), key, "full")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("modified")
    return both.select(key, kind.alias("change"))


def budget_prefix(frame: DataFrame, keys: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """Rows in order as long as the running cost stays within the budget; costs are not negative."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return frame.withColumn("running", F.sum(cost).over(window)).where(F.col("running") <= budget)


def field_changes(old: DataFrame, given: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, before, after): fields that are given (not null) and differ from what is there, a null included."""
    both = old.select(key, *[F.col(f).alias(f"_{f}") for f in fields]).join(given.select(key, *fields), key)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}").cast("string").alias("before"), F.col(f).cast("string").alias("after")) for f in fields])
    changed = F.filter(each, lambda x: x["after"].isNotNull() & ~x["before"].eqNullSafe(x["after"]))
    return both.select(key, F.explode(changed).alias("x")).select(key, "x.field", "x.before", "x.after")
