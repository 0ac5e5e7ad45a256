"""Packing items into model contexts: batches with overlap, registries by tier, calibration."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def output_reserve(characters: float) -> int:
    """Expected output tokens of an extraction: fixed values fitted to its batches."""
    return math.ceil((4000 + characters / 3.3 * 4.0) * 1.15)


def fitting(sizes: list[int], start: int, room: int, output_room: int, reserve: Callable[[list[int]], int]) -> int:
    """How many items from `start` on fit, with what they will make the model write."""
    used = n = 0
    for k in range(start, len(sizes)):
        used += sizes[k]
        out = reserve(sizes[start : k + 1])
        if used + out > room or out > output_room:
            break
        n += 1
    return n


def balance(rest: int, capacity: int, overlap: int = 1) -> list[int]:
    """Sizes of the last batches: two of about half where a full one would leave a small one."""
    sizes, step = [], capacity - overlap
    while rest > capacity:
        if rest < 2 * step + overlap:
            half = -(-(rest + overlap) // 2)
            return [*sizes, half, rest - half + overlap]
        sizes.append(capacity)
        rest -= step
    return [*sizes, rest]


def batches(sizes: list[int], room: int, output_room: int, reserve: Callable[[list[int]], int], overlap: int = 1, alone: bool = False) -> list[tuple[int, int]]:
    """(first, count) of batches that cover all items in order; neighbours share `overlap` items, the last two are evened.

    An item that fits no batch is an error, or goes alone if `alone` is set: split_overflow() halves it when it is sent.
    """
    out, at = [], 0
    while at < len(sizes):
        n = fitting(sizes, at, room, output_room, reserve)
        if not n and not alone:
            raise ValueError(f"item {at} of {sizes[at]} tokens fits no batch")
        n = max(n, 1)
        rest = len(sizes) - at - n
        if 0 < rest < n:
            halves = balance(n + rest - overlap, n, overlap)
            if len(halves) == 2 and halves[0] < n:
                n = halves[0]
        out.append((at, n))
        if at + n >= len(sizes):
            break
        at = max(at + 1, at + n - (overlap if n > overlap else 0))
    return out


def packed(frame: DataFrame, room: int, output_room: int, overlap: int = 1) -> DataFrame:
    """(document_id, batch, id) for rows of document_id, idx, id and tokens: one document is one task's unit; an item too
    large for any batch is one of its own."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        sizes = part.tokens.tolist()
        rows = [(part.document_id.iloc[0], k, part.id.iloc[i]) for k, (first, n) in enumerate(batches(sizes, room, output_room, lambda s: sum(s) // 2, overlap, alone=True)) for i in range(first, first + n)]
        return pd.DataFrame(rows, columns=["document_id", "batch", "id"])

    return frame.select("document_id", "idx", "id", "tokens").groupBy("document_id").applyInPandas(work, "document_id bigint, batch int, id bigint")


def registry(entries: list[tuple[int, list[int]]], budget: int) -> tuple[list[int], int]:
    """Entries (id, tokens at each tier), most important first, that fit; and the tier reached, 0 being the fullest.

    The first entry that does not fit lowers the tier for all after it.
    """
    kept, used, tier = [], 0, 0
    for name, costs in entries:
        if used + costs[tier] > budget and tier < len(costs) - 1:
            tier += 1
        if used + costs[tier] <= budget:
            kept.append(name)
            used += costs[tier]
    return kept, tier


def registries(frame: DataFrame, budget: int) -> DataFrame:
    """(document_id, id, tier) for rows of document_id, id, mentions and costs (array): one document is one unit."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["mentions", "id"], ascending=[False, True])
        kept, tier = registry([(i, list(map(int, x))) for i, x in zip(part.id, part.costs, strict=True)], budget)
        return pd.DataFrame({"document_id": [part.document_id.iloc[0]] * len(kept), "id": kept, "tier": [tier] * len(kept)})

    return frame.select("document_id", "id", "mentions", "costs").groupBy("document_id").applyInPandas(work, "document_id bigint, id bigint, tier int")


def calibrate(history: list[tuple[float, float, bool]], multiplier: float = 1.0) -> list[float]:
    """The multiplier after each batch (estimated, actual, overflowed): half as much again, and 2 at least, after an
    overflow; 5 % less, down to 1, while the last twenty all stayed under 80 %."""
    out = []
    for k, (_, _, overflowed) in enumerate(history):
        last = history[max(0, k - 19) : k + 1]
        if overflowed:
            multiplier = max(multiplier * 1.5, 2.0)
        elif len(last) == 20 and all(not o and a < 0.8 * e for e, a, o in last):
            multiplier = max(multiplier * 0.95, 1.0)
        out.append(multiplier)
    return out


def calibrated(frame: DataFrame) -> DataFrame:
    """(model, id, multiplier) for rows of model, id, estimated, actual and overflowed, folded in order of id by model.

    Each batch turns the multiplier m into max(a * m, b); such steps compose to one of the same form. So the value after
    each batch is A * max(1, greatest b / A so far), A being the product of all a so far: running sums and greatest
    values of logarithms, which need no fold of one row after another.
    """
    order = Window.partitionBy("model").orderBy("id")
    last, so_far = order.rowsBetween(-19, 0), order.rowsBetween(Window.unboundedPreceding, 0)
    easy = ~F.col("overflowed") & (F.col("actual") < 0.8 * F.col("estimated"))
    calm = (F.count("*").over(last) == 20) & F.bool_and(easy).over(last)
    steps = frame.withColumn("_calm", calm).select(
        "model", "id", F.when(F.col("overflowed"), math.log(1.5)).when(F.col("_calm"), math.log(0.95)).otherwise(0.0).alias("_a"), F.when(F.col("overflowed"), math.log(2.0)).when(F.col("_calm"), 0.0).alias("_b")
    )
    summed = steps.withColumn("_s", F.sum("_a").over(so_far))
    return summed.select("model", "id", F.exp(F.col("_s") + F.greatest(F.lit(0.0), F.max(F.col("_b") - F.col("_s")).over(so_far))).alias("multiplier"))
