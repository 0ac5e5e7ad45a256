"""Usage as a stream: incremental rollups, quota windows and replay."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narrata.operators.lineage import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder where executors and driver both read and write."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """The events table as a stream of files; ts becomes a TIMESTAMP, which watermarks ask for."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    found = spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    return found.select(*columns) if columns else found


def incremental_rollup(stream: DataFrame, keys: list[str], sums: dict[str, str], path: str) -> DataFrame:
    """Totals by key after all that the stream has now.

    Every micro-batch writes its own sums under its batch id and overwrites them if it is tried again, so a batch
    counts once; the totals are the sums over batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(v).alias(k) for k, v in sums.items()]).write.mode("overwrite").parquet(f"{path}/totals/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/totals").groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in sums])


def windowed_counts(stream: DataFrame, width: str, late: str, path: str) -> DataFrame:
    """Counts by type and window of event time, for windows that the watermark has closed."""
    counted = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    flat = counted.select(F.col("w.start").alias("start"), "event_type", "n")
    flat.writeStream.outputMode("append").format("parquet").option("path", f"{path}/windows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(flat.schema).parquet(f"{path}/windows")


def daily_quota(events: DataFrame, limit: int, user: str = "user_id", at: str = "ts", key: str = "id") -> DataFrame:
    """Each request with its number in its user's calendar day, and whether it is over the limit."""
    window = Window.partitionBy(user, F.to_date(at)).orderBy(at, key)
    return events.withColumn("nth", F.row_number().over(window)).withColumn("rejected", F.col("nth") > limit)


def fixed_window_limit(events: DataFrame, width_seconds: int, limit: int, user: str = "user_id", at: str = "ts") -> DataFrame:
    """Requests and rejections by user and fixed window, named by the window's number since the epoch."""
    number = F.floor(F.unix_timestamp(F.col(at).cast("timestamp")) / width_seconds).alias("window")
    return events.groupBy(user, number).agg(F.count("*").alias("n")).withColumn("rejected", F.greatest(F.col("n") - limit, F.lit(0)))


def replay(log: DataFrame, after: int, channels: DataFrame, now: str, ttl_seconds: int) -> DataFrame:
    """Log entries after an id, of channels subscribed to, younger than their time to live."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return log.where(F.col("id") > after).where(age < ttl_seconds).join(channels, "channel", "left_semi")


def buffered(log: DataFrame, most: int = 1000, keep: int = 500) -> DataFrame:
    """What a capped log still holds of each type: all up to the cap; past it the last `keep` at the last cut, and what came since."""
    counted = log.withColumn("n", F.count("*").over(Window.partitionBy("type"))).withColumn("back", F.row_number().over(Window.partitionBy("type").orderBy(F.col("id").desc())))
    held = F.when(F.col("n") <= most, F.col("n")).otherwise(keep + F.pmod(F.col("n") - most - 1, F.lit(most - keep + 1)))
    return counted.where(F.col("back") <= held).drop("n", "back")


def recover(jobs: DataFrame, now: str, started: int = 600, progress: int = 300) -> DataFrame:
    """Stale processing jobs (seconds since start and progress): requeued while retries are left, else failed."""
    age = lambda c: F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col(c).cast("timestamp"))
    stale = (F.col("status") == "processing") & (age("started_at") > started) & (F.col("progress_at").isNull() | (age("progress_at") > progress))
    again = F.col("retries") < F.col("max_retries")
    return jobs.withColumns(
        {"status": F.when(stale & again, "queued").when(stale, "failed").otherwise(F.col("status")), "retries": F.when(stale & again, F.col("retries") + 1).otherwise(F.col("retries"))}
    )


def deduct(requests: DataFrame, quota: DataFrame, user: str = "user_id") -> DataFrame:
    """Requests (user, id, cost) in order against each user's quota, accepted while the running cost fits.

    Costs are not negative, so those accepted in order are the prefix that fits; later ones wait for the next period.
    """
    running = F.sum("cost").over(Window.partitionBy(user).orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return requests.join(quota, user).withColumn("used", running).withColumn("accepted", F.col("used") <= F.col("quota"))


def deduct_optimistic(requests: DataFrame, quota: DataFrame, risky: float = 0.8, user: str = "user_id") -> DataFrame:
    """Requests (user, id, cost) in order of id: (user, id, mode, accepted, consumed).

    While a user's consumption is under `risky` of the quota a request is optimistic: it is deducted if it fits at that
    moment. From then on requests are strict: reserved first, so that consumption and what is held may not pass the
    quota. A request that is refused consumes nothing, and later smaller ones may fit. Each depends on those before it,
    so a user's requests of the period are one task's unit.
    """

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        limit, used, out = float(part["quota"].iloc[0]), 0.0, []
        for cost in part["cost"].astype(float):
            mode = "strict" if limit <= 0 or used / limit >= risky else "optimistic"
            fits = used + cost <= limit
            used += cost if fits else 0.0
            out.append((mode, fits, used))
        return part[[user, "id"]].assign(mode=[x[0] for x in out], accepted=[x[1] for x in out], consumed=[x[2] for x in out])

    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    return requests.join(quota, user).select(user, "id", "cost", "quota").groupBy(user).applyInPandas(fold, f"{user} {kinds[user]}, id {kinds['id']}, mode string, accepted boolean, consumed double")


def consumer_state(log: DataFrame, groups: DataFrame, acked: DataFrame) -> DataFrame:
    """(grp, channel, produced, delivered, pending, oldest, lag) of each consumer group and channel of a stream.

    log: id, channel; groups: grp, channel, last (the id delivered last); acked: grp, id. Delivered entries that were
    not acknowledged are pending, the oldest of them by id; entries after the last one delivered are the lag.
    """
    each = groups.join(log.select("id", "channel"), "channel").join(acked.select("grp", "id", F.lit(True).alias("_a")).distinct(), ["grp", "id"], "left")
    sent = F.col("id") <= F.col("last")
    open_ = sent & F.col("_a").isNull()
    n = lambda x: F.count(F.when(x, 1))
    return each.groupBy("grp", "channel").agg(F.count("*").alias("produced"), n(sent).alias("delivered"), n(open_).alias("pending"), F.min(F.when(open_, F.col("id"))).alias("oldest"), n(~sent).alias("lag"))


def resume(checkpoints: DataFrame, documents: DataFrame, stages: int, format_version: int = 2) -> DataFrame:
    """(document_id, stage, run): which of stages 1 to `stages` are still to run.

    checkpoints: document_id, format, document_version, last_stage (null: none completed). One counts only for the
    document's current version. In format 1 a later removed stage 4 stood between: its stages from 4 on are one less
    now. Other formats are unknown and count for nothing.
    """
    last = F.when(F.col("format") == format_version, F.col("last_stage")).when(F.col("format") == 1, F.col("last_stage") - (F.col("last_stage") >= 4).cast("int"))
    known = checkpoints.select("document_id", F.col("document_version").alias("_v"), last.alias("_last"))
    state = documents.select(F.col("id").alias("document_id"), "version").join(known, "document_id", "left")
    done = F.when(F.col("_v") == F.col("version"), F.coalesce("_last", F.lit(0))).otherwise(0)
    return state.select("document_id", F.explode(F.sequence(F.lit(1), F.lit(stages))).alias("stage"), done.alias("_done")).select("document_id", "stage", (F.col("stage") > F.col("_done")).alias("run"))


def synced_activities(activities: DataFrame, jobs: DataFrame, terminal: list[str]) -> DataFrame:
    """(id, status) of open activities whose job ended, with its status, or is gone, as failed."""
    both = activities.where(~F.col("status").isin(terminal)).join(jobs.select(F.col("id").alias("job_id"), F.col("status").alias("_now")), "job_id", "left")
    return both.where(F.col("_now").isNull() | F.col("_now").isin(terminal)).select("id", F.coalesce("_now", F.lit("failed")).alias("status"))
