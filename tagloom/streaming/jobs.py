"""Structured Streaming forms of ingest, funnel, merge, embedding and profiles."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions.text import normal_key
from ..operators.feedback import embed, price_band, rates, stale
from ..operators.merge import KEEP_OLD_IF_NULL, merge
from ..plans.shared import is_written, remove, written

EVENT_TYPES = ("click", "purchase", "dismiss", "explanation_helpful", "explanation_unhelpful")


def ingest_events(events: DataFrame, good: str, bad: str, checkpoint: str, types: tuple[str, ...] = EVENT_TYPES, trigger: dict | None = None) -> StreamingQuery:
    """Events of a known type go to ``good``, all others to ``bad``; each batch is written once.

    A repeated batch overwrites its own folder, so restarts leave no doubles.
    """

    def write(batch: DataFrame, n: int) -> None:
        known = F.coalesce(F.col("event_type").isin(*types), F.lit(False))
        for path, part in ((good, batch.where(known)), (bad, batch.where(~known))):
            part.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_funnel(events: DataFrame, size: str = "1 day", late: str = "1 hour", impressions: tuple[str, ...] = ("click", "dismiss")) -> DataFrame:
    """Counts and rates of each variant in each time window."""
    variant = F.coalesce(F.when(F.trim("variant") != "", F.col("variant")), F.lit("control")).alias("variant")
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", size), variant).agg(
        F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type").isin(*impressions)).alias("impressions"), F.count_if(F.col("event_type") == "purchase").alias("purchases")
    )
    return rates(counts)


def _bucket(buckets: int, key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def create_catalog(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """A catalogue in buckets of its rows' key by brand and item, which later batches are merged into; normalized_key must be null or that key."""
    spark = rows.sparkSession
    placed = rows.withColumn("bucket", _bucket(buckets, normal_key(F.col("brand"), F.col("item"))))
    placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data")
    last = rows.agg(F.max("item_id")).first()[0] or 0
    spark.createDataFrame([(last, buckets)], "last_id long, buckets int").write.json(f"{path}/commits/batch=-1")


def read_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a catalogue in buckets, with ``bucket``."""
    return spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/data")


def merge_batch(batch: DataFrame, n: int, path: str, keep: list[str] = KEEP_OLD_IF_NULL, now: Column | None = None) -> None:
    """Merge a batch into a catalogue in buckets: only the buckets of its keys are read and written again.

    The merged buckets are staged first, then they replace the old ones, then the batch is marked as committed with the last id
    given out. A batch that is committed does nothing; one that was staged is put in place again; one that was not is merged anew from
    untouched buckets. So a repeated batch is harmless, wherever it broke off.
    """
    spark = batch.sparkSession
    if is_written(spark, f"{path}/commits/batch={n}"):
        return
    history = spark.read.schema("last_id long, buckets int").json(f"{path}/commits").agg(F.max("last_id").alias("last_id"), F.max("buckets").alias("buckets")).first()
    staged, types = f"{path}/staged/batch={n}", T.StructType([*spark.read.parquet(f"{path}/data").drop("bucket").schema, T.StructField("bucket", T.IntegerType())])
    if not is_written(spark, staged):
        rows = written(batch, "batch")
        own = _bucket(history["buckets"], normal_key(F.col("brand"), F.col("item")))
        touched = rows.select(F.explode(F.array(own, _bucket(history["buckets"], F.col("normalized_key")))).alias("b")).distinct().collect()
        stored = spark.read.schema(types).parquet(f"{path}/data").where(F.col("bucket").isin([r["b"] for r in touched])).drop("bucket")
        merged = merge(stored, rows, keep, now, history["last_id"])
        merged.withColumn("bucket", own).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(staged)
    new = spark.read.schema(types).parquet(staged)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/data")
    last = max(history["last_id"], new.agg(F.max("item_id")).first()[0] or 0)
    spark.createDataFrame([(last, history["buckets"])], "last_id long, buckets int").write.mode("overwrite").json(f"{path}/commits/batch={n}")
    remove(spark, staged)


def merge_stream(batches: DataFrame, path: str, checkpoint: str, keep: list[str] = KEEP_OLD_IF_NULL, trigger: dict | None = None) -> StreamingQuery:
    """Upsert each batch into the catalogue in buckets at ``path``."""
    return batches.writeStream.foreachBatch(lambda b, n: merge_batch(b, n, path, keep)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def embed_stream(changes: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, model=None, size: int = 384, trigger: dict | None = None) -> StreamingQuery:
    """Embed the rows of each batch whose vector is stale, and stamp them."""

    def run(batch: DataFrame, n: int) -> None:
        done = embed(stale(batch), "text", size, model=model)
        write(done.withColumns({"embedding": F.col("vec"), "last_embedded_at": F.current_timestamp()}).drop("vec"), n)

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class SessionProfiles(StatefulProcessor):
    """Keeps each session's newest clicks in map state and gives its whole profile whenever it gets new ones.

    A click leaves the state ``ttl_ms`` after it came; a timer of the same length drops what a silent session still holds.
    """

    FIELDS = "score double, price double, brand string, accords array<string>, gender string, known boolean"

    def __init__(self, keep: int, least: int, ttl_ms: int) -> None:
        self.keep, self.least, self.ttl_ms = keep, least, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clicks = handle.getMapState("clicks", "ts long, event_id long", self.FIELDS, self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for f in rows:
            for r in f.itertuples(index=False):
                none = lambda x: None if x is None or x is pd.NA or x != x else x
                accords = None if r.accords is None else list(r.accords)
                self.clicks.updateValue((int(r.ts.value // 1000), int(r.event_id)), (none(r.score), none(r.price), none(r.brand), accords, none(r.gender), bool(r.known)))
        held = sorted(((tuple(k), tuple(v)) for k, v in self.clicks.iterator()), reverse=True)
        for old, _ in held[self.keep :]:
            self.clicks.removeKey(old)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
        profile = self.profile(key[0], [v for _, v in held[: self.keep]])
        if profile is not None:
            yield profile

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clicks.clear()
        return iter([])

    def profile(self, session: int, clicks: list[tuple]) -> pd.DataFrame | None:
        known = [(n, c) for n, c in enumerate(clicks) if c[5]]
        if len(known) < self.least:
            return None

        def top(values: list[tuple[int, str]], many: int) -> list[str]:
            count, first = Counter(v for _, v in values), {}
            for n, v in values:
                first.setdefault(v, n)
            return sorted(count, key=lambda v: (-count[v], first[v], v))[:many]

        prices = [c[1] for _, c in known if c[1] is not None]
        gender = top([(n, c[4]) for n, c in known if c[4] is not None], 1)
        return pd.DataFrame({
            "session_id": [session], "n_clicks": [len(known)], "mean_score": [sum(c[0] or 0.0 for _, c in known) / len(known)], "mean_price": [sum(prices) / len(prices) if prices else None],
            "top_brands": [top([(n, c[2]) for n, c in known if c[2] is not None], 3)], "top_accords": [top([(n, a) for n, c in known for a in c[3] or [] if a is not None], 3)], "gender": [gender[0] if gender else None],
        })

    def close(self) -> None:
        pass


def session_stream(clicks: DataFrame, keep: int = 50, least: int = 3, ttl_ms: int = 30 * 86_400_000) -> DataFrame:
    """Each session's profile over its newest clicks, as ``feedback.session_profiles`` has it, whenever it gets new ones.

    clicks(session_id long, event_id long, ts timestamp, score double, price double, brand string, accords array<string>, gender string, known boolean);
    clicks on items that are not ``known`` take a place among the newest but do not count. The state is in RocksDB, as map state, timers and expiry need.
    Processing time asks for one batch after another, also without data: a run that is to end sets spark.sql.streaming.noDataMicroBatches.enabled to false.
    """
    clicks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = clicks.groupBy("session_id").transformWithStateInPandas(
        SessionProfiles(keep, least, ttl_ms), "session_id long, n_clicks long, mean_score double, mean_price double, top_brands array<string>, top_accords array<string>, gender string", "update", "processingTime",
    )
    return out.withColumn("price_band", price_band(F.col("mean_price")))
