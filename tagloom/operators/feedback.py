"""Sessions, experiment funnels, weight sweeps and refresh scans over event tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import strings


def recent_clicks(events: DataFrame, keep: int = 50, kind: str = "click") -> DataFrame:
    """The newest ``keep`` clicks of each session, with ``n`` from the newest."""
    order = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.where(F.col("event_type") == kind).withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)


def price_band(mean: Column) -> Column:
    return F.when(mean < 1000, "budget").when(mean <= 3000, "mid").when(mean > 3000, "luxury")


def favourites(clicks: DataFrame, value: Column, name: str, top: int = 3) -> DataFrame:
    """(session_id, name): the most frequent values, of equals the one seen first."""
    counts = clicks.select("session_id", "n", value.alias("_v")).where("_v is not null").groupBy("session_id", "_v").agg(F.count("*").alias("_c"), F.min("n").alias("_p"))
    order = Window.partitionBy("session_id").orderBy(F.desc("_c"), "_p", "_v")
    best = counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top)
    return best.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_v"))), lambda x: x["_v"]).alias(name))


def session_profiles(events: DataFrame, items: DataFrame, least: int = 3, keep: int = 50) -> DataFrame:
    """Profile of each session with at least ``least`` clicks: mean score (no score counts as zero), price band, favourites."""
    clicks = recent_clicks(events, keep).join(items.select("item_id", "brand", "accords", "price", "gender"), "item_id")
    base = clicks.groupBy("session_id").agg(
        F.count("*").alias("n_clicks"), F.avg(F.coalesce("score", F.lit(0.0))).alias("mean_score"), F.avg("price").alias("mean_price")
    ).where(F.col("n_clicks") >= least)
    brands = favourites(clicks, F.col("brand"), "top_brands")
    accords = favourites(clicks, F.explode_outer("accords"), "top_accords")
    genders = favourites(clicks, F.col("gender"), "_g", 1).select("session_id", F.try_element_at("_g", F.lit(1)).alias("gender"))
    out = base
    for part in (brands, accords, genders):
        out = out.join(part, "session_id", "left")
    return out.withColumn("price_band", price_band(F.col("mean_price")))


def profile_text() -> Column:
    """A profile as a sentence; reads the columns of ``session_profiles``."""
    part = lambda label, c: F.when(F.size(F.coalesce(c, strings())) > 0, F.concat(F.lit(label), F.array_join(c, ", ")))
    return F.concat_ws("; ", part("likes ", F.col("top_accords")), part("from ", F.col("top_brands")), F.concat(F.lit("buys "), "price_band"), F.concat(F.lit("for "), "gender"))


def funnel(events: DataFrame, now: Column | None = None, days: int = 30, impressions: tuple[str, ...] = ("click", "dismiss")) -> DataFrame:
    """Clicks, impressions, purchases and rates of each variant over the last days; blank variants are the control."""
    now = F.current_timestamp() if now is None else now
    kept = events.where(F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS"))
    variant = F.coalesce(F.when(F.trim("variant") != "", F.col("variant")), F.lit("control"))
    counts = kept.groupBy(variant.alias("variant")).agg(
        F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type").isin(*impressions)).alias("impressions"),
        F.count_if(F.col("event_type") == "purchase").alias("purchases"),
    )
    return rates(counts)


def rates(counts: DataFrame) -> DataFrame:
    """ctr, purchase_rate and composite; zero without impressions."""
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("impressions")), F.lit(0.0))
    return counts.withColumns({"ctr": share("clicks"), "purchase_rate": share("purchases")}).withColumn("composite", F.col("ctr") + 2 * F.col("purchase_rate"))


def weight_grid(spark, n: int, low: float = 0.02, high: float = 0.40, seed: int = 5) -> DataFrame:
    """n weight vectors that sum to one, repeatable by their seed: digits of MD5 between the bounds, then divided by their sum."""
    names = list(vocab.WEIGHTS)
    draw = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "id", F.lit(k)).cast("binary")), 1, 8), 16, 10).cast("double") / 2**32
    raw = spark.range(n).select(F.col("id").alias("vector_id"), *[(low + (high - low) * draw(k)).alias(k) for k in names])
    total = sum((F.col(k) for k in names[1:]), F.col(names[0]))
    return raw.select("vector_id", *[(F.col(k) / total).alias(k) for k in names])


#: Weight vectors that are evaluated at a time.
WEIGHT_BLOCK = 2048


def evaluate_weights(scored: DataFrame, weights: DataFrame, least: int = 5, low: float = 0.02, high: float = 0.40) -> DataFrame:
    """(vector_id, objective) of each weight vector, over scored(request_id, item_id, clicks, impressions, fit_..).

    The score is computed anew for each vector; clicks are discounted by the rank that it gives, equal scores, to twelve digits, by item_id. Vectors outside the
    bounds pay for it. A request's candidates meet in a task as a sorted stream; their fits times a block of weights is one matrix
    product, and a task hands on one sum a vector. Weights pass through the driver, ``WEIGHT_BLOCK`` at a time.
    """
    names = [k for k in vocab.WEIGHTS if f"fit_{k}" in scored.columns]
    spark, n = scored.sparkSession, weights.count()
    kept = scored.where(F.col("impressions") >= least).select("request_id", F.col("item_id").cast("long").alias("item_id"), *[F.col(c).cast("double").alias(c) for c in ("clicks", "impressions")], F.array(*[F.coalesce(F.col(f"fit_{k}").cast("double"), F.lit(0.0)) for k in names]).alias("fits"))
    kept = kept.repartition("request_id").sortWithinPartitions("request_id", "item_id")
    out = None
    for p in range(max(1, -(-n // WEIGHT_BLOCK))):
        block = weights.where(F.pmod(F.xxhash64("vector_id"), F.lit(max(1, -(-n // WEIGHT_BLOCK)))) == p).select(F.col("vector_id").cast("long").alias("vector_id"), *names).toPandas()
        sent = spark.sparkContext.broadcast((block["vector_id"].to_numpy(), block[names].to_numpy(float)))

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, w = sent.value
            gain, shown, held = np.zeros(len(ids)), 0.0, []

            def close() -> None:
                """Add a whole request: its rows are held in item order."""
                nonlocal gain
                clicks, fits = (np.concatenate([h[i] for h in held]) for i in (0, 1))
                scores = np.round(fits @ w.T, 12)
                rank = np.argsort(np.argsort(-scores, axis=0, kind="stable"), axis=0, kind="stable") + 1
                gain += (clicks[:, None] / np.log2(rank + 1)).sum(axis=0)
                held.clear()

            now = None
            for batch in batches:
                request = batch.column("request_id").to_pylist()
                clicks, seen = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("clicks", "impressions"))
                fits = batch.column("fits").flatten().to_numpy(zero_copy_only=False).reshape(len(request), -1)
                shown += seen.sum()
                cuts = [0, *[i for i in range(1, len(request)) if request[i] != request[i - 1]], len(request)]
                for lo, hi in zip(cuts, cuts[1:]):
                    if held and request[lo] != now:
                        close()
                    now = request[lo]
                    held.append((clicks[lo:hi], fits[lo:hi]))
            if held:
                close()
            yield pa.RecordBatch.from_pydict({"vector_id": pa.array(ids, pa.int64()), "gain": gain, "shown": np.full(len(ids), float(shown))})

        part = kept.mapInArrow(run, "vector_id long, gain double, shown double")
        out = part if out is None else out.unionByName(part)
    gains = out.groupBy("vector_id").agg(F.try_divide(F.sum("gain"), F.sum("shown")).alias("_gain"))
    fine = sum((F.when(~F.col(k).between(low, high), 0.01 * F.abs(F.col(k) - 0.2)).otherwise(0.0) for k in names[1:]), F.when(~F.col(names[0]).between(low, high), 0.01 * F.abs(F.col(names[0]) - 0.2)).otherwise(0.0))
    return gains.join(weights.withColumn("_fine", fine).select("vector_id", "_fine"), "vector_id").select("vector_id", (F.col("_gain") - F.col("_fine")).alias("objective"))


def variant_weights(variant: Column) -> Column:
    """Weights of a variant: those after ``v2_`` if they can be read, else the default."""
    default = F.create_map(*[F.lit(x) for kv in vocab.WEIGHTS.items() for x in kv])
    own = F.from_json(F.substring(variant, F.lit(4), F.length(variant)), "map<string,double>", {"mode": "PERMISSIVE"})
    return F.when(variant.startswith("v2_") & (F.size(own) > 0), own).otherwise(default)


def bucket(flag: str, request: Column) -> Column:
    """0 to 99 from the first eight digits of md5(flag:request)."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{flag}:"), request.cast("string"))), 1, 8), 16, 10).cast("long") % 100).cast("int")


def enabled(flag: str, request: Column, rollout: int, on: bool = True) -> Column:
    return F.lit(on) & (bucket(flag, request) < rollout)


def active_variant(flags: dict[str, int], request: Column) -> Column:
    """The first flag in order that the request falls into, or the control."""
    return F.coalesce(*[F.when(enabled(f, request, r), F.lit(f)) for f, r in flags.items()], F.lit("control"))


def ratings(events: DataFrame, helpful: str = "explanation_helpful", unhelpful: str = "explanation_unhelpful") -> DataFrame:
    return events.groupBy("item_id").agg(F.count_if(F.col("event_type") == helpful).alias("helpful"), F.count_if(F.col("event_type") == unhelpful).alias("unhelpful")).where("helpful + unhelpful > 0")


def stale(df: DataFrame, model: str | None = None) -> DataFrame:
    """Rows to embed again: no vector, never stamped, stamped before the last change, or by another model."""
    old = F.col("embedding").isNull() | F.col("last_embedded_at").isNull() | (F.col("last_embedded_at") < F.col("updated_at"))
    return df.where(old | ~F.col("model_version").eqNullSafe(F.lit(model))) if model else df.where(old)


def missing_image_vectors(df: DataFrame) -> DataFrame:
    return df.where(F.col("image_url").isNotNull() & F.col("image_embedding").isNull())


def signed_places(text: Column, size: int) -> Column:
    """For each word its place among ``size``, counted from 1, with the sign that its hash gives: digits 1 to 8 and digit 9 of its MD5."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def place(word: Column) -> Column:
        digits = F.md5(word.cast("binary"))
        at = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long") % size + 1
        return F.when(F.conv(F.substring(digits, 9, 1), 16, 10).cast("int") % 2 == 0, at).otherwise(-at).cast("int")

    return F.transform(words, place)


def hashed_vector(places: Column, size: int) -> Column:
    """The unit vector of summed signs; of no words, or of words that cancel out, the zero vector."""

    @F.pandas_udf("array<float>")
    def run(batches: pd.Series) -> pd.Series:
        def one(held: np.ndarray | None) -> np.ndarray:
            at = np.asarray(held if held is not None else [], dtype=int)
            v = np.bincount(np.abs(at) - 1, weights=np.sign(at), minlength=size) if len(at) else np.zeros(size)
            return v / max(np.sqrt((v * v).sum()), 1e-300)

        return batches.map(one)

    return run(places)


def embed(df: DataFrame, text: str = "text", size: int = 384, query: bool = False, model=None) -> DataFrame:
    """df with ``vec``. ``model``, called once for each batch, maps a list of texts to vectors; the default hashes words with signs.

    Queries get an instruction before the text; a null text is empty.
    """
    prompt = F.concat(F.lit("query: "), F.coalesce(text, F.lit(""))) if query else F.coalesce(text, F.lit(""))
    if model is None:
        return df.withColumn("vec", hashed_vector(signed_places(prompt, size), size))

    @F.pandas_udf("array<float>")
    def run(batches: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in model(batches.tolist())])

    return df.withColumn("vec", run(prompt))
