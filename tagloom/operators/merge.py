"""Source-priority dedup and catalogue merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strings

KEEP_OLD_IF_NULL = ["gender", "embedding", "price", "image_url", "url", "country", "perfumer", "model_version"]


def _blank_to_null(df: DataFrame, c: str) -> Column:
    return F.when(F.trim(c) != "", F.col(c)) if dict(df.dtypes)[c] == "string" else F.col(c)


def priority_fold(rows: DataFrame, key: str, fill: list[str] = (), union: list[str] = ()) -> DataFrame:
    """One row a key, as if its rows came one by one in load_order.

    A row replaces the kept one only if its source_priority is strictly higher; others are
    dropped whole. An empty scalar of a row that replaces takes the value kept so far, and lists
    are joined without repeats. A list of a key with one kept row is left as it is.
    Null priorities count as zero; ties of load_order go by the row's other columns' hash.
    """
    columns, tie = rows.columns, F.xxhash64(*rows.columns)
    # of a key's rows of one priority only the earliest can replace another: partial aggregates leave a row for each key and priority
    first = rows.groupBy(F.col(key).alias("_key"), F.coalesce("source_priority", F.lit(0)).alias("_priority")).agg(F.min_by(F.struct(*columns), F.struct("load_order", tie)).alias("_row"))
    rows = first.select("_row.*")
    by = Window.partitionBy(key).orderBy("load_order", tie)
    before = F.max(F.coalesce("source_priority", F.lit(0))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    ladder = rows.withColumn("_before", before).where(F.col("_before").isNull() | (F.coalesce("source_priority", F.lit(0)) > F.col("_before"))).drop("_before")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    filled = ladder.withColumns({c: F.last(_blank_to_null(ladder, c), ignorenulls=True).over(so_far) for c in fill})
    count = F.count("*").over(so_far)
    joined = filled.withColumns({
        c: F.when(count == 1, F.col(c)).otherwise(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, strings())).over(so_far)))) for c in union
    })
    last = Window.partitionBy(key).orderBy(F.desc("load_order"), F.desc(tie))
    return joined.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def in_batch(batch: DataFrame, target: str, stored_priority: str, keep: list[str]) -> DataFrame:
    """One row for each target, as if the batch's rows came one by one in load_order.

    A row counts unless its priority is lower than the stored one or than that of a row before it. Of the rows that
    count the last one gives each value, for ``keep`` columns the last one that is not null; a target that is not stored
    has brand and item of its first row. Null priorities count as zero; ties of load_order go by the row's hash.
    """
    order = F.struct("load_order", F.xxhash64(*batch.columns))
    priority = F.coalesce("source_priority", F.lit(0))
    before = F.max(priority).over(Window.partitionBy(target).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    marked = batch.withColumns({"_order": order, "_floor": F.greatest(F.col(stored_priority), before)})
    counting = marked.where(F.col("_floor").isNull() | (priority >= F.col("_floor")))
    of = lambda c: F.min_by(c, "_order") if c in ("brand", "item") else F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))) if c in keep else F.max_by(c, "_order")
    return counting.groupBy(target).agg(*[of(c).alias(c) for c in batch.columns if c != target])


def resolve(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """batch with target_id: by exact brand and item, else by a normalised key that only one stored row has.

    ``ambiguous`` marks rows whose key several stored rows share; they count as new.
    """
    exact = stored.select("brand", "item", F.col("item_id").alias("_exact"))
    keys = stored.where("normalized_key is not null").groupBy("normalized_key").agg(F.count("*").alias("_n"), F.min("item_id").alias("_by_key"))
    out = batch.join(exact, ["brand", "item"], "left").join(keys, "normalized_key", "left")
    unique = F.when(F.col("_n") == 1, F.col("_by_key"))
    ambiguous = F.coalesce(F.col("_exact").isNull() & (F.col("_n") > 1), F.lit(False))
    return out.withColumns({"target_id": F.coalesce("_exact", unique), "ambiguous": ambiguous}).drop("_exact", "_n", "_by_key")


def merged_value(new: Column, old: Column, policy: str) -> Column:
    return F.coalesce(new, old) if policy == "keep" else new


def merge(stored: DataFrame, batch: DataFrame, keep: list[str] = KEEP_OLD_IF_NULL, now: Column | None = None, last_id: int | None = None) -> DataFrame:
    """stored after an upsert of batch; both have the same columns but item_id, which batch lacks.

    Rows are resolved, and applied as if one by one in load_order: a priority lower than the present one is skipped, and
    a later row finds an earlier new one by its key. For updates ``keep`` columns stay where the new value is null, all others take the new value;
    brand and item never change; an empty list is written as null. New rows get ids after ``last_id``, or the largest stored one.
    ``updated_at``, where it exists, moves only if another column changed.
    """
    now = F.current_timestamp() if now is None else now
    columns = [c for c in stored.columns if c != "item_id"]
    arrays = {c for c, t in batch.dtypes if t.startswith("array<string")}
    ready = resolve(batch, stored)
    ready = ready.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in arrays}) if arrays else ready
    # new rows meet by their key, unless several stored rows have it: then, and without a key, by brand and item
    key = F.when(~F.col("ambiguous"), F.concat(F.lit("k"), F.col("normalized_key")))
    target = F.coalesce(F.concat(F.lit("i"), F.col("target_id").cast("string")), key, F.concat_ws("\u0001", F.lit("n"), "brand", "item"))
    held = stored.select(F.col("item_id").alias("target_id"), F.coalesce("source_priority", F.lit(0)).alias("_stored"))
    ready = ready.withColumn("_target", target).join(held, "target_id", "left")
    ready = in_batch(ready, "_target", "_stored", keep).drop("_target", "_stored", "ambiguous")
    hit = ready.where("target_id is not null").select("target_id", *[F.col(c).alias(f"_new_{c}") for c in columns if c in batch.columns])
    joined = stored.join(hit, stored["item_id"] == hit["target_id"], "left")
    wins = F.col("target_id").isNotNull()
    policy = lambda c: "keep" if c in keep else "new"
    value = {c: F.when(wins, merged_value(F.col(f"_new_{c}"), F.col(c), policy(c))).otherwise(F.col(c)) for c in columns if c in batch.columns and c not in ("brand", "item", "updated_at")}
    changed = wins & F.lit(False)
    for c, v in value.items():
        changed = changed | ~v.eqNullSafe(F.col(c))
    if "updated_at" in columns:
        value["updated_at"] = F.when(changed, now).otherwise(F.col("updated_at"))
    updated = joined.select("item_id", *[value.get(c, F.col(c)).alias(c) for c in columns])
    fresh = ready.where("target_id is null").drop("target_id")
    base = stored.agg(F.coalesce(F.max("item_id") if last_id is None else F.lit(last_id), F.lit(0)).cast("long").alias("_base"))
    stamped = fresh.withColumn("updated_at", now) if "updated_at" in columns else fresh
    numbered = numbered_after(stamped, base)
    return updated.unionByName(numbered.select("item_id", *columns), allowMissingColumns=True)


def numbered_after(fresh: DataFrame, base: DataFrame) -> DataFrame:
    """Dense ids after ``base(_base)``, in order of the rows' key: counted by part, as many as shuffle partitions."""
    parts = int(fresh.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = fresh.withColumn("_part", F.pmod(F.xxhash64("brand", "item"), F.lit(parts)))
    sizes = keyed.groupBy("_part").agg(F.count("*").alias("_size"))
    offset = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    n = F.row_number().over(Window.partitionBy("_part").orderBy("brand", "item"))
    return keyed.withColumn("_n", n).join(F.broadcast(offset), "_part").crossJoin(F.broadcast(base)).withColumn("item_id", F.col("_base") + F.col("_offset") + F.col("_n")).drop("_part", "_n", "_offset", "_base")


def resolved_tiers(notes: Column, top: Column, heart: Column, base: Column, inferred: Column) -> Column:
    """Source tiers stay; notes that none of them holds join the tier that ``inferred`` gives them."""
    held = lambda c: F.coalesce(c, strings())
    tagged = F.transform(F.concat(held(top), held(heart), held(base)), F.lower)
    free = F.filter(held(notes), lambda n: ~F.array_contains(tagged, F.lower(n)))
    add = lambda mine, t: F.array_union(held(mine), F.array_intersect(free, held(inferred[t])))
    return F.struct(add(top, "top").alias("top"), add(heart, "heart").alias("heart"), add(base, "base").alias("base"))
