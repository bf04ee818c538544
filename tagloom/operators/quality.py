"""Data quality: issue lists, splits, audits and backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_notes, concentration, normal_key


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def issues(brand: Column, item: Column, price: Column, rating: Column, rating_count: Column, accords: Column, notes: Column) -> Column:
    """What is wrong with a catalogue row; an empty array if nothing is."""
    hollow = lambda a: F.coalesce(F.exists(a, _blank), F.lit(False))
    return F.array_compact(F.array(
        F.when(_blank(brand), "brand is blank"), F.when(_blank(item), "item is blank"), F.when(price <= 0, "price is not positive"),
        F.when(~rating.between(0, 5), "rating is outside 0-5"), F.when(rating_count < 0, "rating count is negative"),
        F.when(hollow(accords), "blank accord"), F.when(hollow(notes), "blank note"),
    ))


def request_issues(text: Column, limit: Column, age: Column, hours: Column, budget: Column, projection: Column, least_budget: float = 0.0) -> Column:
    """The same for a search request."""
    return F.array_compact(F.array(
        F.when(~F.length(F.coalesce(text, F.lit(""))).between(1, 500), "text length"), F.when(~limit.between(1, 60), "limit"), F.when(~age.between(13, 100), "age"),
        F.when(~hours.between(1, 24), "hours"), F.when(budget < least_budget, "budget"), F.when(~projection.isin("light", "moderate", "strong"), "projection"),
    ))


def split_valid(df: DataFrame, column: str = "issues") -> tuple[DataFrame, DataFrame]:
    """(rows without issues, rows for quarantine)."""
    return df.where(F.size(column) == 0).drop(column), df.where(F.size(column) > 0)


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows have each column: not null, and not empty if text or an array."""
    kinds = dict(df.dtypes)

    def full(c: str) -> Column:
        if kinds[c].startswith("array"):
            return F.coalesce(F.size(c) > 0, F.lit(False))
        return ~_blank(F.col(c)) if kinds[c] == "string" else F.col(c).isNotNull()

    return df.agg(F.count("*").alias("total"), *[F.count_if(full(c)).alias(f"with_{c}") for c in columns])


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def audit(items: DataFrame, events: DataFrame, types: list[str]) -> DataFrame:
    """(rule, violations): not null, unique, event domain, event without an item."""
    rule = lambda name, df: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
    orphan = events.join(items.select(F.col("item_id")), "item_id", "left_anti")
    return (
        rule("item not null", items.where("brand is null or item is null"))
        .unionByName(rule("item unique", duplicate_keys(items, "brand", "item")))
        .unionByName(rule("event type", events.where(~F.col("event_type").isin(types))))
        .unionByName(rule("event item", orphan))
    )


def key_collisions(df: DataFrame, brand: str = "brand", item: str = "item") -> DataFrame:
    """Normalised keys that several stored names share."""
    return df.groupBy(normal_key(F.col(brand), F.col(item)).alias("normalized_key")).agg(F.count("*").alias("n_rows"), F.count_distinct(item).alias("n_names")).where("n_rows > 1")


def has_limited_data(notes: Column) -> Column:
    return F.size(clean_notes(notes)) == 0


def backfilled(df: DataFrame) -> DataFrame:
    """Rows from before these columns were kept: source, priority, type and key are filled."""
    return df.withColumns({
        "source": F.coalesce("source", F.lit("legacy_seed")), "source_priority": F.coalesce("source_priority", F.lit(0)),
        "type": F.coalesce("type", concentration(F.col("item"))), "normalized_key": F.coalesce("normalized_key", normal_key(F.col("brand"), F.col("item"))),
    })
