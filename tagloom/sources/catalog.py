"""Catalogue files, event sinks and metrics text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as P

#: The canonical record: what every source is brought to.
RECORD = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("brand", "item", "name", "launch_year", "gender")],
    *[T.StructField(n, T.ArrayType(T.StringType())) for n in ("accords", "notes", "notes_top", "notes_middle", "notes_base")],
    *[T.StructField(n, T.StringType()) for n in ("description", "image_url")],
    T.StructField("rating", T.DoubleType()), T.StructField("rating_count", T.IntegerType()), T.StructField("price", T.IntegerType()),
    *[T.StructField(n, T.StringType()) for n in ("url", "country", "perfumer", "source")],
    T.StructField("source_priority", T.IntegerType()), T.StructField("load_order", T.LongType()),
])


def record(df: DataFrame, source: str, priority: int, columns: dict[str, Column]) -> DataFrame:
    """df as canonical records; brand and item must be there."""
    own = columns | {"source": F.lit(source), "source_priority": F.lit(priority), "load_order": F.monotonically_increasing_id()}
    empty = lambda f: P.strings() if isinstance(f.dataType, T.ArrayType) else F.lit(None)
    out = df.select(*[own.get(f.name, empty(f)).cast(f.dataType).alias(f.name) for f in RECORD])
    return out.where((F.trim("brand") != "") & (F.trim("item") != ""))


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """A CSV file with a header, all columns as text: quotes may hold separators, line feeds and doubled quotes.

    Code pages beyond Spark's own list need its setting for all of Java's charsets, which stays on in the session.
    """
    if encoding.lower() not in ("utf-8", "iso-8859-1", "us-ascii", "utf-16"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return spark.read.options(header=True, sep=sep, encoding=encoding, multiLine=True, escape='"').csv(path)


def quoted_list_source(spark: SparkSession, path: str, source: str = "da_fragrance", priority: int = 1) -> DataFrame:
    """Notes and accords as list literals; the audience is read from brand and item."""
    d = read_csv(spark, path)
    return record(d, source, priority, {
        "brand": F.trim("brand"), "item": F.trim("perfume"), "name": F.concat_ws(" ", "brand", "perfume"), "launch_year": F.col("launch_year"),
        "notes": P.parse_list(F.col("notes")), "accords": P.parse_list(F.col("main_accords")), "gender": P.gender(F.concat_ws(" ", "brand", "perfume")),
    })


def packed_name_source(spark: SparkSession, path: str, source: str = "fra_perfumes", priority: int = 2) -> DataFrame:
    """One name cell with item, brand and audience."""
    d = read_csv(spark, path).where(F.trim("Name") != "")
    return record(d, source, priority, {
        "brand": P.packed_brand(F.col("Name")), "item": P.packed_item(F.col("Name")), "name": F.col("Name"), "gender": P.gender(F.col("Gender")),
        "accords": P.parse_list(F.col("Main Accords")), "description": F.col("Description"), "rating": P.decimal_text(F.col("Rating Value")), "rating_count": P.count_text(F.col("Rating Count")),
    })


def tiered_source(spark: SparkSession, path: str, source: str = "fra_cleaned", priority: int = 3) -> DataFrame:
    """Semicolons, code page 850, tiers as comma lists, accords in five columns."""
    d = read_csv(spark, path, ";", "cp850")
    tiers = {t: P.parse_tier(F.col(c)) for t, c in (("notes_top", "Top"), ("notes_middle", "Middle"), ("notes_base", "Base"))}
    return record(d, source, priority, tiers | {
        "brand": F.trim("Brand"), "item": F.trim("Perfume"), "launch_year": F.col("Year"), "gender": P.gender(F.col("Gender")), "notes": F.array_distinct(F.concat(*tiers.values())),
        "accords": P.wide_to_array(*[F.col(f"mainaccord{i}") for i in range(1, 6)]), "rating": P.decimal_text(F.col("Rating Value")), "rating_count": P.count_text(F.col("Rating Count")),
        "perfumer": P.joined_pair(F.col("Perfumer1"), F.col("Perfumer2")), "country": F.col("Country"), "url": F.col("url"),
    })


def image_link_source(spark: SparkSession, path: str, source: str = "nandini", priority: int = 4) -> DataFrame:
    """Commas, code page 850, with image links."""
    d = read_csv(spark, path, ",", "cp850")
    return record(d, source, priority, {
        "brand": F.trim("Brand"), "item": F.trim("Name"), "notes": P.parse_tier(F.col("Notes")), "description": F.col("Description"), "image_url": F.col("Image URL"),
    })


def supplement_source(spark: SparkSession, path: str, source: str = "indian_brands", priority: int = 0) -> DataFrame:
    """A small curated file with real prices; no file, no rows."""
    from pyspark.errors import AnalysisException

    try:
        d = read_csv(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RECORD)
    return record(d, source, priority, {
        "brand": F.trim("brand"), "item": F.trim("perfume"), "gender": P.gender(F.col("gender")), "notes": P.parse_tier(F.col("notes")), "accords": P.parse_tier(F.col("accords")),
        "price": F.when(F.trim("price_inr").rlike("^[0-9]+$"), F.trim("price_inr")).try_cast("int"),
    })


def nested_header_source(spark: SparkSession, path: str, source: str = "india_mainstream", priority: int = 5) -> DataFrame:
    """Headers with dots, prices as a list of dicts, titles with marketing words."""
    d = read_csv(spark, path)
    tiers = {t: P.parse_list(F.col(f"`notes.{c}`")) for t, c in (("notes_top", "top_notes"), ("notes_middle", "middle_notes"), ("notes_base", "base_notes"))}
    return record(d, source, priority, tiers | {
        "brand": F.trim("brand"), "item": P.product_title(F.trim("name"), F.trim("brand")), "name": F.col("name"), "gender": P.gender(F.col("gender")),
        "notes": F.array_distinct(F.concat(*tiers.values())), "accords": P.parse_list(F.col("accords")), "price": P.listing_price(F.col("prices")),
    })


def all_sources(parts: list[DataFrame]) -> DataFrame:
    """The sources one after another: load_order rises through them in this order."""
    out = None
    for i, p in enumerate(parts):
        part = p.withColumn("load_order", F.col("load_order") + (i << 52))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def capped(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy("load_order").limit(n)


def lookup(df: DataFrame, item_id: int) -> DataFrame:
    """One item with cleaned notes and type."""
    found = df.where(F.col("item_id") == item_id)
    return found.withColumns({"notes": P.clean_notes(F.col("notes")), "type": F.coalesce("type", P.concentration(F.col("item"))), "currency": F.lit("INR")})


def append_events(events: DataFrame, path: str) -> None:
    """Append events, by day."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def rating_events(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """ratings(item_id, rating, ..) of 0 or 1 on existing items, as events."""
    known = ratings.where(F.col("rating").isin(0, 1)).join(items.select("item_id"), "item_id", "left_semi")
    return known.withColumn("event_type", F.when(F.col("rating") == 1, "explanation_helpful").otherwise("explanation_unhelpful")).drop("rating")


def write_catalog(df: DataFrame, path: str, buckets: int = 16) -> None:
    """The merged catalogue, range-partitioned and sorted by item_id so that files can be skipped."""
    df.repartitionByRange(buckets, "item_id").sortWithinPartitions("item_id").write.mode("errorifexists").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(metric, labels, value) of each line of an exposition text; comments are left out."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    pattern = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{([^}]*)\})?\s+([^\s]+)"
    pairs = F.regexp_extract_all(F.regexp_extract("value", pattern, 2), F.lit(r'([A-Za-z_]+="[^"]*")'), F.lit(1))
    labels = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.split(x, "=", 2)[0].alias("k"), F.trim(F.split(x, "=", 2)[1], F.lit('"')).alias("v"))))
    return lines.select(F.regexp_extract("value", pattern, 1).alias("metric"), labels.alias("labels"), F.regexp_extract("value", pattern, 3).try_cast("double").alias("value"))
