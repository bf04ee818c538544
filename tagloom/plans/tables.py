"""The driver's tables seen as catalogue, requests and logs; each view has its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_WORD = {"red": "warm spicy", "blue": "aquatic", "hot": "amber", "cold": "fresh", "old": "woody", "new": "citrus", "large": "leather", "small": "floral"}
SECOND_WORD = {"ring": "Rose", "widget": "Sicilian Bergamot", "bolt": "Sandalwood", "gear": "White Musk", "gizmo": "Vanilla", "anvil": "Oud", "plate": "Pink Pepper", "rod": "Cedar"}
TYPE_ACCORD = {"STANDARD": "green", "MEDIUM": "sweet", "PROMO": "fruity", "LARGE": "oud", "SMALL": "powdery", "ECONOMY": "marine"}
TYPE_KIND = {"STANDARD": "Eau de Parfum", "MEDIUM": "Eau de Toilette", "PROMO": "Body Spray", "LARGE": "Elixir", "SMALL": "Eau de Cologne"}
AUDIENCE = {1: "male", 2: "female", 3: "unisex"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lookup(table: dict, c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as items: item_id, brand, item, price, accords, notes, gender, kind, rating."""
    words = F.split("p_name", " ")
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("item"), F.col("p_retailprice").alias("price"),
        F.array(_lookup(FIRST_WORD, words[0]), _lookup(TYPE_ACCORD, F.col("p_type"))).alias("accords"),
        F.array(_lookup(SECOND_WORD, words[1]), F.concat(F.initcap(words[0]), F.lit(" Notes"))).alias("notes"),
        _lookup(AUDIENCE, F.col("p_size") % 4).alias("gender"), _lookup(TYPE_KIND, F.col("p_type")).alias("kind"), F.col("p_size").alias("size"),
    )


def sql_map(table: dict) -> str:
    lit = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in table.items()) + "}"


CATALOG_SQL = f"""catalog AS (SELECT p_partkey AS item_id, p_brand AS brand, p_name AS item, p_retailprice AS price,
 [{sql_map(FIRST_WORD)}[split_part(p_name, ' ', 1)], {sql_map(TYPE_ACCORD)}[p_type]] AS accords,
 [{sql_map(SECOND_WORD)}[split_part(p_name, ' ', 2)], upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] || ' Notes'] AS notes,
 {sql_map(AUDIENCE)}[p_size % 4] AS gender, {sql_map(TYPE_KIND)}[p_type] AS kind, p_size AS size FROM part)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as items(item_id, vec, label)."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"), "label")


def vector_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of the searches: every vector whose id is divisible by 100."""
    return vectors(spark, sf_dir).where("item_id % 100 = 0").select(F.col("item_id").alias("request_id"), "vec")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as requests: budget, gender, age, hours, projection, scenarios, families, text."""
    k = F.col("c_custkey")
    pick = lambda table, n: _lookup(dict(enumerate(table)), k % n)
    return read(spark, sf_dir, "customer").select(
        k.alias("request_id"), F.when(k % 3 > 0, 900 + k % 100).cast("double").alias("budget"), pick(["male", "female"], 3).alias("gender"),
        F.when(k % 2 == 0, 13 + k % 60).cast("int").alias("age"), F.when(k % 5 == 0, 4 + k % 9).cast("int").alias("hours"), pick(["light", "moderate", "strong"], 4).alias("projection"),
        F.split(pick(["gym", "office,date", "wedding", "summer"], 5), ",").alias("scenarios"), F.split(pick(["citrus", "woody,earthy", "floral"], 4), ",").alias("families"),
        (k % 7 == 0).alias("wants_longevity"), F.concat_ws(" ", F.lower("c_mktsegment"), F.lit("for"), "c_name").alias("text"), (k % 2).cast("int").alias("has_nation"),
    )


REQUESTS_SQL = f"""requests AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 3 > 0 THEN CAST(900 + c_custkey % 100 AS DOUBLE) END AS budget,
 {sql_map({0: 'male', 1: 'female'})}[c_custkey % 3] AS gender, CASE WHEN c_custkey % 2 = 0 THEN CAST(13 + c_custkey % 60 AS INT) END AS age,
 CASE WHEN c_custkey % 5 = 0 THEN CAST(4 + c_custkey % 9 AS INT) END AS hours, {sql_map({0: 'light', 1: 'moderate', 2: 'strong'})}[c_custkey % 4] AS projection,
 string_split({sql_map({0: 'gym', 1: 'office,date', 2: 'wedding', 3: 'summer'})}[c_custkey % 5], ',') AS scenarios,
 string_split({sql_map({0: 'citrus', 1: 'woody,earthy', 2: 'floral'})}[c_custkey % 4], ',') AS families, c_custkey % 7 = 0 AS wants_longevity FROM customer)"""


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as feedback: session, item, score, variant."""
    n = read(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    return read(spark, sf_dir, "events").join(F.broadcast(n)).select(
        "event_id", "ts", F.col("user_id").alias("session_id"), "event_type", (F.col("event_id") % F.col("n")).alias("item_id"), F.col("value").alias("score"),
        F.when(F.col("user_id") % 3 == 1, "v2").when(F.col("user_id") % 3 == 2, " ").alias("variant"),
    )


EVENTS_SQL = "feedback AS (SELECT event_id, ts, user_id AS session_id, event_type, event_id % (SELECT count(*) FROM part) AS item_id, value AS score, CASE user_id % 3 WHEN 1 THEN 'v2' WHEN 2 THEN ' ' END AS variant FROM events)"


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a request log: route, status, duration, whether the failure was unhandled, kind of key."""
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select(
        "ts", F.col("event_type").alias("route"), F.when(k < 10, 500).when(k < 20, 429).otherwise(200).alias("status"), (F.col("value") / 1000).alias("duration_s"),
        (k % 2 == 0).alias("unhandled"), F.when(F.col("user_id") % 2 == 0, "server").otherwise("public").alias("key_type"),
    )


LOG_SQL = """log AS (SELECT ts, event_type AS route, CASE WHEN k < 10 THEN 500 WHEN k < 20 THEN 429 ELSE 200 END AS status, value / 1000 AS duration_s, k % 2 = 0 AS unhandled,
 CASE WHEN user_id % 2 = 0 THEN 'server' ELSE 'public' END AS key_type FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""
