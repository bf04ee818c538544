"""Queries that take the tables through files, streams and output rows and back; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intent as I
from ..functions import text as P
from ..operators import feedback as K
from ..operators import merge as D
from ..operators import retrieve as R
from ..sources import catalog as S
from ..streaming import jobs as L
from .event_queries import PROFILE_SQL
from .shared import intermediate_folder
from .tables import CATALOG_SQL, EVENTS_SQL, LOG_SQL, REQUESTS_SQL, catalog, read, request_log, requests, session_events


def _csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "utf-8") -> str:
    if encoding != "utf-8":
        df.sparkSession.conf.set("spark.sql.legacy.javaCharsets", "true")
    df.write.options(header=True, sep=sep, escape='"', encoding=encoding, lineSep="\r\n" if encoding != "utf-8" else "\n").csv(path)
    return path


def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, divided over the six source formats by its key, written as files and read back as canonical records.

    Some cells are blank, unknown or no numbers; some names are missing, and these rows go.
    """
    folder, c = intermediate_folder(spark), F.col
    words = F.split("p_name", " ")
    literal = lambda *xs: F.concat(F.lit("['"), F.concat_ws("', '", *xs), F.lit("']"))
    t = read(spark, sf_dir, "part").withColumns({
        "kind": c("p_partkey") % 6, "brand": F.when(c("p_size") != 7, c("p_brand")), "a": words[0], "b": words[1], "audience": F.when(c("p_size") % 2 == 0, "for women").otherwise("for men"),
        "score": F.concat(c("p_size") % 5, F.lit(",5")), "votes": F.when(c("p_size") % 3 > 0, F.concat(F.lit("1,"), F.lpad(c("p_size").cast("string"), 3, "0"))).otherwise("many"),
    })
    part = lambda k, *columns: t.where(c("kind") == k).select(*columns)
    name = F.concat_ws(" ", "p_name", F.regexp_replace("p_brand", "#", ""), "audience").alias("Name")
    tiers = [c("a").alias("Top"), F.lit("Unknown").alias("Middle"), F.concat_ws(", ", "b", "a").alias("Base")]
    # code page 850: bytes above 127, doubled quotes, line feeds and separators in quotes, and a row that says what the header says
    odd = F.when(c("p_size") % 4 == 0, F.concat(F.lit('É "'), "p_name", F.lit('"; ß'))).when(c("p_size") % 4 == 1, F.concat("p_name", F.lit("\nñ, x"))).when(c("p_size") % 4 == 2, F.lit("Perfume")).otherwise(c("p_name"))
    wide = [F.when(c("p_size") % 5 >= i, c("b")).alias(f"mainaccord{i}") for i in range(1, 6)]
    rated = [c("score").alias("Rating Value"), c("votes").alias("Rating Count")]
    nested = [literal("a").alias("notes.top_notes"), F.lit("[]").alias("notes.middle_notes"), literal("b").alias("notes.base_notes")]
    prices = F.concat(F.lit("[{'mrp': '"), c("p_size") + 500, F.lit("', 'discount_price': '"), F.when(c("p_size") % 2 == 0, (c("p_size") + 100).cast("string")).otherwise(""), F.lit("'}]"))
    found = [
        S.quoted_list_source(spark, _csv(part(0, "brand", c("p_name").alias("perfume"), (c("p_size") + 1970).alias("launch_year"), literal("a", "b").alias("notes"), literal("b").alias("main_accords")), f"{folder}/0")),
        S.packed_name_source(spark, _csv(part(1, name, c("audience").alias("Gender"), literal("a").alias("Main Accords"), c("p_type").alias("Description"), *rated), f"{folder}/1")),
        S.tiered_source(spark, _csv(part(2, F.when(c("p_size") % 4 == 2, "Brand").otherwise(c("brand")).alias("Brand"), odd.alias("Perfume"), (c("p_size") + 1970).alias("Year"), c("audience").alias("Gender"), *tiers, *wide, *rated, c("a").alias("Perfumer1"), F.lit("unknown").alias("Perfumer2"), F.lit("X").alias("Country"), F.lit("u").alias("url")), f"{folder}/2", ";", "cp850")),
        S.image_link_source(spark, _csv(part(3, c("brand").alias("Brand"), odd.alias("Name"), F.concat_ws(", ", "a", F.lit("none"), "b").alias("Notes"), c("p_type").alias("Description"), F.lit("i").alias("Image URL")), f"{folder}/3", ",", "cp850")),
        S.supplement_source(spark, _csv(part(4, "brand", c("p_name").alias("perfume"), F.lit("unknown").alias("gender"), c("a").alias("notes"), c("b").alias("accords"), F.when(c("p_size") % 2 == 0, c("p_size").cast("string")).otherwise("n/a").alias("price_inr")), f"{folder}/4")),
        S.nested_header_source(spark, _csv(part(5, "brand", F.concat_ws(" ", F.lit("Unisex"), "p_name", F.lit("Perfume - 100ml")).alias("name"), F.lit("").alias("gender"), *nested, literal("b").alias("accords"), prices.alias("prices")), f"{folder}/5")),
    ]
    out = S.all_sources(found)
    listed = lambda *columns: [F.array_join(x, ",").alias(x) for x in columns]
    return out.select("source", "source_priority", "brand", "item", "gender", "launch_year", "rating", "rating_count", "price", "perfumer", *listed("accords", "notes", "notes_top", "notes_base"))


SOURCE_SQL = """WITH t AS (SELECT *, p_partkey % 6 AS kind, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b,
 CASE p_size % 4 WHEN 0 THEN 'É "' || p_name || '"; ß' WHEN 1 THEN p_name || chr(10) || 'ñ, x' WHEN 2 THEN 'Perfume' ELSE p_name END AS odd FROM part)
SELECT ['da_fragrance', 'fra_perfumes', 'fra_cleaned', 'nandini', 'indian_brands', 'india_mainstream'][kind + 1] AS source, CAST([1, 2, 3, 4, 0, 5][kind + 1] AS INT) AS source_priority,
 CASE WHEN kind = 1 THEN replace(p_brand, '#', '') WHEN kind = 2 AND p_size % 4 = 2 THEN 'Brand' ELSE p_brand END AS brand, CASE WHEN kind IN (2, 3) THEN odd ELSE p_name END AS item, CASE WHEN kind IN (1, 2) THEN CASE WHEN p_size % 2 = 0 THEN 'female' ELSE 'male' END END AS gender,
 CASE WHEN kind IN (0, 2) THEN CAST(p_size + 1970 AS VARCHAR) END AS launch_year, CASE WHEN kind IN (1, 2) THEN p_size % 5 + 0.5::DOUBLE END AS rating, CASE WHEN kind IN (1, 2) AND p_size % 3 > 0 THEN CAST(1000 + p_size AS INT) END AS rating_count,
 CASE WHEN kind = 4 AND p_size % 2 = 0 THEN CAST(p_size AS INT) WHEN kind = 5 THEN CAST(p_size + CASE WHEN p_size % 2 = 0 THEN 100 ELSE 500 END AS INT) END AS price, CASE WHEN kind = 2 THEN a END AS perfumer,
 CASE kind WHEN 1 THEN a WHEN 2 THEN array_to_string(list_transform(range(p_size % 5), lambda i: b), ',') WHEN 3 THEN '' ELSE b END AS accords,
 CASE kind WHEN 1 THEN '' WHEN 2 THEN CASE WHEN a = b THEN a ELSE a || ',' || b END WHEN 4 THEN a WHEN 5 THEN CASE WHEN a = b THEN a ELSE a || ',' || b END ELSE a || ',' || b END AS notes,
 CASE WHEN kind IN (2, 5) THEN a ELSE '' END AS notes_top, CASE kind WHEN 2 THEN b || ',' || a WHEN 5 THEN b ELSE '' END AS notes_base
FROM t WHERE kind = 1 OR p_size <> 7"""


def stored_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue written and read back, and one item looked up in it."""
    path = f"{intermediate_folder(spark)}/stored"
    S.write_catalog(catalog(spark, sf_dir).withColumn("type", F.when(F.col("size") > 25, F.col("kind"))), path)
    one = S.lookup(spark.read.parquet(path), 7)
    return one.select("item_id", "brand", "item", F.array_join("notes", ",").alias("notes"), F.coalesce("type", F.lit("none")).alias("type"), "currency")


LOOKUP_SQL = f"WITH {CATALOG_SQL} SELECT item_id, brand, item, array_to_string(list_filter(notes, lambda x: x IS NOT NULL), ',') AS notes, coalesce(CASE WHEN size > 25 THEN kind END, 'none') AS type, 'INR' AS currency FROM catalog WHERE item_id = 7"


def rating_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of existing items appended as events by day, read back and counted."""
    path = f"{intermediate_folder(spark)}/stored"
    given = session_events(spark, sf_dir).select("ts", (F.col("event_id") % 900).alias("item_id"), (F.col("event_id") % 4 - 1).alias("rating"))
    S.append_events(S.rating_events(given, catalog(spark, sf_dir)), path)
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("n_items"))


RATING_LOG_SQL = """WITH g AS (SELECT ts, event_id % 900 AS item_id, event_id % 4 - 1 AS rating FROM events)
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE rating WHEN 1 THEN 'explanation_helpful' ELSE 'explanation_unhelpful' END AS event_type, count(*) AS n, count(DISTINCT item_id) AS n_items
FROM g WHERE rating IN (0, 1) AND item_id IN (SELECT p_partkey FROM part) GROUP BY ALL"""


def metrics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log's counts written as exposition text and read back."""
    path = f"{intermediate_folder(spark)}/stored"
    counts = request_log(spark, sf_dir).groupBy("route", "status").agg(F.count("*").alias("n"))
    line = F.concat(F.lit('requests_total{route="'), "route", F.lit('",status="'), F.col("status").cast("string"), F.lit('"} '), F.col("n").cast("string"))
    counts.select(F.explode(F.array(F.lit("# TYPE requests_total counter"), F.lit(" "), line)).alias("value")).write.text(path)
    found = S.read_metrics(spark, path)
    return found.select("metric", F.col("labels")["route"].alias("route"), F.col("labels")["status"].alias("status"), "value")


METRICS_SQL = f"WITH {LOG_SQL} SELECT 'requests_total' AS metric, route, CAST(status AS VARCHAR) AS status, CAST(count(*) AS DOUBLE) AS value FROM log GROUP BY route, status"


def output_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding and search texts, money, and items as they are shown."""
    c = catalog(spark, sf_dir).withColumns({
        "notes": F.when(F.col("size") % 4 > 0, F.concat("notes", F.array(F.lit("{'broken': 1}")))), "price": F.when(F.col("size") % 3 > 0, F.floor("price") * 7).otherwise(0),
        "item": F.concat_ws(" ", "item", F.when(F.col("size") % 2 == 0, "edp")), "type": F.when(F.col("size") > 25, F.col("kind")), "description": F.repeat("item", F.lit(30)),
    })
    shown = P.present(c.withColumn("raw", F.col("notes")))
    return shown.select(
        "item_id", P.embedding_text(F.col("brand"), F.col("item"), F.col("accords"), F.col("raw"), F.col("description")).alias("embedding_text"),
        P.search_document(F.col("brand"), F.col("item"), F.col("accords"), F.col("raw")).alias("search_document"), P.money(F.col("price")).alias("money"), "price", "type",
        F.array_join("notes", ",").alias("notes"), F.size("accords").alias("n_accords"),
    )


_text = lambda a, n, sep: f"array_to_string(list_filter({a}, lambda x: x IS NOT NULL)[1:{n}], '{sep}')"
OUTPUT_SQL = f"""WITH {CATALOG_SQL}, t AS (SELECT item_id, brand, accords, size, concat_ws(' ', item, CASE WHEN size % 2 = 0 THEN 'edp' END) AS item, repeat(item, 30) AS description, CASE WHEN size > 25 THEN kind END AS type,
 CASE WHEN size % 4 > 0 THEN list_append(notes, '{{''broken'': 1}}') END AS raw, CASE WHEN size % 3 > 0 THEN CAST(floor(price) AS BIGINT) * 7 ELSE 0 END AS cost FROM catalog)
SELECT item_id, concat_ws('. ', brand, item, nullif({_text('accords', 8, ' ')}, ''), nullif({_text('raw', 10, ' ')}, ''), description[1:300]) AS embedding_text,
 concat_ws(' ', brand, item, {_text('accords', 99, ' ')}, {_text('raw', 99, ' ')}) AS search_document, '₹' || format('{{:,}}', nullif(cost, 0)) AS money, nullif(cost, 0) AS price,
 coalesce(type, CASE WHEN size % 2 = 0 THEN 'Eau de Parfum' END) AS type, coalesce({_text('raw[1:2]', 2, ',')}, '') AS notes, CAST(len(accords) AS INT) AS n_accords FROM t"""


def event_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long before the end of its hour, day or month each event was, in words, counted."""
    at = F.col("ts").cast("timestamp")
    end = F.when(F.col("event_id") % 3 == 0, F.date_trunc("hour", at) + F.expr("INTERVAL 1 HOUR")).when(F.col("event_id") % 3 == 1, F.date_trunc("day", at) + F.expr("INTERVAL 1 DAY")).otherwise(F.date_trunc("month", at) + F.expr("INTERVAL 1 MONTH"))
    return read(spark, sf_dir, "events").groupBy(P.since(at, end).alias("age")).agg(F.count("*").alias("n"))


AGES_SQL = """WITH t AS (SELECT floor(epoch(date_trunc(u, ts) + CASE u WHEN 'hour' THEN INTERVAL 1 HOUR WHEN 'day' THEN INTERVAL 1 DAY ELSE INTERVAL 1 MONTH END)) - floor(epoch(ts)) AS s
 FROM (SELECT CAST(ts AS TIMESTAMP) AS ts, ['hour', 'day', 'month'][event_id % 3 + 1] AS u FROM events))
SELECT CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ago' WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ago' ELSE CAST(floor(s / 86400) AS BIGINT) || 'd ago' END AS age, count(*) AS n FROM t GROUP BY 1"""


def image_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a picture of which no vector is stored."""
    held = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("image_embedding"))
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("img/"), "doc_id")).alias("image_url"))
    return K.missing_image_vectors(d.join(held, "doc_id", "left")).select("doc_id", "image_url")


BACKLOG_SQL = "SELECT doc_id, 'img/' || doc_id AS image_url FROM documents WHERE n_chars % 2 = 0 AND doc_id NOT IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL)"


def merged_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios stated, found in the text and given by a model, without repeats."""
    r = requests(spark, sf_dir)
    text = F.concat_ws(" ", "text", F.when(F.col("request_id") % 2 == 0, "on a hot day").otherwise("in the snow"))
    model = F.when(F.col("request_id") % 3 == 0, P.strings("wedding", "winter"))
    return r.select("request_id", F.array_join(I.merged_scenarios(F.col("scenarios"), I.keyword_scenarios(text), model), ",").alias("scenarios"))


_words = lambda ws: "(" + " OR ".join(f"contains(t, '{w}')" for w in ws) + ")"
_distinct = lambda a: f"list_filter({a}, lambda x, i: list_position({a}, x) = i)"
MERGED_SQL = f"""WITH {REQUESTS_SQL}, p AS (SELECT r.*, ' ' || lower(lower(c_mktsegment) || ' for ' || c_name || CASE WHEN request_id % 2 = 0 THEN ' on a hot day' ELSE ' in the snow' END) || ' ' AS t FROM requests r JOIN customer ON c_custkey = request_id),
a AS (SELECT request_id, list_concat(coalesce(scenarios, []), list_filter([{', '.join(f"CASE WHEN {_words(ws)} THEN '{s}' END" for s, ws in I.SCENARIO_KEYWORDS.items())}], lambda x: x IS NOT NULL), CASE WHEN request_id % 3 = 0 THEN ['wedding', 'winter'] ELSE [] END) AS l FROM p)
SELECT request_id, array_to_string({_distinct('l')}, ',') AS scenarios FROM a"""


def note_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of the source, completed by inferred ones: only notes that no tier holds join."""
    c = catalog(spark, sf_dir).withColumns({"a": F.coalesce(F.try_element_at("notes", F.lit(1)), F.lit("Moss")), "b": F.try_element_at("notes", F.lit(2))}).withColumn("notes", F.array("a", "b"))
    k = F.col("size") % 3
    inferred = F.struct(F.array("a").alias("top"), F.array("b").alias("heart"), P.strings("Moss", "Tar").alias("base"))
    out = D.resolved_tiers(F.col("notes"), F.when(k == 0, F.array(F.upper("a"))), F.when(k == 1, F.array("b")), F.when(k == 2, F.array("a")), inferred)
    return c.select("item_id", *[F.array_join(out[t], ",").alias(t) for t in ("top", "heart", "base")])


TIERS_SQL = f"""WITH {CATALOG_SQL}, t AS (SELECT item_id, size % 3 AS k, coalesce(notes[1], 'Moss') AS a, notes[2] AS b FROM catalog)
SELECT item_id, CASE k WHEN 0 THEN upper(a) WHEN 1 THEN a ELSE '' END AS top, b AS heart, CASE WHEN k = 2 THEN a WHEN k = 1 AND a = 'Moss' THEN 'Moss' ELSE '' END AS base FROM t"""


def session_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's profile as a sentence."""
    return K.session_profiles(session_events(spark, sf_dir), catalog(spark, sf_dir)).select("session_id", K.profile_text().alias("sentence"))


def brand_houses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all brands under one item name are of one house."""
    c = catalog(spark, sf_dir).withColumn("house", F.lower(F.when(F.col("size") % 2 == 0, F.substring("brand", 1, 7)).otherwise(F.col("brand"))))
    by = c.groupBy("item", (F.col("item_id") % 25).alias("part")).agg(F.collect_set("house").alias("houses"))
    return by.select("item", "part", R.same_house(F.col("houses")).alias("one_house"), F.size("houses").alias("n"))


HOUSE_SQL = f"""WITH {CATALOG_SQL}, t AS (SELECT item, item_id % 25 AS part, list(DISTINCT lower(CASE WHEN size % 2 = 0 THEN brand[1:7] ELSE brand END)) AS h FROM catalog GROUP BY ALL),
s AS (SELECT *, list_sort(list_transform(h, lambda x: {{'n': len(x), 'x': x}}))[1].x AS core FROM t)
SELECT item, part, len(h) <= 1 OR (len(core) >= 4 AND len(list_filter(h, lambda x: NOT contains(x, core))) = 0) AS one_house, CAST(len(h) AS INT) AS n FROM s"""


def _stream(spark: SparkSession, df: DataFrame, folder: str) -> DataFrame:
    df.repartition(4).write.parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")


def ingested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of several batches: known types to one table, others to another; both counted."""
    folder = intermediate_folder(spark)
    source = session_events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 11 > 0, F.col("event_type")).alias("event_type"))
    L.ingest_events(_stream(spark, source, folder), f"{folder}/good", f"{folder}/bad", f"{folder}/state").awaitTermination()
    part = lambda name: spark.read.schema(source.schema).option("recursiveFileLookup", True).parquet(f"{folder}/{name}").withColumn("target", F.lit(name))
    return part("good").unionByName(part("bad")).groupBy("target", F.coalesce("event_type", F.lit("none")).alias("event_type")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


_known = ", ".join(f"'{x}'" for x in L.EVENT_TYPES)
INGEST_SQL = f"""WITH t AS (SELECT event_id, CASE WHEN event_id % 11 > 0 THEN event_type END AS e FROM events)
SELECT CASE WHEN e IN ({_known}) THEN 'good' ELSE 'bad' END AS target, coalesce(e, 'none') AS event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM t GROUP BY ALL"""


def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's whole profile from a stream of clicks; the last row of each session after several batches."""
    folder = intermediate_folder(spark)
    items = catalog(spark, sf_dir).select("item_id", F.col("price").cast("double").alias("price"), "brand", "accords", "gender", F.lit(True).alias("known"))
    clicks = session_events(spark, sf_dir).where("event_type = 'click'").join(items, "item_id", "left")
    clicks = clicks.select("session_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("score").cast("double").alias("score"), "price", "brand", "accords", "gender", F.coalesce("known", F.lit(False)).alias("known"))
    out = L.session_stream(_stream(spark, clicks, folder))
    write = lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/n={n}")
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle)
    spark.conf.set(idle, "false")  # or processing time would ask for batches without end
    try:
        out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(idle, before)
    names = [c for c in out.columns if c != "session_id"]
    every = spark.read.schema(f"{', '.join(f'{c} {t}' for c, t in out.dtypes)}, batch int").option("recursiveFileLookup", True).parquet(f"{folder}/out")
    last = every.groupBy("session_id").agg(F.max_by(F.struct(*names), "batch").alias("x")).select("session_id", "x.*")
    listed = lambda c: F.array_join(c, ",")
    return last.select(
        "session_id", "n_clicks", F.round(F.col("mean_score") * F.col("n_clicks"), 2).alias("sum_score"), F.round(F.col("mean_price") * F.col("n_clicks"), 1).alias("sum_price"), "price_band",
        listed("top_brands").alias("brands"), listed("top_accords").alias("accords"), F.coalesce("gender", F.lit("none")).alias("gender"),
    )


STREAM_SQL = f"SELECT * EXCLUDE (has_text) FROM ({PROFILE_SQL})"


def incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of supplier rows, several to a target, merged as a stream into a catalogue in buckets."""
    folder, k = intermediate_folder(spark), F.col("s_suppkey")
    s = read(spark, sf_dir, "supplier").withColumns({"brand": F.col("s_nationkey").cast("string"), "price": F.col("s_acctbal").cast("int")})
    key = P.normal_key(F.col("brand"), F.col("item"))
    stored = s.where(k % 3 != 0).select(k.alias("item_id"), "brand", F.col("s_name").alias("item"), "price", F.lit("old").alias("country"), (k % 4).cast("int").alias("source_priority"))
    L.create_catalog(stored.withColumn("normalized_key", key), f"{folder}/catalog")
    rows = s.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("batch", F.floor(F.col("n") / 2)).where((k + F.col("n")) % 4 > 0)
    rows = rows.select(
        "brand", F.when((k + F.col("n")) % 5 == 0, F.lower("s_name")).otherwise(F.col("s_name")).alias("item"), F.when((k + F.col("n")) % 3 > 0, F.col("price") + F.col("n")).cast("int").alias("price"),
        F.when((k + F.col("n")) % 7 > 0, F.concat(F.lit("c"), F.col("n"))).alias("country"), ((k * 3 + F.col("n") * 2) % 5).cast("int").alias("source_priority"), (F.col("n").cast("long") * 1_000_000_000 + k).alias("load_order"), "batch",
    ).withColumn("normalized_key", key)
    for batch in range(3):
        # a folder for each batch, so that the stream takes them one after another
        rows.where(F.col("batch") == batch).drop("batch").coalesce(1).write.parquet(f"{folder}/in/{batch}")
        stream = spark.readStream.schema(rows.drop("batch").schema).parquet(f"{folder}/in/[0-{batch}]")
        L.merge_stream(stream, f"{folder}/catalog", f"{folder}/state").awaitTermination()
    found = L.read_catalog(spark, f"{folder}/catalog", "item_id long, brand string, item string, price int, country string, source_priority int")
    last = stored.agg(F.max("item_id").alias("last"))
    return found.join(F.broadcast(last)).select(F.when(F.col("item_id") > F.col("last"), -1).otherwise(F.col("item_id")).alias("item_id"), "brand", "item", "price", F.coalesce("country", F.lit("none")).alias("country"), "source_priority")


INCREMENTAL_SQL = """WITH s AS (SELECT s_suppkey AS k, CAST(s_nationkey AS VARCHAR) AS brand, s_name, CAST(trunc(s_acctbal) AS INT) AS price FROM supplier),
r AS (SELECT k, -1 AS n, s_name AS item, price, 'old' AS country, k % 4 AS p FROM s WHERE k % 3 <> 0
 UNION ALL SELECT k, n, CASE WHEN (k + n) % 5 = 0 THEN lower(s_name) ELSE s_name END, CASE WHEN (k + n) % 3 > 0 THEN price + n END, CASE WHEN (k + n) % 7 > 0 THEN 'c' || n END, (k * 3 + n * 2) % 5 FROM s, range(6) AS t(n) WHERE (k + n) % 4 > 0),
f AS (SELECT *, max(p) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS floor FROM r), c AS (SELECT * FROM f WHERE floor IS NULL OR p >= floor)
SELECT CASE WHEN k % 3 <> 0 THEN k ELSE -1 END AS item_id, any_value(brand) AS brand, arg_min(item, n) AS item, CAST(arg_max(c.price, n) FILTER (c.price IS NOT NULL) AS INT) AS price, coalesce(arg_max(country, n) FILTER (country IS NOT NULL), 'none') AS country,
 CAST(arg_max(p, n) AS INT) AS source_priority FROM c JOIN s USING (k) GROUP BY k"""


def incremental_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of parts as a stream of several batches: rows whose vector is stale are embedded and stamped; the vectors' entries."""
    folder, k = intermediate_folder(spark), F.col("p_partkey")
    at = lambda day: F.to_timestamp(F.lit(f"2024-01-0{day}"))
    changes = read(spark, sf_dir, "part").select(
        k.alias("item_id"), F.concat_ws(" ", "p_name", F.lower("p_brand"), "p_name").alias("text"), F.when(k % 3 > 0, F.array(F.lit(1.0).cast("float"))).alias("embedding"),
        F.when(k % 3 > 0, F.when(k % 4 > 0, at(2)).otherwise(at(4))).alias("last_embedded_at"), at(3).alias("updated_at"),
    )
    write = lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/n={n}")
    L.embed_stream(_stream(spark, changes, folder), write, f"{folder}/state", size=64).awaitTermination()
    done = spark.read.schema("item_id long, embedding array<float>, last_embedded_at timestamp").option("recursiveFileLookup", True).parquet(f"{folder}/out")
    entries = done.where(F.col("last_embedded_at") > at(5)).select("item_id", F.posexplode("embedding").alias("place", "value"))
    return entries.where("value <> 0").select("item_id", "place", F.round(F.col("value").cast("double"), 5).alias("value"))


_entries = lambda words, size: f"""h AS (SELECT id, ('0x' || md5(w)[1:8])::BIGINT % {size} AS place, CASE WHEN ('0x' || md5(w)[9])::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS sign FROM ({words})),
e AS (SELECT id, CAST(place AS INT) AS place, sum(sign) AS n FROM h GROUP BY ALL)"""  # noqa: E731
INCREMENTAL_EMBED_SQL = f"""WITH {_entries("SELECT p_partkey AS id, unnest(string_split(lower(p_name || ' ' || p_brand || ' ' || p_name), ' ')) AS w FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 4 > 0", 64)}
SELECT id AS item_id, place, round(CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE), 5) AS value FROM e QUALIFY n <> 0"""


# the profile's SQL gives lists joined by a bare comma and the word none for no audience
SENTENCE_SQL = f"""SELECT session_id, concat_ws('; ', 'likes ' || replace(accords, ',', ', '), 'from ' || replace(brands, ',', ', '), 'buys ' || price_band, 'for ' || nullif(gender, 'none')) AS sentence FROM ({PROFILE_SQL})"""


QUERIES = {
    "source_records": (source_records, SOURCE_SQL), "stored_lookup": (stored_lookup, LOOKUP_SQL), "rating_log": (rating_log, RATING_LOG_SQL), "metrics_text": (metrics_text, METRICS_SQL),
    "output_rows": (output_rows, OUTPUT_SQL), "event_ages": (event_ages, AGES_SQL), "image_backlog": (image_backlog, BACKLOG_SQL), "merged_scenarios": (merged_scenarios, MERGED_SQL),
    "note_tiers": (note_tiers, TIERS_SQL), "session_sentences": (session_sentences, SENTENCE_SQL), "brand_houses": (brand_houses, HOUSE_SQL), "ingested_events": (ingested_events, INGEST_SQL),
    "session_stream": (session_stream, STREAM_SQL), "incremental_merge": (incremental_merge, INCREMENTAL_SQL), "incremental_embedding": (incremental_embedding, INCREMENTAL_EMBED_SQL),
}
