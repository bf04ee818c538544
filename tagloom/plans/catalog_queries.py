"""Queries over the catalogue view: text, quality, merge, enrichment, scoring and ranking; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as P
from ..operators import enrich as X
from ..operators import merge as D
from ..operators import quality as Q
from ..operators import rank as W
from ..operators import score as S
from .shared import written
from .tables import CATALOG_SQL, REQUESTS_SQL, catalog, read, requests, sql_map


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_NORMAL = "trim(regexp_replace(regexp_replace(lower(trim(coalesce({0}, ''))), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_LONG, _SHORT = "CASE WHEN len({0}) <= len({1}) THEN {1} ELSE {0} END", "CASE WHEN len({0}) <= len({1}) THEN {0} ELSE {1} END"
_EQUIV = f"({{0}} = {{1}} OR CASE WHEN contains({_LONG}, {_SHORT}) THEN regexp_matches({_LONG}, '\\b' || regexp_escape({_SHORT}) || '\\b') ELSE false END)"
_low = lambda a: f"list_transform({a}, lambda z: lower(z))"


def text_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, match texts, concentrations and their fallback."""
    c = catalog(spark, sf_dir)
    name = F.concat_ws(" ", "brand", F.initcap("item"), F.lower("kind"))
    return c.select("item_id", P.normal_key(F.col("brand"), name).alias("key"), P.match_text(name).alias("match"), F.coalesce(P.concentration(name), F.lit("none")).alias("parsed"), F.coalesce("kind", P.concentration(F.col("item")), F.lit("none")).alias("final"), P.short_title(name).alias("title"))


TEXT_SQL = f"""WITH {CATALOG_SQL}, t AS (SELECT *, concat_ws(' ', brand, array_to_string(list_transform(string_split(item, ' '), lambda w: upper(w[1]) || w[2:]), ' '), lower(kind)) AS name FROM catalog)
SELECT item_id, {_NORMAL.format('brand')} || '|' || {_NORMAL.format('name')} AS key, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS match,
 CASE WHEN contains(lower(name), 'eau de toilette') THEN 'Eau de Toilette' WHEN contains(lower(name), 'eau de parfum') THEN 'Eau de Parfum' WHEN contains(lower(name), 'cologne') THEN 'Eau de Cologne' WHEN contains(lower(name), 'elixir') THEN 'Elixir' WHEN contains(lower(name), 'body spray') THEN 'Body Spray' ELSE 'none' END AS parsed,
 coalesce(kind, 'none') AS final, CASE WHEN len(name) > 42 THEN name[1:42] || '…' ELSE name END AS title FROM t"""


def column_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List literals, comma lists, decimal commas, thousands, pairs and wide columns."""
    p = read(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    literal = F.concat(F.lit("['"), words[0], F.lit("', ' "), words[1], F.lit(" ', '']"))
    as_dict = F.concat(F.lit("{'top': ['"), words[0], F.lit("'], 'base': ['"), words[1], F.lit("']}"))
    return p.select(
        F.col("p_partkey").alias("item_id"), F.array_join(P.parse_list(literal), ",").alias("listed"), F.array_join(P.parse_list(as_dict), ",").alias("flat"),
        F.array_join(P.parse_tier(F.concat_ws(", ", words[0], F.lit("Unknown"), words[1], F.lit("none"))), ",").alias("tier"),
        P.decimal_text(F.concat(F.col("p_size").cast("string"), F.lit(",5"))).alias("rating"), P.count_text(F.concat(F.lit("1,"), F.lpad(F.col("p_size").cast("string"), 3, "0"))).alias("votes"),
        P.joined_pair(words[0], F.when(F.col("p_size") % 2 == 0, words[1]).otherwise("unknown")).alias("pair"), F.array_join(P.wide_to_array(words[0], F.lit(" "), words[1]), ",").alias("wide"),
        P.listing_price(F.concat(F.lit("[{'mrp': '"), F.col("p_size").cast("string"), F.lit("', 'discount_price': ''}]"))).alias("list_price"),
    )


PARSE_SQL = """WITH t AS (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
SELECT p_partkey AS item_id, a || ',' || b AS listed, a || ',' || b AS flat, a || ',' || b AS tier, p_size + 0.5::DOUBLE AS rating, CAST(1000 + p_size AS INT) AS votes,
 CASE WHEN p_size % 2 = 0 THEN a || ' and ' || b ELSE a END AS pair, a || ',' || b AS wide, CAST(nullif(p_size, 0) AS INT) AS list_price FROM t"""


def packed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand, item and audience out of one cell; product titles."""
    s = F.element_at(F.array(*[F.lit(x) for x in ("for women", "for men", "for women and men", "unisex", "")]), (F.col("p_size") % 5 + 1).cast("int"))
    brand = F.regexp_replace("p_brand", "#", "")
    name = F.trim(F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 5 < 2, F.concat(brand, s)).otherwise(F.concat_ws(" ", brand, s))))
    title = F.concat_ws(" ", brand, F.initcap("p_name"), F.lit("Unisex Perfume - 100ml"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), P.packed_brand(name).alias("brand"), P.packed_item(name).alias("item"), F.coalesce(P.gender(name), F.lit("none")).alias("gender"), P.product_title(title, brand).alias("title"))


_GLUED = "CASE WHEN p_size % 5 < 2 THEN true ELSE false END"
PACKED_SQL = """WITH t AS (SELECT *, replace(p_brand, '#', '') AS b, p_size % 5 AS k FROM part)
SELECT p_partkey AS item_id, b AS brand, CASE WHEN k = 4 THEN p_name || ' ' || b ELSE p_name END AS item,
 CASE k WHEN 0 THEN 'female' WHEN 1 THEN 'male' WHEN 2 THEN 'unisex' WHEN 3 THEN 'unisex' ELSE 'none' END AS gender,
 array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM t"""


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of each supplier seen as a catalogue row; valid and quarantined rows are told apart."""
    s = read(spark, sf_dir, "supplier")
    found = s.select(F.col("s_suppkey").alias("item_id"), Q.issues(F.when(F.col("s_suppkey") % 7 > 0, F.col("s_name")), F.col("s_name"), F.col("s_acctbal"), F.col("s_acctbal") / 1500, F.col("s_nationkey") - 3, F.array("s_name", F.when(F.col("s_nationkey") > 20, " ").otherwise("x")), F.array(F.lit("n"))).alias("issues"))
    good, bad = Q.split_valid(found)
    return good.select("item_id", F.lit("").alias("problems")).unionByName(bad.select("item_id", F.array_join("issues", "; ").alias("problems")))


QUALITY_SQL = """SELECT s_suppkey AS item_id, concat_ws('; ', CASE WHEN s_suppkey % 7 = 0 THEN 'brand is blank' END, CASE WHEN s_acctbal <= 0 THEN 'price is not positive' END,
 CASE WHEN s_acctbal / 1500 NOT BETWEEN 0 AND 5 THEN 'rating is outside 0-5' END, CASE WHEN s_nationkey - 3 < 0 THEN 'rating count is negative' END, CASE WHEN s_nationkey > 20 THEN 'blank accord' END) AS problems FROM supplier"""


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.coverage(catalog(spark, sf_dir).withColumn("limited", F.when(Q.has_limited_data(F.slice("notes", 1, (F.col("size") % 2).cast("int"))), "yes")), ["brand", "notes", "accords", "gender", "kind", "price", "limited"])


COVERAGE_SQL = f"WITH {CATALOG_SQL} SELECT count(*) AS total, count(brand) AS with_brand, count(notes) AS with_notes, count(accords) AS with_accords, count(gender) AS with_gender, count(kind) AS with_kind, count(price) AS with_price, count(*) FILTER (size % 2 = 0) AS with_limited FROM catalog"


def constraint_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not null, unique, event domain and foreign key, over catalogue and events."""
    events = read(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("item_id"))
    return Q.audit(catalog(spark, sf_dir), events, ["click", "purchase", "view"])


AUDIT_SQL = f"""WITH {CATALOG_SQL} SELECT 'item not null' AS rule, count(*) AS violations FROM catalog WHERE brand IS NULL OR item IS NULL
UNION ALL SELECT 'item unique', count(*) FROM (SELECT brand, item FROM catalog GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'event type', count(*) FROM events WHERE event_type NOT IN ('click', 'purchase', 'view')
UNION ALL SELECT 'event item', count(*) FROM events WHERE event_id NOT IN (SELECT p_partkey FROM part)"""


def request_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir)
    return r.select("request_id", F.array_join(Q.request_issues(F.col("text"), (F.col("request_id") % 70).cast("int"), F.col("age"), F.col("hours"), F.col("budget"), F.col("projection"), 950.0), ",").alias("problems"))


CONTRACT_SQL = f"""WITH {REQUESTS_SQL} SELECT request_id, concat_ws(',', CASE WHEN request_id % 70 NOT BETWEEN 1 AND 60 THEN 'limit' END, CASE WHEN age NOT BETWEEN 13 AND 100 THEN 'age' END, CASE WHEN hours NOT BETWEEN 1 AND 24 THEN 'hours' END, CASE WHEN budget < 950 THEN 'budget' END) AS problems FROM requests"""


def key_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = catalog(spark, sf_dir).withColumn("item", F.when(F.col("size") % 2 == 0, F.upper("item")).otherwise(F.concat(F.col("item"), F.lit("!"))))
    return Q.key_collisions(items)


COLLISION_SQL = f"WITH {CATALOG_SQL}, t AS (SELECT brand, CASE WHEN size % 2 = 0 THEN upper(item) ELSE item || '!' END AS item FROM catalog) SELECT {_NORMAL.format('brand')} || '|' || {_NORMAL.format('item')} AS normalized_key, count(*) AS n_rows, count(DISTINCT item) AS n_names FROM t GROUP BY 1 HAVING count(*) > 1"


def legacy_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir).select("item_id", "brand", F.concat_ws(" ", "item", F.lit("edt")).alias("item"), F.when(F.col("size") > 25, "csv").alias("source"), F.when(F.col("size") > 25, 3).alias("source_priority"), F.col("kind").alias("type"), F.lit(None).cast("string").alias("normalized_key"))
    return Q.backfilled(c)


BACKFILL_SQL = f"WITH {CATALOG_SQL} SELECT item_id, brand, item || ' edt' AS item, CASE WHEN size > 25 THEN 'csv' ELSE 'legacy_seed' END AS source, CAST(CASE WHEN size > 25 THEN 3 ELSE 0 END AS INT) AS source_priority, coalesce(kind, 'Eau de Toilette') AS type, {_NORMAL.format('brand')} || '|' || {_NORMAL.format('item')} || ' edt' AS normalized_key FROM catalog"


def _fold_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    key = P.normal_name(F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), r"\s+"), 1, 1), " "))
    return d.select(F.coalesce(key, F.lit("")).alias("key"), F.col("doc_id").alias("load_order"), (F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 6).alias("source_priority"), F.when(F.col("n_chars") % 3 > 0, F.col("lang")).otherwise("").alias("gender"), F.array("lang", "source").alias("notes"))


def priority_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one first word, folded by source priority."""
    out = D.priority_fold(_fold_input(spark, sf_dir), "key", ["gender"], ["notes"])
    return out.select("key", "load_order", "source_priority", F.coalesce("gender", F.lit("")).alias("gender"), F.array_join("notes", ",").alias("notes"))


FOLD_SQL = f"""WITH t AS (SELECT {_NORMAL.format("regexp_split_to_array(coalesce(text, ''), '\\s+')[1]")} AS key, doc_id AS load_order, CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 6 AS source_priority, CASE WHEN n_chars % 3 > 0 THEN lang ELSE '' END AS gender, [lang, source] AS notes FROM documents),
b AS (SELECT *, max(source_priority) OVER (PARTITION BY key ORDER BY load_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t), l AS (SELECT * FROM b WHERE before IS NULL OR source_priority > before),
g AS (SELECT key, max(load_order) AS load_order, max(source_priority) AS source_priority, coalesce(arg_max(gender, load_order) FILTER (gender <> ''), '') AS gender, flatten(list(notes ORDER BY load_order)) AS n FROM l GROUP BY key)
SELECT key, load_order, source_priority, gender, array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i), ',') AS notes FROM g"""


def catalog_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert suppliers into a catalogue made of the same table: matches by name and by key, skips, inserts."""
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    price = F.col("s_acctbal").cast("int")
    stored = s.where(k % 3 != 0).select(k.alias("item_id"), F.col("s_nationkey").cast("string").alias("brand"), F.col("s_name").alias("item"), price.alias("price"), F.lit("old").alias("country"), (k % 4).cast("int").alias("source_priority"), P.normal_key(F.col("s_nationkey").cast("string"), F.col("s_name")).alias("normalized_key"))
    name = F.when(k % 5 == 0, F.lower("s_name")).otherwise(F.col("s_name"))
    batch = s.select(F.col("s_nationkey").cast("string").alias("brand"), name.alias("item"), F.when(k % 2 == 0, price + 1).alias("price"), F.when(k % 7 > 0, F.lit("new")).alias("country"), F.lit(2).alias("source_priority"), P.normal_key(F.col("s_nationkey").cast("string"), name).alias("normalized_key"), k.alias("load_order"))
    out = D.merge(stored, batch)
    base = stored.agg(F.max("item_id").alias("m"))
    # new ids follow the order of hash parts, which SQL lacks: told here only as new
    return out.join(F.broadcast(base)).select(F.when(F.col("item_id") > F.col("m"), -1).otherwise(F.col("item_id")).cast("long").alias("item_id"), "brand", "item", "price", F.coalesce("country", F.lit("none")).alias("country"), "source_priority")


MERGE_SQL = """WITH new AS (SELECT s_suppkey AS k, CAST(s_nationkey AS VARCHAR) AS brand, s_name AS item, CASE WHEN s_suppkey % 5 = 0 THEN lower(s_name) ELSE s_name END AS new_item, CAST(trunc(s_acctbal) AS INT) AS price FROM supplier)
SELECT CASE WHEN k % 3 != 0 THEN k ELSE -1 END AS item_id, brand, CASE WHEN k % 3 != 0 THEN item ELSE new_item END AS item,
 CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN price + 1 END WHEN k % 4 <= 2 AND k % 2 = 0 THEN price + 1 ELSE price END AS price,
 CASE WHEN k % 3 = 0 THEN CASE WHEN k % 7 > 0 THEN 'new' ELSE 'none' END WHEN k % 4 <= 2 AND k % 7 > 0 THEN 'new' ELSE 'old' END AS country,
 CAST(CASE WHEN k % 3 = 0 OR k % 4 <= 2 THEN 2 ELSE k % 4 END AS INT) AS source_priority FROM new"""


def tag_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes put in tiers by family, next to those by accords."""
    tiered = X.note_tiers(catalog(spark, sf_dir), vocab.taxonomy(spark))
    shown = X.pyramid(F.struct(P.strings().alias("top"), P.strings().alias("heart"), P.strings().alias("base")), F.struct("top", "heart", "base"), F.col("accords"))
    by = X.accord_tiers(F.col("accords"))
    return tiered.select("item_id", *[F.array_join(shown[t], ",").alias(f"note_{t}") for t in ("top", "heart", "base")], *[F.array_join(by[t], ",").alias(f"accord_{t}") for t in ("top", "heart", "base")])


_FAM = ", ".join(f"('{t}', '{f}', {i})" for i, (f, ts) in enumerate(vocab.FAMILIES.items()) for t in ts)
_FAMILY_CTE = f"""tax(term, family, ord) AS (VALUES {_FAM}), notes AS (SELECT item_id, unnest(range(1, len(notes) + 1)) AS pos, unnest(notes) AS note FROM catalog),
fam AS (SELECT note, coalesce(max(CASE WHEN lower(note) = family THEN family END), arg_min(family, ord) FILTER ({_EQUIV.format('term', 'lower(note)')} AND len(term) <= len(note))) AS family FROM (SELECT DISTINCT note FROM notes), tax GROUP BY note),
tiers AS (SELECT item_id, pos, note, CASE WHEN family IN ('citrus', 'fresh_aquatic', 'green', 'fruity') THEN 'top' WHEN family IN ('woody', 'oriental', 'animalic', 'earthy') THEN 'base' ELSE 'heart' END AS tier FROM notes JOIN fam USING (note))"""
_LW = sql_map(vocab.LONGEVITY_WEIGHTS)
TIER_SQL = f"""WITH {CATALOG_SQL}, {_FAMILY_CTE}, g AS (SELECT item_id, {', '.join(f"coalesce(string_agg(note, ',' ORDER BY pos) FILTER (tier = '{t}'), '') AS note_{t}" for t in ('top', 'heart', 'base'))} FROM tiers GROUP BY item_id)
SELECT g.*, array_to_string(list_filter(accords, lambda a: coalesce({_LW}[a], 0.5) <= 0.35), ',') AS accord_top, array_to_string(list_filter(accords, lambda a: coalesce({_LW}[a], 0.5) > 0.35 AND coalesce({_LW}[a], 0.5) < 0.75), ',') AS accord_heart,
 array_to_string(list_filter(accords, lambda a: coalesce({_LW}[a], 0.5) >= 0.75), ',') AS accord_base FROM g JOIN catalog USING (item_id)"""


def derived_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longevity and projection with their labels, before and after the concentration's factor."""
    c = catalog(spark, sf_dir).withColumns({"longevity": X.longevity_score(F.col("accords"), F.col("notes")), "sillage": X.sillage_score(F.col("accords"), F.col("notes"))})
    a = X.adjusted(F.col("longevity"), F.col("sillage"), F.col("kind"))
    return c.select("item_id", "longevity", "sillage", a["longevity"].alias("adj_longevity"), a["sillage"].alias("adj_sillage"), X.wear_label(a["longevity"]).alias("wear"), X.wear_hours(a["longevity"]).alias("hours"), X.projection_label(a["sillage"]).alias("projection"))


def _position_sql(weights: dict, bonus: float) -> str:
    m = sql_map(weights)
    return f"round(least(100.0, 100 * (coalesce({m}[accords[1]], 0.5) + 0.8::DOUBLE * coalesce({m}[accords[2]], 0.5)) / 1.8::DOUBLE + CASE WHEN list_has_any({_low('notes')}, {_list(vocab.POWER_NOTES)}) THEN {bonus} ELSE 0 END), 1)"


_FACTORS = {k: {x: v[i] for x, v in vocab.TYPE_FACTORS.items()} for i, k in enumerate(("longevity", "sillage"))}
_SCORES = f"scores AS (SELECT *, CAST({_position_sql(vocab.LONGEVITY_WEIGHTS, 8.0)} AS DOUBLE) AS longevity, CAST({_position_sql(vocab.SILLAGE_WEIGHTS, 6.0)} AS DOUBLE) AS sillage FROM catalog)"
_ADJUSTED = "adjusted AS (SELECT *, " + ", ".join(f"CASE WHEN {sql_map(_FACTORS[k])}[lower(kind)] IS NULL THEN {k} ELSE round(greatest(0.0, CASE WHEN {sql_map(_FACTORS[k])}[lower(kind)] > 1 THEN least(100.0, {k} * {sql_map(_FACTORS[k])}[lower(kind)]::DOUBLE) ELSE {k} * {sql_map(_FACTORS[k])}[lower(kind)]::DOUBLE END), 1) END AS adj_{k}" for k in _FACTORS) + " FROM scores)"
_HOURS = "CASE WHEN {0} < 30 THEN 3.0 WHEN {0} < 50 THEN 5.0 WHEN {0} < 70 THEN 7.0 WHEN {0} < 85 THEN 9.0 ELSE 12.0 END"
_PROJ = "CASE WHEN {0} < 35 THEN 'light' WHEN {0} < 65 THEN 'moderate' ELSE 'strong' END"
SCORE_SQL = f"""WITH {CATALOG_SQL}, {_SCORES}, {_ADJUSTED} SELECT item_id, longevity, sillage, CAST(adj_longevity AS DOUBLE) AS adj_longevity, CAST(adj_sillage AS DOUBLE) AS adj_sillage,
 CASE WHEN adj_longevity < 30 THEN '2-4 hours' WHEN adj_longevity < 50 THEN '4-6 hours' WHEN adj_longevity < 70 THEN '6-8 hours' WHEN adj_longevity < 85 THEN '8-10 hours' ELSE '10+ hours' END AS wear,
 CAST({_HOURS.format('adj_longevity')} AS DOUBLE) AS hours, {_PROJ.format('adj_sillage')} AS projection FROM adjusted"""


def scenario_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir)
    found = X.scenario_performance(r, vocab.scenario_defaults(spark))
    return r.join(found.withColumnsRenamed({"hours": "default_hours", "projection": "default_projection"}), "request_id").select("request_id", "default_hours", "default_projection", X.age_bracket(F.col("age")).alias("bracket"), X.scenario_or_default(F.try_element_at("scenarios", F.lit(1))).alias("scenario"))


_DEF = ", ".join(f"('{s}', {h}, '{p}', {vocab.PROJECTIONS.index(p)})" for s, (h, p) in vocab.SCENARIO_DEFAULTS.items())
PERFORMANCE_SQL = f"""WITH {REQUESTS_SQL}, d(scenario, hours, projection, quiet) AS (VALUES {_DEF}), e AS (SELECT request_id, unnest(scenarios) AS scenario FROM requests),
g AS (SELECT request_id, CAST(max(d.hours) AS INT) AS default_hours, arg_min(d.projection, quiet) AS default_projection FROM e JOIN d USING (scenario) GROUP BY 1)
SELECT r.request_id, default_hours, default_projection, CASE WHEN age < 25 THEN 'under_25' WHEN age <= 40 THEN '25_40' WHEN age > 40 THEN '40_plus' END AS bracket, coalesce(scenarios[1], 'daily') AS scenario FROM requests r LEFT JOIN g USING (request_id)"""


_BRANDS = ["Chanel", "Dior Homme", "ZARA", "Davidoff", "House of Tom Ford", "Fogg", ""]


def character_and_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominant tag, character, and prices: known ones stay, others lie in the tier of the brand, which brands of all tiers take in turn."""
    c = catalog(spark, sf_dir)
    buckets = {"woody": ["woody", "leather", "oud", "amber"], "fresh": ["fresh", "citrus", "aquatic", "green", "marine"], "sweet": ["sweet", "fruity", "vanilla"]}
    brand = F.concat_ws(" ", F.element_at(P.strings(*_BRANDS), (F.col("item_id") % len(_BRANDS) + 1).cast("int")), F.lit(" "))
    estimate = X.estimated_price(F.when(F.col("size") % 2 == 0, F.col("price")), brand, F.col("item_id"))
    return c.select("item_id", X.dominant_tag(F.col("accords")).alias("dominant"), F.coalesce(X.character(F.col("accords"), buckets), F.lit("none")).alias("character"), estimate.alias("price"))


_tier = lambda words: "true" if words == [""] else " OR ".join(f"contains(b, '{w.replace(chr(39), chr(39) * 2)}')" for w in words)
_TIER_PRICE = " ".join(f"WHEN {_tier(words)} THEN ('0x' || md5(CAST(item_id AS VARCHAR))[1:8])::BIGINT % {hi - lo + 1} + {lo}" for words, lo, hi in vocab.PRICE_TIERS)
CHARACTER_SQL = f"""WITH {CATALOG_SQL}, t AS (SELECT *, lower({_list(_BRANDS)}[item_id % {len(_BRANDS)} + 1]) AS b, len(list_intersect(accords, ['woody', 'leather', 'oud', 'amber'])) AS w,
 len(list_intersect(accords, ['fresh', 'citrus', 'aquatic', 'green', 'marine'])) AS f, len(list_intersect(accords, ['sweet', 'fruity', 'vanilla'])) AS s FROM catalog)
SELECT item_id, accords[1] AS dominant, CASE WHEN greatest(w, f, s) = 0 THEN 'none' WHEN w >= f AND w >= s THEN 'woody' WHEN f >= s THEN 'fresh' ELSE 'sweet' END AS character,
 CAST(CASE WHEN size % 2 = 0 THEN trunc(price) ELSE CASE {_TIER_PRICE} END END AS INT) AS price FROM t"""


def expanded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as embedding texts, for a search and for an alternative, with and without tags, scenarios, skin and families."""
    r, k = requests(spark, sf_dir), F.col("request_id")
    accords = F.when(k % 2 == 0, P.strings("woody", "amber", "sweet"))
    notes = F.when(k % 3 > 0, F.transform(F.sequence(F.lit(1), k % 13 + 1), lambda i: F.concat(F.lit("note "), i)))
    skin = F.try_element_at(P.strings(*vocab.SKIN_FAMILIES, "unknown"), (k % (len(vocab.SKIN_FAMILIES) + 2) + 1).cast("int"))
    args = (accords, notes, F.col("scenarios"), skin, F.col("families"))
    return r.select(
        "request_id", F.array_join(X.scenario_terms(F.col("scenarios"), "accords", 6), ",").alias("accords"), X.expanded_query(F.col("text"), *args).alias("search"), X.expanded_query(F.col("text"), *args, alternative=True).alias("alternative"),
    )


_of = lambda i, n: f"""(list_filter(string_split(array_to_string(list_transform(list_filter(coalesce(scenarios, []), lambda s: {sql_map({s: "|".join(v[i]) for s, v in vocab.SCENARIOS.items()})}[s] IS NOT NULL), lambda s: {sql_map({s: "|".join(v[i]) for s, v in vocab.SCENARIOS.items()})}[s]), '|'), '|'), lambda x: x <> ''))"""
_first = lambda a, n: f"list_filter({a}, lambda x, j: list_position({a}, x) = j)[1:{n}]"
_say = lambda prefix, a: f"CASE WHEN len({a}) > 0 THEN '{prefix} ' || array_to_string({a}, ', ') END"
_MEMBERS = sql_map({k: "|".join(v[:4]) for k, v in vocab.FAMILIES.items()})
_rest = lambda terms: f"""{_say('accords', 'a')}, {_say('notes', 'n[1:10]')}, {_say('for', terms)}, 'skin ' || nullif(array_to_string(string_split(skin, '|'), ', '), ''), {_say('families', 'f')}"""
EXPANDED_SQL = f"""WITH {REQUESTS_SQL}, t AS (SELECT r.*, lower(c_mktsegment) || ' for ' || c_name AS text, {_first(_of(2, 6), 6)} AS sa, {_first(_of(3, 8), 8)} AS sn, CASE WHEN request_id % 2 = 0 THEN ['woody', 'amber', 'sweet'] END AS a,
 CASE WHEN request_id % 3 > 0 THEN list_transform(range(1, request_id % 13 + 2), lambda i: 'note ' || i) END AS n, {_list("|".join(v) for v in vocab.SKIN_FAMILIES.values())}[request_id % {len(vocab.SKIN_FAMILIES) + 2} + 1] AS skin,
 flatten(list_transform(coalesce(families, []), lambda f: string_split({_MEMBERS}[f], '|'))) AS f FROM requests r JOIN customer ON c_custkey = request_id)
SELECT request_id, array_to_string(sa, ',') AS accords, concat_ws('. ', text, {_rest('sa')}) AS search, concat_ws('. ', 'similar to ' || text, {_rest('sn')}) AS alternative FROM t"""


# ---- scoring: every customer's request against the items that the customer has ordered


#: What tag fits read of an item and of a request.
_ITEM_KIND, _REQUEST_KIND = ("accords", "notes", "gender"), ("wanted", "scenarios", "families", "bracket")


def _kind(columns: tuple[str, ...]):
    """128 bits that name the columns' values."""
    return F.unhex(F.md5(F.to_json(F.struct(*columns)).cast("binary")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the distinct items of their customer's orders: as many pairs as order lines at most."""
    items = catalog(spark, sf_dir).withColumns({"longevity": X.longevity_score(F.col("accords"), F.col("notes")), "sillage": X.sillage_score(F.col("accords"), F.col("notes")), "item_kind": _kind(_ITEM_KIND)})
    asked = requests(spark, sf_dir).withColumnRenamed("gender", "wanted").withColumn("bracket", X.age_bracket(F.col("age"))).withColumn("request_kind", _kind(_REQUEST_KIND))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("item_id"))
    # the pairs are read for their kinds and for themselves
    ordered = written(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("request_id")).join(lines, "o_orderkey").select("request_id", "item_id").distinct(), "ordered")
    return ordered.join(asked, "request_id").join(items, "item_id")


_PAIRS = """pairs AS (SELECT r.* EXCLUDE (gender), r.gender AS wanted, c.* FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) o
 JOIN requests r ON r.request_id = o_custkey JOIN scores c ON c.item_id = l_partkey)"""


def _tag_fits(df: DataFrame) -> DataFrame:
    """Fits that compare tags, made once for each pair of kinds that occurs: as many as pairs at most."""
    c = F.col
    kinds = df.groupBy("item_kind", "request_kind").agg(*[F.first(x).alias(x) for x in (*_ITEM_KIND, *_REQUEST_KIND)], F.first("age").alias("age"))
    made = kinds.select("item_kind", "request_kind", *[x.alias(n) for n, x in {
        "leaning": S.gender_leaning(c("gender"), c("wanted"), c("accords"), c("notes")), "scenario_fit": S.scenario_fit(c("accords"), c("notes"), c("scenarios")),
        "age_fit": S.age_fit(c("accords"), c("age")), "family_fit": S.family_fit(c("accords"), c("notes"), c("families")),
        "negated": F.coalesce(S.negated_hit(c("accords"), c("notes"), F.array(F.lit("oud"), F.lit("rose"))), F.lit("none")),
    }.items()])
    return df.join(written(made, "tag_fits"), ["item_kind", "request_kind"]).drop("item_kind", "request_kind", "bracket")


def fits(df: DataFrame) -> DataFrame:
    c = F.col
    return _tag_fits(df).withColumns({
        "price_fit": S.price_fit(c("price"), c("budget"), c("request_id") % 2 == 0), "gender_fit": S.gender_fit(c("gender"), c("wanted")),
        "longevity_fit": S.longevity_fit(c("longevity"), c("wants_longevity"), c("hours")), "projection_fit": S.projection_fit(c("sillage"), c("projection")),
    })


def fit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["price_fit", "gender_fit", "leaning", "scenario_fit", "longevity_fit", "projection_fit", "age_fit", "family_fit"]
    return fits(pairs(spark, sf_dir)).select("request_id", "item_id", *[F.round(n, 6).alias(n) for n in names], "negated")


_SC = {i: sql_map({s: ",".join(v[i]) for s, v in vocab.SCENARIOS.items()}) for i in (2, 3)}
_want = lambda i: f"list_distinct(flatten(list_transform(coalesce(scenarios, []), lambda s: string_split({_SC[i]}[s], ','))))"
_FAMS = sql_map({k: ",".join(v) for k, v in vocab.FAMILIES.items()})
_AGES = sql_map({k: ",".join(v) for k, v in vocab.AGE_ACCORDS.items()})
_any_equiv = lambda x, xs: f"len(list_filter({xs}, lambda u: {_EQUIV.format(x, 'u')})) > 0"
_count = lambda sa, sn: f"(len(list_intersect({_low('accords')}, {_list(sa)})) + len(list_filter(list_distinct({_low('notes')}), lambda n: {_any_equiv('n', _list(sn))})))"
_FITS = f"""p1 AS (SELECT *, {_want(2)} AS want_a, {_want(3)} AS want_n, {_count(vocab.MASCULINE_ACCORDS, vocab.MASCULINE_NOTES)} AS men, {_count(vocab.FEMININE_ACCORDS, vocab.FEMININE_NOTES)} AS women,
 string_split({_AGES}[CASE WHEN age < 25 THEN 'under_25' WHEN age <= 40 THEN '25_40' WHEN age > 40 THEN '40_plus' END], ',') AS age_a, {_HOURS.format('longevity')} AS est, list_position({_list(vocab.PROJECTIONS)}, {_PROJ.format('sillage')}) - list_position({_list(vocab.PROJECTIONS)}, projection) AS gap,
 list_concat({_low('accords')}, {_low('notes')}) AS tags FROM pairs),
fits AS (SELECT *, CASE WHEN budget IS NULL THEN 1.0 WHEN price > budget THEN 0.0 WHEN request_id % 2 = 0 THEN 1 - price / budget ELSE price / budget END AS price_fit,
 CASE WHEN wanted IS NOT NULL AND gender IS NOT NULL AND gender <> 'unisex' AND gender <> wanted THEN 0.4 ELSE 1.0 END AS gender_fit,
 CASE WHEN gender = 'unisex' AND ((wanted = 'male' AND women > men + 1) OR (wanted = 'female' AND men > women + 1)) THEN 0.85 ELSE 1.0 END AS leaning,
 CASE WHEN len(want_a) + len(want_n) = 0 THEN 1.0 ELSE 0.7 * least(1.0, len(list_intersect({_low('accords')}, want_a)) / 2) + 0.3 * least(1.0, len(list_filter({_low('notes')}, lambda n: {_any_equiv('n', 'want_n')})) / 3) END AS scenario_fit,
 CASE WHEN NOT wants_longevity AND hours IS NULL THEN 1.0 WHEN hours IS NOT NULL THEN CASE WHEN est >= hours THEN 1.0 ELSE greatest(0.2, est / hours) END ELSE longevity / 100 END AS longevity_fit,
 CASE WHEN projection IS NULL THEN 1.0 WHEN abs(gap) = 0 THEN 1.0 WHEN abs(gap) = 1 THEN 0.6 ELSE 0.2 END AS projection_fit,
 CASE WHEN age IS NULL THEN 1.0 ELSE 0.6 + 0.4 * least(1.0, 2 * len(list_intersect(list_distinct(accords), age_a)) / len(list_distinct(accords))) END AS age_fit,
 CASE WHEN families IS NULL THEN 1.0 ELSE len(list_filter(families, lambda f: len(list_filter(tags, lambda t: {_any_equiv('t', f"string_split({_FAMS}[f], ',')")})) > 0)) / len(families) END AS family_fit,
 CASE WHEN len(list_filter(tags, lambda t: {_EQUIV.format("'oud'", 't')})) > 0 THEN 'oud' WHEN len(list_filter(tags, lambda t: {_EQUIV.format("'rose'", 't')})) > 0 THEN 'rose' ELSE 'none' END AS negated FROM p1)"""
_FIT_NAMES = ["price_fit", "gender_fit", "leaning", "scenario_fit", "longevity_fit", "projection_fit", "age_fit", "family_fit"]
FIT_SQL = f"WITH {CATALOG_SQL}, {REQUESTS_SQL}, {_SCORES}, {_PAIRS}, {_FITS} SELECT request_id, item_id, {', '.join(f'round(CAST({n} AS DOUBLE), 6) AS {n}' for n in _FIT_NAMES)}, negated FROM fits"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with their blended score."""
    c = F.col
    active = {"price": c("budget").isNotNull(), "gender": c("wanted").isNotNull(), "longevity": c("wants_longevity") | c("hours").isNotNull(), "scenario": c("scenarios").isNotNull(), "projection": c("projection").isNotNull(), "age": c("age").isNotNull(), "family": c("families").isNotNull()}
    sim = (c("item_id") % 10) / 10.0
    by = {"sim": sim, "note": F.lit(0.4), "price": c("price_fit"), "gender": c("gender_fit") * c("leaning"), "longevity": c("longevity_fit"), "scenario": c("scenario_fit"), "projection": c("projection_fit"), "age": c("age_fit"), "family": c("family_fit")}
    factor = S.negation_factor(F.nullif(c("negated"), F.lit("none")))
    return fits(pairs(spark, sf_dir)).withColumn("score", F.round(S.final_score(S.blend(by, active), F.lit(0.0), factor), 6)).withColumn("has_reference", c("request_id") % 4 == 0)


_W = vocab.WEIGHTS
_term = lambda on, name, fit: (f"CASE WHEN {on} THEN {_W[name]} * {fit} ELSE 0 END", f"CASE WHEN {on} THEN {_W[name]} ELSE 0 END")
_TERMS = [("true", "sim", "((item_id % 10) / 10.0)"), ("true", "note", "0.4"), ("budget IS NOT NULL", "price", "price_fit"), ("wanted IS NOT NULL", "gender", "gender_fit * leaning"), ("wants_longevity OR hours IS NOT NULL", "longevity", "longevity_fit"), ("scenarios IS NOT NULL", "scenario", "scenario_fit"), ("projection IS NOT NULL", "projection", "projection_fit"), ("age IS NOT NULL", "age", "age_fit"), ("families IS NOT NULL", "family", "family_fit")]
_SCORED = "scored AS (SELECT *, request_id % 4 = 0 AS has_reference, round(CAST(100 * (" + " + ".join(f"CAST({_term(*t)[0]} AS DOUBLE)" for t in _TERMS) + ") / (" + " + ".join(f"CAST({_term(*t)[1]} AS DOUBLE)" for t in _TERMS) + ") * CASE WHEN negated = 'none' THEN 1.0 ELSE 0.25 END AS DOUBLE), 6) AS score FROM fits)"
_BASE = f"WITH {CATALOG_SQL}, {REQUESTS_SQL}, {_SCORES}, {_PAIRS}, {_FITS}, {_SCORED}"


def blended_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("request_id", "item_id", "score", S.shown_score(F.col("score")).alias("shown"))


BLEND_SQL = f"{_BASE} SELECT request_id, item_id, score, round(least(100.0, score), 1) AS shown FROM scored"


def price_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of each request in its own order: score, nearest to the ceiling, or cheapest."""
    order = W.price_order(F.col("budget"), F.col("request_id") % 2 == 0)
    return W.top(scored(spark, sf_dir), order, 10).select("request_id", "item_id", "rank")


ORDER_SQL = f"""{_BASE} SELECT request_id, item_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN request_id % 2 = 0 THEN price WHEN budget IS NOT NULL THEN -price ELSE 0 END, score DESC, item_id) AS INT) AS rank FROM scored) WHERE rank <= 10"""


def brand_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six of each request with two of a brand, more only if there are too few."""
    r = W.ranked(scored(spark, sf_dir), W.quality_order())
    return W.relaxing_cap(r, F.substring("brand", -1, 1), 2, 6).select("request_id", "item_id", "rank")


CAP_SQL = f"""{_BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item_id) AS rk FROM scored), o AS (SELECT *, row_number() OVER (PARTITION BY request_id, right(brand, 1) ORDER BY rk) AS occ FROM r)
SELECT request_id, item_id, rank FROM (SELECT request_id, item_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY greatest(occ - 2, 0), rk) AS INT) AS rank FROM o WHERE occ <= 6) WHERE rank <= 6"""


def strictly_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one of each dominant tag, five in all."""
    r = W.ranked(scored(spark, sf_dir), W.quality_order())
    return W.strict_cap(r, X.dominant_tag(F.col("accords")), 1, 5).select("request_id", "item_id", "rank")


STRICT_SQL = f"""{_BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item_id) AS rk FROM scored), o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY request_id, accords[1] ORDER BY rk) = 1)
SELECT request_id, item_id, rank FROM (SELECT request_id, item_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY rk) AS INT) AS rank FROM o) WHERE rank <= 5"""


def diversified_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = scored(spark, sf_dir).select("request_id", "item_id", "brand", "accords", "has_reference", "score")
    # the page reads the ranks several times
    r = written(W.ranked(slim, W.quality_order()).drop("score"), "ranked")
    return W.diversified(r, 5, X.dominant_tag(F.col("accords")), 1, 1).select("request_id", "item_id", "rank")


DIVERSE_SQL = f"""{_BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item_id) AS rk FROM scored), b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY request_id, lower(brand) ORDER BY rk) = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY request_id, accords[1] ORDER BY rk) AS ch FROM b), k AS (SELECT * FROM c WHERE has_reference OR ch = 1), p AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rk) AS pr FROM k QUALIFY pr <= 5),
rest AS (SELECT r.*, row_number() OVER (PARTITION BY r.request_id, lower(r.brand) ORDER BY r.rk) AS occ FROM r ANTI JOIN p ON r.request_id = p.request_id AND r.item_id = p.item_id),
restr AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY greatest(occ - 1, 0), rk) AS pr FROM rest WHERE occ <= 5), u AS (SELECT request_id, item_id, 0 AS stage, pr FROM p UNION ALL SELECT request_id, item_id, 1, pr FROM restr WHERE pr <= 5)
SELECT request_id, item_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY stage, pr) AS INT) AS rank FROM u QUALIFY rank <= 5"""


def external_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks of an outside ranker, present on the page, blended and paged."""
    r = W.top(scored(spark, sf_dir), W.quality_order(), 20)
    picks = r.where("rank % 2 = 0").select("request_id", "item_id", (30 - F.col("rank")).alias("pos"), (F.col("item_id") % 120).cast("double").alias("adjusted_score"), F.lit(None).cast("string").alias("explanation"))
    return W.blended_picks(r, picks, 5).select("request_id", "item_id", "rank", W.decimals(F.col("score"), 3).alias("score"))


PICK_SQL = f"""{_BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item_id) AS rk FROM scored QUALIFY rk <= 20), p AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY 30 - rk, item_id) AS pr FROM r WHERE rk % 2 = 0)
SELECT request_id, item_id, CAST(pr AS INT) AS rank, round(0.7 * score + 0.3 * least(100.0, CAST(item_id % 120 AS DOUBLE)), 3) AS score FROM p WHERE pr <= 5"""


def repriced_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blended picks in the price order of their request again."""
    r = W.top(scored(spark, sf_dir), W.quality_order(), 20)
    picks = r.where("rank % 2 = 0").select("request_id", "item_id", (30 - F.col("rank")).alias("pos"), (F.col("item_id") % 120).cast("double").alias("adjusted_score"), F.lit(None).cast("string").alias("explanation"))
    # equal prices go by the score as it is shown
    shown = W.blended_picks(r, picks, 5).withColumn("score", W.decimals(F.col("score"), 3))
    page = W.repriced(shown, F.col("budget"), F.col("request_id") % 2 == 0)
    return page.select("request_id", "item_id", "rank", "score")


REPRICED_SQL = f"""WITH base AS ({PICK_SQL}), q AS (SELECT b.*, p.p_retailprice AS price, CASE WHEN b.request_id % 3 > 0 THEN 900 + b.request_id % 100 END AS budget FROM base b JOIN part p ON p.p_partkey = b.item_id)
SELECT request_id, item_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN request_id % 2 = 0 THEN price WHEN budget IS NOT NULL THEN -price ELSE rank END, score DESC, item_id) AS INT) AS rank, score FROM q"""


def offered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = W.ranked(scored(spark, sf_dir), W.quality_order())
    return W.offered_pages(r, 2, 60, 40.0).select("request_id", "item_id", "rank", "page")


PAGE_SQL = f"""{_BASE}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item_id) AS INT) AS rank FROM scored), l AS (SELECT *, min(CASE WHEN rank % 2 = 0 THEN score END) OVER (PARTITION BY request_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM r WHERE rank <= 60)
SELECT request_id, item_id, rank, CAST((rank - 1) // 2 AS INT) AS page FROM l WHERE low IS NULL OR low >= 40"""


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items next to the next item of their brand: exact and fuzzy overlap, named in a query or not."""
    c = catalog(spark, sf_dir)
    other = c.select((F.col("item_id") - 1).alias("item_id"), F.col("brand").alias("b2"), F.col("item").alias("i2"), F.col("accords").alias("a2"), F.col("notes").alias("n2"))
    j = c.join(other, "item_id")
    return j.select(
        "item_id", F.round(S.jaccard(F.col("notes"), F.col("n2")), 6).alias("exact"), F.round(S.reference_fit(F.col("accords"), F.col("notes"), F.col("a2"), F.col("n2")), 6).alias("fuzzy"),
        S.identity_boost(F.concat_ws(" ", "brand", "item"), F.col("b2"), F.col("i2")).alias("boost"), F.size(S.matched_tags(F.col("notes"), F.split("i2", " "))).alias("matched"),
        F.round(S.note_match(F.col("notes"), F.col("accords"), F.split("i2", " ")), 6).alias("note_match"), S.bridge_fit(F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), F.col("accords"), F.lit(True)).alias("bridge"),
    )


_fresh, _dense = [a for a, w in vocab.LONGEVITY_WEIGHTS.items() if w <= 0.35], [a for a, w in vocab.LONGEVITY_WEIGHTS.items() if w >= 0.75]
_starts = "(regexp_matches(lower(x), '\\b' || t) OR regexp_matches(t, '\\b' || lower(x)))"
_greedy = lambda a, b: f"(len(list_intersect({_low(a)}, {_low(b)})) / (4 - len(list_intersect({_low(a)}, {_low(b)}))))"
COMPOSITION_SQL = f"""WITH {CATALOG_SQL}, j AS (SELECT c.*, d.brand AS b2, d.item AS i2, d.accords AS a2, d.notes AS n2, lower(replace(c.brand, '#', ' ')) AS lb, lower(replace(d.brand, '#', ' ')) AS lb2 FROM catalog c JOIN catalog d ON d.item_id = c.item_id + 1)
SELECT item_id, round(CAST(len(list_intersect({_low('notes')}, {_low('n2')})) / len(list_distinct(list_concat({_low('notes')}, {_low('n2')}))) AS DOUBLE), 6) AS exact, round(CAST(0.65 * {_greedy('accords', 'a2')} + 0.35 * {_greedy('notes', 'n2')} AS DOUBLE), 6) AS fuzzy,
 CAST(CASE WHEN item = i2 THEN CASE WHEN lb = lb2 THEN 35 ELSE 15 END WHEN regexp_matches(lb, '\\b' || lb2 || '\\b') THEN 8 ELSE 0 END AS DOUBLE) AS boost,
 CAST(len(list_filter(notes, lambda x: len(list_filter(string_split(i2, ' '), lambda t: {_starts})) > 0)) AS INT) AS matched,
 round(CAST(least(1.0, (len(list_filter(notes, lambda x: len(list_filter(string_split(i2, ' '), lambda t: {_starts})) > 0)) + len(list_filter(accords, lambda x: len(list_filter(string_split(i2, ' '), lambda t: {_starts})) > 0))) / 5) AS DOUBLE), 6) AS note_match,
 CAST(CASE WHEN list_has_any(accords, {_list(_fresh)}) AND list_has_any(accords, {_list(_dense)}) THEN 1.0 WHEN list_has_any(accords, {_list(_fresh)}) OR list_has_any(accords, {_list(_dense)}) THEN 0.5 ELSE 0.2 END AS DOUBLE) AS bridge FROM j"""


QUERIES = {
    "text_normalisation": (text_normalisation, TEXT_SQL), "column_parsing": (column_parsing, PARSE_SQL), "packed_names": (packed_names, PACKED_SQL), "quality_gate": (quality_gate, QUALITY_SQL),
    "coverage_report": (coverage_report, COVERAGE_SQL), "constraint_audit": (constraint_audit, AUDIT_SQL), "request_contract": (request_contract, CONTRACT_SQL), "key_collisions": (key_collisions, COLLISION_SQL),
    "legacy_backfill": (legacy_backfill, BACKFILL_SQL), "priority_fold": (priority_fold, FOLD_SQL), "catalog_merge": (catalog_merge, MERGE_SQL), "tag_tiers": (tag_tiers, TIER_SQL), "derived_scores": (derived_scores, SCORE_SQL),
    "scenario_performance": (scenario_performance, PERFORMANCE_SQL), "character_and_price": (character_and_price, CHARACTER_SQL), "expanded_queries": (expanded_queries, EXPANDED_SQL), "fit_table": (fit_table, FIT_SQL),
    "blended_scores": (blended_scores, BLEND_SQL), "price_orders": (price_orders, ORDER_SQL), "brand_capped": (brand_capped, CAP_SQL), "strictly_capped": (strictly_capped, STRICT_SQL), "diversified_page": (diversified_page, DIVERSE_SQL),
    "external_picks": (external_picks, PICK_SQL), "repriced_picks": (repriced_picks, REPRICED_SQL), "offered_pages": (offered_pages, PAGE_SQL), "composition": (composition, COMPOSITION_SQL),
}
