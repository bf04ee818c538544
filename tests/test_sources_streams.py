import json
import math
import random
import time

from pyspark.sql import functions as F

from tagloom.operators import conversation as C
from tagloom.operators import explain as E
from tagloom.operators import feedback as K
from tagloom.sources import catalog as S
from tagloom.streaming import jobs as L


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_six_sources_in_order(spark, tmp_path):
    da = put(tmp_path / "da.csv", "brand,perfume,launch_year,notes,main_accords\nDior,Sauvage for Men,2015,\"['Pepper', 'Lavender']\",\"['fresh spicy']\"\n,x,1,[],[]\n")
    fra = put(tmp_path / "fra.csv", "Name,Gender,Main Accords,Description,Rating Value,Rating Count\n9am Dive Afnanfor women,for women,\"['aquatic']\",Nice,4.2,\"1,234\"\n ,,,,,\n")
    cleaned = put(tmp_path / "cleaned.csv", "url;Perfume;Brand;Country;Gender;Rating Value;Rating Count;Year;Top;Middle;Base;Perfumer1;Perfumer2;mainaccord1;mainaccord2;mainaccord3;mainaccord4;mainaccord5\nu;Chloé;Maison;France;women;4,31;12;1999;lemon, unknown;rose;musk;A;unknown;woody;;amber;;\n", "cp850")
    nandini = put(tmp_path / "nandini.csv", "Brand,Name,Notes,Description,Image URL\nLalique,Encré,\"cedar, none\",dark,http://x/i.png\n", "cp850")
    indian = put(tmp_path / "indian.csv", "brand,perfume,gender,notes,accords,price_inr\nFogg,Scent,men,\"mint, tea\",fresh,450\nFogg,Other,men,,,n/a\n")
    main = put(tmp_path / "main.csv", "brand,name,gender,notes.top_notes,notes.middle_notes,notes.base_notes,accords,prices\nVillain,Villain Oud Unisex Perfume - 100ml,unisex,\"['a']\",\"['b']\",\"['a', 'c']\",\"['oud']\",\"[{'mrp': '900', 'discount_price': '799'}]\"\n")
    parts = [S.quoted_list_source(spark, da), S.supplement_source(spark, indian), S.nested_header_source(spark, main), S.packed_name_source(spark, fra), S.tiered_source(spark, cleaned), S.image_link_source(spark, nandini)]
    rows = S.all_sources(parts).orderBy("load_order").collect()
    assert [(r.brand, r.item, r.source_priority) for r in rows] == [("Dior", "Sauvage for Men", 1), ("Fogg", "Scent", 0), ("Fogg", "Other", 0), ("Villain", "Oud", 5), ("Afnan", "9am Dive", 2), ("Maison", "Chloé", 3), ("Lalique", "Encré", 4)]
    assert rows[0].gender == "male" and rows[0].notes == ["Pepper", "Lavender"]
    assert [r.price for r in rows[1:4]] == [450, None, 799] and rows[3].notes == ["a", "b", "c"]
    assert rows[4].rating_count == 1234 and rows[4].gender == "female"
    assert (rows[5].rating, rows[5].notes, rows[5].accords, rows[5].perfumer) == (4.31, ["lemon", "rose", "musk"], ["woody", "amber"], "A")
    assert rows[6].notes == ["cedar"]
    assert S.supplement_source(spark, str(tmp_path / "absent.csv")).count() == 0
    assert S.capped(S.all_sources(parts), 2).count() == 2


def test_code_page_files_with_quotes_and_line_feeds(spark, tmp_path):
    head = '"Brand";Perfume;"Note; text"\r\n'
    rows = 'Ä;"Eau ""X""";"two\nlines"\r\nBrand;Perfume;Note; text\r\n"a;b";é;\r\n;;\r\nBrand;Perfume;"Note; text"\r\n'
    got = S.read_csv(spark, put(tmp_path / "c.csv", head + rows, "cp850"), ";", "cp850")
    assert got.columns == ["Brand", "Perfume", "Note; text"]
    want = {("Ä", 'Eau "X"', "two\nlines"), ("Brand", "Perfume", "Note"), ("a;b", "é", None), ("Brand", "Perfume", "Note; text")}
    assert want <= {tuple(r) for r in got.collect()} and got.count() in (4, 5)


def test_sinks_and_metrics(spark, tmp_path):
    items = spark.createDataFrame([(1,), (2,)], "item_id long")
    rated = S.rating_events(spark.createDataFrame([(1, 1), (2, 0), (9, 1), (1, 5)], "item_id long, rating int"), items)
    assert sorted((r.item_id, r.event_type) for r in rated.collect()) == [(1, "explanation_helpful"), (2, "explanation_unhelpful")]
    S.append_events(rated.withColumn("ts", F.lit("2024-01-02 03:04:05").cast("timestamp")), str(tmp_path / "events"))
    S.append_events(rated.withColumn("ts", F.lit("2024-01-03 03:04:05").cast("timestamp")), str(tmp_path / "events"))
    assert spark.read.parquet(str(tmp_path / "events")).groupBy("day").count().count() == 2
    text = put(tmp_path / "metrics.txt", '# HELP x\nhttp_count{route="/a",status="200"} 3\nup 1\n')
    got = {(r.metric, json.dumps(r.labels)): r.value for r in S.read_metrics(spark, text).collect()}
    assert got == {("http_count", '{"route": "/a", "status": "200"}'): 3.0, ("up", "{}"): 1.0}


def events(spark):
    rows = [(i, f"2024-01-{1 + i % 5:02d} 00:00:{i % 60:02d}", i % 7, ["click", "purchase", "dismiss", "odd"][i % 4], i % 9, float(i % 11), ["v2", "", None][i % 3]) for i in range(300)]
    return spark.createDataFrame(rows, "event_id long, t string, session_id long, event_type string, item_id long, score double, variant string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")


def test_ingest_and_funnel_streams(spark, tmp_path):
    e = events(spark)
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    L.ingest_events(stream, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 225 and spark.read.parquet(str(tmp_path / "bad")).count() == 75
    q = L.live_funnel(stream, "10 days", "0 seconds").writeStream.outputMode("complete").format("memory").queryName("funnel").trigger(availableNow=True).start()
    q.awaitTermination()
    live = {r.variant: (r.clicks, r.impressions, r.purchases) for r in spark.table("funnel").groupBy("variant").agg(*[F.sum(c).alias(c) for c in ("clicks", "impressions", "purchases")]).collect()}
    batch = {r.variant: (r.clicks, r.impressions, r.purchases) for r in K.funnel(e, F.lit("2024-01-06").cast("timestamp")).collect()}
    assert live == batch and set(batch) == {"v2", "control"}


def clicks_with_items(spark, e, items):
    known = items.select("item_id", "price", "brand", "accords", "gender", F.lit(True).alias("known"))
    return e.where("event_type = 'click'").join(known, "item_id", "left").select(
        "session_id", "event_id", "ts", "score", F.col("price").cast("double").alias("price"), "brand", "accords", "gender", F.coalesce("known", F.lit(False)).alias("known"))


def profile_rows(df):
    cut = lambda x: None if x is None else round(x, 6)
    return {r.session_id: (r.n_clicks, cut(r.mean_score), cut(r.mean_price), r.price_band, list(r.top_brands or []), list(r.top_accords or []), r.gender) for r in df.collect()}


def test_session_stream_equals_batch_and_state_expires(spark, tmp_path):
    items = spark.createDataFrame([(i, [None, 50.0, 2000.0, 9000.0][i % 4], ["Ann", "Bo", None][i % 3], [["oud", "rose"], ["rose", "rose", None], [], None][i % 4], ["male", None, "female"][i % 3]) for i in range(7)],
        "item_id long, price double, brand string, accords array<string>, gender string")
    e = events(spark)
    clicks = clicks_with_items(spark, e, items)
    clicks.where("event_id < 200").repartition(3).write.parquet(str(tmp_path / "in"))
    out = {}

    def run(ttl, name):
        stream = spark.readStream.schema(clicks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = L.session_stream(stream, 5, ttl_ms=ttl).writeStream.outputMode("update").foreachBatch(lambda b, n: out.update(profile_rows(b))).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return max(sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress), sum(o["numRowsTotal"] for o in q.recentProgress[-1]["stateOperators"])

    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # processing time asks for one batch after another
    run(3_600_000, "long")
    assert out == profile_rows(K.session_profiles(e.where("event_id < 200"), items, keep=5))
    most, _ = run(2000, "short")
    out.clear()
    time.sleep(3)
    clicks.where("event_id = 204").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    _, left = run(2000, "short")
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert 0 < left < most / 2 and not out  # one click is left, too few for a profile


def merged_one_by_one(stored, batches, last):
    """Row by row: (item_id, brand, item, price, country, priority)."""
    rows = {(b, i): [k, b, i, p, c, s] for k, b, i, p, c, s in stored}
    for batch in batches:
        fresh = []
        for b, i, p, c, s, _ in sorted(batch, key=lambda r: r[5]):
            hit = rows.get((b, i)) or next((x for (sb, si), x in rows.items() if f"{sb}|{si}".lower() == f"{b}|{i}".lower()), None)
            if hit is None:
                rows[b, i] = new = [None, b, i, p, c, s]
                fresh.append(new)
            elif s >= hit[5]:
                hit[3:] = [p if p is not None else hit[3], c if c is not None else hit[4], s]
        for x in fresh:
            x[0] = -1
    return sorted(map(tuple, ((k if k <= last else -1, *rest) for k, *rest in rows.values())), key=str)


def test_merge_stream_in_buckets(spark, tmp_path):
    rnd, cols = random.Random(8), "brand string, item string, price int, country string, source_priority int"
    stored = [(k, f"b{k % 5}", f"Item {k}", rnd.choice([None, k]), "old", rnd.randint(0, 3)) for k in range(1, 40)]
    path, last = str(tmp_path / "catalog"), 39
    key = L.normal_key(F.col("brand"), F.col("item"))
    L.create_catalog(spark.createDataFrame(stored, f"item_id long, {cols}").withColumn("normalized_key", key), path, 16)
    batches = []
    for n in range(3):
        picked = [rnd.randint(1, 60) for _ in range(5 if n else 25)]
        batches.append([(f"b{k % 5}", rnd.choice([f"Item {k}", f"item {k}"]), rnd.choice([None, 100 * n + j]), rnd.choice([None, f"c{n}"]), rnd.randint(0, 3), j) for j, k in enumerate(picked)])
    frames = [spark.createDataFrame(b, f"{cols}, load_order long").withColumn("normalized_key", key) for b in batches]
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "catalog/data").rglob("*.parquet")}
    L.merge_batch(frames[0], 0, path)
    kept = [p for p, t in before.items() if p.exists() and p.stat().st_mtime_ns == t]
    got = lambda: sorted(((r.item_id if r.item_id <= last else -1, r.brand, r["item"], r.price, r.country, r.source_priority) for r in spark.read.parquet(f"{path}/data").collect()), key=str)
    assert got() == merged_one_by_one(stored, batches[:1], last)
    L.merge_batch(frames[0].withColumn("price", F.lit(-5)), 0, path)  # a repeated batch does nothing
    assert got() == merged_one_by_one(stored, batches[:1], last)
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    L.merge_stream(stream, path, str(tmp_path / "c")).awaitTermination()
    assert got() == merged_one_by_one(stored, batches, last)
    ids = [r.item_id for r in spark.read.parquet(f"{path}/data").collect()]
    assert len(ids) == len(set(ids)) and max(ids) == len(ids)
    L.merge_batch(frames[2].limit(1), 7, path)
    after = {p for p in (tmp_path / "catalog/data").rglob("*.parquet")}
    assert len(kept) <= len(before) and len(after) >= 1


def test_staged_batch_is_put_in_place_again(spark, tmp_path):
    path, cols = str(tmp_path / "catalog"), "brand string, item string, price int, source_priority int"
    key = L.normal_key(F.col("brand"), F.col("item"))
    L.create_catalog(spark.createDataFrame([(1, "a", "b", 1, 1), (2, "c", "d", 2, 1)], f"item_id long, {cols}").withColumn("normalized_key", key), path, 4)
    batch = spark.createDataFrame([("a", "b", 9, 1, 1)], f"{cols}, load_order long").withColumn("normalized_key", key)
    L.merge_batch(batch, 0, path)
    # as if the driver had died between the new buckets and the mark
    import shutil

    shutil.rmtree(tmp_path / "catalog/commits/batch=0")
    L.merge_batch(batch, 0, path)
    assert sorted((r.item_id, r.price) for r in spark.read.parquet(f"{path}/data").collect()) == [(1, 9), (2, 2)]


def test_embed_stream(spark, tmp_path):
    rows = "item_id long, text string, embedding array<float>, last_embedded_at timestamp, updated_at timestamp"
    spark.createDataFrame([(1, "x y", None, None, None), (2, "z", [1.0], None, None)], rows).write.parquet(str(tmp_path / "e"))
    done = []
    L.embed_stream(spark.readStream.schema(rows).parquet(str(tmp_path / "e")), lambda df, n: done.extend(df.collect()), str(tmp_path / "c2"), size=16).awaitTermination()
    assert sorted(r.item_id for r in done) == [1, 2] and all(len(r.embedding) == 16 and r.last_embedded_at for r in done)


def test_many_weight_vectors(spark, monkeypatch):
    rnd = random.Random(9)
    fits = ("sim", "price", "gender")
    rows = [(r, i, rnd.randint(0, 3), rnd.choice([4, 6]), *(rnd.choice([0.0, 0.5, 1.0]) for _ in fits)) for r in range(12) for i in range(9)]
    scored = spark.createDataFrame(rows, "request_id long, item_id long, clicks int, impressions int, " + ", ".join(f"fit_{f} double" for f in fits)).repartition(4)
    weights = K.weight_grid(spark, 30)
    monkeypatch.setattr(K, "WEIGHT_BLOCK", 7)
    got = {r.vector_id: r.objective for r in K.evaluate_weights(scored, weights).collect()}
    for w in weights.collect():
        gain = shown = 0.0
        for request in range(12):
            own = sorted(((-round(sum(w[f] * x for f, x in zip(fits, r[4:])), 12), r[1], r[2]) for r in rows if r[0] == request and r[3] >= 5))
            gain += sum(c / math.log2(n + 2) for n, (_, _, c) in enumerate(own))
            shown += sum(r[3] for r in rows if r[0] == request and r[3] >= 5)
        fine = sum(0.0 if 0.02 <= w[f] <= 0.4 else 0.01 * abs(w[f] - 0.2) for f in fits)
        assert abs(got[w["vector_id"]] - (gain / shown - fine)) < 1e-9


def test_variant_weights_and_slots(spark):
    got = spark.createDataFrame([('v2_{"sim": 0.5}',), ("v2_{bad",), ("control",)], "v string").select(K.variant_weights(F.col("v"))["sim"].alias("x")).collect()
    assert [r.x for r in got] == [0.5, 0.07, 0.07]
    slot = spark.range(1).select(C.next_slot(F.array(F.lit("scenario")), F.array(F.lit("gender")), F.lit(False)).alias("x")).first().x
    assert slot == "budget"


def test_price_phrases(spark):
    v = lambda p, b: spark.range(1).select(E.price_phrase(F.lit(p).cast("double"), F.lit(b).cast("double")).alias("x")).first().x
    assert [v(None, 100), v(50, None), v(150, 100), v(50, 100), v(90, 100)] == ["No price is known.", "It costs ₹50.", "At ₹150 it is above the budget.", "At ₹50 it leaves ₹50.", "At ₹90 it is within the budget."]
