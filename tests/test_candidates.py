from pyspark.sql import functions as F

import __spark_entry__ as entry
from tagloom.plans.tables import catalog, requests

SF = "/root/testdata/sf0.001"


def test_predicates_see_the_whole_catalogue(spark):
    got = {r.request_id: r.n_items for r in entry.queries()["candidate_predicates"](spark, SF).collect()}
    items = catalog(spark, SF).select("item_id", "price", "brand", "gender", "accords", "notes").collect()
    banned = ("oud", "bergamot")
    items = [i for i in items if not any(b in (t or "").lower().split() for t in [*i.accords, *i.notes] for b in banned)]
    want = {}
    for r in requests(spark, SF).select("request_id", "budget", "gender").collect():
        house = f"brand#{r.request_id % 25}"
        want[r.request_id] = sum(
            (r.budget is None or i.price <= r.budget)
            and i.item_id != r.request_id
            and not (house in i.brand.lower() or i.brand.lower() in house)
            and (r.gender is None or i.gender in (None, "unisex", r.gender))
            for i in items
        )
    assert got == want and max(got.values()) > len(items) // 50


def test_counts_with_unknown_values(spark):
    from tagloom.operators.retrieve import count_passing

    items = spark.createDataFrame([(1, 5.0, "a", "male"), (2, None, "b", None), (3, 9.0, None, "female"), (None, 1.0, "c", "male")], "item_id long, price double, brand string, gender string")
    asked = spark.createDataFrame([(1, 5.0, None, "z"), (7, 5.0, None, "z"), (8, None, "male", "z"), (9, None, None, "b"), (10, 1.0, None, None)], "request_id long, budget double, wanted string, house string")
    assert {r.request_id: r.n_items for r in count_passing(asked.withColumn("reference_id", F.col("request_id")), items).collect()} == {1: 0, 7: 1, 8: 2, 9: 2, 10: 0}


def test_alike_requests_and_items_meet_once(spark, monkeypatch):
    from tagloom.operators import blocks as B

    pairs, met = B._block_pairs, []
    monkeypatch.setattr(B, "_block_pairs", lambda *a: met.append(pairs(*a)) or met[-1])
    items = spark.range(6000).select(F.col("id").alias("item_id"), (F.col("id") % 5).cast("double").alias("price"), F.lit("male").alias("gender"), F.lit("a").alias("brand"))
    asked = spark.range(3000).select(F.col("id").alias("request_id"), (F.col("id") % 3).cast("double").alias("budget"), F.col("id").alias("reference_id"))
    got = {r.request_id: r.n_items for r in B.count_passing(asked, items).collect()}
    assert got == {i: 1200 * (i % 3 + 1) - (i % 5 <= i % 3) for i in range(3000)}
    assert sum(len(r.ids) * len(r.q_ids) for r in met[0].collect()) <= 15
