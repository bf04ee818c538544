import math

from pyspark.sql import functions as F

from tagloom.operators import rank as W
from tagloom.plans import catalog_queries as Q


def test_scores_round_as_doubles_do(spark):
    halves = [i / 1000 + 0.0005 for i in range(2000)]
    got = [r.x for r in spark.createDataFrame([(x,) for x in halves], "x double").select(W.decimals(F.col("x"), 3).alias("x")).collect()]
    assert got == [math.floor(x * 1000 + 0.5) / 1000 for x in halves]


def test_equal_prices_go_by_the_shown_score(spark, monkeypatch):
    rows = [(1, 7, 60.0, 900.0, 901.0), (1, 240, 50.0004, 900.0, 901.0), (1, 8, 50.0003, 900.0, 901.0), (1, 120, 50.0001, 900.0, 901.0)]
    monkeypatch.setattr(Q, "scored", lambda *_: spark.createDataFrame(rows, "request_id long, item_id long, score double, price double, budget double"))
    assert [(r.item_id, r["rank"], r.score) for r in Q.repriced_picks(spark, "").orderBy("rank").collect()] == [(120, 1, 35.0), (240, 2, 35.0)]
