import __spark_entry__ as entry


def test_ceiling_comes_before_the_nearest(spark, tmp_path):
    """Only the items of the farthest vectors are under the ceiling; the page is full all the same."""
    n = 300
    spark.createDataFrame([(i, [1.0, i / n], 0) for i in range(n)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    parts = [(i, f"Brand#{i % 25}", "red ring", 900.0 if i >= 280 else 2000.0, "PROMO", 1) for i in range(n)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string, p_retailprice double, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    page = entry.queries()["budget_slice"](spark, str(tmp_path)).where("request_id = 0").collect()
    assert len(page) == 10 and all(r.item_id >= 280 for r in page)
