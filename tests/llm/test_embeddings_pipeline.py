import numpy as np
import pytest

import corpus_pipeline
from tagloom.llm import entry
from tagloom.llm.embedjoin import embedding_components
from tagloom.llm.quality import quality_scores

from .test_near_duplicates import plain_components

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("cell, pivots", [(4096, None), (4096, 1), (40, 12), (9, 5)])
def test_range_join_against_brute_force(spark, cell, pivots):
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(40, 8))
    x = np.concatenate([base, *(base[:12] + rnd.normal(size=(12, 8)) * s for s in (0.02, 0.1, 0.2, 0.3)), base[:3], base[5:6] * 1e-200])
    rows = [(i * 2 + 1, v.tolist(), i % 3) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [None] + [1.0] * 7), (1004, [float("inf")] + [1.0] * 7), (1005, [float("nan")] * 8), (1006, [1.0] * 7)]
    df = spark.createDataFrame(rows + [(*o, 0) for o in odd], "vec_id long, embedding array<double>, n_links int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_components(df, 0.9, cell, pivots).collect()}
    u = x / np.abs(x).max(1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.array([comp[link[i]].min() for i in range(len(x))])
    want = {rows[i][0]: (int(link[i].sum()) - 1, rows[comp[i]][0], comp[i] == i) for i in range(len(x))}
    assert got == want | {i: (0, i, True) for i, _ in odd}


def test_range_join_repeats_and_nothing(spark):
    df = spark.createDataFrame([(4, [1.0, 2.0]), (4, [1.0, 2.0]), (None, [2.0, 4.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding_components(df).collect()), key=str)
    assert got == sorted([(4, 2, 4), (4, 2, 4), (None, 2, 4), (2, 0, 2)], key=str)
    assert embedding_components(df.limit(0)).count() == 0


def test_range_join_with_a_hot_vector(spark):
    """Half of the rows hold one vector; signed zeros are one entry; no row is lost at the join with its class."""
    x = [[1.0, 0.0, 0.0]] * 600 + [[1.0, -0.0, 0.0]] * 2 + [[float(i), 1.0, 5000.0 - i] for i in range(500)] + [None] * 100
    rows = [(i + 1, v) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_components(df, 0.999).collect()}
    u = np.array([v for v in x if v])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.999
    comp = np.arange(len(u))
    while (new := np.array([comp[row].min() for row in link])).tolist() != comp.tolist():
        comp = new
    assert got == {i + 1: (int(link[i].sum()) - 1, int(comp[i]) + 1) for i in range(len(u))} | {i + 1: (0, i + 1) for i in range(len(u), len(x))}


def test_stages(spark, tmp_path):
    """Each stage on its own input: what goes is what its operator names; columns stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        new = spark.read.parquet(str(tmp_path / str(k)))
        before, after = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in new.select("doc_id").collect()}
        if k == 0:
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            assert before - after == {r.doc_id for r in quality_scores(docs, labels).where("predicted = 0").collect()}
        elif k == 1:
            assert before == after
        elif k == 2:
            rows = docs.select("doc_id", "text").collect()
            assert after == set(plain_components([r.doc_id for r in rows], [r.text for r in rows]).values())
        elif k == 3:
            from tagloom.llm.decontam import contaminated

            assert before - after == {r.doc_id for r in contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
        if k < 4:
            assert new.columns == columns
        docs = new
    last = {(r.doc_id, r.start, r.ids_crc32) for r in docs.collect()}
    assert {(r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()} == last and last


def test_entry_names():
    assert [k.split("_")[0] for k in entry.queries()] == [f"op{i}" for i in range(1, 11)]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stages_of_odd_rows(spark, tmp_path):
    """Nulls, empty, blank and very long texts, repeated ids and columns with odd names pass through every stage; so does an empty table."""
    long = " ".join(f"long{i % 700} text{i % 31}." for i in range(60_000))
    rows = [(None, None, "en", "s1", 0), (1, "", None, "s1", 0), (2, " \n ", "en", None, 3), (3, long, "en", "s2", 9), (4, "same words here in both of them", "de", "s1", 5), (4, "same words here in both of them", "de", "s1", 5), (4, "another text of that id", "de", "s3", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key string, _gone int, key int, pos int, shard int"
    for table in (rows, []):
        docs = spark.createDataFrame([(*r, "k", 1, 2, 3, 4) for r in table], schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{len(table)}_{k}")
            stage(spark, docs, SF).write.parquet(path)
            new = spark.read.parquet(path)
            assert k == 4 or (new.columns == docs.columns and new.select("_key").distinct().count() == min(1, new.count()))
            docs = new
        assert docs.count() > 0 or not table
