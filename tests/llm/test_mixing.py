import itertools
import random

import duckdb
from pyspark.sql import functions as F

from tagloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def filled(sizes, total, weights=(5, 2, 1)):
    """Targets by sharing out the excess again and again, one source list in order."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    full = set()
    while True:
        rest, ws = 1.5 * total - sum(2 * sizes[s] for s in full), sum(w[s] for s in sizes if s not in full)
        over = {s for s in sizes if s not in full and w[s] * rest / ws > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else w[s] * rest / ws for s in sizes}
        full |= over


def corpus(rnd, n, sources):
    return [(i, rnd.choice([None, "", " \t", "a b\vc", " ".join("w" * rnd.randint(1, 60))]), rnd.choice(sources), "x") for i in range(n)]


def test_targets_sums_and_bounds(spark):
    rnd = random.Random(1)
    for sources in (["a", "b", "é", "z", None, "B"], ["s"], ["hot"] * 6 + ["t", "u", "v"]):
        rows = corpus(rnd, 300, sources)
        rows += rows[:5] + [(7, "twice the id", "a", "x"), (None, "no id at all", sources[0], None), (999, "v " * 30_000, sources[0], "x")]
        got = mixing.mixing_digest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
        plain = [(d, len((t or "").split()), s) for d, t, s, _ in rows]
        assert sorted(map(str, ((r["doc_id"], r["size"]) for r in got))) == sorted(map(str, ((d, n) for d, n, _ in plain)))
        order = sorted({s for _, _, s in plain if s is not None}, key=lambda s: s.encode()) + ([None] if any(s is None for _, _, s in plain) else [])
        sizes = {s: sum(n for _, n, x in plain if x == s) for s in order}
        target = filled(sizes, sum(sizes.values()))
        by = {(sizes[s], round(target[s], 6)): 0 for s in order}
        for r in got:
            assert 0 <= r["taken"] <= 2 * r["size"]
            by[r["source_size"], round(r["target"], 6)] += r["taken"]
        assert all(abs(taken - t) <= 0.5 for (_, t), taken in by.items())


def test_same_as_sql_with_ties_and_repeats(spark):
    rows = corpus(random.Random(2), 200, ["a", "b", None, "c"]) + [(5, "again and again", "a", "x")] * 40
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(rows, SCHEMA).toArrow())
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    want = sorted(con.sql(mixing.ORACLE).select(",".join(cols)).fetchall())
    for parts in (1, 5):
        got = mixing.mixing_digest(spark.createDataFrame(rows, SCHEMA).repartition(parts)).select(cols).collect()
        assert sorted(map(tuple, got)) == want


def test_flow_is_the_cheapest_of_all(spark):
    """Against every integer flow of small networks."""
    rnd = random.Random(3)
    for _ in range(60):
        patterns = {p: (rnd.randint(0, 3), m) for p, m in {"a": [0], "ab": [0, 1], "b": [1]}.items() if rnd.random() < 0.9}
        quotas = {s: rnd.randint(0, 6) for s in (0, 1)}
        give = mixing.min_cost_flow(patterns, quotas, 2)
        cost = lambda g: sum(max(0, g[p] - patterns[p][0]) for p in patterns)
        best = None
        for g in itertools.product(*(range(2 * patterns[p][0] + 1) for p in patterns)):
            g = dict(zip(patterns, g))
            rest = [max(0, g.get(p, 0) - 0) for p in ("a", "b")]
            fits = rest[0] <= quotas[0] and rest[1] <= quotas[1] and sum(g.values()) <= sum(quotas.values())
            if fits and (best is None or (-sum(g.values()), cost(g)) < best):
                best = (-sum(g.values()), cost(g))
        assert (-sum(give.values()), cost(give)) == best


def test_overlapping_sources_share_the_quotas(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join("w" * rnd.randint(1, 9)), rnd.choice([["a"], ["a", "b"], ["b", "a", "a"], ["c"], [], ["d", None], [None]])) for i in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()
    assert len(got) == 200 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    sizes = {s: sum(r["size"] for r in got if s in r["sources"]) for s in ["a", "b", "c", "d", None]}
    quota = {s: int(t + 0.5) for s, t in filled(sizes, total).items()}
    patterns = {}
    for r in got:
        key = str(sorted(set(r["sources"]), key=str))
        patterns.setdefault(key, [0, [list(sizes).index(s) for s in set(r["sources"])], 0])
        patterns[key][0] += r["size"]
        patterns[key][2] += r["taken"]
    want = mixing.min_cost_flow({k: (v[0], v[1]) for k, v in patterns.items()}, {i: quota[s] for i, s in enumerate(sizes)}, 2)
    assert sum(want.values()) == sum(v[2] for v in patterns.values())


def test_many_sources_meet_salted_documents(spark, monkeypatch):
    rows = corpus(random.Random(5), 150, [f"s{i}" for i in range(12)])
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, mixing.mixing_digest(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 3)
    assert sorted(map(tuple, mixing.mixing_digest(df).collect())) == want


def test_empty_tables_and_texts(spark):
    assert mixing.mixing_digest(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mixing.mixing_digest(spark.createDataFrame([(1, None, None, None), (2, "", "a", None)], SCHEMA)).where(F.lit(True)).collect()
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in got] == [(0, 0, 0.0, 0)] * 2
