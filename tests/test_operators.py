import random

import pytest
from pyspark.sql import functions as F

from tagloom import vocab
from tagloom.functions.text import strings
from tagloom.operators import enrich as X
from tagloom.operators import merge as D
from tagloom.operators import rank as W
from tagloom.operators import retrieve as R
from tagloom.operators import score as S


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]



def test_families(spark):
    tags = ["Sicilian Lemon", "Indonesian Patchouli Leaf", "Oud", "Vetiver", "Pink Pepper", "Nothing"]
    got = {r.tag: r.family for r in X.tag_families(spark.createDataFrame([(t,) for t in tags], "tag string"), vocab.taxonomy(spark)).collect()}
    assert [got[t.lower()] for t in tags] == ["citrus", "earthy", "earthy", "woody", "spicy", None]


def test_tiers_and_buckets(spark):
    items = spark.createDataFrame([(1, ["bergamot", "rose", "musk"])], "item_id long, notes array<string>")
    r = X.note_tiers(items, vocab.taxonomy(spark)).first()
    assert (r.top, r.heart, r.base) == (["bergamot"], ["rose"], ["musk"])
    a = one(spark, X.accord_tiers(strings("woody", "marine", "floral")))
    assert (a.top, a.heart, a.base) == (["marine"], ["floral"], ["woody"])
    assert [one(spark, X.wear_label(F.lit(x).cast("double"))) for x in (None, 10, 69, 70, 95)] == ["Unknown", "2-4 hours", "6-8 hours", "8-10 hours", "10+ hours"]
    assert [one(spark, X.projection_label(F.lit(x).cast("double"))) for x in (None, 10, 50, 90)] == ["unknown", "light", "moderate", "strong"]
    assert [one(spark, X.age_bracket(F.lit(x))) for x in (20, 25, 40, 41)] == ["under_25", "25_40", "25_40", "40_plus"]


def test_scenario_performance(spark):
    r = spark.createDataFrame([(1, ["office", "party"]), (2, ["wedding"]), (3, ["not-real", "gym"])], "request_id long, scenarios array<string>")
    got = {x.request_id: (x.hours, x.projection) for x in X.scenario_performance(r, vocab.scenario_defaults(spark)).collect()}
    assert got == {1: (8, "light"), 2: (10, "strong"), 3: (4, "light")}


@pytest.mark.parametrize("kind, want", [("Extrait de Parfum", (80.5, 59.5)), ("Eau de Parfum", (75.6, 65.1)), ("Eau de Toilette", (63.0, 77.0)), ("Eau de Cologne", (52.5, 80.5)), ("Body Spray", (35.0, 49.0)), (None, (70.0, 70.0))])
def test_adjusted(spark, kind, want):
    assert tuple(one(spark, X.adjusted(F.lit(70.0), F.lit(70.0), F.lit(kind).cast("string")))) == want


def test_fits(spark):
    v = lambda c: one(spark, c)
    assert [v(S.price_fit(F.lit(p), F.lit(1000.0), F.lit(d))) for p, d in ((900.0, False), (1500.0, False), (200.0, True))] == [0.9, 0.0, 0.8]
    assert v(S.gender_fit(F.lit("male"), F.lit("female"))) == 0.4
    assert v(S.gender_leaning(F.lit("unisex"), F.lit("male"), strings("floral", "sweet"), strings("Rose", "Jasmine"))) == 0.85
    assert v(S.scenario_fit(strings("citrus", "fresh"), strings(), strings("gym"))) == pytest.approx(0.7)
    assert v(S.scenario_fit(strings(), strings("Sicilian Lemon", "mint", "tea"), strings("gym"))) == pytest.approx(0.3)
    assert v(S.family_fit(strings(), strings("bergamot"), strings("citrus", "woody"))) == 0.5
    yes, no = F.lit(True), F.lit(False)
    assert [v(S.bridge_fit(a, b, x, yes)) for a, b, x in ((yes, yes, strings()), (yes, no, strings()), (no, no, strings()), (no, no, strings("citrus", "woody")))] == [1.0, 0.5, 0.2, 1.0]
    assert v(S.negated_hit(strings("vanilla"), strings(), strings("vanilla"))) == "vanilla" and v(S.negated_hit(strings(), strings("Tonka Bean"), strings("tonka"))) == "tonka"
    assert v(S.fuzzy_jaccard(strings("Jasmine", "Rose"), strings("Moroccan Jasmine", "Musk"))) == pytest.approx(1 / 3)
    assert [v(S.identity_boost(F.lit(q), F.lit("Dior"), F.lit("Sauvage"))) for q in ("Dior Sauvage", "want Dior Sauvage now", "sauvage by dior", "sauvage", "dior", "ab", "notice")] == [35, 30, 25, 15, 8, 0, 0]


def test_blend(spark):
    lit = lambda d: {k: F.lit(float(x)) for k, x in d.items()}
    v = lambda f, a: round(one(spark, S.blend(lit(f), {k: F.lit(x) for k, x in a.items()})), 1)
    off = {"scenario": False}
    assert v({"sim": 0, "note": 0, "scenario": 1}, off) == 0 and v({"sim": 1, "note": 1, "scenario": 1}, off) == 100
    assert v({"sim": 0, "note": 0, "scenario": 1}, {"scenario": True}) == 50.9
    worked = {"sim": 0.62, "note": 0.8, "scenario": 1, "longevity": 1, "bridge": 1}
    assert v(worked, {k: True for k in ("scenario", "longevity", "bridge")}) in (92.6, 92.7)


def test_relaxing_cap_against_greedy(spark):
    rnd, rows, want = random.Random(6), [], {}
    for q in range(60):
        keys = [rnd.choice("ABCD") for _ in range(rnd.randint(1, 12))]
        limit = rnd.randint(1, 8)
        rows += [(q, i + 1, k, limit) for i, k in enumerate(keys)]
        kept, picked = [], {}
        for cap in range(2, max(limit, 2) + 1):
            for i, k in enumerate(keys):
                if i not in kept and picked.get(k, 0) < cap and len(kept) < limit:
                    picked[k] = picked.get(k, 0) + 1
                    kept.append(i)
        want[q] = sorted(kept)
    df = spark.createDataFrame(rows, "request_id long, rank int, key string, lim int").withColumn("item_id", F.col("rank"))
    got = {}
    for r in W.relaxing_cap(df, F.col("key"), 2, F.col("lim")).collect():
        got.setdefault(r.request_id, []).append(r.item_id - 1)
    assert {q: sorted(x) for q, x in got.items()} == want


def test_priority_fold_against_loop(spark):
    rnd, rows = random.Random(8), []
    for i in range(300):
        rows.append((rnd.choice("abcdefgh"), i, rnd.randint(0, 5), rnd.choice(["", "x", "y", None]), [rnd.choice("pqr") for _ in range(rnd.randint(0, 3))]))
    df = spark.createDataFrame(rows, "key string, load_order long, source_priority int, country string, notes array<string>")
    want = {}
    for key, order, prio, country, notes in rows:
        old = want.get(key)
        if old is None:
            want[key] = [order, prio, country, notes]
        elif prio > old[1]:
            want[key] = [order, prio, country if country else old[2], list(dict.fromkeys(old[3] + notes))]
    got = {r.key: [r.load_order, r.source_priority, r.country or None, r.notes] for r in D.priority_fold(df, "key", ["country"], ["notes"]).collect()}
    assert got == {k: [a, b, c or None, n] for k, (a, b, c, n) in want.items()}


def test_merge(spark):
    cols = "brand string, item string, price int, source_priority int, normalized_key string"
    stored = spark.createDataFrame([(1, "Dior", "Sauvage", 10, 1, "dior|sauvage"), (2, "A", "b", 5, 5, "a|b"), (3, "C", "d!", 1, 0, "c|d"), (4, "C", "d", 1, 0, "c|d")], f"item_id long, {cols}")
    batch = spark.createDataFrame([("Dior", "sauvage!", 12, 5, "dior|sauvage", 1), ("A", "b", 9, 1, "a|b", 2), ("C", "D", 7, 0, "c|d", 3), ("A", "b", None, 5, "a|b", 4)], f"{cols}, load_order long")
    got = {(r.brand, r.item): (r.item_id, r.price) for r in D.merge(stored, batch).collect()}
    assert got == {("Dior", "Sauvage"): (1, 12), ("A", "b"): (2, 5), ("C", "d!"): (3, 1), ("C", "d"): (4, 1), ("C", "D"): (5, 7)}


def test_named_items(spark):
    items = spark.createDataFrame([(1, "Creed", "Aventus", ["a"]), (2, "Creedfor", "Aventus", []), (3, "Dior", "Sauvage", ["a"]), (4, "Christian Dior", "Sauvage", ["b"]), (5, "YSL", "Legend", ["a"]), (6, "Prada", "Legend", ["a"])], "item_id long, brand string, item string, notes array<string>")
    asked = spark.createDataFrame([(1, "creed aventus please"), (2, "dupe for sauvage"), (3, "like legend"), (4, "diorr sauvagge")], "request_id long, text string")
    got = {r.request_id: (r.item_id, r.tier) for r in R.named_items(asked, items).collect()}
    assert got[1] == (1, 1) and got[2][0] in (3, 4) and 3 not in got and got[4][0] in (3, 4) and got[4][1] >= 3


def test_same_house_and_sizes(spark):
    names = {("creed", "creedfor"): True, ("dior", "christian dior", "diorfor"): True, ("ysl", "ysla"): False, ("ysl", "nicole farhi", "prada"): False, ("one",): True}
    assert {k: one(spark, R.same_house(strings(*k))) for k in names} == names
    assert [one(spark, R.pool_size(F.lit(n))) for n in (1, 5, 40, 60, 100)] == [500, 500, 600, 900, 1000]


def test_top_k_with_odd_vectors(spark):
    v = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [2.0, 0.0]), (7, [float("nan"), 1.0])]
    df = spark.createDataFrame(v, "item_id long, vec array<double>")
    got = [(r.item_id, round(r.sim, 4)) for r in R.top_k(df.where("item_id = 1").withColumnRenamed("item_id", "request_id"), df, 3).orderBy("rank").collect()]
    assert got == [(1, 1.0), (6, 1.0), (2, 0.7071)]


def test_merge_against_row_by_row(spark):
    """Several rows a target, several spellings a key, nulls: as a loop over the batch does it."""
    import random

    schema = "brand string, item string, price int, country string, kind string, source_priority int, normalized_key string"
    rnd = random.Random(3)
    names = [("Dior", "Sauvage"), ("dior", "sauvage!"), ("Dior", "SAUVAGE"), ("Creed", "Aventus"), ("creed", "aventus"), ("Zara", "Red"), ("zara", "red"), ("Zara", "red!")]
    key = lambda b, i: f"{b.lower()}|{i.lower().strip('!')}"
    maybe = lambda x: x if rnd.random() < 0.7 else None
    row = lambda b, i: (b, i, maybe(rnd.randrange(100)), maybe(rnd.choice("xyz")), maybe(rnd.choice("kl")), rnd.choice([None, 0, 1, 2, 3]), key(b, i))
    for _ in range(6):
        held = [(n + 1, *row(*x)) for n, x in enumerate(rnd.sample(names, rnd.randint(0, 4)))]
        batch = [(*row(*rnd.choice(names)), n) for n in range(14)]
        want = {x[0]: list(x[1:]) for x in held}
        for *r, _ in batch:
            same = [k for k, v in want.items() if v[:2] == r[:2]]
            known = [k for k, v in want.items() if r[6] is not None and v[6] == r[6]]
            k = same[0] if same else known[0] if len(known) == 1 else None
            if k is None:
                want[max(want, default=0) + 1] = list(r)
            elif (r[5] or 0) >= (want[k][5] or 0):
                old = want[k]
                want[k] = [*old[:2], *[n if n is not None else o for n, o in zip(r[2:4], old[2:4])], *r[4:]]
        stored = spark.createDataFrame(held, "item_id long, " + schema)
        out = D.merge(stored, spark.createDataFrame(batch, schema + ", load_order int")).collect()
        assert len({r.item_id for r in out}) == len(out)
        yes = lambda rows: sorted(map(str, rows))
        got = yes(tuple(r[c] for c in ("brand", "item", "price", "country", "kind", "source_priority", "normalized_key")) for r in out)
        assert got == yes(tuple(v) for v in want.values())
