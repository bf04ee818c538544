import random

import pytest

from tagloom.llm import simhash
from tagloom.llm.simhash import drop_near_duplicates, similar_components


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({b" ".join(words)} if words else set())


def plain_components(ids, texts):
    sets = [shingles(t) for t in texts]
    comp = list(ids)
    link = [(i, j) for i in range(len(ids)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0]
    while True:
        old = list(comp)
        for i, j in link:
            comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == old:
            return dict(zip(ids, comp))


def texts(seed):
    rnd = random.Random(seed)
    words = [f"W{i}é" for i in range(400)]
    passage = [rnd.choice(words) for _ in range(60)]
    out = [None, "", " \n", "one two", "One  TWO", "a b c d", "a b c d e"]
    for _ in range(25):
        w = [rnd.choice(words) for _ in range(rnd.randint(1, 150))] + (passage if rnd.random() < 0.6 else [])
        out.append(" ".join(w))
        for _ in range(5):
            v = list(w)
            for _ in range(rnd.randint(1, 4)):
                v[rnd.randrange(len(v))] = rnd.choice(words)
            out.append(" ".join(v))
    return out


@pytest.mark.parametrize("anchors,block", [(True, 2048), (True, 5), (False, 5)])
def test_components_against_brute_force(spark, monkeypatch, anchors, block):
    """Whatever the anchors find, and however tokens are cut into cells, no pair is lost."""
    ts = texts(anchors + block)
    ids = [3 * i + 1 for i in range(len(ts))]
    df = spark.createDataFrame(list(zip(ids, ts)), "doc_id long, text string").repartition(3)
    if not anchors:
        monkeypatch.setattr(simhash, "links", lambda fps, *_: fps.selectExpr("fp as a", "fp as b").limit(0))
    got = {r.doc_id: r.component_id for r in similar_components(df, block=block).collect()}
    assert got == plain_components(ids, ts)


def test_shingles_are_counted_over_all_texts(spark):
    """Which buckets are common, and in how many texts, from every text and not from one in four; counts of one byte and of two meet."""
    from collections import Counter

    import xxhash

    from tagloom.llm import jaccard

    rnd = random.Random(2)
    ts = [None, "", *(" ".join([f"p{rnd.randrange(8)}"] * 6 + (["all of them hold this"] if i % 2 else []) + [f"w{rnd.randrange(300)}" for _ in range(4)]) for i in range(900))]
    df = spark.createDataFrame([(t,) for t in ts + ["q " * 9] * 70_000], "text string")
    want = Counter(xxhash.xxh64_intdigest(x, 42) % jaccard._BUCKETS for t in ts for x in shingles(t))
    want[xxhash.xxh64_intdigest(b"q q q q q", 42) % jaccard._BUCKETS] += 70_000
    mean = sum(want.values()) / jaccard._BUCKETS
    buckets, counts = jaccard._common(df.repartition(5), 5)
    got = dict(zip(buckets.tolist(), counts.tolist()))
    assert got == {k: n for k, n in want.items() if n > 1 + mean + 3 * mean**0.5} and {450, 70_000} <= set(got.values())
    assert [len(x) for x in jaccard._common(df.limit(0), 5)] == [0, 0]


def test_pairs_of_far_fingerprints_go(spark):
    """Similar texts whose 3-word fingerprints differ in more than three bits."""
    from tagloom.llm.simhash import fingerprint

    rnd = random.Random(8)
    base = [f"w{rnd.randrange(5000)}" for _ in range(120)]
    rows = [(1, " ".join(base))]
    while len(rows) < 4:
        v = list(base)
        v[rnd.randrange(10, 110)], v[rnd.randrange(10, 110)] = "x", "y"
        t = " ".join(v)
        if 5 * len(shingles(t) & shingles(rows[0][1])) >= 4 * len(shingles(t) | shingles(rows[0][1])) and (fingerprint(t) ^ fingerprint(rows[0][1])).bit_count() > 3:
            rows.append((len(rows) + 1, t))
    rows.append((None, rows[0][1]))
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, lang string")
    got = drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == [1, None]
    assert drop_near_duplicates(df.limit(0)).count() == 0


def test_texts_of_one_id_are_judged_apart(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "quite another text of several words"), (2, "quite another text of several words"), (3, None), (4, " ")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, id int, of_text int")
    got = sorted((r.doc_id, r.text) for r in drop_near_duplicates(df).collect())
    assert got == [(1, rows[0][1]), (2, rows[2][1]), (2, rows[2][1]), (3, None)] and drop_near_duplicates(df).columns == df.columns
