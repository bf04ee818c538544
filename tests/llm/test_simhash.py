import random

import numpy as np
import xxhash

from tagloom.llm.simhash import anchors, fingerprint, links, simhash_components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def plain_components(ids, fps):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return {ids[i]: min(ids[j] for j in range(len(ids)) if find(j) == find(i)) for i in range(len(ids))}


def texts(seed=1):
    rnd = random.Random(seed)
    words = [f"Word{i}é" for i in range(80)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 120))) for _ in range(25)]
    out = [None, "", " \n\t ", "ONE two", "one TWO", "a b c", "a b c d"]
    for t in base:
        w = t.split()
        out.append(t)
        for _ in range(4):
            v = list(w)
            v[rnd.randrange(len(v))] = rnd.choice(words)
            out.append(" ".join(v))
    return [*out, " ".join(words * 3000)]


def test_fingerprint_matches_definition():
    for t in texts()[:-1]:
        assert fingerprint(t) == plain_fingerprint(t)


def test_covering_finds_every_partner():
    rnd = random.Random(3)
    for _ in range(300):
        x = rnd.getrandbits(64)
        y = x
        for b in rnd.sample(range(64), 3):
            y ^= 1 << b
        key, at, home = anchors(np.array([x, y], np.uint64))
        homes = set(key[home & (at == 0)])
        assert homes & set(key[at == 1])
        assert len(key) <= 68


def test_components_against_brute_force(spark):
    ts = texts()
    rows = [(i * 3 + 1, t, "x") for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = simhash_components(df).collect()
    fps = [plain_fingerprint(t) for t in ts[:-1]] + [fingerprint(ts[-1])]
    want = plain_components([r[0] for r in rows], fps)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {r[0]: f"{f:016x}" for r, f in zip(rows, fps)}


def test_large_cells_are_dealt_into_blocks(spark):
    rnd = random.Random(5)
    fps = {0}
    while len(fps) < 400:
        x = rnd.choice(sorted(fps)[:50])
        for b in rnd.sample(range(64), rnd.randint(1, 4)):
            x ^= 1 << b
        fps.add(x)
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for block in (4096, 7):
        edges = [(r.a, r.b) for r in links(df, 3, block).collect()]
        group = {f: f for f in signed}

        def find(f):
            while group[f] != f:
                f = group[f]
            return f

        for a, b in edges:
            group[find(a)] = find(b)
        ids = list(range(len(signed)))
        want = plain_components(ids, [f & (2**64 - 1) for f in signed])
        lowest = {}
        for i, f in enumerate(signed):
            lowest[find(f)] = min(lowest.get(find(f), i), i)
        assert {i: lowest[find(f)] for i, f in enumerate(signed)} == want


def test_nulls_repeats_and_empty(spark):
    schema = "doc_id long, text string"
    rows = [(None, "p q r s"), (4, "p q r s"), (4, "p q r s"), (None, None), (9, "z")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash_components(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (None, None), (9, 9)], key=str)
    assert simhash_components(spark.createDataFrame([], schema)).count() == 0
