import math
import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pandas as pd
import pytest

from tagloom.llm.ctw import Subtrees, _log_kt, _pack, _unpack, lm_scores, weigh_top


def log_kt(a, b):
    return sum(math.log((i + 0.5) / (i + 1)) for i in range(a)) + sum(math.log((j + 0.5) / (a + j + 1)) for j in range(b))


def plain_probability(grams, nodes, depth, context, byte):
    """Straight from the definition, for one byte after a context of ``depth`` bytes."""
    total = 1.0
    for bit in range(8):
        prefix = byte >> (8 - bit)

        @cache
        def count(ctx):
            out = [0, 0]
            for (c, x), n in grams.items():
                if (not ctx or c[-len(ctx) :] == ctx) and x >> (8 - bit) == prefix:
                    out[x >> (7 - bit) & 1] += n
            return tuple(out)

        def children(ctx):
            return [c for c in nodes if len(c) == len(ctx) + 1 and c[1:] == ctx]

        def rest(ctx):
            return tuple(x - sum(count(c)[i] for c in children(ctx)) for i, x in enumerate(count(ctx)))

        @cache
        def weighted(ctx):
            own = log_kt(*count(ctx))
            if not children(ctx):
                return own
            return np.logaddexp(own, sum(weighted(c) for c in children(ctx)) + log_kt(*rest(ctx))) - math.log(2)

        def predict(ctx):
            zero, one = count(ctx)
            own = (one + 0.5) / (zero + one + 1)
            if not children(ctx):
                return own
            stop = math.exp(log_kt(zero, one) - math.log(2) - weighted(ctx))
            longer = context[-len(ctx) - 1 :]
            if longer in nodes and len(longer) == len(ctx) + 1:
                return stop * own + (1 - stop) * predict(longer)
            zero, one = rest(ctx)
            return stop * own + (1 - stop) * (one + 0.5) / (zero + one + 1)

        p = predict(b"")
        total *= p if byte >> (7 - bit) & 1 else 1 - p
    return total


def code_of(context, byte):
    return int.from_bytes(context[::-1] + bytes([byte]), "big")


def test_tree_against_definition():
    rnd = random.Random(2)
    depth, data = 3, bytes(rnd.choice(b"abca bb") for _ in range(400))
    grams = Counter((data[i - depth : i], data[i]) for i in range(depth, len(data)))
    nodes = {c[depth - d :] for c, _ in grams for d in range(depth + 1)}
    asked = {code_of(c, x): (c, x) for c in (b"abc", b"bca", b"zzz", b"  b", b"zab") for x in b"abc z"}
    counts = {**dict.fromkeys(asked, 0), **{code_of(*g): n for g, n in grams.items()}}
    code = np.array(sorted(counts))
    halves = [code[code >> 24 < 98], code[code >> 24 >= 98]]  # two buckets
    trees = [Subtrees(h, np.array([counts[c] for c in h.tolist()]), depth) for h in halves]
    parts = pd.concat([pd.DataFrame(r, index=k) for k, r in (t.roots() for t in trees)])
    top = parts.groupby(level=0).sum()
    above = weigh_top(top.index.to_numpy(), top.to_numpy())
    value = {c: v for t in trees for c, v in zip(t.codes.tolist(), t.values(*above))}
    for c, (context, byte) in asked.items():
        assert 10.0 ** value[c] == pytest.approx(plain_probability(grams, nodes, depth, context, byte), rel=1e-9)


def test_kt_looks_up_as_it_computes():
    n = np.array([0, 1, 2, 100, 4094, 4095, 4096, 5000, 10**6], float)
    a, b = (x.ravel() for x in np.meshgrid(n, n))
    expected = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.lgamma(x + y + 1) - math.log(math.pi) for x, y in zip(a, b)]
    assert np.allclose(_log_kt(a, b), expected, atol=1e-8)


def test_packing_round_trip():
    key = np.array([-(2**63), -5, 0, 7, 2**63 - 1])
    got, n = _unpack(_pack(key, np.arange(5).astype("<u4")), "<u4")
    assert got.tolist() == key.tolist() and n.tolist() == [0, 1, 2, 3, 4]
    assert [len(x) for x in _unpack(_pack(key[:0], np.zeros(0, "<f8")), "<f8")] == [0, 0]


def test_scores_in_any_chunks(spark):
    """The whole chain against the definition, with texts cut in steps; chunks, buckets and partitions change nothing."""
    rnd = random.Random(5)
    texts = [" ".join(rnd.choices(["ab", "ba", "Abc", "c"], k=rnd.randint(1, 12))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = [" ".join(t.lower().split()).encode() + b"\n" for t in texts]
    grams = Counter()
    for i, t in enumerate(plain):
        if zlib.crc32(str(i).encode()) % 10:
            grams.update(((b"\n" * 3 + t)[j : j + 3], t[j]) for j in range(len(t)))
    nodes = {c[3 - d :] for c, _ in grams for d in range(4)}
    chance = cache(lambda c, x: math.log10(plain_probability(grams, nodes, 3, c, x)))
    expected = [sum(chance((b"\n" * 3 + t)[j : j + 3], t[j]) for j in range(len(t))) for t in plain]
    for parts, chunk, step in ((1, 16 << 20, 2 << 20), (5, 40, 7)):
        got = {r.doc_id: r.score for r in lm_scores(df.repartition(parts), 3, chunk, step).collect()}
        assert [got[i] for i in range(40)] == pytest.approx(expected, rel=1e-5)


def test_scores_against_plain(spark):
    rnd = random.Random(4)
    words = ["the", "The", "cat", "été", "x1", "sat", "zebra"]
    texts = [None, "", " \n", *(" ".join(rnd.choices(words + [f"w{i}"], k=rnd.randint(1, 30))) for i in range(60))]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double").repartition(3)
    got = {r.doc_id: r for r in lm_scores(df).collect()}
    token = [(t or "").encode().lower().split() + [b"\n"] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    c = Counter(w for i, ws in enumerate(token) if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in enumerate(token):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r.score < 0 and r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / (len(b" ".join(ws[:-1])) + 1), rel=1e-9)
    known, odd = got[texts.index(max(texts[3:], key=len))], "qqq jjj vvv kkk"
    assert known.score / known.n_tokens > -3
    assert odd not in texts


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b"), (None, None), (3, "a b"), (3, "a b")]
    got = lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and len({(r.score, r.base_score) for r in got if r.n_tokens == 3}) == 1
    assert lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
