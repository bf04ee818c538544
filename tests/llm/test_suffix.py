import hashlib
import random

import numpy as np
import pytest

from tagloom.llm import suffix
from tagloom.llm.suffix import long_prefixes, remove_repeats, repeats_digest, sort_suffixes


def plain_repeats(texts: list[str | None], length: int = 200) -> list[tuple[int, int, int, str]]:
    """The same for a few texts, straight from the definition: (n_bytes, n_removed, n_spans, SHA-256)."""
    raws = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for raw in raws:
        for p in range(len(raw) - length + 1):
            seen[raw[p : p + length]] = seen.get(raw[p : p + length], 0) + 1
    out = []
    for raw in raws:
        mask = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if seen[raw[p : p + length]] > 1:
                mask[p : p + length] = True
        kept = bytes(c for c, m in zip(raw, mask) if not m)
        out.append((len(raw), int(mask.sum()), int((mask & ~np.r_[False, mask[:-1]][: len(mask)]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_common_prefixes_against_plain():
    rnd = np.random.default_rng(1)
    for kinds, n, least in ((2, 60, 5), (4, 200, 7), (30, 50, 3), (3, 150, 20)):
        t = rnd.integers(1, kinds + 1, n)
        t = np.r_[t, t[10:40], [0]]
        order = sort_suffixes(t, least)
        turned = [tuple(np.roll(t, -i)[:least]) for i in order]
        assert turned == sorted(turned)
        joined = long_prefixes(t, order, least)
        assert joined.tolist() == [False, *(a == b for a, b in zip(turned, turned[1:])), False]


def corpus(seed):
    rnd = random.Random(seed)
    words = ["the", "ñandú", "x", "lorem", "ipsum", "été", "a" * 9, "\n"]
    make = lambda n: " ".join(rnd.choice(words) + str(rnd.randrange(300)) for _ in range(n))
    shared = [make(rnd.randint(8, 40)) for _ in range(6)]
    docs = [None, "", "short", "De " * 120, "De " * 90 + make(20), "ab" * 400]
    for _ in range(30):
        parts = [make(rnd.randint(1, 30)) for _ in range(3)]
        if rnd.random() < 0.7:
            s = rnd.choice(shared)
            cut = rnd.randrange(len(s))
            parts.insert(rnd.randrange(4), s[cut:] if rnd.random() < 0.5 else s)
        docs.append(" ".join(parts))
    docs += [docs[10], docs[11] + "!", "?" + docs[12], docs[13][:150] + "#" + docs[13][151:]]
    return docs


def test_repeats_against_definition(spark):
    for seed, length in ((1, 40), (2, 64), (3, 200), (4, 101)):
        docs = corpus(seed)
        df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats_digest(df, length).collect()}
        assert got == dict(enumerate(plain_repeats(docs, length)))


def test_nulls_repeats_extra_columns_and_empty(spark):
    long = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(120))
    rows = [(1, long, 5), (1, long, 6), (None, long[:230] + "z", 7), (None, None, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_spans int")
    got = sorted(remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans").collect(), key=str)
    n = len(long)
    assert got == sorted([(1, n, n, 1), (1, n, n, 1), (None, 231, 230, 1), (None, 0, 0, 0)], key=str)
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("group", [1, 3, 7])
def test_divided_groups_against_definition(spark, monkeypatch, group):
    """One passage in many surroundings, some of which are partly alike: groups are divided down to single windows."""
    monkeypatch.setattr(suffix, "_GROUP", group)
    rnd = random.Random(group)
    passage = "".join(rnd.choice("abcdefgh") for _ in range(170))
    ends = ["".join(rnd.choice("xyz") for _ in range(60)) for _ in range(4)]
    docs = []
    for _ in range(40):
        left, right = rnd.choice(ends), rnd.choice(ends)
        docs.append("".join(rnd.choice("xyz") for _ in range(30)) + left[rnd.randrange(60) :] + passage + right[: rnd.randrange(60)] + "".join(rnd.choice("xyz") for _ in range(30)))
    for length in (200, 60):
        df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats_digest(df, length).collect()}
        assert got == dict(enumerate(plain_repeats(docs, length)))


def test_repeats_across_tiles_of_a_long_text(spark):
    rnd = random.Random(4)
    line = "".join(rnd.choice("abcdefghijklmnop") for _ in range((1 << 20) + 5000))
    long = line[: (1 << 20) + 60] + line[(1 << 20) - 90 : (1 << 20) + 50] + line[(1 << 20) + 60 :]
    docs = [long, "x" + line[(1 << 20) - 30 : (1 << 20) + 30], None]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(docs)], "doc_id long, text string, _key string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats_digest(df, 40).collect()}
    assert got == dict(enumerate(plain_repeats(docs, 40)))
    assert remove_repeats(df, 40).where("_key = 'k'").count() == 3
