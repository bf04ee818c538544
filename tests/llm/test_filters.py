import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import decontam, linededup
from tagloom.llm.quality import PAIRS, features, fit_quality, keep_good, quality_scores
from tagloom.llm.toxicity import PARTS, STEMS, VARIANTS, VARIED_STEMS, learn_terms, toxicity_scores


def words(rnd, n, pool):
    return " ".join(rnd.choice(pool) for _ in range(n))


POOL = [f"{a}{b}" for a in ("ka", "to", "mi", "ré", "su", "lo") for b in ("na", "ri", "do", "pe", "shi", "")]


def clean(rnd):
    return ".\n".join(words(rnd, rnd.randint(8, 20), POOL).capitalize() for _ in range(rnd.randint(2, 5))) + "."


def junk(rnd):
    base = words(rnd, 40, POOL)
    return rnd.choice([base.upper() + "!!", " ".join(w + "$$$" for w in base.split()), " | ".join(base.split()), " ".join(w for w in base.split()[:4] for _ in range(20))])


def contaminated_plain(docs, items):
    def grams(t, k):
        w = decontam.words_of(t)
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()

    out = []
    for d, t in docs:
        for i, x in set(items):
            k = min(5, len(decontam.words_of(x)))
            g = grams(x, k)
            n = len(g & grams(t, k))
            if g and n >= 0.8 * len(g) - 1e-9:
                out.append((d, i, n, len(g)))
    return out


def test_decontamination_against_brute_force(spark):
    rnd = random.Random(3)
    items = [(i, words(rnd, rnd.randint(3, 40), POOL)) for i in range(25)] + [(90, None), (91, ""), (92, "one two")]
    docs = [(0, None), (1, ""), (2, "ONE, two!")]
    for i in range(3, 90):
        t = words(rnd, rnd.randint(1, 300), POOL)
        if i % 3 == 0:
            w = items[i % 25][1].split()
            w = w[: max(1, int(len(w) * rnd.choice([1, 1, 0.9, 0.7])))]
            if i % 2:
                w[len(w) // 2] = "zzz"
            t = f"{t} {' '.join(w).title()}; {t[:20]}"
        docs.append((i, t))
    d = spark.createDataFrame([(*x, "e") for x in docs], "doc_id long, text string, item_id string").repartition(3)
    b = spark.createDataFrame(items + items[:3], "item_id long, text string")
    want = contaminated_plain(docs, items)
    for limit in (1 << 20, 400):
        got = [(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in decontam.contaminated(d, b, block_bytes=limit).collect()]
        assert sorted(got) == sorted(want) and want
        kept = decontam.drop_contaminated(d, b, block_bytes=limit)
        assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {x for x, _ in docs} - {x for x, *_ in want}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(d, none).count() == 0 and decontam.drop_contaminated(d, none).count() == len(docs)
    assert decontam.contaminated(d.limit(0), b).count() == 0


def test_short_items_in_long_documents(spark):
    filler = "filler word " * 300_000
    docs = [(1, filler + "Seven, eight NINE. " + filler), (1, filler + "Seven, eight NINE. " + filler), (2, "nine eight seven"), (3, "seven"), (4, None), (5, " ")]
    items = [(7, "seven eight nine"), (7, "filler word filler word filler word filler"), (8, "seven"), (8, "SEVEN"), (9, None), (9, "ten")]
    d = spark.createDataFrame([(*x, "t") for x in docs], "doc_id long, text string, shared string")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = sorted(tuple(r)[:4] for r in decontam.contaminated(d, b).collect())
    assert got == sorted(contaminated_plain(docs, items)) and (1, 7, 1, 1) in got and (1, 7, 2, 2) in got
    assert sorted(r.doc_id for r in decontam.drop_contaminated(d, b).collect()) == [4, 5]
    con = duckdb.connect()
    con.register("documents", d.where("doc_id > 1").toPandas())  # lists of a million words are too much for its lambdas
    con.register("benchmark", b.toPandas())
    assert sorted(r[:4] for r in con.sql(decontam.ORACLE).fetchall()) == [x for x in got if x[0] > 1]


def test_line_dedup_against_sql(spark):
    rnd = random.Random(4)
    shared = [f"shared line {i}" for i in range(8)]
    rows = []
    for i in range(300):
        lines = [clean(rnd) for _ in range(2)] + [s for k, s in enumerate(shared) if i % (k + 2) == 0] + ["", " "]
        rnd.shuffle(lines)
        rows.append((i, "\n".join(lines), f"s{i % (6 + i % 9)}", i))
    rows += [(300, "", "s1", 1), (301, shared[0], "s1", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, pos int").repartition(3)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = sorted(con.sql(linededup.ORACLE).fetchall())
    got = sorted(tuple(r) for r in linededup.dedup_report(df).collect())
    assert got == want and any(t != w[1] for (_, t, *_), w in zip(sorted(rows), want))
    out = linededup.dedup_lines(df)
    assert out.columns == df.columns and out.count() == len(rows)


def test_line_dedup_odd_rows(spark):
    line = "everywhere"
    rows = [(i, line, f"s{i}") for i in range(12)] + [(None, line, None), (None, None, "s1"), (5, line, "s5")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.text) for r in linededup.dedup_lines(df).collect()), key=str)
    assert got == sorted([(None, line), (None, None), (5, ""), *((i, "") for i in range(12))], key=str)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def corpus(spark, bad, label, n=700):
    rnd = random.Random(9)
    docs, labels = [(n, None), (n + 1, ""), (None, "x y z")], []
    for i in range(n):
        low = rnd.random() < 0.25
        docs.append((i, bad(rnd) if low else clean(rnd)))
        labels.append((i, int(low if label == "toxic" else not low)))
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, score int").repartition(3)
    return d, spark.createDataFrame(labels, f"doc_id long, {label} int"), dict(labels), len(docs)


def test_quality_on_held_out(spark):
    d, labels, truth, n = corpus(spark, junk, "quality")
    rows = quality_scores(d, labels).collect()
    assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.doc_id in truth and r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    kept = {r.doc_id for r in keep_good(d, labels).collect()}
    assert kept == {r.doc_id for r in rows if r.predicted}


def plain_features(text):
    """Character by character."""
    raw = (text or "").encode()
    words, n = raw.split(), max(1, len(raw))
    m = max(1, len(words))
    of = lambda ok: sum(1 for c in raw if ok(chr(c)) and c < 128)
    upper, lower = of(str.isupper), of(str.islower)
    marks = of(lambda c: c in ".,;:'\"-?()")
    symbols = of(lambda c: 33 <= ord(c) < 127 and not c.isalnum()) - marks
    repeats = sum(words[i] == words[i - 1] for i in range(1, len(words)))
    base = [upper / max(1, upper + lower), min(4, symbols / m), min(4, marks / m), of(str.isdigit) / n, len(set(words)) / m, repeats / m, min(30, n / m) / 10]
    base += [min(1, len(zlib.compress(raw, 1)) / n) if raw else 1.0, min(1, raw.count(b"\n") / m), math.log1p(len(words)) / 10]
    return [*base, *(x**0.5 for x in base), *(x * x for x in base)]


@pytest.mark.parametrize("text", [None, "", "  \n\n", "A a A a! $$ 12", "ÉTÉ été (x); y?", "w" * 200_000, "to to TO, " * 40_000 + "1\n" * 50])
def test_quality_features_against_plain(text):
    assert features(text) == pytest.approx(plain_features(text), rel=1e-12)


def test_quality_pair_loss_is_near_its_least(spark):
    """The same pairs by hand; Newton's method finds the least logistic loss of their feature differences."""
    d, labels, truth, _ = corpus(spark, junk, "quality")
    model = fit_quality(d, labels)
    texts = {r.doc_id: r.text for r in d.collect()}
    order = [r.doc_id for r in labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0).orderBy(F.xxhash64("doc_id")).collect()]
    good, bad = ([np.array(plain_features(texts[i])) for i in order if truth[i] == y] for y in (1, 0))
    draws = spark.range(max(len(good), len(bad)) * PAIRS).select("id", F.pmod(F.xxhash64("id"), F.lit(len(bad))).alias("j")).collect()
    x = np.array([good[r.id % len(good)] - bad[r.j] for r in draws])
    signed = x * np.where(np.arange(len(x)) % 2 == 0, 1, -1)[:, None]
    penalty = 1e-4 * signed.var(axis=0, ddof=1)
    loss = lambda w: np.logaddexp(0, -x @ w).mean() + 0.5 * (penalty * w * w).sum()
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(np.clip(x @ w, -500, 500)))
        step = np.linalg.lstsq((x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(penalty), x.T @ p / len(x) - penalty * w, rcond=None)[0]
        size = 1.0
        while loss(w + size * step) > loss(w) and size > 1e-9:
            size /= 2
        w = w + size * step
    fitted = np.array(model.weights)
    assert loss(w) <= loss(fitted) + 1e-9 and loss(fitted) - loss(w) < 0.02 < loss(0 * w)
    scores = sorted(float(f @ fitted) for f in good + bad)
    at = len(bad) / (len(good) + len(bad)) * (len(scores) - 1)
    cut = scores[int(at)] + (at - int(at)) * (scores[min(int(at) + 1, len(scores) - 1)] - scores[int(at)])
    assert model.threshold == pytest.approx(cut, rel=1e-6)


def test_quality_takes_all_pairs(spark):
    """The slope of the loss over every pair of labelled documents, added up by hand, is zero at the fitted weights."""
    d, labels, truth, _ = corpus(spark, junk, "quality")
    texts = {r.doc_id: r.text for r in d.collect()}
    flipped = {i: y ^ (zlib.crc32(b"%d" % i) % 11 == 1) for i, y in truth.items()}  # so that the kinds overlap
    model = fit_quality(d, spark.createDataFrame(list(flipped.items()), "doc_id long, quality int"))
    used = [i for i in flipped if zlib.crc32(str(i).encode()) % 5]
    good, bad = (np.array([plain_features(texts[i]) for i in used if flipped[i] == y]) for y in (1, 0))
    x = (good[:, None] - bad[None]).reshape(-1, good.shape[1])
    spread, w = np.sqrt((x * x).mean(0)), np.array(model.weights)
    p = 1 / (1 + np.exp(np.clip(x @ w, -500, 500)))
    slope = np.divide(1e-4 * w * spread**2 - x.T @ p / len(x), spread, out=np.zeros_like(w), where=spread > 0)
    assert 0.05 < np.logaddexp(0, -x @ w).mean() < 0.6 and np.abs(slope).max() < 2e-4


def test_quality_takes_all_labels(spark):
    """More labels than the 20,000 of which a sample was taken until round 3: the threshold is the quantile over all."""
    rnd, n = random.Random(6), 27_000
    texts = [" ".join(rnd.choice(["word,", "Word", "WORD$$"][i % 4 == 0 :]) for _ in range(rnd.randint(1, 25))) + "x" * rnd.randint(0, 90) for i in range(n)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    truth = [int(rnd.random() < (0.3 if i % 4 == 0 else 0.9)) for i in range(n)]
    model = fit_quality(d, spark.createDataFrame(list(enumerate(truth)), "doc_id long, quality int"))
    used = [i for i in range(n) if zlib.crc32(str(i).encode()) % 5]
    scores = np.array([features(texts[i]) for i in used]) @ np.array(model.weights)
    assert len(used) > 20_000 and model.threshold == pytest.approx(np.quantile(scores, 1 - np.mean([truth[i] for i in used])), rel=1e-9)


def toxic(rnd):
    w = clean(rnd).split()
    for _ in range(3):
        w.insert(rnd.randrange(len(w)), rnd.choice(["idiot", "you moron", "grukhel" + rnd.choice(POOL), "1d10t"]))
    return " ".join(w)


def test_learned_terms_against_plain_counts(spark):
    """Words, stems and varied stems, by part: those that a part's model lists are counted outside the part."""
    rnd = random.Random(3)
    rows = []
    for i in range(160):
        y = int(i % 8 == 0)
        w = clean(rnd).split() + ([f"grukhel{x}" for x in rnd.sample(POOL, 3)] + ["vexo"] if y else ["grukhel"])
        rows.append((" ".join(w) if i else " ".join(w * 3000), y, rnd.randrange(PARTS)))
    got = dict(learn_terms(spark.createDataFrame([*rows, ("", 0, 1)], "text string, y int, part int").repartition(3)))
    counts = {}
    for text, y, part in rows:
        words = {w for w in text.lower().encode().split() if len(w) > 2}
        terms = words | {b"^" + w[:k] for w in words for k in STEMS if len(w) >= k}
        stems = {w[:k] for w in words for k in VARIED_STEMS if len(w) > k}
        terms |= {b" " + s for s in stems if sum(w.startswith(s) and len(w) > len(s) for w in words) >= VARIANTS}
        for t in terms:
            counts.setdefault(t, []).append((part, y))
    want = {}
    for model in range(PARTS + 1):
        p, n = (sum(q != model and y == of for _, y, q in rows) + (of == 0 and model != 1) for of in (1, 0))
        for t, at in counts.items():
            a, b = (sum(q != model and y == of for q, y in at) for of in (1, 0))
            if a >= max(2 if t[:1] == b" " else 5, p / 500) and a / p / ((b + 1) / n) >= 8:
                want[t] = want.get(t, 0) | 1 << model
    assert got == want and {b"vexo", b" grukhe"} <= got.keys()


def test_toxicity_on_held_out(spark):
    d, labels, truth, n = corpus(spark, toxic, "toxic")
    rows = toxicity_scores(d, labels).collect()
    assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.doc_id in truth and r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


@pytest.mark.parametrize("f, label", [(quality_scores, "quality"), (toxicity_scores, "toxic")])
def test_without_labels(spark, f, label):
    d = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (2, 1)], f"doc_id long, {label} int")
    assert len({r.score for r in f(d, none).collect()}) == 1 and f(d.limit(0), none).count() == 0
