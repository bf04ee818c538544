"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are lexicon densities (a fixed seed lexicon, and words and word stems that the
labelled sample shows mostly in toxic texts), how near lexicon words stand to second-person
words, shares of capitals and punctuation, and rates of obfuscated words. A stem that a text
varies in several words tells more than one word, so it is learned from fewer texts. What
the trees see of a labelled text is counted without its own part of the sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_chunks
from .decontam import words_of
from .labelled import MAX_LABELLED, fold, labelled_sample

CUT = 0.3
FOLDS, HELD_OUT = 4, 2
NEAR = 5
STEMS = (4, 5, 6)
VARIED_STEMS, VARIANTS = (4, 5, 6, 7), 3
#: Parts of the fitted sample; each is scored with the terms of the others.
PARTS = 5
#: Insults in common use, in four languages.
SEED = "arse asshole bastard bitch clown coward cretin crap damn disgusting dumb dumbass fool freak garbage hate idiot idiots imbecile jerk kill loser losers moron morons pathetic pig rat scum shit shut stupid sucker trash ugly useless vermin worthless abschaum arschloch dumm dummkopf ekelhaft idiotisch mistkerl scheisse trottel versager wertlos cretin connard debile degoutant imbecile minable nul ordure raclure salaud stupide asco asqueroso basura cabron escoria estupido idiota imbecil inutil mierda patetico tonto".split()
YOU = "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie tu te toi ton ta tes vous votre vos ti tu tus usted ustedes vosotros vuestro".split()
_LEET = bytes.maketrans(b"01345789@$!|+", b"oieasttgasiit")
_OBFUSCATED = re.compile(rb"[A-Za-z]+(?:[*@#$!0-9._-]+[A-Za-z]+)+|[0-9@$!]+[A-Za-z]+[*@#$!0-9A-Za-z]*")
_SPACED = re.compile(rb"(?<![A-Za-z])(?:[A-Za-z][ .*_-]){3,}[A-Za-z](?![A-Za-z])")
_SEED, _YOU, _LEARNED, _STEM, _VARIED = 1, 2, 4, 8, 16


def varied_stems(words: set[bytes]) -> Counter:
    """Stems, marked by a blank ahead, that at least ``VARIANTS`` different words go on from, and how many do."""
    found = Counter(b" " + w[:k] for w in words for k in VARIED_STEMS if len(w) > k)
    return Counter({stem: n for stem, n in found.items() if n >= VARIANTS})


class _Kinds(dict):
    """Bits for each word: in the seed lexicon, second person, learned word, learned stem, learned varied stem."""

    def __init__(self, learned: set[bytes]):
        super().__init__()
        self.seed, self.you = {w.encode() for w in SEED}, {w.encode() for w in YOU}
        self.learned = learned

    def __missing__(self, w: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        stem = any(b"^" + w[:k] in self.learned for k in STEMS if len(w) >= k)
        varied = any(b" " + w[:k] in self.learned for k in VARIED_STEMS if len(w) > k)
        self[w] = k = (w in self.seed) * _SEED | (w in self.you) * _YOU | (w in self.learned) * _LEARNED | stem * _STEM | varied * _VARIED
        return k


def features(text: str | None, kinds: _Kinds) -> list[float]:
    raw = (text or "").encode()
    words = words_of(text)
    n, m = max(1, len(raw)), max(1, len(words))
    kind = np.fromiter(map(kinds.__getitem__, words), np.uint8, len(words))
    seed, learned, stem = ((kind & bit > 0) for bit in (_SEED, _LEARNED, _STEM))
    hits = np.flatnonzero(seed | learned | stem)
    you = np.flatnonzero(kind & _YOU)
    near = 0
    if len(hits) and len(you):
        at = np.searchsorted(you, hits)
        gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - hits), np.abs(you[np.maximum(at - 1, 0)] - hits))
        near = int((gap <= NEAR).sum())
    on = {words[i] for i in np.flatnonzero(kind & _VARIED)}
    varied = max((v for s, v in varied_stems(on).items() if s in kinds.learned), default=0)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    disguised = [x for x in (w.lower() for w in _OBFUSCATED.findall(raw))]
    spaced = _SPACED.findall(raw)
    plain = [re.sub(rb"[^a-z]", b"", w.translate(_LEET)) for w in disguised] + [re.sub(rb"[^a-z]", b"", w.lower()) for w in spaced]
    hidden = sum(kinds[w] & (_SEED | _LEARNED | _STEM) > 0 for w in plain)
    return [
        int(seed.sum()) / m, math.log1p(int(seed.sum())), int(learned.sum()) / m, math.log1p(int(learned.sum())), int(stem.sum()) / m, math.log1p(int(stem.sum())),
        len(hits) / m, near / m, math.log1p(near), len(you) / m, upper / max(1, upper + lower), int(count[33]) / n, int(count[63]) / n,
        int(count[[35, 36, 37, 38, 42, 64]].sum()) / n, len(disguised) / m, math.log1p(hidden), len(spaced) / m, math.log1p(len(words)),
        varied, varied / m,
    ]


def learn_terms(sample: DataFrame, lift: float = 8.0, least: int = 5, least_varied: int = 2) -> list[tuple[bytes, int]]:
    """(term, in which models): words, stems marked ``^`` and varied stems marked by a blank at least ``lift`` times as common among toxic texts.

    sample(text, y, part): model i < ``PARTS`` learns from the texts outside part i, the last
    one from all. Counted once a text over the whole sample; a term needs ``least`` (a varied stem
    ``least_varied``) toxic texts and a five-hundredth of them. So there are at most five
    hundred times as many terms as a toxic text of the bounded sample has on average.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], Counter] = {}
        for b in text_chunks(batches, "text"):
            for text, *of in zip(*(b.column(c).to_pylist() for c in ("text", "part", "y"))):
                words = {w for w in words_of(text) if len(w) > 2}
                terms = words | {b"^" + w[:k] for w in words for k in STEMS if len(w) >= k} | varied_stems(words).keys()
                seen.setdefault(tuple(of), Counter()).update(terms)
        for (part, y), found in seen.items():
            k = len(found)
            yield pa.record_batch({
                "term": pa.array(found, pa.binary()), "part": pa.array([part] * k, pa.int32()), "y": pa.array([y] * k, pa.int32()), "c": pa.array(found.values(), pa.int64()),
            })

    totals = {(r.part, r.y): r["count"] for r in sample.groupBy("part", "y").count().collect()}
    columns, models = [], F.lit(0)
    for model in range(PARTS + 1):
        counts = [F.sum(F.when((F.col("y") == y) & (F.col("part") != model), F.col("c")).otherwise(0)) for y in (1, 0)]
        columns += [counts[0].alias(f"p{model}"), counts[1].alias(f"n{model}")]
        p, n = (sum(c for (part, of), c in totals.items() if part != model and of == y) for y in (1, 0))
        few = F.when(F.hex(F.substring("term", 1, 1)) == "20", F.lit(least_varied)).otherwise(F.lit(least))
        ratio = (F.col(f"p{model}") / max(1, p)) / ((F.col(f"n{model}") + 1) / max(1, n))
        models = models + F.when((F.col(f"p{model}") >= F.greatest(few, F.lit(p / 500))) & (ratio >= lift), 1 << model).otherwise(0)
    counted = sample.select("text", "part", "y").mapInArrow(run, "term binary, part int, y int, c long").groupBy("term").agg(*columns)
    return [(bytes(r.term), r.models) for r in counted.select("term", models.alias("models")).where("models > 0").collect()]


def toxicity_scores(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (calibrated), predicted.

    Learns from at most ``limit`` labels(doc_id, toxic) outside the held-out fold: trees on
    seven tenths of them, the calibration on the rest. Null and empty texts are scored like
    any other. Without labels of both kinds the score is the share of toxic labels, or zero.
    A null doc_id is in the fold of the empty text; an empty table gives no rows.
    """
    sample = materialize(labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, limit).repartition(6), "toxicity")
    part = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(10))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold(FOLDS) == HELD_OUT).alias("held_out"))
    classes = {(r.fit, r.y): r["count"] for r in sample.groupBy((part < 7).alias("fit"), "y").count().collect()}
    if len(classes) < 4:
        share = sum(c for (_, y), c in classes.items() if y) / max(1, sum(classes.values()))
        flat = keyed.select("doc_id", "held_out", F.lit(float(share)).alias("score"))
        return flat.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
    sample = sample.withColumn("fit", part < 7)
    sample = sample.withColumn("part", F.when(F.col("fit"), F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(PARTS))).otherwise(PARTS).cast("int"))
    terms = docs.sparkSession.sparkContext.broadcast(learn_terms(sample.where("fit")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The terms of the model that ``part`` names, or of the whole sample."""
        kinds: dict[int, _Kinds] = {}
        for b in text_chunks(batches, "text"):
            models = b.column("part").to_pylist() if "part" in b.schema.names else [PARTS] * b.num_rows
            for model in set(models) - kinds.keys():
                kinds[model] = _Kinds({t for t, of in terms.value if of >> model & 1})
            rows = [features(t, kinds[model]) for t, model in zip(b.column("text").to_pylist(), models)]
            rest = {c: b.column(c) for c in b.schema.names if c not in ("text", "part")}
            yield pa.record_batch(rest | {"f": pa.array(rows, pa.list_(pa.float64()))})

    known = materialize(sample.mapInArrow(run, "doc_id long, y int, fit boolean, f array<double>"), "features")
    vectors = known.select("fit", F.col("y").cast("double").alias("label"), array_to_vector("f").alias("features")).repartition(4)
    trees = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, seed=7).fit(vectors.where("fit"))
    raw = vector_to_array("probability")[1].alias("raw")
    rest = trees.transform(vectors.where("not fit")).select(raw, "label")
    curve = IsotonicRegression(featuresCol="raw", predictionCol="score").fit(rest)
    table = keyed.mapInArrow(run, "doc_id long, held_out boolean, f array<double>").withColumn("features", array_to_vector("f"))
    scored = curve.transform(trees.transform(table).select("doc_id", "held_out", raw))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return scored.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
