"""Mixing sources to target weights by min-cost flow.

Documents are added up by membership pattern, the set of sources they belong to. Patterns that
share sources form a component; for each component a min-cost flow routes the patterns' words to
the sources' quotas, where each further pass over a pattern costs more than the one before. What
a pattern has to give is then taken from its documents in the order of a seeded hash: so many whole
passes, and of the next pass the first documents, the last of them in part.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import connected_components, materialize, shuffle_width

WEIGHTS, SHARE, PASSES, SEED = (5, 2, 1), 1.5, 2, 17
#: Sources or patterns up to this number are broadcast to the documents; more of them meet salted documents.
BROADCAST_ROWS = 100_000
_SALTS = 32
#: Hex digits of the seeded hash that a level of the search for the last document tells apart.
_DIGITS = 3
_BLOCK = 10_000


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _pattern(members: Column) -> Column:
    return F.to_json(F.struct(F.array_sort(F.array_distinct(members)).alias("m")), {"ignoreNullFields": "false"})


def _numbered(sizes: DataFrame) -> DataFrame:
    """sizes(source, ...) with ``place``, from 0 in code point order, null last: range partitions and prefix sums over their counts."""
    order = F.col("source").asc_nulls_last()
    spread = sizes.repartitionByRange(shuffle_width(sizes.sparkSession), order).sortWithinPartitions(order)
    held = materialize(spread.withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return held.withColumn("part", part).join(F.broadcast(bases), "part").withColumn("place", F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "at", "base")


def source_targets(sizes: DataFrame, total: int, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """sizes(source, source_size) with place, weight and target.

    Targets are ``share * total`` split by weight, where the weights repeat over the sources by code point, null last;
    none is above ``passes`` times its source's size, and what is cut off is shared by weight among the rest again.
    """
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    found = _numbered(sizes).withColumn("weight", pick.cast("double")).withColumn("cap", (F.col("source_size") * passes).cast("double"))
    found = materialize(found, "weighted")
    rest, w = share * total, None
    while True:
        full = F.lit(False) if w is None else F.col("cap") * w < F.col("weight") * rest
        row = found.agg(F.sum(F.when(full, F.col("cap"))).alias("cap"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        rest = share * total - (row["cap"] or 0.0)
        if row["w"] is None or row["w"] == w:
            break
        w = row["w"]
    level = F.when(F.col("cap") * (w or 1.0) < F.col("weight") * rest, F.col("cap")).otherwise(F.col("weight") * rest / (w or 1.0))
    level = level if row["w"] is not None else F.col("cap")
    return found.select("source", "place", "source_size", "weight", level.cast("double").alias("target"))


def min_cost_flow(patterns: dict[str, tuple[int, list[int]]], quotas: dict[int, int], passes: int) -> dict[str, int]:
    """Words that each pattern gives: the most that the quotas take, at the least cost.

    patterns: (words, the sources' numbers). The first pass over a pattern is free, each further one costs one more a
    word than the one before. Paths of least cost are filled one after the other.
    """
    first = {p: i + 1 for i, p in enumerate(sorted(patterns))}
    source = {s: len(first) + 1 + i for i, s in enumerate(sorted(quotas))}
    sink = len(first) + len(source) + 1
    to, room, cost, out = [], [], [], [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, capacity: int, c: int) -> None:
        for x, y, r, k in ((a, b, capacity, c), (b, a, 0, -c)):
            out[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(k)

    for p, at in first.items():
        words, members = patterns[p]
        for i in range(passes):
            arc(0, at, words, i)
        for s in sorted(members):
            arc(at, source[s], passes * words, 0)
    for s, at in source.items():
        arc(at, sink, quotas[s], 0)
    while True:
        far, via, queue, waits = [None] * (sink + 1), [-1] * (sink + 1), deque([0]), [False] * (sink + 1)
        far[0] = 0
        while queue:
            x = queue.popleft()
            waits[x] = False
            for e in out[x]:
                y = to[e]
                if room[e] and (far[y] is None or far[x] + cost[e] < far[y]):
                    far[y], via[y] = far[x] + cost[e], e
                    if not waits[y]:
                        waits[y] = True
                        queue.append(y)
        if far[sink] is None:
            break
        path, x = [], sink
        while x:
            path.append(via[x])
            x = to[via[x] ^ 1]
        moved = min(room[e] for e in path)
        for e in path:
            room[e] -= moved
            room[e ^ 1] += moved
    return {p: sum(room[e ^ 1] for e in out[0] if to[e] == at) for p, at in first.items()}


def _route(arcs: DataFrame, passes: int) -> DataFrame:
    """(pattern, give) from arcs(component, pattern, words, place, quota); a component's patterns and sources are one task's network."""

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        patterns = {p: (int(x["words"].iloc[0]), [int(s) for s in x["place"]]) for p, x in g.groupby("pattern")}
        give = min_cost_flow(patterns, {int(s): int(q) for s, q in zip(g["place"], g["quota"])}, passes)
        return pd.DataFrame({"pattern": list(give), "give": list(give.values())})

    return arcs.groupBy("component").applyInPandas(solve, "pattern string, give long")


def _beside(rows: DataFrame, few: DataFrame, n: int) -> DataFrame:
    """rows join few on pattern: few is broadcast up to a size, beyond it the rows of a pattern go to several tasks."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), "pattern")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(_SALTS)).cast("int"))
    return salted.join(few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))), ["pattern", "salt"]).drop("salt")


def _crossing(rows: DataFrame, keys: list[str], start: Column) -> DataFrame:
    """Of each pattern the group of ``rows`` in which the running sum of ``words``, from ``start``, passes ``rest``."""
    run = Window.partitionBy("pattern").orderBy(*keys)
    summed = rows.withColumn("upto", start + F.sum("words").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    return summed.where("upto > rest").withColumn("nth", F.row_number().over(run)).where("nth = 1").withColumn("before", F.col("upto") - F.col("words"))


def _last_document(entries: DataFrame, gives: DataFrame, n: int) -> DataFrame:
    """gives(pattern, rest, ...) with the place in the seeded order, (u, doc_id, size), at which ``rest`` words are reached.

    Two levels of hash prefixes narrow it down, so that a window holds 4,096 sums of a pattern, then single documents.
    """
    few, rows, head = gives.select("pattern", "rest", F.lit(0).cast("long").alias("before"), F.lit("").alias("prefix")), entries, 0
    for _ in range(2):
        head += _DIGITS
        inside = _beside(rows, few, n).where(F.col("u").startswith(F.col("prefix"))).withColumn("head", F.substring("u", 1, head))
        sums = inside.groupBy("pattern", "rest", "before", "head").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
        few = materialize(_crossing(sums, ["head"], F.col("before")).select("pattern", "rest", "before", F.col("head").alias("prefix")), "heads")
    inside = _beside(rows, few, n).where(F.col("u").startswith(F.col("prefix"))).withColumn("words", F.col("size") * F.col("copies"))
    cut = _crossing(inside, ["u", "doc_id", "size"], F.col("before"))
    cut = cut.select("pattern", F.col("u").alias("cut_u"), F.col("doc_id").alias("cut_id"), F.col("size").alias("cut_size"), "before")
    return gives.join(cut, "pattern", "left")


def mix(docs: DataFrame, sources: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: int = SEED) -> DataFrame:
    """How many words the mix takes of each document: (doc_id, sources, size, taken), and for documents of one source its source_size and target.

    docs has doc_id, text and the column ``sources``, a string or an array of strings; other columns are not read. A null
    source is one of its own, after all others; a document of an empty array belongs to none and gives nothing. A null or empty text has
    size 0 and gives nothing. Rows that repeat doc_id, size and sources stand next to each other in the seeded order; ties of the hash go by doc_id and size.
    Every row of docs has a row; an empty table has none. A source gets round(target) words, less where overlapping sources leave it too few.
    """
    members = F.col(sources) if docs.schema[sources].dataType.typeName() == "array" else F.array(F.col(sources))
    rows = docs.select("doc_id", _pattern(members).alias("pattern"), members.alias("members"), word_count(F.col("text")).alias("size"))
    u = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    grouped = rows.groupBy("doc_id", "pattern", "size").agg(F.count("*").alias("copies"))
    entries = materialize(grouped.withColumn("u", u), "entries")
    shape = "m array<string>"
    patterns = entries.groupBy("pattern").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    patterns = materialize(patterns.withColumn("members", F.from_json("pattern", shape)["m"]), "patterns")
    total = patterns.agg(F.sum("words")).first()[0] or 0
    split = patterns.select("pattern", "words", F.explode("members").alias("source"))
    targets = materialize(source_targets(split.groupBy("source").agg(F.sum("words").alias("source_size")), total, weights, share, passes), "targets")
    split = split.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("pattern", "words", "place", "source_size", "target")
    split = materialize(split.withColumn("quota", F.floor(F.col("target") + 0.5)), "split")
    own = split.groupBy("pattern").agg(F.min("place").alias("first"))
    links = split.join(own, "pattern").where("place <> first").select(F.col("place").alias("a"), F.col("first").alias("b"))
    arcs = split.join(connected_components(links), F.col("place") == F.col("node"), "left").withColumn("component", F.coalesce("root", "place"))
    gives = _route(arcs.select("component", "pattern", "words", "place", "quota"), passes)
    single = split.groupBy("pattern").agg(*(F.when(F.count("*") == 1, F.first(c)).alias(c) for c in ("source_size", "target")))
    whole = F.when(F.col("words") > 0, F.floor(F.col("give") / F.col("words"))).otherwise(0).cast("long")
    gives = patterns.join(single, "pattern", "left").join(gives, "pattern", "left").withColumn("give", F.coalesce("give", F.lit(0)))
    gives = materialize(gives.withColumn("whole", whole).withColumn("rest", F.col("give") - F.col("whole") * F.col("words")).drop("give", "words"), "gives")
    n = gives.count()
    at = _beside(entries, materialize(_last_document(entries, gives, n), "cuts"), n)
    mine, cut = F.struct("u", "doc_id", "size"), F.struct(F.col("cut_u").alias("u"), F.col("cut_id").alias("doc_id"), F.col("cut_size").alias("size"))
    more = F.when(F.col("cut_u").isNull(), 0).when(mine.eqNullSafe(cut), F.col("rest") - F.col("before")).when(mine < cut, F.col("size") * F.col("copies")).otherwise(0)
    # copies come back as rows in two steps, so that no array is long
    blocks = at.withColumn("more", more).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / _BLOCK))))
    last = F.least(F.lit(_BLOCK), F.col("copies") - F.col("block") * _BLOCK) - 1
    each = blocks.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("nth", F.col("block") * _BLOCK + F.col("at"))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("more") - F.col("nth") * F.col("size")))
    return each.select("doc_id", F.col("members").alias("sources"), "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"))


def mixing_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, size, source_size, target and taken of every row of documents, as ``mix`` gives them."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
f AS (SELECT source, n, w, (SELECT sum(least(2 * CAST(o.n AS HUGEINT) * s.w, 2 * CAST(s.n AS HUGEINT) * o.w)) FROM s AS o) < (SELECT 1.5 * sum(n) FROM s) * s.w AS is_full FROM s),
x AS (SELECT 1.5 * CAST(sum(n) AS DOUBLE) - coalesce(CAST(sum(2 * n) FILTER (is_full) AS DOUBLE), 0) AS rest, CAST(sum(w) FILTER (NOT is_full) AS DOUBLE) AS w FROM f),
t AS (SELECT source, n, CASE WHEN is_full THEN CAST(2 * n AS DOUBLE) ELSE f.w * rest / x.w END AS target FROM f, x),
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM t),
r AS (SELECT *, CASE WHEN n > 0 THEN quota // n ELSE 0 END AS whole FROM q),
o AS (SELECT d.*, n, target, whole, quota - whole * n AS left_over, sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, n AS source_size, target, CAST(whole * size + least(size, greatest(0, left_over - before)) AS BIGINT) AS taken FROM o
"""
