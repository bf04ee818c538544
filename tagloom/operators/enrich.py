"""Taxonomy joins, tiers, derived scores and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import equivalent, strings


def table_of(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def lowered(tags: Column) -> Column:
    return F.transform(F.coalesce(tags, strings()), lambda x: F.lower(F.trim(x)))


def tag_families(tags: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(tag, family) for each distinct tag: a family's own name, else the first family with a term in the tag.

    The pattern join runs over the distinct tags, not over the rows that carry them. Null
    tags are left out; a tag without a family has null.
    """
    distinct = tags.select(F.lower(F.trim("tag")).alias("tag")).where("tag is not null").distinct()
    named = taxonomy.select(F.col("family").alias("term"), "family", F.lit(-1).alias("family_ord")).distinct()
    terms = F.broadcast(taxonomy.unionByName(named))
    stands = F.col("term").eqNullSafe(F.col("tag")) | ((F.col("family_ord") >= 0) & (F.length("term") <= F.length("tag")) & equivalent(F.col("term"), F.col("tag")))
    return distinct.join(terms, stands, "left").groupBy("tag").agg(F.min_by("family", "family_ord").alias("family"))


def tier_of_family(family: Column) -> Column:
    return F.when(family.isin(vocab.TOP_FAMILIES), "top").when(family.isin(vocab.BASE_FAMILIES), "base").otherwise("heart")


def note_tiers(items: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """items(item_id, notes, ..) with top, heart and base, each in the notes' order."""
    exploded = items.select("item_id", F.posexplode("notes").alias("pos", "note"))
    tiers = tag_families(exploded.select(F.col("note").alias("tag")), taxonomy).select("tag", tier_of_family(F.col("family")).alias("tier"))
    placed = exploded.join(tiers, F.lower(F.trim("note")) == tiers["tag"])
    entry = F.array_sort(F.collect_list(F.struct("pos", "note", "tier")))
    grouped = placed.groupBy("item_id").agg(entry.alias("_all"))
    of = lambda tier: F.coalesce(F.transform(F.filter("_all", lambda x: x["tier"] == tier), lambda x: x["note"]), strings())
    return items.join(grouped, "item_id", "left").withColumns({t: of(t) for t in ("top", "heart", "base")}).drop("_all")


def accord_tiers(accords: Column) -> Column:
    """(top, heart, base) by an accord's longevity weight."""
    weight = lambda a: F.coalesce(F.try_element_at(table_of(vocab.LONGEVITY_WEIGHTS), F.lower(F.trim(a))), F.lit(0.5))
    held = F.coalesce(accords, strings())
    return F.struct(
        F.filter(held, lambda a: weight(a) <= 0.35).alias("top"), F.filter(held, lambda a: (weight(a) > 0.35) & (weight(a) < 0.75)).alias("heart"),
        F.filter(held, lambda a: weight(a) >= 0.75).alias("base"),
    )


def pyramid(stored: Column, from_notes: Column, accords: Column) -> Column:
    """Stored tiers if there are any, else those of the notes, else those of the accords."""
    size = lambda p: F.size(F.coalesce(p["top"], strings())) + F.size(F.coalesce(p["heart"], strings())) + F.size(F.coalesce(p["base"], strings()))
    return F.when(size(stored) > 0, stored).when(size(from_notes) > 0, from_notes).otherwise(accord_tiers(accords))


def position_score(accords: Column, notes: Column, weights: dict[str, float], bonus: float) -> Column:
    """Weight of the first five accords, falling with their place, out of 100; more for a power note."""
    first = F.slice(lowered(accords), 1, 5)
    place = lambda i: (5 - i) / 5.0
    value = lambda a: F.coalesce(F.try_element_at(table_of(weights), a), F.lit(0.5))
    total = F.aggregate(F.transform(first, lambda a, i: place(i) * value(a)), F.lit(0.0), lambda s, x: s + x)
    share = F.aggregate(F.transform(first, lambda a, i: place(i)), F.lit(0.0), lambda s, x: s + x)
    strong = F.arrays_overlap(lowered(notes), strings(*vocab.POWER_NOTES))
    score = 100 * total / share + F.when(strong, bonus).otherwise(0.0)
    return F.when(F.size(first) == 0, 50.0).otherwise(F.round(F.least(F.lit(100.0), score), 1))


def longevity_score(accords: Column, notes: Column) -> Column:
    return position_score(accords, notes, vocab.LONGEVITY_WEIGHTS, 8.0)


def sillage_score(accords: Column, notes: Column) -> Column:
    return position_score(accords, notes, vocab.SILLAGE_WEIGHTS, 6.0)


def wear_label(score: Column) -> Column:
    out = F.when(score.isNull(), "Unknown")
    for limit, label, _ in vocab.WEAR_BUCKETS[:-1]:
        out = out.when(score < limit, label)
    return out.otherwise(vocab.WEAR_BUCKETS[-1][1])


def wear_hours(score: Column) -> Column:
    out = F.when(score.isNull(), 4.0)
    for limit, _, hours in vocab.WEAR_BUCKETS[:-1]:
        out = out.when(score < limit, hours)
    return out.otherwise(vocab.WEAR_BUCKETS[-1][2])


def projection_label(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score < 35, "light").when(score < 65, "moderate").otherwise("strong")


def age_bracket(age: Column) -> Column:
    return F.when(age < 25, "under_25").when(age <= 40, "25_40").when(age > 40, "40_plus")


def scenario_performance(requests: DataFrame, defaults: DataFrame) -> DataFrame:
    """(request_id, hours, projection): the longest wear and the softest projection over a request's scenarios."""
    each = requests.select("request_id", F.explode_outer("scenarios").alias("scenario"))
    joined = each.join(F.broadcast(defaults), "scenario", "left")
    return joined.groupBy("request_id").agg(F.max("hours").alias("hours"), F.min_by("projection", "quiet").alias("projection"))


def adjusted(longevity: Column, sillage: Column, kind: Column) -> Column:
    """(longevity, sillage) by the product's concentration, from 0 to 100."""
    by = lambda i: F.try_element_at(table_of({k: v[i] for k, v in vocab.TYPE_FACTORS.items()}), F.lower(kind))
    on = by(0).isNotNull() & longevity.isNotNull() & sillage.isNotNull()
    scaled = lambda x, f: F.round(F.greatest(F.lit(0.0), F.when(f > 1, F.least(F.lit(100.0), x * f)).otherwise(x * f)), 1)
    return F.struct(F.when(on, scaled(longevity, by(0))).otherwise(longevity).alias("longevity"), F.when(on, scaled(sillage, by(1))).otherwise(sillage).alias("sillage"))


def dominant_tag(accords: Column) -> Column:
    return F.lower(F.coalesce(F.try_element_at(accords, F.lit(1)), F.lit("")))


def character(accords: Column, buckets: dict[str, list[str]]) -> Column:
    """The bucket that most accords belong to; of equals the earlier one; null if none does."""
    counts = F.array(*[F.struct(F.size(F.array_intersect(lowered(accords), strings(*v))).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("bucket")) for i, (k, v) in enumerate(buckets.items())])
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["bucket"])


def estimated_price(price: Column, brand: Column, key: Column) -> Column:
    """A known price, else one inside the brand's tier, fixed by the MD5 of the row's key."""
    low = F.lower(F.trim(brand))
    out, spread = None, None
    for words, lo, hi in vocab.PRICE_TIERS:
        hit = F.lit(words == [""]) if words == [""] else F.exists(strings(*words), lambda w: low.contains(w))
        spread = (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % (hi - lo + 1) + lo).cast("int")
        out = F.when(hit, spread) if out is None else out.when(hit, spread)
    return F.coalesce(price.cast("int"), out)


def scenario_terms(scenarios: Column, kind: str, limit: int) -> Column:
    """Distinct accords or notes of the scenarios, in order, at most ``limit``."""
    at = {"accords": 2, "notes": 3}[kind]
    table = F.create_map(*[x for s, v in vocab.SCENARIOS.items() for x in (F.lit(s), strings(*v[at]))])
    return F.slice(F.array_distinct(F.flatten(F.transform(F.coalesce(scenarios, strings()), lambda s: F.coalesce(F.try_element_at(table, s), strings())))), 1, limit)


def expanded_query(text: Column, accords: Column, notes: Column, scenarios: Column, skin: Column, families: Column, alternative: bool = False) -> Column:
    """A request as text for the embedding model."""
    full = lambda prefix, a: F.when(F.size(F.coalesce(a, strings())) > 0, F.concat(F.lit(prefix), F.array_join(a, ", ")))
    skin_families = F.create_map(*[x for k, v in vocab.SKIN_FAMILIES.items() for x in (F.lit(k), strings(*v))])
    members = F.create_map(*[x for k, v in vocab.FAMILIES.items() for x in (F.lit(k), strings(*v[:4]))])
    terms = F.flatten(F.transform(F.coalesce(families, strings()), lambda f: F.coalesce(F.try_element_at(members, f), strings())))
    of_scenarios = scenario_terms(scenarios, "notes", 8) if alternative else scenario_terms(scenarios, "accords", 6)
    lead = F.concat(F.lit("similar to "), text) if alternative else text
    return F.concat_ws(". ", lead, full("accords ", F.slice(accords, 1, 8)), full("notes ", F.slice(notes, 1, 10)), full("for ", of_scenarios), full("skin ", F.try_element_at(skin_families, skin)), full("families ", terms))


def scenario_or_default(scenario: Column) -> Column:
    return F.when(scenario.isin(*vocab.SCENARIOS), scenario).otherwise("daily")
