import pytest
from pyspark.sql import functions as F

from tagloom.functions import intent as I
from tagloom.functions import text as P


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def of(spark, f, value):
    return one(spark, f(F.lit(value).cast("string")))


@pytest.mark.parametrize("given, want", [("  Dior!! ", "dior"), ("Jean   Paul  Gaultier", "jean paul gaultier"), (None, "")])
def test_normal_name(spark, given, want):
    assert of(spark, P.normal_name, given) == want


@pytest.mark.parametrize("given, want", [("Sauvage EDP", "Eau de Parfum"), ("Blue Cologne", "Eau de Cologne"), ("Night Elixir", "Elixir"), ("Sauvage", None), (None, None)])
def test_concentration(spark, given, want):
    assert of(spark, P.concentration, given) == want


@pytest.mark.parametrize("given, want", [
    ("['a', ' b ', '']", ["a", "b"]), ("{'top': ['a'], 'base': ['b', 'c']}", ["a", "b", "c"]), ("a, b,,c", ["a", "b", "c"]), ("Unknown", []), (None, []), ("[broken", ["[broken"]),
])
def test_parse_list(spark, given, want):
    assert of(spark, P.parse_list, given) == want


def test_packed_names(spark):
    got = [(of(spark, P.packed_brand, n), of(spark, P.packed_item, n)) for n in ("9am Dive Afnanfor women", "Adam for men", "Plain Name", "Solo")]
    assert got == [("Afnan", "9am Dive"), ("Adam", "Adam"), ("Name", "Plain Name"), ("Solo", "Solo")]


def test_titles_and_prices(spark):
    assert one(spark, P.product_title(F.lit("HONEY Oud Unisex Perfume - 100ml"), F.lit("Honey"))) == "Oud"
    assert of(spark, P.listing_price, "[{'mrp': '900', 'discount_price': '750'}]") == 750
    assert of(spark, P.listing_price, "[{'mrp': '900'}]") == 900
    assert of(spark, P.listing_price, "nothing") is None


@pytest.mark.parametrize("given, want", [("for women and men", "unisex"), ("pour homme", "male"), ("Femme", "female"), ("Unisex", "unisex"), ("n/a", None), ("table", None), (None, None)])
def test_gender(spark, given, want):
    assert of(spark, P.gender, given) == want


def test_lookup_text(spark):
    assert of(spark, P.lookup_text, "Alternative to Sauvage under 2000") == "sauvage under 2000"


def test_equivalent(spark):
    pairs = {("jasmine", "moroccan jasmine"): True, ("musk", "musky"): False, ("rose", "rosemary"): False, ("a.b", "x a.b y"): True, ("a.b", "x aab y"): False}
    assert {k: one(spark, P.equivalent(F.lit(k[0]), F.lit(k[1]))) for k in pairs} == pairs


def test_clean_notes(spark):
    assert one(spark, P.clean_notes(P.strings("rose", "{'a': 'b'}", "musk", "oud"))) == ["rose", "musk", "oud"]


CASES = [
    (I.gender_hint, "for my husband", "male"), (I.gender_hint, "something for her", "female"), (I.gender_hint, "men and women", "unisex"), (I.gender_hint, "him or her", None),
    (I.hours_required, "lasts 8+ hours", 8), (I.hours_required, "6 to 8 hours", 6), (I.hours_required, "8 or 10 hrs", 8), (I.hours_required, "30 hours", None),
    (I.projection_preference, "close to skin", "light"), (I.projection_preference, "beast mode", "strong"), (I.projection_preference, "by bike", "strong"),
    (I.wants_alternative, "a cheap dupe", True), (I.wants_alternative, "cheaper alternative to X", True), (I.wants_alternative, "fresh summer", False),
    (I.budget_in_text, "under ₹500", 500.0), (I.budget_in_text, "perfume under 2000", 2000.0), (I.budget_in_text, "under 8 hours", None), (I.budget_in_text, "under 20km", None), (I.budget_in_text, "1000 INR", 1000.0),
    (I.negated_terms, "not sweet or heavy, avoid oud", ["sweet", "oud"]), (I.negated_terms, "no vanilla, I want musk", ["vanilla"]), (I.negated_terms, "no vanilla I want musk", ["vanilla"]), (I.negated_terms, "I love piano", []),
    (I.age, "22yo", 22), (I.age, "I am twenty five", 25), (I.age, "under 25", None), (I.age, "10 years", None), (I.age, "a 20 km walk", 20),
    (I.skin_type, "my skin is oily", "oily"), (I.note_families, "woody tobacco scent", ["oriental", "woody"]), (I.keyword_scenarios, "training in the rain", ["gym", "monsoon"]),
]


@pytest.mark.parametrize("f, given, want", CASES)
def test_intent(spark, f, given, want):
    assert of(spark, f, given) == want


def test_preferences(spark):
    p = of(spark, I.preferences, "22yo guy wanting a fresh citrusy scent for the gym under 2000")
    assert (p.gender, p.scenarios, p.budget, p.age) == ("male", ["gym"], 2000.0, 22) and "citrus" in p.note_families
