"""Parsing and normalisation: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import LOOKUP_PHRASES, LOOKUP_STOP_WORDS



def strings(*values: str) -> Column:
    """A literal array of strings."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def quoted(c: Column) -> Column:
    """The text as a pattern that matches itself."""
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")


def known(c: Column) -> Column:
    """Null for blank and for the word unknown."""
    return F.when(~F.lower(F.trim(c)).isin("", "unknown"), F.trim(c))


def parse_list(c: Column) -> Column:
    """A list or dict literal, else comma-separated text, as trimmed strings that are not blank."""
    quotes = {"allowSingleQuotes": "true"}
    text = F.trim(c)
    listed = F.from_json(text, "array<string>", quotes)
    mapped = F.flatten(F.map_values(F.from_json(text, "map<string,array<string>>", quotes)))
    plain = F.split(text, ",")
    found = F.when(text.startswith("["), listed).when(text.startswith("{"), mapped)
    parts = F.when(known(c).isNull(), strings()).otherwise(F.coalesce(found, plain))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def parse_tier(c: Column) -> Column:
    """A comma list without blank, unknown and none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: ~F.lower(x).isin("", "unknown", "none"))


def gender(c: Column) -> Column:
    """male, female, unisex or null, from words of several vocabularies."""
    t = F.lower(F.trim(c))
    women, men = t.rlike(r"\b(women|woman|female|femme|for her)\b"), t.rlike(r"\b(men|man|male|homme|for him)\b")
    both = t.contains("unisex") | (women & men)
    return F.when(t.isin("", "unknown", "n/a", "na"), None).when(both, "unisex").when(women, "female").when(men, "male")


_SUFFIX = r"(?i)\s+(for women and men|for unisex|for women|for men|for her|for him|unisex|women|men)\s*$"


def packed_brand(name: Column) -> Column:
    """The last word before a trailing audience suffix, without a glued ``for``; a single word is itself."""
    words = F.split(F.trim(F.regexp_replace(name, _SUFFIX, "")), r"\s+")
    last = F.element_at(words, -1)
    glued = F.lower(last).endswith("for") & (F.length(last) > 3)
    return F.when(F.size(words) < 2, F.trim(F.regexp_replace(name, _SUFFIX, ""))).when(glued, F.substring(last, F.lit(1), F.length(last) - 3)).otherwise(last)


def packed_item(name: Column) -> Column:
    """All words but the brand's, where an audience suffix was found; else the whole name."""
    rest = F.trim(F.regexp_replace(name, _SUFFIX, ""))
    words = F.split(rest, r"\s+")
    return F.when(~name.rlike(_SUFFIX), name).when(F.size(words) > 1, F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")).otherwise(rest)


def product_title(name: Column, brand: Column) -> Column:
    """A listing's title without pack size, leading brand and marketing words; the name if nothing is left."""
    cut = F.trim(F.regexp_replace(name, r"\s*-\s*\d.*$", ""))
    led = (F.length(brand) > 0) & F.lower(cut).startswith(F.lower(brand))
    bare = F.when(led, F.regexp_replace(F.substring(cut, F.length(brand) + 1, F.lit(10_000)), r"^[ -]+|[ -]+$", "")).otherwise(cut)
    bare = F.regexp_replace(bare, r"(?i)\b(unisex|for\s+men|for\s+women|for\s+her|for\s+him)\b", "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?i)\bperfume\b", ""), r"\s+", " "))
    return F.when(bare != "", bare).otherwise(name)


def listing_price(c: Column) -> Column:
    """Discount price, else list price, of the first entry of a list of dicts, in whole units."""
    first = F.try_element_at(F.from_json(c, "array<struct<discount_price:string,mrp:string>>", {"allowSingleQuotes": "true"}), F.lit(1))
    set_ = lambda x: F.when(~x.isin("", "0", "0.0"), x)
    return F.coalesce(set_(first["discount_price"]), set_(first["mrp"])).try_cast("double").cast("int")


def decimal_text(c: Column) -> Column:
    """A number with a decimal point or comma; anything else is null."""
    return F.regexp_replace(F.trim(c), ",", ".").try_cast("double")


def count_text(c: Column) -> Column:
    """A count with thousands commas; anything else is null."""
    return F.regexp_replace(F.trim(c), ",", "").try_cast("double").cast("int")


def joined_pair(a: Column, b: Column) -> Column:
    """Both with ``and``, or the one that is known, or null."""
    return F.when(known(a).isNotNull() & known(b).isNotNull(), F.concat_ws(" and ", known(a), known(b))).otherwise(F.coalesce(known(a), known(b)))


def wide_to_array(*columns: Column) -> Column:
    """The columns that are not blank, in order."""
    return F.array_compact(F.array(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns]))


def normal_name(c: Column) -> Column:
    """Lower case, letters, digits and single blanks only."""
    kept = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def normal_key(brand: Column, item: Column) -> Column:
    return F.concat_ws("|", normal_name(brand), normal_name(item))


def concentration(name: Column) -> Column:
    """The product type that the first fitting phrase of a name tells."""
    n = F.concat(F.lit(" "), F.lower(name), F.lit(" "))
    has = lambda *xs: F.exists(strings(*xs), lambda x: n.contains(x))
    return (
        F.when(has("eau de toilette", " edt"), "Eau de Toilette").when(has("eau de parfum", " edp"), "Eau de Parfum")
        .when(has("extrait"), "Extrait de Parfum").when(has("cologne", " edc"), "Eau de Cologne").when(has("elixir"), "Elixir")
        .when(has("parfum"), "Parfum").when(has("body spray", "deodorant", "mist"), "Body Spray")
    )


def clean_notes(notes: Column) -> Column:
    """Without elements that look like a dict written as text."""
    return F.filter(F.coalesce(notes, strings()), lambda x: ~(x.startswith("{'") & x.endswith("}")))


def lookup_text(query: Column) -> Column:
    """Lower case without punctuation, search phrases and stop words; accents stay."""
    q = F.regexp_replace(F.lower(query), r"(?U)[^\w\s]", " ")
    for phrase in LOOKUP_PHRASES:
        q = F.replace(q, F.lit(phrase), F.lit(" "))
    return F.array_join(F.filter(F.split(q, r"(?U)\s+"), lambda w: (w != "") & ~w.isin(LOOKUP_STOP_WORDS)), " ")


def match_text(c: Column) -> Column:
    """Lower case, anything but letters and digits as a single blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+", " "))


def has_phrase(text: Column, phrase: Column) -> Column:
    """The phrase occurs between word boundaries; an empty phrase does not. Only texts that hold it reach the pattern."""
    return (phrase != "") & text.contains(phrase) & F.regexp_like(text, F.concat(F.lit(r"\b"), quoted(phrase), F.lit(r"\b")))


def starts_word(term: Column, text: Column) -> Column:
    """The term begins at a word boundary of the text."""
    return (term != "") & text.contains(term) & F.regexp_like(text, F.concat(F.lit(r"\b"), quoted(term)))


def equivalent(a: Column, b: Column) -> Column:
    """Equal, or the shorter stands as whole words in the longer."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a == b) | has_phrase(long, short)


def embedding_text(brand: Column, item: Column, accords: Column, notes: Column, description: Column) -> Column:
    """One recipe for seeding and for refreshing."""
    full = lambda x: F.when(x != "", x)
    return F.concat_ws(". ", full(brand), full(item), full(F.array_join(F.slice(accords, 1, 8), " ")), full(F.array_join(F.slice(notes, 1, 10), " ")), full(F.substring(description, 1, 300)))


def search_document(brand: Column, item: Column, accords: Column, notes: Column) -> Column:
    return F.concat_ws(" ", brand, item, F.array_join(accords, " "), F.array_join(notes, " "))


def money(c: Column) -> Column:
    """Whole units with thousands separators."""
    return F.concat(F.lit("₹"), F.format_number(c, 0))


def short_title(c: Column, limit: int = 42) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def since(moment: Column, now: Column) -> Column:
    """How long ago, in words."""
    s = F.unix_timestamp(now) - F.unix_timestamp(moment)
    of = lambda unit, size: F.concat(F.floor(s / size).cast("string"), F.lit(unit))
    return F.when(s < 60, "just now").when(s < 3600, of("m ago", 60)).when(s < 86400, of("h ago", 3600)).otherwise(of("d ago", 86400))


def present(df, name: str = "price"):
    """A candidate as an output row: price zero is no price, missing arrays are empty, the type is derived."""
    return df.withColumns({
        name: F.nullif(F.col(name), F.lit(0)), "accords": F.coalesce("accords", strings()), "notes": clean_notes(F.col("notes")),
        "type": F.coalesce("type", concentration(F.col("item"))),
    })
