"""Constraints and scores of a query's slots against a device, as column builders.

q is a struct as query.parse_slots gives (brand, family, generation, modifiers, unparsed), d one of a device (brand, family,
generation, modifiers, popularity), code the query's model code or null. Lists in both are not null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import edit_similarity, jaro_winkler

#: Modifiers that make a device narrower than a query without any.
NARROWING = ["pro", "max", "plus", "ultra", "mini", "fe", "lite", "air", "fold", "flip"]
WEIGHTS = {"brand_match": 0.15, "generation_match": 0.15, "modifier_set_match": 0.1, "family_similarity": 0.4, "token_coverage": 0.15, "popularity": 0.05}


def _once(value: Column, f) -> Column:
    """f of value, which is computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _same_set(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(a, lambda x: F.array_contains(b, x))


def brand_similarity(q: Column, d: Column) -> Column:
    """Null where the query has no brand."""
    return F.when(q["brand"].isNotNull(), F.greatest(jaro_winkler(q["brand"], d["brand"]), jaro_winkler(q["brand"], d["family"])))


def _names_brand(q: Column, d: Column) -> Column:
    anchor = F.lower(F.get(F.split(d["family"], "-"), F.lit(0)))
    words = F.concat(F.array(q["brand"]), F.coalesce(F.split(q["family"], "-"), F.array().cast("array<string>")))
    words = F.transform(F.filter(words, lambda w: w.isNotNull() & (w != "")), F.lower)
    return F.exists(words, lambda w: (w == F.lower(d["brand"])) | ((F.length(anchor) > 1) & (w == anchor)))


def known_brand(brand: Column, known: Sequence[str], least: float = 0.85) -> Column:
    """The brand in lower case, or the first most similar known one where it is a misspelling."""
    b = F.lower(brand)
    near = F.transform(F.array(*map(F.lit, known)), lambda k, i: F.struct(jaro_winkler(b, k).alias("s"), (-i).alias("i"), k.alias("k")))
    return F.when((b == "") | b.isin(*known), b).otherwise(_once(F.array_max(near), lambda x: F.when(x["s"] >= least, x["k"]).otherwise(b)))


def designators(family: Column, modifiers: Column) -> Column:
    """One-letter segments of the family and one-letter modifiers, each once."""
    none = F.array().cast("array<string>")
    parts = F.when(family != "", F.split(family, "-")).otherwise(none)
    first, single = F.slice(parts, 1, 1), F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda s: F.length(s) == 1)
    letter = F.length(F.get(first, F.lit(0))) == 1
    segments = F.when(letter & ((F.size(parts) == 1) | (F.size(single) > 0)), F.concat(first, single)).otherwise(single)
    return F.array_distinct(F.concat(segments, F.filter(modifiers, lambda m: F.length(m) == 1)))


def rejection(q: Column, d: Column, known: Sequence[str] = (), least: float = 0.5, similar: Column | None = None, resolved: Column | None = None) -> Column:
    """The first constraint that the pair fails, null where it passes: brand, generation, modifiers, line designator.

    similar, resolved: the brands' similarity and the query's brand by known_brand, where they are known already.
    """
    brand = (brand_similarity(q, d) if similar is None else similar) < least
    if known:
        brand = brand | (F.lower(d["brand"]).isin(*known) & _once(known_brand(q["brand"], known) if resolved is None else resolved, lambda k: (k != F.lower(d["brand"])) & k.isin(*known)))
    brand = q["brand"].isNotNull() & ~_names_brand(q, d) & brand
    line, own = designators(q["family"], q["modifiers"]), designators(d["family"], d["modifiers"])
    generation = q["generation"].isNotNull() & ~q["generation"].eqNullSafe(d["generation"])
    modifiers = (F.size(q["modifiers"]) > 0) & ~_same_set(q["modifiers"], d["modifiers"])
    out = F.when(brand, "REJECT_BRAND_MISMATCH").when(generation, "REJECT_GENERATION_MISMATCH").when(modifiers, "REJECT_MODIFIER_SET_MISMATCH")
    return out.when((F.size(line) > 0) & ~_same_set(line, own), "REJECT_LINE_DESIGNATOR_MISMATCH")


def narrower(q: Column, d: Column, code: Column) -> Column:
    """Whether the device is a narrower variant than the query names; never for a code."""
    line, own = designators(q["family"], q["modifiers"]), designators(d["family"], d["modifiers"])
    more = ((F.size(line) == 0) & (F.size(own) > 0)) | ((F.size(q["modifiers"]) == 0) & F.exists(d["modifiers"], lambda m: m.isin(*NARROWING)))
    return code.isNull() & more


def query_text(q: Column) -> Column:
    return F.concat_ws(" ", q["brand"], F.when(~q["family"].eqNullSafe(q["brand"]), F.replace(q["family"], F.lit("-"), F.lit(" "))))


def device_text(d: Column) -> Column:
    """Brand and family in letters, without the device's modifiers."""
    words = F.filter(F.split(F.lower(F.concat_ws(" ", d["brand"], d["family"])), "[^a-z0-9]+"), lambda w: ~F.array_contains(F.transform(d["modifiers"], F.lower), w))
    return F.array_join(F.filter(F.transform(words, lambda w: F.regexp_replace(w, "[0-9]+", "")), lambda w: w != ""), " ")


def family_similarity(q: Column, d: Column) -> Column:
    asked, own = query_text(q), device_text(d)
    return F.when(asked == "", F.lit(0.0)).otherwise(_once(F.struct(asked.alias("a"), own.alias("b")), lambda t: F.greatest(edit_similarity(t["a"], t["b"]), jaro_winkler(t["a"], t["b"]))))


def score_parts(q: Column, d: Column, code: Column, scale: float = 10.0, similar: Column | None = None, family: Column | None = None) -> dict[str, Column]:
    """The six components of a score, each from 0 to 1. similar, family: the two similarities, where they are known already."""
    one, zero = F.lit(1.0), F.lit(0.0)
    words = F.when(q["brand"].isNull(), 0).when(q["family"].isNull() | (q["family"] == q["brand"]), 1).otherwise(1 + F.size(F.split(q["family"], "-")))
    known = words + q["generation"].isNotNull().cast("int") + F.size(q["modifiers"])
    total = known + F.size(q["unparsed"])
    return {
        "brand_match": F.coalesce(brand_similarity(q, d) if similar is None else similar, one),
        "generation_match": F.when(q["generation"].isNull() | q["generation"].eqNullSafe(d["generation"]), one).otherwise(zero),
        "modifier_set_match": F.when((F.size(q["modifiers"]) == 0) | _same_set(F.array_distinct(q["modifiers"]), F.array_distinct(d["modifiers"])), one).otherwise(zero),
        "family_similarity": F.when(code.isNotNull(), one).otherwise(family_similarity(q, d) if family is None else family),
        "token_coverage": F.when(code.isNotNull(), one).when(total == 0, zero).otherwise(known / F.greatest(total, F.lit(1))),
        "popularity": F.when(d["popularity"] > 0, d["popularity"] / (d["popularity"] + scale)).otherwise(zero),
    }


def weighted_score(parts: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    total = sum(weights.values())
    return sum((parts[k] * F.lit(w) for k, w in weights.items()), F.lit(0.0)) / F.lit(total) if total else F.lit(0.0)
