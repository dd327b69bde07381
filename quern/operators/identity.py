"""One identity for the rows that name one device in several ways: a class of linked rows takes that of its first member."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.query import Dictionary, marketing_slots
from quern.functions.text import device_slug, literal_map
from quern.operators.catalogue import checkpointed, components


def _without(name: Column, word: Column) -> Column:
    """The name without its first word, where that is the word; null where it isn't, or nothing is left."""
    plain = F.trim(name)
    first = F.lower(F.substring_index(plain, " ", 1)) == F.lower(word)
    rest = F.trim(F.regexp_replace(plain, r"^\S+\s*", ""))
    return F.when(first & (rest != ""), rest)


def line_identity(brand: Column, name: Column, parents: Mapping[str, str], titles: Mapping[str, str]) -> Column:
    """struct(line, rest) of a row whose brand is a subbrand, or whose name starts with one of its brand's subbrands; else null.

    parents: the brand of each subbrand. titles: how brands are written in names.
    """
    title = lambda b: titles.get(b, b)
    own = literal_map({b: title(b) for b in parents})
    as_own = F.struct(brand.alias("line"), F.coalesce(_without(name, own[brand]), F.trim(name)).alias("rest"))
    out = F.when(brand.isin(*parents), as_own)
    for line, parent in parents.items():
        if line in titles:
            rest = _without(name, F.lit(titles[line]))
            out = out.when((brand == parent) & rest.isNotNull(), F.struct(F.lit(line).alias("line"), rest.alias("rest")))
    return out


def merge_identities(rows: DataFrame, order: str, parents: Mapping[str, str], titles: Mapping[str, str], dictionary: Dictionary, insignificant: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, notices). rows: id, brand, name, codes, family, generation, modifiers, the column order, and others.

    Ids of one subbrand and remaining name that share a code (whatever its case) are one class, over any chain of them. All rows of a
    class with two ids or more get the identity of its first member by order: brand, title, name, slots and the id made of
    these. notices: id (the new one) and old_id of each row that changed. A class may hold a large share of all ids.
    """
    if not parents:
        return rows.withColumn("brand_title", F.col("brand")), rows.select("id", F.col("id").alias("old_id")).where("false")
    named = rows.withColumn("_i", line_identity(F.col("brand"), F.col("name"), parents, titles))
    # An id's identity is that of its first row.
    ids = checkpointed(named.where("_i is not null").groupBy("id").agg(F.min_by("_i", order).alias("_i"), F.min(order).alias("_at")))
    key = F.concat_ws("\x1f", "_i.line", F.lower("_i.rest"), F.upper("code"))
    keyed = named.select("id", F.explode_outer("codes").alias("code")).join(ids, "id").select("id", F.when(F.col("code").isNotNull(), key).alias("key"))
    classes = components(keyed, "id", "key").join(ids, "id")
    first = classes.groupBy("component").agg(F.min_by("_i", "_at").alias("_first"), F.count("*").alias("_ids")).where("_ids > 1")
    brand_title = lambda b: F.coalesce(literal_map(titles)[b], b) if titles else b
    made = first.select("component", F.col("_first.line").alias("_line"), F.col("_first.rest").alias("_rest"))
    slug = F.concat_ws("-", "_line", F.when(device_slug(F.col("_rest"), insignificant) != "", device_slug(F.col("_rest"), insignificant)))
    made = checkpointed(made.withColumns({"_id": slug, "_q": marketing_slots(F.col("_line"), F.col("_rest"), dictionary)}))
    new = classes.select("id", "component").join(made, "component").where(F.col("_id") != F.col("id")).drop("component")
    j = rows.join(new, "id", "left")
    changed = F.col("_id").isNotNull()
    pick = lambda a, b: F.when(changed, a).otherwise(b)
    out = j.withColumns({
        "old_id": F.col("id"), "id": pick(F.col("_id"), F.col("id")), "brand_title": brand_title(pick(F.col("_line"), F.col("brand"))), "brand": pick(F.col("_line"), F.col("brand")), "name": pick(F.col("_rest"), F.col("name")),
        "family": F.when(changed, F.coalesce("_q.family", "family")).otherwise(F.col("family")), "generation": pick(F.col("_q.generation"), F.col("generation")), "modifiers": pick(F.col("_q.modifiers"), F.col("modifiers")),
    })
    notices = out.where(changed).select("id", "old_id")
    return out.drop("old_id", "_line", "_rest", "_id", "_q"), notices
