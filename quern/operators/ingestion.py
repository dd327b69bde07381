"""From raw rows to catalogue devices: validation, merges within and between sources, precedence, invariants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import rules, text
from quern.operators.catalogue import set_consensus

# What the columns of a raw row may say.
ENUMS = {
    "platform": ["ios", "android", "harmonyos", "other"],
    "device_type": ["phone", "tablet", "watch", "laptop", "other"],
    "esim_support": ["yes", "no", "conditional", "unknown"],
    "dual_sim": ["physical+esim", "dual-esim", "esim-only", "none", "unknown"],
    "ru_market": ["official", "parallel", "none", "unknown"],
    "confidence": ["high", "medium", "low"],
}
REQUIRED = ["platform", "device_type", "esim_support"]
FIRST_YEAR, FIRST_ESIM_YEAR = 2007, 2017


def quarantine_code(brands: Sequence[str], now_year: int) -> Column:
    """The first check that a raw row fails, null where it passes.

    Columns: those of ENUMS, brand, marketing_name, release_year and esim_conditions, all text; only REQUIRED ones must be there.
    """
    said = lambda c: F.lower(F.trim(c))
    bad = [F.when(~F.coalesce(said(c), F.lit("")).isin(*v) & (F.lit(c in REQUIRED) | F.col(c).isNotNull()), "ENUM_INVALID") for c, v in ENUMS.items()]
    year = F.regexp_extract("release_year", r"^\s*([+-]?\d+)", 1).try_cast("int")
    plausible = year.isNotNull() & year.between(FIRST_YEAR, now_year + 1)
    words = text.tokens(text.normalise(F.col("marketing_name")))
    named = F.coalesce(F.size(F.filter(words, lambda w: w.rlike(r"[\p{L}\p{N}]"))) > 0, F.lit(False))
    conditions = F.coalesce(F.size(text.parse_conditions(F.col("esim_conditions"))), F.lit(-1)) > 0
    return F.coalesce(
        *bad,
        F.when(~F.coalesce(said("brand"), F.lit("")).isin(*brands), "BRAND_UNKNOWN"),
        F.when(~named, "NAME_UNPARSEABLE"),
        F.when(~F.coalesce(plausible, F.lit(False)), "YEAR_IMPLAUSIBLE"),
        F.when((year < FIRST_ESIM_YEAR) & said("esim_support").isin("yes", "conditional"), "ESIM_ANACHRONISM"),
        F.when((said("esim_support") == "conditional") & ~conditions, "CONDITION_SYNTAX_INVALID"),
    )


def major_version(c: Column) -> Column:
    """The first number of a version text, with its decimals."""
    return F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def below_ceiling(version: Column, ceiling: float) -> Column:
    """The version, null where its number lies above what exists."""
    return F.when(~F.coalesce(major_version(version) > ceiling, F.lit(False)), version)


def merge_ids(rows: DataFrame, key: Sequence[str], order: str, status: str, codes: str) -> DataFrame:
    """One row per key of those whose rows agree on status: the first, with all its rows' codes in order; outcome says what happened.

    Where rows of one key differ in status, all of them are quarantined (outcome).
    """
    rest = [c for c in rows.columns if c not in (*key, order, status, codes)]
    g = rows.groupBy(*key).agg(F.min(F.struct(order, *rest)).alias("_first"), F.count("*").alias("n"), set_consensus(F.col(status)).alias(status), F.array_sort(F.collect_list(F.struct(order, codes))).alias("_codes"))
    merged = F.array_distinct(F.flatten(F.transform("_codes", lambda c: c[codes])))
    outcome = F.when(F.col(status) == "mixed", "quarantined").when(F.col("n") > 1, "merged").otherwise("single")
    return g.select(*key, "_first.*", status, merged.alias(codes), "n", outcome.alias("outcome"))


def _majority(values: Column) -> Column:
    """The most frequent value of a list without nulls, null where several are as frequent."""
    counts = F.transform(F.array_distinct(values), lambda v: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), v.alias("v")))
    best = F.array_max(F.transform(counts, lambda c: c["n"]))
    top = F.filter(counts, lambda c: c["n"] == best)
    return F.when(F.size(top) == 1, F.get(top, F.lit(0))["v"])


def representative(rows: DataFrame, key: str, order: Sequence[str], first: Sequence[str], voted: Sequence[str], fallback: Sequence[str] = ()) -> DataFrame:
    """One row per key: `first` columns of the first row, the majority of `voted` ones; of `fallback` ones the first row's value where votes tie.

    A key has a row per source, of which there are few, so its rows fit in a list.
    """
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in (*first, *voted, *fallback) if c not in order]))).alias("_rows"))
    head = F.get("_rows", F.lit(0))
    vote = lambda c: _majority(F.filter(F.transform("_rows", lambda r: r[c]), lambda v: v.isNotNull()))
    return g.select(key, *[head[c].alias(c) for c in first], *[vote(c).alias(c) for c in voted], *[F.coalesce(vote(c), head[c]).alias(c) for c in fallback])


def condition_union(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """key and conditions of rows (scope, value, support, note): each once, in the order of its first row, with its last note."""
    at = F.struct(*order)
    one = rows.groupBy(key, "scope", "value", "support").agg(F.min(at).alias("_at"), F.max_by("note", at).alias("note"))
    return one.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "scope", "value", "support", "note"))), lambda c: F.struct(c["scope"].alias("scope"), c["value"].alias("value"), c["support"].alias("support"), c["note"].alias("note"))).alias("conditions"))


def merge_source(curated: Column, brand: Column, platform: Column, family: Column, generation: Column) -> Column:
    """Which of curated rows, the generation rule and the import a device's status comes from."""
    ruled = (brand == "apple") & (platform == "ios") & (rules.generation_rule(family, generation) != "unknown")
    return F.when(curated.isNotNull(), "curated").when(F.coalesce(ruled, F.lit(False)), "rule").otherwise("import")


def data_confidence(source: Column, outcome: Column) -> Column:
    return F.when(source.isin("curated", "rule"), "verified").when(outcome == "single-source", "unverified").otherwise("derived")


def popularity(year: Column, now_year: int) -> Column:
    """0 for the first year, 1 for this one."""
    span = now_year - FIRST_YEAR
    return F.lit(0.5) if span <= 0 else F.greatest(F.lit(0.0), F.least(F.lit(1.0), (year - FIRST_YEAR) / F.lit(float(span))))


def clarifying_question(conditions: Column, questions: Mapping[str, str]) -> Column:
    """struct(kind, question, options) of the first condition's scope: its values, and other; null without conditions."""
    kind = F.get(conditions, F.lit(0))["scope"]
    values = F.array_distinct(F.transform(F.filter(conditions, lambda c: c["scope"] == kind), lambda c: c["value"]))
    return F.when(F.size(conditions) > 0, F.struct(kind.alias("kind"), text.literal_map(dict(questions))[kind].alias("question"), F.concat(values, F.array(F.lit("other"))).alias("options")))


def subbrand_identity(brand: Column, name: Column, parents: Mapping[str, str]) -> Column:
    """struct(subbrand, remainder): the brand's own name goes from the front of the name; a subbrand that leads it is told apart."""
    plain = F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))
    rest = F.when(F.startswith(plain, F.concat(brand, F.lit(" "))), F.substr(plain, F.length(brand) + 2)).otherwise(plain)
    lead = F.split(rest, " ")[0]
    leads = F.coalesce(text.literal_map(dict(parents))[lead] == brand, F.lit(False))
    own = F.when(leads, lead).when(brand.isin(*parents), brand)
    return F.struct(own.alias("subbrand"), F.when(leads, F.trim(F.substr(rest, F.length(lead) + 1))).otherwise(rest).alias("remainder"))


VIOLATION = ["invariant", "code", "device_ids"]


def violations(devices: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """invariant, code and the ordered device_ids of each breach of the catalogue's seven invariants.

    devices: id, ord (their order), brand, family, name, codes, aliases, platform, support, confidence, screens, max_version,
    conditions, question, sources. signatures: screen, candidates, consensus.
    """
    d = devices
    rows = lambda found, n, code, ids: found.select(F.lit(n).alias("invariant"), F.lit(code).alias("code"), ids.alias("device_ids"))
    one = F.array("id")
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    twice = d.groupBy("id").count().where("count > 1")
    owned = d.select("ord", "id", F.explode(F.transform("codes", F.upper)).alias("key"))
    owner = owned.groupBy("key").agg(F.min_by("id", "ord").alias("owner"), F.min("id").alias("a"), F.max("id").alias("b")).where("a < b")
    shared = owned.join(owner, "key").where("id <> owner").select(F.array("owner", "id").alias("ids"))
    names = F.when(F.col("family") != F.col("brand"), F.concat("aliases", F.array("name"))).otherwise(F.col("aliases"))
    said = d.select("ord", "id", "support", F.explode(F.transform(names, lambda x: F.lower(F.trim(x)))).alias("key"))
    split = said.groupBy("key").agg(F.min("support").alias("a"), F.max("support").alias("b"), F.array_sort(F.collect_set("id")).alias("ids")).where("a < b")
    ios, maybe = d.where("platform = 'ios'"), d.where("support = 'conditional'")
    found = [
        rows(twice, 1, "DUPLICATE_DEVICE_ID", one),
        rows(shared, 2, "DUPLICATE_MODEL_CODE", F.col("ids")),
        rows(split, 3, "CONFLICTING_ALIAS", F.col("ids")),
        rows(ios.where(empty("screens")), 4, "IOS_SCREEN_SIGNATURES_MISSING", one),
        rows(ios.where("max_version is null"), 4, "IOS_MAX_VERSION_MISSING", one),
        rows(maybe.where(empty("conditions")), 5, "CONDITIONAL_CONDITIONS_MISSING", one),
        rows(maybe.where("question is null"), 5, "CONDITIONAL_CLARIFYING_QUESTION_MISSING", one),
        rows(d.where("support = 'supported' and confidence = 'verified'").where(empty("sources")), 6, "SUPPORTED_SOURCES_MISSING", one),
    ]
    if signatures is not None:
        named = signatures.select("screen", "consensus", F.explode("candidates").alias("id"))
        known = named.join(d.select("id", "support").dropDuplicates(["id"]), "id", "left")
        found.append(rows(known.where("support is null"), 7, "SCREEN_SIGNATURE_UNKNOWN_CANDIDATE", one))
        seen = known.groupBy("screen", "consensus").agg(set_consensus(F.col("support")).alias("expected"), F.count("support").alias("n"), F.array_sort(F.collect_set("id")).alias("ids"))
        found.append(rows(seen.where("n > 0 and expected <> consensus"), 7, "SCREEN_SIGNATURE_CONSENSUS_MISMATCH", F.col("ids")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def quarantined(devices: DataFrame, breaches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The devices that no breach names, and a row (id, code) per breach and device."""
    named = breaches.select("code", F.explode("device_ids").alias("id"))
    return devices.join(named.select("id").distinct(), "id", "left_anti"), named.select("id", "code")


def edit_breaches(devices: DataFrame, edited: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """The breaches of the catalogue as it would be with the edited devices in place of those of their ids, as far as one of them is named.

    Edits are judged together. Signatures get the consensus that their known candidates would have then, so that a changed
    status is no breach by itself; those without a known candidate keep theirs. Columns as in violations.
    """
    after = devices.join(edited.select("id").distinct(), "id", "left_anti").unionByName(edited)
    if signatures is not None:
        known = after.select("id", "support").dropDuplicates(["id"])
        named = signatures.select("screen", F.explode("candidates").alias("id")).join(known, "id")
        agreed = named.groupBy("screen").agg(set_consensus(F.col("support")).alias("_agreed"))
        signatures = signatures.join(agreed, "screen", "left").withColumn("consensus", F.coalesce("_agreed", "consensus")).drop("_agreed")
    found = violations(after, signatures).withColumn("_breach", F.struct(*VIOLATION))
    named = found.select("_breach", F.explode("device_ids").alias("id")).join(edited.select("id").distinct(), "id", "left_semi")
    return named.select("_breach").distinct().select("_breach.*")
