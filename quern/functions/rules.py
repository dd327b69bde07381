"""Status rules: versions, conditions, confidence, families, generations and browser signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YES, NO, ASK = "supported", "not_supported", "clarification_required"
# Parts of renderer names that no mobile device has.
EMULATED = ["swiftshader", "llvmpipe", "microsoft basic render", "direct3d11 vs_5_0", "direct3d9", "mesa", "angle (intel", "angle (nvidia", "angle (amd", "vmware", "virtualbox"]
# Confidence of an answer by its evidence, and what headers that agree or contradict add.
BASES = {"code": 0.95, "legacy": 0.85, "both": 0.92, "one": 0.85, "disagree": 0.4}
AGREE, CONTRADICT = 0.03, -0.10


def version_compare(a: Column, b: Column) -> Column:
    """Below, at or above 0 as dotted version a is to b, missing parts 0; null where a part that decides is no number."""
    parts = lambda v: F.transform(F.split(v, "[.]"), lambda p: F.coalesce(F.regexp_extract(p, r"^\s*([+-]?\d+)", 1).try_cast("double"), F.lit(float("nan"))))
    steps = F.zip_with(parts(a), parts(b), lambda x, y: F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))
    first = F.get(F.filter(steps, lambda d: F.isnan(d) | (d != 0)), F.lit(0))
    return F.when(a.isNotNull() & b.isNotNull(), F.nanvl(F.coalesce(first, F.lit(0.0)), F.lit(None).cast("double")))


def in_version_range(v: Column, low: Column, high: Column) -> Column:
    """low <= v <= high; a null bound is open, a null version is outside."""
    inside = lambda bound, ok: F.when(bound.isNull(), True).otherwise(F.coalesce(ok, F.lit(False)))
    return v.isNotNull() & inside(low, version_compare(v, low) >= 0) & inside(high, version_compare(v, high) <= 0)


def _holds(c: Column, region: Column, version: Column) -> Column:
    """Whether a condition matches: the region is its value, or the version is below it."""
    return F.coalesce(F.when(c["scope"] == "region", F.upper(F.trim(c["value"])) == F.upper(F.trim(region))).otherwise(version_compare(version, c["value"]) < 0), F.lit(False))


def resolve_conditions(support: Column, conditions: Column, region: Column, version: Column) -> Column:
    """The status of a row, given its conditions (scope, value, support) and what is known of the context."""
    known = F.filter(conditions, lambda c: c.isNotNull())
    hit = F.filter(known, lambda c: _holds(c, region, version))
    unknown = F.exists(known, lambda c: F.when(c["scope"] == "region", region.isNull()).otherwise(version.isNull()))
    none = F.coalesce(F.size(known), F.lit(-1)) <= 0
    return F.when(support != "conditional", support).when(none, ASK).when(F.size(hit) > 0, F.get(hit, F.lit(0))["support"]).when(unknown, ASK).otherwise(YES)


def device_resolution(support: Column, conditions: Column, confidence: Column, question: Column, region: Column, version: Column, derived: bool = True, unverified: bool = False) -> Column:
    """struct(status, reasons, question): a device's status by its conditions and then by the confidence of its data.

    reasons are codes in order. The question is the device's own, where its conditions leave the status open.
    """
    known = F.filter(conditions, lambda c: c.isNotNull())
    first = F.get(F.filter(known, lambda c: _holds(c, region, version)), F.lit(0))
    none = F.coalesce(F.size(known), F.lit(-1)) <= 0
    status = resolve_conditions(support, conditions, region, version)
    code = F.when(support != "conditional", "ESIM_STATUS_DIRECT").when(none, "ESIM_CONDITION_INVALID_CONFIGURATION").when(first["scope"] == "region", "ESIM_CONDITION_MATCHED_REGION").when(first.isNotNull(), "ESIM_CONDITION_MATCHED_OS_VERSION")
    code = code.when(status == ASK, "ESIM_CONDITION_CONTEXT_MISSING").otherwise("ESIM_CONDITION_DEFAULT_SUPPORTED")
    gated = confidence_gate(status, confidence, derived, unverified)
    level = F.concat(F.lit("CATALOG_ENTRY_"), F.upper(confidence), F.when(gated != status, "_BLOCKED").otherwise(""))
    level = F.when(confidence == "quarantined", "CATALOG_ENTRY_QUARANTINED_BLOCKED").otherwise(level)
    reasons = F.when(status == ASK, F.array(code)).otherwise(F.array(code, level))
    return F.struct(gated.alias("status"), reasons.alias("reasons"), F.when(status == ASK, question).alias("question"))


def confidence_gate(status: Column, confidence: Column, derived: bool = True, unverified: bool = False) -> Column:
    closed = ["quarantined", *([] if derived else ["derived"]), *([] if unverified else ["unverified"])]
    return F.when(confidence.isin(*closed), ASK).otherwise(status)


def family_rule(status: Column, confirmed: Column) -> Column:
    return F.when(status == "mixed", ASK).when((status == NO) & ~confirmed, ASK).otherwise(status)


def generation_rule(family: Column, generation: Column) -> Column:
    named = F.when(family == "iphone-x", NO).when(family.isin("iphone-xs", "iphone-xr"), YES)
    se = F.when(family == "iphone-se", F.when(generation.isNull(), None).when(generation >= 2, YES).otherwise(NO))
    plain = F.when((family == "iphone") & generation.isNotNull(), F.when(generation > 8, YES).otherwise(NO))
    return F.coalesce(named, se, plain, F.lit("unknown"))


def platform(agent: Column, hint: Column, touch: Column) -> Column:
    agent, hint = F.coalesce(agent, F.lit("")), F.lower(F.trim(hint))
    tablet = agent.rlike("(?i)macintosh") & (touch > 0)
    out = F.when(agent.rlike(r"(?i)iphone|ipad|ipod|cpu (?:iphone )?os \d"), "ios").when(agent.rlike("(?i)harmonyos|openharmony"), "harmonyos").when(agent.rlike("(?i)android"), "android")
    return out.when(tablet, "ios").when(hint.isin("android", "harmonyos"), hint).when(hint.isin("ios", "ipados"), "ios").otherwise("other")


def device_type(agent: Column, kind: Column, mobile: Column, width: Column, height: Column, touch: Column, model: Column) -> Column:
    """struct(type, ambiguous): watches by name, then by platform; width counts only where mobile is unknown, and then it's a guess."""
    agent = F.coalesce(agent, F.lit(""))
    watch = lambda c: F.coalesce(c.rlike(r"(?i)\bwatch|wear ?os"), F.lit(False))
    wide = F.when(width.isNotNull() & height.isNotNull(), F.least(width, height)) >= 600
    of = lambda name, unsure=False: F.struct(F.lit(name).alias("type"), F.lit(unsure).alias("ambiguous"))
    ios = F.when(agent.rlike("(?i)iphone|ipod"), of("phone")).when(agent.rlike("(?i)ipad|macintosh"), of("tablet")).otherwise(of("phone"))
    android = F.when(mobile == F.lit(False), of("tablet")).when(mobile, of("phone")).when(wide, of("tablet", True)).otherwise(of("phone"))
    other = F.when(agent.rlike("(?i)macintosh") & touch.isNull(), of("other", True)).otherwise(of("other"))
    return F.when(watch(agent) | watch(model), of("watch")).when(kind == "ios", ios).when(kind.isin("android", "harmonyos"), android).otherwise(other)


def emulated(kind: Column, touch: Column, adapter: Column) -> Column:
    """A mobile platform without touch, or on a renderer of desktops or software."""
    seen = F.exists(F.array(*map(F.lit, EMULATED)), lambda m: F.contains(F.lower(adapter), m))
    return kind.isin("ios", "android", "harmonyos") & (F.coalesce(touch == 0, F.lit(False)) | F.coalesce(seen, F.lit(False)))


def _found(c: Column, pattern: str) -> Column:
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))


def os_version(agent: Column) -> Column:
    """Major and minor number of iOS (the patch is dropped), or Android's version."""
    ios = r"(?i)CPU (?:iPhone )?OS (\d+_\d+)"
    return F.coalesce(F.replace(_found(agent, ios), F.lit("_"), F.lit(".")), _found(agent, r"(?i)Android\s+([\d.]+)"))


def legacy_model(agent: Column) -> Column:
    """The model that an Android agent names; the placeholder K is none."""
    model = F.trim(_found(agent, r"(?i)Android\s+[\d.]+\s*;\s*([^;)]+?)\s*(?:Build/[^)]*)?\)"))
    return F.when((model != "") & (F.upper(model) != "K"), model)


def unquoted(header: Column) -> Column:
    """A header's value without one quote at either end."""
    return F.regexp_replace(F.regexp_replace(F.trim(header), '^"', ""), '"$', "")


def headers_agree(model: Column, header_model: Column, platform_: Column, header_platform: Column) -> Column:
    """True where all that both sides name agrees, false where one differs, null where nothing can be compared."""
    same = [F.lower(F.trim(a)) == F.lower(F.trim(unquoted(b))) for a, b in ((model, header_model), (platform_, header_platform))]
    told = F.filter(F.array(*same), lambda x: x.isNotNull())
    return F.when(F.size(told) > 0, F.forall(told, lambda x: x))


def answer_gate(status: Column, confidence: Column, least: float = 0.8) -> Column:
    return F.when(confidence < least, ASK).otherwise(status)


def detection_confidence(base: Column, consistent: Column) -> Column:
    """Base, raised by agreeing headers and lowered by contradicting ones (null: not known), within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + F.when(consistent, AGREE).when(~consistent, CONTRADICT).otherwise(0.0)))


def first_match(c: Column, patterns: dict[str, str]) -> Column:
    """The name of the first pattern, in the order given, that c matches."""
    return F.coalesce(*[F.when(c.rlike(pattern), name) for name, pattern in patterns.items()])
