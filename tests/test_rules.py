from pyspark.sql import functions as F

from quern.functions import rules, text
from quern.operators import ingestion, matching, moderation

CONDITIONS = "array<struct<scope:string,value:string,support:string>>"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_versions_of_any_length_and_without_numbers(spark):
    below = lambda a, b: value(spark, F.coalesce(rules.version_compare(F.lit(a), F.lit(b)) < 0, F.lit(False)))
    assert below("9.0", "15.0") and below("1.2.3.4.5", "1.2.3.4.6") and not below("17", "17.0.0")
    assert not below("beta", "12") and not below("12", "beta") and below("17b", "18") and below("1", "2.beta")
    inside = lambda v, lo, hi: value(spark, rules.in_version_range(F.lit(v).cast("string"), F.lit(lo).cast("string"), F.lit(hi).cast("string")))
    assert inside("17.10", "17.9", None) and inside("5", None, None) and not inside(None, None, None) and not inside("beta", "1", None)


def test_conditions_that_are_missing_ask(spark):
    said = lambda conditions, version: value(spark, rules.resolve_conditions(F.lit("conditional"), conditions, F.lit(None).cast("string"), F.lit(version).cast("string")))
    none, odd = F.lit(None).cast(CONDITIONS), F.array(F.struct(F.lit("osVersion").alias("scope"), F.lit("12").alias("value"), F.lit("not_supported").alias("support")))
    assert said(none, "17") == said(F.array().cast(CONDITIONS), "17") == "clarification_required"
    assert (said(odd, "11.9"), said(odd, "12"), said(odd, None), said(odd, "beta")) == ("not_supported", "supported", "clarification_required", "supported")


def test_device_types(spark):
    rows = [("x Android", "android", False, 300, 400, 1), ("x Android", "android", None, 700, 800, 1), ("x Android", "android", True, 700, 800, 1), ("Macintosh", "other", None, None, None, None), ("Macintosh", "other", None, None, None, 0), ("Macintosh", "ios", None, None, None, 5), ("cpu os 12", "ios", None, None, None, 5), ("Galaxy Watch7 Android", "android", True, 1, 1, 1), (None, "other", None, None, None, None)]
    df = spark.createDataFrame(rows, "a string, k string, m boolean, w int, h int, t int")
    got = [tuple(r["d"]) for r in df.select(rules.device_type(*[F.col(c) for c in "akmwht"], F.lit(None).cast("string")).alias("d")).collect()]
    assert got == [("tablet", False), ("tablet", True), ("phone", False), ("other", True), ("other", False), ("tablet", False), ("phone", False), ("watch", False), ("other", False)]


def test_text_forms(spark):
    assert value(spark, text.unicode_form(F.lit("ﬁne ＡＢ①"))) == "fine ab1"
    assert value(spark, text.split_codes(F.lit("A-10| ;B0;"))) == ["A-10", "B0"]
    got = value(spark, text.extract_attributes(F.array(*map(F.lit, "acme 64 GB red dual SIM 2021 blue".split())), {"storage": ["64 gb"], "dual_sim": ["dual-sim"], "color": ["red", "blue"]}))
    assert (got["storage"], got["dual_sim"], got["color"], got["year"], got["rest"]) == ("64gb", True, "blue", 2021, ["acme"])


SLOTS = "struct<brand:string,family:string,generation:int,modifiers:array<string>,unparsed:array<string>>"
ITEM = "id int, name string, codes array<string>, aliases array<string>, d struct<brand:string,family:string,generation:int,modifiers:array<string>,popularity:double>, status string"


def test_search_by_code_alias_and_trigrams(spark):
    items = [(1, "Nova 5", ["N-5"], ["nova five"], ("acme", "nova", 5, [], 10.0), "supported"), (2, "Nova 5 Pro", ["N-5P", "dup"], [], ("acme", "nova", 5, ["pro"], 5.0), "not_supported"), (3, "Orbit X", ["dup"], [], ("zeta", "orbit-x", None, [], 1.0), "supported")]
    asked = [(1, (None, None, None, [], []), "n-5", "n-5"), (2, (None, None, None, [], []), "DUP", "dup"), (3, ("acme", "nova", 5, [], []), None, "nova  FIVE"), (4, ("acme", "novva", 5, ["pro"], []), None, "acme novva 5 pro"), (5, ("qqq", "www", None, [], []), None, "qqq www")]
    q, c = spark.createDataFrame(asked, f"query int, q {SLOTS}, code string, words string"), spark.createDataFrame(items, ITEM)
    found = {(r["query"], r["id"], r["reason"]) for r in matching.retrieve(q, c, 3).collect()}
    assert {x for x in found if x[0] < 4} == {(1, 1, "MATCH_MODEL_CODE"), (3, 1, "MATCH_EXACT_ALIAS"), (3, 2, "MATCH_EXACT_ALIAS")}
    assert {x for x in found if x[0] == 4} >= {(4, 1, "MATCH_FUZZY_FAMILY"), (4, 2, "MATCH_FUZZY_FAMILY")}
    got = {r["query"]: (r["leader"], r["outcome"], r["status"]) for r in matching.search(q, c, ["acme", "zeta"], 0.8, 0.08, 3).collect()}
    assert got[1] == (1, "DETERMINED", "supported") and got[2][1] == "NOT_FOUND" and got[4] == (2, "DETERMINED", "not_supported") and got[5][0] is None
    assert [r["id"] for r in matching.suggest(q.where("query = 4"), c, 5, ["acme", "zeta"], 3).collect()] == [2]


def test_gates_and_patches(spark):
    assert value(spark, moderation.refused(F.lit(79), F.lit(21))) and not value(spark, moderation.refused(F.lit(80), F.lit(20))) and not value(spark, moderation.refused(F.lit(0), F.lit(0)))
    more, sure = moderation.with_source(F.array(F.lit("a")), F.lit("derived"), F.lit("a"))
    assert (value(spark, more), value(spark, sure)) == (["a"], "verified")
    assert value(spark, moderation.transition(F.lit("csv_quarantine"), F.lit("link_model_code"))) == "invalid"


def test_breaches_leave_no_device(spark):
    fields = "id string, ord int, brand string, family string, name string, codes array<string>, aliases array<string>, platform string, support string, confidence string, screens array<string>, max_version string, conditions array<string>, question string, sources array<string>"
    good = ("a", 1, "b", "f", "n1", ["C1"], [], "android", "supported", "derived", [], None, [], None, [])
    bad = ("x", 2, "b", "f", "n2", ["c1"], [], "ios", "conditional", "derived", [], None, [], None, [])
    d = spark.createDataFrame([good, bad], fields)
    signs = spark.createDataFrame([("s", ["a", "none"], "mixed")], "screen string, candidates array<string>, consensus string")
    codes = sorted(r["code"] for r in ingestion.violations(d, signs).collect())
    assert codes == ["CONDITIONAL_CLARIFYING_QUESTION_MISSING", "CONDITIONAL_CONDITIONS_MISSING", "DUPLICATE_MODEL_CODE", "IOS_MAX_VERSION_MISSING", "IOS_SCREEN_SIGNATURES_MISSING", "SCREEN_SIGNATURE_CONSENSUS_MISMATCH", "SCREEN_SIGNATURE_UNKNOWN_CANDIDATE"]


def test_edits_are_judged_by_their_own_breaches(spark):
    cols = "id string, ord long, brand string, family string, name string, codes array<string>, aliases array<string>, platform string, support string, confidence string, screens array<string>, max_version string, conditions array<string>, question string, sources array<string>"
    row = lambda i, **kw: tuple({"id": i, "ord": ord(i), "brand": "b", "family": "f", "name": f"n{i}", "codes": [f"c{i}"], "aliases": [], "platform": "android", "support": "supported", "confidence": "derived", "screens": [], "max_version": None, "conditions": [], "question": None, "sources": [], **kw}.values())
    d = spark.createDataFrame([row("a"), row("b", codes=["CX"]), row("c", codes=["cx"])], cols)
    signs = spark.createDataFrame([(1, ["a"], "supported")], "screen int, candidates array<string>, consensus string")
    check = lambda *rows: sorted((r["code"], r["device_ids"]) for r in ingestion.edit_breaches(d, spark.createDataFrame(list(rows), cols), signs).collect())
    assert check(row("a", support="not_supported")) == []  # the signature follows; b and c were wrong before
    assert check(row("d", codes=["CA"], ord=200)) == [("DUPLICATE_MODEL_CODE", ["a", "d"])]
    assert check(row("a", support="conditional")) == [("CONDITIONAL_CLARIFYING_QUESTION_MISSING", ["a"]), ("CONDITIONAL_CONDITIONS_MISSING", ["a"])]


def test_form_without_sources(spark):
    forms = spark.createDataFrame([("a", "b", "B", "X", "supported", None, None, None, None), ("c", "b", "B", "Y", "not_supported", ["u"], ["b y"], "n", 0.1)], "id string, brand string, brand_title string, marketing_name string, support string, sources array<string>, aliases array<string>, notes string, popularity double")
    a, c = moderation.device_from_form(forms).orderBy("id").collect()
    assert (a["code"], a["confidence"], a["popularity"], a["aliases"], a["sources"]) == ("VALIDATION_ERROR", "derived", 0.5, ["b x"], [])
    assert (c["code"], c["confidence"], c["dual_sim"], c["aliases"]) == (None, "verified", "none", ["b y"])
