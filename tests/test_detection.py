"""Interval joins against all pairs, group rules and detection by worked cases."""

import random
import re

from pyspark.sql import functions as F

from quern.functions import rules
from quern.operators import detection
from quern.operators.intervals import LEVELS, point_blocks, range_blocks, version_join

YES, NO, ASK = rules.YES, rules.NO, rules.ASK


def below(a, b):
    """The sign of a - b, None where a part that decides is no number."""
    parts = [[int(m[0]) if (m := re.match(r"\s*[+-]?\d+", x)) else None for x in v.split(".")] for v in (a, b)]
    for i in range(max(map(len, parts))):
        x, y = (p[i] if i < len(p) else 0 for p in parts)
        if x is None or y is None:
            return None
        if x != y:
            return -1 if x < y else 1
    return 0


def inside(v, low, high):
    return v is not None and (low is None or below(v, low) in (0, 1)) and (high is None or below(v, high) in (-1, 0))


def test_version_join_equals_all_pairs(spark):
    rng = random.Random(4)
    version = lambda: rng.choice([None, "x", "", "0", "99999999999999999999", "1024.1", *[f"{rng.randint(0, 40)}.{rng.randint(0, 12)}{rng.choice(['', '.1', '.x'])}" for _ in range(8)]])
    points = [(i, version(), rng.choice("ab")) for i in range(150)]
    ranges = [(i, version(), version(), rng.choice("ab")) for i in range(200)] + [(900, None, None, "a"), (901, "20", "3", "a"), (902, "0", "1e", "b")]
    p, r = spark.createDataFrame(points, "i int, v string, k string"), spark.createDataFrame(ranges, "j int, lo string, hi string, k string")
    joined = version_join(p, r, "v", "lo", "hi", ("k",))
    got = sorted((x["i"], x["j"]) for x in joined.select("i", "j").collect())
    assert got == sorted((i, j) for i, v, k in points for j, lo, hi, m in ranges if k == m and inside(v, lo, hi))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_blocks_cover_each_number_once(spark):
    rng = random.Random(1)
    pairs = [(0, 2**LEVELS - 1), (5, 5), (7, 6), (0, 0), (1023, 1023)] + [tuple(sorted(rng.randint(0, 2**LEVELS - 1) for _ in "ab")) for _ in range(40)]
    rows = spark.createDataFrame(pairs, "a int, b int").select("a", "b", range_blocks(F.col("a"), F.col("b")).alias("r")).collect()
    points = {n: {(x["level"], x["block"]) for x in p} for n, p in spark.range(2**LEVELS).select("id", point_blocks(F.col("id").cast("int"))).collect()}
    for a, b, found in rows:
        blocks = [(x["level"], x["block"]) for x in found]
        assert len(blocks) <= 2 * LEVELS
        hits = [sum(x in points[n] for x in blocks) for n in points]
        assert hits == [int(a <= n <= b) for n in points]


CONDITIONS = "array<struct<scope:string,value:string,support:string>>"
QUESTION = "struct<kind:string,question:string,options:array<struct<value:string,label:string>>>"
CATALOG = f"id int, name string, codes array<string>, aliases array<string>, platform string, type string, active boolean, low string, high string, support string, conditions {CONDITIONS}, confidence string, question {QUESTION}"
SIGNALS = "n int, platform string, type string, ambiguous boolean, emulated boolean, told boolean, version string, model string, legacy string, same boolean, region string, screen string"
ASKED = ("region", "Where?", [("CN", "China"), ("x", "Other")])
CN = ("region", "CN", NO)


def device(id_, platform="ios", codes=(), aliases=(), type_="phone", active=True, low=None, high=None, support=YES, conditions=(), confidence="verified", question=None):
    return (id_, f"Device {id_}", list(codes), list(aliases), platform, type_, active, low, high, support, list(conditions), confidence, question)


def signal(n, platform, type_="phone", ambiguous=False, emulated=False, told=True, version=None, model=None, legacy=None, same=None, region=None, screen=None):
    return (n, platform, type_, ambiguous, emulated, told, version, model, legacy, same, region, screen)


def test_device_resolution(spark):
    rows = [  # support, conditions, confidence, region, version, status, reasons, asks
        (YES, [], "verified", None, None, YES, ["ESIM_STATUS_DIRECT", "CATALOG_ENTRY_VERIFIED"], False),
        (NO, [], "derived", None, None, NO, ["ESIM_STATUS_DIRECT", "CATALOG_ENTRY_DERIVED"], False),
        (YES, [], "unverified", None, None, ASK, ["ESIM_STATUS_DIRECT", "CATALOG_ENTRY_UNVERIFIED_BLOCKED"], False),
        (YES, [], "quarantined", None, None, ASK, ["ESIM_STATUS_DIRECT", "CATALOG_ENTRY_QUARANTINED_BLOCKED"], False),
        ("conditional", [], "verified", "CN", "1", ASK, ["ESIM_CONDITION_INVALID_CONFIGURATION"], True),
        ("conditional", [CN], "verified", " cn ", None, NO, ["ESIM_CONDITION_MATCHED_REGION", "CATALOG_ENTRY_VERIFIED"], False),
        ("conditional", [CN], "verified", None, "17", ASK, ["ESIM_CONDITION_CONTEXT_MISSING"], True),
        ("conditional", [CN], "verified", "", "17", YES, ["ESIM_CONDITION_DEFAULT_SUPPORTED", "CATALOG_ENTRY_VERIFIED"], False),
        ("conditional", [CN, ("osVersion", "12.1", NO)], "verified", "US", "12.0.9", NO, ["ESIM_CONDITION_MATCHED_OS_VERSION", "CATALOG_ENTRY_VERIFIED"], False),
        ("conditional", [CN, ("osVersion", "12.1", NO)], "verified", "US", "12.1", YES, ["ESIM_CONDITION_DEFAULT_SUPPORTED", "CATALOG_ENTRY_VERIFIED"], False),
        ("conditional", [("osVersion", "12.1", NO)], "unverified", "US", "x", ASK, ["ESIM_CONDITION_DEFAULT_SUPPORTED", "CATALOG_ENTRY_UNVERIFIED_BLOCKED"], False),
    ]
    df = spark.createDataFrame([(i, *r[:5], ASKED) for i, r in enumerate(rows)], f"i int, s string, c {CONDITIONS}, d string, r string, v string, q {QUESTION}")
    got = df.select("i", rules.device_resolution(F.col("s"), F.col("c"), F.col("d"), F.col("q"), F.col("r"), F.col("v")).alias("x")).orderBy("i").collect()
    assert [(x["status"], x["reasons"], x["question"] is not None) for _, x in got] == [r[5:] for r in rows]


def test_group_resolution(spark):
    other = ("region", "Where?", [("CN", "China"), ("x", "Else")])
    groups = {  # group: (support, conditions, question) of each; status, exact, code, shared question
        "one": ([(YES, [], None)], YES, True, "CANDIDATES_AGREE_ON_ESIM", False),
        "two": ([(NO, [], None), (NO, [], ASKED)], NO, False, "CANDIDATES_AGREE_ON_ESIM", False),
        "mixed": ([(YES, [], None), (NO, [], None)], ASK, False, "CANDIDATES_DISAGREE_ON_ESIM", False),
        "asks": ([("conditional", [CN], ASKED), ("conditional", [CN, CN], ASKED)], ASK, False, "CANDIDATES_AGREE_ON_CLARIFICATION", True),
        "other option": ([("conditional", [CN], ASKED), ("conditional", [CN], other)], ASK, False, "CANDIDATES_AGREE_ON_CLARIFICATION", False),
        "two scopes": ([("conditional", [CN, ("osVersion", "1", NO)], ASKED)], ASK, False, "CANDIDATES_AGREE_ON_CLARIFICATION", False),
        "no question": ([("conditional", [CN], ASKED), ("conditional", [CN], None)], ASK, False, "CANDIDATES_AGREE_ON_CLARIFICATION", False),
        "no conditions": ([("conditional", [], ASKED)], ASK, False, "CANDIDATES_AGREE_ON_CLARIFICATION", False),
    }
    rows = [(g, i, f"d{i}", s, c, "verified" if i else "derived", q) for g, (members, *_) in groups.items() for i, (s, c, q) in enumerate(members)]
    df = spark.createDataFrame(rows, f"g string, id int, name string, s string, conditions {CONDITIONS}, d string, question {QUESTION}")
    none = F.lit(None).cast("string")
    df = df.withColumn("r", rules.device_resolution(F.col("s"), F.col("conditions"), F.col("d"), F.col("question"), none, none))
    got = {r["g"]: r for r in detection.group_resolution(df, ["g"], "id").collect()}
    assert {g: (r["status"], r["exact"], r["code"], r["question"] is not None) for g, r in got.items()} == {g: w[1:] for g, w in groups.items()}
    assert got["two"]["reasons"] == ["ESIM_STATUS_DIRECT", "CATALOG_ENTRY_DERIVED", "CATALOG_ENTRY_VERIFIED"] and got["mixed"]["reasons"] == []
    assert [m["id"] for m in got["mixed"]["members"]] == [0, 1]


def test_detect_routes_and_answers(spark):
    catalog = [
        device(1, "android", ["SM-1"], ["Nova  One"]), device(2, "android", ["SM-2"], ["Twin"]), device(3, "android", ["SM-3"], ["twin"], confidence="unverified"),
        device(4, "android", ["SM-4"], support="conditional", conditions=[CN], question=ASKED),
        device(10, low="12.0", high="15.9"), device(11, low="14.0", high=None), device(12, low="17.0", support=NO), device(13, type_="tablet", low="10"), device(14, active=False, low="1"), device(15, low="30", support=NO),
    ]
    screens = [("a", 10), ("a", 12), ("b", 15), ("c", 14), ("d", 10), ("d", 11)]
    cases = [
        (signal(1, "android", model="sm-1"), "model", YES, 0.95, "1", [], None, "CATALOG_EXACT_MATCH"),
        (signal(2, "harmonyos", model="x", legacy="nova one", same=True), "legacy", YES, 0.88, "1", [], None, "LEGACY_UA_MODEL_PARSED"),
        (signal(3, "android", model=" K", legacy="SM-9", type_="tablet"), "unknown", ASK, 0.0, None, [], "manual_input", "UA_CH_MODEL_MISSING_OR_GENERIC"),
        (signal(4, "android", model="TWIN"), "unknown", ASK, 0.0, None, [], "manual_input", "CATALOG_MODEL_CODE_UNKNOWN"),
        (signal(5, "android", model="SM-3"), "model", ASK, 0.95, "3", [], "check_on_device", "CATALOG_ENTRY_UNVERIFIED_BLOCKED"),
        (signal(6, "android", model="SM-4"), "model", ASK, 0.95, "4", [], "answer_question", "ESIM_CONDITION_CONTEXT_MISSING"),
        (signal(7, "android", legacy="SM-1", same=False), "legacy", ASK, 0.75, "1", [], "check_on_device", "CONFIDENCE_BELOW_THRESHOLD"),
        (signal(8, "android", model="SM-1", emulated=True), "unknown", ASK, 0.0, None, [], "manual_input", "EMULATION_SUSPECTED"),
        (signal(9, "ios", version="15.1", screen="a"), "version and screen", YES, 0.92, "10", [], None, "SCREEN_SIGNATURE_MATCHED"),
        (signal(10, "ios", version="16.0", screen="a"), "version and screen", ASK, 0.4, None, ["10", "12"], "choose_candidate", "CANDIDATES_DISAGREE_ON_ESIM"),  # none in range: all of the screen
        (signal(11, "ios", version="14.5", screen="zz"), "version and screen", YES, 0.85, None, [], None, "SCREEN_SIGNATURE_UNKNOWN"),
        (signal(12, "ios", screen="b"), "version and screen", NO, 0.85, "15", [], None, "CANDIDATES_AGREE_ON_ESIM"),
        (signal(13, "ios"), "version and screen", ASK, 0.4, None, [], "manual_input", "SCREEN_SIGNATURE_UNKNOWN"),
        (signal(14, "ios", screen="c"), "version and screen", ASK, 0.4, None, [], "manual_input", "SCREEN_SIGNATURE_MATCHED"),  # not active
        (signal(15, "ios", type_="tablet", version="11"), "version and screen", YES, 0.85, "13", [], None, "IOS_VERSION_IMPLIES_MIN_MODEL"),
        (signal(16, "ios", type_="watch"), "unknown", ASK, 0.0, None, [], "manual_input", "PLATFORM_DETECTED"),
        (signal(17, "other", type_="other", told=False), "unknown", ASK, 0.0, None, [], "manual_input", "NO_SIGNALS"),
        (signal(18, "other", type_="other", ambiguous=None, emulated=None), "unknown", ASK, 0.0, None, [], "manual_input", "PLATFORM_NOT_MOBILE"),
        (signal(19, "ios", version="15.1", screen="d", same=False), "version and screen", YES, 0.82, None, [], None, "SIGNAL_HEADERS_INCONSISTENT"),
    ]
    answers = detection.detect(spark.createDataFrame([c[0] for c in cases], SIGNALS), spark.createDataFrame(catalog, CATALOG), spark.createDataFrame(screens, "screen string, id int"), "n")
    got = {r["n"]: r for r in answers.collect()}
    assert len(got) == len(cases)
    for given, method, status, sure, found, candidates, kind, reason in cases:
        r = got[given[0]]
        assert (r["method"], r["status"], round(r["confidence"], 6), r["device"], r["candidates"], r["clarification"] and r["clarification"]["kind"]) == (method, status, sure, found, candidates, kind), given
        assert reason in r["reasons"], given
    assert sorted((r["code"], r["n"]) for r in detection.unknown_codes(answers, "n").collect()) == [("SM-9", 3), ("TWIN", 4)]
    assert [tuple(r) for r in detection.unknown_screens(answers, "n").collect()] == [("zz", 11)]
    assert [o["id"] for o in got[10]["clarification"]["options"]] == ["10", "12", "__other__"] and got[6]["clarification"]["question"] == "Where?"
