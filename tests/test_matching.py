from pyspark.sql import functions as F

from quern.functions import matching
from quern.operators import catalogue as cat

SLOTS = "q struct<brand:string,family:string,generation:int,modifiers:array<string>,unparsed:array<string>>"
DEVICE = "d struct<brand:string,family:string,generation:int,modifiers:array<string>,popularity:double>"
BRAND, GENERATION, MODIFIERS, LINE = (f"REJECT_{x}_MISMATCH" for x in ("BRAND", "GENERATION", "MODIFIER_SET", "LINE_DESIGNATOR"))


def test_constraints_and_narrower(spark):
    known = ["samsung", "oppo", "poco", "xiaomi", "apple"]
    rows = [  # query, device, rejection, narrower
        (("poco", "x", 5, [], []), ("oppo", "find-x", 5, [], 0.0), BRAND, False),  # both known
        (("samsng", "galaxy-s", 23, [], []), ("samsung", "galaxy-s", 23, ["ultra"], 0.0), None, True),
        (("xiaomi", "poco-x", 5, [], []), ("poco", "poco-x", 5, [], 0.0), None, False),  # names the other brand
        (("zzz", "zzz", None, [], []), ("samsung", "galaxy-s", 23, [], 0.0), BRAND, True),
        ((None, None, 5, [], []), ("oppo", "find-x", None, [], 0.0), GENERATION, True),
        (("oppo", "find", 5, ["pro"], []), ("oppo", "find", 5, ["pro", "max"], 0.0), MODIFIERS, False),
        (("oppo", "find", 5, ["max", "pro"], []), ("oppo", "find", 5, ["pro", "max"], 0.0), None, False),
        (("samsung", "galaxy-s", None, [], []), ("samsung", "galaxy-m", None, [], 0.0), LINE, False),
        (("samsung", "m-s", None, [], []), ("samsung", "galaxy-s", None, ["m"], 0.0), None, False),
        (("samsung", "v-moskve", None, [], []), ("samsung", "galaxy", None, [], 0.0), None, False),
        (("samsung", "galaxy", None, [], []), ("samsung", "galaxy", None, ["a"], 0.0), None, True),
    ]
    df = spark.createDataFrame([(i, q, d) for i, (q, d, _, _) in enumerate(rows)], f"i int, {SLOTS}, {DEVICE}")
    q, d, none = F.col("q"), F.col("d"), F.lit(None).cast("string")
    got = df.select("i", matching.rejection(q, d, known).alias("r"), matching.narrower(q, d, none).alias("n"), matching.narrower(q, d, F.lit("SM-1")).alias("c")).orderBy("i").collect()
    assert [(r["r"], r["n"], r["c"]) for r in got] == [(r, n, False) for _, _, r, n in rows]


def test_scores(spark):
    rows = [(("samsung", "galaxy-s", 23, [], ["x1"]), ("samsung", "galaxy-s", 23, [], 10.0)), ((None, None, 5, ["pro"], []), ("oppo", "find2", 6, [], 0.0))]
    q, d = F.col("q"), F.col("d")
    parts = matching.score_parts(q, d, F.lit(None).cast("string"))
    got = [tuple(r) for r in spark.createDataFrame(rows, f"{SLOTS}, {DEVICE}").select(*parts.values(), matching.weighted_score(parts), matching.device_text(d)).collect()]
    assert got[0][:6] == (1, 1, 1, 1, 0.8, 0.5) and abs(got[0][6] - (0.8 + 0.15 * 0.8 + 0.05 * 0.5)) < 1e-12
    assert got[1][:6] == (1, 0, 0, 0, 1, 0) and abs(got[1][6] - 0.3) < 1e-12 and got[1][7] == "oppo find"


def test_equivalence_and_downgrade(spark):
    rows = [  # query, item, score, key, clear, narrower
        ("gap", 1, 0.9, "x", True, True), ("gap", 2, 0.5, "y", True, False),
        ("same", 1, 0.9, "x", True, True), ("same", 2, 0.88, "x", True, False), ("same", 3, 0.7, "y", True, False),
        ("differ", 1, 0.9, "x", True, False), ("differ", 2, 0.88, "y", True, False),
        ("odd", 1, 0.9, "x", False, False), ("odd", 2, 0.88, "x", False, False),
        ("low", 1, 0.6, "x", True, False), ("low", 2, 0.1, "x", True, False),
        ("lowdiffer", 1, 0.6, "x", True, False), ("lowdiffer", 2, 0.1, "y", True, False),
        ("lowalone", 1, 0.6, "x", True, True),
        ("unknown", 1, 0.9, None, True, False), ("unknown", 2, 0.88, None, True, False),
        ("plain", 1, 0.9, "x", True, False),
    ]
    df = spark.createDataFrame(rows, "query string, item int, score double, key string, clear boolean, narrower boolean")
    asked = spark.createDataFrame([(q,) for q in {r[0] for r in rows} | {"none"}], "query string")
    got = {r["query"]: r["outcome"] for r in cat.decide(df, "query", "item", "score", 0.72, 0.08, (), "key", F.col("clear"), F.col("narrower"), asked).collect()}
    same = "RESOLVED_BY_EQUIVALENCE"
    assert got == {"gap": "GAP_TOO_SMALL", "same": same, "differ": "GAP_TOO_SMALL", "odd": "GAP_TOO_SMALL", "low": same, "lowdiffer": "BELOW_THRESHOLD", "lowalone": "GAP_TOO_SMALL", "unknown": "GAP_TOO_SMALL", "plain": "DETERMINED", "none": "NOT_FOUND"}


def test_matcher_queries_have_rows(spark):
    from quern.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    reasons = {r["reason"] for r in QUERIES["constraint_reject"](spark, sf).collect()}
    assert {"PASS", BRAND, GENERATION, MODIFIERS} <= reasons
    assert QUERIES["score_rank"](spark, sf).count() > 0
    assert len({r["outcome"] for r in QUERIES["match_resolve"](spark, sf).collect()}) > 1
