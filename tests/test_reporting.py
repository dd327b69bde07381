import random

from pyspark.sql import functions as F

from quern.functions import rules, text
from quern.operators import catalogue as cat


def test_prefix_suggestions_equal_brute_force(spark):
    rng = random.Random(5)
    code = lambda: "".join(rng.choice("AB") for _ in range(rng.randint(0, 9)))
    items, asked = [(i, code()) for i in range(300)], [(i, code()) for i in range(40)]
    expected = set()
    for q, c in asked:
        shared = lambda d: next((i for i in range(min(len(c), len(d)), 0, -1) if c[:i] == d[:i]), 0)  # noqa: B023, E731
        best = sorted((-shared(d), i) for i, d in items if shared(d) >= 4)[:5]
        expected |= {(q, i, -n, rank) for rank, (n, i) in enumerate(best, 1)}
    got = cat.prefix_suggestions(spark.createDataFrame(asked, "q int, code string"), spark.createDataFrame([*items, (999, None)], "id int, code string"), "q", "id", "code")
    assert {tuple(r) for r in got.select("q", "id", "shared", "rank").collect()} == expected


def test_components_of_a_long_chain_and_null_keys(spark):
    chain = [(i, f"k{i // 2}") for i in range(40)] + [(i, f"m{(i + 1) // 2}") for i in range(40)]
    rows = [*chain, (100, "x"), (101, "x"), (101, "x"), (102, None)]
    got = {r["n"]: r["component"] for r in cat.components(spark.createDataFrame(rows, "n int, k string"), "n", "k").collect()}
    assert got == {**{i: 0 for i in range(40)}, 100: 100, 101: 100, 102: 102}
    assert cat.components(spark.createDataFrame([], "n int, k string"), "n", "k").count() == 0


def test_conditions_are_parsed(spark):
    raw = spark.createDataFrame([("region:CN / hk=no; osVersion:17=ДА;firmware:1=yes;nonsense;region:=no",), ("",), (None,)], "t string")
    got = [r["c"] for r in raw.select(text.parse_conditions(F.col("t")).alias("c")).collect()]
    assert [tuple(x) for x in got[0]] == [("region", "CN", "not_supported"), ("region", "hk", "not_supported"), ("osVersion", "17", "supported")]
    assert got[1:] == [[], None]


def test_slug_and_first_match(spark):
    row = spark.range(1)
    assert row.select(text.device_slug(F.lit("Acme Old X-5 (Dual SIM)"), ["old"])).first()[0] == "acme-x-5"
    assert row.select(rules.first_match(F.lit("AB1"), {"one": "^A", "two": "^AB"})).first()[0] == "one"


def test_metrics_and_examples(spark):
    rows = [("p", "yes", "yes"), ("p", "no", "yes"), ("p", "no", "open"), ("r", "no", "no")]
    got = {r["c"]: (r["total"], r["correct"], r["false_positive"], r["unanswered"], r["percent"]) for r in cat.category_metrics(spark.createDataFrame(rows, "c string, e string, g string"), "c", "e", "g", "yes", "open").collect()}
    assert got == {"p": (3, 1, 1, 1, "33.3"), "r": (1, 1, 0, 0, "100.0"), "total": (4, 2, 1, 1, "50.0")}
    few = cat.first_examples(spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1)], "g string, i int"), "g", "i", 3)
    assert {r["g"]: (r["total"], r["examples"]) for r in few.collect()} == {"a": (9, [0, 1, 2]), "b": (1, [1])}
