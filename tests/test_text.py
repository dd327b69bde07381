import random

from pyspark.sql import functions as F

from quern.functions import text


def osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def jaro(a, b):
    if not a and not b:
        return 1.0
    w, used, mine = max(max(len(a), len(b)) // 2 - 1, 0), [], []
    for i, c in enumerate(a):
        for j in range(max(0, i - w), min(len(b), i + w + 1)):
            if b[j] == c and j not in used:
                used.append(j)
                mine.append(c)
                break
    if not mine:
        return 0.0
    k, t = len(mine), sum(x != b[j] for x, j in zip(mine, sorted(used)))
    return (k / len(a) + k / len(b) + (k - t / 2) / k) / 3


def test_distances_equal_plain_versions(spark):
    rng = random.Random(3)
    pairs = [tuple("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 8))) for _ in "ab") for _ in range(400)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for a, b, d, j in df.select("a", "b", text.osa_distance(F.col("a"), F.col("b")), text.jaro(F.col("a"), F.col("b"))).collect():
        assert d == osa(a, b), (a, b)
        assert abs(j - jaro(a, b)) < 1e-12, (a, b)


def test_normalisation_steps(spark):
    df = spark.createDataFrame([("  Galaxy--S23,Ultra! ",)], "t string")
    assert df.select(text.normalise(F.col("t"))).first()[0] == "galaxy s23 ultra"
    words = df.select(text.repair_lookalikes(F.array(F.lit("l2"), F.lit("0ppo"), F.lit("x1")))).first()[0]
    assert words == ["12", "oppo", "x1"]


def test_screen_key(spark):
    df = spark.createDataFrame([(900, 400, 2.625), (390, 844, 3.0)], "w int, h int, d double")
    assert [r[0] for r in df.select(text.screen_key(F.col("w"), F.col("h"), F.col("d"))).collect()] == ["400x900@2.625", "390x844@3"]
