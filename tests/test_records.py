"""Checked records, signals, configuration, nearest geometries and merged identities."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quern.functions.query import Dictionary
from quern.operators import identity, moderation
from quern.sources import config, records
from quern.sources.records import Field

FIELDS = [Field("id", shortest=1), Field("n", "int", low=0, high=99), Field("tags", "strings", nullable=True, longest=2), Field("esim", "object", required=False), Field("when", required=False, form=r"^\d{4}-\d\d$"), Field("share", "number", required=False, low=0, high=1)]


def test_rejects_and_last_duplicate(spark):
    rows = [
        '{"id":"a","n":3,"tags":["x"]}', '{"id":5,"n":3.5}', '{"id":"a","n":9,"tags":[],"esim":{"s":1},"when":"2024-01","share":1}', "nope", "[1]", "7", "null", "", None,
        '{"id":"b","n":1,"tags":[1]}', '{"id":"","n":-1,"tags":null,"esim":[]}', '{"id":"c","n":100,"tags":["1","2","3"],"when":"soon","share":1.5,"z":0}', '{"id":"é \\" x","n":0,"tags":null}',
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string")
    good, bad = records.checked(df, "r", FIELDS, ("i",), "id", ("i",), closed=True)
    assert {r["id"]: (r["i"], r["n"], r["tags"], r["when"], r["share"]) for r in good.collect()} == {"a": (2, 9, [], "2024-01", 1.0), 'é " x': (12, 0, None, None, None)}
    assert {r["i"]: r["reasons"] for r in bad.collect()} == {
        1: ["type:id", "type:n", "missing:tags"], 3: ["json"], 4: ["object"], 5: ["object"], 6: ["object"], 7: ["json"], 8: ["json"], 9: ["type:tags"],
        10: ["length:id", "range:n", "type:esim"], 11: ["range:n", "length:tags", "format:when", "range:share", "unknown:z"],
    }
    assert records.checked(df.where("false"), "r", FIELDS)[0].collect() == []
    every, _ = records.checked(df, "r", FIELDS)
    assert every.columns == [f.name for f in FIELDS] and every.count() == 3


def test_folder_of_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "x", "n": 1, "tags": []}, {"id": "y", "n": 2, "tags": []}], indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"id": "x", "n": 5, "tags": ["late"]}))
    (tmp_path / "remarks.txt").write_text("not read")
    got = records.read_checked(spark, str(tmp_path), FIELDS, "id")
    assert {r["id"]: r["n"] for r in got.collect()} == {"x": 5, "y": 2}
    (tmp_path / "c.json").write_text('[{"id": "z"}]')
    with pytest.raises(ValueError, match="missing:n"):
        records.read_checked(spark, str(tmp_path), FIELDS, "id")
    (tmp_path / "c.json").write_text("{broken")
    with pytest.raises(ValueError, match="json"):
        records.read_checked(spark, str(tmp_path), FIELDS, "id")


def test_bad_overrides_take_their_devices_out(spark):
    devices = spark.createDataFrame([("d1", 1), ("d2", 2), ("d3", 3)], "id string, v int")
    overrides = spark.createDataFrame([("d1", '{"note":"x"}'), ("d2", '{"note":5}'), ("d9", "{")], "device string, patch string")
    left, good, bad = records.without_bad_overrides(devices, overrides, "patch", [Field("note")], "id", "device")
    assert sorted(r["id"] for r in left.collect()) == ["d1", "d3"] and [tuple(r) for r in good.collect()] == [("d1", "x")] and {r["device"] for r in bad.collect()} == {"d2", "d9"}


def test_signals(spark):
    rows = [
        ('{"userAgent":"x","screen":{"width":390.5,"height":"a","dpr":3},"hardware":{"maxTouchPoints":1e999},"uaData":{"brands":[{"brand":"C"},{"v":1},3],"mobile":"no"}}', ("x", 391, None, 3.0, None, ["C"], None)),
        ('{"screen":{"width":-0.5},"webgl":{"vendor":"v"},"hardware":{"maxTouchPoints":0}}', (None, 0, None, None, 0, None, "v")),
        ('{"screen":{}}', (None, None, None, None, None, None, None)),
    ]
    c = F.col
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string").withColumn("s", records.signals(c("t"))).orderBy("i")
    got = df.select("s.userAgent", "s.screen.width", "s.screen.height", "s.screen.dpr", "s.hardware.maxTouchPoints", "s.uaData.brands", "s.webgl.vendor").collect()
    assert [tuple(r) for r in got] == [r[1] for r in rows]
    parts = df.select("s.screen", "s.hardware", "s.uaData", "s.webgl").collect()
    assert [[x is not None for x in r] for r in parts] == [[True, False, True, False], [True, True, False, True], [False] * 4]
    assert [r["s"] for r in spark.createDataFrame([("bad",), (None,)], "t string").select(records.signals(c("t")).alias("s")).collect()] == [None, None]


def test_configuration():
    words = {"synonyms": {"a": ["b"]}, "transliteration": {"а": "a"}, "keyboardLayout": {"й": "q"}, "insignificantAttributes": {"storagePatterns": ["1gb"], "colors": [], "networkMarkers": ["5g"], "dualSimMarkers": []}, "stopWords": ["the"]}
    d = config.dictionary(json.dumps(words))
    assert (d.synonyms, d.attributes["storage"], d.stop_words) == ({"a": ["b"]}, ["1gb"], ["the"])

    def faults(f, *args):
        with pytest.raises(config.ConfigError) as e:
            f(*args)
        return [place for place, _ in e.value.faults]

    assert faults(config.dictionary, json.dumps(words | {"synonyms": {"a": []}, "keyboardLayout": {"й": "qq"}, "stopWords": [1]})) == ["synonyms.a", "keyboardLayout.й", "stopWords"]
    assert faults(config.dictionary, "{}") and faults(config.dictionary, "[") == [""] and faults(config.dictionary, "[]") == [""]
    assert config.code_patterns('{"_note": 1, "acme": "^A"}') == {"acme": "^A"} and faults(config.code_patterns, '{"acme": "("}') == ["acme"]
    assert config.version_ceilings('{"android": 17, "ios": 26.5}') == {"android": 17.0, "ios": 26.5} and faults(config.version_ceilings, '{"android": true, "ios": -1}') == ["android", "ios"]
    assert config.subbrands('{"red": "acme"}', ["red", "acme"]) == {"red": "acme"} and faults(config.subbrands, '{"red": "none", "acme": "acme"}', ["red", "acme"]) == ["red", "acme"]
    row = {"brand": "a", "codeSuffix": "B", "region": "eu", "sources": ["http://x"]}
    assert config.code_suffixes(json.dumps([row]), ["eu"]) == [row]
    assert faults(config.code_suffixes, json.dumps([row, row | {"x": 1, "sources": []}, row | {"codeSuffix": "C", "region": "moon"}, 5]), ["eu"]) == ["[1].x", "[1].sources", "[1]", "[2].region", "[3]"]


@pytest.mark.parametrize("n,k", [(1, 5), (30, 1), (400, 5), (400, 401)])
def test_nearest_screens_equal_all_pairs(spark, n, k):
    rng = random.Random(n + k)
    screens = [(rng.choice([390, 400, rng.randint(1, 4000)]), rng.choice([844, rng.randint(1, 4000)]), rng.choice([1.0, 2.0, 2.625])) for _ in range(n)] + [(None, 5, 1.0)]
    asked = [(i, rng.choice([390, rng.randint(-50, 90_000)]), rng.randint(1, 4000), rng.choice([1.0, 2.5])) for i in range(40)] + [(98, None, 3, 1.0), (99, 390, 844, 2.0), (100, 390, 844, 2.0)]
    got = moderation.nearest_screens(spark.createDataFrame(asked, "q int, w int, h int, dpr double"), spark.createDataFrame(screens, "w int, h int, dpr double"), "q", k)
    want = set()
    for q, w, h, d in asked:
        if w is not None:
            near = sorted((abs(a - w) + abs(b - h) + 100 * abs(c - d), a, b, c) for a, b, c in set(screens) if a is not None)[:k]
            want |= {(q, a, b, c, x, r) for r, (x, a, b, c) in enumerate(near, 1)}
    assert {tuple(r) for r in got.collect()} == want


def test_nearest_of_no_screens(spark):
    none = spark.createDataFrame([], "w int, h int, dpr double")
    assert moderation.nearest_screens(spark.createDataFrame([(1, 2, 3, 1.0)], "q int, w int, h int, dpr double"), none, "q", 3).collect() == []


def plain_identities(rows, parents, titles):
    """rows: id, brand, name, codes, in order. The new (id, brand, name) of each."""

    def strip(name, word):
        first, _, rest = name.strip().partition(" ")
        return rest.strip() or None if first.lower() == word.lower() else None

    def of(brand, name):
        if brand in parents:
            return brand, strip(name, titles.get(brand, brand)) or name.strip()
        for line, parent in parents.items():
            if parent == brand and line in titles and strip(name, titles[line]):
                return line, strip(name, titles[line])
        return None

    who, links = {}, {}
    for i, brand, name, _ in rows:
        if i not in who and of(brand, name):
            who[i] = of(brand, name)
    root = {i: i for i in who}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, _, _, codes in rows:
        if i in who:
            for c in codes:
                links.setdefault((who[i][0], who[i][1].lower(), c.upper()), []).append(i)
    for ids in links.values():
        for j in ids[1:]:
            root[find(j)] = find(ids[0])
    first, size = {}, {}
    for i in who:
        first.setdefault(find(i), who[i])
        size[find(i)] = size.get(find(i), 0) + 1
    out = []
    for i, brand, name, _ in rows:
        if i in who and size[find(i)] > 1:
            line, rest = first[find(i)]
            new = "-".join([line, *rest.lower().split()])
            out.append((new, line, rest) if new != i else (i, brand, name))
        else:
            out.append((i, brand, name))
    return out


def test_identities_equal_union_find(spark):
    rng = random.Random(8)
    parents, titles = {"red": "acme", "blue": "acme", "mute": "acme"}, {"red": "Red", "blue": "Blue", "acme": "Acme"}
    rows = []
    for n in range(150):
        rest = rng.choice(["One", "one", "Two x", "hub"])
        brand, name = rng.choice([("red", rest), ("acme", f"Red {rest}"), ("acme", f" BLUE  {rest}"), ("blue", f"Blue {rest}"), ("acme", rest), ("other", rest), ("red", "Red"), ("mute", rest)])
        rows.append((rng.choice([f"id{n}", f"id{rng.randint(0, 20)}", "red-one"]), brand, name, rng.sample(["c1", "C1", "c2", "c3", f"own{n}"], rng.randint(0, 2))))
    df = spark.createDataFrame([(n, *r, "f", 1, []) for n, r in enumerate(rows)], "n int, id string, brand string, name string, codes array<string>, family string, generation int, modifiers array<string>")
    out, notices = identity.merge_identities(df, "n", parents, titles, Dictionary())
    got = {r["n"]: (r["id"], r["brand"], r["name"]) for r in out.collect()}
    want = plain_identities(rows, parents, titles)
    assert {n: (got[n], w) for n, w in enumerate(want) if got[n] != w} == {}
    assert sorted((r["id"], r["old_id"]) for r in notices.collect()) == sorted((w[0], r[0]) for w, r in zip(want, rows) if w[0] != r[0])
    same, none = identity.merge_identities(df, "n", {}, titles, Dictionary())
    assert same.count() == 150 and none.count() == 0
