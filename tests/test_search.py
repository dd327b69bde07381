"""The query front end by worked cases, and search against a plain matcher."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.functions import query as front
from quern.operators import matching

KEYS = dict(zip("йцукенгшщзхъфывапролджэячсмитьбюё", "qwertyuiop[]asdfghjkl;'zxcvbnm,.`"))
WORDS = front.Dictionary(
    {"айфон": ["iphone"], "про": ["pro"], "s23u": ["galaxy", "s23", "ultra"], "с24": ["s24"], "samsng": ["samsung"], "галакси": ["galaxy"], "самсунг": ["samsung"]},
    dict(zip("abвгдекиопрстуь", "abvgdekioprstu")) | {"ь": "", "ж": "zh"},
    KEYS, {"storage": ["128gb"], "network": ["5g"], "color": ["blue", "синий"], "dual_sim": ["dual sim"]}, ["купить"],
)
# raw, normalised, code, brand, family, generation, modifiers, unparsed
CASES = [
    ("iphone se 2", "iphone se 2", None, "iphone", "se", 2, [], []),
    ("pixel 8 a", "pixel 8 a", None, "pixel", "pixel", 8, ["a"], []),
    ("Pixel 8a", "pixel 8 a", None, "pixel", "pixel", 8, ["a"], []),
    ("galaxy s 23 ultar", "galaxy s 23 ultar", None, "galaxy", "s", 23, [], ["ultar"]),
    ("ultar", "ultar", None, "ultar", "ultar", None, [], []),  # the first word is a brand, not a damaged variant
    ("Ｇａｌａｘｙ Ⅻ", "galaxy xii", None, "galaxy", "xii", None, [], []),
    ("айфон 15 про", "iphone 15 pro", None, "iphone", "iphone", 15, ["pro"], []),
    ("купить iPhone-15Pro 128 GB blue 5G 2023", "kupit iphone 15 pro 128 gb blue 5 g 2023", None, "iphone", "iphone", 15, ["pro"], []),
    ("ыфьыгтп пфдфчн 5 pro pro", "samsung galaxy 5 pro pro", None, "samsung", "galaxy", 5, ["pro", "pro"], []),
    ("s23u", "galaxy s 23 ultra", None, "galaxy", "s", 23, ["ultra"], []),
    ("с24", "s 24", None, "s", "s", 24, [], []),
    ("sm-s928b", "sm s 928 b", "SM-S928B", None, None, None, [], []),
    (" 2201116SG ", "2201116 sg", "2201116SG", None, None, None, [], []),
    ("SM-1", "sm 1", None, "sm", "sm", 1, [], []),
    ("acme 7 9 x1 l", "acme 7 9 x 1 1", None, "acme", "x", 7, [], ["9", "1", "1"]),
    ("99999999999999999999999999999999999999999 x", "99999999999999999999999999999999999999999 x", None, "x", "x", front.LARGEST, [], []),
    (None, "", None, None, None, None, [], []),
    ("  ", "", None, None, None, None, [], []),
]


def test_front_end(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, raw string")
    rows = df.select("i", front.normalised(F.col("raw"), WORDS).alias("n")).orderBy("i").collect()
    for case, (_, n) in zip(CASES, rows):
        q = n["q"]
        assert (n["normalised"], n["code"], q["brand"], q["family"], q["generation"], q["modifiers"], q["unparsed"]) == case[1:], case[0]
        assert [t["step"] for t in n["trace"]] == list(front.steps(WORDS)) and n["trace"][-1]["value"] == n["normalised"]
    bought = rows[7]["n"]["q"]["attributes"]
    assert (bought["storage"], bought["network"], bought["color"], bought["dual_sim"], bought["year"]) == ("128gb", "5g", "blue", False, 2023)
    changed = {t["step"] for t in rows[9]["n"]["trace"] if t["changed"]}
    assert changed == {"compounds", "letters and digits"}


def test_damaged_modifiers_and_names(spark):
    words = ["pro", "rpo", "po", "prro", "pra", "amx", "mx", "xam", "ultrs", "lit", "lte", "fod", "cold", "a", "fe", "plsu"]
    got = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(front.damaged_modifier(F.col("w"))).collect()]
    assert got == [False, True, False, True, True, True, False, False, True, True, True, True, True, False, False, True]
    q = spark.range(1).select(front.marketing_slots(F.lit("Acme"), F.lit("SM-S928B"), WORDS).alias("q")).first()["q"]
    assert (q["brand"], q["family"], q["generation"], q["unparsed"]) == ("acme", "sm-s-b", 928, [])


def grams(t):
    p = f"  {t.lower()}  "
    return [p[i : i + 3] for i in range(len(p) - 2)]


@pytest.mark.parametrize("k,least", [(1, 1), (3, 1), (3, 4), (50, 1)])
def test_top_shared_trigrams_equals_all_pairs(spark, k, least):
    rng = random.Random(k)
    stems = ["alpha", "alp", "beta", "gamma ray", "ray", "common common", "zz"]
    text = lambda: " ".join(rng.choice(stems) + rng.choice(["", "x", "7", " y"]) for _ in range(rng.randint(1, 3)))
    asks, own = [text() for _ in range(60)] + ["", None, "qqq"], [text() for _ in range(120)] + ["", None]
    got = matching.top_shared_trigrams(spark.createDataFrame([(a,) for a in asks], "a string"), spark.createDataFrame([(o,) for o in own], "o string"), "a", "o", k, least)
    want = set()
    for a in {a for a in asks if a is not None}:
        n = Counter(grams(a))
        found = sorted((-sum(n[g] for g in set(grams(o))), o) for o in {o for o in own if o is not None})
        want |= {(a, o, -s, r) for r, (s, o) in enumerate([f for f in found if -f[0] >= least][:k], 1)}
    assert {tuple(r) for r in got.collect()} == want


# --- a plain matcher


def osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def jaro_winkler(a, b):
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
    s = (k / len(a) + k / len(b) + (k - t / 2) / k) / 3
    p = next((i for i in range(min(4, len(a), len(b)), 0, -1) if a[:i] == b[:i]), 0)
    return s + p * 0.1 * (1 - s)


def plain_search(asks, catalog, known, sure=0.8, gap=0.08):
    """asks: (query, q, code, words); catalog: (id, name, codes, aliases, d, status). Outcome by query."""

    def own_text(d):
        words = "".join(c if c.isascii() and c.isalnum() else " " for c in f"{d['brand']} {d['family']}".lower()).split()
        return " ".join(x for x in ("".join(c for c in w if not c.isdigit()) for w in words if w not in d["modifiers"]) if x)

    codes, aliases = defaultdict(set), defaultdict(set)
    for i, name, cs, als, d, _ in catalog:
        for c in cs:
            codes[c.strip().upper()].add(i)
        for a in [*als, name]:
            aliases[" ".join(a.lower().split())].add(i)
    by_id = {c[0]: c for c in catalog}

    def letters(q):
        parts = (q["family"] or "").split("-") if q["family"] else []
        single = [p for p in parts[1:] if len(p) == 1]
        if parts and len(parts[0]) == 1 and (len(parts) == 1 or single):
            single = [parts[0], *single]
        return {*single, *(m for m in q["modifiers"] if len(m) == 1)}

    def similar(q, d):
        return max(jaro_winkler(q["brand"], d["brand"]), jaro_winkler(q["brand"], d["family"]))

    def brand_of(b):
        b = b.lower()
        if b in known or not b:
            return b
        s, _, near = max((jaro_winkler(b, k), -i, k) for i, k in enumerate(known))
        return near if s >= 0.85 else b

    def rejected(q, d):
        if q["brand"] is not None:
            anchor = d["family"].split("-")[0].lower()
            words = [w.lower() for w in [q["brand"], *(q["family"] or "").split("-")] if w]
            names = any(w == d["brand"].lower() or (len(anchor) > 1 and w == anchor) for w in words)
            other = d["brand"].lower() in known and brand_of(q["brand"]) in known and brand_of(q["brand"]) != d["brand"].lower()
            if not names and (similar(q, d) < 0.5 or other):
                return True
        if q["generation"] is not None and q["generation"] != d["generation"]:
            return True
        if q["modifiers"] and (len(q["modifiers"]) != len(d["modifiers"]) or set(q["modifiers"]) - set(d["modifiers"])):
            return True
        return bool(letters(q)) and letters(q) != letters(d)

    def text_of(q):
        return " ".join(x for x in [q["brand"], q["family"].replace("-", " ") if q["family"] is not None and q["family"] != q["brand"] else None] if x is not None)

    def score(q, d, code):
        asked, own = text_of(q), own_text(d)
        words = 0 if q["brand"] is None else 1 if q["family"] in (None, q["brand"]) else 1 + len(q["family"].split("-"))
        known_words = words + (q["generation"] is not None) + len(q["modifiers"])
        total = known_words + len(q["unparsed"])
        parts = [
            (0.15, 1 if q["brand"] is None else similar(q, d)),
            (0.15, q["generation"] is None or q["generation"] == d["generation"]),
            (0.1, not q["modifiers"] or set(q["modifiers"]) == set(d["modifiers"])),
            (0.4, 1 if code else 0 if not asked else max(1 - osa(asked, own) / max(len(asked), len(own)), jaro_winkler(asked, own))),
            (0.15, 1 if code else known_words / total if total else 0),
            (0.05, d["popularity"] / (d["popularity"] + 10) if d["popularity"] > 0 else 0),
        ]
        return sum(w * v for w, v in parts)

    def narrower(q, d, code):
        wide = ["pro", "max", "plus", "ultra", "mini", "fe", "lite", "air", "fold", "flip"]
        return not code and ((not letters(q) and bool(letters(d))) or (not q["modifiers"] and any(m in wide for m in d["modifiers"])))

    out = {}
    for query, q, code, words in asks:
        if code:
            found = codes.get(code, set())
            ids = found if len(found) == 1 else set()
        elif len(hit := aliases.get(" ".join(words.lower().split()), set())) == 1:
            (first,) = hit
            line = by_id[first][4]
            family = {c[0] for c in catalog if c[4]["family"] == line["family"] and (q["generation"] is None or c[4]["generation"] == q["generation"])}
            ids = family if not q["modifiers"] and len(family) > 1 else hit
        else:
            g = set(grams(text_of(q))) if text_of(q) else set()
            ids = {c[0] for c in catalog if g & set(grams(own_text(c[4])))}
        ranked = sorted((-score(q, by_id[i][4], code), -by_id[i][4]["popularity"], i) for i in ids if not rejected(q, by_id[i][4]))
        if not ranked:
            out[query] = (None, "NOT_FOUND", "clarification_required", [])
            continue
        top, leader = -ranked[0][0], ranked[0][2]
        lead = top - (-ranked[1][0] if len(ranked) > 1 else 0)
        near = [i for s, _, i in ranked if top < sure or top + s < gap]
        same = not q["unparsed"] and len({by_id[i][5] for i in near}) == 1
        if top >= sure and lead >= gap:
            outcome = "DETERMINED"
        elif same:
            outcome = "RESOLVED_BY_EQUIVALENCE"
        else:
            outcome = "BELOW_THRESHOLD" if top < sure else "GAP_TOO_SMALL"
        if narrower(q, by_id[leader][4], code) and (top >= sure and lead >= gap or (outcome == "RESOLVED_BY_EQUIVALENCE" and len(near) == 1)):
            outcome = "GAP_TOO_SMALL"
        shown = [leader] if top >= sure and lead >= gap else near[:5]
        out[query] = (leader, outcome, by_id[leader][5] if outcome in ("DETERMINED", "RESOLVED_BY_EQUIVALENCE") else "clarification_required", shown)
    return out


def small_catalog():
    none = []
    lines = [("apple", "iphone", g, m) for g in (11, 12, 13) for m in ([], ["pro"], ["pro", "max"])] + [("samsung", f"galaxy-{x}", 23, m) for x in "sam" for m in ([], ["fe"], ["ultra"])]
    lines += [("oppo", "find-x", 5, none), ("poco", "poco-x", 5, ["pro"]), ("xiaomi", "redmi-note", 12, none), ("xiaomi", "redmi-note", 12, ["pro"]), ("samsung", "galaxy-z", 5, ["flip"]), ("apple", "iphone", None, none)]
    rows = []
    for i, (brand, family, generation, modifiers) in enumerate(lines):
        name = f"{family.replace('-', ' ')} {generation or ''} {' '.join(modifiers)}".strip()
        rows.append((i, name, [f"SM-S{100 + (i // 2 if i < 10 else i)}B"], [f"{brand} {name}", "shared alias" if i < 2 else f"only {i}"], {"brand": brand, "family": family, "generation": generation, "modifiers": modifiers, "popularity": float(i % 7)}, ["supported", "not_supported", "supported"][i % 3]))
    return rows


def test_search_equals_plain_matcher(spark):
    catalog = small_catalog()
    known = ["apple", "samsung", "oppo", "poco", "xiaomi"]
    rng = random.Random(2)
    raws = ["iphone 12 pro", "iphone 13", "iphon 13 pro", "айфон 12 про", "galaxy s 23 ultar", "galaxy s23 ultra", "samsng galaxy a 23", "SM-S112B", "sm-s103b", "SM-X999", "shared alias", "only 3", "only 9", "zzz 99", "", "poco x 5", "oppo x 5 pro", "redmi note", "redmi note 12 pro blue 128gb", "x 5", "galaxy", "iphone", None, "flip", "samsung galaxy z 5 flip"]
    raws += [" ".join(rng.sample(["iphone", "galaxy", "s", "a", "12", "23", "pro", "max", "note", "redmi", "ipone", "samsung"], rng.randint(1, 5))) for _ in range(80)]
    cat = spark.createDataFrame(catalog, "id int, name string, codes array<string>, aliases array<string>, d struct<brand:string,family:string,generation:int,modifiers:array<string>,popularity:double>, status string")
    asks = matching.asked(spark.createDataFrame(list(enumerate(raws)), "n int, raw string"), "n", "raw", WORDS)
    rows = [(r["query"], r["q"].asDict(), r["code"], r["words"]) for r in asks.collect()]
    assert len(rows) == len(raws)
    got = {r["query"]: (r["leader"], r["outcome"], r["status"]) for r in matching.search(asks, cat, known).collect()}
    want = {i: w[:3] for i, w in plain_search(rows, catalog, known).items()}
    assert {raws[i]: (got[i], want[i]) for i in got if got[i] != want[i]} == {}
    assert len({o for _, o, _ in want.values()}) == 5
    tiers = Counter(r["reason"] for r in matching.retrieve(asks, cat).collect())
    assert len(tiers) == 3
    with pytest.raises(ValueError):
        matching.suggest(asks, cat, 11)
    best = matching.suggest(asks, cat, 3, known).collect()
    assert all(1 <= r["rank"] <= 3 for r in best) and {r["query"] for r in best} == {i for i, w in want.items() if w[0] is not None}


def test_responses_follow_the_decisions(spark):
    """Answers by branch; a device's status follows from its support, conditions, region and confidence."""
    from quern.functions import rules

    china, asked = [("region", "CN", "not_supported")], ("region", "Where?", [("CN", "China"), ("x", "Other")])
    base = small_catalog()
    kinds = {0: ("supported", [], "verified", None), 1: ("not_supported", [], "derived", None), 2: ("conditional", china, "verified", asked), 3: ("supported", [], "unverified", None)}
    kind = lambda i: kinds[2] if base[i][4]["family"].startswith("galaxy") else kinds[0] if base[i][4]["brand"] == "apple" and i % 4 else kinds[i % 4]

    def status(i, region):
        support, conditions, confidence, _ = kind(i)
        said = support if support != "conditional" else "not_supported" if region == "CN" else "clarification_required" if region is None else "supported"
        return "clarification_required" if confidence == "unverified" else said

    schema = "id int, name string, codes array<string>, aliases array<string>, d struct<brand:string,family:string,generation:int,modifiers:array<string>,popularity:double>"
    facts = "support string, conditions array<struct<scope:string,value:string,support:string>>, confidence string, question struct<kind:string,question:string,options:array<struct<value:string,label:string>>>"
    cat = spark.createDataFrame([(*c[:5], *kind(c[0])) for c in base], f"{schema}, {facts}")
    known = ["apple", "samsung", "oppo", "poco", "xiaomi"]
    raws = [(r, g) for r in ["iphone 12 pro", "iphone 13", "iphone", "galaxy s23 ultra", "galaxy s 23", "galaxy s 23 ultar", "samsung galaxy", "zzz 99", "SM-S112B", "redmi note 12", "poco x 5", "only 7", "flip", ""] for g in (None, " cn", "US")]
    rows = spark.createDataFrame([(i, r, g) for i, (r, g) in enumerate(raws)], "n int, raw string, region string")
    asks = matching.asked(rows, "n", "raw", WORDS).join(rows.select(F.col("n").alias("query"), "region"), "query")
    slots = {r["query"]: (r["query"], r["q"].asDict(), r["code"], r["words"]) for r in asks.collect()}
    got = {r["query"]: r for r in matching.respond(asks, cat, known).collect()}
    assert len(got) == len(raws)
    branches = set()
    for i, (raw, region) in enumerate(raws):
        place = region and region.strip().upper()
        items = [(*c[:5], status(c[0], place)) for c in base]
        leader, outcome, said, shown = plain_search([slots[i]], items, known)[i]
        single = outcome == "DETERMINED" or (outcome == "RESOLVED_BY_EQUIVALENCE" and len(shown) == 1)
        group = outcome == "RESOLVED_BY_EQUIVALENCE" and not single
        r, where = got[i], (raw, region)
        assert (r["status"], r["device"]) == (said, leader if single else None), where
        open_ = outcome in ("GAP_TOO_SMALL", "BELOW_THRESHOLD")
        assert [m["id"] for m in r["matches"]] == (shown if open_ else []), where
        assert r["task"] == ("unmatched_query" if outcome == "NOT_FOUND" else "ambiguous_query" if open_ else None), where
        asks_own = [kind(x)[3] is not None and status(x, place) == rules.ASK for x in (shown if group else [leader])] if leader is not None else [False]
        kind_of = "manual_input" if outcome == "NOT_FOUND" else "choose_candidate" if open_ else None if said != rules.ASK else "answer_question" if all(asks_own) else "check_on_device"
        assert (r["clarification"] and r["clarification"]["kind"]) == kind_of, where
        branches.add((single, group, open_, kind_of))
    assert len(branches) >= 6
