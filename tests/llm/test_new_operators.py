"""op11 to op13 against plain versions: whole queries on small tables, and their operators on odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import collocations, conversations, url_filters
from quern.llm.shared import Scratch

BLANK = " \t\n\x0b\x0c\r"


# --- op11

URLS = ["http://a.org/x", "https://EXAMPLE.org/es/1", "http://www.example.org/en/15?q=1#f", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/de/9", "http://com/de/", "http://notcom/de/", "http://x.net/", "no scheme", None, "", "http://x.org", "http://x.org?a=/fr/", "ftp://b.example.com/fr", "http://org/", "a://b://c.org/d", "http://ÄB.org/ü", "http://a.org/two\nlines", "http://" + "s." * 300 + "com/de/" + "p" * 5000]


def fits(host, path, rule_host, rule_path):
    return (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path)


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    return host.translate(str.maketrans(url_filters.UPPER, url_filters.LOWER)), path


def plain_verdicts(urls, rules, default="allow"):
    out = []
    for u in urls:
        host, path = plain_url(u)
        best = max([(len(h + p), len(h), h + p, a) for h, p, a in rules if host and fits(host, path, h, p)], default=None)
        out.append((u, host, path, best and best[2], best[3] if best else default))
    return out


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("repeats", [1, 3])
def test_op11_equals_plain_rules(spark, tmp_path, repeats):
    rows = [(i if i % 7 else None, u, "<p>", "h", "p", "r", "v") for i, u in enumerate(URLS * repeats)]
    spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string, rule string, verdict string").write.parquet(str(tmp_path / "pages.parquet"))
    out = url_filters.op11_url_filters(spark, str(tmp_path))
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = [(r[0], *w[1:]) for r, w in zip(rows, plain_verdicts([r[1] for r in rows], url_filters.RULES))]
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)


def test_cascade_of_many_rules_is_exact(spark):
    """Thousands of rules of both actions; the first level errs often, so that many levels are needed."""
    rng = random.Random(4)
    hosts = [f"h{i}.{d}" for i in range(400) for d in ("org", "com", "b.net")]
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h in rng.sample(hosts, 500) for p in rng.sample([f"/{c}/" for c in "abcdefgh"] + ["/", "", "/ab"], 4)}.values())
    urls = [f"http://{rng.choice(['', 'www.', 'x.y.'])}{rng.choice(hosts)}/{rng.choice('abcdefghij')}{rng.choice(['/', 'b', ''])}{rng.randint(0, 99)}" for _ in range(4000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    frame = spark.createDataFrame([*rules, rules[0], (None, "/", "block"), ("x.org", None, "block"), ("x.org", "/", "deny"), ("", "/", "block")], "host string, path string, action string")
    want = sorted(plain_verdicts(urls, rules), key=key)
    with Scratch(spark) as scratch:
        for most in (1 << 27, 10):  # 10 bytes: the join takes over
            got = url_filters.judge_urls(pages, frame, scratch, most_bytes=most).select("url", "host", "path", "rule", "verdict")
            assert sorted(map(tuple, got.collect()), key=key) == want


def test_cascade_levels(spark):
    listed = spark.range(2000).select(*url_filters.hashed(F.col("id").cast("string")))
    universe = spark.range(60_000).select(*url_filters.hashed(F.col("id").cast("string")))
    with Scratch(spark) as scratch:
        cascade = url_filters.build(listed, universe.unionByName(universe), scratch, first_rate=0.5)
        assert len(cascade.levels) > 5 and cascade.n_bytes < 60_000
        rows = universe.toPandas()
        assert cascade.member(rows["h1"].to_numpy(), rows["h2"].to_numpy()).tolist() == [i < 2000 for i in range(60_000)]
        assert url_filters.build(listed.where("false"), universe, scratch).levels == []
        assert url_filters.build(listed, universe, scratch, most_bytes=8) is None


def test_op11_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, action string")
    rules = spark.createDataFrame(url_filters.RULES, none.schema)
    with Scratch(spark) as scratch:
        assert [tuple(r) for r in url_filters.judge_urls(pages, none, scratch).collect()] == [(1, "http://a.org/", "a.org", "/", None, "allow")]
        assert url_filters.judge_urls(pages.where("false"), rules, scratch).collect() == []


# --- op12


def plain_collocations(rows, least=30, top=2000):
    f, n = defaultdict(Counter), Counter()
    low = str.maketrans(url_filters.UPPER, url_filters.LOWER)
    for lang, text in rows:
        lang = lang or "und"
        for c in ".,;:!?\n\x0b\x0c\r":
            text = (text or "").translate(low).replace(c, "\0")
        for piece in text.split("\0"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rest = []
        for p, a in found.items():
            if any(100 * b >= 80 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rest.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rest)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts_with_phrases(seed=1, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Émile", "x\u00a0y", "'", "日本"]
    fixed = ["alpha Beta gamma delta", "gamma delta", "new York", "New york city hall", "aa aa aa aa aa", "o o"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))]
        rows.append((rng.choice(["en", "en", "de", None, "und"]), "".join(p + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", " ? "]) for p in parts)))
    return rows + [("en", None), (None, ""), ("en", " .,\n "), ("fr", "only once here"), ("en", "long piece " * 20_000), ("de", ("end. " * 3000 + "w1 w2 w3 ") * 30)]


@pytest.mark.parametrize("part,shard", [(1 << 20, 1 << 20), (700, 500)])
def test_phrase_counts_equal_plain_ones(spark, tmp_path, part, shard):
    rows = texts_with_phrases()
    docs = spark.createDataFrame([(i, t, lang, "f", 1) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, rank int").repartition(3)
    with Scratch(spark) as scratch:
        got = {(r["lang"], r["phrase"]): r["f"] for r in collocations.phrase_counts(docs, scratch, part_bytes=part, shard=shard).where("words > 1").collect()}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = plain_collocations(rows)
    assert want and all(got[w[0], w[2]] == w[3] for w in want)
    assert sorted(map(tuple, collocations.op12_phrase_collocations(spark, str(tmp_path)).collect())) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(collocations.OP12_SQL).fetchall()) == want


def test_collocations_top_and_empty(spark):
    docs = spark.createDataFrame([("en", t) for _, t in texts_with_phrases(2)], "lang string, text string")
    whole = sorted(map(tuple, collocations.collocations(docs).collect()))
    assert [r for r in whole if r[1] <= 3] == sorted(map(tuple, collocations.collocations(docs, top=3).collect()))
    assert collocations.collocations(docs.where("false")).collect() == []


def test_suffix_automaton_states():
    """States are the classes of equal end sets, with the right counts and links."""
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 5, 400)
    joined = rng.random(400) < 0.8
    joined[0] = False
    context = np.ones(400, np.int8)
    for i in range(1, 400):
        context[i] = min(4, context[i - 1] + 1) if joined[i] else 1
    a = collocations.Automaton(ids, context)
    ends = defaultdict(set)
    for i in range(400):
        for d in range(1, context[i] + 1):
            ends[tuple(ids[i - d + 1 : i + 1])].add(i)
    classes = defaultdict(list)
    for string, where in ends.items():
        classes[frozenset(where), string[-1]].append(string)
    assert len(a.count) == len(classes)
    for end, shortest, longest, count, link in zip(a.end, a.shortest, a.longest, a.count, a.link):
        string = tuple(ids[end - longest + 1 : end + 1])
        assert sorted(map(len, classes[frozenset(ends[string]), string[-1]])) == list(range(shortest, longest + 1))
        assert len(ends[string]) == count
        parent = string[longest - shortest + 1 :]
        assert (link == -1) == (not parent)
        if parent:
            assert a.count[link] == len(ends[parent]) and a.longest[link] == shortest - 1
    assert len(collocations.Automaton(ids[:0], context[:0]).count) == 0


# --- op13


def plain_repair(turns):
    """turns: (role, text) in order. Counts, least cost with its least audit, and the repaired turns, by plain dynamic programming."""
    faults, seen = [], set()
    for role, text in turns:
        stripped = text.strip(BLANK)
        faults.append("blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else "")
        seen.add((role, text))
    n = len(turns)
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, last, inserted):
        found = [(0, "", ())] if i == n and last in ("", "a") else []
        def add(cost, edit, now, nxt):
            c, audit, made = best(*nxt)
            found.append((cost + c, edit + audit, now + made))
        if inserted < 3:
            for to in follow[last].replace("s", ""):
                add(2, "I", (({"u": "user", "a": "assistant"}[to], ""),), (i, to, inserted + 1))
        if i < n:
            role, text = turns[i]
            add(3, "D", (), (i + 1, last, 0))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if role[:1] and role[0] in follow[last]:
                    add(more, "K", ((role, text),), (i + 1, role[0], 0))
                for to in follow[last].replace("s", ""):
                    add(2 + more, "R", (({"u": "user", "a": "assistant"}[to], text),), (i + 1, to, 0))
        return min(found, default=(10**9, "", ()))

    for i in range(n, 0, -1):  # from the end, so that calls stay shallow
        for last in follow:
            best(i, last, 0)
    cost, audit, made = best(0, "", 0) if n else (0, "", ())
    illegal = sum((a[0][:1] or "-") + (b[0][:1] or "-") not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    told = "\n".join(f"{r}:{t}" for r, t in made)
    return faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(told.encode()).hexdigest()


def plain_op13(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        by[conv] += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    out = []
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.md5(t[2].encode()).hexdigest()))
        numbers = {t[0] for t in turns if t[0] is not None}
        out.append((conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *plain_repair([t[1:] for t in turns])))
    return sorted(out, key=key)


def conversation_rows(seed, convs, most=12):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "cut off", "", "  ", "Tell me more. ", "a\nb.", "é日.", None, "\u00a0"]
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire", "Ärger"])
            rows.append((c, t if rng.random() < 0.95 else None, role, rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}."))
    return rows + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, None, None), *rows[:5]]


def op13(spark, rows, path):
    spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, conv string").repartition(3).write.parquet(str(path / "conversations.parquet"))
    out = conversations.op13_conversation_repair(spark, str(path))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, out.collect()), key=key)


def test_op13_equals_plain_repair(spark, tmp_path):
    rows = conversation_rows(5, 400)
    assert op13(spark, rows, tmp_path) == plain_op13(rows)


def test_op13_of_one_long_conversation(spark, tmp_path):
    """Most turns are one conversation's, which spans all ranges; many of its turns are alike."""
    rng = random.Random(6)
    rows = conversation_rows(7, 30) + [(999, t, rng.choice(["user", "assistant"]), rng.choice(["same.", "again", f"own {t}."])) for t in range(300)] + [(998, None, "user", "tied.")] * 40
    assert op13(spark, rows, tmp_path) == plain_op13(rows)


@pytest.mark.parametrize("held,chunk", [(2, 3), (4096, 4096)])
def test_long_conversations_give_the_same(spark, held, chunk):
    rows = conversation_rows(8, 60)
    turns = conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    with Scratch(spark) as scratch:
        got = conversations.repair(turns, scratch, held=held, chunk=chunk)
        verdicts = {r["conv"]: r for r in got.verdicts.collect()}
        long = defaultdict(list)
        for r in got.long_turns.orderBy("conv", "place").collect():
            long[r["conv"]].append(f"{r['role']}:{r['text']}")
    for conv, gaps, *counts, audit, digest in plain_op13(rows):
        r = verdicts["null" if conv is None else f"c{conv}"]
        assert [r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]] == [gaps, *counts, audit]
        told = "\n".join([f"{t['role']}:{t['text']}" for t in r["turns"]] if r["turns"] is not None else long[r["conv"]])
        assert hashlib.sha256(told.encode()).hexdigest() == digest


def test_op13_empty_and_all_dropped(spark, tmp_path):
    (tmp_path / "a").mkdir()
    assert op13(spark, [], tmp_path / "a") == []
    gone = [(c, t, "user", "x.") for c in range(2000) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:9]
    got = op13(spark, gone, tmp_path)
    assert got == sorted({(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in gone}, key=key)


def test_layers_against_plain_repair():
    layers, rng = conversations.Layers(), random.Random(1)
    for _ in range(1500):
        turns = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b.", "c", "", f"{rng.random()}."])) for _ in range(rng.randint(1, 14))]
        seen: set = set()
        faults = [conversations.fault_of(r, t, seen) for r, t in turns]
        row, edits = conversations.judged(layers, "".join(conversations.letter(r) for r, _ in turns), faults)
        assert tuple(row.values()) == plain_repair(turns)[:6]
    assert len({after for after, *_ in layers.steps}) < 60
