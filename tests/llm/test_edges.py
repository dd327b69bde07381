"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names; and the pipeline's stages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import embedding_dedup, minhash_dedup, mixing, quality_classifier, quality_rules, repair, toxicity, warc_revisit
from quern.llm.shared import Scratch, new_path

CLASH = "doc_id long, text string, lang string, source string, n_chars long, label int, _st_n_words int, _mix_size int, row string, rank int"
LABELS = "doc_id long, quality int, toxic int"
CAPTURES = "record_id string, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, payload string"


def clashing(spark, n=60, seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " ", "one", "x" * 60_000, "long " * 30_000] + [" ".join(rng.choice(words) for _ in range(rng.randint(20, 90))) for _ in range(n)]
    texts += texts[8:12] + [texts[20] + " more"]
    rows = [(i, t, "en", ["a", "b", None][i % 3], None, 7, 1, 2, "r", 3) for i, t in enumerate(texts)]
    rows += [rows[30], rows[30], (None, texts[40], "en", "a", None, 7, 1, 2, "r", 3), (31, "another text of an id that is there already " * 5, "en", "a", None, 7, 1, 2, "r", 3)]
    return spark.createDataFrame(rows, CLASH)


def test_stages_pass_clashing_columns_and_odd_rows(spark, tmp_path):
    docs = clashing(spark)
    spark.createDataFrame([(i, int(i % 5 > 0), int(i % 9 == 0)) for i in range(60)] + [(3, None, None), (8, 0, 1)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns and {r["label"] for r in rows} <= {7}
        assert rows, name
        empty = stage(spark, docs.where("false"), str(tmp_path))
        assert empty.columns == out.columns and empty.count() == 0


def test_pipeline_applies_its_stages(spark, tmp_path):
    clashing(spark).select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name in ("toxicity", "near-duplicates"):
            assert 0 < docs.count() <= before
        if name == "quality rules":  # with one class of labels the base checks alone decide
            assert all(len((r["text"] or "").split()) >= 20 for r in docs.collect())
    want = sorted((r["doc_id"], r["piece"], r["start"], r["length"]) for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect())
    got = sorted((r["doc_id"], r["piece"], r["start"], r["length"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and got


def test_repeated_ids_in_near_duplicates(spark):
    base = " ".join(f"a{i}" for i in range(40))
    other = " ".join(f"b{i}" for i in range(40))
    rows = [(1, base), (2, base + " end"), (2, other), (3, other + " end"), (3, other + " end"), (4, "alone in the world today"), (None, base), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(df).where("doc_id is not null").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in minhash_dedup.keep_one(df).where("doc_id is null or doc_id < 5").collect())
    assert kept == [(0, base), (1, base), (4, "alone in the world today")]
    two = spark.createDataFrame([(1, base), (1, other), (1, base)], "doc_id long, text string")
    assert sorted(r["text"] for r in minhash_dedup.keep_one(two).collect()) == [base, other]


def test_shared_passage_of_unlike_documents(spark):
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(60)]
    texts = [" ".join(shared + [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(15, 30))]) for _ in range(150)]
    texts += [t + " tail" for t in texts[:20]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(df).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {i: find(i) for i in range(len(texts))}


def test_revisits_are_rows_each(spark):
    head = {"content-type": "t"}
    r = ("r", "http://ex.com/a", 10, "response", "t1", None, head, "body")
    v = ("v", "http://ex.com/a", 20, "revisit", "t1", None, {"x": "1"}, None)
    rows = [r, r, v, v, (None, "http://ex.com/a", 30, "revisit", "t1", None, None, None), ("u", None, 30, "revisit", "t1", None, None, None), ("w", "http://ex.com/a", None, "revisit", "t1", None, None, None), ("early", "http://ex.com/a", 5, "revisit", "t1", None, None, None), ("q", "http://ex.com/a", 40, "request", None, None, None, None)]
    df = spark.createDataFrame(rows, CAPTURES)
    got = sorted(((x["record_id"] or "", x["response_id"], x["outcome"], x["payload"]) for x in warc_revisit.resolve_revisits(df).collect()), key=str)
    assert got == sorted([("v", "r", "etag", "body")] * 2 + [("", "r", "etag", "body"), ("u", None, "no response", None), ("w", None, "no response", None), ("early", None, "no response", None)], key=str)
    assert warc_revisit.resolve_revisits(df.where("false")).count() == 0


def test_revisits_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        kind = rng.choice(["response", "revisit", "revisit"])
        rows.append((f"x{i:03}", rng.choice(["http://a.com/", "http://b.com/x", "http://hot.com/"]), rng.randint(0, 60), kind, rng.choice(["1", "W/1", "2", None]), rng.choice(["mon", "tue", None]), {"k": str(i)}, f"p{i}" if kind == "response" else None))
    want = {}
    for v in rows:
        if v[3] == "revisit":
            before = [r for r in rows if r[3] == "response" and r[1] == v[1] and (r[2], r[0]) < (v[2], v[0])]
            r = max(before, key=lambda r: (r[2], r[0]), default=None)
            plain = lambda t: t and t.removeprefix("W/")
            if r is None:
                want[v[0]] = (None, "no response", None)
            elif v[4] is not None:
                ok = plain(v[4]) == plain(r[4])
                want[v[0]] = (r[0], "etag" if ok else "validator differs", r[7] if ok else None)
            elif v[5] is not None:
                want[v[0]] = (r[0], "last-modified" if v[5] == r[5] else "validator differs", r[7] if v[5] == r[5] else None)
            else:
                want[v[0]] = (r[0], "no validator", None)
    got = {x["record_id"]: (x["response_id"], x["outcome"], x["payload"]) for x in warc_revisit.resolve_revisits(spark.createDataFrame(rows, CAPTURES), ranges=7).collect()}
    assert got == want


def test_warc_records_survive_damage():
    good = warc_revisit.record_bytes({"WARC-Type": "response"}, b"one")
    bad = good.replace(b"Content-Length: 3", b"Content-Length: many")
    assert [r["block"] for r in warc_revisit.records(bad + good)] == [b"one"]


def test_links_are_symmetric_at_dimension_64(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    b = rng.standard_normal((300, 64))
    b -= (x * b).sum(1, keepdims=True) * x
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    v = np.concatenate([x, 0.902 * x + (1 - 0.902**2) ** 0.5 * b, 0.97 * x + (1 - 0.97**2) ** 0.5 * b])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>"), block=64).collect()}
    assert [got[i] for i in range(len(v))] == want.tolist()
    assert embedding_dedup.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_classifiers_without_labels_and_rows(spark):
    docs, labels = clashing(spark), spark.createDataFrame([], LABELS)
    scored = quality_classifier.scored(docs, labels.select("doc_id", F.col("quality").alias("label")))
    assert {r["score"] for r in scored.collect()} == {0.5} and scored.count() == docs.count()
    assert quality_classifier.scored(docs.where("false"), labels.select("doc_id", F.col("quality").alias("label"))).count() == 0
    assert {r["score"] for r in toxicity.toxicity_scores(docs, toxicity.learn(docs, labels)).collect()} == {0.5}
    assert toxicity.toxicity_scores(docs.where("false"), {}).count() == 0


def test_rule_ensemble_learns_a_conjunction():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (1500, 10))
    y = ((x[:, 2] > 0.6) & (x[:, 4] < 0.5)).astype(float)
    rules, bias = quality_classifier.fit(x[:1000], y[:1000])
    margin = bias + sum(w * quality_classifier.holds(r, x[1000:]) for r, w in rules)
    assert ((margin > 0) == (y[1000:] == 1)).mean() > 0.97


def test_toxicity_scores_equal_a_plain_sum(spark):
    texts = ["Bad dog", None, "", "bad bad, dog"]
    model = {int(h): 0.1 * (k + 1) for k, h in enumerate(np.unique(np.concatenate(toxicity._distinct(__import__("pyarrow").array(["bad dog"]), 12))))} | {-1: -0.3}
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, 12).collect()}
    full = sum(v for v in model.values())
    assert got[0] == pytest.approx(1 / (1 + np.exp(-full))) and got[1] == got[2] == pytest.approx(1 / (1 + np.exp(0.3)))


def test_mix_comes_close(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([1, 2, 5, 40, 900])), rng.choice(["a", "b", "c"])) for i in range(500)] + [(900, None, "zero"), (901, "", "zero")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.col("source"), mixing.cycling_targets()).collect()
    held = {s: sum(r["_mix_size"] for r in out if r["source"] == s) for s in ("a", "b", "c", "zero")}
    target = mixing.cycling_targets()(held)
    for s in held:
        assert abs(sum(r["_mix_size"] * r["_mix_copies"] for r in out if r["source"] == s) - target[s]) <= 20  # half of the third smallest size
    assert all(0 <= r["_mix_copies"] <= 2 for r in out)


def test_rules_of_a_shard_are_used_twice_or_more():
    ids = np.random.default_rng(1).zipf(1.3, 60_000).clip(0, 3000).astype(np.uint32)
    rules, seq = repair.compress(ids, 3001)
    used = np.bincount(np.concatenate([seq, rules.ravel()]).astype(np.int64), minlength=3001 + len(rules))[3001:]
    inner = np.bincount(rules.ravel().astype(np.int64), minlength=3001 + len(rules))[3001:]
    assert len(rules) and ((used >= 2) | (inner > 0)).all() and (repair.expand(seq, rules, 3001) == ids).all()


def test_scratch_leaves_only_what_is_kept(spark):
    with Scratch(spark) as scratch:
        kept, gone = scratch.stored(spark.range(3), "a", keep=True), scratch.stored(spark.range(3), "b")
    assert kept.count() == 3 and new_path(spark, "x") != new_path(spark, "x")
    with pytest.raises(Exception):  # noqa: B017
        gone.count()
    assert quality_rules.learn_list([]) == []
