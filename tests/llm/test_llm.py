import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import embedding_dedup, minhash_dedup, mixing, packing, quality_rules, repair, token_counts, toxicity, warc_revisit
from quern.llm.statistics import with_statistics
from quern.llm.tokens import encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_frame(spark, texts, sources=None):
    rows = [(i if i != 3 else 3, t, None, (sources or ["a", None])[i % len(sources or ["a", None])], None, 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_texts(n=40, seed=0):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "don't", "été", "日本", "<|endoftext|>", "!!", "12", "$x"]
    out = [None, "", "   ", "\n\n", "one", "x" * 50_000]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) + rng.choice(["", "\n", "  end"]) for _ in range(n)]
    return out + out[6:12]


def test_piece_encoding_equals_the_library():
    own = encoder(token_counts.TOKENIZER)
    texts = odd_texts()
    want = [e.ids for e in own.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = [f[o[i] : o[i + 1]].tolist() for f, o in own.ids(pa.array(texts)) for i in range(len(o) - 1)]
    assert got == want and own.counts(pa.array(texts)).tolist() == list(map(len, want))


@pytest.mark.parametrize("chunk, overlap", [(7, 3), (40, 8), (100, 33)])
def test_resynchronised_chunks_equal_the_whole(chunk, overlap):
    own = encoder(token_counts.TOKENIZER).library
    for t in odd_texts(15, 1)[6:] + ["x" * 500, "ab " * 90]:
        got = [int(x) for part in token_counts.resynchronised(own, t, chunk, overlap) for x in part]
        assert got == own.encode(t, add_special_tokens=False).ids


def test_token_counts_of_odd_rows(spark):
    texts = odd_texts()
    own = encoder(token_counts.TOKENIZER).library
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(docs_frame(spark, texts), huge=100, chunk=64, overlap=40).collect()}
    assert got == {i: (len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    assert token_counts.token_counts(docs_frame(spark, [])).count() == 0


def test_best_fit_equals_the_plain_algorithm():
    rng = random.Random(0)
    for _ in range(100):
        cap = rng.choice([5, 16, 37])
        counts = {n: rng.randint(1, 9) for n in rng.sample(range(1, cap + 1), rng.randint(1, cap))}
        open_ = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fit = [i for i, x in enumerate(open_) if x >= length]
                if fit:
                    open_[min(fit, key=lambda i: open_[i])] -= length
                else:
                    open_.append(cap - length)
        assert packing.best_fit_runs(counts, cap)[1] == len(open_)


def test_equal_pieces_fill_the_tightest_bin_first():
    counts = {1100: 100, 450: 100, 316: 150}
    runs, n_bins = packing.best_fit_runs(counts, 2048)
    assert n_bins == 100
    ends = {(length, rank) for length, rank, _, _ in runs} | {(length, n) for length, n in counts.items()}
    spans = [(b, off, length, b + min(r for k, r in ends if k == length and r > rank) - rank) for length, rank, b, off in runs]
    for b in range(n_bins):
        held = sorted((off, length) for first, off, length, end in spans if first <= b < end)
        assert [off for off, _ in held] == [sum(x for _, x in held[:i]) for i in range(len(held))] and sum(x for _, x in held) <= 2048


def test_packing_has_no_gaps(spark):
    texts = odd_texts(60)
    rows = packing.pack(docs_frame(spark, texts), capacity=128).toPandas()
    own = encoder(token_counts.TOKENIZER).library
    for i, g in rows.groupby("doc_id"):
        ids = np.array(own.encode(texts[i] or "", add_special_tokens=False).ids + [0], "<u4")
        for r in g.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length]) == r.ids_crc32
        assert g.length.sum() == len(ids) and (len(ids) > 128 or len(g) == 1)
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 128
    assert packing.pack(docs_frame(spark, [])).count() == 0


def test_packed_sequences_hold_the_ids(spark):
    texts = odd_texts(60)
    rows = packing.pack(docs_frame(spark, texts), capacity=128).toPandas()
    own = encoder(token_counts.TOKENIZER).library
    want = [own.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        held = np.concatenate(g.ids.to_list()).tolist()
        assert held == [x for r in g.itertuples() for x in want[r.doc_id][r.start : r.start + r.length]]
    for i, g in rows.groupby("doc_id"):
        assert np.concatenate(g.sort_values("start").ids.to_list()).tolist() == want[i]


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0, np.uint32), np.zeros(100, np.uint32), rng.integers(0, 5, 5000).astype(np.uint32), np.tile(np.arange(7, dtype=np.uint32), 900)):
        starts = np.unique(np.linspace(0, len(ids), 9).astype(int)) if len(ids) else np.array([0, 0])
        shard = repair.Shard(repair.pack_shard(ids, starts))
        assert (shard.ids() == ids).all()
        for k in range(len(starts) - 1):
            assert (shard.document(k) == ids[starts[k] : starts[k + 1]]).all()


def test_shards_read_back(spark, tmp_path):
    texts = odd_texts()
    repair.write_shards(docs_frame(spark, texts), str(tmp_path / "s"), shard_ids=500)
    got = repair.read_shards(spark, str(tmp_path / "s")).orderBy("doc_id").collect()
    own, at = encoder(token_counts.TOKENIZER).library, 0
    for i, (t, r) in enumerate(zip(texts, got, strict=True)):
        ids = np.array(own.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(ids))
        at += len(ids)


def test_targets_are_capped_and_complete():
    t = mixing.capped_targets([100, 10, 50, 0], [3, 1, 2, 3], 1.5, 2.0)
    assert abs(sum(t) - 240) < 1e-9 and all(x <= 2 * n for x, n in zip(t, [100, 10, 50, 0]))


def test_flow_prefers_fresh_words_and_overlaps():
    # Two sources share a pattern; the quota of the small one is met from the shared words before any repetition.
    got = mixing.route([((0,), 100), ((0, 1), 50), ((1,), 20)], [100, 70], 2)
    assert got == [[100, 0], [50, 0], [20, 0]]
    assert mixing.route([((0,), 100)], [150], 2) == [[100, 50]]


def test_mix_is_near_target_and_repeats(spark):
    rng = random.Random(5)
    texts = [" ".join(["w"] * rng.randint(1, 30)) for _ in range(600)] + [None, ""]
    df = docs_frame(spark, texts, ["a", "b", None, "c"])
    runs = [{r["doc_id"]: r["_mix_copies"] for r in mixing.mix(df, df["source"], mixing.cycling_targets()).collect()} for _ in range(2)]
    assert runs[0] == runs[1] and set(runs[0].values()) <= {0, 1, 2} and runs[0][600] == runs[0][601] == 0
    rows = mixing.mix(df, df["source"], lambda held: {k: 0.5 * v for k, v in held.items()}).collect()
    for s in ("a", "b", "c", None):
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["_mix_size"] * r["_mix_copies"] for r in own) - sum(r["_mix_size"] for r in own) / 2) <= 30
    assert mixing.mixed_documents(df).columns == df.columns


def test_statistics_equal_brute_force(spark):
    texts = odd_texts(30, 4) + [" ".join(["a b c d e f g h i"] * 4), "l1 x\nl1 x\n \nl1 x"]
    for r in with_statistics(docs_frame(spark, texts)).collect():
        t = texts[r["doc_id"]] or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        seen, cov = {}, set()
        for a in range(len(w) - 7):
            seen.setdefault(tuple(w[a : a + 8]), []).append(a)
        for at in seen.values():
            if len(at) > 1:
                cov |= {a + k for a in at for k in range(8)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cov))
        assert tuple(r[f"_st_{c}"] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, r["doc_id"]


def test_decision_list_finds_a_threshold(spark):
    rng = random.Random(2)
    rows = [tuple([rng.uniform(0, 1) for _ in range(10)]) for _ in range(400)]
    rules = quality_rules.learn_list([(x, x[2] > 0.7 and x[4] < 0.5) for x in rows])
    assert rules and all(any(q.feature in (2, 4) for q in r) for r in rules)
    assert quality_rules.learn_list([(x, False) for x in rows]) == [] and quality_rules.learn_list([]) == []


def test_filters_keep_columns_and_survive_no_labels(spark):
    df = docs_frame(spark, odd_texts())
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(df, labels).columns == df.columns and toxicity.drop_toxic(df, labels).count() == df.count()
    kept = quality_rules.keep_good(df, labels)
    assert kept.columns == df.columns and 0 < kept.count() < df.count()


def test_ftrl_learns_words():
    rng = random.Random(0)
    texts = [" ".join(rng.choice("abcdefghij") * 2 for _ in range(30)) + (" Nasty." if i % 4 == 0 else "") for i in range(400)]
    y = np.array([float(i % 4 == 0) for i in range(400)])
    rows = toxicity._distinct(pa.array(texts), 16)
    at, w, bias = toxicity.fit(rows[:300], y[:300], bits=16)
    t = np.zeros(1 << 16)
    t[at] = w
    p = np.array([1 / (1 + np.exp(-(t[r].sum() + bias))) for r in rows[300:]])
    assert ((p >= 0.7) == (y[300:] == 1)).all() and len(at) < 2000


def brute_components(sets, percent):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(7)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 80))] for _ in range(12)]
    texts = [None, "", "Short text", "short TEXT"]
    for b in base:
        texts += [" ".join(b)] * 3
        for _ in range(8):
            c = list(b)
            for _ in range(rng.randint(1, 4)):
                c[rng.randrange(len(c))] = f"n{rng.randint(0, 10**6)}"
            texts.append(" ".join(c))
    df = docs_frame(spark, texts)
    for width in (4, 5):
        sets = {}
        for i, t in enumerate(texts):
            w = WORD.findall((t or "").lower())
            sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
        got = minhash_dedup.near_duplicates(df, minhash_dedup.Settings(width=width)).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(sets, 80)
        assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}
    assert minhash_dedup.near_duplicates(docs_frame(spark, [])).count() == 0
    assert minhash_dedup.keep_one(df).columns == df.columns


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 16))
    rows = [v.tolist() for v in x] + [(v + rng.normal(0, 0.12, 16)).tolist() for v in x for _ in range(3)] + [x[0].tolist(), (2 * x[0]).tolist()]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0], [2.0, 4.0], []]
    df = spark.createDataFrame(list(enumerate(rows + odd)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    u = np.array(rows)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    near = np.abs(u @ u.T - 0.9).min()
    assert near > 1e-9
    found = sum(got[i][0] for i in range(len(rows)))
    assert 0.99 * link.sum() <= found <= link.sum()
    n = len(rows)
    assert [got[n + k] for k in range(4)] == [(0, n + k) for k in range(4)]
    assert got[n + 4] == (1, n + 4) and got[n + 5] == (1, n + 4) and got[n + 6] == (0, n + 6)


def test_revisits(spark):
    page = b"HTTP/1.1 200 OK\r\nETag: \"a\"\r\nContent-Type: text/html\r\n\r\nhello"
    same = b"HTTP/1.1 304 Not Modified\r\nETag: W/\"a\"\r\nContent-Length: 0\r\nX-New: 1\r\n\r\n"
    data = warc_revisit.record_bytes({"WARC-Type": "response", "WARC-Record-ID": "r1"}, page) + warc_revisit.record_bytes({"WARC-Type": "revisit", "WARC-Record-ID": "v1"}, same)
    assert [r["block"] for r in warc_revisit.records(data)] == [page, same]
    schema = "record_id string, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, payload string"
    rows = [
        ("r1", "http://www.Ex.com/a/?utm_source=x", 1, "response", '"a"', None, {"content-type": "t", "etag": '"a"'}, "one"),
        ("v1", "https://ex.com/a#top", 2, "revisit", 'W/"a"', None, {"content-length": "0", "x-new": "1"}, None),
        ("r2", "https://ex.com/a", 3 << 20, "response", '"b"', "mon", {"content-type": "t"}, "two"),
        ("v2", "https://ex.com/a", 9 << 20, "revisit", '"a"', None, None, None),
        ("v3", "https://ex.com/a", 9 << 20, "revisit", None, "mon", None, None),
        ("v4", None, 5, "revisit", '"a"', None, None, None),
    ]
    got = {r["record_id"]: (r["response_id"], r["outcome"], r["payload"], r["headers"]) for r in warc_revisit.resolve_revisits(spark.createDataFrame(rows, schema)).collect()}
    assert got["v1"] == ("r1", "etag", "one", {"content-type": "t", "etag": '"a"', "x-new": "1"})
    assert got["v2"][:3] == ("r2", "validator differs", None) and got["v3"][:3] == ("r2", "last-modified", "two") and got["v4"][:2] == (None, "no response")
