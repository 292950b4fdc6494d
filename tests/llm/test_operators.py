"""Each operator against brute force or a round trip on small tables, and on odd rows."""

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewire.llm import common, components, embedding_dup, language_id, mixing, near_dup, nearest, quality, sentencepiece_io, substring_dup, token_counts, token_files

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, ids string"
ODD = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, "a b", "en", "s", 3, "x"), (3, "a b", "en", "s", 3, "x"), (4, "12 34 !!", "de", None, 8, "y"), (5, "word " * 30000, "en", "s", 150000, None), (None, "c d e f g", "en", "s", 9, "z")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_words_match_python():
    texts = ["Hello, wörld 42x", "", "x", "tail", "head one"]
    w = common.Words(pa.array(texts), lower=True)
    import re

    want = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    assert np.diff(w.rows).tolist() == [len(x) for x in want]
    again = common.Words(pa.array(["hello", "42x"]))
    assert w.hashes[0] == again.hashes[0] and w.hashes[2] == again.hashes[1]


def test_tokens_round_trip(spark, tmp_path, odd, empty):
    from tokenizers import Tokenizer

    path = token_files.default_tokenizer()
    tok = Tokenizer.from_file(path)
    rows = [(k, t) for k, t in enumerate(["It's <b> ÀÉß", "日本 x", None, "", "don't stop 123", "<|endoftext|> a", "naïve ñandú " * 500])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    man = token_files.write_token_files(docs, str(tmp_path / "f"), path, seq_len=16, batch_rows=2, shard_bytes=3000)
    got = {r.doc_id: r for r in token_files.read_token_files(man).collect()}
    at = 0
    for k, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    f = token_files.SequenceFile(man.orderBy("shard").first().path)
    assert len(f.ids(0)) == 16 and f.mask(0).true_count == 16
    assert token_files.read_token_files(token_files.write_token_files(odd, str(tmp_path / "o"), path)).count() == len(ODD)
    assert token_files.read_token_files(token_files.write_token_files(empty, str(tmp_path / "e"), path)).count() == 0


def test_sentencepiece(spark, odd, empty):
    import sentencepiece

    path = token_files.default_tokenizer("piece_bpe_32k.model")
    peer = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", "a  b", "\n x", "日本 😀", "▁a ▁", "<s>x", "It's, a (test).", " lead"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    coded = sentencepiece_io.encode(docs, path)
    for r in sentencepiece_io.decode(coded, path).collect():
        assert r.ids == peer.encode(r.text) and r.parity and r.decoded == r.text.replace("▁", " ")
    assert sentencepiece_io.encode(odd, path).count() == len(ODD) and sentencepiece_io.encode(empty, path).count() == 0


def test_unigram_model():
    m = sentencepiece_io.Model([("<unk>", 0, 2), ("▁", -1.0, 1), ("a", -1.0, 1), ("b", -1.0, 1), ("▁ab", -0.5, 1)], squeeze=False)
    assert sentencepiece_io.rebuild(m).encode("ab b", add_special_tokens=False).ids == [4, 1, 3]


def test_quality(spark, odd, empty):
    sf = SF.replace("0.001", "0.01")  # a hundred labels are too few to learn from
    docs = common.documents(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = quality.classify(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    share = {r.quality: r.k for r in good}
    assert share[1] > 0.9 and share.get(0, 0) < 0.2
    assert quality.classify(odd, labels).count() == len(ODD) and quality.classify(empty, labels).count() == 0
    keys = spark.createDataFrame([(float(x % 7), x) for x in range(50)], "v double, doc_id long")
    for k in (1, 8, 50):
        edge, left = quality.kth_largest(keys, k, "v", bins=4)
        values = sorted((r.v for r in keys.collect()), reverse=True)
        assert edge == values[k - 1] and left == values[:k].count(edge)


def test_language_id(spark, odd, empty):
    docs = common.documents(spark, "/root/testdata/sf0.01")
    langs, logp = language_id.train(docs.where(~language_id.held_out()))
    got = language_id.predict(docs.where(language_id.held_out()), langs, logp)
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    mixed = spark.createDataFrame([(1, " ".join(r.text for r in docs.where(f"lang='{x}' and length(text) between 900 and 2000").limit(1).collect())) for x in ("en",)], "doc_id long, text string")
    two = mixed.first().text + " " + docs.where("lang='de' and length(text) between 900 and 2000").first().text
    shares = language_id.predict(spark.createDataFrame([(1, two)], "doc_id long, text string"), langs, logp).first().langs
    assert shares.get("en", 0) > 0.2 and shares.get("de", 0) > 0.2
    rows = {r.doc_id: r for r in language_id.predict(odd, langs, logp).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[4].lang_pred == "und" and rows[5].lang_pred != "und"
    assert language_id.predict(empty, langs, logp).count() == 0 and language_id.train(empty)[0] == []
    assert {r.lang_pred for r in language_id.predict(odd, [], np.zeros((0, 8), np.float32)).collect()} == {"und"}


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_languages_grow_by_penalty_alone():
    scores = np.full((205, 5), -30.0)
    scores[np.arange(200), np.arange(200) % 5] = 0.0  # one document of five languages in equal parts, and one of the last alone
    scores[200:, 4] = 0.0
    share = language_id.infer(scores, np.array([0, 200, 205]), 1.5)
    assert np.allclose(share, [[0.2] * 5, [0, 0, 0, 0, 1]], atol=0.01)


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == brute_components({x for p in chain for x in p}, chain)


def test_near_duplicates(spark, odd, empty):
    docs = common.documents(spark, SF)
    rows = docs.collect()
    idf = near_dup.Idf(near_dup.count_shingles(docs), len(rows), near_dup.STRENGTH)
    h, first = common.Words(pa.array([r.text for r in rows])).shingles(5)
    sets = [(u, idf.weights(u, c)) for u, c in (np.unique(h[first[i] : first[i + 1]], return_counts=True) for i in range(len(rows)))]
    links = [(rows[i].doc_id, rows[j].doc_id) for i, j in combinations(range(len(rows)), 2) if near_dup.weighted_jaccard(sets[i], sets[j]) >= 0.8]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()}
    assert got == brute_components([r.doc_id for r in rows], links)
    assert {r.doc_id for r in near_dup.near_duplicates(odd).collect()} == {1, 2, 3, 4, 5} and near_dup.near_duplicates(empty).count() == 0


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    u = rng.integers(1, 1 << 63, 400, dtype=np.uint64)
    a, b = np.sort(u[:300]), np.sort(u[100:])
    wa, wb = np.ones(300) * 2, np.ones(300)
    want = near_dup.weighted_jaccard((a, wa), (b, wb))
    assert abs((near_dup.samples(a, wa, 2000) == near_dup.samples(b, wb, 2000)).mean() - want) < 0.04


def test_substrings(spark, odd, empty):
    rng = np.random.default_rng(9)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    hits = 0
    for _ in range(3):
        passage = word(60)
        rows = [(k, f"{word(80 + k)}\n{passage} {word(70)}") for k in range(5)] + [(9, word(120))]
        got = {r.doc_id: r for r in substring_dup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got[0].text == rows[0][1] and got[9].text == rows[5][1]
        hits += sum(passage not in got[k].text and got[k].removed_words >= 18 for k in range(1, 5))
        for k in range(1, 5):
            assert rows[k][1].startswith(got[k].text[:300])
    assert hits == 12
    assert substring_dup.dedup_substrings(odd).count() == len(ODD) and substring_dup.dedup_substrings(empty).count() == 0


def test_chunks_follow_their_own_text():
    rng = np.random.default_rng(4)
    texts = [" ".join("".join(rng.choice(list("abcdefghij"), int(n))) for n in rng.integers(1, 8, 60)) for _ in range(200)] + ["", "a", " b", "word " * 200]
    alone = [substring_dup.Chunks(pa.array([t]), 3).digest.tolist() for t in texts]
    for order in (np.arange(len(texts)), rng.permutation(len(texts))):
        c = substring_dup.Chunks(pa.array([texts[k] for k in order]), 3)
        assert [c.digest[c.row == r].tolist() for r in range(len(order))] == [alone[k] for k in order]


def test_substrings_in_any_order(spark):
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), int(k))) for k in rng.integers(1, 8, n))
    passage = prose(60)
    rows = [(k, f"{prose(25)} {passage} {prose(25)}" if k % 3 == 0 else prose(60)) for k in range(300)]
    rows += [(400, prose(60)), (400, f"{passage} {prose(30)}"), (400, f"{passage} {prose(30)}")]  # one id, several texts
    cut = lambda rows, n: sorted((r.doc_id, r.text, r.removed_words) for r in substring_dup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect())
    got = cut(rows, 1)
    assert got == cut(rows[::-1], 7)
    old = sorted(rows)
    assert all(g[1] == t for g, (k, t) in zip(got, old, strict=True) if k % 3 and k < 400)
    for g, (k, t) in zip(got, old, strict=True):
        if k % 3 == 0 and 0 < k < 400:  # nothing but the passage goes
            assert 18 <= g[2] <= 60 and g[1].split()[:25] == t.split()[:25] and g[1].split()[-25:] == t.split()[-25:]
    assert rows[300] in [g[:2] for g in got]


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0])]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, shard_rows=128).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    y, hit = x.astype(float), 0
    assert set(found) == set(range(0, 400, 20))
    for q in found:
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(400), d))[:10].tolist()
        hit += len({*want} & {*found[q].values()})
    assert hit >= 0.95 * 200
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_embedding_duplicates(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 24))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 24)) * 0.2, base[:3], base[:3] * 2]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(500, None), (501, [0.0] * 24)]
    got = {r.vec_id: r for r in embedding_dup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=8).collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    links = [(a, b) for a, b in combinations(range(len(x)), 2) if y[a] @ y[b] >= 0.9]
    want = brute_components(got, links)
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(got[k].n_links == sum(k in p for p in links) for k in range(len(x))) and got[500].n_links == 0
    assert embedding_dup.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_mixing(spark, odd, empty):
    rows = [(k, "w " * (1 + k % 5), "en" if k % 3 else "fr", f"s{k % 4}", 0) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix(docs, {"lang": {"fr": 3}}, share=0.5, max_epochs=2).collect()
    supply = sum(len(r[1].split()) for r in rows)
    assert 0.45 * supply < sum(r.n_tokens for r in out) <= 0.5 * supply
    assert max(r.epoch for r in out) <= 2
    assert {(r.doc_id, r.epoch) for r in mixing.mix(docs, share=1.0, max_epochs=1).collect()} == {(k, 1) for k in range(400)}
    assert mixing.mix(odd, share=1.0, max_epochs=1).count() >= 5 and mixing.mix(empty).count() == 0


def test_rollups(spark, tmp_path):
    store = token_counts.RollupStore(spark, "file://" + str(tmp_path / "r"))
    make = lambda rows: spark.createDataFrame(rows, "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long")
    assert store.apply("b1", make([("insert", "s", "en", "v", 10, None), ("insert", "s", None, "v", 4, None), ("insert", "t", "en", "v", 1, None)]))
    assert not store.apply("b1", make([("insert", "s", "en", "v", 99, None)]))
    store.compact()
    assert store.apply("b2", make([("revise", "s", "en", "v", 12, 10), ("delete", "t", "en", "v", 1, None)])) and store.apply("b3", make([]))
    assert {tuple(r) for r in store.totals().collect()} == {("s", "en", "v", 1, 12), ("s", None, "v", 1, 4)}
    with pytest.raises(Exception):
        store.apply("b4", make([("what", "s", "en", "v", 1, None)]))


def test_near_dup_stage_on_odd_ids(spark, odd, empty):
    rng = np.random.default_rng(6)
    one, two, three = (" ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(80)) for _ in range(3))
    more = [(20, one, "en", "s", 0, "x"), (21, one + " end", "en", "s", 0, "x"), (20, two, "en", "s", 0, "x"), (None, two + " end", "en", "s", 0, "x"), (None, three, "en", "s", 0, "x"), (None, three, "en", "s", 0, "x")]
    stage = lambda docs: sorted(map(str, ((r.doc_id, r.text) for r in corpus_pipeline.near_dup_stage(spark, docs, SF).collect())))
    want = {(r[0], r[1]) for r in ODD} | {(20, one), (20, two), (None, three)}
    assert stage(odd.unionByName(spark.createDataFrame(more, DOC))) == sorted(map(str, want))
    assert stage(empty) == []


def test_pipeline(spark):
    docs = common.documents(spark, SF)
    cut = corpus_pipeline.substring_stage(spark, docs, SF)
    assert cut.columns == docs.columns and corpus_pipeline.mixing_stage(spark, docs, SF).columns == docs.columns
    out = corpus_pipeline.run(spark, SF)
    assert out.where("not parity").count() == 0 and 0 < out.count() < docs.count()
