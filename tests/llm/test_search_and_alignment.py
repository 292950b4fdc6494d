"""Operators 11 to 13 against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest

from tidewire.llm import alignment, decontamination, lexical
from tidewire.llm.token_files import default_tokenizer

DOC = "doc_id long, text string, item_ids string, row string, n string, hits string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def some_texts(seed, n, vocabulary=12, longest=60):
    rng = random.Random(seed)
    known = [f"w{k}" for k in range(vocabulary)] + ["Äpfel", "x"]
    return [rng.choice([" ", ", ", "-"]).join(rng.choices(known, k=rng.randint(0, longest))) for _ in range(n)]


def rows(texts):
    return [(k, t, "x", "y", "z", None) for k, t in enumerate(texts)]


ODD = [(1, None, "a", None, None, None), (2, "", "a", None, None, None), (3, "one two", "a", None, None, None), (3, "one two", "a", None, None, None), (None, "one two three !!", "b", None, None, None), (4, "long word " * 40000, "b", None, None, None), (5, "...", "c", None, None, None)]


# ---------------------------------------------------------------- 11


def plain_hits(docs, items, span=10):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), span)
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[key]
        out.append((d, len(w), len(hit), sorted(found)))
    return out


def test_decontamination_equals_brute_force(spark):
    texts = some_texts(1, 60)
    rng = random.Random(2)
    passages = some_texts(3, 12, vocabulary=400, longest=30)
    for k in range(0, 60, 3):  # planted passages, in whole or from the middle on
        p = words(rng.choice(passages))
        texts[k] += " " + " ".join(p[rng.randint(0, 3) :]).upper()
    items = [(k, p) for k, p in enumerate(passages)] + [(90, "w1 w2"), (91, "x"), (92, "w3, w1; W4 w0 w7 äpfel"), (92, passages[0]), (None, "w5 w5 w5"), (93, None), (94, "!")]
    got = decontamination.decontaminate(spark.createDataFrame(rows(texts), DOC), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got) == plain_hits(enumerate(texts), items)
    assert all(r.n_hit == sum(s.end - s.start for s in r.spans) for r in got)


def test_winnowing_is_the_same_wherever_a_window_stands():
    h = np.random.default_rng(5).integers(1, 1 << 62, 300).astype(np.uint64)
    for n in range(1, 11):
        assert (decontamination.winnow(h, n)[40:60] == decontamination.winnow(h[40 : 59 + n], n)).all()
        assert len(decontamination.winnow(h[: n - 1], n)) == 0


def test_decontamination_of_odd_rows(spark):
    items = spark.createDataFrame([(1, "one two"), (2, "word long word long word long word long word long word")], "item_id long, text string")
    got = decontamination.decontaminate(spark.createDataFrame(ODD, DOC), items).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.item_ids) for r in got) == [(0, 3, 2, ["1"]), (1, 0, 0, []), (2, 0, 0, []), (3, 2, 2, ["1"]), (3, 2, 2, ["1"]), (4, 80000, 80000, ["2"]), (5, 0, 0, [])]
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontamination.decontaminate(spark.createDataFrame(ODD, DOC), none).collect()} == {0}
    assert decontamination.decontaminate(spark.createDataFrame([], DOC), items).count() == 0


# ---------------------------------------------------------------- 12


def plain_search(docs, items, k=10):
    bags = [(d, words(t)) for d, t in docs]
    n, total = sum(bool(w) for _, w in bags), sum(len(w) for _, w in bags)
    df = Counter(t for _, w in bags for t in set(w))
    out = []
    for i, text in items:
        found = []
        for d, w in bags:
            tf, m = Counter(w), 25 + 75 * len(w) * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in words(text) if tf[t])
            if score > 0:
                found.append((-score, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "batch"), [(4096, 256), (16, 3)])
def test_search_equals_brute_force(spark, block, batch):
    texts = some_texts(7, 120, vocabulary=80, longest=40) + ["w1 w2"] * 15 + ["", None]
    items = list(enumerate(some_texts(8, 9, vocabulary=90, longest=12) + ["w1 w1 w1 w2", None, "", "nowhere", "x X x"]))
    got = lexical.search(spark.createDataFrame(rows(texts), DOC), spark.createDataFrame(items, "item_id long, text string"), block=block, batch=batch).collect()
    assert sorted(tuple(r) for r in got) == plain_search(list(enumerate(texts)), items)


def test_slices_add_and_find_the_top():
    rng = np.random.default_rng(3)
    numbers = [np.where(rng.random(640) < share, rng.integers(0, 1 << 30, 640), 0) for share in (0.01, 0.5, 1, 0.2, 0.9)]
    made = [lexical.sliced(v[np.flatnonzero(v)], np.flatnonzero(v), 33, 10) for v in numbers]
    total = sum(numbers)
    slices = lexical.added(made)
    assert (lexical.values_at(slices, np.arange(640)) == total).all()
    assert set(lexical.top(slices, 25).tolist()) == set(np.argsort(-total, kind="stable")[:25].tolist())
    ties = lexical.sliced(np.array([5, 5, 5, 5, 9]), np.array([3, 8, 100, 200, 300]), 4, 10)
    assert lexical.top(ties, 3).tolist() == [3, 8, 300] and len(lexical.top(ties, 50)) == 5


def test_search_in_odd_rows(spark):
    items = spark.createDataFrame([(1, "two"), (1, "two"), (2, None), (None, "word")], "item_id long, text string")
    got = lexical.search(spark.createDataFrame(ODD, DOC), items).collect()
    assert sorted((r.item_id or 0, r.rank, r.doc_id or 0) for r in got) == [(0, 1, 4), (1, 1, 3), (1, 1, 3), (1, 2, 3), (1, 2, 3), (1, 3, 0), (1, 3, 0)]
    assert lexical.search(spark.createDataFrame([], DOC), items).count() == 0
    assert lexical.search(spark.createDataFrame(ODD, DOC), items.limit(0)).count() == 0


# ---------------------------------------------------------------- 13

A, B = default_tokenizer("byte_bpe_50k.json"), default_tokenizer("piece_bpe_32k.model")


def plain_alignment(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    a_bytes, out = alignment.byte_level_tokens(A), []
    b_bytes = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in range(b_tok.get_piece_size())]
    for d, t in docs:
        a, b = (a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)) if t else ([], [])
        whole = (" " + (t or "")).encode()
        if b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            a = b = []
        ends = [list(accumulate(len(kind[i]) for i in ids)) for kind, ids in ((a_bytes, a), (b_bytes, b))]
        links, parts, i, j, one, two = [], [], 0, 0, [], []
        while i < len(a):
            links.append((a[i], b[j]))
            x, y = ends[0][i], ends[1][j]
            if x <= y:
                one.append(str(a[i]))
                i += 1
            if y <= x:
                two.append(str(b[j]))
                j += 1
            if x == y:
                parts.append(f"{','.join(one)}|{','.join(two)}")
                one, two = [], []
        out.append((d, len(a), len(b), len(parts), links, ";".join(parts)))
    count = Counter(x for o in out for x in o[4])
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return sorted((d, n_a, n_b, n, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), text) for d, n_a, n_b, n, links, text in out)


@pytest.mark.parametrize(("block_bytes", "most_broadcast"), [(1 << 20, 1 << 20), (200, 3)])
def test_alignment_equals_brute_force(spark, monkeypatch, block_bytes, most_broadcast):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block_bytes)
    rng = random.Random(4)
    parts = ["don't", " it's", "'tis", " ", "  ", "\n\n", "\t", "1234", "Größe", "naïve", "x" * 40, "...", "<|endoftext|>", "</s>", "日本語", "😀", "word", "Word", "\r\n", "'ll", " unbelievably"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(60)] + [None, "", " ", "a▁b", "same text", "same text", "aaaa " * 3000]
    got = alignment.align(spark.createDataFrame(rows(texts), DOC), A, B, most_broadcast=most_broadcast).collect()
    assert sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got) == plain_alignment(list(enumerate(texts)))


def test_alignment_of_odd_rows(spark):
    got = alignment.align(spark.createDataFrame(ODD, DOC), A, B).collect()
    assert len(got) == len(ODD) and sorted(r.n_groups > 0 for r in got) == [False] * 2 + [True] * 5
    assert alignment.align(spark.createDataFrame([], DOC), A, B).count() == 0


def test_byte_level_pieces_are_the_tokenizers():
    encoder, rng = alignment.ByteLevelEncoder(A), random.Random(6)
    parts = ["'", "'s", "'ll", "'re", " ", "  ", "\n", "\t", "a", "é", "Z", "9", "12", ".", "!", "<|endoftext|>", "ve", "\r\n", "word", " the", "日"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)]
    assert [x.tolist() for x in encoder.encode(texts)] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_digest_of_groups(spark, tmp_path):
    spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in alignment.op13_alignment(spark, str(tmp_path)).collect()}
    want = plain_alignment([(1, "some text")])[0][-1]
    assert got[1].groups_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[2].groups_sha256 == ""


def test_units_are_measured_once_and_forgotten_ones_again(monkeypatch):
    rng, measured = random.Random(8), []
    real = alignment.measure
    monkeypatch.setattr(alignment, "measure", lambda units, *more: measured.extend(units) or real(units, *more))
    texts = [" ".join(rng.choices([f"unbelievably{k}" for k in range(40)], k=50)) for _ in range(30)]
    want = {k: (n_a, n_b, n, n_links, text) for k, n_a, n_b, n, n_links, _, _, text in plain_alignment(list(enumerate(texts)))}
    for most, all_once in ((1000, True), (10, False)):
        monkeypatch.setattr(alignment, "MOST_UNITS", most)
        aligner = alignment.Aligner(A, B)
        measured.clear()
        for k in range(0, 30, 2):
            numbers, groups, pairs, counts, links, first = aligner.block(texts[k : k + 2])
            assert list(zip(*(n.tolist() for n in numbers), groups, strict=True)) == [want[k], want[k + 1]]
            assert len(set(pairs.tolist())) == len(pairs) and np.bincount(links).tolist() == counts.tolist() and first[-1] == counts.sum()
        assert (len(measured) == len(set(measured))) == all_once and len(aligner.hashes) <= most + 100


def test_a_blocks_distinct_pairs_travel_and_no_tokens(spark):
    texts = ["some unbelievably long words " * 300] * 20
    made = alignment.blocks(spark.createDataFrame(rows(texts), DOC).coalesce(1), A, B).collect()
    assert sum(len(b.pairs) for b in made) < 30 < 1000 < sum(d.n_links for b in made for d in b.docs) == sum(sum(b.counts) for b in made)
