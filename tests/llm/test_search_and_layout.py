import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import cover_search, packing, sharding, token_counts
from ledgerloom.plans.shared import staged


def plain_top(vectors, queries, k):
    out = set()
    for q in queries:
        scored = sorted((-int(np.dot(vectors[q][1], v)), i) for n, (i, v) in enumerate(vectors) if n != q)
        out.update((vectors[q][0], r + 1, i, -s) for r, (s, i) in enumerate(scored[:k]))
    return out


@pytest.mark.parametrize("shape", ["clusters", "equal", "few"])
def test_top_products_against_all_pairs(spark, shape):
    rng = np.random.default_rng(8)
    n = {"clusters": 900, "equal": 700, "few": 9}[shape]
    centres = rng.normal(size=(5, 12))
    x = centres[rng.integers(0, 5, n)] + 0.05 * rng.normal(size=(n, 12))
    if shape == "equal":
        x[: n // 2] = x[0]
    x = x.astype(np.float32)
    rows = [(i * 3, x[i].tolist()) for i in range(n)]
    odd = [(10**6, None), (10**6 + 1, []), (10**6 + 2, [1.0] * 11 + [float("nan")]), (10**6 + 3, [1.0] * 11 + [None]), (None, [1.0] * 12),
           (10**6 + 4, [float("inf")] * 12), (10**6 + 5, [1.0] * 5)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = cover_search.top_products(df, F.col("vec_id") % 20 == 0, query_block=16, data_block=64)
    whole = [(i, np.floor(np.array(v, np.float64) * 64).astype(np.int64)) for i, v in rows]
    want = plain_top(whole, [k for k, (i, _) in enumerate(whole) if i % 20 == 0], 20)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == want
    assert got.count() == len(want)


def test_top_products_of_nothing_and_of_large_components(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cover_search.top_products(empty, F.col("vec_id") % 20 == 0).count() == 0
    rng = np.random.default_rng(2)
    x = rng.integers(-(2**24), 2**24, (50, 4)).astype(float)
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(50)], "vec_id long, embedding array<double>")
    got = cover_search.top_products(df, F.col("vec_id") % 20 == 0, k=5)
    whole = [(i, (x[i] * 64).astype(np.int64)) for i in range(50)]
    assert {tuple(r) for r in got.collect()} == plain_top(whole, [0, 20, 40], 5)


def test_one_shortened_vector_does_not_set_the_length(spark):
    x = np.random.default_rng(3).integers(-5, 6, (40, 6)).astype(float)
    rows = [(0, [1.0] * 5)] + [(i + 1, x[i].tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.warns(UserWarning, match="^1 vectors of another length than 6 "):
        got = cover_search.top_products(df, F.col("vec_id") % 20 == 0, k=5)
    whole = [(i + 1, (x[i] * 64).astype(np.int64)) for i in range(40)]
    assert {tuple(r) for r in got.collect()} == plain_top(whole, [19, 39], 5)


def test_radii_bound_all_products():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(2000, 6))
    root = cover_search.Node(points, np.arange(2000))
    seen, stack = [], [root]
    while stack:
        node = stack.pop()
        assert np.sqrt(((points[node.rows] - node.centre) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
            stack += node.children
        else:
            seen.append(node)
            assert len(node.rows) <= cover_search.LEAF
    for a in seen[:4]:
        for b in seen[-4:]:
            assert (points[a.rows] @ points[b.rows].T).max() <= cover_search.most(a, b)


def test_shards_hold_every_row_once(spark, tmp_path):
    rows = [(i, "same" if i % 3 else f"text {i}") for i in range(1000)] + [(None, None)] * 300 + [(7, "x" * 300_000), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    table = staged(df, "shard-test")
    got = sharding.shard_rows(table, shards=7, bucket_bytes=20_000)
    assert got.columns == ["doc_id", "text", "law", "shard", "slot"]
    found = got.collect()
    assert sorted(((r[0], r[1]) for r in found), key=str) == sorted(rows, key=str)
    sizes = {}
    for r in found:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert set(sizes) == set(range(7)) and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    ids = [r["doc_id"] for r in sorted(found, key=lambda r: (r["shard"], r["slot"])) if r["doc_id"] is not None]
    assert abs(np.corrcoef(ids, np.arange(len(ids)))[0, 1]) < 0.2
    sharding.write_shards(got, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


@pytest.mark.parametrize("rows", [0, 1, 5])
def test_fewer_rows_than_shards(spark, rows):
    table = staged(spark.range(rows).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), "shard-test")
    got = sharding.shard_rows(table, shards=7).collect()
    assert sorted(r["shard"] for r in got) == list(range(rows)) and all(r["slot"] == 0 for r in got)


@pytest.fixture(scope="module")
def word_tokenizer():
    return public_tokenizers.path("word_bpe_49k.json")


def test_pieces_round_trip(spark, prose, word_tokenizer):
    texts = [None, "", " \n", "It's 12 o'clock — naïve ÉCOLE x y", "é İ \x1c a\x1cb ½ 漢字 日本", "word " * 5000, prose(1, 3000),
             "<|endoftext|> a<|startoftext|>b", "x" * 20000, "a̸ < ̸ ≠", "don't we'll THEY'VE", "İstanbul, ISTANBUL. word,word word... K! ǅ? Σας, ΣΑΣ. ﬁne; e\u0301a\u0301: 3rd. x²! … a…, <, <|endoftext|>."]
    docs = spark.createDataFrame([*enumerate(texts), (None, "no id"), (3, "twice")], "doc_id long, text string").withColumn("piece", F.lit("clash"))
    pieces = packing.encode_pieces(docs, word_tokenizer, 100, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(word_tokenizer)
    want = {}
    for doc, text in [*enumerate(texts), (None, "no id"), (3, "twice")]:
        want.setdefault(doc, []).append(tokenizer.encode(text or "", add_special_tokens=False).ids + [0])
    got = {}
    for r in sorted(pieces, key=lambda r: (r["doc_id"] or -1)):
        assert r["length"] == len(r["ids"]) <= 100 and r["start"] == 100 * r["piece"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        got.setdefault(r["doc_id"], []).append((r["piece"], r["ids"]))
    for doc, lists in want.items():
        if len(lists) == 1:
            assert [x for _, ids in sorted(got[doc]) for x in ids] == lists[0]


@pytest.mark.parametrize("lot", [50, 10_000])
def test_packing_is_valid_and_tight(spark, lot):
    rng = np.random.default_rng(4)
    sizes = np.r_[rng.integers(1, 64, 700), np.full(40, 64), np.full(100, 33)]
    rows = [(int(i) if i % 9 else None, 0, 0, int(s), 1) for i, s in enumerate(sizes)]
    table = staged(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), "packing-test")
    got = packing.pack_pieces(table, 64, lot_size=lot).collect()
    assert sorted(((r[0], r[3]) for r in got), key=str) == sorted(((r[0], r[3]) for r in rows), key=str)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 64
    bound = max(np.ceil(sizes.sum() / 64), (sizes > 32).sum())
    assert bound <= len(bins) <= 1.02 * bound + (len(sizes) // lot + 1)


def test_genes_keep_every_item_once():
    rng = np.random.default_rng(6)
    sizes = rng.integers(20, 60, 400)
    a, b = packing.first_packing(sizes, 100, None), packing.first_packing(sizes, 100, rng)
    for seed in range(10):
        child = packing.crossover(a, b, sizes, 100, np.random.default_rng(seed))
        assert len(child) == 400 and (child >= 0).all() and np.bincount(child, sizes).max() <= 100
    start = [packing.first_packing(sizes, 100, rng) for _ in range(4)]
    best = packing.evolve(sizes, start, 100, 1, generations=40)[0]
    assert packing.fitness(best, sizes, 100) >= max(packing.fitness(p, sizes, 100) for p in start)


def test_words_with_marks_have_the_ids_of_the_tokenizer(word_tokenizer, monkeypatch):
    words = [f"{core}{tail}" for core in ("word", "Naïve", "İ", "Bक़", "ǅ", "don't", "x1", "ΣΑΣ", "漢") for tail in ("", "$$$", "&&&", "***,", ".", "\"),", "'", "-_/", "<", "|>", "...'")]
    tokenizer, encoder = Tokenizer.from_file(word_tokenizer), packing.Encoder(word_tokenizer)
    asked = []
    monkeypatch.setattr(encoder, "_encode", lambda texts, real=encoder._encode: asked.extend(texts) or real(texts))
    for _ in range(2):
        got = encoder.encode([[w.encode()] for w in words])
        assert got == [np.array(tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    assert "word$$$" not in asked and "$$$" in asked


def test_units_are_encoded_once_whatever_their_case_and_marks(word_tokenizer, monkeypatch):
    encoder = packing.Encoder(word_tokenizer)
    asked = []
    monkeypatch.setattr(encoder, "_learn", lambda new, real=encoder._learn: asked.extend(new) or real(new))
    encoder.encode([[b"THE", b"(the", b"The!!"], [b"the/the", b"[thE]", b"don't"]])
    assert sorted(asked) == sorted([b"the", b"(", b"!!", b"/", b"[", b"]", b"don't"])


def test_texts_cut_into_units_have_the_ids_of_the_tokenizer(word_tokenizer):
    rng = np.random.default_rng(12)
    atoms = [*"aHJiIT.,;'|<>=-_(\"9 \t\n\x0b\x1c\x7f\x00\xa0", "\u0301", "\u0331", "\u0338", "\u0307", "\u0327", "é", "É", "İ", "Σ", "\u212a", "…", "²", "漢", "한", "\u037e",
             "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "<|eNDOFTEXt|>", "<|startoftext|>", "word", "Word", "THE", "!!"]
    tokenizer, encoder = Tokenizer.from_file(word_tokenizer), packing.Encoder(word_tokenizer)
    for _ in range(300):
        texts = ["".join(rng.choice(atoms, rng.integers(0, 25))) for _ in range(rng.integers(0, 6))]
        want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert encoder.encode_texts([t.encode() for t in texts]) == want


def test_words_met_first_stay_known(word_tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_WORDS", 4)
    encoder = packing.Encoder(word_tokenizer)
    first = encoder.encode([[b"one", b"two"]])
    encoder.encode([[b"three", b"four", b"five"]])
    assert encoder.encode([[b"one", b"two"], [b"six"]])[0] == first[0]
    assert set(encoder.known) == {b"one", b"two", b"six"}


def test_packing_nothing(spark, word_tokenizer):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(empty, word_tokenizer).count() == 0


def test_length_histogram_answers_every_limit(spark, prose):
    rng = np.random.default_rng(9)
    lengths = np.r_[rng.integers(0, 5000, 500), np.zeros(20, int), np.full(300, 1024), [100_000]]
    hist = token_counts.length_histogram(spark.createDataFrame([(int(x),) for x in lengths], "n_tokens long"))
    rows = hist.collect()
    assert sorted(r["length"] for r in rows) == sorted(set(lengths.tolist()))
    for r in rows:
        at = lengths >= r["length"]
        assert (r["docs"], r["docs_at_least"], r["tokens_at_least"]) == ((lengths == r["length"]).sum(), at.sum(), lengths[at].sum())
        assert r["docs_at_most"] == (lengths <= r["length"]).sum() and r["truncated_total"] == np.minimum(lengths, r["length"]).sum()
    for limit in (0, 1, 1000, 1024, 3333, 10**6):
        assert token_counts.truncated_total(hist, limit) == np.minimum(lengths, limit).sum()
    for q in (0, 0.01, 0.5, 0.9, 1):
        assert token_counts.quantile(hist, q) == np.sort(lengths)[max(int(np.ceil(q * len(lengths))) - 1, 0)]
    none = token_counts.length_histogram(spark.createDataFrame([], "n_tokens long"))
    assert none.count() == 0 and token_counts.truncated_total(none, 5) == 0 and token_counts.quantile(none, 0.5) is None


def test_encoded_lengths(spark, prose):
    texts = [None, "", "hello  world\n", "naïve 漢字 <|endoftext|>", prose(3, 2000), "a" * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = token_counts.add_lengths(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).orderBy("doc_id").collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    assert [r["n_tokens"] for r in got] == [len(tokenizer.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]
