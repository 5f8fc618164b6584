"""Collocations against counting every phrase."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import collocations
from ledgerloom.llm.collocations import Chunk, keys, parts_of, top_collocations


def plain(rows, least, limit, max_words=5, inside_share=100):
    counts, total = defaultdict(Counter), Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            counts[lang].update(tuple(w[i : i + m]) for m in range(1, max_words + 1) for i in range(len(w) - m + 1))
    result = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= least}
        gone = set()
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    if 100 * a >= inside_share * often[p[i : i + m]]:
                        gone.add(p[i : i + m])
        scored = []
        for p, a in often.items():
            if len(p) > 1 and p not in gone:
                score, _, l, r = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:limit], 1):
            result.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(result)


def corpus(seed, texts=150):
    rng = random.Random(seed)
    names = {"en": 60, "fr": 25, None: 12, "und": 12, "de": 400}
    rows = []
    passages = [" ".join(f"p{rng.randrange(30)}" for _ in range(rng.randrange(2, 8))) for _ in range(12)]
    for _ in range(texts):
        lang = rng.choice(list(names))
        words = []
        for _ in range(rng.randrange(0, 120)):
            # Few words are very frequent, most are rare.
            words.append(rng.choice([f"W{int(names[lang] * rng.random() ** 3)}", f"w{rng.randrange(3)}", "é|", rng.choice(passages)]))
        rows.append((lang, "".join(w + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",\r\n", "\x0b"]) for w in words)))
    return [*rows, ("en", None), ("xx", ""), ("yy", " . ,\n"), ("zz", "same " * 50), *rows[:20]]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed, least, limit, share", [(1, 3, 40, 1 / 16), (3, 8, 10_000, 1.0)])
def test_against_counting_everything(spark, seed, least, limit, share):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "lang string, text string")
    got = rows_of(top_collocations(df, least=least, limit=limit, first_share=share, growth=4))
    assert got == plain(rows, least, limit) and got


def test_waves_stop_once_the_limit_is_settled(spark, monkeypatch):
    rows = corpus(5, 200)
    waves = []
    monkeypatch.setattr(collocations, "count_phrases", lambda *a, real=collocations.count_phrases: waves.append(1) or real(*a))
    df = spark.createDataFrame([r for r in rows if r[0] == "de"], "lang string, text string")
    got = rows_of(top_collocations(df, least=2, limit=3, first_share=1 / 8, growth=2))
    assert got == plain([r for r in rows if r[0] == "de"], 2, 3)
    assert len(waves) < 4  # an eighth, a quarter, a half, all


def test_small_chunks_long_texts_and_a_lower_share(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 300)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 50)
    rows = corpus(6, 60)
    rows.append(("en", "no end of a piece " * 300))
    df = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(top_collocations(df, least=3, limit=60, max_words=4, inside_share=60)) == plain(rows, 3, 60, 4, 60)


def test_tables_instead_of_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BROADCAST_ROWS", 0)
    rows = corpus(7, 60)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(top_collocations(df, least=3, limit=30)) == plain(rows, 3, 30)


def test_nothing_frequent_and_other_columns(spark):
    df = spark.createDataFrame([("en", "a b c", {"x": 1}, "mine")], "lang string, text string, codes map<string, int>, chunk string")
    assert top_collocations(df).collect() == [] and top_collocations(df.limit(0)).collect() == []
    assert [tuple(r) for r in top_collocations(df, least=1, limit=1).collect()] == [("en", 1, "a b c", 1, 1, 1, 3, 3000)]


def test_a_chunk_is_cut_at_the_end_of_a_piece():
    chunk = Chunk()
    for part in parts_of(b"One two. three"):
        chunk.add(part)
    words, codes = chunk.cut()
    assert [words[c] for c in codes] == [b"one", b"two", b"\n"]
    assert chunk.cut() is None
    chunk.add(b"four \n five")
    words, codes = chunk.cut()
    assert [words[c] for c in codes] == [b"three", b"four", b"\n"] and chunk.cut() is None


def test_keys_tell_rows_apart_beyond_64_bits():
    rng = np.random.default_rng(1)
    columns = [rng.integers(2**31 - 9, 2**31 - 1, 500) for _ in range(5)]
    key = keys(columns, 2**31)
    rows = list(zip(*[c.tolist() for c in columns]))
    assert len(set(key.tolist())) == len(set(rows)) == len(set(zip(key.tolist(), rows)))


def test_chunks_are_read_and_sent_to_python_one_by_one(spark, monkeypatch):
    seen = {}

    def noted(df, label, real=collocations.staged, **options):
        seen[label] = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
        return real(df, label, **options)

    monkeypatch.setattr(collocations, "staged", noted)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = corpus(8, 40)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(top_collocations(df, least=3, limit=30)) == plain(rows, 3, 30)
    assert {seen[label] for label in ("phrase-words", "phrase-level", "phrase-near")} == {("1", "1")}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_words_near_frequent_pairs_hold_all_longer_phrases():
    rng = np.random.default_rng(2)
    codes = rng.integers(-1, 9, 3000).astype(np.int32)
    ids, counts = np.arange(9)[::-1] * 7, np.arange(9)
    rare = counts <= 2
    pairs = np.array([(ids[0], ids[5]), (ids[7], ids[1]), (ids[2], ids[2]), (ids[5], ids[6])])
    left, used = collocations.near_pairs(codes, ids, rare, pairs, 5)
    assert 0 < (left >= 0).sum() < (codes >= 0).sum() / 2
    known = pairs
    for m in (3, 4, 5):
        found = [collocations.phrases_of(c, i, r, m, known) for c, i, r in ((codes, ids, rare), (left, ids[used], rare[used]))]
        whole, near = ({tuple(p): n for p, n in zip(words.tolist(), count.tolist())} for words, count in found)
        assert whole == near and whole
        known = found[0][0]
