"""Licence parts against plain TF-IDF over all words of all files."""

import math
import random
import textwrap
from collections import Counter

from ledgerloom.llm import licenses
from ledgerloom.llm.licenses import ALL_TEMPLATES, LONG_TEMPLATES, THRESHOLD, words


def plain(texts):
    """(licence, similarity, line) of every text: all lines, headers and whole texts with all templates."""
    df = Counter(w for t in texts for w in set(words((t or "").encode())))
    n = len(texts)

    def vector(text):
        raw = {w: (1 + math.log(c)) * (math.log((n + 1) / (df[w] + 1)) + 1) for w, c in Counter(text).items()}
        size = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / size for w, x in raw.items()}

    templates = [(name, vector(words(text.encode()))) for name, text in ALL_TEMPLATES]
    out = []
    for text in texts:
        lines = [words(x) for x in (text or "").encode().splitlines()]
        full = [i for i, x in enumerate(lines) if x]
        parts = [(k, lines[i]) for k, i in enumerate(full)]
        header = [i for k, i in enumerate(full) if i - k == full[0]]
        parts += [(0, sum((lines[i] for i in header), []))] if len(header) > 1 else []
        parts += [(0, sum((lines[i] for i in full), []))] if len(full) > len(header) else []
        found = []
        for no, own in parts:
            v = vector(own)
            found += [(-round(sum(x * v.get(w, 0) for w, x in t.items()), 9), name, no) for name, t in templates]
        found = [f for f in found if -f[0] >= THRESHOLD]
        best = min(found, default=(0, None, None))
        out.append((best[1], round(-best[0], 6), best[2]))
    return out


def corpus(seed, n=80):
    rng = random.Random(seed)
    vocabulary = [*(f"w{i}" for i in range(60)), *"the of and to in this that any for is by under license software".split()]
    some = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    texts = [None, "", "\n\n"]
    for _ in range(n):
        body = "\n".join(some(rng.randrange(0, 14)) for _ in range(rng.randrange(0, 8)))
        name, text = rng.choice(ALL_TEMPLATES)
        kind = rng.randrange(6)
        if kind == 0:
            body = f"# {text} by us\n{body}"
        elif kind == 1:
            body = "\n".join("# " + x for x in textwrap.wrap(text, 50)) + f"\n\n{body}"
        elif kind == 2:
            body = f"Copyright 2020 {some(2)}\n\n" + "\n\n".join(textwrap.wrap(text, 70))
        elif kind == 3:
            body = f"{body}\nReleased under the MIT License {some(rng.randrange(3))}\n{body}"
        texts.append(body)
    return texts


def scanned(spark, texts):
    df = spark.createDataFrame([(i, f"d{i}/f", t) for i, t in enumerate(texts)], "i long, path string, text string")
    rows = licenses.scan_licenses(df, keep=["i"]).collect()
    return [(r["own_license"], round(r["similarity"], 6), r["own_line"]) for r in sorted(rows, key=lambda r: r["i"])]


def test_against_plain_tf_idf(spark):
    texts = corpus(3)
    got = scanned(spark, texts)
    assert got == plain(texts) and len({name for name, _, _ in got}) > 5


def test_the_answer_does_not_depend_on_the_size_of_the_table(spark):
    """A third of the files state the licence, with words beside it that many files hold."""
    line = "# Released under the MIT License by us"
    for n in (30, 3000):
        texts = [line if i % 3 == 0 else f"by us and w{i % 50} and w{i % 7}" for i in range(n)]
        got = scanned(spark, texts)
        assert [name for name, _, _ in got] == ["MIT" if i % 3 == 0 else None for i in range(n)]
        assert got[0][1] > 0.75


def test_whole_files_speak_for_their_directory(spark):
    rows = [(f"{name}/sub/x.py", "nothing here") for name in LONG_TEMPLATES]
    rows += [(f"{name}/text", "\n".join(textwrap.wrap(text, 40)) + "\n\n") for name, text in LONG_TEMPLATES.items()]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r["path"]: r["license"] for r in licenses.scan_licenses(df).collect()}
    assert all(got[f"{name}/sub/x.py"] == got[f"{name}/text"] == name for name in LONG_TEMPLATES)
