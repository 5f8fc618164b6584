"""Phrase collocation mining by best-first branch-and-bound growth.

Phrases grow word by word, and only from phrases that occur often enough. A phrase that starts or ends with a word of count c scores at
most 1000 n / c, whatever stands between, because the rest of a cut occurs at least as often as the whole: counts of prefixes, and of
suffixes alike, bound all that grows from them. So the rarest words are the most promising. A wave takes those that make up a share of all
occurrences, counts every phrase that starts or ends in them, level by level, and scores the phrases that do both, for these have all
the counts their cuts need. A language is settled once `limit` surviving phrases score strictly more than any phrase of the words left out
can; else the next wave takes `GROWTH` times as much, at last everything.

Texts are cut once into chunks of numbered words, written to the shared folder. A task counts the phrases of a chunk before anything is
shuffled. Chunks are laid out by their number in a bucketed table of the session's catalogue, which is dropped at the end, so that later
joins leave them where they are. Which words and phrases of a chunk are frequent comes back to it by joins of its distinct words and phrases with the tables of
frequent ones; such a table is broadcast, and phrases then looked up inside the task, only when it was measured and found small. Longer phrases need only
the words near a frequent pair, so a wave reads whole chunks for its pairs and once more to cut out these words. A chunk is a row of several megabytes, so it goes to Python as
a batch of its own. Nothing but counts of languages reaches the driver.

Defined results: a null text is empty, a null language is `und`. Repeated rows count as often as they stand there. Pieces end at
`. , ; : ! ?` and at line breaks, words at spaces and tabs; only A-Z are lower-cased; bytes that are no UTF-8 are kept as they are. Ties in
score go to the higher count, then to the phrase that is first in UTF-8 byte order. An empty table, or one without frequent phrases,
gives no rows. Only the columns of the text and the language are read.
"""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import SLICE_BYTES, slices, texts_of
from ledgerloom.plans.joins import BROADCAST_BYTES, BROADCAST_ROWS, measured, top_per_group
from ledgerloom.plans.shared import new_folder, over_all_cores, runs_in_tasks, staged

runs_in_tasks(__name__)

MAX_WORDS = 5
LEAST_COUNT = 100
LIMIT = 2000
# A phrase goes if a longer one around it has at least so many hundredths of its count.
INSIDE_SHARE = 100
UNKNOWN = "und"
# The first wave covers this share of the occurrences of frequent words, each later one GROWTH times as much.
FIRST_SHARE = 1 / 16
GROWTH = 2
# Text that a task holds in open chunks, all languages together.
CHUNK_BYTES = 4_000_000
# Texts, and chunks, that are read and go to Python at once.
TEXT_ROWS, CHUNK_ROWS = 1_000, 1
# Parquet looks at the size of its pages and row groups after a hundred rows; a chunk is as large as a page should be.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
PLAIN_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else 10 if c in SEPARATORS else 32 if c == 9 else c for c in range(256)
)
# Numbers that no word has: nothing between two spaces, and the end of a piece.
NOTHING, BREAK = 0, 1


class Numbers(dict):
    """Words numbered as they come."""

    def __init__(self) -> None:
        super().__init__({b"": NOTHING, b"\n": BREAK})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def parts_of(text: bytes) -> Iterator[bytes]:
    """A text with plain separators, cut between words."""
    text = text.translate(PLAIN_BYTES).replace(b"\n", b" \n ")
    start = 0
    while start < len(text):
        end = text.find(b" ", start + SLICE_BYTES)
        end = len(text) if end < 0 else end
        yield text[start:end]
        start = end


class Chunk:
    """Numbered words of one language, collected until there are enough."""

    def __init__(self) -> None:
        self.numbers, self.parts, self.size = Numbers(), [], 0

    def add(self, part: bytes) -> None:
        words = part.split(b" ")
        codes = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        self.parts.append(codes[codes != NOTHING])
        self.size += len(part)

    def cut(self) -> tuple[list[bytes], np.ndarray] | None:
        """Words and their numbers up to the last end of a piece; what follows stays."""
        codes = np.concatenate([np.zeros(0, np.int32), *self.parts])
        ends = np.flatnonzero(codes == BREAK)
        self.parts, self.size = [codes], 0
        if not len(ends):
            return None
        words, left = list(self.numbers), codes[ends[-1] + 1 :]
        self.numbers = Numbers()
        self.parts = [np.fromiter((self.numbers[words[c]] for c in left), np.int32, len(left))]
        return words, codes[: ends[-1] + 1]


def chunks(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(chunk, lang, words, counts, codes, total): texts as numbers of the chunk's own words, BREAK between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, number = {}, TaskContext.get().partitionId() << 32

        def close(name: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            found = open_[name].cut()
            if found is None:
                return
            words, codes = found
            counts = np.bincount(codes, minlength=len(words))
            counts[: BREAK + 1] = 0
            values = [number, name, words, counts.tolist(), codes.tobytes(), int(counts.sum())]
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, layout)], schema=layout)

        for batch in batches:
            for part in slices(batch, "text"):
                texts, names = texts_of(part), part.column("lang").to_pylist()
                by_name = {}
                for t, name in zip(texts, names):
                    if t:
                        by_name.setdefault(name, []).append(t)
                for name, some in by_name.items():
                    for words in parts_of(b"\n".join([*some, b""])):
                        open_.setdefault(name, Chunk()).add(words)
                        while sum(c.size for c in open_.values()) > CHUNK_BYTES:
                            yield from close(max(open_, key=lambda name: open_[name].size))
        for name in list(open_):
            yield from close(name)

    layout = pa.schema([
        ("chunk", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())),
        ("codes", pa.binary()), ("total", pa.int64()),
    ])
    columns = [F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang")]
    schema = "chunk long, lang string, words array<binary>, counts array<long>, codes binary, total long"
    return over_all_cores(docs.select(*columns)).mapInArrow(run, schema)


@contextmanager
def rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside the block reads and sends to Python at most so many rows at once."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")}
    try:
        for key in before:
            spark.conf.set(key, rows)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def sized(df: DataFrame) -> tuple[DataFrame, int, bool]:
    """A staged table, marked for broadcast if it was measured and found small, its number of rows, and whether it is small."""
    rows, size = measured(df)
    few = rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    return (F.broadcast(df) if few else df), rows, few


def small(df: DataFrame) -> DataFrame:
    return sized(df)[0]


def bucketed(df: DataFrame, label: str, key: str) -> str:
    """Name of a table of `df` in the shared folder, laid out by `key`: joins on the key leave its rows where they are."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.options(**LARGE_ROWS).bucketBy(parts, key).sortBy(key).option("path", new_folder(spark, label)).saveAsTable(name)
    return name


def frequent_words(cut: DataFrame, least: int) -> DataFrame:
    """(lang, word, f, n, id) of the words that occur often enough; n counts all words of the language."""
    single = cut.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    often = single.groupBy("lang", "word").agg(F.sum("c").alias("f")).filter(F.col("f") >= least)
    total = cut.groupBy("lang").agg(F.sum("total").alias("n"))
    with rows_at_once(cut.sparkSession, CHUNK_ROWS):
        return staged(often.join(total, "lang").withColumn("id", F.monotonically_increasing_id()), "phrase-words")


def closed_up(codes: np.ndarray) -> np.ndarray:
    """Codes with one -1 for several in a row."""
    return codes[np.r_[True, (codes[1:] >= 0) | (codes[:-1] >= 0)]]


def only_frequent(cut: DataFrame, words: DataFrame) -> str:
    """Table (chunk, lang, codes, ids, counts): chunks in numbers of frequent words only, the most frequent first; -1 between what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                known = batch.column("known")[i].values
                place, ids, counts = (known.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                old = np.frombuffer(batch.column("codes")[i].as_buffer(), np.int32)
                order = np.lexsort((ids, -counts))
                place, ids, counts = place[order], ids[order], counts[order]
                new = np.full(max(int(old.max()), int(place.max())) + 1, -1, np.int32)
                new[place] = np.arange(len(place))
                codes = closed_up(new[old])
                yield pa.RecordBatch.from_arrays([
                    batch.column("chunk").slice(i, 1), batch.column("lang").slice(i, 1), pa.array([codes.tobytes()], pa.binary()),
                    pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
                ], names=["chunk", "lang", "codes", "ids", "counts"])

    own = cut.select("chunk", "lang", F.posexplode("words").alias("place", "word")).filter(F.col("place") > BREAK)
    # Every word of a chunk looks itself up, so the join makes as many rows as the chunks have words.
    found = own.join(small(words.select("lang", "word", "f", "id")), ["lang", "word"], "left")
    listed = F.collect_list(F.when(F.col("id").isNotNull(), F.struct("place", "id", "f")))
    known = found.groupBy("chunk").agg(listed.alias("known")).filter(F.size("known") > 0)
    joined = cut.select("chunk", "lang", "codes").join(known, "chunk")
    told = joined.mapInArrow(run, "chunk long, lang string, codes binary, ids array<long>, counts array<long>")
    with rows_at_once(cut.sparkSession, CHUNK_ROWS):
        return bucketed(told, "phrase_chunks", "chunk")


def keys(columns: list[np.ndarray], span: int) -> np.ndarray:
    """One number for every row of columns with values below `span`; equal numbers mean equal rows."""
    key, reach = columns[0].astype(np.int64), span
    for column in columns[1:]:
        if reach > 2**62 // span:
            key = np.unique(key, return_inverse=True)[1]
            reach = len(key) + 1
        key = key * span + column
        reach *= span
    return key


def runs_of(codes: np.ndarray, m: int) -> np.ndarray:
    """Whether m words in a row start here."""
    run = codes >= 0
    for _ in range(m - 1):
        run = run[:-1] & (codes[len(codes) - len(run) + 1 :] >= 0)
    return run


def starts_of(codes: np.ndarray, ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether a phrase that `known` has a row of ids for starts here."""
    m = known.shape[1]
    run = runs_of(codes, m)
    order = np.argsort(ids)
    listed = order[np.searchsorted(ids[order], known)]
    at = np.flatnonzero(run)
    columns = [np.concatenate([codes[at + k], listed[:, k]]) for k in range(m)]
    key = keys(columns, max(len(ids), 1))
    often = np.zeros(len(run), bool)
    often[at] = np.isin(key[: len(at)], key[len(at) :])
    return often


def phrases_of(codes: np.ndarray, ids: np.ndarray, rare: np.ndarray, m: int, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and counts of the phrases of m words that may be frequent and start or end in a rare word.

    `known` has a row of ids for every frequent phrase of one word less that starts or ends in a rare word.
    """
    span = max(len(ids), 1)
    run = runs_of(codes, m - 1)
    often = starts_of(codes, ids, known) if m > 2 else run
    n = max(len(codes) - m + 1, 0)
    at = np.flatnonzero(run[:n] & (codes[m - 1 :] >= 0))
    first, last = rare[codes[at]], rare[codes[at + m - 1]]
    at = at[(first | last) & (~first | often[at]) & (~last | often[at + 1])]
    if not len(at):
        return np.zeros((0, m), np.int64), np.zeros(0, np.int64)
    _, where, count = np.unique(keys([codes[at + k] for k in range(m)], span), return_index=True, return_counts=True)
    at = at[where]
    return np.stack([ids[codes[at + k]] for k in range(m)], axis=1), count


def near_pairs(codes: np.ndarray, ids: np.ndarray, rare: np.ndarray, pairs: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes with only the words that phrases of up to `reach` words can have, and the former numbers of those words.

    A longer phrase that starts in a rare word starts with a frequent pair, and one that ends in a rare word ends with one.
    """
    at = np.flatnonzero(starts_of(codes, ids, pairs))
    first, last = at[rare[codes[at]]], at[rare[codes[at + 1]]] + 1
    near = np.zeros(len(codes), bool)
    for k in range(reach):
        near[np.minimum(first + k, len(codes) - 1)] = True
        near[np.maximum(last - k, 0)] = True
    codes = closed_up(np.where(near, codes, -1))
    used, new = np.unique(codes[codes >= 0], return_inverse=True)
    left = np.full(len(codes), -1, np.int32)
    left[codes >= 0] = new
    return left, used


def word_columns(m: int, start: int = 1) -> list[str]:
    return [f"w{k}" for k in range(start, start + m)]


def of_chunk(phrases: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The phrases that have only words with these ids."""
    place = np.sort(ids)
    at = np.minimum(np.searchsorted(place, phrases), len(place) - 1)
    return phrases[(place[at] == phrases).all(axis=1)]


def local_phrases(work: DataFrame, m: int, shared=None) -> DataFrame:
    """(chunk, w1 .. wm, c) of the phrases that each chunk finds worth counting.

    The frequent phrases of one word less come with each chunk as `known`, or all of them as a broadcast array `shared`.
    """
    columns = word_columns(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes = np.frombuffer(batch.column("codes")[i].as_buffer(), np.int32)
                ids, counts = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "counts"))
                known = None
                if m > 2 and shared is not None:
                    known = of_chunk(shared.value, ids)
                elif m > 2:
                    known = batch.column("known")[i].values.flatten().to_numpy(zero_copy_only=False).reshape(-1, m - 1)
                words, count = phrases_of(codes, ids, counts <= batch.column("cut")[i].as_py(), m, known)
                arrays = [pa.array(np.full(len(count), batch.column("chunk")[i].as_py()), pa.int64())]
                arrays += [pa.array(np.ascontiguousarray(words[:, k]), pa.int64()) for k in range(m)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(count, pa.int64())], names=["chunk", *columns, "c"])

    return work.mapInArrow(run, ", ".join(f"{c} long" for c in ["chunk", *columns, "c"]))


def only_near(work: DataFrame, shared, reach: int) -> DataFrame:
    """(chunk, codes, ids, counts, cut): chunks with only the words near a pair of the broadcast array `shared`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes = np.frombuffer(batch.column("codes")[i].as_buffer(), np.int32)
                ids, counts = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "counts"))
                codes, used = near_pairs(codes, ids, counts <= batch.column("cut")[i].as_py(), of_chunk(shared.value, ids), reach)
                if len(used):
                    yield pa.RecordBatch.from_arrays([
                        batch.column("chunk").slice(i, 1), pa.array([codes.tobytes()], pa.binary()), pa.array([ids[used]], pa.list_(pa.int64())),
                        pa.array([counts[used]], pa.list_(pa.int64())), batch.column("cut").slice(i, 1),
                    ], names=["chunk", "codes", "ids", "counts", "cut"])

    return work.mapInArrow(run, "chunk long, codes binary, ids array<long>, counts array<long>, cut long")


def wave_cuts(words: DataFrame, active: DataFrame | None, share: float) -> DataFrame:
    """(lang, cut, bound): per language the highest count of the words of this wave, and the most that phrases of other words can score.

    Words are summed by classes of counts first, eight for a doubling, so that a language has a few hundred steps.
    """
    classes = words.groupBy("lang", "n", F.floor(F.log2("f") * 8).alias("class"))
    by_count = classes.agg(F.sum("f").alias("mass"), F.max("f").alias("f"), F.min("f").alias("low"))
    if active is not None:
        by_count = by_count.join(active, "lang")
    per_lang = by_count.groupBy("lang", "n").agg(F.sort_array(F.collect_list(F.struct("f", "mass", "low"))).alias("steps"), F.sum("mass").alias("all"))
    sums = F.aggregate(
        "steps", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("cut")),
        lambda s, x: F.struct(
            (s["sum"] + x["mass"]).alias("sum"),
            F.when(s["cut"].isNull() | (s["sum"] + x["mass"] <= F.col("all") * F.lit(float(share))), x["f"]).otherwise(s["cut"]).alias("cut"),
        ),
    )["cut"]
    beyond = F.array_min(F.transform(F.filter("steps", lambda x: x["f"] > F.col("cut")), lambda x: x["low"]))
    cuts = per_lang.withColumn("cut", sums).withColumn("next", beyond)
    return cuts.select("lang", "cut", F.expr("(1000 * n) div next").alias("bound"))


def count_phrases(frequent: DataFrame, cuts: DataFrame, least: int, max_words: int) -> list[DataFrame]:
    """Tables of the frequent phrases of 2, 3 ... words that start or end in a word of the wave, with their counts."""
    spark = frequent.sparkSession
    work = frequent.join(cuts.select("lang", "cut"), "lang")
    levels, known, shared = [], None, None
    for m in range(2, max_words + 1):
        columns = word_columns(m)
        met = work if known is None else work.join(known, "chunk")
        often = local_phrases(met, m, shared).groupBy(*columns).agg(F.sum("c").alias("f")).filter(F.col("f") >= least)
        with rows_at_once(spark, CHUNK_ROWS):
            level = staged(often, "phrase-level")
        level, found, few = sized(level)
        levels.append(level)
        if not found or m == max_words:
            break
        if few:
            table = level.select(*columns).toArrow()
            known, shared = None, spark.sparkContext.broadcast(np.stack([table.column(c).to_numpy() for c in columns], axis=1))
            if m == 2 and max_words > 3:
                with rows_at_once(spark, CHUNK_ROWS):
                    work = staged(only_near(work, shared, max_words), "phrase-near", options=LARGE_ROWS)
            continue
        # Every row looks its phrase up, so the join makes as many rows as the chunks have.
        back = local_phrases(met, m, shared).join(level.select(*columns, F.lit(True).alias("often")), columns, "left")
        listed = F.collect_list(F.when(F.col("often"), F.array(*columns)))
        with rows_at_once(spark, CHUNK_ROWS):
            known, shared = staged(back.groupBy("chunk").agg(listed.alias("known")).filter(F.size("known") > 0), "phrase-known"), None
    return levels


def scored(words: DataFrame, cuts: DataFrame, levels: list[DataFrame], inside_share: int) -> DataFrame:
    """(lang, words, a, l, r, n, score) of the phrases that start and end in words of the wave and survive."""
    counts = lambda *c: F.array(*c).cast("array<long>")
    rare = words.join(cuts, "lang").filter(F.col("f") <= F.col("cut"))
    part = words.join(rare.select("id", F.lit(True).alias("rare")), "id", "left")
    mine = F.when(F.col("rare"), counts())
    # A row per phrase; `before` has the counts of its proper prefixes and `after` those of its proper suffixes, where it starts, or ends, rare.
    shorter = part.select(F.col("id").alias("w1"), "f", "lang", "n", mine.alias("before"), mine.alias("after"))
    result = None
    for m, level in enumerate(levels, 2):
        columns = word_columns(m)
        prefix = shorter.select(*columns[:-1], "lang", "n", F.concat("before", counts("f")).alias("before")).filter(F.col("before").isNotNull())
        suffix = shorter.select(*[F.col(a).alias(b) for a, b in zip(word_columns(m - 1), columns[1:])], F.concat(counts("f"), "after").alias("after"))
        suffix = suffix.filter(F.col("after").isNotNull())
        phrases = level.join(prefix, columns[:-1], "left").join(suffix, columns[1:], "left")
        shorter = staged(phrases.select(*columns, "f", "lang", "n", "before", "after"), "phrase-cuts")
        whole = shorter.filter(F.col("before").isNotNull() & F.col("after").isNotNull())
        if m - 1 < len(levels):
            longer, more = levels[m - 1], word_columns(m + 1)
            wider = [longer.select(*[F.col(a).alias(b) for a, b in zip(more[s : s + m], columns)], F.col("f").alias("g")) for s in (0, 1)]
            around = wider[0].unionByName(wider[1]).groupBy(*columns).agg(F.max("g").alias("g"))
            whole = whole.join(around, columns, "left").filter(F.coalesce(F.col("g") * 100 < F.col("f") * inside_share, F.lit(True)))
        rows = whole.select("lang", F.array(*columns).alias("words"), F.col("f").alias("a"), "n", "before", "after")
        result = rows if result is None else result.unionByName(rows)
    big = lambda c: c.cast("decimal(20,0)")
    result = result.withColumn("_cuts", F.arrays_zip("before", "after")).withColumn("_best", F.array_min(F.transform(
        "_cuts", lambda c, k: F.struct(_div(big(F.col("a")) * 1000 * big(F.col("n")), big(c["before"]) * big(c["after"])).alias("score"), k.alias("k"), c["before"].alias("l"), c["after"].alias("r"))
    )))
    return result.select("lang", "words", "a", "_best.l", "_best.r", "n", "_best.score")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def spelled(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Phrases with their words as text."""
    single = phrases.select("words", F.posexplode("words").alias("k", "id"))
    named = single.join(words.select("id", "word"), "id").groupBy("words").agg(F.sort_array(F.collect_list(F.struct("k", "word"))).alias("w"))
    text = F.array_join(F.transform("w", lambda w: w["word"].cast("string")), " ")
    return phrases.join(named.select("words", text.alias("phrase")), "words").drop("words")


def grown(
    frequent: DataFrame, words: DataFrame, least: int, limit: int, max_words: int, inside_share: int, share: float, growth: int
) -> DataFrame | None:
    """Surviving phrases of all languages, for each from the wave that settled it; None without frequent words."""
    active, settled = None, None
    while True:
        cuts = staged(wave_cuts(words, active, share), "phrase-waves")
        small_cuts, languages, _ = sized(cuts)
        if not languages:
            return settled
        levels = count_phrases(frequent, small_cuts, least, max_words)
        survivors = staged(scored(words, small_cuts, levels, inside_share), "phrase-scored")
        beyond = survivors.join(small_cuts, "lang").filter(F.col("bound").isNull() | (F.col("score") > F.col("bound")))
        enough = staged(cuts.join(beyond.groupBy("lang").count(), "lang", "left").select(
            "lang", (F.col("bound").isNull() | (F.coalesce("count", F.lit(0)) >= limit)).alias("enough")
        ), "phrase-settled")
        done = survivors.join(small(enough.filter("enough").select("lang")), "lang")
        settled = done if settled is None else settled.unionByName(done)
        active, share = enough.filter("NOT enough").select("lang"), share * growth


def top_collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT, limit: int = LIMIT, max_words: int = MAX_WORDS,
    inside_share: int = INSIDE_SHARE, first_share: float = FIRST_SHARE, growth: int = GROWTH,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `limit` phrases."""
    spark = docs.sparkSession
    with rows_at_once(spark, TEXT_ROWS):
        cut = staged(chunks(docs, text, lang), "phrase-texts", options=LARGE_ROWS)
    words = frequent_words(cut, least)
    frequent = only_frequent(cut, words)
    try:
        settled = grown(spark.table(frequent), words, least, limit, max_words, inside_share, first_share, growth)
    finally:
        spark.sql(f"DROP TABLE {frequent}")
    if settled is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    order = [F.desc("score"), F.desc("a")]
    last = top_per_group(settled.select("lang", "score", "a"), ["lang"], order, limit).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("last"))
    chosen = settled.join(last, "lang").filter(F.struct("score", "a") >= F.col("last")).drop("last")
    ranked = top_per_group(spelled(staged(chosen, "phrase-chosen"), words), ["lang"], [*order, F.asc("phrase")], limit)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
