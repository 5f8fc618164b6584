"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of the test items.

Letters of the automaton are words of the items; any other word of a text is one separating letter. A text is scanned
once, and hits are mapped back to character offsets of the original. Defined results: a null or empty text has no words
and no hits; an item without words occurs nowhere; an item with fewer words than a window is one window. Repeated items
count once by id, items without an id or text are left out. Very long texts are scanned whole. With one automaton no row is joined
or shuffled. Columns named like a result are replaced by it.
"""

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import WORD_BYTES, annotate, shielded, slices, texts_of
from ledgerloom.plans.joins import lookup_join
from ledgerloom.plans.shared import runs_in_tasks, staged

runs_in_tasks(__name__)

WINDOW = 10
# Item text per automaton: about 10 nodes of 40 bytes for every 6 bytes, so below 300 MB in a task. A larger benchmark
# is cut into blocks of items, and the texts are scanned once for each block.
AUTOMATON_BYTES = 4_000_000
WORD_IN_TEXT = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


class Matcher:
    """The automaton of (id, text) items and the items of each of its patterns."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        import ahocorasick

        self.letters: dict[bytes, str] = {}
        patterns: dict[str, tuple[int, set[str]]] = {}
        for item, text in items:
            words = (text or "").encode().translate(WORD_BYTES).split()
            spelled = "".join(self.letter(w) for w in words)
            for k in range(max(len(words) - window, 0) + 1) if words else ():
                piece = spelled[k : k + window]
                patterns.setdefault(piece, (len(piece), set()))[1].add(item)
        self.automaton = ahocorasick.Automaton()
        for piece, found in patterns.items():
            self.automaton.add_word(piece, found)
        self.empty = not patterns
        if patterns:
            self.automaton.make_automaton()

    def letter(self, word: bytes) -> str:
        if word not in self.letters:
            n = len(self.letters) + 1
            self.letters[word] = chr(n if n < 0xD800 else n + 0x800)
        return self.letters[word]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges [from, to) covered by windows, merged, and the ids of the items found."""
        if self.empty:
            return [], set()
        get = self.letters.get
        ranges: list[tuple[int, int]] = []
        found: set[str] = set()
        for end, (size, items) in self.automaton.iter("".join([get(w, "\0") for w in words])):
            ranges.append((end + 1 - size, end + 1))
            found |= items
        return merged(ranges), found


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    keep: list[str] | None = None,
    automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """Add n_words, n_hit, items (sorted ids of items found) and spans (character offsets [begin, end) of hits)."""
    return shielded(docs, ["text"], lambda d, kept: _scanned(d, benchmark, window, kept, automaton_bytes), keep)


FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))),
]


def reported(texts: list[bytes | None], found: list[tuple[list[tuple[int, int]], list[str]]]) -> list[pa.Array]:
    """The result columns of texts whose hit word ranges and items are known."""
    n_words = [len((t or b"").translate(WORD_BYTES).split()) for t in texts]
    spans = []
    for text, (ranges, _) in zip(texts, found):
        places = [m.span() for m in WORD_IN_TEXT.finditer(text.decode("utf-8", "replace"))] if ranges else []
        spans.append([{"begin": places[a][0], "end": places[b - 1][1]} for a, b in ranges])
    return [
        pa.array(n_words, pa.int64()), pa.array([sum(b - a for a, b in ranges) for ranges, _ in found], pa.int64()),
        pa.array([items for _, items in found], pa.list_(pa.string())),
        pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
    ]


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, keep: list[str] | None, automaton_bytes: int) -> DataFrame:
    """One block of items is one pass. More blocks are passes of their own, one after the other, over numbered rows: a task never has more
    than one automaton, and only rows with a hit are written, to be put together and to meet their rows."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text IS NOT NULL AND item_id IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // automaton_bytes) + 1
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    context = docs.sparkSession.sparkContext

    def scanner(block: int):
        rows = [(r["item_id"], r["text"]) for r in items.filter(F.col("block") == block).select("item_id", "text").toLocalIterator()]
        shared, matchers = context.broadcast(rows), []

        def scan(texts: list[bytes | None]) -> list[tuple[list[tuple[int, int]], list[str]]]:
            if not matchers:
                matchers.append(Matcher(shared.value, window))
            hits = (matchers[0].scan((t or b"").translate(WORD_BYTES).split()) for t in texts)
            return [(ranges, sorted(found)) for ranges, found in hits]

        return scan

    if blocks == 1:
        scan = scanner(0)
        return annotate(docs, lambda part: reported(texts_of(part), scan(texts_of(part))), FIELDS, keep)
    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "contamination-rows")
    hits = None
    for block in range(blocks):
        written = staged(rows.select("_row", "text").mapInArrow(_hits(scanner(block)), "_row long, ranges array<long>, items array<string>"), "contamination-hits")
        hits = written if hits is None else hits.unionByName(written)
    both = hits.groupBy("_row").agg(
        F.flatten(F.collect_list("ranges")).alias("_ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items")
    )
    met = lookup_join(rows, both, ["_row"], "left", spread_by=["_row"])

    def put_together(part: pa.RecordBatch) -> list[pa.Array]:
        found = [
            (merged(list(zip((flat or [])[::2], (flat or [])[1::2]))), own or [])
            for flat, own in zip(part.column("_ranges").to_pylist(), part.column("_items").to_pylist())
        ]
        return reported(texts_of(part), found)

    kept = [c for c in docs.columns if keep is None or c in keep]
    return annotate(met, put_together, FIELDS, kept)


def _hits(scan):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = scan(texts_of(part))
                at = [i for i, (ranges, _) in enumerate(found) if ranges]
                yield pa.RecordBatch.from_arrays([
                    part.column("_row").take(pa.array(at, pa.int64())), pa.array([[x for r in found[i][0] for x in r] for i in at], pa.list_(pa.int64())),
                    pa.array([found[i][1] for i in at], pa.list_(pa.string())),
                ], names=["_row", "ranges", "items"])

    return run
