"""Substring dedup: word windows repeated at one length are extended to twice that length, up to the full window.

A word is removed when a window of `window` consecutive words that covers it also starts in a document with a smaller
id. Levels for 50 words: 13 -> 25 -> 50. Level one needs only the windows that are smallest by hash among all that fit
into some full window: equal full windows pick equal ones, so no repeated passage is missed. Candidates go on as long as
another document shares them; the last level compares the full windows by 96 bits of hash.

Defined results: null and empty texts and texts shorter than a window lose nothing; a null text stays null. A missing id
counts as the largest id. Rows with equal ids are one document: they do not take words from each other. Documents whose
whole word sequence repeats are settled as a whole, so groups of copies never reach the levels. Other columns stay as they
are, but for columns named like a result, which are replaced.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import NO_ID, shielded, slices, texts_of, without
from ledgerloom.plans.shared import runs_in_tasks, staged

runs_in_tasks(__name__)

WINDOW = 50
_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """Words of several texts: a 64-bit hash each, the text they are in, and where that text ends."""

    def __init__(self, texts: list[bytes | None]) -> None:
        joined = b"\n".join(t or b"" for t in texts) + b"\n"
        raw = np.frombuffer(joined, np.uint8)
        blank = _BLANK[raw]
        start = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
        size = np.flatnonzero(blank & np.r_[False, ~blank[:-1]]) - start
        ends = np.cumsum([len(t or b"") + 1 for t in texts])
        self.owner = np.searchsorted(ends, start, side="right")
        self.counts = np.bincount(self.owner, minlength=len(texts))
        self.last = np.cumsum(self.counts)
        self.first = self.last - self.counts
        h = size.astype(_U) + _U(0x9E3779B97F4A7C15)
        short = np.flatnonzero(size <= 48)
        order = short[np.argsort(-size[short], kind="stable")]
        left = np.searchsorted(-size[order], -np.arange(48), side="left")
        place, value = start[order], h[order]
        for j in range(48):
            k = left[j]
            if not k:
                break
            value[:k] = (value[:k] ^ raw[place[:k] + j]) * _U(0x100000001B3)
        h[order] = value
        for i in np.flatnonzero(size > 48):
            h[i] = xxhash.xxh64_intdigest(joined[start[i] : start[i] + size[i]])
        self.hash = scramble(h)

    def windows(self, length: int, seed: int = 0) -> np.ndarray:
        """Hash of the window of that length at every word, built by doubling; meaningless where it leaves its text."""
        if length == 1:
            return scramble(self.hash + _U(seed)) if seed else self.hash
        half = (length + 1) // 2
        part, move = self.windows(half, seed), length - half
        out = np.zeros_like(part)
        if len(part) > move:
            out[:-move] = scramble(part[:-move] * _U(0x9E3779B97F4A7C15) + scramble(part[move:] + _U(length + seed)))
        return out

    def fits(self, length: int) -> np.ndarray:
        return np.arange(len(self.hash)) + length <= self.last[self.owner]


def sliding(values: np.ndarray, width: int, pick, empty) -> np.ndarray:
    """pick (minimum or maximum) over values[i : i + width]; beyond the end counts as `empty`."""
    out, span = values.copy(), 1
    while span < width:
        step = min(span, width - span)
        moved = np.full_like(out, empty)
        if len(out) > step:
            moved[:-step] = out[step:]
        out, span = pick(out, moved), span + step
    return out


def anchors(words: Words, base: int, window: int) -> np.ndarray:
    """Starts of the base windows that have the smallest hash inside some full window of their text."""
    if not len(words.hash):
        return np.empty(0, np.int64)
    top, width = _U(2**64 - 1), window - base + 1
    h = np.minimum(words.windows(base), top - _U(1))
    h[~words.fits(base)] = top
    low = sliding(h, width, np.minimum, top)
    low[~words.fits(window)] = 0
    back = sliding(low[::-1], width, np.maximum, _U(0))[::-1]
    return np.flatnonzero((back == h) & (h < top))


def levels(window: int) -> tuple[int, int]:
    """Lengths of the first and the middle level."""
    middle = (window + 1) // 2
    return (middle + 1) // 2, middle


def _survey(docs: DataFrame, window: int) -> DataFrame:
    """A row per document with words enough: hash of all words, and its anchors with the middle windows at their sides."""
    base, middle = levels(window)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part)
                words = Words(texts)
                at = anchors(words, base, window)
                owner = words.owner[at] if len(at) else np.empty(0, np.int64)
                low, mid = words.windows(base), words.windows(middle)
                shift = middle - base
                right = np.where(at + middle <= words.last[owner], mid[at], 0)
                left = np.where(at - shift >= words.first[owner], mid[np.maximum(at - shift, 0)], 0)
                cut = np.searchsorted(owner, np.arange(len(texts) + 1))
                use = np.flatnonzero(words.counts >= window)
                number = lambda x: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.diff(cut)[use])].astype(np.int32)), pa.array(x))  # noqa: E731,B023
                flat = np.isin(owner, use)
                ids = part.column("id").to_numpy(zero_copy_only=False)[use]
                whole = [xxhash.xxh128_digest(words.hash[words.first[i] : words.last[i]].tobytes()) for i in use]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids), pa.array(whole, pa.binary()), part.column("th").take(pa.array(use)),
                        number((at - words.first[owner])[flat].astype(np.int32)), number(low[at][flat].view(np.int64)),
                        number(left[flat].view(np.int64)), number(right[flat].view(np.int64)),
                    ],
                    names=["id", "whole", "th", "at", "low", "left", "right"],
                )

    return docs.mapInArrow(
        run, "id long, whole binary, th long, at array<int>, low array<long>, left array<long>, right array<long>"
    )


def _shared_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys met in two documents or more, with the smallest id; summed map-side, so a hot key is no hot task.

    Written and merged, so that joins with it shuffle both sides at every size and AQE can split the rows of a hot key among
    tasks.
    """
    shared = rows.groupBy(*keys).agg(F.min("id").alias("first"), F.max("id").alias("_last")).filter("first < _last").drop("_last")
    return staged(shared, "substring-shared").hint("merge")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, th, spans): word ranges to remove of each document (id, text, th = hash of the text) that loses words."""
    base, middle = levels(window)
    survey = staged(_survey(docs, window), "substring-survey")
    groups = _shared_keys(survey, "whole")
    survey = survey.join(groups, "whole", "left").withColumn("copy", F.coalesce(F.col("first") < F.col("id"), F.lit(False)))
    copies = survey.filter("copy").select("id", "th", F.lit(True).alias("all"))
    spots = survey.filter("not copy").select(
        "id", "th", F.explode(F.arrays_zip("at", "low", "left", "right")).alias("a")
    ).select("id", "th", "a.at", "a.low", "a.left", "a.right")
    spots = staged(spots.join(_shared_keys(spots, "low").select("low").hint("merge"), "low", "left_semi"), "substring-spots")
    # The windows of the middle length on either side of an anchor; a full window around it holds one of the two.
    side = F.explode(F.array(
        F.struct((F.col("at") - (middle - base)).alias("at"), F.col("left").alias("key")),
        F.struct(F.col("at"), F.col("right").alias("key")),
    )).alias("s")
    sides = spots.select("id", "th", side).select("id", "th", "s.at", "s.key").filter("key <> 0").distinct()
    sides = sides.join(_shared_keys(sides, "key").select("key").hint("merge"), "key", "left_semi")
    asked = sides.groupBy("id", "th").agg(F.collect_set("at").alias("ask"))
    wanted = docs.join(asked, ["id", "th"])

    def extend(batches):
        for batch in batches:
            for part in slices(batch):
                words = Words(texts_of(part))
                mark = np.zeros(len(words.hash) + 1, np.int64)
                ask = part.column("ask")
                owner = np.repeat(np.arange(part.num_rows), ask.value_lengths().to_numpy(zero_copy_only=False))
                at = words.first[owner] + ask.flatten().to_numpy(zero_copy_only=False)
                np.add.at(mark, np.maximum(at - (window - middle), words.first[owner]), 1)
                np.add.at(mark, at + 1, -1)
                s = np.flatnonzero((np.cumsum(mark)[:-1] > 0) & words.fits(window))
                row = words.owner[s]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(row)), part.column("th").take(pa.array(row)),
                        pa.array((s - words.first[row]).astype(np.int32)), pa.array(words.windows(window)[s].view(np.int64)),
                        pa.array(words.windows(window, 7)[s].view(np.int64).astype(np.int32)),
                    ],
                    names=["id", "th", "at", "key", "check"],
                )

    full = staged(wanted.select("id", "th", "text", "ask").mapInArrow(extend, "id long, th long, at int, key long, check int"), "substring-full")
    later = full.join(_shared_keys(full, "key", "check"), ["key", "check"]).filter("first < id")
    runs = later.groupBy("id", "th").agg(F.array_sort(F.collect_set("at")).alias("starts"))
    return runs.select("id", "th", "starts", F.lit(False).alias("all")).unionByName(
        copies.distinct().select("id", "th", F.lit(None).cast("array<int>").alias("starts"), "all")
    )


def remove_repeated(
    docs: DataFrame, window: int = WINDOW, keep: list[str] | None = None, result: str = "kept_text"
) -> DataFrame:
    """Add n_words, n_removed and `result`: the words left, joined by one blank (null for a null text).

    The text crosses the network twice: once, only for documents that share a middle window, to the last level, and once
    to meet what is to be removed.
    """
    return shielded(docs, ["doc_id", "text"], lambda d, kept: _without_spans(d, window, kept, result), keep)


def _without_spans(docs: DataFrame, window: int, keep: list[str] | None, result: str) -> DataFrame:
    id_, th = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.coalesce(F.xxhash64("text"), F.lit(0))
    spans = repeated_spans(docs.select(id_.alias("id"), th.alias("th"), "text").filter("text IS NOT NULL"), window)
    base = without(docs, "n_words", "n_removed", *([result] if result != "text" else []))
    kept = [c for c in base.columns if (keep is None or c in keep) and c != result]
    spans = spans.select(F.col("id").alias("_span_id"), F.col("th").alias("_span_th"), F.col("starts").alias("_starts"), F.col("all").alias("_all"))
    rows = base.withColumn("_id", id_).withColumn("_th", th)
    rows = rows.join(spans, (F.col("_id") == F.col("_span_id")) & (F.col("_th") == F.col("_span_th")), "left")
    rows = rows.select(*dict.fromkeys([*kept, "text"]), "_starts", "_all")

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                n_words, n_removed, out = [], [], []
                for text, starts, whole in zip(texts_of(part), part.column("_starts").to_pylist(), part.column("_all").to_pylist()):
                    words = (text or b"").split()
                    left = words
                    if whole:
                        left = []
                    elif starts:
                        mark = np.zeros(len(words) + 1, np.int64)
                        s = np.array(starts)
                        mark[s] += 1
                        mark[s + window] -= 1
                        left = [w for w, hit in zip(words, (np.cumsum(mark) > 0).tolist()) if not hit]
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(left))
                    out.append(None if text is None else b" ".join(left).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())],
                    names=[*kept, "n_words", "n_removed", result],
                )

    made = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(result, T.StringType())]
    schema = T.StructType([docs.schema[c] for c in kept] + made)
    return rows.mapInArrow(cut, schema)
