"""SimHash near-dedup with deletion-variant signatures.

The 64 bits are cut into `pieces` segments, fewer than would force one of them to be equal: among `taken` of them two
fingerprints that differ in `distance` bits differ by one bit at most. Each fingerprint is indexed once for every such
choice of segments and every bit of them left out; equal keys meet, and the full distance is verified. Rows of equal
fingerprints are one node, so copies are never paired.

Defined results: a text that is null or has no words has fingerprint 0 and is linked like any other; a text with fewer
words than a shingle is one shingle. Missing ids never become a component id unless no other row is reachable. Repeated
rows get equal results. Columns named like a result are replaced by it.
"""

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import LOWER_BYTES, NO_ID, annotate, components, shielded, spanning_forest, texts_of
from ledgerloom.plans.shared import runs_in_tasks, staged

runs_in_tasks(__name__)

SHINGLE = 4
DISTANCE = 4
# Fingerprints compared with each other at once; a key with more is compared block by block.
BLOCK = 2048


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in more than half of the shingles' XXH64 (seed 42)."""
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(len(words) - shingle, 0) + 1
    hashes = np.array([digest(b" ".join(words[i : i + shingle]), 42) for i in range(n)], np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 4096):
        ones += np.unpackbits(hashes[a : a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def add_fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """Add _print, the fingerprint as a long."""

    def run(part: pa.RecordBatch) -> list[pa.Array]:
        prints = [fingerprint((t or b"").translate(LOWER_BYTES).split(), shingle) for t in texts_of(part)]
        return [pa.array(np.array(prints, np.uint64).view(np.int64))]

    return annotate(docs, run, [T.StructField("_print", T.LongType())], keep)


def scheme(count: int, distance: int) -> list[list[int]]:
    """Bit positions of every choice of segments, for the number of fingerprints: the cheaper of writing keys and comparing.

    `taken` of `pieces` segments serve if, however `distance` bits fall, some choice of them differs by one bit at most.
    """
    best = None
    for pieces in range(2, 9):
        cuts = [64 * i // pieces for i in range(pieces + 1)]
        for taken in range(1, pieces):
            # The worst case spreads the bits evenly: the choice with the fewest then has this many.
            low, extra = divmod(distance, pieces)
            if taken * low + max(0, taken - (pieces - extra)) > 1:
                continue
            width = 64 * taken // pieces
            keys = comb(pieces, taken) * width
            cost = count * keys * 20 + keys * count * count / 2.0 ** max(width - 1, 0)
            if best is None or cost < best[0]:
                best = (cost, [[b for p in chosen for b in range(cuts[p], cuts[p + 1])] for chosen in combinations(range(pieces), taken)])
    if best is None:
        raise ValueError(f"no segments for distance {distance}")
    return best[1]


def signatures(fp: str, choices: list[list[int]]) -> Column:
    """All keys of a fingerprint: per choice of segments and bit left out, a hash of the bits that stay."""
    masks = []
    for bits in choices:
        whole = sum(1 << b for b in bits)
        masks += [whole & ~(1 << b) for b in bits]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    table = F.array(*[F.lit(m).cast("long") for m in signed])
    return F.transform(table, lambda m: F.xxhash64(m, F.col(fp).bitwiseAND(m)))


def _compare(distance: int, sides: bool):
    """Streams rows sorted by group; links of each group as a spanning forest. With sides, only across side 0 and 1."""
    columns = ["key", "i", "j"] if sides else ["key"]

    def links(fp: np.ndarray, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        left, right = (fp[side == 0], fp[side == 1]) if sides else (fp, fp)
        a, b = [], []
        for k in range(0, len(left), 256):
            near = np.bitwise_count(left[k : k + 256, None] ^ right[None, :]) <= distance
            u, v = np.nonzero(near)
            u += k
            if not sides:
                u, v = u[u < v], v[u < v]
            if len(u):
                x, y = spanning_forest(left[u].view(np.int64), right[v].view(np.int64))
                a.append(x)
                b.append(y)
        if not a:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return spanning_forest(np.concatenate(a), np.concatenate(b))

    def run(batches):
        held: list[np.ndarray] = []
        out_a: list[np.ndarray] = []
        out_b: list[np.ndarray] = []

        def settle(rows: np.ndarray):
            """Rows of complete groups, sorted by group."""
            group = rows[:, : len(columns)]
            cut = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1), True])
            size = np.diff(cut)
            if not sides:
                two = cut[:-1][size == 2]
                near = np.bitwise_count((rows[two, -1] ^ rows[two + 1, -1]).view(np.uint64)) <= distance
                out_a.append(rows[two[near], -1])
                out_b.append(rows[two[near] + 1, -1])
            for k in np.flatnonzero(size > (1 if sides else 2)):
                part = rows[cut[k] : cut[k + 1]]
                a, b = links(np.ascontiguousarray(part[:, -1]).view(np.uint64), part[:, 3] if sides else None)
                out_a.append(a)
                out_b.append(b)

        def flush(final: bool):
            if out_a and (final or sum(map(len, out_a)) > 100_000):
                a, b = spanning_forest(np.concatenate(out_a), np.concatenate(out_b))
                out_a.clear()
                out_b.clear()
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names])
            if held:
                rows = np.concatenate([*held, rows])
            if not len(rows):
                continue
            same = (rows[:, : len(columns)] == rows[-1, : len(columns)]).all(axis=1)
            end = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
            settle(rows[:end]) if end else None
            held = [rows[end:]]
            yield from flush(False)
        if held:
            settle(held[0])
        yield from flush(True)

    return run


def near_links(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (fp) at most `distance` apart, without listing all pairs.

    Keys with at most `block` fingerprints are sorted together and compared in a stream. A key with more is cut into
    blocks; every two blocks are compared in a task of their own, so no task holds more than two blocks of a key.
    """
    keyed = staged(prints.select("_print", F.explode(signatures("_print", scheme(prints.count(), distance))).alias("key")), "simhash-keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    crowds = staged(sizes, "simhash-crowds")
    crowded = not crowds.isEmpty()
    fine = keyed.join(crowds, "key", "left_anti") if crowded else keyed
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fine = fine.select("key", "_print").repartition(parts, "key").sortWithinPartitions("key")
    links = fine.mapInArrow(_compare(distance, False), "a long, b long")
    if not crowded:
        return links
    crowd = keyed.join(crowds, "key").withColumn("of", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("_print"), F.col("of")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("of") - 1))
    pairs = crowd.withColumn("own", own).withColumn("other", other).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "_print",
    )
    # A block meets itself: its rows stand on both sides.
    pairs = pairs.select("key", "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.lit(0), F.lit(1))).otherwise(F.array("side"))).alias("side"), "_print")
    across = pairs.select(*[F.col(c).cast("long") for c in ("key", "i", "j", "side", "_print")]).repartition(parts, "key", "i", "j")
    across = across.sortWithinPartitions("key", "i", "j").mapInArrow(_compare(distance, True), "a long, b long")
    return links.unionByName(across)


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, keep: list[str] | None = None
) -> DataFrame:
    """Add fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links) and representative, true
    for one row of each component: the first with that id.

    With `keep`, only those columns and doc_id come back, and no text is shuffled. Without, rows meet their result by
    running number. Numbers depend on how a scan is split, so the rows are written with them once and read from there.
    """
    return shielded(docs, ["doc_id", "text"], lambda d, kept: _grouped(d, shingle, distance, kept), None if keep is None else list(dict.fromkeys([*keep, "doc_id"])))


def _grouped(docs: DataFrame, shingle: int, distance: int, keep: list[str] | None) -> DataFrame:
    base = docs.withColumn("_row", F.monotonically_increasing_id())
    if keep is None:
        base = staged(base, "simhash-rows")
    few = ["doc_id"] if keep is None else list(dict.fromkeys([*keep, "doc_id"]))
    printed = staged(add_fingerprints(base, shingle, [*few, "_row"]), "simhash-prints")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "_row"))
    nodes = staged(printed.groupBy("_print").agg(F.min("doc_id").alias("low"), first.alias("first")), "simhash-nodes")
    joined = components(near_links(nodes.select("_print"), distance))
    labels = nodes.join(joined, nodes["_print"] == joined["node"], "left").select(
        "_print", "low", "first", F.coalesce("component", "_print").alias("component")
    )
    least = labels.groupBy("component").agg(F.min("low").alias("component_id"), F.min("first").alias("_first"))
    named = labels.join(least, "component").select("_print", "component_id", F.col("_first._row").alias("_chosen"))
    out = printed.join(named, "_print").withColumn("fingerprint", F.lower(F.lpad(F.hex("_print"), 16, "0")))
    out = out.withColumn("representative", F.col("_row") == F.col("_chosen"))
    if keep is None:
        out = base.join(out.select("_row", "fingerprint", "component_id", "representative"), "_row")
    return out.drop("_print", "_row", "_chosen")
