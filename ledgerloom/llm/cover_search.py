"""Exact top-k inner products by dual-tree cover-tree search.

Queries and data are dealt to cells around a few pivots, the top level of the trees; a cell is cut into blocks of bounded
size, and each block becomes a cover tree by farthest-first nets: every node has a centre, a covering radius and at most
FANOUT children. A pair of nodes is pruned when the largest product it can hold,
<q, d> + R_q |d| + R_d |q| + R_q R_d for centres q, d, is below the worst kth score of the query group. First every query
block meets its most promising data blocks, which sets these scores; then all pairs of blocks that they do not prune are
searched, the most promising first. Only sums of blocks (centre, radius, size) are matched all against all.

Vectors become floor(scale x) first; those that are null, of another length than the commonest (the longer of two as
common; a warning gives their number), or hold null or non-finite components, take no part. Defined results: ties go to the smaller id; a row never finds itself, but finds other rows of
the same id; a query with fewer than k candidates gets them all; an empty table gives no rows; a null id takes no part.
Equal vectors of any number are spread over blocks. Only the result's columns come back.
"""

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.shared import runs_in_tasks, staged

runs_in_tasks(__name__)

SCALE = 64
K = 20
# Pivots, one for every block of rows up to MAX_PIVOTS, are chosen among this many rows, the first by hash of the id: a
# bounded sample that only shapes the cells.
PIVOT_SAMPLE = 2048
MAX_PIVOTS = 64
# Rows of a block: 256 kB for 64 components of one byte.
QUERY_BLOCK, DATA_BLOCK = 1024, 4096
FANOUT, LEAF = 8, 256
# Data blocks that each query block meets before anything is pruned.
FIRST_BLOCKS = 1
# Shares of a query block's list of data blocks that are searched side by side.
LANES = 4


def to_integers(vectors: DataFrame, vec: str, scale: int = SCALE) -> DataFrame:
    """Replace `vec` by floor(scale x) as longs and leave out rows with unusable vectors."""
    x = F.col(vec)
    sound = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return vectors.filter(sound).withColumn(vec, F.transform(x, lambda v: F.floor(v.cast("double") * scale)))


def farthest_first(points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a net of at most n points, each the farthest from those before it, and the nearest of them for every row."""
    chosen = [0]
    gap = ((points - points[0]) ** 2).sum(axis=1)
    near = np.zeros(len(points), np.int64)
    while len(chosen) < n and gap.max() > 0:
        new = int(gap.argmax())
        d = ((points - points[new]) ** 2).sum(axis=1)
        near[d < gap] = len(chosen)
        gap = np.minimum(gap, d)
        chosen.append(new)
    return np.array(chosen), near


class Node:
    """Rows of a block around a centre: children, or the rows themselves."""

    __slots__ = ("centre", "children", "norm", "radius", "rows")

    def __init__(self, points: np.ndarray, rows: np.ndarray) -> None:
        own = points[rows]
        self.centre = own.mean(axis=0)
        self.norm = float(np.sqrt((self.centre**2).sum()))
        self.radius = float(np.sqrt(((own - self.centre) ** 2).sum(axis=1).max()))
        self.rows, self.children = rows, []
        if len(rows) > LEAF and self.radius > 0:
            net, near = farthest_first(own, FANOUT)
            if len(net) > 1:
                self.children = [Node(points, rows[near == i]) for i in range(len(net))]
        elif len(rows) > LEAF:
            self.children = [Leaf(points, rows[i : i + LEAF]) for i in range(0, len(rows), LEAF)]


class Leaf(Node):
    """Equal rows beyond the size of a leaf are only counted off."""

    def __init__(self, points: np.ndarray, rows: np.ndarray) -> None:
        self.centre, self.radius, self.rows, self.children = points[rows[0]], 0.0, rows, []
        self.norm = float(np.sqrt((self.centre**2).sum()))


def most(q: Node, d: Node) -> float:
    """No product of a row below q with a row below d is larger; a little is added for rounding."""
    top = float(q.centre @ d.centre) + q.radius * d.norm + d.radius * q.norm + q.radius * d.radius
    return top + 1e-9 * (abs(top) + 1)


class Best:
    """The k best candidates so far of every query of a block, none of a score below `floor`."""

    def __init__(self, n: int, k: int, floor: int) -> None:
        self.k, self.floor = k, floor
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.full = np.zeros(n, np.int64)

    def worst(self, rows: np.ndarray) -> float:
        """The worst kth score of a group of queries; the floor while one of them has fewer than k."""
        return max(float(self.score[rows, -1].min()) if (self.full[rows] == self.k).all() else -np.inf, float(self.floor))

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates (row, score, id) join those held."""
        touched = np.unique(rows)
        r = np.concatenate([np.repeat(touched, self.full[touched]), rows])
        held = np.arange(self.k)[None, :] < self.full[touched][:, None]
        s = np.concatenate([self.score[touched][held], scores])
        i = np.concatenate([self.id[touched][held], ids])
        order = np.lexsort((i, -s, r))
        r, s, i = r[order], s[order], i[order]
        start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        rank = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
        top = rank < self.k
        self.score[r[top], rank[top]], self.id[r[top], rank[top]] = s[top], i[top]
        self.full[touched] = np.minimum(np.bincount(r, minlength=len(self.full))[touched], self.k)


class Block:
    """Vectors of a block with their ids and row numbers, and the tree over them."""

    def __init__(self, ids: bytes, numbers: bytes, vectors: bytes, width: int, kind: str) -> None:
        self.ids, self.numbers = np.frombuffer(ids, "<i8"), np.frombuffer(numbers, "<i8")
        self.whole = np.frombuffer(vectors, kind).reshape(-1, width).astype(np.int64)
        self.points = self.whole.astype(np.float64)
        self.root = Node(self.points, np.arange(len(self.ids)))
        self.exact = float(np.abs(self.points).max(initial=0)) ** 2 * width < 2**53


def search(q: Block, d: Block, best: Best) -> None:
    """Visit node pairs of two trees, the more promising child pairs first, and compare the leaves that are left."""
    stack = [(q.root, d.root)]
    while stack:
        a, b = stack.pop()
        if most(a, b) < best.worst(a.rows):
            continue
        if a.children or b.children:
            if a.children and (not b.children or a.radius >= b.radius):
                pairs = [(c, b) for c in a.children]
            else:
                pairs = [(a, c) for c in b.children]
            stack += sorted(pairs, key=lambda p: most(*p))
            continue
        if q.exact and d.exact:
            scores = (q.points[a.rows] @ d.points[b.rows].T).astype(np.int64)
        else:
            scores = q.whole[a.rows] @ d.whole[b.rows].T
        floor = np.where(best.full[a.rows] == best.k, best.score[a.rows, -1], np.iinfo(np.int64).min)
        floor = np.maximum(floor, best.floor)
        good = (scores >= floor[:, None]) & (q.numbers[a.rows][:, None] != d.numbers[b.rows][None, :])
        x, y = np.nonzero(good)
        if len(x):
            best.add(a.rows[x], scores[x, y], d.ids[b.rows[y]])


def _blocks(rows: DataFrame, width: int, kind: str, pivots: np.ndarray, size: int) -> DataFrame:
    """Blocks of rows (id, number, vec): cell by nearest pivot, chunks of a cell by hash, one packed row per block."""

    def place(batches):
        for batch in batches:
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            gap = (pivots**2).sum(axis=1)[None, :] - 2 * flat @ pivots.T
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(gap.argmin(axis=1).astype(np.int32))], names=[*batch.schema.names, "cell"]
            )

    celled = staged(rows.mapInArrow(place, "id long, number long, vec array<long>, cell int"), "search-cells")
    chunks = {r["cell"]: -(-r["count"] // size) for r in celled.groupBy("cell").count().collect()}
    parts = F.create_map(*[F.lit(x) for kv in chunks.items() for x in kv]) if chunks else F.create_map(F.lit(0), F.lit(1))
    chunk = F.pmod(F.xxhash64("number"), parts[F.col("cell")])

    def pack(table: pa.Table) -> pa.Table:
        vectors = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        middle = vectors.mean(axis=0)
        radius = float(np.sqrt(((vectors - middle) ** 2).sum(axis=1).max()))
        ids, numbers = (table[c].to_numpy().astype("<i8") for c in ("id", "number"))
        return pa.table({
            "block": pa.array([int(table["cell"][0].as_py()) << 32 | int(table["chunk"][0].as_py())], pa.int64()),
            "n": pa.array([len(ids)], pa.int64()), "centre": pa.array([middle], pa.list_(pa.float64())), "radius": pa.array([radius]),
            "ids": pa.array([ids.tobytes()], pa.binary()), "numbers": pa.array([numbers.tobytes()], pa.binary()),
            "vectors": pa.array([vectors.astype(kind).tobytes()], pa.binary()),
        })

    schema = "block long, n long, centre array<double>, radius double, ids binary, numbers binary, vectors binary"
    return staged(celled.withColumn("chunk", chunk.cast("int")).groupBy("cell", "chunk").applyInArrow(pack, schema), "search-blocks")


def top_products(
    vectors: DataFrame, is_query: Column, id_: str = "vec_id", vec: str = "embedding", k: int = K, scale: int = SCALE,
    query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest integer products of every query row with all other rows."""
    clean = to_integers(vectors.filter(F.col(id_).isNotNull()), vec, scale)
    query = F.coalesce(is_query, F.lit(False)).alias("query")
    rows = staged(clean.select(F.col(id_).cast("long").alias("id"), F.monotonically_increasing_id().alias("number"), F.col(vec).alias("vec"), query), "search-rows")
    common = rows.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if common is None:
        return vectors.sparkSession.createDataFrame([], empty)
    width, others = common["width"], rows.count() - common["count"]
    if others:
        warnings.warn(f"{others} vectors of another length than {width} take no part", stacklevel=2)
    rows = rows.filter(F.size("vec") == width)
    n, largest = rows.agg(F.count("*"), F.max(F.array_max(F.transform("vec", lambda v: F.abs(v))))).first()
    kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if largest <= np.iinfo(t).max)
    sample = np.array([r["vec"] for r in rows.orderBy(F.xxhash64("id"), "number").limit(PIVOT_SAMPLE).select("vec").collect()], np.float64)
    pivots = sample[farthest_first(sample, min(max(n // data_block, 1), MAX_PIVOTS))[0]]
    data = _blocks(rows.select("id", "number", "vec"), width, kind, pivots, data_block)
    asked = _blocks(rows.filter("query").select("id", "number", "vec"), width, kind, pivots, query_block)
    dot = F.aggregate(F.zip_with("q.centre", "d.centre", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = lambda side: F.sqrt(F.aggregate(f"{side}.centre", F.lit(0.0), lambda s, x: s + x * x))
    top = dot + F.col("q.radius") * norm("d") + F.col("d.radius") * norm("q") + F.col("q.radius") * F.col("d.radius")
    # The query set in blocks against all rows in blocks: one line per block meets, not the rows.
    lines = lambda b, s: b.select("block", "centre", "radius").alias(s)
    pairs = staged(
        lines(asked, "q").join(lines(data, "d")).select(
            F.col("q.block").alias("qb"), F.col("d.block").alias("db"), dot.alias("near"), (top + F.abs(top) * 1e-9 + 1e-6).alias("top")
        ).withColumn("order", F.row_number().over(Window.partitionBy("qb").orderBy(F.desc("near"), "db"))),
        "search-pairs",
    )

    def visit(batches):
        held, best, block = None, None, None

        def result() -> pa.RecordBatch:
            row = np.repeat(np.arange(len(block.ids)), best.full)
            at = np.arange(k)[None, :] < best.full[:, None]
            columns = [np.full(len(row), held[0]), block.numbers[row], block.ids[row], best.id[at], best.score[at]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["qb", "number", "query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c not in ("ids", "numbers", "vectors")}
                load = lambda: Block(*(batch.column(c)[i].as_py() for c in ("ids", "numbers", "vectors")), width, kind)  # noqa: E731,B023
                if held != (r["qb"], r["lane"]):
                    if best is not None:
                        yield result()
                    # The query block stands before its data blocks.
                    held, block = (r["qb"], r["lane"]), load()
                    best = Best(len(block.ids), k, r["floor"])
                elif r["top"] >= best.worst(np.arange(len(block.ids))):
                    search(block, load(), best)
        if best is not None:
            yield result()

    def searched(chosen: DataFrame) -> DataFrame:
        """Results of pairs (qb, db, lane, top, floor); a query block and its data blocks come as one sorted stream per lane."""
        load = lambda b, on, role: b.select(F.col("block").alias(on), F.lit(role).alias("role"), "ids", "numbers", "vectors")
        heads = chosen.groupBy("qb", "lane").agg(F.max("top").alias("top"), F.max("floor").alias("floor"))
        columns = ["qb", "lane", "floor", "role", "top", "ids", "numbers", "vectors"]
        stream = heads.join(load(asked, "qb", 0), "qb").select(*columns).unionByName(chosen.join(load(data, "db", 1), "db").select(*columns))
        parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        stream = stream.repartition(parts, "qb", "lane").sortWithinPartitions("qb", "lane", "role", F.desc("top"))
        return stream.mapInArrow(visit, "qb long, number long, query_id long, vec_id long, score long")

    nothing = F.lit(np.iinfo(np.int64).min).cast("long")
    first = staged(searched(pairs.filter(F.col("order") <= FIRST_BLOCKS).select("qb", "db", "top", F.lit(0).alias("lane"), nothing.alias("floor"))), "search-first")
    kth = first.groupBy("qb", "number").agg(F.min("score").alias("score"), F.count("*").alias("n"))
    floors = kth.groupBy("qb").agg(F.min(F.when(F.col("n") == k, F.col("score"))).alias("score"), F.count("*").alias("n"), F.count_if(F.col("n") == k).alias("full"))
    size = asked.select(F.col("block").alias("qb"), F.col("n").alias("all"))
    floors = size.join(floors, "qb", "left").select("qb", F.when(F.col("full") == F.col("all"), F.col("score")).otherwise(nothing).alias("floor"))
    rest = pairs.filter(F.col("order") > FIRST_BLOCKS).join(floors, "qb").filter(F.col("top") >= F.col("floor"))
    rest = rest.select("qb", "db", "top", F.pmod(F.col("order"), F.lit(LANES)).cast("int").alias("lane"), "floor")
    found = first.unionByName(searched(rest))
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
