"""What the operators share: reading tables, running a function over slices of texts, connected components."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.plans.shared import cut_lineage, runs_in_tasks

runs_in_tasks(__name__)

# Bytes of text worked on at once inside a task; one longer text forms a slice of its own.
SLICE_BYTES = 4_000_000
# Stands for a missing id wherever ids are compared: the largest id there is.
NO_ID = 2**63 - 1

# Byte classes: letters A-Z become a-z, ASCII letters, digits and all bytes of non-ASCII characters stay, others separate.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 over 4; a missing id is not held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that an operator is about to add; column names differ at least in more than case."""
    lowered = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in lowered])


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that `df` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shielded(
    docs: DataFrame, inputs: list[str], work: Callable[[DataFrame, list[str] | None], DataFrame], keep: list[str] | None = None
) -> DataFrame:
    """Apply `work` to `docs` while all columns but `inputs` bear names that no operator uses; `keep` names columns as the caller does.

    Afterwards they have their own names again, except those that bear the name of a result, which replaces them.
    """
    away = {c: f"_caller_{i}_" for i, c in enumerate(docs.columns) if c not in inputs}
    done = work(docs.select(*[F.col(f"`{c}`").alias(away.get(c, c)) for c in docs.columns]), None if keep is None else [away.get(c, c) for c in keep])
    results = [c for c in done.columns if c not in inputs and c not in away.values()]
    replaced = {c.lower() for c in results}
    back = [
        F.col(away.get(c, c)).alias(c) for c in docs.columns
        if away.get(c, c) in done.columns and (keep is None or c in keep) and (c in inputs or c.lower() not in replaced)
    ]
    return done.select(*back, *results)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice together have about `limit` bytes."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size.astype(np.int64)) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def annotate(
    docs: DataFrame,
    fn: Callable[[pa.RecordBatch], list[pa.Array]],
    fields: list[T.StructField],
    keep: list[str] | None = None,
    text: str = "text",
) -> DataFrame:
    """Add columns computed from each row by `fn`, which gets a slice of rows and returns one array per field.

    Only `keep` (all columns if None) goes back from Python. Existing columns of the new names are replaced. No shuffle.
    """
    kept = [c for c in without(docs, *[f.name for f in fields]).columns if keep is None or c in keep]
    schema = T.StructType([docs.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), *fn(part)], names=[*kept, *(f.name for f in fields)]
                )

    return docs.mapInArrow(run, schema)


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges that connect every node of a bounded edge list to the smallest node of its component."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); component is the smallest node reachable.

    Alternates the large-star and small-star steps: every round is two aggregates and two equi-joins, rounds grow with
    the logarithm of the longest chain, and the edge list never gets longer than it was. Each round is checkpointed in
    the shared folder. A node with very many edges is summed map-side and its join is split by AQE.
    """
    edges = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("n")).select("a", F.least("a", "n").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.a", "e.b").filter("a <> b").distinct()
        new = cut_lineage(small)
        digest = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if digest(new) == digest(edges):
            break
        edges = new
    roots = new.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return new.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
