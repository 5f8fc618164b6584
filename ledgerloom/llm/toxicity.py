"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Terms are the words of the whole text (A-Z lowered) and the four-byte beginnings of longer words. The vocabulary is learnt
from all labelled rows: terms whose share of toxic documents is surely above the base rate. Document frequencies are
counted over all documents. Examples are a bounded sample of the labelled rows that hold a known term, MAX_EXAMPLES per
label by hash of the id, and count with the weight of the rows they stand for. A text without any known term (null and
empty ones too) gets the toxic rate of labelled rows like it.

Defined results: ties in similarity go to the smaller example id. Several labels of one document count as toxic if one of
them is; labels that are null or of no document are left out. Repeated rows get equal scores. Without labels of both kinds
every score is the base rate, 0 if there is none. Columns named like a result are replaced by it.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import WORD_BYTES, annotate, free_name, shielded, slices, texts_of
from ledgerloom.plans.shared import runs_in_tasks, staged

runs_in_tasks(__name__)

VOCABULARY = 4096
MAX_EXAMPLES = 4096
NEIGHBOURS = 25
INDEX_BLOCK = 64
# Standard deviations of the lower bound of a term's toxic share.
CERTAINTY = 4.0
# Labels are broadcast, 12 bytes each, up to this many; beyond, documents and labels are shuffled on the id.
BROADCAST_LABELS = 2_000_000
# Weight of the base rate among the votes.
PRIOR_WEIGHT = 0.5
TASK_TERMS = 300_000


def terms(text: bytes | None) -> dict[bytes, int]:
    """How often each term occurs."""
    out: dict[bytes, int] = {}
    for word in (text or b"").translate(WORD_BYTES).split():
        out[word] = out.get(word, 0) + 1
    for word, n in list(out.items()):
        if len(word) > 4:
            start = word[:4] + b"*"
            out[start] = out.get(start, 0) + n
    return out


def learn_vocabulary(labelled: DataFrame, size: int = VOCABULARY) -> tuple[list[bytes], float]:
    """The terms that mark toxic rows of `labelled` (text, toxic 0/1), best first, and the toxic rate of all its rows.

    Tasks count by themselves, TASK_TERMS terms at a time; the driver gets `size` terms.
    """

    def count(batches):
        seen: dict[bytes, list[int]] = {}
        for batch in batches:
            for part in slices(batch):
                for text, toxic in zip(texts_of(part), part.column("toxic").to_pylist()):
                    for term in terms(text):
                        seen.setdefault(term, [0, 0])[toxic] += 1
                if len(seen) > TASK_TERMS:
                    yield counts(seen)
                    seen = {}
        if seen:
            yield counts(seen)

    def counts(seen):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), *(pa.array([n[k] for n in seen.values()], pa.int64()) for k in (0, 1))],
            names=["term", "n0", "n1"],
        )

    rate, rows = labelled.agg(F.avg("toxic"), F.count("*")).first()
    if not rate or rate == 1:
        return [], float(rate or 0)
    counted = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(count, "term binary, n0 long, n1 long")
    total = counted.groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter("n1 > 2")
    # Wilson's lower bound of the toxic share.
    n, p, z = F.col("n0") + F.col("n1"), F.col("n1") / (F.col("n0") + F.col("n1")), CERTAINTY
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    sure = total.withColumn("low", low).filter(F.col("low") > min(2 * rate, (1 + rate) / 2))
    best = sure.orderBy(F.desc("low"), "term").limit(size).select("term").collect()
    return [bytes(r["term"]) for r in best], float(rate)


def add_vectors(docs: DataFrame, vocabulary: list[bytes], keep: list[str] | None = None) -> DataFrame:
    """Add ids and counts, the known terms of each text and how often they occur, by term number."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(part: pa.RecordBatch) -> list[pa.Array]:
        known = shared.value
        ids, counts = [], []
        for text in texts_of(part):
            found = sorted((known[t], n) for t, n in terms(text).items() if t in known)
            ids.append([i for i, _ in found])
            counts.append([n for _, n in found])
        return [pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]

    kind = T.ArrayType(T.IntegerType())
    return annotate(docs, run, [T.StructField("ids", kind), T.StructField("counts", kind)], keep)


def weigh(ids: list[int], counts: list[int], idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of a vector, of length one."""
    w = (1 + np.log(np.asarray(counts, float))) * idf[np.asarray(ids, int)]
    return w / np.sqrt((w * w).sum())


@dataclass
class Example:
    doc_id: int
    toxic: int
    ids: list[int]
    counts: list[int]


class BlockMaxIndex:
    """Examples by rising id in blocks; per term its postings by block and the largest weight it has in each."""

    def __init__(self, examples: list[Example], idf: np.ndarray, block: int = INDEX_BLOCK) -> None:
        self.examples = sorted(examples, key=lambda e: e.doc_id)
        self.idf, self.block = idf, block
        self.blocks = -(-len(examples) // block)
        posts: dict[int, dict[int, list[tuple[int, float]]]] = {}
        for n, e in enumerate(self.examples):
            for t, w in zip(e.ids, weigh(e.ids, e.counts, idf)):
                posts.setdefault(t, {}).setdefault(n // block, []).append((n % block, w))
        self.posts = {
            t: {b: (np.array([p for p, _ in own]), np.array([w for _, w in own])) for b, own in by.items()} for t, by in posts.items()
        }
        self.tops = {t: (np.array(list(by)), np.array([w.max() for _, w in by.values()])) for t, by in self.posts.items()}

    def nearest(self, ids: list[int], counts: list[int], k: int) -> list[tuple[float, int]]:
        """(cosine, example number) of the k nearest with a term in common, exactly; ties to the smaller number."""
        query = weigh(ids, counts, self.idf)
        bound = np.zeros(self.blocks)
        for t, q in zip(ids, query):
            if t in self.tops:
                at, top = self.tops[t]
                bound[at] += q * top
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(best) == k and bound[b] < -best[-1][0] - 1e-9:
                break
            score = np.zeros(self.block)
            for t, q in zip(ids, query):
                own = self.posts.get(t, {}).get(b)
                if own is not None:
                    score[own[0]] += q * own[1]
            # Rounded, so that equal vectors tie whatever the order of their terms.
            score = np.round(score, 9)
            worst = -best[-1][0] if len(best) == k else 0.0
            found = np.flatnonzero(score >= worst) if worst else np.flatnonzero(score > 0)
            best = sorted([*best, *((-score[j], b * self.block + j) for j in found.tolist())])[:k]
        return [(-s, n) for s, n in best]


@dataclass
class ToxicityModel:
    vocabulary: list[bytes]
    idf: np.ndarray
    examples: list[Example]
    weights: dict[int, float]
    rate: float
    empty_rate: float

    def score(self, index: BlockMaxIndex, ids: list[int], counts: list[int], k: int = NEIGHBOURS) -> tuple[float, list[tuple[int, float, int]]]:
        near = index.nearest(ids, counts, k) if ids else []
        if not near:
            return self.empty_rate, []
        votes = [(s * s * self.weights[index.examples[n].toxic], index.examples[n].toxic) for s, n in near]
        for_, all_ = sum(v for v, y in votes if y), sum(v for v, _ in votes)
        score = (for_ + PRIOR_WEIGHT * self.rate) / (all_ + PRIOR_WEIGHT)
        return min(1.0, max(0.0, score)), [(index.examples[n].doc_id, float(s), index.examples[n].toxic) for s, n in near]


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of `docs` that have a label, with toxic 0/1."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("_labelled")).agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("toxic")
    )
    if labels.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    return docs.drop("toxic").join(known, F.col("doc_id") == F.col("_labelled")).drop("_labelled")


def score_toxicity(
    docs: DataFrame, labels: DataFrame, learn_from, k: int = NEIGHBOURS, max_examples: int = MAX_EXAMPLES, keep: list[str] | None = None
) -> DataFrame:
    """Add score (0 to 1) and evidence (example id, similarity and label of the nearest) to every row of `docs`.

    `learn_from` is the condition on rows of `docs` whose labels may be learnt. Texts are read twice: the labelled ones for
    the vocabulary, all for their vectors; only vectors, a few numbers per document, are written and read again.
    """
    mark = free_name(docs, "learnt")
    marked = docs.withColumn(mark, F.coalesce(learn_from, F.lit(False)))
    kept = None if keep is None else list(dict.fromkeys([*keep, "doc_id"]))
    return shielded(marked, ["doc_id", "text", mark], lambda d, own: _scored(d, labels, mark, k, max_examples, own), kept).drop(mark)


def _scored(docs: DataFrame, labels: DataFrame, learn_from: str, k: int, max_examples: int, keep: list[str] | None) -> DataFrame:
    lean = docs.filter(learn_from).select("doc_id", "text")
    vocabulary, rate = learn_vocabulary(with_labels(lean, labels))
    kept = None if keep is None else [*keep, learn_from]
    vectors = staged(add_vectors(docs, vocabulary, kept), "toxicity-vectors")
    rows = vectors.count()
    frequency = np.zeros(len(vocabulary))
    for r in vectors.select(F.explode("ids").alias("t")).groupBy("t").count().collect():
        frequency[r["t"]] = r["count"]
    idf = np.log((rows + 1) / (frequency + 1)) + 1
    learnt = with_labels(vectors.filter(learn_from).select("doc_id", "ids", "counts"), labels)
    empty, examples, weights = rate, [], {}
    for r in learnt.groupBy("toxic").agg(F.count_if(F.size("ids") > 0).alias("full"), F.count_if(F.size("ids") == 0).alias("empty")).collect():
        picked = learnt.filter((F.col("toxic") == r["toxic"]) & (F.size("ids") > 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
        own = [Example(x["doc_id"], r["toxic"], list(x["ids"]), list(x["counts"])) for x in picked.collect()]
        examples += own
        weights[r["toxic"]] = r["full"] / max(len(own), 1)
        weights[f"empty{r['toxic']}"] = r["empty"]
    none = [weights.pop("empty0", 0), weights.pop("empty1", 0)]
    if sum(none):
        empty = (none[1] + rate) / (sum(none) + 1)
    model = ToxicityModel(vocabulary, idf, examples, weights, rate, float(empty))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    returned = [c for c in vectors.columns if c not in ("ids", "counts")]
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))

    def run(batches):
        known = shared.value
        index = BlockMaxIndex(known.examples, known.idf)
        met: dict[tuple, tuple] = {}
        for batch in batches:
            scores, evidence = [], []
            for ids, counts in zip(batch.column("ids").to_pylist(), batch.column("counts").to_pylist()):
                key = (tuple(ids), tuple(counts))
                if key not in met:
                    if len(met) > 50_000:
                        met.clear()
                    met[key] = known.score(index, ids, counts, k)
                scores.append(met[key][0])
                evidence.append([{"doc_id": d, "similarity": s, "toxic": y} for d, s, y in met[key][1]])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in returned), pa.array(scores, pa.float64()), pa.array(evidence, kind)], names=[*returned, "score", "evidence"]
            )

    schema = T.StructType([vectors.schema[c] for c in returned] + [
        T.StructField("score", T.DoubleType()),
        T.StructField("evidence", T.ArrayType(T.StructType([
            T.StructField("doc_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("toxic", T.IntegerType())]))),
    ])
    # Vectors are small and fill few files, but each is searched for: they are dealt to all tasks evenly.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return vectors.repartition(parts).mapInArrow(run, schema)

