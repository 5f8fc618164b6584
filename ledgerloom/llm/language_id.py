"""Language ID by mixture inference: EM over letter-trigram likelihoods, language set by penalised likelihood.

Defined results: a text that is null or has no letter, or an empty model, gives `und`, score 0 and no mixture. Texts of
any length are read whole. Equal proportions go to the language whose name sorts first. Repeated rows get equal results;
rows are never joined, so repeated or missing ids do not matter. Columns named like a result are replaced by it.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import annotate, shielded, slices, texts_of
from ledgerloom.plans.shared import runs_in_tasks

runs_in_tasks(__name__)

BUCKETS = 1 << 15
# The model has 4 bytes for each language and bucket: at most this many languages keep it, and its broadcast, below 32 MB.
MAX_LANGUAGES = 256
SMOOTHING = 0.5
EM_ROUNDS = 12
# What a further language must gain: half a log of the sample size, times three because each letter is in three trigrams.
PENALTY = 1.5
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of the trigram around every letter; all that is no letter counts as one blank."""
    lowered = ["\n" if t is None else t.decode("utf-8", "replace").lower() + "\n" for t in texts]
    chars = np.frombuffer(("\n" + "".join(lowered)).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter = letter_table()[chars]
    kept = letter | np.r_[True, letter[:-1]]
    code = np.where(letter, chars, 0)[kept].astype(np.uint64)
    owner = np.r_[0, owner][kept]
    at = np.flatnonzero(code)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    after = np.r_[code[1:], np.uint64(0)]
    h = code[at - 1] * np.uint64(0x9E3779B97F4A7C15) + code[at] * np.uint64(0xC2B2AE3D27D4EB4F) + after[at] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return owner[at], (h >> np.uint64(64 - 15)).astype(np.int64)


@dataclass
class LanguageModel:
    """languages, sorted; log-likelihood of each bucket in each of them."""

    languages: list[str]
    table: np.ndarray


def train_language_model(labelled: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Count trigram buckets by language over all rows that have a language.

    Tasks count by themselves and hand on one row per language and bucket, so what is shuffled and what reaches the
    driver is bounded by languages x BUCKETS. More than MAX_LANGUAGES languages raise an error.
    """

    def count(batches):
        seen: dict[str, np.ndarray] = {}

        def flush():
            for name, n in seen.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])],
                    names=["lang", "bucket", "n"],
                )
            seen.clear()

        for batch in batches:
            for part in slices(batch):
                names = part.column("lang").to_pylist()
                owner, bucket = trigrams(texts_of(part))
                own = {name: i for i, name in enumerate(dict.fromkeys(names))}
                number = np.array([own[x] for x in names], np.int64)
                flat = np.bincount(number[owner] * BUCKETS + bucket, minlength=len(own) * BUCKETS)
                for name, i in own.items():
                    seen[name] = seen.get(name, 0) + flat[i * BUCKETS : (i + 1) * BUCKETS]
                if len(seen) > MAX_LANGUAGES:
                    yield from flush()
        yield from flush()

    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.limit(MAX_LANGUAGES * BUCKETS + 1).toArrow()
    languages = sorted(set(got["lang"].to_pylist()))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    n = np.zeros((BUCKETS, len(languages)))
    place = {name: i for i, name in enumerate(languages)}
    n[got["bucket"].to_numpy(), [place[x] for x in got["lang"].to_pylist()]] = got["n"].to_numpy()
    total = n.sum(axis=0)
    return LanguageModel(languages, np.log((n + SMOOTHING) / (total + SMOOTHING * BUCKETS)).astype(np.float32))


def infer_mixtures(owner: np.ndarray, bucket: np.ndarray, texts: int, model: LanguageModel) -> np.ndarray:
    """Proportions (texts x languages) of the language set with the best penalised likelihood; zeros without a letter.

    EM over all languages ranks them; then the sets of the 1, 2, ... best are fitted, and a text goes on to the next
    larger set for as long as that raises its penalised likelihood.
    """
    out = np.zeros((texts, len(model.languages)))
    if not len(owner) or not model.languages:
        return out
    key, n = np.unique(owner * BUCKETS + bucket, return_counts=True)
    doc, n = key // BUCKETS, n.astype(np.float32)
    present, start = np.unique(doc, return_index=True)
    row = np.repeat(np.arange(len(present)), np.diff(np.r_[start, len(doc)]))
    logs = model.table[key % BUCKETS]
    top = logs.max(axis=1, keepdims=True)
    like = np.exp(logs - top)
    total = np.add.reduceat(n, start)

    def fit(share: np.ndarray, use: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        """EM for the documents `use` from the shares given; a language of share 0 stays out."""
        picked = np.flatnonzero(use[row])
        number = np.cumsum(use) - 1
        r, c, q = number[row[picked]], n[picked], like[picked]
        begin, size = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]), total[use][:, None]
        share = share[use].astype(np.float32)
        for _ in range(rounds):
            w = q * share[r]
            w *= (c / np.maximum(w.sum(axis=1), 1e-30))[:, None]
            share = np.add.reduceat(w, begin) / size
        mix = np.log(np.maximum((q * share[r]).sum(axis=1), 1e-30)) * c
        return share, np.add.reduceat(mix.astype(np.float64), begin)

    every = np.ones(len(present), bool)
    k_all = len(model.languages)
    share, _ = fit(np.full((len(present), k_all), 1 / k_all), every)
    single = np.add.reduceat((logs - top).astype(np.float64) * n[:, None], start)
    best = np.zeros_like(share)
    best[np.arange(len(present)), single.argmax(axis=1)] = 1
    score = single.max(axis=1)
    rank = np.argsort(-share, axis=1, kind="stable")
    going = every.copy()
    for k in range(2, k_all + 1):
        allowed = np.zeros_like(share)
        np.put_along_axis(allowed, rank[:, :k], np.float32(1 / k), axis=1)
        fitted, found = fit(allowed, going)
        found = found - PENALTY * (k - 1) * np.log(np.maximum(total[going], 2))
        better = found > score[going]
        at = np.flatnonzero(going)[better]
        best[at], score[at] = fitted[better], found[better]
        going = np.zeros_like(going)
        going[at] = True
        if not len(at):
            break
    out[present] = best / best.sum(axis=1, keepdims=True)
    return out


def detect_languages(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred (the language of the largest share), score (that share) and mixture (all shares above 0)."""
    return shielded(docs, ["text"], lambda d, own: _detected(d, model, own), keep)


def _detected(docs: DataFrame, model: LanguageModel, keep: list[str] | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table))

    def infer(part: pa.RecordBatch) -> list[pa.Array]:
        known = LanguageModel(*shared.value)
        share = infer_mixtures(*trigrams(texts_of(part)), part.num_rows, known)
        none = share.sum(axis=1) == 0 if known.languages else np.ones(part.num_rows, bool)
        first = share.argmax(axis=1) if known.languages else np.zeros(part.num_rows, int)
        names = np.array([*known.languages, UNKNOWN], object)[np.where(none, len(known.languages), first)]
        score = np.zeros(part.num_rows) if not known.languages else np.clip(share.max(axis=1), 0, 1)
        mixture = [
            [{"lang": known.languages[j], "share": float(s[j])} for j in np.flatnonzero(s > 0)] for s in share
        ]
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        return [pa.array(names, pa.string()), pa.array(score), pa.array(mixture, kind)]

    fields = [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("mixture", T.ArrayType(T.StructType([
            T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))),
    ]
    return annotate(docs, infer, fields, keep)
