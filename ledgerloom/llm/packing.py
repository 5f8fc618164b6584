"""Best-fit packing by a grouping genetic algorithm on islands with elite migration.

Documents become pieces of at most `capacity` tokens. Full pieces are sequences of their own; the others are dealt at
random into lots of bounded size. Each lot is evolved on several islands, every island in a task of its own: crossover
injects whole well-filled bins of one parent into another, takes out the bins that held the same documents, and
best-fits what that displaced. After each epoch the best packing of an island moves to the next one of its lot; the
best of all islands is the lot's packing. An island that needs no more bins than any packing must stops.

Defined results: a null text is an empty document, which is one piece holding only the closing id. Repeated rows and rows
without id are packed each for itself. An empty table gives no rows. Very long texts are encoded whole and cut. Only the
columns named in the result come back.
"""

import os
import string
import unicodedata
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER_BYTES, slices, texts_of
from ledgerloom.plans.shared import runs_in_tasks, staged

runs_in_tasks(__name__)

CAPACITY = 2048
CLOSING_ID = 0
# Pieces that evolve together. A lot may end with one bin that another lot could have filled.
LOT = 16_384
ISLANDS = 3
POPULATION = 4
EPOCHS = 3
GENERATIONS = 8
# Words whose ids a task remembers, about 200 bytes each.
REMEMBERED_WORDS = 500_000


# Marks that end a word; behind a letter the tokenizer always starts a new token with them.
CLOSING_MARKS = string.punctuation.replace("'", "")
BLANKS = b" \t\n\r\x0b\x0c"
# The tokenizer marks the last token of a word so.
WORD_END = "</w>"
JOINED_WORDS = 500

# Kinds of bytes. Apostrophes and the bars of special tokens are cut off from nothing, nor are non-ASCII characters; marks
# that can change the letter before them when texts are normalised start with a byte from 0xCC on.
BLANK, WORD, CAPITAL, MARK, MAY_COMBINE, OTHER = range(6)


def _kind(c: int) -> int:
    if c in BLANKS:
        return BLANK
    if 65 <= c <= 90:
        return CAPITAL
    if c < 128 and chr(c).isalnum():
        return WORD
    if chr(c) in CLOSING_MARKS and chr(c) != "|":
        return MARK
    return MAY_COMBINE if c >= 0xCC else OTHER


# What two kinds in a row, as 8 times the first plus the second, mean: a unit starts with the second, a word ends with the
# first, or the first stays a capital.
STARTS, ENDS, STAYS = 1, 2, 3
KINDS = bytes(map(_kind, range(256)))
PAIRS = bytes(
    STARTS if (a == BLANK and b != BLANK) or (a in (WORD, CAPITAL) and b == MARK) or (a == MARK and b in (WORD, CAPITAL))
    else ENDS if a != BLANK and b == BLANK
    else STAYS if (a, b) == (CAPITAL, MAY_COMBINE) else 0
    for a, b in (divmod(pair, 8) for pair in range(256))
)


def units(texts: list[bytes], special: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The units of texts, which the tokenizer treats one by one: words between ASCII blanks, cut where an ASCII letter or digit
    meets a closing mark, A-Z lower-cased unless what follows may combine with it. Also the number of units ahead of each text and of its end."""
    joined = b" ".join([b"", *texts, b""])
    kinds = np.frombuffer(joined.translate(KINDS), np.uint8)
    pairs = ((kinds[:-1] << 3) | kinds[1:]).tobytes().translate(PAIRS)
    meaning = np.frombuffer(pairs, np.uint8)
    edges = np.flatnonzero((meaning == STARTS) | (meaning == ENDS)) + 1
    starting = meaning[edges - 1] == STARTS
    starts = edges[starting]
    lowered = bytearray(joined.translate(LOWER_BYTES))
    if bytes([STAYS]) in pairs:
        stays = np.flatnonzero(meaning == STAYS)
        np.frombuffer(lowered, np.uint8)[stays] = np.frombuffer(joined, np.uint8)[stays]
    if any(lowered.count(s) > joined.count(s) for s in special):  # special tokens have a case
        lowered = joined
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.diff(edges)[starting[:-1]], out=offsets[1:])
    data = bytes(lowered.translate(None, BLANKS))
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), np.searchsorted(starts, begins)


class Encoder:
    """Ids of a text, as little-endian 32-bit numbers. Texts are cut into units that the tokenizer treats one by one, the
    different units of many texts are looked up if they were met before, and their ids are strung together by Arrow. New units
    that are all letters, but for closing marks, are encoded many at a time and told apart by the tokens that end a word."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model without what does nothing to words that are all letters: special tokens, runs of blanks, splitting;
        # for the letters a-z nothing but the model is left.
        blanks = pre_tokenizers.WhitespaceSplit()
        self.ascii_speller, self.speller = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.ascii_speller.pre_tokenizer = blanks
        self.speller.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.speller.pre_tokenizer = pre_tokenizers.Sequence([blanks, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.special = [token.content.encode() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.letters: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spell(self, words: list[str], speller) -> list[bytes]:
        """Ids of words that are all letters."""
        groups, found = [words[k : k + JOINED_WORDS] for k in range(0, len(words), JOINED_WORDS)], []
        for group, e in zip(groups, speller.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(cuts) == len(group):
                packed, cuts = ids.tobytes(), [0, *cuts.tolist()]
                found += [packed[a:b] for a, b in zip(cuts, cuts[1:])]
            else:
                found += [own.tobytes() for own in self._encode(group)]
        return found

    def _learn(self, new: list[bytes]) -> None:
        plain, mixed = [w for w in new if w.isalpha()], [w for w in new if not w.isalpha()]
        self.known.update(zip(plain, self._spell(b" ".join(plain).lower().decode().split(), self.ascii_speller)))
        words = b" ".join(mixed).decode("utf-8", "replace").split(" ") if mixed else []
        cores = [word.rstrip(CLOSING_MARKS) for word in words]
        # Some letters become a letter and a mark when they are normalised.
        forms = unicodedata.normalize("NFC", " ".join(cores)).lower().split(" ")
        split, others = [], []
        for raw, word, core, form in zip(mixed, words, cores, forms):
            if form.isalpha():
                split.append((raw, core, word[len(core) :]))
            else:
                others.append((raw, word))
        letters = self.letters
        unmet = list(dict.fromkeys(core for _, core, _ in split if core not in letters))
        letters.update(zip(unmet, self._spell(unmet, self.speller)))
        wholes = list({*(word for _, word in others), *(tail for _, _, tail in split)})
        found = {w: ids.tobytes() for w, ids in zip(wholes, self._encode(wholes))}
        self.known.update((raw, found[word]) for raw, word in others)
        self.known.update((raw, letters[core] + found[tail]) for raw, core, tail in split)

    def encode_texts(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > REMEMBERED_WORDS:
            # Frequent words are met first, and most of the others only once.
            self.known, self.letters = (dict(islice(d.items(), REMEMBERED_WORDS // 2)) for d in (self.known, self.letters))
        found, bounds = units(texts, self.special)
        found = found.dictionary_encode()
        different = pa.ListArray.from_arrays([0, len(found.dictionary)], found.dictionary.cast(pa.binary()))
        different = pc.binary_join(different, pa.scalar(b" ", pa.binary()))[0].as_py().split(b" ") if len(found) else []
        own = list(map(self.known.get, different))
        new = [w for w, ids in zip(different, own) if ids is None]
        for k in range(0, len(new), 20_000):
            self._learn(new[k : k + 20_000])
        own = [self.known[w] if ids is None else ids for w, ids in zip(different, own)] if new else own
        if not own:
            return [b""] * len(texts)
        _, offsets, data = pa.array(own, pa.large_binary()).take(found.indices).buffers()
        data, cuts = memoryview(data), np.frombuffer(offsets, np.int64)[bounds].tolist()
        return [data[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[list[bytes]]) -> list[bytes]:
        """Ids of texts given as lists of words."""
        return self.encode_texts([b" ".join(words) for words in texts])


def encode_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    close = np.array([CLOSING_ID], "<u4").tobytes()

    def run(batches):
        encoder = Encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, limit=2_000_000):
                rows = ([], [], [], [], [], [])
                encoded = encoder.encode_texts([t or b"" for t in texts_of(part)])
                for i, ids in enumerate(encoded):
                    ids += close
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        for column, value in zip(rows, (i, piece, at // 4, len(own) // 4, zlib.crc32(own), np.frombuffer(own, "<u4").astype(np.int32) if with_ids else None)):
                            column.append(value)
                out = [part.column("doc_id").take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:5])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(rows[5], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = ", ids array<int>" if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{ids}")


def best_fit(sizes: list[int], order: list[int], bins: list[int], room: list[int], capacity: int) -> None:
    """Put the items in `order` each into the fullest bin that takes it; writes bins (by item) and room (by bin)."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, r in enumerate(room):
        if r:
            free[r].append(b)
            mask |= 1 << r
    for i in order:
        size = sizes[i]
        above = mask >> size
        if above:
            r = size + (above & -above).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                mask &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i] = b
        r -= size
        room[b] = r
        if r:
            free[r].append(b)
            mask |= 1 << r


def first_packing(sizes: np.ndarray, capacity: int, rng: np.random.Generator | None) -> np.ndarray:
    """Best fit of the items by falling size; with `rng`, of sizes disturbed by up to a fifth."""
    key = sizes * (rng.uniform(0.8, 1.0, len(sizes)) if rng else 1)
    bins = [0] * len(sizes)
    best_fit(sizes.tolist(), np.argsort(-key, kind="stable").tolist(), bins, [], capacity)
    return np.array(bins, np.int32)


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """More is better: first fewer bins, then bins filled more unevenly."""
    fill = np.bincount(bins, sizes)
    fill = fill[fill > 0]
    return -len(fill), float(np.mean((fill / capacity) ** 2)) if len(fill) else 0.0


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Some well-filled bins of `b` go whole into `a`; what their arrival displaces is put back by best fit."""
    fill_b = np.bincount(b, sizes)
    used = np.flatnonzero(fill_b)
    good = used[fill_b[used] >= np.median(fill_b[used])]
    chosen = rng.choice(good, max(1, len(good) // 8), replace=False)
    injected = np.isin(b, chosen)
    fill_a = np.bincount(a, sizes)
    broken = np.zeros(len(fill_a), bool)
    broken[a[injected]] = True
    # The emptiest bins are dissolved too, or nothing could fill the gaps.
    whole = np.flatnonzero((fill_a > 0) & ~broken)
    broken[whole[np.argsort(fill_a[whole])[: max(1, len(whole) // 50)]]] = True
    child = np.full(len(a), -1, np.int64)
    stay = ~broken[a] & ~injected
    kept, child[stay] = np.unique(a[stay], return_inverse=True)
    _, new = np.unique(b[injected], return_inverse=True)
    child[injected] = len(kept) + new
    room = (capacity - np.bincount(child[child >= 0], sizes[child >= 0])).astype(int).tolist()
    loose = np.flatnonzero(child < 0)
    bins = child.tolist()
    best_fit(sizes.tolist(), loose[np.argsort(-sizes[loose], kind="stable")].tolist(), bins, room, capacity)
    return np.array(bins, np.int32)


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, seed: int, generations: int = GENERATIONS) -> list[np.ndarray]:
    """The population after some generations, best first; starts one if it is empty."""
    rng = np.random.default_rng(seed)
    # No two pieces of more than half a sequence share one.
    bound = max(-(-int(sizes.sum()) // capacity), int((sizes * 2 > capacity).sum()))
    if not population:
        population = [first_packing(sizes, capacity, None)]
        if -fitness(population[0], sizes, capacity)[0] > bound:
            population += [first_packing(sizes, capacity, rng) for _ in range(POPULATION - 1)]
    value = lambda p: fitness(p, sizes, capacity)
    population = sorted(population, key=value, reverse=True)
    for _ in range(generations):
        if -value(population[0])[0] <= bound or len(population) < 2:
            break
        i, j = rng.choice(len(population), 2, replace=False)
        population.append(crossover(population[i], population[j], sizes, capacity, rng))
        population = sorted(population, key=value, reverse=True)[:POPULATION]
    return population


def _state(rows: list[tuple[int, int, np.ndarray, list[np.ndarray]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
            pa.array([r[2] for r in rows], pa.list_(pa.int64())),
            pa.array([[p.astype("<i4").tobytes() for p in r[3]] for r in rows], pa.list_(pa.binary())),
        ],
        names=["lot", "island", "sizes", "population"],
    )


def _islands(batch):
    for lot, island, sizes, population in zip(
        *(batch.column(c).to_pylist() for c in ("lot", "island")), batch.column("sizes"), batch.column("population").to_pylist()
    ):
        yield lot, island, sizes.values.to_numpy(), [np.frombuffer(p, "<i4") for p in population]


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, lot_size: int = LOT, seed: int = 7, epochs: int = EPOCHS) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32), which must be a table in files.

    A task holds the pieces of one lot; what is shuffled is a few dozen bytes per piece.
    """
    numbered = pieces.withColumn("_number", F.monotonically_increasing_id())
    own = [c for c in pieces.columns]
    full = numbered.filter(F.col("length") == capacity).select(*own, (-F.col("_number") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = numbered.filter(F.col("length") < capacity)
    lots = int(pieces.filter(F.col("length") < capacity).count() // lot_size) + 1
    lot = F.pmod(F.xxhash64(F.lit(seed), "_number"), F.lit(lots))
    held = staged(short.groupBy(lot.alias("lot")).agg(F.collect_list(F.struct(*own)).alias("items")), "packing-lots")
    kind = "lot long, island int, sizes array<long>, population array<binary>"
    islands = held.select(
        "lot", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("items.length").alias("sizes"),
        F.array().cast("array<binary>").alias("population"),
    )

    def grow(epoch):
        def run(batches):
            for batch in batches:
                for number, island, sizes, population in _islands(batch):
                    start = (seed * 1_000_003 + number) * 101 + island * 11 + epoch
                    yield _state([(number, island, sizes, evolve(sizes, population, capacity, start))])

        return run

    def migrate(table: pa.Table) -> pa.Table:
        rows = sorted((r for batch in table.to_batches() for r in _islands(batch)), key=lambda r: r[1])
        elites = [r[3][0] for r in rows]
        moved = [(n, i, s, [elites[k - 1], *p[: POPULATION - 1]]) for k, (n, i, s, p) in enumerate(rows)]
        return pa.Table.from_batches([_state(moved)])

    def choose(table: pa.Table) -> pa.Table:
        rows = [r for batch in table.to_batches() for r in _islands(batch)]
        number, _, sizes, _ = rows[0]
        best = max((p for r in rows for p in r[3]), key=lambda p: fitness(p, sizes, capacity))
        order = np.argsort(best, kind="stable")
        ends = np.cumsum(sizes[order])
        begins = ends - sizes[order]
        first = np.r_[True, best[order][1:] != best[order][:-1]]
        offset = np.empty(len(best), np.int64)
        offset[order] = begins - np.maximum.accumulate(np.where(first, begins, 0))
        return pa.table({"lot": pa.array([number], pa.int64()), "bins": pa.array([best.astype(np.int64)], pa.list_(pa.int64())), "offsets": pa.array([offset], pa.list_(pa.int64()))})

    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for epoch in range(epochs):
        islands = islands.repartition(parts, "lot", "island").mapInArrow(grow(epoch), kind)
        if epoch < epochs - 1:
            islands = islands.groupBy("lot").applyInArrow(migrate, kind)
    packed = islands.groupBy("lot").applyInArrow(choose, "lot long, bins array<long>, offsets array<long>")
    placed = held.join(packed, "lot").select("lot", F.explode(F.arrays_zip("items", "bins", "offsets")).alias("p"))
    rows = placed.select(
        *[F.col("p.items")[c].alias(c) for c in own], F.shiftleft("lot", 32).bitwiseOR(F.col("p.bins")).alias("sequence_id"), F.col("p.offsets").alias("offset")
    )
    return rows.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Encode, cut and pack: a row per piece with its sequence and its place there."""
    return pack_pieces(staged(encode_pieces(docs, tokenizer, capacity), "packing-pieces"), capacity)


