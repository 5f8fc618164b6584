"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

`RULES` says which share of which measure is allowed. `quality` measures every whole text (lengths, symbols, stop words, lines,
repeated words) and compares the measures with the table, in whole numbers. There is no shuffle, no join, no user function, and no row is
dropped.

Repeated words: all windows of a text are hashed to 64 bits, of which the low ones are replaced by the window's place; sorted, equal
windows stand side by side. Windows with such a neighbour, and only these, are compared word by word, so that the count is exact. State
is a few numbers per word of the one text a task is at.

Defined results: a null text has no words, no lines and is not kept; the same for an empty one. Words are separated by space, tab, line
feed, vertical tab, form feed and carriage return; lines by line feeds. Invalid UTF-8 is read as the JVM decodes it. Every row is
judged on its own, so that repeated rows get the same verdict. Columns of the caller are kept unless they bear the name of a result.
"""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import free_name, without

# Words of a window in which repeated words are looked for.
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30

# Frequent words of the four languages that the corpus has; fixed values.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by", "this", "are", "at", "from",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "nicht", "dem", "ein", "eine", "als",
    "de", "la", "le", "et", "les", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "pas", "avec",
    "el", "y", "los", "se", "del", "las", "por", "con", "no", "una", "su", "para", "es", "al", "lo",
)
SYMBOLS = "[#*$%&|<>]"


class Rule(NamedTuple):
    """100 x measure must be from `least` x base to `most` x base."""

    name: str
    measure: str
    base: str
    least: int | None = None
    most: int | None = None


BASE_RULES = (
    Rule("few_words", "n_words", "one", least=100 * LEAST_WORDS),
    Rule("repeated_words", "n_repeat_words", "n_words", most=MOST_REPEATED),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", least=200, most=1200),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("stop_words", "n_stop_words", "n_words", least=2),
    Rule("equal_lines", "n_dup_lines", "n_lines", most=30),
    Rule("cut_lines", "n_cut_lines", "n_lines", most=30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=90),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_cut_lines", "n_bullet_lines", "n_repeat_words")
RESULT = (*MEASURES, "base_failed", "failed", "kept")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` over a value that is computed once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def equal_neighbour(items: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Items of a sorted array that equal the one before or the one behind."""
    met = lambda x, y: F.coalesce(same(x, y), F.lit(False))
    return F.filter(items, lambda x, i: met(x, F.get(items, i - 1)) | met(x, F.get(items, i + 1)))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in windows found twice or more in the text, the first of them included."""

    def in_windows(words: Column, hashes: Column) -> Column:
        n = F.size(words) - (window - 1)
        # The lowest bits, as many as the number of windows has, hold the place.
        places = (F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n))) - 1).cast("long")

        def marked(low: Column) -> Column:
            window_hash = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)])
            return F.transform(F.sequence(F.lit(0), n - 1), lambda i: window_hash(i).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))

        def count(low: Column) -> Column:
            high = lambda x: x.bitwiseAND(F.bitwise_not(low))
            return bind(
                F.sort_array(marked(low)),
                lambda keys: bind(
                    F.sort_array(F.transform(
                        equal_neighbour(keys, lambda x, y: high(x) == high(y)),
                        lambda x: F.struct(F.slice(words, x.bitwiseAND(low).cast("int") + 1, F.lit(window)).alias("w"), x.bitwiseAND(low).alias("at")),
                    )),
                    lambda likely: bind(
                        F.sort_array(F.transform(equal_neighbour(likely, lambda x, y: x["w"] == y["w"]), lambda x: x["at"])),
                        covered,
                    ),
                ),
            )

        def covered(starts: Column) -> Column:
            new = F.transform(starts, lambda x, i: F.least(F.lit(window).cast("long"), F.coalesce(F.get(starts, i + 1) - x, F.lit(window).cast("long"))))
            return F.aggregate(new, F.lit(0).cast("long"), lambda total, x: total + x)

        return F.when(n < 2, F.lit(0).cast("long")).otherwise(bind(places, count))

    return bind(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: in_windows(words, hashes))


def measures(text: Column) -> Column:
    """All measures of a text, as a struct of longs."""

    def of_words(text: Column, words: Column, lines: Column) -> Column:
        count = lambda c: c.cast("long")
        ending = lambda line: F.rtrim(F.regexp_replace(line, r"[\x09-\x0D]+", " "))
        return F.struct(
            count(F.size(words)).alias("n_words"),
            count(F.length(F.array_join(words, ""))).alias("word_chars"),
            count(F.regexp_count(text, F.lit(SYMBOLS))).alias("n_symbols"),
            count(F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS)))).alias("n_stop_words"),
            count(F.size(lines)).alias("n_lines"),
            count(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            count(F.size(F.filter(lines, lambda x: ending(x).endswith("...") | ending(x).endswith("…")))).alias("n_cut_lines"),
            count(F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]")))).alias("n_bullet_lines"),
            repeated_words(words).alias("n_repeat_words"),
        )

    with_word = lambda text: F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return bind(
        F.coalesce(text, F.lit("")),
        lambda text: bind(words_of(text), lambda words: bind(with_word(text), lambda lines: of_words(text, words, lines))),
    )


def holds(rule: Rule, measured: Column) -> Column:
    value = lambda name: F.lit(1).cast("long") if name == "one" else measured[name]
    least = [value(rule.measure) * 100 >= value(rule.base) * rule.least] if rule.least is not None else []
    most = [value(rule.measure) * 100 <= value(rule.base) * rule.most] if rule.most is not None else []
    ok = F.lit(True)
    for one in least + most:
        ok = ok & one
    return ok


def quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Every row with its measures, the names of the rules it breaks, whether a base rule is among them, and whether it is kept."""
    rest = [F.col(f"`{c}`") for c in without(docs, *RESULT).columns]
    name = free_name(docs, "measured")
    measured = F.col(name)
    failed = F.array_compact(F.array(*[F.when(~holds(rule, measured), F.lit(rule.name)) for rule in (*base, *rules)]))
    base_failed = F.arrays_overlap(failed, F.array(*[F.lit(rule.name) for rule in base]))
    return docs.select(*rest, measures(F.col(text)).alias(name)).select(
        *rest, *[measured[m].alias(m) for m in MEASURES],
        base_failed.alias("base_failed"), failed.alias("failed"), (F.size(failed) == 0).alias("kept"),
    )
