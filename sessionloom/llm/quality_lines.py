"""Line-first cleaning: judge every line, drop the failures, then judge what the document lost.

A line fails as *navigation* (separators between short items), as *noise* (many symbol
characters or shouted words with doubled marks), as *boilerplate* (licence, cookie, script and
sign-up phrases) or as a *repeat* of an earlier line of its document. Lines of ``SHORT_LINE`` words
or more that end in no closing punctuation fail as *punctuation*, unless they are the last line, which
may be cut. Lines without a word are kept as they are and count nothing.

Everything is column expressions on one row at a time: no shuffle, no Python.
Null text counts as empty. Row order, repeated rows and null ids do not matter: every
row is judged alone, and extra columns of the input are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import NOT_SPACE, let, whole, words

SYMBOLS = r"[#*$%&|<>]"
NO_SYMBOLS = r"[^#*$%&|<>]+"
MIN_WORDS = 50
SHORT_LINE = 8
SEPARATORS = 3  # separators that make a line a navigation bar
NAVIGATION = r"(\A|[\x20\x09])(\||>|»|›|·|•|/|::)([\x20\x09]|\z)"
SHOUT = r"\p{Lu}{2,}[^\s\p{L}]*!!"
MARKS = r"[#*$%&|<>»›·•/:]"
CLOSED = r"""[.!?…。！？:;]["'”’»)\]]*[\x20\x09\x0B-\x0D]*\z"""
BOILERPLATE = (
    r"(?i)(\A|[^A-Za-z])(all rights reserved|licen[sc]ed under|released under the|terms of (use|service)|privacy policy"
    r"|use of cookies|accept cookies|enable javascript|click here|sign up for|subscribe to our|log ?in to"
    r"|share this (page|article)|lorem ipsum)([^A-Za-z]|\z)"
)
SYMBOL_SHARE = 0.05  # of the characters of a line
KEEP_SHARE = 0.5  # of the word characters of a document


def window_keys(tokens: Column, width: int = 3) -> Column:
    """64-bit keys of the windows of ``width`` words, by start."""
    keys = F.transform(tokens, lambda word, i: F.xxhash64(word, *[F.get(tokens, i + k) for k in range(1, width)]))
    return F.slice(keys, 1, F.greatest(F.size(tokens) - (width - 1), F.lit(0)))


def repeat_starts(keys: Column) -> Column:
    """Sorted starts of the windows whose key occurs twice or more; most texts have none and are not sorted."""
    placed = F.sort_array(F.transform(keys, lambda key, i: F.struct(key.alias("h"), i.alias("p"))))

    def again(s: Column) -> Column:
        def same(pair: Column, j: Column) -> Column:
            return F.coalesce((j >= 0) & (pair["h"] == F.get(s, j)["h"]), F.lit(False))

        found = F.filter(s, lambda pair, i: same(pair, i - 1) | same(pair, i + 1))
        return F.sort_array(F.transform(found, lambda pair: pair["p"]))

    none = F.array().cast("array<int>")
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), none).otherwise(let(placed, again))


def covered(starts: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` words at the sorted ``starts``."""
    gaps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda p, q: F.coalesce(q - p, F.lit(width)))
    return F.aggregate(gaps, F.lit(0), lambda total, gap: total + F.least(gap, F.lit(width))).cast("long")


def line_fails(line: Column) -> Column:
    """Whether a line that has a word fails by its own content."""
    symbols = F.length(F.regexp_replace(line, NO_SYMBOLS, ""))
    navigation = F.regexp_count(line, F.lit(NAVIGATION)) >= SEPARATORS
    shouted = F.contains(line, F.lit("!!")) & (F.regexp_count(line, F.lit(SHOUT)) >= SEPARATORS)
    # The marks that a navigation or noise line has; most lines have none of them.
    marked = line.rlike(MARKS) & (navigation | (symbols > SYMBOL_SHARE * F.length(line)))
    return marked | shouted | line.rlike(BOILERPLATE)


def open_ended(line: Column) -> Column:
    """A line of some length without closing punctuation."""
    return ~line.rlike(CLOSED) & (F.size(words(line)) >= SHORT_LINE)


def repeats(lines: Column) -> Column:
    """For every line whether an earlier one equals it, from the lines sorted with their places."""
    placed = F.array_sort(F.transform(lines, lambda line, i: F.struct(line.alias("l"), i.alias("i"))))

    def marked(s: Column) -> Column:
        same = F.transform(s, lambda e, j: F.struct(e["i"].alias("i"), F.coalesce(F.get(s, j - 1)["l"] == e["l"], F.lit(False)).alias("r")))
        return F.transform(F.array_sort(same), lambda e: e["r"])

    return let(placed, marked)


def kept_lines(lines: Column) -> Column:
    """The lines that pass, in order; lines without a word pass."""
    none = F.array().cast("array<boolean>")

    def passing(again: Column) -> Column:
        def passes(line: Column, i: Column) -> Column:
            last = i == F.size(lines) - 1
            repeated = F.coalesce(F.get(again, i), F.lit(False)) & line.rlike(NOT_SPACE)
            return ~(repeated | line_fails(line) | (~last & open_ended(line)))

        return F.filter(lines, passes)

    # Most texts have no equal lines and are not sorted.
    return let(F.when(F.col("_distinct"), none).otherwise(repeats(lines)), passing)


def word_chars(text: Column) -> Column:
    return F.length(F.array_join(words(text), "")).cast("long")


def judged(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: the ``keep`` columns, its measures, verdict and cleaned text.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` measure the whole
    text; ``clean_text`` holds the lines that pass and ``clean_chars`` its word characters;
    ``base_failed`` is the document rule (too few words, or over half of them in repeated 3-word
    windows); ``kept`` is false for a base failure and for a text whose passing lines hold less
    than ``KEEP_SHARE`` of its word characters. An empty text has measures 0 and is not kept.
    """
    body = whole(text)
    split = docs.select(
        F.struct(*[F.col(name) for name in keep]).alias("_row"),
        body.alias("_text"),
        words(body).alias("_words"),
        F.split(body, "\n", -1).alias("_lines"),
    )
    keyed = split.select(
        "*",
        window_keys(F.col("_words")).alias("_keys"),
        F.filter("_lines", lambda line: line.rlike(NOT_SPACE)).alias("_worded"),
        (F.size(F.array_distinct("_lines")) == F.size("_lines")).alias("_distinct"),
    )
    measured = keyed.select(
        "_row",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", NO_SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long").alias("n_dup_lines"),
        repeat_starts(F.col("_keys")).alias("_starts"),
        F.size("_lines").alias("_n_lines"),
        kept_lines(F.col("_lines")).alias("_passing"),
    ).select(
        "_row",
        *MEASURES[:-1],
        covered(F.col("_starts")).alias("n_repeat_words"),
        F.array_join("_passing", "\n").alias("clean_text"),
        (F.size("_passing") == F.col("_n_lines")).alias("_all"),
        # A filter on the verdict stays above this column; pushed below, it would compute every measure again.
        F.monotonically_increasing_id().alias("_spot"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    enough = F.col("clean_chars") >= KEEP_SHARE * F.col("word_chars")
    return (
        measured.withColumn(
            "clean_chars", F.when(F.col("_all"), F.col("word_chars")).otherwise(word_chars(F.col("clean_text")))
        )
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & enough & (F.col("_spot") >= 0))
        .select("_row.*", *MEASURES, "base_failed", "kept", "clean_chars", "clean_text")
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The kept documents with their passing lines as text; all other columns as they were.

    ``n_chars``, where the table has it, becomes the length of the cleaned text.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{name}`") for name in names]).alias("_doc"), F.col(text).alias("_body"))
    good = judged(packed, "_body", ("_doc",)).filter("kept")
    fresh = {text: F.col("clean_text")}
    if "n_chars" in names:
        fresh["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return good.select(*[fresh.get(name, F.col("_doc")[name]).alias(name) for name in names])
