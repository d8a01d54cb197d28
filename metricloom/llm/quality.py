"""Quality rules as a cascade that stops at the first rule a text fails."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm.common import dropped, stored, table

# White space, symbols, and the limits of the base.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words
# Rows on which cost and selectivity of the rules are estimated; they only decide the order.
SAMPLE_ROWS = 1000
# A rule is timed on as many copies of the sample as take so many times what a job takes anyway.
WELL_ABOVE, MOST_COPIES = 3, 1 << 6


@dataclass(frozen=True)
class Rule:
    """A reason to reject, as a condition on the text, its words, lines and base counts."""

    name: str
    rejects: Callable[[], Column]


def _share(count: Column, percent: int) -> Column:
    return 100 * count > percent * F.col("n_words")


# Named after what they reject. Every one is a single pass over the text at most.
RULES = (
    Rule("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    Rule("long_words", lambda: F.col("word_chars") > 20 * F.col("n_words")),
    Rule("symbols", lambda: _share(F.col("n_symbols"), 20)),
    Rule("repeated_lines", lambda: 100 * F.col("n_dup_lines") > 50 * F.size("lines")),
    Rule("shouting", lambda: _share(F.regexp_count("text", F.lit(r"[!?]{2,}([\x20\x09-\x0D]|\z)")), 30)),
    Rule(
        "few_letters",
        lambda: 100 * F.regexp_count("text", F.lit(r"\p{L}")) < 50 * F.col("word_chars"),
    ),
    Rule(
        "cut_off_lines",
        lambda: 100 * F.regexp_count("text", F.lit(r"(\.\.\.|…)[ \t]*(\n|\z)")) > 60 * F.size("lines"),
    ),
    Rule(
        "bullet_lines",
        lambda: 100 * F.regexp_count("text", F.lit(r"(^|\n)[ \t]*[•*-][ \t]")) > 90 * F.size("lines"),
    ),
)


def _repeat_words(base: DataFrame) -> DataFrame:
    """Add n_repeat_words: words in a window of three words that the text holds twice or more.

    Windows are sorted by hash with their places in the low bits, as many as the
    text needs; equal neighbours are repeated windows. Sorting keeps this near linear for
    any text, where a lookup per window would not.
    """
    n = F.size("words")
    place = F.col("place_bits")
    hashed = base.withColumn("place_bits", F.length(F.bin(n))).withColumn(
        "hashes", F.transform("words", lambda w: F.xxhash64(w))
    )

    def packed(h: Column, i: Column) -> Column:
        window = F.xxhash64(h, F.get("hashes", i + 1), F.get("hashes", i + 2))
        return F.call_function(
            "shiftleft", F.call_function("shiftright", window, place), place
        ).bitwiseOR(i.cast("bigint"))

    windows = F.transform(F.slice("hashes", 1, F.greatest(n - 2, F.lit(0))), packed)
    ordered = hashed.withColumn("ordered", F.sort_array(windows))

    def window_of(v: Column) -> Column:
        return F.call_function("shiftright", v, place)

    def repeated(v: Column, i: Column) -> Column:
        before = window_of(F.get("ordered", i - 1)) == window_of(v)
        after = window_of(F.get("ordered", i + 1)) == window_of(v)
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    low = F.call_function("shiftleft", F.lit(1).cast("bigint"), place) - 1
    places = F.sort_array(F.transform(F.filter("ordered", repeated), lambda v: v.bitwiseAND(low)))
    # Each repeated window covers three words, less where the next one starts sooner.
    covered = F.transform(
        "places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("places", i + 1) - p, F.lit(3)))
    )
    return ordered.withColumn("places", places).withColumn(
        "n_repeat_words", F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, b: a + b)
    )


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, words, lines, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = (
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
        .withColumn("words", F.array_remove(F.split("text", SPACE), ""))
        .withColumn("lines", F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)))
        .withColumn("n_words", F.size("words").cast("bigint"))
        .withColumn("word_chars", F.length(F.array_join("words", "")).cast("bigint"))
        .withColumn("n_symbols", F.regexp_count("text", F.lit(SYMBOL)).cast("bigint"))
        .withColumn(
            "n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint")
        )
    )
    few = F.col("n_words") < LEAST_WORDS
    repeats = 100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    return _repeat_words(base).withColumn("base_failed", few | repeats)


def _seconds(frame: DataFrame, column: Column) -> tuple[float, float]:
    """Time to count what a condition rejects, and the share rejected."""
    started = time.perf_counter()
    share = frame.agg(F.avg(F.coalesce(column, F.lit(False)).cast("int")).alias("share")).first().share
    return time.perf_counter() - started, share or 0.0


def _cost(sample: DataFrame, column: Column, idle: dict[int, float]) -> tuple[float, float]:
    """Seconds that a condition takes on the sample, and the share rejected.

    One pass over a sample is lost in the time of a job, so the rows are copied until it stands out. ``idle``
    keeps what as many copies take with a condition that costs nothing.
    """
    copies = 1
    while True:
        copied = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        if copies not in idle:
            idle[copies] = min(_seconds(copied, F.col("copy") < 0)[0] for _ in range(2))
        seconds, share = _seconds(copied, column)
        if seconds > WELL_ABOVE * idle[copies] or copies >= MOST_COPIES:
            return max(seconds - idle[copies], 1e-6) / copies, share
        copies *= 8


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules by falling rejection per cost, both estimated on a sample of the texts.

    ``docs`` has doc_id and text. The sample is drawn before anything is counted, and stored, so that each
    rule is timed alone (see ``_cost``). The order changes the work and never a verdict.
    """
    whole = docs.count()
    if not whole:
        return rules
    drawn = docs.sample(min(1.0, sample_rows / whole), seed=7)
    columns = ("text", "lines", "n_words", "word_chars", "n_symbols", "n_dup_lines", "base_failed")
    counted = stored(base_counts(drawn).select(*columns), "sample")
    # Filtered only once it is stored: a filter on the counts would be pushed below
    # the steps they are made in, and make each of them anew for every word.
    sample = counted.filter("NOT base_failed")
    _seconds(sample, F.lit(False))  # the first job of a kind is slower
    worth, idle = {}, {}
    for rule in rules:
        seconds, share = _cost(sample, rule.rejects(), idle)
        worth[rule.name] = share / seconds
    dropped(counted)
    return tuple(sorted(rules, key=lambda r: -worth[r.name]))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and verdict of every row: (doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, first_failed).

    A text that fails the base is not kept; the others go through the rules in their
    estimated order, and the first that rejects ends it: ``first_failed`` names it, or the
    base, and is null for a kept text. All of it is SQL expressions over one row: no shuffle.
    Null and empty texts have no words and fail the base. Repeated rows and rows without an id each
    give a row; an empty table gives none; other columns of ``docs`` are not looked at.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counted = base_counts(texts)
    verdict = F.when(F.col("base_failed"), "base")
    for rule in cascade(texts, rules):
        verdict = verdict.when(rule.rejects(), rule.name)
    return counted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        verdict.alias("first_failed"),
    ).select("*", F.col("first_failed").isNull().alias("kept"))


def op3_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of every document."""
    # Which rule was first depends on the timings, the verdict doesn't.
    return judged(table(spark, sf_dir, "documents")).drop("first_failed")


OP3_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), words AS (
  SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM texts
), windows AS (
  SELECT doc_id, i, w, lead(w, 1) OVER o AS v, lead(w, 2) OVER o AS u
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), counted AS (
  SELECT doc_id, i, u IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, v, u) > 1 AS again
  FROM windows
), repeated AS (
  SELECT doc_id, count(*) FILTER (WHERE covered) AS n FROM (
    SELECT doc_id, bool_or(again) OVER (
      PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS covered
    FROM counted)
  GROUP BY doc_id
), base AS (
  SELECT t.doc_id, text, len(lines) AS n_lines, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM texts t LEFT JOIN repeated r ON t.doc_id = r.doc_id
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines
    OR 100 * len(regexp_extract_all(text, '[!?]{2,}([\x20\x09-\x0D]|\z)')) > 30 * n_words
    OR 100 * len(regexp_extract_all(text, '\p{L}')) < 50 * word_chars
    OR 100 * len(regexp_extract_all(text, '(\.\.\.|…)[ \t]*(\n|\z)')) > 60 * n_lines
    OR 100 * len(regexp_extract_all(text, '(^|\n)[ \t]*[•*-][ \t]')) > 90 * n_lines) AS kept
FROM judged
"""
