"""Conversations in the order of their replies, without what messages quote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm.common import dropped, stored, table

# Marks of quotation before a line, one for each level, and white space.
MARKS = r"^([\x20\t]*>)+[\x20\t]?"
SPACE = r"[\x20\x09-\x0D]+"
# Consecutive lines of a message that can be quoted out of it: up to so many are looked up at once.
WINDOW = 4
# Where a passage is not found, a line of it links its message if it has as many words as this.
LINE_WORDS = 4


def _normal(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), SPACE, " "))


def _level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">")))


def _hashed(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.xxhash64(t))


def _long_enough(line: Column) -> Column:
    return F.size(F.split(line, " ")) >= LINE_WORDS


def _windows(lines: Column, sizes: range) -> Column:
    """Every run of so many consecutive lines, each as one text."""

    def of(n: int) -> Column:
        firsts = F.slice(lines, 1, F.greatest(F.size(lines) - n + 1, F.lit(0)))
        return F.transform(firsts, lambda _, i: F.array_join(F.slice(lines, i + 1, n), " "))

    return F.concat(*map(of, sizes))


def parsed(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, passages, body): messages cut where the level of quotation changes.

    ``passages`` has (level, lines) in order, lines normalised; ``body`` is the text of level 0 as written.
    """
    return (
        messages.select(
            F.col("conv_id").cast("bigint").alias("conv_id"),
            F.col("turn").cast("bigint").alias("turn"),
            F.col("role").cast("string").alias("role"),
            F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n").alias("raw"),
        )
        .withColumn("levels", F.transform("raw", _level))
        .withColumn(
            "lines", F.transform("raw", lambda line: _normal(F.regexp_replace(line, MARKS, "")))
        )
        .withColumn(
            "starts",
            F.filter(
                F.sequence(F.lit(0), F.size("levels") - 1),
                lambda i: (i == 0) | (F.get("levels", i) != F.get("levels", i - 1)),
            ),
        )
        .withColumn(
            "passages",
            F.transform(
                "starts",
                lambda s, k: F.struct(
                    F.get("levels", s).alias("level"),
                    F.filter(
                        F.slice(
                            "lines",
                            s + 1,
                            F.coalesce(F.get("starts", k + 1), F.size("lines")) - s,
                        ),
                        lambda line: line != "",
                    ).alias("lines"),
                ),
            ),
        )
        .withColumn(
            "body",
            F.regexp_replace(
                F.array_join(F.filter("raw", lambda line, i: F.get("levels", i) == 0), "\n"),
                r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$",
                "",
            ),
        )
        .select("conv_id", "turn", "role", "levels", "passages", "body")
    )


def _originals(messages: DataFrame) -> DataFrame:
    """(conv, hash, first): the first message of a conversation that says a passage itself.

    Its whole text, each stretch between quotes, and each run of up to WINDOW lines
    can be quoted.
    """
    own = F.filter("passages", lambda p: p["level"] == 0)
    every = F.flatten(F.transform(own, lambda p: p["lines"]))
    said = F.concat(
        F.array(F.array_join(every, " ")),
        F.transform(own, lambda p: F.array_join(p["lines"], " ")),
        _windows(every, range(1, WINDOW + 1)),
    )
    units = messages.select(
        "conv_id", "turn", F.explode(F.array_distinct(_hashed(F.filter(said, lambda t: t != ""))))
        .alias("hash")
    )
    return (
        units.groupBy(F.col("conv_id").alias("_conv"), F.col("hash").alias("_hash"))
        .agg(F.min("turn").alias("first"))
        .hint("rebalance")
    )


def _quoted(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, passage, level, part, need, hash): what of a quoted passage is looked up.

    Part 0 is the passage as a whole, part 1 the runs of WINDOW lines that a longer one is made of, of
    which a message has to hold all ``need``, and the parts after that are its long lines.
    """
    quotes = messages.select(
        "conv_id",
        "turn",
        F.posexplode(
            F.filter("passages", lambda p: (p["level"] > 0) & (F.size(p["lines"]) > 0))
        ).alias("passage", "quote"),
    )
    lines = F.col("quote.lines")
    runs = F.array_distinct(_windows(lines, range(WINDOW, WINDOW + 1)))

    def part(number: Column, need: Column, text: Column) -> Column:
        return F.struct(
            number.cast("int").alias("part"), need.cast("bigint").alias("need"), F.xxhash64(text).alias("hash")
        )

    one = F.lit(1)
    long_lines = F.transform(lines, lambda line, i: F.when(_long_enough(line), part(i + 2, one, line)))
    parts = F.concat(
        F.array(part(F.lit(0), one, F.array_join(lines, " "))),
        F.transform(F.when(F.size(lines) > WINDOW, runs).otherwise(F.array().cast("array<string>")),
            lambda run: part(one, F.size(runs), run)),
        F.filter(long_lines, lambda p: p.isNotNull()),
    )
    return quotes.select(
        "conv_id", "turn", "passage", F.col("quote.level").alias("level"), F.inline(parts)
    )


def _replies(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, n_linked, reply_to) of the messages that quote an earlier one."""
    quoted, originals = _quoted(messages), _originals(messages)
    found = quoted.join(
        originals,
        (quoted["conv_id"] == originals["_conv"])
        & (quoted["hash"] == originals["_hash"])
        & (originals["first"] < quoted["turn"]),
    )
    held = (
        found.groupBy("conv_id", "turn", "passage", "level", "part", "first", "need")
        .agg(F.count_distinct("hash").alias("n"))  # rows may repeat
        .filter("n = need")
    )
    passages = held.groupBy("conv_id", "turn", "passage").agg(
        F.min("level").alias("level"), F.min(F.struct("part", "first")).alias("best")
    )
    # The latest original of the outermost level that has one.
    best = F.min(F.struct("level", (-F.col("best.first")).alias("later")))
    return passages.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("n_linked"), (-best["later"]).alias("reply_to")
    )


def _threads(replies: DataFrame) -> DataFrame:
    """Replies with ``thread``, the message that the chain of replies begins with.

    Pointers double their reach each round, so the rounds are the logarithm of the longest chain.
    """
    now = stored(replies.withColumn("thread", F.col("reply_to")), "threads")
    while True:
        up = now.select(
            F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("thread").alias("_up")
        )
        far = now.join(
            up, (now["conv_id"] == up["_conv"]) & (now["thread"] == up["_turn"]), "left"
        )
        if far.filter("_up IS NOT NULL").isEmpty():
            return now
        after = stored(
            far.select(
                "conv_id", "turn", "n_linked", "reply_to", F.coalesce("_up", "thread").alias("thread")
            ),
            "threads",
        )
        dropped(now)
        now = after


def reply_ordered(messages: DataFrame) -> DataFrame:
    """Messages without their quotes, with what they answer: (conv_id, turn, role, body,
    n_quoted_lines, max_level, n_passages, n_linked, reply_to, thread).

    A line is quoted as many levels deep as ``>`` marks stand before it. A passage is a run of
    lines of one level; its normalised text (lower case, single spaces) is looked up by hash among what earlier
    messages of the conversation say themselves: as a whole (their whole text, a stretch, or up to four consecutive lines of them,
    however short), a longer excerpt by its runs of four lines, then by lines of four words or more. An excerpt
    that is wrapped at another width than its message links by none of these. ``reply_to`` is the turn that
    the outermost quotes answer (the latest, of several) and null without a link; ``thread`` is the turn that the chain of replies began
    with, the own one without a link. Sorted by (conv_id, thread, turn), every
    message follows the one that it answers: the order is a sort key, so that a
    conversation of any size is never gathered.

    Null texts are empty. Rows that repeat (conv_id, turn) share their links; rows where
    either is null have none. An empty table gives no rows; other columns are not looked at.
    """
    of_messages = parsed(messages)
    replies = _replies(of_messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL"))
    linked = _threads(replies).select(
        F.col("conv_id").alias("_conv"),
        F.col("turn").alias("_turn"),
        F.col("n_linked").alias("_linked"),
        "reply_to",
        F.col("thread").alias("_thread"),
    )
    quoted = F.filter("levels", lambda level: level > 0)
    passages = F.filter("passages", lambda p: (p["level"] > 0) & (F.size(p["lines"]) > 0))
    return of_messages.join(
        linked,
        (of_messages["conv_id"] == linked["_conv"]) & (of_messages["turn"] == linked["_turn"]),
        "left",
    ).select(
        "conv_id",
        "turn",
        "role",
        "body",
        F.size(quoted).cast("bigint").alias("n_quoted_lines"),
        F.coalesce(F.array_max("levels"), F.lit(0)).cast("bigint").alias("max_level"),
        F.size(passages).cast("bigint").alias("n_passages"),
        F.coalesce("_linked", F.lit(0)).cast("bigint").alias("n_linked"),
        "reply_to",
        F.coalesce("_thread", "turn").alias("thread"),
    )


def write_ordered(ordered: DataFrame, path: str) -> None:
    """Write conversations in the order of their replies, in files of like size."""
    keys = ("conv_id", "thread", "turn")
    ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)


def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of the conversations without quotes, and what it answers."""
    return reply_ordered(table(spark, sf_dir, "conversations"))


OP4_SQL = r"""
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, generate_subscripts(raw, 1) AS i, unnest(raw) AS raw
  FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS raw FROM conversations)
), levelled AS (
  SELECT *, length(regexp_replace(regexp_extract(raw, '^([\x20\t]*>)+[\x20\t]?'), '[^>]', '', 'g')) AS level,
    trim(regexp_replace(lower(regexp_replace(raw, '^([\x20\t]*>)+[\x20\t]?', '')),
      '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM lines
), numbered AS (
  SELECT *, sum(changed) OVER (PARTITION BY conv_id, turn ORDER BY i) AS passage FROM (
    SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY conv_id, turn ORDER BY i)
      THEN 1 ELSE 0 END AS changed FROM levelled)
), passages AS (
  SELECT conv_id, turn, passage, level, string_agg(line, ' ' ORDER BY i) AS text
  FROM numbered WHERE line <> '' GROUP BY ALL
), own AS (
  SELECT conv_id, turn, line, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS k
  FROM numbered WHERE level = 0 AND line <> ''
), said AS (
  SELECT conv_id, turn, text FROM passages WHERE level = 0
  UNION ALL SELECT conv_id, turn, string_agg(line, ' ' ORDER BY k) FROM own GROUP BY ALL
  UNION ALL SELECT conv_id, turn, text FROM (
    SELECT a.conv_id, a.turn, a.k, n, string_agg(b.line, ' ' ORDER BY b.k) AS text
    FROM own a CROSS JOIN range(1, 5) AS sizes(n) JOIN own b
      ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.k BETWEEN a.k AND a.k + n - 1
    GROUP BY ALL HAVING count(*) = n)
), originals AS (
  SELECT conv_id, text, min(turn) AS first FROM said GROUP BY ALL
), theirs AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn, passage ORDER BY i) AS k,
    count(*) OVER (PARTITION BY conv_id, turn, passage) AS size
  FROM numbered WHERE level > 0 AND line <> ''
), excerpts AS (
  SELECT DISTINCT conv_id, turn, passage, level, text FROM (
    SELECT a.conv_id, a.turn, a.passage, a.level, a.k, string_agg(b.line, ' ' ORDER BY b.k) AS text
    FROM theirs a JOIN theirs b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.passage = b.passage
      AND b.k BETWEEN a.k AND a.k + 3 WHERE a.size > 4 GROUP BY ALL HAVING count(*) = 4)
), quoted AS (
  SELECT conv_id, turn, passage, level, 0 AS part, 1 AS need, text FROM passages WHERE level > 0
  UNION ALL SELECT conv_id, turn, passage, level, 1, count(*) OVER (PARTITION BY conv_id, turn, passage), text
    FROM excerpts
  UNION ALL SELECT conv_id, turn, passage, level, k + 1, 1, line FROM theirs
    WHERE len(string_split(line, ' ')) >= 4
), held AS (
  SELECT q.conv_id, q.turn, q.passage, level, q.part, o.first
  FROM quoted q JOIN originals o ON q.conv_id = o.conv_id AND q.text = o.text AND o.first < q.turn
  GROUP BY ALL HAVING count(DISTINCT q.text) = any_value(need)
), linked AS (
  SELECT conv_id, turn, passage, level, arg_min(first, (part, first)) AS first FROM held GROUP BY ALL
), replies AS (
  SELECT conv_id, turn, count(*) AS n_linked, max(first) FILTER (WHERE level = least) AS reply_to
  FROM (SELECT *, min(level) OVER (PARTITION BY conv_id, turn) AS least FROM linked) GROUP BY ALL
), chains AS (
  SELECT conv_id, turn, reply_to AS thread FROM replies
  UNION ALL SELECT c.conv_id, c.turn, r.reply_to FROM chains c
    JOIN replies r ON c.conv_id = r.conv_id AND c.thread = r.turn
), threads AS (
  SELECT conv_id, turn, min(thread) AS thread FROM chains GROUP BY ALL
), counts AS (
  SELECT conv_id, turn, count(*) FILTER (WHERE level > 0) AS n_quoted_lines, max(level) AS max_level,
    string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE level = 0) AS body
  FROM levelled GROUP BY ALL
), quotes AS (
  SELECT conv_id, turn, count(*) AS n_passages FROM passages WHERE level > 0 GROUP BY ALL
)
SELECT m.conv_id, m.turn, m.role,
  regexp_replace(coalesce(c.body, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body,
  CAST(c.n_quoted_lines AS BIGINT) AS n_quoted_lines, CAST(c.max_level AS BIGINT) AS max_level,
  CAST(coalesce(q.n_passages, 0) AS BIGINT) AS n_passages,
  CAST(coalesce(r.n_linked, 0) AS BIGINT) AS n_linked, r.reply_to,
  coalesce(t.thread, m.turn) AS thread
FROM conversations m
JOIN counts c ON m.conv_id = c.conv_id AND m.turn = c.turn
LEFT JOIN quotes q ON m.conv_id = q.conv_id AND m.turn = q.turn
LEFT JOIN replies r ON m.conv_id = r.conv_id AND m.turn = r.turn
LEFT JOIN threads t ON m.conv_id = t.conv_id AND m.turn = t.turn
"""
