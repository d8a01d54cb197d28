"""Removal of long byte strings that occur more than once, by prefix-free parsing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.llm.common import map_batches, rows, signed, stored, table, utf8, with_length

# Fixed value: the shortest string that counts as repeated.
LENGTH = 200
# Bytes of the rolling hash whose smallest value in a window is its trigger.
TRIGGER = 64
# Suffixes worked on at a time; bounds the memory of a long text and of a phrase.
BLOCK = 1 << 18
PHRASE = 1 << 12
# Suffixes of one trigger's phrases that are sorted in one task.
HOT = 1 << 16

_TRIGGERS = LENGTH - TRIGGER + 1
# Odd constants of no meaning: bases of the two polynomial hashes, and a mixer.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_WORD = 1 << 64


def _powers(base: int) -> np.ndarray:
    """base**i modulo 2**64 for every offset of a block."""
    out = np.full(BLOCK + PHRASE + LENGTH, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _prefix_sums(data: np.ndarray, base: int) -> np.ndarray:
    """Sums over i < n of (data[i] + 1) * base**i, for every n."""
    if base not in _TABLES:
        _TABLES[base] = _powers(base), _powers(pow(base, -1, _WORD))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _TABLES[base][0][: len(data)], out=sums[1:])
    return sums


def _hashes(sums: np.ndarray, base: int, starts, ends) -> np.ndarray:
    """Hash of data[start:end], the same wherever in the block the string stands."""
    values = (sums[ends] - sums[starts]) * _TABLES[base][1][starts]
    values ^= values >> np.uint64(32)
    values *= _MIX
    values ^= values >> np.uint64(29)
    return values


def _every(sums: np.ndarray, base: int, width: int) -> np.ndarray:
    n = len(sums) - width
    return _hashes(sums, base, slice(0, n), slice(width, width + n))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n, reach = len(values) - width + 1, 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[:n], values[width - reach : width - reach + n])


def parse(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cut the suffixes of a block into phrases: (start, count, trigger, content, periodic).

    A suffix here is a start of ``LENGTH`` bytes. Its trigger is the smallest
    rolling hash in those bytes, so equal strings have equal triggers wherever
    they stand. A phrase is a run of suffixes with one trigger and holds all
    their bytes: neighbouring phrases overlap, as in prefix-free parsing, and
    every suffix is whole within its phrase. A phrase is periodic if its
    trigger occurs in it twice; only then can it repeat a string within itself.
    """
    rolling = _every(_prefix_sums(data, _BASES[0]), _BASES[0], TRIGGER)
    triggers = _sliding_min(rolling, _TRIGGERS)
    cuts = np.flatnonzero(np.concatenate([[True], triggers[1:] != triggers[:-1]]))
    counts = np.diff(np.append(cuts, len(triggers)))
    if counts.max() > PHRASE:  # a run of one byte has one trigger throughout
        parts = -(-counts // PHRASE)
        first = np.repeat(np.cumsum(parts) - parts, parts)
        cuts = np.repeat(cuts, parts) + (np.arange(len(first)) - first) * PHRASE
        counts = np.diff(np.append(cuts, len(triggers)))
    anchors = triggers[cuts]
    sums = _prefix_sums(data, _BASES[1])
    content = _hashes(sums, _BASES[1], cuts, cuts + counts + LENGTH - 1)
    periodic = np.zeros(len(cuts), bool)
    span = np.arange(_TRIGGERS)
    for at in range(0, len(cuts), 512):
        part = slice(at, at + 512)
        first = rolling[cuts[part, None] + span] == anchors[part, None]
        ends = cuts[part] + counts[part] - 1
        last = rolling[ends[:, None] + span] == anchors[part, None]
        lowest = cuts[part] + first.argmax(1)
        highest = ends + _TRIGGERS - 1 - last[:, ::-1].argmax(1)
        periodic[part] = lowest != highest
    return cuts, counts, anchors, content, periodic


def _blocks(text: bytes):
    """(offset, bytes) of blocks that share LENGTH - 1 bytes, so that no suffix is cut."""
    data = np.frombuffer(text, np.uint8)
    for at in range(0, len(data) - LENGTH + 1, BLOCK):
        yield at, data[at : at + BLOCK + LENGTH - 1]


_KEYS = ("key_id", "key_text")


def _parsed(base: DataFrame) -> DataFrame:
    """The parse: one row per phrase occurrence, in the order of the corpus by (key, start)."""

    def step(batches):
        for batch in batches:
            parts = []
            for i, text in enumerate(utf8(batch.column(2))):
                for at, data in _blocks(text or b""):
                    starts, *rest = parse(data)
                    parts.append((np.full(len(starts), i), starts + at, *rest))
            if parts:
                own, start, count, trigger, content, periodic = map(
                    np.concatenate, zip(*parts, strict=True)
                )
                own = pa.array(own)
                yield rows(
                    key_id=batch.column(0).take(own),
                    key_text=batch.column(1).take(own),
                    start=start,
                    count=count.astype(np.int32),
                    trigger=signed(trigger),
                    content=signed(content),
                    periodic=periodic,
                )

    return map_batches(
        base.select(*_KEYS, "text"),
        step,
        "key_id bigint, key_text bigint, start bigint, count int, trigger bigint,"
        " content bigint, periodic boolean",
    )


def _phrase_bytes(texts: DataFrame) -> DataFrame:
    """Cut the phrases of a list, (start, count, single, trigger, hot), out of each text."""

    def step(batches):
        for batch in batches:
            own, found = [], []
            for i, (text, phrases) in enumerate(
                zip(utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True)
            ):
                own += [i] * len(phrases)
                found += [
                    (p, text[p["start"] : p["start"] + p["count"] + LENGTH - 1]) for p in phrases
                ]
            own = pa.array(own, pa.int64())
            yield rows(
                key_id=batch.column(0).take(own),
                key_text=batch.column(1).take(own),
                start=pa.array([p["start"] for p, _ in found], pa.int64()),
                single=pa.array([p["single"] for p, _ in found], pa.bool_()),
                trigger=pa.array([p["trigger"] for p, _ in found], pa.int64()),
                hot=pa.array([p["hot"] for p, _ in found], pa.bool_()),
                phrase=pa.array([b for _, b in found], pa.binary()),
            )

    return map_batches(
        texts,
        step,
        "key_id bigint, key_text bigint, start bigint, single boolean, trigger bigint,"
        " hot boolean, phrase binary",
    )


def _runs(own: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


def _repeated_in(phrases: list[bytes]) -> list[np.ndarray]:
    """For each phrase, which of its suffixes stand elsewhere in these phrases.

    The suffix array of the phrases by their first LENGTH bytes: equal
    neighbours in that order share at least LENGTH bytes.
    """
    windows = np.concatenate(
        [np.lib.stride_tricks.sliding_window_view(np.frombuffer(p, np.uint8), LENGTH) for p in phrases]
    )
    suffixes = np.ascontiguousarray(windows).view(f"S{LENGTH}").ravel()
    order = np.argsort(suffixes)
    same = suffixes[order[1:]] == suffixes[order[:-1]]
    repeated = np.zeros(len(order), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    return np.split(repeated, np.cumsum([len(p) - LENGTH + 1 for p in phrases])[:-1])


_SPANS = "key_id bigint, key_text bigint, start bigint, end bigint"


def _sorted_groups(phrases: DataFrame) -> DataFrame:
    """Spans of repeated suffixes among the phrases of each trigger, at most HOT suffixes."""

    def step(batches):
        group: list[dict] = []
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if group and row["trigger"] != group[0]["trigger"]:
                    out += spans_of(group)
                    group = []
                group.append(row)
            yield batch_of(out)
        if group:
            yield batch_of(spans_of(group))

    def spans_of(group):
        for row, repeated in zip(group, _repeated_in([r["phrase"] for r in group]), strict=True):
            if row["single"]:
                for a, b in _runs(repeated):
                    yield row["key_id"], row["key_text"], row["start"] + a, row["start"] + b + LENGTH

    def batch_of(out):
        columns = list(zip(*out, strict=True)) or [()] * 4
        names = ("key_id", "key_text", "start", "end")
        return rows(**{n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})

    dealt = phrases.repartition("trigger").sortWithinPartitions("trigger")
    return map_batches(dealt, step, _SPANS)


def _hashed_suffixes(phrases: DataFrame) -> DataFrame:
    """(keys, start, single, trigger, suffix): each suffix of each phrase as a hash."""

    def step(batches):
        for batch in batches:
            parts, held = [], 0
            for i, phrase in enumerate(batch.column(5).to_pylist()):
                data = np.frombuffer(phrase, np.uint8)
                parts.append((i, _every(_prefix_sums(data, _BASES[1]), _BASES[1], LENGTH)))
                held += len(data)
                if held >= BLOCK:
                    yield out(parts, batch)
                    parts, held = [], 0
            if parts:
                yield out(parts, batch)

    def out(parts, batch):
        own = pa.array(np.concatenate([np.full(len(h), i) for i, h in parts]))
        offset = np.concatenate([np.arange(len(h)) for _, h in parts])
        return rows(
            key_id=batch.column(0).take(own),
            key_text=batch.column(1).take(own),
            start=batch.column(2).take(own).to_numpy() + offset,
            single=batch.column(3).take(own),
            trigger=batch.column(4).take(own),
            suffix=signed(np.concatenate([h for _, h in parts])),
        )

    return map_batches(
        phrases.select(*_KEYS, "start", "single", "trigger", "phrase"),
        step,
        "key_id bigint, key_text bigint, start bigint, single boolean, trigger bigint,"
        " suffix bigint",
    )


def _hashed_groups(phrases: DataFrame) -> DataFrame:
    """The same spans for triggers of any number of suffixes, by counting equal ones."""
    suffixes = stored(_hashed_suffixes(phrases), "suffixes")
    equal = (
        suffixes.groupBy("trigger", "suffix")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.col("trigger").alias("_trigger"), F.col("suffix").alias("_suffix"))
        .hint("rebalance")
    )
    return (
        suffixes.filter("single")
        .join(
            equal,
            (F.col("trigger") == F.col("_trigger")) & (F.col("suffix") == F.col("_suffix")),
            "left_semi",
        )
        .select(*_KEYS, "start", (F.col("start") + LENGTH).alias("end"))
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str, *others: str) -> DataFrame:
    """Texts with a key that equal rows share: equal texts have equal spans anyway."""
    id_, text = F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(id_, F.lit(-(2**63))).alias("key_id"),
        F.xxhash64(text).alias("key_text"),
        id_.alias("doc_id"),
        text.alias("text"),
        *others,
    )


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key_id, key_text, spans): per text the [start, end) byte spans that occur elsewhere.

    The plan is prefix-free parsing cut to what a threshold of LENGTH bytes
    needs. The parse gives phrases; the dictionary is the distinct ones with
    their counts. Phrases overlap by LENGTH - 1 bytes, so the first LENGTH bytes
    of any suffix of the corpus lie in one phrase, and its place in the order
    of the corpus, as far as LENGTH bytes tell, is that of the suffix of the
    dictionary phrase. A phrase that occurs twice has all its suffixes twice.
    What is left are different phrases of one trigger. Equal strings have equal
    triggers, so the suffix array of the dictionary falls into one part per
    trigger: each part is sorted on its own, and equal neighbours are the
    repeated strings. A trigger whose phrases have more than HOT suffixes (a passage
    between many different texts) isn't gathered in one task; its suffixes are
    counted by (trigger, hash of LENGTH bytes), two independent 64-bit hashes.
    """
    base = _keyed(docs, id_col, text_col)
    parsed = _parsed(base)
    # One row per trigger that occurs again. "mixed": in different phrases.
    triggers = stored(
        parsed.groupBy("trigger")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("content").alias("low"),
            F.max("content").alias("high"),
            F.max("periodic").alias("periodic"),
        )
        .filter("n > 1 or periodic")
        .select("trigger", (F.col("periodic") | (F.col("low") != F.col("high"))).alias("mixed")),
        "triggers",
    )
    again = stored(parsed.join(triggers, "trigger"), "parse")
    dictionary = stored(
        again.filter("mixed")
        .groupBy("trigger", "content")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct(*_KEYS, "start", "count")).alias("first"),
        )
        .select("trigger", "content", "n", "first.*"),
        "dictionary",
    )
    hot = stored(
        dictionary.groupBy("trigger").agg(F.sum("count").alias("n")).filter(F.col("n") > HOT),
        "hot",
    ).select(F.col("trigger").alias("_hot"))
    lists = (
        dictionary.join(hot, dictionary["trigger"] == hot["_hot"], "left")
        .groupBy(*_KEYS)
        .agg(
            F.collect_list(
                F.struct(
                    "start",
                    "count",
                    (F.col("n") == 1).alias("single"),
                    "trigger",
                    F.col("_hot").isNotNull().alias("hot"),
                )
            ).alias("phrases")
        )
    )
    # Rows that repeat a key hold the same text; one of them gives the phrases.
    texts = (
        base.select(*_KEYS, "text")
        .join(lists.hint("rebalance"), list(_KEYS))
        .dropDuplicates(list(_KEYS))
        .select(*_KEYS, "text", "phrases")
    )
    phrases = stored(_phrase_bytes(texts), "phrases")
    partly = _sorted_groups(phrases.filter("not hot").drop("hot")).unionByName(
        _hashed_groups(phrases.filter("hot"))
    )
    # Occurrences of a phrase that is there twice: by its own count in the dictionary.
    twice = dictionary.filter("n > 1").select(
        F.col("trigger").alias("_trigger"), F.col("content").alias("_content")
    )
    whole = again.filter("not mixed").unionByName(
        again.filter("mixed").join(
            twice,
            (F.col("trigger") == F.col("_trigger")) & (F.col("content") == F.col("_content")),
            "left_semi",
        )
    )
    spans = whole.select(
        *_KEYS, "start", (F.col("start") + F.col("count") + (LENGTH - 1)).alias("end")
    ).unionByName(partly)
    return spans.groupBy(*_KEYS).agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _cut(text: bytes, spans: list | None) -> tuple[bytes, int, int]:
    """Text without its spans; number of bytes removed; number of maximal runs removed."""
    if not spans:
        return text, 0, 0
    pairs = np.array([(s["start"], s["end"]) for s in spans], np.int64)
    pairs = pairs[pairs[:, 0].argsort()]
    reach = np.maximum.accumulate(pairs[:, 1])
    opens = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
    starts = pairs[opens, 0]
    ends = reach[np.append(np.flatnonzero(opens)[1:] - 1, len(reach) - 1)]
    edges = [0, *np.stack([starts, ends], 1).ravel().tolist(), len(text)]
    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    return kept, len(text) - len(kept), len(starts)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every row's text without repeated strings.

    A byte goes if a string of LENGTH bytes that covers it starts anywhere else
    too, in the same text or another, overlaps included; strings are judged on
    the input. ``kept`` is binary: a cut may fall within a character. Null and
    empty texts keep nothing of nothing: 0 bytes, 0 spans. Repeated rows, with
    or without an id, are copies of each other and lose all that is long enough.
    An empty table gives no rows; other columns of ``docs`` are not looked at.
    """
    base = _keyed(docs, id_col, text_col)
    spans = repeated_spans(docs, id_col, text_col)
    joined = base.join(spans.hint("rebalance"), list(_KEYS), "left").select("doc_id", "text", "spans")

    def step(batches):
        for batch in batches:
            texts = utf8(batch.column(1))
            done = [_cut(t, s) for t, s in zip(texts, batch.column(2).to_pylist(), strict=True)]
            yield rows(
                doc_id=batch.column(0),
                n_bytes=pa.array([len(t) for t in texts], pa.int64()),
                n_removed=pa.array([d[1] for d in done], pa.int64()),
                n_spans=pa.array([d[2] for d in done], pa.int64()),
                kept=pa.array([d[0] for d in done], pa.binary()),
            )

    return map_batches(
        joined, step, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    )


def documents_without_repeats(docs: DataFrame) -> DataFrame:
    """The columns of documents, each text without repeated strings; see ``without_repeats``.

    Bytes of characters that a cut leaves incomplete go too. A row stays even if its
    text becomes empty; a null text stays null. ``n_chars`` follows the new text.
    """
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    keyed = _keyed(docs.select(row, F.col("doc_id").alias("_id"), F.col("text").alias("_text")), "_id", "_text", "row")
    spans = repeated_spans(docs)
    joined = keyed.join(spans.hint("rebalance"), list(_KEYS), "left").select("row", "text", "spans")

    def step(batches):
        for batch in batches:
            pairs = zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True)
            kept = [_cut(t, s)[0].decode(errors="ignore") for t, s in pairs]
            yield rows(row=batch.column(0), text=pa.array(kept, pa.string()))

    out = T.StructType([joined.schema["row"], T.StructField("text", T.StringType())])
    found = map_batches(joined, step, out)
    fields = [
        F.when(F.col("row.text").isNotNull(), F.col("text")).alias("text") if c == "text" else F.col("row")[c].alias(c)
        for c in docs.columns
    ]
    return with_length(found.select(*fields))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps once strings of 200 bytes that repeat are gone."""
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
