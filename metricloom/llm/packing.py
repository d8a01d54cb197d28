"""Packing of tokenised documents into sequences of several lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.llm.bpe import CHUNK, RANKS, RESYNC, chunks, ranks_of
from metricloom.llm.common import map_batches, rows, stored, table

# Context sizes, powers of two; the largest is the sequence length.
TIERS = (128, 256, 512, 1024)
# Tokens of a step group: a whole number of sequences of any tier.
STEP_TOKENS = 64 * 1024
# The id after each document, and the vocabulary's one special token.
END = 0
SPECIAL = {"<|endoftext|>": 50256}
# Tokens that a task gathers before it packs them.
BUFFER = 1 << 20


@lru_cache(maxsize=2)
def _coder(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(
        "packing",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=ranks_of(path),
        special_tokens=SPECIAL,
    )


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of a text and the id that ends it. A long text is encoded word run by word run."""
    coder = _coder(path)
    ids: list[int] = []
    if len(text) > CHUNK:
        for start, stop in _runs(text):
            ids += coder.encode(text[start:stop], allowed_special="all")
    else:
        ids = coder.encode(text, allowed_special="all")
    ids.append(END)
    return np.array(ids, np.dtype("<u4"))


def _runs(text: str):
    """Stretches of a text that start where a pre-token does in every reading."""
    start = 0
    for _, cut in chunks(text):
        if cut < len(text):
            cut = RESYNC.search(text, cut).start() + 1
        yield start, cut
        start = cut


class Packer:
    """Fills windows of the tiers with pieces of documents; holds what is not yet packed.

    A document longer than the longest window gives full windows first. What is
    left of every document opens a window of the smallest tier that holds it. The gap is filled
    from shorter documents, the longest that fits first; where none fits, a
    longer one is cut to fit. So every window is full. What no longer fills one
    at the end of a task goes to windows of smaller powers of two.
    """

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tiers
        self.pool: list[tuple[int, int, int]] = []  # (length, document, start), sorted
        self.placed: list[tuple[int, int, int, int, int, int]] = []
        self.count = dict.fromkeys(tiers, 0)
        self.sequences = 0

    def add(self, document: int, length: int) -> None:
        longest, start = self.tiers[-1], 0
        while length - start >= longest:
            self._emit([(longest, document, start)], longest)
            start += longest
        if length > start:
            insort(self.pool, (length - start, document, start))

    def _emit(self, pieces: list[tuple[int, int, int]], size: int) -> None:
        offset, rank = 0, self.count.get(size, 0)
        self.count[size] = rank + 1
        for length, document, start in pieces:
            self.placed.append((document, start, length, self.sequences, offset, size, rank))
            offset += length
        self.sequences += 1

    def pack(self, last: bool) -> None:
        pool = self.pool
        while pool:
            pieces = [pool.pop()]
            size = next(t for t in self.tiers if t >= pieces[0][0])
            gap = size - pieces[0][0]
            while gap and pool:
                i = bisect_right(pool, (gap + 1,)) - 1
                length, document, start = pool.pop(max(i, 0))
                if length > gap:
                    insort(pool, (length - gap, document, start + gap))
                    length = gap
                pieces.append((length, document, start))
                gap -= length
            if not gap:
                self._emit(pieces, size)
            elif last:
                self._rest(pieces, size - gap)
            else:
                for piece in pieces:
                    insort(pool, piece)
                return

    def _rest(self, pieces: list[tuple[int, int, int]], total: int) -> None:
        """Windows of the powers of two that make up ``total``."""
        pieces = pieces[::-1]
        for bit in reversed(range(total.bit_length())):
            need, own = total & 1 << bit, []
            while need:
                length, document, start = pieces.pop()
                if length > need:
                    pieces.append((length - need, document, start + need))
                    length = need
                own.append((length, document, start))
                need -= length
            if own:
                self._emit(own, 1 << bit)


def packed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents, packed: one row per piece, with its place and step group.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier,
    step_group), and the piece's ``ids`` as binary if asked for. A document is its token ids and the
    id 0; each id lies in one piece. Sequences are as long as their tier and full; a
    task's last few have lengths of smaller powers of two. Step groups of one tier hold
    equally many tokens each (the last may hold fewer); they are numbered by tier.

    Every task packs the documents that it reads, in batches of bounded size:
    nothing is shuffled, and no document, source or group of copies gathers in one
    task. Null and empty texts are the id 0 alone. Repeated rows and rows without an id are
    documents of their own. An empty table gives no rows; other columns of
    ``docs`` are not looked at.
    """
    path = path or public_tokenizers.path(RANKS)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("bigint"), text)

    def step(batches):
        task = TaskContext.get().partitionId()
        packer, ids, names, held = Packer(tiers), {}, {}, 0

        def out():
            done, packer.placed = packer.placed, []
            own = [ids[d][s : s + n].tobytes() for d, s, n, *_ in done]
            batch = rows(
                doc_id=pa.array([names[p[0]] for p in done], pa.int64()),
                start=pa.array([p[1] for p in done], pa.int64()),
                length=pa.array([p[2] for p in done], pa.int64()),
                ids_crc32=pa.array([zlib.crc32(b) for b in own], pa.int64()),
                doc_tokens=pa.array([len(ids[p[0]]) for p in done], pa.int64()),
                sequence_id=pa.array([task << 40 | p[3] for p in done], pa.int64()),
                offset=pa.array([p[4] for p in done], pa.int64()),
                tier=pa.array([p[5] for p in done], pa.int64()),
                task=pa.array([task] * len(done), pa.int64()),
                rank=pa.array([p[6] for p in done], pa.int64()),
                **({"ids": pa.array(own, pa.binary())} if with_ids else {}),
            )
            waiting = {p[1] for p in packer.pool}
            for d in ids.keys() - waiting:
                del ids[d], names[d]
            return batch

        n = 0
        for batch in batches:
            for name, text in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True
            ):
                ids[n], names[n] = token_ids(text, path), name
                packer.add(n, len(ids[n]))
                held += len(ids[n])
                n += 1
                if held >= BUFFER:
                    packer.pack(last=False)
                    yield out()
                    held = 0
        packer.pack(last=True)
        yield out()

    pieces = stored(
        map_batches(
            base,
            step,
            "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint,"
            " sequence_id bigint, offset bigint, tier bigint, task bigint, rank bigint"
            + (", ids binary" if with_ids else ""),
        ),
        "pieces",
    )
    return _in_steps(pieces)


def _in_steps(pieces: DataFrame) -> DataFrame:
    """Number the sequences of each tier through all tasks, and group them by tokens.

    Counts are per task and tier: a few rows per task, whatever the documents.
    """
    counts = pieces.groupBy("tier", "task").agg((F.max("rank") + 1).alias("n"))
    before = W.partitionBy("tier").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select(
        F.col("tier").alias("_tier"),
        F.col("task").alias("_task"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"),
    ).hint("rebalance")
    joined = pieces.join(first, (F.col("tier") == F.col("_tier")) & (F.col("task") == F.col("_task")))
    group = F.floor((F.col("_first") + F.col("rank")) * F.col("tier") / STEP_TOKENS)
    return joined.withColumn("step_group", group.cast("bigint")).drop(
        "task", "rank", "_tier", "_task", "_first"
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 1024 tokens."""
    return packed(table(spark, sf_dir, "documents"))
