"""Byte-level BPE encoding and decoding of texts, long ones in overlapping chunks."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm.common import map_batches, rows, table

RANKS = "byte_bpe_50k.tiktoken"
# Code points of a chunk and of what it shares with the next one. The margin
# is more than any pre-token's end looks ahead.
CHUNK = 1 << 14
OVERLAP = 1 << 10
MARGIN = 16
# Pieces whose ids a worker remembers.
CACHE = 1 << 18
# Between two words a single space always opens a pre-token, whatever came before.
RESYNC = re.compile(r"\S \S")


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    """Rank of every token, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=2)
def pattern_of(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def _merged_short(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Merge the pair of the lowest rank, the leftmost of equals, until none is known."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = len(ranks) + 256
    pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905
    while pairs and (low := min(pairs)) < none:
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
    return tuple(ranks[p] for p in parts)


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same with a heap, for pieces where scanning all pairs again would be quadratic."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two parts has changed since
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (left := before[i]) >= 0 and (r := ranks.get(piece[left:stop])) is not None:
            heapq.heappush(heap, (r, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return tuple(out)


class Encoder:
    """Ids of pre-tokens, each encoded on its own; remembers the ones it has seen."""

    def __init__(self, path: str, pattern: str):
        self.ranks = ranks_of(path)
        self.split = pattern_of(pattern).findall
        self.seen: dict[str, tuple[int, ...]] = {}

    def _ids(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        if (rank := self.ranks.get(data)) is not None:
            return (rank,)
        return (_merged_short if len(data) < 128 else _merged_long)(data, self.ranks)

    def encode(self, pieces: list[str]) -> list[tuple[int, ...]]:
        out = list(map(self.seen.get, pieces))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    piece = pieces[i]
                    if (ids := self.seen.get(piece)) is None:
                        ids = self._ids(piece)
                        if len(self.seen) >= CACHE:
                            self.seen.clear()
                        if len(piece) < 64:
                            self.seen[piece] = ids
                    out[i] = ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _flat(ids: list[tuple[int, ...]]) -> bytes:
    return np.fromiter(chain.from_iterable(ids), np.dtype("<u4")).tobytes()


def chunks(text: str) -> Iterator[tuple[int, int]]:
    """(start, next start) of the chunks of a text.

    A cut stands only where the overlap behind it holds two words with one space
    between them. There the next pre-token starts in every reading of the text,
    so readings from both sides meet within the overlap. A longer stretch
    without such a place stays in one chunk.
    """
    start = 0
    while len(text) - start > CHUNK + OVERLAP:
        cut = start + CHUNK
        place = RESYNC.search(text, cut, len(text) - MARGIN)
        if place is None:
            break
        cut = max(cut, place.start() - OVERLAP + 4)
        yield start, cut
        start = cut
    yield start, len(text)


def _boundaries(pieces: list[str]) -> np.ndarray:
    """Offset of every pre-token, and the end."""
    return np.concatenate([[0], np.cumsum(list(map(len, pieces)), dtype=np.int64)])


def encode_chunk(coder: Encoder, part: str, length: int) -> tuple[bytes, list[int], list[int], int]:
    """Encode a chunk with its overlap, up to where the next chunk's reading takes over.

    Returns the ids; the offsets of pre-tokens near the start with the number of
    ids before each, so that the chunk before can say where to begin; and the
    offset into the next chunk where the two readings meet.
    """
    pieces = coder.split(part)
    starts = _boundaries(pieces)
    meet = 0
    if length < len(part):
        other = _boundaries(coder.split(part[length:])) + length
        meet = int(np.intersect1d(starts[starts >= length], other)[0])
        pieces = pieces[: int(np.searchsorted(starts, meet))]
    ids = coder.encode(pieces)
    near = int(np.searchsorted(starts[: len(pieces)], OVERLAP + MARGIN))
    counts = np.concatenate([[0], np.cumsum([len(i) for i in ids[:near]], dtype=np.int64)])[:near]
    return _flat(ids), starts[:near].tolist(), counts.tolist(), max(0, meet - length)


def _cut(long: DataFrame) -> DataFrame:
    """One row per chunk of each long text, with the overlap and its own length."""

    def step(batches):
        for batch in batches:
            own, number, part, length = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for n, (start, stop) in enumerate(chunks(text)):
                    own.append(i)
                    number.append(n)
                    part.append(text[start : stop + OVERLAP + MARGIN])
                    length.append(stop - start)
            own = pa.array(own, pa.int64())
            yield rows(
                row=batch.column(0).take(own),
                doc_id=batch.column(1).take(own),
                number=pa.array(number, pa.int64()),
                part=pa.array(part, pa.string()),
                length=pa.array(length, pa.int64()),
            )

    return map_batches(
        long, step, "row bigint, doc_id bigint, number bigint, part string, length bigint"
    )


def _encoded_chunks(parts: DataFrame, path: str, pattern: str) -> DataFrame:
    def step(batches):
        coder = encoder(path, pattern)
        for batch in batches:
            done = [
                encode_chunk(coder, p, n)
                for p, n in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
            ]
            yield rows(
                row=batch.column(0),
                doc_id=batch.column(1),
                number=batch.column(2),
                ids=pa.array([d[0] for d in done], pa.binary()),
                offsets=pa.array([d[1] for d in done], pa.list_(pa.int64())),
                counts=pa.array([d[2] for d in done], pa.list_(pa.int64())),
                meet=pa.array([d[3] for d in done], pa.int64()),
            )

    return map_batches(
        parts,
        step,
        "row bigint, doc_id bigint, number bigint, ids binary, offsets array<bigint>,"
        " counts array<bigint>, meet bigint",
    )


def _stitched(encoded: DataFrame) -> DataFrame:
    """The ids of each long text: of every chunk from where the one before it hands over."""
    whole = encoded.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.sort_array(F.collect_list(F.struct("number", "ids", "offsets", "counts", "meet"))).alias(
            "chunks"
        ),
    )
    # How many ids to skip: those before the place that the chunk before names.
    place = lambda c, i: F.array_position(
        c["offsets"], F.element_at(F.col("chunks"), i)["meet"]
    )
    own = F.transform(
        "chunks",
        lambda c, i: F.when(i == 0, c["ids"]).otherwise(
            F.substring(
                c["ids"],
                F.element_at(c["counts"], place(c, i).cast("int")).cast("int") * 4 + 1,
                F.length(c["ids"]),
            )
        ),
    )

    def step(batches):
        for batch in batches:
            joined = [b"".join(parts) for parts in batch.column(1).to_pylist()]
            yield rows(doc_id=batch.column(0), ids=pa.array(joined, pa.binary()))

    return map_batches(whole.select("doc_id", own.alias("parts")), step, "doc_id bigint, ids binary")


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """(doc_id, ids) of every row: token ids as little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is encoded on its own by the ranks in the file
    ``path``, which every executor has under that name; no token is special. Texts
    longer than a chunk are cut into overlapping chunks that are dealt out, pre-tokenised
    and encoded in parallel, and stitched where the readings of two chunks meet.
    Null and empty texts have no ids. Repeated rows and rows without an id each give
    a row; an empty table gives none; other columns of ``docs`` are not looked at.
    """
    path = path or public_tokenizers.path(RANKS)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))

    def step(batches):
        coder = encoder(path, pattern)
        for batch in batches:
            ids = [_flat(coder.encode(coder.split(t))) for t in batch.column(1).to_pylist()]
            yield rows(doc_id=batch.column(0), ids=pa.array(ids, pa.binary()))

    is_long = F.length("text") > CHUNK + OVERLAP
    short = map_batches(base.filter(~is_long), step, "doc_id bigint, ids binary")
    long = base.filter(is_long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = _cut(long).hint("rebalance")
    return short.unionByName(_stitched(_encoded_chunks(parts, path, pattern)))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, bytes): the raw bytes of the tokens, one after the other."""
    path = path or public_tokenizers.path(RANKS)

    def step(batches):
        token = {rank: data for data, rank in ranks_of(path).items()}.__getitem__
        for batch in batches:
            out = [
                b"".join(map(token, np.frombuffer(ids, np.dtype("<u4")).tolist()))
                for ids in batch.column(1).to_pylist()
            ]
            yield rows(doc_id=batch.column(0), ids=batch.column(1), bytes=pa.array(out, pa.binary()))

    return map_batches(
        encoded.select("doc_id", "ids"), step, "doc_id bigint, ids binary, bytes binary"
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to."""
    return decode(encode(table(spark, sf_dir, "documents"))).select(
        "doc_id",
        F.expr("CAST(length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
