"""Near-duplicate texts by SimHash and meet-in-the-middle ball hashing."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm.common import map_batches, rows, signed, stored, table, utf8
from metricloom.llm.graph import components

# Shingle width, hash seed and the largest distance of a link.
SHINGLE = 4
SEED = 42
DISTANCE = 4
# Hashes whose bits are unpacked at a time; bounds the memory of a long text.
BLOCK = 1 << 14
# Neighbours that a fingerprint is compared with in the screen.
NEAR = 16

_ONE = np.uint64(1)
_BITS = _ONE << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text; 0 if it has no word."""
    words = _words(text)
    if not words:
        return 0
    hashes = _hashes(words, shingle)
    last = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, last, BLOCK):
        bits = hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BITS[2 * ones > last].sum(dtype=np.uint64))


def _words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []  # bytes: only A-Z, only ASCII white space


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """Hash of each shingle of at least one word; fewer words than a shingle has are one."""
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(1, len(words) - shingle + 1)
    tails = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (
            digest(joined[a:b], SEED)
            for a, b in zip(starts[:last].tolist(), tails.tolist(), strict=True)
        ),
        np.uint64,
        last,
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a BIGINT. A null text has no words."""

    def step(batches):
        for batch in batches:
            values = np.array([fingerprint(t) for t in utf8(batch.column(1))], np.uint64)
            yield rows(doc_id=batch.column(0), fp=signed(values))

    return map_batches(
        docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")),
        step,
        "doc_id bigint, fp bigint",
    )


def ball(values: np.ndarray, bits: int, radius: int) -> np.ndarray:
    """All variants of each value that differ from it in at most ``radius`` of its low ``bits``."""
    masks = np.zeros(1, np.uint64)
    singles = _BITS[:bits]
    ring = masks
    for _ in range(radius):
        # A new bit above the highest one set: each mask is made once.
        ring = np.concatenate([m | singles[singles > m] for m in ring])
        masks = np.concatenate([masks, ring])
    return values[:, None] ^ masks[None, :]


def _variants(prints: DataFrame, balls) -> DataFrame:
    """(variant, fp): each fingerprint with every key that ``balls`` gives for it."""

    def step(batches):
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(values), 256):
                own = values[at : at + 256]
                keys = balls(own)
                yield rows(
                    variant=signed(keys.ravel()), fp=signed(np.repeat(own, keys.shape[1]))
                )

    return map_batches(prints.select("fp"), step, "variant bigint, fp bigint")


def _half_balls(values: np.ndarray) -> np.ndarray:
    """Balls of half the radius around each half; the half stands in bit 32 of the key."""
    low = ball(values & np.uint64(0xFFFFFFFF), 32, DISTANCE // 4)
    high = ball(values >> np.uint64(32), 32, DISTANCE // 4) | np.uint64(1 << 32)
    return np.concatenate([low, high], axis=1)


def _full_balls(values: np.ndarray) -> np.ndarray:
    return ball(values, 64, DISTANCE // 2)


def _collisions(variants: DataFrame) -> DataFrame:
    """(a, b): each fingerprint with the smallest one of the same variant, where they differ.

    A star instead of all pairs, so a group's output is as long as the group.
    The rows come sorted by Spark, which spills; the pass over them holds one
    variant's smallest fingerprint and nothing else.
    """

    def step(batches):
        key = low = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            opens = np.concatenate([[keys[0] != key], keys[1:] != keys[:-1]])
            at = np.maximum.accumulate(np.where(opens, np.arange(len(keys)), -1))
            lows = np.where(at < 0, prints[0] if low is None else low, prints[at])
            key, low = keys[-1], lows[-1]
            differ = lows != prints
            pairs = np.unique(np.stack([prints[differ], lows[differ]], 1), axis=0)
            yield rows(a=pairs[:, 0].copy(), b=pairs[:, 1].copy())

    dealt = variants.repartition("variant").sortWithinPartitions("variant", "fp")
    return map_batches(dealt, step, "a bigint, b bigint").distinct()


def _close(variants: DataFrame) -> DataFrame:
    """(fp,) of fingerprints that may have a link, from keys that linked ones share.

    Within a key each fingerprint is compared with its NEAR neighbours before it
    in order. In a group of up to NEAR + 1 that is every pair, and only those in
    distance stay; in a larger one those with a row further off stay unseen.
    """

    def step(batches):
        keys, prints = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            prints = np.concatenate([prints, batch.column(1).to_numpy()])
            own = np.zeros(len(keys), bool)
            for back in range(1, min(NEAR + 2, len(keys))):
                same = keys[back:] == keys[:-back]
                if back <= NEAR:
                    differing = np.bitwise_count((prints[back:] ^ prints[:-back]).view(np.uint64))
                    same &= differing <= DISTANCE
                own[back:] |= same
                own[:-back] |= same
            yield rows(fp=np.unique(prints[own]))
            keys, prints = keys[-NEAR - 1 :], prints[-NEAR - 1 :]

    dealt = variants.repartition("variant").sortWithinPartitions("variant", "fp")
    return map_batches(dealt, step, "fp bigint").distinct()


def links(prints: DataFrame) -> DataFrame:
    """(a, b) of fingerprints at distance 1 to 4 whose components are those of all such pairs.

    ``prints`` holds distinct fingerprints ``fp``. Two of them are within 4 bits
    of each other exactly if their balls of radius 2 share a variant: variants
    of 64 bits give neither false nor missing links, and a group needs a star
    only. A full ball has 2081 variants, so a screen by the same idea goes
    first: of two fingerprints within 4 bits, one pair of halves is within 2
    bits, and the balls of radius 1 of those halves share one of 66 keys.
    Fingerprints that cannot have a link by that emit no full ball.
    """
    close = stored(_close(_variants(prints, _half_balls)), "close").hint("rebalance")
    found = _collisions(_variants(close, _full_balls))
    return found.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    Rows whose fingerprints differ in at most 4 bits are linked; a component is
    named by its smallest id. Null and empty texts, and texts of white space,
    have fingerprint 0 and are linked like any other. Repeated rows each give a
    row. A row without an id is linked too, but never names a component unless
    no row of it has an id (then null). An empty table gives no rows; other
    columns of ``docs`` are not looked at.
    """
    of_docs = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    prints = stored(of_docs.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "prints")
    groups = stored(components(links(prints.select("fp")).select("a", "b")), "components")
    named = (
        prints.join(groups, prints["fp"] == groups["node"], "left")
        .select("fp", "first_doc", F.coalesce("component", "fp").alias("component"))
    )
    # The rebalances let adaptive execution split the joins on a hot component or text.
    roots = (
        named.groupBy(F.col("component").alias("root"))
        .agg(F.min("first_doc").alias("component_id"))
        .hint("rebalance")
    )
    labels = stored(
        named.join(roots, named["component"] == roots["root"]).select("fp", "component_id"),
        "labels",
    )
    return of_docs.join(labels, "fp").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Returns the columns of ``docs``. Rows that repeat the kept id stay as they
    are; rows without an id stay only in groups where no row has one.
    """
    labels = near_duplicates(docs)
    keep = labels.filter("doc_id <=> component_id").select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["_keep"]), "left_semi")
