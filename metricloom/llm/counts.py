"""Token counts of texts, from a cache of counts by digest."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from metricloom.llm.common import map_batches, path_of, rows, table
from metricloom.session import scratch_path

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
# What stands for a blank in the pieces of a sentencepiece model, by its format.
BLANK = "▁"
# Code points that are encoded at a time where a text may be cut; bounds the memory of a long one.
BLOCK = 1 << 16
# A single blank between two words: no piece reaches over it, see ``_cuts_at_blanks``.
_CUT = re.compile(f"[^ {BLANK}] (?=[^ {BLANK}])")

_ENTRIES = "digest BINARY, n_tokens BIGINT"


def version_of(path: str) -> str:
    """Digest of a tokenizer: of its file and the release of the library that reads it."""
    library = tokenizers if path.endswith(".json") else sentencepiece
    with open(path, "rb") as file:
        own = hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + file.read())
    return own.hexdigest()


def _cuts_at_blanks(model: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether a text may be cut at a blank between two words without changing its tokens.

    So it is where the model keeps the text as it is but for a blank put before
    it, and no piece holds a blank behind another character: then nothing is
    merged across the place, and the blank put before the rest is the one cut out.
    """
    kept = model.normalize("a  b c") == f"{BLANK}a{BLANK * 2}b{BLANK}c"
    pieces = map(model.id_to_piece, range(model.get_piece_size()))
    return kept and not any(BLANK in piece.lstrip(BLANK) for piece in pieces)


def _parts(text: str, size: int) -> list[str]:
    """A text cut at blanks between words, as soon as a part has ``size`` code points."""
    parts, start = [], 0
    while (cut := _CUT.search(text, start + size)) is not None:
        parts.append(text[start : cut.start() + 1])
        start = cut.end()
    return [*parts, text[start:]]


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of tokens of texts, by the library that the file is made for."""
    if path.endswith(".json"):
        coder = tokenizers.Tokenizer.from_file(path)
        coder.no_truncation()
        coder.no_padding()
        return lambda texts: [
            len(e.ids) for e in coder.encode_batch_fast(texts, add_special_tokens=False)
        ]
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = BLOCK if _cuts_at_blanks(model) else None

    def count(texts: list[str]) -> list[int]:
        return [
            sum(len(model.encode(part)) for part in (_parts(t, size) if size else [t]))
            for t in texts
        ]

    return count


def _folder(cache: str, path: str) -> str:
    return f"{cache.rstrip('/')}/version={version_of(path)}"


def known_counts(spark: SparkSession, cache: str, path: str) -> DataFrame:
    """(digest, n_tokens) of a tokenizer's entries, one row per digest.

    Two runs at a time may have added the same digest; both found the same count.
    """
    place, files = path_of(spark, _folder(cache, path))
    files.mkdirs(place)
    entries = (
        spark.read.schema(_ENTRIES).option("recursiveFileLookup", "true").parquet(_folder(cache, path))
    )
    return entries.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def add_misses(docs: DataFrame, cache: str, path: str) -> int:
    """Encode the distinct texts that the cache does not know, append their counts, say how many.

    ``docs`` holds (digest, text). Copies of a text are dropped before anything is
    shuffled. Every call writes a folder of its own, so calls at the same time
    do not disturb each other, and what a lost executor leaves is never read.
    """
    spark = docs.sparkSession
    missing = docs.dropDuplicates(["digest"]).join(known_counts(spark, cache, path), "digest", "left_anti")

    def step(batches):
        count = counter(path)
        for batch in batches:
            yield rows(
                digest=batch.column(0), n_tokens=pa.array(count(batch.column(1).to_pylist()), pa.int64())
            )

    added = Observation()
    entries = map_batches(missing.select("digest", "text"), step, _ENTRIES)
    target = f"{_folder(cache, path)}/{uuid.uuid4().hex}"
    entries.observe(added, F.count(F.lit(1)).alias("rows")).write.parquet(target)
    if not added.get["rows"]:
        place, files = path_of(spark, target)
        files.delete(place, True)
    return added.get["rows"]


def token_counts(
    docs: DataFrame, cache: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row: UTF-8 bytes of the text and its number of tokens.

    ``path`` is a tokenizer's file, which every executor has under that name:
    ``.json`` for tokenizers, ``.model`` for sentencepiece. No special token is
    added, nothing cut off or padded. ``cache`` is a folder that all executors share; it
    keeps counts by the digest of the tokenizer and the digest of the normalised
    text: null as an empty text, and for a sentencepiece model a blank for the sign that
    it writes blanks with, which it does not tell apart. Texts found there are not encoded,
    of the others each distinct one is, once, and its count added.

    Null and empty texts have no tokens. Repeated rows and rows without an id each give a row;
    an empty table gives none; other columns of ``docs`` are not looked at. ``docs`` is read twice
    and has to give the same rows.
    """
    path = path or public_tokenizers.path(MODEL)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    same = text if path.endswith(".json") else F.replace(text, F.lit(BLANK), F.lit(" "))
    keyed = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.unhex(F.sha2(same, 256)).alias("digest"),
        text.alias("text"),
    )
    add_misses(keyed.select("digest", "text"), cache, path)
    # The rebalance lets adaptive execution split the join on a text with many copies.
    known = known_counts(docs.sparkSession, cache, path).hint("rebalance")
    return keyed.drop("text").join(known, "digest", "left").select("doc_id", "n_bytes", "n_tokens")


def op11_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; the cache is a new one, so every distinct text is encoded."""
    found = token_counts(table(spark, sf_dir, "documents"), scratch_path(spark, "token-counts"))
    return found.withColumn("over_limit", F.col("n_tokens") > LIMIT)
