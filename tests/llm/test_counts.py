"""op11: counts against the libraries, and what the cache does."""

import random

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from metricloom.llm import counts
from metricloom.llm.counts import add_misses, known_counts, op11_digest_cache, token_counts, version_of

PATH = public_tokenizers.path(counts.MODEL)
DOCS = "doc_id long, text string, n_tokens string, digest int, version string"


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(3)
    words = ["the", "Über", "naïve", "漢字", "🙂", "<s>", "</s>", "<unk>", "x" * 50, "\n", "\t", " ", "  ", "▁", "a▁b", "\0"]
    out = [None, "", " ", "   ", "a", " a", "a ", "▁a", "a  b", "\n\n", "<0x0A>", "▁", "é", "é"]
    out += ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    out += ["word " * 30000, "漢" * 5000, "x " * 10 + "y" * 3000]
    return out


def test_counts_are_those_of_the_library(spark, model, tmp_path):
    rows = list(enumerate(texts())) + [(None, "without id"), (3, "a"), (3, "a")]
    docs = spark.createDataFrame([(*r, "x", 1, "v") for r in rows], DOCS)
    found = token_counts(docs, f"{tmp_path}/cache")
    assert found.columns == ["doc_id", "n_bytes", "n_tokens"]
    expected = [(i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)


def test_a_text_cut_at_blanks_has_the_same_tokens(model):
    assert counts._cuts_at_blanks(model)
    for text in texts():
        for size in (1, 3, 17):
            parts = counts._parts(text or "", size)
            assert " ".join(parts) == (text or "")
            assert sum(len(model.encode(p)) for p in parts) == len(model.encode(text or ""))


def test_counts_of_the_other_library(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    plain.no_truncation()
    plain.no_padding()
    rows = [r for r in enumerate(texts()) if len(r[1] or "") < 10000]
    docs = spark.createDataFrame([(*r, "x", 1, "v") for r in rows], DOCS)
    found = {r.doc_id: r.n_tokens for r in token_counts(docs, f"{tmp_path}/cache", path).collect()}
    assert found == {i: len(plain.encode(t or "", add_special_tokens=False).ids) for i, t in rows}


def keyed(spark, rows):
    docs = spark.createDataFrame(rows, "text string")
    return docs.select(F.unhex(F.sha2("text", 256)).alias("digest"), "text")


def test_only_distinct_misses_are_encoded(spark, tmp_path):
    cache = f"{tmp_path}/cache"
    assert add_misses(keyed(spark, [("a b",)] * 50 + [("c",)]), cache, PATH) == 2
    assert add_misses(keyed(spark, [("c",), ("d",), ("d",)]), cache, PATH) == 1
    assert add_misses(keyed(spark, [("c",)] * 3), cache, PATH) == 0
    folder = tmp_path / "cache" / f"version={version_of(PATH)}"
    assert len(list(folder.iterdir())) == 2  # a call without a miss leaves no folder
    assert known_counts(spark, cache, PATH).count() == 3


def test_stored_counts_are_used_and_belong_to_a_tokenizer(spark, tmp_path):
    cache = f"{tmp_path}/cache"
    target = f"{cache}/version={version_of(PATH)}/earlier"
    digest = F.unhex(F.sha2(F.lit("known text"), 256)).alias("digest")
    one = spark.range(1).select(digest, F.lit(777).cast("bigint").alias("n_tokens"))
    one.unionByName(one).write.parquet(target)  # the same entry of two runs
    docs = spark.createDataFrame([(1, "known text"), (2, "known▁text"), (3, "new")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, cache).collect()} == {1: 777, 2: 777, 3: 1}
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, cache, other).collect()}[1] == 2


def test_what_a_failed_run_left_is_not_read(spark, tmp_path):
    cache = tmp_path / "cache"
    left = cache / f"version={version_of(PATH)}" / "failed" / "_temporary"
    left.mkdir(parents=True)
    (left / "part-0.parquet").write_bytes(b"half a file")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [r.n_tokens for r in token_counts(docs, str(cache)).collect()] == [1]


def test_empty_table_and_query(spark, tmp_path, model):
    assert token_counts(spark.createDataFrame([], DOCS), f"{tmp_path}/cache").count() == 0
    rows = [(1, "w " * 4200), (2, None), (3, "w " * 4095 + "w")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in op11_digest_cache(spark, str(tmp_path)).collect()}
    assert [found[i].over_limit for i in (1, 2, 3)] == [len(model.encode(t or "")) > 4096 for _, t in rows]
    assert found[3].n_tokens == 4096 and found[2].n_bytes == 0
