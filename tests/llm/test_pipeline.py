"""The pipeline: each stage on what the one before it kept, columns, and edge cases."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from metricloom.llm import pii
from metricloom.llm.packing import END
from metricloom.llm.repeats import documents_without_repeats
from tests.llm import test_packing, test_pii, test_repeats, test_simhash, test_toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(rows):
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]


@pytest.fixture
def corpus(spark, tmp_path):
    """Toxic texts, near copies, shared passages and personal data, on disk."""
    rng = random.Random(1)
    texts, labels = test_toxicity.corpus(200)
    rows = list(texts)
    base = " ".join(f"w{rng.randrange(999)}" for _ in range(300))
    rows += [(1000 + i, base + f" tail{i}") for i in range(4)]
    passage = " ".join(f"p{rng.randrange(999)}" for _ in range(80))
    rows += [
        (2000 + i, " ".join(f"v{rng.randrange(9999)}" for _ in range(60)) + " " + passage)
        for i in range(3)
    ]
    rows += [(3000, "mail bob@example.org or 1.2.3.4 é"), (3001, None), (3002, "")]
    spark.createDataFrame(documents(rows), COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    return str(tmp_path), rows, labels


def test_stages_take_effect(spark, corpus):
    sf_dir, rows, labels = corpus
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == columns
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in seen[name].values())
    toxic = {i for i, _, x in labels if x}
    kept = set(seen["toxicity"])
    assert len(toxic - kept) > 0.9 * len(toxic) and len(kept - toxic) > 0.95 * (len(rows) - len(toxic))
    copies = [i for i in seen["near_duplicates"] if 1000 <= i < 1004]
    assert copies == [1000]
    text = {i: r.text for i, r in seen["repeated_passages"].items()}
    assert all(len(text[2000 + i]) < 500 for i in range(3)) and text[3001] is None
    assert seen["personal_data"][3000].text == "mail <EMAIL> or <IP> é"
    assert set(seen["packing"]) == set(seen["personal_data"])


def test_each_stage_equals_a_plain_version_on_its_input(spark, corpus):
    sf_dir, rows, labels = corpus
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text, after = [rows], {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
        after[name] = docs
        if name != "packing":
            text.append(sorted((r.doc_id, r.text) for r in docs.collect()))
    start, clean, single, cut, safe = text
    scores = test_toxicity.plain_scores(start, labels)
    assert clean == sorted(row for row, score in zip(start, scores, strict=True) if score < 0.5)
    roots = test_simhash.brute(clean)  # (doc_id, fingerprint, component)
    assert [i for i, _ in single] == sorted({r[2] for r in roots})
    assert set(single) <= set(clean)
    kept = {i: left.decode(errors="ignore") for i, *_, left in test_repeats.brute(single)}
    assert cut == [(i, None if t is None else kept[i]) for i, t in single]
    crf = pii.model()
    for (i, old), (j, new) in zip(cut, safe, strict=True):
        assert i == j
        spans = pii.find_all([old], crf)[0]
        assert [s[:3] for s in spans if s[3]] == test_pii.plain(old or "")
        left, at = [], 0
        for start_, kind, end, _ in spans:
            if start_ >= at:
                left += [old[at:start_], f"<{pii.KINDS[kind].upper()}>"]
            at = max(at, end)
        assert new == (old if not spans else "".join(left) + old[at:])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: b"" for i, _ in safe}
    for r in sorted(after["packing"].collect(), key=lambda r: (r.doc_id, r.start)):
        ids[r.doc_id] += bytes(r.ids)
    for i, t in safe:
        assert np.frombuffer(ids[i], "<u4").tolist() == test_packing.ids_of(library, t)


def test_run_equals_the_stages(spark, corpus):
    sf_dir, *_ = corpus
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert sum(r.length for r in pieces if r.start == 0) > 0 and END == 0
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]


def test_rows_hold_the_token_ids(spark, corpus):
    pieces = corpus_pipeline.run(spark, corpus[0]).collect()
    assert pieces and all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in pieces)


def test_texts_without_repeats_keep_other_columns(spark):
    rng = random.Random(2)
    shared = test_repeats.prose(rng, 60)
    rows = [(1, shared + "é"), (2, "x " + shared), (2, "x " + shared), (None, shared), (4, None), (5, "")]
    schema = COLUMNS + ", key_id int, row string, spans int"
    docs = spark.createDataFrame([(*d, 7, "r", 9) for d in documents(rows)], schema)
    out = documents_without_repeats(docs)
    assert out.columns == docs.columns
    brute = {i: kept.decode(errors="ignore") for i, *_, kept in test_repeats.brute(rows)}
    found = out.collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.text == (None if r.doc_id == 4 else brute[r.doc_id])
        assert (r.key_id, r.row, r.spans) == (7, "r", 9)
    assert documents_without_repeats(docs.limit(0)).count() == 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
