"""op8: pieces against the ids of the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from metricloom.llm.packing import STEP_TOKENS, packed, token_ids
from tests.llm.test_bpe import prose

DOCS = "doc_id long, text string, tier int, offset string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def check(spark, library, rows, parts=3):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS).repartition(parts)
    found = packed(docs, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length > 0
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == {r[0] for r in rows}
    whole = defaultdict(list)
    for i, text in rows:
        whole[i].append(ids_of(library, text))
    for i, own in pieces.items():
        if len(whole[i]) > 1:  # repeated ids: counted together
            assert sum(r.length for r in own) == sum(map(len, whole[i]))
            continue
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))
        assert [x for r in own for x in np.frombuffer(r.ids, "<u4")] == whole[i][0]
        assert {r.doc_tokens for r in own} == {len(whole[i][0])}
    steps = defaultdict(set)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))
        total = sum(r.length for r in own)
        assert total <= 1024 and total.bit_count() == 1  # nothing to pad
        assert {(r.tier, r.step_group) for r in own} == {(total, own[0].step_group)}
        steps[total, own[0].step_group].add(own[0].sequence_id)
    assert all(size * len(own) <= STEP_TOKENS for (size, _), own in steps.items())
    return sequences


def test_every_id_lies_in_one_piece(spark, library):
    rng = random.Random(8)
    texts = [prose(rng, int(2 ** rng.uniform(0, 11))) for _ in range(150)]
    texts += [None, "", " ", "x", "a <|endoftext|> b", "日本語", "word " * 1023, texts[5], texts[5]]
    rows = list(enumerate(texts)) + [(None, "no id"), (3, "twice"), (3, "twice")]
    check(spark, library, rows)


def test_tiers_hold_whole_documents_first(spark, library):
    rows = [(i, "word " * (60 + i)) for i in range(300)]
    sequences = check(spark, library, rows, parts=1)
    assert {s[0].tier for s in sequences.values()} >= {256, 512}


def test_long_texts(spark, library):
    rng = random.Random(9)
    texts = [prose(rng, 20000), "a" * 50000, " " * 30000 + "x y " * 9000, "no spaces" * 4000]
    for text in texts:
        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
        assert token_ids(text, path).tolist() == ids_of(library, text)
    check(spark, library, list(enumerate(texts)))


def test_empty_table(spark):
    assert packed(spark.createDataFrame([], DOCS)).count() == 0


def test_ids_are_those_of_the_tokenizers_library_at_every_code_point(library):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 1 << 16):
        texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} '{chr(c)} x" for c in points[at : at + (1 << 16)]]
        encoded = library.encode_batch_fast(texts, add_special_tokens=False)
        for text, ids in zip(texts, encoded, strict=True):
            assert token_ids(text, path).tolist() == [*ids.ids, 0]
