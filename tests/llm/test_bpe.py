"""op10: ids and decoded bytes against the tiktoken library."""

import random

import numpy as np
import public_tokenizers
import tiktoken

from metricloom.llm import bpe

DOCS = "doc_id long, text string, ids int, row string"


def library():
    path = public_tokenizers.path(bpe.RANKS)
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(path), special_tokens={}
    )


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS)
    found = bpe.decode(bpe.encode(docs)).collect()
    own = library()
    expected = [(i, own.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    as_ids = [
        (r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.bytes)) for r in found
    ]
    assert sorted(as_ids, key=repr) == sorted(expected, key=repr)


def prose(rng, n):
    out = []
    for _ in range(n):
        out.append("".join(rng.choices("abcdeéüXYZ0123456789'.,-!", k=rng.randint(1, 9))))
        out.append(rng.choice([" ", " ", " ", " ", "  ", "\n", "\n\n", "   \t", "'s ", "", " "]))
    return "".join(out)


def test_short_texts(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(60)]
    texts += [None, "", " ", "\n\n\n", "x", "  two  spaces ", "it's we'll I'd they've", "<|endoftext|>"]
    texts += ["日本語 テキスト", "عربى", "\U0001f600\U0001f600 a", "a" * 500, "=" * 300 + "ab" * 200]
    rows = list(enumerate(texts)) + [(None, "no id"), (None, None), (3, "twice"), (3, "twice")]
    check(spark, rows)


def test_long_texts_meet_in_the_overlap(spark):
    rng = random.Random(2)
    texts = [prose(rng, n) for n in (5000, 9000, 20000)]
    texts += ["word " * 30000, "a" * 60000, " " * 40000 + "x", "x" + "\n" * 40000 + "y z" * 20000]
    texts += ["q" * 40000 + " then some words " * 3000, "ab " * 5461 + "c" * 30000 + " d e f" * 9000]
    texts += [prose(rng, 5000)] * 2
    check(spark, list(enumerate(texts)) + [(1, texts[0]), (None, texts[1])])


def test_chunks_cover_the_text():
    rng = random.Random(3)
    text = prose(rng, 30000)
    cuts = list(bpe.chunks(text))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and len(cuts) > 5
    assert all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))  # noqa: B905


def test_empty_table(spark):
    check(spark, [])


def test_long_pieces_merge_alike():
    rng = random.Random(4)
    ranks = bpe.ranks_of(public_tokenizers.path(bpe.RANKS))
    for _ in range(200):
        piece = "".join(rng.choices("aabcdeorstin", k=rng.randint(2, 200))).encode()
        assert bpe._merged_short(piece, ranks) == bpe._merged_long(piece, ranks)
