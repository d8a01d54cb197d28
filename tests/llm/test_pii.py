"""op5: fixed patterns against plain searches; the model on sentences it has not seen."""

import hashlib
import random
import re

from metricloom.llm import pii

DOCS = "doc_id long, text string, spans int, kind string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    out = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, m.end()))
    return sorted(out)


def noise(rng, n):
    alphabet = ["a", "Z", "é", "9", "0", "1", "25", ".", "-", " ", "@", "+", "(", ")", "\n", "_", "٣"]
    known = ["a.b@c.d", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (909) 555-2931", "@@", "x@y@z.w"]
    return "".join(rng.choices(alphabet + known, k=n))


def test_fixed_patterns_equal_plain_searches():
    rng = random.Random(5)
    for _ in range(3000):
        text = noise(rng, rng.randint(0, 40))
        assert [(a, k, b) for a, k, b, _ in pii.base_spans(text)] == plain(text), text


def test_thousands_of_digits_end_nothing(spark):
    many = ["0" * 5000, "1" * 5000]
    texts = [t.format(d) for d in many for t in (
        "1.2.3.{}", "{}.2.3.4 x", "host {}.1.1.1 down", "call +{} now", "card {} 4111 1111 1111 1111", "a@{}.{}",
        "server 1.2.3.{}: in 3 ms", "{}",
    ) if t.count("{}") == 1] + ["a@" + "1" * 5000 + ".b", "ip 1.2.3." + "0" * 5000 + "7"]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], DOCS)
    found = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans if s.base]
             for r in pii.find_personal_data(docs).collect()}
    assert len(found) == len(texts)
    assert found[0] == [("ip", texts[0])] and found[len(texts) - 1] == [("ip", texts[-1][3:])]
    assert [k for k, _ in found[texts.index("1.2.3." + "1" * 5000)]] == []


def test_query_rows(spark):
    rng = random.Random(6)
    texts = [noise(rng, 30) for _ in range(50)] + [None, "", "no data", "x" * 9000, "1" * 3000]
    texts += ["é bob@x.org é\n" * 900, "1 2 3 4 5 " * 400]
    rows = list(enumerate(texts)) + [(None, "a@b.cd"), (None, None), (1, texts[1])]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], DOCS)
    found = pii.find_personal_data(docs).collect()
    assert sorted(map(repr, (r.doc_id for r in found))) == sorted(repr(r[0]) for r in rows)
    by_id = {r.doc_id: r.spans for r in found if r.doc_id is not None}
    for i, text in enumerate(texts):
        own = [(s.start, pii.KINDS.index(s.kind), s.end) for s in by_id[i] if s.base]
        assert own == plain(text or "")
        added = [(s.start, s.end) for s in by_id[i] if not s.base]
        assert all(b <= x or a >= y for x, y in added for a, _, b in own)
    assert spark.createDataFrame([], DOCS).transform(pii.find_personal_data).count() == 0


def test_digest_columns(spark, tmp_path):
    text = "é a@b.cd, 1.2.3.4 and +1 (909) 555-2931; call 212-555-0147"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    rows = {r.doc_id: r for r in pii.op5_crf(spark, str(tmp_path)).collect()}
    base = "email:2:8,ip:10:17,phone:22:39"
    assert rows[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert rows[1].spans == base + ",phone:46:58"
    assert (rows[1].n_email, rows[1].n_ip, rows[1].n_card, rows[1].n_phone) == (1, 1, 0, 1)
    assert rows[2].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[2].spans == ""


def test_model_on_sentences_it_has_not_seen():
    crf = pii.model()
    personal = {
        "You can call 646-555-0102 now": ("phone", "646-555-0102"),
        "tel (305) 555-0170 thanks": ("phone", "(305) 555-0170"),
        "mail eve [at] shop [dot] org please": ("email", "eve [at] shop [dot] org"),
        "host fe80::2bc:1fff:fe10:21 is up": ("ip", "fe80::2bc:1fff:fe10:21"),
        "card 5500.0000.0000.0004 now": ("card", "5500.0000.0000.0004"),
    }
    for text, (kind, span) in personal.items():
        found = [(pii.KINDS[k], text[a:b]) for a, k, b, _ in pii.find_all([text], crf)[0]]
        assert found == [(kind, span)], text
    ordinary = ["In 2021 some 4000 came", "at 10:30 on 2020-01-02", "key=a8f3k2 v 2.4.1", "12 34 56", "p. 1234567"]
    assert pii.find_all(ordinary, crf) == [[]] * len(ordinary)


def test_viterbi_against_every_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    k = len(pii.LABELS)
    crf = pii.Crf({}, np.zeros((0, k)), rng.normal(size=(k, k)))
    scores = [rng.normal(size=(n, k)) for n in (1, 2, 3, 4)]
    for own, path in zip(scores, crf.viterbi(scores), strict=True):
        best = max(
            itertools.product(range(k), repeat=len(own)),
            key=lambda p: sum(own[t, s] for t, s in enumerate(p))
            + sum(crf.transition[a, b] for a, b in zip([0, *p], [*p, 0], strict=True)),
        )
        assert tuple(path) == best


def test_redacted_keeps_columns(spark):
    rows = [(1, "mail a@b.cd now", "en", 15, "x"), (2, None, None, None, None), (3, "", "de", 0, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, spans string")
    out = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert out[1].text == "mail <EMAIL> now" and out[1].n_chars == 16 and out[1].spans == "x"
    assert out[2].text is None and out[2].n_chars is None and out[3].text == ""
