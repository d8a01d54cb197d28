"""op3: counts against a plain version; the order of rules changes no verdict."""

import random
import re
from collections import Counter

from metricloom.llm import quality

DOCS = "doc_id long, text string, words int, kept string, place_bits long"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    n = len(words)
    return (
        n,
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
        n < 50 or 100 * len(covered) > 50 * n,
    )


def texts():
    rng = random.Random(3)
    few, many = [f"w{i}" for i in range(6)], [f"word{i}" for i in range(5000)]
    out = [" ".join(rng.choices(few, k=rng.randint(0, 80))) for _ in range(30)]
    out += [" ".join(rng.choices(many, k=rng.randint(40, 200))) for _ in range(20)]
    out += ["\n".join(rng.choices(["a b c", "d e", "", " \t", "f # $"], k=60)) for _ in range(10)]
    out += [None, "", " \n\t", "x", "a b", "a b c", "a b c a b c", "é ü ß " * 30, "same " * 60]
    out += ["GO!! " * 80, "a %%% b ### " * 30, " ".join(many) * 4, "x" * 100_000, "\x0b\x0c\r a"]
    return out


def test_counts_equal_a_plain_version(spark):
    rows = [(i, t, 1, "k", 2) for i, t in enumerate(texts())]
    rows += [(None, "no id", 1, "k", 2), (3, rows[3][1], 1, "k", 2)]
    found = quality.judged(spark.createDataFrame(rows, DOCS)).collect()
    as_tuples = [
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        for r in found
    ]
    assert sorted(as_tuples, key=repr) == sorted(((r[0], *plain(r[1])) for r in rows), key=repr)
    assert all((r.first_failed == "base") == r.base_failed for r in found)
    assert all(r.kept == (r.first_failed is None) for r in found)


def test_order_of_rules_changes_no_verdict(spark, monkeypatch):
    rows = [(i, t, 1, "k", 2) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, DOCS)
    verdicts = set()
    for order in (quality.RULES, quality.RULES[::-1]):
        monkeypatch.setattr(quality, "cascade", lambda docs, rules, order=order: order)
        verdicts.add(tuple(sorted((r.doc_id, r.kept) for r in quality.judged(docs).collect())))
    assert len(verdicts) == 1


def test_cascade_orders_by_rejection_per_cost(spark):
    rng = random.Random(9)
    texts = [
        " ".join("".join(rng.choices("abcdefgh", k=6)) + "!!" for _ in range(90)) for _ in range(50)
    ]
    docs = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in enumerate(texts)], DOCS)
    order = quality.cascade(docs.select("doc_id", "text"))
    assert set(order) == set(quality.RULES) and order[0].name == "shouting"


def test_empty_table_and_native_plan(spark):
    docs = spark.createDataFrame([], DOCS)
    assert quality.judged(docs).count() == 0
    plan = quality.judged(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
