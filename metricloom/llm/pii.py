"""Personal data: fixed patterns, and a linear-chain CRF over word shapes for other spellings."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm.common import map_batches, rows, table, with_length

# The kinds in the order in which ties are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can't start within a run of digits where its first digit started none.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int, bool]  # start, kind's number, end, of a fixed pattern


def _digits(text: str) -> list[int]:
    return [int(c) for c in _DIGIT.findall(text)]


def _luhn(digits: list[int]) -> bool:
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 12 <= len(digits) <= 19 and _luhn(digits)


def _is_ip(text: str) -> bool:
    # Leading zeros go first: Python makes no number of thousands of digits.
    parts = [p.lstrip("0") or "0" for p in text.split(".")]
    return all(len(p) < 4 and int(p) <= 255 for p in parts)


def _emails(text: str) -> Iterable[tuple[int, int]]:
    """Matches of the email pattern, from each sign outwards: a plain search is quadratic."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and without overlap for each kind."""
    found = [(a, 0, b, True) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for kind, pattern, holds in (
            (1, _IP, _is_ip),
            (2, _CARD, _is_card),
            (3, _PHONE, lambda t: 9 <= len(_DIGIT.findall(t)) <= 15),
        ):
            found += [
                (m.start(), kind, m.end(), True) for m in pattern.finditer(text) if holds(m[0])
            ]
    return sorted(found)


# ---------------------------------------------------------------- model

# The labelled table: sentences whose personal data stands in brackets with its kind.
LABELLED = """
Call me at {phone:555-0143} or {phone:(212) 555-0198} tomorrow .
My phone is {phone:+44 20 7946 0958} , fax {phone:020 7946 0959} .
Phone: {phone:030 901820} and mobile {phone:0171 2345678} please .
Reach the office on {phone:(909) 555-2931} before noon .
tel. {phone:01 42 68 53 00} ou {phone:06.12.34.56.78} le soir .
Tel {phone:212-555-0147} ext 12 or call {phone:1-800-555-0199} .
Ruf an: {phone:089/1234567} bis 18 Uhr .
mobile {phone:07700 900461} home {phone:01632 960983}
Write to {email:anna.li@example.org} or {email:bob [at] example [dot] com} today .
Mail {email:info(at)example.net} for details in 2 days .
Email: {email:k.moreau [at] mail [dot] example [dot] fr} .
contact {email:sales@localhost} about order 77120 .
The server {ip:192.0.2.17} answered , then {ip:2001:db8::8a2e:370:7334} did .
Host {ip:fe80::1ff:fe23:4567:890a} and {ip:198.51.100.4} in 3 ms .
Host {ip:2001:db8:0:1::25} is down , ping {ip:fe80::a00:27ff:fe4e:66a1} failed .
server {ip:2a00:1450::200e} was slow
Card {card:4111 1111 1111 1111} expires 12/27 .
Pay with card {card:5500.0000.0000.0004} or {card:3400/000000/00009} .
Visa {card:4012_8888_8888_1881} was charged 49.90 euro .
In 1998 about 20 people paid 1,299.00 for 3 rooms .
Version 3.10.2 came on 2024-05-17 at 10:45:03 .
See section 4.2.1 , page 118 , lines 12-48 .
Order 20240517 of item 4412-9981 costs 15.00 .
The token a9f3c2e1b4 and key=Zk91mQ0x7 are not shown .
Build 1234567 took 98.6 percent of 4096 MB .
Invoice 2023-000451 , total 1 250 000 dollars .
score 3-2 in 90 minutes , 45000 fans , 11 players .
Chapter 12 ends on p. 345 ; note 6 follows .
ISBN 978-0-306-40615-7 , issue 12 (3) , 1987 .
"x7f9 1b2c 77aa" 10:00 - 11:30 room 101 @home @ 5
1. first 2. second 3. third 10. tenth
From 1914-1918 and 1939-1945 , 52.5200 , 13.4050 .
User id 88213377 , batch 0001 , size 640x480 .
A1 B2 C3 4d5e6f 00:1A:2B:3C:4D:5E 12:30 5 @ 3
"""
LABELS = ("O", *(f"{p}-{k}" for p in "BI" for k in KINDS))
_CUES = {
    "call", "phone", "tel", "fax", "mobile", "mail", "email", "contact", "write", "card", "visa",
    "pay", "server", "host", "ip", "order", "version", "section", "page", "isbn", "id", "total",
}
_WORD = re.compile(r"\S+")
_ACTIVE = re.compile(r"[0-9@]|[\[({](?:at|dot)[\])}]|::")
_SIGN = re.compile(r"^[\[({](?:at|dot)[\])}]$")
# Steps and penalty of the fit.
_STEPS, _RATE, _PENALTY = 120, 0.2, 0.02


def _shape(word: str) -> str:
    return re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "a", word))


@lru_cache(maxsize=1 << 14)
def _features(word: str) -> tuple[str, ...]:
    """What the model sees of a word: its shape, exact and rough, and what it may announce."""
    shape = _shape(word[:64])
    rough = re.sub(r"(.)\1+", r"\1", shape)
    digits = shape.count("9")
    cue = re.sub(r"\W", "", word[:64]).lower()
    return (
        f"shape={shape}" if len(shape) < 20 else "shape=long",
        f"rough={rough}" if len(rough) < 20 else "rough=long",
        f"digits={min(digits, 16)}",
        f"share={4 * digits // max(1, len(shape))}",
        f"signs={''.join(sorted(set(shape) - {'a', '9'}))[:8]}",
        f"marks={min(shape.count('.'), 4)}{min(shape.count(':'), 3)}{'::' in shape}",
        f"cue={cue if cue in _CUES else '-'}",
    )


def _emission_keys(words: list[str], i: int) -> list[str]:
    keys = [f"0{f}" for f in _features(words[i])]
    keys += [f"-{f}" for f in (_features(words[i - 1]) if i else ("edge",))]
    return keys + [f"+{f}" for f in (_features(words[i + 1]) if i + 1 < len(words) else ("edge",))]


def _table() -> list[tuple[list[str], list[int]]]:
    """Words and label numbers of the labelled sentences."""
    out = []
    for line in LABELLED.strip().splitlines():
        words, labels = [], []
        for kind, inner, plain in re.findall(r"\{(\w+):([^}]*)\}|(\S+)", line):
            for n, word in enumerate((inner or plain).split()):
                words.append(word)
                labels.append(LABELS.index(f"{'BI'[n > 0]}-{kind}") if kind else 0)
        out.append((words, labels))
    return out


def _logsumexp(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(values - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Crf:
    """Weights of a linear-chain conditional random field: emissions by feature, transitions."""

    def __init__(self, names: dict[str, int], emission: np.ndarray, transition: np.ndarray):
        self.names, self.emission, self.transition = names, emission, transition

    def emissions(self, words: list[str], at: range) -> np.ndarray:
        """Scores of every label at some words of a text."""
        out = np.zeros((len(at), len(LABELS)))
        for row, i in enumerate(at):
            own = [n for k in _emission_keys(words, i) if (n := self.names.get(k)) is not None]
            out[row] = self.emission[own].sum(axis=0)
        return out

    def viterbi(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of stretches of words; before and after each stretch stands O.

        Stretches of like length go together, one numpy step for a word of each.
        """
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(emissions)
        order = sorted(range(len(emissions)), key=lambda i: len(emissions[i]))
        while order:
            longest = len(emissions[order[-1]])
            part = order[-max(1, (1 << 16) // longest) :]
            del order[-len(part) :]
            length = np.array([len(emissions[i]) for i in part])
            padded = np.zeros((len(part), longest, len(LABELS)))
            for row, i in enumerate(part):
                padded[row, : length[row]] = emissions[i]
            back = np.zeros(padded.shape, np.int8)
            best = self.transition[0] + padded[:, 0]
            final = np.where((length == 1)[:, None], best, 0.0)
            for t in range(1, longest):
                paths = best[:, :, None] + self.transition
                back[:, t] = paths.argmax(axis=1)
                best = paths.max(axis=1) + padded[:, t]
                final = np.where((length == t + 1)[:, None], best, final)
            state = (final + self.transition[:, 0]).argmax(axis=1)
            path = np.zeros((len(part), longest), np.int64)
            for t in range(longest - 1, -1, -1):
                inside = t < length
                path[inside, t] = state[inside]
                state = np.where(inside, back[np.arange(len(part)), t, state], state)
            for row, i in enumerate(part):
                out[i] = path[row, : length[row]]
        return out


def _gradients(emission, transition, scores, labels, mask):
    """Expected label and transition counts of padded sentences under the model."""
    n, longest, k = scores.shape
    alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
    alpha[:, 0] = transition[0] + scores[:, 0]
    for t in range(1, longest):
        new = _logsumexp(alpha[:, t - 1, :, None] + transition, 1) + scores[:, t]
        alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
    beta[:, -1] = transition[:, 0]
    for t in range(longest - 2, -1, -1):
        new = _logsumexp(transition + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(mask[:, t + 1, None], new, transition[:, 0])
    total = _logsumexp(alpha[:, 0] + beta[:, 0], 1)
    marginal = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
    pairs = np.zeros((k, k))
    for t in range(1, longest):
        joint = alpha[:, t - 1, :, None] + transition + (scores[:, t] + beta[:, t])[:, None, :]
        pairs += (np.exp(joint - total[:, None, None]) * mask[:, t, None, None]).sum(axis=0)
    last = mask.sum(axis=1) - 1
    pairs[0] += marginal[:, 0].sum(axis=0)
    pairs[:, 0] += marginal[np.arange(n), last].sum(axis=0)
    return marginal, pairs


def train(sentences: list[tuple[list[str], list[int]]]) -> Crf:
    """Fit by gradient steps on the penalised log-likelihood of the labelled sentences."""
    keys = [[_emission_keys(w, i) for i in range(len(w))] for w, _ in sentences]
    names = {k: n for n, k in enumerate(sorted({k for s in keys for w in s for k in w}))}
    n, longest, k = len(sentences), max(len(w) for w, _ in sentences), len(LABELS)
    used = np.zeros((n, longest, len(names)), np.float32)
    gold, mask = np.zeros((n, longest, k)), np.zeros((n, longest), bool)
    seen = np.zeros((k, k))
    for row, (words, labels) in enumerate(sentences):
        for t, label in enumerate(labels):
            used[row, t, [names[x] for x in keys[row][t]]] = 1
            gold[row, t, label], mask[row, t] = 1, True
        for a, b in zip([0, *labels], [*labels, 0], strict=True):
            seen[a, b] += 1
    emission, transition = np.zeros((len(names), k)), np.zeros((k, k))
    moments = [np.zeros_like(emission), np.zeros_like(transition)]
    for _ in range(_STEPS):
        scores = (used.reshape(n * longest, -1) @ emission).reshape(n, longest, k)
        marginal, pairs = _gradients(emission, transition, scores, gold, mask)
        residual = (gold - marginal).reshape(n * longest, k)
        steps = [
            used.reshape(n * longest, -1).T @ residual - _PENALTY * emission,
            seen - pairs - _PENALTY * transition,
        ]
        for weights, step, moment in zip((emission, transition), steps, moments, strict=True):
            moment += step**2
            weights += _RATE * step / np.sqrt(moment + 1e-8)
    return Crf(names, emission, transition)


@lru_cache(maxsize=1)
def model() -> Crf:
    """The model of the labelled table; the table bounds its size (some 50 kB)."""
    return train(_table())


# ---------------------------------------------------------------- decoding


def _stretches(text: str) -> tuple[list[str], list[tuple[int, int]], list[range]]:
    """Words near what may be personal data, their places, and the runs to label among them.

    A word that has neither a digit nor a sign of an address, and stands beside no
    spelled-out sign, is always outside. It ends the chain, so only runs of other words
    are decoded, with O on both sides: the labels are those of the whole text.
    """
    words, places, active = [], [], []
    line = 0
    for hit in _ACTIVE.finditer(text):
        if hit.start() < line:
            continue
        # The line around the hit: a chain never goes beyond it.
        begin = text.rfind("\n", 0, hit.start()) + 1
        end = text.find("\n", hit.start())
        end = line = len(text) if end < 0 else end
        first = len(words)
        for m in _WORD.finditer(text, begin, end):
            words.append(m[0])
            places.append(m.span())
            active.append(bool(_ACTIVE.search(m[0])))
        for i in range(first, len(words)):
            if _SIGN.match(words[i]):
                active[max(first, i - 1)] = True
                active[min(len(words) - 1, i + 1)] = True
        words.append("\n")
        places.append((end, end))
        active.append(False)
    runs, begin = [], None
    for i, own in enumerate([*active, False]):
        if own and begin is None:
            begin = i
        elif not own and begin is not None:
            runs.append(range(begin, i))
            begin = None
    return words, places, runs


def _accepted(kind: int, text: str) -> bool:
    """What a labelled span must hold at least to be personal data of its kind."""
    digits = len(_DIGIT.findall(text))
    if kind == 0:
        return bool(re.search(r"\w\s?(?:@|[\[({]at[\])}])\s?\w", text))
    if kind == 1:
        return text.count(":") > 1 if ":" in text else text.count(".") == 3 and _is_ip(text)
    return _is_card(text) if kind == 2 else 7 <= digits <= 15


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in "\"'<[{,;:.!?=":
        start += 1
    while start < end and text[end - 1] in "\"'>]},;:.!?=)" and (
        text[end - 1] != ")" or "(" not in text[start:end]
    ):
        end -= 1
    return start, end


def find_all(texts: list[str | None], crf: Crf) -> list[list[Span]]:
    """Spans of each text: those of the fixed patterns, and those of the model beside them."""
    out, jobs, emissions = [], [], []
    for n, text in enumerate(texts):
        if not text or not _ACTIVE.search(text):
            out.append([])
            continue
        out.append(base_spans(text))
        words, places, runs = _stretches(text)
        for run in runs:
            jobs.append((n, [places[i] for i in run]))
            emissions.append(crf.emissions(words, run))
    for (n, places), labels in zip(jobs, crf.viterbi(emissions), strict=True):
        text, i = texts[n], 0
        while i < len(labels):
            if not labels[i]:
                i += 1
                continue
            kind, stop = (int(labels[i]) - 1) % len(KINDS), i + 1
            while stop < len(labels) and labels[stop] == 1 + len(KINDS) + kind:
                stop += 1
            start, end = _trimmed(text, places[i][0], places[stop - 1][1])
            free = all(end <= a or start >= b for a, _, b, _ in out[n])
            if start < end and free and _accepted(kind, text[start:end]):
                out[n].append((start, kind, end, False))
            i = stop
    return [sorted(spans) for spans in out]


_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
)


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, spans) of every row: array of (kind, start, end, base), in code points.

    Spans of the fixed patterns (``base``) always stay, and may overlap between kinds; the model adds spans in
    other spellings where no span is yet. They come by start, then kind. Null and empty texts
    have none. Repeated rows and rows without an id each give a row; an empty table gives
    none; other columns of ``docs`` are not looked at.
    """
    crf = model()

    def step(batches):
        for batch in batches:
            spans = [
                [(KINDS[k], a, b, base) for a, k, b, base in own]
                for own in find_all(batch.column(1).to_pylist(), crf)
            ]
            as_rows = [
                [dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in own]
                for own in spans
            ]
            yield rows(doc_id=batch.column(0), spans=pa.array(as_rows, _SPANS))

    return map_batches(
        docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")),
        step,
        "doc_id bigint, spans array<struct<kind string, start bigint, end bigint, base boolean>>",
    )


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def op5_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])

    def number(kind: str) -> Column:
        return F.size(F.filter(kinds, lambda k: k == kind)).cast("bigint")

    return found.select(
        "doc_id",
        *[number(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def _without(text: str | None, spans: list[Span]) -> str | None:
    parts, done = [], 0
    for start, kind, end, _ in spans:
        if start >= done:
            parts += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join([*parts, text[done:]]) if spans else text


def redacted(docs: DataFrame) -> DataFrame:
    """The columns of documents, with each span of personal data replaced by its kind.

    Overlapping spans are replaced as one, by the kind of the first. ``n_chars`` follows
    the new text; a null text stays null. Other columns stay as they are.
    """
    fields = docs.columns
    text, crf = fields.index("text"), model()

    def step(batches):
        for batch in batches:
            old = batch.column(text).to_pylist()
            new = [_without(t, s) for t, s in zip(old, find_all(old, crf), strict=True)]
            field = batch.schema.field(text)
            yield batch.set_column(text, field, pa.array(new, field.type))

    return with_length(map_batches(docs, step, docs.schema))
