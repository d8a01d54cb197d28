"""Periodic runs of words, found on a grammar that Re-Pair makes of the word ids."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm.common import map_batches, rows, table, utf8

# Least words of a run, and how often its period fits in at least.
LEAST = 24
TIMES = 3
# Words of a window. In a run of LEAST words that holds its period q TIMES times, every window
# of 8 words stands again q words on or back: q + 8 words on either side of any place are not all
# outside it, since its length is 2 * q + 7 at least.
WINDOW = 8
_LEVEL = 3  # WINDOW = 1 << _LEVEL
# Pairs of windows whose reach is looked up at a time; bounds the memory of a repetitive text.
BLOCK = 1 << 18

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of pairs of 64-bit values."""
    x = a * _K[0] + b * _K[1]
    x ^= x >> np.uint64(32)
    x *= _K[2]
    return x ^ (x >> np.uint64(29))


def _stretches(texts: list[list[bytes]]) -> list[tuple[int, int, int]]:
    """(text, start, end) of the stretches of words that can hold a run.

    Those are where every window of 8 words stands elsewhere in the text too. Windows
    are compared by hash: chance hits only make a stretch longer.
    """
    sizes = np.array([len(t) for t in texts])
    total = int(sizes.sum())
    if total < LEAST:
        return []
    own = np.repeat(np.arange(len(texts)), sizes)
    h = np.fromiter(map(hash, chain.from_iterable(texts)), np.int64, total).view(np.uint64)
    for level in range(_LEVEL):
        h = _mixed(h[: -(1 << level)], h[1 << level :])
    h = _mixed(h, own[: len(h)].astype(np.uint64))
    inside = np.flatnonzero(own[: len(h)] == own[WINDOW - 1 :])
    h = h[inside]
    order = np.argsort(h)
    equal = h[order][1:] == h[order][:-1]
    again = np.zeros(total + 1, bool)
    again[inside[order[1:][equal]]] = True
    again[inside[order[:-1][equal]]] = True
    # The last windows of a text are no windows, so a stretch ends with its text.
    edges = np.flatnonzero(np.diff(again.view(np.int8), prepend=0))
    first, last = edges[::2], edges[1::2]  # of the windows; the last is past the end
    long = last - first >= LEAST - WINDOW + 1
    first, last = first[long], last[long] + WINDOW - 1
    begins = np.concatenate([[0], np.cumsum(sizes)])
    return [
        (int(own[a]), int(a - begins[own[a]]), int(b - begins[own[a]]))
        for a, b in zip(first.tolist(), last.tolist(), strict=True)
    ]


def _classes(ids: np.ndarray, longest: int) -> list[np.ndarray]:
    """Class k of a place: equal for two places if the 2**k ids from there on are equal."""
    classes = [ids.astype(np.int32)]
    while 2 << (len(classes) - 1) <= longest:
        half = 1 << (len(classes) - 1)
        low = classes[-1]
        pairs = low[:-half].astype(np.int64) * (int(low.max()) + 1) + low[half:]
        classes.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
    return classes


class Grammar:
    """Nonterminals over a sequence of ids: two children each, and every place they derive.

    ``at`` holds (nonterminal, place) of each use. A nonterminal stands for the same ids wherever it is used.
    """

    def __init__(self, ids: np.ndarray, stretch: np.ndarray):
        self.terminals = int(ids.max()) + 1
        self.length = np.ones(self.terminals, np.int64)
        self.middle: list[np.ndarray] = []  # length of the left child
        self.uses: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self._paired(ids.astype(np.int64), np.arange(len(ids)), stretch)

    def _replace(self, symbols: np.ndarray, starts: np.ndarray, at: np.ndarray, kind: np.ndarray):
        """Make a nonterminal of every kind of pair and put it in place of the pairs at ``at``."""
        _, first, own = np.unique(kind, return_index=True, return_inverse=True)
        new = own + len(self.length)
        left, right = symbols[at[first]], symbols[at[first] + 1]
        self.middle.append(self.length[left])
        self.uses.append(new)
        self.places.append(starts[at])
        self.length = np.concatenate([self.length, self.length[left] + self.length[right]])
        symbols[at] = new
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        return symbols[keep], starts[keep]

    def _paired(self, symbols: np.ndarray, starts: np.ndarray, stretch: np.ndarray) -> None:
        """Re-Pair in rounds, then pairs of neighbours until every stretch is one symbol.

        In a round each pair that occurs again is replaced where it is more frequent than
        the pairs it overlaps. Stretches end in ids of their own, so no pair reaches over.
        """
        while len(symbols) > 1:
            keys = symbols[:-1] * len(self.length) + symbols[1:]
            _, pair, count = np.unique(keys, return_inverse=True, return_counts=True)
            # Ties are broken by a mixture of the pair's number, which no text foresees.
            rank = np.where(
                count[pair] > 1, (count[pair] << 32) + (pair * 2654435769 & 0xFFFFFFFF), -1
            )
            # Stretches of one pair, as in "a a a", are taken as a whole, every second place.
            head = np.flatnonzero(np.diff(pair, prepend=-1))
            around = np.concatenate([[-1], rank[head], [-1]])
            best = (around[1:-1] > around[:-2]) & (around[1:-1] > around[2:])
            of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(pair))))
            at = np.flatnonzero(best[of] & ((np.arange(len(pair)) - head[of]) % 2 == 0))
            if not len(at):
                break
            symbols, starts = self._replace(symbols, starts, at, pair[at])
        own = stretch[starts]
        symbols, starts, own = symbols[own >= 0], starts[own >= 0], own[own >= 0]
        while len(symbols) > 1:
            head = np.flatnonzero(np.diff(own, prepend=-1))
            place = np.arange(len(own)) - np.repeat(head, np.diff(np.append(head, len(own))))
            at = np.flatnonzero((place[:-1] % 2 == 0) & (own[:-1] == own[1:]))
            if not len(at):
                break
            symbols, starts = self._replace(symbols, starts, at, np.arange(len(at)))
            own = stretch[starts]


def _reach(classes: list[np.ndarray], at: np.ndarray, period: np.ndarray, most: np.ndarray, back: bool):
    """How far from ``at`` on, or back from it, ids equal those ``period`` on; ``most`` at the most."""
    reach, left = np.zeros(len(at), np.int64), most.copy()
    for level in range(len(classes) - 1, -1, -1):
        step = 1 << level
        fits = np.flatnonzero(left >= step)
        place = at[fits] - reach[fits] - step + 1 if back else at[fits] + reach[fits]
        equal = classes[level][place] == classes[level][place + period[fits]]
        reach[fits[equal]] += step
        left[fits[equal]] -= step
    return reach


def _crossing(classes: list[np.ndarray], grammar: Grammar):
    """(nonterminal, start, end, period) of the periodic stretches over a nonterminal's middle.

    Start and end count from where it begins, and the stretch is followed no further than its
    ends. A stretch holds the window right before the middle or the one that
    begins there, less one id; its period is how far from it that window stands again.
    """
    ids = np.concatenate([np.zeros(0, np.int64), *grammar.middle])
    node = np.arange(grammar.terminals, grammar.terminals + len(ids))
    uses, places = np.concatenate(grammar.uses), np.concatenate(grammar.places)
    first = np.zeros(len(grammar.length), np.int64)
    first[uses[::-1]] = places[::-1]
    node = node[grammar.length[node] >= LEAST]
    begin, length = first[node], grammar.length[node]
    end, middle = begin + length, begin + ids[node - grammar.terminals]
    size = len(classes[0])
    windows = classes[_LEVEL].astype(np.int64)
    ordered = np.sort(windows * size + np.arange(len(windows)))
    found = []
    for window, there in ((middle - 1, middle - 1 + WINDOW <= end), (middle - WINDOW, middle - WINDOW >= begin)):
        own, w = np.flatnonzero(there), window[there]
        most = length[own] // TIMES
        low = np.searchsorted(ordered, windows[w] * size + np.maximum(begin[own], w - most))
        high = np.searchsorted(ordered, windows[w] * size + np.minimum(end[own] - WINDOW, w + most), "right")
        upto = np.cumsum(high - low)
        for block in range(0, int(upto[-1]) if len(upto) else 0, BLOCK):
            number = np.arange(block, min(block + BLOCK, int(upto[-1])))
            i = np.searchsorted(upto, number, "right")
            other = ordered[high[i] - (upto[i] - number)] % size
            period = np.abs(other - w[i])
            i, other, period = i[period > 0], other[period > 0], period[period > 0]
            k, place = own[i], np.minimum(other, w[i])
            stop = place + WINDOW
            e = stop + period + _reach(classes, stop, period, end[k] - stop - period, False)
            s = place - _reach(classes, place - 1, period, place - begin[k], True)
            good = (e - s >= np.maximum(LEAST, TIMES * period)) & (s < middle[k]) & (e > middle[k])
            k, s, e, period = k[good], s[good], e[good], period[good]
            found.append(np.stack([node[k], s - begin[k], e - begin[k], period]))
    found = np.concatenate([np.zeros((4, 0), np.int64), *found], axis=1)
    # Periods of one stretch are multiples of the smallest, which is among them.
    found = found[:, np.lexsort(found[::-1])]
    return found[:, np.any(np.diff(found[:3], prepend=-1), axis=0)]


def _translated(found: np.ndarray, grammar: Grammar) -> np.ndarray:
    """(start, end, period) of the stretches at every place that their nonterminals derive."""
    uses, places = np.concatenate(grammar.uses), np.concatenate(grammar.places)
    order = np.argsort(uses, kind="stable")
    uses, places = uses[order], places[order]
    low, high = np.searchsorted(uses, found[0]), np.searchsorted(uses, found[0], "right")
    many = high - low
    which = np.repeat(np.arange(len(many)), many)
    place = places[low[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)]
    return np.stack([found[1][which] + place, found[2][which] + place, found[3][which]])


def _maximal(stretches: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """The stretches that lie in no other one of the same period: runs, since each run is there whole."""
    start, end, period = stretches
    order = np.lexsort([-end, start, period, stretch[start]])
    start, end, period = start[order], end[order], period[order]
    new = np.diff(stretch[start], prepend=-1).astype(bool) | np.diff(period, prepend=-1).astype(bool)
    group = np.cumsum(new) * (len(stretch) + 1)
    seen = np.maximum.accumulate(end + group)
    keep = np.ones(len(end), bool)
    keep[1:] = (end + group)[1:] > seen[:-1]
    return np.stack([start, end, period])[:, keep]


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, a list of words, by start, then period.

    A run is a stretch of words with smallest period q, of 24 words and 3 * q at
    least, that is not part of a longer one with that period.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    parts = _stretches(texts)
    if not parts:
        return out
    number: dict[bytes, int] = {}
    ids: list[int] = []
    for text, a, b in parts:
        ids += [number.setdefault(w, len(number)) for w in texts[text][a:b]]
        ids.append(-1)
    ids = np.array(ids)
    ends = ids < 0  # each end is an id of its own
    ids[ends] = len(number) + np.arange(len(parts))
    stretch = np.cumsum(ends) - ends
    begins = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1])
    classes = _classes(ids, max(b - a for _, a, b in parts))
    grammar = Grammar(ids, np.where(ends, -1, stretch))
    found = _maximal(_translated(_crossing(classes, grammar), grammar), stretch)
    for s, e, q in sorted(found.T.tolist(), key=lambda r: (r[0], r[2])):
        text, a, _ = parts[stretch[s]]
        out[text].append((s - int(begins[stretch[s]]) + a, e - s, q))
    return out


def _collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without what follows the first period of each run."""
    if found:
        keep = np.ones(len(words), bool)
        for start, length, period in found:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row.

    ``runs`` are structs (start, length, period) in words, by start, then period; ``collapsed`` is the
    text with one period of each run, words joined by a blank. Words are what white
    space of ASCII separates; they are compared as they are. Null and empty texts have no words, no runs and
    an empty ``collapsed``. Repeated rows and rows without an id each give a row; an
    empty table gives none; other columns of ``docs`` are not looked at. Nothing is shuffled; a
    task holds a batch of texts, and grammars only of the stretches where words repeat.
    """
    kind = pa.list_(pa.struct({n: pa.int64() for n in ("start", "length", "period")}))

    def step(batches):
        for batch in batches:
            words = [t.split() if t else [] for t in utf8(batch.column(1))]
            found = runs_of(words)
            yield rows(
                doc_id=batch.column(0),
                n_words=pa.array([len(w) for w in words], pa.int64()),
                runs=pa.array(
                    [[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in found], kind
                ),
                collapsed=pa.array(list(map(_collapsed, words, found)), pa.binary()).cast(pa.string()),
            )

    return map_batches(
        docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")),
        step,
        "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>,"
        " collapsed string",
    )


def highest(runs: Column) -> Column:
    """The run with the greatest length / period, the first of equals; null if there is none."""
    return F.aggregate(
        runs,
        F.get(runs, F.lit(0)),
        lambda best, r: F.when(
            r["length"] * best["period"] > best["length"] * r["period"], r
        ).otherwise(best),
    )


def _made_periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents repeat some of their words to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    return (
        docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
        .withColumn("a", F.expr("h DIV 10 % size(words)"))
        .withColumn("p", F.expr("1 + (size(words) - a) DIV (3 + h DIV 10 % 8)"))
        .select(
            "doc_id",
            F.when(
                F.size("words") > 0,
                F.expr(
                    "array_join(transform(words, (w, i) ->"
                    " IF(i < a, w, get(words, CAST(a + (i - a) % p AS INT)))), ' ')"
                ),
            ).otherwise(F.col("text")).alias("text"),
        )
    )


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of which are made periodic first."""
    found = periodic_runs(_made_periodic(table(spark, sf_dir, "documents")))
    told = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    top = highest(F.col("runs"))
    return (
        found.withColumn("top", top)
        .select(
            "doc_id",
            F.size("runs").cast("bigint").alias("n_runs"),
            "top.start",
            "top.length",
            "top.period",
            F.expr("1000 * top.length DIV top.period").alias("exponent_milli"),
            F.sha2(F.array_join(F.transform(told, lambda r: F.concat(r, F.lit("\n"))), ""), 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )
