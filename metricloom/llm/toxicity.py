"""Toxicity by class-conditional Kneser-Ney models over the characters of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm.common import map_batches, rows, stored, table

# Characters of an expression of the models, and the discount of Kneser-Ney.
ORDER = 5
DISCOUNT = 0.9
# Labelled rows to learn from, at most; which ones is decided by a hash of the id.
TRAINING_ROWS = 30_000
# Words whose score a worker remembers, and characters of words whose expressions are made at a time.
CACHE = 1 << 18
CHARS = 1 << 18
# Labelled rows of this remainder are held out, of that one fit the calibration.
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
# Score from which a text is predicted to be toxic.
TOXIC = 0.5

# A character takes 21 bits of an expression's code, as many as code points have: ``lo`` holds
# the last three characters, ``hi`` those before. The marks of a word's ends are 1 and 2.
_BITS, _LAST = 21, 3
_CHAR = (1 << _BITS) - 1
_BEFORE, _AFTER = "\x01" * (ORDER - 1), "\x02"


def _pieces(words: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Words with the marks of their ends, so many at a time as CHARS allows: (places, pieces).

    A word without end is cut into pieces, each of which repeats the characters that its first
    expression reaches back to.
    """
    places, pieces, size = [], [], 0
    for i, word in enumerate(words):
        marked = f"{_BEFORE}{word}{_AFTER}"
        for at in range(0, len(marked) - ORDER + 1, CHARS):
            places.append(i)
            pieces.append(marked[at : at + CHARS + ORDER - 1])
            size += len(pieces[-1])
            if size >= CHARS:
                yield places, pieces
                places, pieces, size = [], [], 0
    if pieces:
        yield places, pieces


def _codes(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (hi, lo) of all expressions of the pieces, one per character and end, and each piece's first."""
    joined = "".join(pieces)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    n = len(chars) - ORDER + 1
    hi, lo = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(ORDER):
        half = hi if i < ORDER - _LAST else lo
        half <<= _BITS
        half |= chars[i : i + n]
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) - ORDER + 1
    ends = np.cumsum(lengths + ORDER - 1)
    firsts = ends - lengths - ORDER + 1
    # Expressions that end in a character or an end mark of a word.
    inside = np.ones(n, bool)
    gaps = (firsts[1:, None] - np.arange(1, ORDER)).ravel()
    inside[gaps] = False
    return hi[inside], lo[inside], np.cumsum(lengths) - lengths


def _place(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value among sorted ones, and whether it is one of them."""
    place = np.minimum(np.searchsorted(among, values), max(len(among) - 1, 0))
    return place, among[place] == values if len(among) else np.zeros(len(values), bool)


@dataclass
class Model:
    """Log-likelihood ratio of each expression that either class has shown; calibration of features.

    ``his`` and ``los`` are the halves that occur, sorted; ``pairs`` are those of them that make
    an expression, as place of hi times their number plus place of lo. Held exactly: as
    many as the labelled texts have, whatever the corpus.
    """

    his: np.ndarray
    los: np.ndarray
    pairs: np.ndarray
    values: np.ndarray
    weights: np.ndarray | None = None

    def ratios(self, words: list[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        total = np.zeros(len(words))
        for places, pieces in _pieces(words):
            hi, lo, firsts = _codes(pieces)
            out = np.zeros(len(hi))
            (high, one), (low, two) = _place(hi, self.his), _place(lo, self.los)
            place, known = _place(high * len(self.los) + low, self.pairs)
            # What neither class has shown says nothing, not that the class with fewer texts is likelier.
            known &= one & two
            out[known] = self.values[place[known]]
            np.add.at(total, places, np.add.reduceat(out, firsts))
        return total

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(features))
        z = _scaled(features) @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _scaled(features: np.ndarray) -> np.ndarray:
    return np.stack([features[:, 0] * 4, features[:, 1] / 8], 1)


def _words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def _gathered(labelled: DataFrame) -> DataFrame:
    """(kind, hi, lo, n): expressions by class (kinds 0 and 1) and of the corpus (2, n says nothing).

    ``labelled`` is (text, toxic) of all documents, toxic null where not learned from.
    """

    def step(batches):
        seen: set[str] = set()
        for batch in batches:
            words: list[dict[str, int]] = [{}, {}]
            fresh: set[str] = set()
            for text, toxic in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True
            ):
                own = _words(text)
                fresh.update(own)
                if toxic is not None:
                    counts = words[toxic]
                    for w in own:
                        counts[w] = counts.get(w, 0) + 1
            fresh -= seen
            if len(seen) > CACHE:
                seen.clear()
            seen |= fresh
            for kind, counts in enumerate([*words, dict.fromkeys(fresh, 1)]):
                names = list(counts)
                for places, part in _pieces(names):
                    hi, lo, firsts = _codes(part)
                    times = np.fromiter((counts[names[i]] for i in places), np.int64, len(part))
                    times = np.repeat(times, np.diff(np.append(firsts, len(hi))))
                    order = np.lexsort((lo, hi))
                    hi, lo, times = hi[order], lo[order], times[order]
                    new = np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))
                    n = np.add.reduceat(times, np.flatnonzero(new))
                    yield rows(kind=np.full(len(n), kind, np.int32), hi=hi[new], lo=lo[new], n=n)

    raw = map_batches(labelled, step, "kind int, hi bigint, lo bigint, n bigint")
    return raw.groupBy("kind", "hi", "lo").agg(F.sum("n").alias("n"))


def _suffix(k: int, to: str = "") -> list:
    """Code of the last k characters of an expression."""
    high, low = ((1 << _BITS * n) - 1 for n in (max(k - _LAST, 0), min(k, _LAST)))
    return [F.expr(f"hi & {high}L").alias(f"{to}hi"), F.expr(f"lo & {low}L").alias(f"{to}lo")]


def _context(to: str = "") -> list:
    """Code of an expression without its last character."""
    low = f"shiftleft(hi & {_CHAR}L, {_BITS * (_LAST - 1)}) | shiftright(lo, {_BITS})"
    return [F.expr(f"shiftright(hi, {_BITS})").alias(f"{to}hi"), F.expr(low).alias(f"{to}lo")]


def _interpolated(count: str, total: str, kinds: str, backoff: str):
    """Interpolated Kneser-Ney; where the context is unknown, the backoff itself."""
    high = F.greatest(F.col(count) - DISCOUNT, F.lit(0.0)) / F.col(total)
    low = F.lit(DISCOUNT) * F.col(kinds) / F.col(total) * F.col(backoff)
    return F.when(F.col(total) > 0, high + low).otherwise(F.col(backoff))


def _model(grams: DataFrame) -> Model:
    """Exact counts of the whole corpus, joined to the expressions that the classes have shown.

    Each of those has its suffixes in the corpus, so the joins lose none.
    """

    def of_class(kind: int):
        return F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(f"n{kind}")

    own = stored(grams.filter("kind < 2").groupBy("hi", "lo").agg(of_class(0), of_class(1)), "shown")
    levels, level = {}, grams.filter("kind = 2")
    for k in range(ORDER - 1, 0, -1):
        # How many different characters stand before an expression of k characters.
        level = level.groupBy(*_suffix(k)).agg(F.count(F.lit(1)).alias("n"))
        levels[k] = level = stored(level, f"shared{k}")
    # Likelihood of the last k characters of what is shown, from short to long.
    kinds = levels[1].count() + 1
    backoff = None
    for k in range(1, ORDER):
        contexts = levels[k].groupBy(*_context("c_")).agg(
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")
        )
        asked = own.select(*_suffix(k)).distinct()
        found = levels[k].join(asked, ["hi", "lo"], "left_semi")
        found = found.select("hi", "lo", "n", *_context("c_"), *_suffix(k - 1, "s_"))
        found = found.join(contexts, ["c_hi", "c_lo"])
        if backoff is None:
            found = found.withColumn("p", F.lit(1 / kinds))
        else:
            found = found.join(backoff, ["s_hi", "s_lo"])
        backoff = stored(
            found.select(
                F.col("hi").alias("s_hi"), F.col("lo").alias("s_lo"), _interpolated("n", "total", "kinds", "p").alias("p")
            ),
            f"backoff{k}",
        )
    totals = own.groupBy(*_context("c_")).agg(
        *[F.sum(f"n{c}").alias(f"total{c}") for c in (0, 1)],
        *[F.sum((F.col(f"n{c}") > 0).cast("bigint")).alias(f"kinds{c}") for c in (0, 1)],
    )
    ordinary, toxic = (F.log(_interpolated(f"n{c}", f"total{c}", f"kinds{c}", "p")) for c in (0, 1))
    found = (
        own.select("*", *_context("c_"), *_suffix(ORDER - 1, "s_"))
        .join(totals, ["c_hi", "c_lo"])
        .join(backoff, ["s_hi", "s_lo"])
        .select("hi", "lo", (toxic - ordinary).alias("ratio"))
        .toArrow()  # as many rows as the labelled texts have expressions
    )
    hi, lo, ratio = (found.column(k).to_numpy() for k in ("hi", "lo", "ratio"))
    his, high = np.unique(hi, return_inverse=True)
    los, low = np.unique(lo, return_inverse=True)
    pairs = high * len(los) + low
    order = np.argsort(pairs)
    return Model(his, los, pairs[order], ratio[order])


class _Features:
    """Features of texts, word by word; remembers the words it has seen.

    A text's log-likelihood ratio over its number of words, and that of its most toxic
    expression alone, so that a long text does not hide it.
    """

    def __init__(self, model: Model):
        self.model = model
        self.seen: dict[str, float] = {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        seen, words = self.seen, [_words(t) for t in texts]
        if len(seen) > CACHE:
            seen.clear()
        new = list(set().union(*words).difference(seen))
        seen.update(zip(new, self.model.ratios(new).tolist(), strict=True))
        features = np.zeros((len(texts), 2))
        for i, own in enumerate(words):
            if own:
                values = np.fromiter(map(seen.__getitem__, own), np.float64, len(own))
                features[i] = values.mean(), values.max()
        return features


def _fitted(features: np.ndarray, toxic: np.ndarray) -> np.ndarray | None:
    """Logistic regression with a small penalty, by Newton's method."""
    if len(np.unique(toxic)) < 2:
        return None
    x = np.column_stack([np.ones(len(toxic)), _scaled(features)])
    penalty = np.diag([1e-6, 1e-2, 1e-2])
    w = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - toxic) + penalty @ w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(3)
        w -= np.linalg.solve(hessian, gradient)
    return w


def _remainder(doc_id):
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def trained(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> Model:
    """The models of both classes, their shared backoff and the calibration.

    Learned from at most ``training_rows`` rows of ``labels`` whose crc32 of the id, modulo
    5, is not 0 (4: the calibration, the rest: the models); of several labels of an id the
    highest counts, rows with a null are skipped. The backoff is counted over all of ``docs``.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = (
        labels.select(
            F.col("doc_id").cast("bigint").alias("_id"), F.col("toxic").cast("int").alias("toxic")
        )
        .filter("_id IS NOT NULL AND toxic IN (0, 1)")
        .filter(_remainder("_id") != HELD_OUT)
        .groupBy("_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(training_rows)
    )
    chosen = stored(chosen, "labels")
    learn = F.broadcast(chosen.filter(_remainder("_id") != CALIBRATION))
    labelled = base.join(learn, base["doc_id"] == learn["_id"], "left").select("text", "toxic")
    model = _model(stored(_gathered(labelled), "expressions"))

    fit = F.broadcast(chosen.filter(_remainder("_id") == CALIBRATION))
    own = base.join(fit, base["doc_id"] == fit["_id"]).select("text", "toxic")

    def step(batches):
        featured = _Features(shipped.value)
        for batch in batches:
            features = featured(batch.column(0).to_pylist())
            yield rows(mean=features[:, 0].copy(), high=features[:, 1].copy(), toxic=batch.column(1))

    shipped = spark.sparkContext.broadcast(model)
    found = map_batches(own, step, "mean double, high double, toxic int").toArrow()
    pairs = np.column_stack([found.column("mean").to_numpy(), found.column("high").to_numpy()])
    model.weights = _fitted(pairs, found.column("toxic").to_numpy().astype(float))
    shipped.unpersist()
    return model


def scores(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Two Kneser-Ney models, of toxic and of ordinary texts, give the characters
    of each word a likelihood from the four before them; both back off to one
    model of the whole corpus. An expression that neither class has shown is left out, since its
    context says only which class has more texts. The ratio of the likelihoods, over the number of words and for the
    strongest expression, is calibrated by logistic regression (see ``trained``).

    Null and empty texts have no words and ratio 0. Where the labels do not show both
    classes, all scores are 0. Repeated rows and rows without an id each give a row (held_out
    false without one); an empty table gives none; other columns are not looked at.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, training_rows))

    def step(batches):
        featured = _Features(shipped.value)
        for batch in batches:
            found = shipped.value.score(featured(batch.column(1).to_pylist()))
            yield rows(doc_id=batch.column(0), score=pa.array(found))

    base = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    scored = map_batches(base, step, "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        F.coalesce(_remainder("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def ordinary_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not predicted to be toxic, with all their columns; see ``scores``.

    Each row goes by its own text; nothing is shuffled.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))
    text = docs.columns.index("text")

    def step(batches):
        featured = _Features(shipped.value)
        for batch in batches:
            found = shipped.value.score(featured(batch.column(text).to_pylist()))
            yield batch.filter(pa.array(found < TOXIC))

    return map_batches(docs, step, docs.schema)
