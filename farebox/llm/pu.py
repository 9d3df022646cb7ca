"""Non-negative positive-unlabelled learning over whole texts.

A classifier learns from trusted positives and unlabelled documents only. With class prior p, loss l and scores g the
risk is

    p E_P[l(g)]  +  max(0, E_U[l(-g)] - p E_P[l(-g)])

where the second term, the risk on negatives written without any, must not fall below zero (when a batch drives it
there, its gradient is turned round). The prior is estimated from positives and unlabelled texts: where a score ranks
nothing but positives, unlabelled texts are found as often as positives, times the prior (see `estimate_prior`).
Labelled negatives are never read.

Two disjoint bounded samples of each kind are drawn by a hash of doc_id: one gives a lexicon (words and beginnings of
words that positives hold more or less often than unlabelled texts), the other, described by that lexicon and by counts of characters, words and
lines, trains the network. Every document is then scored over its whole text in one pass.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.llm.text import blobs, small_batches, words
from farebox.session import cut

FOLDS = 5
SEED = 20


@dataclass(frozen=True)
class Settings:
    """Bounds of the samples are strict, by rank of a hash of doc_id; they don't grow with the corpus."""

    label: str  # column of `labels` with 1 for positives
    positives: int = 6_000  # sampled for both halves together
    unlabelled: int = 12_000
    lexicon: int = 2_000  # units kept
    sure: float = 4.0  # standard errors by which the log-odds of a kept unit differ from none
    form: bool = True  # describe a text by counts of characters, words and lines too
    least_documents: int = 6  # of the sample that hold a kept unit
    hidden: int = 12
    epochs: int = 60
    rate: float = 0.01
    prior: float | None = None  # estimated where None
    ranking: float = 0.1  # prior of the networks that only rank, for the estimate
    doubt: float = 0.1  # chance that a bound of the estimate fails
    without_positives: float = 0.0  # score of every text if no positive is known


def crc_fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo FOLDS; fold 0 is held out. A null doc_id is never used for training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


# Deletion tables: what is left after translate() is counted.
_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))
_STOPS = b".,"
_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b not in _STOPS)


def stats(text: bytes, ws: list[bytes]) -> list[float]:
    """Counts of characters, words and lines that don't depend on any vocabulary."""
    n, n_words = max(1, len(text)), max(1, len(ws))
    share = lambda drop: (len(text) - len(text.translate(None, drop))) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    ascii_bytes = text.isascii() or not text
    return [
        np.log1p(len(ws)),
        np.log1p(len(text)),
        share(_UPPER),
        share(_DIGITS),
        share(_MARKS),
        share(_STOPS),
        share(b" \t\r\n"),
        len(set(ws)) / n_words,
        sum(map(operator.eq, ws, ws[1:])) / n_words,
        len(set(lines)) / n_lines,
        np.log1p(len(text) / n_lines),
        float(ascii_bytes),
        (len(text) / n_words) ** 0.5,
    ]


PREFIXES = range(4, 9)  # bytes of a word's beginnings that are units too; they stand for words built on one stem
CACHED_WORDS = 300_000


def units(word: bytes) -> list[bytes]:
    """What a lexicon may hold of a word: its beginnings, marked as such, and the word itself; the longest last."""
    return [*(word[:n] + b"-" for n in PREFIXES if n < len(word)), word]


class Weights(dict):
    """Weight of a word: that of its longest unit in a lexicon, 0 without one. Bounded; forgets all when full."""

    def __init__(self, lexicon: dict[bytes, float]) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> float:
        if len(self) >= CACHED_WORDS:
            self.clear()
        weight = next((self.lexicon[u] for u in reversed(units(word)) if u in self.lexicon), 0.0)
        self[word] = weight
        return weight


def features(text: bytes, weights: Weights, form: bool) -> list[float]:
    """The weight of a text's words, and its statistics if `form`."""
    ws = words(text)
    n = max(1, len(ws))
    found = list(filter(None, map(weights.__getitem__, ws)))
    for_it = [w for w in found if w > 0]
    n_for, n_against = len(for_it), len(found) - len(for_it)
    sum_for = sum(for_it)
    return [
        *(stats(text, ws) if form else ()),
        sum_for / n,
        min(1.0, 20.0 * sum_for / n),
        np.log1p(sum_for),
        n_for / n,
        (sum_for - sum(found)) / n,
        n_against / n,
        float(n_for >= 1),
        float(n_for >= 2),
    ]


@dataclass(frozen=True)
class Model:
    """A standardised two-layer network; small arrays that travel with the task."""

    lexicon: dict[bytes, float]
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    form: bool = True
    constant: float | None = None
    prior: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        g = np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def gradient(theta: list[np.ndarray], xp: np.ndarray, xu: np.ndarray, prior: float) -> list[np.ndarray]:
    """Of the risk of one batch with the logistic loss, or against its negative part where that is below zero."""
    hp, hu = np.tanh(xp @ theta[0] + theta[1]), np.tanh(xu @ theta[0] + theta[1])
    gp, gu = hp @ theta[2] + theta[3], hu @ theta[2] + theta[3]
    sp, su = 1 / (1 + np.exp(-np.clip(gp, -30, 30))), 1 / (1 + np.exp(-np.clip(gu, -30, 30)))

    def back(x: np.ndarray, slope: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
        inner = np.outer(slope, theta[2]) * (1 - h * h)
        return [x.T @ inner, inner.sum(0), h.T @ slope, slope.sum(keepdims=True)]

    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    of_u = back(xu, su / len(su), hu)  # of E_U[l(-g)]
    of_p = back(xp, prior * sp / len(sp), hp)  # of p E_P[l(-g)]
    if negative < 0:
        return [b - a for a, b in zip(of_u, of_p, strict=True)]
    toward = back(xp, prior * (sp - 1) / len(sp), hp)  # of p E_P[l(g)]
    return [a - b + c for a, b, c in zip(of_u, of_p, toward, strict=True)]


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, s: Settings) -> Model:
    """Minimise the non-negative risk by Adam."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    rng = np.random.default_rng(SEED)
    d = p.shape[1]
    theta = [rng.normal(0, 0.5 / np.sqrt(d), (d, s.hidden)), np.zeros(s.hidden), rng.normal(0, 0.3, s.hidden), np.zeros(1)]
    first, second, t = [np.zeros_like(w) for w in theta], [np.zeros_like(w) for w in theta], 0
    steps = max(8, min(40, len(u) // 256))
    for _ in range(s.epochs):
        for pi, ui in zip(
            np.array_split(rng.permutation(len(p)), steps), np.array_split(rng.permutation(len(u)), steps), strict=True
        ):
            if not len(pi) or not len(ui):
                continue
            t += 1
            for i, g in enumerate(gradient(theta, p[pi], u[ui], prior)):
                g = g + 1e-4 * theta[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                theta[i] = theta[i] - s.rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return Model({}, mean, scale, *theta[:3], float(theta[3][0]))


def best_share(positive: np.ndarray, unlabelled: np.ndarray, doubt: float) -> float:
    """The share of positives among unlabelled scores, read off above the threshold that bounds it best.

    Above any threshold the share of unlabelled scores is at least the prior times that of positive scores. Their ratio
    so bounds the prior, and is near it where no negatives are; the threshold with the least upper bound is taken, as
    high ones leave too few scores to tell and low ones let negatives in.
    """
    at = np.unique(positive)
    over_p = 1 - np.searchsorted(np.sort(positive), at) / len(positive)
    over_u = 1 - np.searchsorted(np.sort(unlabelled), at) / len(unlabelled)
    slack = sum(np.sqrt(np.log(4 / doubt) / (2 * len(x))) for x in (positive, unlabelled))
    best = np.argmin((over_u + slack) / over_p)
    return float(over_u[best] / over_p[best])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, s: Settings) -> float:
    """The share of positives among the unlabelled, from feature rows of both; 1 / rows at least, 0.99 at most.

    Each half is scored by a network that was fitted on the other, and both halves' estimates are averaged.
    """
    found = []
    for k in (0, 1):
        fitted = nn_pu(positive[k::2], unlabelled[k::2], s.ranking, s)
        p, u = positive[1 - k :: 2], unlabelled[1 - k :: 2]
        if len(p) and len(u):
            found.append(best_share(fitted.scores(p), fitted.scores(u), s.doubt))
    return float(np.clip(np.mean(found) if found else s.ranking, 1 / len(unlabelled), 0.99))


def _constant(score: float) -> Model:
    empty = np.zeros(0)
    return Model({}, empty, empty, empty, empty, empty, 0.0, constant=score)


_MADE = T.StructType().add("word", T.BinaryType()).add("positive", T.BooleanType())
_DESCRIBED = T.StructType().add("positive", T.BooleanType()).add("x", T.ArrayType(T.DoubleType()))


def sample(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame | None:
    """`positive, text, first`: the texts a classifier is fitted on, at most `positives` and `unlabelled`; none without
    a positive.

    Of fold 0 nothing is drawn. A doc_id that repeats counts once, with the text of the least hash. Ids are drawn by
    rank of a hash, so the bounds hold for any data; positives are among the unlabelled as often as anywhere.
    """
    usable = F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id")) != 0)
    known = labels.where(usable & (F.col(f"`{s.label}`") == 1)).select("doc_id").distinct()

    def order(salt: int) -> Column:
        return F.xxhash64("doc_id", F.lit(salt)).bitwiseAND((1 << 62) - 1)

    positives = known.orderBy(order(1), "doc_id").limit(s.positives).select(F.col("doc_id").alias("positive_id"))
    positives = cut(positives, "positives")
    if positives.isEmpty():
        return None
    texts = docs.where(usable).select("doc_id", "text")
    n_ids = texts.agg(F.approx_count_distinct("doc_id", 0.02)).first()[0]
    likely = int((1 << 62) * min(1.0, 1.2 * s.unlabelled / max(n_ids, 1)))  # ids beyond are not among the first
    drawn = texts.select(order(2).alias("place")).where(F.col("place") < likely).distinct().orderBy("place").limit(s.unlabelled)
    last = drawn.agg(F.max("place")).first()[0]
    chosen = (
        texts.join(F.broadcast(positives), F.col("doc_id") == F.col("positive_id"), "left")  # at most s.positives ids
        .select("doc_id", "text", F.col("positive_id").isNotNull().alias("known"), (order(2) <= F.lit(last)).alias("drawn"))
        .where(F.col("known") | F.col("drawn"))
        .groupBy("doc_id", "known", "drawn").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    )
    kinds = F.array_compact(F.array(F.when(F.col("known"), F.lit(True)), F.when(F.col("drawn"), F.lit(False))))
    half = (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 0).alias("first")
    return cut(chosen.select(F.explode(kinds).alias("positive"), "text", half), "sample")


def train(docs: DataFrame, labels: DataFrame, s: Settings) -> Model:
    """Fit on rows outside fold 0. Only `doc_id` and `text` of documents, and `doc_id` and the label column, are read.

    Null and empty texts are texts like any other, null doc_ids and null labels say nothing. Without a positive, or
    without texts of both kinds, every text gets the constant `without_positives`.
    """
    chosen = sample(docs, labels, s)
    if chosen is None:
        return _constant(s.without_positives)
    form = s.form
    lexicon = _lexicon(chosen.where("first"), s)

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(lexicon)
        for batch in small_batches(batches):
            made = [features(b, weights, form) for b in blobs(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], names=_DESCRIBED.names)

    rows = chosen.where("not first").select("positive", "text").mapInArrow(describe, _DESCRIBED).toArrow()
    if not rows.num_rows:
        return _constant(s.without_positives)
    x = np.array(rows.column("x").to_pylist(), float).reshape(rows.num_rows, -1)
    positive = np.array(rows.column("positive").to_pylist(), bool)
    order = np.lexsort(x.T)  # the same order, and so the same model, whichever task came first
    order = order[np.random.default_rng(SEED).permutation(len(order))]
    x, positive = x[order], positive[order]
    if positive.all() or not positive.any():
        return _constant(s.without_positives)
    prior = s.prior if s.prior is not None else estimate_prior(x[positive], x[~positive], s)
    return replace(nn_pu(x[positive], x[~positive], prior, s), lexicon=lexicon, form=form, prior=prior)


def _lexicon(sample: DataFrame, s: Settings) -> dict[bytes, float]:
    """Log-odds of the units whose share among positives and unlabelled texts differs most surely."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4 << 20):
            out, kinds = [], []
            for kind, text in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
                own = {u for w in set(words(text)) for u in units(w)}
                out.extend(own)
                kinds.extend([kind] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(kinds, pa.bool_())], names=_MADE.names)

    totals = sample.agg(F.sum(F.col("positive").cast("int")), F.sum((~F.col("positive")).cast("int"))).first()
    n_p, n_u = totals[0] or 0, totals[1] or 0
    if not n_p or not n_u:
        return {}
    counted = (
        sample.select("positive", "text").mapInArrow(split, _MADE).groupBy("word")
        .agg(F.sum(F.col("positive").cast("int")).alias("p"), F.sum((~F.col("positive")).cast("int")).alias("u"))
        .where(F.col("p") + F.col("u") >= s.least_documents)
    )
    p, u = (F.col("p") + 0.5) / (n_p + 1.0), (F.col("u") + 0.5) / (n_u + 1.0)
    error = F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("u") + 0.5))
    odds = F.log(p / u)
    kept = (
        counted.select("word", odds.alias("weight"), F.abs(odds / error).alias("sure"))
        .where(F.col("sure") > s.sure).orderBy(F.desc("sure"), "word").limit(s.lexicon)
    )
    return {bytes(r.word): float(r.weight) for r in kept.collect()}


def score(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """`doc_id, held_out, score, predicted` of every whole text.

    Null and empty texts are described as having nothing and scored like any other; repeated rows each get a row. A
    null doc_id counts as held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "score", "predicted"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights = Weights(m.lexicon)
        for batch in small_batches(batches):
            if batch.num_rows:
                values = m.scores(np.array([features(b, weights, m.form) for b in blobs(batch.column(1))]))
                made = [batch.column(0), pa.array(values), pa.array((values >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(made, names=names)

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
    held_out = F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, model: Model, wanted: Callable[[float], bool]) -> DataFrame:
    """The rows of `docs`, unchanged, whose text has a wanted score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights = Weights(m.lexicon)
        for batch in small_batches(batches):
            if batch.num_rows:
                x = np.array([features(b, weights, m.form) for b in blobs(batch.column(at))])
                yield batch.filter(pa.array([wanted(v) for v in m.scores(x).tolist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
