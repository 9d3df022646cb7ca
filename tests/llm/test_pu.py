from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from farebox.llm import pu, quality, toxicity

SMALL_TABLES = "/root/testdata/sf0.01"
BAD = ["scoundrel", "wretch", "vermin"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(900):
        toxic, poor = rng.random() < 0.2, rng.random() < 0.3
        text = rng.choices(words, k=rng.randint(20, 120))
        if toxic:
            for _ in range(max(3, len(text) // 25)):
                text[rng.randrange(len(text))] = rng.choice(BAD)
        if poor:
            text = [w.upper() + "!!" for w in text]
        docs.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, int(not poor), int(toxic)))
    docs += [(5000, None), (5001, ""), (None, "no id"), (5002, "long " * 40_000)]
    labels += [(None, 1, 1), (4, None, None), (9999, 1, 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "0 AS score", "1 AS positive").cache(),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache(),
    )


@pytest.mark.parametrize(("op", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_accuracy(corpus, op, label):
    docs, labels = corpus
    rows = op.score(docs, labels)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"] and rows.count() == docs.count()
    truth = {r.doc_id: r[label] for r in labels.collect()}
    rows = rows.collect()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= op.THRESHOLD)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None and r.doc_id is not None]
    assert np.mean([a == b for a, b in held]) > 0.93


def test_held_out_labels_change_nothing(spark, corpus):
    docs, labels = corpus
    other = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (sorted(map(repr, toxicity.score(docs, x).collect())) for x in (labels, other))
    assert a == b


def test_keeping_and_no_positives(spark, corpus, no_documents):
    docs, labels = corpus
    kept = toxicity.keep_clean(docs, labels)
    bad = {r.doc_id for r in toxicity.score(docs, labels).where("predicted = 1").collect()}
    assert bad and {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == bad
    assert kept.schema == docs.schema
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.score(no_documents, labels).count() == 0


def test_risk_is_minimised_without_negatives():
    rng = np.random.default_rng(1)
    positive = rng.normal(2, 1, (400, 2))
    mixed = np.concatenate([rng.normal(2, 1, (300, 2)), rng.normal(-2, 1, (700, 2))])
    model = pu.nn_pu(positive, mixed, 0.3, pu.Settings("y"))
    truth = np.arange(1000) < 300
    assert ((model.scores(mixed) >= 0.5) == truth).mean() > 0.95


def plain_risk(theta, xp, xu, prior):
    """Both parts of the risk, written out over single rows."""

    def g(x):
        return sum(np.tanh(sum(x[i] * theta[0][i, k] for i in range(len(x))) + theta[1][k]) * theta[2][k] for k in range(len(theta[1]))) + theta[3][0]

    def loss(v):
        return np.log(1 + np.exp(-v))

    toward = prior * np.mean([loss(g(x)) for x in xp])
    negative = np.mean([loss(-g(x)) for x in xu]) - prior * np.mean([loss(-g(x)) for x in xp])
    return toward, negative


@pytest.mark.parametrize(("prior", "sign"), [(0.3, 1), (0.999, -1)])
def test_gradient_by_finite_differences(prior, sign):
    rng = np.random.default_rng(4)
    theta = [rng.normal(0, 1, (3, 2)), rng.normal(0, 1, 2), rng.normal(0, 1, 2), rng.normal(0, 1, 1)]
    xp, xu = rng.normal(1, 1, (7, 3)), rng.normal(0, 1, (9, 3))
    if sign < 0:  # unlabelled rows that score low, positives that score high: the negative part falls below zero
        xu, xp = np.full((9, 3), -2.0) * np.sign(theta[0] @ theta[2]), np.full((7, 3), 2.0) * np.sign(theta[0] @ theta[2])
    toward, negative = plain_risk(theta, xp, xu, prior)
    assert np.sign(negative) == sign

    def objective():
        t, n = plain_risk(theta, xp, xu, prior)
        return t + n if sign > 0 else -n

    made = pu.gradient(theta, xp, xu, prior)
    for weights, slope in zip(theta, made, strict=True):
        for at in np.ndindex(weights.shape):
            kept = weights[at]
            weights[at] = kept + 1e-6
            high = objective()
            weights[at] = kept - 1e-6
            low = objective()
            weights[at] = kept
            assert slope[at] == pytest.approx((high - low) / 2e-6, abs=1e-5)


def test_features_restated():
    lexicon = {b"vermin": 2.0, b"good": -1.0, b"verm-": 1.5}
    text = "Vermin, vermins good GOOD\n\n1 é"
    ws = ["vermin", "vermins", "good", "good", "1", "é"]
    weights = [2.0, 1.5, -1.0, -1.0, 0.0, 0.0]
    up = sum(w for w in weights if w > 0)
    expected = [up / 6, min(1, 20 * up / 6), np.log1p(up), 2 / 6, 2 / 6, 2 / 6, 1.0, 1.0]
    got = pu.features(text.encode(), pu.Weights(lexicon), False)
    assert got == pytest.approx(expected)
    form = pu.features(text.encode(), pu.Weights(lexicon), True)[:13]
    n = len(text.encode())
    assert form == pytest.approx([
        np.log1p(6), np.log1p(n), sum(c.isupper() for c in text) / n, 1 / n, 0, 1 / n, sum(c.isspace() for c in text) / n,
        len(set(ws)) / 6, 1 / 6, 1.0, np.log1p(n / 2), 0.0, (n / 6) ** 0.5,
    ])


@pytest.mark.parametrize("share", [0.05, 0.2, 0.5, 0.8])
def test_prior_from_positives_and_unlabelled(share):
    rng = np.random.default_rng(int(100 * share))
    positive = rng.normal(1.5, 1, (2000, 3))
    n = int(4000 * share)
    mixed = np.concatenate([rng.normal(1.5, 1, (n, 3)), rng.normal(-1.5, 1, (4000 - n, 3))])
    found = pu.estimate_prior(positive, rng.permutation(mixed), pu.Settings("y"))
    assert found == pytest.approx(share, abs=0.05)


@pytest.mark.parametrize("op", [toxicity, quality])
def test_labelled_negatives_are_never_read(spark, corpus, op):
    docs, labels = corpus
    name = op.SETTINGS.label
    a, b = (sorted(map(repr, op.score(docs, x).collect())) for x in (labels, labels.where(f"{name} = 1")))
    assert a == b


def test_positives_alone_on_a_whole_table(spark):
    docs, labels = (spark.read.parquet(f"{SMALL_TABLES}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.score(docs, labels.where("toxic = 1")).where("held_out").collect()
    held = [(r.predicted, truth[r.doc_id]) for r in rows if truth.get(r.doc_id) is not None]
    assert np.mean([a == b for a, b in held]) > 0.93


def test_sample_bounds_hold_for_repeated_ids(spark, corpus):
    docs, labels = corpus
    hot = next(r.doc_id for r in labels.where("toxic = 1 AND crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 <> 0").collect())
    many = docs.select("doc_id", "text").union(spark.range(3000).selectExpr(f"CAST({hot} AS BIGINT)", "concat('copy ', id % 7)"))
    s = pu.Settings("toxic", positives=40, unlabelled=100)
    drawn = pu.sample(many, labels, s).groupBy("positive").count().collect()
    n = {r.positive: r["count"] for r in drawn}
    assert n[True] <= 40 and 50 <= n[False] <= 100
    everything = pu.Settings("toxic", positives=10_000, unlabelled=10_000)
    n = {r.positive: r["count"] for r in pu.sample(many, labels, everything).groupBy("positive").count().collect()}
    usable = [r.doc_id for r in docs.select("doc_id").collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    assert n[False] == len(usable)
