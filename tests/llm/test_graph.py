from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from farebox.llm import graph


def expected(rows, threshold=0.98):
    """n_links and component_id by position of the row."""
    ok, unit = [], {}
    for i, (_, vec, label) in enumerate(rows):
        if label is None or not vec or any(v is None or not np.isfinite(v) for v in vec) or not any(vec):
            continue
        x = np.array(vec, float)
        unit[i] = x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max())
        ok.append(i)
    near = {i: [j for j in ok if j != i and rows[j][2] == rows[i][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in ok}
    out = {}
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out[i] = (vec_id, len(near.get(i, ())), min(ids, default=None))
    return sorted(map(repr, out.values()))


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(700, 16))
    close = np.concatenate([c + 0.03 * rng.normal(size=(40, 16)) for c in base[:6]])
    chain = np.array([np.cos(a) * base[10] / np.linalg.norm(base[10]) + np.sin(a) * np.eye(16)[0] for a in np.arange(0, 3, 0.15)])
    x = np.concatenate([base, close, chain, base[:5], base[:3] * 7]).astype(np.float32)
    return [(i, v.tolist(), i % 2) for i, v in enumerate(x)]


@pytest.mark.parametrize("shard", [2000, 60])  # one shard a label; many, with nodes between them
def test_against_brute_force(spark, vectors, shard):
    odd = [
        (9000, None, 1), (9001, [], 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [None, 1.0], 1), (9005, vectors[0][1], None),
        (9006, [float("inf"), 1.0], 0), (9007, [1.0, 1.0], 0), (9008, [2.0, 2.0], 0), (9009, [1e-30, 1e-30], 0), (None, [1.0, 0.0], 1),
        (9010, [-0.0, 1.0], 1), (9011, [0.0, 1.0], 1), (9011, [0.0, 1.0], 1),
    ]
    rows = vectors + odd
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS node", "2 AS n_links")
    settings = graph.Settings(shard=shard, overlap=2)
    result = graph.near_duplicates(frame, settings)
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    assert sorted(repr((r.vec_id, r.n_links, r.component_id)) for r in result.collect()) == expected(rows32)
    assert all(r.kept == (r.vec_id == r.component_id) for r in result.collect())


def test_recall_is_audited(spark, vectors):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    assert graph.audit_recall(frame, graph.near_duplicates(frame)) >= 0.99
    assert graph.near_duplicates(frame.limit(0)).count() == 0
    odd = [(20, None, 1), (40, [], 1), (60, [0.0] * 16, 1), (80, [None, 1.0], 1), (100, [1.0, 2.0], 0), (120, [2.0, 4.0], 0), (140, [1.0] * 16, None)]
    mixed = spark.createDataFrame([v for v in vectors if v[0] % 7 == 0 and v[0] > 140] + odd + [(None, [1.0, 2.0], 0)], frame.schema)
    found = graph.near_duplicates(mixed)
    assert graph.audit_recall(mixed, found, block=3) == 1.0
    assert graph.audit_recall(mixed, found.withColumn("n_links", F.lit(0))) == 0.0
    assert graph.audit_recall(mixed.limit(0), found) == 1.0


def test_every_node_is_reached():
    rng = np.random.default_rng(1)
    x = np.concatenate([c + 1e-3 * rng.normal(size=(100, 8)) for c in np.eye(8)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = graph.Settings()
    edges = graph.build(x, s)
    assert graph._reached(edges, len(x), int(np.argmax(x @ x.mean(0)))).all()
    assert np.bincount(edges[:, 0]).max() <= 2 * s.degree + len(np.eye(8))
    q, v = graph.search(x, graph._table(edges, len(x)), np.arange(0, 800, 50), s)
    assert np.bincount(q, minlength=800)[::50].min() == 99


def test_dense_group_of_many_shards(spark):
    """Different near-copies of one vector: each is linked with nearly all others, so with members of every shard."""
    n, dim = 20_000, 64
    rng = np.random.default_rng(6)
    x = np.eye(dim)[0] + 0.0152 * rng.normal(size=(n, dim))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = [int((unit[i : i + 500] @ unit.T >= 0.98).sum(1).sum()) - 500 for i in range(0, n, 500)]
    assert 0.2 < sum(true) / n / (n - 1) < 1
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    result = graph.near_duplicates(frame).toPandas().set_index("vec_id").sort_index()
    assert [int(result.n_links[i : i + 500].sum()) for i in range(0, n, 500)] == true
    assert result.component_id.nunique() == 1


def test_shards_of_links_are_visited():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3_000, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = x[:40].copy()
    centres[5] = centres[6]
    home, visits = graph._visits(x, centres, 0.98)
    a, b = np.nonzero(x @ x.T >= 0.98)
    assert visits[a, home[b]].all() and visits.mean() < 0.5


def test_links_are_counted_at_both_ends():
    rng = np.random.default_rng(9)
    x = np.eye(24)[0] + 0.025 * rng.normal(size=(1_500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    one, other = np.arange(0, 1_500, 2), np.arange(1, 1_500, 2)
    threshold = float(np.einsum("i,i->", x[0], x[1]))  # a pair right at the threshold among them
    near = x @ x.T >= threshold
    for parts, met in (((one, other), (np.arange(1_500) % 2)[:, None] != np.arange(1_500) % 2), ((np.arange(1_500), None), ~np.eye(1_500, dtype=bool))):
        links, _ = graph._compared(x, np.ones(1_500, np.int64), *parts, threshold)
        pair = np.arange(1_500) < 2
        assert (links[~pair] == (near & met).sum(1)[~pair]).all()
        assert links.sum() % 2 == 0
    ones, _ = graph._compared(x, np.ones(1_500, np.int64), one, other, threshold)
    assert ones[one].sum() == ones[other].sum()  # each link across counts once on either side
