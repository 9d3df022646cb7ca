"""Embedding near-dedup by an exact search over pairs of shards.

Equal vectors of a label are one node with a weight. Nodes of a large label are dealt to shards by the nearest of its
centroids, which are fitted on a bounded sample; that shard is a node's home. A linked node lies within a known distance,
and the border to another shard is a plane, so a node further than that from the plane has no link there; it visits all
other shards. Every two shards are one task, and each shard by itself: what is at home in one and visits the other is
compared with the reverse, in blocks, by cosine in double precision. So every link is found once, and counted at both ends.

Links are never listed pair by pair: a task gives numbers of links, and a forest of what hangs together there.

`build` and `search` are a robust-pruned flat graph over one set of vectors and a greedy search in it. `near_duplicates`
doesn't use them: dealt to a few shards a node, they lose links in dense groups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.llm.components import components
from farebox.session import cut


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.98
    shard: int = 500  # nodes at home in a shard, on average
    overlap: int = 2  # of no effect: a node visits as many shards as may hold links of it
    sample: int = 40_000  # nodes that centroids are fitted on, in expectation; 4 per centroid at least
    near: int = 48  # candidates for the neighbours of a node
    random: int = 16
    degree: int = 32
    alpha: float = 1.2
    steps: int = 40  # least number of nodes expanded by a search
    slack: float = 0.03  # below the threshold, cosines that are still explored


def _unit(flat: np.ndarray, n: int) -> np.ndarray:
    x = flat.reshape(n, -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return _unit(np.concatenate([c.values.to_numpy(zero_copy_only=False)[_span(c)] for c in column.chunks]), n)


def _span(c: pa.ListArray) -> slice:
    offsets = c.offsets.to_numpy()
    return slice(int(offsets[0]), int(offsets[-1]))


def _neighbours(x: np.ndarray, s: Settings, seed: int) -> np.ndarray:
    """Robust-pruned neighbours of every vector, -1 where there are fewer."""
    n = len(x)
    rng = np.random.default_rng(seed)
    near = min(s.near, n - 1)
    out = np.full((n, s.degree), -1, np.int64)
    if near < 1:
        return out
    for at in range(0, n, 256):
        own = np.arange(at, min(n, at + 256))
        sims = x[own] @ x.T
        sims[np.arange(len(own)), own] = -2
        close = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        cand = np.concatenate([close, rng.integers(0, n, (len(own), s.random))], axis=1)
        score = np.take_along_axis(sims, cand, 1)
        order = np.argsort(-score, axis=1, kind="stable")
        cand, score = np.take_along_axis(cand, order, 1), np.take_along_axis(score, order, 1)
        alive = score > -2
        alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
        far = np.sqrt(np.maximum(0, 2 - 2 * score))
        vectors = x[cand]
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nid,njd->nij", vectors, vectors)))
        kept = np.zeros(len(own), np.int64)
        for i in range(cand.shape[1]):
            take = np.flatnonzero(alive[:, i] & (kept < s.degree))
            out[own[take], kept[take]] = cand[take, i]
            kept[take] += 1
            # whatever is nearer to this neighbour than to the vector is reached through it
            alive[take] &= ~(s.alpha * between[take, i] <= far[take])
            alive[:, i] = False
    return out


def build(x: np.ndarray, s: Settings, seed: int = 0) -> np.ndarray:
    """Edges (from, to) of the graph of a shard; every node is reached from the medoid."""
    n = len(x)
    out = _neighbours(x.astype(np.float32), s, seed)
    a, b = np.repeat(np.arange(n), s.degree), out.ravel()
    a, b = a[b >= 0], b[b >= 0]
    own = np.bincount(a, minlength=n)
    sims = np.einsum("ij,ij->i", x[a], x[b])
    order = np.lexsort((-sims, b))  # edges back, the nearest first, as far as the degree goes
    a, b = a[order], b[order]
    place = np.arange(len(b)) - np.searchsorted(b, b)
    back = place + own[b] < 2 * s.degree
    edges = np.unique(np.concatenate([np.stack([a, b], 1), np.stack([b[back], a[back]], 1)]), axis=0)
    start = int(np.argmax(x @ x.mean(0)))
    while True:
        reached = _reached(edges, n, start)
        if reached.all():
            return edges
        lost = np.flatnonzero(~reached)[:512]
        sims = x[lost] @ x[reached].T
        near = np.flatnonzero(reached)[sims.argmax(1)]
        edges = np.unique(np.concatenate([edges, np.stack([near, lost], 1), np.stack([lost, near], 1)]), axis=0)


def _reached(edges: np.ndarray, n: int, start: int) -> np.ndarray:
    reached = np.zeros(n, bool)
    reached[start] = True
    while True:
        more = edges[reached[edges[:, 0]] & ~reached[edges[:, 1]], 1]
        if not len(more):
            return reached
        reached[more] = True


def _table(edges: np.ndarray, n: int) -> np.ndarray:
    """Neighbours by node, -1 where there are fewer."""
    edges = edges[np.argsort(edges[:, 0], kind="stable")]
    place = np.arange(len(edges)) - np.searchsorted(edges[:, 0], edges[:, 0])
    out = np.full((n, int(place.max(initial=-1)) + 1), -1, np.int64)
    out[edges[:, 0], place] = edges[:, 1]
    return out


def _medoids(x: np.ndarray, many: int = 4) -> np.ndarray:
    """The medoid, and nodes far from it and from each other."""
    found = [int(np.argmax(x @ x.mean(0)))]
    nearest = x @ x[found[0]]
    while len(found) < min(many, len(x)):
        found.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[found[-1]])
    return np.unique(found)


def search(x: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) that the graph search finds with cosine at or above the threshold, the query left out."""
    n = len(x)
    small = x.astype(np.float32)
    starts = _medoids(small)
    wide = s.threshold - s.slack
    found_q, found_v = [], []
    step = max(16, min(256, (1 << 21) // max(n, 1)))
    for at in range(0, len(queries), step):
        q = queries[at : at + step]
        sims = np.full((len(q), n), -2, np.float32)
        sims[:, starts] = small[q] @ small[starts].T
        todo = np.full((len(q), n), -2, np.float32)  # cosines of what is found and not expanded
        todo[:, starts] = sims[:, starts]
        for k in range(n):
            best = todo.argmax(1)
            value = todo[np.arange(len(q)), best]
            go = np.flatnonzero((value > -2) & ((value >= wide) | (k < s.steps)))
            if not len(go):
                break
            inside_q, inside_v = np.nonzero(todo >= wide)
            who = np.concatenate([go, inside_q])
            node = np.concatenate([best[go], inside_v])
            todo[who, node] = -2
            to = neighbours[node]
            who = np.broadcast_to(who[:, None], to.shape)[to >= 0]
            key = np.unique(who * n + to[to >= 0])
            key = key[sims.ravel()[key] == -2]
            who, node = key // n, key % n
            for i in range(0, len(key), 1 << 18):
                w, v = who[i : i + (1 << 18)], node[i : i + (1 << 18)]
                cosines = np.einsum("ij,ij->i", small[q[w]], small[v])
                sims[w, v] = np.maximum(cosines, -1)
                todo[w, v] = sims[w, v]
        w, v = np.nonzero(sims >= s.threshold - 1e-4)
        for i in range(0, len(w), 1 << 18):
            a, b = q[w[i : i + (1 << 18)]], v[i : i + (1 << 18)]
            sure = (np.einsum("ij,ij->i", x[a], x[b]) >= s.threshold) & (a != b)
            found_q.append(a[sure])
            found_v.append(b[sure])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(found_q), np.concatenate(found_v)) if found_q else (empty, empty)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that hangs together with each node over links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _centroids(nodes: DataFrame, s: Settings) -> dict[tuple[int, int], np.ndarray]:
    """By label and length of vectors, for those with more nodes than a shard: centroids of a bounded sample."""
    large = nodes.groupBy("label", "dim").count().where(F.col("count") > s.shard)
    total = large.agg(F.sum("count")).first()[0]
    if not total:
        return {}
    share = min(1.0, s.sample / total)
    drawn = nodes.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = drawn.join(large, ["label", "dim"]).select("label", "dim", "count", "vec").toArrow()  # some `sample` rows
    of = list(zip(rows.column("label").to_pylist(), rows.column("dim").to_pylist(), strict=True))
    sizes = dict(zip(of, rows.column("count").to_pylist(), strict=True))
    vectors = rows.column("vec").combine_chunks()
    out = {}
    for key, size in sorted(sizes.items()):
        at = [i for i, k in enumerate(of) if k == key]
        k = min(-(-size // s.shard), len(at) // 4)
        if k < 2:
            continue
        x = _unit(vectors.take(pa.array(at)).values.to_numpy(zero_copy_only=False), len(at))
        x = x[np.lexsort(x.T)]
        centres = x[np.random.default_rng(0).choice(len(x), k, replace=False)]
        for _ in range(8):
            home = (x @ centres.T).argmax(1)
            for c in range(k):
                own = x[home == c]
                if len(own):
                    mean = own.mean(0)
                    centres[c] = mean / max(np.linalg.norm(mean), 1e-12)
        out[key] = centres
    return out


def _visits(x: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The home of each vector, and by vector and shard whether one at home in the shard may be linked with it.

    With u the unit vector from centroid B to centroid A, x.u >= 0 for what is at home in A and <= 0 for what is at home
    in B. Linked vectors are at most sqrt(2 - 2 threshold) apart, so x.u is no larger if x has a link in B.
    """
    scores = x @ centres.T
    home = scores.argmax(1)
    own = centres[home]
    square = np.einsum("ij,ij->i", centres, centres)
    apart = np.sqrt(np.maximum(0, square[home, None] + square[None, :] - 2 * own @ centres.T))
    reach = np.sqrt(max(0.0, 2 - 2 * threshold))
    return home, scores[np.arange(len(x)), home][:, None] - scores <= reach * apart + 1e-6  # more than rounding errors


def _dealt(nodes: DataFrame, s: Settings) -> DataFrame:
    """Nodes with `shards`, numbers of their shards within the label: home, then those that it visits."""
    shared = nodes.sparkSession.sparkContext.broadcast(_centroids(nodes, s))

    def run(batches):
        centroids = shared.value
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
            shards = [[0]] * batch.num_rows
            for key in set(keys) & centroids.keys():
                at = [i for i, k in enumerate(keys) if k == key]
                for first in range(0, len(at), 512):
                    part = at[first : first + 512]
                    own = batch.column("vec").take(pa.array(part))
                    x = _unit(own.values.to_numpy(zero_copy_only=False)[_span(own)], len(part))
                    home, visits = _visits(x, centroids[key], s.threshold)
                    visits[np.arange(len(part)), home] = False
                    for i, h, row in zip(part, home.tolist(), visits, strict=True):
                        shards[i] = [h, *np.flatnonzero(row).tolist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(shards, pa.list_(pa.int32()))], names=[*batch.schema.names, "shards"]
            )

    kind = nodes.schema["vec"].dataType.simpleString()
    schema = f"node long, label long, dim int, vec {kind}, weight long, shards array<int>"
    return nodes.select("node", "label", "dim", "vec", "weight").mapInArrow(run, schema)


def _compared(
    x: np.ndarray, weight: np.ndarray, one: np.ndarray, other: np.ndarray | None, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """By vector: weight linked to it, and the least vector that it hangs together with.

    Compared are the vectors `one` with the vectors `other`, or `one` among themselves where that is None.
    """
    n = len(x)
    links, root, weight = np.zeros(n, np.int64), np.arange(n), weight.astype(np.float64)
    for i in range(0, len(one), 512):
        a = one[i : i + 512]
        with_ = one[i:] if other is None else other
        for j in range(0, len(with_), 4096):
            b = with_[j : j + 4096]
            sims = x[a] @ x[b].T
            near = sims >= threshold
            p, q = np.nonzero(np.abs(sims - threshold) < 1e-12)  # so close that the order of summing decides
            near[p, q] = np.einsum("ij,ij->i", x[a[p]], x[b[q]]) >= threshold
            if other is None and j == 0:
                near[:, : len(a)] &= np.tri(len(a), k=-1, dtype=bool).T  # each pair once
            ones = near.astype(np.float64)
            links[a] += (ones @ weight[b]).astype(np.int64)
            links[b] += (weight[a] @ ones).astype(np.int64)
            p, q = np.nonzero(near & (root[a][:, None] != root[b][None, :]))
            if len(p):
                root = _roots(root[a[p]], root[b[q]], n)[root]
    return links, root


_KEYS = ["label", "dim", "shard", "visited"]


def _searched(dealt: DataFrame, s: Settings) -> DataFrame:
    """`node, n_links, root`: links of a node, in parts that add up, and the least node that it hangs together with."""

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("node").to_numpy(), kind="stable")))
        ids, n = t.column("node").to_numpy(), t.num_rows
        weight = t.column("weight").to_numpy()
        here = t.column("first").to_numpy(zero_copy_only=False)
        alone = t.column("shard")[0] == t.column("visited")[0]
        one, other = np.flatnonzero(here), None if alone else np.flatnonzero(~here)
        links, root = _compared(_vectors(t.column("vec"), n), weight, one, other, s.threshold)
        if alone:
            links += weight - 1
        told = links > 0 if not alone else np.ones(n, bool)
        return pa.table({
            "node": pa.array(ids[told], pa.int64()), "n_links": pa.array(links[told], pa.int64()),
            "root": pa.array(ids[root[told]], pa.int64()),
        })

    home = F.col("shards")[0]
    met = dealt.select("node", "label", "dim", "vec", "weight", home.alias("home"), F.explode("shards").alias("to"))
    pairs = met.select(
        "node", "label", "dim", "vec", "weight", F.least("home", "to").alias("shard"), F.greatest("home", "to").alias("visited"),
        (F.col("home") <= F.col("to")).alias("first"),
    )
    return pairs.groupBy(*_KEYS).applyInArrow(run, "node long, n_links long, root long")


def _rows(embeddings: DataFrame) -> DataFrame:
    """`vec_id, label, vec, good`: good vectors have a label, and finite components that aren't all zero."""
    single = embeddings.schema["embedding"].dataType.elementType.simpleString() == "float"
    vec = F.transform("embedding", lambda x: x.cast("float" if single else "double"))  # unit vectors are in double precision
    good = (
        F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    return embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vec.alias("vec"),
        F.coalesce(good, F.lit(False)).alias("good"),
    )


def near_duplicates(embeddings: DataFrame, s: Settings = Settings()) -> DataFrame:
    """`vec_id, n_links, component_id, kept` per vector; links join vectors of one label with cosine >= threshold.

    Vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with
    nothing: 0 links, a component of their own. Only vectors of the same length are compared. Every row is a vector, so
    rows that repeat a vector link with each other. Of rows with a null vec_id, component_id is the least vec_id they
    reach; it is null, and kept true, where there is none.
    """
    rows = _rows(embeddings)
    linked = rows.where("good")
    nodes = cut(
        linked.groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
        .select(F.monotonically_increasing_id().alias("node"), "label", F.size("vec").alias("dim"), "vec", "least", "weight"),
        "nodes",
    )
    searched = cut(_searched(_dealt(nodes, s), s), "searched")
    found = components(searched.select("node", "root"))
    groups = nodes.select("node", "least").join(found, "node").groupBy("root").agg(F.min("least").alias("component_id"))
    grouped = found.join(groups, "root").select("node", "component_id", F.lit(True).alias("found"))
    facts = (
        nodes.select("node", F.col("label").alias("l"), F.col("vec").alias("v"), "least")
        .join(searched.groupBy("node").agg(F.sum("n_links").alias("n_links")), "node").join(grouped, "node", "left")
        .select("l", "v", "n_links", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    )
    met = linked.join(facts, (F.col("label") == F.col("l")) & (F.col("vec") == F.col("v")))
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return met.select("vec_id", "n_links", "component_id").union(alone).select(
        "*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def audit_recall(embeddings: DataFrame, result: DataFrame, s: Settings = Settings(), block: int = 512) -> float:
    """Share of the true links of every 20th vec_id, counted against all rows, that `result` reports.

    Queries are taken in blocks of some `block` rows by a hash of their id, one pass over all rows for each; counts stay
    in Spark, where they are laid beside `result`. Vectors that link with nothing are left out, as are ids that repeat.
    Vectors of other labels or lengths aren't compared. Without true links the recall is 1.
    """
    good = _rows(embeddings).where("good").select("vec_id", "label", "vec")
    single = result.groupBy("vec_id").agg(F.count(F.lit(1)).alias("rows"), F.max("n_links").alias("told")).where("rows = 1")
    queries = good.where("vec_id % 20 = 0")
    n_blocks = -(-queries.count() // block)
    true: DataFrame | None = None
    for number in range(n_blocks):
        t = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == number).toArrow()
        by_size: dict[int, list[int]] = {}
        for at, size in enumerate(pc.list_value_length(t.column("vec")).to_pylist()):
            by_size.setdefault(size, []).append(at)
        asked = []
        for size, places in by_size.items():
            own = t.take(pa.array(places))
            x = _vectors(own.column("vec"), len(places))
            asked.append((size, own.column("vec_id").to_numpy(), own.column("label").to_numpy(), x))

        def count(batches, asked=asked):
            for b in batches:
                sizes = pc.list_value_length(b.column("vec")).to_numpy(zero_copy_only=False)
                for size, ids, labels, x in asked:
                    part = b.filter(pa.array(sizes == size))
                    if not part.num_rows:
                        continue
                    vec = part.column("vec")
                    y = _unit(vec.values.to_numpy(zero_copy_only=False)[_span(vec)], part.num_rows)
                    near = (x @ y.T >= s.threshold) & (labels[:, None] == part.column("label").to_numpy()[None, :])
                    near &= ids[:, None] != part.column("vec_id").fill_null(-1).to_numpy()[None, :]
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near.sum(1))], names=["vec_id", "n"])

        counted = good.mapInArrow(count, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
        true = counted if true is None else true.union(counted)
    if true is None:
        return 1.0
    found, total = true.join(single, "vec_id").agg(F.sum(F.least("n", "told")), F.sum("n")).first()
    return found / total if total else 1.0
