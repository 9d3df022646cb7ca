"""The pipeline's stages against the operators' own results, each on what the stage before kept."""

from __future__ import annotations

import hashlib

import sentencepiece

import corpus_pipeline as cp
from farebox.llm import decontaminate, quality, simhash, toxicity
from farebox.llm.queries import QUERIES, table

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, model_path):
    docs = table(spark, SMALL, "documents").cache()
    labels = table(spark, SMALL, "labels")
    columns, frames = docs.columns, [docs]
    for _, stage in cp.STAGES:
        frames.append(stage(spark, frames[-1], SMALL).cache())
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality", "simhash", "decontamination", "sentencepiece"]
    assert all(f.columns == columns for f in frames[:-1])
    ids = [sorted(r.doc_id for r in f.select("doc_id").collect()) for f in frames]
    bad = {r.doc_id for r in toxicity.score(docs, labels).where("predicted = 1").collect()}
    assert ids[1] == [i for i in ids[0] if i not in bad]
    poor = {r.doc_id for r in quality.score(frames[1], labels).where("predicted = 0").collect()}
    assert ids[2] == [i for i in ids[1] if i not in poor]
    assert ids[3] == sorted({r.component_id for r in simhash.near_duplicates(frames[2]).collect()})
    scanned = {r.doc_id: r.n_hit / max(r.n_words, 1) for r in decontaminate.scan(frames[3], table(spark, SMALL, "benchmark")).collect()}
    assert ids[4] == [i for i in ids[3] if scanned[i] <= 0.2]
    assert not decontaminate.scan(frames[4], table(spark, SMALL, "benchmark")).where("n_hit > 0").count()
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    text = {r.doc_id: r.text for r in frames[4].select("doc_id", "text").collect()}
    for r in frames[5].collect():
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, model.encode(text[r.doc_id]))).encode()).hexdigest()
    assert sorted(map(repr, cp.run(spark, SMALL).collect())) == sorted(map(repr, frames[5].collect()))


def test_one_query_per_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


def test_the_near_duplicate_stage_broadcasts_nothing(spark, monkeypatch):
    """What it joins grows with the documents; the pipeline's driver isn't sized for it."""
    plans, cut = [], simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df, label: (plans.append(df._jdf.queryExecution().toString()), cut(df, label))[1])
    docs = table(spark, SMALL, "documents").limit(30)
    kept = cp.drop_near_duplicates(spark, docs, SMALL)
    plans.append(kept._jdf.queryExecution().toString())
    sent = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line and "[root#" not in line]
    assert 0 < kept.count() <= 30 and not sent  # sizes of roots are known from a shuffle
