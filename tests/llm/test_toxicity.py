from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from causal_panel.llm import toxicity


def test_risk_with_hidden_positives():
    """Two thirds of the toxic texts are unlabelled; the prior tells how many there are."""
    draw = np.random.default_rng(1)
    texts, toxic = [], []
    for k in range(1500):
        bad = k % 5 == 0
        texts.append([f"w{i}" for i in draw.choice(60, 12, replace=False)] + (["vile"] if bad else []))
        toxic.append(bad)
    confirmed = np.array([t and k % 3 == 0 for k, t in enumerate(toxic)])
    code = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
    model = toxicity.fit(np.append(0, np.cumsum([len(t) for t in texts])), np.array([code[w] for t in texts for w in t]), confirmed, 0.2)
    score = np.array([model[None] + sum(model.get(code[w], 0) for w in t) for t in texts])
    assert ((score > 0) == np.array(toxic)).mean() > 0.98


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (found["predicted"] == (found["score"] >= 0.5)).all() and found["score"].between(0, 1).all()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) for i in found["doc_id"])
    insulted = docs.filter(F.lower("text").rlike(r"\b(idiot|scum|moron|trash|loser)\b")).select("doc_id").toPandas()["doc_id"]
    hit = found["doc_id"].isin(insulted)
    assert found[hit]["predicted"].mean() > 0.97 and found["predicted"].mean() < 0.12
    assert (found["predicted"] == found["toxic"]).mean() > 0.92  # a twentieth of the labels is noise


def test_held_out_labels_are_not_read(documents, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.learnable(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    one, two = (sorted(toxicity.score_toxicity(documents, x).collect(), key=lambda r: r.doc_id) for x in (labels, turned))
    assert one == two


def test_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, None), (None, 1)], "doc_id long, toxic int")
    found = toxicity.score_toxicity(odd.withColumns({c: F.lit(1) for c in ("_id", "_text", "held_out", "positive", "fold")}), labels).collect()
    assert len(found) == 8 and all(0 <= r.score <= 1 for r in found)
    assert {r.held_out for r in found if r.doc_id is None} == {True}
    assert [r.score for r in toxicity.score_toxicity(odd, labels.filter("false")).collect()] == [0.0] * 8
    assert toxicity.score_toxicity(none, labels).collect() == []
    assert toxicity.clean_only(odd, labels.filter("false")).columns == odd.columns


def test_a_step_against_brute_force():
    """One round from zero weights: slopes of the risk by differences of the risk itself, on both branches."""
    draw = np.random.default_rng(2)
    n, width = 40, 6
    row, col = np.nonzero(draw.random((n, width)) < 0.5)
    for prior, share, sampled in ((0.3, 0.3, 1.0), (0.9, 0.1, 1.0), (0.2, 0.3, 0.6), (0.9, 0.3, 0.5)):
        positive, drawn = draw.random(n) < share, draw.random(n) < sampled

        def risk(weight, bias, part):
            z = bias + np.bincount(row, weight[col], n)
            clean = np.logaddexp(0, z[drawn]).mean() - prior * np.logaddexp(0, z[positive]).mean()
            return (prior * np.logaddexp(0, -z[positive]).mean() + clean) if part == "whole" else -clean

        start = np.log(prior / (1 - prior))
        clean_risk = -risk(np.zeros(width), start, "clean")
        part = "whole" if clean_risk >= 0 else "clean"
        slope = [(risk(np.eye(width)[k] * 1e-6, start, part) - risk(np.eye(width)[k] * -1e-6, start, part)) / 2e-6 for k in range(width)]
        weight, _ = toxicity._descend(row, col, width, positive, prior, 1, 0.5, 0.0, drawn)
        assert (np.sign(weight) == -np.sign(slope)).all() and np.allclose(np.abs(weight), 0.5, atol=1e-3)  # the first step of each weight is `rate` long


def test_clean_risk_below_zero_is_met(documents, spark, monkeypatch):
    """On the given tables, documents of all kinds as unlabelled texts, both branches of the risk are taken."""
    real, seen = toxicity._slope, []
    monkeypatch.setattr(toxicity, "_slope", lambda *given: seen.append(real(*given)[1]) or real(*given))
    toxic = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("toxic = 1").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    words = [sorted(toxicity.words_of(r.text)) for r in rows]
    code = {w: k for k, w in enumerate(sorted(set().union(*words)))}
    confirmed = np.array([r.doc_id in toxic for r in rows])
    toxicity.fit(np.append(0, np.cumsum([len(w) for w in words])), np.array([code[w] for x in words for w in x]), confirmed, 0.12, ~confirmed | (np.arange(len(rows)) % 2 == 0))
    assert any(seen) and not all(seen)


def test_labels_of_unlabelled_texts_are_not_read(documents, spark):
    """Which rows are labelled clean plays no part but for their number."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").filter(toxicity.learnable(F.col("doc_id")))
    others = labels.withColumn("doc_id", F.when(F.col("toxic") == 1, F.col("doc_id")).otherwise(F.col("doc_id") + 1_000_000))
    n, m = (x.filter(toxicity.learnable(F.col("doc_id"))).count() for x in (labels, others))
    prior = labels.filter("toxic = 1").count() / max(n, m)
    assert toxicity.train(documents, labels, prior=prior) == toxicity.train(documents, others, prior=prior)
