from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from test_jaccard import slow_groups, slow_sets

from causal_panel.llm import surrogates, toxicity
from causal_panel.llm.queries import SURROGATE_KEY

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, documents, texts):
    docs, seen = documents, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == documents.columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(documents, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert set(seen[0]) == {i for i in texts if scores[i] < 0.5}
    ids = sorted(seen[0])
    groups = slow_groups(slow_sets([texts[i] for i in ids]))
    assert set(seen[1]) == {ids[k] for k in groups}
    squash = lambda t: " ".join(t.lower().split())
    items = [squash(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(seen[2]) == {i for i in seen[1] if not any(x in squash(texts[i]) for x in items)}
    assert seen[3] == {i: surrogates.rewrite(texts[i], SURROGATE_KEY, {})[0] for i in seen[2]}
    mixed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in mixed} == set(seen[3])
    taken = defaultdict(int)
    for r in mixed:
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= 1 for r in mixed)


def test_odd_rows_pass_all_stages(spark, odd, none, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns go through; an empty table gives an empty result."""
    labels = spark.createDataFrame([(4, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd), ("none", none)):
        folder = f"{tmp_path}/{name}"
        docs.withColumn("lang", F.lit("en")).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    kept = {r.doc_id for r in rows}
    assert kept <= {1, 4, 6, None} and {1, 4} <= kept and len([r for r in rows if r.doc_id is not None]) == len(kept - {None})
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
