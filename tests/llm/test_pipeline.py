"""The pipeline's stages, in order, on documents planted with what each has to catch."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from shelfcast.llm.common import fresh_path
from tests.llm.tables import documents, words


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    passage = words(rng, 70)
    texts = [" ".join(words(rng, int(n))) for n in rng.integers(5, 150, 120)]
    toxic = [" ".join([*words(rng, 40), "dreadfulscum", *words(rng, 20)]) for _ in range(60)]
    near = [texts[0] + " tail", *[texts[k] for k in (1, 2, 2)]]
    shared = [" ".join([*words(rng, 80), *passage, *words(rng, 80)]) for _ in range(4)]
    docs = documents(spark, texts + toxic + near + shared + [None, "", " "], clashing=False)
    folder = fresh_path(spark, "planted")
    docs.write.parquet(f"{folder}/documents.parquet")
    n = len(texts)
    labels = [(k, 1, int(n <= k < n + 60)) for k in range(n + 60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, n, " ".join(passage)


def test_stages(spark, planted):
    folder, n, passage = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert k == 4 or out.columns == columns, name
        out.write.parquet(path := fresh_path(spark, "stage"))
        docs = spark.read.parquet(path)
        seen[k] = docs.collect()
    clean, toxic, near, shared = set(range(n)), set(range(n, n + 60)), set(range(n + 60, n + 64)), set(range(n + 64, n + 68))
    empty = set(range(n + 68, n + 71))
    after = [{r.doc_id for r in seen[k]} for k in range(4)]
    assert len(toxic & after[0]) <= 3 and clean | near | shared | empty <= after[0]
    assert after[1] == after[0] - near
    assert after[2] == after[1]
    first, *rest = sorted((r for r in seen[2] if r.doc_id in shared), key=lambda r: r.doc_id)
    assert passage in first.text and all(passage not in r.text and len(r.text.split()) == 160 for r in rest)
    before = {r.doc_id: r.text for r in seen[1]}
    assert all(before[r.doc_id] == r.text for r in seen[2] if r.doc_id not in shared)
    sizes = sum(len((r.text or "").split()) for r in seen[2])
    assert abs(sum(len((r.text or "").split()) for r in seen[3]) - 1.5 * sizes) <= 3
    assert max(np.unique([r.doc_id for r in seen[3]], return_counts=True)[1]) <= 2
    assert len(seen[4]) == len(seen[3]) and all(r.round_trip for r in seen[4])


def test_run_equals_the_stages(spark, planted):
    rows = corpus_pipeline.run(spark, planted[0])
    assert rows.columns[0] == "doc_id" and rows.where("NOT round_trip").count() == 0 and rows.count() > 100


def test_empty_documents(spark, planted):
    docs = spark.read.parquet(f"{planted[0]}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, planted[0]).count() == 0
