"""The pipeline on planted cases: what must go goes, what is clean stays."""

from __future__ import annotations

import random

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    rng = random.Random(9)
    root = tmp_path_factory.mktemp("corpus")
    texts = {i: prose(rng, 80, "aeioustrn" if i % 2 else "öäüßkwzfg") for i in range(30)}
    item = prose(rng, 20)
    texts |= {50: texts[3], 51: texts[4].upper().replace("SS", "ß"), 60: "12 34 56 78 !! ??", 61: None, 62: ""}
    texts |= {70: texts[0][:-1] + "a\n" + item + "\n" + prose(rng, 60), 71: item, 80: "password: hunter2hunter2 " + prose(rng, 60)}
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    names = ("doc_id", "text", "lang", "source", "n_chars")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
    pq.write_table(pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds))}), root / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": [item]}), root / "benchmark.parquet")
    return str(root), texts, item


def test_stages(spark, planted, tmp_path):
    root, texts, item = planted
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, root).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs)
        if name != "mix":
            assert docs.columns == columns
    kept = [{r["doc_id"]: r["text"] for r in d.collect()} for d in seen[:4]]
    clean = set(range(30))
    assert clean <= set(kept[0]) and not {60, 61, 62} & set(kept[0])
    assert clean <= set(kept[1]) and 50 not in kept[1]
    assert all(kept[2][i] == texts[i] for i in clean) and 71 not in kept[2] and item not in kept[2][70]
    assert "hunter2" not in kept[3][80] and all(kept[3][i] == texts[i] for i in clean)
    mixed = seen[4].collect()
    assert {r["doc_id"] for r in mixed} <= set(kept[3]) and clean & {r["doc_id"] for r in mixed}
    assert corpus_pipeline.run(spark, root).count() == len(mixed)


def test_empty(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
