"""The pipeline against the plain versions, stage by stage, and its registration."""

import random

import pytest

import __spark_entry__
import corpus_pipeline
from strataloom.llm import cascade

from . import brute


def test_stages(spark, tmp_path):
    rnd = random.Random(5)
    words = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(n))
    base, item = words(60), words(30)
    texts = [words(50), base, base + " end", words(3), "## " * 40, words(20) + " " + item, "password: hunter2222 " + words(40), None]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, current = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, str(tmp_path))
        seen[name] = {r["doc_id"]: r for r in current.collect()}
        if name != "sentencepiece":
            assert current.columns == docs.columns
    assert set(seen["quality_rules"]) == {0, 1, 2, 5, 6} and not any(brute.quality(texts[k])[5] for k in seen["quality_rules"])
    assert set(seen["near_copies"]) == {0, 1, 5, 6}
    assert set(seen["decontamination"]) == {0, 1, 6}
    assert "hunter2222" not in seen["secret_scan"][6]["text"] and seen["secret_scan"][0]["text"] == texts[0]
    assert set(seen["sentencepiece"]) == {0, 1, 6} and all(r["ids"] for r in seen["sentencepiece"].values())
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {0, 1, 6}


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_clean_labelled_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    judged = cascade.judge(docs).join(good, "doc_id").where("not base_failed")
    assert judged.where("not kept").count() == 0


@pytest.mark.parametrize("bad", [None, ""])
def test_entry_survives_blank_texts(bad):
    assert brute.quality(bad)[0] == 0
