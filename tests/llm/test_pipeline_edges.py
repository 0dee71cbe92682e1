"""The whole pipeline on empty tables, null ids and texts, repeated rows and columns named like the operators' own."""

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, part string, n int, label string"
PROSE = "The river {0} rose in spring and the village {0} moved its boats to the upper bank before noon while children carried nets along the wet path to the mill."


@pytest.mark.parametrize("filled", [False, True])
def test_odd_tables(spark, tmp_path, filled):
    rows = [(i, PROSE.format(chr(97 + i) * 5), "en", "s", 1, 7, "p", 3, "x") for i in range(4)] if filled else []
    rows += [(None, PROSE.format("zzzz"), None, None, None, None, None, None, None), (3, PROSE.format("ddddd"), "en", "s", 1, 7, "p", 3, "x"), (9, None, "en", "s", 0, 0, "", 0, ""), (10, "", "en", "s", 0, 0, "", 0, "")] if filled else []
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert (None in got and {0, 1, 2, 3} >= {d for d in got if d is not None} and 0 in got) if filled else got == []
