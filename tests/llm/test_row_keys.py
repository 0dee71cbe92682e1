"""Rows of one id: each text is a document of its own, however many share the id."""

import time

import numpy as np

from strataloom.llm import jaccard, secretscan


def _texts(n, seed=0):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{x}" for x in rng.integers(0, 10**9, 12)) for _ in range(n)]


def test_many_texts_of_one_id_lose_none(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "ID_SHIFT", 8)  # so that keys clash often
    texts = _texts(1500)
    rows = [(5, t) for t in texts] + [(2, texts[7]), (5, texts[9]), (9, texts[11])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {(r["doc_id"], r["text"]) for r in jaccard.drop_near_copies(docs).collect()}
    assert kept == {(5, t) for k, t in enumerate(texts) if k != 7} | {(2, texts[7])}
    found = sorted((r["doc_id"], r["component_id"]) for r in jaccard.classes(docs).collect())
    assert found == sorted([(2, 2), (5, 2), (9, 5)] + [(5, 5)] * 1500)


def test_scans_are_linear_in_the_text():
    compiled = secretscan.compile_rules()
    for unit, n_spans in ((b"token=a ", 0), (b"AKIA", 1), (b"0123456789abcdef", 1), (b"-----BEGIN RSA PRIVATE KEY-----\n", 32768), (b"token=abcdefg ", (1 << 20) // 14)):
        data = np.frombuffer(unit * ((1 << 20) // len(unit)), np.uint8)
        began = time.perf_counter()
        spans = secretscan.find_secrets(compiled, secretscan.RULES, data, np.array([0, len(data)]))[0]
        assert len(spans) == n_spans and time.perf_counter() - began < 20  # seconds on a machine that is busy; quadratic scans took minutes
