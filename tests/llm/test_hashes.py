"""Hashes of spans keep apart what a polynomial modulo a power of two confuses."""

import zlib

import numpy as np
import public_tokenizers as P

from strataloom.llm import bitplanes, cascade, jaccard, runindex
from strataloom.llm import common as C

from . import brute


def thue_morse(letters):
    word = letters[0]
    for _ in range(10):
        word += word.translate(str.maketrans(letters, letters[::-1]))
    return word


ONE, TWO = thue_morse("ab"), thue_morse("ba")


def test_span_hashes():
    data = np.frombuffer((ONE + TWO).encode(), np.uint8)
    a, b = C.span_hashes(data, np.array([0, 1024]), np.array([1024, 2048]), C.byte_codes(False))
    assert a != b
    raw = bytes(np.random.default_rng(1).integers(0, 256, 3000, np.uint8))
    data, start, end = np.frombuffer(raw, np.uint8), np.array([0, 7, 7, 100, 2990]), np.array([1, 7, 30, 2900, 3000])
    want = [sum((x + 1) * pow(C._POINT, i, C._PRIME) for i, x in enumerate(raw[a:b])) % C._PRIME for a, b in zip(start, end, strict=True)]
    length = (end - start).astype(np.uint64)
    assert (C.span_hashes(data, start, end, C.byte_codes(False)) == C.mix(np.array(want, np.uint64) + length * np.uint64(0x9E3779B97F4A7C15))).all()


def test_distinct_spans_never_trust_a_hash(monkeypatch):
    data = np.frombuffer(b"ab abc ab a abcdefghij abcdefghik ab", np.uint8)
    start, end, _ = C.runs(C.NOT_SPACE[data], np.array([0, len(data)]))
    for f in (C.span_hashes, lambda d, s, e, c: np.zeros(len(s), np.uint64)):
        monkeypatch.setattr(C, "span_hashes", f)
        first, place = C.distinct_spans(data, start, end)
        words = [bytes(data[a:b]) for a, b in zip(start, end, strict=True)]
        assert len(first) == len(set(words)) and [words[first[p]] for p in place] == words


def test_in_every_operator_that_hashes(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(1, ONE), (2, TWO), (3, ONE + "\n" + TWO), (4, TWO * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: (r[1], r[2]) for r in jaccard.classes(docs).collect()} == brute.classes(rows)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert {r[0]: tuple(r)[1:7] for r in cascade.judge(docs, always=names).collect()} == {k: brute.quality(t) for k, t in rows}
    assert {r[0]: tuple(r)[1:] for r in runindex.remove_repeats(docs).collect()} == brute.repeats([(k, t.encode()) for k, t in rows])
    path, tokenizer = P.path("byte_bpe_50k.json"), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    bitplanes.write_ids(docs, path, f"file://{tmp_path}/ids")
    want = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for k, t in rows}
    got = {r["doc_id"]: r for r in bitplanes.read_ids(spark, f"file://{tmp_path}/ids").collect()}
    assert all(got[k]["ids"] == ids and got[k]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) for k, ids in want.items())
