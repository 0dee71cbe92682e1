"""Piece ids against a lattice over the whole text, and against the library."""

import random
import struct

import public_tokenizers as P
import pyarrow as pa
import pytest

from strataloom.llm import lattice

from . import brute
from .test_operators import TEXTS

RND = random.Random(11)
PATH = P.path("piece_bpe_32k.model")
ODD = [
    "  two  spaces   and    more" + " " * 40 + "x", " leading", "trailing  ", "tab\tand\nline\n\n  indented(x1, y22);  // note", "▁ literal ▁▁ mark", "日本語の文章です。中文也在这里", "e\u0301 combining ² 12². ½ x²", "😀😀 family 👨‍👩‍👧",
    "".join(RND.choices("abcdeéñ日", k=10_000)), "a" * 700, "ab" * 300, "=" * 500 + "-" * 90, "<s> </s> <unk> <0x41>", "\0\x01\ufffd", " ", "  ", "x",
]
ALL = [*TEXTS, *ODD]


def fields(raw):
    return list(lattice._fields(raw))


def packed(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | (5 if isinstance(value, float) else 2)) + (struct.pack("<f", value) if isinstance(value, float) else varint(len(value)) + value)


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The shipped vocabulary as a unigram model: other scores and another kind, nothing trained."""
    out, k = b"", 0
    with open(PATH, "rb") as f:
        raw = f.read()
    for number, value in fields(raw):
        if number == 1:
            inner = dict(fields(value))
            kind = inner.get(3, 1)
            score = -3.0 - (k * 7919 % 31991) / 2003.0 if kind == 1 else 0.0
            value = packed(1, inner[1]) + packed(2, score) + packed(3, kind)
            k += 1
        elif number == 2:
            value = b"".join(packed(n, struct.unpack("<f", v)[0] if isinstance(v, bytes) and n in (10, 18) else v) for n, v in fields(value) if n != 3 and n in (3, 35, 40, 41, 42, 43, 44, 45, 46, 47, 48)) + packed(3, 1)
        out += packed(number, value) if number in (1, 2, 3) else b""
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(out)
    return str(path)


def uncut(model, text):
    pieces = {p: (i, c) for p, i, c in zip(model.pieces, model.ids, model.costs, strict=True)}
    return brute.viterbi(" " + text, pieces, model.longest, model.first_byte, model.uncovered) if text else []


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("chunk", [1 << 23, 500])
def test_best_path_of_whole_texts(spark, monkeypatch, chunk):
    monkeypatch.setattr(lattice, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(lattice, "FREQUENT", 40)
    monkeypatch.setattr(lattice, "SAMPLE_CHUNKS", 2)
    model = lattice.load_model(PATH)
    encoded = lattice.encode(rows(spark, ALL), PATH)
    got = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert len(got) == len(ALL)
    for k, text in enumerate(ALL):
        assert got[k] == uncut(model, text), text
    back = {r["doc_id"]: r["text"] for r in lattice.decode(encoded, PATH).collect()}
    assert back == {k: t or "" for k, t in enumerate(ALL)}


def test_unigram_ids_are_the_librarys(spark, unigram):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=unigram)
    texts = [t for t in ALL if t and "▁" not in t and "\0" not in t]
    got = {r["doc_id"]: r["ids"] for r in lattice.encode(rows(spark, texts), unigram).collect()}
    for k, text in enumerate(texts):
        score = lambda ids: round(sum(library.get_score(i) for i in ids if not library.is_byte(i)), 2)
        want = library.encode(text)
        assert got[k] == want or score(got[k]) == score(want), text  # of equal paths the library takes another
    assert sum(got[k] == library.encode(t) for k, t in enumerate(texts)) >= 0.9 * len(texts)


def test_null_ids_repeats_clashing_columns_and_nothing(spark):
    table = spark.createDataFrame([(None, "one two", 1), (None, "one two", 1), (None, "three", 2), (4, None, 3), (4, "four", 4)], "doc_id long, text string, chunk long")
    table = table.selectExpr("*", "1 AS set", "'x' AS tag", "2 AS ids", "3 AS spots", "4 AS word")
    model = lattice.load_model(PATH)
    got = sorted((str(r["doc_id"]), r["ids"]) for r in lattice.encode(table, PATH).collect())
    assert got == sorted((str(a), uncut(model, b)) for a, b in ((None, "one two"), (None, "one two"), (None, "three"), (4, None), (4, "four")))
    assert lattice.encode(table.limit(0), PATH).count() == 0


def test_words_are_whole_texts():
    model = lattice.load_model(PATH)
    words, off = lattice.cut_words(pa.array(ALL), model.joined)
    for k, text in enumerate(ALL):
        assert "".join(words[off[k] : off[k + 1]].to_pylist()) == (" " + text if text else "")
