"""Null and shared ids, repeated rows, columns named like an operator's own, very long texts and empty tables."""

import hashlib
import random
import struct
import time
import zlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from strataloom.llm import bitplanes, cascade, jaccard, jumphash, maincontent, runindex, secretscan, warc, winnow

from . import brute

RND = random.Random(23)
WORDS = " ".join("".join(RND.choices("abcdefg", k=RND.randint(2, 7))) for _ in range(120))
ITEM = " ".join(WORDS.split()[30:60])
#: A null id twice with one text and once with another, an id with two texts, and a row given twice.
ROWS = [(None, WORDS), (None, WORDS), (None, "nothing of it"), (3, WORDS + " end"), (3, "other words, password=hunter22 here"), (7, None), (7, None), (8, "x " * 30_000 + WORDS), (9, "")]
OWN = ["kept", "base_failed", "spans", "ids", "component_id", "key", "label", "row", "n", "hits", "items", "start", "end", "shard", "slot", "print", "size", "n_words", "chunk"]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"own {c}") for c in OWN})


def shown(rows):
    return sorted(str(tuple(r)) for r in rows)


def test_winnowing(spark):
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, ITEM), (2, None), (3, "nothing of it")], "item_id long, text string").withColumn("n", F.lit(1))
    got = winnow.contamination(table(spark), bench).collect()
    want = []
    for doc, text in ROWS:
        n, hit, _, _, _ = brute.contamination([(0, text)], [(1, ITEM), (3, "nothing of it")])[0]
        items = ["1", "1"] if ITEM in (text or "") else ["3"] if text == "nothing of it" else []
        want.append((doc, n, hit, items))
    assert sorted(map(str, [(r["doc_id"], r["n_words"], r["n_hit"], [i for i in r["items"] if i is not None]) for r in got])) == sorted(map(str, want))
    assert all(len(r["items"]) == 3 for r in got if r["n_hit"] == 30)  # an item without an id counts as well
    clean = winnow.drop_contaminated(table(spark), bench)
    assert clean.columns == ["doc_id", "text", *OWN]
    assert shown(clean.select("doc_id", "text").collect()) == shown([r for r in ROWS if ITEM not in (r[1] or "") and r[1] != "nothing of it"])
    assert all(r["key"] == "own key" for r in clean.collect())


def test_winnowing_beyond_the_sorted_filter(spark, monkeypatch):
    monkeypatch.setattr(winnow, "FILTER_FINGERPRINTS", 1)
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert {r["n_hit"] for r in winnow.contamination(table(spark), bench).collect() if r["n_words"] > 100} == {30}


def test_cascade(spark):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = cascade.judge(table(spark), always=names).collect()
    assert sorted(str((r["doc_id"], *[r[c] for c in names], r["base_failed"])) for r in got) == sorted(str((d, *brute.quality(t))) for d, t in ROWS)
    alone = cascade.judge(table(spark)).select("doc_id", "base_failed", "kept").collect()
    assert shown(alone) == shown([(r["doc_id"], r["base_failed"], r["kept"]) for r in got])
    kept = cascade.keep_documents(table(spark))
    assert kept.columns == ["doc_id", "text", *OWN] and {r["kept"] for r in kept.collect()} == {"own kept"}
    assert kept.count() == sum(r["kept"] for r in got)
    assert cascade.keep_documents(table(spark).limit(0)).count() == 0


def test_secrets(spark):
    got = secretscan.scan(table(spark)).collect()
    assert sorted(str((r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]])) for r in got) == sorted(str((d, brute.secrets(t))) for d, t in ROWS)
    safe = secretscan.redact(table(spark))
    assert safe.columns == ["doc_id", "text", *OWN] and safe.count() == len(ROWS)
    assert "other words, [SECRET] here" in {r["text"] for r in safe.collect()}


def test_jaccard(spark):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.classes(table(spark)).collect()}
    n = len(brute.classes([(0, WORDS)])) and brute.classes([(0, WORDS)])[0][0]
    assert {(None, n, 3), (None, 1, None), (3, n + 1, 3), (7, 0, 7), (9, 0, 9)} <= got and jaccard.classes(table(spark)).count() == len(ROWS)
    left = jaccard.drop_near_copies(table(spark))
    assert left.columns == ["doc_id", "text", *OWN]
    # The long text's set is that of the passage and five shingles of the repeated word: a near copy.
    assert shown(left.select("doc_id", "text").collect()) == shown([r for k, r in enumerate(ROWS) if k not in (0, 1, 7)])


def test_rows_given_twice_become_one(spark):
    left = jaccard.drop_near_copies(spark.createDataFrame([("b", WORDS), ("b", WORDS), ("a", "one two"), ("a", "one two")], "doc_id string, text string"))
    assert shown(left.collect()) == shown([("b", WORDS), ("a", "one two")])


def test_repeats(spark):
    got = runindex.remove_repeats(table(spark)).collect()
    raw = [(k, (t or "").encode()) for k, (_, t) in enumerate(ROWS) if k != 7]
    want = [(ROWS[k][0], *v) for k, v in brute.repeats([*raw, (7, ("x " * 2_000 + WORDS).encode())]).items() if k != 7]
    assert sorted(str(tuple(r)) for r in got if r["n_bytes"] < 50_000) == sorted(str(w) for w in want)
    long = next(r for r in got if r["n_bytes"] > 50_000)
    assert (long["n_removed"], long["kept_sha256"]) == (long["n_bytes"], hashlib.sha256(b"").hexdigest())


def test_planes(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    bitplanes.write_ids(table(spark), P.path("byte_bpe_50k.json"), f"file://{tmp_path}/ids")
    got = bitplanes.read_ids(spark, f"file://{tmp_path}/ids").collect()
    crc = lambda t: zlib.crc32(struct.pack(f"<{len(i)}I", *i)) if (i := [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) else 0
    assert sorted(str((r["doc_id"], r["ids_crc32"])) for r in got) == sorted(str((d, crc(t))) for d, t in ROWS)
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])][:3] == [None] * 3


def test_shards(spark):
    got = jumphash.shard_documents(table(spark), 4).collect()
    assert len(got) == len(ROWS) and len({(r["shard"], r["slot"]) for r in got}) == len(ROWS)


PAGES = [(None, None, "<article><p>one</article>"), (None, None, "<article><p>one</article>"), (1, "u", None), (2, "v", "<main><p>" + "word " * 200_000 + "</main>"), (2, "w", "<p>plain")]


def test_main_text(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"text": F.lit(1), "order": F.lit(2)})
    got = maincontent.main_text(pages).collect()
    want = [(None, None, "one"), (None, None, "one"), (1, "u", ""), (2, "v", " ".join(["word"] * 200_000)), (2, "w", "plain")]
    assert shown(got) == shown(want)
    assert maincontent.main_text(pages.limit(0)).count() == 0


def test_best_stretch_is_the_best_of_all():
    for _ in range(300):
        scores = [RND.choice([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(RND.randint(0, 25))]
        best = max((sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=0)
        a, b = maincontent.best_stretch(scores)
        assert (a, b) == (0, 0) if best <= 0 else sum(scores[a:b]) == best


@pytest.mark.parametrize("unit", ['<a "', "<div>word ", "<div>x</p>", "< a ", "<a ", "<ul><li>x", "<!-", "<a '>", "</script", "<figure><p>x"])
def test_pages_of_any_kind_take_linear_time(unit):
    weights = maincontent.learn([])
    took = []
    for n in (4_000, 32_000):
        began = time.perf_counter()
        maincontent.extract(unit * n, weights)
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0] + 0.5


def test_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", ((1 << 10, 50), (1 << 14, 6), (1 << 62, 1)))
    pages = [(k, "http://x/", "<p>" + RND.choice("ab") * size) for k, size in enumerate([5, 200, 200, 2_000, 2_000, 60_000, 300_000, 0])]
    pages += [(None, "http://n/", "<p>" + "c" * 300), (20, "http://n/", "<p>" + "c" * 300)]
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2), f"file://{tmp_path}/w")
    got = {r["page_id"]: r for r in warc.pages_of(warc.assemble(warc.read_records(spark, f"file://{tmp_path}/w"))).collect()}
    assert len(got) == len(pages)
    for page, _, html in pages:
        same = [p for p, _, h in pages if h == html and p is not None]
        again = page is not None and len(html) >= 100 and page != min(same)
        assert (got[page]["payload_bytes"], got[page]["payload_digest"]) == (len(html), hashlib.sha256(html.encode()).hexdigest())
        assert (got[page]["record_type"], got[page]["refers_to"]) == (("revisit", min(same)) if again else ("response", None))
