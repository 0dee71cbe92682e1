"""What cutting and indexing cost, counted and not timed, and that they still find what brute force finds."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from strataloom.llm import common as C
from strataloom.llm import runindex


def arrays(rows):
    return C.bytes_view(pa.array(rows, pa.binary()))


def test_cutting_takes_few_bytes_for_each_byte_of_text():
    rnd = random.Random(1)
    data, off = arrays([rnd.randbytes(4000) for _ in range(250)])
    runindex.cut(data, off, 32)  # powers are computed once
    tracemalloc.start()
    runindex.cut(data, off, 32)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * len(data)


def test_suffixes_that_are_equal_to_their_ends_are_not_sorted_again(monkeypatch):
    counted = []
    for name in ("sort", "argsort"):
        monkeypatch.setattr(np, name, lambda a, *x, f=getattr(np, name), **k: (counted.append(len(a)), f(a, *x, **k))[1])
    piece = random.Random(2).randbytes(900)
    index = runindex.RunIndex([piece, piece])
    assert index.repeats() == [[(0, 900)], [(0, 900)]]
    assert sum(counted) < 8 * 1800


def test_equal_windows_meet_under_one_key():
    rnd = random.Random(3)
    for _ in range(20):
        base = bytes(rnd.choices(b"ab c", k=900)) if rnd.random() < 0.5 else rnd.randbytes(rnd.randint(1, 450)) * 3
        rows = [base[a : a + rnd.randint(0, 1200)] + rnd.randbytes(rnd.randint(0, 300)) for a in (rnd.randint(0, 500) for _ in range(5))]
        for gram in runindex.GRAMS:
            keys, seen = {}, set()
            for row, start, length, key, _, twice in zip(*(x.tolist() for x in runindex.cut(*arrays(rows), gram)), strict=True):
                inside = set()
                for at in range(start, start + length - runindex.LEAST + 1):
                    window = rows[row][at : at + runindex.LEAST]
                    assert len(window) == runindex.LEAST and keys.setdefault(window, key) == key
                    assert twice or window not in inside
                    inside.add(window)
                    seen.add((row, at))
            assert seen == {(i, at) for i, r in enumerate(rows) for at in range(len(r) - runindex.LEAST + 1)}


def test_stretches_hold_every_repeat():
    rnd = random.Random(4)
    shared = [rnd.randbytes(n) for n in (399, 400, 430, 700)]
    pieces = [rnd.randbytes(rnd.randint(0, 60)) + rnd.choice(shared) + rnd.randbytes(rnd.randint(0, 60)) for _ in range(12)] + [b"a" * 600, b"short", b""]
    data, off = arrays(pieces)
    begin, to, row = runindex.stretches(data, off, runindex.SEED)
    found = runindex.RunIndex([data[a:b].tobytes() for a, b in zip(begin, to, strict=True)]).repeats()
    got = [[] for _ in pieces]
    for at, r, spans in zip((begin - off[row]).tolist(), row.tolist(), found, strict=True):
        got[r] += [(a + at, b + at) for a, b in spans]
    assert got == runindex.RunIndex(pieces).repeats()
    assert sum(to - begin) < len(data)
