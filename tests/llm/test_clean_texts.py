"""Clean tables, lists and texts of any script are kept, junk is not."""

import random

import pyarrow as pa
import pytest

from strataloom.llm import cascade

RND = random.Random(4)


def word(letters="abcdefghijklmnop", low=2, high=8):
    return "".join(RND.choices(letters, k=RND.randint(low, high)))


def of(low, high, n):
    return "".join(chr(RND.randint(low, high)) for _ in range(n))


CLEAN = {
    "pipe table": "| a | b | c |\n|---|---|---|\n" + "\n".join(f"| {word()} | {k} | {word()} |" for k in range(12)),
    "table of letters": "\n".join("| " + " | ".join(RND.choices("abcdefgh", k=4)) + " |" for _ in range(9)),
    "table of digits": "\n".join(" ".join(RND.choices("123456789", k=7)) for _ in range(9)),
    "table without edges": "\n".join(f"{word()} | {k} | {word()}" for k in range(12)),
    "star list": "\n".join(f"* {word()}" for _ in range(25)),
    "nested list": "\n".join(f"  {'*' * (k % 3 + 1)} {word()}" for k in range(25)),
    "citation": "\n".join(f"> {word()} {word()}" for k in range(25)),
    "headings": "\n".join(f"### {word()}\n{word()}" for k in range(15)),
    "emphasis": " ".join(f"**{word(low=4)}**" if k % 3 == 0 else word(low=4) for k in range(40)),
    "Chinese": "\n".join(of(0x4E00, 0x9F00, 60) + "。" for _ in range(24)),
    "Chinese with Latin words": "\n".join(of(0x4E00, 0x9F00, 50) + "Spark，" + of(0x4E00, 0x9F00, 20) for _ in range(24)),
    "Chinese words": " ".join(of(0x4E00, 0x9F00, RND.randint(1, 2)) for _ in range(60)),
    "Japanese": "\n".join(of(0x3041, 0x3090, 20) + of(0x4E00, 0x9F00, 10) + of(0x30A1, 0x30F0, 10) for _ in range(24)),
    "Thai": " ".join(of(0x0E01, 0x0E2E, 40) for _ in range(40)),
    "Korean": " ".join(of(0xAC00, 0xD700, RND.randint(2, 5)) for _ in range(40)),
    "Russian": " ".join(word("абвгдежзиклмноп") for _ in range(40)),
    "prose": " ".join(word() for _ in range(40)),
}
JUNK = {
    "menu": "\n".join(" | ".join(word() for _ in range(k)) for k in (30, 9, 14)),
    "symbols at words": " ".join(word() + "###" * (k % 3 == 0) + " $$$" * (k % 4 == 0) for k in range(40)),
    "symbols": " ".join(of(35, 38, RND.randint(1, 4)) for _ in range(60)),
    "marked symbols": "\n".join(f"* {of(35, 38, RND.randint(1, 4))} {word(high=3)}" for _ in range(40)),
    "spaced letters": " ".join(word(low=1, high=1) for _ in range(60)),
    "long words": " ".join(word(low=40, high=60) for _ in range(40)),
}


@pytest.mark.parametrize("name", [*CLEAN, *JUNK])
def test_verdicts(name):
    text = (CLEAN | JUNK)[name]
    t = cascade.Texts(*cascade.C.bytes_view(pa.array(["", text, "x", text, "| a"])))
    rejecting = [r.name for r in cascade.RULES if r.test(*[t.feature(f) for f in r.features])[1]]
    assert bool(rejecting) == (name in JUNK), rejecting
    assert (cascade.run_cascade(t, list(cascade.RULES)) < 0).tolist() == [False, name in CLEAN, False, name in CLEAN, False]
