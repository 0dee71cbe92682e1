"""Quality rules as a short-circuit cascade.

Each rule is a rejection test over features of a text. Its cost (seconds a document, its
features computed for it alone) and selectivity (share rejected) are measured on a bounded
sample of the first rows that are not too long; rules then run by falling rejection per cost, and a document that one rule
rejects is not shown to the later ones. The order changes the work, never the verdict: a
document is kept if no rule rejects it.

Defined cases: a null or empty text has zero for every count and is rejected by the length
rule; line and window repeats are counted within one text, whole however long; a null doc_id is
an id like any other; repeated rows are judged alike and each gives a row; rules with equal gain
run by name; an empty table gives an empty result; extra columns, also those named like the
operator's own, are kept by ``keep_documents`` and else ignored.

What clean tables, lists and scripts show is no reason to reject: the pipes of a table's line
(two or more, and it starts with one or is of three or more lines with as many), the mark before
a list item, heading or citation, and one or two stars at a word do not count as symbols; word
lengths are judged on words outside such lines with a letter of a script that puts spaces
between words. Pipes between the entries of a menu, in lines of any number, do count.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Documents on which cost and selectivity are measured; ordering only, never the verdict.
SAMPLE_ROWS = 400
SAMPLE_BYTES = 1 << 16

#: Bytes that count as symbols. Fixed values.
SYMBOLS = "#*$%&|<>"
#: Bytes that make up the mark before a list item, heading or citation, and its length at most.
MARKS = "*#>"
MARK_BYTES = 6
#: Code points of scripts without spaces between words, with their punctuation: Thai to Tibetan, Myanmar, Khmer, Tai and Balinese scripts,
#: CJK, kana and Yi, Javanese, forms for compatibility and of full width, CJK beyond the basic plane.
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1940, 0x1AFF), (0x1B00, 0x1B7F), (0x2E80, 0xA4CF), (0xA980, 0xA9FF), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFFEF), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))


class Texts:
    """A slice of texts and what has been computed for it; each feature is one array."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off, self.n = data, off, len(off) - 1
        self.done: dict[str, np.ndarray] = {}
        self.shared: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self._words = None

    def words(self):
        if self._words is None:
            self._words = C.words_of(self.data, self.off, C.NOT_SPACE, lower=False)
        return self._words

    def feature(self, name: str) -> np.ndarray:
        if name not in self.done:
            self.done[name] = FEATURES[name](self)
        return self.done[name]

    def subset(self, rows: np.ndarray) -> Texts:
        """Only the given texts (ascending), with what is known of them."""
        parts = [self.data[self.off[r] : self.off[r + 1]] for r in rows]
        out = Texts(np.concatenate(parts) if parts else np.zeros(0, np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64))
        out.done = {k: v[rows] for k, v in self.done.items()}
        if self._words is not None:
            start, end, row, hashes = self._words
            place = np.full(self.n, -1)
            place[rows] = np.arange(len(rows))
            keep = place[row] >= 0
            row, new = row[keep], place[row[keep]]
            shift = self.off[row] - out.off[new]
            out._words = (start[keep] - shift, end[keep] - shift, new, hashes[keep])
        return out


def _per_row(t: Texts, marks: np.ndarray) -> np.ndarray:
    """How many marks lie in each text."""
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return total[t.off[1:]] - total[t.off[:-1]]


def _n_words(t: Texts) -> np.ndarray:
    return np.bincount(t.words()[2], minlength=t.n).astype(np.int64)


def _word_chars(t: Texts) -> np.ndarray:
    return _per_row(t, C.NOT_SPACE[t.data] & ((t.data & 0xC0) != 0x80))


def _bytes_in(chars: str) -> Callable[[Texts], np.ndarray]:
    inside = C.table(lambda b: chr(b) in chars)
    return lambda t: _per_row(t, inside[t.data])


def _repeats(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which (row, value) pairs occur twice or more."""
    key = C.mix(value + C.mix(row.astype(np.uint64) + np.uint64(1)))
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    return twice[at] == key


def _lines(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every line that has a word."""
    start, end, row = C.runs(t.data != 10, t.off)
    filled = np.concatenate([[0], np.cumsum(C.NOT_SPACE[t.data], dtype=np.int64)])
    real = filled[end] > filled[start]
    return start[real], end[real], row[real]


def _n_lines(t: Texts) -> np.ndarray:
    return np.bincount(_lines(t)[2], minlength=t.n).astype(np.int64)


def _n_dup_lines(t: Texts) -> np.ndarray:
    start, end, row = _lines(t)
    key = C.mix(C.span_hashes(t.data, start, end, C.byte_codes(False)) + C.mix(row.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    return np.bincount(row[again], minlength=t.n).astype(np.int64)


def _n_repeat_words(t: Texts) -> np.ndarray:
    _, _, row, hashes = t.words()
    at, window = C.grams(hashes, row, 8)
    at = at[_repeats(row[at], window)]
    if not len(at):
        return np.zeros(t.n, np.int64)
    edge = np.bincount(at, minlength=len(row) + 1) - np.bincount(at + 8, minlength=len(row) + 1)
    return np.bincount(row[np.cumsum(edge[:-1]) > 0], minlength=t.n).astype(np.int64)


def _unspaced_starts() -> np.ndarray:
    """For the first two bytes of a code point whether it is of an unspaced script."""
    out = np.zeros(1 << 16, bool)
    for low, high in UNSPACED:
        for c in range(low, high + 1, 16):
            raw = chr(c).encode("utf-8")
            out[raw[0] << 8 | raw[1]] = True
    return out


def _letters(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the bytes at which code points begin that are letters of spaced scripts (none is taken from U+2000 to U+2FFF), and of those of unspaced scripts."""
    if "_letters" not in t.shared:
        after = np.append(t.data[1:], 0).astype(np.uint16)
        unspaced = (t.data >= 0xE0) & _UNSPACED[(t.data.astype(np.uint16) << 8) | after]
        t.shared["_letters"] = (_LATIN[t.data] | ((t.data >= 0xC3) & (t.data != 0xE2))) & ~unspaced, unspaced
    return t.shared["_letters"]


def _laid_out(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Which words lie in a table's line, and which are the mark before a list item, heading or citation."""
    if "_laid_out" not in t.shared:
        start, end, row, _ = t.words()
        table = np.zeros(len(t.data) + 1, np.int64)
        low, high, line_row = C.runs(t.data != 10, t.off)
        pipes, other = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (t.data == 124, C.NOT_SPACE[t.data] & ~_SYMBOL[t.data]))
        held = pipes[high] - pipes[low]
        filled = np.concatenate([[0], np.cumsum(C.NOT_SPACE[t.data], dtype=np.int64)])
        begins = np.searchsorted(filled, filled[low], "right") - 1  # the first byte of a line that is no space
        led = t.data[np.minimum(begins, len(t.data) - 1)] == 124 if len(low) else np.zeros(0, bool)
        alike = (line_row[1:] == line_row[:-1]) & (held[1:] == held[:-1]) & (low[1:] == high[:-1] + 1)
        alike &= np.append(alike[1:], False) | np.append(False, alike[:-1]) if len(alike) else alike
        beside = np.append(alike, False) | np.append(False, alike) if len(low) else led
        real = (held >= 2) & (other[high] > other[low]) & (led | beside)
        table[low[real]] += 1
        table[high[real]] -= 1
        in_table = np.cumsum(table[:-1]) > 0
        ends = np.concatenate([[0], np.cumsum(t.data == 10, dtype=np.int64)])
        n = len(start)
        first, last = np.ones(n, bool), np.ones(n, bool)
        if n > 1:
            apart = (row[1:] != row[:-1]) | (ends[start[1:]] > ends[end[:-1]])
            first[1:], last[:-1] = apart, apart
        marks = np.concatenate([[0], np.cumsum(_MARK[t.data], dtype=np.int64)])
        mark = first & ~last & (end - start <= MARK_BYTES) & (marks[end] - marks[start] == end - start)
        t.shared["_laid_out"] = in_table, mark
    return t.shared["_laid_out"]


def _n_odd_symbols(t: Texts) -> np.ndarray:
    """Symbols but the pipes of tables, the marks before items and the stars of emphasis."""
    in_table, mark = _laid_out(t)
    start, end, row, _ = t.words()
    odd = _SYMBOL[t.data] & ~((t.data == 124) & in_table)
    low, high, _ = C.runs(t.data == 42, t.off)
    plain = np.concatenate([[False], C.NOT_SPACE[t.data] & ~_SYMBOL[t.data], [False]])
    at = (high - low <= 2) & (plain[low] | plain[high + 1])
    odd[low[at]] = False
    odd[high[at] - 1] = False
    return _per_row(t, odd) - np.bincount(row[mark], (end - start)[mark], t.n).astype(np.int64)


def _prose(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Which words lie outside tables and have a letter of a spaced script."""
    in_table, _ = _laid_out(t)
    start, end, row, _ = t.words()
    letters = np.concatenate([[0], np.cumsum(_letters(t)[0], dtype=np.int64)])
    return (letters[end] > letters[start]) & ~in_table[start], row


def _n_prose_words(t: Texts) -> np.ndarray:
    inside, row = _prose(t)
    return np.bincount(row[inside], minlength=t.n).astype(np.int64)


def _chars_in_prose(marks: Callable[[Texts], np.ndarray]) -> Callable[[Texts], np.ndarray]:
    def count(t: Texts) -> np.ndarray:
        inside, row = _prose(t)
        start, end = t.words()[:2]
        total = np.concatenate([[0], np.cumsum(marks(t), dtype=np.int64)])
        return np.bincount(row[inside], (total[end] - total[start])[inside], t.n).astype(np.int64)

    return count


_LATIN = C.table(lambda b: chr(b).isascii() and chr(b).isalpha())
_SYMBOL = C.table(lambda b: chr(b) in SYMBOLS)
_MARK = C.table(lambda b: chr(b) in MARKS)
_UNSPACED = _unspaced_starts()


FEATURES: dict[str, Callable[[Texts], np.ndarray]] = {
    "n_words": _n_words,
    "word_chars": _word_chars,
    "n_symbols": _bytes_in(SYMBOLS),
    "n_lines": _n_lines,
    "n_dup_lines": _n_dup_lines,
    "n_repeat_words": _n_repeat_words,
    "n_odd_symbols": _n_odd_symbols,
    "n_prose_words": _n_prose_words,
    "prose_chars": _chars_in_prose(lambda t: (t.data & 0xC0) != 0x80),
    "spaced_chars": _chars_in_prose(lambda t: ((t.data & 0xC0) != 0x80) & ~_letters(t)[1]),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text when ``test`` of its ``features`` holds."""

    name: str
    features: tuple[str, ...]
    test: Callable[..., np.ndarray]


BASE_RULES = (
    Rule("too_short", ("n_words",), lambda n: n < 20),
    Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 30 * n),
)
#: Thresholds lie far outside what clean prose, lists or tables show in any script (tests/llm/test_clean_texts.py).
EXTRA_RULES = (
    Rule("symbols", ("n_odd_symbols", "n_words"), lambda s, n: 100 * s > 25 * n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: (d >= 3) & (2 * d > n)),
    # Fewer words than the length rule asks for are too few to judge.
    Rule("word_length", ("n_prose_words", "prose_chars", "spaced_chars"), lambda n, c, s: (n >= 20) & ((c < 2 * n) | (s > 25 * n))),
)
RULES = BASE_RULES + EXTRA_RULES


def measure(sample: list[str], rules=RULES) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected), each rule on its own."""
    data, off = C.bytes_view(pa.array(sample, pa.string()))
    out = []
    for rule in rules:
        t, began = Texts(data, off), time.perf_counter()
        rejected = rule.test(*[t.feature(f) for f in rule.features])
        out.append((rule.name, (time.perf_counter() - began) / max(1, t.n), float(np.mean(rejected)) if t.n else 0.0))
    return out


def order_rules(stats: list[tuple[str, float, float]], rules=RULES) -> list[Rule]:
    """Rules by falling rejection per cost; ties by name."""
    gain = {name: -share / max(cost, 1e-9) for name, cost, share in stats}
    return sorted(rules, key=lambda r: (gain[r.name], r.name))


def run_cascade(t: Texts, rules: list[Rule]) -> np.ndarray:
    """The position of the rule that rejects each text, -1 if none does; rejected texts skip later rules."""
    verdict, rows, live = np.full(t.n, -1), np.arange(t.n), t
    for k, rule in enumerate(rules):
        if not len(rows):
            break
        bad = rule.test(*[live.feature(f) for f in rule.features])
        verdict[rows[bad]] = k
        if bad.any():
            keep = np.flatnonzero(~bad)
            rows, live = rows[keep], live.subset(keep)
    return verdict


def _ordered(documents: DataFrame, rules, sample_rows: int) -> list[Rule]:
    """The rules in the order that a sample of ``sample_rows`` texts of SAMPLE_BYTES at most suggests: it reaches the driver, so its bytes have a bound too."""
    short = documents.select("text").where(F.octet_length("text") <= SAMPLE_BYTES).limit(sample_rows)
    return order_rules(measure([r[0] for r in short.collect()], rules), rules)


def judge(documents: DataFrame, rules=RULES, always: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, ``always`` (features given for every document), base_failed and kept. The features of the base rules are computed for every document, since base_failed tells of these rules alone; those of the others only until a rule rejects."""
    ordered = _ordered(documents, rules, sample_rows)
    schema = ", ".join(["doc_id " + documents.schema["doc_id"].dataType.simpleString(), *[f"{a} bigint" for a in always], "base_failed boolean", "kept boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in C.slices(whole):
                t = Texts(*C.bytes_view(batch["text"]))
                given = [t.feature(a) for a in always]
                failed = np.zeros(t.n, bool)
                for rule in BASE_RULES:
                    failed |= rule.test(*[t.feature(f) for f in rule.features])
                kept = ~failed
                kept[kept] = run_cascade(t.subset(np.flatnonzero(kept)), ordered) < 0
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(g, pa.int64()) for g in given], pa.array(failed), pa.array(kept)], names=["doc_id", *always, "base_failed", "kept"])

    return C.only(documents, "doc_id", "text").mapInArrow(run, schema)


def keep_documents(documents: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with their own columns; no rule sees what an earlier one has rejected."""
    ordered = _ordered(documents, rules, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in C.slices(whole):
                yield batch.filter(pa.array(run_cascade(Texts(*C.bytes_view(batch["text"])), ordered) < 0))

    return documents.mapInArrow(run, documents.schema)
