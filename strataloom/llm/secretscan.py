"""Secret scans with one deterministic automaton for all rules.

A rule is a ``head`` (a regular expression over bytes) and a ``body`` (a class of bytes that runs
on as far as it can). All rules, each up to the byte of its body at which it is certain, are
joined in one nondeterministic automaton; subset construction followed by partition-refinement
minimisation gives transition arrays. A scan reads each byte once, for all rules together: texts
are cut at bytes on which the automaton always restarts, and all pieces of a slice step through
the arrays in lockstep. In pieces where a rule accepts, the positions at which it accepts give
the spans: the automaton of the reversed rule runs back to the leftmost start, and the body runs
on to the end. Spans of a rule that begin inside an earlier one of it are none; a span whose
value is shorter than the rule asks for takes its place but is dropped.

A rule with a ``tail`` runs on in the whole text, past line ends and whatever else cuts pieces.
A private key's runs through its END line if one comes before the next BEGIN line, or else to the
end of its base64 block.

Defined cases: a null text is empty and has no spans; texts of any length are scanned whole; a
null doc_id is an id like any other; repeated rows give repeated results; spans with one start
come in the order of the rules; empty tables give none; extra columns, also those named like the
operator's own, are kept by ``redact`` and else ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C


@dataclass(frozen=True)
class Rule:
    """Matches leftmost and without overlaps: ``head``, then ``body`` once or more, as often as it can. It is certain after ``sure`` bytes of
    body; a match counts if its value, the body or with ``whole`` all of it, has ``least`` bytes. ``tail`` gives the end of the secret in the
    whole text from the end of the match; without it, that is its end. A large ``sure`` where bodies share an alphabet multiplies states."""

    kind: str
    head: str
    body: str = ""
    sure: int = 1
    least: int = 0
    whole: bool = True
    base: bool = False
    tail: Callable[[bytes, int], int] | None = None

    @property
    def pattern(self) -> str:
        """What the automaton accepts."""
        return self.head + (f"{self.body}{{{self.sure}}}" if self.body else "")


_KEY_END = re.compile(rb"-----END [A-Z ]*PRIVATE KEY-----")
#: What may stand between the lines of a key: white space, escaped line ends, quotes and marks of comments, citations and joined strings.
_GAP = rb"(?:[\s\"'`,;>|*#+]|\\+[nrt]|//)*+"
_KEY_BODY = re.compile(rb"(?:" + _GAP + rb"[A-Za-z][A-Za-z-]*+: [^\n\\]*+)*+(" + _GAP + rb"[A-Za-z0-9+/=]{16,}+)*+(?:[ \t\"'`,;+]*+(?:\r?\n|(?:\\+r)?\\+n)(?:[ \t\"'`>|*#+]|//)*+[A-Za-z0-9+/=]++(?=[\s\"'`,;\\]|\Z))?+")


def key_end(text: bytes, at: int) -> int:
    """The end of the private key whose BEGIN line ends at ``at``: that of its END line, or of its base64 block if it has none."""
    following = text.find(b"-----BEGIN", at)
    if end := _KEY_END.search(text, at, following if following >= 0 else len(text)):
        return end.end()
    body = _KEY_BODY.match(text, at)
    return body.end() if body and (body[1] or body.end() == len(text)) else at  # a first line that the text's end cuts is short


_ASSIGN = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?"

#: Base rules first, in the order in which kinds are listed.
RULES = (
    Rule("assign", _ASSIGN, r"[A-Za-z0-9+/_.=-]", least=6, whole=False, base=True),
    Rule("access", "AKIA", "[A-Z0-9]", least=20, base=True),
    Rule("hex", "", "[0-9a-f]", sure=24, least=24, base=True),
    Rule("repo_token", r"gh[pousr]_", "[A-Za-z0-9]", least=34),
    Rule("chat_token", r"xox[abprs]-", "[A-Za-z0-9-]", least=15),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", tail=key_end),
)


# --- regular expression to nondeterministic automaton -------------------------------------


class Nfa:
    """States are numbers; ``moves[s]`` lists (byte mask, target), ``free[s]`` the targets without a byte."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[int, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1


class Parser:
    """The subset of byte regular expressions that rules use: literals, escapes, classes, groups, | ? * + {n}."""

    def __init__(self, text: str, nfa: Nfa):
        self.text, self.at, self.nfa = text, 0, nfa

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def either(self) -> tuple[int, int]:
        ends = [self.chain()]
        while self.peek() == "|":
            self.take()
            ends.append(self.chain())
        if len(ends) == 1:
            return ends[0]
        a, b = self.nfa.state(), self.nfa.state()
        for x, y in ends:
            self.nfa.free[a].append(x)
            self.nfa.free[y].append(b)
        return a, b

    def chain(self) -> tuple[int, int]:
        a = b = self.nfa.state()
        while self.peek() not in ("", "|", ")"):
            x, y = self.piece()
            self.nfa.free[b].append(x)
            b = y
        return a, b

    def piece(self) -> tuple[int, int]:
        at = self.at
        x, y = self.atom()
        end = self.at
        op = self.peek()
        if op not in ("?", "*", "+", "{"):
            return x, y
        self.take()
        if op == "{":
            times = int(self.text[self.at : self.text.index("}", self.at)])
            after = self.text.index("}", self.at) + 1
            for _ in range(times - 1):  # a copy of the atom for each time
                self.at = at
                p, q = self.atom()
                self.nfa.free[y].append(p)
                y = q
            self.at = max(after, end)
            return x, y
        a, b = self.nfa.state(), self.nfa.state()
        self.nfa.free[a].append(x)
        self.nfa.free[y].append(b)
        if op in "?*":
            self.nfa.free[a].append(b)
        if op in "*+":
            self.nfa.free[y].append(x)
        return a, b

    def atom(self) -> tuple[int, int]:
        c = self.take()
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            ends = self.either()
            self.take()
            return ends
        mask = self.members() if c == "[" else 1 << self.escaped(c)
        a, b = self.nfa.state(), self.nfa.state()
        self.nfa.moves[a].append((mask, b))
        return a, b

    def escaped(self, c: str) -> int:
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def members(self) -> int:
        mask, negate = 0, self.peek() == "^"
        if negate:
            self.take()
        while (c := self.take()) != "]":
            low = high = self.escaped(c)
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                high = self.escaped(self.take())
            for b in range(low, high + 1):
                mask |= 1 << b
        return ((1 << 256) - 1) ^ mask if negate else mask


# --- subset construction and minimisation -------------------------------------------------


@dataclass
class Automaton:
    """``moves[state * n_classes + classes[byte]]`` is the next state, 0 the first; ``accepts[state]`` a bit set of rules."""

    classes: np.ndarray
    n_classes: int
    moves: np.ndarray
    accepts: np.ndarray
    restarts: np.ndarray  # bytes that lead to state 0 from every state

    @cached_property
    def lists(self) -> tuple[list[int], list[int], list[int], list[bool]]:
        """moves, accepts and classes as lists, for plain steps, and which states nothing leads out of."""
        stuck = (self.moves.reshape(-1, self.n_classes) == np.arange(len(self.accepts))[:, None]).all(axis=1)
        return self.moves.tolist(), self.accepts.tolist(), self.classes.tolist(), stuck.tolist()


def _parsed(rule: Rule, nfa: Nfa) -> tuple[int, int]:
    """The first and last state of a rule's pattern."""
    parser = Parser(rule.pattern, nfa)
    ends = parser.either()
    if parser.at != len(rule.pattern):
        raise ValueError(f"unbalanced pattern: {rule.pattern}")
    return ends


def _reversed(nfa: Nfa) -> Nfa:
    out = Nfa()
    out.moves, out.free = [[] for _ in nfa.moves], [[] for _ in nfa.free]
    for s, moves in enumerate(nfa.moves):
        for mask, t in moves:
            out.moves[t].append((mask, s))
        for t in nfa.free[s]:
            out.free[t].append(s)
    return out


def _deterministic(nfa: Nfa, first: int, final: dict[int, int], anywhere: bool) -> Automaton:
    """The minimal automaton. ``anywhere``: it accepts after any prefix, else the empty set of states is one that is never left."""
    masks = sorted({m for moves in nfa.moves for m, _ in moves})
    signature: dict[tuple, int] = {}
    classes = np.zeros(256, np.int64)
    for b in range(256):  # bytes that no rule tells apart share a class
        classes[b] = signature.setdefault(tuple(m >> b & 1 for m in masks), len(signature))
    one_of = {int(c): int(np.flatnonzero(classes == c)[0]) for c in set(classes.tolist())}
    n = len(one_of)

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    start = closure([first])
    number, order, rows = {start: 0}, [start], []
    for subset in order:  # grows while it is read
        row = []
        for c in range(n):
            b = one_of[c]
            target = closure([*([first] if anywhere else []), *(t for s in subset for m, t in nfa.moves[s] if m >> b & 1)])
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row.append(number[target])
        rows.append(row)
    moves = np.array(rows)
    accepts = np.array([sum({final[s] for s in subset if s in final}) for subset in order])
    block = np.unique(accepts, return_inverse=True)[1]
    while True:  # states stay together while all their moves lead to the same blocks
        finer = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    rank = {int(block[0]): 0}
    for x in block.tolist():
        rank.setdefault(x, len(rank))
    block = np.array([rank[x] for x in block.tolist()])
    keep = np.array([int(np.flatnonzero(block == k)[0]) for k in range(len(rank))])
    small = block[moves[keep]]
    dead = (small == 0).all(axis=0)
    return Automaton(classes.astype(np.uint8), n, small.ravel().astype(np.int32), accepts[keep].astype(np.int64), dead[classes])


@dataclass
class Compiled:
    """The automaton of all rules, and for each rule that of its reversed pattern and the bytes of its body."""

    forward: Automaton
    backward: list[Automaton]
    body: list[np.ndarray]

    @property
    def accepts(self) -> np.ndarray:
        return self.forward.accepts


def compile_rules(rules=RULES) -> Compiled:
    """One minimal automaton that accepts, after any prefix, wherever some rule is certain; and what finds the ends of its spans."""
    nfa, final, back, body = Nfa(), {}, [], []
    first = nfa.state()
    for k, rule in enumerate(rules):
        a, b = _parsed(rule, nfa)
        nfa.free[first].append(a)
        final[b] = 1 << k
        alone = Nfa()
        a, b = _parsed(rule, alone)
        back.append(_deterministic(_reversed(alone), b, {a: 1}, False))
        inside = np.zeros(256, bool)
        if rule.body:
            mask = Parser(rule.body[1:], nfa).members()
            inside = C.table(lambda b, m=mask: m >> b & 1)
        body.append(inside)
    return Compiled(_deterministic(nfa, first, final, True), back, body)


def scan_slice(auto: Automaton, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and accepted rules of the pieces between restart bytes in which a rule accepts."""
    start, end, row = C.runs(~auto.restarts[data], off)
    if not len(start):
        return start, end, row, np.zeros(0, np.int64)
    order = np.argsort(start - end, kind="stable")  # longest first: pieces still running are always a prefix
    begin, length = start[order], (end - start)[order]
    code = auto.classes[data].astype(np.int32)
    state = np.zeros(len(begin), np.int32)
    found = np.zeros(len(begin), np.int64)
    live_at = np.searchsorted(-length, -np.arange(length[0]), "left")  # pieces longer than t
    width = np.int32(auto.n_classes)
    hot = auto.accepts > 0
    for t in range(int(length[0])):
        m = live_at[t]
        if m < 4:  # a few very long pieces: plain steps cost less than array calls
            moves, accepts, _, _ = auto.lists
            for i in range(m):
                s, bits = int(state[i]), 0
                for c in code[begin[i] + t : begin[i] + length[i]].tolist():
                    s = moves[s * auto.n_classes + c]
                    bits |= accepts[s]
                found[i] |= bits
            break
        s = auto.moves[state[:m] * width + code[begin[:m] + t]]
        state[:m] = s
        hits = np.flatnonzero(hot[s])
        if len(hits):
            found[hits] |= auto.accepts[s[hits]]
    some = np.flatnonzero(found)
    return begin[some], begin[some] + length[some], row[order[some]], found[some]


def _accepted(auto: Automaton, piece: bytes) -> list[tuple[int, int]]:
    """(end, accepted rules) at every position of a piece where some rule accepts."""
    moves, accepts, kinds, _ = auto.lists
    state, out = 0, []
    for i, b in enumerate(piece):
        state = moves[state * auto.n_classes + kinds[b]]
        if accepts[state]:
            out.append((i + 1, accepts[state]))
    return out


def _start(auto: Automaton, piece: bytes, end: int, least: int) -> int:
    """The leftmost start, from ``least`` on, of a match that ends at ``end``."""
    moves, accepts, kinds, stuck = auto.lists
    state, best = 0, -1
    for i in range(end - 1, least - 1, -1):
        state = moves[state * auto.n_classes + kinds[piece[i]]]
        if accepts[state]:
            best = i
        elif stuck[state]:
            break  # nothing leads on
    return best


def _spans(compiled: Compiled, rules, piece: bytes) -> list[tuple[int, int, int]]:
    """(start, rule, end) within a piece: leftmost, as long as the body runs, without overlaps."""
    out, done = [], [0] * len(rules)
    raw = np.frombuffer(piece, np.uint8)
    outside: dict[int, list[int]] = {}  # by rule, the bytes of the piece that end its body
    for end, bits in _accepted(compiled.forward, piece):
        for k, rule in enumerate(rules):
            if not bits >> k & 1 or end <= done[k]:
                continue
            start = _start(compiled.backward[k], piece, end, done[k])
            if start < 0:  # it would begin inside the span before
                continue
            value = start if rule.whole else end - rule.sure
            stop = end
            if rule.body:
                if k not in outside:
                    outside[k] = [*np.flatnonzero(~compiled.body[k][raw]).tolist(), len(piece)]
                stop = outside[k][bisect_left(outside[k], end)]
            done[k] = stop
            if stop - value >= rule.least:
                out.append((start, k, stop))
    return out


def find_secrets(compiled: Compiled, rules, data: np.ndarray, off: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, rule, end) in code points, sorted."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(off) - 1)]
    begin, end, row, _ = scan_slice(compiled.forward, data, off)
    if not len(begin):
        return out
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    held, text = -1, b""
    for b, e, r in zip(begin.tolist(), end.tolist(), row.tolist(), strict=True):
        base = points[off[r]]
        for s, k, t in _spans(compiled, rules, data[b:e].tobytes()):
            if rules[k].tail:
                if held != r:
                    held, text = r, data[off[r] : off[r + 1]].tobytes()
                t = rules[k].tail(text, int(b + t - off[r])) - int(b - off[r])
            out[r].append((int(points[b + s] - base), k, int(points[b + t] - base)))
    for spans in out:
        spans.sort()
    return out


def scan(documents: DataFrame, rules=RULES) -> DataFrame:
    """doc_id and ``spans``: an array of (kind, base, start, end), in code points, by start and then kind as listed."""
    auto = compile_rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for batch in C.slices(whole):
                found = find_secrets(auto, rules, *C.bytes_view(batch["text"]))
                spans = [[{"kind": rules[k].kind, "base": rules[k].base, "start": s, "end": e} for s, k, e in f] for f in found]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(spans, kind)], names=["doc_id", "spans"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return C.only(documents, "doc_id", "text").mapInArrow(run, f"doc_id {id_type}, spans array<struct<kind:string,base:boolean,start:bigint,end:bigint>>")


def redact(documents: DataFrame, rules=RULES, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret replaced by ``mark`` and n_chars counted anew; overlapping spans are replaced as one."""
    auto = compile_rules(rules)
    columns = documents.columns

    def hide(text: str, spans: list[tuple[int, int, int]]) -> str:
        parts, at, covered = [], 0, 0
        for s, _, e in spans:
            if s >= covered:
                parts += [text[at:s], mark]
            covered = at = max(covered, e)
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in C.slices(whole):
                found = find_secrets(auto, rules, *C.bytes_view(batch["text"]))
                if any(found):
                    texts = batch["text"].to_pylist()
                    texts = [hide(x, f) if f else x for x, f in zip(texts, found, strict=True)]
                    arrays = {n: batch[n] for n in columns} | {"text": pa.array(texts, pa.string())}
                    if "n_chars" in columns:
                        counts = [len(x) if f else n for x, f, n in zip(texts, found, batch["n_chars"].to_pylist(), strict=True)]
                        arrays["n_chars"] = pa.array(counts, batch["n_chars"].type)
                    batch = pa.RecordBatch.from_arrays([arrays[n] for n in columns], names=columns)
                yield batch

    return documents.mapInArrow(run, documents.schema)
