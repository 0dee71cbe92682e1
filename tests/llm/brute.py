"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contamination(docs, bench):
    windows, lengths = defaultdict(set), set()
    for item, text in bench:
        w = TERMS.findall(lower(text))
        n = min(10, len(w))
        if n:
            lengths.add(n)
            for j in range(len(w) - n + 1):
                windows[tuple(w[j : j + n])].add(item)
    out = {}
    for doc, text in docs:
        w = TERMS.findall(lower(text))
        hit, items = [0] * len(w), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if found := windows.get(tuple(w[j : j + n])):
                    items |= found
                    hit[j : j + n] = [1] * n
        names = sorted(map(str, items))
        out[doc] = (len(w), sum(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), sum(hit) > 0)
    return out


def quality(text):
    w = WORDS.findall(text or "")
    n = len(w)
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    count = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    mark = [0] * n
    for i in range(n - 7):
        if count[tuple(w[i : i + 8])] > 1:
            mark[i : i + 8] = [1] * 8
    repeats = sum(mark)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeats, n < 20 or 100 * repeats > 30 * n)


def classes(docs):
    sets = {}
    for doc, text in docs:
        w = WORDS.findall(lower(text))
        sets[doc] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in sets}


def secrets(text):
    base = (
        ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
    )
    return [(k, s, e) for s, _, k, e in sorted((m.start(), i, k, m.end()) for i, (k, p, g, n) in enumerate(base) for m in p.finditer(text or "") if len(m[g]) >= n)]


def repeats(docs, least=400):
    count = Counter(t[i : i + least] for _, t in docs for i in range(len(t) - least + 1))
    out = {}
    for doc, t in docs:
        mark = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if count[t[i : i + least]] > 1:
                mark[i : i + least] = b"\1" * least
        kept = bytes(x for x, m in zip(t, mark, strict=True) if not m)
        runs = sum(1 for i, m in enumerate(mark) if m and (not i or not mark[i - 1]))
        out[doc] = (len(t), sum(mark), runs, hashlib.sha256(kept).hexdigest())
    return out


def jump(key, n):
    b, j, key = -1, 0, key & (1 << 64) - 1
    while j < n:
        b = j
        key = key * 2862933555777941757 + 1 & (1 << 64) - 1
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def viterbi(text, pieces, longest, first_byte, uncovered):
    """Ids of the best path through the lattice of a whole text. pieces: (id, cost) by piece."""
    cost, back = [0], [None]
    for e in range(1, len(text) + 1):
        top = None
        for s in range(max(0, e - longest), e):
            part = text[s:e]
            if part in pieces:
                i, c = pieces[part]
                new = (cost[s] + c, s, [i])
            elif e - s == 1:
                new = (cost[s] + uncovered, s, [first_byte + b for b in part.encode()])
            else:
                continue
            if top is None or new[0] < top[0]:
                top = new
        cost.append(top[0])
        back.append(top[1:])
    out, e = [], len(text)
    while e:
        s, ids = back[e]
        out[:0] = [ids]
        e = s
    return [i for ids in out for i in ids]
