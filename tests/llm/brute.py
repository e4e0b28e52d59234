"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingles(text, pattern=WORD):
    w = pattern.findall(lower(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def rules(text):
    t = text or ""
    words = WORD.findall(t)
    n = len(words)
    windows = [tuple(words[i:i + 8]) for i in range(n - 7)]
    twice = Counter(windows)
    covered = {p for i, w in enumerate(windows) if twice[w] > 1 for p in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    m = {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
         "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
         "n_bangs": len(t.split("!!")) - 1, "n_stutters": sum(a == b for a, b in zip(words, words[1:]))}
    failed = [n < 20, 100 * m["n_repeat_words"] > 30 * n, 5 * m["n_symbols"] > n, 2 * m["n_dup_lines"] > m["n_lines"],
              m["word_chars"] < 2 * n, m["word_chars"] > 16 * n, 10 * m["n_bangs"] > n, 10 * m["n_stutters"] > 3 * n]
    return m | {"failures": sum(1 << i for i, f in enumerate(failed) if f)}


def near_groups(texts):
    """Links of each text (other rows with similarity 0.8 or more, exact copies too) and its group."""
    sets = [shingles(t) for t in texts]
    inv = defaultdict(list)
    parent, links = list(range(len(texts))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def link(i, j):
        links[i] += 1
        links[j] += 1
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)

    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in inv[g]).items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                link(i, j)
        for g in s:
            inv[g].append(i)
    seen = defaultdict(list)
    for i, t in enumerate(texts):
        if not sets[i]:
            for j in seen[t or ""]:
                link(i, j)
            seen[t or ""].append(i)
    return [links[i] for i in range(len(texts))], [find(i) for i in range(len(texts))]


def cut_repeats(texts, length=200):
    """(kept bytes, removed runs) of each text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        out.append((bytes(x for x, g in zip(b, gone) if not g),
                    [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]))
    return out


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def leaks(text, items):
    """{item id: share of its shingles in the text}, at 0.8 or more."""
    s = shingles(text, ALNUM)
    out = {}
    for i, t in items:
        q = shingles(t, ALNUM)
        if q and len(q & s) >= 0.8 * len(q):
            out[i] = len(q & s) / len(q)
    return out
