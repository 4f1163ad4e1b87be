"""Plain versions of the operators, one text at a time, to test against."""

from __future__ import annotations

import collections
import hashlib
import re

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def components(rows, words=2, percent=80):
    """{doc_id: (set size, smallest reachable id)}"""
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(ASCII_LOWER))
        sets[i] = frozenset(tuple(w[k:k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def lines(rows):
    """{doc_id: (lines, dropped, kept text)}"""
    split = {i: (t or "").split("\n") for i, t in rows}
    key = lambda x: x.strip(" \t\n\v\f\r").translate(ASCII_LOWER)
    where = collections.defaultdict(set)
    for i, ls in split.items():
        for x in ls:
            if len(key(x)) >= 10:
                where[key(x)].add(i)
    out = {}
    for i, ls in split.items():
        kept = [x for x in ls if len(where.get(key(x), ())) < 2 or min(where[key(x)]) == i]
        out[i] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def pii(text):
    """[(start, kind index, end, kind)]"""
    out = []
    for k, (name, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[name]
            if ok:
                out.append((m.start(), k, m.end(), name))
    return sorted(out)


def quality(text):
    """(words, word_chars, symbols, dup lines, repeat words)"""
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i:i + 5])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def distance_in(unit: str, text: str) -> int:
    """Least edit distance of unit to any region of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(unit, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)
