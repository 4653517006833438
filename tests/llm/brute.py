"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEST_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def space_words(text):
    return SPACE_WORD.findall(text or "")


def shingles(text, n):
    w = space_words(lower(text))
    if not w:
        return set()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))}


def components(rows, n, percent):
    """rows: (id, text).  Per row (id, size of its set, smallest id reachable)."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids else None))
    return out


def contaminated(docs, items, n=13):
    """Per document (id, words, hit words, item ids as sorted strings)."""
    out = []
    for doc, text in docs:
        w = TEST_WORD.findall(lower(text))
        hit, named = set(), set()
        for item, t in items:
            iw = TEST_WORD.findall(lower(t))
            wins = [iw[i:i + n] for i in range(max(1, len(iw) - n + 1))] if iw else []
            for x in wins:
                for i in range(len(w) - len(x) + 1):
                    if w[i:i + len(x)] == x:
                        hit |= set(range(i, i + len(x)))
                        if item is not None:
                            named.add(str(item))
        out.append((doc, len(w), len(hit), sorted(named)))
    return out


def cut_repeats(docs, n):
    """Per document (id, words, removed words, the rest joined by a space)."""
    words = [space_words(t) for _, t in docs]
    seen: dict = {}
    for w in words:
        for i in range(len(w) - n + 1):
            seen[tuple(w[i:i + n])] = seen.get(tuple(w[i:i + n]), 0) + 1
    out = []
    for (doc, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i:i + n])] > 1:
                gone |= set(range(i, i + n))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 if d > 4 else d * 2
    return total % 10 == 0


PII = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
       ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
       ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def personal(text):
    out = []
    for no, (kind, pattern) in enumerate(PII):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), no, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
