"""Brute-force versions that the operators are held against."""

import hashlib
import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def shingles(text, n=3):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(rows, percent=90, n=3):
    """All pairs, without filters."""
    sets, groups = {i: shingles(t, n) for i, t in rows}, Union()
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                groups.join(a, b)
    return {i: (len(sets[i]), groups.find(i)) for i in ids}


def substrings(rows, window=20):
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if g in seen:
                gone[k : k + window] = [True] * window
            seen.add(g)
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, y in zip(w, gone, strict=True) if not y)))
    return out


def contamination(rows, items, window=13):
    wins = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[k : k + n])].add(item)
    lengths, out = {len(x) for x in wins}, {}
    for i, text in rows:
        w, hit, found = alnum(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(w))
    return out


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text):
    digits = lambda v: re.sub("[^0-9]", "", v)
    good = {"email": lambda v: True, "ip": lambda v: all(int(x) < 256 for x in v.split(".")), "card": lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v)), "phone": lambda v: 9 <= len(digits(v)) <= 15}
    return [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, text or "") if good[k](m.group())]


def repetition(text):
    text = text or ""
    w = words(text)
    grams = defaultdict(list)
    for k in range(len(w) - 2):
        grams[tuple(w[k : k + 3])].append(k)
    rep = {k + j for at in grams.values() if len(at) > 1 for k in at for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def licenses(text):
    w = alnum(text)
    at = [(k, label) for p, label in PHRASES.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
    places = [k for k, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def repeated_chars(text, sizes):
    """Characters of repeated lines, of all lines, and of words inside repeats of earlier n-grams, by n."""
    seen, dup, chars = set(), 0, 0
    for line in (text or "").split("\n"):
        if words(line):
            dup, chars = dup + len(line) * (line in seen), chars + len(line)
            seen.add(line)
    w, inside = words(text), []
    for n in sizes:
        grams, hit = set(), set()
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            if g in grams:
                hit |= set(range(k, k + n))
            grams.add(g)
        inside.append(sum(len(w[k]) for k in hit))
    return dup, chars, inside


def template_labels(text, rules, alike):
    """Labels of the templates that some run of words matches, and the best containment; every run is looked at."""
    w, best = alnum(text), {}
    have = set(w)
    for t, label, ws, need, block in rules:
        if len(have & set(ws)) >= need:
            over = max(len(set(w[k : k + block]) & set(ws)) for k in range(max(1, len(w) - block + 1)))
            if over >= need:
                best[t] = (over / len(ws), len(ws), label)
    kept = [x for t, x in best.items() if not any(u in best and best[u][:2] > x[:2] for s, u in alike if s == t)]
    return {x[2] for x in kept}, max((x[0] for x in kept), default=0.0)
