"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def jaccard(docs, k, percent):
    """docs: [(doc_id, text)] -> sorted [(doc_id, n_shingles, component_id)]"""
    sets = [shingles(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            at[g].add(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in at[g] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets)))


def contamination(docs, items, window=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    grams = defaultdict(set)
    for item, text in items:
        w = split(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[i : i + n])].add(str(item))
    sizes = {len(g) for g in grams}
    out = []
    for d, text in docs:
        w, hit, found = split(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[g]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def repeated_words(docs, window=13):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(d, first.get(g, d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out)


def repeated_bytes(docs, length=200):
    texts = [(d, (t or "").encode()) for d, t in docs]
    seen = defaultdict(int)
    for _, t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] += 1
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        out.append((d, len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return sorted(out)


def exact(docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[t or ""].append(d)
    return sorted((d, max(groups[t or ""]), len(groups[t or ""]), d == max(groups[t or ""]), sha(t or "")) for d, t in docs)


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def posterior(rows, names, temper_pseudo, accept, min_letters):
    """rows: [(ll, letters, declared, suffix, domain, host)] -> [(detected, posterior, accepted)], by the formulas alone."""
    pseudo, k = temper_pseudo, len(names)
    guess = [r[0].index(max(r[0])) if r[1] >= min_letters else None for r in rows]

    def counts(keep):
        return [sum(g == i and keep(r) for g, r in zip(guess, rows)) for i in range(k)]

    def smooth(c, parent):
        return [(x + pseudo * p) / (sum(c) + pseudo) for x, p in zip(c, parent)]

    totals = counts(lambda r: True)
    every = [(t + pseudo / k) / (sum(totals) + pseudo) for t in totals]
    kinds = len({r[2] for r in rows})
    out = []
    for ll, letters, declared, *place in rows:
        prior = every
        for level in (1, 2, 3):
            prior = smooth(counts(lambda r: r[3 : 3 + level] == tuple(place[:level])), prior)  # noqa: B023
        trust = [(c + 1) / (t + kinds) for c, t in zip(counts(lambda r: r[2] == declared), totals)]  # noqa: B023
        logs = [x + math.log(t) + math.log(p) for x, t, p in zip(ll, trust, prior)]
        best = logs.index(max(logs))
        share = 1 / sum(math.exp(x - logs[best]) for x in logs)
        out.append((names[best], share, share >= accept and letters >= min_letters))
    return out
