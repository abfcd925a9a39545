"""Plain Python versions of the contracts, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contamination(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        if item is None or not w:
            continue
        n = min(13, len(w))
        for i in range(len(w) - n + 1):
            windows[tuple(w[i : i + n])].add(item)
    lengths = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if k := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= k
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), SHA(ids), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def secrets(docs):
    kinds = {"assign": (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), "access": (r"AKIA[A-Z0-9]+", 0, 16), "hex": (r"[0-9a-f]+", 0, 32)}
    out = []
    for doc, text in docs:
        spans = sorted((m.start(), k, m.end(), kind) for k, (kind, (rx, g, least)) in enumerate(kinds.items()) for m in re.finditer(rx, text or "") if len(m.group(g)) >= least)
        n = Counter(s[3] for s in spans)
        out.append((doc, n["assign"], n["access"], n["hex"], SHA(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans))))
    return out


def near_dup(docs, k, percent):
    sets = []
    for _, text in docs:
        w = SPACED.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            by[g].add(i)
    pairs = {p for v in by.values() for p in combinations(sorted(v), 2)}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(docs):
        least[root(i)].append(doc)
    out = []
    for i, (doc, _) in enumerate(docs):
        c = min((x for x in least[root(i)] if x is not None), default=None)
        out.append((doc, len(sets[i]), c, doc == c))
    return out


def quality(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        w = SPACED.findall(text)
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n, covered = Counter(grams), set()
        for i, g in enumerate(grams):
            if n[g] > 1:
                covered.update(range(i, i + 8))
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        out.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    return out
