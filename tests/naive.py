"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

WEIGHT = {
    0: lambda d: 1.0,
    1: lambda d: 1.0 / d,
    2: lambda d: 2.0 / (1 + d),
    3: lambda d: 3.0 / (2 + d),
    4: lambda d: 1.0 / math.sqrt(d),
}


def words(line):
    kept = line.replace("\r", "")
    return [w for part in kept.split("\t") for w in part.split(" ") if w]


def vocabulary(texts, min_count):
    counts = Counter(w for t in texts for w in words(t))
    ranked = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0].encode()))
    return {w: i for i, (w, n) in enumerate([x for x in ranked if x[1] >= min_count], 1)}


def coded(texts, ids):
    return [[ids[w] for w in words(t) if w in ids] for t in texts]


def pairs(texts, ids, window):
    for line in coded(texts, ids):
        for j in range(len(line)):
            for d in range(1, min(window, j) + 1):
                yield line[j - d], line[j], d


def cooccurrence(texts, ids, window, code, symmetric):
    cells = defaultdict(float)
    for a, b, d in pairs(texts, ids, window):
        cells[a, b] += WEIGHT[code](d)
        if symmetric:
            cells[b, a] += WEIGHT[code](d)
    return dict(cells)


def corpus(seed, lines=40, longest=60, words_=25):
    """Random lines with a hot word, blank lines, repeated separators and words of several scripts."""
    rng = random.Random(seed)
    names = ["the"] + [f"w{i}" for i in range(words_)] + ["é", "日本", "naïve"]
    out = []
    for _ in range(lines):
        parts = []
        for _ in range(rng.randrange(longest)):
            parts.append("the" if rng.random() < 0.4 else rng.choice(names))
            parts.append(rng.choice([" ", " ", " ", "\t", "  ", " \t"]))
        out.append("".join(parts))
    return out
