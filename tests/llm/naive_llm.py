"""Plain Python versions of the contracts."""

import re
from collections import Counter, defaultdict

SPACE_WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return SPACE_WORDS.findall(text or "")


def windows(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def repeated_words(words, n):
    """Places of words in windows of n that occur twice or more in this list."""
    found = windows(words, n)
    count = Counter(found)
    return {i + k for i, w in enumerate(found) if count[w] > 1 for k in range(n)}


def without_repeats(texts, n=35):
    split_texts = [split(t) for t in texts]
    count = Counter(w for words in split_texts for w in windows(words, n))
    kept = []
    for words in split_texts:
        gone = {i + k for i, w in enumerate(windows(words, n)) if count[w] > 1 for k in range(n)}
        kept.append((len(words), len(gone), [w for i, w in enumerate(words) if i not in gone]))
    return kept


def shingles(text, n=5):
    words = split((text or "").translate(LOWER))
    return set(windows(words, n)) if len(words) >= n else ({tuple(words)} if words else set())


def near_components(rows):
    """Smallest id reachable for every (id, text) with an id."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {i: find(i) for i, _ in sets}


def page_rank(edges, seeds, damping, steps):
    total = defaultdict(int)
    for (a, _), n in edges.items():
        total[a] += n
    start = {h: (1 - damping) * w for h, w in seeds.items()}
    score = dict(start)
    for _ in range(steps):
        new = defaultdict(float, start)
        for (a, b), n in edges.items():
            if a in score:
                new[b] += damping * n / total[a] * score[a]
        score = dict(new)
    return score
