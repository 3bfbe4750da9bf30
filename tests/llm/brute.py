"""Plain Python versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re
import zlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


def repeats(rows, n=50):
    """(words, removed, kept text) of each (id, text) row."""
    starts = collections.defaultdict(lambda: math.inf)
    rank = lambda i: math.inf if i is None else i
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            starts[key] = min(starts[key], rank(i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {x for k in range(len(w) - n + 1) if starts[tuple(w[k : k + n])] < rank(i) for x in range(k, k + n)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def components(rows, k=2, percent=80):
    """(n_shingles, component, kept) of each (id, text) row."""
    sets = []
    for _, t in rows:
        w = words((t or "").translate(LOWER))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if None in (rows[a][0], rows[b][0]) or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = i if g not in least else min(least[g], i)
    return [(len(s), least[g], least[g] == i or i is None) for (i, _), s, g in zip(rows, sets, group)]


def leaks(rows, items, n=10):
    """(n_words, n_hit, n_items, items, contaminated) of each (id, text) row."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for _, t in rows:
        w, hit, found = cut(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (key := tuple(w[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[key]
        out.append((len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return out


def base_scores(rows, folds=7):
    """(n_tokens, n_known, train_tokens, base_score) of each (id, text) row."""
    train = [i is None or zlib.crc32(str(i).encode()) % folds != 2 for i, _ in rows]
    tokens = [[*words((t or "").translate(LOWER)), None] for _, t in rows]
    count = collections.Counter(w for t, own in zip(tokens, train) if own for w in t)
    total, distinct = sum(count.values()), len(count)
    return [(len(t), sum(count[w] > 0 for w in t), total, sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in t)) for t in tokens]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
