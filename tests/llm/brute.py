"""Plain single-process versions that the operators are held against."""

import math
import re
import unicodedata
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    words = WORD.findall(text or "")
    n = len(words)
    windows = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    covered = {j for i in range(n - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def shingles(text, size=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def jaccard_components(rows, percent=80):
    """{id: (set size, smallest id of the component)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


def best_sum(room, counts):
    """The largest sum up to ``room`` of a multiset with at most ``counts`` of each length."""
    sums = {0}
    for length, n in counts.items():
        sums |= {s + length * k for s in sums for k in range(n + 1) if s + length * k <= room}
    return max(sums)


def url_verdict(url, rules, default):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match("[^/?#]*", rest)[0])
        path = re.match("[^?#]*", rest[len(host) :])[0]
    for rule in sorted(rules, key=len, reverse=True):
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            return host, path, rule, rules[rule]
    return host, path, None, default


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def quality_statistics(text):
    n, chars = base_counts(text)[:2]
    words = WORD.findall(text or "")
    lines = sum(1 for x in (text or "").split("\n") if WORD.search(x))
    other = sum(1 for w in words for c in w if unicodedata.category(c)[0] not in "LM")
    return math.log((chars + 100) / (n + 20)), math.log((other + 5) / (chars + 100)), math.log(n / lines), math.log((len(set(words)) + 20) / (n + 20))


def determinant_distances(x, least, support, factor):
    """Squared distances to the minimum-covariance-determinant estimate of the rows of x, by two starts of concentration steps."""
    lower = lambda a, p: np.sort(a, axis=0)[math.ceil(p * len(a)) - 1]
    middle = lower(x, 0.5)
    spread = 1.4826 * lower(np.abs(x - middle), 0.5)
    drawn = np.clip(x, middle - 2 * spread, middle + 2 * spread)
    distances = lambda rows, m, c: np.einsum("ij,jk,ik->i", rows - m, np.linalg.inv(c), rows - m)
    found = []
    for start, (m, c) in enumerate([(middle, np.diag(spread**2)), (drawn.mean(axis=0), np.cov(drawn.T, bias=True))]):
        c, before = c + np.diag(least), math.inf
        while True:
            d2 = distances(x, m, c)
            near = x[d2 <= lower(d2, support)]
            m, c = near.mean(axis=0), factor * np.cov(near.T, bias=True) + np.diag(least)
            now = np.linalg.slogdet(c)[1]
            if not before - now > 1e-3:
                break
            before = now
        found.append((now, start, m, c))
    _, _, m, c = min(found, key=lambda f: f[:2])
    return lambda rows: distances(rows, m, c)


def quality_kept(rows, min_group, support, factor, cutoff, least_vectors):
    """{id: kept} of (id, text, lang, source), with strata, pooling and estimates."""
    sound = [r for r in rows if not base_counts(r[1])[5]]
    stats = {r[0]: quality_statistics(r[1]) for r in sound}
    size = Counter(r[2:] for r in sound)
    pool = Counter(r[2] for r in sound if size[r[2:]] < min_group)
    stratum = {r[0]: r[2:] if size[r[2:]] >= min_group else r[2] if pool[r[2]] >= min_group else 0 for r in sound}
    kept = {r[0]: False for r in rows}
    every = np.array(sorted({(str(stratum[i]), *z) for i, z in stats.items()}, key=str), dtype=object)
    least = 1e-4 * every[:, 1:].astype(float).var(axis=0) + 1e-12
    for s in set(stratum.values()):
        ids = [i for i in stratum if stratum[i] == s]
        x = np.array(sorted({stats[i] for i in ids}))
        if len(x) < least_vectors:
            kept.update(dict.fromkeys(ids, True))
            continue
        d2 = determinant_distances(x, least, support, factor)(np.array([stats[i] for i in ids]))
        kept.update(zip(ids, (d2 <= cutoff).tolist()))
    return kept
