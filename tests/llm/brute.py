"""Plain versions of the operators' definitions, for small inputs."""

import hashlib
import re

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))


def contamination(text, items, window=13):
    """(n_words, n_hit, item ids) of one text."""
    own = words(text)
    hit, found = set(), set()
    for item, said in items:
        theirs = words(said)
        for i in range(max(len(theirs) - window, 0) + 1 if theirs else 0):
            part = theirs[i : i + window]
            for j in range(len(own) - len(part) + 1):
                if own[j : j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
                    found.add(item)
    return len(own), len(hit), sorted(str(x) for x in found if x is not None)


def shingles(text, size):
    own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    if not own:
        return frozenset()
    return frozenset(tuple(own[i : i + size]) for i in range(max(len(own) - size, 0) + 1))


def components(nodes, links):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(rows, size, percent=80):
    """{id: (set size, component)} of (id, text) rows with different ids."""
    sets = {d: shingles(t, size) for d, t in rows}
    ids = sorted(sets)
    links = [
        (a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    comps = components(ids, links)
    return {d: (len(sets[d]), comps[d]) for d in ids}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
