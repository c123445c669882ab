"""Plain restatements of the operators, for small inputs."""

import re
from collections import defaultdict

SPACE = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def shingles(text, n):
    w = words(lower(text))
    return set() if not w else {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def groups(docs, n, percent):
    """component of each position of a list of texts, by all pairs."""
    sets, up = [shingles(t, n) for t in docs], list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(docs))], [len(s) for s in sets]


def item_words(text):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text)) if w]


def windows(items):
    out = defaultdict(set)
    for item, text in items:
        w = item_words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            out[tuple(w[i : i + n])].add("" if item is None else str(item))
    return out


def contamination(text, held):
    w, hit, items = item_words(text), set(), set()
    for n in {len(k) for k in held}:
        for i in range(len(w) - n + 1):
            if (k := tuple(w[i : i + n])) in held:
                hit |= set(range(i, i + n))
                items |= held[k]
    return len(w), len(hit), sorted(items)


def quality(text):
    w = words(text)
    places = defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i : i + 3])].append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    n_symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), n_symbols, dup, len(covered), sum(bool(words(x)) for x in lines)
