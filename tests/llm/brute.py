"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def exact(rows):
    """doc_id -> (keep_id, group_size) over ``(doc_id, text)``; null ids last."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    return [(d, min((i for i in g if i is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g]


def shingles(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def near(rows, width, percent):
    """doc_id -> (size of the set, least id reachable)."""
    sets = {d: shingles(t, width) for d, t in rows}
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in ids}


def targets(sizes):
    """source -> target by repeated resharing; sizes by source, None last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    held, free = {}, set(order)
    while free:
        left = Fraction(sum(sizes.values()) - sum(held.values()))
        heft = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / heft > 3 * sizes[s]]
        if not over:
            return held | {s: left * weight[s] / heft for s in free}
        for s in over:
            held[s] = 3 * sizes[s]
            free.discard(s)
    return held


def mix(rows):
    """doc_id -> (size, source size, target, taken) over ``(doc_id, text, source)`` with ids of their own."""
    size = {d: len(WORD.findall(t or "")) for d, t, _ in rows}
    by_source = {}
    for d, _, s in rows:
        by_source.setdefault(s, []).append(d)
    total = {s: sum(size[d] for d in ds) for s, ds in by_source.items()}
    want, out = targets(total), {}
    for s, ds in by_source.items():
        room, taken = int(want[s]), Counter()
        for _ in range(3):
            for d in sorted(ds, key=lambda d: (hashlib.md5(str(d).encode()).hexdigest(), d)):
                step = min(size[d], room)
                taken[d] += step
                room -= step
        for d in ds:
            out[d] = (size[d], total[s], float(want[s]), taken[d])
    return out


def top_k(rows, is_query, k=10):
    """(query, rank, id, score) over ``(vec_id, integers)``."""
    out = []
    for q, x in rows:
        if is_query(q):
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), v) for v, y in rows if v != q)
            out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(scores[:k])]
    return sorted(out)
