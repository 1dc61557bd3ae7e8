"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall((text or "").translate(FOLD))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(docs):
    """doc_id: (set size, component, kept) from every pair that shares a shingle."""
    sets = {d: shingles(t) for d, t in docs}
    holders, both = defaultdict(list), Counter()
    for d, found in sets.items():
        for s in found:
            both.update((min(o, d), max(o, d)) for o in holders[s])
            holders[s].append(d)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def without_lines(docs):
    """doc_id: (text, removed) by comparing every line with all earlier ones that share a word."""
    lines, holders, out = [], defaultdict(list), {}
    for d, text in sorted(docs):
        if text is None:
            out[d] = (None, 0)
            continue
        kept, parts = [], text.split("\n")
        for part in parts:
            own = frozenset(words(part))
            gone = False
            if len(own) >= 5:
                both = Counter(i for w in own for i in holders[w])
                gone = any(100 * n >= 75 * (len(own) + len(lines[i]) - n) for i, n in both.items())
                for w in own:
                    holders[w].append(len(lines))
                lines.append(own)
            if not gone:
                kept.append(part)
        out[d] = ("\n".join(kept), len(parts) - len(kept))
    return out


def repeats(docs, length=100):
    """doc_id: (bytes, removed, spans, digest) from the set of all strings so far."""
    seen, out = set(), {}
    for d, text in sorted(docs):
        raw = (text or "").encode()
        cut = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                cut[i : i + length] = b"\x01" * length
            seen.add(s)
        spans = sum(1 for j in range(len(raw)) if cut[j] and (j == 0 or not cut[j - 1]))
        kept = bytes(c for c, gone in zip(raw, cut, strict=True) if not gone)
        out[d] = (len(raw), sum(cut), spans, hashlib.sha256(kept).hexdigest())
    return out


def leaks(docs, items):
    """Pairs of doc_id and item_id with a containment of 0.75."""

    def runs(text):
        w = words(text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    asked = {i: runs(t) for i, t in items}
    return {
        (d, i)
        for d, own in ((d, runs(t)) for d, t in docs)
        for i, want in asked.items()
        if want and len(want & own) >= 0.75 * len(want)
    }


def mix(docs):
    """doc_id: (size, source size, target, taken); docs are (doc_id, source, text)."""
    size = {d: len(WORDS.findall(t or "")) for d, _, t in docs}
    source = {d: s for d, s, _ in docs}
    total = Counter()
    for d, s in source.items():
        total[s] += size[d]
    order = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, rest = {}, set(order), 1.5 * sum(total.values())
    while True:
        per = rest / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if per * weight[s] > 2 * total[s]]
        if not over:
            target |= {s: per * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2 * total[s]
            rest -= target[s]
            free.discard(s)
    out, laid = {}, defaultdict(int)
    for d in sorted(size, key=lambda d: (hashlib.md5(f"mix:{d}".encode()).hexdigest(), d)):
        s = source[d]
        start, end, goal = laid[s], laid[s] + size[d], int(target[s] + 1e-6)
        laid[s] = end
        taken = sum(max(0, min(end, goal - again * total[s]) - start) for again in (0, 1))
        out[d] = (size[d], total[s], target[s], taken)
    return out
