"""Brute-force versions of the operators, written from their definitions."""

import collections
import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def similar_pairs(sets):
    """Pairs with 4 * intersection >= 3 * union, through an inverted list."""
    lists, out = collections.defaultdict(list), []
    for i, s in sets.items():
        shared = collections.Counter(j for x in s for j in lists[x])
        out += [(i, j) for j, n in shared.items() if 4 * n >= 3 * (len(s) + len(sets[j]) - n)]
        for x in s:
            lists[x].append(i)
    return out


def shingles(t):
    w = WORD.findall(low(t))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def near_duplicates(rows):
    sets = {i: shingles(t) for i, t in rows}
    comp = components(sets, similar_pairs(sets))
    return {i: (len(sets[i]), comp[i]) for i in sets}


def fuzzy_lines(rows, k):
    lines = {(i, n): x for i, t in rows for n, x in enumerate((t or "").split("\n"))}
    full = {p: x for p, x in sorted(lines.items()) if x.strip(" \t\n\x0b\x0c\r")}
    sets = {p: frozenset(x[i:i + k] for i in range(max(1, len(x) - k + 1))) for p, x in full.items()}
    comp = components(sets, similar_pairs(sets))
    return {p: comp.get(p, p) for p in lines}


def without_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        x = (t or "").encode()
        gone = bytearray(len(x))
        for s in range(len(x) - length + 1):
            w = x[s:s + length]
            if w in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(w)
        runs = sum(bool(v) and (k == 0 or not gone[k - 1]) for k, v in enumerate(gone))
        kept = bytes(c for c, v in zip(x, gone, strict=True) if not v)
        out[i] = (len(x), len(x) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def quality_base(t):
    w = WORD.findall(t or "")
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    again = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again))


def katz(rows, held, k=5):
    """n_tokens, n_known, N, base score, score of each text."""
    end = object()
    tok = {i: [*WORD.findall(low(t)), end] for i, t in rows}
    uni, bi = collections.Counter(), collections.Counter()
    for i, x in tok.items():
        if not held(i):
            uni.update(x)
            bi.update(zip([end, *x], x, strict=False))
    after = collections.defaultdict(list)
    for h, w in bi:
        after[h].append(w)
    total, kinds = sum(uni.values()), len(uni)

    def discount(counts):
        n = collections.Counter(counts)
        d = collections.defaultdict(lambda: 1.0)
        if not n[1]:
            return d
        a, b = (k + 1) * n[k + 1] / n[1], n[1] / (n[1] + 2 * n[2]) if n[2] else 0.5
        for r in range(1, k + 1):
            good = (((r + 1) * n[r + 1] / (r * n[r])) - a) / (1 - a) if n[r] and a < 1 else -1
            d[r] = good if 0 < good <= 1 else 1 - b / r
        return d

    d1, d2 = discount(uni.values()), discount(bi.values())
    lost = sum((1 - d1[c]) * c for c in uni.values())
    scale = total / (total + 1) if total and not lost else 1.0
    unseen = (lost / total if lost else 1 / (total + 1)) if total else 1.0
    p = lambda w: scale * d1[uni[w]] * uni[w] / total if uni[w] else unseen
    memo = {}

    def backoff(h):
        if h not in memo:
            gone = sum((1 - d2[bi[h, w]]) * bi[h, w] for w in after[h])
            left = gone / uni[h] if gone else 1 / (uni[h] + 1)
            memo[h] = (1.0 if gone else uni[h] / (uni[h] + 1), left / (1 - sum(map(p, after[h]))))
        return memo[h]

    def prob(h, w):
        if not uni[h]:
            return p(w)
        s, a = backoff(h)
        return s * d2[bi[h, w]] * bi[h, w] / uni[h] if bi[h, w] else a * p(w)

    for h in list(after)[:20]:      # each distribution sums to one
        assert abs(sum(prob(h, w) for w in uni) + backoff(h)[1] * unseen - 1) < 1e-9
    return {i: (len(x), sum(uni[w] > 0 for w in x), total,
                sum(math.log10((uni[w] + 1) / (total + kinds + 1)) for w in x),
                sum(math.log10(prob(h, w)) for h, w in zip([end, *x], x, strict=False))) for i, x in tok.items()}


def full_alignment(a, b):
    """Most matches of an alignment of a (whole) with a stretch of b at match
    +2 and -1 otherwise: the best score."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] - 1]
        for j, y in enumerate(b, 1):
            new.append(max(row[j - 1] + (2 if x == y else -1), row[j] - 1, new[-1] - 1))
        row = new
    return max(row)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def merkle_leaf(row):
    """row: values of doc_id, source, lang, n_chars, text."""
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def merkle_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def merkle_path(levels, i):
    """[(siblings left, siblings right)] from the leaf to the root."""
    out = []
    for nodes in levels[:-1]:
        first = i // 16 * 16
        run = nodes[first:first + 16]
        out.append((run[:i - first], run[i - first + 1:]))
        i //= 16
    return out


def merkle(rows, tampered):
    """(leaf, subroot, root, proof, folded) of every row, as a list; rows in
    any order, tampered(row) its changed form or None."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, merkle_leaf(r)))
    trees = {s: merkle_levels([merkle_leaf(r) for r in by[s]]) for s in sources}
    top = merkle_levels([trees[s][-1][0] for s in sources])
    out = []
    for n, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            path = merkle_path(trees[s], i) + merkle_path(top, n)
            got = merkle_leaf(tampered(r) or r)
            for a, b in path:
                got = digest(*a, got, *b)
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0],
                        digest(*(x for a, b in path for x in a + b)), got))
    return out


def word_runs(w, least=6, times=4):
    """(start, length, period) of every run, from the definition."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())
