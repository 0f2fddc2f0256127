"""Plain versions of operators, for small inputs."""

import re


def shingles(text, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def union(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def jaccard_components(texts):
    sets = [shingles(t) for t in texts]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    links = set()
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in where[x]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        links |= {(i, j) for j, n in shared.items() if 100 * n >= 75 * (len(s) + len(sets[j]) - n)}
    return [len(s) for s in sets], union(len(texts), links)


def repeated(texts, length):
    """Removed flags of each text's bytes."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for i, d in enumerate(data):
        for p in range(len(d) - length + 1):
            seen.setdefault(hash(d[p : p + length]), []).append((i, p))
    gone = [bytearray(len(d)) for d in data]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + length] = b"\1" * length
    return data, gone
