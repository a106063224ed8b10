"""Plain versions of the operators, to hold them against."""

import re
from collections import defaultdict

import xxhash


def components(nodes, linked):
    """{node: smallest node reachable} for a function that tells whether two nodes are linked."""
    nodes = sorted(nodes)
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def simhash(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingle_set(text, width=5):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def repeated_lines(docs, least=50):
    """{doc position: line numbers to delete} of (id, text) in order: each common run with an earlier place that it does not overlap."""
    seqs = [[(k, line.strip(), len(line.split())) for k, line in enumerate((t or "").split("\n")) if line.split()] for _, t in docs]
    places, gone = defaultdict(list), defaultdict(set)
    for a, s in enumerate(seqs):
        for b, (_, line, _n) in enumerate(s):
            places[line].append((a, b))
    for found in places.values():
        for x in range(len(found)):
            for a, b in found[:x]:
                c, e = found[x]
                one, two = seqs[a], seqs[c]
                if b and e and one[b - 1][1] == two[e - 1][1]:
                    continue
                k = 0
                while b + k < len(one) and e + k < len(two) and one[b + k][1] == two[e + k][1]:
                    k += 1
                shift = e - b if a == c else k
                for m in range(e, e + k):
                    run = two[m : min(m + shift, e + k)]
                    if sum(n for *_, n in run) >= least:
                        gone[c] |= {at for at, *_ in run}
    return gone
