"""Plain Python versions of what the operators compute."""

import re

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def brute_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] if ws else []
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_roots(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def brute_contamination(text, items):
    ws = WORD.findall(lowered(text))
    hit, met = set(), set()
    for i, t in items:
        iw = WORD.findall(lowered(t))
        if not iw:
            continue
        n = min(13, len(iw))
        for a in range(len(iw) - n + 1):
            for p in range(len(ws) - n + 1):
                if ws[p : p + n] == iw[a : a + n]:
                    hit.update(range(p, p + n))
                    met.add(str(i))
    return len(ws), len(hit), sorted(met)
