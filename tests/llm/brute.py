"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def exact(docs):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in docs}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    return {i: (min(groups[t]), len(groups[t]), min(groups[t]) == i, sha(t)) for i, t in norm.items()}


def lines(docs, least=20, holders=3):
    key = lambda x: x.strip(SPACE).translate(LOW)
    held = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held[key(x)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= holders}
    out = {}
    for i, t in docs:
        own = (t or "").split("\n")
        kept = [x for x in own if not (key(x) in gone and gone[key(x)] != i)]
        out[i] = (len(own), len(own) - len(kept), "\n".join(kept))
    return out


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard(docs, percent=80):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            held[g].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in held[g] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def repeats(docs, least):
    texts = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[k : k + least] for _, b in texts for k in range(len(b) - least + 1))
    out = {}
    for i, b in texts:
        covered = bytearray(len(b))
        for k in range(len(b) - least + 1):
            if seen[b[k : k + least]] > 1:
                covered[k : k + least] = b"\1" * least
        kept = bytes(x for x, c in zip(b, covered) if not c)
        out[i] = (len(b), sum(covered), sum(1 for k in range(len(b)) if covered[k] and (not k or not covered[k - 1])), sha(kept), covered)
    return out


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def search(docs, items, k=10):
    """{item_id: [(score, doc_id)]}, best first; docs is a list, so that ids may repeat."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(1 for _, b in bags if b)
    words = sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(terms(t))
    out = {}
    for item, q in asked.items():
        found = []
        for i, b in bags:
            size, score = sum(b.values()), 0
            for w, times in q.items():
                if b[w]:
                    weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
                    score += times * weight * (1000000000 * b[w] // (1000 * b[w] + 8 * (100 - 75 + 75 * size * n // words)))
            if score > 0:
                found.append((score, i))
        out[item] = sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
    return out


def windows(docs, items, window=10):
    """[(doc_id, n_words, hit word numbers, item ids)] in the order of docs."""
    own = [(i, w[p : p + window]) for i, t in items for w in [terms(t)] if w for p in range(max(len(w) - window, 0) + 1)]
    out = []
    for i, t in docs:
        w, hit, found = terms(t), set(), set()
        for item, x in own:
            for p in range(len(w) - len(x) + 1):
                if w[p : p + len(x)] == x:
                    hit.update(range(p, p + len(x)))
                    found.add(item)
        out.append((i, len(w), hit, sorted(str(x) for x in found if x is not None)))
    return out
