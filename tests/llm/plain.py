"""Plain versions of the corpus operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def mix(rows, weights=(5, 2, 1), share=1.5, limit=2.0):
    """Per row (doc_id, text, source) the target of its source and the words taken."""
    size = [len(words(t)) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in sources}
    w = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    budget, capped = share * sum(size), set()
    while True:
        free = [s for s in sources if s not in capped]
        if not free:
            level = math.inf
            break
        level = (budget - sum(limit * total[s] for s in capped)) / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > limit * total[s]}
        if not over:
            break
        capped |= over
    target = {s: min(limit * total[s], w[s] * level) for s in sources}
    at = lambda r: int(hashlib.md5(f"{'' if r[0] is None else r[0]}\n{r[1] or ''}".encode()).hexdigest()[:15], 16)
    taken = [0] * len(rows)
    for s in sources:
        reps = math.floor(target[s] / total[s]) if total[s] else 1
        room, before = target[s] - reps * total[s], 0
        for i in sorted((i for i, r in enumerate(rows) if r[2] == s), key=lambda i: at(rows[i])):
            taken[i] = size[i] * (reps + (room >= before + size[i] / 2))
            before += size[i]
    return size, [target[r[2]] for r in rows], taken


def shingles(text):
    w = words((text or "").translate(LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_duplicates(rows):
    """Component of every (doc_id, text)."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 75 * len(a | sets[j]) and sets[j]:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return [min(least[find(i)], default=None) for i in range(len(rows))]


def quality(text):
    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    inside = {i + k for i, g in enumerate(windows) if often[g] > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed


def conversation(turns):
    digest, said = hashlib.sha256(), ""
    for role, text in turns:
        digest.update(f"{role}\n{text}\n".encode())
        said += text if role == "assistant" else ""
    return len(turns), digest.hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()
