"""Plain versions of the operators, for small tables of (doc_id, text, source)."""

import hashlib
import math
import re
import zlib
from collections import Counter

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for label, phrase in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def suffixes(rows, size=400):
    raw = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[i : i + size] for _, t in raw for i in range(len(t) - size + 1))
    out = []
    for d, t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if count[t[i : i + size]] > 1:
                gone[i : i + size] = b"\x01" * size
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def shared_bytes(rows, size):
    raw = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[i : i + size] for _, t in raw for i in range(len(t) - size + 1))
    out = []
    for d, t in raw:
        held = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if count[t[i : i + size]] > 1:
                held[i : i + size] = b"\x01" * size
        out.append((d, sum(held)))
    return out


def suffixes_first(rows, size):
    """Rows in the order of doc_id; a window that started earlier goes."""
    seen, out = set(), []
    for d, text in sorted(rows):
        t = (text or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if t[i : i + size] in seen:
                gone[i : i + size] = b"\x01" * size
            seen.add(t[i : i + size])
        out.append((d, bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return out


def rules(text):
    text = text or ""
    w = WORDS.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def lines(rows):
    key = lambda x: x.strip(SPACE).translate(LOWER)
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(held.get(key(x), ())) < 3 or max(held[key(x)]) == d]
        out.append((d, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def shingles(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(i)
    pairs = Counter((i, j) for v in index.values() for a, i in enumerate(v) for j in v[a + 1 :])
    for (i, j), k in pairs.items():
        (d, s), (e, t) = sets[i], sets[j]
        if 100 * k >= 80 * (len(s) + len(t) - k):
            a, b = sorted((find(d), find(e)))
            root[b] = a
    return [(d, len(s), find(d)) for d, s in sets]


def base_scores(rows):
    tokens = [(d, [*WORDS.findall((t or "").translate(LOWER)), None]) for d, t in rows]
    count = Counter(x for d, t in tokens if zlib.crc32(str(d).encode()) % 10 for x in t)
    n, v = sum(count.values()), len(count)
    return [(d, zlib.crc32(str(d).encode()) % 10 == 0, len(t), sum(x in count for x in t), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)) for d, t in tokens]


def lm_scores(rows, n, rounds=100):
    """Log10 of the interpolated n-gram model: counts by n-gram tuples, weights by bucket from every held-out token of fold 1."""
    texts = [(zlib.crc32(str(d).encode()) % 10, [*WORDS.findall((t or "").translate(LOWER)), None]) for d, t in rows]
    gram = lambda w, i, k: tuple(w[i - k : i + 1]) if i >= k else ("begin", k, *w[: i + 1])

    def count(chosen):
        c = Counter(gram(w, i, k) for f, w in texts if chosen(f) for i in range(len(w)) for k in range(n))
        return c, sum(len(w) for f, w in texts if chosen(f)), sum(chosen(f) for f, _ in texts)

    def parts(c, total, docs, w, i):
        """Estimates of orders 1 to n, and the bucket."""
        before = [total] + [docs if i == 0 else c[gram(w, i - 1, k - 1)] for k in range(1, n)]
        met = [k for k in range(1, n) if before[k]]
        bucket = (met[-1], min(int(math.log2(before[met[-1]])), 23)) if met else (0, 0)
        return [c[gram(w, i, k)] / max(before[k], 1) for k in range(n)], bucket

    every, outside = count(lambda f: f > 0), count(lambda f: f > 1)
    v = len({x for f, w in texts if f > 0 for x in w})
    held = {}
    for f, w in texts:
        for i in range(len(w) if f == 1 else 0):
            p, b = parts(*outside, w, i)
            held.setdefault(b, []).append([*p, 1 / (v + 1)])

    def weights(b):
        while b not in held and b[1]:
            b = (b[0], b[1] - 1)
        w = [1 / (b[0] + 2) if k <= b[0] or k == n else 0.0 for k in range(n + 1)]
        if b not in held:
            return w
        for _ in range(rounds):
            new = [0.0] * (n + 1)
            for p in held[b]:
                total = sum(x * y for x, y in zip(p, w, strict=True))
                for k in range(n + 1):
                    new[k] += p[k] * w[k] / total
            w = [x / len(held[b]) for x in new]
        return [0.999 * x + 0.001 * (k == n) for k, x in enumerate(w)]

    cache, out = {}, []
    for _, w in texts:
        score = 0
        for i in range(len(w)):
            p, b = parts(*every, w, i)
            cache[b] = cache.get(b) or weights(b)
            score += math.log10(sum(x * y for x, y in zip([*p, 1 / (v + 1)], cache[b], strict=True)))
        out.append(score)
    return out


def statistics(text):
    """The classifier's features, by the lists and counts that they are named after."""
    raw = (text or "").encode()
    w = [x.lower() for x in re.findall(rb"[^ \t\n\x0b\x0c\r]+", raw)]
    n, k = len(raw), len(w)
    odds = lambda x, n: math.log((x + 0.5) / (max(n - x, 0) + 0.5))
    of = lambda chars: sum(c in chars for c in raw)
    rows = [x for x in raw.split(b"\n") if x.strip()]
    blank = of(b" \t\n\x0b\x0c\r")
    upper, digit = of(bytes(range(65, 91))), of(bytes(range(48, 58)))
    symbol, mark = of(b"#*$%&|<>~^=+_{}[]\\@"), of(b"!?")
    pairs = {(w[i], w[i + 1]) for i in range(k - 1)}
    ends = sum(x.rstrip().endswith((b".", b"?", b"!")) for x in rows)
    return [
        math.log1p(k), math.log1p((n - blank) / max(k, 1)), odds(len(set(w)), k), odds(max(Counter(w).values(), default=0), k), odds(len(pairs), max(k - 1, 0)),
        odds(upper, n), odds(digit, n), odds(symbol, n), odds(mark, n), odds(blank, n),
        math.log1p(k / max(len(rows), 1)), odds(len(rows) - len(set(rows)), len(rows)), odds(ends, len(rows)),
    ]


def quality(rows, labels):
    """Scores of the quadratic discriminant by id: densities by inverse and determinant."""
    import numpy as np

    x = {d: np.array(statistics(t)) for d, t in rows}
    fit = [d for d in x if d in labels and zlib.crc32(str(d).encode()) % 3 != 1]
    every = np.array([x[d] for d in fit])
    center, scale = every.mean(0), np.sqrt(np.maximum(every.var(0), 1e-12))
    part = [np.array([(x[d] - center) / scale for d in fit if labels[d] == c]) for c in (0, 1)]
    spread = [np.cov(p.T, bias=True) for p in part]
    both = sum(len(p) * s for p, s in zip(part, spread, strict=True)) / len(fit)

    def density(z, c):
        s = 0.8 * spread[c] + 0.2 * both
        s = 0.9 * s + 0.1 * max(np.trace(s) / len(s), 1e-6) * np.eye(len(s))
        y = z - part[c].mean(0)
        return math.log(len(part[c]) / len(fit)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * y @ np.linalg.inv(s) @ y

    return {d: 1 / (1 + math.exp(min(700, max(-700, density((v - center) / scale, 0) - density((v - center) / scale, 1))))) for d, v in x.items()}


def good(rows, labels):
    """Ids that the quadratic discriminant predicts as good."""
    return {d for d, s in quality(rows, labels).items() if s >= 0.5}


def lines_kept(rows):
    """Texts without the lines that go."""
    key = lambda x: x.strip(SPACE).translate(LOWER)
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(d)
    return [(d, "\n".join(x for x in (t or "").split("\n") if len(held.get(key(x), ())) < 3 or max(held[key(x)]) == d)) for d, t in rows]


def copies(rows):
    """How often the mix takes each of (doc_id, text, source): weights 1, 2, 3 in the order of sources, at most three times."""
    by = {}
    for d, t, s in rows:
        by.setdefault(s, []).append((int(hashlib.md5(str(d).encode()).hexdigest()[:12], 16), len(WORDS.findall(t or "")), d))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    size = {s: sum(n for _, n, _ in by[s]) for s in names}
    target, left, open_ = {}, sum(size.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        capped = {s for s in open_ if 3 * size[s] <= weight[s] * level}
        target |= {s: float(3 * size[s]) if s in capped else weight[s] * level for s in capped or open_}
        left -= sum(3 * size[s] for s in capped)
        open_ = open_ - capped if capped else set()
    out = {}
    for s in names:
        full = min(int(target[s] // size[s]), 3) if size[s] else 0
        budget, done, ended = target[s] - full * size[s], 0, False
        for _, n, d in sorted(by[s]):
            ends = not ended and done + n >= budget
            out[d] = full + int(budget > 0 and not ended and (not ends or done + n - budget <= budget - done))
            ended, done = ended or ends, done + n
    return out
