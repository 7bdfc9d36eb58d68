"""Plain versions of the corpus operators over lists of rows."""

import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def simhash(text, width=4):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(ids, prints, distance=4):
    """id -> smallest id reachable; ids are distinct."""
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= distance:
                x, y = top(ids[a]), top(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def kept_words(docs, width=50):
    """[(id, text)] -> [kept words] in the same order; a null id comes last."""
    key = lambda i: (i is None, i if i is not None else 0)
    first = {}
    for i, text in docs:
        w = words(text)
        for s in range(len(w) - width + 1):
            run = tuple(w[s : s + width])
            if run not in first or key(i) < first[run]:
                first[run] = key(i)
    out = []
    for i, text in docs:
        w = words(text)
        gone = {p for s in range(len(w) - width + 1) if first[tuple(w[s : s + width])] < key(i) for p in range(s, s + width)}
        out.append([x for p, x in enumerate(w) if p not in gone])
    return out


def targets(sizes, weights=(1, 2, 3), cap=3.0):
    """Shares by weight, stopped at the cap and shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, shut = float(sum(sizes.values())), {}
    while True:
        open_ = [s for s in names if s not in shut]
        level = (left / sum(weight[s] for s in open_)) if open_ else 0.0
        over = [s for s in open_ if level * weight[s] > cap * sizes[s]]
        if not over:
            return shut | {s: level * weight[s] for s in open_}
        for s in over:
            shut[s] = cap * sizes[s]
            left -= shut[s]


def order_minhash(text, k=2, l=2, bins=64):  # noqa: E741
    """The bins' tuples as lists of (k-mer, occurrence) in text order, by the operator's hashes."""
    w = words(text)
    runs = [w[i : i + k] for i in range(max(len(w) - k + 1, min(len(w), 1)))]

    def chained(parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p, seed)
        return seed

    seen, items = Counter(), []
    for at, run in enumerate(runs):
        h = chained([x.encode() for x in run]) >> 31
        items.append((h, seen[h], at))
        seen[h] += 1
    rows = sorted((chained([h.to_bytes(8, "little"), n.to_bytes(4, "little")]) >> 31, at, (tuple(runs[at]), n)) for h, n, at in items)
    out = {}
    for h, at, item in rows:
        held = out.setdefault(h >> 27, [])
        if len(held) < l:
            held.append((at, item))
    return {b: tuple(i for _, i in sorted(v)) for b, v in out.items()}


def jaccard_groups(rows, width=5):
    """[(key, text)] -> key of the least row reachable over pairs with a similarity of 0.8 or more; keys are distinct."""
    sets = []
    for _, t in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or {tuple(w)})
    keys = [k for k, _ in rows]
    root = {k: k for k in keys}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = top(keys[a]), top(keys[b])
                root[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}


def trigram_counts(text):
    """Counts of the trigrams of a text's letters, runs of other characters being one blank."""
    chars, seen = [" "], False
    for c in (text or "").lower():
        if c.isalpha():
            chars.append(c)
            seen = True
        elif chars[-1] != " ":
            chars.append(" ")
    if chars[-1] != " ":
        chars.append(" ")
    return Counter(tuple(chars[i : i + 3]) for i in range(len(chars) - 2)) if seen else Counter()


def hypervector(text, letters, dimensions=512, seed=17):
    """The bundle of a text's bound trigrams, element by element; ``letters`` keeps the letters' vectors."""
    import numpy as np

    def letter(c):
        if c not in letters:
            point = 0 if c == " " else ord(c)
            letters[c] = np.random.default_rng([seed, point]).integers(0, 2, dimensions, np.int8).astype(np.int64) * 2 - 1
        return letters[c]

    total = np.zeros(dimensions, np.int64)
    for (a, b, c), n in trigram_counts(text).items():
        total += n * np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    return total


def languages(learn, asked):
    """[(text, lang)] and texts -> [(lang, score)]."""
    import numpy as np

    letters, sums = {}, {}
    for text, lang in learn:
        v = hypervector(text, letters)
        if lang is not None and (v @ v):
            sums[lang] = sums.get(lang, 0) + v / np.sqrt(v @ v)
    names, out = sorted(sums), []
    for text in asked:
        v = hypervector(text, letters)
        if not trigram_counts(text) or not names:
            out.append(("und", 0.0))
            continue
        cosines = [float(sums[n] @ v / np.linalg.norm(sums[n]) / max(np.linalg.norm(v), 1e-12)) for n in names]
        best = max(range(len(names)), key=lambda i: (cosines[i], -i))
        out.append((names[best], max(0.0, cosines[best]), sorted(cosines)[-2:]))
    return out


def quality_statistics(text):
    """The 26 statistics by plain loops."""
    import math

    data = (text or "").encode()
    n, w = len(data), [x for x in re.split(rb"[ \t\n\x0b\x0c\r]+", data) if x]
    lines = data.split(b"\n")
    filled = [x for x in lines if x.strip()]
    upper, digit = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
    space, stop = b" \t\n\x0b\x0c\r", b".,;:?'\"-()"
    letter = lambda b: b >= 128 or chr(b).isalpha()
    share = lambda a, b: a / b if b else 0.0
    lengths, times, chars = [len(x) for x in w], Counter(w), Counter(data)
    mean = share(sum(lengths), len(w))
    values = [
        math.log1p(n), math.log1p(len(w)), math.log1p(len(filled)),
        mean, math.sqrt(share(sum((x - mean) ** 2 for x in lengths), len(w))), math.log1p(max(lengths, default=0)),
        share(sum(map(letter, data)), n), share(sum(b in upper for b in data), sum(map(letter, data))), share(sum(b in digit for b in data), n),
        share(sum(b in space for b in data), n), share(sum(b in stop for b in data), n),
        share(sum(not (letter(b) or b in digit or b in space or b in stop) for b in data), n),
        share(data.count(b"|"), len(w)), share(data.count(b"!"), len(w)), share(data.count(b"\n"), len(w)), share(sum(b >= 128 for b in data), n),
        share(len(times), len(w)), share(max(times.values(), default=0), len(w)), share(len(set(zip(w, w[1:], strict=False))), len(w) - 1 if w else 0),
        share(len(set(filled)), len(filled)), math.log1p(share(len(w), len(filled))), share(sum(x.rstrip()[-1:] in (b".", b"?", b"!") for x in filled), len(filled)),
        share(sum(x.isupper() for x in w), len(w)), share(sum(x[-1] < 128 and not x[-1:].isalnum() and x[-1:] not in (b".", b",", b";", b":", b"?", b"!") for x in w), len(w)),
        math.log1p(share(len(w), sum(x[-1:] in (b".", b"?", b"!") for x in w) + 1)), -sum(c / n * math.log2(c / n) for c in chars.values()) if n else 0.0,
    ]
    return [round(min(40.0, v) * 10_000) for v in values]


def quality_scores(stats, labelled, frequencies=160, width=3.0, ridge=1e-4, seed=31):
    """Scores of rows of statistics, learned from (statistics, label, half), with the normal equations of whole matrices."""
    import numpy as np

    x, y, half = (np.array(c, float) for c in zip(*labelled, strict=True))
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1.0)
    drawn = np.random.default_rng(seed).standard_normal((x.shape[1], frequencies)) / width

    def lifted(rows):
        p = np.clip((np.array(rows, float) - mean) / spread, -5, 5) @ drawn
        return np.hstack([np.cos(p), np.sin(p), np.ones((len(p), 1))])

    def ridge_fit(z, t):
        return np.linalg.solve(z.T @ z / len(z) + (ridge + 2.0 / len(z)) * np.eye(z.shape[1]), z.T @ t / len(z))

    z = lifted(x)
    crossed = [ridge_fit(z[half != h], y[half != h]) for h in (0, 1)]
    raw = np.array([z[i] @ crossed[int(h)] for i, h in enumerate(half)])
    grid = np.rint((np.clip(raw, -0.5, 1.5) + 0.5) * 1000) / 1000 - 0.5
    blocks = [[c * (grid == c).sum(), y[grid == c].sum(), (grid == c).sum()] for c in np.unique(grid)]
    at = 0
    while at + 1 < len(blocks):  # merge the first pair that falls, then look again from the one before
        if blocks[at][1] / blocks[at][2] >= blocks[at + 1][1] / blocks[at + 1][2]:
            blocks[at] = [a + b for a, b in zip(blocks[at], blocks.pop(at + 1), strict=True)]
            at = max(0, at - 1)
        else:
            at += 1
    return np.clip(np.interp(lifted(stats) @ ridge_fit(z, y), [b[0] / b[2] for b in blocks], [b[1] / b[2] for b in blocks]), 0, 1)
