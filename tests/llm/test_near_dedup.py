"""The pipeline's near-duplicate stage against all pairs' exact similarities."""

import random

from tests.llm import brute


def _least(ids, texts, width=5):
    """id -> smallest id reachable over pairs with a Jaccard similarity of 0.8 or more; ids are distinct."""
    sets = []
    for t in texts:
        w = brute.words((t or "").lower())
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or {tuple(w)})
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = top(ids[a]), top(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_near_dedup_links_at_four_fifths(docs, spark):
    import corpus_pipeline as cp

    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    passage, texts = [word() for _ in range(60)], [None, "", "one", "One", "one two"]
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(30, 150))]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        texts.append(" ".join(passage + base[:20]))
    # similar sets of different sizes, at 0.8 and just below
    long = [word() for _ in range(104)]
    texts += [" ".join(long), " ".join(long[:84]), " ".join(long[:83])]
    rng.shuffle(texts)
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    found = sorted(r.doc_id for r in cp.near_dedup(spark, docs(rows, clash=False), "").collect())
    assert found == sorted(set(_least(range(len(texts)), texts).values()))


def test_near_dedup_of_the_smallest_table(spark, small):
    import corpus_pipeline as cp

    told = dict(cp.STAGES)["language_id"](spark, spark.read.parquet(f"{small}/documents.parquet"), small).cache()
    rows = told.collect()
    near = sorted(r.doc_id for r in cp.near_dedup(spark, told, small).collect())
    assert near == sorted(set(_least([r.doc_id for r in rows], [r.text for r in rows]).values()))
