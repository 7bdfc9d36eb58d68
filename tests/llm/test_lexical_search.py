"""Lexical search against all documents scored one by one, blocks against all cuts, and the defined cases."""

import math
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest

from fluxloom.llm import lexical_search, registry
from tests.oracle import rows_of, sql_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _brute(docs, items, k=10):
    held = [(i, Counter(_terms(t))) for i, t in docs if _terms(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 25 + (75 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in _terms(text) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(str(item), r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def _found(spark, docs, items, **more):
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, q string, block int")
    asked = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, score int")
    return sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in lexical_search.rank_documents(rows.repartition(3), asked, **more).collect()), key=str)


def _corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "naïve", "ZEBRA", "日本"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(r.choices(words, weights, k=r.randrange(0, 40))) + r.choice([".", "", "!\n"])) for i in range(n)], r, words


@pytest.mark.parametrize("shard_bytes", [500, 1 << 20])
def test_matches_brute_force(spark, shard_bytes):
    docs, r, words = _corpus(3, 400)
    items = [(q, " ".join(r.sample(words, r.randrange(1, 9))) + " " + r.choice(words)) for q in range(30)]
    assert _found(spark, docs, items, shard_bytes=shard_bytes) == _brute(docs, items)
    # queries in many blocks, over an index of every term
    assert _found(spark, docs, items, shard_bytes=shard_bytes, query_bytes=64, k=3) == _brute(docs, items, 3)


def test_odd_rows(spark):
    long_ = " ".join(f"t{i % 5000}" for i in range(300_000))
    docs = [(1, None), (2, ""), (3, "... !!"), (4, "alpha beta"), (4, "alpha beta"), (5, "ALPHA beta"), (None, "alpha beta"), (6, long_), (7, "x" * 3_000_000), (4, "alpha")]
    items = [(1, "alpha"), (1, "beta beta, alpha"), (None, "t17 alpha"), (2, None), (3, "?!"), (4, "x" * 3_000_000), (5, "no such term")]
    assert _found(spark, docs, items) == _brute(docs, items)
    assert _found(spark, docs, items, k=2) == _brute(docs, items, 2)
    assert _found(spark, [], items) == [] and _found(spark, docs, []) == [] and _found(spark, docs, [(2, None)]) == []


def test_thousands_of_equal_scores(spark):
    docs = [(i * 7919 % 6000, "one passage that thousands share") for i in range(6000)] + [(9000 + i, f"other text {i}") for i in range(50)]
    found = _found(spark, docs, [(1, "passage share")], shard_bytes=20_000)
    assert [d for _, _, d, _ in sorted(found, key=lambda x: x[1])] == list(range(10))


def test_query_agrees_with_sql(spark, small):
    assert rows_of(registry.queries()["op11_lexical_search"](spark, small)) == sql_rows(registry.oracle_sql()["op11_lexical_search"], small)


def _cost(parts, ends, block_cost):
    cost, start = 0.0, 0
    for e in ends:
        cost += block_cost * np.mean(parts) + (e + 1 - start) * max(parts[start : e + 1])
        start = e + 1
    return cost


def test_blocks_are_the_best_of_all_cuts():
    r = np.random.default_rng(5)
    lists = [r.integers(1, 1000, n) for n in (1, 2, 5, 9, 10, 10, 3)]
    counts = np.array([len(x) for x in lists])
    for max_block, block_cost in ((64, 1.5), (3, 0.2), (4, 3.0)):
        ends = np.split(lexical_search.cut_blocks(np.concatenate(lists), counts, max_block, block_cost), np.cumsum(counts)[:-1])
        for parts, got in zip(lists, ends, strict=True):
            got, least = np.flatnonzero(got), math.inf
            assert got[-1] == len(parts) - 1 and np.diff(np.concatenate([[-1], got])).max() <= max_block
            for inner in product([0, 1], repeat=len(parts) - 1):
                cut = [i for i, x in enumerate([*inner, 1]) if x]
                if np.diff(np.concatenate([[-1], cut])).max() <= max_block:
                    least = min(least, _cost(parts, cut, block_cost))
            assert _cost(parts, got, block_cost) == pytest.approx(least)


def test_bounds_hold_and_skip(spark):
    """No bound is below its document's score, and few documents are scored."""
    r = random.Random(11)
    docs = [(i, " ".join(r.choices([f"a{i // 200}-{x}" for x in range(50)] + ["the", "of"], k=60))) for i in range(4000)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    index = lexical_search.Index(rows)
    weights = index.weights({b"the", b"a3", b"7", b"9", b"a5"})
    (row,) = index.shards.collect()
    shard = lexical_search.Shard(*(bytes(x) if isinstance(x, (bytes, bytearray)) else [bytes(t) for t in x] if i == 1 else x for i, x in enumerate(row)))
    query = [(t, w) for t, w in weights.items() if w]
    lists = [(shard.place[t], w) for t, w in query]
    every = shard.scores(lists, np.arange(4000))
    bounds = shard.bounds(lists)
    assert (bounds >= every).all() and (bounds < 3 * every.max()).all()
    shard.scored = 0
    best = shard.search(query, [], 10)
    assert [(-s, i) for s, _, i in best] == sorted(((int(s), i) for i, s in enumerate(every)), key=lambda x: (-x[0], x[1]))[:10]
    assert shard.scored < 1500
