"""The prefix trie against dictionaries of prefixes, whatever the blocks, and the defined cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from fluxloom.llm import prefix_trie, registry
from tests.oracle import rows_of, sql_rows

SCHEMA = "conv_id long, turn long, role string, text string, depth int, a string"


def _convs(rows):
    held = defaultdict(list)
    for c, turn, role, text in rows:
        held[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in held.items()}


def _rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        if c is None:
            out[c] = turns
            continue
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def _brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    key = lambda c: (c is None, c or 0)
    out = []
    for node, held in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join("" if c is None else str(c) for c in sorted(held, key=key) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]], key=key) if node else None
        out.append((min(held, key=key), len(node), parent, len(held), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "mine") for r in rows], SCHEMA)


def _rows(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


def _random(seed, n):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant", None]), r.choice(["a", "b", "à", "", None])) for c in range(n) for t in range(r.randrange(0, 7))]


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_matches_prefixes(spark, block):
    rows = _random(block, 120)
    assert _rows(prefix_trie.prefix_trie(_frame(spark, rows), block=block)) == _brute(_convs(rows))


def test_rebuilt_conversations(spark):
    rows = [(c - 8 if c > 3 else c, t, role, text) for c, t, role, text in _random(9, 90)]
    built, convs = prefix_trie.branched(prefix_trie.numbered(_frame(spark, rows)))
    assert _rows(prefix_trie.trie_of(built, convs)) == _brute(_rebuilt(_convs(rows)))


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, "user", "x"), (1, 0, "user", "x"), (1, 0, "user", "x"), (None, 1, "user", "x"), (None, 2, None, "long " * 50_000), (2, 5, "user", "x"), (-3, 5, "user", "x")]
    assert _rows(prefix_trie.prefix_trie(_frame(spark, rows))) == _brute(_convs(rows))
    assert prefix_trie.prefix_trie(_frame(spark, [])).count() == 0
    only = [(None, 1, "user", "x"), (None, 2, None, None)]
    assert _rows(prefix_trie.prefix_trie(_frame(spark, only))) == _brute(_convs(only))


def test_conversations_without_turns(spark):
    rows = prefix_trie.numbered(_frame(spark, [(3, 0, "user", "hé")]))
    found = _rows(prefix_trie.trie_of(rows.selectExpr("conv", "pos + 1 AS depth", "h1", "h2", "tokens"), spark.range(1, 4).selectExpr("id AS conv")))
    assert found == _brute({1: [], 2: [], 3: [("user", "hé")]})


def test_one_long_conversation_and_thousands_of_copies(spark):
    rows = [(5, t, "user", f"turn {t}") for t in range(3000)] + [(10 + c, t, "user", f"turn {t}") for c in range(2000) for t in range(2)]
    found = _rows(prefix_trie.prefix_trie(_frame(spark, rows), block=100))
    assert len(found) == 3001
    by_depth = {r[1]: r for r in found}
    assert by_depth[0][:6] == (5, 0, None, 2001, 1, 1) and by_depth[2][3:6] == (2001, 1, 1) and by_depth[3][3] == 1
    assert by_depth[0][6] == 2 * 2000 * len("turn 0") and by_depth[2][6] == 2000 * len("turn 0") and by_depth[3][6] == 0
    assert by_depth[2][7] == hashlib.sha256(",".join(str(10 + c) for c in range(2000)).encode()).hexdigest()


def test_tokens_of_another_kind(spark):
    rows = _random(4, 40)
    from pyspark.sql import functions as F

    found = prefix_trie.prefix_trie(_frame(spark, rows), tokens=lambda text: F.lit(1).cast("long"))
    convs = _convs(rows)
    nodes = {tuple(t[:d]) for t in convs.values() for d in range(1, len(t) + 1)}
    assert found.where("depth = 0").first().saved_tokens == sum(map(len, convs.values())) - len(nodes)


def test_query_agrees_with_sql(spark, small):
    assert rows_of(registry.queries()["op12_prefix_trie"](spark, small)) == sql_rows(registry.oracle_sql()["op12_prefix_trie"], small)
