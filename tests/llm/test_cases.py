"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm import brute

from fluxloom.llm import chat, code_search, language_id, mixing, order_minhash, packing, quality, simhash, substring, url_filter

TOKENIZER = packing.tokenizer_path("byte_bpe_50k.json")
FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_language_id(docs, odd):
    rows = docs(odd)
    found = language_id.identify_language(rows, language_id.learn_prototypes(rows)).collect()
    assert len(found) == len(odd)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and isinstance(r.score, float) for r in found)
    empty = language_id.learn_prototypes(docs([]))
    assert empty.languages == () and language_id.identify_language(rows, empty).where("lang_pred <> 'und' OR score <> 0").count() == 0
    assert language_id.identify_language(docs([]), empty).count() == 0


def test_trigrams_in_blocks(monkeypatch):
    text = "Été à la plage, 12 fois — " * 40
    whole = language_id.trigrams(text)
    monkeypatch.setattr(language_id, "_BLOCK", 37)
    assert all((a == b).all() for a, b in zip(whole, language_id.trigrams(text), strict=True))


def test_hypervectors_beyond_the_table(monkeypatch):
    grams, counts = np.arange(5000, dtype=np.int32) * 7, np.ones(5000, np.int64)
    whole = language_id.Hypervectors(64, 1).bundle(grams, counts)
    monkeypatch.setattr(language_id, "_TABLED", 1024)
    assert np.allclose(whole, language_id.Hypervectors(64, 1).bundle(grams, counts))


def test_packing(spark, docs, odd):
    pieces = packing.pack_documents(docs(odd), TOKENIZER, 64).collect()
    encoder = packing.Encoder(TOKENIZER)
    want = sorted((i, len(encoder.encode(t or "")) + 1) for i, t, _, _ in odd if i is not None)
    whole = {}
    for p in pieces:
        whole[p.doc_id] = whole.get(p.doc_id, 0) + p.length
    for i in {i for i, _ in want}:
        assert whole[i] == sum(n for j, n in want if j == i)
    fill = {}
    for p in pieces:
        fill[p.sequence_id] = fill.get(p.sequence_id, 0) + p.length
    assert all(n & (n - 1) == 0 and n <= 64 for n in fill.values())
    assert packing.pack_documents(docs([]), TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs(odd), TOKENIZER, 100)


@pytest.mark.parametrize("text", ["", " ", "a  b \n\n c", "x<|endoftext|>y <|endoftext|> z", "it's we'll 12 345 ñandú — 日本語 😀\t\r\n  end  ", "a" * 5000, " " * 3000, "ab  cd\n e" * 60_000])
def test_fast_ids_are_those_of_tokenizers(text):
    from tokenizers import Tokenizer

    encoder = packing.Encoder(TOKENIZER)
    assert encoder.fast is not None
    assert encoder.encode(text).tolist() == Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids


def test_other_tokenizers_run_as_they_are():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("word_bpe_49k.json")
    encoder = packing.Encoder(path)
    assert encoder.fast is None and encoder.encode("Two words").tolist() == Tokenizer.from_file(path).encode("Two words", add_special_tokens=False).ids


def test_hilbert_neighbours_touch():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert(cells, 3)
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_mixing(docs, odd):
    rows = docs(odd)
    mixed = mixing.mix_sources(rows)
    assert mixed.columns == rows.columns
    counts = {}
    for r in mixed.collect():
        counts[(r.doc_id, r.text)] = counts.get((r.doc_id, r.text), 0) + 1
    held = {}
    for i, t, _, _ in odd:
        held[(i, t)] = held.get((i, t), 0) + 1
    assert all(n <= 3 * held[k] and n % held[k] == 0 for k, n in counts.items())
    assert mixing.mix_sources(docs([])).count() == 0


@FEW
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d", None]), st.integers(0, 40)), min_size=1, max_size=40))
def test_targets_against_brute_force(spark, rows):
    sizes = {}
    for s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    df = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(rows)], "doc_id long, source string, size long")
    found = {r.source: r.target for r in mixing.plan_mix(df).collect()}
    assert all(abs(found[s] - t) < 1e-9 * (1 + t) for s, t in brute.targets(sizes).items())


def test_simhash_cases(docs, odd):
    found = simhash.near_duplicates(docs(odd)).collect()
    assert len(found) == len(odd)
    at = {r.doc_id: r for r in found if r.doc_id is not None}
    assert at[1].fingerprint == at[2].fingerprint == "0" * 16 and at[2].component_id == 1
    assert at[4].component_id == at[5].component_id == 4 and at[7].component_id == 6
    kept = simhash.drop_near_duplicates(docs(odd))
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 1 and 5 not in ids and 2 not in ids and 7 not in ids and ids.count(None) == 1 and kept.columns == docs(odd).columns
    assert simhash.near_duplicates(docs([])).count() == 0 and simhash.drop_near_duplicates(docs([])).count() == 0


def test_simhash_in_blocks(monkeypatch):
    text = " ".join(f"Word{i % 91}" for i in range(3000))
    whole = simhash.simhash(text)
    assert whole == brute.simhash(text)
    real = simhash.byte_blocks
    monkeypatch.setattr(simhash, "byte_blocks", lambda data: real(data, 50))
    assert simhash.simhash(text) == whole


def test_links_lose_no_pair(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(12):
            p = base
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                p ^= 1 << b
            prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long")
    for distance in (0, 3, 4, 5):
        told = [(r.u, r.v) for r in simhash.linked_pairs(nodes, distance).collect()]
        found = set(told)
        assert len(told) == len(found)
        want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for j, b in enumerate(signed) if i < j and bin(prints[i] ^ prints[j]).count("1") <= distance}
        assert found == want
    with pytest.raises(ValueError):
        simhash.linked_pairs(nodes, 6)


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (200, 100)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 102, 200)}


def test_url_rules(spark):
    rules = [*url_filter.RULES, url_filter.UrlRule("block", "a.b.org", "/x/y"), url_filter.UrlRule("allow", "", "")]
    urls = [
        None, "no host", "http://EXAMPLE.org/es/1", "http://www.example.org/en/12", "https://example.org", "http://x.com/de/#f", "http://x.com/fr/?q",
        "http://notexample.org/es/", "http://org/", "http://u@example.org:80/es/", "ftp://a.b.org/x/yz/../?x#y", "http://a.b.org/x", "http://com/de", "http://q.net?x://y", "http://",
    ]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, host string")
    quick = url_filter.judge_urls(pages, rules).orderBy("page_id").collect()
    joined = url_filter.judge_urls(pages, rules, broadcast_bytes=0).orderBy("page_id").collect()
    told = [(r.host, r.path, r.rule, r.verdict) for r in quick]
    assert told[2] == ("example.org", "/es/1", "example.org/es/", "block") and told[3][2:] == ("example.org/en/1", "block")
    assert told[4] == ("example.org", "", None, "allow") and told[5] == ("x.com", "/de/", "com/de/", "block") and told[7][2] == "org/"
    assert told[10][2:] == ("a.b.org/x/y", "block") and told[11][2] == "org/" and told[9][0] == "u@example.org:80"
    bare = lambda rows: [(r.rule, r.verdict) for r in rows if r.host]
    assert bare(quick) == bare(joined)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


TURNS = "conv_id long, turn long, role string, text string, valid string, segments int"


def test_chat_round_trip(spark):
    hostile = ["\\", "<", ">", "</turn>\n", "<turn user>\n", "\\l\\b\\g", "", None, "é😀\n\n", "\\### Assistant: </turn> ok", "x" * 200_000]
    rows = [(i, n, r, t, "m", 1) for i, t in enumerate(hostile) for n, r in enumerate(["system", "user", "assistant"])]
    rows += [(50, None, None, None, "m", 1), (50, 2, "assistant", "b", "m", 1), (50, 2, "assistant", "b", "m", 1), (None, 0, "user", "u", "m", 1), (51, 0, "us<er>", "t", "m", 1)]
    found = chat.format_chats(spark.createDataFrame(rows, TURNS))
    read = {r.conv_id: (r.t, r.loss, r.valid, r.bad_turn) for r in found.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("segments")).alias("loss"), "valid", "bad_turn").collect()}
    for i, t in enumerate(hostile):
        assert [tuple(x) for x in read[i][0]] == [(r, t or "") for r in ("system", "user", "assistant")] and read[i][1] == (t or "") and read[i][2]
    assert [tuple(x) for x in read[50][0]] == [("", ""), ("assistant", "b"), ("assistant", "b")] and read[50][1:] == ("bb", False, 0)
    assert [tuple(x) for x in read[51][0]] == [("us<er>", "t")] and not read[None][2] and read[None][3] is None
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def _code(spark, rows):
    return spark.createDataFrame(rows, "id long, code long")


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_code_search_against_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    rows = [(i, base[i % 12] ^ (1 << rng.randrange(64) if i % 3 else 0)) for i in range(300)] + [(1000 + i, base[0]) for i in range(100)]
    df = _code(spark, [(i, _signed(c)) for i, c in rows] + [(None, 5), (7777, None)])
    for k in (1, 7):
        found = {}
        for r in code_search.top_k_codes(df, df.where("id % 20 = 0"), k).collect():
            found.setdefault(r.query_id, []).append((r.rank, r.distance, r.neighbor_id))
        for i, c in rows:
            if i % 20 == 0:
                want = sorted((bin(c ^ d).count("1"), j) for j, d in rows if j != i)[:k]
                assert sorted(found[i]) == [(n + 1, d, j) for n, (d, j) in enumerate(want)]
    few = _code(spark, [(0, 1), (20, -1)])
    assert [(r.query_id, r.neighbor_id, r.distance) for r in code_search.top_k_codes(few, few, 5).orderBy("query_id").collect()] == [(0, 20, 63), (20, 0, 63)]
    assert code_search.top_k_codes(few.limit(0), few.limit(0), 3).count() == 0


def test_sign_codes(spark):
    df = spark.createDataFrame([([1.0, -1.0, None, 2.0],), ([0.5] * 64,), (None,)], "v array<float>")
    assert [r[0] for r in df.select(code_search.sign_code(F.col("v"))).collect()] == [9, -1, None]


def test_order_minhash_cases(docs, odd):
    found = order_minhash.edited_likeness(docs(odd)).collect()
    assert len(found) == len(odd)
    by_text = {}
    for r in found:
        if r.doc_id is not None:
            by_text.setdefault(dict((i, t) for i, t, _, _ in odd)[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and by_text[""] == {""}
    assert order_minhash.edited_likeness(docs([])).count() == 0
    alone = order_minhash.edited_likeness(docs([(9, "only one text here", "en", "a")])).first()
    assert alone.near_next == 1.0


def test_order_minhash_sees_order(spark):
    w = [f"w{i}" for i in range(400)]
    moved = [x for i in range(0, 400, 20) for x in reversed([w[i : i + 10], w[i + 10 : i + 20]])]
    moved = [y for x in moved for y in x]
    df = spark.createDataFrame([(" ".join(w), " ".join(moved))], "a string, b string")
    df = order_minhash.with_fingerprint(order_minhash.with_fingerprint(df, "a", "x"), "b", "y")
    same, other = df.select(order_minhash.likeness(F.col("x"), F.col("x")), order_minhash.likeness(F.col("x"), F.col("y"))).first()
    assert same == 1.0 and 0.1 < other < 0.95


def test_quality_cases(docs, odd):
    rows = quality.with_statistics(docs(odd).drop("key"))
    nothing = quality.fit_quality(rows.select(F.col("doc_id").alias("key"), "statistics", F.lit(None).cast("int").alias("label")))
    assert {r.score for r in quality.score_quality(rows, nothing).collect()} == {0.5}
    one = quality.fit_quality(rows.select(F.col("doc_id").alias("key"), "statistics", F.lit(1).alias("label")))
    assert all(0 <= r.score <= 1 for r in quality.score_quality(rows, one).collect())
    assert all(len(quality.statistics(t)) == quality.STATISTICS for _, t, _, _ in odd)
    assert quality.score_quality(quality.with_statistics(docs([])), one).count() == 0


def test_quality_does_not_depend_on_partitions(spark, small):
    docs_, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    rows = quality.with_statistics(docs_.select("doc_id", "text")).join(labels, "doc_id").select(F.col("doc_id").alias("key"), "statistics", F.col("quality").alias("label"))
    a, b = quality.fit_quality(rows.repartition(1)), quality.fit_quality(rows.repartition(5))
    assert (a.weights == b.weights).all() and (a.values == b.values).all()


def test_isotonic():
    x, v = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([1.0, 0, 3, 2]), np.array([2.0, 2, 3, 4]))
    assert np.allclose(v, [0.25, 5 / 7]) and (np.diff(v) >= 0).all() and np.allclose(x, [0.5, 18 / 7])


def _substring(df, **args):
    return {(r.doc_id, r.text): (r.kept_text, r.n_words, r.n_removed) for r in substring.remove_repeated(df, **args).collect()}


def test_substring_cases(docs, odd):
    found = substring.remove_repeated(docs(odd)).collect()
    assert len(found) == len(odd)
    rows = [(i, t) for i, t, _, _ in odd]
    want = {(i, t): " ".join(k) for (i, t), k in zip(rows, brute.kept_words(rows), strict=True)}
    assert all(r.kept_text == want[(r.doc_id, r.text)] and r.n_removed == r.n_words - len(brute.words(r.kept_text)) for r in found)
    kept = substring.drop_repeated(docs(odd))
    assert kept.columns == docs(odd).columns and substring.remove_repeated(docs([])).count() == 0 and substring.drop_repeated(docs([])).count() == 0


@FEW
@given(st.integers(0, 10_000), st.sampled_from([3, 6, 12]), st.sampled_from([3, 10, 20]))
def test_substring_against_brute_force(docs, seed, letters, bits):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefghijkl"[:letters]) for _ in range(rng.randrange(4, 25))] for _ in range(4)]
    rows = []
    for i in rng.sample(range(100), 14):
        w = []
        for _ in range(rng.randrange(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.6 else [rng.choice("abcdefghijkl"[:letters]) for _ in range(rng.randrange(1, 12))]
        rows.append((i, "  ".join(w), "en", "a"))
    rows.append((rows[0][0], "another text of the same id " + rows[1][1], "en", "a"))
    pairs = [(i, t) for i, t, _, _ in rows]
    want = {p: " ".join(k) for p, k in zip(pairs, brute.kept_words(pairs, 8), strict=True)}
    found = _substring(docs(rows, clash=False), width=8, gram=3, bits=bits)
    assert {k: v[0] for k, v in found.items()} == want


def test_entry_lives_without_the_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in ("fluxloom", "__spark_entry__.py"):
        source = os.path.join(root, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "fluxloom" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); assert 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
