"""Repeated and missing ids, clashing columns by value, many labels, long urls, and plain versions of the learned operators."""

import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm import brute

from fluxloom.llm import code_search, language_id, mixing, order_minhash, packing, quality, registry, shingles, simhash, substring, url_filter

CLASH = (
    "_row", "_id", "_text", "_told", "_some", "_fp", "_lead", "_of", "_gone", "_rank", "_words", "_copies", "_copy", "_source", "_size", "_h", "_p", "_n", "_rule",
    "n_words", "n_removed", "kept_text", "score", "lang_pred", "key", "key_a", "key_b", "gone", "text_", "copies", "size", "rows", "a", "b", "part", "place", "at",
    "taken_doc_id", "host", "verdict", "fp", "node", "root", "statistics",
)


def _clashing(df):
    """``df`` with a column for each name, holding a value of its own in every row."""
    return df.select(*df.columns, *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("text"), F.lit("-"))).alias(n) for n in CLASH if n not in df.columns])


def _kept_values(rows):
    for r in rows:
        for n in CLASH:
            assert r[n].startswith(f"{n}:"), n
    return True


TEXTS = {c: " ".join(f"{c}{i * 7919 % 1000}" for i in range(80)) for c in "ABCDE"}


@pytest.mark.parametrize("drop", [simhash.drop_near_duplicates, shingles.drop_similar])
def test_dropping_tells_repeated_ids_apart(docs, drop):
    rows = [(1, "A"), (9, "A"), (9, "B"), (4, "C"), (4, "D"), (4, "D"), (None, "E"), (None, "E"), (None, "A"), (5, "A")]
    df = _clashing(docs([(i, TEXTS[t], "en", "a") for i, t in rows], clash=False))
    kept = drop(df).collect()
    assert sorted((r.doc_id or 0, r.text[0]) for r in kept) == [(0, "E"), (1, "A"), (4, "C"), (4, "D"), (9, "B")]
    assert drop(df).columns == df.columns and all(r["n_words"] == f"n_words:{r.text}" and r["_row"] == f"_row:{r.text}" for r in kept) and _kept_values(kept)


def test_every_text_keeps_a_row_of_its_group(docs):
    rows = [(i, TEXTS[t], "en", "a") for i, t in [(5, "A"), (9, "A"), (5, "B"), (3, "B")]]
    assert sorted((r.doc_id, r.text[0]) for r in simhash.drop_near_duplicates(docs(rows)).collect()) == [(3, "B"), (5, "A")]


def test_candidates_stay_flat(spark):
    """Random fingerprints meet a bounded number of others in the grid, whatever their number."""
    met = []
    for count in (20_000, 200_000):
        nodes = spark.range(count).select(F.xxhash64("id").alias("fp"))
        parts = simhash.grid_parts(count, 4)
        cells = nodes.select(F.explode(simhash.grid_cells(F.col("fp"), parts, 4)).alias("cell")).groupBy("cell").count()
        met.append(cells.agg(F.sum(F.col("count") * (F.col("count") - 1))).first()[0] / count)
    assert max(met) <= 5 and [simhash.grid_parts(n, 4) for n in (10**5, 10**6, 10**9)] == [6, 7, 9]


def _counts(x, first):
    return [(x >> i & 1) + (x >> i + 1 & 1) for i in range(first, 63, 2)]


def test_embeddings_bound_the_distance(spark):
    rng = random.Random(8)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(200)]
    apart = lambda f: F.bit_count(f(F.col("a")).bitwiseXOR(f(F.col("b"))))
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", apart(simhash.embedded).alias("even"), apart(simhash.embedded_odd).alias("odd"))
    for r in df.collect():
        for first, d in ((0, r.even), (1, r.odd)):
            assert d == sum(abs(x - y) for x, y in zip(_counts(r.a, first), _counts(r.b, first), strict=True)) <= bin(r.a ^ r.b).count("1")


def test_cells_depend_on_segment_counts_only(spark):
    """Runs that alternate have the same counts and so the same cells; other bits change a count, and a cell with it."""
    rng, signed = random.Random(5), lambda x: x - (1 << 64) if x >> 63 else x
    cells = lambda xs, parts: [r.c for r in spark.createDataFrame([(signed(x),) for x in xs], "fp long").select(simhash.grid_cells(F.col("fp"), parts, 4).alias("c")).collect()]
    for parts in (6, 7, 9):
        edges = [2 * (32 * i // parts) for i in range(parts + 1)]
        one = two = 0
        for a, b in zip(edges, edges[1:], strict=False):  # every part alternates, from 0 or from 1
            run = sum(1 << i for i in range(0, b - a, 2))
            one, two = one | run << a, two | (run if rng.random() < 0.5 else run << 1) << a
        assert one != two and cells([one], parts) == cells([two], parts)
        x = rng.getrandbits(64)
        own, *others = cells([x, *(x ^ 1 << i for i in range(64))], parts)
        assert own not in others


def _substring(df, **args):
    return sorted((r.doc_id or -1, r.text, r.kept_text, r.n_words, r.n_removed) for r in substring.remove_repeated(df, **args).collect())


def _cut(rows, width=50):
    return sorted((i or -1, t, " ".join(k), len(brute.words(t)), len(brute.words(t)) - len(k)) for (i, t), k in zip(rows, brute.kept_words(rows, width), strict=True))


@pytest.mark.parametrize("broadcast_bytes", [1 << 25, 0])
def test_substring_of_many_texts_without_id(docs, broadcast_bytes):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    shared = [[word() for _ in range(12)] for _ in range(5)]
    rows = [(None, " ".join([*(word() for _ in range(rng.randrange(3, 12))), *rng.choice(shared), word()])) for _ in range(2000)]
    rows += [(7, " ".join(shared[0])), ((1 << 63) - 1, " ".join(["x", *shared[1]])), (None, rows[0][1]), (7, " ".join(shared[2][:9])), (8, " ".join(shared[2]))]
    df = docs([(i, t, "en", "a") for i, t in rows], clash=False)
    assert _substring(df, width=8, gram=3, broadcast_bytes=broadcast_bytes) == _cut(rows, 8)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_substring_by_table_against_brute_force(docs, seed):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randrange(4, 25))] for _ in range(4)]
    rows = []
    for i in [*rng.sample(range(100), 12), None, None]:
        w = []
        for _ in range(rng.randrange(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.6 else [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))]
        rows.append((i, " ".join(w)))
    assert _substring(docs([(i, t, "en", "a") for i, t in rows], clash=False), width=8, gram=3, broadcast_bytes=0) == _cut(rows, 8)


def test_sketch_as_a_table(docs):
    """Bits by default and a small broadcast: the sketch's full cells are joined, few anchors pass, and the same words go."""
    rng = random.Random(6)
    passages = [[f"p{rng.randrange(10_000)}" for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(900):
        w = [f"w{rng.randrange(100_000)}" for _ in range(rng.randrange(0, 150))]
        rows.append((i, " ".join(w + rng.choice(passages) if i % 9 == 0 else w)))
    df = docs([(i, t, "en", "a") for i, t in rows], clash=False)
    assert _substring(df, broadcast_bytes=1000) == _substring(df) == _cut(rows, 50)
    keyed = substring.keyed(df, "doc_id", "text").select("rank_id", "key_a", "key_b", "text")
    lone = {t for i, t in rows if i % 9}
    flagged = [r for r in substring._by_table(keyed, 50, 12, 2, substring.sketch_bits(keyed)).collect() if r.text in lone]
    anchors = sum(len(np.unique(substring.Spans(t, 50, 12).anchor)) for t in lone)
    assert sum(len(r.flagged) for r in flagged) < 0.02 * anchors


def test_blocks_of_a_wide_sketch(spark):
    """A sketch of 2^40 cells holds only the blocks that have anchors."""
    text = " ".join(f"w{i}" for i in range(200))
    rows = spark.createDataFrame([(text,), (text,), ("other " * 60 + text[:400],)], "text string")
    held = substring._sketches(rows, 50, 12, 2, 40).collect()
    assert 0 < len(held) < 200 and max(r.block for r in held) > 1 << 20 and {r.row for r in held} == {0, 1}


def test_sketch_follows_the_texts(spark):
    rows = spark.createDataFrame([("x" * 1000,)], "text string")
    assert substring.sketch_bits(rows) == 16 and substring.sketch_bits(spark.range(1 << 16).select(F.lit("x" * 1024).alias("text"))) == 23


def test_substring_keeps_values(docs, odd):
    df = _clashing(docs(odd, clash=False))
    kept = substring.drop_repeated(df)
    assert kept.columns == df.columns and _kept_values(kept.collect())
    removed = substring.remove_repeated(df)
    assert all(r["_id"].startswith("_id:") and isinstance(r["n_words"], int) for r in removed.collect())


def test_mixing_tells_rows_without_id_apart(docs):
    rows = [(None, " ".join(f"t{n}w{i}" for i in range(10)), "en", "a") for n in range(50)] + [(1, " ".join(["w"] * 250), "en", "b"), (2, " ".join(["v"] * 500), "en", "c")]
    df = _clashing(docs(rows, clash=False))
    mixed = mixing.mix_sources(df).collect()
    taken = sum(10 for r in mixed if r.source == "a")
    target = brute.targets({"a": 500, "b": 250, "c": 500})["a"]
    assert abs(taken - target) <= 10 and _kept_values(mixed) and mixing.mix_sources(df).columns == df.columns


def test_mixing_ranks_very_many_sources(spark):
    sizes = {f"s{i:04d}": i % 50 for i in range(3000)}
    found = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7), (1, 2, 3), 3.0)
    want = brute.targets(sizes)
    assert all(abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source]) for r in found.collect())


def test_language_stage_keeps_values(docs, odd):
    df = _clashing(docs(odd, clash=False))
    told = language_id.tell_language(df, language_id.learn_prototypes(df))
    assert told.columns == df.columns and _kept_values(told.collect()) and told.where("lang IS NULL").count() == 0


def test_ten_thousand_labels(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéñжш漢字") for _ in range(14)) for _ in range(10_000)]
    rows = spark.createDataFrame([(n, f"l{i:05d}") for i, n in enumerate(names)], "text string, lang string")
    prototypes = language_id.learn_prototypes(rows)
    assert len(prototypes.languages) == 10_000 and len(prototypes.blocks) == 3
    asked = rows.where("lang LIKE 'l___00'")
    assert language_id.identify_language(asked, prototypes).where("lang = lang_pred").count() == 100


def test_equal_cosines_go_to_the_first_name(spark):
    rows = spark.createDataFrame([("same words", "b"), ("same words", "a"), ("other", "c")], "text string, lang string")
    assert language_id.identify_language(rows, language_id.learn_prototypes(rows)).where("text = 'same words' AND lang_pred <> 'a'").count() == 0


def test_language_id_against_plain_version(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    learn = [(r.text, r.lang) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    want = dict(zip((r.doc_id for r in rows), brute.languages(learn, [r.text for r in rows]), strict=True))
    for r in registry.queries()["op1_language_id"](spark, small).collect():
        w = want[r.doc_id]
        assert abs(r.score - w[1]) < 1e-4 and (r.lang_pred == w[0] or w[2][1] - w[2][0] < 1e-4)


def test_statistics_against_plain_version(odd, spark, small):
    texts = [t for _, t, _, _ in odd] + ["It's 5 o'clock.\nIT IS! a|b\n\n \nÉté — 漢字?", "!!!", "\n\n", " . "]
    texts += [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    for t in texts:
        assert np.abs(np.array(quality.statistics(t)) - brute.quality_statistics(t)).max() <= 1, t and t[:50]


def test_quality_against_plain_version(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    half = {r.doc_id: r.h for r in labels.select("doc_id", (F.xxhash64("doc_id") % 2 != 0).cast("int").alias("h")).collect()}
    stats = {r.doc_id: brute.quality_statistics(r.text) for r in docs.collect()}
    learn = [(stats[r.doc_id], r.quality, half[r.doc_id]) for r in labels.collect() if r.quality is not None and r.doc_id in stats and zlib.crc32(str(r.doc_id).encode()) % 5]
    want = dict(zip(stats, brute.quality_scores(list(stats.values()), learn), strict=True))
    found = {r.doc_id: r.score for r in registry.queries()["op9_quality"](spark, small).collect()}
    assert found.keys() == want.keys() and np.mean([abs(found[i] - want[i]) < 0.02 for i in found]) > 0.97


def test_quality_scores_survive_clashing_columns(docs, odd):
    plain, clashing = docs(odd, clash=False), _clashing(docs(odd, clash=False))

    def scores(df):
        rows = quality.with_statistics(df)
        model = quality.fit_quality(rows.select(F.col("doc_id").alias("key"), "statistics", (F.col("doc_id") % 2).alias("label")))
        return sorted((str(r.text), r.score) for r in quality.score_quality(rows, model).collect())

    assert scores(plain) == scores(clashing)


hosts = st.lists(st.sampled_from(["a", "b", "org", "com", "", "example"]), max_size=4).map(".".join)
paths = st.lists(st.sampled_from(["x", "xy", "", "fr", "e"]), max_size=4).map("/".join)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.builds(url_filter.UrlRule, st.sampled_from(["allow", "block"]), hosts, paths.map(lambda p: "/" + p if p else "")), max_size=12), st.lists(st.tuples(hosts, paths), min_size=1, max_size=40))
def test_both_url_paths_agree_on_all_rows(spark, rules, parts):
    urls = [f"http://{h}/{p}" for h, p in parts] + ["http://x.com./a", "http://", "no", None, "http:///x", "http://..org/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rules = [*rules, url_filter.UrlRule("block", "", "")]
    told = lambda **args: sorted((r.page_id, str(r.rule), r.verdict) for r in url_filter.judge_urls(pages, rules, **args).collect())
    assert told() == told(broadcast_bytes=0)


def test_long_urls_are_judged_at_once():
    trie = url_filter.UrlTrie(url_filter.RULES)
    began = time.perf_counter()
    assert trie.judge("example.org", "/fr/" + "a" * 1_000_000) == ("org/", "allow") and trie.judge("x.com", "/de/" + "/".join("ab" * 200_000)) == ("com/de/", "block")
    assert time.perf_counter() - began < 0.2


def test_url_columns_keep_values(spark):
    df = _clashing(spark.createDataFrame([(1, "http://a.org/x", "t")], "page_id long, url string, text string"))
    for size in (1 << 20, 0):
        row = url_filter.judge_urls(df, url_filter.RULES, broadcast_bytes=size).first()
        assert row.host == "a.org" and row.verdict == "allow" and all(row[n] == f"{n}:t" for n in ("_row", "_h", "_p", "_n", "_rule", "_id"))


def test_code_search_of_repeated_rows(spark):
    rows = [(1, 0)] * 40 + [(2, 0)] * 30 + [(i, 1) for i in range(3, 9)] + [(1, 3), (1, 5), (20, 2)]
    df = spark.createDataFrame(rows, "id long, code long").select("id", "code", F.lit("mine").alias("n"), F.lit(1).alias("salt"), F.lit("q").alias("q"))
    distinct = sorted(set(rows))
    for k in (2, 4, 30):
        found = sorted((r.query_id, r["rank"], r.neighbor_id, r.distance) for r in code_search.top_k_codes(df, df.where("id IN (1, 20)"), k).collect() if r.query_id == 20)
        want = sorted((bin(2 ^ c).count("1"), i) for i, c in distinct if i != 20)[:k]
        assert found == [(20, n + 1, i, d) for n, (d, i) in enumerate(want)]
    same = spark.createDataFrame([(5, 9)] * 50 + [(6, 9)] * 50, "id long, code long")
    assert sorted((r.query_id, r.neighbor_id) for r in code_search.top_k_codes(same, same, 3).collect()) == [(5, 6), (6, 5)]


def test_code_search_widths_follow_the_codes():
    assert max(w for _, w in code_search._segments(1 << 30)) > 20 and max(w for _, w in code_search._segments(1000)) <= 10


def test_order_minhash_of_repeated_ids(docs):
    rows = [(1, TEXTS["A"]), (1, TEXTS["B"]), (2, TEXTS["C"]), (None, TEXTS["D"]), (None, TEXTS["E"]), (2, TEXTS["C"])]
    plain = order_minhash.edited_likeness(docs([(i, t, "en", "a") for i, t in rows], clash=False)).collect()
    clashing = order_minhash.edited_likeness(_clashing(docs([(i, t, "en", "a") for i, t in rows], clash=False))).collect()
    assert sorted(map(str, plain)) == sorted(map(str, clashing)) and len(plain) == 6
    prints = {r.fingerprint for r in plain}
    assert len(prints) == 5 and sum(r.doc_id is None for r in plain) == 2


def test_copies_without_id_spread_over_partitions(spark, docs):
    df = docs([(None, "the same text without an id", "en", "a")] * 4000, clash=False).repartition(4)
    pieces = packing.pack_documents(df, packing.tokenizer_path("byte_bpe_50k.json"), 64)
    held = [r["count"] for r in pieces.groupBy(F.shiftright("sequence_id", 32).alias("part")).count().collect()]
    assert pieces.agg(F.sum("length")).first()[0] == 4000 * pieces.first().doc_tokens and len(held) > 1 and max(held) < 2 * sum(held) / len(held)


def test_neighbours_on_the_curve_share_sequences(docs):
    """Texts of one kind stand together: few sequences hold both kinds."""
    kinds = [" ".join(["alpha beta gamma delta"] * 30), " ".join(["12345 67890 !!! ???"] * 30)]
    rows = [(i, kinds[i % 2] + f" {i}", "en", "a") for i in range(400)]
    pieces = packing.pack_documents(docs(rows), packing.tokenizer_path("byte_bpe_50k.json"), 512).collect()
    held = {}
    for p in pieces:
        held.setdefault(p.sequence_id, set()).add(p.doc_id % 2)
    assert sum(len(v) == 2 for v in held.values()) <= 0.1 * len(held)


def test_fast_ids_on_random_text():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("byte_bpe_50k.json")
    fast, slow, rng = packing.Encoder(path), Tokenizer.from_file(path), random.Random(6)
    pool = "aZ09 \n\t'.!é漢ж😀 ‍́’s" + "".join(chr(rng.randrange(0x20, 0x2FFF)) for _ in range(60))
    for _ in range(400):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 60)))
        assert fast.encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_tables(spark, docs, odd, empty):
    import corpus_pipeline as cp

    df = _clashing(docs([] if empty else odd, clash=False))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns, name
        rows = out.collect()
        assert _kept_values(rows) and (not empty or not rows)
    assert (cp.STAGES[-1][1](spark, df, "").count() == 0) == empty


def _nearest_codes(rows, asked, k):
    out = []
    for i, q in sorted(set(asked)):
        d = sorted((bin(q ^ c).count("1"), j, c) for j, c in set(rows) if j != i)[:k]
        out += [(i, q, x[1], x[0]) for x in d]
    return out


def test_code_search_with_an_id_on_thousands_of_codes(spark):
    """One placeholder id on very many codes, asked for and met, and a query far from all."""
    rng = random.Random(12)
    rows = [(i, rng.getrandbits(62)) for i in range(1, 1500)] + [(0, rng.getrandbits(62)) for _ in range(3000)]
    base = rows[40][1]
    rows += [(5000 + i, base ^ 1 << i % 60) for i in range(30)] + [(9000, -1)]
    df = spark.createDataFrame(rows, "id long, code long")
    asked = [r for r in rows if r[0] in (20, 40, 41, 1400, 9000)]
    found = code_search.top_k_codes(df, spark.createDataFrame(asked, "id long, code long"), 6).collect()
    got = sorted((r.query_id, r["rank"], r.neighbor_id, r.distance) for r in found)
    full = [(i, c & (1 << 64) - 1) for i, c in rows]
    want, seen = [], {}
    for i, _, j, d in _nearest_codes(full, [(i, c & (1 << 64) - 1) for i, c in asked], 6):
        seen[i] = seen.get(i, 0) + 1
        want.append((i, seen[i], j, d))
    assert got == sorted(want)
    own = code_search.top_k_codes(df, df.where("id = 0").limit(40), 3)  # the placeholder's own rows find none of themselves
    assert own.where("neighbor_id = 0").isEmpty() and own.count() == 3


def test_long_vectors_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0] * 65)], "id long, v array<double>")
    with pytest.raises(Exception, match="64 bits"):
        df.select(code_search.sign_code(F.col("v"))).collect()
    short = spark.createDataFrame([([1.0, -1.0, 1.0],), (None,)], "v array<double>").select(code_search.sign_code(F.col("v")).alias("c")).collect()
    assert [r.c for r in short] == [5, None]


def test_order_minhash_of_thousands_of_texts_without_id(spark, docs):
    """Rows without an id are dealt out in shares: the same result, and no task with most of them."""
    rows = [(None, f"text {i % 700} of {i % 700 // 7} without any id") for i in range(1500)] + [(i, f"text {i} with an id of its own") for i in range(60)] + [(7, "again the id")]
    df = docs([(i, t, "en", "a") for i, t in rows], clash=False)
    key = lambda r: (str(r.doc_id), r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)
    plain = order_minhash.edited_likeness(df, share=10**6)
    spread = order_minhash.edited_likeness(df, share=20)
    assert sorted(map(key, plain.collect())) == sorted(map(key, spread.collect())) and spread.count() == len(rows)
    settings_ = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # else these few rows are one task anyway
    held = {n: spark.conf.get(n) for n in settings_}
    try:
        for n, v in settings_.items():
            spark.conf.set(n, v)
        sizes = order_minhash.edited_likeness(df, share=20).rdd.mapPartitions(lambda p: [sum(1 for r in p if r.doc_id is None)]).collect()
    finally:
        for n, v in held.items():
            spark.conf.set(n, v)
    assert max(sizes) < 1500 * 0.45 and sum(sizes) == 1500
