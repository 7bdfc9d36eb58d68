"""The registered queries against SQL, brute force, round trips and held-out labels."""

import hashlib
import zlib

import numpy as np
import pytest
from tests.llm import brute
from tests.oracle import rows_of, sql_rows

from fluxloom.llm import registry


@pytest.fixture(scope="module")
def texts(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    return [(r.doc_id, r.text) for r in rows]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, small, name):
    assert rows_of(registry.queries()[name](spark, small)) == sql_rows(registry.oracle_sql()[name], small)


def test_language_id_is_right_on_held_out_rows(spark, small):
    found = {r.doc_id: r for r in registry.queries()["op1_language_id"](spark, small).collect()}
    labels = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert found.keys() == labels.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in found.items())
    assert np.mean([r.lang_pred == labels[i] for i, r in found.items() if r.held_out]) > 0.97


def test_packing_round_trip(spark, small, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in texts}
    pieces = registry.queries()["op2_pack"](spark, small).collect()
    at = dict.fromkeys(ids, 0)
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == at[p.doc_id] and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        at[p.doc_id] += p.length
    assert all(at[i] == len(v) for i, v in ids.items())
    fill = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill.get(p.sequence_id, 0)
        fill[p.sequence_id] = p.offset + p.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in fill.values())


def test_mix_comes_near_its_targets(spark, small):
    rows = registry.queries()["op3_mix_sources"](spark, small).collect()
    sizes, want, taken, largest = {}, {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        want[r.source] = r.target
        assert r.taken <= 3 * r.size
    assert all(abs(want[s] - t) < 1e-6 * (1 + t) for s, t in brute.targets(sizes).items())
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    again = registry.queries()["op3_mix_sources"](spark, small).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_simhash_against_all_pairs(spark, small, texts):
    found = {r.doc_id: r for r in registry.queries()["op4_simhash"](spark, small).collect()}
    prints = [brute.simhash(t) for _, t in texts]
    ids = [i for i, _ in texts]
    assert {i: found[i].fingerprint for i in ids} == {i: f"{p:016x}" for i, p in zip(ids, prints, strict=True)}
    assert {i: found[i].component_id for i in ids} == brute.components(ids, prints)


def test_order_minhash_against_python(spark, small, texts):
    found = {r.doc_id: r for r in registry.queries()["op8_order_minhash"](spark, small).collect()}
    plain = [t or "" for _, t in texts]
    prints = [brute.order_minhash(t) for t in plain]

    def like(a, b):
        filled = set(a) | set(b)
        return sum(a.get(x) == b.get(x) for x in filled) / len(filled) if filled else 1.0

    for n, (i, _) in enumerate(texts):
        t, after = plain[n], (n + 1) % len(texts)
        edited = t[: len(t) - len(t) // 4] + plain[after][: len(t) // 4]
        r = found[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r.fingerprint) == 8 * len(prints[n])
        assert abs(r.near_edited - like(prints[n], brute.order_minhash(edited))) < 1e-9
        assert abs(r.near_next - like(prints[n], prints[after])) < 1e-9


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in registry.queries()["op9_quality"](spark, folder).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    held = [(rows[i].score, q, rows[i].predicted) for i, q in labels if rows[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    good, bad = [s for s, q, _ in held if q], [s for s, q, _ in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.95 and np.mean([p == q for _, q, p in held]) > 0.9


def test_pipeline_against_brute_force(spark, small):
    """Every stage on its own input."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(cp.STAGES)
    names = [n for n, _ in cp.STAGES]
    assert names == ["language_id", "near_dedup", "substring_dedup", "mixing", "packing"]
    told = stages["language_id"](spark, docs, small).cache()
    assert {r.doc_id for r in told.collect()} == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    near = stages["near_dedup"](spark, told, small).cache()
    groups = brute.jaccard_groups([(r.doc_id, r.text) for r in told.collect()])
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(groups.values()))
    cut = stages["substring_dedup"](spark, near, small).cache()
    before = [(r.doc_id, r.text) for r in near.collect()]
    want = {}
    for (i, t), kept in zip(before, brute.kept_words(before), strict=True):
        if kept or not brute.words(t):
            want[i] = t if len(kept) == len(brute.words(t)) else " ".join(kept)
    assert {r.doc_id: r.text for r in cut.collect()} == want and all(r.n_chars == len(r.text) for r in cut.collect())
    mixed = stages["mixing"](spark, cut, small).cache()
    assert all(df.columns == docs.columns for df in (told, near, cut, mixed))
    source = {r.doc_id: (r.source, len(brute.words(r.text))) for r in cut.collect()}
    sizes, taken = {}, {}
    for s, n in source.values():
        sizes[s] = sizes.get(s, 0) + n
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + source[r.doc_id][1]
    assert all(abs(taken.get(s, 0) - t) <= max(n for x, n in source.values() if x == s) for s, t in brute.targets(sizes).items())
    packed = stages["packing"](spark, mixed, small)
    whole = {}
    for r in packed.collect():
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert whole.keys() == copies.keys()
    assert cp.run(spark, small).count() == packed.count()
