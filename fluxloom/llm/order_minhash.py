"""Document fingerprints by Order MinHash, in DataFrame operations only.

The k-mers are runs of ``k`` words. Each occurrence of a k-mer is numbered within its text, and the pair of k-mer and
number is hashed. The hash's leading bits choose one of 64 bins; in every bin the ``l`` occurrences of the least
hashes are selected, put back into the order of the text, and hashed as a tuple. A fingerprint is the list of the bins'
tuples, so it depends on which occurrences there are and on the order in which they stand, as edit distance does. The
likeness of two fingerprints is the share of bins, of those filled in either, that hold the same tuple.

A sort brings equal k-mers together, from which their occurrences are numbered; a second sort by hash brings the
bins' least occurrences to the front of each bin. Both work on longs that hold a 33-bit hash and a 30-bit position, so
the work is n log n in the words of a text.

Defined cases: a null text is empty; texts without words have an empty fingerprint, like only other such texts; texts
of fewer than ``k`` words are one k-mer; the order of a bin with fewer than ``l`` occurrences is that of those it
has; very long texts are one row each. For the neighbouring document: ids are ordered with null first, of rows that
repeat an id the one whose text has the least hash stands for it, and a table of one id is its own neighbour; rows that
repeat an id all appear in the result; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.runtime import broadcast_if_small, materialised, table

_PLACE, _HASH, _BINS = 30, 33, 6
_SPACE = " \t\n\x0b\x0c\r"


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _packed(hash64: Column, place: Column) -> Column:
    """33 bits of a hash above a 30-bit position."""
    return F.shiftleft(F.shiftrightunsigned(hash64, 64 - _HASH), _PLACE).bitwiseOR(place.cast("long"))


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(_long((1 << _PLACE) - 1))


def _bin(packed: Column) -> Column:
    return F.shiftright(packed, _PLACE + _HASH - _BINS)


def with_fingerprint(df: DataFrame, text_col: str, name: str, k: int = 2, l: int = 2) -> DataFrame:  # noqa: E741
    """``df`` with ``name``: the fingerprint as an array of ints, each 6 bits of bin above 26 bits of its tuple's hash."""
    words, kmers, again, runs, chosen = (f"_{name}_{x}" for x in ("words", "kmers", "again", "runs", "chosen"))
    trimmed = F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(_SPACE))
    df = df.withColumn(words, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    n = F.size(words)
    starts = F.slice(words, 1, F.greatest(n - (k - 1), F.least(n, F.lit(1))))
    kmer = lambda w, i: F.xxhash64(w, *[F.get(F.col(words), i + j) for j in range(1, k)])
    df = df.withColumn(kmers, F.sort_array(F.transform(starts, lambda w, i: _packed(kmer(w, i), i)))).drop(words)
    hashed = lambda v: F.shiftright(v, _PLACE)
    head = lambda c, i: hashed(F.get(F.col(c), i))
    starts_run = lambda c, i: (i == 0) | (head(c, i) != head(c, i - 1))
    alone = lambda v, i: starts_run(kmers, i) & ((i == F.size(kmers) - 1) | (hashed(v) != head(kmers, i + 1)))
    df = df.withColumn(again, F.filter(kmers, lambda v, i: ~alone(v, i)))
    places = F.sequence(F.lit(0), F.greatest(F.size(again) - 1, F.lit(0)))
    df = df.withColumn(runs, F.filter(places, lambda i: (i < F.size(again)) & starts_run(again, i)))

    def numbered(start: Column, j: Column) -> Column:
        run = F.slice(F.col(again), start + 1, F.coalesce(F.get(F.col(runs), j + 1), F.size(again)) - start)
        return F.transform(run, lambda v, occurrence: _packed(F.xxhash64(hashed(v), occurrence), _place(v)))

    once = F.transform(F.filter(kmers, alone), lambda v: _packed(F.xxhash64(hashed(v), F.lit(0)), _place(v)))
    df = df.withColumn(kmers, F.sort_array(F.concat(once, F.flatten(F.transform(runs, numbered))))).drop(again, runs)
    df = df.withColumn(chosen, F.filter(kmers, lambda v, i: (i < l) | (_bin(F.get(F.col(kmers), i - l)) != _bin(v)))).drop(kmers)

    def tuple_of(v: Column, i: Column) -> Column:
        mates = F.filter(F.slice(F.col(chosen), i + 1, l), lambda x: _bin(x) == _bin(v))
        in_text = F.sort_array(F.transform(mates, lambda x: F.shiftleft(_place(x), _HASH).bitwiseOR(F.shiftright(x, _PLACE))))
        code = F.xxhash64(F.transform(in_text, lambda x: x.bitwiseAND(_long((1 << _HASH) - 1))))
        whole = F.shiftleft(_bin(v), 26).bitwiseOR(F.shiftrightunsigned(code, 38))
        leads = (i == 0) | (_bin(F.get(F.col(chosen), i - 1)) != _bin(v))
        return F.when(leads, F.when(whole >= 1 << 31, whole - (1 << 32)).otherwise(whole).cast("int"))

    return df.withColumn(name, F.array_compact(F.transform(chosen, tuple_of))).drop(chosen)


def fingerprint_text(fingerprint: Column) -> Column:
    """The fingerprint as a string of 8 hex digits for each filled bin."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda v: F.lpad(F.hex(v.cast("long").bitwiseAND(_long(0xFFFFFFFF))), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """The share of the bins filled in either of two fingerprints that hold the same tuple; 1 if none is filled."""
    bins = lambda x: F.transform(x, lambda v: F.shiftrightunsigned(v, 26))
    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def next_ids(ids: DataFrame) -> DataFrame:
    """The rows of ``ids`` (doc_id, distinct, and other columns) with next_id and the next row's columns as next_*.

    Rows are range-sorted and numbered in their partitions; the counts of the partitions before make places in the
    whole order, and a row meets the one at the next place. The last meets the first.
    """
    other = [c for c in ids.columns if c != "doc_id"]
    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("_at", F.monotonically_increasing_id())
    ordered = materialised(ordered).withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(_long((1 << 33) - 1))})
    parts = ordered.groupBy("_part").agg(F.count("*").alias("_held"))
    every = W.orderBy("_part")
    ahead = parts.select("_part", (F.sum("_held").over(every) - F.col("_held")).alias("_ahead"), F.sum("_held").over(W.partitionBy()).alias("_all"))
    placed = ordered.join(ahead, "_part").select("doc_id", *other, (F.col("_row") + F.col("_ahead")).alias("_place"), "_all")
    after = placed.select(F.col("doc_id").alias("next_id"), *[F.col(c).alias(f"next_{c}") for c in other], ((F.col("_place") + F.col("_all") - 1) % F.col("_all")).alias("_place"))
    return placed.join(after, "_place").drop("_place", "_all")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 1024) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness, with the next document's beside it.

    The edited text has its last quarter of code points replaced by the first as many of the next document's. An id that stands
    on over ``share`` rows, null among them, is dealt out in that many shares.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.select("doc_id", F.length("text").alias("n"), F.xxhash64("text").alias("hash")).groupBy("doc_id")
    ids = materialised(ids.agg(F.max("n").alias("n"), F.min("hash").alias("hash"), F.ceil(F.count("*") / share).cast("int").alias("shares")))
    crowded = materialised(ids.where("shares > 1").select(F.col("doc_id").alias("_id"), F.col("shares").alias("_shares")))
    spread = rows.join(broadcast_if_small(crowded), rows["doc_id"].eqNullSafe(F.col("_id")), "left")
    lot = F.when(F.col("_shares").isNotNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_shares")).cast("int")).otherwise(0)
    keyed = spread.select(F.struct("doc_id", lot.alias("share")).alias("key"), "text")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    follows = next_ids(ids).select("doc_id", "shares", "next_id", "next_hash", F.floor(F.col("n") / 4).cast("int").alias("q"), every("next_shares").alias("next_share"))
    follows = follows.select("doc_id", "shares", "q", "next_hash", F.struct(F.col("next_id").alias("doc_id"), F.col("next_share").alias("share")).alias("next_key"))
    # both joins deal the texts out by the same key, a struct that is equal for null ids too, so they are shuffled once
    found = keyed.join(follows, keyed["key"] == follows["next_key"]).where(F.xxhash64("text").bitwiseXOR(F.col("next_hash")) == 0)
    found = with_fingerprint(found, "text", "sig").select("doc_id", F.substring("text", F.lit(1), F.col("q")).alias("head"), "sig", every("shares").alias("share"))
    heads = found.groupBy(F.struct("doc_id", "share").alias("at_key")).agg(F.first("head").alias("head"), F.first("sig").alias("next_sig"))
    whole = keyed.join(heads, keyed["key"] == heads["at_key"]).withColumn("n_chars", F.length("text"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - quarter), F.substring("head", F.lit(1), quarter))
    whole = whole.withColumn("edited", edited).drop("head")
    whole = with_fingerprint(with_fingerprint(whole, "text", "sig"), "edited", "edited_sig")
    return whole.select(
        F.col("key.doc_id").alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_text(F.col("sig")).alias("fingerprint"),
        fingerprint_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return edited_likeness(table(spark, sf_dir, "documents"))
