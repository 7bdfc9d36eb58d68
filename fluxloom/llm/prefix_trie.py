"""The trie of conversation prefixes, with what a trainer saves that computes each shared prefix once.

A node is a distinct sequence of first turns; conversations that begin with it are its members. Each node is owned by its
smallest member. A conversation that owns a node owns all deeper nodes of its path too, since fewer members reach them: what
it owns is the end of its path. So three numbers a conversation (where it starts to own, the tokens from there on, whether
its last node is a leaf) tell all of its nodes apart, and sums over subtrees become sums over members: the tokens of the
members' turns from a node on, less those of the turns that they own, are the tokens saved below it; members that own a leaf
count its leaves; members that own the next node count its children.

Turns are numbered by a range sort, and a node is named by 128 bits: the exclusive or of hashes of (turn, depth) along the
path. This and the running sums of tokens are taken in blocks of ``block`` turns and then over blocks, so a conversation of
any length is spread. Owners are marked by two windows, one over the members of a node with one salt, one over the first
member of each salt, so a node of any size is spread. One group-by by node, with partial sums, follows. What one task must see
whole are the ids whose digest a node shows: they pass through it sorted, one batch at a time, and are never held.

Defined cases: turns stand by turn number, null first, then by role and text; a null role or text is empty; rows without a
conversation id are one conversation, which comes after all others and shows as null (in a digest as an empty string); a
conversation without turns is a member of the root only; repeated rows are turns of their own; an empty table gives an empty
result, without a root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.llm.arrow import map_batches
from fluxloom.ordering import ranked
from fluxloom.runtime import materialised, table

_NODE = ("depth", "a", "b")


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokens=utf8_bytes) -> DataFrame:
    """(conv, pos, h1, h2, tokens): each turn's place from 0, two hashes of role and text, and ``tokens`` of its text."""
    empty = F.lit("")
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text"))
    placed = ranked(rows, ["conv"], [F.col("turn"), F.col("role"), F.col("text")], "pos")  # null turns are sorted first
    return placed.select("conv", F.col("pos").cast("long").alias("pos"), F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(7), "text", "role").alias("h2"), tokens(F.col("text")).alias("tokens"))


def _paths(turns: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """A row for each member of each node: conv, the node, its parent's a and b, tokens, below (from this turn on), length."""
    rows = turns.select("conv", "depth", "tokens", F.xxhash64("h1", "depth").alias("xa"), F.xxhash64(F.lit(11), "h2", "depth").alias("xb"), F.floor(F.col("depth") / block).alias("block"))
    inside = W.partitionBy("conv", "block").orderBy("depth")
    run = rows.withColumns({"ra": F.bit_xor("xa").over(inside), "rb": F.bit_xor("xb").over(inside), "upto": F.sum("tokens").over(inside)})
    whole, before = W.partitionBy("conv"), W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("conv", "block").agg(F.bit_xor("xa").alias("xa"), F.bit_xor("xb").alias("xb"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    ahead = {n: F.coalesce(f(c).over(before), F.lit(0)) for n, f, c in (("fa", F.bit_xor, "xa"), ("fb", F.bit_xor, "xb"), ("ft", F.sum, "tokens"))}
    sums = sums.withColumns(ahead | {"total": F.sum("tokens").over(whole), "length": F.sum("n").over(whole)})
    sums = materialised(sums.select(F.col("conv").alias("of"), F.col("block").alias("at"), *ahead, "total", "length"))
    a, b = F.col("ra").bitwiseXOR(F.col("fa")), F.col("rb").bitwiseXOR(F.col("fb"))
    below = F.col("total") - F.col("ft") - F.col("upto") + F.col("tokens")
    deep = run.join(sums, F.col("conv").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    deep = deep.select("conv", "depth", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("xa")).alias("pa"), b.bitwiseXOR(F.col("xb")).alias("pb"), "tokens", below.alias("below"), "length")
    ends = sums.groupBy("of").agg(F.max("total").alias("total"), F.max("length").alias("length"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    known = lambda c: F.coalesce(F.col(c), zero)
    roots = convs.join(ends, F.col("conv").eqNullSafe(F.col("of")), "left")
    roots = roots.select("conv", zero.alias("depth"), zero.alias("a"), zero.alias("b"), none.alias("pa"), none.alias("pb"), zero.alias("tokens"), known("total").alias("below"), known("length").alias("length"))
    return materialised(deep.unionByName(roots))


def _owned(paths: DataFrame) -> DataFrame:
    """For each conversation that owns nodes: owner, own_from (the first depth), own_below (tokens from there on), leaf."""
    salts = max(1, int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    small = F.col("conv").asc_nulls_last()
    rows = paths.select("conv", *_NODE, "below", "length", F.pmod(F.xxhash64("conv"), F.lit(salts)).alias("salt"))
    some, every = W.partitionBy(*_NODE, "salt"), W.partitionBy(*_NODE)
    first = rows.withColumns({"r": F.row_number().over(some.orderBy(small)), "deepest": F.max("length").over(some)}).where("r = 1")
    first = first.withColumns({"r": F.row_number().over(every.orderBy(small)), "deepest": F.max("deepest").over(every)}).where("r = 1")
    leaf = F.max(((F.col("depth") == F.col("length")) & (F.col("deepest") == F.col("depth"))).cast("long"))
    return first.groupBy(F.col("conv").alias("owner")).agg(F.min("depth").alias("own_from"), F.max("below").alias("own_below"), leaf.alias("leaf"))


def _digests(paths: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the nodes at which conversations end: the digest of their ids in order."""
    ended = paths.where("depth = length").select(*_NODE, "conv").repartition(*_NODE)
    ended = ended.sortWithinPartitions(*_NODE, F.col("conv").asc_nulls_last())

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        node, digest = None, None
        for batch in batches:
            out = {n: [] for n in (*_NODE, "ends_sha256")}
            ids = pc.fill_null(pc.cast(batch.column(3), pa.string()), "").to_pylist()
            keys, start = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)), 0
            while start < len(keys):
                end = start + 1
                while end < len(keys) and keys[end] == keys[start]:
                    end += 1
                if keys[start] != node:
                    if digest:
                        for n, x in zip(out, (*node, digest.hexdigest()), strict=True):
                            out[n].append(x)
                    node, digest = keys[start], hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(",".join(ids[start:end]).encode())
                start = end
            yield out
        if digest:
            yield dict(zip((*_NODE, "ends_sha256"), ([x] for x in (*node, digest.hexdigest())), strict=True))

    return map_batches(ended, digested, "depth long, a long, b long, ends_sha256 string")


def trie_of(turns: DataFrame, convs: DataFrame, block: int = 1024) -> DataFrame:
    """The nodes of the trie of (conv, depth from 1, h1, h2, tokens) turns and (conv) conversations.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    paths = _paths(turns, convs, block)
    owned = materialised(_owned(paths))
    told = paths.join(owned, F.col("conv").eqNullSafe(F.col("owner")), "left")
    next_, own = F.col("depth") + 1, F.col("own_from")
    mine = F.coalesce(F.when(F.col("depth") >= own, F.col("below")).otherwise(F.col("own_below")), F.lit(0))
    nodes = told.groupBy(*_NODE).agg(
        F.min("conv").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.first("pa").alias("pa"),
        F.first("pb").alias("pb"),
        F.count_if((own <= next_) & (next_ <= F.col("length"))).alias("n_children"),
        F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        F.sum(F.col("below") - mine).alias("saved_tokens"),
    )
    nodes = materialised(nodes.join(_digests(paths), list(_NODE), "left"))
    above = nodes.select((F.col("depth") + 1).alias("d"), F.col("a").alias("ka"), F.col("b").alias("kb"), F.col("conv_id").alias("parent_conv_id"))
    shown = nodes.join(above, (F.col("depth") == F.col("d")) & (F.col("pa") == F.col("ka")) & (F.col("pb") == F.col("kb")), "left")
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    return shown.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokens=utf8_bytes, block: int = 1024) -> DataFrame:
    """The nodes of the trie of conversations (see ``trie_of``); ``tokens`` makes a text column a number of tokens."""
    rows = materialised(numbered(turns, conv_col, turn_col, role_col, text_col, tokens))
    return trie_of(rows.withColumn("depth", F.col("pos") + 1), rows.select("conv").distinct(), block)


def branched(rows: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """``numbered`` rows rebuilt to share beginnings, and their conversations.

    The first h turns of conversation c are those of c - c % ``family``; its own follow after its first h. h is the crc32 of
    c's decimal digits modulo ``heads``. The conversation without an id stays as it is.
    """
    sizes = materialised(rows.groupBy("conv").agg(F.count("*").alias("turns")))
    drawn = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads))
    convs = sizes.select("conv", (F.col("conv") - F.col("conv") % family).alias("base"), F.coalesce(drawn, F.lit(0)).alias("h"))
    lent = sizes.select(F.col("conv").alias("lender"), F.col("turns").alias("lent"))
    convs = convs.join(lent, F.col("base") == F.col("lender"), "left")
    convs = materialised(convs.select(F.col("conv").alias("c"), "base", "h", F.least("h", F.coalesce("lent", F.lit(0))).alias("k")))
    rows, columns = materialised(rows), ("h1", "h2", "tokens")
    first = rows.where(F.col("pos") < heads - 1).join(convs, (F.col("conv") == F.col("base")) & (F.col("pos") < F.col("h")))
    rest = rows.join(convs, F.col("conv").eqNullSafe(F.col("c")) & (F.col("pos") >= F.col("h")))
    built = first.select(F.col("c").alias("conv"), (F.col("pos") + 1).alias("depth"), *columns)
    built = built.unionByName(rest.select("conv", (F.col("pos") - F.col("h") + F.col("k") + 1).alias("depth"), *columns))
    return materialised(built), convs.select(F.col("c").alias("conv"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt to share beginnings; a token is a byte of UTF-8."""
    return trie_of(*branched(numbered(table(spark, sf_dir, "conversations"))))


OP12_SQL = r"""
WITH numbered AS MATERIALIZED (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations
), bytes AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS step
), convs AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(4294967295, list_reduce([4294967295] || list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT), lambda s, c: xor(s >> 8, step[(xor(s, c) & 255) + 1]))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations), bytes
), heads AS MATERIALIZED (
  SELECT c.conv_id, n.pos + 1 AS depth, n.role, n.text FROM convs c JOIN numbered n ON n.conv_id = c.base AND n.pos < c.h
), lent AS MATERIALIZED (
  SELECT conv_id, count(*) AS k FROM heads GROUP BY conv_id
), turns AS MATERIALIZED (
  SELECT * FROM heads UNION ALL
  SELECT n.conv_id, n.pos - c.h + coalesce(l.k, 0) + 1, n.role, n.text FROM numbered n JOIN convs c ON c.conv_id = n.conv_id LEFT JOIN lent l ON l.conv_id = n.conv_id WHERE n.pos >= c.h
), paths AS MATERIALIZED (
  SELECT conv_id, depth, strlen(text) AS size, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM turns
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM convs
), lengths AS MATERIALIZED (
  SELECT conv_id, max(depth) AS length FROM paths GROUP BY conv_id
), nodes AS MATERIALIZED (
  SELECT node, depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs FROM paths GROUP BY node, depth
), parents AS MATERIALIZED (
  SELECT n.node, p.node AS parent FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
), kids AS MATERIALIZED (
  SELECT parent AS node, count(*) AS n_children FROM parents GROUP BY parent
), below AS MATERIALIZED (
  SELECT p.node, count(*) FILTER (k.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved_tokens
  FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN kids k ON k.node = n.node GROUP BY p.node
), ended AS MATERIALIZED (
  SELECT p.node, string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) AS ids FROM paths p JOIN lengths l ON l.conv_id = p.conv_id AND l.length = p.depth GROUP BY p.node
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN parents p ON p.node = n.node LEFT JOIN nodes u ON u.node = p.parent LEFT JOIN kids k ON k.node = n.node JOIN below b ON b.node = n.node LEFT JOIN ended e ON e.node = n.node
"""
