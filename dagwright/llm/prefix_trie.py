"""Prefix trie of conversations, built level by level."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

#: Bytes of decimal ids that are put together before a node's digest takes them.
CHUNK = 1 << 20
_NOTHING = hashlib.sha256().hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """``(conv_id, position, role, text)``: turns from 0 on, in the order of turn,
    then role, then text, nulls first; a null role or text is empty.

    Repeated rows are turns of their own. Rows without a conv_id belong to no
    conversation and are left out. The order is made in ranges over all rows, so
    a conversation of any size is spread over tasks; what a conversation has in
    earlier ranges is one number for each range that it goes on in.
    """
    rows = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text")
    order = ["conv_id", "turn", "role", "text"]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = ranges.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at"))
    at = written(at, "turns")
    # Positions: rows before in the same range, and those of earlier ranges.
    parts = at.groupBy("conv_id", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    return at.join(parts, ["conv_id", "range"]).select("conv_id", (F.col("at") - F.col("first") + F.col("earlier")).alias("position"), "role", "text")


def keyed(turns: DataFrame) -> DataFrame:
    """``turns`` with ``key``, 256 bits of role and text, and ``bytes``, the UTF-8
    length of the text, instead of both."""
    rest = [c for c in turns.columns if c not in ("role", "text")]
    whole = F.concat(F.length("role").cast("string"), F.lit("|"), "role", "text")
    return turns.select(*rest, F.unhex(F.sha2(whole.cast("binary"), 256)).alias("key"), F.octet_length("text").cast("long").alias("bytes"))


def shared_prefixes(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt to share beginnings: ``(turns, lengths)``.

    ``turns`` has conv_id (an integer), position and any other columns. With
    h = crc32(decimal conv_id) % ``most``, conversation c becomes the first h
    turns of c - c % ``family`` (fewer if it has fewer, none if there is none)
    and its own turns after its first h. Returned are ``(conv_id, depth, ...)``
    with depth from 1, and ``(conv_id, n_turns)`` of every conversation, those
    that are left without turns included.
    """
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    base = own.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    c = F.col("conv_id")
    ids = own.withColumn("base", c - c % family).withColumn("h", F.crc32(c.cast("string").cast("binary")) % most)
    ids = ids.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0))))
    ids = written(ids.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns")), "lengths")
    rest = [x for x in turns.columns if x not in ("conv_id", "position")]
    first = turns.filter(F.col("position") < most - 1).withColumnRenamed("conv_id", "base")
    borrowed = first.join(ids.filter("taken > 0"), "base").filter("position < h").select("conv_id", (F.col("position") + 1).alias("depth"), *rest)
    kept = turns.join(ids.select("conv_id", "h", "taken"), "conv_id").filter("position >= h")
    kept = kept.select("conv_id", (F.col("taken") + F.col("position") - F.col("h") + 1).alias("depth"), *rest)
    return borrowed.unionByName(kept), ids.select("conv_id", "n_turns")


def _alike() -> Column:
    """Whether all conversations of a group are one, turn by turn."""
    return (F.min("whole") == F.max("whole")) & (F.min("whole2") == F.max("whole2"))


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every distinct beginning of the conversations: ``(nodes, ends)``.

    ``turns`` is ``(conv_id, depth, key, bytes)``, depth from 1 without gaps;
    ``lengths`` is ``(conv_id, n_turns)`` of every conversation. ``nodes`` has
    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_bytes)``: a node is known by its depth and its smallest conversation,
    and its last turn is that conversation's turn of this depth. The root has
    depth 0 and no parent. ``saved_bytes`` adds up (n_convs - 1) * bytes over the
    node's subtree. ``ends`` has ``(conv_id, depth, member)``, the node at which
    each conversation ends; nodes where a single one ends by itself are there too.

    Level by level, the conversations that are still live are grouped by their
    node and their next turn; a group's smallest conversation names the new node.
    Both steps are hash aggregates with partial sums and joins on unique keys, so
    a turn that a third of all conversations share is one row of the groups. A
    group whose conversations are the same to the end, a single one among them,
    leaves the levels: what follows is a chain, read off one of its conversations.
    So there are as many levels as the longest beginning that different
    conversations share, and long conversations alone cost none. Then the levels
    are rolled up from the deepest. An empty table gives empty tables;
    conversations without turns end at the root.
    """
    turns = written(turns.sortWithinPartitions("depth"), "trie")
    # 128 bits of a whole conversation, whatever its length: turns and their places.
    whole = turns.groupBy("conv_id").agg(F.bit_xor(F.xxhash64("depth", "key")).alias("whole"), F.bit_xor(F.xxhash64("key", "depth", F.lit(1))).alias("whole2"))
    start = lengths.join(whole, "conv_id", "left").select("conv_id", "n_turns", F.coalesce("whole", F.lit(0)).alias("whole"), F.coalesce("whole2", F.lit(0)).alias("whole2"))
    start = written(start, "live")
    group = [F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.max("n_turns").alias("n_turns"), _alike().alias("alike"), F.max("bytes").alias("bytes")]
    root = start.withColumn("bytes", F.lit(0).cast("long")).agg(*group).filter("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), *[c for c in root.columns])
    levels, ends = [written(root, "level")], []
    top = F.broadcast(levels[0].select("node", "alike"))
    assigned = start.join(top, F.lit(True))
    while True:
        depth = len(levels) - 1
        ending = F.col("alike") | (F.col("n_turns") == depth)
        ends.append(written(assigned.filter(ending).select(F.col("node").alias("conv_id"), F.when(F.col("alike"), F.col("n_turns")).otherwise(F.lit(depth)).cast("long").alias("depth"), F.col("conv_id").alias("member")), "ends"))
        live = written(assigned.filter(~ending).select("conv_id", "node", "n_turns", "whole", "whole2"), "live")
        if depth == 0:
            dropped(start)
        else:
            dropped(now)
        if live.isEmpty():
            dropped(live)
            break
        now = live.withColumnRenamed("node", "parent").join(turns.filter(F.col("depth") == depth + 1).drop("depth"), "conv_id")
        now = written(now, "next")
        dropped(live)
        groups = now.groupBy("parent", "key").agg(*group).withColumn("depth", F.lit(depth + 1).cast("long"))
        groups = written(groups, "level")
        levels.append(groups)
        shared = groups.filter("n_convs > 1").select("parent", "key", "node", "alike")
        assigned = now.join(shared, ["parent", "key"]).select("conv_id", "node", "alike", "n_turns", "whole", "whole2")
    columns = ["depth", "parent", "node", "n_convs", "n_turns", "alike", "bytes"]
    every = levels[0].select(*columns)
    for x in levels[1:]:
        every = every.unionByName(x.select(*columns))
    chains = _chains(turns, every.filter("alike"))
    # From the deepest level up: what the children of an open node have.
    out, kids = chains, None
    heads = chains.filter("head")
    for depth in range(len(levels) - 1, -1, -1):
        open_ = levels[depth].filter("NOT alike")
        if kids is not None:
            at = kids.groupBy(F.col("parent_conv_id").alias("node")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_bytes").alias("saved_bytes"))
            inner = open_.join(at, "node").select(
                F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                (F.col("saved_bytes") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_bytes"),
            )
            inner = written(inner, "inner")
            out = out.unionByName(inner, allowMissingColumns=True)
            kids = inner.unionByName(heads.filter(F.col("depth") == depth).select(inner.columns))
        else:
            # At the deepest level every group is a chain's head.
            kids = heads.filter(F.col("depth") == depth).drop("head")
    found = ends[0]
    for x in ends[1:]:
        found = found.unionByName(x)
    singles = chains.filter("n_convs = 1 AND n_children = 0 AND depth > 0").select("conv_id", "depth", F.col("conv_id").alias("member"))
    return out.drop("head"), found.unionByName(singles)


def _chains(turns: DataFrame, heads: DataFrame) -> DataFrame:
    """Nodes from each head on, along its conversation; ``head`` marks the first."""
    heads = heads.select(F.col("node").alias("conv_id"), F.col("depth").alias("top"), "parent", "n_convs", "n_turns")
    # The root is no turn: a table of copies of one conversation is a chain from depth 0.
    roots = heads.filter("top = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"))
    rows = turns.select("conv_id", "depth", "bytes").unionByName(roots).join(heads, "conv_id").filter("depth >= top")
    # What copies save is summed over the turns from here on; single conversations save nothing.
    after = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    columns = ["conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
               (F.col("depth") < F.col("n_turns")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves")]
    head = (F.col("depth") == F.col("top")).alias("head")
    alone = rows.filter("n_convs = 1").select(*columns, F.lit(0).cast("long").alias("saved_bytes"), head)
    copies = rows.filter("n_convs > 1").withColumn("below", F.sum("bytes").over(after))
    copies = copies.select(*columns, ((F.col("n_convs") - 1) * F.col("below")).alias("saved_bytes"), head)
    return written(alone.unionByName(copies), "chains")


def end_digests(ends: DataFrame) -> DataFrame:
    """``(conv_id, depth, ends_sha256)``: SHA-256 of the decimal ids that end at
    each node, ascending, with commas.

    Ids are sorted in ranges and put into chunks of text in parallel; a node's
    chunks then run through its digest as a stream, which is sequential by
    nature: however many copies end at a node, its task holds one chunk.
    """
    order = ["conv_id", "depth", "member"]

    def chunks(batches):
        node, first, text, size = None, None, [], 0
        for b in batches:
            out = []
            for c, d, m in zip(*(b.column(k).to_pylist() for k in order), strict=True):
                if (c, d) != node or size >= CHUNK:
                    if text:
                        out.append((*node, first, ",".join(text)))
                    node, first, text, size = (c, d), m, [], 0
                text.append(str(m))
                size += len(text[-1]) + 1
            if out:
                yield _batch(out)
        if text:
            yield _batch([(*node, first, ",".join(text))])

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)], names=["conv_id", "depth", "first", "chunk"])

    def digest(batches):
        node = sha = None
        names = ["conv_id", "depth", "ends_sha256"]
        row = lambda: (*node, sha.hexdigest())
        for b in batches:
            out = []
            for c, d, t in zip(b.column("conv_id").to_pylist(), b.column("depth").to_pylist(), b.column("chunk"), strict=True):
                if (c, d) != node:
                    if node:
                        out.append(row())
                    node, sha = (c, d), hashlib.sha256(t.as_py().encode())
                else:
                    sha.update(b"," + t.as_py().encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out])
        if node:
            yield pa.RecordBatch.from_pylist([dict(zip(names, row(), strict=True))])

    parts = ends.select(*[F.col(c).cast("long") for c in order]).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = parts.mapInArrow(chunks, "conv_id long, depth long, first long, chunk string")
    return parts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    first = written(keyed(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))), "keyed")
    nodes, ends = prefix_trie(*shared_prefixes(first))
    nodes = nodes.join(end_digests(ends), ["conv_id", "depth"], "left").withColumnRenamed("saved_bytes", "saved_tokens")
    return nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOTHING)))


OP12_SQL = r"""
WITH RECURSIVE crc(n, c) AS (
  SELECT n, n FROM range(256) t(n)
), crc_table AS (
  SELECT n, list_reduce(list_prepend(n, range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END) AS v FROM crc
), crc_list AS (
  SELECT list(v ORDER BY n) AS t FROM crc_table
), numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, count(*) AS own FROM numbered GROUP BY conv_id
), hashed AS (
  SELECT o.conv_id, o.own, o.conv_id - o.conv_id % 5 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(o.conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(o.conv_id AS VARCHAR), i, 1)) AS BIGINT))),
             lambda v, b: xor(v // 256, t[xor(v % 256, b) + 1])), 4294967295) % 9 AS h
  FROM own o, crc_list
), ids AS (
  SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.own, 0)) AS taken, least(c.h, coalesce(b.own, 0)) + greatest(c.own - c.h, 0) AS n_turns
  FROM hashed c LEFT JOIN own b ON b.conv_id = c.base
), turns AS (
  SELECT i.conv_id, n.pos + 1 AS depth, n.role, n.text FROM ids i JOIN numbered n ON n.conv_id = i.base AND n.pos < i.h
  UNION ALL
  SELECT i.conv_id, i.taken + n.pos - i.h + 1, n.role, n.text FROM ids i JOIN numbered n ON n.conv_id = i.conv_id AND n.pos >= i.h
), prefixes AS (
  SELECT conv_id, depth, strlen(text) AS bytes,
         sha256(string_agg(md5(length(role) || '|' || role || text), '' ) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS prefix
  FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids
), members AS (
  SELECT p.*, i.n_turns, min(p.conv_id) OVER (PARTITION BY p.depth, p.prefix) AS node FROM prefixes p JOIN ids i USING (conv_id)
), nodes AS (
  SELECT node, depth, count(*) AS n_convs, max(bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n_turns = depth), '')) AS ends_sha256
  FROM members GROUP BY node, depth
), linked AS (
  SELECT n.*, m.node AS parent FROM nodes n LEFT JOIN members m ON m.conv_id = n.node AND m.depth = n.depth - 1
), children AS (
  SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL
), own_values AS (
  SELECT l.*, coalesce(c.n_children, 0) AS n_children FROM linked l LEFT JOIN children c USING (node, depth)
), below AS (
  SELECT m.node, m.depth, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.bytes) AS saved
  FROM own_values v JOIN members m ON m.conv_id = v.node AND m.depth <= v.depth GROUP BY m.node, m.depth
)
SELECT v.node AS conv_id, CAST(v.depth AS BIGINT) AS depth, v.parent AS parent_conv_id, v.n_convs, v.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM own_values v JOIN below b USING (node, depth)
"""
