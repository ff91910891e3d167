"""Op 11: the prefix trie of conversations.

A turn becomes the SHA-256 of its role and text; a prefix the SHA-256 of the prefix before it and its last turn's digest, chained along
each conversation, so equal sequences have equal digests and texts never move. Every prefix is exploded to a row, and a group
of rows alike in (depth, digest) is a node. Sums over subtrees come by sending every node to all its ancestors: a node counts
for its smallest member, whose own prefixes are those ancestors. The nodes of one smallest member lie one below the other down to
its end, so they are summed from the end upwards first, and a prefix carries the sum of what lies below it: a conversation of n turns
sends n rows, not n * n / 2.

A node in which a third of all conversations meet (a common first turn, a conversation copied many times, the root) is only ever summed
in parts before it moves, or stands on the side of a join that Spark can split. Lists of members that end in a node are ranged by
(node, conv_id) into pieces and hashed piece after piece. One conversation is walked in order, with one turn in memory.

`rebuild` replaces a conversation's first turns as the registered query wants; without it conversations are taken as they are.

Edge cases: rows without a conv_id belong to no conversation and are left out; a null role or text counts as empty; a null turn comes first; turns
alike in number are ordered by role, then text, so repeated rows are turns of their own; a conversation that is left without
turns is a member of the root alone, and ends there; an empty table gives no node; texts of any length are read whole; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise

#: The query's rule: of conversation c, the first crc32(c) % CUT turns come from conversation c - c % BLOCK.
BLOCK, CUT = 5, 9
#: Members' ids are joined into pieces of at most about so many characters before they are hashed.
PIECE = 1 << 20
_PREFIX = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("parent", pa.binary()), ("n_bytes", pa.int64()), ("ends", pa.bool_())])
_PIECES = pa.schema([("depth", pa.int64()), ("digest", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
_HASHES = pa.schema([("depth", pa.int64()), ("digest", pa.binary()), ("ends_sha256", pa.string())])
_EMPTY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (the turn's place, from 0), turn_sha (of role and text), n_bytes of the text. A text moves only where a turn's number repeats."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    tied = materialise(rows.groupBy("conv_id", "turn").count().filter("count > 1").select(F.col("conv_id").alias("t_conv"), F.col("turn").alias("t_turn")), "tied-turns")
    rows = rows.join(tied, (F.col("conv_id") == F.col("t_conv")) & F.col("turn").eqNullSafe(F.col("t_turn")), "left")
    said = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.select("conv_id", "turn", "role", F.when(F.col("t_conv").isNotNull(), F.col("text")).alias("tie"), said.alias("turn_sha"), F.octet_length("text").cast("long").alias("n_bytes"))
    rows = rows.withColumn("block", F.col("conv_id") - F.pmod("conv_id", F.lit(BLOCK))).repartition("block")
    order = Window.partitionBy("block", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "tie")
    return rows.select("block", "conv_id", (F.row_number().over(order) - 1).cast("long").alias("at"), "turn_sha", "n_bytes")


def borrowed(conv_id: Column) -> Column:
    """How many first turns a conversation takes from its block's first one."""
    return F.crc32(conv_id.cast("string").cast("binary")) % CUT


def _parts(rows: DataFrame, rebuild: bool) -> DataFrame:
    """Rows of every conversation in its order: conv_id, part, at, turn_sha, n_bytes. Part 0: of the conversation itself but cut, 1: borrowed, 2: its own."""
    if not rebuild:
        return rows.withColumn("part", F.lit(2)).sortWithinPartitions("conv_id", "part", "at")
    own = F.when((F.col("conv_id") == F.col("block")) | (F.col("at") >= borrowed(F.col("conv_id"))), 2).otherwise(0)
    others = F.when((F.col("conv_id") == F.col("block")) & (F.col("at") < CUT - 1), F.sequence(F.lit(1), F.lit(BLOCK - 1))).otherwise(F.array().cast("array<int>"))
    # The turns of a block are together already; a row goes to itself and, borrowed, to the block's other conversations.
    targets = F.concat(F.array(F.struct(F.col("conv_id").alias("conv_id"), own.alias("part"))), F.transform(others, lambda i: F.struct((F.col("conv_id") + i).alias("conv_id"), F.lit(1).alias("part"))))
    sent = rows.select("at", "turn_sha", "n_bytes", F.explode(targets).alias("to")).select("to.*", "at", "turn_sha", "n_bytes")
    sent = sent.filter(((F.col("part") == 1) & (F.col("at") < borrowed(F.col("conv_id")))) | (F.col("part") == 2) | ((F.col("part") == 0) & (F.col("at") == 0)))
    return sent.sortWithinPartitions("conv_id", "part", "at")


def _chain(batches):
    """Prefixes of the conversations that have a row of their own, the empty prefix included."""
    out, now, there, depth, digest, held = [], None, False, 0, b"", None
    for batch in batches:
        for conv, part, sha, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "turn_sha", "n_bytes")), strict=True):
            if conv != now:
                if held:
                    out.append((*held, True))
                now, there, depth, digest = conv, part != 1, 0, b""  # borrowed turns alone make no conversation
                held = (conv, 0, b"", None, 0) if there else None
            if part and there:
                out.append((*held, False))
                depth, before = depth + 1, digest
                digest = hashlib.sha256(before + sha).digest()
                held = (conv, depth, digest, before, n)
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PREFIX.types, strict=True)], schema=_PREFIX)
            out = []
    if held:
        out.append((*held, True))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PREFIX.types, strict=True)], schema=_PREFIX)


def prefixes(conversations: DataFrame, rebuild: bool = False) -> DataFrame:
    """Every prefix of every conversation: conv_id, depth, digest, parent (the digest before), n_bytes of its last text, ends."""
    return _parts(turns(conversations), rebuild).mapInArrow(_chain, "conv_id long, depth long, digest binary, parent binary, n_bytes long, ends boolean")


def _pieces(batches):
    """Join the ids of a node, which come in order, to pieces."""
    node, first, ids, size, out = None, 0, [], 0, []
    for batch in batches:
        for d, h, c in zip(*(batch.column(x).to_pylist() for x in ("depth", "digest", "conv_id")), strict=True):
            if (d, h) != node or size > PIECE:
                if ids:
                    out.append((*node, first, ",".join(ids)))
                node, first, ids, size = (d, h), c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PIECES.types, strict=True)], schema=_PIECES)
            out = []
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*node, first, ",".join(ids)), _PIECES.types, strict=True)], schema=_PIECES)


def _hashes(batches):
    """SHA-256 over the pieces of a node, which come in order."""
    node, state, out = None, None, []
    for batch in batches:
        for d, h, ids in zip(*(batch.column(x).to_pylist() for x in ("depth", "digest", "ids")), strict=True):
            if (d, h) != node:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (d, h), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _HASHES.types, strict=True)], schema=_HASHES)
            out = []
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*node, state.hexdigest()), _HASHES.types, strict=True)], schema=_HASHES)


def ends(rows: DataFrame) -> DataFrame:
    """depth, digest, ends_sha256 of every node in which conversations end."""
    ranged = rows.filter("ends").select("depth", "digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "depth", "conv_id")
    pieces = ranged.mapInArrow(_pieces, "depth long, digest binary, first long, ids string")
    return pieces.repartition("digest").sortWithinPartitions("digest", "depth", "first").mapInArrow(_hashes, "depth long, digest binary, ends_sha256 string")


def trie(conversations: DataFrame, rebuild: bool = False) -> DataFrame:
    """One row a node: depth, digest, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = materialise(prefixes(conversations, rebuild), "prefixes")
    node = ["depth", "digest"]
    nodes = materialise(rows.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("n_bytes").alias("n_bytes")), "nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    # A smallest member's nodes lie one below the other: sums of each and those below it.
    upwards = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("own_leaves", F.sum((F.col("n_children") == 0).cast("long")).over(upwards)).withColumn("own_saved", F.sum((F.col("n_convs") - 1) * F.col("n_bytes")).over(upwards))
    counted = materialise(counted, "counted-nodes")
    tops = counted.groupBy("conv_id").agg(F.min(F.struct("depth", "own_leaves", "own_saved")).alias("top")).filter("top.depth > 0").select("conv_id", F.col("top.depth").alias("top"), F.col("top.own_leaves").alias("leaves"), F.col("top.own_saved").alias("saved"))
    above = rows.select("conv_id", *node).join(tops, "conv_id").filter(F.col("depth") < F.col("top"))
    below = above.groupBy(*node).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    # A node's parent has the same smallest member, but for the topmost; a topmost node of depth 1 hangs at the root.
    root = nodes.filter("depth = 0").select(F.col("conv_id").alias("root_conv"))
    parents = nodes.filter("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv"))
    topmost = counted.select("conv_id", *node, "parent").join(tops.select("conv_id", F.col("top").alias("depth")), ["conv_id", "depth"], "left_semi").filter("depth > 1")
    hung = topmost.join(parents, ["depth", "parent"]).select(*node, "parent_conv")
    out = counted.join(below, node, "left").join(hung, node, "left").join(ends(rows), node, "left").join(F.broadcast(root.limit(1)))  # one row
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("parent_conv").isNotNull(), F.col("parent_conv")).when(F.col("depth") == 1, F.col("root_conv")).otherwise(F.col("conv_id"))
    plus = lambda own, more: F.col(own) + F.coalesce(more, F.lit(0).cast("long"))
    return out.select("conv_id", "depth", "digest", parent.cast("long").alias("parent_conv_id"), "n_convs", "n_children", plus("own_leaves", "leaves").alias("n_leaves"), plus("own_saved", "saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), rebuild=True).drop("digest")


#: crc32 is taken bit by bit: DuckDB has no such function.
ORACLE = """
WITH c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - ((conv_id % 5) + 5) % 5 AS block, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
    lambda crc, d: list_reduce(list_prepend(xor(crc, d), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, z: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM c)),
r AS (
  SELECT i.conv_id, 1 AS part, c.pos, c.role, c.text FROM ids i JOIN c ON c.conv_id = i.block AND c.pos < i.h WHERE i.conv_id <> i.block
  UNION ALL SELECT i.conv_id, 2, c.pos, c.role, c.text FROM ids i JOIN c USING (conv_id) WHERE c.pos >= i.h OR i.conv_id = i.block),
p AS (SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS n_bytes, list(struct_pack(role, text)) OVER w AS path,
    count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
m AS (SELECT conv_id, depth, n_bytes, md5(path::VARCHAR) || sha256(path::VARCHAR) AS k, depth = n_turns AS ends FROM p
  UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM p) FROM ids),
w AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM m),
n AS (SELECT depth, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM w GROUP BY depth, k),
f AS (SELECT n.*, (SELECT count(*) FROM n ch WHERE ch.depth = n.depth + 1 AND ch.up = n.k) AS n_children FROM n),
s AS (SELECT a.depth, a.k, sum((f.n_children = 0)::BIGINT) AS n_leaves, sum((f.n_convs - 1) * f.n_bytes) AS saved_tokens
  FROM f JOIN m x ON x.conv_id = f.conv_id AND x.depth <= f.depth JOIN n a ON a.depth = x.depth AND a.k = x.k
    AND f.k = (SELECT y.k FROM m y WHERE y.conv_id = f.conv_id AND y.depth = f.depth)
  GROUP BY a.depth, a.k)
SELECT f.conv_id, f.depth, pa.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (depth, k) LEFT JOIN n pa ON pa.depth = f.depth - 1 AND pa.k = f.up
"""
