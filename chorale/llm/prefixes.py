"""Conversation prefix trie: every distinct sequence of first turns is a node, with its members, children, leaves and saved tokens.

A turn becomes 16 bytes, the MD5 of role and text, and a number of code points, before anything is shuffled. Conversations are rebuilt
(see `rebuild`) and dealt by ranges of (turn sequence, conv_id), so the members of a node are neighbours. A sorted range is read in
shards of bounded size. In a shard the turns are numbered in order and laid out as a padded matrix; `np.lexsort` orders it, column
changes accumulated by OR along a row mark where nodes start, and `reduceat` sums every depth. A node that crosses a shard's edge
leaves as a partial result under the hash of its turns and is put together afterwards: sums, least member, and the lists of ends in order.
What a shard needs of its neighbours is how many turns its first and last row share with them.

Null conv_id: the row takes no part. Null role or text: empty. Turns are ordered by turn, null first, then by the MD5 of role and text;
repeated rows are repeated turns. An empty table has no conversation and no node. A conversation is one row of the matrix: its turns'
hashes (20 bytes a turn, not the texts) are held in one task. Other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale.llm.common import cut_lineage

#: Conversations that share a base, and the turns that may be taken from it: fewer than HEADS.
FAMILY, HEADS = 100, 6
#: Rows meant for one range; matrix cells and rows held at once.
RANGE_ROWS, CELLS, ROWS = 40_000, 1 << 20, 20_000
NONE = hashlib.sha256(b"").hexdigest()
CLOSED, LEFT, RIGHT = 0, 1, 2
SHARD = "shard bigint, side int, depth bigint, node binary, parent_side int, parent_node binary, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, ends binary"


def turn_hash() -> Column:
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def head_size(conv: Column) -> Column:
    """Turns that a conversation takes from its base."""
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int")


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: (turn, hash, chars) in order."""
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), turn_hash().alias("hash"), F.length(F.coalesce("text", F.lit(""))).alias("chars")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuild(conversations: DataFrame) -> DataFrame:
    """conv_id, ids, chars: the first h turns of conversation c - c % 100, then the own turns after the first h; h = crc32(c) % 6."""
    own = sequences(conversations)
    heads = sequences(conversations.where(F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h, none = head_size(F.col("conv_id")), F.array().cast("array<struct<turn:bigint,hash:binary,chars:int>>")
    met = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "base", "left")
    tail = F.when(F.size("turns") > h, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(1)))).otherwise(none)
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), tail)
    return met.select("conv_id", turns.alias("t")).select("conv_id", F.col("t.hash").alias("ids"), F.col("t.chars").alias("chars"))


def shared(a: Column, b: Column) -> Column:
    """Turns that two sequences have in common at their start."""
    n = F.least(F.size(a), F.size(b))
    return F.coalesce(F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y), F.lit(False)).cast("int"), F.lit(0)), n


def edges(ranged: DataFrame) -> dict[int, tuple[int, int]]:
    """For every range that has rows: turns shared with the row before it and the row after it, -1 where there is none. One pair a range."""
    row = F.struct("ids", "conv_id")
    ends = ranged.groupBy("range").agg(F.min(row)["ids"].alias("first"), F.max(row)["ids"].alias("last"))
    order = Window.partitionBy(F.lit(0)).orderBy("range")  # two rows a range
    met = ends.select("range", "first", F.lag("last").over(order).alias("before"))
    at, n = shared(F.col("first"), F.col("before"))
    lead = met.select("range", F.when(F.col("before").isNull(), -1).when(at > 0, at - 1).otherwise(n).alias("lead")).orderBy("range").collect()
    leads = [r["lead"] for r in lead]
    return {r["range"]: (r["lead"], after) for r, after in zip(lead, [*leads[1:], -1], strict=False)}


def node_name(ids: np.ndarray, depth: int) -> bytes:
    return hashlib.blake2b(depth.to_bytes(8, "little") + ids[:depth].tobytes(), digest_size=16).digest()


def nodes_of(shard: int, convs: np.ndarray, ids: np.ndarray, chars: np.ndarray, sizes: np.ndarray, before: int, after: int) -> pa.RecordBatch:
    """The nodes of a shard's rows, complete or partial. `before`, `after`: turns shared with the neighbouring rows, -1 for none."""
    n, width = len(convs), int(sizes.max(initial=1))
    _, number = np.unique(ids, return_inverse=True)
    held = np.arange(width) < sizes[:, None]
    matrix, length = np.full((n, width), -1, np.int64), np.zeros((n, width), np.int64)
    matrix[held], length[held] = number, chars
    order = np.lexsort((convs, *matrix.T[::-1]))
    offset = (np.cumsum(sizes) - sizes)[order]  # of each row's first turn in `ids`
    matrix, length, sizes, convs, held = matrix[order], length[order], sizes[order], convs[order], held[order]

    change = np.ones((n, width), bool)
    change[1:] = np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1)
    new = change & held  # the row is the first of its node, in the whole table
    if before > 0:
        new[0, :before] = False
    common = np.append(np.minimum((~change[1:]).sum(axis=1), np.minimum(sizes[:-1], sizes[1:])), after)
    leaf = (common < sizes).astype(np.int64)  # the next row neither repeats nor continues the sequence
    saved = np.cumsum(np.where(new, 0, length)[:, ::-1], axis=1)[:, ::-1]  # a node's own row counts its text once less

    columns: dict[str, list] = {name.split()[0]: [] for name in SHARD.split(", ")}
    group = np.zeros(n, np.int64)  # of the level above
    above = (np.zeros(1, np.int64), np.array([convs.min()]), np.zeros(1, np.int64))
    for depth in range(width + 1):
        rows = np.flatnonzero(sizes >= depth)
        starts = np.flatnonzero(change[rows, depth - 1]) if depth else np.zeros(1, np.int64)
        if not len(rows):
            break
        low = np.minimum.reduceat(convs[rows], starts)
        count = np.diff(np.append(starts, len(rows)))
        children = np.add.reduceat(new[rows, depth].astype(np.int64), starts) if depth < width else np.zeros(len(starts), np.int64)
        leaves = np.add.reduceat(leaf[rows], starts)
        tokens = np.add.reduceat(saved[rows, depth - 1] if depth else saved[:, 0], starts)
        head, tail = rows[starts], rows[np.append(starts[1:], len(rows)) - 1]
        side = np.zeros(len(starts), np.int64)
        side[(tail == n - 1) & (after >= depth)] = RIGHT
        side[(head == 0) & (before >= depth)] = LEFT
        mine = np.repeat(np.arange(len(starts)), count)
        over = group[head]  # the node above
        name, parent_name = [None] * len(starts), [None] * len(starts)
        for i in np.flatnonzero(side).tolist():
            turns = ids[offset[head[i]] : offset[head[i]] + depth]
            name[i], parent_name[i] = node_name(turns, depth), node_name(turns, depth - 1) if depth else None
        stop = np.flatnonzero(sizes[rows] == depth)
        ends: dict[int, bytes] = {}
        if len(stop):
            cuts = np.flatnonzero(np.diff(mine[stop], prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(stop)], strict=True):
                ends[int(mine[stop[a]])] = b",".join(map(b"%d".__mod__, convs[rows[stop[a:b]]].tolist()))
        made = {
            "shard": [shard] * len(starts), "side": side.tolist(), "depth": [depth] * len(starts), "node": name, "parent_node": parent_name,
            "parent_side": above[2][over].tolist(), "conv_id": low.tolist(), "parent_conv_id": above[1][over].tolist() if depth else [None], "n_convs": count.tolist(),
            "n_children": children.tolist(), "n_leaves": leaves.tolist(), "saved_tokens": tokens.tolist(),
            "ends_sha256": [hashlib.sha256(ends[i]).hexdigest() if i in ends and not s else None for i, s in enumerate(side.tolist())], "ends": [ends.get(i) if s else None for i, s in enumerate(side.tolist())],
        }
        for key, values in made.items():
            columns[key] += values
        group = np.zeros(n, np.int64)
        group[rows] = mine
        above = (starts, low, side)
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(columns[f.split()[0]], kinds[f.split()[1]]) for f in SHARD.split(", ")], names=[f.split()[0] for f in SHARD.split(", ")])


def shards(ranged: DataFrame, neighbours: dict[int, tuple[int, int]]) -> DataFrame:
    """Nodes and partial nodes of every shard."""
    known = ranged.sparkSession.sparkContext.broadcast(neighbours)  # two numbers a range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        widest, shard, before, part = 0, 0, -1, None

        def flush(after: int) -> pa.RecordBatch:
            convs, rows, chars = zip(*held, strict=True)
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            ids = np.array([x for r in rows for x in r], "S16")
            return nodes_of((part << 32) + shard, np.array(convs, np.int64), ids, np.array([c for r in chars for c in r], np.int64), sizes, before, after)

        for batch in batches:
            for own, conv, ids, chars in zip(*(batch.column(c).to_pylist() for c in ("range", "conv_id", "ids", "chars")), strict=True):
                if part is None:
                    part, before = own, known.value[own][0]
                if held and ((len(held) + 1) * max(widest, len(ids)) > CELLS or len(held) >= ROWS):
                    common = next((k for k, (a, b) in enumerate(zip(held[-1][1], ids, strict=False)) if a != b), min(len(held[-1][1]), len(ids)))
                    yield flush(common)
                    held, widest, shard, before = [], 0, shard + 1, common
                held.append((conv, ids, chars))
                widest = max(widest, len(ids))
        if held:
            yield flush(known.value[part][1])

    return ranged.mapInArrow(run, SHARD)


def joined_ends(open_nodes: DataFrame) -> DataFrame:
    """node, ends_sha256 of the nodes whose ends lie in several shards: the pieces are hashed one after the other as they arrive."""
    pieces = open_nodes.where("ends is not null").select("node", "shard", "ends")
    parts = max(1, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            for node, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if node != name:
                    if name is not None:
                        yield one(name, state)
                    name, state = node, hashlib.sha256(ends)
                else:
                    state.update(b"," + ends)
        if name is not None:
            yield one(name, state)

    def one(name: bytes, state) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    return pieces.repartition(parts, F.xxhash64("node")).sortWithinPartitions("node", "shard").mapInArrow(run, "node binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row for every node."""
    rows = cut_lineage(rebuild(conversations))
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS + 1)
    dealt = rows.repartitionByRange(ranges, "ids", "conv_id").sortWithinPartitions("ids", "conv_id").select(F.spark_partition_id().cast("long").alias("range"), "*")
    ranged = cut_lineage(dealt)  # the ranges stay as they are, also for a task that runs again
    found = cut_lineage(shards(ranged, edges(ranged)))

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    partial = found.where(F.col("side") != CLOSED)
    whole = partial.groupBy("node").agg(F.min("depth").alias("depth"), F.min("parent_node").alias("parent_node"), F.min("conv_id").alias("conv_id"), *sums)
    least = whole.select("node", F.col("conv_id").alias("least"))
    # a closed node below an open one asks for it by shard and side, so no key has more rows than a shard
    above = partial.select("shard", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), "node").join(least, "node").drop("node")
    closed = found.where(F.col("side") == CLOSED).join(above, ["shard", "parent_side", "depth"], "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = closed.withColumn("parent_conv_id", F.coalesce("least", "parent_conv_id")).select(*columns)
    outer = whole.join(least.select(F.col("node").alias("parent_node"), F.col("least").alias("parent_conv_id")), "parent_node", "left").join(joined_ends(partial), "node", "left").select(*columns)
    return inner.union(outer).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE)))
