"""The trie of conversations by common first turns, with sums over subtrees by heavy-path decomposition.

Turns are numbered and prefixes get keys in range partitions sorted by conversation, whose parts are put together afterwards,
so a conversation of any length is spread over tasks. A prefix's key is the 128-bit exclusive or of the hashes of (place,
role, text) of its turns. Nodes are the distinct prefixes, and from then on a node is (smallest member, depth).

The heavy child of a node is the one with most members, so a way from the root has at most log2(conversations) light edges.
Path heads are found by pointer jumping; a path's own sum moves up the tree of paths, one light edge a round; then each node
adds up what lies behind it on its path array, in blocks of PART nodes and over the blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import forget, give_back, small_batches, staged
from .words import NOT_SPACE, Words, mix, pieces

U = np.uint64
#: Nodes of a path that are added up in one group.
PART = 1024
#: Bytes of joined ids that travel as one row.
LIST = 1 << 20


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64), pa.int64())


class _Stretch:
    """Consecutive rows of one conversation over the batches of a partition."""

    def __init__(self) -> None:
        self.last, self.seq, self.sums = None, 0, [U(0), U(0)]

    def starts(self, conv: np.ndarray) -> np.ndarray:
        new = np.append(conv[0] != self.last if self.last is not None else True, conv[1:] != conv[:-1])
        self.last = conv[-1]
        return new

    def numbered(self, new: np.ndarray) -> np.ndarray:
        """Numbers from 1 inside each stretch"""
        at = np.arange(len(new))
        first = np.maximum.accumulate(np.where(new, at, -1))
        out = np.where(first < 0, at + 1 + self.seq, at - first + 1)
        self.seq = int(out[-1])
        return out

    def accumulated(self, new: np.ndarray, value: np.ndarray, lane: int) -> np.ndarray:
        """Running exclusive or inside each stretch"""
        run = np.bitwise_xor.accumulate(value)
        at = np.flatnonzero(new)
        before = np.append(U(0), run)[at]
        out = run ^ np.concatenate([np.full(at[0] if len(at) else len(run), self.sums[lane]), np.repeat(before, np.diff(np.append(at, len(run))))])
        self.sums[lane] = out[-1]
        return out


def _carried(rows: DataFrame, columns: list[str], how) -> DataFrame:
    """rows (conv_id, part, ...) with what earlier parts of the same conversation come to, under before_<column>. Only the
    first and last conversation of a part have others, so this is a row for each part at most, and is broadcast."""
    sums = rows.groupBy("conv_id", "part").agg(*[how(c).alias(c) for c in columns])
    several = sums.groupBy("conv_id").agg(F.count("*").alias("parts")).where("parts > 1").select("conv_id")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    running = F.sum if how is F.max else F.bit_xor
    carry = sums.join(several, "conv_id", "left_semi").select("conv_id", "part", *[F.coalesce(running(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in columns])
    return rows.join(F.broadcast(carry), ["conv_id", "part"], "left")


def numbered(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, e1, e2, n_words): turns of each conversation from 1, by turn (null first), then role and text; a hash of
    role and text in two longs, and the text's words. Null roles and texts are empty; rows without a conversation go."""
    small_batches(conversations.sparkSession)
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = conversations.select(F.col(f"`{id_col}`").cast("bigint").alias("conv_id"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).where("conv_id is not null")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, part = _Stretch(), TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            seq = stretch.numbered(stretch.starts(conv))
            digest = []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                role = role.encode()
                digest.append(xxhash.xxh3_128_digest(len(role).to_bytes(8, "little") + role + text.encode()))
            e = np.frombuffer(b"".join(digest), "<u8").reshape(-1, 2)
            words = np.concatenate([Words(data, offsets, NOT_SPACE).counts() for _, _, data, offsets in pieces(batch.column(3))])
            yield pa.RecordBatch.from_arrays([pa.array(conv), pa.array(np.full(len(conv), part), pa.int64()), pa.array(seq, pa.int64()), _long(e[:, 0].copy()), _long(e[:, 1].copy()), pa.array(words, pa.int64())], names=["conv_id", "part", "seq", "e1", "e2", "n_words"])
            give_back()

    order = [F.col("conv_id"), F.col("turn").asc_nulls_first()]
    found = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text").mapInArrow(number, "conv_id bigint, part bigint, seq bigint, e1 bigint, e2 bigint, n_words bigint"), "turns")
    whole = _carried(found, ["seq"], F.max)
    return whole.select("conv_id", (F.col("seq") + F.coalesce("before_seq", F.lit(0))).alias("pos"), "e1", "e2", "n_words")


def rebuilt(turns: DataFrame, family: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, e1, e2, n_words), (conv_id)): each conversation c with its first h turns replaced by those of
    conversation c - c % family, h = crc32(c) % (most + 1); and all conversations, as some end up without turns."""
    c = F.col("conv_id")
    h = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(most + 1))
    convs = staged(turns.groupBy("conv_id").agg(F.max("pos").alias("len")).select("conv_id", "len", h.alias("h"), (c - c % family).alias("host")), "conversations")
    hosts = convs.select(F.col("conv_id").alias("host"), F.col("len").alias("host_len"))
    sized = staged(convs.join(hosts, "host", "left").select("conv_id", "h", "host", F.least("h", F.coalesce("host_len", F.lit(0))).alias("taken")), "sized")
    heads = turns.where(F.col("pos") <= most).withColumnRenamed("conv_id", "host")
    first = sized.where("taken > 0").join(heads, "host").where("pos <= h").select("conv_id", "pos", "e1", "e2", "n_words")
    own = turns.join(sized.select("conv_id", "h", "taken"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "e1", "e2", "n_words")
    return first.unionByName(own), convs.select("conv_id")


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, q1, q2, n_words): the key p of each prefix and q of the one before."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, part = _Stretch(), TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, pos = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = stretch.starts(conv)
            own = [mix(batch.column(2 + i).to_numpy().view(np.uint64) ^ mix(pos.astype(np.uint64) * U(2) + U(i + 1))) for i in (0, 1)]
            run = [stretch.accumulated(new, own[i], i) for i in (0, 1)]
            cols = [pa.array(conv), pa.array(np.full(len(conv), part), pa.int64()), pa.array(pos), *map(_long, run), *map(_long, own), batch.column(4)]
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "part", "depth", "x1", "x2", "y1", "y2", "n_words"])

    ordered = turns.select("conv_id", F.col("pos").cast("bigint").alias("pos"), "e1", "e2", "n_words").repartitionByRange("conv_id", "pos").sortWithinPartitions("conv_id", "pos")
    found = staged(ordered.mapInArrow(chain, "conv_id bigint, part bigint, depth bigint, x1 bigint, x2 bigint, y1 bigint, y2 bigint, n_words bigint"), "prefixes")
    whole = _carried(found, ["y1", "y2"], F.bit_xor)
    p = [F.col(f"x{i}").bitwiseXOR(F.coalesce(f"before_y{i}", F.lit(0))) for i in (1, 2)]
    return whole.select("conv_id", "depth", p[0].alias("p1"), p[1].alias("p2"), p[0].bitwiseXOR(F.col("y1")).alias("q1"), p[1].bitwiseXOR(F.col("y2")).alias("q2"), "n_words")


NODE = ["depth", "p1", "p2"]


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of ends (conv_id, depth, p1, p2): SHA-256 of each node's ids, ascending, comma-joined. Ids
    are joined in ranges first; a node's joined ids then stream through one task, never held at once."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, size = None, [], 0

        def row() -> pa.RecordBatch:
            cols = [pa.array([x], pa.int64()) for x in (*node, ids[0])] + [pa.array([",".join(map(str, ids)).encode()], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=[*NODE, "first", "ids"])

        for batch in batches:
            for *key, conv in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (key != node or size > LIST) and ids:
                    yield row()
                    ids, size = [], 0
                node = key
                ids.append(conv)
                size += 12
        if ids:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, done = None, None, []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0][i] for d in done], pa.int64()) for i in range(3)] + [pa.array([d[1] for d in done], pa.string())], names=[*NODE, "ends_sha256"])

        for batch in batches:
            for *key, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if key != node:
                    if node is not None:
                        done.append((node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256(ids)
                else:
                    sha.update(b"," + ids)
            if len(done) > 10_000:
                yield rows()
                done = []
        if node is not None:
            done.append((node, sha.hexdigest()))
            yield rows()

    lists = ends.select(*NODE, "conv_id").repartitionByRange("conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(join, "depth bigint, p1 bigint, p2 bigint, first bigint, ids binary")
    return lists.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, "depth bigint, p1 bigint, p2 bigint, ends_sha256 string")


def _heads(tree: DataFrame) -> DataFrame:
    """(conv_id, depth, head, head_depth): the top of each node's heavy path, by pointer jumping; a node's pointer doubles its
    reach each round until it stands on a head."""
    up = tree.select("conv_id", "depth", F.when(F.col("is_head"), F.col("conv_id")).otherwise(F.col("parent_conv_id")).alias("head"), F.when(F.col("is_head"), F.col("depth")).otherwise(F.col("depth") - 1).alias("head_depth"), F.col("is_head").alias("there"))
    table = staged(up, "pointers")
    while True:
        over = table.select(F.col("conv_id").alias("head"), F.col("depth").alias("head_depth"), F.col("head").alias("over"), F.col("head_depth").alias("over_depth"), F.col("there").alias("known"))
        moved = table.where("not there").join(over, ["head", "head_depth"]).select("conv_id", "depth", F.col("over").alias("head"), F.col("over_depth").alias("head_depth"), F.col("known").alias("there"))
        new = staged(table.where("there").unionByName(moved), "pointers")
        forget(table)
        table = new
        if table.where("not there").isEmpty():
            return table.select("conv_id", "depth", "head", "head_depth")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every distinct prefix.

    turns: (conv_id, pos, e1, e2, n_words), pos from 1 without gaps; conversations: (conv_id) of all, also of those without
    turns, each once. conv_id is the smallest member. Without conversations there is no node, not even the root.
    """
    members = staged(_prefixes(turns), "members")
    zero = F.lit(0).cast("bigint")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(*[zero.alias(c) for c in NODE], "conv_id", "n_convs", zero.alias("q1"), zero.alias("q2"), zero.alias("n_words"))
    nodes = members.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.max("n_words").alias("n_words"))
    nodes = staged(nodes.unionByName(root), "nodes")
    lengths = members.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    last = members.join(lengths, ["conv_id", "depth"]).select("conv_id", *NODE)
    turnless = conversations.join(lengths, "conv_id", "left_anti").select("conv_id", *[zero.alias(c) for c in NODE])
    digests = _digests(last.unionByName(turnless))

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    # a parent with very many children is one row of one side, many of the other, which Spark splits
    named = nodes.where("depth > 0").join(parents, ["depth", "q1", "q2"]).unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint")))
    empty = hashlib.sha256().hexdigest()
    named = staged(named.join(digests, NODE, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_words", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")), "named")
    forget(members, nodes)
    kids = named.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", -F.col("conv_id"))).alias("heavy"))
    kids = staged(kids.select("conv_id", "depth", "n_children", (-F.col("heavy.col2")).alias("heavy")), "children")
    chosen = kids.select(F.col("heavy").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.lit(False).alias("is_head"))
    tree = named.join(kids.drop("heavy"), ["conv_id", "depth"], "left").join(chosen, ["conv_id", "depth"], "left")
    tree = tree.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("is_head", F.lit(True)).alias("is_head"), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"), "ends_sha256")
    tree = staged(tree, "tree")
    forget(named, kids)

    on_path = staged(tree.drop("is_head").join(_heads(tree.select("conv_id", "depth", "parent_conv_id", "is_head")), ["conv_id", "depth"]), "paths")
    forget(tree)
    sums = [F.sum(c).alias(c) for c in ("leaves", "saved")]
    path = ["head", "head_depth"]
    own = on_path.groupBy(*path).agg(*sums)
    tops = on_path.where("conv_id = head and depth = head_depth and depth > 0").select(*path, F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    above = on_path.select("conv_id", "depth", F.col("head").alias("over"), F.col("head_depth").alias("over_depth"))
    links = staged(tops.join(above, ["conv_id", "depth"]), "links")
    front = staged(own, "front")
    total = front
    while True:  # once for each light edge on the longest way: log2(conversations) times at most
        front = staged(front.join(links, path).groupBy(F.col("over").alias("head"), F.col("over_depth").alias("head_depth")).agg(*sums), "front")
        if front.isEmpty():
            break
        total = total.unionByName(front)
    light = total.groupBy(*path).agg(*sums).join(links, path).groupBy("conv_id", "depth").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    full = on_path.join(light, ["conv_id", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", zero) for c in ("leaves", "saved")}).withColumn("part", F.floor(F.col("depth") / PART))
    full = staged(full.drop("more_leaves", "more_saved"), "values")
    later = Window.partitionBy(*path).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    behind = full.groupBy(*path, "part").agg(*sums).select(*path, "part", *[F.coalesce(F.sum(c).over(later), zero).alias(f"{c}_behind") for c in ("leaves", "saved")])
    inside = Window.partitionBy(*path, "part").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    done = full.withColumns({c: F.sum(c).over(inside) for c in ("leaves", "saved")}).join(behind, [*path, "part"])
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + F.col("leaves_behind")).alias("n_leaves"), (F.col("saved") + F.col("saved_behind")).alias("saved_tokens"), "ends_sha256")
