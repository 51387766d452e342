"""Prefix trie of conversations by a burst trie.

A conversation is a path of turn ids.  Containers hold what follows below a
head of the trie; a container with too many turns bursts: the turns that all
of its conversations share become an edge of trie nodes, and the rest is
dealt to new containers by the next turn id.  Containers that are small
enough are sorted and swept into nodes, each in one task; a container of one
conversation is a plain chain and needs no sweep.  Equal conversations are
one member of a container, with a count.

A node is named by the exclusive or of the position-tagged 128-bit hashes of
its turns, so the name of the node above is one operation away, and a long
conversation is a column of rows, never one value.
"""

from __future__ import annotations

import hashlib
import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.base import free_worker, join_facts
from tessera.session import checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARED_BY = 5  # conversations that begin with the turns of one of them
MAX_SHARED = 9  # one more than the most turns that they begin with
CONTAINER_TURNS = 50_000  # a container with more bursts
BLOCK = 1024  # turns of a conversation that are summed in one group
PACK_BYTES = 64 << 10
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE_SCHEMA = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
               "saved_tokens bigint, ends_sha256 string")
NODE_COLUMNS = [c.split()[0] for c in NODE_SCHEMA.split(", ")]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), turn_a, turn_b (128-bit id of role and text),
    n_bytes, in the order of turn (null first), then role, then text.

    Rows are sorted by range, so a conversation of any length may lie in
    several partitions: each numbers its own rows, and the at most one
    conversation that a partition continues gets the rows before as offset."""
    checkpoint_dir(conversations.sparkSession)
    order = ["conv_id", "turn", "role", "text"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            ids = b.column(0).to_numpy()
            if not len(ids):
                continue
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            run = np.repeat(first, np.diff(np.append(first, len(ids))))
            pos = np.arange(len(ids)) - run
            if ids[0] == last:
                pos[run == 0] += n
            last, n = ids[-1], pos[-1] + 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(pos), pa.array(np.full(len(ids), part, np.int32))],
                ["conv_id", "turn_a", "turn_b", "n_bytes", "pos", "part"])

    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.xxhash64("role", "text").alias("turn_a"), F.xxhash64("text", F.lit("turn"), "role").alias("turn_b"),
        F.octet_length("text").cast("bigint").alias("n_bytes"))
    rows = rows.mapInArrow(number, "conv_id bigint, turn_a bigint, turn_b bigint, n_bytes bigint, pos bigint, part int").checkpoint()
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("offset", F.sum("n").over(before)).filter(F.col("offset") > 0).drop("n"))
    # at most one row a partition
    return rows.join(F.broadcast(offsets), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("pos") + F.coalesce("offset", F.lit(0))).alias("pos"), "turn_a", "turn_b", "n_bytes")


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """``numbered_turns`` of rebuilt conversations, from position 1, and a
    row of position 0 for each.  Conversation c begins with the first h turns
    of c - c % 5 (h = crc32 of the decimal c, % 9; remainders are not
    negative) and goes on with its own after its first h.

    Null roles and texts are empty; rows without conv_id belong to no
    conversation; repeated rows are turns of their own; other columns are
    ignored."""
    turns = numbered_turns(conversations).checkpoint()
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MAX_SHARED
    convs = sizes.withColumn("h", shared).withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(SHARED_BY)))
    begins = (turns.filter(F.col("pos") < MAX_SHARED - 1).groupBy(F.col("conv_id").alias("base"))  # at most 8 turns
              .agg(F.array_sort(F.collect_list(F.struct("pos", "turn_a", "turn_b", "n_bytes"))).alias("begin")))
    none = F.array().cast("array<struct<pos:bigint,turn_a:bigint,turn_b:bigint,n_bytes:bigint>>")
    convs = convs.join(begins, "base", "left").select(
        "conv_id", "n", "h", F.slice(F.coalesce("begin", none), 1, F.col("h").cast("int")).alias("begin")).checkpoint()
    own = join_facts(turns.withColumnRenamed("pos", "at"), convs, "conv_id", "n", turns.count()).filter(F.col("at") >= F.col("h"))
    own = own.select("conv_id", (F.col("at") - F.col("h") + F.size("begin") + 1).alias("pos"), "turn_a", "turn_b", "n_bytes")
    begun = convs.select("conv_id", F.explode("begin").alias("t")).select(
        "conv_id", (F.col("t.pos") + 1).alias("pos"), "t.turn_a", "t.turn_b", "t.n_bytes")
    zero = F.lit(0).cast("bigint")
    top = convs.select("conv_id", zero.alias("pos"), zero.alias("turn_a"), zero.alias("turn_b"), zero.alias("n_bytes"))
    return own.unionByName(begun).unionByName(top)


def path_rows(turns: DataFrame) -> DataFrame:
    """``turns`` with the name of the node at every position (key_a, key_b),
    the step to it (step_a, step_b) and the bytes down to it.  Running values
    are made in blocks of a conversation, whose totals are then added."""
    tag = F.col("pos") > 0
    rows = turns.select("conv_id", "pos", "n_bytes", F.floor(F.col("pos") / BLOCK).alias("block"),
                        F.when(tag, F.xxhash64("pos", "turn_a", "turn_b")).otherwise(0).alias("step_a"),
                        F.when(tag, F.xxhash64("turn_b", "pos", "turn_a")).otherwise(0).alias("step_b"))
    within = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("step_a").alias("a"), F.bit_xor("step_b").alias("b"), F.sum("n_bytes").alias("s"))
    blocks = blocks.select("conv_id", "block", F.bit_xor("a").over(before).alias("a"), F.bit_xor("b").over(before).alias("b"),
                           F.sum("s").over(before).alias("s")).filter(F.col("block") > 0)
    rows = rows.select("*", F.bit_xor("step_a").over(within).alias("ka"), F.bit_xor("step_b").over(within).alias("kb"),
                       F.sum("n_bytes").over(within).alias("run")).join(blocks, ["conv_id", "block"], "left")

    def added(c: str, before: str):
        return F.col(c).bitwiseXOR(F.coalesce(before, F.lit(0).cast("bigint")))

    return rows.select("conv_id", "pos", "n_bytes", "step_a", "step_b", added("ka", "a").alias("key_a"), added("kb", "b").alias("key_b"),
                       (F.col("run") + F.coalesce("s", F.lit(0))).alias("run"))


def end_digests(ends: DataFrame) -> DataFrame:
    """key_a, key_b, len, ends_sha256: SHA-256 of the ascending decimal
    conv_ids of equal conversations, comma-joined.  Sorted ids are joined to
    texts where they lie; the texts of one conversation then stream in order
    through one digest."""
    key = ["key_a", "key_b", "len"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        out, last, ids, size = [], None, [], 0
        for b in batches:
            for *k, c in zip(*(x.to_pylist() for x in b.columns)):
                if k != last or size > PACK_BYTES:
                    if ids:
                        out.append((*last, ids[0], ",".join(map(str, ids))))
                    last, ids, size = k, [], 0
                ids.append(c)
                size += 20
            if out:
                yield batch(out, ids_schema)
                out = []
        if ids:
            yield batch([(*last, ids[0], ",".join(map(str, ids)))], ids_schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        last, sha = None, None
        for b in batches:
            out = []
            for *k, _, text in zip(*(x.to_pylist() for x in b.columns)):
                if k == last:
                    sha.update(b"," + text.encode())
                else:
                    if last:
                        out.append((*last, sha.hexdigest()))
                    last, sha = k, hashlib.sha256(text.encode())
            if out:
                yield batch(out, sha_schema)
        if last:
            yield batch([(*last, sha.hexdigest())], sha_schema)

    ids_schema = "key_a bigint, key_b bigint, len bigint, first bigint, ids string"
    sha_schema = "key_a bigint, key_b bigint, len bigint, ends_sha256 string"
    order = [*key, "conv_id"]
    packed = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, ids_schema)
    return packed.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digest, sha_schema)


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


HEAD = ["head_a", "head_b", "top"]


def burst(classes: DataFrame, paths: DataFrame, max_turns: int) -> tuple[DataFrame, int]:
    """The container (``HEAD``: name and depth of its top node) of every
    class (distinct conversation), and the edges on the way to it; and the
    number of rounds.  A class that ends on an edge has no container."""
    zero = F.lit(0).cast("bigint")
    edges = F.array().cast("array<struct<top:bigint,bottom:bigint,key_a:bigint,key_b:bigint,bytes:bigint>>")
    state = classes.select("conv_id", "n", "len", "ends_sha256", zero.alias("head_a"), zero.alias("head_b"), zero.alias("top"),
                           F.lit(False).alias("ended"), edges.alias("path")).checkpoint()
    for rounds in itertools.count():
        big = (state.filter(~F.col("ended")).groupBy(*HEAD)
               .agg(F.sum(F.col("len") - F.col("top") + 1).alias("turns"), F.count(F.lit(1)).alias("members"))
               .filter((F.col("turns") > max_turns) & (F.col("members") > 1)).drop("turns").checkpoint())
        if not big.take(1):
            return state, rounds
        inside = state.filter(~F.col("ended")).join(big, HEAD).select("conv_id", *HEAD, "members")
        name = F.struct("key_a", "key_b")
        level = inside.join(paths, "conv_id").filter(F.col("pos") >= F.col("top")).groupBy(*HEAD, "pos").agg(
            F.min(name).alias("least"), F.max(name).alias("most"), F.count(F.lit(1)).alias("there"),
            F.max("members").alias("members"), F.max("run").alias("run"), F.max("n_bytes").alias("n_bytes"))
        common = level.filter((F.col("least") == F.col("most")) & (F.col("there") == F.col("members"))).groupBy(*HEAD).agg(
            F.max("pos").alias("bottom"), F.max_by("least", "pos").alias("name"),
            (F.max("run") - F.min("run") + F.min_by("n_bytes", "pos")).alias("bytes")).checkpoint()
        moved = state.join(common, HEAD, "left")
        went = F.col("bottom").isNotNull() & ~F.col("ended")
        edge = F.struct("top", "bottom", F.col("name.key_a").alias("key_a"), F.col("name.key_b").alias("key_b"), "bytes")
        moved = moved.select(
            "conv_id", "n", "len", "ends_sha256", "head_a", "head_b", "top",
            (F.col("ended") | (went & (F.col("len") == F.col("bottom")))).alias("ended"),
            F.when(went, F.concat("path", F.array(edge))).otherwise(F.col("path")).alias("path"),
            F.when(went & (F.col("len") > F.col("bottom")), F.col("bottom") + 1).alias("pos"))
        stay, go = moved.filter(F.col("pos").isNull()).drop("pos"), moved.filter(F.col("pos").isNotNull())
        go = go.drop(*HEAD).join(paths.select("conv_id", "pos", F.col("key_a").alias("head_a"), F.col("key_b").alias("head_b")),
                                 ["conv_id", "pos"]).withColumnRenamed("pos", "top")
        state = stay.unionByName(go).checkpoint()


SWEPT_SCHEMA = NODE_SCHEMA + ", is_top boolean"


def sweep(rows: DataFrame) -> DataFrame:
    """Nodes of containers of several classes, from the deepest up.
    ``rows``: the turns of each class below its container's top, with
    ``HEAD``, the class's n, len and ends_sha256, and ``above`` (the
    parent_conv_id of the top node)."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        columns = ("head_a", "head_b", "top", "above", "pos", "key_a", "key_b", "step_a", "step_b", "n_bytes", "conv_id", "n", "len", "ends_sha256")
        stream = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in columns)))
        out, below = [], {}
        for (_, _, top, above, pos, a, b, step_a, step_b, n_bytes), members in itertools.groupby(stream, lambda r: r[:10]):
            conv, n, ends = None, 0, NO_ENDS
            for *_, c, copies, length, sha in members:
                conv = c if conv is None else min(c, conv)
                n += copies
                if length == pos:
                    ends = sha
            children, leaves, saved = below.pop((pos, a, b), ((), 0, 0))
            out.extend((*node[:2], conv, *node[3:]) for node in children)
            leaves, saved = leaves or 1, saved + (n - 1) * n_bytes
            node = (conv, pos, above, n, len(children), leaves, saved, ends, pos == top)
            if pos == top:
                out.append(node)
            else:
                parent = (pos - 1, a ^ step_a, b ^ step_b)
                others, more, bytes_ = below.get(parent, ([], 0, 0))
                others.append(node)
                below[parent] = (others, more + leaves, bytes_ + saved)
            if len(out) > 10_000:
                yield batch(out, SWEPT_SCHEMA)
                out = []
        if out:
            yield batch(out, SWEPT_SCHEMA)

    ordered = rows.repartition(*HEAD).sortWithinPartitions(*HEAD, F.col("pos").desc(), "key_a", "key_b", "conv_id")
    return ordered.mapInArrow(nodes, SWEPT_SCHEMA)


def prefix_nodes(turns: DataFrame, max_turns: int = CONTAINER_TURNS) -> DataFrame:
    """One row for every distinct sequence of first turns (``turns`` as
    from ``rebuilt_turns``): conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    Conversations without a turn are members of the root alone; equal
    conversations are all counted; an empty table has no node."""
    checkpoint_dir(turns.sparkSession)
    key = ["key_a", "key_b", "len"]
    all_paths = path_rows(turns).checkpoint()
    ends = all_paths.groupBy("conv_id").agg(F.max(F.struct("pos", "key_a", "key_b", "run")).alias("e")).select(
        "conv_id", F.col("e.pos").alias("len"), "e.key_a", "e.key_b").checkpoint()
    classes = ends.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    classes = classes.join(end_digests(ends), key).select("conv_id", "n", "len", "ends_sha256").checkpoint()
    paths = all_paths.join(classes.select("conv_id"), "conv_id", "left_semi").checkpoint()
    state, rounds = burst(classes, paths, max_turns)

    held = state.filter(~F.col("ended"))
    members = held.groupBy(*HEAD).agg(F.count(F.lit(1)).alias("members"))
    held = held.join(members, HEAD).withColumn("last", F.element_at("path", F.when(F.size("path") > 0, -1)))
    no_one = F.lit(None).cast("bigint")
    if rounds:
        spots = state.select("*", F.posexplode("path").alias("at", "edge")).withColumn("next", F.get("path", F.col("at") + 1))
        child = F.when(F.col("next").isNotNull(), F.struct(F.col("next.key_a").alias("a"), F.col("next.key_b").alias("b"))).when(
            ~F.col("ended"), F.struct(F.col("head_a").alias("a"), F.col("head_b").alias("b")))
        edges = spots.groupBy("edge").agg(
            F.max("at").alias("at"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.count_distinct(child).alias("n_children"),
            F.max(F.when(F.col("ended") & F.col("next").isNull(), F.col("ends_sha256"))).alias("ends_sha256")).checkpoint()
        held = held.join(edges.select(F.col("edge").alias("last"), F.col("conv_id").alias("above")), "last", "left").checkpoint()
    else:
        held = held.withColumn("above", no_one).checkpoint()

    below = held.join(paths, "conv_id").filter(F.col("pos") >= F.col("top"))
    swept = sweep(below.filter(F.col("members") > 1)).checkpoint()
    chain = below.filter(F.col("members") == 1)
    bottom = chain.groupBy("conv_id").agg(F.max("run").alias("all_bytes"))
    is_top, is_end = F.col("pos") == F.col("top"), F.col("pos") == F.col("len")
    single = chain.join(bottom, "conv_id").select(
        "conv_id", F.col("pos").alias("depth"), F.when(is_top, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(is_end, 0).otherwise(1).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        ((F.col("n") - 1) * (F.col("all_bytes") - F.col("run") + F.col("n_bytes"))).alias("saved_tokens"),
        F.when(is_end, F.col("ends_sha256")).otherwise(NO_ENDS).alias("ends_sha256"), is_top.alias("is_top"))
    nodes = swept.unionByName(single)
    if not rounds:
        return nodes.select(*NODE_COLUMNS)

    # what lies below every edge: the containers, and the edges further down
    on_way = state.select("conv_id", "path")
    totals = nodes.filter("is_top").select("conv_id", "n_leaves", "saved_tokens").join(on_way, "conv_id").select(
        F.explode("path").alias("edge"), "n_leaves", "saved_tokens")
    own = edges.join(on_way, "conv_id").filter(F.col("at") > 0).select(
        F.explode(F.slice("path", F.lit(1), F.col("at"))).alias("edge"), F.lit(0).cast("bigint").alias("n_leaves"),
        ((F.col("n") - 1) * F.col("edge.bytes")).alias("saved_tokens"))
    below_edge = totals.unionByName(own).groupBy("edge").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_below"))
    upper = edges.join(on_way, "conv_id").withColumn("up", F.when(F.col("at") > 0, F.get("path", F.col("at") - 1)))
    upper = upper.join(edges.select(F.col("edge").alias("up"), F.col("conv_id").alias("above")), "up", "left").join(below_edge, "edge")
    upper = upper.select("conv_id", "n", "n_children", "n_leaves", "saved_below", "ends_sha256", "above", "edge.top", "edge.bottom").join(
        paths, "conv_id").filter(F.col("pos").between(F.col("top"), F.col("bottom")))
    last_run = upper.groupBy("conv_id", "top").agg(F.max("run").alias("all_bytes"))
    is_end = F.col("pos") == F.col("bottom")
    upper = upper.join(last_run, ["conv_id", "top"]).select(
        "conv_id", F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("top"), F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(is_end, F.col("n_children")).otherwise(1).cast("bigint").alias("n_children"), "n_leaves",
        (F.col("saved_below") + (F.col("n") - 1) * (F.col("all_bytes") - F.col("run") + F.col("n_bytes"))).alias("saved_tokens"),
        F.when(is_end, F.coalesce("ends_sha256", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"))
    return nodes.select(*NODE_COLUMNS).unionByName(upper)
