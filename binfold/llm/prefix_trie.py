"""Prefix trie of conversations by partition refinement.

All conversations start in one class, the root. A round looks at one turn: every active class splits by that turn, and
each part is a node. A class of one conversation, or of conversations that all go on alike to their end, is retired:
the rest of it is a chain without branches, written from the turns of its smallest member. So the rounds are as many
as turns that different conversations share, however long conversations are. At last the counts of subtrees are folded
back from the deepest branching level to the root, a round per level.

Classes are named by their smallest member, and the grouping that finds it is the split itself. Rows of a class go
back to its members by joins that split hot classes, as the first classes hold most conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binfold.llm.common import delete_path, join_groups, new_path, table

#: Conversation ids of one block of a node's list of ends; a block is put together in one row.
BLOCK = 4096
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def numbered(turns: DataFrame, path: str) -> DataFrame:
    """``conv, nth, role, text``: rows of every conversation numbered from 1 by turn (null first), then role and text.

    Rows are dealt by ranges of the whole order, so a conversation that holds a large part of all rows lies in many
    partitions; a row's number is its place in its partition after those of the partitions before. ``path`` takes
    the ordered rows.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("_turn"), text("role").alias("role"), text("text").alias("text"))
    order = [F.col("conv"), F.col("_turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("at"))
    placed = table(placed, "turns", path)
    parts = placed.groupBy("conv", "pid").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("conv", "pid", (before - F.col("first") + 1).alias("shift"))
    return placed.join(parts.hint("shuffle_hash"), ["conv", "pid"]).select("conv", (F.col("at") + F.col("shift")).alias("nth"), "role", "text")


def rebuild(turns: DataFrame, base: int = 100, most: int = 6) -> DataFrame:
    """``conv, depth, role, text``: each conversation c begins with the first h turns of c - c % ``base``.

    h is the unsigned CRC-32 of c in decimal, modulo ``most``. c's own turns after its first h follow. Of a base
    conversation with fewer turns all are taken, of an absent one none. A conversation without any rebuilt turn is a
    row of null depth. Rows of a null ``conv_id`` belong to no conversation and are left out.
    """
    spark = turns.sparkSession
    paths = [new_path(spark, f"rebuild-{k}") for k in range(3)]
    rows = table(numbered(turns, paths[0]), "numbered", paths[1])
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most))
    convs = rows.groupBy("conv").agg(F.max("nth").alias("own"))
    heads = rows.where(F.col("nth") < most).select(F.col("conv").alias("base"), "nth", "role", "text")
    sizes = convs.select(F.col("conv").alias("base"), F.col("own").alias("has"))
    convs = convs.select("conv", "own", h.alias("h"), (F.col("conv") - F.col("conv") % base).alias("base"))
    taken = table(convs.join(sizes, "base", "left").select("conv", "own", "h", "base", F.least("h", F.coalesce("has", F.lit(0))).alias("taken")), "heads", paths[2])
    begun = taken.select("conv", "base", "taken").join(heads, "base").where("nth <= taken").select("conv", F.col("nth").alias("depth"), "role", "text")
    # Own turns keep their place but for what the base lacks; a conversation of many rows meets one row here.
    own = join_groups(rows, taken.select("conv", "h", "taken", "own"), ["conv"], "own", rows.count()).where("nth > h").select("conv", (F.col("nth") - F.col("h") + F.col("taken")).alias("depth"), "role", "text")
    none = taken.where("taken = 0 and own <= h").select("conv", F.lit(None).cast("long").alias("depth"), F.lit("").alias("role"), F.lit("").alias("text"))
    out = table(begun.unionByName(own).unionByName(none), "rebuilt")
    for path in paths:
        delete_path(spark, path)
    return out


def _ends_digest(ends: DataFrame) -> DataFrame:
    """``conv_id, depth, ends_sha256`` from ``conv_id, depth, conv``: digest of each node's ids in order, with commas.

    Ids are put together in blocks of a range of ids, in parallel; the digest then reads a node's blocks in order, one
    at a time, as SHA-256 only goes forward.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    blocks = ends.groupBy("conv_id", "depth", F.floor(F.col("conv") / BLOCK).alias("block")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            out: list[tuple] = []
            for conv, depth, ids in zip(*(b.column(k).to_pylist() for k in (0, 1, 3))):
                if (conv, depth) == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (conv, depth), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["conv_id", "depth", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], ["conv_id", "depth", "ends_sha256"])

    keys = ["conv_id", "depth"]
    return blocks.repartition(*keys).sortWithinPartitions(*keys, "block").mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations ``conv, depth, role, text`` (see ``rebuild``).

    ``depth`` counts the turns of a conversation from 1 without gaps; a row of null depth stands for a conversation
    without turns. Columns: ``conv_id``, the smallest member; ``depth``; ``parent_conv_id`` (root: null); ``n_convs``,
    members; ``n_children``; ``n_leaves``, childless nodes of the subtree, its top included; ``saved_tokens``, the sum
    over the subtree of (members - 1) times the code points of the last text; ``ends_sha256``, digest of the ids, in
    order with commas, of the members that end there. Empty input has no root and gives no row.
    """
    spark = turns.sparkSession
    kept: list[str] = []

    def save(df: DataFrame, name: str) -> DataFrame:
        kept.append(new_path(spark, f"trie-{name}"))
        return table(df, name, kept[-1])

    # A turn is its digest; by depth, so that a round reads its own depth alone.
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    steps = turns.where("depth is not null").select("conv", F.col("depth").cast("long").alias("depth"), key.alias("key"), F.length("text").cast("long").alias("chars"))
    steps = save(steps.repartitionByRange("depth", "conv").sortWithinPartitions("depth", "conv"), "steps")
    lanes = [F.xxhash64(F.lit(k), "depth", "key") for k in (1, 2)]
    rest = steps.groupBy("conv").agg(F.count("*").alias("len"), *[F.bit_xor(x).alias(f"rest{k}") for k, x in enumerate(lanes)])
    zero = F.lit(0).cast("long")
    alone = turns.where("depth is null").select("conv").distinct().join(rest.select("conv"), "conv", "left_anti").select("conv", zero.alias("len"), zero.alias("rest0"), zero.alias("rest1"))
    active = save(rest.unionByName(alone).withColumn("node", zero), "all")
    total = active.count()
    if not total:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")

    # Members of a class that go on alike have equal xors of the 128-bit hashes of all their further turns.
    alike = (F.min("rest0") == F.max("rest0")) & (F.min("rest1") == F.max("rest1")) & (F.min("len") == F.max("len"))
    branching, chains, ends, depth = [], [], [], 0
    groups = active.agg(F.min("conv").alias("conv_id"), F.lit(None).cast("long").alias("parent"), F.count("*").alias("m"), zero.alias("chars"), alike.alias("alike"))
    rows = active.drop("node").withColumn("node", zero).withColumn("key", F.lit(b"").cast("binary"))
    groups = groups.withColumn("node", zero).withColumn("key", F.lit(b"").cast("binary"))
    while True:
        groups = save(groups, f"groups-{depth}")
        split = join_groups(rows, groups.select("node", "key", "conv_id", "m", "alike"), ["node", "key"], "m", total)
        split = save(split.select("conv", "len", "rest0", "rest1", F.col("conv_id").alias("node"), "alike"), f"rows-{depth}")
        level = F.lit(depth).cast("long")
        branching.append(groups.where("not alike").select("conv_id", level.alias("depth"), "parent", "m", "chars"))
        chains.append(groups.where("alike").select("conv_id", level.alias("depth"), "parent", "m", "chars"))
        over = F.col("alike") | (F.col("len") == depth)
        ends.append(split.where(over).select(F.col("node").alias("conv_id"), F.col("len").alias("depth"), "conv"))
        active = split.where(~over)
        total = active.count()
        if not total:
            break
        depth += 1
        here = steps.where(F.col("depth") == depth).select("conv", "key", "chars", *[x.alias(f"now{k}") for k, x in enumerate(lanes)])
        rows = active.drop("alike").join(here, "conv").select("conv", "len", *[F.col(f"rest{k}").bitwiseXOR(F.col(f"now{k}")).alias(f"rest{k}") for k in (0, 1)], "node", "key", "chars")
        rows = save(rows, f"split-{depth}")
        groups = rows.groupBy("node", "key").agg(F.min("conv").alias("conv_id"), F.count("*").alias("m"), F.max("chars").alias("chars"), alike.alias("alike")).withColumn("parent", F.col("node"))

    # Chains: the smallest member's own turns from the class's depth on; one leaf below each, sums from the end.
    tops = save(reduce(DataFrame.unionByName, chains).withColumnRenamed("depth", "top"), "tops")
    further = steps.join(tops.withColumnRenamed("conv_id", "conv").select("conv", "top", "m", "parent"), "conv").where("depth > top").select("conv", "depth", F.col("conv").alias("parent"), "m", "top", "chars")
    chain = further.unionByName(tops.select(F.col("conv_id").alias("conv"), F.col("top").alias("depth"), "parent", "m", "top", "chars"))
    onward = Window.partitionBy("conv", "top").orderBy(F.desc("depth"))
    chain = chain.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("m").alias("n_convs"), (F.row_number().over(onward) > 1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.sum((F.col("m") - 1) * F.col("chars")).over(onward.rowsBetween(Window.unboundedPreceding, 0)).alias("saved_tokens"), (F.col("depth") == F.col("top")).alias("head"),
    )
    chain = save(chain, "chains")
    nodes = [chain.select(*NODE)]
    heads = chain.where("head").select(*NODE)
    below = None
    for at in range(depth, -1, -1):
        children = heads.where(F.col("depth") == at + 1)
        children = children if below is None else children.unionByName(below)
        sums = children.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
        own = (F.col("m") - 1) * F.col("chars") + F.coalesce("saved", zero)
        done = branching[at].join(sums, "conv_id", "left").select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("m").alias("n_convs"), F.coalesce("n_children", zero).alias("n_children"), F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), own.alias("saved_tokens"))
        below = save(done, f"folded-{at}")
        nodes.append(below)
    digests = _ends_digest(reduce(DataFrame.unionByName, ends))
    out = reduce(DataFrame.unionByName, nodes).join(digests, ["conv_id", "depth"], "left").select(*NODE, F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    out = table(out, "trie")
    for path in kept:
        delete_path(spark, path)
    return out
