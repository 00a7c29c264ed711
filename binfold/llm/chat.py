"""Chat formatting from reply trees (DataFrame functions only).

Messages point to the message they answer. Self-joins with doubling jump tables list, for every leaf, all messages
up to the root in about log2(depth) rounds. Branches are ranked by score, the chosen ones are formatted as one
string each, and ``read_back`` parses that string again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binfold.llm.common import new_path, table

#: Strings that chat templates use as control marks; inside texts they are escaped.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
START, END = CONTROL[0], CONTROL[1]


def _replace(col: Column, old: str, new: str) -> Column:
    return F.replace(col, F.lit(old), F.lit(new))


def escape(col: Column) -> Column:
    """Reversible: ``\\`` becomes ``\\0`` and the k-th control string ``\\k``; null counts as empty."""
    out = _replace(F.coalesce(col, F.lit("")), "\\", "\\0")
    for k, mark in enumerate(CONTROL, 1):
        out = _replace(out, mark, f"\\{k}")
    return out


def unescape(col: Column) -> Column:
    """Inverse of ``escape``: after the marks are back, the only escapes left are those of the backslash itself."""
    for k, mark in enumerate(CONTROL, 1):
        col = _replace(col, f"\\{k}", mark)
    return _replace(col, "\\0", "\\")


def escape_role(col: Column) -> Column:
    """A role ends at the line break, so one inside it is written ``\\n``."""
    return _replace(escape(col), "\n", "\\n")


def unescape_role(col: Column) -> Column:
    return unescape(_replace(col, "\\n", "\n"))


def linear_tree(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A conversation without replies as a tree: each row answers the row before it.

    Order: turn (nulls first), then role and text, so tied turns have a defined order and all rows take part.
    """
    w = Window.partitionBy("conv").orderBy(F.col("_turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("_turn"), "role", "text").withColumn("node", F.row_number().over(w).cast("long"))
    return rows.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def root_to_leaf(tree: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``conv, leaf, node, up``: every node on the path of every leaf, ``up`` steps above it.

    ``tree``: ``conv, node, parent`` with node ids unique in a conversation; a parent that is absent makes its
    child a root. Round k joins the paths found so far with jumps of 2**k steps and doubles the jumps. A cycle
    has no leaf or never ends: it raises after ``max_rounds``.
    """
    links = tree.select("conv", "node", "parent")
    present = links.select("conv", F.col("node").alias("parent"))
    same = lambda a, b, *on: [a[x].eqNullSafe(b[x]) for x in on]
    jump = links.alias("l").join(present.alias("p"), (F.col("l.conv").eqNullSafe(F.col("p.conv"))) & (F.col("l.parent") == F.col("p.parent"))).select("l.conv", "l.node", F.col("l.parent").alias("to"))
    jump = table(jump, "jump")
    leaf = links.join(jump.select(F.col("conv").alias("c2"), F.col("to").alias("n2")), F.col("conv").eqNullSafe(F.col("c2")) & (F.col("node") == F.col("n2")), "left_anti")
    paths = table(leaf.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
    for k in range(max_rounds):
        j = jump.select(F.col("conv").alias("c2"), F.col("node").alias("n2"), "to")
        if not j.take(1):
            return paths
        on = F.col("conv").eqNullSafe(F.col("c2")) & (F.col("node") == F.col("n2"))
        more = paths.join(j, on).select("conv", "leaf", F.col("to").alias("node"), (F.col("up") + 2**k).alias("up"))
        paths = table(paths.unionByName(more), "paths")
        twice = jump.select("conv", "node", F.col("to").alias("mid")).join(j, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("mid") == F.col("n2"))).select("conv", "node", "to")
        jump = table(twice, "jump")
    raise RuntimeError("replies form a cycle, or a path is longer than 2**max_rounds")


def conversations(tree: DataFrame, branches: int = 1) -> DataFrame:
    """The best ``branches`` paths of each conversation, formatted: ``conv, branch, formatted``.

    A branch scores the mean of its messages' scores; ties go to the longer, then to the smaller leaf id.
    """
    paths = root_to_leaf(tree)
    t = tree.select(F.col("conv").alias("c3"), F.col("node").alias("n3"), "role", "text", "score")
    msgs = paths.join(t, F.col("conv").eqNullSafe(F.col("c3")) & (F.col("node") == F.col("n3"))).drop("c3", "n3")
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("mean"), F.desc("len"), "leaf"))
    best = msgs.groupBy("conv", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"), F.count("*").alias("len")).withColumn("branch", rank).where(F.col("branch") <= branches)
    best = best.select(F.col("conv").alias("c4"), F.col("leaf").alias("l4"), "branch")
    chosen = msgs.join(best, F.col("conv").eqNullSafe(F.col("c4")) & (F.col("leaf") == F.col("l4")))
    turn = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END + "\n"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), turn.alias("s"))))
    return chosen.groupBy("conv", "branch").agg(parts.alias("parts")).select("conv", "branch", F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("formatted"))


def turns_of(formatted: Column) -> Column:
    """``array<struct<role, text>>`` parsed from a formatted conversation."""
    pieces = F.split(formatted, "<\\|im_start\\|>")
    raw = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    body = lambda s: F.substring_index(s, END, 1)
    return F.transform(raw, lambda s: F.struct(unescape_role(F.substring_index(body(s), "\n", 1)).alias("role"), unescape(F.substr(body(s), F.instr(body(s), F.lit("\n")) + 1)).alias("text")))


def loss_text(formatted: Column) -> Column:
    """Text under the loss mask: what assistants say, once and in order."""
    own = F.filter(turns_of(formatted), lambda t: t["role"] == "assistant")
    return F.array_join(F.transform(own, lambda t: t["text"]), "")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations: turns, loss mask and size (columns of the op9 contract)."""
    turns = turns_of(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("formatted"))
    return formatted.select(
        F.col("conv").alias("conv_id"), "branch", F.size(turns).cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def format_chats(turns: DataFrame, branches: int = 1, path: str | None = None) -> DataFrame:
    """Format linear conversations, write them, and read the digests back from what was written.

    Null text or role: empty. A null ``conv_id`` is a conversation of its own. Tied or repeated turns all take part
    (order: turn, role, text). Empty input gives an empty result. Further columns are not read.
    """
    tree = table(linear_tree(turns), "tree")
    out = table(conversations(tree, branches), "chats", path or new_path(turns.sparkSession, "chats"))
    return read_back(out)
