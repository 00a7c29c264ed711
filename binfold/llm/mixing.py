"""Mixing sources to target weights (DataFrame functions only).

Leaves are (domain, lang, source). A token budget goes down the tree: at each node the children share by weight,
a child whose whole subtree cannot use its share is filled up, and what it leaves goes to its siblings; only what
all siblings together cannot take stays with the parent's level. A leaf may repeat its documents ``max_epochs``
times. It takes whole epochs and then a token-prefix of one more epoch, whose order is seeded by epoch and id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binfold.llm.common import join_groups, table, word_count

LEVELS = ["domain", "lang", "source"]
UNKNOWN = "unknown"


def default_domain() -> Column:
    """A stand-in for a domain label where the table has none: four groups of sources."""
    return F.concat(F.lit("d"), (F.ascii(F.md5(F.col("source").cast("binary"))) % 4).cast("string"))


def leaf_columns(domain: Column | None = None) -> list[Column]:
    """``domain, lang, source`` of a row; what is null or absent falls under ``unknown``."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias(c)
    return [F.coalesce(domain if domain is not None else default_domain(), F.lit(UNKNOWN)).alias("domain"), name("lang"), name("source")]


def _weight(col: str, weights: dict[str, int] | None) -> Column:
    """Weights are configuration (a dict of the caller); a key without entry weighs 1, an entry of 0 excludes."""
    if not weights:
        return F.lit(1.0)
    lookup = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.try_element_at(lookup, F.col(col)), F.lit(1.0))


def share(children: DataFrame, parent: list[str], key: str, out: str = "budget") -> DataFrame:
    """Water-filling of ``parent_budget`` over rows with ``cap`` and ``w``, in closed form by two windows.

    Children in rising order of ``cap / w``: one is filled up when its cap is at most its share of what the ones
    before it left. The rest divide the remainder by weight, rounded down (under one token lost a child).
    """
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = w.orderBy(F.col("ratio"), F.col(key)).rowsBetween(Window.unboundedPreceding, -1)
    df = children.where("w > 0 and cap > 0").withColumn("ratio", F.col("cap") / F.col("w"))
    df = df.withColumn("cap_before", F.coalesce(F.sum("cap").over(order), F.lit(0))).withColumn("w_left", F.sum("w").over(w) - F.coalesce(F.sum("w").over(order), F.lit(0.0)))
    df = df.withColumn("full", F.col("cap") * F.col("w_left") <= F.col("w") * (F.col("parent_budget") - F.col("cap_before")))
    df = df.withColumn("cap_full", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(w)).withColumn("w_open", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(w))
    rest = F.floor(F.greatest(F.col("parent_budget") - F.col("cap_full"), F.lit(0)) * F.col("w") / F.nullif(F.col("w_open"), F.lit(0.0)))
    return df.withColumn(out, F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), rest)).cast("long")).drop("ratio", "cap_before", "w_left", "full", "cap_full", "w_open", "w", "parent_budget")


def leaf_budgets(leaves: DataFrame, total: Column, max_epochs: int, weights: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """Budgets of the leaves ``domain, lang, source, tokens``; the tree has one row per distinct leaf.

    A leaf below a node of weight 0 can take nothing, so it counts in no cap above it and its share goes to siblings.
    """
    weights = weights or {}
    open_ = F.lit(True)
    for level in LEVELS:
        open_ &= _weight(level, weights.get(level)) > 0
    leaves = leaves.withColumn("cap", F.when(open_, F.col("tokens") * max_epochs).otherwise(0))
    level = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"))
    level = share(level.withColumn("w", _weight("domain", weights.get("domain"))).withColumn("parent_budget", total), [], "domain")
    for depth in (2, 3):
        up, key = LEVELS[: depth - 1], LEVELS[depth - 1]
        kids = leaves.groupBy(*LEVELS[:depth]).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        kids = kids.join(level.select(*up, F.col("budget").alias("parent_budget")), up).withColumn("w", _weight(key, weights.get(key)))
        level = share(kids, up, key)
    return level


def mix(docs: DataFrame, budget_share: float = 0.5, max_epochs: int = 2, weights: dict[str, dict[str, int]] | None = None, seed: str = "mix", domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text", range_rows: int = 4096) -> DataFrame:
    """``doc_id, domain, lang, source, n_tokens, leaf_budget, copies``: how often each document is taken.

    The budget is ``budget_share`` of all tokens (words; a text without words counts 0 and joins any full epoch).
    Null or missing labels fall in the leaf ``unknown``. Null ids order first within their epoch. Rows that repeat
    id and leaf are peers: the prefix takes all or none. Leaves of weight 0 get no tokens. Empty input gives an
    empty result. Further columns are not read.

    Ranks come in steps so that a hot leaf is never one task. The epoch hash is cut into ranges by its leading hex
    digits, as many digits as leave about ``range_rows`` rows to a range; ranges get offsets inside their block (all
    but the last three digits), blocks inside their leaf, and only rows of one range are sorted together. So no
    window sees more than 4096 ranges or blocks until a leaf has ``range_rows`` * 2**36 rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), *leaf_columns(domain), word_count(F.col(text_col)).alias("n_tokens"))
    rows = table(rows, "leaf-rows")
    leaves = table(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "leaves")
    tokens, n_rows = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    budgets = leaf_budgets(leaves, F.lit(int(tokens * budget_share)), max_epochs, weights)
    budgets = leaves.join(budgets.select(*LEVELS, "budget"), LEVELS, "left").select(*LEVELS, "tokens", "rows", F.coalesce("budget", F.lit(0)).alias("leaf_budget"))
    full = F.when(F.col("tokens") > 0, F.floor(F.col("leaf_budget") / F.col("tokens"))).otherwise(0).cast("long")
    budgets = budgets.withColumn("epochs", full).withColumn("rest", F.col("leaf_budget") - F.col("epochs") * F.col("tokens"))
    digits = F.least(F.lit(9), F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("rows") / range_rows)))).cast("int")
    budgets = table(budgets.withColumn("digits", digits).drop("tokens"), "budgets")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("epochs").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    ranked = join_groups(rows, budgets, LEVELS, "rows", n_rows).withColumn("key", key)
    ranked = ranked.withColumn("range", F.left(F.col("key"), F.col("digits"))).withColumn("block", F.left(F.col("key"), F.col("digits") - 3)).drop("rows", "digits")
    ranked = table(ranked, "ranked")
    ranges = ranked.groupBy(*LEVELS, "block", "range").agg(F.sum("n_tokens").alias("t"))
    start = lambda by, *keys: F.coalesce(F.sum("t").over(Window.partitionBy(*LEVELS, *keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = table(ranges, "ranges")
    blocks = ranges.groupBy(*LEVELS, "block").agg(F.sum("t").alias("t")).withColumn("block_start", start("block")).drop("t")
    ranges = ranges.withColumn("range_start", start("range", "block")).drop("t").join(blocks, [*LEVELS, "block"])
    ranges = ranges.select(*LEVELS, "range", (F.col("block_start") + F.col("range_start")).alias("before"))
    inside = Window.partitionBy(*LEVELS, "range").orderBy("key", "id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranked.withColumn("upto", F.sum("n_tokens").over(inside)).join(ranges, [*LEVELS, "range"])
    taken = (F.col("before") + F.col("upto") <= F.col("rest")) & (F.col("rest") > 0)
    return out.select(F.col("id").alias(id_col), *LEVELS, "n_tokens", "leaf_budget", (F.col("epochs") + F.when(taken, 1).otherwise(0)).cast("long").alias("copies"))
