"""Packing: optimal length buckets from the global histogram, then token-budget batches inside each bucket.

The histogram (each distinct length with its rows, grouped in the cluster) reaches the driver as two number columns:
16 bytes a distinct length, so no more than 16 bytes a token of the longest document, however many rows there are.
The dynamic programme is exact over all of them.
"""

from __future__ import annotations

from array import array

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binfold.llm.common import table, word_count


def optimal_boundaries(lengths: list[int], counts: list[int], n_buckets: int) -> list[int]:
    """Boundaries (each a length of the histogram, the last the largest) that minimise total padding.

    dp[k][j] = min over i < j of dp[k-1][i] + L_j (N_j - N_i) - (S_j - S_i), N and S being prefix counts and token
    sums. For fixed k the candidates are lines in L_j with falling slopes -N_i, asked at rising L_j: a monotone
    hull answers each in amortised constant time, all in exact integers.
    """
    m = len(lengths)
    if not m:
        return []
    n, s = [0], [0]
    for length, count in zip(lengths, counts):
        n.append(n[-1] + count)
        s.append(s[-1] + count * length)
    prev = [0] + [lengths[j - 1] * n[j] - s[j] for j in range(1, m + 1)]
    back: list[array] = []
    best, best_k = prev[m], 1
    for _ in range(2, min(n_buckets, m) + 1):
        cur, arg = [0] * (m + 1), array("q", bytes(8 * (m + 1)))
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i
        at = 0
        for j in range(1, m + 1):
            i = j - 1
            a, b = -n[i], prev[i] + s[i]
            while len(hull) - at >= 2 and (b - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - a):
                hull.pop()
            hull.append((a, b, i))
            x = lengths[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            cur[j], arg[j] = hull[at][0] * x + hull[at][1] + x * n[j] - s[j], hull[at][2]
        back.append(arg)
        prev = cur
        if prev[m] < best:
            best, best_k = prev[m], len(back) + 1
    out, j = [], m
    for arg in reversed(back[: best_k - 1]):
        out.append(lengths[j - 1])
        j = arg[j]
    out.append(lengths[j - 1])
    return out[::-1]


def length_histogram(lengths: DataFrame) -> tuple[list[int], list[int]]:
    """Distinct lengths, ascending, and the rows of each."""
    t = lengths.groupBy("n").agg(F.count("*").alias("rows")).toArrow().sort_by("n")
    return t.column("n").to_pylist(), t.column("rows").to_pylist()


def bucket_of(n: Column, boundaries: list[int]) -> Column:
    """0-based number of the first boundary that is at least ``n``."""
    return F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in boundaries]), lambda b: b < n)).cast("int") if boundaries else F.lit(0)


def pack(docs: DataFrame, n_buckets: int = 16, token_budget: int = 65536, rows_per_salt: int = 20000, seed: int = 17, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, bucket, bucket_len, batch, slot``: the place of every document.

    ``n_tokens`` is ``length`` (default: words plus one end token). Documents of one bucket are padded to
    ``bucket_len``; a batch holds as many as fit the budget after padding, at least one, so a document above the
    budget makes a batch of its own and none is cut or dropped. ``batch`` counts from 0 within its bucket.
    Null text: length 1. A null id is a document like others. Rows that repeat an id each get a place. Empty
    input gives an empty result. Further columns are not read.

    Order inside a bucket is by seeded hash. Ranks come from salted parts of about ``rows_per_salt`` rows with
    offsets, so a bucket that holds most rows is spread over many tasks.
    """
    n = length if length is not None else word_count(F.col(text_col)) + 1
    # The text takes part in the order, so rows without an id, or with the same, lie in many parts as well.
    text = [F.col(text_col)] if text_col in docs.columns else []
    rows = table(docs.select(F.col(id_col).alias("id"), n.cast("long").alias("n"), F.xxhash64(F.col(id_col), *text, F.lit(seed)).alias("h")), "lengths")
    lengths, counts = length_histogram(rows)
    bounds = optimal_boundaries(lengths, counts, n_buckets)
    sizes: dict[int, int] = {}
    at = 0
    for x, c in zip(lengths, counts):
        while x > bounds[at]:
            at += 1
        sizes[at] = sizes.get(at, 0) + c
    salts = F.array(*[F.lit(1 + sizes.get(k, 0) // rows_per_salt) for k in range(len(bounds))]) if bounds else F.array(F.lit(1))
    lens = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(1).cast("long"))
    placed = rows.withColumn("bucket", bucket_of(F.col("n"), bounds))
    placed = placed.withColumn("salt", F.pmod(F.col("h"), F.get(salts, F.col("bucket")).cast("long")))
    parts = placed.groupBy("bucket", "salt").agg(F.count("*").alias("c"))
    before = Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("bucket", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    placed = placed.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("h", "id", "n")))
    out = placed.join(parts, ["bucket", "salt"]).withColumn("bucket_len", F.get(lens, F.col("bucket")))
    each = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("bucket_len"))).cast("long")
    place = F.col("before") + F.col("rank") - 1
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), "bucket", "bucket_len", F.floor(place / each).cast("long").alias("batch"), F.pmod(place, each).cast("int").alias("slot"))
