"""Edit-aware token counts.

A text is kept as a tree over its independent units (see ``units``): leaves hold the characters and tokens of one unit
or, after edits, of a run of units; every inner node the sums of its two children. An edit finds the leaves it touches by
descending the character sums, re-encodes only these and one leaf of context on either side, and renews the sums on
the paths to the root. The count of the edited text is then the root, without encoding the rest again. The edited text
and its tree can be kept, so the next round of edits is local too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDITS = "array<struct<start:long,stop:long,text:string>>"


class TokenTree:
    """Segment tree with two sums per node; leaf i is node ``width + i``."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.leaves = len(chars)
        self.width = 1 << max(0, int(len(chars) - 1).bit_length()) if len(chars) else 1
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + len(chars), 0] = chars
        self.sums[self.width : self.width + len(chars), 1] = tokens
        level = self.width
        while level > 1:
            half = level >> 1
            self.sums[half:level] = self.sums[level : 2 * level].reshape(half, 2, 2).sum(axis=1)
            level = half

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, char: int) -> tuple[int, int]:
        """Leaf that holds a character, and where the leaf starts; the last leaf for a place at the end."""
        if char >= self.chars:
            last = max(0, self.leaves - 1)
            return last, self.chars - int(self.sums[self.width + last, 0])
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if char >= start + self.sums[node, 0]:
                start += int(self.sums[node, 0])
                node += 1
        return node - self.width, start

    def set_leaves(self, first: int, last: int, chars: int, tokens: int) -> None:
        """Leaves first..last now hold ``chars`` and ``tokens`` together (kept at the first); sums above them follow."""
        lo, hi = self.width + first, self.width + last
        self.sums[lo : hi + 1] = 0
        self.sums[lo] = chars, tokens
        self.leaves = max(self.leaves, last + 1)
        while lo > 1:
            lo, hi = lo >> 1, hi >> 1
            self.sums[lo : hi + 1] = self.sums[2 * lo : 2 * hi + 2].reshape(-1, 2, 2).sum(axis=1)

    def to_bytes(self) -> bytes:
        """The leaves that hold characters; those an edit has emptied are left out."""
        leaves = self.sums[self.width : self.width + self.leaves]
        return leaves[leaves[:, 0] > 0].astype("<i4").tobytes()

    @staticmethod
    def from_bytes(raw: bytes) -> TokenTree:
        leaves = np.frombuffer(raw, "<i4").reshape(-1, 2)
        return TokenTree(leaves[:, 0], leaves[:, 1])


def regions(tree: TokenTree, edits: list[tuple[int, int, str]]) -> list[tuple[int, int, int, int, list[tuple[int, int, str]]]]:
    """(first leaf, last leaf, start, stop, edits) with one leaf of context on each side; regions that touch are one."""
    out: list[list] = []
    for start, stop, text in edits:
        first, at = tree.leaf_at(start)
        last, last_at = tree.leaf_at(max(start, stop - 1))
        if first > 0:
            first -= 1
            at -= int(tree.sums[tree.width + first, 0])
        if last < tree.leaves - 1:
            last_at += int(tree.sums[tree.width + last, 0])
            last += 1
        end = last_at + int(tree.sums[tree.width + last, 0])
        if out and first <= out[-1][1] + 1:
            out[-1][1], out[-1][3] = max(out[-1][1], last), max(out[-1][3], end)
            out[-1][4].append((start, stop, text))
        else:
            out.append([first, last, at, end, [(start, stop, text)]])
    return [tuple(x) for x in out]


def checked(edits: list[dict] | None, length: int) -> list[tuple[int, int, str]]:
    """Edits in order of place, clipped to the text; an edit that overlaps the one before starts where that one stops."""
    out: list[tuple[int, int, str]] = []
    for e in sorted((e for e in edits or [] if e and e["start"] is not None), key=lambda e: (e["start"], e["stop"] if e["stop"] is not None else e["start"])):
        start = min(max(0, e["start"]), length)
        start = max(start, out[-1][1]) if out else start
        stop = min(max(start, e["stop"] if e["stop"] is not None else start), length)
        out.append((start, stop, e["text"] or ""))
    return out


def apply_text(text: str, edits: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, stop, new in edits:
        out += [text[at:start], new]
        at = stop
    return "".join(out) + text[at:]


def sample_edits(text_col: str = "text") -> Column:
    """Two edits of every text: 40 characters at a third are deleted, and a mark is put in at two thirds."""
    n = F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    a, b = F.floor(n / 3), F.floor(n * 2 / 3)
    return F.array(
        F.struct(a.alias("start"), F.least(a + 40, b).alias("stop"), F.lit("").alias("text")),
        F.struct(b.alias("start"), b.alias("stop"), F.lit(" [edited] ").alias("text")),
    ).cast(EDITS)


def build_trees(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``docs`` with a column ``tree`` (the leaves; sums are rebuilt in one pass on reading), which replaces one of that name.

    Null text: an empty tree.
    """
    docs = docs.drop("tree")
    columns, at = docs.columns, docs.columns.index(text_col)
    docs = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from binfold.llm.units import encoder, split_units

        enc = encoder(tokenizer)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [t or "" for t in part.column(at).to_pylist()]
                trees = []
                for text, units, rows in zip(texts, map(split_units, texts), enc.rows(texts)):
                    size = enc.size[rows]
                    if len(size) != len(units):  # the first piece is empty where a text starts with a space
                        size = size[1:]
                    trees.append(np.stack((np.fromiter(map(len, units), np.int64, len(units)), size[: len(units)]), axis=1).astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(trees, pa.binary())], [*names, "tree"])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("tree", T.BinaryType())])).toDF(*columns, "tree")


def edit_tree(tree: TokenTree, spans: list[tuple[int, int, int, int]]) -> None:
    """Set regions (first leaf, last leaf, new characters, new tokens), all numbered as before any of them."""
    for first, last, chars, tokens in spans:
        tree.set_leaves(first, last, chars, tokens)


def apply_edits(trees: DataFrame, edits_col: str = "edits", id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, keep: bool = False) -> DataFrame:
    """``doc_id, n_tokens, n_edits, n_units, n_reencoded, n_tokens_edited`` from texts with their trees.

    With ``keep`` also the edited ``text`` and its ``tree``, ready for further edits.
    """
    names = ["id", "n_tokens", "n_edits", "n_units", "n_reencoded", "n_tokens_edited"] + ["text", "tree"] * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from binfold.llm.units import encoder

        enc = encoder(tokenizer)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                work, pieces = [], []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for text, raw, edits in zip(texts, part.column(2).to_pylist(), part.column(3).to_pylist()):
                    tree, todo = TokenTree.from_bytes(raw), checked(edits, len(text))
                    before, spans = (tree.tokens, tree.leaves), []
                    for first, last, start, end, own in regions(tree, todo):
                        pieces.append(apply_text(text[start:end], [(s - start, e - start, t) for s, e, t in own]))
                        spans.append((first, last, len(pieces[-1])))
                    work.append((tree, before, todo, spans))
                at = iter(enc.rows(pieces))
                out: list[list] = [[] for _ in names[1:]]
                for text, (tree, (tokens, units), todo, spans) in zip(texts, work):
                    sizes = [enc.size[next(at)] for _ in spans]
                    edit_tree(tree, [(*span, int(size.sum())) for span, size in zip(spans, sizes)])
                    row = (tokens, len(todo), units, int(sum((size > 0).sum() for size in sizes)), tree.tokens)
                    for c, v in zip(out, (*row, apply_text(text, todo), tree.to_bytes()) if keep else row):
                        c.append(v)
                cols = [pa.array(x, pa.int64()) for x in out[:5]] + [pa.array(x, t) for x, t in zip(out[5:], (pa.string(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names)

    kind = trees.select(id_col).dtypes[0][1]
    rows = trees.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), "tree", F.col(edits_col).cast(EDITS).alias("edits"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_edits long, n_units long, n_reencoded long, n_tokens_edited long" + ", text string, tree binary" * keep).withColumnRenamed("id", id_col)


def count_after_edits(docs: DataFrame, edits: Column, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Counts of every whole text before and after its edits (``array<struct<start, stop, text>>``, characters from 0).

    Null text: empty; null edits: none. Edits are clipped to the text and taken in order of place. Null and repeated
    ids are rows like others. Empty input gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col), F.col(text_col), edits.alias("edits"))
    return apply_edits(build_trees(rows, text_col, tokenizer), "edits", id_col, text_col, tokenizer)
