"""Substring dedup by recompression: words that belong to a repeated window of text are removed.

Recompression rewrites every text level by level. A run of one symbol becomes one symbol, and a symbol of the left half
of the alphabet followed by one of the right half becomes one symbol. A new symbol's name is a hash of what it stands
for, so every task names a run or pair as every other would, and equal stretches of text get equal symbols wherever
they lie, except for a few at their ends. Each symbol carries the range of words that decided it (its own and those
next to it), so it is known which symbols any equal stretch must contain.

Spark rounds compare names over all documents, in buckets of names:

1. High symbols (of ``LONGEST`` words and more, up to one symbol for a whole text): where a name has an earlier holder,
   all windows inside are repeats. Copies and long shared passages end here, whatever their number.
2. Low symbols: of the symbols that the words of a window decide, the window takes the highest as its anchor. Equal
   windows take equal anchors, so a window whose anchor occurs once in the corpus is no repeat.
3. Of the remaining windows the 128-bit hashes are compared; only the first of equal windows is not a repeat. The first
   window of its kind is never inside a repeated symbol, so nothing is missed by leaving those out.

Messages are arrays of one bucket and one part of the documents. Inside a part each name goes out once, so a name that
most documents hold costs a bucket one entry a part. The answer to a part are ranges of windows of its rows. Rows live
in a table bucketed by row number, which all joins use without moving a text again.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binfold.llm.common import delete_path, new_path, table
from binfold.llm.words import BLANKS, among, mix, slices, words_of

WINDOW = 20
#: Bytes of text that one part holds, and per bucket of names: they set how finely work is cut, never what is found.
PART_BYTES, BUCKET_BYTES = 6 << 20, 16 << 20
#: Words from which a symbol counts as a high one, and the levels at which these are taken (then one for the whole text).
LONGEST, HIGH_LEVELS = 24, (12, 16, 20, 24, 28)
LEVELS = 400
#: The last level of anchors, and how often its symbols are halved by name: windows agree on the rarest they hold.
ANCHOR_LEVEL, ANCHOR_RANKS = 2, 4
_BLANK = among(BLANKS)
_RNG = np.random.default_rng(20250612)
_A, _B, _RUN, _LANE = (_RNG.integers(1, 2**63, 2, dtype=np.uint64) | np.uint64(1) for _ in range(4))
_WINDOW = _RNG.integers(1, 2**63, (2, 4096), dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_BASE), -1, 2**64))
LAST = np.int64(2**63 - 1)


class Symbols:
    """The symbols of a level over all texts of a part, in order.

    ``name`` has two lanes of 64 bits. ``start, end``: words covered. ``low, high``: words that decided the symbol; the
    edge of a text counts as a word outside of it, as the words of a window never tell where a text begins or ends.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        n = len(words)
        self.name = np.stack((mix(words * _LANE[0]), mix(words * _LANE[1] + np.uint64(1))))
        self.start, self.end, self.doc = np.arange(n), np.arange(1, n + 1), doc
        self.low, self.high = self.start, self.end
        self.sent = np.zeros(n, bool)

    def _next_same(self) -> np.ndarray:
        """Whether the next symbol belongs to the same text."""
        return np.append(self.doc[1:] == self.doc[:-1], False)

    def _replace(self, head: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray, new: np.ndarray) -> None:
        """Symbols at ``head`` stand for all up to the next head; ``name`` is theirs, ``new`` tells which changed."""
        last = np.append(head[1:], len(self.doc)) - 1
        self.name, self.start, self.end, self.doc = name, self.start[head], self.end[last], self.doc[head]
        self.low, self.high, self.sent = low, high, self.sent[head] & ~new

    def runs(self) -> None:
        """Every run of one symbol becomes one symbol; to tell where a run ends takes the symbols on both sides."""
        inner = self._next_same()
        equal = inner & np.append((self.name[:, 1:] == self.name[:, :-1]).all(axis=0), False)
        head = np.flatnonzero(~np.concatenate(([False], equal[:-1])))
        last = np.append(head[1:], len(self.doc)) - 1
        n = (last - head + 1).astype(np.uint64)
        name = self.name[:, head]
        long = n > 1
        name[:, long] = mix((name[:, long] + n[long]) * _RUN[:, None])
        low = np.where(np.concatenate(([False], inner[:-1]))[head], self.low[head - 1], self.start[head] - 1)
        high = np.where(inner[last], self.high[np.minimum(last + 1, len(self.doc) - 1)], self.end[last] + 1)
        self._replace(head, name, low, high, long)

    def pairs(self, level: int) -> None:
        """A left symbol followed by a right one becomes one symbol; a bit of the name says which half it belongs to."""
        n = len(self.doc)
        inner = self._next_same()
        right = (self.name[0] >> np.uint64(level % 64)) & np.uint64(1) == 1
        pair = inner & ~right & np.append(right[1:], False)
        head = np.flatnonzero(~np.concatenate(([False], pair[:-1])))
        paired = pair[head]
        name = self.name[:, head]
        two = head[paired]
        name[:, paired] = mix(self.name[:, two] * _A[:, None] + mix(self.name[:, two + 1] * _B[:, None]))
        # A pair is decided by its two symbols, a left symbol alone by the next one, a right symbol alone by the one before.
        after = np.where(inner[head], self.high[np.minimum(head + 1, n - 1)], self.end[head] + 1)
        before = np.where(np.concatenate(([False], inner[:-1]))[head], self.low[head - 1], self.start[head] - 1)
        alone = ~paired
        low = np.where(alone & right[head], before, self.low[head])
        high = np.where(alone & right[head], self.high[head], after)
        self._replace(head, name, low, high, paired)


def _anchor(symbols: Symbols, pick: np.ndarray | None, n: int, best: tuple[np.ndarray, np.ndarray], window: int) -> None:
    """For every window the first symbol (of those picked) that its words decide, if any, replaces what came before."""
    lo, hi = best
    low, high = (symbols.low, symbols.high) if pick is None else (symbols.low[pick], symbols.high[pick])
    ok = (high - low <= window) & (low >= 0)
    low, high = low[ok], high[ok]
    if not len(low):
        return
    # Windows that begin after the low end of the symbol before and not after its own, and reach its high end.
    begin = np.maximum(np.concatenate(([0], low[:-1] + 1)), high - window)
    size = np.maximum(low + 1 - begin, 0)
    at = np.arange(size.sum()) + np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size)
    lo[at], hi[at] = np.repeat(low, size), np.repeat(high, size)


def parse(words: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """High symbols ``(name, first word, words)`` of all texts, and the range of words of every window's anchor."""
    n = len(words)
    best = (np.arange(n), np.arange(1, n + 1))
    if not n:
        return (np.zeros((2, 0), np.uint64), *best), best
    s = Symbols(words, doc)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    longest = max(LONGEST, window)

    def send() -> None:
        at = np.flatnonzero(~s.sent & (s.end - s.start >= longest))
        out.append((s.name[:, at], s.start[at], s.end[at] - s.start[at]))
        s.sent[at] = True

    for level in range(LEVELS):
        # Runs of words first; then, where symbols are short, pairs alone, as runs take more context to decide.
        if level == 0 or level > 6:
            s.runs()
            if level == 0:
                _anchor(s, None, n, best, window)
        s.pairs(level)
        if level <= ANCHOR_LEVEL:
            _anchor(s, None, n, best, window)
        if level == ANCHOR_LEVEL:
            for rank in range(1, ANCHOR_RANKS):
                _anchor(s, np.flatnonzero(s.name[1] >> np.uint64(64 - rank) == 0), n, best, window)
        if level in HIGH_LEVELS:
            send()
        whole = len(s.doc) == 1 + np.count_nonzero(np.diff(s.doc))
        if whole and level > 12:
            break
    send()
    return (np.concatenate([x[0] for x in out], axis=1), *(np.concatenate([x[k] for x in out]) for k in (1, 2))), best


def window_hashes(words: np.ndarray, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Two lanes of a hash of the ``window`` words from each place of ``at``."""
    h = np.zeros((2, len(at)), np.uint64)
    other = mix(words + _LANE[0])
    for j in range(window):
        h[0] += words[at + j] * _WINDOW[0, j % 4096]
        h[1] += other[at + j] * _WINDOW[1, j % 4096]
        if j % 4096 == 4095:
            h = mix(h)
    return mix(h)


def _range_hashes(words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of the words of each range, by sums of powers."""
    power = np.full(len(words) + 1, _BASE)
    back = np.full(len(words) + 1, _INV)
    power[0] = back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[:-1])))
    return mix((total[high] - total[low]) * back[low] + (high - low).astype(np.uint64))


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every stretch of true."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start


def _covered(n: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of ``n`` places the ranges cover."""
    step = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(start + length, minlength=n + 1)[: n + 1]
    return np.cumsum(step)[:n] > 0


MESSAGE = "bucket long, part long, ids binary, rows binary, times binary, keys binary, at binary, len binary, many binary"
ANSWER = "part long, kind int, rows binary, times binary, at binary, len binary"
_MESSAGE = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), *((c, pa.binary()) for c in ("ids", "rows", "times", "keys", "at", "len", "many"))])


def _small(a: np.ndarray) -> bytes:
    """32-bit numbers as byte planes; the high ones are nearly all 0 and cost nothing once the shuffle compresses."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_small(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def _messages(kind: int, buckets: int, part: int, ids: np.ndarray, rows: np.ndarray, key: np.ndarray, doc: np.ndarray, at: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """Entries of a part, dealt by key: the first of equal keys goes to the key's bucket, the others to the part itself.

    ``key`` has one lane or two; ``doc`` numbers ``ids`` and ``rows``, ``at`` counts from the start of its text. Of the
    others it is certain already that they are no first and not alone; bucket -1 takes them straight to the answer.
    """
    order = np.lexsort((at, rows[doc], ids[doc], *key[::-1])) if len(key) > 1 else np.lexsort((at, rows[doc], ids[doc], key[0]))
    key, doc, at, length = key[:, order], doc[order], at[order], length[order]
    n = len(at)
    new = np.concatenate((np.ones(min(1, n), bool), (key[:, 1:] != key[:, :-1]).any(axis=0)))
    many = np.zeros(n, bool)
    many[np.flatnonzero(new)] = np.diff(np.append(np.flatnonzero(new), n)) > 1
    to = np.where(new, ((key[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), -1)
    order = np.lexsort((at, doc, to))
    to, key, doc, at, length, many = to[order], key[:, order], doc[order], at[order], length[order], many[order]
    cut = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1, [n])) if n else np.zeros(1, np.int64)
    out: list[list] = [[] for _ in _MESSAGE]
    for i, j in zip(cut[:-1], cut[1:]):
        here = np.concatenate(([i], np.flatnonzero(np.diff(doc[i:j])) + 1 + i))
        who = doc[here]
        keys = np.ascontiguousarray(key[:, i:j]).tobytes() if to[i] >= 0 else b""
        values = (int(to[i]) * 4 + kind, part, ids[who].tobytes(), rows[who].tobytes(), _small(np.diff(np.append(here, j))), keys, _small(at[i:j]), _small(length[i:j]), np.packbits(many[i:j]).tobytes())
        for column, value in zip(out, values):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _MESSAGE)], schema=_MESSAGE)


#: Kinds of entries: names of high symbols and hashes of windows ask for those that are not first, anchors for those not alone.
HIGH, ANCHOR, EXACT = 0, 1, 2


def _meet(group: pa.Table) -> pa.Table:
    """One bucket: which entries are not first (high symbols, windows), or not alone (anchors), of all with their key."""
    bucket = group.column("bucket")[0].as_py()
    kind = bucket % 4
    raw = {c: [x.as_py() for x in group.column(c)] for c in ("ids", "rows", "times", "keys", "at", "len", "many")}
    part = group.column("part").to_numpy()
    times = [_from_small(x) for x in raw["times"]]
    sizes = np.array([t.sum() for t in times], np.int64)
    answer = {c: raw[c] for c in ("rows", "times", "at", "len")}
    if bucket >= 0:
        lanes = 1 if kind == ANCHOR else 2
        key = np.concatenate([np.frombuffer(x, np.uint64).reshape(lanes, -1) for x in raw["keys"]], axis=1)
        many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=int(n)) for x, n in zip(raw["many"], sizes)]).astype(bool)
        at = np.concatenate([_from_small(x) for x in raw["at"]])
        of = np.concatenate(times)
        ids, rows = (np.repeat(np.concatenate([np.frombuffer(x, np.int64) for x in raw[c]]), of) for c in ("ids", "rows"))
        if kind == ANCHOR:
            order = np.argsort(key[0], kind="stable")
        else:
            order = np.lexsort((at, rows, ids, key[1], key[0]))
        key = key[:, order]
        first = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0))))
        holders = np.diff(np.append(first, len(at)))
        want = np.zeros(len(at), bool)
        if kind == ANCHOR:
            want[order] = np.repeat(holders > 1, holders)
            want |= many
        else:
            later = np.ones(len(at), bool)
            later[first] = False
            want[order] = later
        # Back in the order of the messages: each becomes a message to its part with the wanted entries.
        edge = np.concatenate(([0], np.cumsum(sizes)))
        answer = {c: [] for c in answer}
        keep = []
        for m, t in enumerate(times):
            w = want[edge[m] : edge[m + 1]]
            if not w.any():
                continue
            keep.append(m)
            left = np.add.reduceat(w, np.concatenate(([0], np.cumsum(t)[:-1])), dtype=np.int64)
            answer["rows"].append(np.frombuffer(raw["rows"][m], np.int64)[left > 0].tobytes())
            answer["times"].append(_small(left[left > 0]))
            answer["at"].append(_small(at[edge[m] : edge[m + 1]][w]))
            answer["len"].append(_small(_from_small(raw["len"][m])[w]))
        part = part[keep]
    columns = [pa.array(part, pa.int64()), pa.array([kind] * len(part), pa.int32()), *(pa.array(answer[c], pa.binary()) for c in ("rows", "times", "at", "len"))]
    return pa.table(columns, names=["part", "kind", "rows", "times", "at", "len"])


def _gather(group: pa.Table) -> pa.Table:
    """Answers to one part: per row the ranges of windows ``(first, number)``, high symbols and others apart."""
    kinds = group.column("kind").to_numpy()
    raw = {c: [x.as_py() for x in group.column(c)] for c in ("rows", "times", "at", "len")}
    times = [_from_small(x) for x in raw["times"]]
    row = np.concatenate([np.repeat(np.frombuffer(x, np.int64), t) for x, t in zip(raw["rows"], times)])
    at, length = (np.concatenate([_from_small(x) for x in raw[c]]) for c in ("at", "len"))
    high = np.repeat(kinds == HIGH, [t.sum() for t in times])
    names = np.unique(row)
    columns = [pa.array(names)]
    for which in (high, ~high):
        r, a, n = row[which], at[which], length[which]
        order = np.lexsort((a, r))
        r, a, n = r[order], a[order], n[order]
        cut = np.searchsorted(r, names), np.searchsorted(r, names, side="right")
        both = np.stack((a, n), axis=1).astype("<u4")
        columns.append(pa.array([both[i:j].tobytes() if j > i else None for i, j in zip(*cut)], pa.binary()))
    return pa.table(columns, names=["row", "high", "low"])


def _answers(messages: DataFrame) -> DataFrame:
    met = messages.groupBy(F.when(F.col("bucket") < 0, F.col("part") * 4 + F.pmod("bucket", F.lit(4))).otherwise(F.lit(-1)).alias("own"), "bucket").applyInArrow(_meet, ANSWER)
    return met.groupBy("part").applyInArrow(_gather, "row long, high binary, low binary")


def _pairs(raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(raw or b"", "<u4").reshape(-1, 2).astype(np.int64)
    return both[:, 0], both[:, 1]


def _parts(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows with their words: ``rows, part, word hashes, text of each word, first word and words of each text``."""
    for b in slices(batch, text, PART_BYTES):
        w = words_of(b.column(text), _BLANK)
        count = np.bincount(w.doc, minlength=b.num_rows)
        yield b, b.column(0)[0].as_py(), w.hash, w.doc, np.concatenate(([0], np.cumsum(count)[:-1])), count


def _first_round(buckets: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, part, words, doc, base, count in _parts(batch, 2):
                rows, ids = b.column(0).to_numpy(), b.column(1).fill_null(int(LAST)).to_numpy()
                (name, start, size), (low, high) = parse(words, doc, window)
                owner = doc[start]
                yield _messages(HIGH, buckets, part, ids, rows, name, owner, start - base[owner], size - window + 1)
                # Windows inside a symbol that this part itself holds earlier need no anchor.
                order = np.lexsort((start, rows[owner], ids[owner], name[1], name[0]))
                later = np.concatenate((np.zeros(min(1, len(order)), bool), (name[:, order[1:]] == name[:, order[:-1]]).all(axis=0)))
                known = _covered(len(words), start[order][later], size[order][later] - window + 1)
                place = np.arange(len(words))
                use = (place - base[doc] + window <= count[doc]) & ~known
                new = use & np.concatenate((np.ones(min(1, len(use)), bool), (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | ~use[:-1] | (doc[1:] != doc[:-1])))
                at = np.flatnonzero(new)
                run = np.add.reduceat(use, at, dtype=np.int64) if len(at) else at
                key = _range_hashes(words, low[at], high[at])[None]
                yield _messages(ANCHOR, buckets, part, ids, rows, key, doc[at], at - base[doc[at]], run)

    return run


def _second_round(buckets: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, part, words, _, base, _ in _parts(batch, 2):
                at, owner = [], []
                for i, (high, low) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist())):
                    s, n = _pairs(low)
                    if not len(s):
                        continue
                    t, m = _pairs(high)
                    size = int(max((s + n).max(), (t + m).max(initial=0)))
                    p = np.flatnonzero(_covered(size, s, n) & ~_covered(size, t, m))
                    at.append(p)
                    owner.append(np.full(len(p), i))
                if at:
                    at, owner = np.concatenate(at), np.concatenate(owner)
                    rows, ids = b.column(0).to_numpy(), b.column(1).fill_null(int(LAST)).to_numpy()
                    yield _messages(EXACT, buckets, part, ids, rows, window_hashes(words, at + base[owner], window), owner, at, np.ones(len(at), np.int64))

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, high, exact in zip(b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist()):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                (s, n), (t, m) = _pairs(high), _pairs(exact)
                gone = _covered(len(words), np.concatenate((s, t)), np.concatenate((n, m)) + window - 1)
                kept = b" ".join(itertools.compress(words, ~gone) if len(s) or len(t) else words)
                for column, value in zip(out, (len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass"))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2]), pa.array(out[3])], ["id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, path: str | None = None) -> DataFrame:
    """One row per document: ``<id>, n_words, n_removed, kept_sha256, kept``.

    Words are runs of characters other than space and ASCII tab to return, taken as they are. A window is ``window``
    consecutive words of one text; a word goes if any window over it has the same words as a window that starts
    earlier: in a text with a smaller id, or earlier in the same text. ``kept`` are the other words, joined by one
    space, and ``kept_sha256`` the digest of their UTF-8 bytes.

    ``id_col`` holds whole numbers. A null id comes after all others; rows that share an id, or have none, are
    documents of their own, in the order of a row number that is fixed once. Null, empty and blank texts have no words.
    An empty input gives an empty result. Other columns are not read, whatever their names. The result is a table
    (at ``path``, if given).
    """
    spark = docs.sparkSession
    at = new_path(spark, "repeats-rows")
    name = f"repeats_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"))
    rows.repartition(parts, "row").write.option("compression", "zstd").bucketBy(parts, "row").option("path", at).saveAsTable(name)
    source = spark.table(name)
    buckets = max(8, -(-source.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] // BUCKET_BYTES))
    texts = source.select("row", "id", "text")
    beside = lambda answer: texts.join(answer.hint("shuffle_hash"), "row", "left")
    first = table(_answers(texts.mapInArrow(_first_round(buckets, window), MESSAGE)), "repeats-symbols", a := new_path(spark, "repeats-symbols"))
    asked = beside(first).where("low is not null").select("row", "id", "text", "high", "low")
    second = table(_answers(asked.mapInArrow(_second_round(buckets, window), MESSAGE)), "repeats-windows", b := new_path(spark, "repeats-windows"))
    marked = beside(first.select("row", "high")).join(second.select("row", "low").hint("shuffle_hash"), "row", "left").select("row", "id", "text", "high", "low")
    kind = docs.select(id_col).dtypes[0][1]
    cut = marked.mapInArrow(_cut(window), "id long, n_words long, n_removed long, kept_sha256 string, kept string")
    out = table(cut.select(F.col("id").cast(kind).alias(id_col), "n_words", "n_removed", "kept_sha256", "kept"), "kept", path)
    spark.sql(f"DROP TABLE {name}")
    for p in (at, a, b):
        delete_path(spark, p)
    return out
