"""Phrase collocations by hashed, pruned passes over the texts (PCY and DHP).

Each pass counts phrases of one length exactly and those of the next length in hash buckets. A bucket that holds fewer
than the asked number can't hold a frequent phrase, so the next pass counts exactly only what lies in full buckets
(a broadcast bitmap of bounded size) and has only frequent parts (a second bitmap of the same size, made from the exact
counts of the pass before). Bitmaps only leave out what can't be frequent; what they let through is counted exactly.

Phrases are compared as arrays of hashes inside a task and as strings between tasks. A task adds up its own counts
first, so a phrase that half of the corpus holds costs one entry a task; entries travel as arrays, dealt by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binfold.llm.common import delete_path, join_groups, new_path, table
from binfold.llm.words import Words, among, mix, slices, words_of

LONGEST = 4
#: Buckets per byte of text (an eighth, rounded up to a power of two), the least and the most bits of a bucket's number.
#: With the most, a bitmap has 32 MB; beyond some 2 GB of text buckets fill up and more has to be counted exactly.
TEXT_PER_BUCKET, LEAST_BITS, MOST_BITS = 8, 16, 28
#: Bytes of text that are looked at together, distinct phrases and buckets that a task keeps before it hands on or merges.
SLICE_BYTES, KEEP, MERGE = 2 << 20, 200_000, 1_000_000
PART_BYTES = 8 << 20  # text per part of the counted phrases
BREAKS = b".,;:!?\n\x0b\x0c\r"
_BLANK, _BREAK = among(b" \t" + BREAKS), among(BREAKS)
_FACTOR = np.random.default_rng(20250613).integers(1, 2**63, (LONGEST + 1, LONGEST), dtype=np.uint64) | np.uint64(1)


def lang_hash(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))


class Phrases:
    """Words of a run of texts, and the hashes of their phrases."""

    def __init__(self, langs: list[str], texts: pa.Array):
        self.langs = langs
        self.words: Words = words_of(texts, _BLANK, lower=True)
        w = self.words
        self.lang = np.array([lang_hash(x) for x in langs], np.uint64)[w.doc] if len(langs) else np.zeros(0, np.uint64)
        breaks = np.concatenate(([0], np.cumsum(_BREAK[w.raw], dtype=np.int32)))
        # Whether a word and the next one lie side by side in one piece of one text.
        self.joined = (w.doc[1:] == w.doc[:-1]) & (breaks[w.start[1:]] == breaks[w.end[:-1]])

    def at(self, k: int) -> np.ndarray:
        """First words of all phrases of ``k`` words."""
        n = len(self.words.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        ok = np.ones(n, bool)
        for j in range(k - 1):
            ok &= self.joined[j : j + n]
        return np.flatnonzero(ok)

    def hashes(self, k: int, at: np.ndarray) -> np.ndarray:
        h = self.lang[at].copy()
        for j in range(k):
            h += self.words.hash[at + j] * _FACTOR[k, j]
        return mix(h)

    def phrase(self, k: int, at: int, raw: bytes) -> str:
        w = self.words
        return b" ".join(raw[w.start[i] : w.end[i]] for i in range(at, at + k)).decode("utf-8", "surrogatepass")


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash's bucket is set; there is a power of two of bits."""
    bucket = h >> np.uint64(64 - (len(bits).bit_length() + 2))
    return (bits[(bucket >> np.uint64(3)).astype(np.int64)] >> (bucket & np.uint64(7)).astype(np.uint8)) & 1 == 1


class _Buckets:
    """Counts of buckets of a task, up to 255, as sorted numbers; only buckets that are met take memory."""

    def __init__(self, k: int, bits: int):
        self.k, self.bits, self.parts, self.held = k, bits, [], 0

    def add(self, h: np.ndarray) -> None:
        bucket, n = np.unique((h >> np.uint64(64 - self.bits)).astype(np.uint32), return_counts=True)
        self.parts.append((bucket, np.minimum(n, 255).astype(np.uint8)))
        self.held += len(bucket)
        if self.held > MERGE:
            self.parts = [self.merged()]
            self.held = len(self.parts[0][0]) // 2

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        bucket, n = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(bucket, kind="stable")
        bucket, n = bucket[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
        return bucket[first], np.minimum(np.add.reduceat(n, first, dtype=np.int64), 255).astype(np.uint8) if len(first) else n

    def rows(self) -> Iterator[pa.RecordBatch]:
        """A row per block of 2**16 buckets: the low 16 bits of the numbers, then their counts."""
        bucket, n = self.merged()
        block = (bucket >> np.uint32(16)).astype(np.int64)
        cut = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)])) if len(block) else np.zeros(1, np.int64)
        out = [(self.k, None, int(block[i]), None, None, (bucket[i:j] & np.uint32(0xFFFF)).astype("<u2").tobytes() + n[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:])]
        for lo in range(0, len(out), 256):
            yield _rows(out[lo : lo + 256])


ROW = "k int, lang string, block int, phrases array<string>, fs array<bigint>, counts binary"
_ROW = pa.schema([("k", pa.int32()), ("lang", pa.string()), ("block", pa.int32()), ("phrases", pa.list_(pa.string())), ("fs", pa.list_(pa.int64())), ("counts", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)


class _Counts:
    """Exact counts of a task: numbers by hash, and the phrase of every hash the first time it is met."""

    def __init__(self, k: int, parts: int):
        self.k, self.parts, self.names, self.found = k, parts, {}, []

    def add(self, p: Phrases, at: np.ndarray, h: np.ndarray, raw: bytes) -> None:
        keys, first, n = np.unique(h, return_index=True, return_counts=True)
        self.found.append((keys, n))
        for key, i in zip(keys.tolist(), at[first].tolist()):
            if key not in self.names:
                self.names[key] = (p.langs[p.words.doc[i]], p.phrase(self.k, i, raw))

    def rows(self) -> Iterator[pa.RecordBatch]:
        """A row per language and part of the hashes."""
        if self.found:
            keys, where = np.unique(np.concatenate([x for x, _ in self.found]), return_inverse=True)
            total = np.bincount(where, np.concatenate([n for _, n in self.found])).astype(np.int64)
            part = ((keys >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).tolist()
            dealt: dict[tuple[int, str], tuple[list, list]] = {}
            for key, to, n in zip(keys.tolist(), part, total.tolist()):
                lang, phrase = self.names[key]
                phrases, fs = dealt.setdefault((to, lang), ([], []))
                phrases.append(phrase)
                fs.append(n)
            rows = [(self.k, lang, to, phrases, fs, None) for (to, lang), (phrases, fs) in dealt.items()]
            for lo in range(0, len(rows), 64):
                yield _rows(rows[lo : lo + 64])
        self.names, self.found = {}, []


def _summed(least: int):
    """Counts of the phrases of one language and part over all tasks; those of ``least`` and more."""

    def run(group: pa.Table) -> pa.Table:
        flat = pa.table({c: pc.list_flatten(group.column(c).combine_chunks()) for c in ("phrases", "fs")})
        sums = flat.group_by("phrases").aggregate([("fs", "sum")])
        sums = sums.filter(pc.greater_equal(sums.column("fs_sum"), least))
        first = [group.column(c)[0].as_py() for c in ("k", "lang")]
        n = sums.num_rows
        return pa.table({"k": pa.array([first[0]] * n, pa.int32()), "lang": pa.array([first[1]] * n, pa.string()), "phrase": sums.column("phrases"), "f": sums.column("fs_sum")})

    return run


def _pass(exact: dict[int, list], buckets: dict[int, list], bits: int, parts: int, n_words: bool):
    """One pass: ``exact`` and ``buckets`` give, per length to count, the bitmaps that a phrase must pass.

    A bitmap comes as ``(length, bits)``; all parts of that length must be in it.
    """

    def passing(p: Phrases, k: int, tests: list) -> tuple[np.ndarray, np.ndarray]:
        at = p.at(k)
        for size, bits in sorted(tests, key=lambda t: t[0]):
            if size < k:
                ok = np.zeros(len(p.words.hash) + 1, bool)
                own = p.at(size)
                ok[own[_has(bits.value, p.hashes(size, own))]] = True
                for j in range(k - size + 1):
                    at = at[ok[at + j]]
        h = p.hashes(k, at)
        for size, bits in tests:
            if size == k:
                ok = _has(bits.value, h)
                at, h = at[ok], h[ok]
        return at, h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {k: _Buckets(k, bits) for k in buckets}
        counts, words = {k: _Counts(k, parts) for k in exact}, {}
        for batch in batches:
            for b in slices(batch, 1, SLICE_BYTES):
                p = Phrases(["und" if x is None else x for x in b.column(0).to_pylist()], b.column(1))
                raw = p.words.raw.tobytes() if exact else b""
                for k, tests in exact.items():
                    counts[k].add(p, *passing(p, k, tests), raw)
                    if len(counts[k].names) > KEEP:
                        yield from counts[k].rows()
                for k, tests in buckets.items():
                    counters[k].add(passing(p, k, tests)[1])
                if n_words:
                    for lang, n in zip(p.langs, np.bincount(p.words.doc, minlength=len(p.langs)).tolist()):
                        words[lang] = words.get(lang, 0) + n
        for c in counts.values():
            yield from c.rows()
        for c in counters.values():
            yield from c.rows()
        if words:
            yield _rows([(0, lang, 0, None, [n], None) for lang, n in words.items()])

    return run


def _bitmap(blocks: DataFrame, bits: int, least: int) -> np.ndarray:
    """Bits of the buckets that reach ``least``: block by block in the cluster, then at most 32 MB in all for the driver.

    A block's messages are added up one after the other, so its memory is that of its counters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1)):
                raw = raw.as_py()
                n = len(raw) // 3
                at = np.frombuffer(raw, "<u2", n)
                own = total.setdefault(block, np.zeros(1 << 16, np.uint16))
                own[at] = np.minimum(own[at] + np.frombuffer(raw, np.uint8, n, 2 * n).astype(np.uint32), 65535)
        if total:
            full = [np.packbits(total[k] >= least, bitorder="little").tobytes() for k in total]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(full, pa.binary())], ["block", "bits"])

    out = np.zeros((1 << max(0, bits - 16), 1 << 13), np.uint8)
    for block, full in blocks.select("block", "counts").repartition("block").mapInArrow(run, "block int, bits binary").collect():
        out[block] = np.frombuffer(full, np.uint8)
    return out.reshape(-1)


def _bitmap_of(phrases: DataFrame, k: int, bits: int) -> np.ndarray:
    """Bits of the buckets of the given phrases (``lang, phrase``, each of ``k`` words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = _Buckets(k, bits)
        for b in batches:
            p = Phrases(b.column(0).to_pylist(), b.column(1))
            counters.add(p.hashes(k, p.at(k)))
        yield from counters.rows()

    return _bitmap(phrases.select("lang", "phrase").mapInArrow(run, ROW), bits, 1)


def frequent_phrases(docs: DataFrame, least: int, lang_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """``k, lang, phrase, f``: words and phrases that occur ``least`` times in their language; k 0: all words of a language."""
    spark = docs.sparkSession
    texts = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    send, paths, done = spark.sparkContext.broadcast, [], []
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(8, size // PART_BYTES)
    bits = min(MOST_BITS, max(LEAST_BITS, (size // TEXT_PER_BUCKET).bit_length()))

    def one(name: str, **what) -> DataFrame:
        paths.append(new_path(spark, f"phrases-{name}"))
        return table(texts.mapInArrow(_pass(bits=bits, parts=parts, **what), ROW), name, paths[-1])

    def total(rows: DataFrame, k: int) -> DataFrame:
        paths.append(new_path(spark, f"phrases-{k}"))
        own = rows.where((F.col("k") == k) & F.col("fs").isNotNull())
        if k:
            sums = own.select("k", "lang", "block", "phrases", "fs").groupBy("lang", "block").applyInArrow(_summed(least), "k int, lang string, phrase string, f long")
        else:
            sums = own.select("k", "lang", F.explode("fs").alias("n")).groupBy("k", "lang").agg(F.sum("n").alias("f")).select("k", "lang", F.lit("").alias("phrase"), "f")
        done.append(table(sums, f"{k}", paths[-1]))
        return done[-1]

    # A task's counter ends at 255, so that is what a bucket is asked for where more occurrences are wanted.
    full = lambda rows, k: send(_bitmap(rows.where((F.col("k") == k) & F.col("counts").isNotNull()), bits, min(least, 255)))
    def used(*bitmaps) -> None:
        for bitmap in bitmaps:
            bitmap.destroy()

    first = one("first", exact={}, buckets={1: [], 2: []}, n_words=True)
    total(first, 0)
    b1, b2 = full(first, 1), full(first, 2)
    second = one("second", exact={1: [(1, b1)], 2: [(1, b1), (2, b2)]}, buckets={3: [(1, b1), (2, b2)]}, n_words=False)
    used(b1, b2)
    total(second, 1)
    f2, b3 = send(_bitmap_of(total(second, 2), 2, bits)), full(second, 3)
    third = one("third", exact={3: [(2, f2), (3, b3)]}, buckets={4: [(2, f2), (3, b3)]}, n_words=False)
    used(f2, b3)
    f3, b4 = send(_bitmap_of(total(third, 3), 3, bits)), full(third, 4)
    total(one("fourth", exact={4: [(3, f3), (4, b4)]}, buckets={}, n_words=False), 4)
    used(f3, b4)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, paths


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, inside_share: int = 80, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of 2 to 4 words of every language.

    Texts are lower-cased (A-Z) and cut at ``. , ; : ! ?`` and line ends into pieces, these at spaces and tabs into
    words; ``a`` counts all contiguous occurrences in pieces. A phrase of at least ``least`` occurrences is cut where
    ``floor(2000000 a / (l + r))`` is smallest (then earliest), ``l`` and ``r`` being the counts of both parts. It is
    left out where a longer such phrase around it has ``inside_share`` percent of its occurrences. Order: score, then
    ``a``, descending, then the phrase's bytes. ``n``: all words of the language. A null language is ``und``; null and
    empty texts have no words; rows that repeat count as often as they stand. Empty input gives an empty result.
    """
    spark = docs.sparkSession
    found, paths = frequent_phrases(docs, least, lang_col, text_col)
    known = found.where("k > 0").select("lang", F.col("phrase").alias("part"), "f")
    phrases = found.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "k", "w")
    sides = F.array(F.struct(F.lit(0).alias("side"), part(F.lit(1), F.col("cut")).alias("part")), F.struct(F.lit(1).alias("side"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("part")))
    cuts = table(cuts.select("lang", "phrase", "a", "cut", F.explode(sides).alias("s")).select("lang", "phrase", "a", "cut", "s.side", "s.part"), "cuts", cuts_path := new_path(spark, "cuts"))
    # A common word is a part of very many phrases.
    uses = cuts.groupBy("lang", "part").agg(F.count("*").alias("uses")).join(known, ["lang", "part"])
    valued = join_groups(cuts, uses, ["lang", "part"], "uses", cuts.count())
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("f")))
    cuts = valued.groupBy("lang", "phrase", "a", "cut").agg(side(0).alias("l"), side(1).alias("r"))
    score = F.expr("CAST((CAST(a AS DECIMAL(20, 0)) * CAST(2000000 AS DECIMAL(10, 0))) div CAST(l + r AS DECIMAL(20, 0)) AS BIGINT)")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    inner = [F.slice("w", i, n) for n in (2, 3) for i in range(1, LONGEST - n + 2)]
    subs = F.filter(F.array(*inner), lambda s: F.size(s) < F.col("k"))
    subs = phrases.where("k > 2").select("lang", "a", F.explode(subs).alias("s")).where(F.size("s") >= 2).select("lang", F.array_join("s", " ").alias("phrase"), "a")
    around = subs.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    left = best.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < inside_share * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    ranked = left.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    n = found.where("k = 0").select("lang", F.col("f").alias("n"))
    out = table(ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    for path in [*paths, cuts_path]:
        delete_path(spark, path)
    return out
