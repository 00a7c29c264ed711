"""N-gram Jaccard self-join: near-duplicate groups of documents, without losing a link.

1. Every text becomes the sorted set of 64-bit hashes of its word shingles. Documents with equal sets form a class;
   from here on only classes are compared.
2. The hash space is cut into buckets (as many as the data needs, about ``BUCKET_SETS`` hashes each). A bucket keeps
   the hashes that two classes or more hold. A class can only link if three quarters of its set are such shared
   hashes, which is counted exactly, so most of a corpus ends here.
3. The rest is ordered rarest hash first. Two sets that link share a hash of their prefixes, so classes that meet in
   a prefix are joined to coarse groups (connected components of stars, never all pairs).
4. Groups are cut into size-banded tiles of blocks. In a tile, sizes are compared, then bitmap signatures: each bit
   that differs needs an element that differs, which bounds the overlap from above; what is left is decided by the
   exact intersection of the sorted arrays. A tile gives one row per document: its links and its root in the tile.
5. Components of the roots are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binfold.llm.common import connected_components, delete_path, join_groups, new_path, table

SHINGLE = 5
#: Hashes per bucket and documents per block: they set how finely work is cut, never what is found.
BUCKET_SETS = 2_000_000
BLOCK = 1024
#: Classes per batch, holders of a hash in a batch from which it is hot, and the rarity byte of hot hashes.
BATCH, HOT, HOTTEST = 4096, 64, 255
PIECE = 1 << 22
BITMAP_WORDS = 8
_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # lower-cases A-Z
_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_BASE, _INV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MUL = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_SHORT = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for at, base in enumerate((_BASE, _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[at] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


def _piece_hashes(raw: np.ndarray) -> np.ndarray:
    sep = _SEP[raw]
    edge = np.diff(np.concatenate(([True], sep, [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[raw] * up[: len(raw)])))
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash per word, by a polynomial over its bytes; long texts go in pieces that end at white space."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) <= PIECE:
        return _piece_hashes(raw)
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and not _SEP[raw[end]]:
            step = np.flatnonzero(_SEP[raw[end : end + PIECE]])
            end = end + int(step[0]) if len(step) else min(len(raw), end + PIECE)
        out.append(_piece_hashes(raw[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of the whole sequence if it is shorter; empty without words."""
    w = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(w):
        return w
    if len(w) < SHINGLE:
        return _mix((w * _MUL[: len(w)]).sum(dtype=np.uint64, keepdims=True) + _SHORT[len(w) : len(w) + 1])
    h = np.zeros(len(w) - SHINGLE + 1, np.uint64)
    for j in range(SHINGLE):
        h += w[j : len(w) - SHINGLE + 1 + j] * _MUL[j]
    return np.unique(_mix(h))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n, c1, c2``: set size and the two halves of the set's 128-bit digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, c1, c2 = [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py())
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                c1.append(int.from_bytes(d[:8], "little", signed=True))
                c2.append(int.from_bytes(d[8:], "little", signed=True))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64())], ["id", "n", "c1", "c2"])

    kind = docs.select(id_col).dtypes[0][1]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n long, c1 long, c2 long")


def _planes(a: np.ndarray) -> bytes:
    """Byte planes of 32-bit numbers: the high ones are nearly all 0 and cost nothing once the shuffle compresses."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def strong_classes(docs: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """``c1, keys``: classes of which three quarters of the hashes are held by another class too, with those hashes.

    Keys are 64-bit hashes, rarest first: by a byte of rarity (finer than doubling of the number of classes), then by
    hash. Eight bytes a hash are shuffled, in one row per bucket and batch; what a bucket finds goes on in one row per
    bucket and part of the classes, so rows do not multiply with classes.

    A hash that over ``HOT`` classes of one batch hold is known to be shared. Its bucket is only told so; the classes
    go to their parts at once, with the highest rarity byte, which the bucket then gives to all other holders too. So
    no hash, however common, puts more than ``HOT`` classes of a batch in one group.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, cls, at = [], [], set()
            for t in b.column(0):
                s = shingle_set(t.as_py())
                if len(s):
                    c1 = int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "little", signed=True)
                    if c1 not in at:
                        at.add(c1)
                        sets.append(s)
                        cls.append(c1)
            for lo in range(0, len(sets), BATCH):
                part = sets[lo : lo + BATCH]
                size, c1 = np.array([len(s) for s in part], np.int64), np.array(cls[lo : lo + BATCH], np.int64)
                h, doc = np.concatenate(part), np.repeat(np.arange(len(part), dtype=np.int32), size)
                bucket = (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
                inorder = np.sort(h)
                told = np.unique(inorder[HOT:][inorder[HOT:] == inorder[: max(0, len(h) - HOT)]])
                told_bucket = (((told >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
                hot = np.isin(h, told) if len(told) else np.zeros(len(h), bool)
                rows: list[list] = [[], [], [], [], [], []]

                def send(to: np.ndarray, who_of: np.ndarray, key: np.ndarray, shift: int) -> None:
                    order = np.argsort(to, kind="stable")  # keeps the classes in order
                    to, who_of, key = to[order], who_of[order], key[order]
                    cut = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1, [len(to)])) if len(to) else np.zeros(1, np.int64)
                    for i, j in zip(cut[:-1], cut[1:]):
                        who, times = np.unique(who_of[i:j], return_counts=True)
                        for r, v in zip(rows, (int(to[i]) + shift, c1[who].tobytes(), _planes(size[who]), _planes(times), key[i:j].tobytes(), b"")):
                            r.append(v)

                send(bucket[~hot], doc[~hot], h[~hot], 0)
                if len(told):
                    direct = (c1.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
                    send(direct[doc[hot]], doc[hot], h[hot], buckets)
                    for to in np.unique(told_bucket):
                        for r, v in zip(rows, (int(to), b"", b"", b"", b"", told[told_bucket == to].tobytes())):
                            r.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], ["bucket", "cls", "size", "times", "keys", "hot"])

    def meet(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        if bucket >= buckets:  # holders of hot hashes, on their way to the part of their class
            rare = [bytes([HOTTEST]) * (len(x.as_py()) // 8) for x in group.column("keys")]
            return pa.table({"part": pa.array([bucket - buckets] * group.num_rows, pa.int32()), "cls": group.column("cls"), "size": group.column("size"), "hits": group.column("times"), "keys": group.column("keys"), "rare": pa.array(rare, pa.binary())})
        raw = lambda c: (x.as_py() for x in group.column(c))
        cls = np.concatenate([np.frombuffer(x, np.int64) for x in raw("cls")])
        size, times = (np.concatenate([_from_planes(x) for x in raw(c)]) for c in ("size", "times"))
        key, at = np.empty(int(times.sum()), np.uint64), 0
        for x in raw("keys"):
            key[at : at + len(x) // 8] = np.frombuffer(x, np.uint64)
            at += len(x) // 8
        told = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in raw("hot")]))
        # A class that several batches brought counts once for each hash.
        names, which = np.unique(cls, return_inverse=True)
        n = np.zeros(len(names), np.int64)
        n[which] = size
        doc = np.repeat(which.astype(np.int32), times)
        order = np.argsort(key) if len(names) == len(cls) else np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        del order
        if len(names) < len(cls):
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))) if len(key) else np.zeros(0, bool)
            key, doc = key[new], doc[new]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        df = np.diff(np.append(start, len(key)))
        rare = np.minimum(HOTTEST - 1, 4 * np.log2(np.maximum(df, 2) / 2)).astype(np.uint8)
        rare[np.isin(key[start], told)] = HOTTEST
        shared = np.repeat((df > 1) | (rare == HOTTEST), df)
        key, doc, rare = key[shared], doc[shared], np.repeat(rare, df)[shared]
        part = (names[doc].view(np.uint64) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((doc, part))
        key, doc, part, rare = key[order], doc[order], part[order], rare[order]
        cut = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(key)])) if len(key) else np.zeros(1, np.int64)
        rows: list[list] = [[], [], [], [], [], []]
        for lo, hi in zip(cut[:-1], cut[1:]):
            who, hits = np.unique(doc[lo:hi], return_counts=True)
            for r, v in zip(rows, (int(part[lo]), names[who].tobytes(), _planes(n[who]), _planes(hits), key[lo:hi].tobytes(), rare[lo:hi].tobytes())):
                r.append(v)
        return pa.table({"part": pa.array(rows[0], pa.int32()), **{c: pa.array(r, pa.binary()) for c, r in zip(("cls", "size", "hits", "keys", "rare"), rows[1:])}})

    def gather(group: pa.Table) -> pa.Table:
        raw = lambda c: (x.as_py() for x in group.column(c))
        cls = np.concatenate([np.frombuffer(x, np.int64) for x in raw("cls")])
        size, hits = (np.concatenate([_from_planes(x) for x in raw(c)]) for c in ("size", "hits"))
        names, which = np.unique(cls, return_inverse=True)
        n = np.zeros(len(names), np.int64)
        n[which] = size
        # Hot hashes may have come by two ways, so a first count is an upper bound.
        likely = 100 * np.bincount(which, hits, len(names)).astype(np.int64) >= 75 * n
        key, rare = (np.concatenate([np.frombuffer(x, t) for x in raw(c)]) for c, t in (("keys", np.uint64), ("rare", np.uint8)))
        owner = np.repeat(which, hits)
        keep = likely[owner]
        key, rare, owner = key[keep], rare[keep], owner[keep]
        order = np.lexsort((key, rare, owner))
        key, owner = key[order], owner[order]
        if len(key):
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))
            key, owner = key[new], owner[new]
        total = np.bincount(owner, minlength=len(names))
        strong = likely & (100 * total >= 75 * n)
        key = key[strong[owner]]
        offsets = np.concatenate(([0], np.cumsum(total[strong] * 8))).astype(np.int64)
        blob = pa.Array.from_buffers(pa.large_binary(), int(strong.sum()), [None, pa.py_buffer(offsets), pa.py_buffer(key.tobytes())]).cast(pa.binary())
        return pa.table({"c1": pa.array(names[strong]), "keys": blob})

    dealt = docs.select(F.col(text_col).alias("text")).mapInArrow(deal, "bucket int, cls binary, size binary, times binary, keys binary, hot binary")
    met = dealt.groupBy("bucket").applyInArrow(meet, "part int, cls binary, size binary, hits binary, keys binary, rare binary")
    return met.groupBy("part").applyInArrow(gather, "c1 long, keys binary")


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        reps, keys = [], []
        for rep, n, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            k = np.frombuffer(blob.as_py(), np.uint64)
            k = k[: len(k) - (-(-75 * n // 100)) + 1]
            reps.append(np.full(len(k), rep, np.int64))
            keys.append(k)
        if reps:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(reps))], ["key", "rep"])


def compare_tile(rep: np.ndarray, n: np.ndarray, weight: np.ndarray, sets: list[np.ndarray], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (weighted by class size) and tile root of every member; pairs of different ``side`` only, unless all are 0."""
    order = np.lexsort((rep, n))
    rep, n, weight, side, sets = rep[order], n[order], weight[order], side[order], [sets[i] for i in order]
    m, lens = len(rep), np.array([len(s) for s in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int64)
    at = np.concatenate(([0], np.cumsum(lens)))
    bits = np.zeros((m, BITMAP_WORDS * 64), bool)
    bits[np.repeat(np.arange(m), lens), _mix(ids.astype(np.uint64)) % np.uint64(BITMAP_WORDS * 64)] = True
    sig = np.packbits(bits, axis=1).view(np.uint64)
    cross = side.any()
    links, root, mark = np.zeros(m, np.int64), np.arange(m), np.zeros(int(ids.max()) + 1, bool)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(m - 1):
        hi = int(np.searchsorted(n, n[i] * 100 // 75, side="right"))
        if hi <= i + 1:
            continue
        j = np.arange(i + 1, hi)
        need = -(-75 * (n[i] + n[j]) // 175)
        most = (lens[i] + lens[j] - np.bitwise_count(sig[j] ^ sig[i]).sum(axis=1, dtype=np.int64)) // 2
        ok = most >= need
        if cross:
            ok &= side[j] != side[i]
        j, need = j[ok], need[ok]
        if not len(j):
            continue
        own = ids[at[i] : at[i + 1]]
        mark[own] = True
        if 3 * len(j) > hi - i - 1:  # dense: one pass over the adjoining sorted arrays
            inside = np.add.reduceat(mark[ids[at[i + 1] : at[hi]]], at[i + 1 : hi] - at[i + 1], dtype=np.int64)[ok]
        else:
            inside = np.array([np.count_nonzero(mark[ids[at[x] : at[x + 1]]]) for x in j])
        mark[own] = False
        j = j[inside >= need]
        links[i] += weight[j].sum()
        links[j] += weight[i]
        a = find(i)
        for x in j:
            b = find(int(x))
            if a != b:
                a, b = min(a, b), max(a, b)
                root[b] = a
    tops = np.array([find(i) for i in range(m)])
    lowest = rep.copy()
    np.minimum.at(lowest, tops, rep)
    back = np.empty(m, np.int64)
    back[order] = np.arange(m)
    return links[back], lowest[tops][back]


def _tile(group: pa.Table) -> pa.Table:
    col = {c: group.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "n", "size", "side")}
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("keys")]
    links, root = compare_tile(col["rep"], col["n"], col["size"], sets, col["side"])
    has = links > 0
    return pa.table({"rep": pa.array(col["rep"][has]), "links": pa.array(links[has]), "root": pa.array(root[has])})


def _with(rows: DataFrame, small: DataFrame, on: list[str], salts: int = 8) -> DataFrame:
    """Join that spreads a hot key: the small side (a row per key) is repeated for every salt.

    It has as many rows as there are groups, so it is never broadcast: the planner sees its size before the salts.
    """
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.hash("rep"), F.lit(salts))).hint("merge").join(salted, [*on, "_salt"]).drop("_salt")


def tiles(members: DataFrame) -> DataFrame:
    """Deal ``comp, rep, n`` to tiles: ``comp, tile, side, rep``, a row per tile that a class belongs to.

    Bands have ratio 4/3, so a link joins equal or neighbouring bands. A band has one block per ``BLOCK`` members;
    tiles are pairs of blocks. A group of at most ``BLOCK`` members is one tile, its sizes are compared inside.
    """
    rows = table(_with(members, members.groupBy("comp").agg(F.count("*").alias("members")), ["comp"]), "members")
    small = rows.where(F.col("members") <= BLOCK).select("comp", F.lit("all").alias("tile"), F.lit(0).alias("side"), "rep")
    large = rows.where(F.col("members") > BLOCK).withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(np.log(4 / 3)) + 1e-9).cast("int"))
    counts = table(large.groupBy("comp", "band").agg(F.count("*").alias("c")).select("comp", "band", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "bands")
    upper = counts.select("comp", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    lower = counts.select("comp", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    dealt = _with(large, counts.join(upper, ["comp", "band"], "left").join(lower, ["comp", "band"], "left"), ["comp", "band"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
    seq = lambda to: F.when(F.coalesce(to, F.lit(0)) > 0, F.sequence(F.lit(0), to - 1)).otherwise(F.array().cast("array<int>"))
    name = lambda *x: F.concat_ws(".", *[c.cast("string") for c in x])
    own = F.transform(seq(F.col("blocks")), lambda j: F.struct(name(F.col("band"), F.least("block", j), F.col("band"), F.greatest("block", j)).alias("tile"), F.when(F.col("block") > j, 1).otherwise(0).alias("side")))
    up = F.transform(seq(F.col("above")), lambda j: F.struct(name(F.col("band"), F.col("block"), F.col("band") + 1, j).alias("tile"), F.lit(0).alias("side")))
    down = F.transform(seq(F.col("below")), lambda j: F.struct(name(F.col("band") - 1, j, F.col("band"), F.col("block")).alias("tile"), F.lit(1).alias("side")))
    return small.unionByName(dealt.select("comp", F.explode(F.concat(own, up, down)).alias("t"), "rep").select("comp", "t.tile", "t.side", "rep"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for every row.

    Words are runs of characters other than space and ASCII tab to return, lower-cased A-Z; two documents link when
    100 * |intersection| >= 75 * |union| of their 5-word shingle sets. ``component_id`` is the smallest id reachable
    by links; ``n_links`` counts the rows it links with, copies included. Null or wordless texts: ``n_shingles`` 0,
    a component of their own. Ids may be of any orderable type. Rows that repeat an id link like other copies, each by
    its own text. Null ids link like others; their component is null when no row of it has an id. Empty input gives
    an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    sets = table(shingle_sets(docs, id_col, text_col), "sets")
    full = sets.where("n > 0")
    shingles, documents = full.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    classes = table(full.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.max("n").alias("n")), "classes")
    buckets = max(8, -(-shingles // BUCKET_SETS))
    # Classes meet by their own key, not by an id: null ids link like others, and an id on two texts joins nothing.
    known = classes.select("c1", F.col("c1").alias("rep"), "n", "size")
    path = new_path(spark, "strong")
    strong = table(strong_classes(docs, text_col, buckets).join(known, "c1").select("rep", "n", "size", "keys"), "strong", path)
    meets = table(strong.select("rep", "n", "keys").mapInArrow(_prefixes, "key long, rep long"), "meets")
    low = meets.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("holders")).where("low < high").select("key", "low", "holders")
    low = table(low, "lowest")
    edges = join_groups(meets, low, ["key"], "holders", meets.count()).where("rep <> low").select(F.col("rep").alias("u"), F.col("low").alias("v")).distinct()
    groups = connected_components(edges)
    places = tiles(strong.select("rep", "n").join(groups.withColumnsRenamed({"node": "rep"}), "rep").select("comp", "rep", "n"))
    found = table(places.join(strong, "rep").groupBy("comp", "tile").applyInArrow(_tile, "rep long, links long, root long"), "links")
    comps = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = table(classes.select("c1", "c2", "size", F.col("rep").alias("id"), F.col("c1").alias("rep")).join(links, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left"), "linked")
    lowest = linked.where("comp is not null").groupBy("comp").agg(F.min("id").alias("lowest"))
    alone = linked.where("comp is null").select("c1", "c2", "size", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("links"))
    answer = _with(linked.where("comp is not null"), lowest, ["comp"]).select("c1", "c2", "size", F.col("lowest").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    answer = table(answer.unionByName(alone), "answer")
    delete_path(spark, path)
    # Documents of a class of many copies do not meet in one task.
    out = join_groups(full, answer, ["c1", "c2"], "size", documents)
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", (F.col("size") - 1 + F.col("links")).cast("long").alias("n_links"))
    return out.unionByName(sets.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))
