"""Content-addressed store of token ids.

Documents are encoded whole, an end id is appended, and a rolling hash over eight ids cuts the stream into chunks. A
chunk is stored once under the SHA-256 of its ids (little-endian, 32 bits each); a document is a recipe, the list of
its chunks. Recipes lie in ascending id order in parts. A Merkle tree stands over all of them: nodes of ``FANOUT``
recipes, parts, groups of ``FANOUT`` parts, and the store. Part roots are kept in the manifest, the root of the store in
a note; both are compared when the store is read, so a part that is changed, added or taken away with its manifest row
is noticed.

Layout below the store's path: ``log/kind=chunk`` (key, n, body), ``recipes`` (part, row, start, id, n, body = chunk
keys), ``manifest`` (part, docs, tokens, root) and ``_root`` (the store's root, parts, documents and tokens).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binfold.llm.common import new_path, read_note, write_note

END_ID = 0
KEY = 32
WINDOW, MIN_CHUNK, MAX_CHUNK, CUT_BITS = 8, 128, 8192, 9
FANOUT = 1024
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PRESS: list = []


def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One pair per process: making the contexts costs more than a chunk."""
    if not _PRESS:
        _PRESS.extend((zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()))
    return _PRESS[0], _PRESS[1]


def chunk_ends(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document: where the top bits of the rolling hash are 0, between the size bounds."""
    n = len(ids)
    if n <= MIN_CHUNK:
        return [n] if n else []
    g = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(32)
    span, power = 1, int(_STEP)
    h = g
    while span < WINDOW:  # sums over windows of doubling length: three passes for eight ids
        wider = h.copy()
        wider[span:] += h[:-span] * np.uint64(power)
        h, span, power = wider, 2 * span, power * power & (2**64 - 1)
    out, start = [], 0
    for c in (np.flatnonzero((h >> np.uint64(64 - CUT_BITS)) == 0) + 1).tolist() + [n]:
        while c - start > MAX_CHUNK:
            start += MAX_CHUNK
            out.append(start)
        if c - start >= MIN_CHUNK or c == n:
            if c > start:
                out.append(c)
            start = c
    return out


def pack_ids(ids: np.ndarray) -> bytes:
    """One byte of width (2 or 4), then the byte planes, compressed."""
    width = 2 if not len(ids) or ids.max() < 65536 else 4
    planes = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + _zstd()[0].compress(planes.tobytes())


def unpack_ids(body: bytes, n: int) -> np.ndarray:
    width = body[0]
    raw = _zstd()[1].decompress(body[1:], max_output_size=n * width)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(f"<u{width}").reshape(-1).astype("<u4")


def _encode(tokenizer: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from binfold.llm.units import encoder

        enc, task, row, written = encoder(tokenizer), TaskContext.get().partitionId(), 0, set()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                kind, key, doc, ns, body = [], [], [], [], []
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    keys, start = [], 0
                    for end in chunk_ends(ids):
                        one = ids[start:end]
                        digest = hashlib.sha256(one.tobytes()).digest()
                        keys.append(digest)
                        if digest not in written:  # a task hands a chunk on once, so a hot chunk makes no hot key
                            if len(written) > 500_000:
                                written.clear()
                            written.add(digest)
                            kind.append("chunk"), key.append(digest), doc.append(None), ns.append(end - start), body.append(pack_ids(one))
                        start = end
                    kind.append("recipe"), key.append(task.to_bytes(4, "big") + row.to_bytes(8, "big")), doc.append(doc_id), ns.append(len(ids)), body.append(b"".join(keys))
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(key, pa.binary()), pa.array(doc, b.schema.field(0).type), pa.array(ns, pa.int64()), pa.array(body, pa.binary())], ["kind", "key", "id", "n", "body"])

    return run


def _lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the sorted recipes of a part and give each its start inside the part."""
    part, row, start = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        n = b.column("n").to_numpy()
        first = start + np.cumsum(n) - n
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(row, row + len(n))), pa.array(first.astype(np.int64)), b.column("id"), b.column("n"), b.column("body")], ["part", "row", "start", "id", "n", "body"])
        row, start = row + len(n), int(start + n.sum())


def merkle(recipes: DataFrame) -> DataFrame:
    """``part, docs, tokens, root`` from recipes; a node hashes at most ``FANOUT`` leaves, a part its nodes in order."""
    leaf = F.unhex(F.sha2(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"), F.lit(b":"), F.col("body")), 256))
    nodes = recipes.withColumn("leaf", leaf).withColumn("node", F.floor(F.col("row") / FANOUT)).groupBy("part", "node").agg(_joined("leaf", "row").alias("hash"), F.count("*").alias("docs"), F.sum("n").alias("tokens"))
    return nodes.groupBy("part").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), _joined("hash", "node").alias("root"))


def _joined(c: str, by: str) -> Column:
    """SHA-256 over the hashes of a group's children in order."""
    return F.unhex(F.sha2(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, c))), lambda x: F.hex(x[c])), "")), 256))


def store_root(manifest: DataFrame) -> str:
    """The top of the tree: root over groups of parts, with the numbers of parts, documents and tokens."""
    groups = manifest.groupBy(F.floor(F.col("part") / FANOUT).alias("group")).agg(_joined("root", "part").alias("hash"), F.count("*").alias("parts"), F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    top = groups.agg(F.lower(F.hex(_joined("hash", "group"))), F.coalesce(F.sum("parts"), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    return " ".join(map(str, top))


def write_store(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode, cut and store; returns the store's path.

    One shuffle carries chunks and recipes together, keyed by content or by row. Ids tie by size and content.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "store")
    kind = docs.select(id_col).dtypes[0][1]
    coded = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_encode(tokenizer), f"kind string, key binary, id {kind}, n long, body binary")
    once = F.row_number().over(Window.partitionBy("kind", "key").orderBy("n"))
    coded.withColumn("nth", once).where("nth = 1").drop("nth").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/log")
    log = spark.read.schema(f"kind string, key binary, id {kind}, n long, body binary").parquet(f"{path}/log")
    recipes = log.where("kind = 'recipe'").select("id", "n", "body").repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "n", "body")
    recipes.mapInArrow(_lay_out, f"part int, row long, start long, id {kind}, n long, body binary").write.mode("overwrite").parquet(f"{path}/recipes")
    merkle(spark.read.parquet(f"{path}/recipes")).write.mode("overwrite").parquet(f"{path}/manifest")
    write_note(spark, f"{path}/_root", store_root(spark.read.parquet(f"{path}/manifest")))
    return path


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kind string, key binary, n long, body binary").parquet(f"{path}/log").where("kind = 'chunk'").select("key", "n", "body")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with ``start`` over the whole store, after the manifest has been compared with what was read."""
    recipes, manifest = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    if read_note(spark, f"{path}/_root") != store_root(manifest):
        raise ValueError("the manifest does not match the root of the store")
    now = merkle(recipes).select("part", F.col("root").alias("now"))
    # One row per part: as many as the writing job had tasks.
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = manifest.join(now, "part", "full").select("part", F.when(F.col("now").eqNullSafe(F.col("root")), F.coalesce(before, F.lit(0))).otherwise(F.raise_error(F.lit("the manifest does not match the recipes")).cast("long")).alias("before"))
    return recipes.join(parts, "part").select("part", "row", (F.col("before") + F.col("start")).alias("start"), "id", "n", "body")


def _steps(recipes: DataFrame) -> DataFrame:
    at = F.sequence(F.lit(0), (F.octet_length("body") / KEY).cast("int") - 1)
    return recipes.select("part", "row", "start", "id", F.col("n").alias("doc_n"), F.posexplode(F.transform(at, lambda i: F.substr("body", i * KEY + 1, F.lit(KEY)))).alias("pos", "key"))


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        crc = []
        for key, n, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            raw = unpack_ids(body, n).tobytes()
            if hashlib.sha256(raw).digest() != key:
                raise ValueError("a chunk does not match its key")
            crc.append(crc32(raw))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crc, pa.int64())], ["key", "size", "crc"])


def read_documents(spark: SparkSession, path: str, recipes: DataFrame | None = None) -> DataFrame:
    """``id, start, n, ids`` (binary, 32-bit little-endian) rebuilt from chunks; pass filtered recipes to read some."""
    steps = _steps(recipes if recipes is not None else read_recipes(spark, path))
    kind = steps.select("id").dtypes[0][1]
    whole = steps.join(read_chunks(spark, path), "key", "left").groupBy("part", "row", "start", "id", "doc_n").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "body"))).alias("c"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [b"".join(unpack_ids(x["body"], x["n"]).tobytes() for x in c) for c in b.column("c").to_pylist()]
            if any(len(x) != 4 * n for x, n in zip(ids, b.column("n").to_pylist())):
                raise ValueError("a chunk of a recipe is missing")
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("start"), b.column("n"), pa.array(ids, pa.binary())], ["id", "start", "n", "ids"])

    return whole.select("id", "start", F.col("doc_n").alias("n"), "c").mapInArrow(build, f"id {kind}, start long, n long, ids binary")


def _shift_tables() -> np.ndarray:
    """[k][byte place][byte]: a CRC-32 moved over 4 * 2**k zero bytes (one linear map per power of two)."""
    poly = 0xEDB88320
    one = []
    for bit in range(32):  # over one zero bit, 8 times: one byte; then squared
        v = 1 << bit
        for _ in range(32):
            v = (v >> 1) ^ (poly if v & 1 else 0)
        one.append(v)
    out = np.zeros((40, 4, 256), np.uint32)
    cols = one
    for k in range(40):
        for place in range(4):
            for byte in range(256):
                v = 0
                for bit in range(8):
                    if byte >> bit & 1:
                        v ^= cols[8 * place + bit]
                out[k, place, byte] = v
        apply = lambda x, t=out[k]: int(t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24])
        cols = [apply(c) for c in cols]
    return out


_SHIFT: np.ndarray | None = None


def combine_crcs(crcs: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
    """CRC-32 of each document from those of its chunks (``sizes`` in ids of four bytes): crc(ab) = shift(crc(a), b) ^ crc(b)."""
    global _SHIFT
    if _SHIFT is None:
        _SHIFT = _shift_tables()
    out = np.array([c[0] for c in crcs], np.uint32)
    live = np.array([i for i, c in enumerate(crcs) if len(c) > 1], np.int64)
    pos = 1
    while len(live):
        v, size = out[live], np.array([sizes[i][pos] for i in live], np.int64)
        k = 0
        while (size >> k).any():
            moved = _SHIFT[k, 0][v & 255] ^ _SHIFT[k, 1][v >> 8 & 255] ^ _SHIFT[k, 2][v >> 16 & 255] ^ _SHIFT[k, 3][v >> 24]
            v = np.where((size >> k) & 1 == 1, moved, v)
            k += 1
        out[live] = v ^ np.array([crcs[i][pos] for i in live], np.uint32)
        pos += 1
        live = np.array([i for i in live if len(crcs[i]) > pos], np.int64)
    return out


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of every document, from the stored files.

    Every chunk is opened once and checked against its key; only its size and checksum travel to the documents that
    hold it, where checksums combine in recipe order to that of all ids.
    """
    chunks = read_chunks(spark, path).mapInArrow(_opened, "key binary, size long, crc long")
    steps = _steps(read_recipes(spark, path))
    kind = steps.select("id").dtypes[0][1]
    held = steps.join(chunks, "key", "left").groupBy("part", "row", "start", "id", "doc_n").agg(F.array_sort(F.collect_list(F.struct("pos", "size", "crc"))).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c = b.column("c")
            flat, off = c.flatten(), c.offsets.to_numpy() - c.offsets[0].as_py()
            if flat.field("crc").null_count:
                raise ValueError("a chunk of a recipe is missing")
            crc, size = flat.field("crc").to_numpy(zero_copy_only=False), flat.field("size").to_numpy(zero_copy_only=False)
            crcs, sizes = np.split(crc, off[1:-1]), np.split(size, off[1:-1])
            total = np.array([s.sum() for s in sizes])
            if (total != b.column("doc_n").to_numpy()).any():
                raise ValueError("sizes of chunks and recipe differ")
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("start"), pa.array(total.astype(np.int64)), pa.array(combine_crcs(crcs, sizes).astype(np.int64))], ["id", "start", "n_tokens", "ids_crc32"])

    return held.select("id", "start", "doc_n", "c").mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long")


def store_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Write the store and read it back: ``doc_id, start, n_tokens, ids_crc32``.

    Texts are encoded in independent units by the library's own pattern and merges (see ``units``), equal to encoding
    them whole.

    A null or empty text is the end id alone. Null ids come first. Rows that repeat an id are documents of their own,
    in order of size and content. Empty input gives an empty store and result. Other columns are not read.
    """
    path = write_store(docs, None, tokenizer, id_col, text_col)
    return digests(docs.sparkSession, path).withColumnRenamed("id", id_col)
