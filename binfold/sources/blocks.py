"""Block-compressed files: gzip members of at most 64 KB that name their own size, so a reader can begin at any of them."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

from pyarrow import fs

#: Fixed values of the format: first bytes of a block, name of the field that holds its size, most bytes in a block.
MAGIC, SIZE_FIELD, MOST = b"\x1f\x8b\x08\x04", b"BC", 65280


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a path or address as Spark writes them (``file:/a`` has one slash)."""
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_files(path: str, ending: str) -> list[tuple[str, int]]:
    """Files below a path with an ending, and their sizes, in order; names that begin with ``_`` or ``.`` are no data."""
    system, inner = locate(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    hidden = lambda p: any(x[:1] in ("_", ".") for x in p[len(inner) :].strip("/").split("/"))
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(ending) and not hidden(f.path))


def block(data: bytes, level: int = 6) -> bytes:
    """One block of at most ``MOST`` bytes of data; no data gives the mark that ends a file."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = len(body) + 25
    return MAGIC + struct.pack("<IBBH", 0, 0, 255, 6) + SIZE_FIELD + struct.pack("<HH", 2, size) + body + struct.pack("<II", zlib.crc32(data), len(data))


def block_size(head: bytes, at: int = 0) -> int | None:
    """Size of the block that begins at ``at``, or None if none does (or its head is cut off)."""
    if head[at : at + 4] != MAGIC or len(head) < at + 18:
        return None
    end = at + 12 + struct.unpack_from("<H", head, at + 10)[0]
    field = at + 12
    while field + 6 <= min(end, len(head)):
        length = struct.unpack_from("<H", head, field + 2)[0]
        if head[field : field + 2] == SIZE_FIELD and length == 2:
            return struct.unpack_from("<H", head, field + 4)[0] + 1
        field += 4 + length
    return None


class BlockReader:
    """Blocks of a file from any offset; counts the compressed bytes it reads."""

    def __init__(self, path: str):
        system, inner = locate(path)
        self.file = system.open_input_file(inner)
        self.size, self.bytes_read = self.file.size(), 0
        self._window, self._at = b"", 0

    def _bytes(self, at: int, n: int) -> bytes:
        if not self._at <= at or at + n > self._at + len(self._window):
            self._window, self._at = self.file.read_at(min(max(n, 1 << 18), self.size - at), at), at
            self.bytes_read += len(self._window)
        return self._window[at - self._at : at - self._at + n]

    def first_block(self, at: int) -> int:
        """Offset of the first block at or after ``at`` (the size of the file if there is none).

        The first bytes of a block may also occur in compressed data, so the block after it must begin as one too.
        """
        while at < self.size:
            window = self._bytes(at, min(1 << 17, self.size - at))
            found = window.find(MAGIC)
            while found >= 0:
                size = block_size(self._bytes(at + found, min(64, self.size - at - found)))
                if size:
                    after = at + found + size
                    if after == self.size or (after < self.size and block_size(self._bytes(after, min(64, self.size - after)))):
                        return at + found
                found = window.find(MAGIC, found + 1)
            at += max(1, len(window) - 3)
        return self.size

    def inflate(self, at: int) -> tuple[bytes, int]:
        """Data of the block at ``at``, and where the next one begins."""
        size = block_size(self._bytes(at, min(64, self.size - at)))
        raw = self._bytes(at, size or 0) if size else b""
        if not size or len(raw) < size:
            raise ValueError(f"no whole block at offset {at}")
        head = 12 + struct.unpack_from("<H", raw, 10)[0]
        data = zlib.decompress(raw[head:-8], -15)
        crc, length = struct.unpack_from("<II", raw, size - 8)
        if length != len(data) or crc != zlib.crc32(data):
            raise ValueError(f"damaged block at offset {at}")
        return data, at + size

    def blocks(self, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        """``(offset, data)`` of blocks that begin in a range; ``start`` is the beginning of one."""
        while start < min(end, self.size):
            data, after = self.inflate(start)
            yield start, data
            start = after

    def close(self) -> None:
        self.file.close()


class BlockWriter:
    """Writes bytes as blocks; a place in the file is the offset of a block times 2**16 plus a place in its data."""

    def __init__(self, out):
        self.out, self.at, self._data = out, 0, bytearray()

    def place(self) -> int:
        return self.at << 16 | len(self._data)

    def write(self, data: bytes) -> None:
        self._data += data
        done = 0
        while len(self._data) - done >= MOST:
            self._pack(self._data[done : done + MOST])
            done += MOST
        del self._data[:done]

    def _pack(self, data: bytearray) -> None:
        packed = block(bytes(data))
        self.out.write(packed)
        self.at += len(packed)

    def close(self) -> None:
        if self._data:
            self._pack(self._data)
        self.out.write(block(b""))
        self.out.close()
