"""Files of independent Zstandard frames with an index and a seek table at the end.

Layout: data frames; one skippable frame with the compressed index (three little-endian int64 arrays: key, frame,
offset in the decompressed frame, and a fourth: length); one skippable frame with the seek table in Zstandard's
public seekable format (sizes of each frame, and a checksum: the low 32 bits of XXH64 of its content). Plain
decompressors read the data and skip the rest; readers of some keys decompress only the frames that hold them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
import zstandard

from .common import file_size, open_input, open_output

#: Fixed values of the public formats.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
TABLE_END = 0x8F92EAB1
FRAME_BYTES = 1 << 20


class Writer:
    """Writes keyed pieces; a frame ends once it holds FRAME_BYTES, so no piece is divided."""

    def __init__(self, uri: str, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.out, self.most = open_output(uri), frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.table: list[tuple[int, int, int]] = []
        self.now: list[bytes] = []
        self.size = 0
        self.rows: list[tuple[int, int, int, int]] = []
        self.bytes = 0

    def add(self, key: int, piece: bytes) -> None:
        self.rows.append((key, len(self.table), self.size, len(piece)))
        self.now.append(piece)
        self.size += len(piece)
        if self.size >= self.most:
            self._flush()

    def _flush(self) -> None:
        data = b"".join(self.now)
        packed = self.zstd.compress(data)
        self._write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.now, self.size = [], 0

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def close(self) -> int:
        """Write what is left, the index and the seek table; bytes of the file."""
        if self.now:
            self._flush()
        index = self.zstd.compress(np.array(self.rows, "<i8").reshape(-1, 4).T.tobytes())
        self._write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        body = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0x80, TABLE_END)
        self._write(struct.pack("<II", SKIPPABLE_TABLE, len(body)) + body)
        self.out.close()
        return self.bytes


class Reader:
    """Random access to a file of frames."""

    def __init__(self, uri: str):
        self.file, size = open_input(uri), file_size(uri)
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != TABLE_END or not flags & 0x80:
            raise ValueError(f"{uri} has no seek table with checksums")
        start = size - 9 - 12 * n - 8
        self.table = np.frombuffer(self._at(start + 8, 12 * n), "<u4").reshape(n, 3)
        self.begin = np.concatenate([[0], np.cumsum(self.table[:, 0].astype(np.int64))])
        kind, length = struct.unpack("<II", self._at(int(self.begin[-1]), 8))
        if kind != SKIPPABLE_INDEX:
            raise ValueError(f"{uri} has no index")
        self.zstd = zstandard.ZstdDecompressor()
        index = self.zstd.decompress(self._at(int(self.begin[-1]) + 8, length))
        self.index = np.frombuffer(index, "<i8").reshape(4, -1)

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        packed, size, check = (int(x) for x in self.table[k])
        data = self.zstd.decompress(self._at(int(self.begin[k]), packed), max_output_size=size) if size else b""
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def pieces(self, keys: Iterable[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(key, piece) in file order, of some keys or all; frames without them are not decompressed."""
        key, frame, offset, length = self.index
        rows = np.arange(len(key)) if keys is None else np.flatnonzero(np.isin(key, np.fromiter(keys, np.int64)))
        at, data = -1, b""
        for r in rows.tolist():
            if frame[r] != at:
                at, data = int(frame[r]), self.frame(int(frame[r]))
            yield int(key[r]), data[offset[r] : offset[r] + length[r]]

    def close(self) -> None:
        self.file.close()
