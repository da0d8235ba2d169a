"""Members of block-compressed gzip files."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

# Fixed values of the format.
MAX_SIZE = 65_536
EOF_MARKER = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


class FormatError(ValueError):
    """A file that breaks its format; says where."""


@dataclass(frozen=True)
class Member:
    offset: int
    raw: bytes  #: the whole member

    @property
    def size(self) -> int:
        return struct.unpack_from("<I", self.raw, len(self.raw) - 4)[0]

    @property
    def is_eof(self) -> bool:
        return self.raw == EOF_MARKER

    def inflate(self, path: str) -> bytes:
        try:
            data = zlib.decompress(self.raw, 31, max(1, min(self.size, MAX_SIZE)))
        except zlib.error as e:
            raise FormatError(f"{path}: cannot inflate the member at {self.offset}: {e}") from e
        if len(data) != self.size:
            raise FormatError(f"{path}: the member at {self.offset} inflates to {len(data)} bytes, not {self.size}")
        return data


def _need(file, n: int, path: str, at: int, what: str) -> bytes:
    data = file.read(n)
    if len(data) < n:
        raise FormatError(f"{path}: truncated while reading {what} of the member at {at}")
    return data


def member_size(extra: bytes, path: str, at: int) -> int:
    """Total size of a member, from the only BC subfield of its extra field."""
    size, i = None, 0
    while i < len(extra):
        if i + 4 > len(extra):
            raise FormatError(f"{path}: truncated extra subfield in the member at {at}")
        length = struct.unpack_from("<H", extra, i + 2)[0]
        if i + 4 + length > len(extra):
            raise FormatError(f"{path}: an extra subfield overruns the member at {at}")
        if extra[i : i + 2] == b"BC":
            if size is not None or length != 2:
                raise FormatError(f"{path}: {'duplicate' if size is not None else 'malformed'} BGZF BC subfield in the member at {at}")
            size = struct.unpack_from("<H", extra, i + 4)[0] + 1
        i += 4 + length
    if size is None:
        raise FormatError(f"{path}: missing BGZF BC subfield in the member at {at}")
    return size


def _check_options(body: bytes, flags: int, path: str, at: int) -> None:
    """Name and comment must end, and all optional fields lie before the trailer."""
    i, end = 0, len(body) - 8
    for bit, what in ((0x08, "name"), (0x10, "comment")):
        if flags & bit:
            stop = body.find(b"\0", i, end)
            if stop < 0:
                raise FormatError(f"{path}: unterminated {what} in the member at {at}")
            i = stop + 1
    if flags & 0x02 and i + 2 > end:
        raise FormatError(f"{path}: truncated header checksum in the member at {at}")


def read_member(file, path: str) -> Member | None:
    """The member at the file's position; None at the end of the file."""
    at = file.tell()
    first = file.read(1)
    if not first:
        return None
    head = first + _need(file, 11, path, at, "the header")
    if head[:2] != b"\x1f\x8b":
        raise FormatError(f"{path}: no gzip member at {at}")
    if head[2] != 8:
        raise FormatError(f"{path}: unknown compression method {head[2]} at {at}")
    if head[3] & 0xE0:
        raise FormatError(f"{path}: reserved flags are set at {at}")
    if not head[3] & 0x04:
        raise FormatError(f"{path}: no extra field, so no BGZF member at {at}")
    extra = _need(file, struct.unpack_from("<H", head, 10)[0], path, at, "the extra field")
    rest = member_size(extra, path, at) - 12 - len(extra)
    if rest < 8:
        raise FormatError(f"{path}: the size of the member at {at} is less than its header and trailer")
    body = _need(file, rest, path, at, "the data")
    _check_options(body, head[3], path, at)
    out = Member(at, head + extra + body)
    if out.size > MAX_SIZE:
        raise FormatError(f"{path}: the member at {at} inflates to more than {MAX_SIZE} bytes")
    return out


def data_end(file) -> int:
    """Where the data ends: one end marker at the end of the file does not count."""
    size = file.size()
    if size < len(EOF_MARKER):
        return size
    file.seek(size - len(EOF_MARKER))
    return size - len(EOF_MARKER) if file.read(len(EOF_MARKER)) == EOF_MARKER else size


def deflate(data: bytes, level: int = 6) -> bytes:
    """One member that holds up to 65,280 bytes."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    return struct.pack("<4BI2BH2sHH", 31, 139, 8, 4, 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))
