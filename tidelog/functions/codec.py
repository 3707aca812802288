"""Byte layouts of log and run files, for import and export.

All numbers are little-endian. A log record is crc32, key length, value length, op,
key, value; the checksum covers what follows it. A run record is the same without the
checksum. An index entry is key length, key, 64-bit place of the record.
"""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

PUT, DELETE = 0, 1
LOG_HEAD, RUN_HEAD = 13, 9
FOOTER = 16
SPARSE_STRIDE = 16


class LogRecord(NamedTuple):
    key: bytes
    value: bytes | None
    op: int
    size: int


def u32(n: int) -> bytes:
    return struct.pack("<I", n)


def u64(n: int) -> bytes:
    return struct.pack("<Q", n)


def read_u32(raw: bytes, at: int = 0) -> int:
    return struct.unpack_from("<I", raw, at)[0]


def read_u64(raw: bytes, at: int = 0) -> int:
    return struct.unpack_from("<Q", raw, at)[0]


def run_record(key: bytes, value: bytes | None, op: int = PUT) -> bytes:
    value = b"" if op else value or b""
    return struct.pack("<IIB", len(key), len(value), op) + key + value


def log_record(key: bytes, value: bytes | None, op: int = PUT) -> bytes:
    body = run_record(key, value, op)
    return u32(zlib.crc32(body)) + body


def index_entry(key: bytes, place: int) -> bytes:
    return u32(len(key)) + key + u64(place)


def log_record_size(head: bytes) -> int:
    """Bytes of the log record that begins with this head."""
    return LOG_HEAD + read_u32(head, 4) + read_u32(head, 8)


def run_record_size(head: bytes) -> int:
    return RUN_HEAD + read_u32(head) + read_u32(head, 4)


def read_log_record(raw: bytes, at: int = 0) -> LogRecord | str:
    """The record at a place, or why there is none: short_header, short_body or crc."""
    if len(raw) - at < LOG_HEAD:
        return "short_header"
    crc, n_key, n_value, op = struct.unpack_from("<IIIB", raw, at)
    end = at + LOG_HEAD + n_key + n_value
    if end > len(raw):
        return "short_body"
    if zlib.crc32(raw[at + 4 : end]) != crc:
        return "crc"
    key = raw[at + LOG_HEAD : at + LOG_HEAD + n_key]
    op = DELETE if op else PUT  # any other number deletes
    return LogRecord(key, None if op else raw[end - n_value : end], op, end - at)


def read_run_record(raw: bytes, at: int, end: int) -> tuple[bytes, bytes | None, int, int] | None:
    """key, value, op, size; None at the end."""
    if end - at < RUN_HEAD:
        return None
    n_key, n_value, op = struct.unpack_from("<IIB", raw, at)
    size = RUN_HEAD + n_key + n_value
    if at + size > end:
        raise ValueError(f"a run record at {at} is cut off")
    key = raw[at + RUN_HEAD : at + RUN_HEAD + n_key]
    return key, None if op else raw[at + size - n_value : at + size], DELETE if op else PUT, size


def log_name(number: int) -> str:
    return f"wal_{number:08d}.log"


def run_name(number: int) -> str:
    return f"sst_{number:08d}.sst"
