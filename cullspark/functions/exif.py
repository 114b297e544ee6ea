"""Capture times from the bytes of images: the tags of a TIFF header, found by the markers of a JPEG or the chunks of a PNG.

Only the directories are read: the first one and the Exif directory that it points to. A directory that points to
itself, an offset beyond the bytes at hand or a count that doesn't fit leaves its tags out, it never raises, so the
beginning of a file is enough where the header lies there.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalar as S

# Fixed values of the formats: tags, the type of texts, marks of a JPEG and a PNG.
DATE, ORIGINAL, DIGITIZED, EXIF = 0x0132, 0x9003, 0x9004, 0x8769
TEXT, SHORT, LONG = 2, 3, 4
APP1, SCAN, END = 0xE1, 0xDA, 0xD9
EXIF_MARK, PNG_MARK, PNG_EXIF = b"Exif\0\0", b"\x89PNG\r\n\x1a\n", b"eXIf"
#: Entries of a directory that are looked at.
MOST_ENTRIES = 4096

TAGS = "original string, digitized string, exif string, tiff string"


def header_of(content: bytes) -> bytes | None:
    """The TIFF header within an image, or None."""
    if content[:4] in (b"II*\0", b"MM\0*"):
        return content
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(content) and content[at] == 0xFF:
            mark = content[at + 1]
            if mark == 0xFF:  # fill bytes
                at += 1
                continue
            if mark in (SCAN, END):
                return None
            if mark == 0x01 or 0xD0 <= mark <= 0xD8:  # marks without a length
                at += 2
                continue
            size = int.from_bytes(content[at + 2 : at + 4], "big")
            if size < 2:
                return None
            body = content[at + 4 : at + 2 + size]
            if mark == APP1 and body.startswith(EXIF_MARK):
                return body[len(EXIF_MARK) :]
            at += 2 + size
        return None
    if content[:8] == PNG_MARK:
        at = 8
        while at + 8 <= len(content):
            size, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
            if kind == PNG_EXIF:
                return content[at + 8 : at + 8 + size]
            at += 12 + size
    return None


def _directory(header: bytes, order: str, at: int) -> dict[int, tuple[int, int, bytes]]:
    """Tags of a directory: type, count and the four bytes of the value or its offset."""
    if not 8 <= at <= len(header) - 2:
        return {}
    (n,) = struct.unpack_from(order + "H", header, at)
    out: dict[int, tuple[int, int, bytes]] = {}
    for k in range(min(n, MOST_ENTRIES)):
        entry = at + 2 + 12 * k
        if entry + 12 > len(header):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", header, entry)
        out.setdefault(tag, (kind, count, header[entry + 8 : entry + 12]))
    return out


def _text(header: bytes, order: str, entry: tuple[int, int, bytes] | None) -> str | None:
    if entry is None or entry[0] != TEXT:
        return None
    _, count, value = entry
    if count > 4:
        (at,) = struct.unpack(order + "I", value)
        if at + count > len(header):
            return None
        value = header[at : at + count]
    return value[:count].partition(b"\0")[0].decode("latin-1")


def _offset(order: str, entry: tuple[int, int, bytes] | None) -> int:
    if entry is None or entry[1] != 1 or entry[0] not in (SHORT, LONG):
        return 0
    return struct.unpack(order + "H", entry[2][:2])[0] if entry[0] == SHORT else struct.unpack(order + "I", entry[2])[0]


def times_of(content: bytes | None) -> tuple[str | None, str | None, str | None, str | None]:
    """Texts of the tags original, digitized and date of the Exif directory, and date of the first one."""
    header = header_of(content) if content else None
    if not header or header[:4] not in (b"II*\0", b"MM\0*") or len(header) < 8:
        return None, None, None, None
    order = "<" if header[:2] == b"II" else ">"
    (first,) = struct.unpack_from(order + "I", header, 4)
    main = _directory(header, order, first)
    at = _offset(order, main.get(EXIF))
    inner = _directory(header, order, at) if at != first else {}
    return *(_text(header, order, inner.get(t)) for t in (ORIGINAL, DIGITIZED, DATE)), _text(header, order, main.get(DATE))


def _times(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([times_of(None if c is None else bytes(c)) for c in content], columns=["original", "digitized", "exif", "tiff"], dtype=object)


_times.__annotations__ = {"content": pd.Series, "return": pd.DataFrame}


def tags(content: Column) -> Column:
    """original, digitized, exif and tiff: the time tags of images in a binary column; null where there are none."""
    return F.pandas_udf(_times, TAGS)(content)


def captured_at(content: Column, zone: str = "UTC") -> Column:
    """Milliseconds of the first tag that isn't empty; a tag that is no time gives null, and the next isn't asked."""
    t = tags(content)
    first = F.coalesce(*(F.nullif(t[c], F.lit("")) for c in ("original", "digitized", "exif", "tiff")))
    return S.exif_millis(first, zone)
