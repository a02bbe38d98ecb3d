"""Compressed lengths of text windows under zstandard dictionaries."""

from __future__ import annotations

import numpy as np
import zstandard

#: Fixed value: ASCII letters stay, every other ASCII byte becomes a space.
_LETTERS = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in range(256))


def normal(text: str) -> bytes:
    """Lower case, with one space for each run of ASCII characters that are no letters."""
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    """A compressor with ``dictionary`` as digested raw content.

    Matches of four bytes count: the evidence is in short endings and words.
    """
    params = zstandard.ZstdCompressionParameters.from_level(level, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=content)


def spread(data: bytes, size: int, places: int) -> bytes:
    """``size`` bytes of ``data`` from ``places`` places between its begin and its end, or
    all of it."""
    if len(data) <= size:
        return data
    width = max(1, (size - places + 1) // places)
    return b" ".join(data[at : at + width] for at in (i * (len(data) - width) // (places - 1) for i in range(places)))


def windows(data: bytes, width: int) -> list[bytes]:
    """Consecutive windows of at least ``width`` bytes that end at a space, over the
    whole text; the last takes what is left.  An empty text has no window."""
    out, at, n = [], 0, len(data)
    while n - at > 2 * width:
        end = data.find(b" ", at + width, at + 2 * width)
        end = at + width if end < 0 else end + 1
        out.append(data[at:end])
        at = end
    if at < n:
        out.append(data[at:])
    return out


def lengths(parts: list[bytes], by: zstandard.ZstdCompressor) -> np.ndarray:
    """Compressed length of each window."""
    return np.fromiter((len(by.compress(p)) for p in parts), np.int64, len(parts))
