"""Content-defined chunking by a Rabin fingerprint over a window of ``min`` bytes.

A position is an anchor if the fingerprint of the window that ends there is 0 modulo ``avg``. For
an odd base the test is a difference of prefix sums, as the base has an inverse; for an even one
only the last few bytes count. From a chunk's start the first anchor at ``min`` or more bytes
ends it, ``max`` at the latest; a rest shorter than ``min`` is the last chunk.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_BYTES = 1 << 20
#: About what a row takes beside its bytes.
ROW_BYTES = 128


def check_sizes(least: int, avg: int, most: int) -> None:
    if any(x < 1 or x & (x - 1) for x in (least, avg, most)) or least > most:
        raise ValueError("min, avg and max must be powers of two, min not above max")


def anchors(data: bytes, least: int, avg: int, base: int = 257, byte_mode: str = "signed", block: int = 1 << 22) -> np.ndarray:
    """Ends of the windows whose fingerprint is 0, ascending."""
    if byte_mode not in ("signed", "unsigned"):
        raise ValueError("byte_mode is 'signed' or 'unsigned'")
    raw = np.frombuffer(data, np.int8 if byte_mode == "signed" else np.uint8)
    out = []
    if base % 2:
        inverse = pow(base, -1, avg) if avg > 1 else 0
        powers, x = [], 1 % avg
        while not powers or x != 1 % avg:
            powers.append(x)
            x = x * inverse % avg
        factors = np.array(powers, np.int64)
    # Blocks overlap by a window, so memory doesn't grow with the file.
    for lo in range(0, max(1, len(raw) - least + 1), block):
        part = raw[lo : lo + block + least - 1].astype(np.int64)
        if len(part) < least:
            break
        if base % 2:
            terms = part * np.resize(np.roll(factors, -(lo % len(factors))), len(part)) % avg
            sums = np.concatenate(([0], np.cumsum(terms)))
            value = sums[least:] - sums[:-least]
        else:
            value = np.zeros(len(part) - least + 1, np.int64)
            for k in range(least):
                factor = pow(base, k, avg)
                if not factor:
                    break
                value += part[least - 1 - k : len(part) - k] * factor
        out.append(np.flatnonzero(value % avg == 0) + lo + least)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def cuts(n: int, at: np.ndarray, least: int, most: int) -> list[int]:
    """Ends of the chunks of a file of ``n`` bytes."""
    ends, c = [], 0
    while c < n:
        if n - c < least:
            ends.append(n)
            break
        k = int(np.searchsorted(at, c + least))
        end = min(c + most, n)
        c = int(at[k]) if k < len(at) and at[k] <= end else end
        ends.append(c)
    return ends


def _files(batches):
    """Path and bytes of each file; null content is empty."""
    for batch in batches:
        for path, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield path, cell.as_py() or b""


def _gathered(rows, kinds: dict[str, pa.DataType]):
    """Batches of about BATCH_BYTES of rows: neither one for each small file nor a large file whole."""
    names, binary = list(kinds), [i for i, kind in enumerate(kinds.values()) if kind == pa.binary()]
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += ROW_BYTES + sum(len(row[i]) for i in binary)
        if size >= BATCH_BYTES:
            yield _batch(held, names, kinds)
            held, size = [], 0
    if held:
        yield _batch(held, names, kinds)


def _batch(held: list[tuple], names: list[str], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.values(), strict=True)], names)


def anchor_points(files: DataFrame, least: int, avg: int, base: int = 257, byte_mode: str = "signed") -> DataFrame:
    """``path, end_offset`` of all anchors."""
    check_sizes(least, avg, least)

    def rows(batches):
        for path, data in _files(batches):
            for end in anchors(data, least, avg, base, byte_mode):
                yield path, int(end)

    def run(batches):
        return _gathered(rows(batches), {"path": pa.string(), "end_offset": pa.int64()})

    return files.select("path", "content").mapInArrow(run, "path string, end_offset long")


def chunk(files: DataFrame, least: int, avg: int, most: int, base: int = 257, byte_mode: str = "signed", with_content: bool = False) -> DataFrame:
    """``path, chunk_no`` (from 1)``, start_offset, size, hash`` (base64 of SHA-256) and, on
    request, ``content``. A null or empty file has no chunks. ``min = avg = max`` cuts evenly."""
    check_sizes(least, avg, most)

    kinds = {"path": pa.string(), "chunk_no": pa.int32(), "start_offset": pa.int64(), "size": pa.int64(), "hash": pa.string()}
    if with_content:
        kinds["content"] = pa.binary()

    def rows(batches):
        for path, data in _files(batches):
            ends = cuts(len(data), anchors(data, least, avg, base, byte_mode), least, most)
            for no, (a, b) in enumerate(zip([0, *ends], ends, strict=False), 1):
                part = data[a:b]
                yield (path, no, a, b - a, base64.b64encode(hashlib.sha256(part).digest()).decode(), *[part] * with_content)

    def run(batches):
        return _gathered(rows(batches), kinds)

    return files.select("path", "content").mapInArrow(run, "path string, chunk_no int, start_offset long, size long, hash string" + ", content binary" * with_content)
