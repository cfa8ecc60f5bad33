"""Token ids as packed binary matrices: best-fit decreasing with a segment tree.

Documents are tokenised and cut losslessly into runs of at most the row length. A window of runs
is packed longest first; a segment tree over the possible capacities left finds the fullest open
row with room in logarithmic time. A row holds its ids (little-endian unsigned 32-bit, padded to
full length), the cumulative segment lengths and the positions, which start again at each segment.
Documents have numbers of their own, so rows that repeat an id can be told apart again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffer
from .tokens import END_ID, encoder

WINDOW_TOKENS = 1 << 22


class CapacityTree:
    """Counts of open rows by capacity left; ``fit`` finds the smallest one that is enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, left: int, by: int) -> None:
        at = self.size + left
        while at:
            self.count[at] += by
            at >>= 1

    def fit(self, need: int) -> int:
        """The least capacity of at least ``need`` that an open row has, or -1."""
        at = self.size + need
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of run numbers. Ties go in order of the runs."""
    tree, rows, open_ = CapacityTree(capacity), [], {}
    left: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        room = tree.fit(n)
        if room < 0:
            row = len(rows)
            rows.append([i])
            left.append(capacity - n)
        else:
            row = open_[room].pop()
            tree.add(room, -1)
            rows[row].append(i)
            left[row] = room - n
        if left[row]:
            open_.setdefault(left[row], []).append(row)
            tree.add(left[row], 1)
    return rows


def token_matrix(df: DataFrame, tokenizer_path: str, row_length: int = 4096, id_col: str = "doc_id", text_col: str = "text", window_tokens: int = WINDOW_TOKENS, pad_id: int = 0) -> DataFrame:
    """One row per packed sequence: ``sequence_id, input_ids binary, n_tokens, cu_seqlens
    array<int>, position_ids binary, doc_ids array<long>, doc_nos array<long>, pieces array<int>``.

    A document's ids end with END_ID; a null text is empty, so END_ID alone. Runs longer than a
    row are cut, and (doc_nos, pieces) puts them together again. Each window of
    ``window_tokens`` inside a partition is packed by itself, so nothing is shuffled and memory is
    bounded. Null ids and repeated rows are packed like others; other columns, whatever their names,
    are ignored; an empty table has no sequences.
    """
    schema = pa.schema([("sequence_id", pa.int64()), ("input_ids", pa.binary()), ("n_tokens", pa.int64()), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_nos", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32()))])
    end, width = np.array([END_ID], "<u4").tobytes(), 4 * row_length
    pad, count_up = np.array([pad_id], "<u4").tobytes(), np.arange(row_length, dtype="<u4").tobytes()

    def run(batches):
        enc, number = encoder(tokenizer_path), TaskContext.get().partitionId() << 36
        runs: list[tuple] = []
        held, doc_no = 0, number

        def flush():
            nonlocal runs, held, number
            out: list[tuple] = []
            for row in best_fit_decreasing([len(r[2]) // 4 for r in runs], row_length):
                parts = [runs[i] for i in row]
                sizes = [len(p[2]) for p in parts]
                gap = width - sum(sizes)
                cumulative = np.concatenate(([0], np.cumsum(sizes))) // 4
                out.append((number, b"".join([p[2] for p in parts]) + pad * (gap // 4), sum(sizes) // 4, cumulative.tolist(), b"".join([count_up[:n] for n in sizes]) + b"\0" * gap, [p[0] for p in parts], [p[3] for p in parts], [p[1] for p in parts]))
                number += 1
                if len(out) == 256:
                    yield out
                    out = []
            if out:
                yield out
            runs, held = [], 0

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            docs = batch.column(0).to_pylist()
            buf, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets, 1 << 21):
                base = int(offsets[lo])
                ids, at = enc.buffer(buf[base : offsets[hi]], offsets[lo : hi + 1] - base)
                every, at = ids.tobytes(), (4 * at).tolist()
                for doc, a, b in zip(docs[lo:hi], at[:-1], at[1:], strict=True):
                    raw = every[a:b] + end
                    runs += [(doc, k, raw[cut : cut + width], doc_no) for k, cut in enumerate(range(0, len(raw), width))]
                    doc_no += 1
                    held += len(raw) // 4
                    if held >= window_tokens:
                        yield from map(batch_of, flush())
        if runs:
            yield from map(batch_of, flush())

    ddl = "sequence_id long, input_ids binary, n_tokens long, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, doc_nos array<long>, pieces array<int>"
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl)


def write_packed(df: DataFrame, tokenizer_path: str, path: str, **options) -> None:
    """Write the packed matrix as Parquet."""
    token_matrix(df, tokenizer_path, **options).write.mode("overwrite").parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """``doc_id, ids`` from a packed matrix: one row for each row that was packed, its runs put
    together again, with END_ID; null and repeated ids too. An empty matrix gives no rows."""

    def run(batches):
        for batch in batches:
            rows = []
            for ids, cuts, docs, nos, pieces in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                rows += [(d, n, p, ids[4 * a : 4 * b]) for d, n, p, a, b in zip(docs, nos, pieces, cuts[:-1], cuts[1:], strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "no", "piece", "ids"])

    runs = packed.select("input_ids", "cu_seqlens", "doc_ids", "doc_nos", "pieces").mapInArrow(run, "doc_id long, no long, piece int, ids binary")
    whole = F.array_sort(F.collect_list(F.struct("piece", "ids")))
    found = runs.groupBy("no").agg(F.first("doc_id").alias("doc_id"), F.transform(whole, lambda x: x["ids"]).alias("parts"))
    return found.select("doc_id", F.expr("aggregate(parts, X'', (x, y) -> x || y)").alias("ids"))
