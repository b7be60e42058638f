"""Packing documents into training sequences by bounded-space online packing.

Each task reads its documents in order and keeps a fixed number of open windows. A document longer than a window
is cut into full windows and a rest; rests and shorter documents stay whole. Each goes best-fit into the open
window that it leaves fullest. Where none has room, the fullest window is emitted and a new one is opened. The
windows still open at the ends of the tasks are finally merged with each other, several thousand to a task.
There is no shuffle but that of the leftovers' sizes: one short row for each window left open.

Null and empty texts are documents of one id, the end id. Repeated rows are packed each on its own. An empty
table gives no sequences. Columns other than doc_id and text don't matter.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import common, tokens, workers

WINDOW = 2048
OPEN_WINDOWS = 128
#: Windows left open that one task merges.
MERGED_PER_TASK = 4096
#: Documents that a worker gets at once.
DOCUMENTS_AT_ONCE = 10_000
TOKENIZER = "byte_bpe_50k.json"
END_ID = 1


class OpenWindows:
    """The open windows of one task, by free space."""

    def __init__(self, window: int, limit: int):
        self.window, self.limit = window, limit
        self.free: list[tuple[int, int]] = []  # (free places, window), ascending
        self.opened = 0

    def place(self, size: int) -> tuple[int, int, int | None]:
        """(window, offset, window emitted for it or None) of a piece of up to a window's size."""
        out = None
        if size == self.window:
            self.opened += 1
            return self.opened - 1, 0, None
        at = bisect.bisect_left(self.free, (size, -1))
        if at < len(self.free):
            room, k = self.free.pop(at)
        else:
            if len(self.free) >= self.limit:
                out = self.free.pop(0)[1]
            room, k = self.window, self.opened
            self.opened += 1
        if room - size:
            bisect.insort(self.free, (room - size, k))
        return k, self.window - room, out


def pack_sizes(sizes: list[int], window: int, limit: int) -> list[tuple[int, int]]:
    """(window, offset) of each piece."""
    w = OpenWindows(window, limit)
    return [w.place(n)[:2] for n in sizes]


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, left_open boolean"


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = END_ID,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    with_ids: bool = True,
    name: str = "packing",
    added_tokens: bool = False,
    frugal: bool = False,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (int array).

    frugal: workers take a twentieth as many documents at once and forget words with their task, which takes a fifth more
    time; for use among other operators, whose workers share an executor's memory.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        w = OpenWindows(window, open_windows)
        waiting: dict[int, list[tuple]] = {}  # rows of the open windows
        ready: list[tuple] = []

        def flush(rows: list[tuple], left_open: bool) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 8
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array([left_open] * len(rows), pa.bool_())]
            names = [x.split()[0] for x in PIECE.split(", ")]
            if with_ids:
                arrays.append(pa.array(cols[7], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        held = 0
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for doc_id, ids in zip(doc_ids, tokens.encode_documents(batch.column("text"), tokenizer, end_id, added_tokens=added_tokens, frugal=frugal)):
                n = len(ids)
                for start in range(0, n, window):
                    piece = ids[start : start + window]
                    k, offset, out = w.place(len(piece))
                    row = (doc_id, start, len(piece), tokens.crc32(piece), n, task | k, offset, piece if with_ids else None)
                    if out is not None:
                        ready += waiting.pop(out)
                    rows = waiting.setdefault(k, [])
                    rows.append(row)
                    if offset + len(piece) == window:
                        ready += waiting.pop(k)
                    held += len(piece)
                if held > 2_000_000:
                    if ready:
                        yield flush(ready, False)
                    ready, held = [], 0
        if ready:
            yield flush(ready, False)
        if frugal:
            workers.forget()
            workers.trim()
        left = [r for rows in waiting.values() for r in rows]
        if left:
            yield flush(left, True)

    schema = PIECE + (", ids array<int>" if with_ids else "")
    with common.batches_of(spark, DOCUMENTS_AT_ONCE // (20 if frugal else 1)):
        pieces = common.materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema), name)
    moved = merge_open(pieces, window)
    rest = ["ids"] if with_ids else []
    first = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    done = pieces.where("not left_open").select(*first, F.col("window").alias("sequence_id"), "offset", *rest)
    merged = pieces.where("left_open").join(moved, "window").select(*first, "sequence_id", (F.col("offset") + F.col("base")).alias("offset"), *rest)
    return done.unionByName(merged)


def merge_open(pieces: DataFrame, window: int) -> DataFrame:
    """(window, sequence_id, base) of each window left open: where its pieces go when such windows are merged."""
    fills = pieces.where("left_open").groupBy("window").agg(F.sum("length").alias("fill"))
    fills = common.materialize(fills, "packing-open")
    parts = max(1, -(-fills.count() // MERGED_PER_TASK))

    def run(frames):
        import pandas as pd

        rows = pd.concat([pd.DataFrame({"window": [], "fill": []}, dtype="int64"), *frames])
        rows = rows.sort_values(["fill", "window"], ascending=[False, True])
        placed = pack_sizes(rows["fill"].tolist(), window, len(rows) + 1)
        names = rows["window"].tolist()
        lead: dict[int, int] = {}  # a merged window takes the name of the first that went in
        out = [(name, lead.setdefault(k, name), base) for name, (k, base) in zip(names, placed)]
        yield pd.DataFrame(out, columns=["window", "sequence_id", "base"]).astype(np.int64)

    return fills.repartition(parts, F.xxhash64("window")).mapInPandas(run, "window long, sequence_id long, base long")


def packed(docs: DataFrame, with_ids: bool = False, tokenizer_path: Callable[[str], str] = tokens.default_path, frugal: bool = False) -> DataFrame:
    return pack(docs, tokenizer_path(TOKENIZER), END_ID, WINDOW, OPEN_WINDOWS, with_ids, added_tokens=True, frugal=frugal)


def op6(spark, sf_dir):
    return packed(common.table(spark, sf_dir, "documents"))
