"""Token ids in binary shards, compressed by Re-Pair grammars.

Documents are range-partitioned and sorted by doc_id; each task encodes its range and writes blocks of documents.
A block's ids are cut into segments of bounded length, each with a grammar of its own: frequent pairs of symbols
are replaced by nonterminals again and again, many pairs to a round. A segment stores its rules, the length that
each rule expands to, and the remaining symbols, so any stretch of ids is decoded by skipping whole symbols.

Files: a Parquet table in the shared folder with a row for each block (part, block, n_docs, n_tokens, payload).
The payload is little-endian: b"RPG1", then unsigned 32-bit n_docs, base, segments; doc_ids (int64), flags of
null doc_ids (uint8), lengths (int64); then for each segment unsigned 32-bit counts of ids, rules and symbols and
the bytes of a symbol, followed by rules (two symbols each), expansion lengths (uint32) and symbols.

Null and empty texts hold the end id alone. Rows without doc_id come first; rows with equal doc_id are ordered by
a hash of their texts, then stand as they come (equal rows give equal ids). Empty tables give no rows. Texts of any
length are encoded whole; a long one's ids run over several segments. Columns other than doc_id and text don't matter.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import common, tokens

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SEGMENT_IDS = 1 << 19
#: Occurrences that a pair of symbols needs to become a rule.
MIN_COUNT = 16
_HASH_BITS = 20


def compress(ids: np.ndarray, base: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """(rules as an n x 2 array, symbols). Symbol base + k stands for rule k.

    Goes on until no pair occurs min_count times or no symbol is left (of 16 bits, if the base leaves any). Each round
    replaces all such pairs that can be replaced at once.
    """
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    made = 0
    room = (65536 if base < 65536 else 1 << 31) - base
    while len(seq) > 1 and made < room:
        pairs = _frequent(seq, min_count)[: room - made]
        if not len(pairs):
            break
        order = np.argsort(pairs)
        named = (base + made + order).astype(np.uint32)
        rules.append(np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        seq = _replace(seq, pairs[order], named)
        made += len(pairs)
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)), seq


def _buckets(seq: np.ndarray) -> np.ndarray:
    return (seq[:-1] * np.uint32(2654435761) + seq[1:] * np.uint32(2246822519)) >> np.uint32(32 - _HASH_BITS)


def _frequent(seq: np.ndarray, least: int) -> np.ndarray:
    """Codes (left << 32 | right) of pairs found `least` times or more that can be replaced at once, most frequent first.

    Pairs are counted in hashed buckets; only those of full buckets are counted exactly. In a run of one symbol every
    second place counts. A symbol ends up on the left or on the right of the pairs of a round, so their occurrences
    don't overlap; or in a pair with itself. Of pairs that exclude each other the more frequent one is taken.
    """
    bucket = _buckets(seq)
    full = np.bincount(bucket, minlength=1 << _HASH_BITS) >= least
    at = np.flatnonzero(full[bucket])
    if not len(at):
        return np.zeros(0, np.uint64)
    twins = np.flatnonzero(seq[at] == seq[at + 1])
    if len(twins):  # the places of a run after the first, third, ... don't count
        where = at[twins]
        first = np.flatnonzero(np.concatenate([[True], np.diff(where) != 1]))
        nth = np.arange(len(where)) - np.repeat(first, np.diff(np.append(first, len(where))))
        at = np.delete(at, twins[nth % 2 == 1])
    codes, counts = np.unique(seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1], return_counts=True)
    often = counts >= least
    codes, counts = codes[often], counts[often]
    codes = codes[np.argsort(-counts, kind="stable")]
    side: dict[int, int] = {}
    chosen = []
    for i, code in enumerate(codes.tolist()):
        x, y = code >> 32, code & 0xFFFFFFFF
        if x == y:
            if x not in side:
                side[x] = 2
                chosen.append(i)
        elif side.get(x, 0) == 0 and side.get(y, 1) == 1:
            side[x], side[y] = 0, 1
            chosen.append(i)
    return codes[chosen]


def _replace(seq: np.ndarray, pairs: np.ndarray, names: np.ndarray) -> np.ndarray:
    """pairs ascending; each occurrence becomes its name. In a run of one symbol every second place is taken."""
    wanted = np.zeros(1 << _HASH_BITS, bool)
    left, right = (pairs >> np.uint64(32)).astype(np.uint32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    wanted[(left * np.uint32(2654435761) + right * np.uint32(2246822519)) >> np.uint32(32 - _HASH_BITS)] = True
    at = np.flatnonzero(wanted[_buckets(seq)])
    codes = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
    k = np.minimum(np.searchsorted(pairs, codes), len(pairs) - 1)
    hit = pairs[k] == codes
    at, k = at[hit], k[hit]
    if not len(at):
        return seq
    first = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
    nth = np.arange(len(at)) - np.repeat(first, np.diff(np.concatenate([first, [len(at)]])))
    even = nth % 2 == 0
    at, k = at[even], k[even]
    out = seq.copy()
    out[at] = names[k]
    stay = np.ones(len(seq), bool)
    stay[at + 1] = False
    return out[stay]


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule stands for. Rules refer to earlier rules only."""
    out = np.ones(len(rules), np.int64)
    deep = rules.astype(np.int64) - base
    while len(rules):
        now = np.where(deep >= 0, out[np.maximum(deep, 0)], 1).sum(1)
        if (now == out).all():
            break
        out = now
    return out.astype(np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    seq = symbols.astype(np.int64)
    while True:
        deep = seq >= base
        if not deep.any():
            return seq.astype(np.uint32)
        size = 1 + deep
        end = np.cumsum(size)
        out = np.empty(int(end[-1]), np.int64)
        out[end - size] = np.where(deep, rules[np.where(deep, seq - base, 0), 0] if len(rules) else 0, seq)
        out[end[deep] - 1] = rules[seq[deep] - base, 1]
        seq = out


def expand_segment(symbols: np.ndarray, rules: np.ndarray, spans: np.ndarray, base: int) -> np.ndarray:
    """The same for a whole segment: every rule is expanded once, then all symbols are looked up in one pass."""
    if not len(rules):
        return symbols.astype(np.uint32)
    known = expand(np.arange(base, base + len(rules)), rules, base)
    begins = np.cumsum(spans, dtype=np.int64) - spans
    rule = np.maximum(symbols.astype(np.int64) - base, 0)
    deep = symbols >= base
    sizes = np.where(deep, spans[rule], 1).astype(np.int64)
    source = np.where(deep, begins[rule], len(known) + np.arange(len(symbols)))
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32) + np.repeat((source - ends + sizes).astype(np.int32), sizes)
    return np.concatenate([known, symbols.astype(np.uint32)])[at]


def pack_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, base: int, segment: int = SEGMENT_IDS) -> bytes:
    cuts = range(0, len(ids), segment)
    parts = [b"RPG1", struct.pack("<III", len(doc_ids), base, len(cuts))]
    parts += [np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], "u1").tobytes(), np.array(lengths, "<i8").tobytes()]
    for cut in cuts:
        piece = ids[cut : cut + segment]
        rules, symbols = compress(piece, base)
        kind = "<u2" if base + len(rules) <= 65536 else "<u4"
        parts += [struct.pack("<IIII", len(piece), len(rules), len(symbols), int(kind[2])), rules.astype(kind).tobytes(), expansion_lengths(rules, base).astype("<u4").tobytes(), symbols.astype(kind).tobytes()]
    return b"".join(parts)


class BlockReader:
    """Reads a block's payload: all of it, or any stretch of its ids."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"RPG1":
            raise ValueError("not a block of token ids")
        n, self.base, segments = struct.unpack_from("<III", payload, 4)
        at = 16
        ids = np.frombuffer(payload, "<i8", n, at)
        nulls = np.frombuffer(payload, "u1", n, at + 8 * n)
        self.doc_ids = [None if z else x for x, z in zip(ids.tolist(), nulls.tolist())]
        self.lengths = np.frombuffer(payload, "<i8", n, at + 9 * n)
        at += 17 * n
        self.segments = []
        for _ in range(segments):
            size, n_rules, n_symbols, width = struct.unpack_from("<IIII", payload, at)
            kind, at = f"<u{width}", at + 16
            rules = np.frombuffer(payload, kind, 2 * n_rules, at).reshape(-1, 2)
            at += 2 * n_rules * width
            spans = np.frombuffer(payload, "<u4", n_rules, at)
            at += 4 * n_rules
            symbols = np.frombuffer(payload, kind, n_symbols, at)
            at += n_symbols * width
            self.segments.append((size, rules, spans, symbols))

    def __iter__(self) -> Iterator[np.ndarray]:
        """The ids of each segment."""
        for _, rules, spans, symbols in self.segments:
            yield expand_segment(symbols, rules, spans, self.base)

    def stretch(self, start: int, stop: int) -> np.ndarray:
        """ids[start:stop]; symbols outside it aren't expanded."""
        out, begin = [np.zeros(0, np.uint32)], 0
        for size, rules, spans, symbols in self.segments:
            lo, hi = max(start - begin, 0), min(stop - begin, size)
            if lo < hi:
                deep = symbols.astype(np.int64) - self.base
                ends = np.cumsum(np.where(deep >= 0, spans[np.maximum(deep, 0)] if len(spans) else 1, 1))
                i, j = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi, "left") + 1
                skipped = int(ends[i - 1]) if i else 0
                out.append(expand(symbols[i:j], rules, self.base)[lo - skipped : hi - skipped])
            begin += size
        return np.concatenate(out)

    def document(self, k: int) -> np.ndarray:
        start = int(self.lengths[:k].sum())
        return self.stretch(start, start + int(self.lengths[k]))


BLOCK = "part int, block int, n_docs int, n_tokens long, payload binary"


def encode(docs: DataFrame, tokenizer: str, end_id: int, base: int, path: str, block_ids: int = SEGMENT_IDS, added_tokens: bool = False) -> DataFrame:
    """Write the documents' ids as blocks at `path`, in ascending doc_id order, and read the table back."""
    spark = docs.sparkSession
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            payload = pack_block(names, [len(x) for x in held], np.concatenate(held), base)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(names)], pa.int32()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())], ["part", "block", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for name, ids in zip(batch.column("doc_id").to_pylist(), tokens.encode_documents(batch.column("text"), tokenizer, end_id, added_tokens=added_tokens)):
                names.append(name)
                held.append(ids)
                size += len(ids)
                if size >= block_ids:
                    yield flush()
                    names, held, size, block = [], [], 0, block + 1
        if names:
            yield flush()

    ordered.mapInArrow(run, BLOCK).write.parquet(path)
    return spark.read.schema(BLOCK).parquet(path)


DOCUMENT = "part int, block int, doc_id long, before long, n_tokens long, ids_crc32 long"


def decode(blocks: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row for each document of the blocks: doc_id, start, n_tokens, ids_crc32, and ids (int array) if asked for."""
    spark = blocks.sparkSession
    # A row for each block, without its payload; blocks number by their ids, so one short row for half a million ids.
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    first, total = [], 0
    for r in sizes:
        first.append((r["part"], total))
        total += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, payload in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), batch.column("payload")):
                reader = BlockReader(payload.as_buffer())
                ends = np.cumsum(reader.lengths)
                rest = np.zeros(0, np.uint32)
                crcs, ids, k = [], [], 0
                pending: list[np.ndarray] = []
                need = int(reader.lengths[0]) if len(ends) else 0
                for seq in reader:
                    at = 0
                    while k < len(ends) and len(seq) - at >= need:
                        pending.append(seq[at : at + need])
                        at += need
                        whole = np.concatenate(pending) if len(pending) > 1 else pending[0]
                        crcs.append(tokens.crc32(whole))
                        if with_ids:
                            ids.append(whole.astype(np.int32))
                        pending, k = [], k + 1
                        need = int(reader.lengths[k]) if k < len(ends) else 0
                    rest = seq[at:]
                    if len(rest):
                        pending.append(rest)
                        need -= len(rest)
                n = len(ends)
                arrays = [pa.array([part] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(reader.doc_ids, pa.int64()), pa.array(ends - reader.lengths, pa.int64()), pa.array(reader.lengths, pa.int64()), pa.array(crcs, pa.int64())]
                names = ["part", "block", "doc_id", "before", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    out = blocks.select("part", "block", "payload").mapInArrow(run, DOCUMENT + (", ids array<int>" if with_ids else ""))
    # Starts of blocks: a running sum over the blocks of a part; starts of parts: one number for each task.
    from pyspark.sql import Window as W

    w = W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    parts = spark.createDataFrame(first, "part int, part_start long")
    starts = blocks.select("part", "block", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).alias("block_start")).join(F.broadcast(parts), "part")
    return out.join(starts, ["part", "block"]).select("doc_id", (F.col("part_start") + F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op4(spark, sf_dir, tokenizer_path: Callable[[str], str] = tokens.default_path):
    docs = common.table(spark, sf_dir, "documents")
    blocks = encode(docs, tokenizer_path(TOKENIZER), END_ID, 49408, common.scratch_path(spark, "token-ids"), added_tokens=True)
    return decode(blocks, with_ids=False)
