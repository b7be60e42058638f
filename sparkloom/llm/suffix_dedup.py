"""Removal of repeated byte strings by a distributed suffix array, sorted deep-shallow.

Every byte is removed that lies in a string of LENGTH bytes which starts earlier as well, in a document before or further
up in the same one. To find them, suffixes are ordered by their first LENGTH bytes.

Buckets: all strings of LENGTH bytes that begin within a short run of places and have the same least hash of GRAM bytes in
them (their anchor) stand together. Where a string has its anchor depends on the string alone, so equal strings have equal
anchors at equal places; a run, some 40 places long, is a row of a few numbers. Runs that are alike as a whole
collapse, as equal keys do in a quicksort, first within the tasks that hold the texts and then in their bucket: all but
the earliest are repeats. Buckets that are left with one run hold no more repeats.
Sorting: the runs of other buckets fetch their bytes. Of a bucket, the suffixes with equal distance to the anchor are
sorted by multikey quicksort, eight bytes at a time, to a shallow depth; groups that are still alike go into blind tries:
each suffix is held against its trie's leaf once, which tells the depth and the byte where it branches off. Both advance for
all groups of a batch at once. Suffixes that are alike to the full length are a class, and all but its earliest repeat it.
Large buckets: where more runs share an anchor than one task should sort, they are partitioned further, as quicksort would: a
run is cut by the distance to the anchor, and its pieces meet those with which all bytes that strings at such distances
have in common agree. Pieces that are alone, or alike, are settled by that; what is left is cut again, down to single
strings. Of a key that a task holds many rows of, most are dealt out by a salt.

Texts are shuffled twice, once to give runs that are to be sorted their bytes and once to be cut; suffixes are not, but for
single strings of large buckets, as hashes. No row is a group of unbounded size but a document's own repeats, which are
fewer than its bytes.

Documents are ordered by doc_id, nulls last; those that share one by a hash of the text. Of rows that share both, the
first is judged by what comes before and the others are repeats of it: all removed, if they have LENGTH bytes. Null and
empty texts have no bytes. Texts of any length are taken in overlapping pieces. An empty table gives no rows. Columns other
than doc_id and text don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm import common

#: Bytes of a repeated string.
LENGTH = 100
#: Bytes of an anchor.
GRAM = 24
#: Bytes that quicksort orders by; beyond, tries do.
SHALLOW = 32
#: Runs of a bucket that are sorted at once; larger buckets are partitioned by strings at up to so many distances in turn.
PART = 256
WIDTHS = (16, 4)
SALTS = 64
#: Documents that a worker cuts at once, bytes of text whose places it works on at once (one text's piece at least), and runs
#: that it collapses before they are shuffled.
DOCUMENTS_AT_ONCE = 500
BYTES_AT_ONCE = 1 << 20
RUNS_AT_ONCE = 1 << 20
#: Places that a number's lower bits tell apart.
_PLACE = np.uint64((1 << 24) - 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h = (x * _A) ^ ((y << np.uint64(29)) | (y >> np.uint64(35)))
    h = h * _B
    return h ^ (h >> np.uint64(32))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; data has eight bytes to spare."""
    return np.ndarray((len(data) - 8,), np.uint64, data.data, 0, (1,))


def runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first place, places, distance of the first to the anchor, bucket, digest) of the runs of texts that lie end to end.

    A digest is of all bytes that the run's strings cover.
    """
    n = len(data)
    w = _words(np.concatenate([data, np.zeros(3 * LENGTH, np.uint8)])).copy()
    h16 = _mix(w[:-8], w[8:])
    h24 = _mix(h16[: n + LENGTH], w[16 : n + LENGTH + 16])
    least = (h24[:n] & ~_PLACE) | np.arange(n, dtype=np.uint64)
    width, have = LENGTH - GRAM + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    least = np.minimum(least[: len(least) - (width - have)], least[width - have :]) if width > have else least
    anchor = (least & _PLACE).astype(np.int64)
    # Places where a string of full length begins and stays within its text.
    whole = ends - begins >= LENGTH
    edge = np.zeros(len(anchor) + LENGTH + 1, np.int32)
    edge[begins[whole]] += 1
    edge[ends[whole] - LENGTH + 1] -= 1
    inside = np.cumsum(edge)[: len(anchor)] > 0
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(anchor))
    first, last = first[inside[first]], last[inside[first]]
    end = last - 1 + LENGTH
    h64 = lambda at: _mix(_mix(h16[at], h16[at + 16]), _mix(h16[at + 32], h16[at + 48]))
    digest = _mix(_mix(h64(first), h64(np.minimum(first + 64, end - 64))), h64(end - 64) ^ (end - first).astype(np.uint64))
    at = anchor[first]
    return first, last - first, at - first, h24[at], digest


def pieces(texts: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, begins, ends, row of each text, place of its first byte there) of texts in turn, of some `most` bytes at once.

    A longer text comes in pieces that overlap by a string less a byte, so each string is in one of them.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        if end == at + 1 and offsets[end] - offsets[at] > most:
            for begin in range(int(offsets[at]), int(offsets[end]) - LENGTH + 1, most):
                piece = data[begin : min(begin + most + LENGTH - 1, int(offsets[end]))]
                yield piece, np.array([0]), np.array([len(piece)]), np.array([at]), np.array([begin - offsets[at]])
        elif offsets[end] > offsets[at]:
            own = offsets[at : end + 1] - offsets[at]
            yield data[offsets[at] : offsets[end]], own[:-1], own[1:], np.arange(at, end), np.zeros(end - at, np.int64)
        at = end


def _changes(*columns: np.ndarray) -> np.ndarray:
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _filled(first: np.ndarray) -> np.ndarray:
    """For each row the last one before or at it that is a first."""
    return np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))


def _joined(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Places (start, count) of documents with those that follow on each other made one."""
    order = np.lexsort((start, tie, doc))
    doc, tie, start, count = doc[order], tie[order], start[order], count[order]
    first = _changes(doc, tie)
    first[1:] |= start[1:] != start[:-1] + count[:-1]
    at = np.flatnonzero(first)
    return [doc[at], tie[at], start[at], np.add.reduceat(count, at) if len(at) else count]


#: A run, or with salt -1 places that are repeats: their number is in `digest`. place: start, places less one, distance to the anchor.
RUN = "bucket long, salt int, digest long, doc long, tie long, place long"


BYTES = ", bytes binary"


def _packed(start: np.ndarray, count: np.ndarray, off: np.ndarray) -> np.ndarray:
    return (start << 14) | ((count - 1) << 7) | off


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 14, ((place >> 7) & 127) + 1, place & 127


def _batch(names: str, *columns) -> pa.RecordBatch:
    fields = [f.split() for f in names.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _collapsed(rows: list[np.ndarray], held: pa.Array | None = None) -> pa.RecordBatch:
    """Runs (bucket, digest, doc, tie, place) of a task: the earliest of those alike, salted where a bucket has many, and repeats.

    held: their bytes, if they are to be kept.
    """
    bucket, digest, doc, tie, place = rows
    order = np.lexsort((place, tie, doc, digest, bucket))
    bucket, digest, doc, tie, place = (c[order] for c in (bucket, digest, doc, tie, place))
    first = _changes(bucket, digest)
    lead = _filled(first)
    again = ~first & ((doc != doc[lead]) | (tie != tie[lead]) | (place != place[lead]))
    start, count, _ = _unpacked(place[again])
    marks = _joined(doc[again], tie[again], start, count)
    bucket, digest, doc, tie, place = (c[first] for c in (bucket, digest, doc, tie, place))
    nth = np.arange(len(bucket)) - _filled(_changes(bucket)) if len(bucket) else np.zeros(0, np.int64)
    salt = np.where(nth > PART, 1 + nth % SALTS, 0)
    none = np.zeros(len(marks[0]), np.int64)
    both = zip((bucket, salt, digest, doc, tie, place), (marks[0] ^ marks[1], none - 1, marks[3], marks[0], marks[1], marks[2] << 14))
    columns = [np.concatenate(x) for x in both]
    if held is None:
        return _batch(RUN, *columns)
    return _batch(RUN + BYTES, *columns, pa.concat_arrays([held.take(pa.array(order[first])), pa.nulls(len(none), held.type)]))


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        docs, ties = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
        for data, begins, ends, row, place in pieces(batch.column("text"), BYTES_AT_ONCE):
            if len(data) < LENGTH:
                continue
            first, count, off, bucket, digest = runs(data, begins, ends)
            text = np.searchsorted(begins, first, "right") - 1
            # Empty texts begin where the next one does.
            start = first - begins[text] + place[text]
            held.append([bucket.view(np.int64), digest.view(np.int64), docs[row[text]], ties[row[text]], _packed(start, count, off)])
            n += len(first)
        if n >= RUNS_AT_ONCE:
            yield _collapsed([np.concatenate(c) for c in zip(*held)])
            held, n = [], 0
    if held:
        yield _collapsed([np.concatenate(c) for c in zip(*held)])


#: Repeats (wide null) and runs that are left; wide: there are more of the bucket than are sorted at once.
CANDIDATE = "bucket long, wide boolean, doc long, tie long, start long, count long, off long"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs in the order of bucket, salt, digest and document, with or without their bytes."""
    large = None  # a bucket of which rows have been given already
    for table, starts in common.whole_groups(batches, ["bucket", "salt"], PART):
        bucket, salt, digest, doc, tie, place = (table[c].to_numpy() for c in ("bucket", "salt", "digest", "doc", "tie", "place"))
        start, count, off = _unpacked(place)
        done = salt < 0
        first = _changes(bucket, salt, digest) | done
        lead = _filled(first)
        again = ~first & ((doc != doc[lead]) | (tie != tie[lead]) | (place != place[lead]))
        marks = [np.concatenate(x) for x in zip(*((doc[done], tie[done], start[done], digest[done]), (doc[again], tie[again], start[again], count[again])))]
        size = np.diff(starts)
        group = np.repeat(np.arange(len(size)), size)
        left = np.bincount(group[first & ~done], minlength=len(size))
        ends = [(int(bucket[k]), int(salt[k])) for k in (0, -1)]
        wide = (size > PART) | (salt[starts[:-1]] > 0)
        wide[0] |= ends[0] == large
        large = ends[1] if len(size) == 1 and wide[0] else None
        kept = first & ~done & ((left > 1) | wide)[group]
        n = len(marks[0])
        null, more = pa.nulls(n, pa.int64()), np.flatnonzero(kept)
        column = lambda a, b: pa.concat_arrays([a if isinstance(a, pa.Array) else pa.array(a, pa.int64()), pa.array(b, pa.int64())])
        columns = [column(null, bucket[kept]), pa.concat_arrays([pa.nulls(n, pa.bool_()), pa.array(wide[group[kept]], pa.bool_())])]
        columns += [column(marks[0], doc[kept]), column(marks[1], tie[kept]), column(marks[2], start[kept]), column(marks[3], count[kept]), column(null, off[kept])]
        if "bytes" in table.column_names:
            yield _batch(CANDIDATE + BYTES, *columns, pa.concat_arrays([pa.nulls(n, pa.binary()), table["bytes"].combine_chunks().take(pa.array(more))]))
        else:
            yield _batch(CANDIDATE, *columns)


def _cut(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """Slices of bytes as an array of binaries."""
    upto = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(upto[-1]) + np.repeat(begin - upto[:-1], size)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))]).cast(pa.binary())


def _with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From documents with the list of runs that are wanted of them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("text").cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], np.uint8)
        wanted, row = batch.column("wanted").flatten(), pc.list_parent_indices(batch.column("wanted")).to_numpy()
        field = {f: wanted.field(f) for f in ("bucket", "wide", "start", "count", "off")}
        start, count = field["start"].to_numpy(), field["count"].to_numpy()
        cut = _cut(data, offsets[:-1][row] + start, count - 1 + LENGTH)
        own = [batch.column(c).to_numpy()[row] for c in ("doc", "tie")]
        yield _batch(CANDIDATE + BYTES, field["bucket"], field["wide"], *own, field["start"], field["count"], field["off"], cut)


def _held(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of binaries, with bytes to spare at the end."""
    rows = rows.cast(pa.large_binary())
    offsets = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
    return np.concatenate([np.frombuffer(rows.buffers()[2] or b"", np.uint8), np.zeros(LENGTH + 16, np.uint8)]), offsets


def _hashes(eight: np.ndarray, at: np.ndarray, size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the bytes of each slice (eight of them at least, `most` at most)."""
    one, two = size.astype(np.uint64), ~size.astype(np.uint64)
    for d in range(0, most, 8):
        w = eight[at + np.minimum(d, size - 8)]
        one, two = _mix(one, w), _mix(w ^ _B, two)
    return one, two


def _finer(width: int):
    """Runs with their bytes as pieces of strings at `width` distances to the anchor each, keyed by what such strings share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, doc, tie, start, count, off = (batch.column(c).to_numpy() for c in ("bucket", "doc", "tie", "start", "count", "off"))
            data, offsets = _held(batch.column("bytes"))
            eight, found, cuts = _words(data), [], []
            for k in range((LENGTH - GRAM) // width + 1):
                high, low = np.minimum(off, k * width + width - 1), np.maximum(off - count + 1, k * width)
                row = np.flatnonzero(low <= high)
                high, low = high[row], low[row]
                begin, size = offsets[row] + off[row] - high, high - low + LENGTH
                shared = np.full(len(row), LENGTH + 1 - width)
                key = _mix(_hashes(eight, begin + high - k * width, shared, LENGTH)[0], bucket[row].view(np.uint64) + np.uint64(k))
                digest = _hashes(eight, begin, size, LENGTH + width)[0]
                found.append([key.view(np.int64), digest.view(np.int64), doc[row], tie[row], _packed(start[row] + off[row] - high, high - low + 1, high)])
                cuts.append((begin, size))
            yield _collapsed([np.concatenate(c) for c in zip(*found)], _cut(data, *(np.concatenate(c) for c in zip(*cuts))))

    return run


#: A string of a large bucket, by its hashes; again: an earlier one of its task is alike.
STRING = "one long, two long, doc long, tie long, start long, again boolean"


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, tie, start, count = (batch.column(c).to_numpy() for c in ("doc", "tie", "start", "count"))
        data, offsets = _held(batch.column("bytes"))
        run = np.repeat(np.arange(len(doc)), count)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        one, two = _hashes(_words(data), offsets[run] + nth, np.full(len(run), LENGTH), LENGTH)
        place = start[run] + nth
        order = np.lexsort((place, tie[run], doc[run], two, one))
        one, two, run, place = one[order], two[order], run[order], place[order]
        yield _batch(STRING, one.view(np.int64), two.view(np.int64), doc[run], tie[run], place, ~_changes(one, two))


def quicksorted(word, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, start of a segment) of suffixes, sorted within groups by multikey quicksort over the first `depth` bytes.

    word(suffixes, depth): the eight bytes there, as numbers that are ordered as bytes are. Groups are numbered in order, and
    suffixes of a group stand together. A segment is of suffixes alike to that depth. Equal suffixes keep their order.
    """
    order = np.arange(len(group))
    starts = _changes(group) if len(group) else np.zeros(0, bool)
    place = np.flatnonzero(~(starts & np.append(starts[1:], True))) if len(group) else order
    level = np.zeros(len(place), np.int64)
    while len(place):
        own, begin = order[place], np.flatnonzero(starts[place])
        size = np.diff(np.append(begin, len(place)))
        segment = np.repeat(np.arange(len(size)), size)
        w = np.empty(len(place), np.uint64)
        for d in np.unique(level):
            w[level == d] = word(own[level == d], int(d))
        pivot = w[begin + size // 2][segment]
        side = 3 * segment + 1 + (w > pivot).astype(np.int64) - (w < pivot)
        sort = np.argsort(side, kind="stable")
        side = side[sort]
        order[place] = own[sort]
        cut = _changes(side)
        starts[place] = cut
        level = level[sort] + np.where(side % 3 == 1, 8, 0)
        alone = cut & np.append(cut[1:], True)
        more = ~alone & (level < depth)
        place, level = place[more], level[more]
    return order, starts


def tried(word, byte, order: np.ndarray, starts: np.ndarray, known: int, depth: int) -> np.ndarray:
    """For each suffix the first one of its class, those alike in `depth` bytes, from segments alike in `known` ones.

    Each segment is a blind trie: its suffixes are compared with the first one, which tells where they branch off. Those that
    branch off at one depth with one byte are a trie below. `order` becomes that of all bytes.
    """
    leader = np.arange(len(order))
    place = np.flatnonzero(~(starts & np.append(starts[1:], True))) if len(order) else order
    upto = np.full(len(place), known, np.int64)  # bytes that a segment's suffixes share
    while len(place):
        own, begin = order[place], np.flatnonzero(starts[place])
        size = np.diff(np.append(begin, len(place)))
        lead = np.repeat(own[begin], size)
        same = upto.copy()
        active = np.flatnonzero(own != lead)
        same[own == lead] = depth
        while len(active):
            at = same[active]
            differ = word(own[active], at) ^ word(lead[active], at)
            bytes_ = differ.byteswap().view(np.uint8).reshape(-1, 8) != 0
            zeros = np.where(differ == 0, 8, bytes_.argmax(1))
            same[active] = np.minimum(at + zeros, depth)
            active = active[(zeros == 8) & (at + 8 < depth)]
        alike = same >= depth
        leader[own[alike]] = lead[alike]
        branch = np.where(alike, 0, byte(own, np.minimum(same, depth - 1)).astype(np.int64))
        above = ~alike & (branch > byte(lead, np.minimum(same, depth - 1)))
        segment = np.repeat(np.arange(len(size)), size)
        # Lesser ones come first, by ascending depth; greater ones after the leaf, by descending depth.
        turn = np.where(alike, 0, np.where(above, 2 * depth - same, same - depth))
        sort = np.lexsort((branch, turn, segment))
        order[place] = own[sort]
        alike, same = alike[sort], same[sort]
        cut = _changes(segment[sort], turn[sort], branch[sort])
        starts[place] = cut
        more = ~alike & ~(cut & np.append(cut[1:], True))
        place, upto = place[more], np.minimum(same[more] + 1, depth)
    return leader


MARK = "doc long, tie long, start long, count long"


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among runs with their bytes, in the order of bucket and document."""
    for table, starts in common.whole_groups(batches, ["bucket"], None):
        doc, tie, start, count, off = (table[c].to_numpy() for c in ("doc", "tie", "start", "count", "off"))
        size = np.diff(starts)
        cell = np.repeat(np.arange(len(size)), size)
        data, offsets = _held(table["bytes"].combine_chunks())
        eight = _words(data)
        # A suffix for each place of each run, by bucket and distance to the anchor, then by document.
        run = np.repeat(np.arange(len(doc)), count)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        group = cell[run] * (LENGTH + 1) + off[run] - nth
        sort = np.argsort(group, kind="stable")
        run, nth, group = run[sort], nth[sort], group[sort]
        at = offsets[run] + nth
        word = lambda k, d: eight[at[k] + d].byteswap()
        order, segments = quicksorted(word, group, SHALLOW)
        leader = tried(lambda k, d: _limited(word(k, d), d), lambda k, d: data[at[k] + d], order, segments, SHALLOW, LENGTH)
        places = start[run] + nth
        again = (doc[run] != doc[run[leader]]) | (tie[run] != tie[run[leader]]) | (places != places[leader])
        yield _batch(MARK, *_joined(doc[run[again]], tie[run[again]], places[again], np.ones(int(again.sum()), np.int64)))


def _limited(word: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Words without what lies beyond the full length."""
    beyond = np.clip(np.asarray(depth) + 8 - LENGTH, 0, 8).astype(np.uint64) * np.uint64(8)
    return np.where(beyond >= 64, np.uint64(0), (word >> np.minimum(beyond, np.uint64(63))) << np.minimum(beyond, np.uint64(63)))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From documents with the list of the places that repeat, and how many rows are alike."""
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text, copies, marks in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("copies").to_pylist(), batch.column("marks")):
            data = text.as_buffer() if text.is_valid else b""
            n, removed, spans, kept = len(data), 0, 0, data
            if marks.is_valid:
                start, count = (marks.values.field(f).to_numpy() for f in ("start", "count"))
                depth = np.bincount(start, minlength=n + 1) - np.bincount(start + count - 1 + LENGTH, minlength=n + 1)
                gone = np.cumsum(depth[:n]) > 0
                removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(data, np.uint8)[~gone]
            out.append((doc_id, n, removed, spans, hashlib.sha256(kept).hexdigest()))
            if copies > 1:
                whole = (doc_id, n, n, 1, hashlib.sha256().hexdigest()) if n >= LENGTH else out[-1]
                out += [whole] * (copies - 1)
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], [f.split()[0] for f in RESULT.split(", ")])


def removed(documents: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    with common.scope() as keep:
        out = common.materialize(_removed(documents), "suffix-dedup")
        keep(out)
    return out


def _removed(documents: DataFrame) -> DataFrame:
    spark = documents.sparkSession
    last = (1 << 63) - 1
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(last)).alias("doc"), F.xxhash64("text").alias("tie"), "text")
    # Here Spark's own bound on a batch's bytes holds; texts are taken in pieces of it.
    found = rows.select("doc", "tie", "text").mapInArrow(_runs_of, RUN).repartition("bucket", "salt")
    found = found.sortWithinPartitions("bucket", "salt", "digest", "doc", "tie", "place")
    found = common.materialize(found.mapInArrow(_candidates, CANDIDATE), "suffix-runs")
    mark = ["doc", "tie", "start", "count"]
    marks = found.where("wide is null").select(*mark)

    # Runs that are left get their bytes.
    wanted = found.where("wide is not null").groupBy("doc", "tie").agg(F.collect_list(F.struct("bucket", "wide", "start", "count", "off")).alias("wanted"))
    texts = rows.groupBy("doc", "tie").agg(F.any_value("text").alias("text"))
    with common.batches_of(spark, DOCUMENTS_AT_ONCE):
        fetched = common.materialize(texts.join(wanted, ["doc", "tie"]).mapInArrow(_with_bytes, CANDIDATE + BYTES), "suffix-bytes")
    small, large = fetched.where("not wide"), fetched.where("wide")
    for width in WIDTHS:
        parts = large.mapInArrow(_finer(width), RUN + BYTES).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "digest", "doc", "tie", "place")
        parts = common.materialize(parts.mapInArrow(_candidates, CANDIDATE + BYTES), "suffix-pieces")
        marks = marks.unionAll(parts.where("wide is null").select(*mark))
        small, large = small.unionAll(parts.where("not wide")), parts.where("wide")
    nth = F.row_number().over(W.partitionBy("one", "two").orderBy("doc", "tie", "start"))
    strings = common.materialize(large.mapInArrow(_strings, STRING), "suffix-strings")
    across = strings.where("not again").withColumn("nth", nth).where("nth > 1").drop("nth")
    strings = strings.where("again").unionAll(across).select("doc", "tie", "start", F.lit(1).cast("long").alias("count"))
    ordered = small.repartition("bucket").sortWithinPartitions("bucket", "doc", "tie", "start").mapInArrow(_sorted, MARK)

    marks = marks.unionAll(strings).unionAll(ordered)
    marks = marks.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "count")).alias("marks"))
    texts = rows.groupBy("doc", "tie").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("text").alias("text"), F.count("*").alias("copies"))
    with common.batches_of(spark, DOCUMENTS_AT_ONCE):
        return common.materialize(texts.join(marks, ["doc", "tie"], "left").select("doc_id", "text", "copies", "marks").mapInArrow(_judged, RESULT), "suffix-judged")


def op13(spark, sf_dir):
    return removed(common.table(spark, sf_dir, "documents"))


#: Bytes as pairs of hexadecimal digits; strings are cut out of short blocks of a text.
ORACLE = """
with d as (
    select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), b as (
    select doc_id, unnest(range(0, len(h) // 2 - 99, 128)) as block, h from d
), c as (
    select doc_id, block, substr(h, 2 * block + 1, 2 * (128 + 99)) as h from b
), s as (
    select doc_id, block, h, unnest(range(0, len(h) // 2 - 99)) as i from c
), k as (
    select doc_id, block + i as i, row_number() over (partition by substr(h, 2 * i + 1, 200) order by doc_id, block + i) as n from s
), m as (
    select doc_id, i, i > lag(i) over w + 100 or lag(i) over w is null as fresh from k where n > 1 window w as (partition by doc_id order by i)
), r as (
    select doc_id, i, sum(fresh::int) over (partition by doc_id order by i) as span from m
), spans as (
    select doc_id, span, min(i) as lo, max(i) + 100 as hi from r group by doc_id, span
), gaps as (
    select doc_id, span, lo, hi, coalesce(lag(hi) over (partition by doc_id order by span), 0) as at, lead(lo) over (partition by doc_id order by span) is null as final from spans
), kept as (
    select g.doc_id, sum(hi - lo) as removed, count(*) as spans, string_agg(substr(d.h, 2 * g.at + 1, 2 * (g.lo - g.at)) || case when final then substr(d.h, 2 * g.hi + 1) else '' end, '' order by span) as h
    from gaps g join d using (doc_id) group by g.doc_id
)
select d.doc_id, len(d.h) // 2 as n_bytes, coalesce(k.removed, 0)::bigint as n_removed, coalesce(k.spans, 0) as n_spans, sha256(unhex(coalesce(k.h, d.h))) as kept_sha256
from d left join kept k using (doc_id)
"""
