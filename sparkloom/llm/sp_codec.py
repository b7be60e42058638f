"""SentencePiece encoding and decoding by batched numpy Viterbi.

A text is normalised as the model asks (the identity rule here: spaces become word marks, one is put in front), cut
into words at the marks, and each distinct word is encoded once per worker. Words of equal length advance through
their lattices together: at every end place all pieces that end there are probed at once, as substring hashes in
the sorted hashes of the pieces; the best is taken by a vectorised maximum, and its length is the backpointer.

For a unigram model the maximum is that of score sums (Viterbi proper). A BPE model doesn't maximise sums; its
encoding is the one path whose neighbouring pieces could not have been merged differently. So there the lattice
keeps, for each place, the last piece of the word's encoding up to there, and a candidate counts only if the pair
(last piece before it, candidate) is stable: no merge across their border comes before the merges that made them.
Exactly one candidate is stable, and the same maximum finds it: the ids are those of the sentencepiece library.

Characters that aren't pieces become their bytes' pieces (byte fallback) and end the lattice on either side.
Decoding joins pieces, turns marks into spaces, drops the one put in front, and reads byte pieces as UTF-8.

Null and empty texts have no ids, and null ids no text; texts of any length are read whole. Rows are encoded each on its
own, so repeated rows give repeated results and an empty table an empty one. Other columns are carried along, but for
one that is named as the new column, which is replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import common, tokens
from sparkloom.llm.textmodel import slices

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Words and characters that a worker remembers; words that advance together, and the longest that do.
CACHE_WORDS = 800_000
CACHE_CHARS = 48_000_000
TOGETHER = 20_000
SLICE_BYTES = 12_000_000
#: Spaces that normalising would squeeze, line breaks beside or before them, and marks in the text itself.
ODD = "  |\\A[ \\n]| \\z| \\n|" + MARK
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _fields(data: bytes):
    """(field number, value) of a serialised message: numbers, or bytes of strings, messages and floats."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces, scores and kinds of a model file, in the tables that the lattice probes.

    Kinds: 1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte. Only normal pieces stand in the lattice.
    """

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores = []
        self.unigram = True
        self.byte_fallback = False
        self.add_prefix = self.squeeze = True
        rule = ""
        for field, value in _fields(data):
            if field == 1:
                piece = {n: v for n, v in _fields(value)}
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0])
                self.kinds.append(piece.get(3, 1))
            elif field == 2:
                for n, v in _fields(value):
                    if n == 3:
                        self.unigram = v == 1
                        if v not in (1, 2):
                            raise ValueError("only unigram and BPE models are read")
                    elif n == 35:
                        self.byte_fallback = bool(v)
            elif field == 3:
                for n, v in _fields(value):
                    if n == 1:
                        rule = v.decode()
                    elif n == 3:
                        self.add_prefix = bool(v)
                    elif n == 4:
                        self.squeeze = bool(v)
                    elif n == 2 and v:
                        rule = rule or "compiled"
        if rule not in ("", "identity"):
            raise ValueError(f"normalisation {rule} isn't read, only identity")
        self.scores = np.array(scores, np.float64)
        self.unknown = self.kinds.index(2) if 2 in self.kinds else 0
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == 6}
        normal = [i for i, k in enumerate(self.kinds) if k == 1]
        self.longest = max((len(self.pieces[i]) for i in normal), default=1)
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, _ODD)]), dtype=np.uint64)
        keys = np.array([self._hash(self.pieces[i]) for i in normal], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal, np.int64)[order]
        # Byte pieces below 128 are characters of their own.
        self.shown = [chr(int(p[3:5], 16)) if k == 6 and int(p[3:5], 16) < 128 else p for p, k in zip(self.pieces, self.kinds)]
        self.simple = np.array([k in (1, 4) or k == 6 and len(t) == 1 for k, t in zip(self.kinds, self.shown)])
        if not self.unigram:
            self._bpe(normal)

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_ODD) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _bpe(self, normal: list[int]) -> None:
        """Merge ranks; what each piece is made of; and the pairs of pieces that make a piece."""
        n = len(self.pieces)
        self.rank = np.empty(n, np.int64)
        self.rank[np.argsort(-self.scores, kind="stable")] = np.arange(n)
        by_name = {self.pieces[i]: i for i in normal}
        single = [i for i in normal if len(self.pieces[i]) == 1]
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        pairs, made = [], []
        splits: dict[int, list[tuple[int, int]]] = {}
        for i in normal:
            p = self.pieces[i]
            for cut in range(1, len(p)):
                a, b = by_name.get(p[:cut]), by_name.get(p[cut:])
                if a is not None and b is not None:
                    pairs.append(a * n + b)
                    made.append(i)
                    splits.setdefault(i, []).append((a, b))
        order = np.argsort(np.array(pairs, np.int64)) if pairs else np.zeros(0, np.int64)
        self.pair_keys, self.pair_made = np.array(pairs, np.int64)[order], np.array(made, np.int64)[order]
        # A piece is reached if merging its own characters ends in it; its last merge tells what it is made of.
        self.reached = np.zeros(n, bool)
        self.reached[single] = True
        for i in normal:
            p = self.pieces[i]
            if len(p) > 1 and i in splits:
                last = self._merge(p, by_name)
                if last is not None:
                    self.left[i], self.right[i] = last
                    self.reached[i] = True
        # Only pieces made by merges stand in the lattice.
        ok = self.reached[self.ids]
        self.keys, self.ids = self.keys[ok], self.ids[ok]

    def _merge(self, text: str, by_name: dict[str, int]) -> tuple[int, int] | None:
        """The two pieces of the last merge if merging the text's characters ends in one piece."""
        parts = [by_name.get(c, -1) for c in text]
        names = list(text)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                made = by_name.get(names[i] + names[i + 1])
                if made is not None and (best is None or self.rank[made] < best[0]):
                    best = (self.rank[made], i, made)
            if best is None:
                return None
            _, i, made = best
            if len(parts) == 2:
                return parts[0], parts[1]
            parts[i : i + 2] = [made]
            names[i : i + 2] = [names[i] + names[i + 1]]
        return None

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, or -1."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.ids[at], -1)

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of pieces a and b together leaves just a and b.

        Merges come in the order of their ranks, and what a merge makes ranks behind what it is made of. So at the
        border stand, at any time, the largest parts whose rank is past; a merge across it happens if it ranks
        before both the merge that takes a's part further and, or level with, the one that takes b's.
        """
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        none = np.int64(1) << 60
        up_x, up_y = np.full(len(a), none), np.full(len(a), none)  # ranks of the merges that end x and y
        n = len(self.pieces)
        while len(live):
            key = x * n + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.rank[self.pair_made[at]], none)
            broken = (rank < up_x) & (rank <= up_y) & (rank < none)
            out[live[broken]] = False
            # Go back in time: undo whichever part was made later.
            rx = np.where(self.right[x] >= 0, self.rank[x], -1)
            ry = np.where(self.left[y] >= 0, self.rank[y], -1)
            go = ~broken & ((rx >= 0) | (ry >= 0))
            back_x = go & (rx >= ry)
            back_y = go & ~back_x
            up_x, up_y = np.where(back_x, rx, up_x), np.where(back_y, ry, up_y)
            x, y = np.where(back_x, self.right[x], x), np.where(back_y, self.left[y], y)
            live, x, y, up_x, up_y = live[go], x[go], y[go], up_x[go], up_y[go]
        return out

    def encode_equal(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, from their code points (a row each), joined; and how many each has."""
        rows, size = codes.shape
        h = np.zeros((size + 1, rows), np.uint64)
        for i in range(size):
            h[i + 1] = h[i] * _ODD + codes[:, i].astype(np.uint64) + np.uint64(1)
        back = np.zeros((size + 1, rows), np.int32)
        last = np.full((size + 1, rows), -1, np.int64)  # -1: a start, or after a character that is no piece
        best = np.full((size + 1, rows), -np.inf)
        best[0] = 0.0
        floor = self.scores.min() - 10
        for j in range(1, size + 1):
            top = np.full(rows, -np.inf)
            open_rows = np.arange(rows)
            for l in range(1, min(j, self.longest) + 1):
                i = j - l
                piece = self.lookup(h[j, open_rows] - h[i, open_rows] * self.powers[l])
                found = (piece >= 0) & (best[i, open_rows] > -np.inf)
                at, piece = open_rows[found], piece[found]
                if self.unigram:
                    value = best[i, at] + self.scores[piece]
                    better = value >= top[at]  # of equal sums the longer piece
                    at, piece, value = at[better], piece[better], value[better]
                else:
                    before = last[i, at]
                    inner = np.flatnonzero(before >= 0)
                    good = np.ones(len(at), bool)
                    good[inner] = self.stable(before[inner], piece[inner])
                    at, piece, value = at[good], piece[good], 0.0
                top[at] = value
                back[j, at] = l
                last[j, at] = piece
                if not self.unigram and len(at):  # the one stable candidate is found
                    open_rows = open_rows[top[open_rows] == -np.inf]
                    if not len(open_rows):
                        break
            # A character that is no piece stands alone.
            alone = np.flatnonzero((self.lookup(h[j] - h[j - 1] * self.powers[1]) < 0) & (best[j - 1] > -np.inf))
            value = best[j - 1, alone] + floor if self.unigram else np.zeros(len(alone))
            better = value > top[alone]
            at = alone[better]
            top[at] = value[better]
            back[j, at] = 1
            last[j, at] = -1
            best[j] = top
        # Walk the backpointers of all words at once.
        place = np.full(rows, size)
        steps: list[np.ndarray] = []
        while (place > 0).any():
            row = np.arange(rows)
            ids = np.where(place > 0, last[place, row], -2)
            steps.append(np.where(ids == -1, -3 - codes[row, np.maximum(place - 1, 0)].astype(np.int64), ids))
            place = np.where(place > 0, place - back[place, row], 0)
        flat = np.stack(steps[::-1], 1) if steps else np.zeros((rows, 0), np.int64)
        there = flat != -2
        ids, lengths = flat[there], there.sum(1)
        if (ids <= -3).any():
            ids, lengths = self._fall_back(ids, np.repeat(np.arange(rows), lengths), rows)
        return ids.astype(np.int32), lengths

    def _fall_back(self, ids: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no pieces (-3 less their code point) as bytes, or as one unknown piece for a run of them."""
        strange = ids <= -3
        if not self.byte_fallback:
            again = strange.copy()
            again[1:] &= strange[:-1] & (row[1:] == row[:-1])
            again[:1] = False
            ids = np.where(strange, self.unknown, ids)[~again]
            return ids, np.bincount(row[~again], minlength=rows)
        size = np.ones(len(ids), np.int64)
        known = {}
        for x in np.unique(ids[strange]).tolist():
            known[x] = [self.bytes[b] for b in chr(-3 - x).encode()]
            size[ids == x] = len(known[x])
        ends = np.cumsum(size)
        out = np.repeat(ids, size)
        for x, own in known.items():
            at = np.flatnonzero(ids == x)
            for k, piece in enumerate(own):
                out[ends[at] - size[at] + k] = piece
        return out, np.bincount(row, weights=size, minlength=rows).astype(np.int64)

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        return (MARK if self.add_prefix else "") + text.replace(" ", MARK)

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        if self.simple[ids].all():
            text = "".join(map(self.shown.__getitem__, ids.tolist())).replace(MARK, " ")
            return text[1:] if self.add_prefix and text[:1] == " " else text
        out: list[str] = []
        held = bytearray()
        for i in ids.tolist():
            if self.kinds[i] == 6:
                held.append(int(self.pieces[i][3:5], 16))
                continue
            if held:
                out.append(held.decode(errors="replace"))
                held.clear()
            if self.kinds[i] in (1, 4):
                out.append(self.pieces[i])
            elif self.kinds[i] == 2:
                out.append(" ⁇ ")
        if held:
            out.append(held.decode(errors="replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if self.add_prefix and text[:1] == " " else text


class Encoder:
    """Encodes texts by a model, remembering words; its memory is bounded."""

    def __init__(self, data: bytes):
        self.model = Model(data)
        m = self.model
        # No piece holds a line break here, so a word may be cut before one.
        self.cuts_lines = not any("\n" in p for p, k in zip(m.pieces, m.kinds) if k in (1, 4)) and m.byte_fallback
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[str, int] = {}
        self.first = np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, np.int32)
        self.used = self.chars = 0

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised words, those of one length at once: (their order, ids joined in it, ids of each)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        ids, lengths, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while at < len(order):
            n = int(size[order[at]])
            stop = min(int(np.searchsorted(size[order], n, "right")), at + max(1, min(TOGETHER, 2_000_000 // max(n, 1))))
            part = [words[i] for i in order[at:stop].tolist()]
            codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
            got, many = self.model.encode_equal(codes)
            ids.append(got)
            lengths.append(many)
            at = stop
        return order, np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, words: list[str]) -> None:
        mark = MARK
        order, ids, lengths = self._encoded([w if w[:1] == "\n" and self.cuts_lines else mark + w for w in words])
        k, n = len(self.numbers), len(words)
        if k + n + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros(max(k + n + 1, len(self.first)), np.int64)])
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(self.used + len(ids), len(self.pool)), np.int32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.first[k : k + n + 1] = self.used + np.concatenate([[0], np.cumsum(lengths)])
        self.numbers.update(zip(map(words.__getitem__, order.tolist()), range(k, k + n)))
        self.used += len(ids)
        self.chars += sum(map(len, words))

    def _whole(self, text: str) -> np.ndarray:
        """A text with marks of its own, or spaces in odd places: cut at the marks of its normal form."""
        words: list[str] = []
        marks = ""
        head, *parts = self.model.normalise(text).split(MARK)
        if head:
            words.append(head)
        for p in parts:
            marks += MARK
            if p:
                words.append(marks + p)
                marks = ""
        if marks:
            words.append(marks)
        order, ids, lengths = self._encoded(words)
        ends = np.cumsum(lengths)
        place = np.argsort(order)
        return np.concatenate([np.zeros(0, np.int32), *(ids[ends[i] - lengths[i] : ends[i]] for i in place.tolist())])

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if len(self.numbers) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.reset()
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False) | (not self.model.add_prefix)
        plain = np.flatnonzero(~odd & ~pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        chosen = texts.take(pa.array(plain))
        words = pc.split_pattern(pc.replace_substring(chosen, "\n", " \n") if self.cuts_lines else chosen, " ")
        counts = np.diff(words.offsets.to_numpy()).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.numbers]
        if new:
            self._learn(new)
        number = np.fromiter(map(self.numbers.__getitem__, distinct), np.int64, len(distinct))
        begin, long = self.first[number], (self.first[number + 1] - self.first[number]).astype(np.int32)
        codes = coded.indices.to_numpy()
        size = long[codes]
        ends = np.cumsum(size, dtype=np.int64)
        at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32) + np.repeat((begin[codes] - ends + size).astype(np.int32), size)
        ids = self.pool[at]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        out = [np.zeros(0, np.int32)] * len(texts)
        for i, lo, hi in zip(plain.tolist(), bounds[:-1], bounds[1:]):
            out[i] = ids[lo:hi]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._whole(texts[i].as_py())
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    with open(path, "rb") as f:
        return Encoder(f.read())


def encode_udf(path: str):
    @F.arrow_udf("array<int>")
    def encode(text: pa.Array) -> pa.Array:
        ids = [x for part in slices(text, SLICE_BYTES) for x in encoder(path).encode(part)]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))

    return encode


def decode_udf(path: str):
    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        model = encoder(path).model
        return pa.array([None if x is None else model.decode(x) for x in ids.to_pylist()], pa.string())

    return decode


def encoded(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    return docs.withColumn(out, encode_udf(path)(F.col(text).cast("string")))


def decoded(rows: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    return rows.withColumn(out, decode_udf(path)(F.col(ids)))


def op9(spark, sf_dir, tokenizer_path: Callable[[str], str] = tokens.default_path):
    """Every document's ids (counted and summed up by crc32) and whether decoding them gives its text back."""
    path = tokenizer_path(MODEL)

    @F.arrow_udf("struct<n_tokens:bigint,ids_crc32:bigint,n_bytes:bigint,round_trip:boolean>")
    def digest(text: pa.Array) -> pa.Array:
        e = encoder(path)
        out = []
        for part in slices(text, SLICE_BYTES):
            for t, ids in zip(part.to_pylist(), e.encode(part)):
                whole = e.model.normalise(t or "").replace(MARK, " ")
                back = e.model.decode(ids)
                out.append({"n_tokens": len(ids), "ids_crc32": tokens.crc32(ids), "n_bytes": len((t or "").encode()), "round_trip": back == (whole[1:] if e.model.add_prefix else whole)})
        return pa.array(out, pa.struct([("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("n_bytes", pa.int64()), ("round_trip", pa.bool_())]))

    docs = common.table(spark, sf_dir, "documents").select("doc_id", digest(F.col("text").cast("string")).alias("d"))
    return docs.select("doc_id", "d.n_tokens", "d.ids_crc32", "d.n_bytes", "d.round_trip")
