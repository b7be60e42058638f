"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per worker.

A text is cut only where both tokenizers cut it anyway: before a single space or a single line break that stands
between two characters that aren't white space. What stands between two cuts is encoded by the library and
remembered; a text's ids are the ids of its parts in order. A text where a space or line break stands beside other
white space, or at an end, is encoded by the library as one string instead, so every id is the library's own.
A tokenizer that lowers case and drops white space cuts at any white space, and between a letter and punctuation;
there the words are remembered in lower case, and texts with combining marks are encoded as one string.

The file's added tokens (<|endoftext|>) are either text like any other, or, with `added_tokens`, tokens wherever a text
holds them, which is the library's default and what the queries return; texts that hold one are encoded as one string.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sparkloom.llm import workers

#: Words and characters that a worker remembers at most; beyond that it starts anew, so its memory stays bounded.
CACHE_WORDS = 1_000_000
CACHE_CHARS = 32_000_000
#: Characters of distinct words that are encoded in one call of the library; its results are some 100 bytes a character.
CALL_CHARS, FEW_CALL_CHARS = 400_000, 60_000
#: White space beside a space or line break, either at an end, or any other white space.
_ODD = "[ \\n][ \\n]|\\A[ \\n]|[ \\n]\\z|[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: What marks the first word of a text; texts that hold it are odd ones.
_FIRST = "\r"


#: Letters that a tokenizer which drops white space ends before ASCII punctuation, and that punctuation, but for the apostrophe.
_BEFORE_POINTS = "([a-zà-öø-ÿ])([!-&(-/:-@\\[-`{-~])"


class WordEncoder:
    """encode(texts) -> (ids of all texts joined, number of ids of each). A null text has none."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, added_tokens: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if not added_tokens:
            self.tokenizer.encode_special_tokens = True
        self.cache_words, self.call_chars = cache_words, CALL_CHARS
        parts = json.loads(self.tokenizer.to_str())
        steps = (parts.get("normalizer") or {}).get("normalizers") or [parts.get("normalizer") or {}]
        split = ((parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        # It lowers case and keeps only letter runs, digits and runs of other signs: white space and case don't matter.
        self.folds = any(x.get("type") == "Lowercase" for x in steps) and split.get("behavior") == "Removed" and split.get("invert") is True and "[^\\s\\p{L}\\p{N}]+" in (split.get("pattern") or {}).get("Regex", "")
        # Lowering A-Z early is safe where no mark follows a letter that it could be composed with.
        self.odd = "\\p{M}" if self.folds else _ODD
        if added_tokens:
            contents = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
            if contents:  # in any case, as a token may be one of the lowered text
                self.odd += f"|(?i:{contents})"
        self.reset()

    def reset(self) -> None:
        self.numbers: dict = {}
        self.first = np.zeros(1 << 16, np.int64)  # of a word's ids in the pool
        self.pool = np.zeros(1 << 18, np.int32)
        self.used = self.chars = 0

    def _learn(self, words: list[str]) -> None:
        """Encode words that aren't in the cache yet, and number them in their order. Those that begin a text carry a mark."""
        need = len(self.numbers) + len(words) + 1
        if need > len(self.first):
            self.first = np.concatenate([self.first, np.zeros(max(need, len(self.first)), np.int64)])
        chars = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        at = done = 0
        while at < len(words):
            stop = max(at + 1, int(np.searchsorted(chars, done + self.call_chars, "right")))
            batch = words[at:stop]
            written = batch if self.folds else [w[1:] if w[:1] == _FIRST else w if w[:1] == "\n" else " " + w for w in batch]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(written, add_special_tokens=False)]
            ends = self.used + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            end = int(ends[-1])
            if end > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(end, len(self.pool)), np.int32)])
            self.pool[self.used : end] = np.fromiter(chain.from_iterable(found), np.int32, end - self.used)
            k = len(self.numbers)
            self.numbers.update(zip(batch, range(k, k + len(batch))))
            self.first[k + 1 : k + 1 + len(batch)] = ends
            self.used = end
            at, done = stop, int(chars[stop - 1])
        self.chars += done

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.numbers) > self.cache_words or self.chars > CACHE_CHARS:
            self.reset()
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~odd & ~empty)
        chosen = texts.take(pa.array(plain))
        if self.folds:
            chosen = pc.replace_substring(pc.ascii_lower(chosen), "\n", " ")
            words = pc.split_pattern(pc.replace_substring_regex(chosen, _BEFORE_POINTS, "\\1 \\2"), " ")
        else:
            words = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(pa.scalar(_FIRST), chosen, ""), "\n", " \n"), " ")
        counts = np.diff(words.offsets.to_numpy()).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        number = np.fromiter(map(self.numbers.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = np.arange(len(self.numbers), len(self.numbers) + len(new))
            self._learn([distinct[i] for i in new.tolist()])
        begin, long = self.first[number], (self.first[number + 1] - self.first[number]).astype(np.int32)
        codes = coded.indices.to_numpy()
        size = long[codes]
        ends = np.cumsum(size, dtype=np.int64)
        at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32) + np.repeat((begin[codes] - ends + size).astype(np.int32), size)
        ids = self.pool[at]
        lengths = np.zeros(len(texts), np.int64)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        lengths[plain] = np.diff(bounds)
        if odd.any():
            whole = [np.zeros(0, np.int32)] * len(texts)
            for i, begin, end in zip(plain.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                whole[i] = ids[begin:end]
            strange = np.flatnonzero(odd).tolist()
            for i in strange:
                whole[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.int32)
                lengths[i] = len(whole[i])
            ids = np.concatenate(whole)
        return ids, lengths


@functools.lru_cache(maxsize=2)
def encoder(path: str, added_tokens: bool = False) -> WordEncoder:
    """One per Python worker; workers are reused from task to task."""
    return WordEncoder(path, added_tokens=added_tokens)


workers.on_other_work(encoder.cache_clear)


def encode_documents(texts: pa.Array | list[str | None], path: str, end_id: int, batch_bytes: int = 6_000_000, added_tokens: bool = False, frugal: bool = False):
    """Yields each text's ids with the end id, as int32 arrays. frugal: with less memory, in more time."""
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.string())
    e = encoder(path, added_tokens)
    e.call_chars = FEW_CALL_CHARS if frugal else CALL_CHARS
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = done = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(sizes, done + batch_bytes, "right")))
        ids, lengths = e.encode(texts[at:stop])
        begin = 0
        for n in lengths.tolist():
            out = np.empty(n + 1, np.int32)
            out[:n] = ids[begin : begin + n]
            out[n] = end_id
            begin += n
            yield out
        at, done = stop, int(sizes[stop - 1])
    workers.trim()


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
