"""Exact byte-level BPE over Arrow batches: vectorised pre-token cutting, each distinct pre-token encoded once.

The tokenizers library cuts a text into pre-tokens by one fixed pattern and merges bytes inside
each of them alone, so a text's tokens are those of its pre-tokens in a row. Pre-tokens are cut
here for a whole batch with array operations on bytes and looked up by their distinct values; only
unknown ones reach the library. Texts with a special token's string, or with a character whose
class could differ between Unicode versions, go to the library whole.
"""

from __future__ import annotations

import functools
import os
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import bytes_of

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

BLANK, SPACE, LETTER, NUMBER, OTHER, UNSURE = range(6)

#: Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Entries that a worker's cache may hold before it starts anew; about 170 MB.
CACHE_ENTRIES = 800_000

#: Caches of this Python worker, which serves many tasks: by tokenizer file and kind of value.
CACHES: dict[tuple, dict[bytes, object]] = {}


@functools.cache
def classes() -> np.ndarray:
    """Class of each code point below 0x20000 for the pre-token pattern."""
    old = unicodedata.ucd_3_2_0
    kind = {"L": LETTER, "N": NUMBER}
    table = np.full(0x20000, OTHER, np.uint8)
    for c in range(0x20000):
        category = unicodedata.category(chr(c))
        if category in ("Cn", "Cs"):
            table[c] = UNSURE
        elif category[0] in kind:
            table[c] = kind[category[0]] if old.category(chr(c))[0] == category[0] else UNSURE
    table[WHITE_SPACE] = SPACE
    table[0x20] = BLANK
    return table


def classify(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte of valid UTF-8 belongs to."""
    table = classes()
    out = table[data]
    high = np.flatnonzero(data >= 0xC0)
    if high.size:
        lead = data[high]
        for low, top, more in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0x100, 3)):
            at = high[(lead >= low) & (lead < top)]
            if not at.size:
                continue
            code = data[at].astype(np.int32) & (0x3F >> more)
            for k in range(1, more + 1):
                code = code << 6 | (data[at + k] & 0x3F)
            own = np.where(code < len(table), table[np.minimum(code, len(table) - 1)], UNSURE)
            for k in range(more + 1):
                out[at + k] = own
    return out


def starts_of(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Byte positions at which pre-tokens start; they tile each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)  # of a text
    first[offsets] = True
    white = kind <= SPACE
    group = np.where(white, np.uint8(SPACE), kind)
    run = first[:n].copy()
    run[1:] |= group[1:] != group[:-1]
    # A run of letters, numbers or others takes one blank before it along.
    after = np.flatnonzero(run[1:] & ~first[1:n] & ~white[1:] & white[:-1]) + 1
    start = run
    start[after[kind[after - 1] == BLANK]] = False
    # White space before a run gives its last character away.
    last = after - 1
    for _ in range(2):
        last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
    start[last] = True
    # 's 't 'm 'd 're 've 'll
    quote = np.flatnonzero((data == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1]]
    quote = quote[kind[quote + 1] == LETTER]
    if quote.size:
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & ~first[np.minimum(quote + 2, n)]
        for hit, size in ((quote[one], 2), (quote[two & ~one], 3)):
            start[hit + 1] = False
            rest = hit + size
            rest = rest[rest < n]
            start[rest[(kind[rest] == LETTER) & ~first[rest]]] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes batches with one tokenizer file; keeps what it learned for the next batch.

    ``known``: pre-tokens with their values, from a broadcast table. ``value`` maps a library
    encoding to what the cache holds for it: the number of ids, or the ids.
    """

    def __init__(self, path: str, value: Callable, known: dict | None = None, limit: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.value, self.known, self.limit = value, known or {}, limit
        self.cache = CACHES.setdefault((path, value), {})

    def whole(self, text: str):
        return self.value(self.tokenizer.encode(text, add_special_tokens=False))

    def values(self, tokens: list[bytes]) -> list:
        """Values of distinct pre-tokens."""
        cache, known = self.cache, self.known
        missing = [t for t in tokens if t not in known and t not in cache]
        if missing:
            if len(cache) + len(missing) > self.limit:
                cache.clear()
                missing = [t for t in tokens if t not in known]
            coded = self.tokenizer.encode_batch_fast([t.decode() for t in missing], add_special_tokens=False)
            cache.update(zip(missing, map(self.value, coded), strict=True))
        return [known[t] if t in known else cache[t] for t in tokens]

    def odd(self, column: pa.Array, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Texts that the library has to encode whole."""
        out = np.zeros(len(offsets) - 1, bool)
        unsure = np.flatnonzero(kind == UNSURE)
        if unsure.size:
            out[np.searchsorted(offsets, unsure, "right") - 1] = True
        for special in self.specials:
            out |= pc.fill_null(pc.match_substring(column, special), False).to_numpy(zero_copy_only=False)
        return out

    def cut(self, column: pa.Array):
        """(dictionary index of each pre-token, distinct pre-tokens, n+1 offsets of texts in the pre-tokens, odd texts)."""
        data, offsets = bytes_of(column)
        kind = classify(data)
        start = starts_of(data, offsets, kind)
        bounds = np.concatenate([start, [len(data)]]).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary.to_pylist(), np.searchsorted(start, offsets), self.odd(column, offsets, kind)
