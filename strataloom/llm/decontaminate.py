"""Benchmark decontamination by winnowing: shared fingerprints are joined, then extended to whole windows."""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bytes_of, materialize, slices, sums, table, words_of

#: Benchmark words that one broadcast index covers, some 30 bytes each; larger benchmarks take several passes.
BLOCK_WORDS = 2_000_000

NONE = np.iinfo(np.uint64).max


def lowered() -> np.ndarray:
    """Bytes as they count: A-Z lower-cased, what separates words as a blank."""
    table = np.arange(256, dtype=np.uint8)
    table[:0x80] = 0x20
    table[0x30:0x3A] = np.arange(0x30, 0x3A)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


LOWERED = lowered()


def gram_hashes(ids: np.ndarray, k: int, room: np.ndarray) -> np.ndarray:
    """A hash of the ``k`` word ids from each place on; NONE where fewer than ``k`` are left in the
    text (``room``) or one of the words is unknown (id 0)."""
    n = len(ids)
    out = np.full(n, NONE, np.uint64)
    if n < k:
        return out
    h, known = np.zeros(n - k + 1, np.uint64), np.ones(n - k + 1, bool)
    for j in range(k):
        part = ids[j : n - k + 1 + j]
        h = (h + part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        known &= part > 0
    fits = known & (room[: n - k + 1] >= k)
    out[: n - k + 1][fits] = np.minimum(h[fits], NONE - np.uint64(1))
    return out


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Places of the minimum of each window of ``w`` hashes, all of equal ones. What is kept in a
    window depends on that window alone, so texts that share w hashes in a row share a kept one."""
    if not len(h):
        return np.zeros(0, np.int64)
    padded = np.concatenate([np.full(w - 1, NONE, np.uint64), h, np.full(w - 1, NONE, np.uint64)])
    low = padded[: len(h) + w - 1].copy()
    for j in range(1, w):
        np.minimum(low, padded[j : j + len(h) + w - 1], out=low)
    high = low[: len(h)].copy()
    for j in range(1, w):
        np.maximum(high, low[j : j + len(h)], out=high)
    return np.flatnonzero((h == high) & (h != NONE))


def window_hashes(ids: np.ndarray, at: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A hash of the ``length`` word ids from each of some places on."""
    h = np.full(len(at), seed, np.uint64)
    for j in range(length):
        h = (h + ids[at + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Windows:
    """Distinct windows of one length: sorted hashes, a place of each in the benchmark, and the items that have it."""

    length: int
    seed: int
    hashes: np.ndarray
    place: np.ndarray
    first: np.ndarray
    items: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, at: np.ndarray, item: np.ndarray, length: int) -> Windows:
        for seed in range(100):
            hashes, place, index = np.unique(window_hashes(ids, at, length, seed), return_index=True, return_inverse=True)
            place = at[place]
            if all((ids[at + j] == ids[place[index] + j]).all() for j in range(length)):  # no two windows have one hash
                break
        pairs = np.unique(np.stack([index.reshape(-1), item], 1), axis=0)
        first = np.searchsorted(pairs[:, 0], np.arange(len(hashes) + 1))
        return Windows(length, seed, hashes, place.astype(np.int32), first.astype(np.int32), pairs[:, 1].astype(np.int32))

    def find(self, ids: np.ndarray, own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(those places of a text at which one of the windows stands, which one); words are compared."""
        if not len(self.hashes) or not len(at):
            return at[:0], at[:0]
        h = window_hashes(ids, at, self.length, self.seed)
        window = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        same = self.hashes[window] == h
        at, window = at[same], window[same]
        same = np.ones(len(at), bool)
        for j in range(self.length):
            same &= ids[at + j] == own[self.place[window] + j]
        return at[same], window[same]


class BenchmarkIndex:
    """Word ids, fingerprints and windows of some benchmark items; small enough to broadcast."""

    def __init__(self, item_ids: list, texts: pa.Array, window: int, k: int):
        self.window, self.k, self.item_ids = window, k, item_ids
        data, offsets = bytes_of(texts)
        words, first = words_of(LOWERED[data], offsets)
        coded = words.dictionary_encode()
        self.vocabulary = coded.dictionary
        ids = coded.indices.to_numpy().astype(np.int64) + 1 if len(words) else np.zeros(0, np.int64)
        self.ids = ids.astype(np.int32)
        size = np.diff(first)
        item_of = np.repeat(np.arange(len(size)), size)
        room = size[item_of] - (np.arange(len(ids)) - first[item_of])
        h = np.where(size[item_of] >= window, gram_hashes(ids, k, room), NONE)
        self.prints = np.unique(h[winnow(h, window - k + 1)])
        at = np.flatnonzero(room >= window)
        self.windows = [Windows.of(ids, at, item_of[at], window)]
        for m in sorted({int(x) for x in size if 0 < x < window}):
            at = first[:-1][size == m]
            self.windows.append(Windows.of(ids, at, item_of[at], m))

    @functools.cached_property
    def lookup(self) -> dict[str, int]:
        """Word ids by word."""
        return {w: i + 1 for i, w in enumerate(self.vocabulary.to_pylist())}

    @functools.cached_property
    def seen(self) -> np.ndarray:
        """Marks of the fingerprints' first bits, to pass most others by."""
        seen = np.zeros(1 << 20, bool)
        seen[(self.prints >> np.uint64(44)).astype(np.int64)] = True
        return seen

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("lookup", "seen")}

    def candidates(self, ids: np.ndarray, offsets: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Where full windows can start: around the fingerprints that the benchmark has too."""
        if not len(self.prints):
            return np.zeros(0, np.int64)
        h = gram_hashes(ids, self.k, room)
        at = winnow(h, self.window - self.k + 1)
        at = at[self.seen[(h[at] >> np.uint64(44)).astype(np.int64)]]
        at = at[self.prints[np.minimum(np.searchsorted(self.prints, h[at]), len(self.prints) - 1)] == h[at]]
        start = np.zeros(len(ids), bool)
        for back in range(self.window - self.k + 1):
            start[np.maximum(at - back, 0)] = True
        start = np.flatnonzero(start)
        return start[room[start] >= self.window]

    def hits(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(marks of hit words, text of each text-item pair, its item). Work is in proportion to the
        texts and to the pairs, however often a window is repeated on either side."""
        size = np.diff(offsets)
        text_of = np.repeat(np.arange(len(size)), size)
        room = offsets[1:][text_of] - np.arange(len(ids))
        edge, pairs = np.zeros(len(ids) + 1, np.int64), [np.zeros((0, 2), np.int64)]
        for windows in self.windows:
            m = windows.length
            at = self.candidates(ids, offsets, room) if m == self.window else np.flatnonzero((ids > 0) & (room >= m))
            at, window = windows.find(ids, self.ids, at)
            edge += np.bincount(at, minlength=len(edge)) - np.bincount(at + m, minlength=len(edge))
            met = np.unique(text_of[at] * len(windows.hashes) + window) if len(at) else at
            text, window = met // max(1, len(windows.hashes)), met % max(1, len(windows.hashes))
            n = windows.first[window + 1] - windows.first[window] if len(met) else met
            entry = np.repeat(windows.first[window] - (np.cumsum(n) - n), n) + np.arange(int(n.sum())) if len(met) else met
            pairs.append(np.stack([np.repeat(text, n), windows.items[entry].astype(np.int64)], 1))
        both = np.unique(np.concatenate(pairs), axis=0)
        return np.cumsum(edge[:-1]) > 0, both[:, 0], both[:, 1]


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, window: int, k: int, block_words: int):
    """Broadcast-sized indexes that together cover the benchmark."""
    b = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    # A word takes two bytes at least, with what separates it.
    n = b.agg(F.sum(F.octet_length("text") / 2 + 1).alias("n")).first().n or 0
    count = max(1, int(-(-n // block_words)))
    for i in range(count):
        part = b if count == 1 else b.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == i)
        table = part.toArrow()
        if table.num_rows or count == 1:
            yield BenchmarkIndex(table.column("id").to_pylist(), table.column("text").combine_chunks(), window, k)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    k: int = 5,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Benchmark windows in documents: (doc_id, n_words, n_hit, item_ids, spans).

    A window is ``window`` consecutive item words, or the whole of a shorter item that has words.
    Of the hashes of k words in a row, the least of every window - k + 1 is kept on both sides, so
    that each window that both have leaves a common fingerprint; hits are extended to the windows
    around them, which are looked up by hash and compared word by word, so results are exact and
    repeats on either side cost no pairs. Items below a window's length are looked up as wholes. ``spans`` are [start, end) of hit words, counted in words; ``item_ids``
    are the items with hit windows as strings, sorted, each once (items of null id hit, unlisted).

    The benchmark is broadcast, ``block_words`` at a time: one pass over the documents for each
    block, one after the other, and, for several blocks, one merge of the few documents with hits. Documents aren't
    shuffled otherwise. Null and empty texts have no words. A row gives a row; repeated rows, null
    ids, an empty benchmark and other columns do no harm.
    """
    spark = docs.sparkSession
    schema = "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int>>"

    def scan(index: BenchmarkIndex, keyed: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def run(batches):
            index = shared.value
            known = index.lookup
            for piece in slices(batches, text_col):
                data, offsets = bytes_of(piece.column(text_col))
                words, at = words_of(LOWERED[data], offsets)
                coded = words.dictionary_encode()
                table = np.array([known.get(w, 0) for w in coded.dictionary.to_pylist()], np.int64)
                ids = table[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
                hit, text, item = index.hits(ids, at)
                # Runs of hit words, which end with their text.
                head, tail = np.zeros(len(ids) + 1, bool), np.zeros(len(ids) + 1, bool)
                head[at], tail[at] = True, True
                starts = np.flatnonzero(hit & (head[:-1] | ~np.concatenate([[False], hit[:-1]]))) if len(ids) else np.zeros(0, np.int64)
                ends = np.flatnonzero(hit & (tail[1:] | ~np.concatenate([hit[1:], [False]]))) + 1 if len(ids) else starts
                own = np.searchsorted(at, starts, "right") - 1
                spans: list[list] = [[] for _ in range(len(at) - 1)]
                for t, a, b in zip(own.tolist(), (starts - at[own]).tolist(), (ends - at[own]).tolist(), strict=True):
                    spans[t].append({"start": a, "end": b})
                items: list[set] = [set() for _ in range(len(at) - 1)]
                for t, i in zip(text.tolist(), item.tolist(), strict=True):
                    items[t].add(index.item_ids[i])
                out = [pc.cast(piece.column(id_col), pa.int64()), pa.array(np.diff(at)), pa.array(sums(hit.astype(np.int64), at)), pa.array([sorted(x - {None}) for x in items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
                names = ["doc_id", "n_words", "n_hit", "item_ids", "spans"]
                if keyed:
                    out, names = [*out, piece.column("__key")], [*names, "__key"]
                yield pa.RecordBatch.from_arrays(out, names)

        source = docs.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{text_col}`").cast("string").alias(text_col), *([text_key(docs, id_col, text_col)] if keyed else []))
        return arrow_rows(source, [id_col, text_col, *(["__key"] if keyed else [])], run, schema + (", __key string" if keyed else ""))

    indexes = blocks_of(benchmark, item_id_col, item_text_col, window, k, block_words)
    first = next(indexes)
    second = next(indexes, None)
    if second is None:
        return scan(first, False)
    # Written one after the other, so that a worker holds one index at a time.
    passes = [materialize(scan(first, True), "leaks-all")]
    passes += [materialize(scan(x, True).where("n_hit > 0"), "leaks") for x in itertools.chain([second], indexes)]
    found = functools.reduce(DataFrame.unionByName, [passes[0].where("n_hit > 0"), *passes[1:]])
    found = found.dropDuplicates(["__key", "item_ids", "spans"])
    merged = found.groupBy("__key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("i"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"))
    # Join overlapping and touching spans in order.
    start = F.array().cast("array<struct<start:int,end:int>>")
    join = lambda a, x: F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1)["end"] >= x["start"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.get(a, F.size(a) - 1)["start"].alias("start"), F.greatest(F.get(a, F.size(a) - 1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(x)))
    merged = merged.withColumn("s", F.aggregate("s", start, join))
    merged = merged.withColumn("h", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]).cast("long")))
    every = passes[0].select("doc_id", "n_words", "__key").join(merged, "__key", "left")
    return every.select("doc_id", "n_words", F.coalesce("h", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("i", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("s", start).alias("spans"))


def text_key(docs: DataFrame, id_col: str, text_col: str):
    """Rows of one id and text are alike in every pass."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return F.concat_ws(":", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.sha2(text, 256)).alias("__key")


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, k: int = 5, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The rows of ``docs`` in whose text no benchmark window occurs, all columns as they are.

    The same search as ``find_contamination``, but rows are kept or dropped where they are read:
    there is no shuffle. A further block of the benchmark is a further pass over what the one before
    kept, which is written. Null and empty texts have no words and stay; repeated rows stay or go
    alike; an empty table or benchmark drops nothing, and columns of any name are kept.
    """
    spark = docs.sparkSession

    def clean(docs, index):
        shared = spark.sparkContext.broadcast(index)

        def run(batches):
            index = shared.value
            known = index.lookup
            for piece in slices(batches, text_col):
                data, offsets = bytes_of(piece.column(text_col))
                words, at = words_of(LOWERED[data], offsets)
                coded = words.dictionary_encode()
                table = np.array([known.get(w, 0) for w in coded.dictionary.to_pylist()], np.int64)
                hit = index.hits(table[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64), at)[0]
                yield piece.filter(pa.array(sums(hit.astype(np.int64), at) == 0))

        return arrow_rows(docs, docs.columns, run, docs.schema)

    indexes = blocks_of(benchmark, item_id_col, item_text_col, window, k, block_words)
    kept = clean(docs, next(indexes))
    for index in indexes:
        kept = clean(materialize(kept, "clean"), index)
    return kept


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
