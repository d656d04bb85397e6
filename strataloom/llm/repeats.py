"""Substring dedup by hashing units that are cut by content: the earliest occurrence stays."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, bytes_of, materialize, slices, table

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True
#: Words among which one of least hash ends a unit: a passage of 50 words has 27 in whole units of its own.
WINDOW = 12

#: The rank of rows without an id, which is the last.
LAST = (1 << 63) - 1

#: Bytes of text whose words and units a worker holds at a time.
PIECE_BYTES = 400_000


def sentence_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where sentences end: after a line break, after a stop before white space, and at the end of a text."""
    end = np.zeros(len(data) + 1, bool)
    end[offsets] = True
    end[1:] |= data == 0x0A
    if len(data) > 1:
        end[1:-1] |= STOP[data[:-1]] & WHITE[data[1:]]
    return np.flatnonzero(end[1:]) + 1


def words_at(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of all texts."""
    word = ~WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = word & (edge[:-1] | np.concatenate([[True], ~word[:-1]]))
    ends = word & (edge[1:] | np.concatenate([~word[1:], [True]]))
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def least_of_windows(hashes: np.ndarray, text: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Whether each word has the least hash, the last one of equal ones, of some ``window`` words of its text;
    words all the same choose none."""
    chosen = np.zeros(len(hashes), bool)
    if len(hashes) >= window:
        each = np.lib.stride_tricks.sliding_window_view(hashes, window)
        at = np.arange(len(each)) + window - 1 - each[:, ::-1].argmin(axis=1)
        chosen[at[(text[: len(each)] == text[window - 1 :]) & (each.max(axis=1) > each.min(axis=1))]] = True
    return chosen


def digest_ranges(first: np.ndarray, last: np.ndarray, lines: np.ndarray, texts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Words [from, to) that stand for the units [first, last): ``least`` of them at least, the next
    ones within the sentence, else the ones before; short sentences take what follows. ``lines`` and
    ``texts`` are the bounds of all sentences and texts in words."""
    line = np.searchsorted(lines, first, "right") - 1
    text = np.searchsorted(texts, first, "right") - 1
    low, high = lines[line], lines[line + 1]
    short = high - low < least
    to = np.minimum(np.maximum(last, first + least), np.where(short, texts[text + 1], high))
    return np.where(short, first, np.minimum(first, np.maximum(low, to - least))), to


def units_of(docs: DataFrame, id_col: str, text_col: str, min_unit_words: int) -> DataFrame:
    """Units of whole texts: (row, doc_id, unit, start, end, words, digest); places are counted in
    characters, the digest is 64 bits of the normalised words."""
    numbered = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))

    def run(batches):
        import xxhash

        for piece in slices(batches, "text", PIECE_BYTES):
            data, offsets = bytes_of(piece.column("text"))
            raw, (begin, finish) = data.tobytes().lower(), words_at(data, offsets)
            if not len(begin):
                continue
            bounds = list(zip(begin.tolist(), finish.tolist(), strict=True))
            hashes = np.fromiter((zlib.crc32(raw[a:b]) for a, b in bounds), np.uint32, len(bounds))
            in_text = np.searchsorted(offsets, begin, "right") - 1
            lines = np.unique(np.searchsorted(begin, np.concatenate([[0], sentence_ends(data, offsets)])))
            texts = np.unique(np.searchsorted(begin, offsets))
            last = np.union1d(np.flatnonzero(least_of_windows(hashes, in_text)) + 1, lines[1:])
            first = np.concatenate([[0], last[:-1]])
            low, high = digest_ranges(first, last, lines, texts, min_unit_words)
            digest = np.array([xxhash.xxh3_64_intdigest(b" ".join(raw[a:b].split())) for a, b in zip(begin[low].tolist(), finish[high - 1].tolist(), strict=True)], np.uint64).view(np.int64)
            # A unit ends with its last word, or where its sentence or text ends; the next one goes on from there.
            forced = sentence_ends(data, offsets)
            ends, sizes, kept = finish[last - 1], last - first, np.arange(len(first))
            stop = forced[np.minimum(np.searchsorted(forced, ends), len(forced) - 1)]
            ends = np.where(np.isin(last, lines), stop, ends)
            starts = np.where(np.isin(first, texts), offsets[in_text[first]], np.concatenate([[0], ends[:-1]]))
            text = in_text[first]
            characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            base = characters[offsets[text]]
            unit = np.arange(len(kept)) - np.searchsorted(text, text, "left")
            take = lambda name: piece.column(name).take(pa.array(text))
            yield pa.RecordBatch.from_arrays(
                [take("row"), take("doc_id"), pa.array(unit.astype(np.int32)), pa.array((characters[starts[kept]] - base).astype(np.int32)), pa.array((characters[ends[kept]] - base).astype(np.int32)), pa.array(sizes[kept].astype(np.int32)), pa.array(digest)],
                ["row", "doc_id", "unit", "start", "end", "words", "digest"],
            )

    return arrow_rows(numbered, ["row", "doc_id", "text"], run, "row long, doc_id long, unit int, start int, end int, words int, digest long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_unit_words: int = 4, min_span_words: int = 25) -> DataFrame:
    """Spans to remove: (doc_id, row, start, end, n_units, n_words, first_doc_id).

    Texts are cut at line breaks, ends of sentences, and after each word that has the least hash of
    some ``WINDOW`` words, with A-Z lower-cased and white space collapsed. So inside a passage the cuts are the same
    wherever it stands, and one of 50 words has at least 27 in whole units. A unit is known by a
    64-bit digest of its words, or of ``min_unit_words`` around its start where it has fewer. Equal
    units are grouped over the whole corpus, and all but the earliest, by document id and place
    (null ids last), are repeats. Runs of repeats next to each other are spans; those of
    ``min_span_words`` words or more are returned, so that phrases that texts share by chance stay
    (1 returns every repeated unit). ``start`` and ``end`` are the original places in characters,
    and ``first_doc_id`` is the least document in which the units of the span stay.

    Digests are grouped with partial aggregation and joined back only where they are repeated; a
    hot line is one digest, whose side of the join Spark splits. Texts don't leave their tasks.
    Null and empty texts have no units, and an empty table gives no spans. Of repeated rows one
    counts as the earlier; ``row`` tells them apart. Other columns, whatever their names, are ignored.
    """
    units = materialize(units_of(docs, id_col, text_col, min_unit_words), "units")
    rank = F.coalesce("doc_id", F.lit(LAST))
    first = units.groupBy("digest").agg(F.min(F.struct(rank.alias("rank"), F.col("row").alias("row"), F.col("start").alias("at"))).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    # Written, so that the join deals both sides anew and Spark can split a hot digest's rows.
    first = materialize(first, "units-first")
    met = units.join(first, "digest").where(~((F.col("row") == F.col("first.row")) & (F.col("start") == F.col("first.at"))))
    own = Window.partitionBy("row").orderBy("unit")
    runs = met.withColumn("run", F.col("unit") - F.row_number().over(own))
    spans = runs.groupBy("row", "run").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_units"), F.sum("words").alias("n_words"), F.nullif(F.min("first.rank"), F.lit(LAST)).alias("first_doc_id")
    )
    return spans.where(F.col("n_words") >= min_span_words).select("doc_id", "row", "start", "end", "n_units", "n_words", "first_doc_id")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_unit_words: int = 4, min_span_words: int = 25) -> DataFrame:
    """``docs`` with repeated spans cut out of the texts, all columns kept; row order is free.

    The rows are numbered as they are read, so ``docs`` has to give the same rows in the same
    partitions twice, as a table does. Null texts stay null; rows that repeat another lose what the
    earlier one keeps, but stay. Columns of any name are kept, and an empty table gives an empty one.
    """
    spans = repeated_spans(docs, id_col, text_col, min_unit_words, min_span_words)
    cuts = spans.groupBy(F.col("row").alias("__row")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__cuts"))
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    joined = numbered.join(cuts, "__row", "left")
    text = F.col(f"`{text_col}`")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, c: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, c["start"] - a["at"])).alias("out"), c["end"].alias("at"))
    kept = F.aggregate("__cuts", start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return joined.withColumn(text_col, F.when(F.col("__cuts").isNull(), text).otherwise(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_repeated_spans(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return repeated_spans(docs).drop("row")
