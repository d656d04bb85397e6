"""Token counts by a two-tier map-side lookup of pre-token lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bytes_of, materialize, most_frequent, slices, sums, table
from .pretokens import Encoder

#: Entries of the broadcast table; about 1 MB.
FREQUENT = 50_000

#: Candidates that a task reports for the table.
PER_TASK = 2_000


def frequent_pretokens(docs: DataFrame, text_col: str, tokenizer_path: str, size: int = FREQUENT, per_task: int = PER_TASK) -> list[bytes]:
    """The ``size`` pre-tokens that the tasks' own ``per_task`` most frequent ones add up to, over
    all texts. What reaches the shuffle is bounded by tasks x ``per_task``; the table only decides
    what is looked up where, never a count."""

    def top(batches):
        encoder, counts = Encoder(tokenizer_path, len), {}
        for piece in slices(batches, text_col):
            index, tokens, _, _ = encoder.cut(piece.column(text_col))
            for t, n in zip(tokens, np.bincount(index, minlength=len(tokens)).tolist(), strict=True):
                counts[t] = counts.get(t, 0) + n
            if len(counts) > 50 * per_task:
                counts = dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: 10 * per_task])
        best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:per_task]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in best], pa.binary()), pa.array([n for _, n in best], pa.int64())], ["token", "n"])

    found = arrow_rows(docs, [text_col], top, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return [bytes(r.token) for r in most_frequent(materialize(found, "frequent-pretokens"), "n", size).collect()]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, frequent: int = FREQUENT) -> DataFrame:
    """Tokens of each whole text: (doc_id, n_bytes, n_tokens, over_limit).

    Lengths of frequent pre-tokens come from a broadcast table of at most ``frequent`` entries,
    others from a cache in the Python worker that the tokenizers library fills; no pre-token is
    shuffled. Null and empty texts have 0 bytes and tokens. A row gives a row: null ids, repeated
    rows and other columns make no difference.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    tokens = frequent_pretokens(docs, text_col, tokenizer_path, frequent)
    lengths = [len(e.ids) for e in Tokenizer.from_file(tokenizer_path).encode_batch_fast([t.decode() for t in tokens], add_special_tokens=False)]
    table = spark.sparkContext.broadcast((tokens, lengths))

    def run(batches):
        encoder = Encoder(tokenizer_path, len, dict(zip(*table.value, strict=True)))
        for piece in slices(batches, text_col):
            column = piece.column(text_col)
            index, distinct, offsets, odd = encoder.cut(column)
            lengths = np.array(encoder.values(distinct), np.int64)
            n = sums(lengths[index] if len(distinct) else np.zeros(0, np.int64), offsets)
            for i in np.flatnonzero(odd):
                n[i] = encoder.whole(column[int(i)].as_py())
            size = np.diff(bytes_of(column)[1])
            yield pa.RecordBatch.from_arrays([pc.cast(piece.column(id_col), pa.int64()), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return arrow_rows(docs, [id_col, text_col], run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
