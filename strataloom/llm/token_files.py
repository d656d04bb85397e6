"""Token ids in flat unsigned-integer files with 64-bit document offsets, to be memory-mapped.

Layout of a folder, for each shard of consecutive document ids:

* ``shard-00000.bin``: the ids of all its documents in a row, little-endian uint16 or uint32;
* ``shard-00000.idx``: n+1 little-endian uint64, the place of each document's first id counted over
  all shards, and the end; then n int64 document ids, then n bytes that are 1 where the id is null;

and ``manifest.json`` with the width of an id and each shard's documents, ids and first place.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, filesystem, shared_path, ship, slices, table, write_atomic
from .pretokens import Encoder


def packed16(encoding) -> bytes:
    return np.array(encoding.ids, "<u2").tobytes()


def packed32(encoding) -> bytes:
    return np.array(encoding.ids, "<u4").tobytes()


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int, width: int, bounds: list[int], id_col: str, text_col: str) -> DataFrame:
    """(shard, doc_id, ids) with the ids of each whole text and ``end_id`` as bytes; ``bounds`` are
    the largest document ids of all shards but the last, and null ids come first."""
    pack = packed16 if width == 2 else packed32
    end, edges = np.array([end_id], f"<u{width}").tobytes(), np.array(bounds, np.int64)

    def run(batches):
        encoder = Encoder(tokenizer_path, pack)
        for piece in slices(batches, text_col):
            column, ids = piece.column(text_col), pc.cast(piece.column(id_col), pa.int64())
            index, distinct, offsets, odd = encoder.cut(column)
            # All distinct pre-tokens' ids in a row, and from there the ids of each pre-token in turn.
            values = encoder.values(distinct)
            size = np.fromiter(map(len, values), np.int64, len(values)) // width
            pool = np.frombuffer(b"".join(values), f"<u{width}")
            first = np.cumsum(size) - size
            each = size[index]
            upto = np.concatenate([[0], np.cumsum(each)])
            flat = pool[np.repeat(first[index] - upto[:-1], each) + np.arange(upto[-1])].tobytes()
            at = (upto[offsets] * width).tolist()
            out = [flat[a:b] + end for a, b in zip(at, at[1:], strict=False)]
            for i in np.flatnonzero(odd):
                out[i] = encoder.whole(column[int(i)].as_py()) + end
            shard = np.searchsorted(edges, pc.fill_null(ids, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "left")
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), ids, pa.array(out, pa.binary())], ["shard", "doc_id", "ids"])

    return arrow_rows(docs, [id_col, text_col], run, "shard int, doc_id long, ids binary")


def shard_files(folder: str, shard: int) -> tuple[str, str]:
    return f"{folder}/shard-{shard:05d}.bin", f"{folder}/shard-{shard:05d}.idx"


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> dict:
    """Write the token ids of all documents in ascending id order to ``folder``; returns the manifest.

    Documents are encoded where they are read, so that only ids, at two bytes each where the
    vocabulary allows, go through the one shuffle; it deals them to shards by ranges of the
    document id. Each task writes its shard under a temporary name and renames it, so a repeated
    task leaves the same files. Shards' first places are prefix sums of their counts (one row a
    shard reaches the driver), and are then added to the offsets.

    Null texts are empty documents of one id, the end. Null document ids come first; documents of
    one id stand in the order of their token bytes. Without documents there are no shards.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = [i / shards for i in range(1, shards)]
    found = docs.agg(F.percentile_approx(F.col(f"`{id_col}`").cast("long"), F.array(*map(F.lit, points)), 20 * shards).alias("p")).first().p if points else None
    encoded = encode_documents(docs, tokenizer_path, end_id, width, sorted(set(found or [])), id_col, text_col)
    dealt = encoded.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "ids")

    def write(batches):
        rows = []
        state = {"shard": None, "sizes": [], "ids": [], "null": []}

        def chunks():
            """The bytes of all documents; the partition is one shard."""
            for batch in batches:
                if not batch.num_rows:
                    continue
                state["shard"] = batch.column("shard")[0].as_py()
                state["sizes"].append(pc.binary_length(batch.column("ids")).to_numpy().astype(np.int64) // width)
                state["ids"].append(pc.fill_null(batch.column("doc_id"), 0).to_numpy(zero_copy_only=False))
                state["null"].append(pc.is_null(batch.column("doc_id")).to_numpy(zero_copy_only=False))
                yield b"".join(batch.column("ids").to_pylist())

        source = chunks()
        head = next(source, None)
        if head is not None:
            binary, index = shard_files(folder, state["shard"])

            def every():
                yield head
                yield from source

            write_atomic(binary, every())
            sizes = np.concatenate(state["sizes"])
            local = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
            write_atomic(index, [local.tobytes(), np.concatenate(state["ids"]).astype("<i8").tobytes(), np.concatenate(state["null"]).astype("u1").tobytes()])
            rows.append((state["shard"], len(sizes), int(sizes.sum())))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["shard", "docs", "tokens"])

    written = sorted(tuple(r) for r in dealt.mapInArrow(write, "shard int, docs long, tokens long").collect())
    base, entries = 0, []
    for shard, n_docs, n_tokens in written:
        entries.append({"shard": shard, "docs": n_docs, "tokens": n_tokens, "base": base})
        base += n_tokens

    def place(batches):
        """Add the shard's first place to its offsets; doing it again changes nothing."""
        for batch in batches:
            for shard, n, base in zip(*(batch.column(c).to_pylist() for c in ("shard", "docs", "base")), strict=True):
                index = shard_files(folder, shard)[1]
                system, path = filesystem(index)
                with system.open_input_file(path) as f:
                    raw = f.read()
                offsets = np.frombuffer(raw, "<u8", n + 1)
                write_atomic(index, [(offsets - offsets[0] + np.uint64(base)).astype("<u8").tobytes(), raw[8 * (n + 1) :]])
            yield pa.RecordBatch.from_arrays([batch.column("shard")], ["shard"])

    if entries:
        manifest_rows(spark, entries).mapInArrow(place, "shard int").collect()
    manifest = {"width": width, "end_id": end_id, "documents": sum(e["docs"] for e in entries), "tokens": base, "shards": entries}
    write_atomic(f"{folder}/manifest.json", [json.dumps(manifest).encode()])
    return manifest


def manifest_rows(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """One row, and one task, for each shard."""
    ship(spark)
    rows = [(e["shard"], e["docs"], e["tokens"], e["base"]) for e in entries]
    return spark.createDataFrame(rows, "shard int, docs long, tokens long, base long").repartition(max(1, len(rows)))


def open_shard(folder: str, entry: dict, width: int) -> tuple[Callable[[int, int], np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(ids by their places in the shard, offsets counted over all shards, document ids, null
    marks), memory-mapped where the folder is on a mounted file system; elsewhere ids are read in
    the ranges asked for."""
    from pyarrow import fs

    n, (ids, index) = entry["docs"], shard_files(folder, entry["shard"])
    system, path = filesystem(ids)
    if isinstance(system, fs.LocalFileSystem):
        mapped = np.memmap(path, f"<u{width}", "r") if entry["tokens"] else np.zeros(0, f"<u{width}")
        read = lambda a, b: mapped[a:b]
        raw = np.memmap(filesystem(index)[1], np.uint8, "r")
    else:
        file = system.open_input_file(path)
        read = lambda a, b: np.frombuffer(file.read_at((b - a) * width, a * width), f"<u{width}")
        with system.open_input_file(filesystem(index)[1]) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    return read, raw[: 8 * (n + 1)].view("<u8"), raw[8 * (n + 1) : 8 * (2 * n + 1)].view("<i8"), raw[8 * (2 * n + 1) :]


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the files: ``start`` ids of
    other documents come before it, and the checksum is over its ids as little-endian uint32."""
    system, path = filesystem(f"{folder}/manifest.json")
    with system.open_input_file(path) as f:
        manifest = json.loads(f.read())
    width = manifest["width"]

    def run(batches):
        for batch in batches:
            for entry in batch.to_pylist():
                ids, offsets, docs, null = open_shard(folder, entry, width)
                local = (offsets - offsets[0]).astype(np.int64)
                for at in range(0, entry["docs"], 10_000):
                    to = min(at + 10_000, entry["docs"])
                    part, base = ids(int(local[at]), int(local[to])), local[at]
                    sums = [zlib.crc32(part[local[i] - base : local[i + 1] - base].astype("<u4").tobytes()) for i in range(at, to)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[at:to].astype(np.int64), mask=null[at:to].astype(bool)), pa.array(offsets[at:to].astype(np.int64)), pa.array(np.diff(local[at : to + 1])), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return manifest_rows(spark, manifest["shards"]).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    folder = shared_path(spark, "token-files")
    write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, folder)
