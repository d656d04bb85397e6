"""SimHash near-duplicates: candidates by the pigeonring principle, exact links, distributed components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bytes_of, discard, materialize, ship, slices, table, tidy
from .graph import connected_components

#: Segments that a fingerprint's 64 bits are cut into, and the largest distance their keys are complete for.
SEGMENTS, RADIUS = 8, 3

#: Fingerprints of one key that are compared in one piece; larger buckets are cut into tiles.
TILE = 4096

#: Texts that are sampled for frequent shingles, and in how many of them a frequent one is.
SAMPLE, FREQUENT = 5000, 5

#: A text's sketch is its so many least shingles, or all if it has no more.
SKETCH = 128

#: Columns of the parities of a sketch, 64 in each.
PARITIES = tuple(f"p{i}" for i in range(8))

#: Columns of the parities of all shingles, 64 in each.
WHOLE = tuple(f"w{i}" for i in range(16))

#: Members by which the sketches of two similar texts differ at most, where a text has more shingles than its sketch.
SKETCHES_APART = 126

#: Columns of a text's first keys, by which a pair is told under which of its keys it is made.
FIRST = tuple(f"k{i}" for i in range(8))

#: Members of a bucket that meet all others, in turn, before all pairs do.
HEADS = (2, 16)


def shingle_hashes(text: bytes, n: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``n`` words (all words if there are fewer), in order, repeats included."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray, chunk: int = 200_000) -> int:
    """64 bits, each set if it is set in more than half of the hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), chunk):
        part = np.unpackbits(hashes[i : i + chunk].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes)).view(">u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, n: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of each whole text's word shingles, A-Z lower-cased, as a signed long."""

    def run(batches):
        for piece in slices(batches, text_col):
            data, offsets = bytes_of(piece.column(text_col))
            raw, at = data.tobytes(), offsets.tolist()
            found = np.array([fingerprint(shingle_hashes(raw[a:b], n, seed)) for a, b in zip(at, at[1:], strict=False)], np.uint64)
            yield pa.RecordBatch.from_arrays([pc.cast(piece.column(id_col), pa.int64()), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return arrow_rows(docs, [id_col, text_col], run, "doc_id long, fp long")


def bucket_keys(fp: Column) -> Column:
    """The 24 keys under which fingerprints within ``RADIUS`` bits meet.

    Cut two such fingerprints into 8 segments on a ring. By the pigeonring principle some segment
    starts a chain whose first l segments differ in at most l * 3 / 8 bits together for every l:
    none in the first two, at most one in the first five. So the first two segments agree and at
    least two of the next three: with any of 8 starts and 3 ways to leave one out, one of these
    32-bit keys is common.
    """
    keys = []
    for start in range(SEGMENTS):
        ring = F.shiftleft(fp, 8 * start).bitwiseOR(F.shiftrightunsigned(fp, 64 - 8 * start)) if start else fp
        low, mid = F.lit(0xFF).cast("long"), F.lit(0xFFFF).cast("long")
        for left_out, key in enumerate(
            (
                F.shiftrightunsigned(ring, 32),
                F.shiftleft(F.shiftrightunsigned(ring, 40), 8).bitwiseOR(F.shiftrightunsigned(ring, 24).bitwiseAND(low)),
                F.shiftleft(F.shiftrightunsigned(ring, 48), 16).bitwiseOR(F.shiftrightunsigned(ring, 24).bitwiseAND(mid)),
            )
        ):
            keys.append(key.bitwiseOR(F.lit((3 * start + left_out) << 32)))
    return F.array(*keys)


def chain_holds(difference: np.ndarray, start: np.ndarray | int, radius: int) -> np.ndarray:
    """Whether the chain from segment ``start`` keeps all its budgets; the last is the full Hamming check."""
    shift = np.asarray(start, np.uint64) * np.uint64(8)
    ring = difference << shift | np.where(shift > 0, difference >> (np.uint64(64) - shift) % np.uint64(64), np.uint64(0))
    ok = np.bitwise_count(ring >> np.uint64(24)) <= 5 * radius // SEGMENTS
    for length in (6, 7, 8):
        ok &= np.bitwise_count(ring >> np.uint64(64 - 8 * length)) <= length * radius // SEGMENTS
    return ok


def forest(members: np.ndarray, start: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever the links of these fingerprints connect, one less than members at most."""
    a, b, left, frontier = [], [], members, []
    while left.size:
        if not frontier:
            frontier, left = [left[0]], left[1:]
        while frontier and left.size:
            x = frontier.pop()
            near = chain_holds(left ^ x, start, radius)
            if near.any():
                found = left[near]
                a.append(np.full(len(found), x)), b.append(found)
                frontier.extend(found)
                left = left[~near]
        frontier = []
    empty = np.zeros(0, np.uint64)
    return np.concatenate([*a, empty]), np.concatenate([*b, empty])


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between fingerprints (fp, distinct) that connect exactly what the pairs within
    ``radius`` bits connect.

    Fingerprints meet under 24 keys; keys of one fingerprint are dropped. In a bucket only a
    spanning forest of its links is emitted, never all pairs. A bucket of more than ``tile``
    members is cut into blocks, and each pair of blocks is a piece of its own, so no task ever
    holds more than two blocks of it.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the keys are complete up to {RADIUS} bits, not for {radius}")
    ship(distinct.sparkSession)
    keyed = distinct.select("fp", F.explode(bucket_keys(F.col("fp"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / tile).cast("int")
    met = keyed.join(shared, "key").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pieces = met.select("key", "fp", "blocks", "own", other.alias("other")).select("key", "fp", (F.least("own", "other").cast("long") * F.col("blocks") + F.greatest("own", "other")).alias("piece"))
    dealt = pieces.repartition(F.col("key"), F.col("piece")).sortWithinPartitions("key", "piece", "fp")

    def run(batches):
        held = None

        def links(key, piece, fp):
            """Forests of whole groups; rows are sorted by group."""
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])]))
            size = np.diff(np.concatenate([edge, [len(key)]]))
            start = (key >> 32) // 3
            two = edge[size == 2]
            ok = chain_holds(fp[two] ^ fp[two + 1], start[two], radius)
            a, b = [fp[two][ok]], [fp[two + 1][ok]]
            for at, n in zip(edge[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                x, y = forest(fp[at : at + n], int(start[at]), radius)
                a.append(x), b.append(y)
            a, b = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a.view(np.int64), b.view(np.int64))), pa.array(np.maximum(a.view(np.int64), b.view(np.int64)))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in ("key", "piece", "fp")]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            key, piece, _ = rows
            last = int(np.flatnonzero((key != key[-1]) | (piece != piece[-1]))[-1]) + 1 if ((key != key[-1]) | (piece != piece[-1])).any() else 0
            if last:
                yield links(*(x[:last] if i < 2 else x[:last].view(np.uint64) for i, x in enumerate(rows)))
            held = [x[last:] for x in rows]
        if held is not None and len(held[0]):
            yield links(held[0], held[1], held[2].view(np.uint64))

    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, n: int = 3, radius: int = RADIUS, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints chains of links join are a
    component, and ``component_id`` is its least document id.

    Texts without words have fingerprint zero and link like others. Equal fingerprints are one
    vertex, so copies cost an aggregate and a join whatever their number; its hot fingerprints are
    split by Spark. One row comes out per row, repeated rows too; null ids count in no minimum,
    and a component without an id has none. Other columns are ignored.
    """
    own = materialize(fingerprints(docs, n, seed, id_col, text_col), "simhash")
    distinct = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    labels = connected_components(materialize(link_fingerprints(distinct.select("fp"), radius, tile), "simhash-links"))
    named = distinct.join(labels.withColumnRenamed("v", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    # Written, so that the join deals both sides anew and Spark can split a component of many fingerprints.
    least = materialize(named.groupBy("label").agg(F.min("least").alias("component_id")), "simhash-least")
    classes = named.join(least, "label").select("fp", "component_id")
    return own.join(classes, "fp").select("doc_id", "fp", "component_id")


def frequent_shingles(docs: DataFrame, n: int, id_col: str, text_col: str) -> np.ndarray:
    """Sorted hashes of the shingles in at least ``FREQUENT`` texts of a sample of about ``SAMPLE``.

    They only order the shingles, so the sample decides about time and never about results.
    """
    share = min(1.0, SAMPLE / max(1, docs.count()))
    picked = docs.where(F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches):
        for piece in slices(batches, text_col):
            data, offsets = bytes_of(piece.column(text_col))
            raw, at = data.tobytes(), offsets.tolist()
            grams = [np.unique(shingle_hashes(raw[a:b], n, 42)) for a, b in zip(at, at[1:], strict=False)]
            found, count = np.unique(np.concatenate(grams), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(count)], ["gram", "n"])

    counted = arrow_rows(picked, [id_col, text_col], run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return np.sort(counted.where(F.col("n") >= FREQUENT).select("gram").toArrow().column("gram").to_numpy().astype(np.int64).view(np.uint64))


def prefix_of(grams: np.ndarray, similarity: float, frequent: np.ndarray) -> np.ndarray:
    """The first of sorted distinct ``grams``, frequent ones last: two sets of at least this Jaccard
    similarity share one of them, as each set has fewer others than it may miss."""
    size = len(grams) - int(np.ceil(similarity * len(grams) - 1e-9)) + 1 if len(grams) else 0
    if len(frequent) and len(grams):
        late = frequent[np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)] == grams
        grams = np.concatenate([grams[~late], grams[late]])
    return grams[:size]


def parity(members: np.ndarray, columns: tuple[str, ...] = PARITIES) -> np.ndarray:
    """64 parities a column of the hashes by their last bits: of two sets no more of them differ than members do."""
    bits = 64 * len(columns)
    odd = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_apart(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """By how many members the sketches of two texts of this similarity differ at most, given the
    texts' numbers of shingles. Whole sets differ by a share of their sizes. Of the 128 least hashes of
    both sets together each is in both with the similarity as its chance, so 65 are but for one pair
    of 0.8 in 10**12, and are in both sketches."""
    whole = (1 - similarity) / (1 + similarity) * (a + b) + 1e-9
    return np.where(np.maximum(a, b) <= SKETCH, whole, SKETCHES_APART if similarity >= 0.8 else 2 * SKETCH)


def text_signatures(docs: DataFrame, id_col: str, text_col: str, n: int, similarity: float, frequent: np.ndarray) -> DataFrame:
    """(doc_id, own, v, fp, size, p0, ..., keys): a hash of the text as it is, one of its words in
    order, the SimHash of the set of its words, and of its distinct ``n``-word shingles the number,
    the parities of the sketch and of all, and the keys."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).withColumn("own", F.xxhash64("text"))
    names = ["doc_id", "own", "v", "fp", "size", *PARITIES, *WHOLE]
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        import xxhash

        for piece in slices(batches, "text"):
            data, offsets = bytes_of(piece.column("text"))
            raw, at = data.tobytes().lower(), offsets.tolist()
            texts = [raw[a:b].split() for a, b in zip(at, at[1:], strict=False)]
            v = np.array([xxhash.xxh3_64_intdigest(b" ".join(t)) for t in texts], np.uint64)
            known: dict[bytes, int] = {}
            index = [np.fromiter({known.setdefault(w, len(known)) for w in t}, np.int64) for t in texts]
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
            fp = np.array([fingerprint(hashes[i]) for i in index], np.uint64)
            grams = [np.unique(shingle_hashes(raw[a:b], n, 42)) for a, b in zip(at, at[1:], strict=False)]
            odd = np.array([np.concatenate([parity(g[:SKETCH]), parity(g, WHOLE)]) for g in grams], np.int64).reshape(-1, len(PARITIES) + len(WHOLE))
            keys = pa.array([prefix_of(g, similarity, shared.value).view(np.int64) for g in grams], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("own"), pa.array(v.view(np.int64)), pa.array(fp.view(np.int64)), pa.array([len(g) for g in grams], pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in odd.T), keys],
                [*names, "keys"],
            )

    return arrow_rows(source, ["doc_id", "own", "text"], run, ", ".join(f"{n} long" for n in names) + ", keys array<long>")


def first_keys(members: DataFrame) -> DataFrame:
    """``members`` (key, v, place) under one key for each set of texts: of the keys that the same texts
    have, the first in the common order. Whatever meets under one of them meets under that one, where
    the places are least. Sets are told apart by their least member, their size and 128 bits."""
    sets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("v")).alias("g"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("h"), F.min(F.struct("v", "place")).alias("least"))
    first = sets.groupBy("n", "g", "h", F.col("least.v").alias("v")).agg(F.min_by("key", "least.place").alias("key"))
    return members.join(first.select("key"), "key")


def first_of(members: DataFrame) -> DataFrame:
    """(v, k0, ...): the first keys of each text in the common order; of fewer, the first one fills the rest."""
    keys = F.sort_array(F.collect_list(F.struct("place", "key")))["key"]
    return members.groupBy("v").agg(keys.alias("keys")).select("v", *(F.coalesce(F.get("keys", F.lit(i)), F.get("keys", F.lit(0))).alias(c) for i, c in enumerate(FIRST)))


def pairs_of(members: DataFrame, details: DataFrame, similarity: float, tile: int, heads: int | None = None, earlier: int = 0) -> DataFrame:
    """Distinct pairs (x, y) of ``members`` (key, v, label, place) that meet under a key, have different
    labels, and whose sizes, parities (``details``: v, size, p0, ..., w0, ..., k0, ...) and places allow the similarity.

    A member's place is how many of its shingles come before the key in the common order. None of
    them is shared where the key is the first that two texts share, so there the sum of both places is
    no more than the shingles by which similar texts differ; under later keys a pair may be ruled out.

    A pair is made once: under the first key that is among the first ones (``FIRST``) of both, and
    under each of its keys only if there is none.

    With ``heads`` only pairs with so many members of each piece, or all of a piece of twice as many,
    which a hash of the member picks: a group of copies has the same ones under all of its keys, so
    its pairs are in proportion to it. Pairs that a call with ``earlier`` heads has made, or left out as
    they had one label, aren't made again: ``members`` but for the labels have to be the same. Large
    buckets are cut into blocks whose pairs are pieces, as for fingerprints.
    """
    ship(members.sparkSession)
    open_keys = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("least"), F.max("label").alias("most")).where((F.col("least") != F.col("most")) & (F.col("n") > 2 * earlier)).select("key", F.ceil(F.col("n") / tile).cast("int").alias("blocks"))
    # Sizes and sketches come to the members of open keys alone.
    met = members.join(open_keys, "key").join(details, "v").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    names = ["key", "piece", "v", "label", "place", "size", *PARITIES, *WHOLE, *FIRST]
    pieces = met.select("*", other.alias("other")).withColumn("piece", F.least("block", "other").cast("long") * F.col("blocks") + F.greatest("block", "other")).select(*names)
    dealt = pieces.repartition(F.col("key"), F.col("piece")).sortWithinPartitions("key", "piece", "v")

    def allowed(i, others, rows):
        key, _, _, label, place, size, *bits = rows
        bits, first = bits[: -len(FIRST)], bits[-len(FIRST) :]
        a, b = size[i], size[others]
        ok = (label[i] != label[others]) & (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9)
        whole = (1 - similarity) / (1 + similarity) * (a + b) + 1e-9
        ok &= place[i] + place[others] <= whole
        apart = lambda columns: sum(np.bitwise_count((p[i] ^ p[others]).view(np.uint64)).astype(np.int64) for p in columns)
        ok &= (apart(bits[: len(PARITIES)]) <= most_apart(a, b, similarity)) & (apart(bits[len(PARITIES) :]) <= whole)
        hit = np.flatnonzero(ok)
        x, y = (np.column_stack([k[c[hit]] for k in first]) for c in (i, others))
        before = np.cumsum(x == key[i[hit]][:, None], axis=1) == 0
        ok[hit] = ~(before & (x[:, :, None] == y[:, None, :]).any(axis=2)).any(axis=1)
        return ok

    def done(n, k):
        """How many members of a piece of ``n`` have met all others after a call with ``k`` heads."""
        return n if k is None or n <= 2 * k else k

    def found(rows):
        key, piece, v = rows[:3]
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])]))
        size = np.diff(np.concatenate([edge, [len(key)]]))
        two = edge[(size == 2) & (done(2, earlier) < 2)]
        ok = allowed(two, two + 1, rows)
        out = [np.column_stack([v[two][ok], v[two + 1][ok]])]
        for at, n in zip(edge[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            order = at + np.argsort(v[at : at + n].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            for r in range(done(n, earlier), min(done(n, heads), n - 1)):
                i, others = order[r], order[r + 1 :]
                hit = others[allowed(np.full(len(others), i), others, rows)]
                out.append(np.column_stack([np.full(len(hit), v[i]), v[hit]]))
        pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["x", "y"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in names]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            before = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            last = int(before[-1]) + 1 if len(before) else 0
            if last:
                yield found([x[:last] for x in rows])
            held = [x[last:] for x in rows]
        if held is not None and len(held[0]):
            yield found(held)

    return dealt.mapInArrow(tidy(run), "x long, y long").distinct()


def shingle_sets(texts: DataFrame, n: int) -> DataFrame:
    """(v, grams): the sorted distinct shingle hashes of each row's text."""

    def run(batches):
        for piece in slices(batches, "text"):
            data, offsets = bytes_of(piece.column("text"))
            raw, at = data.tobytes(), offsets.tolist()
            grams = [np.unique(shingle_hashes(raw[a:b], n, 42)).view(np.int64) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([piece.column("v"), pa.array(grams, pa.list_(pa.int64()))], ["v", "grams"])

    return arrow_rows(texts, ["v", "text"], run, "v long, grams array<long>")


def drop_near_duplicates(docs: DataFrame, n: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one of least id (null ids last).

    Two texts are near copies if they have the same words in order, or if the sets of their
    ``n``-word shingles have a Jaccard similarity of ``similarity`` (0.8 or more) or more; groups are
    chains of near copies. A pair is missed where 64-bit hashes collide, or by chance, of which a
    pair of 0.8 has less than one in 10**12.

    Candidates come from SimHash over the set of single words, by pigeonring for ``RADIUS`` bits as
    a spanning forest, and, among texts that these don't join, from the shingles: similar sets share one of each set's first shingles in
    a common order (``prefix_of``) near its start in both, and their sketches differ little. Where texts of one such shingle
    aren't in one group yet, first a few of them meet all others (``HEADS``) and then all pairs from
    different groups do. Of keys that the same texts have one is kept, and a pair that meets under
    several is made under one of them. Every pair is checked on its shingles before it links anything.

    Null texts count as empty, empty ones are copies of each other, and rows that repeat another
    leave one. All columns are kept, whatever their names, and an empty table gives an empty one.
    Text columns meet a shuffle in each of the four checks, for the candidates, and in the result.
    """
    if similarity < 0.8:
        raise ValueError(f"sketches are made for a similarity of 0.8 or more, not {similarity}")
    own = materialize(text_signatures(docs, id_col, text_col, n, similarity, frequent_shingles(docs, n, id_col, text_col)), "near-signatures")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("own").alias("own"))
    details = ["size", *PARITIES, *WHOLE]
    texts = materialize(own.groupBy("v").agg(F.min(rank).alias("first"), *(F.min(c).alias(c) for c in ["fp", *details, "keys"])), "near-texts")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).withColumn("__own", F.xxhash64("text"))

    def checked(pairs):
        """Links (a, b): the pairs that are similar by their shingles."""
        # Written, so that Spark knows whether they are few enough to leave the texts where they are.
        asked = materialize(pairs.select(F.col("x").alias("v")).union(pairs.select("y")).distinct().join(texts.select("v", "first.doc_id", "first.own"), "v"), "near-asked")
        fetched = source.join(asked, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__own") == F.col("own"))).select("v", "text")
        sets = materialize(shingle_sets(fetched, n).dropDuplicates(["v"]), "near-shingles")
        both = pairs.join(sets.select(F.col("v").alias("x"), F.col("grams").alias("p")), "x").join(sets.select(F.col("v").alias("y"), F.col("grams").alias("q")), "y")
        shared = F.size(F.array_intersect("p", "q"))
        links = materialize(both.where(shared >= F.lit(similarity) * (F.size("p") + F.size("q") - shared)).select(F.col("x").alias("a"), F.col("y").alias("b")), "near-links")
        discard(asked, sets)
        return links

    # SimHash: of texts of one fingerprint the least stands for all.
    heads = texts.groupBy("fp").agg(F.min("v").alias("head"))
    near = link_fingerprints(heads.select("fp"), RADIUS, tile)
    ends = near.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select("x", "y")
    same = texts.join(heads, "fp").where("v <> head").select(F.col("v").alias("x"), F.col("head").alias("y"))
    tested = ends.unionByName(same).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    tested = materialize(tested.distinct(), "near-pairs")
    links = checked(tested)
    # Keys of one text alone are dropped.
    posts = texts.select(F.posexplode("keys").alias("place", "key"), "v")
    shared_keys = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    shared = materialize(posts.join(shared_keys, "key"), "near-posts")
    members = materialize(first_keys(shared), "near-members")
    discard(shared)
    details = materialize(texts.select("v", *details).join(first_of(members), "v"), "near-details")
    for earlier, some in zip((0, *HEADS), (*HEADS, None), strict=True):
        labels = connected_components(links)
        named = members.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
        more = materialize(pairs_of(named, details, similarity, tile, some, earlier).join(tested, ["x", "y"], "left_anti"), "near-pairs")
        if more.limit(1).count():
            links, tested = links.unionByName(checked(more)), tested.unionByName(more)
    labels = connected_components(links)
    named = own.join(labels, "v", "left").select("doc_id", "own", F.coalesce("label", "v").alias("label"))
    # All rows but the first of each group, which is written so that the join deals both sides anew
    # and a hot group can be split; a row and its repeats are told apart by dropping repeats afterwards.
    least = materialize(named.groupBy("label").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "near-first")
    dropped = named.join(least, "label").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("own") == F.col("first.own")))).select(F.col("doc_id").alias("__drop_id"), F.col("own").alias("__drop_own")).distinct()
    identifier, text = F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    kept = docs.join(dropped, identifier.eqNullSafe(F.col("__drop_id")) & (text == F.col("__drop_own")), "left_anti")
    if own.groupBy("doc_id", "own").count().where("count > 1").limit(1).count():
        kept = kept.withColumns({"__id": identifier, "__own": text}).dropDuplicates(["__id", "__own"]).drop("__id", "__own")
    return kept


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
