"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its labels."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bytes_of, crc32_mod, materialize, most_frequent, slices, table, words_of
from .decontaminate import LOWERED

#: Labelled rows of each class that the voters and the classifier are fitted on, at most.
SAMPLE_PER_CLASS = 10_000

#: Letters of a stem.
STEMS = (4, 5, 6, 7)

#: Patterns that can be voters as words can: shouting, masked and spaced letters, stretched letters, runs of marks.
PATTERNS = {
    "#shouts": r"(\b[A-Z]{4,}\b[^a-z]*){3,}",
    "#masked": r"[A-Za-z][*@$#]+[A-Za-z]",
    "#spaced": r"(\b[A-Za-z][ .-]){4,}",
    "#stretched": "|".join(f"{c}{{4,}}" for c in "abcdefghijklmnopqrstuvwxyz"),
    "#marks": r"[!?]{3,}",
}

#: Words and stems whose counts a worker holds before it hands them on.
COUNTED_NAMES = 100_000

#: Voters with words or stems of their own; what is left shares GROUPS more.
VOTERS, GROUPS = 64, 16


def stems_of(word: str) -> list[str]:
    return [word[:k] + "*" for k in STEMS if len(word) > k]


def batch_patterns(column: pa.Array) -> np.ndarray:
    """Which of ``PATTERNS`` each text has."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    found = [pc.match_substring_regex(column, p).to_numpy(zero_copy_only=False) for p in PATTERNS.values()]
    return np.array(found, bool).reshape(len(PATTERNS), len(column)).T


def batch_words(column: pa.Array):
    """(index of each word, distinct words, n+1 offsets of the texts in the words)."""
    data, offsets = bytes_of(column)
    words, at = words_of(LOWERED[data], offsets)
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), at


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, per_class: int) -> DataFrame:
    """(text, toxic, weight) of up to ``per_class`` labelled rows a class, those of small id hash, none of
    them held out; ``weight`` is how many rows of its class a row stands for."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(crc32_mod(F.col("doc_id"), 3) != 1)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    # A share of the ids by hash, 4 % below the bound where there are more, as hashes scatter.
    place = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 7), 16, 10).cast("long")
    upto = {k: (1 << 28) if n <= per_class else int((1 << 28) * 0.96 * per_class / n) for k, n in sizes.items()}
    picked = known.where(place < F.when(F.col("toxic") == 1, F.lit(upto.get(1, 0))).otherwise(F.lit(upto.get(0, 0))))
    stands = {k: (1 << 28) / n for k, n in upto.items()}
    weight = F.when(F.col("toxic") == 1, F.lit(stands.get(1, 1.0))).otherwise(F.lit(stands.get(0, 1.0)))
    picked = picked.select(F.col("doc_id").alias("__id"), "toxic", weight.alias("weight"))
    # At most 2 * per_class rows of 20 bytes.
    texts = docs.select(F.col(f"`{id_col}`").alias("__own"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return materialize(texts.join(F.broadcast(picked), F.col("__own") == F.col("__id")).select("text", "toxic", "weight"), "toxicity-sample")


def class_weights(sample: DataFrame) -> dict[int, float]:
    """How many rows a sampled row of each class stands for, 1 on average."""
    found = {r.toxic: (r.weight, r.n) for r in sample.groupBy("toxic").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n")).collect()}
    mean = sum(w * n for w, n in found.values()) / max(1, sum(n for _, n in found.values()))
    return {k: found[k][0] / mean if k in found else 1.0 for k in (0, 1)}


def tail(k: int, n: int, p: float) -> float:
    """Chernoff bound of log P(at least k of n) at rate p."""
    q = k / n
    if q <= p:
        return 0.0
    return -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))


def learn_lexicon(sample: DataFrame, risk: float = 0.01, precision: float = 0.8) -> list[tuple[str, int, int]]:
    """(word, stem* or #pattern, toxic texts, other texts) of what marks toxic texts beyond chance.

    Texts with a word, stem or pattern are counted by class over the whole sample. One is taken if at least
    ``precision`` of its texts are toxic, each counted as many times as its weight, and chance gives
    as much by the sample's own counts and rate, over all candidates together,
    with probability ``risk`` at most. Copies of a toxic text are no new evidence, so toxic texts
    count no more than the different neighbours that the word has in them. What a shorter stem
    covers is left out.
    """

    def count(batches):
        found: dict[str, list[int]] = {}

        def rows():
            keys = list(found)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([found[k][0] for k in keys], pa.int64()), pa.array([found[k][1] for k in keys], pa.int64())], ["name", "toxic", "other"])

        for piece in slices(batches, "text"):
            index, distinct, at = batch_words(piece.column("text"))
            names = [[w, *stems_of(w)] for w in distinct]
            for toxic, a, b, has in zip(piece.column("toxic").to_pylist(), at.tolist(), at[1:].tolist(), batch_patterns(piece.column("text")), strict=False):
                for name in {x for i in np.unique(index[a:b]).tolist() for x in names[i]} | {p for p, h in zip(PATTERNS, has, strict=True) if h}:
                    found.setdefault(name, [0, 0])[1 - toxic] += 1
            if len(found) >= COUNTED_NAMES:
                yield rows()
                found.clear()
        yield rows()

    counted = materialize(arrow_rows(sample, ["text", "toxic"], count, "name string, toxic long, other long").groupBy("name").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "toxicity-words")
    texts = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    stands = class_weights(sample)
    rate = min(max(texts.get(1, 0) / max(1, sum(texts.values())), 1e-6), 0.999)
    tried = max(1, counted.where("toxic + other >= 3").count())
    # Fewer than 20,000 can be that certain: each takes several of a bounded number of texts' words.
    sure = counted.where((F.col("toxic") >= 3) & (stands[1] * F.col("toxic") >= precision * (stands[1] * F.col("toxic") + stands[0] * F.col("other"))))
    sure = most_frequent(sure, "toxic", 20_000).collect()
    candidates = {r.name: (r.toxic, r.other) for r in sure if math.log(tried) + tail(r.toxic, r.toxic + r.other, rate) <= math.log(risk)}

    def contexts(batches):
        """The different neighbours that candidates have in toxic texts, and the different texts with patterns."""
        found: set[tuple[str, int]] = set()
        for piece in slices(batches, "text"):
            index, distinct, at = batch_words(piece.column("text"))
            own = [[x for x in (w, *stems_of(w)) if x in candidates] for w in distinct]
            for text, has in zip(piece.column("text").to_pylist(), batch_patterns(piece.column("text")), strict=True):
                found.update((p, zlib.crc32((text or "").encode())) for p, h in zip(PATTERNS, has, strict=True) if h and p in candidates)
            hit = np.flatnonzero(np.array([bool(x) for x in own], bool)[index]) if len(own) else []
            edge = set(at.tolist())
            for i in hit:
                before = distinct[index[i - 1]] if i not in edge else ""
                after = distinct[index[i + 1]] if i + 1 not in edge else ""
                found.update((x, zlib.crc32(f"{before} {after}".encode())) for x in own[index[i]])
        pairs = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.string()), pa.array([c for _, c in pairs], pa.int64())], ["name", "context"])

    met = arrow_rows(sample.where("toxic = 1"), ["text"], contexts, "name string, context long").groupBy("name").agg(F.countDistinct("context").alias("n"))
    spread = {r.name: r.n for r in met.collect()} if candidates else {}
    good = {}
    for name, (toxic, other) in candidates.items():
        n = min(toxic, spread.get(name, 0))
        if n and stands[1] * n >= precision * (stands[1] * n + stands[0] * other) and math.log(tried) + tail(n, n + other, rate) <= math.log(risk):
            good[name] = (toxic, other)
    # Of a stem and what extends it the shorter stands, unless the longer has nearly as many toxic texts and no more others.
    stems = {n: [s for s in stems_of(n.rstrip("*")) if s != n and s in good] for n in good}
    purer = {s for n, shorter in stems.items() for s in shorter if good[n][1] <= good[s][1] and good[n][0] >= 0.9 * good[s][0]}
    taken = [n for n in good if n not in purer and not any(s not in purer for s in stems[n])]
    return sorted(((n, *good[n]) for n in taken), key=lambda x: (-x[1], x[0]))


@dataclass
class Voters:
    """Which voter each word and stem belongs to."""

    voter: dict[str, int]
    size: int
    toxic: np.ndarray
    other: np.ndarray

    @staticmethod
    def of(lexicon: list[tuple[str, int, int]]) -> Voters:
        own = min(VOTERS, len(lexicon))
        size = own + (GROUPS if len(lexicon) > own else 0)
        toxic, other, voter = np.zeros(size), np.zeros(size), {}
        for i, (name, a, b) in enumerate(lexicon):
            at = voter[name] = i if i < own else own + i % GROUPS
            toxic[at], other[at] = max(toxic[at], a), other[at] + b
        return Voters(voter, size, toxic, other)

    def of_word(self, word: str) -> int:
        for name in (word, *stems_of(word)):
            if name in self.voter:
                return self.voter[name]
        return -1

    def counts(self, column: pa.Array) -> np.ndarray:
        """Words of each voter in each text; a pattern counts as one."""
        index, distinct, at = batch_words(column)
        n, k = len(at) - 1, max(1, self.size)
        own = np.fromiter(map(self.of_word, distinct), np.int64, len(distinct))[index] if len(distinct) else np.zeros(0, np.int64)
        hit = np.flatnonzero(own >= 0)
        text = np.searchsorted(at, hit, "right") - 1
        out = np.bincount(text * k + own[hit], minlength=n * k).reshape(n, k).astype(float)
        if any(p in self.voter for p in PATTERNS):
            has = batch_patterns(column)
            for i, p in enumerate(PATTERNS):
                if p in self.voter:
                    out[:, self.voter[p]] += has[:, i]
        return out


def label_model(votes: np.ndarray, seen: tuple[np.ndarray, np.ndarray, float, float] | None = None, rounds: int = 25, mass: np.ndarray | None = None) -> tuple[np.ndarray, dict]:
    """Posterior of the hidden label of each row of binary ``votes``, and the model's estimates.

    A voter fires at one rate on toxic and at another on other texts (its accuracy). Voters that
    also agree beyond what the label explains are correlated; each one's evidence is divided by the
    number of voters that it amounts to, the root of one plus its conditional correlations. Both
    are estimated together with the labels by expectation maximisation. ``seen`` are each voter's
    toxic and other texts and the number of all of them where labels are known; they stand as
    prior counts, without which voters of different languages could be taken for the two classes.
    ``mass`` is how many rows each one counts for, 1 by default.
    """
    n, k = votes.shape
    toxic, other, positives, negatives = seen or (np.zeros(k), np.zeros(k), 0, 0)
    if not n:
        return np.zeros(0), {"on": np.zeros(k), "off": np.zeros(k), "weight": np.ones(k)}
    q, mass = np.where(votes.any(axis=1), 0.95, 0.02), np.ones(n) if mass is None else mass
    for _ in range(rounds):
        yes, no = q * mass, (1 - q) * mass
        on = (yes @ votes + toxic + 0.5) / (yes.sum() + positives + 1)
        off = np.minimum((no @ votes + other + 0.01) / (no.sum() + negatives + 1), on)
        prior = min(max(yes.sum() / mass.sum(), 1e-4), 0.95)
        both = np.zeros((k, k))
        for part, rate in ((yes, on), (no, off)):
            rest = (votes - rate) * np.sqrt(part)[:, None]
            both += rest.T @ rest
        spread = np.sqrt(np.maximum(np.diag(both), 1e-9))
        correlation = np.clip(both / spread[:, None] / spread[None, :], 0, 1)
        np.fill_diagonal(correlation, 0)
        correlation[correlation < 0.1] = 0
        weight = 1 / np.sqrt(1 + correlation.sum(axis=1))
        fired, quiet = np.log(on / off) * weight, np.log((1 - on) / (1 - off)) * weight
        # A voter that doesn't fire abstains; only where none fires do they all speak against.
        z = np.log(prior / (1 - prior)) + np.where(votes.any(axis=1), votes @ fired, quiet.sum())
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return q, {"on": on, "off": off, "weight": weight, "correlation": correlation, "prior": prior}


def inputs(counts: np.ndarray) -> np.ndarray:
    """What the classifier sees: whether each voter fires, how many do, and how many words they have."""
    fires = counts > 0
    return np.column_stack([fires, np.minimum(fires.sum(axis=1), 4), np.log1p(counts.sum(axis=1)), np.ones(len(counts))]).astype(float)


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 40, mass: np.ndarray | float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last column, the intercept, isn't shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (mass * (p - y)) + shrink * w
        hessian = (x * (mass * (p * (1 - p) + 1e-9))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(hessian, gradient)
        w = w - step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class ToxicityModel:
    voters: Voters
    weights: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs(self.voters.counts(column)) @ self.weights, -30, 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel:
    """Learn from labelled rows that aren't held out (crc32 of the id as text, modulo 3, is not 1).

    At most ``per_class`` rows of each class, the documented bound, make the lexicons and train the
    classifier; scoring reads every whole text. Without labels all scores are low.
    """
    sample = training_sample(docs, labels, id_col, text_col, per_class)
    voters = Voters.of(learn_lexicon(sample))
    texts = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}

    def vote(batches):
        for piece in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([piece.column("toxic"), pa.array(list(voters.counts(piece.column("text")).astype(np.int32)), pa.list_(pa.int32()))], ["toxic", "counts"])

    # At most 2 * per_class rows of VOTERS + GROUPS small numbers.
    voted, stands = arrow_rows(sample, ["text", "toxic"], vote, "toxic int, counts array<int>").toArrow(), class_weights(sample)
    rows, mass = voted.column("counts"), np.where(voted.column("toxic").to_numpy() == 1, stands[1], stands[0])
    counts = np.array(rows.to_pylist(), float).reshape(len(rows), max(1, voters.size))
    if not voters.size or not len(counts):
        return ToxicityModel(voters, np.array([0.0] * (max(1, voters.size) + 2) + [-5.0]))
    posterior, _ = label_model((counts > 0).astype(float), (stands[1] * voters.toxic, stands[0] * voters.other, stands[1] * texts.get(1, 0), stands[0] * texts.get(0, 0)), mass=mass)
    return ToxicityModel(voters, fit_linear(inputs(counts), posterior, mass=mass))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each whole text; null and empty texts get the score of
    a text without toxic words. A row gives a row, and an empty table none; null ids aren't held out,
    equal texts get equal scores, and labels, sources and other columns aren't read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for piece in slices(batches, text_col):
            score = shared.value.scores(piece.column(text_col))
            yield pa.RecordBatch.from_arrays([pc.cast(piece.column(id_col), pa.int64()), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = arrow_rows(docs, [id_col, text_col], run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (crc32_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def filter_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns as they are; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for piece in slices(batches, text_col):
            yield piece.filter(pa.array(shared.value.scores(piece.column(text_col)) < threshold))

    return arrow_rows(docs, docs.columns, run, docs.schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, fit_toxicity(docs, labels))
