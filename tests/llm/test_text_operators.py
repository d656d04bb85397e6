"""Operators against brute force on small fixtures with nulls, empties, ties, repeats, clashing columns and empty tables."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from strataloom.llm import decontaminate, language_model, mixing, quality, repeats, simhash, token_counts, token_files, toxicity  # noqa: E402
from strataloom.llm.graph import connected_components  # noqa: E402

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
TEXTS = [
    (1, LONG + " nu xi.\nshort line here again and again", "a"),
    (2, "before " + LONG + " after, it's done.\n\nThis is one sentence of the common kind that stands everywhere! Yes.", "a"),
    (3, None, "b"),
    (4, "", None),
    (5, " \n\t ", "b"),
    (6, "Ünïcode ÉTÉ 中文 text <|endoftext|> don't 123 😀 ", "c"),
    (7, "word " * 3000, "a"),
    (8, "This is one sentence of the common kind that stands everywhere! Another follows it.", "c"),
    (8, "This is one sentence of the common kind that stands everywhere! Another follows it.", "c"),
    (None, "no id at all but words", "b"),
    (9, "x " + " ".join(f"w{i}" for i in range(40)), "a"),
    (10, "y " + " ".join(f"w{i}" for i in range(40)), "a"),
    (11, "MORE of THE same: alpha beta", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, "clash", 5, 7) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens string, size int, copies int").repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    expected = sorted(((i, len((x or "").encode()), n, n > 10) for i, x, _ in TEXTS for n in [len(t.encode(x or "", add_special_tokens=False).ids)]), key=repr)
    assert rows_of(token_counts.count_tokens(docs, TOKENIZER, limit=10), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    assert token_counts.count_tokens(docs, TOKENIZER, frequent=3).count() == len(TEXTS)
    assert token_counts.count_tokens(none, TOKENIZER).count() == 0


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    coded = sorted(((i is not None, i or 0, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u2").tobytes()) for i, x, _ in TEXTS))
    start, expected = 0, []
    for known, i, raw in coded:
        ids = np.frombuffer(raw, "<u2").astype("<u4")
        expected.append((i if known else None, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    for shards in (1, 4):
        folder = f"file://{tmp_path}/t{shards}"
        manifest = token_files.write_token_files(docs, folder, TOKENIZER, shards=shards)
        assert manifest["tokens"] == start and manifest["width"] == 2
        assert rows_of(token_files.read_token_files(spark, folder), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=repr)
        assert not list(tmp_path.glob(f"t{shards}/*.part"))
    folder = f"file://{tmp_path}/none"
    assert token_files.write_token_files(none, folder, TOKENIZER)["documents"] == 0
    assert token_files.read_token_files(spark, folder).count() == 0


BENCH = [(1, LONG), (2, "alpha beta"), (3, "nowhere to be found"), (4, None), (5, "..."), (12, " ".join(f"W{i}" for i in range(3, 20))), (12, "again and again"), (None, "common kind")]


def brute_contamination(text):
    cut = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(x))
    words, hit, items = cut(text), set(), set()
    for i, b in BENCH:
        w = cut(b)
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if n else ():
            for p in range(len(words) - n + 1):
                if words[p : p + n] == w[s : s + n]:
                    hit |= set(range(p, p + n))
                    items |= {str(i)} if i is not None else set()
    return len(words), len(hit), sorted(items)


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 20])
def test_decontamination(spark, docs, none, block_words):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    found = decontaminate.find_contamination(docs, bench, block_words=block_words)
    expected = sorted(((i, *brute_contamination(t)) for i, t, _ in TEXTS), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in found.collect()), key=repr) == expected
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in found.collect())
    kept = decontaminate.remove_contaminated(docs, bench, block_words=block_words)
    assert kept.columns == docs.columns and kept.count() == sum(not brute_contamination(t)[1] for _, t, _ in TEXTS)
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_repeats_on_both_sides_cost_no_pairs(spark):
    texts = ["the " * 200_000, "the " * 9 + "end", "a the b " * 40, "x " + "the " * 10]
    bench = spark.createDataFrame([(1, "the " * 2000), (2, "the " * 10), (3, "a the b " * 30), (4, "b")] + [(i, "same words " * 9) for i in range(5, 300)], "item_id long, text string")
    began = time.perf_counter()
    found = decontaminate.find_contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()
    assert {r.doc_id: (r.n_hit, r.item_ids) for r in found} == {0: (200_000, ["1", "2"]), 1: (0, []), 2: (120, ["3", "4"]), 3: (10, ["1", "2"])}
    assert time.perf_counter() - began < 60


def test_random_contamination_in_blocks(spark):
    rng = random.Random(9)
    make = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    texts, items = [make(rng.randrange(0, 60)) for _ in range(80)], [(i, make(rng.randrange(0, 25))) for i in range(12)]

    def brute(text):
        words, hit, which = text.split(), set(), set()
        for i, b in items:
            w = b.split()
            n = min(10, len(w))
            for s in range(len(w) - n + 1) if n else ():
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == w[s : s + n]:
                        hit, which = hit | set(range(p, p + n)), which | {str(i)}
        return len(hit), sorted(which)

    frame, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block_words in (decontaminate.BLOCK_WORDS, 60):
        found = {r.doc_id: (r.n_hit, r.item_ids) for r in decontaminate.find_contamination(frame, bench, block_words=block_words).collect()}
        assert found == {i: brute(t) for i, t in enumerate(texts)}


def test_winnowing_keeps_a_hash_of_every_window():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 50, 500).astype(np.uint64)
    kept = set(decontaminate.winnow(h, 6).tolist())
    assert all(kept & set(range(i, i + 6)) for i in range(495))


def test_mixing(spark, docs, none):
    found = mixing.mix_sources(docs).collect()
    size = {s: sum(len(WORD.findall(t or "")) for _, t, x in TEXTS if x == s) for s in ("a", "b", "c", None)}
    total, order = sum(size.values()), ["a", "b", "c", None]
    weight, capped = dict(zip(order, [5, 2, 1, 5], strict=True)), set()
    while True:
        left, open_ = total - sum(3 * size[s] for s in capped), [s for s in order if s not in capped]
        level = left / sum(weight[s] for s in open_)
        more = {s for s in open_ if weight[s] * level > 3 * size[s]}
        if not more:
            break
        capped |= more
    target = {s: 3 * size[s] if s in capped else weight[s] * level for s in order}
    assert len(found) == len(TEXTS)
    for r in found:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
    assert rows_of(mixing.mix_sources(docs), "doc_id", "taken") == rows_of(mixing.mix_sources(docs), "doc_id", "taken")
    assert mixing.mix_sources(none).count() == 0
    mixed = mixing.repeat_documents(docs, mixing.mix_sources(docs))
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in found)


def test_mixing_comes_near_its_targets(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + pmod(xxhash64(id), 200) as int)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source")
    by = mixing.mix_sources(df).groupBy("source", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r.t - r.target) < 0.02 * r.target + 200 for r in by)


def test_quality(docs, none):
    out = {}
    for i, t, _ in TEXTS:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        out.setdefault((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), failed), 0)
    found = quality.apply_quality_rules(docs)
    assert {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found.collect()} == set(out)
    assert found.count() == len(TEXTS) and all(not r.kept for r in found.collect() if r.base_failed)
    assert quality.apply_quality_rules(none).count() == 0


def test_quality_keeps_clean_texts(spark):
    clean = ". ".join(f"Sentence {k} tells of thing{k} and of other{k} in plain words" for k in range(12))
    junk = " ".join(f"PART{k}!!" for k in range(90))
    found = {r.doc_id: r for r in quality.apply_quality_rules(spark.createDataFrame([(1, clean), (2, junk)], "doc_id long, text string")).collect()}
    assert found[1].kept and not found[2].kept and not found[2].base_failed


def test_language_model(docs, none):
    counts, tokens = collections.Counter(), []
    for i, t, _ in TEXTS:
        w = ascii_lower(t).encode().split() + [b""]
        tokens.append((i, w))
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    for hot in (3, 100_000):
        found = language_model.score_texts(docs, hot_tokens=hot).collect()
        expected = sorted(((i, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)) for i, w in tokens), key=repr)
        assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found), key=repr) == expected
        assert all(r.score < 0 for r in found)
    assert language_model.score_texts(none).count() == 0


def bit_model(words):
    """A model with the counts of some words and weights that aren't the ones to start with."""
    bits = language_model.bits_for(len(words))
    seen, rng = np.zeros((sum(1 << b for b in bits), 2), np.uint16), np.random.default_rng(1)
    units = language_model.Units(language_model.pa.array(words).cast(language_model.pa.large_binary()))
    places = language_model.places_of(units.flat, units.size, bits)
    for root, byte, n in zip(places.root, places.byte.tolist(), places.times.tolist(), strict=True):
        for bit in range(8):
            seen[root ^ ((1 << bit) | (byte >> (8 - bit))), byte >> (7 - bit) & 1] += n
    model = language_model.BitModel.start(bits, seen[:, 0].copy(), seen[:, 1].copy())
    model.weights += rng.uniform(-0.1, 0.1, model.weights.shape).astype(np.float32)
    return model


VOCABULARY = ["alpha", "alphabet", "beta", "über", "the", "then", "there", "a", "x" * 3000]


def test_bits_of_a_byte_are_a_distribution():
    z, _ = bit_model(VOCABULARY).predict(np.arange(256, dtype=np.uint8), np.ones(256, np.int64))
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)).reshape(256, 8)
    p = 1 / (1 + np.exp(-z.astype(float)))
    assert np.where(bits == 1, p, 1 - p).prod(axis=1).sum() == pytest.approx(1, abs=1e-3)


def scalar_spelling(model, units):
    """log10 of each unit's probability in a text of these units, bit by bit."""
    weights, refined = model.weights.astype(float), model.refined.astype(float)
    gain, bias = [1.0] * 12, [0.0] * 12
    curve, slope, out = [[200.0] * 12, [200.0] * 12], None, []
    for k, unit in enumerate(units):
        if k == 0 or (k >= 16 and k & (k - 1) == 0):  # a segment starts
            if slope:
                gain = [min(max(g + s / c, 0.5), 1.5) for g, s, c in zip(gain, slope[0], curve[0], strict=True)]
                bias = [min(max(b + s / c, -1), 1) for b, s, c in zip(bias, slope[1], curve[1], strict=True)]
            slope = [[0.0] * 12, [0.0] * 12]
        total = 0.0
        for depth, byte in enumerate(unit):
            # The places of a prefix alone: its last byte's.
            root = language_model.places_of(np.frombuffer(unit[: depth + 1], np.uint8), np.array([depth + 1]), model.bits).root[-1].tolist()
            for bit in range(8):
                node, value = (1 << bit) | (byte >> (8 - bit)), byte >> (7 - bit) & 1
                counts = [(int(model.zeros[r ^ node]), int(model.ones[r ^ node])) for r in root]
                x = [round(10 * (math.log(b + 0.3) - math.log(a + 0.3))) / 10 for a, b in counts]
                level = [(a + b > 0) + (a + b >= 8) for a, b in counts]
                w = weights[(level[4] * 3 + level[5]) * 8 + bit]
                z = sum(a * b for a, b in zip(x, w, strict=False)) + w[-1]
                p = 1 / (1 + math.exp(-z)) / 2 + refined[node, min(max(round((z + 8) * 2), 0), 32)] / 2
                z = math.log(p / (1 - p))
                if bit == 0:
                    kind = min(depth, 3) * 3 + level[5]
                q = 1 / (1 + math.exp(-(gain[kind] * z + bias[kind])))
                total += math.log10(q if value else 1 - q)
                slope[0][kind] += (value - q) * z
                slope[1][kind] += value - q
                curve[0][kind] += q * (1 - q) * z * z
                curve[1][kind] += q * (1 - q)
        out.append(total)
    return out


def test_training_predicts_each_bit_before_it_counts_it(monkeypatch):
    """Counts, weights and refining table against a scalar version that meets one word at a time."""
    monkeypatch.setattr(language_model, "FIRST_BYTES", 1)
    monkeypatch.setattr(language_model, "STEP_SHARE", 1 << 40)
    words, pa = VOCABULARY[:8] * 3, language_model.pa
    bits = language_model.bits_for(len(words))
    learner = language_model.Learner(bits)
    for places in language_model.task_places([pa.RecordBatch.from_arrays([pa.array(words).cast(pa.binary())], ["token"])], bits):
        learner.learn(places)
    seen, weights = collections.defaultdict(lambda: [0, 0]), [[0.05, 0.1, 0.15, 0.2, 0.3, 0.3, 0.0] for _ in range(language_model.GATES)]
    mass, ones = collections.Counter(), collections.Counter()
    for step, word in enumerate(words):
        unit = word.encode() + b"\xff"
        roots = [language_model.places_of(np.frombuffer(unit[: k + 1], np.uint8), np.array([k + 1]), bits).root[-1].tolist() for k in range(len(unit))]
        for bit in range(8):
            moves, met, counted = collections.defaultdict(lambda: [0.0] * 7), collections.Counter(), []
            for root, byte in zip(roots, unit, strict=True):
                node, value = (1 << bit) | (byte >> (8 - bit)), byte >> (7 - bit) & 1
                counts = [seen[r ^ node] for r in root]
                x = [math.log(b + 0.3) - math.log(a + 0.3) for a, b in counts] + [1.0]
                level = [(a + b > 0) + (a + b >= 8) for a, b in counts]
                gate = (level[4] * 3 + level[5]) * 8 + bit
                z = sum(a * b for a, b in zip(x, weights[gate], strict=True))
                error = value - 1 / (1 + math.exp(-z))
                moves[gate] = [m + error * a for m, a in zip(moves[gate], x, strict=True)]
                met[gate] += 1
                cell = node * language_model.BUCKETS + min(max(round((z + 8) * 2), 0), 32)
                mass[cell] += 1
                ones[cell] += value
                counted += [(r ^ node, value) for r in root]
            for gate, move in moves.items():
                weights[gate] = [w + max(0.02, 0.5 / (1 + step / 10)) * m / (met[gate] + 32) for w, m in zip(weights[gate], move, strict=True)]
            for slot, value in counted:
                seen[slot][value] += 1
    assert {int(i): learner.seen[2 * i : 2 * i + 2].tolist() for i in np.unique(np.flatnonzero(learner.seen) // 2)} == {k: v for k, v in seen.items() if any(v)}
    assert learner.weights == pytest.approx(np.array(weights), abs=1e-4)
    assert {int(i): (learner.mass[i], learner.ones[i]) for i in np.flatnonzero(learner.mass)} == {k: (n, ones[k]) for k, n in mass.items()}


@pytest.mark.parametrize("kept", [0, language_model.KEPT_BYTES])
def test_spelling_against_a_scalar_version(kept, monkeypatch):
    monkeypatch.setattr(language_model, "KEPT_BYTES", kept)
    monkeypatch.setattr(language_model, "MEET_BYTES", 40)
    model, rng = bit_model(VOCABULARY), random.Random(2)
    texts = [[rng.choice([*VOCABULARY[:8], "unseen", "thé"]) for _ in range(n)] for n in (0, 1, 15, 16, 17, 40, 130)]
    distinct = sorted({w for t in texts for w in t})
    units = language_model.Units(language_model.pa.array(distinct).cast(language_model.pa.large_binary()))
    unit = np.array([distinct.index(w) for t in texts for w in t])
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = language_model.spell(model, units, unit, offsets)
    expected = [x for t in texts for x in scalar_spelling(model, [w.encode() + b"\xff" for w in t])]
    assert found == pytest.approx(expected, abs=2e-3)


def test_long_words_are_spelled_in_pieces():
    units = language_model.Units(language_model.pa.array(["a" * 1023, "b" * 1024, "c" * 3000, ""]).cast(language_model.pa.large_binary()))
    assert units.size.tolist() == [1024, 1024, 1, 1024, 1024, 953, 1] and units.pieces.tolist() == [1, 2, 3, 1]
    assert units.flat[units.start + units.size - 1].tolist() == [255, 98, 255, 99, 99, 255, 255]


def test_scores_use_the_counts_of_the_corpus(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    rows = [(i, " ".join(words[min(int(rng.expovariate(0.02)), 299)] for _ in range(200))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    few, many = ({r.doc_id: r for r in language_model.score_texts(frame, hot_tokens=n).collect()} for n in (20, 10_000))
    for i in few:  # joined or broadcast, counts give the same
        assert few[i].score == pytest.approx(many[i].score, rel=1e-6) and few[i].base_score == pytest.approx(many[i].base_score, rel=1e-9)
    held = [r for r in many.values() if r.held_out]
    # Words come by themselves here, so the counts of words are all there is to know; blanks and ends cost little more.
    assert held and sum(r.score for r in held) > 1.03 * sum(r.base_score for r in held)


def test_one_very_long_text(spark):
    rng = np.random.default_rng(0)
    text = " ".join(f"w{i}" for i in rng.integers(0, 50_000, 700_000).tolist()) + " " + "y" * 2_000_000
    found = language_model.score_texts(spark.createDataFrame([(2, text), (3, "w1 w2")], "doc_id long, text string")).collect()
    assert {r.n_tokens for r in found} == {700_002, 3} and all(-20 * len(text) < r.score < 0 for r in found)


def test_repeated_spans(docs, none):
    found = {(r.doc_id, r.start, r.end, r.first_doc_id) for r in repeats.repeated_spans(docs, min_span_words=8).collect()}
    sentence = "This is one sentence of the common kind that stands everywhere!"
    assert (8, 0, len(sentence), 2) in found
    assert {d for d, *_ in found} == {8, 10}  # 10 shares its words with 9
    cut = repeats.remove_repeats(docs, min_span_words=8)
    assert sum((r.text or "").count("one sentence") for r in cut.collect()) == 1 and cut.columns == docs.columns
    assert repeats.repeated_spans(none).count() == 0


def test_passage_inside_lines_without_stops(spark):
    passage = " ".join(f"pass{k * 37 % 101}" for k in range(60))
    other = lambda n: " ".join(f"own{n}x{k}" for k in range(30))
    rows = [(1, f"{other(1)} {passage} {other(2)}"), (2, other(3)), (3, f"{other(4)} {passage}"), (4, f"{passage} {other(5)}")]
    found = repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == {3, 4} and {r.first_doc_id for r in found} == {1}
    texts = dict(rows)
    assert all(texts[r.doc_id][r.start : r.end].strip() in passage and r.n_words >= 40 for r in found)


@pytest.mark.parametrize("stops", [0, 0.1])
def test_every_passage_of_fifty_words_is_found(spark, stops):
    rng, rows = random.Random(5), []
    own = lambda n: [f"w{rng.randrange(10**6)}" + "." * (rng.random() < stops) for _ in range(n)]
    for i in range(150):
        passage = own(51)
        for half in (0, 1):
            a, b = own(rng.randrange(60)), own(rng.randrange(60))
            rows.append((2 * i + half, " ".join(a + passage + b)))
    found = {r.doc_id for r in repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {2 * i + 1 for i in range(150)}


def test_passages_of_short_lines(spark):
    lines = "\n".join(f"a{k} b{k}." for k in range(40))
    bridge = "\n".join([*(f"c{k} d{k} e{k} f{k}." for k in range(8)), "{}", *(f"g{k} h{k} i{k} j{k}." for k in range(8))])
    rows = [(1, f"{lines}\nmine"), (2, f"yours\n{lines}"), (3, bridge.format("only here.")), (4, bridge.format("just there."))]
    texts = dict(rows)
    found = repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == {2, 4}
    assert not any("just there" in texts[r.doc_id][r.start : r.end] for r in found)


def brute_fingerprint(text):
    w = ascii_lower(text).encode().split()
    grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, none):
    found = simhash.near_duplicates(docs).collect()
    prints = {r.fp & (2**64 - 1) for r in found}
    assert prints == {brute_fingerprint(t) for _, t, _ in TEXTS}
    byid = {r.doc_id: r.component_id for r in found}
    assert byid[3] == byid[4] == byid[5] == 3 and byid[8] == 8
    assert len(found) == len(TEXTS) and simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("tile", [4, 4096])
def test_fingerprint_links_are_exact(spark, tile):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 12).tolist()
    points = set()
    for c in centres:
        for _ in range(15):
            x = c
            for b in rng.choice(64, rng.integers(0, 5), replace=False).tolist():
                x ^= 1 << b
            points.add(x)
    points = sorted(points)
    signed = [p - 2**64 if p >= 2**63 else p for p in points]
    links = simhash.link_fingerprints(spark.createDataFrame([(p,) for p in signed], "fp long"), tile=tile)
    labels = {r.v: r.label for r in connected_components(links).collect()}
    root = {p: p for p in signed}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(points):
        for k in range(i):
            if bin(p ^ points[k]).count("1") <= 3:
                a, b = find(signed[i]), find(signed[k])
                root[max(a, b)] = min(a, b)
    for p in signed:
        assert labels.get(p, p) == find(p)


@pytest.mark.parametrize("shape", ["up", "one far", "zigzag", "random", "stars", "none"])
def test_components_of_long_chains(spark, shape):
    n, rng = 300, random.Random(1)
    ids = list(range(n))
    zigzag = [x for i in range(n // 2) for x in (i, n - 1 - i)]
    rng.shuffle(ids)
    edges = {
        "up": [(i, i + 1) for i in range(n)],
        "one far": [(0, n), *((i, i + 1) for i in range(1, n))],
        "zigzag": list(zip(zigzag, zigzag[1:], strict=False)),
        "random": list(zip(ids, ids[1:], strict=False)),
        "stars": [*((1000, i) for i in range(200)), *((2000, i) for i in range(300, 500)), (1000, 2000), (600, 600)],
        "none": [(7, 7), (None, 3)],
    }[shape]
    found = {r.v: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == dict.fromkeys({v for e in edges if e[0] is not None and e[0] != e[1] for v in e}, 0)


def test_columns_of_any_name_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, LONG + " " + LONG + " x", 2.0, None), (2, LONG + " " + LONG + " y", 3.0, "s"), (3, None, None, "s")], ["doc.id", "the text", "a.b", "row"])
    cut = repeats.remove_repeats(frame, "doc.id", "the text")
    assert cut.columns == frame.columns and {r["doc.id"]: r["a.b"] for r in cut.collect()} == {1: 2.0, 2: 3.0, 3: None}
    assert repeats.remove_repeats(frame.limit(0), "doc.id", "the text").count() == 0
    copies = spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "doc_id long, copies long")
    assert sorted(r["doc.id"] for r in mixing.repeat_documents(frame, copies, "doc.id").collect()) == [1, 1, 3]
    assert mixing.repeat_documents(frame.limit(0), copies, "doc.id").count() == 0
    assert simhash.drop_near_duplicates(frame, id_col="doc.id", text_col="the text").columns == frame.columns
    assert simhash.drop_near_duplicates(frame.limit(0), id_col="doc.id", text_col="the text").count() == 0
    assert decontaminate.remove_contaminated(frame, spark.createDataFrame([(1, "iota kappa")], "item_id long, text string"), "the text").count() == 1


def test_near_copies_leave_one(docs, none):
    kept = simhash.drop_near_duplicates(docs)
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert kept.columns == docs.columns
    # 3, 4 and 5 have no words; 8 comes twice; 9 and 10 share 36 of 38 shingles.
    assert ids == sorted([1, 2, 3, 6, 7, 8, None, 9, 11], key=repr)
    assert simhash.drop_near_duplicates(none).count() == 0


def edited_groups(rng, groups, copies, share):
    """Texts of ``groups`` originals and their copies, of which each has a share of its words replaced."""
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 240))]
        out.append(base)
        for _ in range(copies):
            w = list(base)
            for k in rng.sample(range(len(w)), max(1, round(len(w) * rng.uniform(*share)))):
                w[k] = f"x{rng.randrange(10**6)}"
            out.append(w)
    rng.shuffle(out)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("groups, copies, share", [(3, 150, (0.012, 0.021)), (40, 4, (0.02, 0.03))])
def test_near_copies_of_edited_groups(spark, groups, copies, share):
    texts = edited_groups(random.Random(11), groups, copies, share)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    group = list(range(len(texts)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                group[y] = x
    for tile in (simhash.TILE, 16):
        kept = simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tile=tile)
        assert {r.doc_id for r in kept.collect()} == {find(i) for i in range(len(texts))}


def test_texts_that_are_only_somewhat_alike_meet_in_few_pairs(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.04 else w for w in base) for _ in range(80)]
    made, write = [], simhash.materialize

    def counting(df, name):
        written = write(df, name)
        if name == "near-pairs":
            made.append(written.count())
        return written

    monkeypatch.setattr(simhash, "materialize", counting)
    kept = simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    alike = sum(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert kept >= 80 - alike and alike < 10 and sum(made) < 300  # of 3160 pairs


def test_keys_of_the_same_texts_leave_the_first(spark):
    rows = [(10, 1, 0), (10, 2, 3), (11, 1, 1), (11, 2, 4), (12, 1, 2), (12, 2, 5), (12, 3, 0), (9, 3, 1), (9, 1, 7)]
    kept = simhash.first_keys(spark.createDataFrame(rows, "key long, v long, place int")).select("key", "v", "place")
    assert sorted(map(tuple, kept.collect())) == sorted(r for r in rows if r[0] != 11)
    first = {r.v: list(r)[1:] for r in simhash.first_of(kept).collect()}
    assert first == {1: [10, 12, 9, 10, 10, 10, 10, 10], 2: [10, 12, *[10] * 6], 3: [12, 9, *[12] * 6]}


def test_pairs_are_made_once_whatever_keys_they_share(spark, monkeypatch):
    texts = edited_groups(random.Random(5), 3, 40, (0.02, 0.035))
    docs, made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), []
    plain = type(docs).mapInArrow

    def counting(self, run, schema, *more):
        out = plain(self, run, schema, *more)
        if schema == "x long, y long":
            made.extend(map(tuple, out.collect()))
        return out

    monkeypatch.setattr(type(docs), "mapInArrow", counting)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    alike = [(j, i) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= 0.8 * len(a | b)]
    group = list(range(len(texts)))
    for _ in texts:
        for j, i in alike:
            group[i] = group[j] = min(group[i], group[j])
    assert kept == set(group)
    assert 0 < len(made) <= 1.1 * len(set(made))


def test_toxicity(spark):
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = [f"w{(i * 7 + k * 13) % 500}" for k in range(30)]
        if toxic:
            words[i % 29], words[(i * 3) % 28] = ("badword", "nasty") if i % 12 else ("stemxa" + "abc"[i % 3], "badword")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "plain text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    table = spark.createDataFrame([*labels, (None, 1), (3, 0)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, table)
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [(found[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r.held_out for r, _ in held) and all(r.predicted == y for r, y in held)
    assert found[1000].predicted == found[1001].predicted == 0 and len(found) == len(rows)
    assert toxicity.filter_toxic(docs, model).columns == docs.columns
    empty = toxicity.fit_toxicity(docs, table.limit(0))
    assert toxicity.score_toxicity(docs, empty).where("predicted = 1").count() == 0
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_patterns_can_be_voters(spark):
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnr"]
    text = lambda: " ".join(rng.choice(words) for _ in range(40))
    rows, labels = [], []
    for i in range(600):
        toxic, t = i % 4 == 0, text()
        if toxic:
            t += rng.choice([" f**k", " go aw*y", " q@q"]) + " " + text()
        rows.append((i, t)), labels.append((i, 0, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert "#masked" in model.voters.voter
    scored = toxicity.score_toxicity(docs, model).where("held_out").collect()
    assert scored and all((r.predicted == 1) == (r.doc_id % 4 == 0) for r in scored)


def test_long_words_are_learned_whole(spark):
    long = "x" * 60
    rows = [(i, f"plain {'y' * 60} text {i}" if i % 3 else f"see {long}bad here {i}") for i in range(300)]
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).where("held_out").collect()
    assert all((r.predicted == 1) == (r.doc_id % 3 == 0) for r in scored)


def test_precision_of_a_word_ignores_the_share_sampled(spark):
    # "halfbad" is in 95 % of the toxic and 15 % of the other texts, of which there are ten times as many.
    rng, rows = random.Random(8), []
    for i in range(3300):
        toxic = i % 11 == 0
        w = [f"q{rng.randrange(10**6)}" for _ in range(8)]
        w[3] = "vileword" if toxic else w[3]
        w[5] = "halfbad" if rng.random() < (0.95 if toxic else 0.15) else w[5]
        rows.append((i, " ".join(w), 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    sample = toxicity.training_sample(docs, docs.select("doc_id", "quality", "toxic"), "doc_id", "text", 250)
    names = {n for n, _, _ in toxicity.learn_lexicon(sample)}
    assert any("vileword".startswith(n.rstrip("*")) for n in names)
    assert not any("halfbad".startswith(n.rstrip("*")) for n in names)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.2
    votes = np.column_stack([np.where(y, rng.random(4000) < 0.6, rng.random(4000) < 0.002) for _ in range(6)]).astype(float)
    posterior, fit = toxicity.label_model(votes)
    assert ((posterior > 0.5) == y).mean() > 0.97 and np.abs(fit["on"] - 0.6).max() < 0.1


def test_sha_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_very_long_texts(spark, tmp_path):
    rng = np.random.default_rng(1)
    n = 400_000
    words = [f"w{i}" for i in rng.integers(0, 60_000, n).tolist()]
    text, line = " ".join(words), "\n" + " ".join(f"line{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text + line, "a"), (2, "short" + line, "b"), (3, "z" * 3_000_000, "a")], "doc_id long, text string, source string").repartition(3).cache()
    bench = spark.createDataFrame([(7, " ".join(words[200_000:200_015]))], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.find_contamination(docs, bench).collect()}
    assert found[1].n_hit == 15 and found[2].n_hit == found[3].n_hit == 0
    counts = {r.doc_id: r for r in token_counts.count_tokens(docs, TOKENIZER).collect()}
    token_files.write_token_files(docs, f"file://{tmp_path}/tokens", TOKENIZER, shards=2)
    places = {r.doc_id: r for r in token_files.read_token_files(spark, f"file://{tmp_path}/tokens").collect()}
    assert all(places[i].n_tokens == counts[i].n_tokens + 1 for i in counts) and counts[3].n_bytes == 3_000_000
    quality_rows = {r.doc_id: r for r in quality.apply_quality_rules(docs).collect()}
    assert quality_rows[1].n_words == n + 60 and quality_rows[3].n_words == 1
    spans = repeats.repeated_spans(docs).collect()
    assert [r.doc_id for r in spans] == [2] and spans[0].n_words >= 27
    prints = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.near_duplicates(docs).collect()}
    assert prints[1] == brute_fingerprint(text + line) and prints[3] == brute_fingerprint("z" * 3_000_000)
    assert simhash.drop_near_duplicates(docs).count() == 3
    taken = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    assert taken[1].size == n + 60 and taken[1].taken <= 3 * taken[1].size
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).count() == 3
