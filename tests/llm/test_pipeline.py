"""The pipeline, stage by stage, against a brute-force version."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")


def hash28(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:7], 16)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, n=5):
    w = [x.lower() for x in words(text)]
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def near(a, b):
    x, y = shingles(a), shingles(b)
    return [w.lower() for w in words(a)] == [w.lower() for w in words(b)] or (len(x & y) >= 0.8 * len(x | y) if x | y else True)


def without_near(docs):
    """The least id of each group."""
    group = {i: i for i in docs}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(docs)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if find(i) != find(j) and near(docs[i][0], docs[j][0]):
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    return {i: d for i, d in docs.items() if find(i) == i}


def leaks(text, bench):
    cut = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").lower())
    w = cut(text)
    for b in map(cut, bench):
        n = min(10, len(b))
        if n and any(w[p : p + n] == b[s : s + n] for s in range(len(b) - n + 1) for p in range(len(w) - n + 1)):
            return True
    return False


def copies(docs):
    """Copies of each document by systematic sampling."""
    size = {i: len(words(t)) for i, (t, _) in docs.items()}
    sources = sorted({s for _, s in docs.values() if s is not None}) + ([None] if any(s is None for _, s in docs.values()) else [])
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(sources)}
    total = {s: sum(size[i] for i, (_, x) in docs.items() if x == s) for s in sources}
    capped = set()
    while True:
        level = (sum(total.values()) - sum(3.0 * total[s] for s in capped)) / sum(weight[s] for s in sources if s not in capped)
        more = {s for s in sources if s not in capped and weight[s] * level > 3 * total[s]}
        if not more:
            break
        capped |= more
    out = {}
    for s in sources:
        target = 3.0 * total[s] if s in capped else weight[s] * level
        rate = target / total[s] if total[s] else 0.0
        offset = hash28(f"7:{s or ''}") / 2**28
        order = sorted((i for i, (_, x) in docs.items() if x == s), key=lambda i: (len(f"{size[i]:b}"), hash28(str(i)) % 64, size[i], i))
        for k, i in enumerate(order, 1):
            out[i] = min(3, math.floor(k * rate + offset) - math.floor((k - 1) * rate + offset))
    return out


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng, docs, labels = random.Random(3), {}, []
    for i in range(360):
        w = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(900)}" for _ in range(rng.randrange(30, 120))]
        toxic = i % 5 == 0
        if toxic:
            for bad in ("vileword", "foulterm", "crudename"):
                w[rng.randrange(len(w))] = bad
        docs[i] = (" ".join(w), rng.choice(["a", "a", "a", "b", "c", None]))
        labels.append((i, 1, int(toxic)))
    bench = [" ".join(words(docs[7][0])[5:20]), "unseen item of five words"]
    docs[400], docs[401] = (docs[1][0], "b"), (docs[2][0] + " tail", "a")
    docs[402] = ("start here " + bench[0] + " end here", "c")
    docs[403], docs[404] = ("", "a"), (None, "b")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, (t, s) in docs.items()], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    after = [{i: d for i, d in docs.items() if i % 5 or i >= 400}]
    after.append(without_near(after[-1]))
    after.append({i: d for i, d in after[-1].items() if not leaks(d[0], bench)})
    assert {400, 401} & set(after[1]) == set() and 402 not in after[2] and 404 not in after[1]
    taken = copies(after[-1])

    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        path = str(tmp_path / name)
        out.write.parquet(path)
        df = spark.read.parquet(path)
        if k < 4:
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = sorted(r.doc_id for r in df.select("doc_id").collect())
        if k < 3:
            assert ids == sorted(after[k]), name
        else:
            assert ids == sorted(i for i, n in taken.items() for _ in range(n)), name
    tokenizer, start, expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i in ids:
        raw = np.array([*tokenizer.encode(docs[i][0] or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((i, start, len(raw), zlib.crc32(raw.tobytes())))
        start += len(raw)
    assert sorted(map(tuple, df.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == sorted(expected)
    assert corpus_pipeline.ORACLE_SQL is None
