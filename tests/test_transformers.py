"""Golden values and the contract that every transformer keeps."""

import math
from random import Random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strataloom.gene import create_gene
from strataloom.plans.pipeline import RejectedColumn, apply_gene, apply_genes, fit_genes
from strataloom.registry import TRANSFORMERS, Target, create_transformer, register_transformer


def column(spark, gene, train, test=None, target=None):
    states = {}
    fit_genes(train, [gene], target, states)
    out = apply_genes(train if test is None else test, [gene], states)
    return [r[gene.output] for r in out.orderBy("i").collect()]


@pytest.fixture(scope="module")
def mixed(spark):
    rng = Random(1)
    rows = [
        Row(i=i, a=None if i % 13 == 0 else rng.gauss(10, 3), b=rng.uniform(-5, 5), c=None if i % 11 == 0 else rng.choice("xyz"), e=rng.choice(["red", "blue", "green"]), t=None if i % 17 == 0 else f"2024-0{i % 9 + 1}-1{i % 9} 0{i % 9}:00:00", u=f"2023-0{i % 9 + 1}-01", y=float(i % 2))
        for i in range(120)
    ]
    return spark.createDataFrame(rows, "i long, a double, b double, c string, e string, t string, u string, y double")


@pytest.mark.parametrize("name", sorted(TRANSFORMERS))
def test_contract(spark, mixed, name):
    """Fit on training rows, apply to others with unseen levels and nulls: a value for each row, nothing raised."""
    t = TRANSFORMERS[name]
    pool = {"numeric": ["a", "b"], "categorical": ["c", "e"], "datetime": ["t", "u"], "mixed": ["c", "a", "b"]}[t.input_type]
    inputs = ["c", "a"] if t.arity == "mixed_binary" else ["c", "a", "b"] if name == "between_group_pca" else pool[: max(1, t.n_inputs[0] if t.n_inputs[0] > 1 else 1)]
    if t.input_type == "mixed" and t.arity == "multivariate":
        inputs = ["c", "a", "b"]
    gene = create_gene(name, inputs, **t.sample_params(Random(3), len(inputs)))
    train = mixed.where("i < 90")
    test = mixed.withColumn("c", F.when(F.col("i") > 100, F.lit("unseen")).otherwise(F.col("c"))).withColumn("e", F.when(F.col("i") > 105, F.lit("")).otherwise(F.col("e")))
    target = Target.of(train, "y") if t.needs_target else None
    assert len(column(spark, gene, train, test, target)) == 120
    assert len(column(spark, gene, train, test.limit(0), target)) == 0


def test_groupby_signed_log(spark):
    train = spark.createDataFrame([(1, "a", 10.0), (2, "a", 20.0), (3, "b", 100.0), (4, "b", 200.0)], "i int, c string, x double")
    test = spark.createDataFrame([(1, "a", 15.0), (2, "a", 25.0), (3, "b", 50.0), (4, "new", 182.5)], "i int, c string, x double")
    gene = create_gene("groupby_signed_log", ["c", "x"])
    assert column(spark, gene, train) == pytest.approx([-math.log1p(5), math.log1p(5), -math.log1p(50), math.log1p(50)])
    assert column(spark, gene, train, test) == pytest.approx([0, math.log1p(10), -math.log1p(100), math.log1p(100)])


def test_pooled_target_encode(spark):
    rows = [(i, "A", float(i < 8)) for i in range(10)] + [(10 + i, "B", float(i < 3)) for i in range(10)]
    df = spark.createDataFrame(rows, "i int, c string, y double")
    out = column(spark, create_gene("pooled_target_encode", "c"), df, target=Target.of(df, "y"))
    assert out[0] == pytest.approx(0.7646946, abs=1e-6) and out[10] == pytest.approx(0.3353054, abs=1e-6)


def test_null_is_a_group_of_its_own(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, 4.0), (3, "a", 9.0)], "i int, c string, x double")
    assert column(spark, create_gene("groupby_mean", ["c", "x"]), df) == [3.0, 3.0, 9.0]


def test_feature_hash_marks_one_bin(spark, mixed):
    bins = [create_gene("feature_hash", "e", num_bins=4, comp_idx=k) for k in range(1, 5)]
    out = apply_genes(mixed, bins, {g.state_key: s for g in bins for s in [_state(mixed, g)]})
    assert {sum(r[g.output] for g in bins) for r in out.collect()} == {1.0}


def _state(df, gene):
    states = {}
    fit_genes(df, [gene], None, states)
    return states[gene.state_key]


def test_large_dictionaries_and_ranks_stay_tables(spark, mixed, monkeypatch):
    from strataloom.operators import binning
    from strataloom.plans import pipeline

    genes = [create_gene("groupby_zscore", ["c", "a"]), create_gene("rank_transform", "a"), create_gene("target_encode", "e")]
    target = Target.of(mixed, "y")
    small = [column(spark, g, mixed, target=target) for g in genes]
    monkeypatch.setattr(pipeline, "LOCAL_KEYS", 1)
    monkeypatch.setattr(binning, "LOCAL_VALUES", 5)
    for g, expected in zip(genes, small, strict=True):
        assert column(spark, g, mixed, target=target) == pytest.approx(expected)


def test_constant_and_redundant_columns_are_rejected(spark, mixed):
    with pytest.raises(RejectedColumn, match="constant"):
        apply_gene(create_gene("subtract", ["a", "a"]), mixed)
    with pytest.raises(RejectedColumn, match="redundant"):
        apply_gene(create_gene("add", ["a", "a"]), mixed)


def test_user_transformer(spark, mixed):
    register_transformer(create_transformer("halved_for_test", "unary", lambda gene, state: F.col(gene.inputs[0]) / 2))
    try:
        assert column(spark, create_gene("halved_for_test", "b"), mixed)[3] == pytest.approx(mixed.where("i = 3").first().b / 2)
    finally:
        del TRANSFORMERS["halved_for_test"]


def test_unknown_transformer_lists_the_known():
    with pytest.raises(ValueError, match="groupby_mean"):
        create_gene("nothing", "x")


# Projections against explicit matrices in numpy.
@pytest.fixture(scope="module")
def grouped(spark):
    rng = np.random.default_rng(5)
    n = 400
    f, g = rng.choice(list("abc"), n, p=[0.5, 0.3, 0.2]), rng.choice(list("uv"), n)
    x = rng.normal(0, 1, n) + (f == "a") * 1.5
    y = 0.5 * x + rng.normal(0, 1, n) + (g == "u")
    z = rng.normal(5, 2, n)
    label = np.where(x + y > 1, "hi", np.where(z > 5, "mid", "lo"))
    rows = [(int(i), str(a), str(b), float(c), float(d), float(e), str(k)) for i, (a, b, c, d, e, k) in enumerate(zip(f, g, x, y, z, label, strict=True))]
    return spark.createDataFrame(rows, "i long, f string, g string, x double, y double, z double, label string"), f, g, np.column_stack([x, y, z]), label


def derived(df, name, inputs, k, target=None):
    gene, states = create_gene(name, inputs, comp_idx=k), {}
    fit_genes(df, [gene], Target.of(df, target) if target else None, states)
    return np.array([r[gene.output] for r in apply_genes(df, [gene], states).orderBy("i").collect()])


def indicators(*columns):
    return np.column_stack([(c == v).astype(float) for c in columns for v in sorted(set(c), key=lambda v, c=c: (-(c == v).sum(), v))])


def scores_like(found, expected):
    """Equal up to a sign; zero means."""
    assert abs(np.corrcoef(found, expected)[0, 1]) > 1 - 1e-9
    assert np.std(found) == pytest.approx(np.std(expected), rel=1e-6)


def by_group(m, groups):
    return np.array([m[groups == g].mean(axis=0) for g in groups])


@pytest.mark.parametrize("k", [1, 2])
@pytest.mark.parametrize("supervised", [False, True])
def test_mca_against_numpy(grouped, k, supervised):
    df, f, g, _, label = grouped
    m = indicators(f, g)
    share = m.mean(axis=0)
    scaled = (m - share) / np.sqrt(share * len(m))
    base = by_group(scaled, label) if supervised else scaled
    v = np.linalg.svd(base, full_matrices=False)[2][k - 1]
    found = derived(df, "supervised_mca" if supervised else "mca", ["f", "g"], k, "label" if supervised else None)
    scores_like(found, scaled @ v / np.sqrt(2))


@pytest.mark.parametrize("k", [1, 2])
@pytest.mark.parametrize("supervised", [False, True])
def test_famd_against_numpy(grouped, k, supervised):
    df, f, _, x, label = grouped
    m = indicators(f)
    share = m.mean(axis=0)
    whole = np.column_stack([(x[:, :2] - x[:, :2].mean(axis=0)) / x[:, :2].std(axis=0, ddof=1), (m - share) / np.sqrt(share)])
    base = by_group(whole, label) if supervised else whole
    v = np.linalg.svd(base, full_matrices=False)[2][k - 1]
    found = derived(df, "supervised_famd" if supervised else "famd", ["x", "y", "f"], k, "label" if supervised else None)
    scores_like(found, whole @ v)


@pytest.mark.parametrize("name, inputs, target", [("between_group_pca", ["f", "x", "y", "z"], None), ("supervised_bgpca", ["x", "y", "z"], "label")])
def test_group_projections_against_numpy(grouped, name, inputs, target):
    df, f, _, x, label = grouped
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    v = np.linalg.svd(by_group(z, label if target else f), full_matrices=False)[2][0]
    scores_like(derived(df, name, inputs, 1, target), z @ v)


def test_gap_encode_against_numpy(spark):
    rng = np.random.default_rng(2)
    words = ["apple pie", "apple tart", "banana split", "banana bread", "cherry pie", ""]
    picked = rng.choice(words, 300)
    df = spark.createDataFrame([(int(i), str(w) if i % 17 else None) for i, w in enumerate(picked)], "i long, w string")
    texts = [str(w) if i % 17 else "" for i, w in enumerate(picked)]
    grams = lambda t: [f"^{t}$"[j : j + 3] for j in range(max(len(t), 1))] if t else []
    counts = {}
    for t in texts:
        for q in set(grams(t)):
            counts[q] = counts.get(q, 0) + grams(t).count(q)
    top = sorted(counts, key=lambda q: (-counts[q], q))[:30]
    m = np.array([[grams(t).count(q) for q in top] for t in texts], float)
    v = np.linalg.svd(m - m.mean(axis=0), full_matrices=False)[2][0]
    scores_like(derived(df, "gap_encode", ["w"], 1), (m - m.mean(axis=0)) @ v)


def test_pca_keeps_digits_of_large_means(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(0, 1, 300)
    x = np.column_stack([1e9 + a, 2e9 + 0.5 * a + rng.normal(0, 1, 300)])
    df = spark.createDataFrame([(int(i), float(p), float(q)) for i, (p, q) in enumerate(x)], "i long, p double, q double")
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    found = derived(df, "pca", ["p", "q"], 1)
    assert abs(np.corrcoef(found, z @ np.linalg.svd(z)[2][0])[0, 1]) > 1 - 1e-6


def test_knn_assign_takes_all_distinct_training_rows(spark, tmp_path):
    from strataloom.catalogue import QUERIES
    from strataloom.options import options

    rng = np.random.default_rng(12)
    x = np.round(rng.normal(0, 1, (400, 64)), 3)
    x[:40, 0] = 0.25  # ties of the first coordinate
    x[350:] = x[rng.integers(0, 300, 50)]  # copies, of training rows and others
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(400, None, 0), (401, None, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    training = np.unique(x[np.arange(400) % 5 != 0], axis=0)
    wanted = {i: int(np.argmin(((training - r) ** 2).sum(axis=1))) + 1 for i, r in enumerate(x)} | {400: None, 401: None}
    with options(max_clustering_size=100):
        found = {r.vec_id: r.nearest for r in QUERIES["op_knn_assign"](spark, str(tmp_path)).collect()}
    assert found == wanted


def test_closest_decides_by_differences():
    from strataloom.operators.cluster import closest

    # Products of these lose the distances, which differ in the eighth digit after the point.
    points = np.array([[1e4, 1e4], [1e4, 1e4 + 3e-6], [1e4, 1e4 + 1e-6]])
    best, place = np.full(2, np.inf), np.zeros(2, np.int64)
    closest(np.array([[1e4, 1e4 + 1e-6], [1e4, 1e4 + 4e-6]]), points, best, place, 7)
    assert place.tolist() == [9, 8]
    closest(np.array([[1e4, 1e4 + 1e-6], [1e4, 1e4 + 4e-6]]), points, best, place, 20)  # equally near ones come too late
    assert place.tolist() == [9, 8]


def test_knn_assign_matches_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from strataloom.catalogue import ORACLE_SQL, QUERIES

    rng = np.random.default_rng(13)
    x = 5e4 + np.round(rng.normal(0, 2e-5, (300, 64)), 6)  # far from 0 and near each other
    x[:, 0] = 5e4 + rng.permutation(300) * 2e-6  # no ties in the SQL's order
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(300, None, 0), (301, None, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    found = {r.vec_id: r.nearest for r in QUERIES["op_knn_assign"](spark, str(tmp_path)).collect()}
    assert found == dict(con.execute(ORACLE_SQL["op_knn_assign"]).fetchall())


def test_rank_transform_by_a_table_beside_the_searchs_label(spark, monkeypatch):
    from strataloom.operators import binning

    monkeypatch.setattr(binning, "LOCAL_VALUES", 3)
    df = spark.createDataFrame([(float(v), float(v % 3), float(v)) for v in range(10)], "x double, __y double, __x double")
    gene, states = create_gene("rank_transform", ["x"]), {}
    fit_genes(df, [gene], None, states)
    assert states[gene.state_key].values["counts"] is None
    rows = apply_genes(df, [gene], states).collect()
    assert sorted((r.x, r["__y"], r["__x"], r[gene.output]) for r in rows) == [(float(v), float(v % 3), float(v), (v + 1) / 10) for v in range(10)]
