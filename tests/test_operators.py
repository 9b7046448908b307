import math
import time

import numpy as np
import pandas as pd
import pytest

from vecloom.config import Config
from vecloom.functions import numeric
from vecloom.operators import compare, crowding, evaluate, neighbours, project, sampling, schema, separability, training
from vecloom.operators.moments import moments
from vecloom.operators.pairs import sums, top_k
from vecloom.sources.embed import Endpoint, embed, embed_new
from vecloom.sources.readers import read_vectors, shards


def sphere(n, d, seed=0):
    return crowding.uniform(n, d, seed)


def table(spark, x, labels=None):
    return spark.createDataFrame([(i, v.tolist(), None if labels is None else labels[i]) for i, v in enumerate(x)], "id bigint, vec array<double>, label string")


def clumped(n=1500, d=64, sizes=(60, 40), spread=0.02):
    x = sphere(n, d)
    random, at = np.random.default_rng(3), n - sum(sizes)
    for s, c in zip(sizes, sphere(len(sizes), d, 9), strict=True):
        x[at : at + s] = c + spread * random.standard_normal((s, d))
        at += s
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_error_function():
    x = np.linspace(-3, 3, 61)
    assert np.abs(numeric.erf(x) - [math.erf(v) for v in x]).max() < 2e-7


def test_exceedance_counts_ties():
    assert numeric.exceedance(np.array([0.1, 0.2, 0.2, 0.9]), np.array([0, 0.15, 0.2, 0.85, 0.95])).tolist() == [1, 0.75, 0.75, 0.25, 0]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_moments_do_not_depend_on_partitions(spark, parts):
    x = np.random.default_rng(0).standard_normal((200, 6))
    m = moments(table(spark, x).repartition(parts))
    assert np.allclose(m.cov, np.cov(x.T)) and np.allclose(m.mean, x.mean(0)) and m.n == 200
    assert math.isclose(m.norm_sd, np.linalg.norm(x, axis=1).std(), rel_tol=1e-9)


def test_isoscore_ends():
    assert math.isclose(numeric.isoscore(np.ones(8)), 1) and numeric.isoscore(np.eye(8)[0]) < 1e-9


@pytest.mark.parametrize("block", [7, 1000])
def test_neighbours_equal_brute_force(spark, block):
    x = sphere(60, 8)
    x[1] = x[0]
    t = table(spark, x)
    got = {(r.src, r.rank): r.dst for r in top_k(t, t, 4, block=block).collect()}
    c = x @ x.T
    for i in range(60):
        want = sorted((j for j in range(60) if j != i), key=lambda j: (-round(c[i, j], 12), j))[:4]
        assert [got[i, r] for r in range(1, 5)] == want


def test_more_neighbours_than_rows(spark):
    t = table(spark, sphere(3, 4))
    assert neighbours.graph(t, 10).count() == 6
    assert neighbours.graph(t.limit(1), 10).count() == 0


def test_mutual_edges(spark):
    idx = [[1, 2], [2, 3], [3, 0], [0, 1]]
    e = spark.createDataFrame([(i, j, 1.0 - 0.1 * r, r + 1) for i, js in enumerate(idx) for r, j in enumerate(js)], "src bigint, dst bigint, cos double, rank int")
    assert {(r.src, r.dst) for r in neighbours.mutual(e).collect()} == {(0, 2), (1, 3), (2, 0), (3, 1)}


def test_collisions_equal_brute_force(spark):
    x = sphere(40, 5)
    phi = numeric.normal_cdf(-np.sqrt(np.maximum(2 - 2 * x @ x.T, 0)) / 0.8)
    np.fill_diagonal(phi, 0)
    got = {r.id: r.collisions for r in crowding.item_collisions(table(spark, x), 0.4).collect()}
    assert np.allclose([got[i] for i in range(40)], phi.sum(1))


def test_pockets_of_planted_sizes():
    found = crowding.pockets(clumped(), 20)
    assert sorted(p["size"] for p in found if p["prominence"] > 0.2)[-2:] == pytest.approx([40, 60], abs=8)
    assert all(p["birth"] < 0.4 for p in found[:2])
    assert not [p for p in crowding.pockets(sphere(600, 64), 20) if p["prominence"] > 0.1]


def test_spanning_tree_weight():
    x = sphere(30, 3)
    d = 1 - x @ x.T
    edges = sorted((d[i, j], i, j) for i in range(30) for j in range(i))
    parent, total = list(range(30)), 0.0

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for w, i, j in edges:
        if top(i) != top(j):
            parent[top(i)] = top(j)
            total += w
    assert math.isclose(crowding.spanning_tree(d)[:, 2].sum(), total)


def test_rank_envelope_power_and_level():
    at = np.linspace(-0.5, 1, 60)
    random = np.random.default_rng(1)
    null = lambda: numeric.exceedance(numeric.sphere_cosines(64, 5000, random), at)
    nulls = np.array([null() for _ in range(39)])
    x = clumped(800, 64, (100,), 0.01)
    i, j = random.integers(0, 800, (2, 5000))
    c = np.einsum("ij,ij->i", x[i[i != j]], x[j[i != j]])
    assert numeric.rank_envelope(numeric.exceedance(c, at), nulls)["p"] == 1 / 40
    assert sum(numeric.rank_envelope(null(), nulls)["p"] <= 0.05 for _ in range(20)) <= 4


def test_separable_groups(spark):
    centre, random = sphere(3, 16, 4), np.random.default_rng(0)
    x = np.repeat(centre, 20, axis=0) + 0.05 * random.standard_normal((60, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = table(spark, x, [f"g{i // 20}" for i in range(60)])
    assert separability.silhouette(t).agg({"silhouette": "min"}).first()[0] > 0.7
    assert neighbours.purity(neighbours.graph(t, 5), t).agg({"purity": "min"}).first()[0] == 1
    one = table(spark, x[:3], ["a", "a", "b"])
    assert {r.id: r.silhouette for r in separability.silhouette(one).collect()}[2] == 0


def test_compare_invariances(spark):
    x = sphere(80, 6)
    q, _ = np.linalg.qr(np.random.default_rng(2).standard_normal((6, 6)))
    a, b = table(spark, x), table(spark, x @ q).orderBy("label")
    both = compare.checked_align(a, b)
    assert math.isclose(compare.block_cka(both), 1, rel_tol=1e-9) and compare.procrustes(both) < 1e-9
    assert math.isclose(compare.block_cka(both), 1, rel_tol=1e-9)
    p, r = compare.matrices(both)
    assert math.isclose(compare.rbf_cka(p, r), 1, rel_tol=1e-9) and compare.mmd(p, p) < 0.01
    assert compare.energy(a, a).first()[0] < 1e-9
    with pytest.raises(ValueError):
        compare.checked_align(a, b.withColumn("id", b.id + 1000))


def test_alignment_of_other_dimensions(spark):
    x = sphere(20, 6)
    both = compare.align(table(spark, x), table(spark, x[:, :4]))
    assert both.count() == 20 and compare.drift(both).where("drift IS NOT NULL").count() == 0


def test_miner_wants_a_window(spark):
    with pytest.raises(ValueError):
        training.confusable_negatives(None, None, 0.5, 0.5, 1)


def test_ranks_with_ties(spark):
    s = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.9), (1, 3, 0.95)], "q int, id int, cos double")
    assert evaluate.gold_ranks(s, spark.createDataFrame([(1, 1)], "q int, id int")).first()["rank"] == 2
    r = spark.createDataFrame([(1.0, True), (1.0, False), (2.0, True), (0.0, False)], "s double, p boolean")
    assert evaluate.auc(r, "s", "p").first()[0] == 0.875
    assert numeric.binomial_tail(0, 12) == pytest.approx(2 / 4096)


def test_sign_test_of_many_draws():
    """As the exact integers have it, and within a second where their number's square would take hours."""
    from fractions import Fraction

    for n in (1, 2, 7, 40, 1001, 3000):
        for k in {0, 1, n // 3, n // 2 - n // 50, n // 2, n}:
            least = min(k, n - k)
            want = min(Fraction(1), Fraction(2 * sum(math.comb(n, i) for i in range(least + 1)), 2**n))
            assert numeric.binomial_tail(k, n) == pytest.approx(float(want), rel=1e-9, abs=1e-300)
    began = time.time()
    assert numeric.binomial_tail(4_998_000, 10_000_000) == pytest.approx(0.2059, abs=1e-3)  # z = -1.2646
    assert numeric.binomial_tail(1_000_000, 10_000_000) == 0
    assert time.time() - began < 1


def test_validation(spark):
    bad = spark.createDataFrame([(1, [1.0, 2.0], "a"), (1, [float("nan"), 1.0], "a"), (2, None, "a"), (3, [1.0], "a"), (4, [0.0, 0.0], "a")], "id bigint, vec array<double>, label string")
    r = schema.validate(bad).first()
    assert (r.n, r.n_null, r.n_not_finite, r.n_zero, r.n_repeated_ids, r.n_uneven) == (5, 1, 1, 1, 1, 1)
    with pytest.raises(ValueError):
        schema.checked(bad)
    assert schema.unit(bad.where("id = 4")).first().vec == [0.0, 0.0]


def test_sample_ignores_partitions(spark):
    t = table(spark, sphere(300, 3))
    want = {r.id for r in sampling.sample(t.repartition(1), 50).collect()}
    assert {r.id for r in sampling.sample(t.repartition(9), 50).collect()} == want


def test_readers(spark, tmp_path):
    x = sphere(30, 4).astype(np.float32)
    np.save(tmp_path / "a.npy", x)
    np.savez(tmp_path / "b.npz", embeddings=x, ids=np.array([f"id{i}" for i in range(30)]), labels=np.array(["u"] * 30))
    pd.DataFrame(x, columns=list("pqrs")).assign(id=range(30)).to_csv(tmp_path / "c.csv", index=False)
    pd.DataFrame({"id": range(30), "embedding": list(x.tolist())}).to_json(tmp_path / "d.jsonl", orient="records", lines=True)
    pd.DataFrame({"id": range(30), "embedding": list(x.tolist())}).to_parquet(tmp_path / "e.parquet")
    for name in ("a.npy", "b.npz", "c.csv", "d.jsonl", "e.parquet"):
        got = read_vectors(spark, str(tmp_path / name))
        assert np.allclose(moments(got).mean, x.mean(0), atol=1e-6), name
        assert got.select("id").distinct().count() == 30
    assert read_vectors(spark, str(tmp_path / "b.npz")).where("label = 'u'").count() == 30
    assert shards(str(tmp_path))[0].endswith("e.parquet")
    with pytest.raises(ValueError):
        read_vectors(spark, x, ids=[1, 2])


def test_endpoint_tries_again():
    calls = []

    def send(body):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}

    assert Endpoint("http://x", "m", send=send, wait=lambda s: None)(["a", "b"]) == [[1.0], [2.0]]


def test_embedding_cache(spark, tmp_path):
    client = lambda texts: [[float(len(t)), 1.0] for t in texts]
    t = spark.createDataFrame([("a", "xx"), ("b", None)], "id string, text string")
    assert {r.id: r.embedding[0] for r in embed(t, client).collect()} == {"a": 2.0, "b": 0.0}
    out = str(tmp_path / "cache")
    embed_new(t, client, out, "m").collect()
    more = t.union(spark.createDataFrame([("c", "yyy")], t.schema))
    assert embed_new(more, client, out, "m").count() == 3 and spark.read.parquet(out).count() == 3


def test_stream_of_moments(spark, tmp_path):
    from vecloom.streaming.moments import accumulate, current

    x = sphere(50, 4)
    for i in range(2):
        table(spark, x[25 * i : 25 * i + 25]).withColumnRenamed("vec", "embedding").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, embedding array<double>, label string").option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    accumulate(stream, str(tmp_path / "sums"), str(tmp_path / "cp")).awaitTermination()
    m = current(spark, str(tmp_path / "sums"))
    assert m.n == 50 and np.allclose(m.mean, x.mean(0))


def test_peaks_and_hull():
    g = np.zeros((5, 7))
    g[1, 1], g[3, 5], g[2, 3] = 3, 2, 1
    top = project.peaks(g, 0.5)
    assert top[0][:3] == (1, 1, 3.0) and {p[:2] for p in top} == {(1, 1), (3, 5), (2, 3)}
    assert project.area(project.hull(np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5]]))) == 1


def test_components(spark):
    n = spark.range(8)
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6)], "a bigint, b bigint")
    assert {r.id: r.root for r in project.graph_components(e, n).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7}


def test_config():
    c = Config().merged('{"k": 5, "voxels": true}')
    assert c.k == 5 and c.shows("voxels") and not c.shows("hexagons") and c.shows("diagnose")
    with pytest.raises(ValueError):
        Config(metric="manhattan")


def test_sums_by_label(spark):
    x = sphere(10, 3)
    t = table(spark, x, [str(i % 2) for i in range(10)])
    got = {(r.id, r.label): (r.total, r.n) for r in sums(t, t, lambda c: c, by="label", block=3).collect()}
    c = x @ x.T
    assert got[0, "0"] == (pytest.approx(sum(c[0, j] for j in range(2, 10, 2))), 4)
