import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.__main__ import parser, settings
from vecloom.config import Config
from vecloom.functions import numeric
from vecloom.operators import crowding, evaluate, neighbours, occupancy, order, retrieval, sampling, separability, studies, synthetic
from vecloom.report import diagnose, histogram, report
from vecloom.sources.embed import embed_to
from vecloom.sources.readers import read_texts


def test_running_sums_by_ranges(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000, i % 5) for i in range(1000)], "a bigint, v bigint")
    value, want, total = {}, {}, 0
    for r in rows.collect():
        value[r.a] = r.v
    for a in sorted(value):
        want[a] = total
        total += value[a]
    for most in (10, 10**6):
        assert {r.a: r.before for r in order.before(rows, ["a"], "v", most=most).collect()} == want
        assert {r.a: r.n for r in order.numbered(rows, [F.col("a").desc()], "n", most=most).collect()} == {a: 999 - a for a in value}


def test_quantiles_by_places(spark):
    x = np.random.default_rng(1).integers(0, 40, 999).astype(float)
    rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    at = [0.0, 0.1, 0.333, 0.5, 0.985, 1.0]
    for most in (10, 10**6):
        assert np.allclose(order.quantiles(rows, "x", at, most), np.quantile(x, at))


def test_quotas_take_the_least_hashes(spark):
    import hashlib

    rows = [(i, "x" if i % 3 else None) for i in range(4000)]
    t = spark.createDataFrame(rows, "id bigint, g string")
    got = sampling.taken(t, ["g"], F.floor(F.col("n") * 0.2), "id").collect()
    want = set()
    for g in ("x", None):
        ids = sorted((hashlib.md5(f"{i}:0".encode()).hexdigest(), i) for i, k in rows if k == g)
        want |= {i for _, i in ids[: int(len(ids) * 0.2)]}
    assert len(got) == 4000 and {r.id for r in got if r.taken} == want
    assert sampling.taken(t.limit(0), ["g"], F.lit(3), "id").count() == 0
    assert Counter(r.taken for r in sampling.taken(t, ["g"], F.lit(0), "id").collect()) == {False: 4000}


def test_samples_are_spread_over_residues(spark):
    ids = [r.id for r in sampling.sample(spark.range(200_000), 2000).collect()]
    assert len({i % 97 for i in ids}) == 97 and max(Counter(i % 10 for i in ids).values()) < 280


def test_exact_permutation_test():
    rho, p = evaluate.permutation_p([(1, 1), (2, 2), (3, 3), (4, 4)])
    assert np.isclose(rho, 1) and np.isclose(p, 2 / 24)


def test_bootstrap_of_constant_clusters(spark):
    rows = spark.createDataFrame([(i, i % 4, 2.0) for i in range(40)], "q bigint, c bigint, v double")
    assert tuple(evaluate.bootstrap(rows, "v", "q", 200, cluster="c").first()) == (2, 2, 2)
    r = evaluate.bootstrap(rows.withColumn("v", F.col("q") % 2), "v", "q", 500).first()
    assert r.lo < r.mean == 0.5 < r.hi


def test_detectors_tell_a_pocket():
    flat, clumped = studies.detectors(synthetic.uniform(800, 32)), studies.detectors(synthetic.pocketed(800, 32, 80))
    assert set(flat) == set(studies.ALARMS)
    for k, side in studies.ALARMS.items():
        if k in ("sigma_star", "knn_q05", "z", "dtm_ratio", "pocket_prominence", "mean_cos"):
            assert (clumped[k] > flat[k]) == (side == "high"), k


def test_power_and_absorption(spark):
    power = {r.statistic: r.power for r in studies.detection_power(spark, 400, 24, 12, 4).collect()}
    assert power["knn_q05"] == power["pocket_prominence"] == 1 and len(power) == len(studies.ALARMS)
    rows = {(r.share, r.spread): r for r in studies.absorption(spark, 400, 24, (0.01, 0.2), (0.02,), 2, 9, 3000).collect()}
    assert rows[0.2, 0.02].reference >= rows[0.01, 0.02].reference


def test_blur_beyond_the_boundary(spark):
    rows = {(r["size"], r.share): r for r in studies.blur_grid(spark, 1000, 32, (20, 200), (0.01, 0.1)).collect()}
    assert rows[20, 0.01].separation > 2 * rows[20, 0.1].separation and rows[200, 0.1].separation > 5


def test_more_replicates_make_z_surer(spark):
    cos = studies.chosen_cosines(synthetic.cone(500, 24), 3000, np.random.default_rng(0))
    rows = {r.reps: r for r in studies.z_by_replicates(spark, cos, 24, (4, 48), 12).collect()}
    assert rows[48].z_sd < rows[4].z_sd and rows[48].z_mean < -10


def test_nulls_keep_their_level(spark):
    """Of uniform corpora few are told from their null; a shuffled spectrum of an ellipse is its own null."""
    x = synthetic.ellipse(1500, 16)
    from vecloom.operators.moments import moments

    fit = moments(synthetic.table(spark, x))
    at = np.linspace(-0.5, 1, 31)
    cos = studies.chosen_cosines(x, 4000, np.random.default_rng(1))
    own = occupancy.rank_test(cos, occupancy.null_curves(spark, fit, 4000, at, 39, "spectrum"), at)
    flat = occupancy.rank_test(cos, occupancy.null_curves(spark, fit, 4000, at, 39, "uniform"), at)
    assert own["p"] > 0.025 and flat["p"] == 1 / 40


def test_structured_noise_along_and_across(spark):
    pairs = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([0.0, 1.0], [0.0, 0.0])], "va array<double>, vb array<double>")
    got = [r.phi for r in occupancy.structured_collisions(pairs, np.diag([4.0, 1.0])).collect()]
    want = numeric.normal_cdf(np.array([-0.5 / 2, -0.5]))
    assert np.allclose(got, want)


def test_sphere_uniformity_is_exact():
    for d in (3, 16, 300):
        assert np.isclose(numeric.sphere_uniformity(d), numeric.uniformity(numeric.sphere_cosines(d, 400_000, np.random.default_rng(d))), atol=0.02)
    assert np.isclose(numeric.sphere_uniformity(3), -4 + np.log(np.sinh(4) / 4))


def test_density_integrates_to_one(spark):
    rows = spark.createDataFrame([(float(x),) for x in np.random.default_rng(0).normal(0, 0.1, 500)], "cos double")
    at = np.linspace(-1, 1, 201)
    d = {r.x: r.density for r in occupancy.density(rows, "cos", at.tolist(), F.lit(0.05)).collect()}
    assert np.isclose(sum(d.values()) * 0.01, 1, atol=1e-3)


def test_mutual_density_fills_with_the_least(spark):
    e = spark.createDataFrame([(0, 1, 0.9, 1), (1, 0, 0.9, 1), (2, 0, 0.8, 1), (3, 4, 0.5, 1), (4, 3, 0.5, 1)], "src bigint, dst bigint, cos double, rank int")
    assert {r.id: r.density for r in neighbours.mutual_density(e, 1).collect()} == {0: 0.9, 1: 0.9, 2: 0.5, 3: 0.5, 4: 0.5}


def test_greedy_groups_are_disjoint(spark):
    x = synthetic.mixture(120, 8, 10, 0.2)
    t = synthetic.table(spark, x)
    got = neighbours.greedy_groups(neighbours.graph(t, 6), t).collect()
    assert len({r.id for r in got}) == len(got) and set(Counter(r.group for r in got).values()) == {3}
    c = x @ x.T
    for r in got:
        anchor = next(q.id for q in got if q.group == r.group and q.place == 0)
        if r.place:
            assert (c[anchor] > c[anchor, r.id] + 1e-12).sum() - 1 < 6
    with pytest.raises(ValueError):
        neighbours.greedy_groups(neighbours.graph(t, 6), t, most=10)


def test_euclidean_graph(spark):
    x = np.random.default_rng(0).standard_normal((40, 4)) * np.arange(1, 41)[:, None]
    got = {(r.src, r["rank"]): r.dst for r in neighbours.euclidean_graph(synthetic.table(spark, x), 3).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2) + np.eye(40) * 1e9
    assert got == {(i, k + 1): int(np.argsort(d[i])[k]) for i in range(40) for k in range(3)}


def test_angular_pockets_of_planted_cones(spark):
    x = synthetic.pocketed(1500, 48, 40, 0.01, 2, seed=3)
    t = synthetic.table(spark, x)
    field = crowding.field(t, neighbours.graph(t, 50), 48, (10, 50))
    crowded = {r.id for r in crowding.crowded_rows(field).where("crowded").collect()}
    assert set(range(1420, 1500)) <= crowded
    pockets = crowding.angular_pockets(t, field).collect()
    for planted in (range(1420, 1460), range(1460, 1500)):
        own = [p for p in pockets if set(planted) <= set(p.members)]
        assert len(own) == 1 and own[0]["size"] <= 50


def test_pocket_table_of_planted_groups(spark):
    x = synthetic.pocketed(1500, 64, 50, 0.01, 2, seed=5)
    got = crowding.pocket_table(spark, synthetic.table(spark, x), 20, floor=crowding.null_prominence(1000, 64, 20)).collect()
    assert [p["size"] for p in got] == pytest.approx([50, 50], abs=8)


def test_group_sums_and_largest_groups(spark):
    x = synthetic.mixture(90, 6, 3)
    t = synthetic.table(spark, x, [f"g{i % 3}" for i in range(90)]).repartition(5)
    got = {r.label: np.array(r.s) / r.n for r in separability.group_sums(t).collect()}
    assert all(np.allclose(got[f"g{k}"], x[k::3].mean(0)) for k in range(3))
    labels = spark.createDataFrame([("prefix-a",), ("prefix-a",), ("prefix-b",)], "label string")
    assert [tuple(r) for r in separability.largest_groups(labels, 5).collect()] == [("a", 2), ("b", 1)]


def test_unsupervised_labels_find_the_groups(spark):
    x = synthetic.mixture(300, 16, 4, 0.05)
    got = {r.id: r.label for r in separability.unsupervised(synthetic.table(spark, x), range(3, 7)).collect()}
    assert len({(i % 4, got[i]) for i in got}) == 4


def test_manifest_needs_every_vector(spark):
    x = synthetic.table(spark, synthetic.uniform(5, 3))
    assert retrieval.aligned(x.select("id").where("id < 3"), x).count() == 3
    with pytest.raises(ValueError):
        retrieval.aligned(spark.range(7), x)


def test_timed_phases(spark):
    ticks = iter(range(10))
    assert studies.timed({"a": lambda: spark.range(3), "b": lambda: None}, lambda: next(ticks)) == [("a", 1), ("b", 1)]


def blobs(tmp_path, name, x, ids, labels):
    np.savez(tmp_path / name, embeddings=x, ids=ids, labels=labels)
    return str(tmp_path / name)


def test_report_of_any_source_and_a_second_one(spark, tmp_path):
    x = synthetic.mixture(240, 12, 4, 0.3)
    ids, labels = np.array([f"id-{i:05}" for i in range(240)]), np.array([f"g{i % 4}" for i in range(240)])
    a = blobs(tmp_path, "a.npz", x, ids, labels)
    o = np.random.default_rng(1).permutation(240)
    b = blobs(tmp_path, "b.npz", (x + 0.1 * synthetic.uniform(240, 12, 3))[o], ids[o], labels[o])
    config = Config(pairs=2000, sample=150, k=5, title="Two & more", views={v: False for v in ("rank_envelope", "stolarsky_z", "local_anisotropy", "pockets", "label_analysis", "separability")})
    r = report(spark, a, config, str(tmp_path / "out.html"), b)
    assert not r.failed and "cmp_overlap_hist" in r.shown and "pockets" not in r.shown
    page = (tmp_path / "out.html").read_text()
    assert "Two &amp; more" in page and "cmp drift grid" in page
    alone = report(spark, a, Config(pairs=1000, metric="euclidean", views={v: False for v in config.views} | {"pca_peaks": False}))
    assert not alone.failed and not [v for v in alone.shown if v.startswith("cmp")]
    with pytest.raises(ValueError):
        report(spark, a, config, compare=blobs(tmp_path, "c.npz", x, np.array([f"z-{i}" for i in range(240)]), labels))


def test_info_of_a_source(spark, tmp_path):
    np.save(tmp_path / "x.npy", synthetic.cone(300, 16))
    d = diagnose(spark, str(tmp_path / "x.npy"), Config(pairs=3000)).first()
    assert (d.n, d.dim) == (300, 16) and 0.1 < d.mean_cos < 0.5
    assert "#" in histogram(spark, str(tmp_path / "x.npy"), Config(pairs=3000))


def test_embedding_verb_and_flags(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps({"body": f"text {i}", "key": f"k{i}", "kind": "a"}) for i in range(5)))
    texts = read_texts(spark, str(tmp_path / "t.jsonl"), "body", "key", "kind")
    embed_to(texts, lambda t: [[float(len(x))] for x in t], str(tmp_path / "o.jsonl"))
    assert {r.id: (r.label, r.embedding[0]) for r in spark.read.json(str(tmp_path / "o.jsonl")).collect()}["k3"] == ("a", 6)
    embed_to(texts.withColumn("label", F.lit(None).cast("string")), lambda t: [[1.0] for _ in t], str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).columns == ["id", "text", "embedding"]
    c = settings(parser().parse_args(["report", "s", "o", "--metric", "euclidean", "--k", "7", "--sample", "99", "--show", "voxels", "--hide", "shells", "--compare", "b"]))
    assert (c.metric, c.k, c.sample, c.shows("voxels"), c.shows("shells")) == ("euclidean", 7, 99, True, False)


def test_hull_and_voids_of_all_points(spark):
    from vecloom.operators import project

    p = np.random.default_rng(2).random((800, 2))
    t = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id bigint, x double, y double").repartition(5)
    got = project.hull(np.array([(r.x, r.y) for r in project.hull_candidates(t).collect()]))
    assert np.allclose(sorted(map(tuple, got)), sorted(map(tuple, project.hull(p))))
    box = (p - p.min(0)) / (p.max(0) - p.min(0))
    x, y, r = project.voids(t, 24, 18)[0]
    g = np.array([((i + 0.5) / 24, (j + 0.5) / 18) for j in range(18) for i in range(24)])
    assert np.isclose(r, np.sqrt(((g[:, None] - box[None]) ** 2).sum(2)).min(1).max())
    assert project.voids(t.limit(0)) == []


def test_polylines_join_segments():
    from vecloom.operators import project

    y, x = np.mgrid[0:30, 0:30]
    lines = project.polylines(project.contours(-((x - 14.5) ** 2 + (y - 14.5) ** 2).astype(float), -60.0))
    assert len(lines) == 1 and np.allclose(lines[0][0], lines[0][-1]) and len(lines[0]) > 40
    assert np.allclose(project.smoothed(np.ones((9, 7))), 1)


def test_betweenness_and_bridges():
    from vecloom.operators import project

    path = [(i, i + 1, 1.0) for i in range(5)]
    nodes, edges = project.betweenness(path, list(range(6)), 6)
    assert nodes[2] == nodes[3] == max(nodes.values()) and edges[2, 3] == max(edges.values()) == 18
    at = {i: (float(i), 0.0) for i in range(6)}
    assert project.bridges(path, at, dict.fromkeys(range(6), 0), sources=6)[0][:2] == (2, 3)
    apart = project.bridges([(0, 1, 1.0)], {0: (0.0, 0.0), 1: (1.0, 0.0), 2: (4.0, 0.0)}, {0: 0, 1: 0, 2: 2})
    assert apart == [(1, 2, 3.0, 0.0)]


def test_texts_of_packed_lines(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "q.jsonl.gz", "wt") as f:
        f.write('{"text": "a", "k": 1}\n{"text": "b", "k": 2}\n')
    assert {(r.id, r.text) for r in read_texts(spark, str(tmp_path / "q.jsonl.gz"), id="k").collect()} == {("1", "a"), ("2", "b")}
