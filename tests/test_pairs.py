"""All pairs without a shuffle of pairs: what is exchanged grows with the rows, results are those of brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions import numeric
from vecloom.operators import compare, crowding, neighbours, pairs, separability


def rows(spark, x, ids=None, labels=None):
    n = len(x)
    data = [(int(i), [float(v) for v in r], g) for i, r, g in zip(ids if ids is not None else range(n), x, labels or ["a"] * n, strict=True)]
    return spark.createDataFrame(data, "id bigint, vec array<double>, label string").repartition(3)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_row_is_sent_to_every_block(spark):
    """Each row went to every block's group before: as many copies as there are blocks."""
    t = rows(spark, crowding.uniform(300, 6, 0))
    for got in (pairs.top_k(t, t, 3, block=16), pairs.sums(t, t, lambda c: c, block=16), pairs.at_least(t, 0.9, block=16), pairs.counts_above(t.withColumn("above", F.lit(0.5)), t, block=16)):
        assert "Generate" not in plan(got) and "Expand" not in plan(got)
    assert "Generate" not in plan(separability.silhouette(t))


@pytest.mark.parametrize("parts", [1, 2, 3, 4, 7, 8])
def test_every_two_parts_meet_once(parts):
    met = sorted(tuple(sorted((a, b))) for a in range(parts) for b in pairs.halves(parts, a))
    assert met == [(a, b) for a in range(parts) for b in range(a, parts)]


@pytest.mark.parametrize("block", [7, 64, 1024])
def test_sums_by_halves_and_whole(spark, block, monkeypatch):
    monkeypatch.setattr(pairs, "_tasks", lambda r: 5)
    x = crowding.uniform(120, 6, 1)
    ids = [i // 2 if i < 20 else i for i in range(120)]  # some stand twice: they don't meet themselves
    t = rows(spark, x, ids)
    phi = lambda c: numeric.normal_cdf(-np.sqrt(np.maximum(2 - 2 * c, 0)) / 0.6)
    other = np.not_equal.outer(ids, ids)
    want, count = {}, {}
    for i, v, n in zip(ids, (phi(x @ x.T) * other).sum(axis=1), other.sum(axis=1), strict=True):
        want[i], count[i] = want.get(i, 0) + v, count.get(i, 0) + n
    for got in (crowding.item_collisions(t, 0.3), pairs.sums(t, t.select("*"), phi, block=block).withColumnRenamed("total", "collisions")):
        assert {r.id: r.collisions for r in got.collect()} == pytest.approx(want, rel=1e-12)
    assert {r.id: r.n for r in pairs.sums(t, t, lambda c: c, block=block).collect()} == count


@pytest.mark.parametrize("euclidean", [False, True])
def test_ties_and_repeated_ids(spark, euclidean, monkeypatch):
    """Equal vectors are one as near as the other, wherever they stand; the least ids are taken."""
    monkeypatch.setattr(pairs, "KEPT", 64 * 4)
    x = crowding.uniform(37, 24, 2)
    x = np.vstack([x] * 6)
    t = rows(spark, x)
    got = {}
    for r in pairs.top_k(t, t, 4, euclidean=euclidean, block=5).collect():
        got[(r.src, r["rank"])] = r.dst
    assert got == {(i, k + 1): [j for j in range(i % 37, 222, 37) if j != i][k] for i in range(222) for k in range(4)}
    twice = rows(spark, np.vstack([x[:10], x[:10]]), list(range(10)) * 2)
    assert pairs.top_k(twice, twice, 3).groupBy("src").count().where("count <> 3").count() == 0


def test_more_neighbours_than_rows(spark):
    t = rows(spark, crowding.uniform(5, 4, 3))
    assert pairs.top_k(t, t, 9).count() == 20 and pairs.top_k(t.limit(1), t.limit(1), 9).count() == 0
    assert pairs.top_k(t, t.limit(0), 2).count() == 0 and pairs.sums(t, t.limit(0), lambda c: c).count() == 0


@pytest.mark.parametrize("mutual", [False, True])
def test_densities_of_several_scales(spark, mutual):
    t = rows(spark, crowding.uniform(90, 5, 4))
    e = neighbours.graph(t, 12).cache()
    got = {r.id: (r.k3, r.k12) for r in neighbours.densities(e, [3, 12], mutual).collect()}
    for at, k in enumerate((3, 12)):
        of = neighbours.mutual_density if mutual else neighbours.mean_similarity
        want = {r.id: r.density for r in of(e, k).collect()}
        least = min(want.values())
        assert {i: least if v[at] is None else v[at] for i, v in got.items()} == pytest.approx(want, rel=1e-12)


def test_overlaps_of_several_numbers(spark):
    x = crowding.uniform(80, 5, 5)
    a, b = (neighbours.graph(rows(spark, y), 8) for y in (x, x + 0.2 * crowding.uniform(80, 5, 6)))
    of = lambda g: {(r.src, r.dst): r["rank"] for r in g.collect()}
    p, q = of(a), of(b)
    for r in neighbours.overlaps(a, b, [1, 4, 8]).collect():
        for k in (1, 4, 8):
            assert r[f"k{k}"] == sum(n <= k and q.get((i, j), 99) <= k for (i, j), n in p.items() if i == r.id) / k


def test_silhouette_by_group_sums(spark):
    x = crowding.uniform(60, 4, 7)
    labels = [["a", "b", "c"][i % 3] for i in range(59)] + ["alone"]
    t = rows(spark, x, None, labels)
    d = 1 - x @ x.T
    for r in separability.silhouette(t).collect():
        mean = {g: np.mean([d[r.id, j] for j in range(60) if labels[j] == g and j != r.id]) for g in set(labels) if any(labels[j] == g and j != r.id for j in range(60))}
        a, b = mean.get(labels[r.id]), min(v for g, v in mean.items() if g != labels[r.id])
        assert r.silhouette == pytest.approx(0 if a is None else (b - a) / max(a, b), abs=1e-12)
    twice = separability.silhouette(t.union(t.where("id = 0")))
    assert twice.where("id = 0").count() == 1


@pytest.mark.parametrize("n", [3, 50, 131])
def test_kernel_scores_of_all_items(spark, n, monkeypatch):
    """As the kernels' matrices have it; no item is left out, and no matrix of pairs is made."""
    monkeypatch.setattr(pairs, "_tasks", lambda r: 4)
    monkeypatch.setattr(pairs, "TILE", 16)
    monkeypatch.setattr(pairs, "BLOCK", 32)
    monkeypatch.setattr(compare, "matrices", None)
    x = crowding.uniform(n, 6, 8)
    y = x + 0.4 * crowding.uniform(n, 6, 9)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    both = compare.align(rows(spark, x), rows(spark, y))
    assert compare.kernel_scores(both) == pytest.approx((compare.rbf_cka(x, y), compare.mmd(x, y)), abs=1e-9)


def test_kernel_scores_beyond_a_sample(spark):
    """8,300 items, more than the 8,192 that were taken before."""
    x = crowding.uniform(8300, 3, 10)
    both = spark.createDataFrame([(str(i), [float(v) for v in r], [float(v) for v in r[::-1]]) for i, r in enumerate(x)], "id string, va array<double>, vb array<double>")
    k = lambda z: np.exp(-np.maximum(2 - 2 * z @ z.T, 0) / (2 * np.median(np.maximum(2 - 2 * z @ z.T, 0)[np.triu_indices(len(z), 1)])))
    a = k(x)
    a -= a.mean(0)
    a -= a.mean(1)[:, None]
    b = k(x[:, ::-1])
    b -= b.mean(0)
    b -= b.mean(1)[:, None]
    assert compare.kernel_scores(both)[0] == pytest.approx((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()), abs=1e-9)


def closest_first(x, cosine):
    """Average linkage by taking the two closest groups again and again."""
    groups = [[i] for i in range(len(x))]
    c = x @ x.T
    while len(groups) > 1:
        value, a, b = max((c[np.ix_(p, q)].mean(), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups[:i]))
        if value < cosine:
            break
        groups[b] = groups[b] + groups.pop(a)
    return sorted(sorted(g) for g in groups)


@pytest.mark.parametrize("cosine", [-2.0, 0.1, 0.5, 0.9, 2.0])
def test_groups_by_angle(cosine):
    x = crowding.uniform(45, 4, 11)
    assert crowding.angular_groups(x, cosine) == closest_first(x, cosine)


def test_pockets_of_more_than_2000_crowded_rows(spark):
    """More were an error before."""
    x = crowding.uniform(2300, 16, 12)
    x[100:] = crowding.uniform(1, 16, 13) + 0.3 * x[100:]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = rows(spark, x)
    long = t.select("id", F.lit(5).alias("k"), F.lit(0.9).alias("density"), F.lit(4.0).alias("z"), (F.col("id") >= 100).alias("crowded"), *(F.lit(1.0).alias(c) for c in ("median", "mad", "null_median", "null_mad", "cut")))
    got = crowding.angular_pockets(t, long).collect()
    assert sum(p["size"] for p in got) > 2000 and all(m >= 100 for p in got for m in p["members"])


@pytest.mark.parametrize("modes", [1, 2, 5])
def test_eigengap_of_all_nodes(spark, modes):
    """1,500 nodes in groups with few links between: beyond what all eigenvalues are computed for, and what a sample held."""
    random = np.random.default_rng(14)
    n = 1500
    a, b = random.integers(0, n, (2, 15 * n))
    keep = (a != b) & ((a % modes == b % modes) | (random.random(len(a)) < 0.02))
    a, b = np.concatenate([a[keep], np.arange(n)]), np.concatenate([b[keep], (np.arange(n) + modes) % n])
    want = separability.laplacian_values(a, b, n, 13, dense=n)
    got = separability.laplacian_values(a, b, n, 13)
    assert np.diff(got).argmax() == np.diff(want).argmax() == modes - 1 and np.abs(got - want).max() < 1e-2
    e = spark.createDataFrame([(int(p) * 7, int(q) * 7) for p, q in zip(a, b, strict=True)], "src bigint, dst bigint")
    assert separability.eigengap(e).first()["n_modes"] == modes
