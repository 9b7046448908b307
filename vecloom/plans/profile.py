"""Profile of an embedding: moments, spectrum, pair cosines, neighbours, crowding, groups."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import crowding, neighbours, occupancy, sampling, schema, separability
from ..operators.moments import moments
from ..operators.order import numbered
from . import context
from .context import SIGMA
from .registered import DRAWN, DRAWS, NEAR, PAIRS, UNIT, mixed, phi, query, r6, raw, table, unit

FIRST = 1000  # ids of the rows whose all-pairs statistics are listed; the sample's size bounds them


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of pairs drawn from all rows."""
    return context.drawn(spark, sf_dir)


# moments and spectrum


@query("vec_norm_stats", f"""WITH {UNIT} SELECT count(*) AS n, CAST(max(len(v)) AS INTEGER) AS dim, round(avg(l), 6) AS norm_mean, round(stddev_pop(l), 6) AS norm_sd, round(min(l), 6) AS norm_min, round(max(l), 6) AS norm_max
    FROM (SELECT v, sqrt(list_dot_product(v, v)) AS l FROM e)""")  # fmt: skip
def vec_norm_stats(spark, sf_dir):
    from ..functions import vec

    x = raw(spark, sf_dir).select(F.size("vec").alias("d"), vec.norm(F.col("vec")).alias("l"))
    return x.agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("dim"), r6(F.avg("l")).alias("norm_mean"), r6(F.stddev_pop("l")).alias("norm_sd"), r6(F.min("l")).alias("norm_min"), r6(F.max("l")).alias("norm_max"))


@query("vec_validate", """WITH e AS (SELECT vec_id AS id, embedding AS v FROM embeddings), d AS (SELECT max(len(v)) AS dim FROM e)
    SELECT count(*) AS n, CAST(any_value(dim) AS INTEGER) AS dim, count(*) FILTER (v IS NULL) AS n_null, count(*) FILTER (len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) > 0) AS n_not_finite,
    count(*) FILTER (len(list_filter(v, lambda x: x <> 0)) = 0) AS n_zero, CAST((SELECT count(*) FROM (SELECT id FROM e GROUP BY id HAVING count(*) > 1)) AS BIGINT) AS n_repeated_ids, count(*) FILTER (len(v) <> dim) AS n_uneven FROM e, d""")  # fmt: skip
def vec_validate(spark, sf_dir):
    return schema.validate(raw(spark, sf_dir)).select("n", "dim", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_null", "n_not_finite", "n_zero", "n_repeated_ids", "n_uneven")))


_LONG = f"WITH {UNIT}, l AS (SELECT id, CAST(unnest(range(len(v))) AS BIGINT) AS pos, unnest(v) AS x FROM e)"


@query("mean_vector", f"{_LONG} SELECT pos, round(avg(x), 6) AS mean FROM l GROUP BY pos")
def mean_vector(spark, sf_dir):
    m = context.fit(spark, sf_dir)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(m.mean)], "pos bigint, mean double").select("pos", r6("mean").alias("mean"))


@query("cov_matrix", f"{_LONG} SELECT a.pos AS i, b.pos AS j, CASE WHEN round(covar_samp(a.x, b.x), 6) = 0 THEN 0 ELSE round(covar_samp(a.x, b.x), 6) END AS cov FROM l a JOIN l b USING (id) GROUP BY 1, 2")
def cov_matrix(spark, sf_dir):
    c = context.fit(spark, sf_dir).cov
    return spark.createDataFrame([(i, j, float(x)) for (i, j), x in np.ndenumerate(c)], "i bigint, j bigint, cov double").select("i", "j", r6("cov").alias("cov"))


@query("total_variance", f"{_LONG} SELECT round(sum(v), 6) AS total_variance FROM (SELECT var_samp(x) AS v FROM l GROUP BY pos)")
def total_variance(spark, sf_dir):
    m = context.fit(spark, sf_dir)
    return spark.createDataFrame([(float(np.trace(m.cov)),)], "total_variance double").select(r6("total_variance").alias("total_variance"))


@query("eig_spectrum")
def eig_spectrum(spark, sf_dir):
    e = numeric.eigenvalues(context.fit(spark, sf_dir).cov)
    total = e.sum()
    return spark.createDataFrame([(i + 1, float(x), float(c)) for i, (x, c) in enumerate(zip(e, np.cumsum(e) / total, strict=True))], "rank int, eigenvalue double, cumulative double")


_COV = f"{_LONG}, c AS (SELECT a.pos AS i, b.pos AS j, covar_samp(a.x, b.x) AS c FROM l a JOIN l b USING (id) GROUP BY 1, 2), k AS (SELECT max(i) + 1 AS d, sum(c) FILTER (i = j) AS t, sum(c * c) AS q FROM c), n AS (SELECT count(*) AS n FROM e)"


@query("eig_power_sums", f"""{_COV}, c2 AS (SELECT a.i, b.j, sum(a.c * b.c) AS c FROM c a JOIN c b ON a.j = b.i GROUP BY 1, 2)
    SELECT round(t, 6) AS p1, round(q, 6) AS p2, round((SELECT sum(x.c * y.c) FROM c2 x JOIN c y USING (i, j)), 6) AS p3, round((SELECT sum(c * c) FROM c2), 6) AS p4 FROM k""")  # fmt: skip
def eig_power_sums(spark, sf_dir):
    """Sums of the eigenvalues' first four powers: traces of the covariance's powers."""
    e = numeric.eigenvalues(context.fit(spark, sf_dir).cov)
    return spark.createDataFrame([tuple(float((e**p).sum()) for p in (1, 2, 3, 4))], "p1 double, p2 double, p3 double, p4 double").select(*(r6(f"p{p}").alias(f"p{p}") for p in (1, 2, 3, 4)))


_ISO = """{0}, z AS (SELECT d, t, q, n, 1.0::DOUBLE AS keep FROM k, n UNION ALL SELECT d, t, power(1 - zeta, 2) * q + (1 - power(1 - zeta, 2)) * t * t / d, n, 0 FROM (SELECT *, greatest(0, least(0.95::DOUBLE, 1 - least(n - 1, d) / CAST(d AS DOUBLE))) AS zeta FROM k, n)),
    f AS (SELECT *, sqrt(greatest(0, 2 * d - 2 * sqrt(d) * t / sqrt(q))) / sqrt(2 * (d - sqrt(d))) AS defect FROM z), s AS (SELECT *, power(d - defect * defect * (d - sqrt(d)), 2) / d AS dims FROM f), o AS (SELECT *, greatest(0, least(1, (dims - 1) / (d - 1))) AS score FROM s)"""


@query("isotropy", f"{_ISO.format(_COV)} SELECT round(max(t * t / q) FILTER (keep = 1), 6) AS participation_ratio, round(max(1 / sqrt(d)), 6) AS isotropy_ref, round(max(score) FILTER (keep = 1), 6) AS isoscore, round(max(defect) FILTER (keep = 1), 6) AS defect, round(max(dims) FILTER (keep = 1), 6) AS isotropic_dims, round(max(score) FILTER (keep = 0), 6) AS isoscore_shrunk FROM o")
def isotropy(spark, sf_dir):
    """The spectrum's measures that need its trace and its length only."""
    m = context.fit(spark, sf_dir)
    e = numeric.eigenvalues(m.cov)
    p = numeric.isoscore_parts(e)
    row = (numeric.participation_ratio(e), 1 / math.sqrt(m.dim), p["score"], p["defect"], p["isotropic_dims"], numeric.shrunk_isoscore(e, m.n))
    names = ["participation_ratio", "isotropy_ref", "isoscore", "defect", "isotropic_dims", "isoscore_shrunk"]
    return spark.createDataFrame([tuple(map(float, row))], ", ".join(f"{c} double" for c in names)).select(*(r6(c).alias(c) for c in names))


@query("rank_metrics")
def rank_metrics(spark, sf_dir):
    m = context.fit(spark, sf_dir)
    e = numeric.eigenvalues(m.cov)
    p = numeric.isoscore_parts(e)
    row = (m.n, m.dim, numeric.effective_rank(e), numeric.participation_ratio(e), numeric.dims_for(e, 0.5), numeric.dims_for(e, 0.9), p["score"], p["defect"], p["isotropic_dims"], numeric.shrunk_isoscore(e, m.n), 1 / math.sqrt(m.dim))
    return spark.createDataFrame([row], "n bigint, dim int, effective_rank double, participation_ratio double, dims50 int, dims90 int, isoscore double, defect double, isotropic_dims double, isoscore_shrunk double, isotropy_ref double")


@query("diagnose")
def diagnose(spark, sf_dir):
    """The scalar profile: one row, with a verdict."""
    return diagnosis(spark, context.fit(spark, sf_dir), occupancy.summary(drawn(spark, sf_dir)).first())


def diagnosis(spark: SparkSession, m, s) -> DataFrame:
    """Of the moments m and the pair summary s."""
    e = numeric.eigenvalues(m.cov)
    cut = 4 / math.sqrt(m.dim)
    row = (m.n, m.n, m.dim, m.norm_mean, m.norm_sd, s["mean_cos"], 1 / math.sqrt(m.dim), numeric.effective_rank(e), numeric.participation_ratio(e), numeric.dims_for(e, 0.9), numeric.isoscore(e), s["uniformity"], "anisotropic" if s["mean_cos"] > cut else "isotropic")
    names = "n bigint, scanned bigint, dim int, norm_mean double, norm_sd double, mean_cos double, isotropy_ref double, effective_rank double, participation_ratio double, dims90 int, isoscore double, uniformity double, verdict string"
    return spark.createDataFrame([tuple(x.item() if isinstance(x, np.generic) else x for x in row)], names)


# sampled pairs


@query("pair_cos_stats", f"""WITH {DRAWN} SELECT count(*) AS n_pairs, round(avg(c), 6) AS mean_cos, round(stddev_pop(c), 6) AS sd_cos, round(quantile_cont(c, 0.99), 6) AS q99,
    round(ln(avg(exp(-2 * (2 - 2 * c)))), 6) AS uniformity, round(avg(sqrt(greatest(2 - 2 * c, 0))), 6) AS mean_chord FROM s""")  # fmt: skip
def pair_cos_stats(spark, sf_dir):
    s = occupancy.summary(drawn(spark, sf_dir))
    return s.select("n_pairs", *(r6(c).alias(c) for c in s.columns[1:]))


@query("k_curve", f"WITH {DRAWN}, g AS (SELECT k, -0.5::DOUBLE + k * 0.0375::DOUBLE AS tt FROM range(41) x(k)) SELECT k, round(tt, 6) AS t, round(CAST(count(*) FILTER (c >= tt) AS DOUBLE) / count(*), 6) AS share FROM g, s GROUP BY k, tt")
def k_curve(spark, sf_dir):
    out = occupancy.exceedance(drawn(spark, sf_dir), occupancy.grid(spark, -0.5, 1.0, 41))
    return out.select("k", r6("t").alias("t"), r6("share").alias("share"))


_QS = [round(0.05 * i, 2) for i in range(1, 20)]


@query("cos_quantiles", f"WITH {DRAWN} " + " UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, round(quantile_cont(c, {q}), 6) AS cos FROM s" for q in _QS))
def cos_quantiles(spark, sf_dir):
    got = drawn(spark, sf_dir).agg(F.percentile("cos", F.array(*map(F.lit, _QS))).alias("v"))
    return got.select(F.explode(F.arrays_zip(F.array(*map(F.lit, _QS)).alias("q"), F.col("v").alias("cos"))).alias("x")).select("x.q", r6("x.cos").alias("cos"))


_QQ = [(i, (i + 0.5) / 65, 0.0 if i == 32 else numeric.normal_quantile((i + 0.5) / 65)) for i in range(65)]


@query("qq_iso", f"WITH {DRAWN}, z(i, p, z) AS (VALUES {', '.join(f'({i}, {p!r}::DOUBLE, {z!r}::DOUBLE)' for i, p, z in _QQ)}), v AS (SELECT quantile_cont(c, [{', '.join(repr(p) for _, p, _ in _QQ)}]) AS v FROM s), d AS (SELECT max(len(v)) AS d FROM e) SELECT round(p, 6) AS q, round(v[i + 1], 6) AS cos, round(z / sqrt(d), 6) AS reference FROM z, v, d")
def qq_iso(spark, sf_dir):
    """Quantiles of the pair cosines against those of N(0, 1/dim)."""
    d = context.shape(spark, sf_dir)[1]
    v = drawn(spark, sf_dir).agg(F.percentile("cos", F.array(*(F.lit(p) for _, p, _ in _QQ))).alias("v")).first()["v"]
    return spark.createDataFrame([(p, float(b), z / math.sqrt(d)) for (_, p, z), b in zip(_QQ, v, strict=True)], "q double, cos double, reference double").select(*(r6(c).alias(c) for c in ("q", "cos", "reference")))


@query("cos_hist", f"WITH {DRAWN} SELECT CAST(least(greatest(floor((c + 1) / 0.025), 0), 79) AS INTEGER) AS bin, count(*) AS n FROM s GROUP BY 1")
def cos_hist(spark, sf_dir):
    return drawn(spark, sf_dir).groupBy(F.least(F.greatest(F.floor((F.col("cos") + 1) / 0.025), F.lit(0)), F.lit(79)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


_SIGMAS = [0.05, 0.1, 0.15, 0.2, 0.3, 0.5]


@query("expected_collisions_grid", f"WITH {DRAWN}, g AS (SELECT unnest({_SIGMAS}::DOUBLE[]) AS sigma) SELECT sigma, round((any_value(m) - 1) * avg({phi('c', 'sigma')}), 6) AS expected FROM s, g GROUP BY sigma")
def expected_collisions_grid(spark, sf_dir):
    n = context.shape(spark, sf_dir)[0]
    return occupancy.collisions(drawn(spark, sf_dir), n, _SIGMAS).select("sigma", r6("expected").alias("expected"))


@query("within_between", f"WITH {DRAWN} SELECT la = lb AS same, count(*) AS n, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS sd FROM s GROUP BY 1")
def within_between(spark, sf_dir):
    return separability.within_between(drawn(spark, sf_dir)).select("same", "n", r6("mean").alias("mean"), r6("sd").alias("sd"))


# nulls


_BISECT = f"""WITH RECURSIVE {DRAWN}, p AS MATERIALIZED (SELECT c, m FROM s), b(k, lo, hi) AS (SELECT 0, 0.001::DOUBLE, 3.0::DOUBLE UNION ALL
    SELECT k + 1, CASE WHEN f < 1 THEN mid ELSE lo END, CASE WHEN f < 1 THEN hi ELSE mid END FROM (SELECT k, any_value(lo) AS lo, any_value(hi) AS hi, sqrt(any_value(lo) * any_value(hi)) AS mid, (any_value(m) - 1) * avg({phi('c', 'sqrt(lo * hi)')}) AS f FROM b, p WHERE k < 60 GROUP BY k))
    SELECT (SELECT count(*) FROM e) AS n, round(sqrt(lo * hi), 6) AS sigma_star FROM b WHERE k = 60"""


@query("sigma_star", _BISECT)
def sigma_star(spark, sf_dir):
    """The noise width at which an item expects one collision."""
    n, _ = context.shape(spark, sf_dir)
    return spark.createDataFrame([(n, numeric.resolution(occupancy.cosines(drawn(spark, sf_dir)), n))], "n bigint, sigma_star double").withColumn("sigma_star", r6("sigma_star"))


@query("sigma_star_uniform")
def sigma_star_uniform(spark, sf_dir):
    """The same of uniform directions."""
    n, d = context.shape(spark, sf_dir)
    null = numeric.sphere_cosines(d, DRAWS, np.random.default_rng(0))
    return spark.createDataFrame([(n, numeric.resolution(null, n))], "n bigint, sigma_star_uniform double")


@query("uniformity_ref", f"WITH RECURSIVE {UNIT}, d AS (SELECT max(len(v)) AS d FROM e), k(k, term, total) AS (SELECT 0, 1.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT k + 1, term * 4.0::DOUBLE / ((k + 1) * (d / 2.0::DOUBLE + k)), total + term * 4.0::DOUBLE / ((k + 1) * (d / 2.0::DOUBLE + k)) FROM k, d WHERE k < 60) SELECT CAST(d AS INTEGER) AS dim, round((SELECT -4 + ln(max(total)) FROM k), 6) AS uniformity FROM d")
def uniformity_ref(spark, sf_dir):
    """Uniformity of uniform directions: the Laplace transform of their cosines' law, exactly."""
    d = context.shape(spark, sf_dir)[1]
    return spark.createDataFrame([(d, numeric.sphere_uniformity(d))], "dim int, uniformity double").withColumn("uniformity", r6("uniformity"))


@query("null_envelope")
def null_envelope(spark, sf_dir):
    at = np.linspace(-0.5, 1, 41)
    return occupancy.envelope(occupancy.null_curves(spark, context.fit(spark, sf_dir, True), DRAWS, at, 19))


@query("rank_envelope")
def rank_envelope(spark, sf_dir):
    at = np.linspace(-0.5, 1, 41)
    got = occupancy.rank_test(occupancy.cosines(drawn(spark, sf_dir)), occupancy.null_curves(spark, context.fit(spark, sf_dir, True), DRAWS, at, 99), at)
    return spark.createDataFrame([(float(got["p"]), got["reps"], got["lift_off"], got["pointwise_lift_off"])], "p double, reps int, lift_off double, pointwise_lift_off double")


@query("stolarsky_z")
def stolarsky_z(spark, sf_dir):
    cos = occupancy.cosines(drawn(spark, sf_dir))
    return occupancy.occupancy_z(numeric.mean_chord(cos), occupancy.null_curves(spark, context.fit(spark, sf_dir, True), DRAWS, np.array([0.5]), occupancy.REPS, "uniform"))


# all pairs of the bounded sample


@query("item_collisions", f"WITH {PAIRS} SELECT i AS id, round(sum({phi('c', '0.3::DOUBLE')}), 5) AS collisions FROM p GROUP BY i")
def item_collisions(spark, sf_dir):
    return context.collisions(spark, sf_dir).select("id", r6("collisions", 5).alias("collisions"))


def _near(spark, sf_dir, k):
    own = context.given.get(sf_dir)
    return context.graph(spark, sf_dir, own.k if own and k == 10 else k)  # 10 is the settings' default


@query("knn10", f"WITH {NEAR} SELECT i AS src, j AS dst, CAST(r AS INTEGER) AS rank, round(c, 6) AS cos FROM k WHERE r <= 10")
def knn10(spark, sf_dir):
    return _near(spark, sf_dir, 10).select("src", "dst", "rank", r6("cos").alias("cos"))


@query("knn5_euclidean", f"WITH {UNIT}, k AS (SELECT a.id AS src, b.id AS dst, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS r FROM e a JOIN e b ON a.id <> b.id) SELECT src, dst, CAST(r AS INTEGER) AS rank, round(d, 6) AS dist FROM k WHERE r <= 5")
def knn5_euclidean(spark, sf_dir):
    from ..operators.pairs import top_k

    x = raw(spark, sf_dir)
    return top_k(x, x, 5, euclidean=True).select("src", "dst", "rank", r6(-F.col("cos")).alias("dist"))


@query("knn_mutual", f"WITH {NEAR}, m AS (SELECT * FROM k WHERE r <= 10) SELECT a.i AS src, a.j AS dst, CAST(row_number() OVER (PARTITION BY a.i ORDER BY a.c DESC, a.j) AS INTEGER) AS rank FROM m a JOIN m b ON a.i = b.j AND a.j = b.i")
def knn_mutual(spark, sf_dir):
    return neighbours.mutual(_near(spark, sf_dir, 10)).select("src", "dst", "rank")


@query("knn_undirected", f"WITH {NEAR} SELECT least(i, j) AS a, greatest(i, j) AS b, round(min(greatest(1 - c, 1e-6)), 6) AS dist FROM k WHERE r <= 10 GROUP BY 1, 2")
def knn_undirected(spark, sf_dir):
    return neighbours.undirected(_near(spark, sf_dir, 10)).select("a", "b", r6("dist").alias("dist"))


_HUBS = NEAR + ", h AS (SELECT u.id, count(k.i) AS hits FROM u LEFT JOIN k ON k.j = u.id AND k.r <= 10 GROUP BY u.id)"


@query("hub_counts", f"WITH {_HUBS} SELECT id, hits FROM h")
def hub_counts(spark, sf_dir):
    return neighbours.occurrences(_near(spark, sf_dir, 10), context.units(spark, sf_dir))


@query("hub_skew", f"WITH {_HUBS}, m AS (SELECT avg(hits) AS mu, stddev_pop(hits) AS sd FROM h) SELECT round(avg(power((hits - mu) / sd, 3)), 6) AS hub_skew FROM h, m")
def hub_skew(spark, sf_dir):
    return neighbours.hub_skew(hub_counts(spark, sf_dir)).select(r6("hub_skew").alias("hub_skew"))


@query("nn_margin", f"WITH {NEAR} SELECT i AS id, round(max(c) FILTER (r = 1) - max(c) FILTER (r = 2), 6) AS margin FROM k GROUP BY i")
def nn_margin(spark, sf_dir):
    return neighbours.margins(_near(spark, sf_dir, 2)).select("id", r6("margin").alias("margin"))


@query("nn_sparsity", f"WITH {NEAR}, d AS (SELECT i AS id, 1 - c AS dist FROM k WHERE r = 1) SELECT id, round(dist, 6) AS dist, dist >= (SELECT quantile_cont(dist, 0.9) FROM d) AS isolated FROM d")
def nn_sparsity(spark, sf_dir):
    return neighbours.sparsity(_near(spark, sf_dir, 1)).select("id", r6("dist").alias("dist"), "isolated")


@query("label_purity", f"WITH {NEAR} SELECT i AS id, any_value(li) AS label, round(avg(CASE WHEN li = lj THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS purity FROM k WHERE r <= 10 GROUP BY i")
def label_purity(spark, sf_dir):
    return neighbours.purity(_near(spark, sf_dir, 10), context.units(spark, sf_dir)).select("id", "label", r6("purity").alias("purity"))


@query("dtm_field", f"WITH {NEAR} SELECT i AS id, round(sqrt(avg(greatest(2 - 2 * c, 0))), 6) AS dtm FROM k WHERE r <= 25 GROUP BY i")
def dtm_field(spark, sf_dir):
    return neighbours.distance_to_measure(_near(spark, sf_dir, 25)).select("id", r6("dtm").alias("dtm"))


@query("dtm_ecdf", f"WITH {NEAR}, d AS (SELECT i AS id, round(sqrt(avg(greatest(2 - 2 * c, 0))), 6) AS dtm FROM k WHERE r <= 25 GROUP BY i) SELECT id, dtm, round(CAST(row_number() OVER (ORDER BY dtm, id) AS DOUBLE) / count(*) OVER (), 6) AS ecdf FROM d")
def dtm_ecdf(spark, sf_dir):
    d = dtm_field(spark, sf_dir)
    n = F.lit(context.shape(spark, sf_dir)[0])
    return numbered(d, ["dtm", "id"], "r").select("id", "dtm", r6((F.col("r") + 1) / n).alias("ecdf"))


@query("crowding_rank", f"WITH {PAIRS}, s AS (SELECT i AS id, round(sum({phi('c', '0.3::DOUBLE')}), 5) AS x FROM p GROUP BY i) SELECT id, round(CAST(row_number() OVER (ORDER BY x, id) - 1 AS DOUBLE) / (count(*) OVER () - 1), 6) AS crowding FROM s")
def crowding_rank(spark, sf_dir):
    s = item_collisions(spark, sf_dir)
    n = F.lit(context.shape(spark, sf_dir)[0])
    return numbered(s, ["collisions", "id"], "r").select("id", r6(F.col("r") / (n - 1)).alias("crowding"))


@query("local_density", f"WITH {NEAR} SELECT i AS id, round(avg(c) FILTER (r <= 10), 6) AS k10, round(avg(c) FILTER (r <= 50), 6) AS k50 FROM k GROUP BY i")
def local_density(spark, sf_dir):
    near = _near(spark, sf_dir, 50)
    a = neighbours.mean_similarity(near, 10).select("id", r6("density").alias("k10"))
    return a.join(neighbours.mean_similarity(near, 50).select("id", r6("density").alias("k50")), "id")


def _field(spark, sf_dir, mutual=False):
    return context.once(spark, sf_dir, f"field{mutual}", lambda: crowding.field(context.units(spark, sf_dir), context.graph(spark, sf_dir, 200), context.shape(spark, sf_dir)[1], mutual=mutual))


@query("local_anisotropy")
def local_anisotropy(spark, sf_dir):
    """One row for each scale: the density field's spread, its crowding against uniform rows, and which scale stands out."""
    return crowding.scales_of(_field(spark, sf_dir))


@query("local_anisotropy_mutual")
def local_anisotropy_mutual(spark, sf_dir):
    return crowding.scales_of(_field(spark, sf_dir, True))


@query("crowded_field")
def crowded_field(spark, sf_dir):
    return _field(spark, sf_dir).select("id", "k", "density", "z", "crowded")


@query("crowded_rows")
def crowded_rows(spark, sf_dir):
    """Rows that are crowded at any of the scales."""
    return crowding.crowded_rows(_field(spark, sf_dir))


@query("angular_pockets")
def angular_pockets(spark, sf_dir):
    return crowding.angular_pockets(context.units(spark, sf_dir), _field(spark, sf_dir))


_MUTUAL = NEAR + ", m AS (SELECT * FROM k WHERE r <= 10), d AS (SELECT a.i AS id, avg(a.c) FILTER (b.i IS NOT NULL) AS d FROM m a LEFT JOIN m b ON a.i = b.j AND a.j = b.i GROUP BY a.i)"


@query("crowding_map")
def crowding_map(spark, sf_dir):
    """The crowding rank of every row, and whether it lies in a pocket (told on 4096 rows at most)."""
    members = pockets(spark, sf_dir).select(F.explode("members").alias("id")).distinct().withColumn("in_pocket", F.lit(True))
    return crowding_rank(spark, sf_dir).join(members, "id", "left").select("id", "crowding", F.coalesce("in_pocket", F.lit(False)).alias("in_pocket"))


@query("k_curve_view")
def k_curve_view(spark, sf_dir):
    """The curve on 260 points beside the envelope of 99 uniform nulls and the mean of nulls with the rows' moments."""
    at = np.linspace(-0.5, 1, 260)
    m = context.fit(spark, sf_dir, True)
    own = occupancy.exceedance(drawn(spark, sf_dir), occupancy.grid(spark, -0.5, 1.0, 260))
    flat = occupancy.envelope(occupancy.null_curves(spark, m, DRAWS, at, 99, "uniform")).select("k", "upper")
    fit = occupancy.envelope(occupancy.null_curves(spark, m, DRAWS, at, 19)).select("k", F.col("mean").alias("fitted"))
    return own.join(flat, "k").join(fit, "k")


@query("dtm_scaled", f"WITH {UNIT}, m AS MATERIALIZED (SELECT id, v FROM u ORDER BY {mixed('id')}, id LIMIT 6000), s AS (SELECT a.id, sum({phi('list_dot_product(a.v, b.v)', '0.3::DOUBLE')}) AS x FROM m a JOIN m b ON a.id <> b.id GROUP BY 1) SELECT id, round(x * ((SELECT count(*) FROM u) - 1.0::DOUBLE) / ((SELECT count(*) FROM m) - 1.0::DOUBLE), 5) AS collisions FROM s")
def dtm_scaled(spark, sf_dir):
    """Collisions among a sample of 6000 rows, scaled to the whole table."""
    part = sampling.sample(context.units(spark, sf_dir), 6000)
    n, m = context.shape(spark, sf_dir)[0], part.count()
    c = crowding.item_collisions(part, SIGMA)
    return c.select("id", r6(F.col("collisions") * (n - 1.0) / (m - 1.0), 5).alias("collisions"))


@query("mutual_density", f"WITH {_MUTUAL} SELECT id, round(coalesce(d, (SELECT min(d) FROM d), 0), 6) AS density FROM d")
def mutual_density(spark, sf_dir):
    return neighbours.mutual_density(context.graph(spark, sf_dir, 10), 10).select("id", r6("density").alias("density"))


@query("field_hist", f"WITH {NEAR}, d AS (SELECT i, avg(c) AS d FROM k WHERE r <= 10 GROUP BY i), b AS (SELECT min(d) AS lo, max(d) AS hi FROM d) SELECT CAST(least(floor((d - lo) / (hi - lo) * 72), 71) AS INTEGER) AS bin, count(*) AS n FROM d, b GROUP BY 1")
def field_hist(spark, sf_dir):
    """Rows by local density (10 neighbours), in 72 bins from the least to the greatest."""
    d = neighbours.mean_similarity(context.graph(spark, sf_dir, 10), 10)
    ends = d.agg(F.min("density").alias("lo"), F.max("density").alias("hi"))
    bin = F.least(F.floor((F.col("density") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 72), F.lit(71))
    return d.join(F.broadcast(ends)).groupBy(bin.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("margin_hist", f"WITH {NEAR}, g AS (SELECT i, max(c) FILTER (r = 1) - max(c) FILTER (r = 2) AS m FROM k GROUP BY i) SELECT CAST(floor(m / 0.001::DOUBLE) AS BIGINT) AS bin, count(*) AS n FROM g GROUP BY 1")
def margin_hist(spark, sf_dir):
    m = neighbours.margins(context.graph(spark, sf_dir, 10))
    return m.groupBy(F.floor(F.col("margin") / 0.001).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("margin_reference")
def margin_reference(spark, sf_dir):
    """Median margin between the first two neighbours, of the rows and of as many uniform directions (2000 at most)."""
    n, d = context.shape(spark, sf_dir)
    own = neighbours.margins(context.graph(spark, sf_dir, 10)).agg(F.percentile("margin", 0.5).alias("median"))
    u = crowding.uniform(min(n, 2000), d, 3)
    two = np.sort(u @ u.T - 4 * np.eye(len(u)), axis=1)[:, -2:]
    return own.withColumn("uniform_median", F.lit(float(np.median(two[:, 1] - two[:, 0]))))


@query("dtm_tails", f"WITH {NEAR}, d AS (SELECT i AS id, round(sqrt(avg(greatest(2 - 2 * c, 0))), 6) AS dtm FROM k WHERE r <= 25 GROUP BY i), l AS (SELECT id, dtm, 'crowded' AS tail FROM d ORDER BY dtm, id LIMIT 10), h AS (SELECT id, dtm, 'isolated' AS tail FROM d ORDER BY dtm DESC, id LIMIT 10) FROM l UNION ALL FROM h")
def dtm_tails(spark, sf_dir):
    """The ten most crowded and the ten most isolated rows by name."""
    d = dtm_field(spark, sf_dir)
    return d.orderBy("dtm", "id").limit(10).withColumn("tail", F.lit("crowded")).union(d.orderBy(F.col("dtm").desc(), "id").limit(10).withColumn("tail", F.lit("isolated")))


# groups


@query("centroid_cosine", f"""WITH {UNIT}, l AS (SELECT label, unnest(range(len(v))) AS pos, unnest(v) AS x FROM u), m AS (SELECT label, pos, avg(x) AS x FROM l GROUP BY 1, 2),
    n AS (SELECT label, list(x ORDER BY pos) AS v FROM m GROUP BY 1) SELECT a.label AS g1, b.label AS g2, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) AS cos FROM n a, n b""")  # fmt: skip
def centroid_cosine(spark, sf_dir):
    return separability.centroid_cosines(unit(spark, sf_dir)).select("g1", "g2", r6("cos").alias("cos"))


@query("fisher_ratio", f"""WITH {UNIT}, l AS (SELECT label, unnest(range(len(v))) AS pos, unnest(v) AS x FROM e), g AS (SELECT label, pos, avg(x) AS m, count(*) AS n, var_pop(x) * count(*) AS w FROM l GROUP BY 1, 2), t AS (SELECT pos, avg(x) AS m FROM l GROUP BY 1)
    SELECT round(sum(g.n * power(g.m - t.m, 2)) / sum(g.w), 6) AS fisher FROM g JOIN t USING (pos)""")  # fmt: skip
def fisher_ratio(spark, sf_dir):
    return separability.fisher(raw(spark, sf_dir)).select(r6("fisher").alias("fisher"))


@query("silhouette_cosine", f"""WITH {PAIRS}, d AS (SELECT i, li, lj, avg(1 - c) AS d FROM p GROUP BY 1, 2, 3), s AS (SELECT i AS id, li AS label, max(d) FILTER (li = lj) AS a, min(d) FILTER (li <> lj) AS b FROM d GROUP BY 1, 2)
    SELECT id, label, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b, 1e-12) END, 6) AS silhouette FROM s""")  # fmt: skip
def silhouette_cosine(spark, sf_dir):
    return separability.silhouette(context.units(spark, sf_dir)).select("id", "label", r6("silhouette").alias("silhouette"))


@query("label_analysis", f"""WITH {NEAR}, i AS (SELECT li AS label, avg(c) AS intra FROM p WHERE li = lj GROUP BY 1), q AS (SELECT label, avg(x) AS purity FROM (SELECT i, any_value(li) AS label, avg(CASE WHEN li = lj THEN 1.0::DOUBLE ELSE 0.0 END) AS x FROM k WHERE r <= 10 GROUP BY i) GROUP BY 1)
    , lg AS (SELECT label, unnest(range(len(v))) AS pos, unnest(v) AS x FROM u), mc AS (SELECT label, list(x ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS x FROM lg GROUP BY 1, 2) GROUP BY 1), nc AS (SELECT a.label, b.label AS nearest, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS cos FROM mc a JOIN mc b ON a.label <> b.label QUALIFY row_number() OVER (PARTITION BY a.label ORDER BY cos DESC, b.label) = 1)
    SELECT label, (SELECT count(*) FROM u WHERE u.label = i.label) AS n, round(intra, 6) AS intra, round(purity, 6) AS purity, nearest, round(nc.cos, 6) AS nearest_cos FROM i JOIN q USING (label) LEFT JOIN nc USING (label)""")  # fmt: skip
def label_analysis(spark, sf_dir):
    x = context.units(spark, sf_dir)
    out = separability.by_label(x, neighbours.purity(context.graph(spark, sf_dir, 10), x))
    return out.select("label", "n", r6("intra").alias("intra"), r6("purity").alias("purity"), "nearest", r6("nearest_cos").alias("nearest_cos"))


_SEPARABLE = f"""WITH {NEAR}, d AS (SELECT i, li, lj, avg(1 - c) AS d FROM p GROUP BY 1, 2, 3), x AS (SELECT i, max(d) FILTER (li = lj) AS a, min(d) FILTER (li <> lj) AS b FROM d GROUP BY 1), q AS (SELECT i, avg(CASE WHEN li = lj THEN 1.0::DOUBLE ELSE 0.0 END) AS x FROM k WHERE r <= 10 GROUP BY i),
    l AS (SELECT label, unnest(range(len(v))) AS pos, unnest(v) AS x FROM e), g AS (SELECT label, pos, avg(x) AS m, count(*) AS n, var_pop(x) * count(*) AS w FROM l GROUP BY 1, 2), t AS (SELECT pos, avg(x) AS m FROM l GROUP BY 1)
    SELECT round((SELECT sum(g.n * power(g.m - t.m, 2)) / sum(g.w) FROM g JOIN t USING (pos)), 6) AS fisher, round((SELECT avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b, 1e-12) END) FROM x), 6) AS silhouette, round((SELECT avg(x) FROM q), 6) AS purity, (SELECT count(DISTINCT label) FROM e) AS n_groups"""


@query("separability", _SEPARABLE)
def separable(spark, sf_dir):
    """All group scalars in one row."""
    x = context.units(spark, sf_dir)
    s = separability.silhouette(x).agg(F.avg("silhouette").alias("silhouette"))
    p = neighbours.purity(context.graph(spark, sf_dir, 10), x).agg(F.avg("purity").alias("purity"))
    g = x.agg(F.countDistinct("label").alias("n_groups"))
    out = separability.fisher(raw(spark, sf_dir)).select("fisher").join(s).join(p).join(g).where("n_groups >= 2")
    return out.select(r6("fisher").alias("fisher"), r6("silhouette").alias("silhouette"), r6("purity").alias("purity"), "n_groups")


@query("group_sizes", "WITH g AS (SELECT label, count(*) AS n FROM (SELECT 'category-' || source || '/' || lang AS label FROM documents) GROUP BY 1), m AS (SELECT min(label) AS a, max(label) AS b FROM g), c AS (SELECT coalesce(max(i), 0) AS c FROM m, range(1, 200) x(i) WHERE i <= length(a) AND left(a, i) = left(b, i)) SELECT CASE WHEN c >= 6 THEN substring(label, c + 1) ELSE label END AS label, n FROM g, c ORDER BY n DESC, label LIMIT 14")
def group_sizes(spark, sf_dir):
    """The 14 largest groups, their labels without a common beginning of six characters or more."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("category-"), "source", F.lit("/"), "lang").alias("label"))
    return separability.largest_groups(d, 14)


@query("pockets")
def pockets(spark, sf_dir):
    x = sampling.sample(unit(spark, sf_dir), crowding.TREE)
    n, d = x.count(), context.shape(spark, sf_dir)[1]
    return crowding.pocket_table(spark, x, floor=crowding.null_prominence(min(n, 1000), d, 20))


@query("mst_edges")
def mst_edges(spark, sf_dir):
    return crowding.tree_table(spark, sampling.sample(unit(spark, sf_dir), crowding.TREE))


@query("mst_hot_edges")
def mst_hot_edges(spark, sf_dir):
    return crowding.hot_edges(mst_edges(spark, sf_dir))


@query("kmeans_labels")
def kmeans_labels(spark, sf_dir):
    return separability.kmeans(context.units(spark, sf_dir), 5)


@query("unsupervised_labels")
def unsupervised_labels(spark, sf_dir):
    """Labels by k-means, k of 3 to 12 with the best silhouette."""
    return separability.unsupervised(context.units(spark, sf_dir))


@query("cluster_stability")
def cluster_stability(spark, sf_dir):
    return separability.stability(context.units(spark, sf_dir), 4)


@query("eigengap")
def eigengap(spark, sf_dir):
    """The number of groups that the graph of all rows falls into, by its eigenvalues."""
    return separability.eigengap(context.graph(spark, sf_dir, 10))


# curves and records

_WIDTHS = [round(0.02 * (1.5 / 0.02) ** (i / 59), 6) for i in range(60)]


@query("bandwidth_curve", f"WITH {DRAWN}, g AS (SELECT unnest({_WIDTHS}::DOUBLE[]) AS sigma) SELECT sigma, round((any_value(m) - 1) * avg({phi('c', 'sigma')}), 4) AS expected FROM s, g GROUP BY sigma")
def bandwidth_curve(spark, sf_dir):
    n = context.shape(spark, sf_dir)[0]
    return occupancy.collisions(drawn(spark, sf_dir), n, _WIDTHS).select("sigma", r6("expected", 4).alias("expected"))


_STRUCTURED = f"""{_LONG}, cv AS (SELECT a.pos AS i, b.pos AS j, covar_samp(a.x, b.x) AS c FROM l a JOIN l b USING (id) GROUP BY 1, 2), tr AS (SELECT sum(c) AS t FROM cv WHERE i = j), rows AS (SELECT list(c ORDER BY j) AS r, i FROM cv GROUP BY i), cm AS (SELECT list(r ORDER BY i) AS m FROM rows)"""


@query("structured_noise", f"""{_STRUCTURED}, {DRAWN.replace(UNIT + ',', '')}, pu AS (SELECT list_transform(list_zip(b.v, a.v), lambda z: z[1] - z[2]) AS u FROM t JOIN r a ON a.n = t.i JOIN r b ON b.n = t.j WHERE t.i <> t.j),
    pv AS (SELECT list_dot_product(u, u) AS r2, 0.09::DOUBLE * len(u) / t * list_dot_product(u, list_transform(m, lambda row: list_dot_product(row, u))) AS var FROM pu, cm, tr)
    SELECT round(avg({phi('(1 - power(2 * 0.3::DOUBLE * r2 / 2 / sqrt(var), 2) / 2)', '0.3::DOUBLE')}), 6) AS phi FROM pv""")  # fmt: skip
def structured_noise(spark, sf_dir):
    """Confusion under noise shaped as the rows' covariance, of the total power that width 0.3 in every direction has."""
    m = context.fit(spark, sf_dir)
    pairs = sampling.pair_vectors(context.units(spark, sf_dir), DRAWS)
    return occupancy.structured_collisions(pairs, m.cov * (0.09 * m.dim / np.trace(m.cov))).agg(r6(F.avg("phi")).alias("phi"))


@query("dtm_null_band")
def dtm_null_band(spark, sf_dir):
    """1st and 99th percentile of the distance to measure of uniform rows, 2048 at most."""
    x = context.units(spark, sf_dir)
    n, d = x.count(), context.shape(spark, sf_dir)[1]
    u = crowding.uniform(min(n, 2048), d, 11)
    near = -np.sort(-(u @ u.T - 4 * np.eye(len(u))), axis=1)[:, : max(2, math.ceil(0.05 * len(u)))]
    dtm = np.sqrt(np.maximum(2 - 2 * near, 0).mean(axis=1))
    return spark.createDataFrame([(float(np.quantile(dtm, 0.01)), float(np.quantile(dtm, 0.99)))], "p1 double, p99 double")


@query("refit_test")
def refit_test(spark, sf_dir):
    """Excess of close pairs over a Gaussian fit, against replicates that are drawn from the fit and fitted anew."""
    m = context.fit(spark, sf_dir, True)
    p = occupancy.refit_bootstrap(spark, occupancy.cosines(drawn(spark, sf_dir)), m, 0.3, 39)
    return spark.createDataFrame([p], "excess double, p double, reps int")


@query("readout")
def readout(spark, sf_dir):
    """One row of the scalars that a run is recorded by."""
    d = diagnose(spark, sf_dir).select("n", "dim", "mean_cos", "isoscore", "effective_rank", "uniformity", "verdict").join(rank_envelope(spark, sf_dir).select("lift_off", F.col("p").alias("envelope_p")))
    return d.join(sigma_star(spark, sf_dir).select("sigma_star")).join(stolarsky_z(spark, sf_dir).select("z", "reps")).join(hub_skew(spark, sf_dir)).join(pockets(spark, sf_dir).agg(F.count(F.lit(1)).alias("pockets"), F.max("size").alias("largest_pocket")))
