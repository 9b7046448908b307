"""Studies and records: densities, curves for export, planted corpora, rounds of training, detectors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import compare, crowding, neighbours, occupancy, studies, synthetic
from ..operators.moments import moments
from ..operators.order import numbered
from . import context
from .geometry import _TWO, other
from .profile import rank_envelope, sigma_star, stolarsky_z
from .registered import DRAWN, NEAR, PAIRS, phi, query, r6

# densities

_AT = [round(-0.5 + 0.025 * i, 6) for i in range(61)]
_KERNEL = "exp(-power((x - c) / w, 2) / 2) / (w * sqrt(2 * pi()))"


def _width(sd):
    return F.greatest(F.lit(0.02), 0.9 * sd * F.pow(F.col("n"), F.lit(-0.2)))


@query("wb_density", f"WITH {DRAWN}, b AS (SELECT la = lb AS same, c FROM s), w AS (SELECT greatest(0.02::DOUBLE, 0.9::DOUBLE * min(sd) * power(sum(n), -0.2::DOUBLE)) AS w FROM (SELECT same, stddev_pop(c) AS sd, count(*) AS n FROM b GROUP BY 1)), g AS (SELECT unnest({_AT}::DOUBLE[]) AS x), d AS (SELECT x, avg({_KERNEL}) FILTER (same) AS dw, avg({_KERNEL}) FILTER (NOT same) AS db FROM b, w, g GROUP BY x) SELECT x, round(dw, 6) AS within, round(db, 6) AS between, round(least(dw, db), 6) AS overlap FROM d")
def wb_density(spark, sf_dir):
    """Kernel densities of pair cosines within and between groups, and what both have in common."""
    pairs = context.drawn(spark, sf_dir).where("la IS NOT NULL AND lb IS NOT NULL").select((F.col("la") == F.col("lb")).alias("same"), "cos")
    by = pairs.groupBy("same").agg(F.stddev_pop("cos").alias("sd"), F.count(F.lit(1)).alias("m"))
    w = by.agg(F.min("sd").alias("sd"), F.sum("m").alias("n")).select(_width(F.col("sd")).alias("w"))
    d = occupancy.density(pairs.join(F.broadcast(w)), "cos", _AT, F.col("w"), ["same"]).groupBy("x").agg(F.max(F.when(F.col("same"), F.col("density"))).alias("p"), F.max(F.when(~F.col("same"), F.col("density"))).alias("q"))
    return d.select("x", r6("p").alias("within"), r6("q").alias("between"), r6(F.least("p", "q")).alias("overlap"))


@query("cos_density", f"WITH {DRAWN}, h AS (SELECT CAST(least(greatest(floor((c + 1) / 0.025), 0), 79) AS INTEGER) AS bin, count(*) AS n FROM s GROUP BY 1), a AS (SELECT bin + o AS bin, n * k AS n FROM h, (VALUES (-1, 0.25::DOUBLE), (0, 0.5::DOUBLE), (1, 0.25::DOUBLE)) v(o, k)), total AS (SELECT sum(n) AS total FROM h) SELECT bin, round(sum(n) / any_value(total) / 0.025::DOUBLE, 6) AS density FROM a, total WHERE bin BETWEEN 0 AND 79 GROUP BY bin")
def cos_density(spark, sf_dir):
    """The histogram of pair cosines as a density, smoothed over neighbouring bins."""
    bin = F.least(F.greatest(F.floor((F.col("cos") + 1) / 0.025), F.lit(0)), F.lit(79)).cast("int")
    h = context.drawn(spark, sf_dir).groupBy(bin.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    taps = F.explode(F.array(*(F.struct(F.lit(o).alias("o"), F.lit(k).alias("k")) for o, k in ((-1, 0.25), (0, 0.5), (1, 0.25)))))
    spread = h.select("bin", "n", taps.alias("t")).select((F.col("bin") + F.col("t.o")).alias("bin"), (F.col("n") * F.col("t.k")).alias("n")).where("bin BETWEEN 0 AND 79")
    total = h.agg(F.sum("n").alias("_t"))
    return spread.groupBy("bin").agg(F.sum("n").alias("n")).join(F.broadcast(total)).select("bin", r6(F.col("n") / F.col("_t") / 0.025).alias("density"))


_SIDES = f"""WITH {_TWO}, r AS (SELECT u.id, u.v AS va, b.v AS vb, row_number() OVER (ORDER BY u.id) - 1 AS n FROM u JOIN b USING (id)), t AS (SELECT (t * 7919 + 13) % m AS i, (t * 104729 + t * t * 31 + 7) % m AS j FROM range(20000) x(t), (SELECT count(*) AS m FROM u)),
    s AS (SELECT list_dot_product(a.va, b.va) AS ca, list_dot_product(a.vb, b.vb) AS cb FROM t JOIN r a ON a.n = t.i JOIN r b ON b.n = t.j WHERE t.i <> t.j), l AS (SELECT 'a' AS side, ca AS c FROM s UNION ALL SELECT 'b', cb FROM s),
    wd AS (SELECT side, greatest(0.02::DOUBLE, 0.9::DOUBLE * stddev_pop(c) * power(count(*), -0.2::DOUBLE)) AS w FROM l GROUP BY 1), g AS (SELECT unnest({_AT}::DOUBLE[]) AS x) SELECT side, x, round(avg({_KERNEL}), 6) AS density FROM l JOIN wd USING (side), g GROUP BY 1, 2"""


@query("cmp_density", _SIDES)
def cmp_density(spark, sf_dir):
    """Kernel densities of the pair cosines of two embeddings, over the same pairs."""
    from ..operators import sampling
    from .registered import DRAWS

    out = None
    for side, pairs in (("a", context.drawn(spark, sf_dir)), ("b", sampling.pair_cosines(other(spark, sf_dir), DRAWS))):
        w = pairs.agg(F.stddev_pop("cos").alias("sd"), F.count(F.lit(1)).alias("n")).select(_width(F.col("sd")).alias("w"))
        d = occupancy.density(pairs.join(F.broadcast(w)), "cos", _AT, F.col("w")).select(F.lit(side).alias("side"), "x", r6("density").alias("density"))
        out = d if out is None else out.union(d)
    return out


@query("cmp_uniformity", f"WITH {_TWO}, r AS (SELECT u.id, u.v AS va, b.v AS vb, row_number() OVER (ORDER BY u.id) - 1 AS n FROM u JOIN b USING (id)), t AS (SELECT (t * 7919 + 13) % m AS i, (t * 104729 + t * t * 31 + 7) % m AS j FROM range(20000) x(t), (SELECT count(*) AS m FROM u)), s AS (SELECT list_dot_product(a.va, b.va) AS ca, list_dot_product(a.vb, b.vb) AS cb FROM t JOIN r a ON a.n = t.i JOIN r b ON b.n = t.j WHERE t.i <> t.j), d AS (SELECT max(len(v)) AS d FROM u), k(k, term, total) AS (SELECT 0, 1.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT k + 1, term * 4.0::DOUBLE / ((k + 1) * (d / 2.0::DOUBLE + k)), total + term * 4.0::DOUBLE / ((k + 1) * (d / 2.0::DOUBLE + k)) FROM k, d WHERE k < 40) SELECT round(ln(avg(exp(-2 * (2 - 2 * ca)))), 6) AS a, round(ln(avg(exp(-2 * (2 - 2 * cb)))), 6) AS b, round((SELECT -4 + ln(max(total)) FROM k), 6) AS reference FROM s".replace("WITH ", "WITH RECURSIVE ", 1))
def cmp_uniformity(spark, sf_dir):
    """Uniformity of both embeddings and the exact value of uniform directions."""
    from ..operators import sampling
    from .registered import DRAWS

    u = lambda p: F.ln(F.avg(F.exp(-2 * (2 - 2 * F.col("cos")))))
    a = context.drawn(spark, sf_dir).agg(r6(u(0)).alias("a"))
    b = sampling.pair_cosines(other(spark, sf_dir), DRAWS).agg(r6(u(0)).alias("b"))
    return a.join(b).withColumn("reference", r6(F.lit(numeric.sphere_uniformity(context.shape(spark, sf_dir)[1]))))


# curves for export

_SIGMAS = [round(10 ** (-2.6 + 2.7 * i / 59), 9) for i in range(60)]
_CURVES = f"""WITH {NEAR}, {DRAWN.split(',', 2)[0] and DRAWN[DRAWN.index('r AS (SELECT *, row_number'):]}, ka AS (SELECT k, k / 79.0::DOUBLE AS x FROM range(80) x(k)), kk AS (SELECT 'K' AS curve, k, x, log10(greatest(CAST(count(*) FILTER (c >= x) AS DOUBLE) / count(*), power(10, -5.602::DOUBLE))) AS y FROM ka, s GROUP BY k, x),
    sg AS (SELECT unnest(range(60)) AS k, unnest({_SIGMAS}::DOUBLE[]) AS sigma), cc AS (SELECT 'C' AS curve, k, log10(sigma) AS x, log10(greatest((any_value(m) - 1) * avg({phi('c', 'sigma')}), 1e-7::DOUBLE)) AS y FROM sg, s GROUP BY k, sigma),
    dt AS (SELECT sqrt(avg(greatest(2 - 2 * c, 0))) AS f FROM k WHERE r <= 10 GROUP BY i), dr AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS place, count(*) OVER () AS n FROM dt), dd AS (SELECT 'D' AS curve, g.k, f AS x, (place + 1.0::DOUBLE) / n AS y FROM range(60) g(k) JOIN dr ON dr.place = CAST(floor(g.k * (dr.n - 1) / 59.0::DOUBLE + 1e-9) AS BIGINT))
    SELECT curve, k, round(x, 4) AS x, round(y, 3) AS y FROM (FROM kk UNION ALL FROM cc UNION ALL FROM dd)"""


@query("curve_export", _CURVES)
def curve_export(spark, sf_dir):
    """Three curves: share of pairs above a cosine (log), expected collisions by width (logs), the distribution of the distance to measure."""
    n, _ = context.shape(spark, sf_dir)
    pairs = context.drawn(spark, sf_dir)
    k = occupancy.exceedance(pairs, occupancy.grid(spark, 0.0, 1.0, 80)).select(F.lit("K").alias("curve"), "k", F.col("t").alias("x"), F.log10(F.greatest("share", F.lit(10**-5.602))).alias("y"))
    at = spark.createDataFrame([(i, s) for i, s in enumerate(_SIGMAS)], "k bigint, sigma double")
    c = occupancy.collisions(pairs, n, _SIGMAS).join(F.broadcast(at), "sigma").select(F.lit("C").alias("curve"), "k", F.log10("sigma").alias("x"), F.log10(F.greatest("expected", F.lit(1e-7))).alias("y"))
    dtm = numbered(neighbours.distance_to_measure(context.graph(spark, sf_dir, 10)).select("id", "dtm"), ["dtm", "id"], "at")
    wanted = spark.range(60).select(F.col("id").alias("k"), F.floor(F.col("id") * (n - 1) / 59.0 + 1e-9).alias("at"))
    d = dtm.join(F.broadcast(wanted), "at").select(F.lit("D").alias("curve"), "k", F.col("dtm").alias("x"), ((F.col("at") + 1) / F.lit(float(n))).alias("y"))
    return k.union(c).union(d).select("curve", "k", r6("x", 4).alias("x"), r6("y", 3).alias("y"))


@query("curve_text", f"WITH c AS ({_CURVES}) SELECT curve, string_agg(printf('(%.4f,%.3f)', x, y), ' ' ORDER BY k) AS points FROM c GROUP BY curve")
def curve_text(spark, sf_dir):
    """The curves as coordinate strings."""
    point = F.format_string("(%.4f,%.3f)", "x", "y")
    got = curve_export(spark, sf_dir).groupBy("curve").agg(F.sort_array(F.collect_list(F.struct("k", point.alias("p")))).alias("p"))  # 80 points a curve at most
    return got.select("curve", F.array_join(F.col("p.p"), " ").alias("points"))


# studies on planted corpora


@query("acg_envelope")
def acg_envelope(spark, sf_dir):
    """The curves' envelope under a null with the rows' spectrum and mean zero."""
    at = np.linspace(-0.5, 1, 41)
    return occupancy.envelope(occupancy.null_curves(spark, context.fit(spark, sf_dir, True), 20_000, at, 19, "spectrum"))


@query("planted_power")
def planted_power(spark, sf_dir):
    return studies.detection_power(spark)


@query("absorption")
def absorption(spark, sf_dir):
    return studies.absorption(spark)


@query("blur_grid")
def blur_grid(spark, sf_dir):
    return studies.blur_grid(spark)


@query("z_by_replicates")
def z_by_replicates(spark, sf_dir):
    return studies.z_by_replicates(spark, occupancy.cosines(context.drawn(spark, sf_dir)), context.shape(spark, sf_dir)[1])


@query("planted_profile")
def planted_profile(spark, sf_dir):
    """The spectrum's and pairs' scalars of planted corpora of each kind."""
    kinds = {"uniform": synthetic.uniform(1000, 32), "pocketed": synthetic.pocketed(1000, 32, 100), "cone": synthetic.cone(1000, 32), "ellipse": synthetic.ellipse(1000, 32), "low_rank": synthetic.low_rank(1000, 32, 4), "mixture": synthetic.mixture(1000, 32, 5)}
    rows = []
    for name, x in kinds.items():
        e = numeric.eigenvalues(np.cov(x.T))
        cos = studies.chosen_cosines(x, 20_000, np.random.default_rng(0))
        rows.append((name, float(cos.mean()), numeric.isoscore(e), numeric.effective_rank(e), numeric.uniformity(cos), numeric.resolution(cos, len(x))))
    return spark.createDataFrame(rows, "corpus string, mean_cos double, isoscore double, effective_rank double, uniformity double, sigma_star double")


# records


@query("headline")
def headline(spark, sf_dir):
    """Lift-off, z, sigma*, the first percentile of the distance to measure, and the first pocket."""
    top = crowding.pocket_table(spark, _tree_rows(spark, sf_dir), 8).orderBy(F.col("prominence").desc()).limit(1).agg(F.max("size").alias("pocket_size"), F.max("birth").alias("pocket_birth"), F.max("death").alias("pocket_death"))
    p1 = neighbours.distance_to_measure(context.graph(spark, sf_dir, 10)).agg(F.percentile("dtm", 0.01).alias("dtm_p1"))
    return rank_envelope(spark, sf_dir).select("lift_off").join(stolarsky_z(spark, sf_dir).select("z")).join(sigma_star(spark, sf_dir).select("sigma_star")).join(p1).join(top)


def _tree_rows(spark, sf_dir):
    from ..operators import sampling

    return sampling.sample(context.units(spark, sf_dir), crowding.TREE)


@query("detector_bundle")
def detector_bundle(spark, sf_dir):
    """(statistic, value, alarm): all detectors of the table, trees on at most 4096 rows."""
    ids, x = crowding.bounded(_tree_rows(spark, sf_dir))
    return spark.createDataFrame([(k, float(v), studies.ALARMS[k]) for k, v in studies.detectors(x).items()], "statistic string, value double, alarm string")


_COHORT = f"""WITH {_TWO}, pb AS (SELECT a.id AS i, sum({phi('list_dot_product(a.v, c.v)', '0.3::DOUBLE')}) AS x FROM u a JOIN u c ON a.id <> c.id GROUP BY 1), pn AS (SELECT a.id AS i, sum({phi('list_dot_product(a.v, c.v)', '0.3::DOUBLE')}) AS x FROM b a JOIN b c ON a.id <> c.id GROUP BY 1),
    f AS (SELECT i, x FROM pb ORDER BY round(x, 5) DESC, i LIMIT (SELECT CAST(ceil(count(*) * 0.05::DOUBLE) AS BIGINT) FROM u)), h AS (SELECT i FROM f WHERE i % 5 = 0),
    ka AS (SELECT a.id AS i, c.id AS j, row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.v, c.v) DESC, c.id) AS r FROM u a JOIN u c ON a.id <> c.id AND a.id % 5 = 0 AND c.id % 5 = 0), kb AS (SELECT a.id AS i, c.id AS j, row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.v, c.v) DESC, c.id) AS r FROM b a JOIN b c ON a.id <> c.id AND a.id % 5 = 0 AND c.id % 5 = 0),
    o AS (SELECT ka.i, count(kb.j) / 10.0::DOUBLE AS s FROM ka LEFT JOIN kb ON ka.i = kb.i AND ka.j = kb.j AND kb.r <= 10 WHERE ka.r <= 10 GROUP BY 1)
    SELECT (SELECT count(*) FROM u) AS n, round((SELECT quantile_cont(x, 0.5) FROM pn), 5) AS median_all, (SELECT count(*) FROM h) AS flagged_heldout, round((SELECT quantile_cont(x, 0.5) FROM pb JOIN h USING (i)), 5) AS cohort_base, round((SELECT quantile_cont(x, 0.5) FROM pn JOIN h USING (i)), 5) AS cohort_now, round((SELECT avg(s) FROM o), 6) AS heldout_overlap"""


@query("round_record", _COHORT)
def round_record(spark, sf_dir):
    """A round of training against its base: collisions of the base's most crowded rows, and neighbours kept, both on rows held out (every fifth id)."""
    base, now = context.units(spark, sf_dir), other(spark, sf_dir)
    a = context.collisions(spark, sf_dir).withColumn("key", F.round("collisions", 5))
    b = context.once(spark, sf_dir, "other_collisions", lambda: crowding.item_collisions(now, context.SIGMA))
    n, _ = context.shape(spark, sf_dir)
    flagged = numbered(a, [F.col("key").desc(), "id"], "r").where(F.col("r") < math.ceil(n * 0.05)).where("id % 5 = 0").select("id", F.col("collisions").alias("before"))
    both = flagged.join(b.withColumnRenamed("collisions", "after"), "id")
    held = lambda x: neighbours.graph(x.where("id % 5 = 0"), 10)
    kept = neighbours.overlap(held(base), held(now), 10).agg(r6(F.avg("share")).alias("heldout_overlap"))
    cohort = both.agg(F.count(F.lit(1)).alias("flagged_heldout"), r6(F.percentile("before", 0.5), 5).alias("cohort_base"), r6(F.percentile("after", 0.5), 5).alias("cohort_now"))
    every = b.agg(F.count(F.lit(1)).alias("n"), r6(F.percentile("collisions", 0.5), 5).alias("median_all"))
    return every.join(cohort).join(kept)


@query("regulariser_example", f"WITH {_TWO}, q AS (SELECT a.id AS i, c.id AS j, a.id % 5 = 0 AS held, list_dot_product(a.v, c.v) AS c FROM u a JOIN u c ON a.id <> c.id AND a.id // 200 = c.id // 200 AND (a.id % 5 = 0) = (c.id % 5 = 0)), n AS (SELECT a.id AS i, c.id AS j, a.id % 5 = 0 AS held, list_dot_product(a.v, c.v) AS c FROM b a JOIN b c ON a.id <> c.id AND a.id // 200 = c.id // 200 AND (a.id % 5 = 0) = (c.id % 5 = 0)) SELECT (SELECT count(*) FROM q WHERE NOT held AND c BETWEEN 0.1 AND 0.25) AS mined, round((SELECT avg({phi('c', '0.3::DOUBLE')}) FROM q WHERE held), 6) AS heldout_before, round((SELECT avg({phi('c', '0.3::DOUBLE')}) FROM n WHERE held), 6) AS heldout_after")
def regulariser_example(spark, sf_dir):
    """Measure, mine and verify: confusable pairs among the training rows, and the confusion of rows held out before and after."""
    from ..operators import training

    split = lambda x: training.batched_pairs(x.withColumn("part", F.col("id") % 5 == 0), 200, "part")
    base, now = split(context.units(spark, sf_dir)), split(other(spark, sf_dir))
    mined = base.where("NOT part").where(F.col("cos").between(0.1, 0.25)).agg(F.count(F.lit(1)).alias("mined"))
    loss = lambda p, name: training.confusion_loss(p.where("part"), 0.3).select(r6("loss").alias(name))
    return mined.join(loss(base, "heldout_before")).join(loss(now, "heldout_after"))


assert compare and moments and PAIRS
