"""Views of points: grids, shells, hexagons, drift and the comparison of two embeddings.

Views with SQL beside them take the first dimensions as coordinates, since principal axes can't
be put in SQL; those named pca_* take the axes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import compare, neighbours, project, sampling, schema
from ..operators.order import quantiles
from . import context
from .registered import NEAR, UNIT, mixed, query, r6, raw, table, unit


def first(spark, sf_dir):
    """(id, x, y, z): the first three dimensions."""
    return raw(spark, sf_dir).select("id", *(F.col("vec")[i].alias(c) for i, c in enumerate("xyz")))


def axes(spark, sf_dir):
    return context.once(spark, sf_dir, "axes", lambda: project.pca(context.units(spark, sf_dir), context.fit(spark, sf_dir, True), 3))


_XYZ = f"WITH {UNIT}, xyz AS (SELECT id, v[1] AS x, v[2] AS y, v[3] AS z FROM e), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM xyz), n AS (SELECT id, (x - x0) / (x1 - x0) AS x, (y - y0) / (y1 - y0) AS y, (z - z0) / (z1 - z0) AS z FROM xyz, b)"


def _cell(c: str, size: int) -> str:
    return f"CAST(least(floor({c} * {size}), {size - 1}) AS BIGINT) AS c{c}"


@query("grid_density", f"{_XYZ} SELECT {_cell('x', 48)}, {_cell('y', 32)}, count(*) AS n FROM n GROUP BY 1, 2")
def grid_density(spark, sf_dir):
    return project.cells(first(spark, sf_dir), ["x", "y"], [48, 32])


@query("grid_hot", f"{_XYZ}, g AS (SELECT {_cell('x', 48)}, {_cell('y', 32)}, count(*) AS n FROM n GROUP BY 1, 2) SELECT cx, cy, n, n >= (SELECT quantile_cont(n, 0.97) FROM g) AS hot FROM g")
def grid_hot(spark, sf_dir):
    return project.hot(grid_density(spark, sf_dir), 0.97)


@query("voxels", f"{_XYZ} SELECT {_cell('x', 9)}, {_cell('y', 9)}, {_cell('z', 9)}, count(*) AS n FROM n GROUP BY 1, 2, 3")
def voxels(spark, sf_dir):
    return project.cells(first(spark, sf_dir), ["x", "y", "z"], [9, 9, 9])


_HEX = 0.05
_SHIFTS = [(i, j) for i in range(3) for j in range(3)]


@query("hexagons", f"""{_XYZ}, o AS (SELECT a, b, x + a * {_HEX}::DOUBLE / 3 AS x, y + b * {_HEX}::DOUBLE * sqrt(3) / 3 AS y FROM n, range(3) s(a), range(3) t(b)),
    c AS (SELECT *, round_even(y / ({_HEX}::DOUBLE * sqrt(3)), 0) AS ar, round_even(x / {_HEX}::DOUBLE, 0) AS aq, floor(y / ({_HEX}::DOUBLE * sqrt(3))) + 0.5::DOUBLE AS br, floor(x / {_HEX}::DOUBLE) + 0.5::DOUBLE AS bq FROM o),
    d AS (SELECT *, power(x - aq * {_HEX}::DOUBLE, 2) + power(y - ar * {_HEX}::DOUBLE * sqrt(3), 2) <= power(x - bq * {_HEX}::DOUBLE, 2) + power(y - br * {_HEX}::DOUBLE * sqrt(3), 2) AS f FROM c)
    SELECT CASE WHEN f THEN aq ELSE bq END AS q, CASE WHEN f THEN ar ELSE br END AS r, round(count(*) / 9.0::DOUBLE, 6) AS mean, max(CASE WHEN a = 0 AND b = 0 THEN 1 ELSE 0 END) = 1 AS own FROM d GROUP BY 1, 2""")  # fmt: skip
def hexagons(spark, sf_dir):
    """Mean counts over nine lattices shifted by thirds; own: whether the lattice in place has points there."""
    return project.shifted_hexagons(first(spark, sf_dir), _HEX).select("q", "r", r6("mean").alias("mean"), "own")


@query("grid_blurred", f"""{_XYZ}, g AS (SELECT {_cell('x', 12)}, {_cell('y', 10)}, count(*) AS n FROM n GROUP BY 1, 2), s AS (SELECT cx + dx AS cx, cy + dy AS cy, n FROM g, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy))
    SELECT cx, cy, round(CAST(sum(n) AS DOUBLE) / ((CASE WHEN cx IN (0, 11) THEN 2 ELSE 3 END) * (CASE WHEN cy IN (0, 9) THEN 2 ELSE 3 END)), 6) AS v FROM s WHERE cx BETWEEN 0 AND 11 AND cy BETWEEN 0 AND 9 GROUP BY 1, 2""")  # fmt: skip
def grid_blurred(spark, sf_dir):
    return project.blurred(project.cells(first(spark, sf_dir), ["x", "y"], [12, 10]), (12, 10)).select("cx", "cy", r6("v").alias("v"))


@query("axis_spread", f"WITH {UNIT} SELECT round(stddev_pop(v[1]), 6) AS x, round(stddev_pop(v[2]), 6) AS y, round(stddev_pop(v[3]), 6) AS z FROM e")
def axis_spread(spark, sf_dir):
    return first(spark, sf_dir).agg(*(r6(F.stddev_pop(c)).alias(c) for c in "xyz"))


_RADIUS = f"WITH {UNIT}, xyz AS (SELECT id, v[1] AS x, v[2] AS y, v[3] AS z FROM e), m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM xyz), f AS (SELECT id, sqrt(power(x - mx, 2) + power(y - my, 2) + power(z - mz, 2)) AS radius FROM xyz, m)"


@query("shells", f"{_RADIUS}, q AS (SELECT quantile_cont(radius, [0.16666666666666666, 0.3333333333333333, 0.5, 0.6666666666666666, 0.8333333333333334]) AS q FROM f) SELECT id, round(radius, 6) AS radius, CAST(len(list_filter(q, lambda c: c < radius)) AS INTEGER) AS shell FROM f, q")
def shells(spark, sf_dir):
    return project.shells(first(spark, sf_dir), ["x", "y", "z"]).select("id", r6("radius").alias("radius"), "shell")


@query("radial_density", f"{_RADIUS}, t AS (SELECT max(radius) AS r, count(*) AS c FROM f), g AS (SELECT CAST(least(floor(radius / r * 22), 21) AS BIGINT) AS bin, any_value(c) AS c, count(*) AS n FROM f, t GROUP BY 1) SELECT bin, n, round(CAST(n AS DOUBLE) / c / (power((bin + 1.0::DOUBLE) / 22, 3) - power(bin / 22.0::DOUBLE, 3)), 5) AS density FROM g")
def radial_density(spark, sf_dir):
    return project.radial(project.shells(first(spark, sf_dir), ["x", "y", "z"])).select("bin", "n", r6("density", 5).alias("density"))


@query("density_ratio", f"""WITH {UNIT}, s AS (SELECT v[1] AS x, v[2] AS y FROM e), z AS (SELECT (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS y FROM s),
    g AS (SELECT CAST(floor((x + 3) / 6 * 30) AS BIGINT) AS cx, CAST(floor((y + 3) / 6 * 30) AS BIGINT) AS cy, count(*) AS n FROM z WHERE abs(x) < 3 AND abs(y) < 3 GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM g)
    SELECT cx, cy, n, round(greatest(least(log2((CAST(n AS DOUBLE) / t + 1e-6) / (exp(-(power((cx + 0.5::DOUBLE) / 30 * 6 - 3, 2) + power((cy + 0.5::DOUBLE) / 30 * 6 - 3, 2)) / 2) / (2 * pi()) * 0.04::DOUBLE + 1e-6)), 3), -3), 5) AS log_ratio FROM g, t""")  # fmt: skip
def density_ratio(spark, sf_dir):
    p = first(spark, sf_dir)
    m = p.agg(*(f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = p.join(F.broadcast(m)).select(*(((F.col(c) - F.col(f"m{c}")) / F.col(f"s{c}")).alias(c) for c in "xy")).where("abs(x) < 3 AND abs(y) < 3")
    g = z.groupBy(*(F.floor((F.col(c) + 3) / 6 * 30).alias(f"c{c}") for c in "xy")).agg(F.count(F.lit(1)).alias("n"))
    return project.log_ratio(g, 30).select("cx", "cy", "n", r6("log_ratio", 5).alias("log_ratio"))


@query("camera", f"{_XYZ} SELECT id, round(-sin(radians(35)) * x + cos(radians(35)) * y, 6) AS u, round(-sin(radians(22)) * cos(radians(35)) * x - sin(radians(22)) * sin(radians(35)) * y + cos(radians(22)) * z, 6) AS v, round(cos(radians(22)) * cos(radians(35)) * x + cos(radians(22)) * sin(radians(35)) * y + sin(radians(22)) * z, 6) AS depth FROM xyz")
def camera(spark, sf_dir):
    return project.camera(first(spark, sf_dir)).select("id", r6("u").alias("u"), r6("v").alias("v"), r6("depth").alias("depth"))


@query("pca_xyz")
def pca_xyz(spark, sf_dir):
    return axes(spark, sf_dir)


@query("pca_hull")
def pca_hull(spark, sf_dir):
    """Area of the outline and the share of cells in use."""
    p = axes(spark, sf_dir)
    h = project.hull(np.array([(r["x"], r["y"]) for r in project.hull_candidates(p).collect()]))
    n = project.cells(p, ["x", "y"], [80, 56]).count()
    return spark.createDataFrame([(len(h), project.area(h), n / (80 * 56))], "corners int, area double, occupied double")


@query("pca_voids")
def pca_voids(spark, sf_dir):
    return spark.createDataFrame(project.voids(axes(spark, sf_dir)), "x double, y double, radius double")


@query("pca_peaks")
def pca_peaks(spark, sf_dir):
    g = project.cells(axes(spark, sf_dir), ["x", "y"], [84, 60])
    for _ in range(3):
        g = project.blurred(g, (84, 60)).withColumnRenamed("v", "n")
    return spark.createDataFrame(project.peaks(project.dense(g, (84, 60)), 0.01), "cx int, cy int, height double, prominence double")


def _levels(spark, sf_dir):
    g = project.smoothed(project.dense(project.cells(axes(spark, sf_dir), ["x", "y"], [96, 60]), (96, 60)))
    return [(float(q), project.contours(g, q)) for q in np.quantile(g[g > 1e-9], [0.3, 0.45, 0.6, 0.75, 0.88, 0.96])]


@query("pca_contours")
def pca_contours(spark, sf_dir):
    rows = [(q, *map(float, (*a, *b))) for q, lines in _levels(spark, sf_dir) for a, b in lines]
    return spark.createDataFrame(rows, "level double, x0 double, y0 double, x1 double, y1 double")


@query("pca_polylines")
def pca_polylines(spark, sf_dir):
    """The level lines as joined points."""
    rows = [(q, k, [[float(x), float(y)] for x, y in line], line[0] == line[-1]) for q, lines in _levels(spark, sf_dir) for k, line in enumerate(project.polylines(lines))]
    return spark.createDataFrame(rows, "level double, line int, points array<array<double>>, closed boolean")


_VOXELS = f"{_XYZ}, g AS (SELECT {_cell('x', 9)}, {_cell('y', 9)}, {_cell('z', 9)}, count(*) AS n FROM n GROUP BY 1, 2, 3)"
_GAPS = " UNION ALL ".join(f"SELECT lead({a}) OVER (PARTITION BY {b}, {c} ORDER BY {a}) - {a} - 1 AS gap FROM g" for a, b, c in (("cx", "cy", "cz"), ("cy", "cx", "cz"), ("cz", "cx", "cy")))


@query("voxel_gap", f"{_VOXELS}, h AS ({_GAPS}) SELECT round((SELECT count(*) FROM g) / 729.0::DOUBLE, 6) AS occupied, CAST((SELECT max(n) FROM g) AS INTEGER) AS hottest, CAST(coalesce(max(gap), 0) AS INTEGER) AS longest_gap FROM h")
def voxel_gap(spark, sf_dir):
    """The share of voxels in use, the fullest one, and the longest run of empty ones between two in use."""
    rows = voxels(spark, sf_dir).collect()
    g = np.zeros((9, 9, 9), int)
    for r in rows:
        g[r["cx"], r["cy"], r["cz"]] = r["n"]
    longest = 0
    for axis in range(3):
        for line in np.moveaxis(g, axis, 2).reshape(-1, 9):
            used = np.flatnonzero(line)
            longest = max([longest, *(np.diff(used) - 1)]) if len(used) > 1 else longest
    return spark.createDataFrame([(round(len(rows) / 729, 6), int(g.max()), int(longest))], "occupied double, hottest int, longest_gap int")


def _paths(spark, sf_dir):
    """A sample of 4096 rows at most, its undirected neighbour graph, and that graph on the driver: paths are followed there."""
    x = sampling.sample(context.units(spark, sf_dir), 4096)
    e = context.once(spark, sf_dir, "path_edges", lambda: neighbours.undirected(neighbours.graph(x, 6)))
    return x, e, [tuple(r) for r in e.collect()]


@query("knn_bridges")
def knn_bridges(spark, sf_dir):
    """Components of the neighbour graph and sampled betweenness of its nodes."""
    x, e, rows = _paths(spark, sf_dir)
    score, _ = project.betweenness(rows, [r["id"] for r in x.select("id").collect()], 60)
    scores = spark.createDataFrame([(k, float(v)) for k, v in score.items()], "id bigint, betweenness double")
    return project.graph_components(e, x).join(scores, "id")


@query("bridge_edges")
def bridge_edges(spark, sf_dir):
    """The edges that hold the graph together, or the gaps between its components."""
    x, e, rows = _paths(spark, sf_dir)
    at = {r["id"]: (r["x"], r["y"]) for r in axes(spark, sf_dir).join(x.select("id"), "id", "left_semi").collect()}
    roots = {r["id"]: r["root"] for r in project.graph_components(e, x).collect()}
    return spark.createDataFrame(project.bridges(rows, at, roots), "a bigint, b bigint, gap double, score double")


@query("scatter_hot", f"WITH {NEAR}, d AS (SELECT i AS id, round(avg(c), 9) AS d FROM k WHERE r <= 10 GROUP BY i), t AS (SELECT quantile_cont(d, 0.985) AS t FROM d) SELECT id, d >= t AS hot FROM d, t")
def scatter_hot(spark, sf_dir):
    """Rows whose local density is at or above its 98.5th percentile."""
    d = neighbours.mean_similarity(context.graph(spark, sf_dir, 10), 10).withColumn("density", F.round("density", 9))
    return d.select("id", (F.col("density") >= F.lit(quantiles(d, "density", [0.985])[0])).alias("hot"))


@query("live_overlay", f"WITH {NEAR}, pt AS MATERIALIZED (SELECT id FROM u ORDER BY {mixed('id')}, id LIMIT 8000), nb AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY c DESC, j) AS n FROM k WHERE i IN (SELECT id FROM pt) AND j IN (SELECT id FROM pt)) SELECT i AS src, j AS dst FROM nb WHERE n <= 3")
def live_overlay(spark, sf_dir):
    """The neighbour graph of a sample of 8000 points, three each."""
    return neighbours.graph(sampling.sample(context.units(spark, sf_dir), 8000), 3).select("src", "dst")


@query("near_dup_groups", f"""WITH RECURSIVE {UNIT}, g AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id AND list_dot_product(a.v, b.v) >= 0.4),
    r(id, root) AS (SELECT id, id FROM u UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.id) SELECT id, min(root) AS root FROM r GROUP BY id""")  # fmt: skip
def near_dup_groups(spark, sf_dir):
    from ..operators.pairs import at_least

    x = unit(spark, sf_dir)
    return project.graph_components(at_least(x, 0.4), x)


# two embeddings of the same items: the second is the first with its dimensions turned by one, or cut to 48


def other(spark, sf_dir):
    """The second embedding: `compare` of the folder if there is one, else the first with its dimensions turned."""
    if context.exists(spark, f"{sf_dir}/compare.parquet"):
        second = schema.vectors(table(spark, sf_dir, "compare"), schema.Columns("embedding", "vec_id", "label"))
        return schema.unit(second)
    turned = F.concat(F.slice("vec", 2, F.size("vec") - 1), F.slice("vec", 1, 1))
    return unit(spark, sf_dir).withColumn("vec", F.transform(F.zip_with("vec", turned, lambda a, b: a + 0.3 * b), lambda x: x)).withColumn("vec", vec.unit(F.col("vec")))


def other_graph(spark, sf_dir):
    return context.once(spark, sf_dir, "other10", lambda: neighbours.graph(other(spark, sf_dir), 10))


def cut(spark, sf_dir):
    return raw(spark, sf_dir).withColumn("vec", vec.truncate(F.col("vec"), 48))


_TWO = UNIT + """, w AS (SELECT id, label, list_transform(list_zip(v, list_concat(v[2:], v[1:1])), lambda z: z[1] + 0.3::DOUBLE * z[2]) AS v FROM u), b AS (SELECT id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM w)"""


@query("truncated", f"WITH {UNIT}, t AS (SELECT id, v[1:16] AS v FROM e), l AS (SELECT id, unnest(range(16)) AS pos, unnest(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))) AS x FROM t) SELECT id, CAST(pos AS BIGINT) AS pos, round(x, 6) AS x FROM l")
def truncated(spark, sf_dir):
    return raw(spark, sf_dir).select("id", F.posexplode(vec.truncate(F.col("vec"), 16)).alias("pos", "x")).select("id", F.col("pos").cast("bigint").alias("pos"), r6("x").alias("x"))


@query("cmp_align", f"WITH {UNIT} SELECT count(*) AS n FROM u a JOIN u b ON CAST(a.id AS VARCHAR) = CAST(b.id AS VARCHAR)")
def cmp_align(spark, sf_dir):
    return compare.align(unit(spark, sf_dir), cut(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"))


@query("cmp_rows_of", "WITH w AS (SELECT CAST(vec_id * 2 AS VARCHAR) AS id FROM embeddings), k AS (SELECT CAST(vec_id AS VARCHAR) AS id, vec_id AS r FROM embeddings) SELECT w.id, coalesce(r, -1) AS row, r IS NOT NULL AS found FROM w LEFT JOIN k USING (id)")
def cmp_rows_of(spark, sf_dir):
    x = raw(spark, sf_dir)
    return compare.rows_of(x.select("id", F.col("id").alias("row")), x.select((F.col("id") * 2).alias("id")))


@query("cmp_drift", f"WITH {_TWO} SELECT CAST(u.id AS VARCHAR) AS id, round(list_distance(u.v, b.v), 6) AS drift, round(list_dot_product(u.v, b.v), 6) AS cos FROM u JOIN b USING (id)")
def cmp_drift(spark, sf_dir):
    return compare.drift(compare.align(unit(spark, sf_dir), other(spark, sf_dir))).select("id", r6("drift").alias("drift"), r6("cos").alias("cos"))


_NEAR2 = f"WITH {_TWO}, pa AS (SELECT x.id AS i, y.id AS j, row_number() OVER (PARTITION BY x.id ORDER BY list_dot_product(x.v, y.v) DESC, y.id) AS r FROM u x JOIN u y ON x.id <> y.id), pb AS (SELECT x.id AS i, y.id AS j, row_number() OVER (PARTITION BY x.id ORDER BY list_dot_product(x.v, y.v) DESC, y.id) AS r FROM b x JOIN b y ON x.id <> y.id)"


@query("cmp_overlap", f"{_NEAR2} SELECT pa.i AS id, round(count(pb.j) / 10.0::DOUBLE, 6) AS share FROM pa LEFT JOIN pb ON pa.i = pb.i AND pa.j = pb.j AND pb.r <= 10 WHERE pa.r <= 10 GROUP BY 1")
def cmp_overlap(spark, sf_dir):
    return neighbours.overlap(context.graph(spark, sf_dir, 10), other_graph(spark, sf_dir), 10).select("id", r6("share").alias("share"))


_CKA = f"""WITH {UNIT}, l AS (SELECT id, unnest(range(len(v))) AS pos, unnest(v) AS x FROM u), m AS (SELECT id, unnest(range(48)) AS pos, unnest(list_transform(v[1:48], lambda x: x / sqrt(list_dot_product(v[1:48], v[1:48])))) AS x FROM e),
    xy AS (SELECT sum(c * c) AS s FROM (SELECT covar_pop(l.x, m.x) * count(*) AS c FROM l JOIN m USING (id) GROUP BY l.pos, m.pos)), xx AS (SELECT sum(c * c) AS s FROM (SELECT covar_pop(a.x, b.x) * count(*) AS c FROM l a JOIN l b USING (id) GROUP BY a.pos, b.pos)),
    yy AS (SELECT sum(c * c) AS s FROM (SELECT covar_pop(a.x, b.x) * count(*) AS c FROM m a JOIN m b USING (id) GROUP BY a.pos, b.pos)) SELECT round(xy.s / sqrt(xx.s * yy.s), 6) AS cka FROM xy, xx, yy"""


@query("cmp_cka_linear", _CKA)
def cmp_cka_linear(spark, sf_dir):
    both = compare.align(unit(spark, sf_dir), cut(spark, sf_dir))
    return spark.createDataFrame([(compare.block_cka(both),)], "cka double").select(r6("cka").alias("cka"))


@query("cmp_energy", f"""WITH {_TWO}, d AS (SELECT (SELECT avg(sqrt(greatest(2 - 2 * list_dot_product(x.v, y.v), 0))) FROM u x, b y) AS xy,
    (SELECT sum(CASE WHEN x.id = y.id THEN 0 ELSE sqrt(greatest(2 - 2 * list_dot_product(x.v, y.v), 0)) END) / count(*) FROM u x, u y) AS xx, (SELECT sum(CASE WHEN x.id = y.id THEN 0 ELSE sqrt(greatest(2 - 2 * list_dot_product(x.v, y.v), 0)) END) / count(*) FROM b x, b y) AS yy)
    SELECT round(greatest(2 * xy - xx - yy, 0), 6) AS energy FROM d""")  # fmt: skip
def cmp_energy(spark, sf_dir):
    return compare.energy(context.units(spark, sf_dir), other(spark, sf_dir)).select(r6("energy").alias("energy"))


_KERNELS = f"""WITH {_TWO}, x AS MATERIALIZED (SELECT p.id AS i, q.id AS j, list_sum(list_transform(list_zip(p.v, q.v), lambda z: power(z[1] - z[2], 2))) AS d FROM u p, u q), y AS MATERIALIZED (SELECT p.id AS i, q.id AS j, list_sum(list_transform(list_zip(p.v, q.v), lambda z: power(z[1] - z[2], 2))) AS d FROM b p, b q), z AS MATERIALIZED (SELECT p.id AS i, q.id AS j, list_sum(list_transform(list_zip(p.v, q.v), lambda z: power(z[1] - z[2], 2))) AS d FROM u p, b q),
    sx AS (SELECT quantile_cont(d, 0.5) AS s FROM x WHERE i < j), sy AS (SELECT quantile_cont(d, 0.5) AS s FROM y WHERE i < j), sz AS (SELECT quantile_cont(d, 0.5) AS s FROM (SELECT d FROM x WHERE i < j UNION ALL SELECT d FROM y WHERE i < j UNION ALL SELECT d FROM z)),
    kx AS (SELECT i, j, exp(-d / (2 * s)) AS k FROM x, sx), ky AS (SELECT i, j, exp(-d / (2 * s)) AS k FROM y, sy),
    cx AS (SELECT i, j, k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER () AS k FROM kx), cy AS (SELECT i, j, k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER () AS k FROM ky), n AS (SELECT count(*) AS n FROM u)
    SELECT round((SELECT sum(a.k * b.k) / sqrt(sum(a.k * a.k) * sum(b.k * b.k)) FROM cx a JOIN cy b USING (i, j)), 6) AS rbf_cka,
    round((SELECT sum(exp(-d / (2 * s))) FROM x, sz WHERE i <> j) / (n * (n - 1.0::DOUBLE)) + (SELECT sum(exp(-d / (2 * s))) FROM y, sz WHERE i <> j) / (n * (n - 1.0::DOUBLE)) - 2 * (SELECT avg(exp(-d / (2 * s))) FROM z, sz), 6) AS mmd FROM n"""


@query("cmp_kernels", _KERNELS)
def cmp_kernels(spark, sf_dir):
    """Kernel scores over all pairs of all items."""
    return spark.createDataFrame([compare.kernel_scores(compare.align(unit(spark, sf_dir), other(spark, sf_dir)))], "rbf_cka double, mmd double").select(r6("rbf_cka").alias("rbf_cka"), r6("mmd").alias("mmd"))


@query("cmp_scores")
def cmp_scores(spark, sf_dir):
    """The scorecard: agreement of kernels and of the rotation, each from 0 to 1."""
    both = compare.align(unit(spark, sf_dir), other(spark, sf_dir))
    cka, mmd = compare.kernel_scores(both)
    card = (compare.block_cka(both), cka, 1 - min(1.0, max(0.0, mmd)), 1 - min(1.0, max(0.0, compare.procrustes(both) / 2)))
    return spark.createDataFrame([card], "cka double, rbf_cka double, mmd_card double, procrustes_card double")


@query("cmp_drift_grid", f"WITH {_TWO}, xy AS (SELECT u.id, u.v[1] AS x, u.v[2] AS y, b.v[1] - u.v[1] AS dx, b.v[2] - u.v[2] AS dy, list_distance(u.v, b.v) AS d FROM u JOIN b USING (id)), m AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM xy), n AS (SELECT id, (x - x0) / (x1 - x0) AS x, (y - y0) / (y1 - y0) AS y, d, dx, dy FROM xy, m), g AS (SELECT {_cell('x', 30)}, {_cell('y', 30)}, count(*) AS n, avg(d) AS drift, avg(dx) AS dx, avg(dy) AS dy FROM n GROUP BY 1, 2), q AS (SELECT quantile_cont(drift, 0.6) AS q60, quantile_cont(drift, 0.95) AS q95 FROM g) SELECT cx, cy, n, round(drift, 6) AS drift, round(dx, 6) AS dx, round(dy, 6) AS dy, drift >= q60 AS over60, drift >= q95 AS over95 FROM g, q")
def cmp_drift_grid(spark, sf_dir):
    """Mean drift and its mean arrow over the cells of the first set's plane, with the cells at or above two quantiles."""
    both = compare.align(unit(spark, sf_dir), other(spark, sf_dir))
    far = compare.drift(both).select("id", F.col("drift").alias("d"))
    at = both.select("id", F.col("va")[0].alias("x"), F.col("va")[1].alias("y"), (F.col("vb")[0] - F.col("va")[0]).alias("dx"), (F.col("vb")[1] - F.col("va")[1]).alias("dy")).join(far, "id")
    g = compare.drift_cells(project.boxed(at, ["x", "y"]), 30)
    return g.select("cx", "cy", "n", r6("drift").alias("drift"), r6("dx").alias("dx"), r6("dy").alias("dy"), "over60", "over95")


@query("cmp_overlap_hist", f"{_NEAR2}, o AS (SELECT pa.i AS id, count(pb.j) / 10.0::DOUBLE AS share FROM pa LEFT JOIN pb ON pa.i = pb.i AND pa.j = pb.j AND pb.r <= 10 WHERE pa.r <= 10 GROUP BY 1) SELECT CAST(least(floor(share * 26), 25) AS INTEGER) AS bin, count(*) AS n FROM o GROUP BY 1")
def cmp_overlap_hist(spark, sf_dir):
    """The items by the share of neighbours that both sets have, in 26 bins."""
    share = neighbours.overlap(context.graph(spark, sf_dir, 10), other_graph(spark, sf_dir), 10)
    return share.groupBy(F.least(F.floor(F.col("share") * 26), F.lit(25)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("cmp_overlap_by_k", f"{_NEAR2} SELECT k, round(CAST(count(pb.j) AS DOUBLE) / (k * count(DISTINCT pa.i)), 6) AS share FROM (SELECT unnest([1, 2, 5, 10]) AS k) JOIN pa ON pa.r <= k LEFT JOIN pb ON pa.i = pb.i AND pa.j = pb.j AND pb.r <= k GROUP BY k")
def cmp_overlap_by_k(spark, sf_dir):
    """The mean share for several numbers of neighbours."""
    a, b = context.graph(spark, sf_dir, 10), other_graph(spark, sf_dir)
    ks = [1, 2, 5, 10]
    mean = neighbours.overlaps(a, b, ks).agg(*(r6(F.avg(f"k{k}")).alias(f"k{k}") for k in ks))
    return mean.select(F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("share")) for k in ks))))


@query("wide_columns", f"WITH {UNIT} SELECT id, round(sqrt(v[1] * v[1] + v[2] * v[2]), 6) AS norm FROM e")
def wide_columns(spark, sf_dir):
    """A table whose numeric columns are the dimensions."""
    wide = raw(spark, sf_dir).select("id", F.col("vec")[0].alias("a"), F.col("vec")[1].alias("b"))
    return schema.vectors(wide).select("id", r6(vec.norm(F.col("vec"))).alias("norm"))


assert NEAR


@query("knn_mesh", f"WITH {NEAR}, m AS (SELECT least(i, j) AS a, greatest(i, j) AS b, min(greatest(1 - c, 1e-6)) AS d FROM k WHERE r <= 6 GROUP BY 1, 2), g AS (SELECT a AS id FROM m UNION ALL SELECT b FROM m) SELECT (SELECT count(*) FROM m) AS edges, round((SELECT max(d) FROM m), 6) AS longest, (SELECT max(n) FROM (SELECT count(*) AS n FROM g GROUP BY id)) AS hub_degree")
def knn_mesh(spark, sf_dir):
    e = neighbours.undirected(context.graph(spark, sf_dir, 6))
    ends = e.select(F.col("a").alias("id")).union(e.select("b")).groupBy("id").count()
    return e.agg(F.count(F.lit(1)).alias("edges"), r6(F.max("dist")).alias("longest")).join(ends.agg(F.max("count").alias("hub_degree")))


_SHIFT = f"""WITH {_TWO}, r AS (SELECT u.id, u.v AS va, b.v AS vb, row_number() OVER (ORDER BY u.id) - 1 AS n FROM u JOIN b USING (id)),
    t AS (SELECT (t * 7919 + 13) % m AS i, (t * 104729 + t * t * 31 + 7) % m AS j FROM range(20000) x(t), (SELECT count(*) AS m FROM u)),
    s AS (SELECT list_dot_product(a.va, b.va) AS ca, list_dot_product(a.vb, b.vb) AS cb FROM t JOIN r a ON a.n = t.i JOIN r b ON b.n = t.j WHERE t.i <> t.j)
    SELECT 'a' AS side, round(avg(ca), 6) AS mean, round(stddev_pop(ca), 6) AS sd, round(ln(avg(exp(-2 * (2 - 2 * ca)))), 6) AS uniformity FROM s UNION ALL SELECT 'b', round(avg(cb), 6), round(stddev_pop(cb), 6), round(ln(avg(exp(-2 * (2 - 2 * cb)))), 6) FROM s"""


@query("cmp_shift", _SHIFT)
def cmp_shift(spark, sf_dir):
    """The pair cosines of both embeddings, over the same pairs."""
    from ..operators import occupancy
    from .registered import DRAWS

    out = None
    for side, rows in (("a", unit(spark, sf_dir)), ("b", other(spark, sf_dir))):
        s = occupancy.summary(sampling.pair_cosines(rows, DRAWS))
        s = s.select(F.lit(side).alias("side"), r6("mean_cos").alias("mean"), r6("sd_cos").alias("sd"), r6("uniformity").alias("uniformity"))
        out = s if out is None else out.union(s)
    return out
