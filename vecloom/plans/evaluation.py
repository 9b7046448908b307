"""Sampling, training inputs and retrieval quality over the embeddings.

Searches are the rows whose id is divisible by 100, against all rows; a document is relevant if it
has the search's label. Training batches are all rows, 200 ids a batch.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec
from ..operators import evaluate, sampling, training
from ..operators.pairs import at_least, top_k
from . import context
from .registered import PAIRS, UNIT, mixed, phi, query, r6, raw, table, unit


@query("hash_sample", f"SELECT vec_id AS id FROM embeddings ORDER BY {mixed('vec_id')}, vec_id LIMIT 100")
def hash_sample(spark, sf_dir):
    return sampling.sample(raw(spark, sf_dir), 100).select("id")


@query("eval_split", f"""WITH d AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY {mixed('doc_id')}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT doc_id, lang, CASE WHEN r <= floor(n * 0.15::DOUBLE + 0.5::DOUBLE) THEN 'eval' ELSE 'train' END AS part FROM d""")  # fmt: skip
def eval_split(spark, sf_dir):
    return sampling.split(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], 0.15, "doc_id")


@query("stratified_sample", f"""WITH c AS (SELECT lang, count(*) AS n, CAST(floor(count(*) * 120 / sum(count(*)) OVER () + 0.5) AS BIGINT) AS q, row_number() OVER (ORDER BY count(*) DESC, lang) AS o FROM documents GROUP BY lang),
    q AS (SELECT lang, least(n, q + CASE WHEN o = 1 THEN 120 - (SELECT sum(q) FROM c) ELSE 0 END) AS q FROM c), t AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {mixed('doc_id')}, doc_id) AS r FROM documents),
    s AS (SELECT doc_id, lang FROM t JOIN q USING (lang) WHERE r <= q), h AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {mixed('doc_id', 1)}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM s)
    SELECT doc_id, lang, CASE WHEN r <= floor(n * 0.2::DOUBLE + 0.5::DOUBLE) THEN 'eval' ELSE 'train' END AS part FROM h""")  # fmt: skip
def stratified_sample(spark, sf_dir):
    return sampling.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 120, 0.2, "doc_id")


@query("per_key_cap", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 3")
def per_key_cap(spark, sf_dir):
    return sampling.capped(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], [F.col("doc_id")], 3)


@query("rebalanced", f"""WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang = 'de' ORDER BY {mixed('doc_id')}, doc_id) AS r, (SELECT 2 * count(*) FROM documents WHERE lang = 'de') AS cap FROM documents)
    SELECT doc_id, lang FROM d WHERE lang = 'de' OR r <= cap""")  # fmt: skip
def rebalanced(spark, sf_dir):
    return sampling.rebalanced(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "de", "doc_id")


@query("weighted_sample", f"SELECT doc_id FROM documents WHERE n_chars > 0 ORDER BY -ln((CAST('0x' || substring({mixed('doc_id')}, 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE) / n_chars, doc_id LIMIT 50")
def weighted_sample(spark, sf_dir):
    return sampling.weighted(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 50, "doc_id").select("doc_id")


SEARCHES = "id % 100 = 0"
BATCH = 200

_BATCH = f"{UNIT}, q AS (SELECT a.id AS i, b.id AS j, a.id // 200 AS batch, list_dot_product(a.v, b.v) AS c FROM u a JOIN u b ON a.id <> b.id AND a.id // 200 = b.id // 200), g AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY c DESC, j) AS r FROM q), h AS (SELECT i, j FROM g WHERE r <= 3 UNION SELECT j, i FROM g WHERE r <= 3)"


def batches(spark, sf_dir, dims=None):
    x = unit(spark, sf_dir)
    return training.batched_pairs(x if dims is None else x.withColumn("vec", vec.truncate(F.col("vec"), dims)), BATCH)


@query("guard_pairs", f"WITH {_BATCH} SELECT i, j FROM h")
def guard_pairs(spark, sf_dir):
    return training.guarded(training.batched_edges(batches(spark, sf_dir)), 3)


@query("confusion_loss", f"WITH {_BATCH} SELECT batch, round(avg({phi('c', '0.3::DOUBLE')}), 6) AS loss FROM q WHERE NOT EXISTS (FROM h WHERE h.i = q.i AND h.j = q.j) GROUP BY batch")
def confusion_loss(spark, sf_dir):
    return training.confusion_loss(batches(spark, sf_dir), 0.3, guard_pairs(spark, sf_dir), ("batch",)).select("batch", r6("loss").alias("loss"))


@query("uniformity_loss", f"WITH {_BATCH} SELECT batch, round(ln(avg(exp(-2 * (2 - 2 * c)))), 6) AS loss FROM q GROUP BY batch")
def uniformity_loss(spark, sf_dir):
    return training.uniformity_loss(batches(spark, sf_dir), by=("batch",)).select("batch", r6("loss").alias("loss"))


@query("preservation_loss", f"""WITH {UNIT}, b AS (SELECT a.id AS i, b.id AS j, a.id // 200 AS batch, list_dot_product(a.v, b.v) AS c, list_dot_product(a.v[1:48], b.v[1:48]) / sqrt(list_dot_product(a.v[1:48], a.v[1:48]) * list_dot_product(b.v[1:48], b.v[1:48])) AS d FROM u a JOIN u b ON a.id <> b.id AND a.id // 200 = b.id // 200),
    l AS (SELECT batch, i, c / 0.05::DOUBLE - ln(sum(exp(c / 0.05::DOUBLE)) OVER (PARTITION BY i)) AS o, d / 0.05::DOUBLE - ln(sum(exp(d / 0.05::DOUBLE)) OVER (PARTITION BY i)) AS n FROM b)
    SELECT batch, round(avg(kl), 6) AS loss FROM (SELECT batch, sum(exp(o) * (o - n)) AS kl FROM l GROUP BY batch, i) GROUP BY batch""")  # fmt: skip
def preservation_loss(spark, sf_dir):
    return training.preservation_loss(batches(spark, sf_dir), batches(spark, sf_dir, 48), by=("batch",)).select("batch", r6("loss").alias("loss"))


@query("resolution_weights", f"WITH {PAIRS}, s AS (SELECT i AS id, sum({phi('c', '0.3::DOUBLE')}) AS x FROM p GROUP BY i) SELECT id, round(0.9::DOUBLE * x / sum(x) OVER () + 0.1::DOUBLE / count(*) OVER (), 7) AS weight FROM s")
def resolution_weights(spark, sf_dir):
    return training.resolution_weights(context.collisions(spark, sf_dir)).select("id", r6("weight", 7).alias("weight"))


@query("confusable_negatives", f"WITH {_BATCH}, w AS (SELECT i, j, c, row_number() OVER (PARTITION BY i ORDER BY {mixed('j')}, j) AS r FROM q WHERE c BETWEEN 0.1 AND 0.25 AND NOT EXISTS (FROM h WHERE h.i = q.i AND h.j = q.j)) SELECT i, j, round(c, 6) AS cos FROM w WHERE r <= 4")
def confusable_negatives(spark, sf_dir):
    return training.confusable_negatives(batches(spark, sf_dir), guard_pairs(spark, sf_dir), 0.1, 0.25, 4).select("i", "j", r6("cos").alias("cos"))


_SCORES = f"{UNIT}, s AS (SELECT a.id AS q, b.id AS id, list_dot_product(a.v, b.v) AS c, a.label = b.label AS rel, row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.v, b.v) DESC, b.id) AS r FROM u a JOIN u b ON a.id % 100 = 0 AND a.id <> b.id), g AS (SELECT q, min(id) AS id FROM s WHERE rel GROUP BY q)"


def searches(spark, sf_dir):
    return context.units(spark, sf_dir).where(SEARCHES)


def hits(spark, sf_dir, k):
    """(q, id, cos, rank, rel): the k nearest rows of every search."""
    x = context.units(spark, sf_dir)
    return evaluate.label_hits(x.where(SEARCHES), x, top_k(x.where(SEARCHES), x, k))


@query("hard_negatives", f"WITH {_SCORES}, n AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY c DESC, id) AS rank FROM s WHERE r <= 20 AND NOT rel) SELECT q, id, CAST(rank AS INTEGER) AS rank FROM n WHERE rank <= 5")
def hard_negatives(spark, sf_dir):
    return training.first_wrong(hits(spark, sf_dir, 20), 5).select("q", "id", "rank")


@query("training_rows", """WITH p AS (SELECT lang AS q, doc_id AS id, source AS text, min(source) OVER (PARTITION BY lang) AS question FROM documents), d AS (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS number FROM (SELECT DISTINCT id FROM p)),
    f AS (SELECT q, question, id, text, number, row_number() OVER (PARTITION BY q ORDER BY id) AS r, count(*) OVER (PARTITION BY q) AS m FROM p JOIN d USING (id)),
    w AS (SELECT doc_id AS id, n.lang AS q, source AS text, row_number() OVER (PARTITION BY n.lang ORDER BY doc_id, source) AS r FROM documents d JOIN (SELECT DISTINCT lang FROM documents) n ON d.lang <> n.lang)
    SELECT q, any_value(question) AS anchor, max(text) FILTER (r = 1) AS positive_1, max(text) FILTER (r = least(2, m)) AS positive_2, max(text) FILTER (r = least(3, m)) AS positive_3, max(number) FILTER (r = 1) AS number_1, max(number) FILTER (r = least(3, m)) AS number_3,
    (SELECT max(w.text) FILTER (w.r = 1) FROM w WHERE w.q = f.q) AS negative_1, (SELECT max(w.text) FILTER (w.r = 5) FROM w WHERE w.q = f.q) AS negative_5 FROM f GROUP BY q""")  # fmt: skip
def training_rows(spark, sf_dir):
    """Every language's first documents as positives, and the first of other languages as negatives."""
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("q"), F.col("doc_id").alias("id"), F.col("source").alias("text"))
    out = training.training_rows(d.withColumn("question", F.col("text")), training.other_groups(d, 5))
    at = lambda c, i: F.col(c)[i - 1].alias(f"{c[:-1] if c != 'gold_numbers' else 'number'}_{i}")
    return out.select("q", "anchor", *(at("positives", i) for i in (1, 2, 3)), *(at("gold_numbers", i) for i in (1, 3)), *(at("negatives", i) for i in (1, 5)))


@query("gold_rank", f"WITH {_SCORES} SELECT s.q, count(*) FILTER (s.c > o.c) + 1 AS rank FROM s JOIN g USING (q) JOIN s o ON o.q = g.q AND o.id = g.id GROUP BY s.q")
def gold_rank(spark, sf_dir):
    x, q = context.units(spark, sf_dir), searches(spark, sf_dir)
    return evaluate.ranks_of(q, evaluate.least_golds(q, x), x)


@query("recall_mrr", f"WITH {_SCORES}, k AS (SELECT s.q, count(*) FILTER (s.c > o.c) + 1 AS rank FROM s JOIN g USING (q) JOIN s o ON o.q = g.q AND o.id = g.id GROUP BY s.q) SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_10, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr_10, round(quantile_cont(rank, 0.5), 6) AS median_rank, round(avg(rank), 6) AS mean_rank FROM k")
def recall_mrr(spark, sf_dir):
    out = evaluate.rank_summary(gold_rank(spark, sf_dir))
    return out.select("n", *(r6(c).alias(c) for c in out.columns[1:]))


@query("set_recall", f"WITH {_SCORES}, m AS (SELECT q, CAST(count(*) FILTER (r <= 50) AS DOUBLE) / count(*) AS x FROM s WHERE rel GROUP BY q) SELECT round(avg(x), 6) AS set_recall, round(avg(CASE WHEN x = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS all_gold FROM m")
def set_recall(spark, sf_dir):
    got = evaluate.set_recall_of(hits(spark, sf_dir, 50), evaluate.label_golds(searches(spark, sf_dir), context.units(spark, sf_dir)), 50)
    return got.select(r6("set_recall").alias("set_recall"), r6("all_gold").alias("all_gold"))


@query("ndcg10", f"WITH {_SCORES}, d AS (SELECT q, sum(CASE WHEN r <= 10 THEN 1 / log2(r + 1) ELSE 0 END) AS dcg, avg(CASE WHEN r <= 100 THEN 1.0::DOUBLE ELSE 0 END) AS recall, least(count(*), 10) AS n FROM s WHERE rel GROUP BY q) SELECT q, round(dcg / list_sum(list_transform(range(1, n + 1), lambda x: 1 / log2(x + 1))), 6) AS ndcg, round(recall, 6) AS recall_100 FROM d")
def ndcg10(spark, sf_dir):
    got = evaluate.ndcg_of(hits(spark, sf_dir, 100), evaluate.label_golds(searches(spark, sf_dir), context.units(spark, sf_dir)))
    return got.select("q", r6("ndcg").alias("ndcg"), r6("recall_100").alias("recall_100"))


@query("auc", "WITH l AS (SELECT quality = 1 AS p, CAST(n_chars // 100 AS BIGINT) AS s FROM labels JOIN documents USING (doc_id)) SELECT round(avg(CASE WHEN a.s > b.s THEN 1.0::DOUBLE WHEN a.s = b.s THEN 0.5 ELSE 0 END), 6) AS auc FROM l a JOIN l b ON a.p AND NOT b.p")
def auc(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("n_chars") / 100).alias("s"))
    return evaluate.auc(table(spark, sf_dir, "labels").join(d, "doc_id").select("s", (F.col("quality") == 1).alias("p")), "s", "p").select(r6("auc").alias("auc"))


@query("spearman", "WITH d AS (SELECT n_chars // 100 AS a, doc_id % 37 AS b FROM documents), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS y FROM d) SELECT round(corr(x, y), 6) AS rho FROM r")
def spearman(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("n_chars") / 100).alias("a"), (F.col("doc_id") % 37).alias("b"))
    return evaluate.spearman(d, "a", "b").select(r6("rho").alias("rho"))


@query("rank_agreement", "WITH r AS (SELECT n_nationkey AS id, n_nationkey % 7 AS x, n_nationkey % 5 AS y FROM nation) SELECT round(avg(CASE WHEN sign(a.x - b.x) = sign(a.y - b.y) THEN 1.0::DOUBLE ELSE 0 END), 6) AS agreement FROM r a JOIN r b ON a.id < b.id")
def rank_agreement(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 7).alias("x"), (F.col("n_nationkey") % 5).alias("y"))
    return evaluate.rank_agreement(n, "x", "y").select(r6("agreement").alias("agreement"))


@query("cohort_deltas", "WITH d AS (SELECT n_chars AS b, n_chars * (doc_id % 3) AS a, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT count(*) AS n, round(quantile_cont(b, 0.5), 6) AS before, round(quantile_cont(a, 0.5), 6) AS after FROM d WHERE r <= ceil(n * 0.05::DOUBLE)")
def cohort_deltas(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("b"), (F.col("n_chars") * (F.col("doc_id") % 3)).alias("a"))
    return evaluate.cohort(d, "b", "a", 0.05).select("n", r6("before").alias("before"), r6("after").alias("after"))


@query("switched_hits", "SELECT count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 5 = 0) AS fixed, count(*) FILTER (doc_id % 3 = 0 AND doc_id % 5 <> 0) AS broken FROM documents")
def switched_hits(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 3 == 0).alias("x"), (F.col("doc_id") % 5 == 0).alias("y"))
    return evaluate.switched(d, "x", "y")


_SWITCHED = "SELECT count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 4 = 0) AS fixed, count(*) FILTER (doc_id % 3 = 0 AND doc_id % 4 <> 0) AS broken FROM documents"


@query("mcnemar", f"WITH s AS ({_SWITCHED}), n AS (SELECT fixed, broken, fixed + broken AS n, least(fixed, broken) AS k FROM s) SELECT fixed, broken, round(least(1, 2 * (SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n * ln(2))) FROM range(k + 1) x(i))), 6) AS p FROM n")
def mcnemar(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 3 == 0).alias("x"), (F.col("doc_id") % 4 == 0).alias("y"))
    r = evaluate.mcnemar(d, "x", "y")
    return spark.createDataFrame([(r["fixed"], r["broken"], float(r["p"]))], "fixed bigint, broken bigint, p double").withColumn("p", r6("p"))


_CI = """{0}, c AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS place, count(*) OVER () AS n FROM (SELECT {1} AS k, sum(1.0::DOUBLE / rank) AS s, count(*) AS c FROM t GROUP BY 1)), m AS (SELECT max(n) AS n FROM c),
    d AS (SELECT rep, CAST('0x' || substring(md5('0:' || rep || ':' || i), 1, 12) AS BIGINT) % n AS place FROM range(2000) x(rep), m, LATERAL (SELECT unnest(range(n)) AS i)), b AS (SELECT rep, sum(s) / sum(c) AS m FROM d JOIN c USING (place) GROUP BY rep)
    SELECT round((SELECT sum(s) / sum(c) FROM c), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM b"""
_RANKS = f"WITH {_SCORES}, t AS (SELECT s.q, count(*) FILTER (s.c > o.c) + 1 AS rank FROM s JOIN g USING (q) JOIN s o ON o.q = g.q AND o.id = g.id GROUP BY s.q)"


@query("bootstrap_ci", _CI.format(_RANKS, "q"))
def bootstrap_ci(spark, sf_dir):
    out = evaluate.bootstrap(gold_rank(spark, sf_dir).withColumn("mrr", 1 / F.col("rank")), "mrr", "q", 2000)
    return out.select(*(r6(c).alias(c) for c in out.columns))


@query("cluster_bootstrap_ci", _CI.format(f"{_RANKS[:-1]})", "q // 300"))
def cluster_bootstrap_ci(spark, sf_dir):
    """The same with searches drawn in clusters of three."""
    ranks = gold_rank(spark, sf_dir).select("q", (1 / F.col("rank")).alias("mrr"), F.floor(F.col("q") / 300).alias("cluster"))
    out = evaluate.bootstrap(ranks, "mrr", "q", 2000, cluster="cluster")
    return out.select(*(r6(c).alias(c) for c in out.columns))


@query("spearman_exact", """WITH t AS (SELECT n_regionkey AS x, sum(n_nationkey) AS y FROM nation GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b, row_number() OVER (ORDER BY x) AS i FROM t), l AS (SELECT list(a ORDER BY i) AS a, list(b ORDER BY i) AS b, count(*) AS n FROM r),
    p AS (SELECT [i, j, k, m, o] AS p FROM range(1, 6) t1(i), range(1, 6) t2(j), range(1, 6) t3(k), range(1, 6) t4(m), range(1, 6) t5(o) WHERE i <> j AND i <> k AND i <> m AND i <> o AND j <> k AND j <> m AND j <> o AND k <> m AND k <> o AND m <> o),
    c AS (SELECT p, corr(av, bv) AS rho FROM (SELECT p, unnest(a) AS av, unnest(list_transform(p, lambda x: b[x])) AS bv FROM p, l) GROUP BY p), own AS (SELECT rho FROM c WHERE p = [1, 2, 3, 4, 5]) SELECT round((SELECT rho FROM own), 6) AS rho, round(avg(CASE WHEN abs(rho) >= abs((SELECT rho FROM own)) - 1e-12 THEN 1.0::DOUBLE ELSE 0 END), 6) AS p FROM c""")  # fmt: skip
def spearman_exact(spark, sf_dir):
    """Rho of regions' counts of nations and their numbers, with the exact permutation test (few rows: all orders are tried)."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("c"), F.sum("n_nationkey").alias("s"))
    rho, p = evaluate.permutation_p([(r["n_regionkey"], r["s"]) for r in n.collect()])
    return spark.createDataFrame([(round(rho, 6), round(p, 6))], "rho double, p double")


@query("dedup_f1", f"WITH {PAIRS}, f AS (SELECT i, j, c FROM p WHERE i < j AND c >= 0.3), g AS (SELECT i, j FROM p WHERE i < j AND li = lj), t AS (SELECT unnest([0.3, 0.35, 0.4]::DOUBLE[]) AS threshold), h AS (SELECT threshold, count(g.i) AS tp, count(*) AS n FROM t JOIN f ON c >= threshold LEFT JOIN g USING (i, j) GROUP BY 1) SELECT threshold, round(tp / CAST(n AS DOUBLE), 6) AS precision, round(tp / CAST((SELECT count(*) FROM g) AS DOUBLE), 6) AS recall, round(2.0::DOUBLE * tp / (n + (SELECT count(*) FROM g)), 6) AS f1 FROM h")
def dedup_f1(spark, sf_dir):
    x = unit(spark, sf_dir)
    return evaluate.label_pair_scores(at_least(x, 0.3), x.select("id", "label"), [0.3, 0.35, 0.4]).select("threshold", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


@query("detection_power", "WITH n AS (SELECT lang AS statistic, quantile_cont(n_chars, 0.99) AS threshold FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) SELECT statistic, round(threshold, 6) AS threshold, round(avg(CASE WHEN n_chars > threshold THEN 1.0::DOUBLE ELSE 0 END), 6) AS power FROM documents JOIN n ON lang = statistic WHERE doc_id % 2 = 1 GROUP BY 1, 2, n.threshold")
def detection_power(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("statistic"), F.col("n_chars").alias("value"))
    out = evaluate.power(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"))
    return out.select("statistic", r6("threshold").alias("threshold"), r6("power").alias("power"))
