"""Retrieval sets: loading, pools, disjoint clusters, routing of duplicates, ranks by variant."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, neighbours, prepare, retrieval
from . import context
from .geometry import _TWO, other
from .registered import UNIT, mixed, query, r6, table


@query("id_lookup", "SELECT doc_id AS id, md5(text) AS digest FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def id_lookup(spark, sf_dir):
    """The texts of a manifest's ids."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    wanted = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return retrieval.of_ids(d, wanted).select("id", F.md5("text").alias("digest"))


@query("open_corpus", "SELECT 'documents:' || doc_id AS id, md5(text) AS digest, 'documents' AS origin FROM documents UNION ALL SELECT 'benchmark:' || item_id, md5(text), 'benchmark' FROM benchmark")
def open_corpus(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return retrieval.open_corpus({"documents": d, "benchmark": b}).select("id", F.md5("text").alias("digest"), "origin")


@query("stripped_labels", "SELECT doc_id, CASE WHEN starts_with(source, 'src') THEN substring(source, 4) ELSE source END AS label FROM documents")
def stripped_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", retrieval.stripped(F.col("source"), "src").alias("label"))


@query("candidate_pool", f"WITH d AS (SELECT doc_id AS id, lang, row_number() OVER (PARTITION BY lang ORDER BY {mixed('doc_id')}, doc_id) AS r FROM documents), p AS (SELECT id, lang FROM d WHERE r <= 20 UNION SELECT id, lang FROM d WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)) SELECT id, lang, CAST(row_number() OVER (ORDER BY {mixed('id', 1)}, id) - 1 AS BIGINT) AS place FROM p")
def candidate_pool(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    wanted = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return retrieval.candidate_pool(d, "lang", 20, wanted)


@query("manifest_alignment", f"WITH {UNIT} SELECT count(*) AS n, round(sum(v[1]), 6) AS first FROM u WHERE id % 3 = 0")
def manifest_alignment(spark, sf_dir):
    """A manifest of every third id, with its vectors; ids without one would be an error."""
    x = context.units(spark, sf_dir)
    got = retrieval.aligned(x.where("id % 3 = 0").select("id"), x.select("id", "vec"))
    return got.agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("vec")[0])).alias("first"))


def _stub(texts: list[str]) -> list[list[float]]:
    """Stands for an encoder: lengths and first characters."""
    return [[float(len(t)), float(ord(t[0])) if t else 0.0] for t in texts]


@query("truncated_references", "SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE length(left(text, 200)) END AS a, CASE WHEN doc_id % 5 = 0 OR text = '' THEN 0 ELSE unicode(text) END AS b FROM documents")
def truncated_references(spark, sf_dir):
    """References of the texts' first 200 characters by a stand-in encoder; every fifth id is held out."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    got = retrieval.truncated_references(d, _stub, 200, F.col("id") % 5 == 0, 2)
    return got.select("id", F.col("embedding")[0].cast("bigint").alias("a"), F.col("embedding")[1].cast("int").alias("b"))


@query("pooled_texts", "SELECT conv_id, max(text) FILTER (r = 1) AS last, CAST(max(r) AS BIGINT) AS turns FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) GROUP BY conv_id")
def pooled_texts(spark, sf_dir):
    """Of every conversation the last turn, which stands for it, and the number of turns."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("last"), F.count(F.lit(1)).alias("turns"))


@query("semantic_clusters")
def semantic_clusters(spark, sf_dir):
    """Disjoint clusters of an anchor and two of its six nearest rows, greedily in mixed order."""
    return neighbours.greedy_groups(context.graph(spark, sf_dir, 6), context.units(spark, sf_dir))


_EVAL = "SELECT doc_id FROM labels WHERE quality = 1"


@query("disjoint_clusters", f"SELECT doc_id, lang, source FROM (SELECT doc_id, lang, source, count(*) OVER (PARTITION BY lang, source) AS n, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents WHERE doc_id NOT IN ({_EVAL})) WHERE n >= 2 AND r <= 2")
def disjoint_clusters(spark, sf_dir):
    """Sibling clusters without the documents of the evaluation."""
    held = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(held, "doc_id", "left_anti")
    return prepare.siblings(d, ["lang", "source"], "doc_id")


@query("disjoint_semantic_clusters")
def disjoint_semantic_clusters(spark, sf_dir):
    """Semantic clusters of the rows that no evaluation has (every tenth id is one)."""
    x = context.units(spark, sf_dir).where("id % 10 <> 0")
    return neighbours.greedy_groups(neighbours.graph(x, 8), x)


@query("authored_questions", """WITH a AS (SELECT conv_id * 100 + turn AS q, text AS question, [conv_id, conv_id + 1] AS golds, conv_id % 4 = 0 AS held FROM conversations WHERE role = 'user'), e AS (SELECT * FROM a WHERE held), x AS (SELECT DISTINCT unnest(golds) AS gold FROM e), t AS (SELECT doc_id AS id, text FROM documents WHERE lang <> 'fr'),
    l AS (SELECT q, question, unnest(golds) AS gold FROM a WHERE NOT held AND question NOT IN (SELECT question FROM e)), k AS (SELECT q, question, gold, text FROM l LEFT JOIN t ON t.id = l.gold), w AS (SELECT q FROM k WHERE text IS NULL OR gold IN (SELECT gold FROM x)),
    f AS (SELECT * FROM k WHERE q NOT IN (SELECT q FROM w)) SELECT q, question, gold, md5(text) AS digest FROM f WHERE q IN (SELECT min(q) FROM f GROUP BY question)""")  # fmt: skip
def authored_questions(spark, sf_dir):
    """User turns as questions for training, apart from those of every fourth conversation, which are the evaluation's."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    a = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("q"), F.col("text").alias("question"), F.array("conv_id", F.col("conv_id") + 1).alias("golds"), (F.col("conv_id") % 4 == 0).alias("held"))
    texts = table(spark, sf_dir, "documents").where("lang <> 'fr'").select(F.col("doc_id").alias("id"), "text")
    return retrieval.authored(a.where("NOT held"), a.where("held"), texts).select("q", "question", "gold", F.md5("text").alias("digest"))


@query("retrieval_variants", f"""WITH {_TWO}, q AS (SELECT id, label FROM u WHERE id % 100 = 0 AND label % 2 = 1), g AS (SELECT q.id AS q, min(u.id) AS id FROM q JOIN u ON u.label = q.label AND u.id <> q.id GROUP BY 1),
    v AS (SELECT 'plain' AS variant, id, v FROM u UNION ALL SELECT 'turned', id, v FROM b), c AS (SELECT 'closed' AS corpus, id, v FROM u WHERE label % 2 = 1 UNION ALL SELECT 'open', id, v FROM u),
    s AS (SELECT variant, corpus, g.q, c.id, g.id AS gold, list_dot_product(v.v, c.v) AS s FROM g JOIN v ON v.id = g.q JOIN c ON c.id <> g.q) SELECT a.variant, a.corpus, a.q, count(*) FILTER (a.s > o.s + 1e-12) + 1 AS rank FROM s a JOIN s o ON o.variant = a.variant AND o.corpus = a.corpus AND o.q = a.q AND o.id = o.gold GROUP BY 1, 2, 3""")  # fmt: skip
def retrieval_variants(spark, sf_dir):
    """Two ways to put every search, against the rows of odd labels and against all."""
    x = context.units(spark, sf_dir)
    closed = x.where("label % 2 = 1")
    q = closed.where("id % 100 = 0")
    golds = evaluate.least_golds(q, x)
    asked = lambda rows: rows.join(q.select("id"), "id", "left_semi").select("id", "vec")
    return retrieval.by_variant({"plain": x, "turned": other(spark, sf_dir)}, golds, {"closed": closed, "open": x}, asked)


_VARIANT_SQL = """{0}), rk AS (SELECT q, max(rank) FILTER (variant = 'plain') AS b, max(rank) FILTER (variant = 'turned') AS a FROM ranks WHERE corpus = 'open' GROUP BY q)"""


def _both(spark, sf_dir):
    """(q, b, a): ranks among all rows of the plain and of the turned searches."""
    r = retrieval_variants(spark, sf_dir).where("corpus = 'open'")
    pick = lambda v: F.max(F.when(F.col("variant") == v, F.col("rank")))
    return r.groupBy("q").agg(pick("plain").alias("b"), pick("turned").alias("a"))


def _ranks_cte() -> str:
    from .registered import SQL

    head, _, tail = SQL["retrieval_variants"].rpartition(" SELECT a.variant")
    return f"{head}, ranks AS (SELECT a.variant{tail}"


@query("retrieval_mcnemar", _VARIANT_SQL.format(_ranks_cte()) + """, n AS (SELECT count(*) FILTER (b > 10 AND a <= 10) AS fixed, count(*) FILTER (b <= 10 AND a > 10) AS broken FROM rk), m AS (SELECT fixed, broken, fixed + broken AS n, least(fixed, broken) AS k FROM n)
    SELECT fixed, broken, round(CASE WHEN n = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n * ln(2))) FROM range(k + 1) x(i))) END, 6) AS p FROM m""")  # fmt: skip
def retrieval_mcnemar(spark, sf_dir):
    """Searches that gain or lose a hit among the first ten when they are put otherwise, with the exact test."""
    r = evaluate.mcnemar(_both(spark, sf_dir).select((F.col("b") <= 10).alias("x"), (F.col("a") <= 10).alias("y")), "x", "y")
    return spark.createDataFrame([(r["fixed"] or 0, r["broken"] or 0, float(r["p"]))], "fixed bigint, broken bigint, p double").withColumn("p", r6("p"))


@query("retrieval_agreement", _VARIANT_SQL.format(_ranks_cte()) + """, o AS (SELECT rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS x, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS y FROM rk)
    SELECT (SELECT count(*) FROM rk) AS n, round((SELECT corr(x, y) FROM o), 6) AS rho, round((SELECT avg(CASE WHEN sign(p.b - q.b) = sign(p.a - q.a) THEN 1.0::DOUBLE ELSE 0 END) FROM rk p JOIN rk q ON p.q < q.q), 6) AS agreement""")  # fmt: skip
def retrieval_agreement(spark, sf_dir):
    """How alike the two ways order the searches by their ranks."""
    w = context.once(spark, sf_dir, "both_ranks", lambda: _both(spark, sf_dir))
    n = w.agg(F.count(F.lit(1)).alias("n"))
    return n.join(evaluate.spearman(w, "b", "a").select(r6("rho").alias("rho"))).join(evaluate.rank_agreement(w, "b", "a", "q").select(r6("agreement").alias("agreement")))


_CUT = 0.4
_ROUTED = f"""WITH RECURSIVE {UNIT}, q AS (SELECT id, label, v FROM u WHERE id % 100 = 0 AND label % 2 = 1), g AS (SELECT q.id AS q, min(u.id) AS id FROM q JOIN u ON u.label = q.label AND u.id <> q.id GROUP BY 1),
    ed AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id AND a.label % 2 = b.label % 2 AND list_dot_product(a.v, b.v) >= {_CUT}), r(id, root) AS (SELECT id, id FROM u UNION SELECT ed.b, r.root FROM r JOIN ed ON ed.a = r.id), c AS (SELECT id, min(root) AS root FROM r GROUP BY id),
    s AS (SELECT q.id AS q, u.id, u.label % 2 = 1 AS own, u.id = c.root AS stays, list_dot_product(q.v, u.v) AS s FROM q JOIN u ON u.id <> q.id JOIN c ON c.id = u.id), o AS (SELECT g.q, s.s FROM g JOIN s USING (q, id)), l AS (SELECT g.q, s.s FROM g JOIN c ON c.id = g.id JOIN s ON s.q = g.q AND s.id = c.root),
    k AS (SELECT s.q, count(*) FILTER (s.s > o.s + 1e-12) + 1 AS b1, count(*) FILTER (s.s > o.s + 1e-12 AND (own OR stays)) + 1 AS a1, count(*) FILTER (s.s > o.s + 1e-12 AND own) + 1 AS b2 FROM s JOIN o USING (q) GROUP BY 1), m AS (SELECT s.q, count(*) FILTER (s.s > l.s + 1e-12 AND own AND stays) + 1 AS a2 FROM s JOIN l USING (q) GROUP BY 1),
    w AS (SELECT 'distractors' AS arm, b1 AS b, a1 AS a FROM k UNION ALL SELECT 'corpus', b2, a2 FROM k JOIN m USING (q))
    SELECT arm, CASE arm WHEN 'corpus' THEN (SELECT count(*) FROM c JOIN u USING (id) WHERE c.id <> root AND label % 2 = 1) ELSE (SELECT count(*) FROM c JOIN u USING (id) WHERE c.id <> root AND label % 2 <> 1) END AS dropped, CAST(quantile_cont(b, 0.5) AS DOUBLE) AS median_before, CAST(quantile_cont(a, 0.5) AS DOUBLE) AS median_after,
    round(avg(CASE WHEN b <= 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_before, round(avg(CASE WHEN a <= 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_after, count(*) FILTER (b > 10 AND a <= 10) AS fixed, count(*) FILTER (b <= 10 AND a > 10) AS broken FROM w GROUP BY arm"""


@query("dedup_routing", _ROUTED)
def dedup_routing(spark, sf_dir):
    """Duplicates dropped among distractors (even labels) and in the corpus (odd ones), with the ranks before and after."""
    x = context.units(spark, sf_dir)
    own, far = x.where("label % 2 = 1"), x.where("label % 2 <> 1")
    q = own.where("id % 100 = 0")
    out = retrieval.routed(q.select("id", "vec"), evaluate.least_golds(q, x), own, far, _CUT)
    return out.select("arm", "dropped", "median_before", "median_after", r6("hit_before").alias("hit_before"), r6("hit_after").alias("hit_after"), "fixed", "broken")

