"""Preparation of texts: filters, splits and joins over documents, pages, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prepare
from .registered import query, table


@query("doc_regex_flags", r"""SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') AS has_mail, regexp_matches(text, '\b[0-9]{16}\b') AS has_card, regexp_matches(text, '[Ll]icen[sc]e') AS has_license FROM documents""")
def doc_regex_flags(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", t.rlike(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+").alias("has_mail"), t.rlike(r"\b[0-9]{16}\b").alias("has_card"), t.rlike("[Ll]icen[sc]e").alias("has_license"))


@query("leak_filter", r"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '§|\bC\.?F\.?R\b|\bU\.?S\.?C\b|(?i:\bpart\s+\d+|\bsection\s+\d+|\bversion\s+\d+)')")
def leak_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(~prepare.leaks(F.col("text"))).select("doc_id")


@query("holdout_antijoin", "SELECT doc_id FROM documents d WHERE doc_id NOT IN (SELECT item_id FROM benchmark) AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text)")
def holdout_antijoin(spark, sf_dir):
    held = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return prepare.without(table(spark, sf_dir, "documents").select("doc_id", "text"), held, "doc_id", "text").select("doc_id")


@query("question_cleaning", r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(text, '^[\s"'']*(?:\d+[.)]\s*)?', ''), '["'']+\s*$', ''), '\s+', ' ', 'g'), ' ') AS question FROM conversations""")
def question_cleaning(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prepare.cleaned(F.col("text")).alias("question"))


@query("text_items", "SELECT CAST(doc_id AS VARCHAR) AS id, md5(concat_ws(chr(10), nullif(source, ''), text)) AS digest FROM documents")
def text_items(spark, sf_dir):
    return prepare.items(table(spark, sf_dir, "documents"), ["id", "_id", "doc_id"], ["title", "source"], ["contents", "text"]).select("id", F.md5("text").alias("digest"))


@query("citation_match", r"""WITH p AS (SELECT page_id, regexp_extract(url, '/([a-z]{2})/', 1) AS lang, TRY_CAST(regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1) AS BIGINT) AS n FROM pages), o AS (SELECT lang, n FROM p GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT d.doc_id, p.page_id FROM documents d JOIN p ON d.lang = p.lang AND d.doc_id = p.n JOIN o ON o.lang = p.lang AND o.n = p.n""")  # fmt: skip
def citation_match(spark, sf_dir):
    url = F.col("url")
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, "/([a-z]{2})/", 1).alias("lang"), F.expr("try_cast(regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1) AS BIGINT)").alias("n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("doc_id").alias("n"))
    return prepare.matched(docs, pages, ["lang", "n"]).select("doc_id", "page_id")


@query("citation_questions", r"""WITH p AS (SELECT page_id, regexp_extract(url, '/([a-z]{2})/', 1) AS lang, TRY_CAST(regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1) AS BIGINT) AS n FROM pages), o AS (SELECT lang, n FROM p GROUP BY 1, 2 HAVING count(*) = 1), q AS (SELECT doc_id, lang, trim(regexp_replace(regexp_replace(regexp_replace(left(text, 80), '^[\s"'']*(?:\d+[.)]\s*)?', ''), '["'']+\s*$', ''), '\s+', ' ', 'g'), ' ') AS question FROM documents),
    m AS (SELECT q.doc_id, q.lang, question, p.page_id, row_number() OVER (PARTITION BY q.lang ORDER BY q.doc_id) AS r FROM q JOIN p ON q.lang = p.lang AND q.doc_id = p.n JOIN o ON o.lang = p.lang AND o.n = p.n WHERE NOT regexp_matches(question, '§|\bC\.?F\.?R\b|\bU\.?S\.?C\b|(?i:\bpart\s+\d+|\bsection\s+\d+|\bversion\s+\d+)'))
    SELECT doc_id, lang, question, page_id FROM m WHERE r <= 5""")  # fmt: skip
def citation_questions(spark, sf_dir):
    """Questions led to the one page they cite: matched, cleaned, without those that give it away, five a language."""
    from ..operators import sampling

    found = citation_match(spark, sf_dir)
    q = table(spark, sf_dir, "documents").select("doc_id", "lang", prepare.cleaned(F.substring("text", 1, 80)).alias("question"))
    kept = q.join(found, "doc_id").where(~prepare.leaks(F.col("question")))
    return sampling.capped(kept, ["lang"], [F.col("doc_id")], 5).select("doc_id", "lang", "question", "page_id")


@query("distractors", "SELECT CAST(item_id AS BIGINT) AS id, 'gold' AS role FROM benchmark UNION ALL SELECT doc_id, 'distractor' FROM documents WHERE source <> 'src3'")
def distractors(spark, sf_dir):
    gold = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("bigint").alias("id"), F.lit("").alias("source"))
    corpus = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return prepare.with_distractors(gold, corpus, "source", "src3").select("id", "role")


@query("sibling_clusters", "SELECT doc_id, lang, source FROM (SELECT doc_id, lang, source, count(*) OVER (PARTITION BY lang, source) AS n, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents) WHERE n >= 2 AND r <= 2")
def sibling_clusters(spark, sf_dir):
    return prepare.siblings(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id")


@query("dense_ids", "SELECT doc_id, source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS BIGINT) AS number FROM documents")
def dense_ids(spark, sf_dir):
    return prepare.dense_ids(table(spark, sf_dir, "documents").select("doc_id", "source"), "source").select("doc_id", "source", "number")


@query("text_canonical", r"WITH k AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n\r]+', ' ', 'g'), ' ') AS k FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS canonical FROM k")
def text_canonical(spark, sf_dir):
    return prepare.canonical(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("canonical_remap", r"""WITH k AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n\r]+', ' ', 'g'), ' ') AS k FROM documents), c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS canonical FROM k)
    SELECT l.doc_id, coalesce(c.canonical, l.doc_id) AS gold, quality FROM labels l LEFT JOIN c USING (doc_id)""")  # fmt: skip
def canonical_remap(spark, sf_dir):
    c = text_canonical(spark, sf_dir)
    return table(spark, sf_dir, "labels").join(c, "doc_id", "left").select("doc_id", F.coalesce("canonical", "doc_id").alias("gold"), "quality")


@query("qrels_lines", "SELECT CAST(doc_id AS VARCHAR) AS q, source AS id, CAST(length(lang) AS INTEGER) AS rel FROM documents")
def qrels_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    four = F.concat_ws(" ", F.col("doc_id").cast("string"), F.lit("0"), "source", F.length("lang").cast("string"))
    three = F.concat_ws("\t", F.col("doc_id").cast("string"), "source", F.length("lang").cast("string"))
    return prepare.judgements(d.select(F.when(F.col("doc_id") % 2 == 0, four).otherwise(three).alias("value")))
