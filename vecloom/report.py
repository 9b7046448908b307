"""The report: chosen views of one embedding, or of two, as a page of HTML; and the verbs diagnose and report."""

from __future__ import annotations

import html
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import COMPARED, PAIRWISE, VIEWS, Config
from .operators import occupancy, sampling, schema
from .operators.moments import moments
from .plans import context, profile
from .sources.readers import read_vectors
from .sources.scratch import folder

ROWS = 200


@dataclass
class Report:
    page: str
    shown: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)


def diagnose(spark: SparkSession, source, config: Config = Config()) -> DataFrame:
    rows = schema.checked(read_vectors(spark, source, config.vector, config.id, config.label))
    pairs = sampling.pair_cosines(schema.unit(rows), config.pairs)
    return profile.diagnosis(spark, moments(rows), occupancy.summary(pairs).first())


def histogram(spark: SparkSession, source, config: Config = Config(), width: int = 40) -> str:
    """The pair cosines as lines of text."""
    rows = schema.unit(read_vectors(spark, source, config.vector, config.id, config.label))
    bin = F.least(F.floor((F.col("cos") + 1) * 10), F.lit(19)).cast("int")
    n = {r["b"]: r["n"] for r in sampling.pair_cosines(rows, config.pairs).groupBy(bin.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    most = max(n.values(), default=1)
    return "\n".join(f"{b / 10 - 1:+.1f} {'#' * round(width * n.get(b, 0) / most)}" for b in range(20) if b in n)


def table(df: DataFrame, rows: int = ROWS) -> str:
    """An HTML table of the first rows; says so where there are more."""
    got = df.limit(rows + 1).collect()
    cell = lambda v: html.escape(f"{v:.6g}" if isinstance(v, float) else str(v))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in got[:rows])
    return f"<table><tr>{head}</tr>{body}</table>" + (f"<p>The first {rows} rows.</p>" if len(got) > rows else "")


def _prepared(spark: SparkSession, source, config: Config, compare) -> tuple[str, str]:
    """Folders with the vectors as the catalogue reads them: all rows, and the sample for views of all pairs."""
    rows = schema.checked(read_vectors(spark, source, config.vector, config.id, config.label))
    named = lambda x: x.select(F.col("id").alias("vec_id"), F.col("vec").alias("embedding"), "label")
    whole, part = folder(spark), folder(spark)
    named(rows).write.parquet(f"{whole}/embeddings.parquet")
    kept = spark.read.parquet(f"{whole}/embeddings.parquet")
    small = sampling.sample(kept, config.sample, config.seed, "vec_id")
    small.write.parquet(f"{part}/embeddings.parquet")
    if compare is not None:
        from .operators.compare import checked_align

        second = schema.checked(read_vectors(spark, compare, config.vector, config.id, config.label))
        checked_align(rows, second)
        text = F.col("vec_id").cast("string")
        own = named(second)
        own.write.parquet(f"{whole}/compare.parquet")
        ids = spark.read.parquet(f"{part}/embeddings.parquet").select(text.alias("_k"))
        spark.read.parquet(f"{whole}/compare.parquet").join(ids, text == F.col("_k"), "left_semi").write.parquet(f"{part}/compare.parquet")
    for at in (whole, part):
        context.given[at] = config
    return whole, part


def report(spark: SparkSession, source, config: Config = Config(), path: str | None = None, compare=None) -> Report:
    """Run every view that the settings show over any source of vectors; one that fails is named and left out.

    compare: a second embedding of the same items, whose views are then shown too. Views of all pairs take
    `sample` rows at most, the others all. A folder with `embeddings` as the catalogue has it is a source too.
    """
    from .plans.catalogue import QUERIES

    whole, part = _prepared(spark, source, config, compare)
    out, parts = Report(""), []
    for name in [*VIEWS, *COMPARED]:
        shown = config.shows(name) if name in VIEWS else compare is not None and config.views.get(name, True)
        if not shown or name not in QUERIES:
            continue
        try:
            parts.append(f"<section><h2>{name.replace('_', ' ')}</h2>{table(QUERIES[name](spark, part if name in PAIRWISE or name in COMPARED else whole))}</section>")
            out.shown.append(name)
        except Exception as e:  # noqa: BLE001  one view's failure leaves the others
            out.failed[name] = str(e).splitlines()[0][:300]
    notes = "".join(f"<p>{html.escape(k)}: {html.escape(v)}</p>" for k, v in out.failed.items())
    style = "body{font:14px sans-serif;margin:2em}td,th{padding:2px 8px;text-align:right}"
    out.page = f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(config.title)}</title><style>{style}</style></head><body><h1>{html.escape(config.title)}</h1>{''.join(parts)}{notes}</body></html>"
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(out.page)
    return out
