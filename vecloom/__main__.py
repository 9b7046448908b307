"""python -m vecloom info SOURCE | report SOURCE OUT | embed TEXTS OUT URL MODEL"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import Config


def settings(a: argparse.Namespace) -> Config:
    own = {k: v for k in ("vector", "id", "label", "metric", "sample", "pairs", "k", "seed", "title") if (v := getattr(a, k, None)) is not None}
    views = {v: True for v in a.show or []} | {v: False for v in a.hide or []}
    return Config().merged(a.config).merged(own | {"views": views})


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb, args in (("info", ["source"]), ("report", ["source", "out"]), ("embed", ["source", "out", "url", "model"])):
        v = verbs.add_parser(verb)
        for a in args:
            v.add_argument(a)
        v.add_argument("--config", default="{}", help="JSON of settings")
        for name in ("vector", "id", "label", "title"):
            v.add_argument(f"--{name}")
        v.add_argument("--metric", choices=("cosine", "euclidean"))
        for name in ("sample", "pairs", "k", "seed"):
            v.add_argument(f"--{name}", type=int)
        v.add_argument("--show", action="append", help="a view to show")
        v.add_argument("--hide", action="append", help="a view to leave out")
        if verb == "report":
            v.add_argument("--compare", help="a second embedding of the same items")
        if verb == "embed":
            v.add_argument("--text", default="text", help="the column of texts")
            v.add_argument("--prefix", default="")
            v.add_argument("--batch", type=int, default=64)
    return p


def main() -> None:
    a = parser().parse_args()
    spark = SparkSession.builder.appName("vecloom").getOrCreate()
    config = settings(a)
    if a.verb == "info":
        from .report import diagnose, histogram

        for k, v in diagnose(spark, a.source, config).first().asDict().items():
            print(f"{k:>20}  {v}")
        print(histogram(spark, a.source, config))
    elif a.verb == "report":
        from .report import report

        r = report(spark, a.source, config, a.out, a.compare)
        print(f"{len(r.shown)} views in {a.out}; failed: {r.failed or 'none'}")
    else:
        from .sources.embed import Endpoint, embed_to
        from .sources.readers import read_texts

        embed_to(read_texts(spark, a.source, a.text, a.id, a.label), Endpoint(a.url, a.model), a.out, a.batch, a.prefix)


if __name__ == "__main__":
    main()
