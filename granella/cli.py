"""Command lines of the runs: python -m granella.cli COMMAND INPUT OUTPUT."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from granella.operators import prices as PR
from granella.plans import documents as D
from granella.plans import drawings as W
from granella.plans import prefilter as P
from granella.session import get_spark

_SEGMENT = "page int, idx long, x0 double, y0 double, x1 double, y1 double"
_TEXT, _SHAPE = "page int, px double, py double, label string", "page int, kind string, x0 double, top double, x1 double, bottom double"
_PAGE = "doc string, page int, text string"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="granella")
    every = out.add_subparsers(dest="command", required=True)
    for name, told in (("texts", "pages to texts"), ("prefilter", "pages to reduced texts"), ("records", "pages to records, validation and cells"), ("prices", "texts of price tables to prices"), ("drawings", "segments to classes, cells, regions, composites and overlays")):
        one = every.add_parser(name, help=told)
        one.add_argument("input", help="a folder of JSON lines")
        one.add_argument("output", help="a folder to write to")
        if name in ("prefilter", "records"):
            one.add_argument("--limit", type=int, default=P.LIMIT if name == "prefilter" else 0, help="characters that a reduced text may have")
        if name == "records":
            one.add_argument("--prices", help="a file with one JSON object of prices by type")
        if name == "drawings":
            one.add_argument("--texts", help="a folder of texts (page, px, py, label)")
            one.add_argument("--shapes", help="a folder of rectangles and curves (page, kind, x0, top, x1, bottom)")
    return out


def _prices(spark: SparkSession, path: str | None) -> dict[str, float]:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path).collect())) if path else {}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or get_spark()
    out: dict = {}
    if a.command in ("texts", "prefilter", "records"):
        pages = spark.read.schema(_PAGE).json(a.input)
        if a.command == "texts":
            out = {"texts": D.texts_of(pages)}
        elif a.command == "prefilter":
            out = {"texts": P.prefilter(D.texts_of(pages), a.limit)}
        else:
            run = D.run(pages, _prices(spark, a.prices), a.limit or None)
            out = {"records": run.records, "validation": run.validation, "cells": run.cells}
    elif a.command == "prices":
        out = {"prices": PR.price_table(spark.read.schema("doc string, text string").json(a.input))}
    else:
        empty = lambda schema: spark.createDataFrame([], schema)
        texts = spark.read.schema(_TEXT).json(a.texts) if a.texts else empty(_TEXT)
        shapes = spark.read.schema(_SHAPE).json(a.shapes) if a.shapes else empty(_SHAPE)
        run = W.run(spark.read.schema(_SEGMENT).json(a.input), texts, shapes)
        out = {"classified": run.classified, "shapes": run.shapes, "cells": run.cells, "regions": run.regions, "composites": run.composites, "overlays": run.overlays}
    for name, table in out.items():
        table.write.mode("overwrite").json(f"{a.output}/{name}")


if __name__ == "__main__":
    main()
