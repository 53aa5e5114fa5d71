"""File sources and sinks: documents read by an injected parser, inventories, drawings."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "doc string, page int, text string, origin string"
ELEMENTS = "doc string, page int, kind string, idx int, x0 double, top double, x1 double, bottom double, text string"

#: Bands of a large page that are recognised on their own (name, x0, y0, x1, y1 as shares), and sizes.
BANDS = (("direita", 0.78, 0.0, 1.0, 1.0), ("inferior_direita", 0.70, 0.55, 1.0, 1.0), ("inferior", 0.0, 0.70, 1.0, 1.0))
LARGE_PAGE, BAND_DPI, ANCHOR_DPI, LEAST_CHARS = 1_500_000, 80, 200, 80
#: What shows that a recognised page is about the project's body.
PROJECT_BODY = r"(?iU)APTOS?|APARTAMENTOS?|PAVIMENTOS?|PAV\.?\s*TIPO|TOTAL\s+DE\s+VAGAS|\d+\s*[xX×]\s*\d+\s*APTOS"


def binary_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def read_pages(files: DataFrame, parser: Callable[[bytes], Iterable[tuple[int, str, str]]]) -> DataFrame:
    """(doc, page, text, origin): parser gives (page, text, origin) of a file's bytes. A file that fails is logged and gives no pages; blank pages are left out."""
    import pandas as pd

    def run(batches):
        log = logging.getLogger(__name__)
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows = [(path, *row) for row in parser(bytes(content)) if row[1] and row[1].strip()]
                except Exception as e:  # noqa: BLE001  a parser's errors are of any kind
                    log.warning("%s: %s", path, e)
                    continue
                if rows:
                    yield pd.DataFrame(rows, columns=["doc", "page", "text", "origin"])

    return files.select("path", "content").mapInPandas(run, PAGES)


def read_elements(files: DataFrame, parser: Callable[[bytes], Iterable[tuple]], most_pages: int | None = None) -> DataFrame:
    """Vector elements of drawings: parser gives (page, kind, idx, x0, top, x1, bottom, text)."""
    import pandas as pd

    def run(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows = [(path, *row) for row in parser(bytes(content)) if most_pages is None or row[0] <= most_pages]
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in ELEMENTS.split(", ")])

    return files.select("path", "content").mapInPandas(run, ELEMENTS)


def document_text(pages: DataFrame) -> DataFrame:
    """(doc, text): a document's pages in order, joined by line breaks."""
    rows = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("doc").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("text"))


def join_texts(*parts):
    """Non-blank texts of a page, joined by an empty line."""
    return F.array_join(F.filter(F.array(*parts), lambda x: F.coalesce(F.trim(x) != "", F.lit(False))), "\n\n")


def large_page(width, height):
    return width * height > LARGE_PAGE


def has_project_body(text):
    """True for a recognised text that mentions units, floors or parking."""
    return F.coalesce(text.rlike(PROJECT_BODY), F.lit(False))


def needs_recognition(text, least: int = LEAST_CHARS):
    """True for a page whose own text is too short to be all of it."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < least


def band_text(bands: DataFrame, key: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """(doc, page, text): recognised bands (band, text) under their names, in the bands' order; blank ones are left out."""
    rank = F.array_position(F.array(*(F.lit(b[0]) for b in BANDS)), F.col("band"))
    part = F.concat(F.lit("OCR_REGIAO: "), F.col("band"), F.lit("\n"), F.trim("text"))
    rows = F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct(rank.alias("r"), part.alias("t")))))
    return bands.groupBy(*key).agg(F.array_join(F.transform(rows, lambda x: x["t"]), "\n\n").alias("text"))


def page_bands(pages: DataFrame) -> DataFrame:
    """(.., band, x0, y0, x1, y1) of large pages (width, height): a fixed dimension of three rows."""
    bands = F.explode(F.array(*(F.struct(F.lit(n).alias("band"), *(F.lit(v).alias(c) for c, v in zip(("a", "b", "c", "d"), box, strict=True))) for n, *box in BANDS)))
    p = pages.filter(large_page(F.col("width"), F.col("height"))).select("*", bands.alias("_b"))
    return p.select(*pages.columns, "_b.band", (F.col("width") * F.col("_b.a")).alias("x0"), (F.col("height") * F.col("_b.b")).alias("y0"), (F.col("width") * F.col("_b.c")).alias("x1"), (F.col("height") * F.col("_b.d")).alias("y1"))


def anchor_crops(words: DataFrame, dpi: int = 200) -> DataFrame:
    """Pixel boxes around wet-room words (word, x0, top, x1, bottom, width, height): grown by fixed margins, clamped, scaled."""
    px = lambda c: (c * dpi / 72).cast("int")
    hit = words.filter(F.upper(F.trim("word")).isin("BWC", "BANHO"))
    return hit.withColumns({
        "left": px(F.greatest(F.col("x0") - 50, F.lit(0.0))),
        "upper": px(F.greatest(F.col("top") - 35, F.lit(0.0))),
        "right": px(F.least(F.col("x1") + 130, F.col("width"))),
        "lower": px(F.least(F.col("bottom") + 70, F.col("height"))),
    })


def boxes(elements: DataFrame) -> DataFrame:
    """elements with centre (three places), and box and centre as shares of the page (six places); width and height are columns."""
    third = lambda c: F.round(c, 3)
    share = lambda c, of: F.when(F.col(of) > 0, F.round(c / F.col(of), 6))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    return elements.withColumns({"cx": third(cx), "cy": third(cy), "nx0": share(F.col("x0"), "width"), "nx1": share(F.col("x1"), "width"), "ntop": share(F.col("top"), "height"), "nbottom": share(F.col("bottom"), "height"), "ncx": share(cx, "width"), "ncy": share(cy, "height")})


def inventory(elements: DataFrame) -> DataFrame:
    """(doc, page, texts, lines, rects, curves, elements) counts of elements (doc, page, kind) by page, and of each document (page null)."""
    of = lambda kind: F.sum((F.col("kind") == kind).cast("long")).alias(f"{kind}s")
    return elements.groupingSets([("doc", "page"), ("doc",)], "doc", "page").agg(*(of(k) for k in ("text", "line", "rect", "curve")), F.count("*").alias("elements"))


def colour(value):
    """A colour of numbers or of one number as a list of numbers with four places; null for others."""
    numbers = F.regexp_extract_all(value, F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return F.when(F.size(numbers) > 0, F.transform(numbers, lambda x: F.round(x.cast("double"), 4)))


def write_json(df: DataFrame, path: str, by: str = "doc", folders: int = 0) -> None:
    """One JSON line per row; a document's rows are in one file. With folders, in so many folders by a hash of the document."""
    if folders:
        df = df.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(folders)))
        df.repartition("bucket").sortWithinPartitions(by).write.mode("overwrite").partitionBy("bucket").json(path)
    else:
        df.repartition(by).sortWithinPartitions(by).write.mode("overwrite").json(path)


def svg_name(stem, page, kind: str = "debug"):
    """`stem.p003.debug.svg`, the stem without its extension and `.geometria`, `.classificada` or `.regioes`."""
    plain = F.regexp_replace(F.regexp_replace(stem, r"\.[A-Za-z0-9]+$", ""), r"\.(geometria|classificada|regioes)$", "")
    return F.format_string(f"%s.p%03d.{kind}.svg", plain, page.cast("int"))


def write_svgs(pages: DataFrame, path: str) -> None:
    """(name, svg) rows as JSON lines; a page's drawing is one value."""
    pages.select("name", "svg").write.mode("overwrite").json(path)
