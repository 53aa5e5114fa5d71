"""Relations of what documents (doc, text) state: units, floors, parking; and choices among candidates (doc, line_no, ..)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granella.functions import patterns as P
from granella.functions import text as T
from granella.operators import project as J


def units(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """Distinct (area, qty) of the unit lines of each document, and the highest floor of its typical floors.

    Only texts that mention units are looked at by line.
    """
    some = docs.filter(P.has(F.col(text), P.MENTIONS["aptos"])).select(key, P.lines_of(F.col(text)).alias("l"))
    tops = F.transform(F.filter(F.col("l"), lambda x: P.has(x, P.TYPICAL_LINE)), lambda x: F.zip_with(P.hits(x, P.FLOOR_RANGE, 1), P.hits(x, P.FLOOR_RANGE, 2), lambda a, b: F.greatest(T.floor_number(a), T.floor_number(b))))
    rows = some.select(key, F.explode(J.units(F.col("l"))).alias("u"), F.coalesce(F.array_max(F.flatten(tops)), F.lit(0)).alias("top"))
    return rows.select(key, "u.area", "u.qty", "top")


def unit_totals(units_: DataFrame, key: str = "doc") -> DataFrame:
    """Units, distinct kinds, private area and typical-floor area of each document."""
    return units_.groupBy(key).agg(
        F.count("*").alias("kinds"),
        F.sum("qty").alias("units"),
        F.round(F.sum(F.col("area") * F.col("qty")), 2).alias("area_total"),
        F.max("top").alias("floors"),
        F.when(F.max("top") > 0, F.round(F.round(F.sum(F.col("area") * F.col("qty")), 3) / F.max("top"), 3)).alias("typical_area"),
    )


def floor_count(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    return docs.select(key, J.floor_count(F.col(text)).alias("floors"))


def parking(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """Most common and double spaces that a text states, and the garages' text of both."""
    got = docs.select(key, J.spaces(F.col(text), P.COMMON_SPACES).alias("common"), J.spaces(F.col(text), P.DOUBLE_SPACES).alias("double"))
    return got.withColumn("text", J.garages(F.col("common"), F.col("double")))


def best_permit(candidates: DataFrame, key: str = "doc") -> DataFrame:
    """The permit spelling with the most points of each document, the first of equals; none if the best is below zero."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "line_no"))
    best = candidates.withColumn("score", T.admin_number_score(F.col("permit")).cast("int")).withColumn("rn", rn).filter("rn = 1")
    return best.select(key, F.when(F.col("score") < 0, "").otherwise(F.col("permit")).alias("permit"), "score")


def nearest_date(lines: DataFrame, reach: int = 2, key: str = "doc") -> DataFrame:
    """The valid date nearest an approval line, after it rather than before, then the first; without one the first date.

    lines: (key, line_no, date string or null, anchor boolean). Two running
    windows find the nearest anchors, so there is no join of lines with lines.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    at = F.when(F.col("anchor"), F.col("line_no"))
    before = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(at, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    d = lines.withColumns({"_b": F.col("line_no") - before, "_a": after - F.col("line_no")}).filter("date is not null")
    dist = F.least(F.coalesce("_b", F.lit(1 << 30)), F.coalesce("_a", F.lit(1 << 30)))
    rank = F.struct(F.when(dist <= reach, dist).otherwise(reach + 1).alias("d"), F.when(dist <= reach, (F.coalesce("_b", F.lit(1 << 30)) > dist).cast("int")).otherwise(0).alias("side"), F.col("line_no"))
    return d.groupBy(key).agg(F.min_by("date", rank).alias("date"), F.min(rank).alias("r")).select(key, "date", F.least(F.col("r.d"), F.lit(reach + 1)).cast("int").alias("distance"))
