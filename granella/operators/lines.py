"""Line relations: (doc, line_no, line) from texts, filters, dedup and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line, numbered from 0. Null texts give no rows."""
    return docs.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once: a filter that keeps all rows, but can't be moved, keeps the optimiser from copying a long expression into each use."""
    return df.select(*(c for c in df.columns if c != name), value.alias(name)).filter(F.rand(0) >= 0)


def page_envelope(doc: Column, page: Column, text: Column) -> Column:
    """A page's block: rule, document, page, rule, text."""
    rule = F.lit("=" * 40)
    return F.concat_ws("\n", rule, F.concat(F.lit("DOCUMENTO: "), doc), F.concat(F.lit("PAGINA: "), page.cast("string")), rule, text)


def split_documents(text: DataFrame, column: str = "text") -> DataFrame:
    """(name, body) of the documents in an enveloped text."""
    parts = F.split(F.col(column), r"(?m)^={10,}\nDOCUMENTO: ")
    return text.select(F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("position", "part")).select(
        "position", F.substring_index("part", "\n", 1).alias("name"), F.regexp_replace(F.expr("substring(part, locate('\n', part) + 1)"), r"(?s)^PAGINA: [0-9]+\n=+\n", "").alias("body")
    )


def batch_numbers(parts: DataFrame, key: str, order: str, size: str, limit: int) -> DataFrame:
    """Greedy packing in order: a part that would lift its batch over the limit opens the next one.

    Of every part the place of the one that would open the next batch is known
    from running sums; a batch's first parts are then those that the chain of such
    places reaches from the first. A key's parts are one array of numbers; their
    texts stay where they are.
    """
    o = F.col(order).alias("o")
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(o, F.col(size).cast("long").alias("n")))).alias("rows"))
    state = F.struct(F.lit(0).alias("batch"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("starts"), F.lit(0).alias("i"))

    def step(a: Column, x: Column) -> Column:
        new = (a["used"] > 0) & (a["used"] + x["n"] > limit)
        return F.struct((a["batch"] + new.cast("int")).alias("batch"), F.when(new, x["n"]).otherwise(a["used"] + x["n"]).alias("used"), F.when(new, F.concat(a["starts"], F.array(a["i"]))).otherwise(a["starts"]).alias("starts"), (a["i"] + 1).alias("i"))

    found = rows.select(key, F.aggregate("rows", state, step, lambda a: a["starts"]).alias("s"), "rows")
    each = found.select(key, "s", F.posexplode("rows").alias("i", "x"))
    return each.select(key, F.col("x.o").alias(order), F.size(F.filter("s", lambda b: b <= F.col("i"))).alias("batch"))
