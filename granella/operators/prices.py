"""Price tables from page texts: prices by type, month of reference, the table's file, and the context for a model."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granella.functions.patterns import ci, hit, hits, let, lines_of
from granella.functions.text import format_brl, parse_br_number, squeeze_spaces

#: Types whose rows name themselves, and labels of rows with three standards.
LITERAL = ("R1-B", "R1-N", "R1-A", "R1-AL", "R4-B", "R4-N", "R4-A", "R4-AL", "PP-4", "PP-B", "PIS", "CSL-8", "CSL-16", "CAL-8", "GI", "GI-P", "GI-G")
TRIPLE = (("R-1", "R1"), ("PP-4", "PP4"), ("R-8", "R8"), ("R-16", "R16"))
STANDARDS = ("B", "N", "A")
_MONEY = r"[:\s]+(?:R\$\s*)?(\d{1,3}(?:[.\s]\d{3})*,\d{2})"
#: Months, the union, and where tables stand.
MONTHS = ("Janeiro", "Fevereiro", "Marco", "Abril", "Maio", "Junho", "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro")
MONTH = r"(janeiro|fevereiro|mar[cç]o|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)\s*[/,]?\s*(?:de\s+)?(\d{4})"
UNION = "SINDUSCON NORTE PR"
TABLE_LINK = r"https://cdn\.prod\.website-files\.com/[^\s\"'<>]+CUB[^\s\"'<>]*\.pdf"


def _literal(text: Column) -> Column:
    """(type, price) of the literal types that a text states, the first price of each."""
    price = lambda t: F.nullif(hit(text, rf"\b{re.escape(t)}\b{_MONEY}"), F.lit(""))
    return F.array(*(F.struct(F.lit(t).alias("type"), parse_br_number(F.replace(price(t), F.lit(" "), F.lit(""))).alias("price"), price(t).isNotNull().alias("there")) for t in LITERAL))


def _triple(text: Column) -> Column:
    """(type, price) of rows that repeat a label three times: simple, normal and high standard."""

    def of_line(line: Column) -> Column:
        rows = []
        for name, prefix in TRIPLE:
            found = hits(squeeze_spaces(line), rf"{re.escape(name)}\s+([\d.,]+)")
            rows += [F.when(F.size(found) >= 3, F.struct(F.lit(f"{prefix}-{s}").alias("type"), parse_br_number(F.get(found, F.lit(i))).alias("price"))) for i, s in enumerate(STANDARDS)]
        return F.array_compact(F.array(*rows))

    return F.flatten(F.transform(F.filter(lines_of(text), lambda x: x.rlike("(?i)R-1|PP-4|R-8")), of_line))


def price_rows(text: Column) -> Column:
    """Array of (type, price): literal types in their order, then those of triple rows; a later price of a type replaces an earlier one."""
    literal = F.transform(F.filter(_literal(text), lambda x: x["there"]), lambda x: F.struct(x["type"].alias("type"), x["price"].alias("price")))
    every = F.concat(literal, _triple(text))
    last = lambda rows, t: F.element_at(F.filter(rows, lambda y: y["type"] == t), -1)["price"]
    return let(every, lambda rows: F.transform(F.array_distinct(F.transform(rows, lambda x: x["type"])), lambda t: F.struct(t.alias("type"), last(rows, t).alias("price"))))


def price_table(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """(doc, position, type, price) of texts (doc, text)."""
    return docs.select(key, F.posexplode(price_rows(F.coalesce(F.col(text), F.lit("")))).alias("position", "x")).select(key, "position", "x.type", "x.price")


def as_dict(prices: DataFrame) -> dict[str, float]:
    """One table's prices by type, in order: a few dozen at most, as the types are fixed."""
    return {r["type"]: r["price"] for r in prices.orderBy("position").collect()}


def reference_month(text: Column, file: Column) -> Column:
    """`Janeiro/2026` as the text states it, else the month before the one in the file's name, else the empty string."""
    stated = F.when(hit(text, MONTH, 2) != "", F.concat(F.initcap(F.lower(hit(text, MONTH, 1))), F.lit("/"), hit(text, MONTH, 2)))
    year, month = (F.regexp_extract(file, r"(?i)(\d{4})_(\d{2})_CUB", i).try_cast("int") for i in (1, 2))
    names = F.array(*map(F.lit, MONTHS))
    before = F.when(month > 1, F.concat(F.get(names, month - 2), F.lit("/"), year.cast("string"))).otherwise(F.concat(F.get(names, F.lit(11)), F.lit("/"), (year - 1).cast("string")))
    return F.coalesce(stated, F.when(month.isNotNull(), before), F.lit(""))


def table_link(html: Column, fallback: str = "") -> Column:
    """The first link to a table that isn't the exempted one, else the fallback."""
    links = F.filter(F.regexp_extract_all(html, F.lit(ci(TABLE_LINK)), F.lit(0)), lambda x: ~F.contains(F.replace(F.upper(x), F.lit("%20"), F.lit(" ")), F.lit("DES")))
    return F.coalesce(F.get(links, F.lit(0)), F.lit(fallback))


def context(rows: Column, month: Column, link: Column, text: Column, most: int = 4000) -> Column:
    """What a model is told of a table: source, month and prices, or the beginning of its text."""
    head = F.concat(F.lit(f"Sindicato: {UNION}\nMes de referencia: "), month, F.lit("\nFonte: "), link, F.lit("\n"))
    prices = F.array_join(F.transform(rows, lambda x: F.concat(F.lit("  "), x["type"], F.lit(": R$ "), format_brl(x["price"]))), "\n")
    told = F.concat(F.lit("Valores CUB (R$/m2):\n"), prices, F.lit("\n\nInstrucao: preencha quadro3.sindicato, quadro3.mesCub e quadro3.valorCub\ncom o tipo CUB que melhor corresponde ao projeto identificado nos documentos.\nPara residencial multifamiliar padrao normal use R1-N ou R4-N conforme o porte."))
    return F.concat(head, F.when(F.size(rows) > 0, told).otherwise(F.concat(F.lit("Texto do documento CUB (extraia os valores diretamente):\n"), F.left(text, F.lit(most)))))


NO_CONTEXT = "(CUB nao disponivel — deixe valorCub=0 e registre em _dados_faltantes)"
