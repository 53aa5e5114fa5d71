"""Texts of evidence within limits: blocks of sections and candidates, what a model's prompt gets of them, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granella.functions.patterns import let, lines_of
from granella.operators import finishes as FI

#: Where critical evidence begins and ends, the order in which sections lose lines, and limits.
EVIDENCE_START, EVIDENCE_END = "EVIDENCIAS CRITICAS EXTRAIDAS DO TEXTO ORIGINAL:", "\n\nTEXTO FILTRADO COMPLEMENTAR:"
CRITICAL_LIMIT, PROMPT_LIMIT = 12_000, 60_000
_MARKERS = tuple(FI.SECTION_HEADS.values())
_GAP = "\n\n"


def _right(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)\s+$", "")


def _strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def _cut_at(s: Column, mark: str, limit: Column | int, least: float) -> Column:
    """A text up to the last mark within the limit, if that keeps the least share of it, else up to the limit."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    head = F.left(s, limit)
    at = F.instr(F.reverse(head), mark[::-1])
    place = F.when(at > 0, F.length(head) - at - len(mark) + 1).otherwise(-1)
    return F.when(place < limit * least, head).otherwise(F.left(s, place))


def critical_evidence(text: Column, limit: int = CRITICAL_LIMIT) -> Column:
    """The critical evidence of a text of reduced documents: the parts between the marks, the heading once; cut at a line break."""
    parts = F.transform(F.slice(F.split(text, F.lit(EVIDENCE_START)), F.lit(2), F.lit(1 << 30)), lambda p: _strip(F.substring_index(p, EVIDENCE_END, 1)))
    joined = F.when(F.size(parts) > 0, _strip(F.concat(F.lit(EVIDENCE_START + "\n"), F.array_join(F.filter(parts, lambda p: p != ""), "\n")))).otherwise("")
    return let(joined, lambda s: F.when(F.length(s) <= limit, s).otherwise(_right(_cut_at(s, "\n", limit, 0.7))))


def section_parts(block: Column) -> Column:
    """(marker, line) of a block of sections, in order; lines before the first marker are left out."""

    def parsed(rows: Column) -> Column:
        marker = F.transform(rows, lambda x, i: F.when(F.trim(x).isin(*_MARKERS), i))
        last = F.transform(rows, lambda x, i: F.array_max(F.filter(marker, lambda m: m <= i)))
        pairs = F.zip_with(rows, last, lambda x, m: F.struct(F.trim(F.get(rows, m)).alias("marker"), x.alias("line")))
        return F.filter(pairs, lambda p: p["marker"].isNotNull() & ~F.trim(p["line"]).isin("", FI.HEAD_SECTIONS, *_MARKERS))

    return let(lines_of(block), parsed)


def markers(block: Column) -> Column:
    """The markers of a block, each once, in order."""
    return F.array_distinct(F.filter(F.transform(lines_of(block), F.trim), lambda x: x.isin(*_MARKERS)))


def _of_marker(parts: Column, marker: str) -> Column:
    return F.filter(parts, lambda p: p["marker"] == marker)


def rebuilt(present: Column, parts: Column) -> Column:
    """A block of the markers with their lines."""
    of = lambda m: F.transform(F.filter(parts, lambda p: p["marker"] == m), lambda p: p["line"])
    return F.concat(F.lit(FI.HEAD_SECTIONS), F.array_join(F.transform(present, lambda m: F.concat(F.lit(_GAP), F.array_join(F.concat(F.array(m), of(m)), "\n"))), ""))


def cut_section_block(block: Column, limit: Column | int) -> Column:
    """A block within a limit: lines go from the end of the first section, then of the second, then of the third; headings stay.

    So what stays is the longest run of lines in the order of sections turned
    round, each from its beginning, that fits beside the headings.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit
    plain = _strip(block)

    def cut(x: Column) -> Column:
        present, parts = x["m"], x["p"]
        placed = F.transform(parts, lambda p, i: F.struct(p["marker"].alias("marker"), p["line"].alias("line"), i.alias("i")))
        order = F.flatten(F.array(*(_of_marker(placed, m) for m in reversed(_MARKERS))))
        bare = rebuilt(present, F.array().cast("array<struct<marker:string,line:string>>"))
        start = F.struct(F.length(bare).alias("used"), F.lit(0).alias("n"), F.lit(False).alias("full"))

        def step(a: Column, p: Column) -> Column:
            full = a["full"] | (a["used"] + F.length(p["line"]) + 1 > limit)
            return F.struct(F.when(full, a["used"]).otherwise(a["used"] + F.length(p["line"]) + 1).alias("used"), F.when(full, a["n"]).otherwise(a["n"] + 1).alias("n"), full.alias("full"))

        kept = let(F.aggregate(order, start, step), lambda a: F.transform(F.array_sort(F.transform(F.slice(order, F.lit(1), a["n"]), lambda p: F.struct(p["i"].alias("i"), p["marker"].alias("marker"), p["line"].alias("line")))), lambda p: F.struct(p["marker"].alias("marker"), p["line"].alias("line"))))
        return F.when(F.size(present) == 0, F.left(x["b"], limit)).otherwise(let(kept, lambda k: rebuilt(present, k)))

    whole = F.struct(markers(plain).alias("m"), section_parts(plain).alias("p"), plain.alias("b"))
    return F.when(F.length(plain) <= limit, plain).otherwise(let(whole, cut))


def split_candidates(block: Column) -> Column:
    """(raw, candidates): a block before its heading of candidates, and from there on."""
    plain = _strip(block)
    at = F.instr(plain, FI.HEAD_CANDIDATES)
    return F.struct(F.when(at > 0, _strip(F.left(plain, at - 1))).otherwise(plain).alias("raw"), F.when(at > 0, F.substr(plain, at)).otherwise("").alias("candidates"))


def cut_candidate_block(block: Column, limit: Column | int) -> Column:
    """Candidates within a limit: list lines go from the end; the heading stays."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    plain = _strip(block)

    def cut(rows: Column) -> Column:
        head, items = F.get(rows, F.lit(0)), F.filter(F.slice(rows, F.lit(2), F.lit(1 << 30)), lambda x: F.startswith(F.trim(x), F.lit("-")))
        ends = F.aggregate(items, F.struct(F.length(head).alias("used"), F.lit(0).alias("n"), F.lit(False).alias("full")), _fit(limit))
        return let(ends, lambda a: F.array_join(F.concat(F.array(head), F.slice(items, F.lit(1), a["n"])), "\n"))

    return F.when(F.length(plain) <= limit, plain).when(~F.startswith(plain, F.lit(FI.HEAD_CANDIDATES)), F.left(plain, limit)).otherwise(let(lines_of(plain), cut))


def _fit(limit: Column):
    def step(a: Column, x: Column) -> Column:
        full = a["full"] | (a["used"] + F.length(x) + 1 > limit)
        return F.struct(F.when(full, a["used"]).otherwise(a["used"] + F.length(x) + 1).alias("used"), F.when(full, a["n"]).otherwise(a["n"] + 1).alias("n"), full.alias("full"))

    return step


def cut_patch_block(raw: Column, candidates: Column, limit: Column | int) -> Column:
    """Sections and candidates within a limit: candidates first, sections lose lines before them."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    raw, candidates = _strip(raw), _strip(candidates)
    room = limit - F.length(candidates) - F.when(raw != "", len(_GAP)).otherwise(0)

    def joined(x: Column) -> Column:
        both = F.when(x != "", F.concat(x, F.lit(_GAP), candidates)).otherwise(candidates)
        rest = F.greatest(F.lit(len(FI.HEAD_CANDIDATES)), limit - F.length(x) - len(_GAP))
        less = cut_candidate_block(candidates, rest)
        return F.when(F.length(both) <= limit, both).when(x != "", F.concat(x, F.lit(_GAP), less)).otherwise(less)

    return (
        F.when(candidates == "", F.when(raw == "", "").otherwise(cut_section_block(raw, limit)))
        .when(F.length(candidates) >= limit, cut_candidate_block(candidates, limit))
        .otherwise(let(F.when((raw != "") & (room > 0), cut_section_block(raw, room)).otherwise(""), joined))
    )


def with_patch_evidence(summary: Column, evidence: Column, limit: int = PROMPT_LIMIT) -> Column:
    """A summary with evidence behind it, within a limit: evidence is cut first, then what is left of the summary's beginning."""

    def joined(x: Column) -> Column:
        both = F.when((x["raw"] != "") & (x["candidates"] != ""), F.concat(x["raw"], F.lit(_GAP), x["candidates"])).when(x["candidates"] != "", x["candidates"]).otherwise(x["raw"])
        whole = F.concat(summary, F.lit(_GAP), both)
        less = let(cut_patch_block(x["raw"], x["candidates"], limit), lambda b: F.when(F.length(b) + len(_GAP) >= limit, b).otherwise(F.concat(_right(F.left(summary, F.lit(limit) - F.length(b) - len(_GAP))), F.lit(_GAP), b)))
        return F.when(F.length(whole) <= limit, whole).otherwise(less)

    return F.when(F.trim(F.coalesce(evidence, F.lit(""))) == "", summary).otherwise(let(split_candidates(evidence), joined))


def summary_lists(items: DataFrame, caps: dict[str, int], key: str = "doc") -> DataFrame:
    """(doc, kind, text): the first items of each kind (doc, kind, position, item), as many as its cap, joined by `; `."""
    cap = F.create_map(*(x for k, v in caps.items() for x in (F.lit(k), F.lit(v))))[F.col("kind")]
    n = F.row_number().over(Window.partitionBy(key, "kind").orderBy("position"))
    few = items.withColumn("_n", n).filter(F.col("_n") <= cap)
    return few.groupBy(key, "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "item"))), lambda x: x["item"]), "; ").alias("text"))


#: How many items a batch's summary gives of each list.
SUMMARY_CAPS = {"resumo": 20, "dados_numericos": 20, "pendencias": 10}


def batch_summaries(items: DataFrame, key: str = "doc") -> DataFrame:
    """(doc, text) of items (doc, batch, kind, name, position, item): batches in order, each with its lists under their names, as many items as the kind's cap."""
    cap = F.create_map(*(x for k, v in SUMMARY_CAPS.items() for x in (F.lit(k), F.lit(v))))[F.col("kind")]
    n = F.row_number().over(Window.partitionBy(key, "batch", "kind", "name").orderBy("position"))
    few = items.withColumn("_n", n).filter(F.col("_n") <= cap)
    rank = F.array_position(F.array(*map(F.lit, SUMMARY_CAPS)), F.col("kind"))
    lists = few.groupBy(key, "batch", "kind", "name").agg(F.min("position").alias("_p"), F.transform(F.array_sort(F.collect_list(F.struct("_n", "item"))), lambda x: F.concat(F.lit("- "), x["item"])).alias("_l"))
    text = F.concat(F.lit("["), F.col("name"), F.lit("]\n"), F.array_join("_l", "\n"))
    one = lists.groupBy(key, "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col("_p"), text.alias("t")))), lambda x: x["t"]), "\n").alias("_t"))
    told = F.concat(F.lit("LOTE "), F.col("batch").cast("string"), F.lit(":\n"), F.col("_t"))
    return one.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("batch"), told.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))
