"""Queries of sections VI to VIII and of the text reducer, over invented texts of construction documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granella.functions import patterns as PT
from granella.functions import text as T
from granella.functions.patterns import lines_of
from granella.operators import finishes as FI
from granella.operators import sections as SE
from granella.plans import prefilter as P
from granella.plans.registry import NUMBERED, all_of, less, like, numbered, pick, query, quoted, sql_list, texts
from granella.session import table

#: Lines that invented texts are made of; # is a number. No accents, as DuckDB's word limits are those of ASCII.
POOL = (
    "CNPJ 12.345.678/0001-90 AURORA EMPREENDIMENTOS LTDA", "ENGENHEIRO CIVIL JOAO DA SILVA CREA PR-#/D", "ALVARA #/2023 PROCESSO APROVACAO", "PAV. TIPO TORRE # - 55,00 X 4 APTOS", "SALA PISO PORCELANATO PAREDE PINTURA", "BWC",
    "PISO LAMINADO TETO PINTURA", "SACADA", "HALL ELEVADOR PISO CIMENTADO", "ELEVADOR# E ELEVADOR1# NA TORRE", "240x480 240x481 JANELA 12", "----------", "PAGINA 12", "3 / 12", "JO1 PM3 PJ05", "BOMBA DE RECALQUE E RESERVATORIO SUPERIOR",
    "DEP. DE GAS COM MEDIDORES", "A1 B2 C3 D4 E5 F6 G7 H8 I9 J0 12 13 14 MN", "TOTAL DE VAGAS COMUNS: #", "EDIFICACAO RESIDENCIAL MULTIFAMILIAR VERTICAL [RMV] NO TERRENO DO CONDOMINIO",
    "O MEMORIAL DESCRITIVO DO EMPREENDIMENTO INDICA O ACABAMENTO E O REVESTIMENTO DE GRANITO", "GARAGEM PISO CIMENTADO PINTURA GRAFITE", "texto sem interesse algum para este caso aqui", "R$ 1.250,00 POR METRO NO SINDUSCON", "COZINHA BANHO PISO VIDRO",
    "PORCELANATO NA SUITE", "ESCADA", "MADEIRA E PORCELANATO NO PISO MADEIRA", "ELEVADOR 12,50 m2", "120 X 200 PORTA DO QUARTO", "12.345 / 67.890 = 11,22 * 33", "PROCEDIMENTO DO ELEVADOR 1",
)
_N = len(POOL)
_LINES = f"""{NUMBERED}, li2 AS (SELECT l_orderkey AS doc, n AS line_no, CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE replace(({sql_list(POOL)})[((l_partkey * 7 + l_suppkey * 3 + n) % {_N} + 1)::INT], '#', (l_partkey % 900 + 100)::VARCHAR) END AS line FROM li)"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """One invented line for each order line; a fifth are empty."""
    line = F.replace(pick(POOL, (F.col("l_partkey") * 7 + F.col("l_suppkey") * 3 + F.col("n")) % _N), F.lit("#"), (F.col("l_partkey") % 900 + 100).cast("string"))
    return numbered(spark, sf).select(F.col("l_orderkey").alias("doc"), F.col("n").alias("line_no"), F.when(F.col("l_suppkey") % 5 == 0, "").otherwise(line).alias("line"))


def _section(line: str) -> str:
    return f"CASE WHEN {like(line, FI.LIFT_LOBBY)} THEN 'viii' WHEN {like(line, FI.SECTION_VI)} THEN 'vi' WHEN {like(line, FI.SECTION_VII)} THEN 'vii' WHEN {like(line, FI.SECTION_VIII)} THEN 'viii' END"


_LETTERS = "[a-zA-ZÀ-ü\\s]"
_WORD4, _WORD5 = "\\b[a-zA-ZÀ-ü]{4,}\\b", "\\b[a-zA-ZÀ-ü]{5,}\\b"


def _other(line: str) -> str:
    return f"length({less(line, _LETTERS, flags='')}) / greatest(length({line}), 1)"


def _badly(line: str, section: str) -> str:
    return f"(NOT (length({line}) <= 24 AND {section} IS NOT NULL) AND len({all_of(line, _WORD4)}) < 2 AND {_other(line)} > 0.55)"


def _shape(line: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({line}), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH {_LINES}, c AS (SELECT doc, line_no, line, {_section('line')} AS section FROM li2 WHERE line <> ''), g AS (SELECT *, row_number() OVER (PARTITION BY doc, {_shape('line')} ORDER BY line_no) AS k FROM c WHERE section IS NOT NULL AND NOT {_badly('line', 'section')}),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc, section ORDER BY line_no)::INT AS rank FROM g WHERE k = 1) SELECT doc, section, rank, line_no, line FROM r WHERE rank <= 20""")
def q09_line_class(spark, sf):
    return FI.section_lines(_lines(spark, sf), 60)


def _rooms(line: str, section: str) -> str:
    """SQL: rooms of a section as structs, without those that overlap one before them."""
    found = ", ".join(f"{{'a': CASE WHEN {like(line, p)} THEN strpos({line}, regexp_extract({line}, {quoted('(?i)' + p)})) ELSE 0 END, 'n': length(regexp_extract({line}, {quoted('(?i)' + p)})), 'name': {quoted(name)}}}" for p, name in FI.ROOMS[section])
    some = f"list_filter([{found}], lambda x: x.a > 0)"
    return f"list_filter({some}, lambda x, i: len(list_filter(({some})[1:i - 1], lambda y: x.a < y.a + y.n AND x.a + x.n > y.a)) = 0)"


def _labels(found: str) -> str:
    """SQL: sorted distinct labels of matched materials."""
    keys, names = sql_list(FI.MATERIALS), sql_list(FI.MATERIALS.values())
    return f"list_sort(list_distinct([({names})[list_position({keys}, upper(m))] FOR m IN {found}]))"


_ON = {s: _labels(all_of("line", p, 1)) for s, p in FI.ON_SURFACE.items()}
_FIRST = "list_min(list_filter([" + ", ".join(f"CASE WHEN {like('line', p)} THEN strpos(line, regexp_extract(line, {quoted('(?i)' + p)})) ELSE 0 END" for p in (*FI.ON_SURFACE.values(), FI.MATERIAL)) + "], lambda x: x > 0))"
#: Features of every distinct line, then finishes of one line and of a line with the next.
_FINISHES = f"""{_LINES}, every_line AS (SELECT DISTINCT line FROM li2),
  f AS (SELECT line, {_section('line')} AS section, {_rooms('line', 'vii')} AS r7, {_rooms('line', 'viii')} AS r8, {_ON['pisos']} AS pisos, {_ON['paredes']} AS paredes, {_ON['tetos']} AS tetos, {_labels(all_of('line', FI.MATERIAL, 1))} AS every_m, {_FIRST} AS first_m FROM every_line),
  m AS (SELECT *, list_sort(list_filter(every_m, lambda x: NOT list_contains(pisos || paredes || tetos, x))) AS outros, list_sort(list_distinct(every_m || pisos || paredes || tetos)) AS materiais FROM f),
  a AS (SELECT *, CASE WHEN len(r7) = 1 AND len(materiais) > 0 AND r7[1].a <= first_m AND first_m - r7[1].a - r7[1].n <= 120 THEN r7[1].name END AS d7, CASE WHEN len(r8) = 1 AND len(materiais) > 0 AND r8[1].a <= first_m AND first_m - r8[1].a - r8[1].n <= 120 THEN r8[1].name END AS d8, {_badly('line', 'section')} AS badly FROM m),
  w AS (SELECT doc, line_no, li2.line, lead(li2.line) OVER v AS after, lag(li2.line) OVER v AS before FROM li2 WINDOW v AS (PARTITION BY doc ORDER BY line_no)),
  pair AS (SELECT w.*, CASE WHEN w.line <> '' AND after <> '' AND x.d7 IS NULL AND len(x.r7) = 1 AND x.r7[1].name NOT IN ('BWC', 'Banho') AND len(x.materiais) = 0 AND len(y.materiais) > 0 AND len(x.r8) = 0 AND len(y.r8) = 0 AND len(y.r7) = 0 AND coalesce(y.section, '') <> 'viii' THEN x.r7[1].name END AS dw
    FROM w JOIN a x ON x.line = w.line LEFT JOIN a y ON y.line = w.after)"""


@query(f"""WITH {_FINISHES}, alone AS (SELECT doc, CASE section WHEN 'vii' THEN 'quadro7' ELSE 'quadro8' END AS quadro, CASE section WHEN 'vii' THEN d7 ELSE d8 END AS dependencia, materiais, pisos, paredes, tetos, outros, li2.line AS linha FROM li2 JOIN a USING (line) WHERE section IN ('vii', 'viii') AND NOT badly),
  two AS (SELECT doc, 'quadro7' AS quadro, dw AS dependencia, materiais, pisos, paredes, tetos, outros, pair.line || ' | ' || after AS linha FROM pair JOIN a ON a.line = after WHERE dw IS NOT NULL)
SELECT DISTINCT doc, quadro, dependencia, array_to_string(materiais, ',') AS materiais, array_to_string(pisos, ',') AS pisos, array_to_string(paredes, ',') AS paredes, array_to_string(tetos, ',') AS tetos, array_to_string(outros, ',') AS outros, linha
FROM (SELECT * FROM alone UNION ALL SELECT * FROM two) WHERE dependencia IS NOT NULL""")
def q10_finish_candidates(spark, sf):
    got = texts(_lines(spark, sf)).select("doc", F.explode(FI.candidates_of(lines_of(F.col("text")))["finishes"]).alias("c"))
    return got.select("doc", "c.quadro", "c.dependencia", *(F.array_join(F.array_sort(f"c.{s}"), ",").alias(s) for s in ("materiais", "pisos", "paredes", "tetos", "outros")), "c.linha")


@query(f"""WITH {_FINISHES}, alone AS (SELECT doc, line_no, 0 AS o, CASE section WHEN 'vii' THEN 'quadro7' ELSE 'quadro8' END AS quadro, CASE section WHEN 'vii' THEN d7 ELSE d8 END AS d, pisos, paredes, tetos, outros FROM li2 JOIN a USING (line) WHERE section IN ('vii', 'viii') AND NOT badly),
  two AS (SELECT doc, line_no, 1, 'quadro7', dw, pisos, paredes, tetos, outros FROM pair JOIN a ON a.line = after WHERE dw IS NOT NULL)
SELECT DISTINCT doc, quadro, d AS dependencia, array_to_string(pisos, ', ') AS pisos, array_to_string(paredes, ', ') AS paredes, array_to_string(tetos, ', ') AS tetos, array_to_string(outros, ', ') AS outros FROM (SELECT * FROM alone UNION ALL SELECT * FROM two) WHERE d IS NOT NULL""")
def q46_finish_items(spark, sf):
    got = texts(_lines(spark, sf)).select("doc", FI.candidates_of(lines_of(F.col("text")))["finishes"].alias("f"))
    each = [got.select("doc", F.lit(q).alias("quadro"), F.explode(FI.finish_items(F.col("f"), q)).alias("x")) for q in ("quadro7", "quadro8")]
    order = lambda s: F.array_join(F.array_sort(F.split(F.col(f"x.{s}"), ", ")), ", ").alias(s)
    return each[0].union(each[1]).select("doc", "quadro", "x.dependencia", *(order(s) for s in ("pisos", "paredes", "tetos", "outros")))


def _machine(line: str) -> str:
    rejected = f"({like(line, FI.LIFT_AREA)} OR {like(line, FI.ADMIN_LINE)} OR ({like(line, FI.LIFT_LONG_NUMBER)} AND NOT {like(line, FI.LIFT_TAG)}))"
    others = " ".join(f"WHEN {like(line, p)} THEN {quoted(name)}" for p, name in FI.EQUIPMENT)
    return f"CASE WHEN {line} = '' OR {like(line, FI.LIFT_LOBBY)} THEN NULL WHEN NOT {rejected} AND {like(line, FI.LIFT)} THEN {quoted(FI.LIFT_NAME)} WHEN {like(line, FI.GAS)} THEN {quoted(FI.GAS_NAME)} {others} END"


@query(f"""WITH {_LINES}, c AS (SELECT doc, line_no, line, {_machine('line')} AS nome FROM li2 WHERE {_section('line')} = 'vi' AND NOT {_badly('line', _section('line'))}),
  t AS (SELECT DISTINCT doc, upper(unnest({all_of('line', FI.LIFT_TAG)})) AS tag FROM c WHERE nome = {quoted(FI.LIFT_NAME)}),
  l AS (SELECT doc, string_agg(tag, '/' ORDER BY regexp_extract(tag, '[0-9]+')::INT) || ' citados' AS tags FROM t GROUP BY doc),
  g AS (SELECT doc, nome, arg_min(line, line_no) AS first FROM c WHERE nome IS NOT NULL GROUP BY 1, 2)
SELECT doc, nome, CASE nome WHEN {quoted(FI.LIFT_NAME)} THEN coalesce(tags, first) WHEN {quoted(FI.GAS_NAME)} THEN {quoted(FI.GAS_DETAIL)} ELSE first END AS detalhes FROM g LEFT JOIN l USING (doc)""")
def q11_equipment_rollup(spark, sf):
    got = texts(_lines(spark, sf)).select("doc", F.explode(FI.equipment_items(FI.candidates_of(lines_of(F.col("text")))["equipment"])).alias("x"))
    return got.select("doc", "x.nome", "x.detalhes")


# ---- evidence ------------------------------------------------------------------------------------------------------


def _company(line: str) -> str:
    return f"({like(line, PT.CNPJ_LABELLED)} OR {like(line, PT.CNPJ_MASKED)} OR {like(line, PT.CNPJ_MASKED_GLUED)})"


def _points(line: str) -> str:
    labelled = like(line, PT.CNPJ_LABELLED)
    rules = " + ".join(f"CASE WHEN {like(line, p)} THEN {n} ELSE 0 END" for p, n in P.POINTS)
    return (
        f"CASE WHEN {labelled} THEN {P.LABELLED_NUMBER} WHEN {_company(line)} THEN {P.MASKED_NUMBER} ELSE 0 END + {rules} + CASE WHEN {like(line, P.LOW_VALUE_WORDS)} THEN {P.LOW_VALUE} ELSE 0 END"
        f" + CASE WHEN regexp_matches({line}, '[0-9]{{14,}}') AND NOT {labelled} THEN {P.LONG_DIGITS} ELSE 0 END + CASE WHEN len({all_of(line, _WORD4)}) < 2 THEN {P.FEW_WORDS} ELSE 0 END + CASE WHEN {_other(line)} > 0.55 THEN {P.SYMBOLS} ELSE 0 END"
    )


def _evidence(lines: str) -> str:
    return f"""scored AS (SELECT doc, line_no, line, {_points('line')} AS score FROM {lines} WHERE line <> '' AND ({like('line', P.CANDIDATE)} OR {_company('line')})),
  formed AS (SELECT *, row_number() OVER (PARTITION BY doc, {_shape('line')} ORDER BY line_no) AS k FROM scored WHERE score >= {P.LEAST_SCORE}),
  best AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY score DESC, line_no)::INT AS rank, line_no, score::INT AS score, line FROM formed WHERE k = 1)"""


@query(f"WITH {_LINES}, {_evidence('li2')} SELECT doc, rank, line_no, score, line FROM best WHERE rank <= 3")
def q12_evidence_topk(spark, sf):
    return P.evidence(_lines(spark, sf), 3).withColumn("score", F.col("score").cast("int"))


# ---- lines and blocks ------------------------------------------------------------------------------------------------


def _reason(line: str) -> str:
    words = all_of(line, "\\b[\\wÀ-ü]+\\b")
    return (
        f"CASE WHEN {line} = '' THEN 'blank' WHEN {like(line, P.PAGE_NUMBER)} THEN 'page' WHEN {like(line, P.SEPARATOR)} THEN 'separator' WHEN length({less(line, '[^' + chr(92) + 'wÀ-ü]')}) < 4 THEN 'short' WHEN {like(line, P.FRAMES)} THEN 'frame'"
        f" WHEN {like(line, P.DIMENSIONS)} AND len({all_of(line, _WORD5)}) < 2 THEN 'dimensions' WHEN length({line}) > 8 AND {_other(line)} > 0.5 AND NOT {_company(line)} AND NOT regexp_matches(lower({line}), {quoted(P.KEPT_NUMBERS)}) THEN 'numbers'"
        f" WHEN regexp_matches({line}, {quoted(P.PLAN_CODES)}) THEN 'codes' WHEN length({line}) > 15 AND len({all_of(line, _WORD4)}) < 2 AND NOT {_company(line)} AND NOT regexp_matches(lower({line}), {quoted(P.KEPT_FRAGMENTS)}) THEN 'fragment'"
        f" WHEN length({line}) > 30 AND len({words}) >= 6 AND len(list_filter({words}, lambda x: length(x) <= 3)) > len({words}) * 0.55 AND NOT {_company(line)} AND NOT {like(f'lower({line})', P.KEPT_SHORT_WORDS)} THEN 'short words' END"
    )


@query(f"WITH {_LINES} SELECT doc, line_no, coalesce({_reason('line')}, 'kept') AS reason FROM li2")
def q13_line_filter(spark, sf):
    return _lines(spark, sf).select("doc", "line_no", F.coalesce(P.line_reason(F.col("line")), F.lit("kept")).alias("reason"))


def _kept() -> str:
    """SQL: lines that stay, from _FINISHES: what gives a finish or equipment, what no rule drops, first blanks."""
    return f"""flagged AS (SELECT p.doc, p.line_no, p.line, CASE WHEN x.d7 IS NOT NULL OR x.d8 IS NOT NULL OR p.dw IS NOT NULL OR coalesce(q.dw IS NOT NULL, false) OR ({_machine('p.line')}) IS NOT NULL THEN 'gives' ELSE coalesce({_reason('p.line')}, '') END AS r
    FROM pair p JOIN a x ON x.line = p.line LEFT JOIN pair q ON q.doc = p.doc AND q.line_no = p.line_no - 1),
  stays AS (SELECT *, last_value(CASE WHEN r <> 'blank' THEN line END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM flagged WHERE r IN ('gives', '', 'blank')),
  fresh AS (SELECT *, lag(r) OVER (PARTITION BY doc ORDER BY line_no) AS l FROM stays WHERE r <> '' OR p IS NULL OR p <> line),
  kept AS (SELECT doc, line_no, line FROM fresh WHERE r <> 'blank' OR coalesce(l <> 'blank', true))"""


@query(f"WITH {_FINISHES}, {_kept()} SELECT doc, line_no, line FROM kept")
def q14_kept_lines(spark, sf):
    return P.kept_lines(_lines(spark, sf))


def _relevant(block: str) -> str:
    words = f"list_distinct({all_of(f'lower({block})', chr(92) + 'b[a-zA-ZÀ-ü' + chr(92) + '-' + chr(39) + ']+' + chr(92) + 'b')})"
    known = f"len(list_intersect({words}, {sql_list(P.KEYWORDS)}))"
    human = f"len(list_filter({words}, lambda x: length(x) BETWEEN 3 AND 15))"
    letters = f"len({all_of(block, '[a-zA-ZÀ-ü]')})"
    special = f"({_company(block)} OR {like(f'lower({block})', P.SPECIAL_BLOCK)})"
    return (
        f"(length({block}) >= 10 AND ({special} OR ({known} >= 2 AND {letters} > length({block}) * 0.30 AND len(list_filter({words}, lambda x: length(x) >= 4)) >= 5 AND {human} > len({words}) * 0.60) OR ({known} >= 4 AND {human} > len({words}) * 0.50)))"
    )


def _blocks(lines: str) -> str:
    return f"""blocked AS (SELECT *, sum((line = '')::INT) OVER (PARTITION BY doc ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS block FROM {lines}),
  block_texts AS (SELECT doc, block::BIGINT AS block, string_agg(line, chr(10) ORDER BY line_no) AS text FROM blocked WHERE line <> '' GROUP BY 1, 2)"""


@query(f"WITH {_LINES}, {_blocks('li2')} SELECT doc, block, {_relevant('text')} AS relevant FROM block_texts")
def q15_block_relevance(spark, sf):
    return P.blocks(_lines(spark, sf)).select("doc", "block", P.relevant(F.col("text")).alias("relevant"))


def _repaired(text: str) -> str:
    """SQL: recognition repairs, all but the one that looks ahead."""
    for pattern, by in T.OCR_REPAIRS:
        if "(?!" not in pattern:
            text = less(text, pattern, by)
    return text


def _block_shape(text: str) -> str:
    masked = less(less(f"left({text}, 200)", "[0-9]+", "#"), P.PROFESSIONAL_CODE, "PROFISSIONAL")
    return f"trim(lower(regexp_replace({masked}, '\\s+', ' ', 'g')))"


def _prefilter(limit: int) -> str:
    lines = _FINISHES.replace("AS line FROM li)", "AS raw FROM li)").replace("every_line AS (SELECT DISTINCT line FROM li2)", f"li1 AS (SELECT doc, line_no, {_repaired('raw')} AS line FROM li2), every_line AS (SELECT DISTINCT line FROM li1)")
    lines = lines.replace("lead(li2.line) OVER v", "lead(line) OVER v").replace("lag(li2.line) OVER v", "lag(line) OVER v").replace("SELECT doc, line_no, li2.line,", "SELECT doc, line_no, line,").replace("FROM li2 WINDOW v", "FROM li1 WINDOW v")
    head = f"{quoted(P.HEAD_EVIDENCE)} || e"
    room = f"({limit} - length({head}) - {len(P.HEAD_BODY)})"
    return f"""WITH {lines}, {_evidence('li1')}, {_kept()}, {_blocks('kept')},
  machines AS (SELECT doc, {quoted(FI.HEAD_EQUIPMENT)} || chr(10) || string_agg(line, chr(10) ORDER BY line_no) AS t FROM (SELECT doc, line, min(line_no) AS line_no FROM li1 WHERE ({_machine('line')}) IS NOT NULL GROUP BY 1, 2) GROUP BY doc),
  parts AS (SELECT p.doc, p.line_no, 0 AS o, p.line AS t FROM pair p JOIN a USING (line) WHERE d7 IS NOT NULL OR d8 IS NOT NULL UNION ALL SELECT doc, line_no, 1, line FROM pair WHERE dw IS NOT NULL UNION ALL SELECT doc, line_no, 2, after FROM pair WHERE dw IS NOT NULL),
  finishes AS (SELECT doc, {quoted(FI.HEAD_FINISHES)} || chr(10) || string_agg(t, chr(10) ORDER BY o) AS t FROM (SELECT doc, t, min(line_no * 10 + o) AS o FROM parts GROUP BY 1, 2) GROUP BY doc),
  ev AS (SELECT doc, string_agg(line, chr(10) ORDER BY rank) AS t FROM best WHERE rank <= 100 GROUP BY doc),
  good AS (SELECT *, row_number() OVER (PARTITION BY doc, {_block_shape('text')} ORDER BY block) AS k FROM block_texts WHERE {_relevant('text')}),
  bodies AS (SELECT doc, string_agg(text, chr(10) || chr(10) ORDER BY block) AS b FROM good WHERE k = 1 GROUP BY doc),
  docs AS (SELECT DISTINCT doc, max(length(line)) OVER (PARTITION BY doc) AS n FROM li1),
  whole AS (SELECT docs.doc, n, concat_ws(chr(10) || chr(10), machines.t, finishes.t, ev.t) AS e, coalesce(b, '') AS b FROM docs LEFT JOIN machines USING (doc) LEFT JOIN finishes USING (doc) LEFT JOIN ev USING (doc) LEFT JOIN bodies USING (doc)),
  cut AS (SELECT *, {room} AS room, strpos(reverse(left(b, greatest({room}, 0)::INT)), chr(10) || chr(10)) AS gap FROM whole),
  placed AS (SELECT *, CASE WHEN gap > 0 THEN least(length(b), room) - gap - 1 ELSE -1 END AS place FROM cut)
SELECT doc, md5(CASE WHEN n = 0 THEN 'blank' WHEN e = '' THEN rtrim(left(b, {limit}), chr(10) || ' ') WHEN room <= 0 THEN rtrim(left({head}, {limit}), chr(10) || ' ') WHEN length(b) <= room THEN {head} || {quoted(P.HEAD_BODY)} || b
  ELSE {head} || {quoted(P.HEAD_BODY)} || rtrim(CASE WHEN place < room * 0.6 THEN left(b, room::INT) ELSE left(b, place::INT) END, chr(10) || ' ') END) AS text FROM placed"""


@query(_prefilter(420))
def q42_prefilter(spark, sf):
    docs = texts(_lines(spark, sf))
    got = P.prefilter(docs, 420)
    blank = docs.select("doc", (F.trim(F.regexp_replace("text", r"\s", "")) == "").alias("_blank"))
    return got.join(blank, "doc").select("doc", F.md5(F.when(F.col("_blank"), "blank").otherwise(F.col("text"))).alias("text"))


# ---- blocks of evidence within limits ----------------------------------------------------------------------------------

_CUT = f"""WITH {_LINES}, c AS (SELECT doc, line_no, line, {_section('line')} AS section FROM li2 WHERE line <> ''), g AS (SELECT *, row_number() OVER (PARTITION BY doc, {_shape('line')} ORDER BY line_no) AS k FROM c WHERE section IS NOT NULL AND NOT {_badly('line', 'section')}),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc, section ORDER BY line_no)::INT AS rank FROM g WHERE k = 1), heads AS (SELECT * FROM (VALUES {', '.join(f"({quoted(k)}, {quoted(v)})" for k, v in FI.SECTION_HEADS.items())}) v(section, head)),
  bare AS (SELECT doc, {len(FI.HEAD_SECTIONS)} + sum(length(head) + 2) AS n FROM (SELECT DISTINCT doc, section FROM r) JOIN heads USING (section) GROUP BY doc),
  u AS (SELECT r.*, n + sum(length(line) + 1) OVER (PARTITION BY r.doc ORDER BY length(section) DESC, rank ROWS UNBOUNDED PRECEDING) AS used FROM r JOIN bare USING (doc)),
  s AS (SELECT doc, section, head || coalesce(string_agg(chr(10) || line, '' ORDER BY rank) FILTER (WHERE used <= 150), '') AS t FROM u JOIN heads USING (section) GROUP BY 1, 2, head)
SELECT doc, {quoted(FI.HEAD_SECTIONS)} || string_agg(chr(10) || chr(10) || t, '' ORDER BY length(section)) AS text FROM s GROUP BY doc"""


@query(_CUT)
def q45_section_cut(spark, sf):
    """Blocks of sections within 150 characters; the block is built, read again and cut."""
    return FI.section_block(FI.section_lines(_lines(spark, sf))).select("doc", SE.cut_section_block(F.col("text"), 150).alias("text"))


_ITEMS = """items AS (SELECT o_custkey AS doc, '- item ' || o_orderkey || ' ' || o_orderstatus AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)"""


@query(f"""WITH {_ITEMS}, u AS (SELECT *, {len(FI.HEAD_CANDIDATES)} + sum(length(t) + 1) OVER (PARTITION BY doc ORDER BY n ROWS UNBOUNDED PRECEDING) AS used FROM items)
SELECT doc, {quoted(FI.HEAD_CANDIDATES)} || coalesce(string_agg(chr(10) || t, '' ORDER BY n) FILTER (WHERE used <= 100), '') AS text FROM u GROUP BY doc""")
def q45b_candidate_cut(spark, sf):
    item = F.concat(F.lit("- item "), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderstatus"))
    block = texts(table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("line_no"), item.alias("line")))
    return block.select("doc", SE.cut_candidate_block(F.concat(F.lit(FI.HEAD_CANDIDATES + "\n"), F.col("text")), 100).alias("text"))


@query(f"""WITH d AS (SELECT doc_id AS doc, text AS s, {quoted(FI.HEAD_CANDIDATES)} || chr(10) || '- a' || doc_id AS c FROM documents),
  l AS (SELECT *, length(s) + 2 + length(c) AS n FROM d)
SELECT doc, md5(CASE WHEN n <= 900 THEN s || chr(10) || chr(10) || c ELSE regexp_replace(left(s, (900 - length(c) - 2)::INT), '\\s+$', '') || chr(10) || chr(10) || c END) AS text FROM l""")
def q45c_patch_evidence(spark, sf):
    c = F.concat(F.lit(FI.HEAD_CANDIDATES + "\n- a"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.md5(SE.with_patch_evidence(F.col("text"), c, 900)).alias("text"))


@query(f"""WITH d AS (SELECT doc_id AS doc, left(text, 200) AS a, n_chars % 3 AS k FROM documents),
  e AS (SELECT doc, k, CASE k WHEN 0 THEN '' WHEN 1 THEN {quoted(SE.EVIDENCE_START)} || chr(10) || 'x' || doc ELSE {quoted(SE.EVIDENCE_START)} || chr(10) || 'x' || doc || chr(10) || 'y' || doc END AS t FROM d) SELECT doc, t AS text FROM e""")
def q45d_critical_evidence(spark, sf):
    d, k = F.col("doc_id").cast("string"), F.col("n_chars") % 3
    part = lambda x: F.concat(F.lit(SE.EVIDENCE_START + "\n" + x), d, F.lit(SE.EVIDENCE_END + "\n"), F.left("text", F.lit(200)), F.lit("\n"))
    text = F.when(k == 0, F.left("text", F.lit(200))).when(k == 1, part("x")).otherwise(F.concat(part("x"), part("y")))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), SE.critical_evidence(text).alias("text"))
