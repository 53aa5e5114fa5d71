"""Scalar expressions over Brazilian construction documents. All are Columns, none a UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The federal units.
UFS = ("AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG", "PA", "PB", "PR", "PE", "PI", "RJ", "RN", "RS", "RO", "RR", "SC", "SP", "SE", "TO")


def parse_br_number(s: Column) -> Column:
    """`8.958,97` is 8958.97; a dot without a comma is a decimal point; white space doesn't count; what is no number is 0."""
    t = F.regexp_replace(s, r"(?U)\s+", "")
    plain = F.when(F.contains(t, F.lit(",")), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(t)
    return F.coalesce(F.when(plain.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), plain.try_cast("double")), F.lit(0.0))


def format_brl(v: Column) -> Column:
    """1234.5 is `1.234,50`."""
    return F.translate(F.format_number(v, 2), ",.", ".,")


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def squeeze_spaces(s: Column) -> Column:
    """White space runs become one blank; none at the ends."""
    return F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", " "), r"^ | $", "")


def normalise_cnpj(s: Column) -> Column:
    """14 digits in the company mask, else the empty string."""
    d = digits(s)
    masked = F.concat(F.substring(d, 1, 2), F.lit("."), F.substring(d, 3, 3), F.lit("."), F.substring(d, 6, 3), F.lit("/"), F.substring(d, 9, 4), F.lit("-"), F.substring(d, 13, 2))
    return F.when(F.length(d) == 14, masked).otherwise(F.lit(""))


#: A registration behind its label, and alone.
_CREA = r"(?iU)CREA\s*([A-Z]{2})\s*[-/]?\s*(\d{4,6})\s*[/]?\s*([A-Z])?"
_CREA_ALONE = r"(?iU)^([A-Z]{2})-?(\d{4,6})([A-Z])?$"


def normalise_crea(s: Column) -> Column:
    """`CREA SP 54321/D`, `CREASP-54321D` and `SP54321D` are `SP-54321/D`, without a letter `SP-54321`; else the empty string."""
    alone = F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", ""), r"(?i)^CREA", "")

    def form(t: Column, pattern: str) -> Column:
        uf, number, letter = (F.regexp_extract(t, pattern, i) for i in (1, 2, 3))
        return F.when(number != "", F.concat(F.upper(uf), F.lit("-"), number, F.when(letter != "", F.concat(F.lit("/"), F.upper(letter))).otherwise("")))

    return F.coalesce(form(s, _CREA), form(alone, _CREA_ALONE), F.lit(""))


def city_uf(city: Column, uf: Column) -> Column:
    """`Cidade-UF` if the unit is known and the city has four characters at least, else the empty string."""
    c = F.initcap(F.lower(squeeze_spaces(city)))
    return F.when(F.upper(uf).isin(*UFS) & (F.length(c) >= 4), F.concat(c, F.lit("-"), F.upper(uf))).otherwise(F.lit(""))


def valid_date(day: Column, month: Column, year: Column) -> Column:
    """Ranges only; no calendar."""
    return day.between(1, 31) & month.between(1, 12) & year.between(1900, 2100)


def format_date(day: Column, month: Column, year: Column) -> Column:
    return F.format_string("%02d/%02d/%04d", day.cast("int"), month.cast("int"), year.cast("int"))


def floor_number(s: Column) -> Column:
    """A floor's number: `202` is 20, as the degree sign is often read as a 2."""
    n = s.try_cast("int")
    return F.when((n >= 100) & F.endswith(s, F.lit("2")), F.substring(s, F.lit(1), F.length(s) - 1).try_cast("int")).otherwise(n)


def admin_number_score(s: Column) -> Column:
    """Points of an administrative number's spelling: number and year are best, long numbers without a slash are glued ones; -1 for none."""
    v = F.regexp_replace(F.trim(s), r"(?U)\s+", "")
    slash, n = F.contains(v, F.lit("/")), F.length(v)
    points = (
        F.when(v.rlike(r"/20\d{2}"), 25).otherwise(0)
        + F.when(v.rlike(r"^\d{1,6}/\d{4}$"), 20).when(slash & (n <= 24), 12).when(v.rlike(r"^\d{3,6}$"), 8).otherwise(0)
        - F.when((n >= 9) & ~slash, 20).otherwise(0)
        + F.when(v.rlike(r"^\d+\.\d+\.\d+/"), 15).otherwise(0)
    )
    return F.when(v == "", -1).otherwise(points)


#: Ordered spelling repairs after character recognition.
OCR_REPAIRS = (
    (r"\bPROJEGAO\b", "PROJEÇÃO"), (r"\bPROJEGOES\b", "PROJEÇÕES"), (r"\bCONSTRUGAO\b", "CONSTRUÇÃO"), (r"\bCONSTRUGOES\b", "CONSTRUÇÕES"), (r"\bCIRCULAGAO\b", "CIRCULAÇÃO"), (r"\bCIRCULAGOES\b", "CIRCULAÇÕES"),
    (r"\bEDIFICAGAO\b", "EDIFICAÇÃO"), (r"\bEDIFICAGOES\b", "EDIFICAÇÕES"), (r"\bAPROVAGAO\b", "APROVAÇÃO"), (r"\bINSCRIGAO\b", "INSCRIÇÃO"), (r"\bOCUPAGAO\b", "OCUPAÇÃO"), (r"\bINSTALAGAO\b", "INSTALAÇÃO"),
    (r"\bINSTALAGOES\b", "INSTALAÇÕES"), (r"\bILUMINAGAO\b", "ILUMINAÇÃO"), (r"\bVENTILAGAO\b", "VENTILAÇÃO"), (r"\bPRESSURIZAGAO\b", "PRESSURIZAÇÃO"), (r"\bAGAO\b", "AÇÃO"), (r"\bGAO\b", "ÇÃO"),
    (r"\bAREA\b", "ÁREA"), (r"\bAREAS\b", "ÁREAS"), (r"\bTERREO\b", "TÉRREO"), (r"\bSUBSOLO\b", "SUBSOLO"), (r"\bPAVIMENTO\b", "PAVIMENTO"), (r"\bMAQUINAS\b", "MÁQUINAS"), (r"\bD AGUA\b", "D'ÁGUA"),
    (r"\bDAGUA\b", "D'ÁGUA"), (r"\bAGUA\b", "ÁGUA"), (r"\bGAS\b", "GÁS"), (r"\bMAO DE OBRA\b", "MÃO DE OBRA"), (r"\bMAOOBRA\b", "MÃO DE OBRA"), (r"\bRESPONSAVEL\b", "RESPONSÁVEL"), (r"\bTECNICO\b", "TÉCNICO"),
    (r"\bPAV\b(?!\.)", "PAV."), (r"\bN[Iİ]VEL\b", "NÍVEL"), (r"M\s*[2²]\b", "m²"), (r"\bM2\b", "m²"),
)


def repair_ocr(s: Column) -> Column:
    """Repairs one after the other, then single blanks, one empty line at most, and no blanks around line breaks."""
    s = reduce(lambda c, r: F.regexp_replace(c, f"(?iU){r[0]}", r[1]), OCR_REPAIRS, s)
    return reduce(lambda c, r: F.regexp_replace(c, *r), (("[ \\t]{2,}", " "), ("\\n{3,}", "\n\n"), (" +\\n", "\n"), ("\\n +", "\n")), s)


def escape_xml(s: Column) -> Column:
    """&, < and >; quotes stay."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def visual_cut(s: Column, limit: int = 20) -> Column:
    return F.when(F.length(s) > limit, F.concat(F.left(s, F.lit(limit - 3)), F.lit("..."))).otherwise(s)


def cell_ref(sheet: Column, column: Column, row: Column) -> Column:
    """`Sheet!C17` from a column number of up to 702 and a row number."""
    low = F.chr(F.lit(65) + (column - 1) % 26)
    high = F.when(column > 26, F.chr(F.lit(64) + F.floor((column - 1) / 26))).otherwise(F.lit(""))
    return F.concat(sheet, F.lit("!"), high, low, row.cast("string"))


def equivalent(expected: Column, found: Column, tolerance: float = 0.001) -> Column:
    """Audit equality of cell texts: blank expected equals blank or zero found; numbers within the tolerance; else trimmed text."""
    e, f = F.trim(F.coalesce(expected, F.lit(""))), F.trim(F.coalesce(found, F.lit("")))
    ne, nf = e.try_cast("double"), f.try_cast("double")
    same = F.when(e == "", True).otherwise(F.coalesce(ne - ne == 0, F.lit(True)))  # what is no number or infinite equals nothing
    differing = F.when(e == "", F.coalesce(nf == 0, F.lit(False))).when(ne.isNotNull() & nf.isNotNull(), F.abs(ne - nf) <= tolerance).otherwise(F.lit(False))
    return F.when(e == f, same).otherwise(differing)


def is_formula(v: Column) -> Column:
    return F.coalesce(v.startswith("="), F.lit(False))
