"""Fixed patterns, words and names of construction documents, for regular-expression columns.

Patterns ignore case and use Unicode classes (``ci``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granella.functions.text import UFS


def ci(pattern: str) -> str:
    """The pattern with case ignored and Unicode classes."""
    return "(?iU)" + pattern


def has(s: Column, pattern: str) -> Column:
    return s.rlike(ci(pattern))


def hit(s: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; empty without one."""
    return F.regexp_extract(s, ci(pattern), group)


def hits(s: Column, pattern: str, group: int = 1) -> Column:
    """A group of every match."""
    return F.regexp_extract_all(s, F.lit(ci(pattern)), F.lit(group))


def without(s: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(s, ci(pattern), by)


def let(x: Column, use) -> Column:
    """use(x), where x is computed once however often it is used."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def filled(x: Column) -> Column:
    """x, null if it is empty; x is computed once, which NULLIF doesn't do inside lambdas."""
    return let(x, lambda v: F.when(v != "", v))


def lines_of(text: Column) -> Column:
    """A text's lines, at all line ends."""
    return F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")


#: Documents, numbers and dates.
DATE = r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
FILE_PREFIX = r"^\[[^\]]+\]\s*"
PDF_PREFIX = r"^\[[^\]]+\.pdf\]\s*"
PDF_MARK = r"^\[[^\]]+\.pdf\]"
CITY_LINE_REJECTED = r"^DOCUMENTO:\s*[^\s]+\.pdf\s*$|^(?:ARQ-PL|PLA-)[^\s]*\s*$"
CITY_EVIDENCE = r"\b[A-ZÀ-Ü][A-ZÀ-Ü ]{2,}\s*[-/]\s*(?:" + "|".join(sorted(UFS)) + r")\b"
CITY_LINE = r"(?<![A-Za-zÀ-ÿ])([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ \t]{2,40}?)[ \t]*[-/][ \t]*([A-Z]{2})\b"
CITY_FIRST_WORDS = ("de", "do", "da", "dos", "das", "são", "sao", "rio", "foz", "belo", "porto", "campo")
PROFESSIONAL = r"\b(?:CREA|CAU|CNPJ)\b"
DATE_WINDOW = 2
DATE_CONTEXT = r"aprova[cç][aã]o|aprovacao|alvar[aá]|alvara|data\s+do\s+projeto"
PERMIT = r"(?:N[°ºo.]?\s*DE\s+)?ALVAR[AÁ]\s*:?\s*([0-9]+(?:\s*/\s*[0-9]+)?)"
LAND = r"TERRENO\s*:\s*([\d.,]+)\s*M"
LAND_AT = r"(?:ÁREA|AREA)\s+TERRENO\s*\[AT\]\s*[=|:|]?\s*([\d.,]+)"
LAND_M2 = r"TERRENO\s+([\d.,]+)\s*M\s*2"
LAND_OWNER = r"PROPRIEDADE\s+DO\s+TERRENO"
CNPJ_LABELLED = r"CNPJ\s*(\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}|\d{2}\.?\d{3}\.?\d{3}\d{4}-?\d{2})"
CNPJ_LOOSE = r"CNPJ\s*([\d./-]{14,20})"
CNPJ_MASKED = r"\b(\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2})\b"
CNPJ_MASKED_GLUED = r"\b(\d{2}\.\d{3}\.\d{3}\d{4}-\d{2})\b"
CREA = r"CREA\s*([A-Z]{2})\s*[-/]?\s*(\d{4,6})\s*[/]?\s*([A-Z])?"
CREA_GLUED = r"CREA\s*([A-Z]{2})\s*[-]?\s*(\d{4,6})\s*([A-Z])?"
PROCESS = r"Processo\s+Aprova[cç][aã]o\s+n[°ºo.]?\s*([\d./-]+)"
STANDARD_R = r"residencial.*(?:multifamiliar|vertical|\[rmv\])|(?:multifamiliar|vertical|\[rmv\]).*residencial"
DESIGNATION = r"(EDIFICA[CÇ][AÃ]O\s+RESIDENCIAL\s+MULTIFAMILIAR\s+VERTICAL\s*\[RMV\])"
DESIGNATION_LINE = r"(EDIFICA[CÇ][AÃ]O\s+.+?\[RMV\])"

#: Sites, names and companies.
SITE_HEADER = r"DATA\s+DO\s+PROJETO|TAXA\s+DE\s+OCUPA[CÇ][AÃ]O"
LOT = r"\bLOTE\b"
SITE_WORDS = r"\b(?:LOTE|QUADRA|RUA|AVENIDA|AV\.|ESTRADA|RODOVIA|FAZENDA|GLEBA|CH[AÁ]CARA|S[IÍ]TIO|CONDOM[IÍ]NIO|BAIRRO|SITUAD|LOCALIZAD|MATR[IÍ]CULA)\b"
SITUATED = r"SITUAD[OA]\s+NO\s+(.+)"
SITE_LABEL = r"LOCAL\s+DA\s+OBRA\s*:?\s*(.+)"
SITE_ADDRESS = r"ENDE[RRE][CÇ]O\s+DA\s+OBRA\s*:?\s*(.+)"
RATE_AT_END = r",\s*[\d.,]+\s*%\s*$"
ONLY_CITY = r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ \t]*[-/][A-Z]{2}"
ADMIN_BLOCK = r"\b(?:Processo|Aprova[cç][aã]o|Alvar[aá]|Diretoria|Matr[ií]cula|Assinado|Digitalmente|Digital|Dados)\b"
ADMIN_CUT = r"\b(?:Processo|N[°ºo.]|ALVAR[AÁ]|CREA|CAU|CNPJ)\b"
BUILDING_NOISE = r"\b(?:CERTIFICADO\s+DE\s+VISTORIA|HABITE-?SE|FICARA\s+CONDIC\w*|CONDICIONAD\w*|CONDIEINAD\w*)\b|^\s*[,;:\-–—]"
COMPANY = r"\b(?:LTDA|S/?A\.?|SA|EIRELI|SPE|INCORPORA[CÇ][AÃ]O|CONSTRU[CÇ][AÃ]O|EMPREENDIMENTOS)\b"
COMPANY_ONLY = r"^(?:LTDA|S/?A\.?|SA|EIRELI|SPE|INCORPORA[CÇ][AÃ]O|CONSTRU[CÇ][AÃ]O|EMPREENDIMENTOS)$"
DEVELOPER_WORD = r"\b(?:INCORPORADOR|INCORPORADORA|CONSTRUTORA|PROPRIET[AÁ]RIO(?:\s+DO\s+TERRENO)?|PROPRIETARIA)\b"
DEVELOPER_LABEL = r"^\s*(?:INCORPORADOR|INCORPORADORA|CONSTRUTORA|PROPRIET[AÁ]RIO(?:\s+DO\s+TERRENO)?|PROPRIETARIA)\s*:?\s*(.+)"
NAME_REJECTED = r"\b(?:Processo|Aprova[cç][aã]o|Alvar[aá]|CNPJ|CPF|Diretoria|Assinado|Digital|Dados|Matr[ií]cula|Propriet[aá]rio|RESPONS[AÁ]VEL|N[°ºo.])\b"
NAME_WITH_NUMBERS = r"\b(?:CPF|CNPJ)\b|\b\d{1,2}/\d{1,2}/\d{4}\b|\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b"
PROFESSION = r"\b(?:ENGENHEIR[OA]|ARQUITET[OA]|CREA|CAU)\b"
PROFESSION_NAME = r"\b(?:ENGENHEIR[OA]|ARQUITET[OA])(?:\s+CIVIL|\s+URBANISTA)?\b"
BUILDING_LABEL = r"(?:NOME\s+DO\s+EDIF[IÍ]CIO|EMPREENDIMENTO)\s*:?\s*(.+)"
STREET = r"\b(?:rua|avenida|av\.|travessa|alameda)\b"
CONTACT = r"\d{5}-?\d{3}|\[\d+\]|@"
COMPANY_JUNK = ("estar", "nestas", "nesta", "neste", "que", "para", "com", "sem")
KEPT_SUFFIXES = ("LTDA", "SA", "S/A", "S.A", "SPE", "EIRELI", "ME", "EPP", "INC", "CIA", *UFS)

#: Units, floors and parking.
AREA_X_UNITS = r"([\d.,]+)\s*[xX×]\s*(\d+)\s*(?:APTOS?|APARTAMENTOS?)\b"
UNITS = r"(?<![\d.,])\b(\d+)\s*(?:APTOS?|APARTAMENTOS?)(?!/\s*PAV)\b"
UNITS_PER_FLOOR = r"\b(\d+)\s*APTOS?\s*/\s*PAV\b"
FLOOR_RANGE = r"\b(\d+)\s*(?:º|°)?\s*AO\s*(\d+)\s*(?:º|°)?\b"
FLOORS = r"\b(\d+)\s+PAVIMENTOS?\b"
GROUND = r"PAVIMENTO\s+T[EÉ]RREO|\bT[EÉ]RREO\b"
ROOF = r"\bCOBERTURA\b"
COMMON_SPACES = r"TOTAL\s+DE\s+VAGAS\s+COMUNS?\s*[:.]?\s*(\d+)"
DOUBLE_SPACES = r"TOTAL\s+DE\s+VAGAS\s+DUPLAS?\s*[:.]?\s*(\d+)"
LEISURE_COVERED = r"[AÁ]REA\s+DE\s+LAZER\s+COBERTA.*?T[EÉ]RREO\s*=\s*([\d.,]+)\s*m"
LEISURE_OPEN = r"[AÁ]REA\s+DE\s+LAZER\s+DESCOBERTA.*?T[EÉ]RREO\s*=\s*([\d.,]+)\s*m"
GROUND_AREA = r"[AÁ]REA\s+PAV(?:IMENTO|\.)?\s*T[EÉ]RREO\s*:?\s*([\d.,]+)\s*m"
ROOF_AREA = r"(?:COBERTURA.*?[AÁ]REA|[AÁ]REA\s+COBERTURA)\s*:?\s*([\d.,]+)\s*m"
TYPICAL_LINE = r"PAV\.?\s*TIPO"
TYPICAL_NAME, GROUND_NAME, ROOF_NAME = "Pavimentos tipo", "Pavimento térreo", "Cobertura"

#: What a text must mention for a missing field to count.
MENTIONS = {
    "crea": r"CREA",
    "vagas_comuns": r"VAGAS\s+COMUNS?",
    "vagas_duplas": r"VAGAS\s+DUPLAS?",
    "aptos": r"APTOS?|APARTAMENTOS?",
    "pavimentos": r"PAV\.?\s*TIPO|PAVIMENTO\s+T[EÉ]RREO|\bT[EÉ]RREO\b|COBERTURA|[AÁ]REA\s+PAVIMENTO",
    "local": r"LOCAL\s+DA\s+OBRA|ENDE[RRE][CÇ]O\s+DA\s+OBRA|SITUAD[OA]\s+NO",
    "edificio": r"NOME\s+DO\s+EDIF[IÍ]CIO|EMPREENDIMENTO",
}

#: Validation of texts.
ADMIN_PHRASE = r"\b(?:CERTIFICADO\s+DE\s+VISTORIA|HABITE-?SE|FICARA\s+CONDICIONAD|FICARA\s+CONDICINAD)\b"
CITY_UF = r"\b[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ\s]{1,40}[-/][A-Z]{2}\b"
REGISTRATION = r"\b[A-Z]{2}\s*[-/]?\s*\d{4,6}\s*/?\s*[A-Z]?\b"
COMPANY_SUFFIX = r"\b(?:LTDA|S/?A|SPE|EIRELI)\b"
CONDITIONAL = r"FICARA\s+CONDIC"


def company_line(line: Column) -> Column:
    """True for a line with a labelled or masked company number."""
    return has(line, CNPJ_LABELLED) | has(line, CNPJ_MASKED) | has(line, CNPJ_MASKED_GLUED)
