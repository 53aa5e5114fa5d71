"""The project record: one nested struct with the names of the project file, its empty form, and its paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Columns of lists.
FLOOR_AREAS = ("areaPrivCobPadrao", "areaPrivCobDifReal", "areaPrivCobDifEquiv", "areaComumNPCobPadrao", "areaComumNPCobDifReal", "areaComumNPCobDifEquiv", "areaComumPCobPadrao", "areaComumPCobDifReal", "areaComumPCobDifEquiv")
UNIT_AREAS = ("areaPrivCobPadrao", "areaPrivCobDifReal", "areaPrivCobDifEquiv", "areaComumNPCobPadrao", "areaComumNPCobDifReal", "areaComumNPCobDifEquiv")
UNIT_EXTRAS = ("outrasAreasPriv", "areaTerrExcl", "areaTerrComum")
EQUIPMENT = ("nome", "tipo", "acabamento", "detalhes")
FINISH = ("dependencia", "pisos", "paredes", "tetos", "outros")
SURFACES = ("pisos", "paredes", "tetos", "outros")
STANDARDS = ("R", "CS", "CL", "CG", "CP", "CP1Q")
STANDARD_ROW = ("designacao", "padrao", "numPav", "areaEquiv", "quartos", "salas", "banheiros", "quartosEmp")
COST_SHARES = (
    "percMateriais", "percMaoObra", "fundacoes", "elevadores", "fogoes", "aquecedores", "bombasRecalque", "incineracao", "arCondicionado", "calefacao", "ventilacao", "outros6_3", "playground", "urbanizacao",
    "recreacao", "ajardinamento", "instCondominio", "outros6_5", "outros6_6", "impostos", "projArq", "projEstrut", "projInst", "projEsp", "percConstrutor", "percIncorporador",
)
BUILDING_NOTES = ("tipoEdificacao", "numPavimentos", "unidadesPorPav", "numeracao", "pilotis", "transicao", "garagens", "pavComunitarios", "outrosPav", "dataAprovacao", "outrasIndicacoes")
#: What must be filled, and what should be.
CRITICAL = ("incorporador.cnpj", "projeto.areaTerreno", "projeto.cidadeUf", "projeto.localConstrucao", "projeto.numAlvara", "projeto.numPavimentos", "projeto.projetoPadrao.R", "projeto.qtdUnidades", "quadro1.pavimentos", "quadro2.unidades")
WARNINGS = ("incorporador.nome", "projeto.nomeEdificio", "projeto.vagasAcessorio", "projeto.vagasComum", "quadro3.valorCub", "quadro5.garagens", "quadro5.tipoEdificacao", "responsavel.crea", "responsavel.nome")

_S, _I, _D, _B = "string", "int", "double", "boolean"
_FLOOR = {"nome": _S, **dict.fromkeys(FLOOR_AREAS, _D), "qtdPavimentos": _I}
_UNIT = {"designacao": _S, **dict.fromkeys(UNIT_AREAS, _D), "qtdUnidades": _I, **dict.fromkeys(UNIT_EXTRAS, _D)}
#: Groups of fields by name: a kind, a group, or a list of rows.
TREE = {
    "incorporador": {"nome": _S, "cnpj": _S, "endereco": _S},
    "responsavel": {"nome": _S, "crea": _S, "art": _S, "endereco": _S},
    "projeto": {
        "nomeEdificio": _S, "localConstrucao": _S, "cidadeUf": _S, "projetoPadrao": dict.fromkeys(STANDARDS, _B), "qtdUnidades": _I, "padraoAcabamento": _S, "numPavimentos": _I, "vagasUA": _I, "vagasAcessorio": _I,
        "vagasComum": _I, "areaTerreno": _D, "dataAprovacao": _S, "numAlvara": _S,
    },
    "quadro1": {"pavimentos": [_FLOOR]},
    "quadro2": {"unidades": [_UNIT]},
    "quadro3": {"projetoPadrao": dict.fromkeys(STANDARD_ROW, _S), "sindicato": _S, "mesCub": _S, "valorCub": _D, **dict.fromkeys(COST_SHARES, _D)},
    "quadro4a": {"unidadesSubrogadas": [{"designacao": _S}]},
    "quadro5": dict.fromkeys(BUILDING_NOTES, _S),
    "quadro6": {"equipamentos": [dict.fromkeys(EQUIPMENT, _S)]},
    "quadro7": {"acabamentos": [dict.fromkeys(FINISH, _S)]},
    "quadro8": {"acabamentos": [dict.fromkeys(FINISH, _S)]},
    "_dados_faltantes": ["string"],
}
_EMPTY = {_S: "", _I: 0, _D: 0.0, _B: False}
#: Lists that hold no row, rather than an empty one, in an empty record.
_NO_ROWS = ("unidadesSubrogadas", "_dados_faltantes")


def ddl(tree=None) -> str:
    """The record's type."""
    tree = TREE if tree is None else tree
    if isinstance(tree, str):
        return tree
    if isinstance(tree, list):
        return f"array<{ddl(tree[0])}>"
    return "struct<" + ",".join(f"`{k}`:{ddl(v)}" for k, v in tree.items()) + ">"


def build(tree, values: dict, path: str = "") -> Column:
    """A struct of the tree with the columns of ``values`` (by path), and empty values elsewhere."""
    out = []
    for name, kind in tree.items():
        own = f"{path}{name}"
        if own in values:
            value = values[own].cast(ddl(kind))
        elif isinstance(kind, dict):
            value = build(kind, values, f"{own}.")
        elif isinstance(kind, list):
            value = F.array().cast(ddl(kind)) if name in _NO_ROWS else F.array(empty_row(kind[0]))
        else:
            value = F.lit(_EMPTY[kind]).cast(kind)
        out.append(value.alias(name))
    return F.struct(*out)


def row(tree: dict, **values: Column) -> Column:
    """A row of a list with the given columns."""
    return F.struct(*(F.coalesce(values[k].cast(v), F.lit(_EMPTY[v]).cast(v)).alias(k) if k in values else _default(k, v).alias(k) for k, v in tree.items()))


def _default(name: str, kind: str) -> Column:
    return F.lit(1 if name in ("qtdPavimentos", "qtdUnidades") and kind == _I else _EMPTY[kind]).cast(kind)


def empty_row(tree: dict) -> Column:
    """A list's template row: nothing but one floor or unit."""
    return row(tree)


def skeleton() -> Column:
    """The empty record."""
    return build(TREE, {})


def leaves(tree=None, path: str = "") -> list[tuple[str, str]]:
    """(path, kind) of every single field; lists are one field of kind list."""
    tree = TREE if tree is None else tree
    out = []
    for name, kind in tree.items():
        if isinstance(kind, dict):
            out += leaves(kind, f"{path}{name}.")
        else:
            out.append((f"{path}{name}", "list" if isinstance(kind, list) else kind))
    return out


def at(record: Column, path: str) -> Column:
    """The value of a dotted path; null above nothing."""
    for part in path.split("."):
        record = record[part]
    return record


def with_value(record: Column, path: str, value: Column) -> Column:
    """The record with another value at a dotted path."""
    return record.withField(path, value)


FLOOR, UNIT = _FLOOR, _UNIT
EQUIPMENT_ROW, FINISH_ROW = dict.fromkeys(EQUIPMENT, _S), dict.fromkeys(FINISH, _S)
