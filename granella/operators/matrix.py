"""The responsibility matrix: where a path's value comes from, and whether a model may change it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granella.functions import schema as S

#: Origins.
DETERMINISTIC, COMPUTED, FORMULA, MODEL, MANUAL = "deterministico", "calculo", "formula_excel", "llm", "revisao_manual"
ORIGINS = (DETERMINISTIC, COMPUTED, FORMULA, MODEL, MANUAL)
#: Paths, their origin, whether a model may change them, state and risk. `.*` stands for all paths below.
RULES = (
    ("incorporador.nome", DETERMINISTIC, True, "implementado", "medio"),
    ("incorporador.cnpj", DETERMINISTIC, False, "implementado", "alto"),
    ("incorporador.endereco", DETERMINISTIC, False, "implementado", "medio"),
    ("responsavel.nome", DETERMINISTIC, True, "implementado", "medio"),
    ("responsavel.crea", DETERMINISTIC, False, "implementado", "alto"),
    ("responsavel.art", MANUAL, False, "planejado", "alto"),
    ("responsavel.endereco", DETERMINISTIC, True, "implementado", "medio"),
    ("projeto.nomeEdificio", DETERMINISTIC, True, "implementado", "medio"),
    ("projeto.localConstrucao", DETERMINISTIC, True, "implementado", "alto"),
    ("projeto.cidadeUf", DETERMINISTIC, False, "implementado", "alto"),
    ("projeto.qtdUnidades", DETERMINISTIC, False, "implementado", "alto"),
    ("projeto.numPavimentos", DETERMINISTIC, False, "implementado", "alto"),
    ("projeto.vagasUA", DETERMINISTIC, False, "implementado", "medio"),
    ("projeto.vagasAcessorio", DETERMINISTIC, False, "implementado", "medio"),
    ("projeto.vagasComum", DETERMINISTIC, False, "implementado", "medio"),
    ("projeto.areaTerreno", DETERMINISTIC, False, "implementado", "alto"),
    ("projeto.dataAprovacao", DETERMINISTIC, False, "implementado", "alto"),
    ("projeto.numAlvara", DETERMINISTIC, False, "implementado", "alto"),
    ("projeto.padraoAcabamento", MANUAL, False, "planejado", "alto"),
    ("projeto.projetoPadrao.R", DETERMINISTIC, False, "implementado", "alto"),
    ("projeto.projetoPadrao.CS", DETERMINISTIC, False, "implementado", "alto"),
    ("projeto.projetoPadrao.CL", DETERMINISTIC, False, "implementado", "alto"),
    ("projeto.projetoPadrao.CG", DETERMINISTIC, False, "implementado", "alto"),
    ("projeto.projetoPadrao.CP", DETERMINISTIC, False, "implementado", "alto"),
    ("projeto.projetoPadrao.CP1Q", DETERMINISTIC, False, "implementado", "alto"),
    ("quadro1.pavimentos", DETERMINISTIC, False, "implementado", "alto"),
    ("quadro2.unidades", DETERMINISTIC, False, "implementado", "alto"),
    ("quadro3.valorCub", DETERMINISTIC, False, "implementado", "alto"),
    ("quadro3.sindicato", DETERMINISTIC, False, "implementado", "alto"),
    ("quadro3.mesCub", DETERMINISTIC, False, "implementado", "alto"),
    ("quadro3.projetoPadrao.*", DETERMINISTIC, False, "parcial", "alto"),
    ("quadro3.percentuais_e_adicionais", FORMULA, False, "parcial", "alto"),
    ("quadro4a.unidadesSubrogadas", MANUAL, False, "planejado", "alto"),
    ("quadro5.garagens", COMPUTED, False, "implementado", "medio"),
    ("quadro5.*", DETERMINISTIC, False, "implementado", "medio"),
    ("quadro6.equipamentos", MODEL, True, "implementado", "medio"),
    ("quadro7.acabamentos", MODEL, True, "implementado", "medio"),
    ("quadro8.acabamentos", MODEL, True, "implementado", "medio"),
)
#: Paths that a collective rule covers.
COLLECTIVE = {"quadro3.percentuais_e_adicionais": tuple(f"quadro3.{c}" for c in S.COST_SHARES)}


def matrix(spark: SparkSession) -> DataFrame:
    """The rules as a relation of a few dozen rows."""
    return spark.createDataFrame(RULES, "rule string, origin string, patchable boolean, state string, risk string")


def _members(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, rule) for rule, members in COLLECTIVE.items() for m in members], "member string, collective string")


def _prefixes(path: Column) -> Column:
    """The dotted beginnings of a path that a `.*` rule can stand for, each as that rule."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "."), F.lit(".*")))


def lookup(paths: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """paths with origin, covered (by its own, a collective or a `.*` rule) and patchable (by its own or the longest `.*` rule).

    All rules are found by equality: a path's own, its collective's, and those of
    its beginnings. Only distinct paths are joined, so the table of paths keeps
    its rows, whatever columns it has.
    """
    spark = paths.sparkSession
    each = paths.select(F.col(path).alias("_p")).distinct()
    own = rules.select(F.col("rule").alias("_p"), F.col("origin").alias("o1"), F.col("patchable").alias("m1"))
    together = _members(spark).join(rules, F.col("collective") == F.col("rule")).select(F.col("member").alias("_p"), F.col("origin").alias("o2"))
    below = each.select("_p", F.explode(_prefixes(F.col("_p"))).alias("rule")).join(rules, "rule").groupBy("_p").agg(F.max_by(F.struct(F.col("origin").alias("o"), F.col("patchable").alias("m")), F.length("rule")).alias("b"))
    got = each.join(own, "_p", "left").join(together, "_p", "left").join(below, "_p", "left")
    origin = F.coalesce("o1", "o2", "b.o")
    got = got.select(F.col("_p").alias(path), origin.alias("origin"), origin.isNotNull().alias("covered"), F.coalesce("m1", "b.m", F.lit(False)).alias("patchable"))
    return paths.join(got, path, "left")


def may_patch(path: Column) -> Column:
    """Whether a model may change a path, as an expression over the fixed rules."""
    exact = F.create_map(*(F.lit(x) for rule, _, may, *_ in RULES if not rule.endswith(".*") for x in (rule, may)))
    out = exact[path]
    for rule, _, may, *_ in sorted((r for r in RULES if r[0].endswith(".*")), key=lambda r: -len(r[0])):
        out = F.coalesce(out, F.when(F.startswith(path, F.lit(rule[:-1])), F.lit(may)))
    return F.coalesce(out, F.lit(False))


def editable_paths(rules: DataFrame) -> DataFrame:
    """Rules that a model may change, in order."""
    return rules.filter("patchable").select("rule").orderBy("rule")


def by_origin(rules: DataFrame, origin: str) -> DataFrame:
    if origin not in ORIGINS:
        raise ValueError(f"unknown origin {origin}")
    return rules.filter(F.col("origin") == origin)
