"""The document and drawing runs on small seeds."""

import json

from pyspark.sql import functions as F

from granella import cli as CLI
from granella import settings as ST_
from granella.functions import cleaning as K
from granella.operators import finishes as FI
from granella.operators import geometry as G
from granella.operators import matrix as MX
from granella.operators import prices as PR
from granella.operators import record as R
from granella.operators import sections as SE
from granella.operators import svg as V
from granella.plans import documents as D
from granella.plans import drawings as W
from granella.plans import model as M
from granella.plans import prefilter as P
from granella.sources import files as S
from granella.streaming import records as ST

TEXT = """NOME DO EDIFICIO: AURORA
INCORPORADORA: Aurora Incorporadora LTDA - CNPJ 12.345.678/0001-90
EDIFICACAO RESIDENCIAL MULTIFAMILIAR VERTICAL [RMV]
Curitiba-PR
N DE ALVARA: 2457/2023 Processo Aprovacao n. 99/2021
data 24/07/2023
(1º AO 202) PAV. TIPO - 55,00 X 4 APTOS
(1º AO 20º) PAV. TIPO - 60,50 X 2 APTOS
PAV. TERREO
COBERTURA
TERRENO: 8.958,97 M2
TOTAL DE VAGAS COMUNS: 55
TOTAL DE VAGAS DUPLAS: 7
LOTE 12, RUA DAS FLORES
SITUADO NO BAIRRO CENTRO
JOAO DA SILVA PEREIRA
ENGENHEIRO CIVIL CREA SP 54321/D
SALA PISO PORCELANATO PAREDE PINTURA
SACADA
PISO CERAMICA
ELEVADOR02 E ELEVADOR01
DEP. DE GAS
AREA DE LAZER COBERTA TERREO = 100,50 m2
rua das palmeiras 12 80000-000"""
PRICES = {"R1-N": 2500.5, "R16-N": 2050.0, "CSL-8": 2700.0}


def pages(spark):
    half = TEXT.index("PAV. TERREO")
    return spark.createDataFrame([("a", 2, TEXT[half:]), ("a", 1, TEXT[: half - 1]), ("b", 1, "nothing here"), ("c", 1, None)], "doc string, page int, text string")


def test_record(spark):
    run = D.run(pages(spark), PRICES, union="UNIAO", month="Maio/2025")
    got = {r["doc"]: r["record"].asDict(True) for r in run.records.collect()}
    a, b = got["a"], got["b"]
    assert a["incorporador"] == {"nome": "Aurora Incorporadora LTDA", "cnpj": "12.345.678/0001-90", "endereco": ""}
    assert a["responsavel"] == {"nome": "JOAO DA SILVA PEREIRA", "crea": "SP-54321/D", "art": "", "endereco": "rua das palmeiras 12 80000-000"}
    p = a["projeto"]
    assert (p["nomeEdificio"], p["localConstrucao"], p["cidadeUf"], p["numAlvara"], p["dataAprovacao"]) == ("AURORA", "LOTE 12, RUA DAS FLORES, BAIRRO CENTRO", "Curitiba-PR", "2457/2023", "24/07/2023")
    assert (p["qtdUnidades"], p["numPavimentos"], p["vagasComum"], p["vagasAcessorio"], p["areaTerreno"], p["projetoPadrao"]["R"]) == (6, 22, 55, 7, 8958.97, True)
    assert [(f["nome"], f["areaPrivCobPadrao"], f["areaComumPCobPadrao"], f["qtdPavimentos"]) for f in a["quadro1"]["pavimentos"]] == [("Pavimento térreo", 0.0, 100.5, 1), ("Pavimentos tipo", 17.05, 0.0, 20)]
    assert [(u["designacao"], u["qtdUnidades"]) for u in a["quadro2"]["unidades"]] == [("Apartamento tipo 55 m²", 4), ("Apartamento tipo 60,5 m²", 2)]
    assert (a["quadro3"]["valorCub"], a["quadro3"]["sindicato"], a["quadro3"]["mesCub"]) == (2050.0, "UNIAO", "Maio/2025")
    assert a["quadro5"]["garagens"] == "55 vagas comuns; 7 vagas duplas" and a["quadro5"]["outrasIndicacoes"].startswith("Processo Aprovação nº 99/2021; Alvará 2457/2023; Local: LOTE 12")
    assert [(e["nome"], e["detalhes"]) for e in a["quadro6"]["equipamentos"]] == [("Elevador", "ELEVADOR01/ELEVADOR02 citados"), ("Instalação de gás", "Instalação de gás citada no memorial")]
    assert [(f["dependencia"], f["pisos"], f["paredes"]) for f in a["quadro7"]["acabamentos"]] == [("Sala", "Porcelanato", "Pintura"), ("Sacada", "Ceramica", "")]
    assert b["incorporador"]["cnpj"] == "" and len(b["_dados_faltantes"]) == 9 and len(b["quadro1"]["pavimentos"]) == 1
    checks = {r["doc"]: r for r in run.validation.collect()}
    assert checks["a"]["ok"] and checks["a"]["avisos_semanticos"] == ["quadro8.acabamentos.template_vazio"] and checks["b"]["score"] == 0.0
    cells = {r["ref"]: r["value"] for r in run.cells.filter("doc = 'a'").collect()}
    assert cells["INFORMAÇÕES PRELIMINARES!F6"] == "12.345.678/0001-90" and cells["INFORMAÇÕES PRELIMINARES!H19"] == "X" and cells["QUADRO I!T18"] == "20.0" and cells["QUADRO I!D5"].endswith(" - Curitiba-PR")
    assert all(r["ok"] for r in D.audit(run.records, run.cells).collect())
    lost = D.audit(run.records, run.cells.filter("doc <> 'b'")).filter("doc = 'b'").first()
    assert not lost["ok"] and lost["erro"] == "planilha nao encontrada" and lost["celulas_verificadas"] == 0


def test_empty_documents(spark):
    none = spark.createDataFrame([], "doc string, page int, text string")
    run = D.run(none, PRICES)
    assert run.records.count() == run.cells.count() == run.validation.count() == 0


def test_prefilter_keeps_evidence(spark):
    noise = "\n".join(["240x480 240x480 240x480 240x480"] * 200)
    rows = spark.createDataFrame([("a", 1, noise + "\n\n" + TEXT + "\n\n" + noise)], "doc string, page int, text string")
    text = P.prefilter(D.texts_of(rows), 2000).first()["text"]
    assert len(text) <= 2000 and "240x480" not in text and "2457/2023" in text and text.startswith(P.HEAD_EVIDENCE)
    assert D.run(rows, PRICES, budget=4000).records.first()["record"]["projeto"]["numAlvara"] == "2457/2023"


def test_model_stage(spark):
    def broken(prompt):
        raise OSError("down")

    def busy(prompt):
        raise RuntimeError("429 rate limit")

    def good(prompt):
        patch = [{"path": "projeto.localConstrucao", "valor": "Rua {X}", "evidencia": "linha 3", "confianca": "alta"}, {"path": "incorporador.cnpj", "valor": "1", "evidencia": "linha 3", "confianca": "alta"}]
        return "Sure:\n```json\n" + json.dumps({"patch": patch}) + "\n``` done"

    run = D.run(pages(spark), PRICES)
    texts = D.texts_of(pages(spark)).filter("doc = 'b'")
    got = D.patched(run.records.filter("doc = 'b'"), texts, [broken, good], "Corrija:", step=0)
    assert [(r["path"], r["value"]) for r in got.filter("changed").collect()] == [("projeto.localConstrucao", "Rua {X}")]
    failed = M.call(texts.withColumn("prompt", F.lit("x")), [broken, busy], attempts=2, step=0).collect()
    assert all(r["answer"] is None and r["error"] == "RuntimeError: limite ou sobrecarga" for r in failed)
    assert M.first_object('x {"a": "}{"} y') == '{"a": "}{"}' and M.first_object("{a} {\"b\": 1}") == '{"b": 1}' and M.first_object("no") is None
    assert M.error_class(ImportError("x")) == (False, "ImportError: dependencia ausente") and M.error_class(ValueError("401"))[0] is False and M.error_class(ValueError("Overload"))[0]
    assert M.normal_answer(" a\r\nb ") == "a\nb" and M.normal_answer("  ") is None and M.normal_answer(3) is None
    assert M.provider_order("auto", "b", {"a": True, "b": False, "c": True}) == ["a", "c"] and M.provider_order("b", "a", {}) == ["b"]


def test_answers_of_objects():
    class Part:
        def __init__(self, **kw):
            self.__dict__.update(kw)

    assert M.answer_text(Part(content=[Part(text="a"), Part(text="b")])) == "ab"
    assert M.answer_text(Part(choices=[Part(message=Part(content="x "))])) == "x" and M.answer_text(Part(choices=[])) is None
    assert M.answer_text(Part(choices=[Part(message=Part(content=[{"type": "text", "text": "y"}, {"type": "other", "text": "z"}]))])) == "y"


def test_prices(spark):
    text = "R-1 2.500,10 R-1 2.900,20 R-1 3.100,30\nPIS: R$ 1.800,00 GI 900,50\nPP-4 1.000,00 PP-4 1.100,00 PP-4 1.200,00\nMARÇO DE 2025"
    got = PR.price_table(spark.createDataFrame([("d", text), ("e", None)], "doc string, text string"))
    prices = PR.as_dict(got.filter("doc = 'd'"))
    assert prices == {"PP-4": 1000.0, "PIS": 1800.0, "GI": 900.5, "R1-B": 2500.1, "R1-N": 2900.2, "R1-A": 3100.3, "PP4-B": 1000.0, "PP4-N": 1100.0, "PP4-A": 1200.0}
    one = lambda c: spark.createDataFrame([(text,)], "t string").select(c).first()[0]
    assert one(R.type_of_price(F.lit(2900.205), prices)) == "R1-N" and one(PR.reference_month(F.col("t"), F.lit(""))) == "Março/2025"
    page = 'x href="https://cdn.prod.website-files.com/a/2026_02_CUB%20DES.pdf" y="https://cdn.prod.website-files.com/a/2026_02_CUB.pdf"'
    assert one(PR.table_link(F.lit(page), "f")).endswith("2026_02_CUB.pdf") and one(PR.table_link(F.lit("none"), "f")) == "f"
    told = one(PR.context(PR.price_rows(F.col("t")), F.lit("Maio/2025"), F.lit("u"), F.col("t")))
    assert told.startswith("Sindicato: SINDUSCON NORTE PR\nMes de referencia: Maio/2025\nFonte: u\nValores CUB (R$/m2):\n  PP-4: R$ 1.000,00")


def test_cleaning(spark):
    def one(v, f):
        return spark.createDataFrame([(v,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]

    assert one("[planta.pdf] ** Rua A, 10, x, ~", K.clean_field) == "Rua A, 10" and one("Sol LTDA. ;", K.clean_field) == "Sol LTDA." and one("Rua B, SP", K.clean_field) == "Rua B, SP"
    assert one("Construtora Sol S/A", K.is_company) and not one("Rua do Sol", K.is_company)
    assert one("Ana Souza - CREA 123", K.cut_admin) == "Ana Souza" and one("que 7 estar SOLAR CONSTRUÇÃO LTDA", K.company_start) == "SOLAR CONSTRUÇÃO LTDA"
    assert one("a * b@c", K.noise_name) and not one("Ana Maria Souza", K.noise_name) and one("MATRICULA 5", K.rejected_name)
    assert one("12.5 m²", K.normalise_area_text) == "12,5M2"
    assert one("piso ceramica 3,5 m2", lambda c: K.wet_room_line(F.lit("bwc"), c)) == "BWC CERÂMICA 3,5M2" and one("nada", lambda c: K.wet_room_line(F.lit("bwc"), c)) == ""
    assert one("HABITE-SE 12", K.looks_like_noise) and not one("Sol LTDA Curitiba-PR", K.looks_like_noise) and one("-- ; x", K.looks_like_noise)


def test_patches_apply_in_order(spark):
    base = spark.createDataFrame([("a", "projeto.nomeEdificio", ""), ("a", "responsavel.nome", "ANA")], "doc string, path string, value string")
    rows = [("projeto.nomeEdificio", ", x"), ("projeto.nomeEdificio", "SOL"), ("projeto.nomeEdificio", "LUA"), ("responsavel.nome", "EVA"), ("quadro6.equipamentos", "[]"), ("quadro6.equipamentos", '[{"nome": "Bomba"}]'), ("quadro5.garagens", "x")]
    patches = spark.createDataFrame([("a", i, p, v, "e", "alta") for i, (p, v) in enumerate(rows)], "doc string, pos int, path string, value string, evidence string, confidence string")
    got = {r["pos"]: r["reason"] for r in R.judged_patches(base, patches).collect()}
    assert got == {0: None, 1: None, 2: R.TEXT_STAYS, 3: R.TEXT_STAYS, 4: R.EMPTY_LIST, 5: None, 6: R.NOT_ALLOWED}
    assert {r["path"]: r["value"] for r in R.apply_patches(base, patches).collect()} == {"projeto.nomeEdificio": "SOL", "responsavel.nome": "ANA", "quadro6.equipamentos": '[{"nome": "Bomba"}]'}


def test_drawing_run(spark):
    box = [(1, 0, 100.0, 100.0, 300.0, 100.0), (1, 1, 100.0, 200.0, 300.0, 200.0), (1, 2, 100.0, 100.0, 100.0, 200.0), (1, 3, 200.0, 100.0, 200.0, 200.0), (1, 4, 300.0, 100.0, 300.0, 200.0), (1, 5, 50.0, 50.0, 50.0, 50.0), (1, 6, 800.0, 800.0, 900.0, 800.0)]
    segments = spark.createDataFrame(box, "page int, idx long, x0 double, y0 double, x1 double, y1 double")
    texts = spark.createDataFrame([(1, 150.0, 150.0, "SALA <1> com um nome bem longo")], "page int, px double, py double, label string")
    shapes = spark.createDataFrame([(1, "rect", 10.0, 10.0, 20.0, 20.0), (1, "curve", 900.0, 900.0, 950.0, 950.0)], "page int, kind string, x0 double, top double, x1 double, bottom double")
    run = W.run(segments, texts, shapes)
    assert {r["idx"]: r["bucket"] for r in run.classified.collect()} == {**dict.fromkeys(range(5), "wall_candidates"), 5: "thin_noise", 6: "titleblock_or_legend_noise"}
    assert [r["reason"] for r in run.shapes.collect()] == ["rect_outside_titleblock"]
    assert run.cells.count() == 2 and run.regions.filter("reason = ''").count() == 2
    c = run.composites.collect()
    assert len(c) == 1 and c[0]["cells"] == 2 and c[0]["fill"] == 1.0 and c[0]["reason"] == ""
    svg = run.overlays.first()["svg"]
    assert svg.startswith("<svg") and svg.count('class="cls-wall" x1') == 5 and "<metadata>" in svg and 'id="layer-legend"' in svg and "reason=axis_aligned_long_segment" in svg
    lines = segments.withColumn("kind", G.orientation(*(F.col(x) for x in ("x0", "y0", "x1", "y1"))))
    plain = V.geometry_page(lines, shapes, texts, 1000, 1000).first()["svg"]
    assert plain.count('<line class="geo-line-') == 6 and "SALA &lt;1&gt;" in plain and plain.count('class="geo-curve"') == 1


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\x0ctwo\x0c \x0c")
    (tmp_path / "bad.pdf").write_bytes(b"!")

    def parser(content):
        if content == b"!":
            raise ValueError("bad")
        return [(i, t.decode(), "native") for i, t in enumerate(content.split(b"\x0c"), 1)]

    got = S.read_pages(S.binary_files(spark, str(tmp_path)), parser)
    assert [(r["page"], r["text"]) for r in got.orderBy("page").collect()] == [(1, "one"), (2, "two")]
    assert S.document_text(got).first()["text"] == "one\ntwo"
    big = spark.createDataFrame([(1, 2000.0, 1000.0), (2, 100.0, 100.0)], "page int, width double, height double")
    assert [(r["band"], r["x0"], r["y0"]) for r in S.page_bands(big).collect()] == [("direita", 1560.0, 0.0), ("inferior_direita", 1400.0, 550.0), ("inferior", 0.0, 700.0)]
    bands = spark.createDataFrame([("a", 1, "inferior", "x"), ("a", 1, "direita", "y "), ("a", 1, "inferior_direita", " ")], "doc string, page int, band string, text string")
    assert S.band_text(bands).first()["text"] == "OCR_REGIAO: direita\ny\n\nOCR_REGIAO: inferior\nx"
    assert spark.range(1).select(S.svg_name(F.lit("x.geometria.json"), F.lit(3)).alias("n")).first()["n"] == "x.p003.debug.svg"
    flags = spark.range(1).select(S.has_project_body(F.lit("2 aptos")).alias("a"), S.has_project_body(F.lit("x")).alias("b"), S.needs_recognition(F.lit("short")).alias("c"), S.colour(F.lit("(0.5, 1)")).alias("d"), S.join_texts(F.lit("a "), F.lit(" "), F.lit("b")).alias("e")).first()
    assert flags["a"] and not flags["b"] and flags["c"] and flags["d"] == [0.5, 1.0] and flags["e"] == "a \n\nb"


def test_words_boxes_and_files(spark, tmp_path):
    words = spark.createDataFrame([("bwc", 100.0, 100.0, 120.0, 110.0, 1000.0, 800.0), ("SALA", 0.0, 0.0, 1.0, 1.0, 1000.0, 800.0)], "word string, x0 double, top double, x1 double, bottom double, width double, height double")
    r = S.anchor_crops(words).collect()
    assert len(r) == 1 and (r[0]["left"], r[0]["upper"], r[0]["right"], r[0]["lower"]) == (138, 180, 694, 500)
    box = S.boxes(words.filter("word = 'bwc'")).first()
    assert (box["cx"], box["cy"], box["nx0"], box["ncy"]) == (110.0, 105.0, 0.1, 0.13125)
    rows = spark.createDataFrame([(f"d{i % 3}", i) for i in range(9)], "doc string, v int")
    S.write_json(rows, str(tmp_path / "j"))
    S.write_json(rows, str(tmp_path / "h"), folders=2)
    assert spark.read.json(str(tmp_path / "j")).count() == 9 and spark.read.json(str(tmp_path / "h")).groupBy("doc").count().count() == 3
    assert len(list((tmp_path / "h").glob("bucket=*"))) <= 2
    S.write_svgs(spark.createDataFrame([("a.svg", "<svg/>")], "name string, svg string"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first()["svg"] == "<svg/>"
    elements = S.read_elements(S.binary_files(spark, str(tmp_path / "s"), "*.json"), lambda b: [(1, "line", 0, 0.0, 0.0, 1.0, 1.0, ""), (9, "rect", 0, 0.0, 0.0, 1.0, 1.0, "")], most_pages=3)
    assert [(r["kind"], r["page"]) for r in elements.collect()] == [("line", 1)]
    counts = {r["page"]: (r["lines"], r["elements"]) for r in S.inventory(elements).collect()}
    assert counts == {1: (1, 1), None: (1, 1)}


def test_stream_of_a_document_in_two_batches(spark, tmp_path):
    half = TEXT.index("PAV. TERREO")
    (tmp_path / "in").mkdir()
    page = lambda n, text: json.dumps({"doc": "a", "page": n, "text": text, "arrived": "2024-01-01T00:00:00"}) + "\n"
    seen = []

    def start():
        q = ST.start_records(ST.page_stream(spark, str(tmp_path / "in")), PRICES, lambda df, n: seen.extend(df.collect()), str(tmp_path / "ck"), str(tmp_path / "store"))
        q.awaitTermination(120)

    (tmp_path / "in" / "1.json").write_text(page(1, TEXT[: half - 1]))
    start()
    (tmp_path / "in" / "2.json").write_text(page(2, TEXT[half:]))
    start()
    assert [(r["record"]["projeto"]["numAlvara"], r["record"]["projeto"]["vagasComum"]) for r in seen] == [("2457/2023", 0), ("2457/2023", 55)]
    assert ST.counts(ST.page_stream(spark, str(tmp_path / "in"))).isStreaming


def test_matrix(spark):
    rules = MX.matrix(spark)
    paths = ("quadro3.fundacoes", "quadro3.projetoPadrao.padrao", "quadro5.garagens", "quadro5.pilotis", "projeto.nomeEdificio", "x", "")
    got = {r["path"]: (r["origin"], r["patchable"]) for r in MX.lookup(spark.createDataFrame([(p,) for p in paths], "path string"), rules).collect()}
    assert got == {"quadro3.fundacoes": ("formula_excel", False), "quadro3.projetoPadrao.padrao": ("deterministico", False), "quadro5.garagens": ("calculo", False), "quadro5.pilotis": ("deterministico", False), "projeto.nomeEdificio": ("deterministico", True), "x": (None, False), "": (None, False)}
    assert MX.by_origin(rules, "revisao_manual").count() == 3 and MX.editable_paths(rules).count() == 8 and len(MX.RULES) == 38


def test_region_drawing(spark):
    cells = spark.createDataFrame([(1, 1, 100.0, 100.0, 200.0, 200.0, 10000.0, 1, 1, 2, 1), (1, 2, 200.0, 100.0, 204.0, 200.0, 400.0, 1, 1, 1, 1)], "page int, cell int, left double, top double, right double, bottom double, area double, top_sources int, right_sources int, bottom_sources int, left_sources int")
    got = G.regions(cells, 1000.0, 1000.0)
    assert {r["region"]: r["reason"] for r in got.collect()} == {"p001_r0001": "", "p001_x0001": "width_below_min"}
    assert G.base_cells(got).count() == 2
    svg = V.region_page(got, 1000, 1000).first()["svg"]
    assert svg.count('class="cls-region"') == 1 and svg.count('class="cls-rejected"') == 1 and ">r0001</text>" in svg and "edge_source_counts=top:1,right:1,bottom:2,left:1" in svg
    assert V.region_page(got, 1000, 1000, rejected=False, labels=False).first()["svg"].count("<circle") == 2


def test_evidence_blocks(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    block = FI.HEAD_SECTIONS + "\n\n" + FI.SECTION_HEADS["vi"] + "\nELEVADOR01\nBOMBA\n\n" + FI.SECTION_HEADS["viii"] + "\nHALL PISO VIDRO"
    candidates = FI.HEAD_CANDIDATES + "\n- a\n- b"
    assert one(SE.cut_section_block(F.lit(block), 1000)) == block
    assert one(SE.cut_section_block(F.lit(block), len(block) - 1)) == block.replace("\nBOMBA", "")
    assert one(SE.cut_section_block(F.lit(block), 10)) == one(SE.cut_section_block(F.lit(block), 1)) and "BOMBA" not in one(SE.cut_section_block(F.lit(block), 10))
    assert tuple(one(SE.split_candidates(F.lit(block + "\n\n" + candidates)))) == (block, candidates)
    assert one(SE.cut_candidate_block(F.lit(candidates), len(candidates) - 1)) == FI.HEAD_CANDIDATES + "\n- a" and one(SE.cut_candidate_block(F.lit("x y"), 1)) == "x"
    assert one(SE.cut_patch_block(F.lit(block), F.lit(candidates), len(block) + len(candidates) + 1)) == block.replace("\nBOMBA", "") + "\n\n" + candidates
    assert one(SE.with_patch_evidence(F.lit("resumo longo"), F.lit(""), 5)) == "resumo longo" and one(SE.with_patch_evidence(F.lit("resumo longo"), F.lit(candidates), len(candidates) + 8)) == "resumo\n\n" + candidates
    body = "first part here\n\nsecond part is rather long text"
    head = len(P.HEAD_EVIDENCE) + 2 + len(P.HEAD_BODY)
    assert one(P.combined(F.lit("EV"), F.lit(body), 500)) == P.HEAD_EVIDENCE + "EV" + P.HEAD_BODY + body
    assert one(P.combined(F.lit("EV"), F.lit(body), head + 20)).endswith("first part here") and one(P.combined(F.lit(""), F.lit(body), 5)) == "first"


def test_pages_text_splits_back(spark):
    from granella.operators import lines as L

    whole = D.pages_text(pages(spark)).filter("doc = 'a'")
    assert whole.first()["text"].count("DOCUMENTO: a") == 2 and L.split_documents(whole).filter("name = 'a'").count() == 2


def test_settings_and_command_line(spark, tmp_path, capsys):
    assert ST_.flag("sim", False) and not ST_.flag("nao", True) and ST_.flag("?", True) and ST_.whole("12", 3) == 12 and ST_.whole("-1", 3) == 3 and ST_.whole("x", 3) == 3
    assert ST_.choice("OpenAI", ("openai", "auto"), "auto") == "openai" and ST_.choice("?", ("a",), "a") == "a"
    texts = tmp_path / "t"
    spark.createDataFrame([("a", 1, TEXT)], "doc string, page int, text string").write.json(str(texts))
    CLI.main(["records", str(texts), str(tmp_path / "out")], spark)
    assert spark.read.json(str(tmp_path / "out" / "records")).first()["record"]["projeto"]["numAlvara"] == "2457/2023"
    assert spark.read.json(str(tmp_path / "out" / "cells")).count() > 50 and spark.read.json(str(tmp_path / "out" / "validation")).count() == 1
    lines = tmp_path / "l"
    spark.createDataFrame([(1, 0, 100.0, 100.0, 300.0, 100.0)], "page int, idx long, x0 double, y0 double, x1 double, y1 double").write.json(str(lines))
    CLI.main(["drawings", str(lines), str(tmp_path / "d")], spark)
    assert spark.read.json(str(tmp_path / "d" / "classified")).first()["bucket"] == "wall_candidates" and spark.read.json(str(tmp_path / "d" / "overlays")).count() == 1
