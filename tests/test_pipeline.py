"""Files in, documents out, with stub engines."""

import json
import zipfile
import zlib

import pytest

from foliant.engines import StubEngine, StubRenderer
from foliant.plans.pipeline import Options, convert
from foliant.sources.files import complete_pdf, docx_text, read_files, read_pages
from foliant.sources.pdf import read_pdf
from foliant.streaming.incremental import score_stream
from pyspark.sql import functions as F

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
P = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"


def docx(path):
    table = f"<w:tbl><w:tr><w:tc>{P.format('a  b')}</w:tc><w:tc>{P.format('c')}</w:tc></w:tr><w:tr><w:tc>{P.format(' ')}</w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{table}{P.format('corpo')}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {NS}>{P.format('topo')}</w:hdr>")
        z.writestr("word/footer1.xml", f"<w:ftr {NS}>{P.format('rodapé')}</w:ftr>")


def pdf(pages, flate=True):
    """A small file: each page a text, and an image drawn over a share of it."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Subtype /Image /Length 0 >>\nstream\n\nendstream"}
    kids = []
    for k, (text, share) in enumerate(pages):
        page, body = 10 + 2 * k, 11 + 2 * k
        kids.append(f"{page} 0 R")
        draw = f"q {595 * share} 0 0 842 0 0 cm /Im0 Do Q " if share else ""
        data = (f"BT /F1 12 Tf 50 700 Td ({text}) Tj ET " + draw).encode("cp1252")
        head = b"<< /Filter /FlateDecode >>" if flate else b"<< >>"
        objects[body] = head + b"\nstream\n" + (zlib.compress(data) if flate else data) + b"\nendstream"
        objects[page] = f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /XObject << /Im0 3 0 R >> >> /Contents {body} 0 R >>".encode()
    objects[2] = f"<< /Type /Pages /Kids [{' '.join(kids)}] >>".encode()
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer\n%%EOF\n"


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.Md").write_text("# Título\n\nTexto do arquivo markdown com mais de trinta letras.", encoding="utf-8")
    (tmp_path / "sub/ruim.md").write_bytes(b"\xff\xfe\xfa")
    docx(tmp_path / "b.docx")
    (tmp_path / "quebrado.pdf").write_bytes(b"%PDF-1.4 sem fim")
    (tmp_path / "a.PDF").write_bytes(pdf([("Documento A pagina um com texto suficiente.", 0.5), ("Segunda pagina do documento, sem imagem.", 0)]))
    (tmp_path / "foto.png").write_bytes("texto lido na foto".encode())
    (tmp_path / "nada.csv").write_text("x")
    return tmp_path


def test_docx_order(folder):
    assert docx_text((folder / "b.docx").read_bytes()) == "topo\ncorpo\na b\tc\nrodapé"


@pytest.mark.parametrize("flate", [True, False])
def test_pdf_text_and_coverage(flate):
    a, b = read_pdf(pdf([("Ola \\(mundo\\) \\351", 0.25), ("dois", 0)], flate))
    assert (a.text, a.image_count, [round(x, 6) for x in a.coverages]) == ("Ola (mundo) é", 1, [0.25])
    assert (b.text, b.coverages) == ("dois", [])


def test_discovery_and_isolation(spark, folder):
    files = read_files(spark, str(folder))
    assert [r.path.rsplit("/", 1)[1] for r in files.orderBy("ordinal_key").collect()] == ["a.PDF", "b.docx", "b.Md", "foto.png", "quebrado.pdf", "ruim.md"]
    assert {r.ext: r.ok for r in files.where("ext = '.pdf'").select("ext", complete_pdf(F.col("content")).alias("ok")).orderBy("ok").collect()} == {".pdf": True}
    pages = read_pages(files).collect()
    assert sum(r.error is not None for r in pages) == 2 and sum(r.error is None for r in pages) == 5


def test_convert(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    options = Options(output_format="md", page_audit=True)
    table = {r.input_path.rsplit("/", 1)[1]: r for r in convert(spark, str(folder), out, StubEngine, StubRenderer, options).collect()}
    assert {k: r.status for k, r in table.items()} == {"a.PDF": "ok", "b.Md": "ok", "b.docx": "ok", "foto.png": "ok", "quebrado.pdf": "failed", "ruim.md": "failed"}
    assert table["b.docx"].output_path == "b.md" and table["b.Md"].output_path == "b_2.md"
    text = "\n".join(r.value for r in spark.read.text(f"{out}/documents").collect())
    assert "## Resumo da extração" in text and "### Conteúdo adicional detectado por OCR" in text and "texto lido na foto" in text
    audit = [json.loads(r.value) for r in spark.read.text(f"{out}/audit").collect()]
    first = next(a for a in audit if a["input_file"].endswith("a.PDF") and a["page"] == 1)
    assert first["source"] == "nativo+ocr" and first["ocr_reason"].startswith("imagem relevante detectada (50.0%") and len(first) == 15


def test_compiled_and_no_ocr(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    table = convert(spark, str(folder), out, options=Options(use_ocr=False, compiled=True), now="agora")
    assert table.where("status = 'ok'").count() == 3  # the image has no text without OCR
    lines = [r.value for r in spark.read.text(f"{out}/compiled").collect()]
    assert lines[0] == "RELATÓRIO COMPILADO - agora" and lines[1] == "Total de arquivos: 3"


def test_options_are_checked():
    for bad in ({"ocr_dpi": 200}, {"ocr_threshold": 0}, {"output_format": "pdf"}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_stream_scores_each_page_once(spark, tmp_path):
    src, state, check = (str(tmp_path / x) for x in ("src", "state", "check"))
    schema = "file_id string, page_index int, text string"
    for rows in ([("f", 0, "um"), ("f", 0, "um")], [("f", 0, "um"), ("f", 1, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        score_stream(spark, src, schema, state, check, ["file_id", "page_index"]).awaitTermination()
    got = spark.read.parquet(state)
    assert sorted((r.page_index, r.quality_score) for r in got.collect()) == [(0, 55), (1, 0)]


def test_an_interrupted_run_goes_on(spark, folder, tmp_path_factory):
    out, state = str(tmp_path_factory.mktemp("out")), str(tmp_path_factory.mktemp("state") / "ocr")
    first = convert(spark, str(folder), out, StubEngine, StubRenderer, Options(), state=state).count()
    rows = spark.read.parquet(state).count()
    assert rows and convert(spark, str(folder), out, StubEngine, StubRenderer, Options(), state=state).count() == first
    assert spark.read.parquet(state).count() == rows  # nothing was read again
    convert(spark, str(folder), out, StubEngine, StubRenderer, Options(ocr_dpi=400), state=state).count()
    assert spark.read.parquet(state).count() == 2 * rows  # other settings, other results


def test_command_line(spark, folder, tmp_path_factory):
    from foliant.__main__ import main

    out = str(tmp_path_factory.mktemp("cli"))
    assert main([str(folder), out, "--output-format", "md", "--engine", "foliant.engines:StubEngine", "--renderer", "foliant.engines:StubRenderer"]) == 2
    assert spark.read.parquet(f"{out}/results").count() == 6


def test_outputs_are_where_the_results_say(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    (folder / "sub/outro.md").write_text("# Outro\n\nUm texto com mais de trinta letras para ler.", encoding="utf-8")
    for round_ in (1, 2):  # a second run takes free names
        rows = {r.input_path.rsplit("/", 1)[1]: r for r in convert(spark, str(folder), out, StubEngine, StubRenderer, output_format="md", page_audit=True, now="agora").collect()}
        end = "" if round_ == 1 else "_2"
        assert rows["outro.md"].output_path == f"sub/outro{end}.md" and rows["outro.md"].page_audit_path == f"sub/outro_paginas{end}.jsonl"
        for r in rows.values():
            assert (r.status == "ok") == bool(r.output_path) and r.processed_at == "agora"
            if r.output_path:
                with open(f"{out}/documents/{r.output_path}", encoding="utf-8") as f:
                    assert f.read().startswith(f"# {r.input_path.rsplit('/', 1)[1]}\n\n## Resumo")
                with open(f"{out}/audit/{r.page_audit_path}", encoding="utf-8") as f:
                    assert [json.loads(x)["page"] for x in f] == list(range(1, r.pages + 1))
    a = rows["a.PDF"]
    assert (a.processing_profile, a.image_pages, a.ocr_image_pages, a.pages) == ("pequeno", [1, 2], [1, 2], 2)
    assert a.warnings == ["Não foi possível medir a área das imagens nas páginas 2."]  # its image is not drawn
    assert rows["quebrado.pdf"].failure.startswith("PDF sem páginas")


def test_packed_layout_and_state_dropped(spark, folder, tmp_path_factory):
    (folder / "quebrado.pdf").unlink()
    (folder / "sub/ruim.md").unlink()
    out, state = str(tmp_path_factory.mktemp("out")), tmp_path_factory.mktemp("state") / "ocr"
    convert(spark, str(folder), out, StubEngine, StubRenderer, state=str(state), layout="packed", drop_state=True)
    packed = spark.read.parquet(f"{out}/documents")
    assert packed.select("file_id").distinct().count() == 4 and not state.exists()


def test_missing_engine_fails_files_with_pages_due(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    got = {r.input_path.rsplit("/", 1)[1]: r.failure for r in convert(spark, str(folder), out).collect()}
    assert got["a.PDF"].startswith("Dependências de OCR ausentes") and got["foto.png"].startswith("Dependências de OCR ausentes") and got["b.Md"] is None
    got = {r.input_path.rsplit("/", 1)[1]: r.failure for r in convert(spark, str(folder), out, use_ocr=False).collect()}
    assert got["foto.png"] == "OCR desativado; imagens exigem OCR." and got["a.PDF"] is None


def test_unreliable_inspection_forces_ocr(spark):
    from foliant.plans import pipeline as L

    pages = spark.createDataFrame([("x", 0, True), ("x", 1, False), ("y", 0, True)], "path string, page_index int, reliable boolean").selectExpr("*", "'nativo' AS source", "'um texto com mais de trinta letras, sem imagem' AS text", "0 AS image_count", "cast(null as array<double>) AS image_coverages", "cast(null as string) AS extraction_issue")
    scored = L.with_force(L.score_pages(pages, Options()), L.inspections(pages), False)
    due = {(r.path, r.page_index): r.ocr_reason for r in L.select_ocr_pages(scored).collect()}
    assert due == {("x", 0): "OCR integral solicitado", ("x", 1): "OCR integral solicitado"}
    none = spark.createDataFrame([], L.OCR_SCHEMA)
    final = L.final_pages(scored, L.select_ocr_pages(scored), none, Options())
    warned = {r.path: r.warnings for r in L.file_warnings(pages, L.inspections(pages), final, True).collect()}
    assert warned == {"x": [L.UNRELIABLE]}


def test_details_are_those_of_what_is_kept(spark):
    from foliant.plans import pipeline as L

    rows = [("a", 0, "curto, mas com quarenta letras ao menos aqui", None), ("b", 0, "x" * 20, "lacuna"), ("c", 0, "um texto nativo bom e longo o bastante para ficar", None)]
    pages = spark.createDataFrame(rows, "path string, page_index int, text string, extraction_issue string").selectExpr("*", "true AS reliable", "'nativo' AS source", "0 AS image_count", "cast(null as array<double>) AS image_coverages")
    options = Options(ocr_threshold=100)
    scored = L.score_pages(pages, options)
    ocr = spark.createDataFrame([("c", 0, "", None)], L.OCR_SCHEMA)
    got = {r.file_id: (r.source, r.quality_flags, r.needs_ocr) for r in L.final_pages(scored, L.select_ocr_pages(scored), ocr, options).collect()}
    assert got == {"a": ("nativo", ["texto-curto"], False), "b": ("nativo", ["texto-curto", "camada-nativa-incompleta"], True), "c": ("nativo", [], False)}


def test_no_bytes_cross_an_exchange(spark, folder):
    from foliant.plans import pipeline as L

    files = read_files(spark, str(folder))
    pages = read_pages(files).where("error is null")
    scored = L.score_pages(pages, Options())
    ocr = L.run_ocr(L.select_ocr_pages(scored), pages.groupBy("path").agg(F.count("*").alias("pages")), StubRenderer, StubEngine, Options())
    plan = ocr._jdf.queryExecution().optimizedPlan().toString()
    assert "binaryFile" in plan or "Relation" in plan
    for line in plan.splitlines():
        if "Repartition" in line or "Join" in line or "Aggregate" in line:
            assert "content" not in line
    assert ocr.where("ocr_error is null").count() == 3


def test_lists_keep_their_order_and_skip_what_is_missing(spark, folder):
    given = [str(folder / x) for x in ("b.docx", "nada.csv", "a.PDF", "fehlt.md", "sub", "b.docx")]
    assert [r.path.rsplit("/", 1)[1] for r in read_files(spark, given).orderBy("ordinal_key").collect()] == ["b.docx", "a.PDF"]
    assert read_files(spark, [str(folder / "fehlt.md")]).count() == 0


def test_loose_options():
    assert Options.of(output_format="pdf").output_format == "txt" and Options.of(output_format=" MD ").output_format == "md"
    assert Options.of(use_ocr=False, force_ocr=True).force_ocr is False
    for bad in ({"workers": 33}, {"ocr_backend": "x"}, {"layout": "x"}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_engines_by_backend():
    from foliant.engines import dispatch, preflight

    class Bad:
        def read(self, image, lang):
            raise RuntimeError("no")

    assert dispatch("auto", Bad, StubEngine)().read(b"x", "por") == "x" and dispatch("tesseract", Bad, StubEngine) is StubEngine
    assert dispatch("vision", None, None) is None and len(preflight(None, None, "por")) == 2 and preflight(StubEngine, StubRenderer, "por") == []


def test_stopped_runs_keep_their_state(spark, folder, tmp_path_factory):
    import threading

    out, state = str(tmp_path_factory.mktemp("out")), str(tmp_path_factory.mktemp("state") / "ocr")
    first = convert(spark, str(folder), out, StubEngine, StubRenderer, state=state).count()
    held = spark.read.parquet(state).count()
    timer = threading.Timer(0.3, spark.interruptTag, ["parar"])
    timer.start()
    try:
        convert(spark, str(folder), out, StubEngine, StubRenderer, state=state, tag="parar")
    except Exception:  # noqa: BLE001  stopped
        pass
    timer.join()
    assert spark.read.parquet(state).count() == held
    assert convert(spark, str(folder), out, StubEngine, StubRenderer, state=state).count() == first
