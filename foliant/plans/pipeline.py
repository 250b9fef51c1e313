"""From input files to documents, audit records and results.

Every input is parsed once: the parsed pages, the OCR results and the final pages are written and read again.  Bytes of
files are never shuffled; tasks that render pages get paths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engines import OcrEngine, PageRenderer
from ..functions import text as T
from ..operators import merge, policy, resume
from ..operators.quality import MIN_CHARS, analysis, structure_hints, summary, with_quality
from ..sinks import audit_name, output_name, relative, remove, taken_names, unique_names, write_audit_files, write_files, write_packed
from ..sources.files import complete_pdf, open_bytes, read_files, read_pages
from . import render

#: Reasons of failure and warnings.
BROKEN_PDF = "PDF sem páginas legíveis, vazio, protegido ou corrompido."
NO_OCR = "OCR desativado; imagens exigem OCR."
NO_ENGINE = "Dependências de OCR ausentes: pdf2image/Poppler e Vision ou Tesseract são obrigatórios."
NO_PAGES, NO_TEXT = "Nenhuma página encontrada.", "Não foi possível extrair texto por camada nativa nem OCR."
UNRELIABLE = "Inspeção inconclusiva: OCR integral ativado para não perder prints ou imagens."
COMPILED = "Compilado (não salvo individualmente)"


def normal_format(name: str | None) -> str:
    """An output format by its name; text where it is none."""
    name = (name or "txt").lower().strip()
    return name if name in ("txt", "md") else "txt"


@dataclass(frozen=True)
class Options:
    """What a run can be asked for; values out of range are refused.

    layout: "files" writes a file for each document, "packed" all documents into few files with an index, for inputs of
    very many files.  workers: the most OCR tasks at a time, all cores if none.
    """

    ocr_threshold: int = 30
    ocr_dpi: int = 300
    lang: str = "por"
    output_format: str = "txt"
    use_ocr: bool = True
    force_ocr: bool = False
    page_audit: bool = False
    compiled: bool = False
    workers: int | None = None
    ocr_backend: str = "auto"
    layout: str = "files"
    drop_state: bool = False

    def __post_init__(self) -> None:
        for name, low, high in (("ocr_threshold", 1, 5000), ("ocr_dpi", 300, 450), ("workers", 1, 32)):
            value = getattr(self, name)
            if value is not None and not low <= value <= high:
                raise ValueError(f"{name} must be from {low} to {high}")
        for name, known in (("output_format", ("txt", "md")), ("ocr_backend", ("auto", "tesseract", "vision")), ("layout", ("files", "packed"))):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} must be one of {', '.join(known)}")

    @classmethod
    def of(cls, **settings) -> Options:
        """Options from loose settings: an unknown output format is text, and OCR is forced only where it is on."""
        settings["output_format"] = normal_format(settings.get("output_format"))
        settings["force_ocr"] = bool(settings.get("force_ocr")) and settings.get("use_ocr", True)
        return cls(**settings)


def score_pages(pages: DataFrame, options: Options) -> DataFrame:
    """Scanned pages with quality, hints, the issue override and whether they are OCR candidates.

    The threshold holds for the native layer of PDF pages, as only these may be read by OCR instead.
    """
    native = F.col("source") == "nativo"
    df = with_quality(pages, "text", "", F.when(native, options.ocr_threshold).otherwise(MIN_CHARS))
    df = policy.with_issue_override(df, "extraction_issue").withColumn("structure_hints", structure_hints(F.col("text")))
    df = df.withColumn("image_coverage", policy.largest(F.col("image_coverages")))
    known = F.when(F.size(F.coalesce("image_coverages", F.array().cast("array<double>"))) > 0, F.col("image_coverage"))
    candidate = policy.image_needs_ocr(F.col("image_count") > 0, known, F.col("char_count"), F.col("quality_score"), F.col("needs_ocr"))
    return df.withColumn("ocr_image_candidate", native & candidate)


def inspections(pages: DataFrame) -> DataFrame:
    """path, reliable, coverage_reliable: whether all pages of a file could be inspected, and all images measured."""
    image = F.coalesce("image_count", F.lit(0)) > 0
    unmeasured = (F.col("source") == "nativo") & image & (F.size(F.coalesce("image_coverages", F.array().cast("array<double>"))) == 0)
    return pages.groupBy("path").agg(F.bool_and(F.coalesce("reliable", F.lit(True))).alias("reliable"), (~F.bool_or(unmeasured)).alias("coverage_reliable"))


def with_force(scored: DataFrame, inspected: DataFrame, force: bool) -> DataFrame:
    """Adds force: OCR of every page, asked for or because the file's inspection is not to be relied on."""
    bad = inspected.where("not reliable").select("path", F.lit(True).alias("_bad"))
    return scored.join(bad, "path", "left").withColumn("force", F.lit(force) | F.coalesce("_bad", F.lit(False))).drop("_bad")


def select_ocr_pages(pages: DataFrame, force: bool = False) -> DataFrame:
    """Pages to read by OCR, with the reason: images, and PDF pages that need it or are candidates; pages may have a column force."""
    force_ = F.col("force") if "force" in pages.columns else F.lit(force)
    image = F.col("source") == "imagem-ocr"
    due = image | ((F.col("source") == "nativo") & (force_ | F.col("needs_ocr") | F.col("ocr_image_candidate")))
    why = policy.ocr_reason(force_, F.col("ocr_image_candidate"), F.col("image_coverage"), F.col("extraction_issue"), F.col("needs_ocr"))
    return pages.where(due).withColumn("ocr_reason", F.when(image, "imagem de entrada").otherwise(why))


def run_ocr(selected: DataFrame, sizes: DataFrame, renderer: Callable[[], PageRenderer], engine: Callable[[], OcrEngine], options: Options) -> DataFrame:
    """path, page_index, ocr_text, ocr_error: contiguous batches of pages, each rendered and read in one task.

    sizes: path and pages; the profile of a file of that size gives the most pages of a batch.  Batches, not files, are
    spread over tasks, so one huge file is no straggler, and they carry the file's path, not its bytes.
    A failed rendering fails its batch, a failed reading its page, a short rendering the pages beyond it; all as rows.
    """
    capped = selected.select("path", "page_index", "source").join(sizes.select("path", F.col("pages").alias("_pages")), "path")
    cap = policy.profile(F.col("_pages"), F.lit(options.ocr_dpi))["render_batch_size"]
    batched = policy.plan_batches(capped, cap, "path")
    groups = batched.groupBy("path", "run", "batch").agg(F.sort_array(F.collect_list("page_index")).alias("pages"), F.max("source").alias("source"))
    keys = ["path", "run", "batch"]
    spread = groups.repartition(options.workers, *keys) if options.workers else groups.repartition(*keys)
    work = spread.sortWithinPartitions(*keys).select("path", "pages", "source")
    lang, dpi = options.lang, options.ocr_dpi

    def run(batches):
        import pyarrow as pa

        reader, drawer = engine(), renderer()
        held: tuple[str | None, bytes] = (None, b"")  # batches of a file follow each other
        for b in batches:
            for path, pages, source in zip(*(b.column(c).to_pylist() for c in ("path", "pages", "source")), strict=True):
                out = []
                try:
                    if source != "imagem-ocr" and hasattr(drawer, "render_path"):
                        images = list(drawer.render_path(path, pages, dpi))
                    else:
                        if held[0] != path:
                            held = (path, open_bytes(path))
                        images = [held[1]] if source == "imagem-ocr" else list(drawer.render(held[1], pages, dpi))
                except Exception as e:  # noqa: BLE001
                    images = None
                    out += [(path, p, None, f"Falha ao renderizar páginas {pages[0] + 1}-{pages[-1] + 1}: {e}") for p in pages]
                if images is not None:
                    short = f"Renderização incompleta nas páginas {pages[0] + 1}-{pages[-1] + 1}: {len(images)} imagem(ns) para {len(pages)} página(s)."
                    out += [(path, p, None, short) for p in pages[len(images) :]]
                    for p, image in zip(pages, images):
                        try:
                            out.append((path, p, reader.read(image, lang), None))
                        except Exception as e:  # noqa: BLE001
                            out.append((path, p, None, f"OCR falhou na página {p + 1}: {e}"))
                cols = list(zip(*out)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["path", "page_index", "ocr_text", "ocr_error"])

    return work.mapInArrow(run, OCR_SCHEMA)


OCR_SCHEMA = "path string, page_index int, ocr_text string, ocr_error string"


def resumed_ocr(spark: SparkSession, selected: DataFrame, files: DataFrame, sizes: DataFrame, renderer: Callable[[], PageRenderer], engine: Callable[[], OcrEngine], options: Options, state: str) -> DataFrame:
    """OCR of the pages the state does not hold for this file, time, settings and version; failed pages are read again."""
    settings = {"backend": options.ocr_backend, "dpi": options.ocr_dpi, "force": options.force_ocr, "lang": options.lang, "threshold": options.ocr_threshold}
    prints = files.select("path", resume.fingerprint(F.col("path"), F.col("length"), F.unix_micros("mtime"), settings).alias("fingerprint"))
    keys = ["path", "fingerprint", "page_index"]
    due = selected.join(prints, "path")
    held = resume.read_state(spark, state, "path string, fingerprint string, page_index int, ocr_text string, ocr_error string")
    todo = resume.pending(due, held.where("ocr_error is null"), keys)
    run_ocr(todo, sizes, renderer, engine, options).join(prints, "path").select("path", "fingerprint", "page_index", "ocr_text", "ocr_error").write.mode("append").parquet(state)
    now = spark.read.parquet(state).join(prints, ["path", "fingerprint"], "left_semi")
    # a page that failed once and was read later counts as read
    best = now.groupBy("path", "page_index").agg(F.max("ocr_text").alias("ocr_text"), F.max("ocr_error").alias("ocr_error"))
    return best.withColumn("ocr_error", F.when(F.col("ocr_text").isNull(), F.col("ocr_error")))


def final_pages(scored: DataFrame, selected: DataFrame, ocr: DataFrame, options: Options) -> DataFrame:
    """Every page with the text that is kept and its details.

    A page that was not read keeps its native details, with the threshold and the flag of an issue; one that was read has
    those of what is kept: of the OCR text by the same threshold, of both texts by the default one, of the native text its
    score without flags.
    """
    reasons = selected.select("path", "page_index", "ocr_reason")
    df = scored.join(reasons, ["path", "page_index"], "left").join(ocr, ["path", "page_index"], "left")
    df = with_quality(df, "ocr_text", "o_", options.ocr_threshold)
    df = df.withColumnRenamed("source", "scan").withColumnRenamed("text", "native_text").withColumnRenamed("structure_hints", "_hints")
    df = df.withColumn("native_analysis", analysis()).withColumn("ocr_analysis", analysis("o_")).withColumn("_read", F.col("ocr_text").isNotNull() & (F.col("scan") == "nativo"))
    force = F.col("force") if "force" in df.columns else F.lit(options.force_ocr)
    pick = merge.reconcile(df.withColumn("force_ocr", force).withColumn("preserve_both", F.col("ocr_image_candidate") | (F.coalesce("extraction_issue", F.lit("")) != "")))
    image = F.col("scan") == "imagem-ocr"
    text = F.when(image, F.coalesce("ocr_text", F.lit(""))).when(F.col("_read"), F.col("text")).otherwise(F.coalesce("native_text", F.lit("")))
    kept = pick.withColumn("_source", F.when(F.col("_read"), F.col("source")).otherwise(F.col("scan"))).withColumn("_text", text)
    kept = with_quality(kept, "_text", "m_", MIN_CHARS)
    ocr_kept, native_kept = F.col("_read") & (F.col("_source") == "ocr"), F.col("_read") & (F.col("_source") == "nativo")
    not_read = ~F.col("_read") & ~image

    def detail(name: str) -> Column:
        return F.when(ocr_kept, F.col(f"ocr_analysis.{name}")).when(native_kept | not_read, F.col(f"native_analysis.{name}")).otherwise(F.col(f"m_{name}"))

    flags = F.when(native_kept, F.array().cast("array<string>")).otherwise(detail("flags"))
    return kept.select(
        F.col("path").alias("file_id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"), (F.col("page_index") + 1).cast("bigint").alias("page"), F.col("_text").alias("text"), summary(F.col("_text")).alias("summary"), F.col("_source").alias("source"), detail("quality_score").alias("quality_score"), detail("char_count").alias("char_count"),
        F.length("_text").cast("bigint").alias("raw_chars"), flags.alias("quality_flags"), F.when(not_read, F.col("_hints")).otherwise(structure_hints(F.col("_text"))).alias("structure_hints"), detail("needs_ocr").alias("needs_ocr"), "image_count", F.round(F.coalesce("image_coverage", F.lit(0.0)), 6).alias("image_coverage"), "ocr_image_candidate", "extraction_issue",
        F.when(F.col("_read") | image, F.col("ocr_reason")).alias("ocr_reason"), "ocr_error",
    )


def page_preview(pages: DataFrame, key: str, page: str, most: int = 8) -> DataFrame:
    """key, preview: a group's first pages in order, with dots where there are more; only these are gathered."""
    from pyspark.sql import Window as W

    due = pages.select(key, page).distinct()
    first = due.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(page))).where(F.col("_k") <= most)
    shown = first.groupBy(key).agg(F.sort_array(F.collect_list(page)).alias("_p")).join(due.groupBy(key).agg(F.count("*").alias("_n")), key)
    return shown.select(key, F.concat(F.array_join(F.col("_p").cast("array<string>"), ", "), F.when(F.col("_n") > most, "...").otherwise("")).alias("preview"))


def warnings(pages: DataFrame) -> DataFrame:
    """One row per page whose OCR went wrong: file_id, page, warning."""
    return pages.where("ocr_error is not null").select("file_id", "page", F.col("ocr_error").alias("warning"))


def file_warnings(parsed: DataFrame, inspected: DataFrame, final: DataFrame, use_ocr: bool) -> DataFrame:
    """path, warnings: a file's distinct warnings in order: of the inspection, then of OCR by page."""
    none = F.size(F.coalesce("image_coverages", F.array().cast("array<double>"))) == 0
    unmeasured = parsed.where((F.col("source") == "nativo") & (F.coalesce("image_count", F.lit(0)) > 0) & none)
    areas = page_preview(unmeasured.withColumn("_page", F.col("page_index") + 1), "path", "_page").select("path", F.lit(-2).cast("bigint").alias("at"), F.concat(F.lit("Não foi possível medir a área das imagens nas páginas "), "preview", F.lit(".")).alias("warning"))
    forced = inspected.where(F.lit(use_ocr) & ~F.col("reliable")).select("path", F.lit(-1).cast("bigint").alias("at"), F.lit(UNRELIABLE).alias("warning"))
    read = warnings(final).groupBy(F.col("file_id").alias("path"), "warning").agg(F.min("page").alias("at")).select("path", "at", "warning")
    every = areas.unionByName(forced).unionByName(read)
    return every.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "warning"))), lambda x: x["warning"]).alias("warnings"))


def results(files: DataFrame, pages: DataFrame, errors: DataFrame, options: Options, warned: DataFrame | None = None, now: str = "") -> DataFrame:
    """One row per input file: status, failure, pages, warnings, profile and the numbers of its pages with images.

    A file's index and page details are its rows of the final pages; they are not gathered into one value.
    """
    image = F.coalesce("image_count", F.lit(0)) > 0
    n = pages.groupBy(F.col("file_id").alias("path")).agg(
        F.count("*").alias("pages"), F.max(F.col("char_count") > 0).alias("some"), F.sum("raw_chars").alias("chars"),
        F.sort_array(F.collect_list(F.when(image, F.col("page").cast("int")))).alias("image_pages"), F.sort_array(F.collect_list(F.when(F.col("ocr_image_candidate"), F.col("page").cast("int")))).alias("ocr_image_pages"),
    )
    first = errors.groupBy("path").agg(F.min("error").alias("error"))
    df = files.select("path", "ordinal_key").join(n, "path", "left").join(first, "path", "left")
    df = df.join(warned, "path", "left") if warned is not None else df.withColumn("warnings", F.lit(None).cast("array<string>"))
    why = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("pages").isNull(), NO_PAGES).when(~F.col("some"), NO_TEXT)
    ok, none = why.isNull(), F.array().cast("array<int>")
    return df.select(
        F.col("path").alias("input_path"), F.lit(options.output_format).alias("output_format"), F.when(ok, F.col("pages")).otherwise(0).alias("pages"), F.when(ok, F.col("chars")).otherwise(0).alias("chars"), F.lit(now).alias("processed_at"), F.when(ok, "ok").otherwise("failed").alias("status"), why.alias("failure"),
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"), F.when(ok, policy.profile(F.col("pages"), F.lit(options.ocr_dpi))["name"]).alias("processing_profile"),
        F.when(ok, F.col("image_pages")).otherwise(none).alias("image_pages"), F.when(ok, F.col("ocr_image_pages")).otherwise(none).alias("ocr_image_pages"), "ordinal_key",
    )


def with_outputs(table: DataFrame, root: str | None, options: Options, taken: DataFrame | None = None, audits: DataFrame | None = None) -> DataFrame:
    """Adds output_path and page_audit_path, relative to the output's documents and audit folders, free among those taken."""
    rel = relative(F.col("input_path"), root)
    ok = table.where("status = 'ok'").withColumn("_rel", rel)
    named = ok.withColumn("_t", output_name(F.col("_rel"), f".{options.output_format}"))
    named = unique_names(named, "_t", ["ordinal_key"], taken).withColumnRenamed("name", "output_path")
    if options.compiled:
        named = named.withColumn("output_path", F.lit(COMPILED))
    named = unique_names(named.withColumn("_a", audit_name(F.col("_rel"))), "_a", ["ordinal_key"], audits)
    named = named.select("input_path", "output_path", F.when(F.lit(options.page_audit), F.col("name")).alias("page_audit_path"))
    return table.join(named, "input_path", "left").withColumn("output_path", F.coalesce("output_path", F.lit("")))


def convert(
    spark: SparkSession, inputs: str | Iterable[str], out_dir: str, engine: Callable[[], OcrEngine] | None = None, renderer: Callable[[], PageRenderer] | None = None, options: Options | None = None, now: str = "", state: str | None = None, tag: str | None = None, **settings
) -> DataFrame:
    """Read, score, OCR where due, reconcile and write; returns the results.

    Written to out_dir: documents and audit (one file each under the result's paths, or packed), or compiled; pages, the
    final pages with a file's index and details.  state: a folder that keeps OCR results over runs, so an interrupted run
    goes on where it stopped.  tag: spark.interruptTag(tag) from another thread stops the run; the state stays.
    """
    options = options or Options.of(**settings)
    if tag:
        spark.addTag(tag)
    try:
        return _convert(spark, inputs, out_dir, engine, renderer, options, now, state)
    finally:
        if tag:
            spark.removeTag(tag)


def _convert(spark, inputs, out_dir, engine, renderer, options: Options, now: str, state: str | None) -> DataFrame:
    work = f"{out_dir}/_work"

    def written(df: DataFrame, where: str) -> DataFrame:
        df.write.mode("overwrite").parquet(where)
        return spark.read.parquet(where)

    files = read_files(spark, inputs)
    facts = files.drop("content")
    whole = files.where((F.col("ext") != ".pdf") | complete_pdf(F.col("content")))
    parsed = written(read_pages(whole), f"{work}/parsed")
    good = parsed.where("error is null")
    broken = facts.join(parsed.select("path").distinct(), "path", "left_anti").select("path", F.lit(BROKEN_PDF).alias("error"))
    errors = parsed.where("error is not null").select("path", "error").unionByName(broken)
    inspected = inspections(good)
    scored = with_force(score_pages(good, options), inspected, options.force_ocr)
    selected = select_ocr_pages(scored)
    sizes = good.groupBy("path").agg(F.count("*").alias("pages"))
    ready = options.use_ocr and engine is not None and renderer is not None
    if not options.use_ocr:
        errors = errors.unionByName(good.where("source = 'imagem-ocr'").select("path", F.lit(NO_OCR).alias("error")))
    elif not ready:
        errors = errors.unionByName(selected.select("path", F.lit(NO_ENGINE).alias("error")).distinct())
    if ready and state:
        ocr = resumed_ocr(spark, selected, facts, sizes, renderer, engine, options, state)
    elif ready:
        ocr = written(run_ocr(selected, sizes, renderer, engine, options), f"{work}/ocr")
    else:
        ocr = spark.createDataFrame([], OCR_SCHEMA)
    final = written(final_pages(scored, selected, ocr, options), f"{out_dir}/pages")
    errors = written(errors, f"{work}/errors")
    root = inputs if isinstance(inputs, str) else None
    made = taken_names(spark, f"{out_dir}/documents"), taken_names(spark, f"{out_dir}/audit")
    table = results(facts, final, errors, options, file_warnings(good, inspected, final, options.use_ocr), now)
    table = written(with_outputs(table, root, options, *made), f"{out_dir}/_results")
    done = final.join(table.where("status = 'ok'").select(F.col("input_path").alias("file_id"), "output_path", "page_audit_path"), "file_id")
    if options.compiled:
        parts = render.compile_report(done, now, options.output_format)
        parts.repartitionByRange("ordinal", "file_id", "part", "page").sortWithinPartitions("ordinal", "file_id", "part", "page").select(F.regexp_replace("body", r"\n$", "").alias("value")).write.mode("overwrite").text(f"{out_dir}/compiled")
    else:
        sections = render.render(done, options.output_format)
        if options.layout == "packed":
            write_packed(sections, f"{out_dir}/documents")
        else:
            paths = table.where("status = 'ok'").select(F.col("input_path").alias("file_id"), F.col("output_path").alias("target"))
            write_files(sections.join(paths, "file_id"), f"{out_dir}/documents", ["part", "page"])
    if options.page_audit:
        records = render.audit_records(done.withColumn("input_file", F.col("file_id")).withColumn("target", F.col("page_audit_path")), keep=("target",))
        write_audit_files(records, f"{out_dir}/audit")
    remove(spark, work)
    if state and options.drop_state and not table.where("status <> 'ok'").limit(1).count():
        remove(spark, state)
    return table.drop("ordinal_key")
