"""Documents, audit records and result rows.

A document is rendered as sections with an ordinal, one row each, and never as one
value: a file of any number of pages is spread over tasks, and a writer that sorts
by (file, ordinal) puts it together line by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import flag_labels, hint_labels, source_label
from ..operators.quality import detail_line

#: The rule between documents, here and below the wording of documents and audit records.
RULE = "=" * 60

#: Columns of a final page: file_id, file_name, page (1-based), text, summary, source, quality_score, char_count,
#: quality_flags, structure_hints, image_count, image_coverage, ocr_image_candidate, extraction_issue, ocr_reason.


def _some(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _line(sep: str = " | ") -> Column:
    return detail_line(F.col("source"), F.coalesce("quality_score", F.lit(0)), F.coalesce("char_count", F.lit(0)), F.col("quality_flags"), F.col("image_count"), F.col("image_coverage"), F.col("ocr_reason"), F.col("extraction_issue"), F.col("structure_hints"))


def _index_line(fmt: str) -> Column:
    sep = ", " if fmt == "md" else " | "
    flags, hints = flag_labels(F.col("quality_flags")), hint_labels(F.col("structure_hints"))
    return F.concat(
        F.lit("- Página " if fmt == "md" else "Página "),
        F.col("page").cast("string"),
        F.lit(" ["),
        source_label(F.col("source")),
        F.lit(f"{sep}qualidade "),
        F.coalesce("quality_score", F.lit(0)).cast("string"),
        F.lit("/100"),
        F.when(F.size(flags) > 0, F.concat(F.lit(f"{sep}alertas: "), F.array_join(flags, ", "))).otherwise(""),
        F.when(F.size(hints) > 0, F.concat(F.lit(f"{sep}estrutura: "), F.array_join(hints, ", "))).otherwise(""),
        F.lit("]: "),
        F.coalesce("summary", F.lit("")),
        F.lit("\n"),
    )


def source_counts(pages: DataFrame) -> DataFrame:
    """file_id, label, n."""
    return pages.groupBy("file_id", source_label(F.col("source")).alias("label")).agg(F.count("*").alias("n"))


def _summary(pages: DataFrame) -> DataFrame:
    """file_id, body: the extraction summary; at most one label per kind of source is gathered for a file."""
    totals = pages.groupBy("file_id").agg(
        F.count("*").alias("pages"),
        F.count_if(F.coalesce("image_count", F.lit(0)) > 0).alias("with_images"),
        F.count_if(F.coalesce("ocr_image_candidate", F.lit(False))).alias("candidates"),
        F.count_if(_some(F.col("extraction_issue"))).alias("issues"),
    )
    labels = source_counts(pages).groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("label", "n"))), lambda x: F.concat(F.lit("- "), x["label"], F.lit(": "), x["n"].cast("string"), F.lit("\n"))), "").alias("labels"))
    issues = F.when(F.col("issues") > 0, F.concat(F.lit("- Páginas com camada nativa incompleta recuperadas por OCR: "), F.col("issues").cast("string"), F.lit("\n"))).otherwise("")
    body = F.concat(
        F.lit("\n## Resumo da extração\n\n- Páginas processadas: "), F.col("pages").cast("string"),
        F.lit("\n- Páginas com elementos gráficos detectados: "), F.col("with_images").cast("string"),
        F.lit("\n- Páginas com imagens relevantes para OCR: "), F.col("candidates").cast("string"),
        F.lit("\n"), issues, F.col("labels"),
    )
    return totals.join(labels, "file_id").select("file_id", body.alias("body"))


def render(pages: DataFrame, fmt: str = "md", own_file: bool = True) -> DataFrame:
    """file_id, part, page, body: sections of every document in the order of (part, page).

    own_file: the document is a file of its own, not a chapter of a compiled one.
    """
    fmt = fmt if fmt in ("md", "txt") else "txt"
    names = pages.groupBy("file_id").agg(F.min("file_name").alias("file_name"))
    last = pages.groupBy("file_id").agg(F.max("page").alias("last"))
    section = lambda df, part, body, page=F.lit(0): df.select("file_id", F.lit(part).alias("part"), page.cast("bigint").alias("page"), body.alias("body"))
    out = []
    if fmt == "md":
        out.append(section(names, 0, F.concat(F.lit("# " if own_file else "# Arquivo: "), F.col("file_name"), F.lit("\n"))))
        out.append(section(_summary(pages), 1, F.col("body")))
        out.append(section(names, 2, F.lit("\n## Índice\n\n")))
    else:
        if not own_file:
            out.append(section(names, 0, F.concat(F.lit("=== ARQUIVO: "), F.col("file_name"), F.lit(" ===\n"))))
        out.append(section(names, 2, F.lit("ÍNDICE (resumo por página)\n------------------------------\n")))
    out.append(section(pages, 3, _index_line(fmt), F.col("page")))
    out.append(section(last, 4, F.lit("\n")))
    before = ("## Página ", "\n\n", "> ", "\n\n") if fmt == "md" else ("=== Página ", " ===\n", "[Meta] ", "\n")
    body = F.concat(F.lit(before[0]), F.col("page").cast("string"), F.lit(before[1]), F.lit(before[2]), _line(), F.lit(before[3]), F.coalesce("text", F.lit("")), F.lit("\n\n"))
    out.append(section(pages, 5, body, F.col("page")))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def compile_report(pages: DataFrame, now: str, fmt: str = "txt") -> DataFrame:
    """ordinal, file_id, part, page, body: all documents in one, header first; the clock is a parameter."""
    rendered = render(pages, fmt, own_file=False)
    files = pages.select("file_id").distinct()
    foot = "\n---\n\n" if fmt == "md" else f"\n{RULE}\n\n"
    parts = rendered.unionByName(files.select("file_id", F.lit(9).alias("part"), F.lit(0).cast("bigint").alias("page"), F.lit(foot).alias("body")))
    total = files.agg(F.count("*").cast("string").alias("n"))
    head = F.concat(F.lit(f"# Relatório compilado\n\n- Gerado em: {now}\n- Total de arquivos: "), "n", F.lit("\n\n")) if fmt == "md" else F.concat(F.lit(f"RELATÓRIO COMPILADO - {now}\nTotal de arquivos: "), "n", F.lit(f"\n{RULE}\n\n"))
    header = total.select(F.lit(0).alias("ordinal"), F.lit("").alias("file_id"), F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("page"), head.alias("body"))
    return header.unionByName(parts.select(F.lit(1).alias("ordinal"), "file_id", "part", "page", "body"))


def audit_records(pages: DataFrame, input_file: str = "input_file", keep: tuple[str, ...] = ()) -> DataFrame:
    """One record per page, its keys in a fixed order; char_count is the raw length of the text; keep: further columns."""
    return pages.select(
        *keep,
        F.col(input_file).alias("input_file"),
        F.col("page").cast("int").alias("page"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("raw_chars", F.lit(0)).cast("bigint").alias("char_count"),
        "source",
        source_label(F.col("source")).alias("source_label"),
        F.coalesce("quality_score", F.lit(0)).cast("bigint").alias("quality_score"),
        F.coalesce("quality_flags", F.array().cast("array<string>")).alias("quality_flags"),
        F.coalesce("structure_hints", F.array().cast("array<string>")).alias("structure_hints"),
        F.coalesce("needs_ocr", F.lit(False)).alias("needs_ocr"),
        F.coalesce("image_count", F.lit(0)).cast("bigint").alias("image_count"),
        F.coalesce("image_coverage", F.lit(0.0)).alias("image_coverage"),
        F.coalesce("ocr_image_candidate", F.lit(False)).alias("ocr_image_candidate"),
        "extraction_issue",
        "ocr_reason",
    )


def outcome(results: DataFrame) -> DataFrame:
    """ok, failed and the exit code of a batch: 2 if any file failed."""
    n = results.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.coalesce("status", F.lit("failed")) != "ok").alias("failed"))
    return n.withColumn("exit_code", F.when(F.col("failed") > 0, 2).otherwise(0).cast("bigint"))
