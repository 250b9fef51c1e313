"""Decisions about pages: which are read by OCR and why, processing profiles, contiguous batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quality import percent

TINY, FULL = 0.025, 0.65
FULL_TEXT_CHARS, FULL_TEXT_SCORE = 900, 70

#: Page limits of profiles, with batch size and the two spill thresholds.
PROFILES = ((250, "pequeno", 50, 250, 2_000_000), (2_000, "grande", 32, 120, 1_000_000), (5_000, "muito-grande", 24, 80, 750_000), (None, "gigante", 16, 50, 500_000))


def image_needs_ocr(has_image: Column, coverage: Column, chars: Column, score: Column, needs_ocr: Column) -> Column:
    """coverage: of the largest image, null where placements are unknown, which is taken as a reason for OCR."""
    healthy = (F.coalesce(chars, F.lit(0)) >= FULL_TEXT_CHARS) & (F.coalesce(score, F.lit(0)) >= FULL_TEXT_SCORE) & ~F.coalesce(needs_ocr, F.lit(False))
    return F.when(~F.coalesce(has_image, F.lit(False)), False).when(coverage.isNull(), True).when(coverage < TINY, False).when((coverage >= FULL) & healthy, False).otherwise(True)


def largest(coverages: Column) -> Column:
    """The largest of a page's coverages; null for none."""
    return F.array_max(F.transform(coverages, lambda x: F.coalesce(x, F.lit(0.0))))


def ocr_reason(force: Column, candidate: Column, coverage: Column, issue: Column, needs_ocr: Column) -> Column:
    flagged = F.coalesce(issue, F.lit("")) != ""
    relevant = F.when(F.coalesce(coverage, F.lit(0.0)) != 0, F.concat(F.lit("imagem relevante detectada ("), percent(coverage), F.lit("% da página)"))).otherwise("imagem relevante detectada")
    text = F.concat_ws(
        "; ",
        F.when(force, "OCR integral solicitado"),
        F.when(candidate, relevant),
        F.when(flagged, "camada nativa incompleta"),
        F.when(needs_ocr & ~flagged, "texto nativo ausente ou de baixa qualidade"),
    )
    return F.when(text == "", "verificação OCR").otherwise(text)


def with_issue_override(df: DataFrame, issue: str, flags: str = "flags", needs_ocr: str = "needs_ocr") -> DataFrame:
    """A page with an extraction issue needs OCR and says so in its flags; its score stays."""
    flagged = F.coalesce(F.col(issue), F.lit("")) != ""
    own = F.coalesce(F.col(flags), F.array().cast("array<string>"))
    return df.withColumn(flags, F.when(flagged, F.array_append(own, "camada-nativa-incompleta")).otherwise(own)).withColumn(needs_ocr, flagged | F.coalesce(F.col(needs_ocr), F.lit(False)))


def joined_issues(messages: DataFrame, keys: list[str], order: str, message: str) -> DataFrame:
    """The distinct messages of each key in order of first appearance, joined; gathered after they are made distinct."""
    first = messages.groupBy(*keys, message).agg(F.min(order).alias("_at"))
    gathered = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", message))).alias("_all"))
    return gathered.select(*keys, F.array_join(F.transform("_all", lambda x: x[message]), "; ").alias("issue"))


def profile(pages: Column, dpi: Column) -> Column:
    n = F.greatest(F.lit(0), F.coalesce(pages, F.lit(0)))
    out = None
    for limit, name, batch, page_spill, char_spill in PROFILES:
        one = F.struct(F.lit(name).alias("name"), F.lit(batch).alias("render_batch_size"), F.lit(page_spill).alias("page_spill_threshold"), F.lit(char_spill).alias("char_spill_threshold"), F.greatest(F.lit(300), F.least(F.lit(450), F.coalesce(F.nullif(dpi, F.lit(0)), F.lit(300)))).alias("ocr_dpi"))
        out = (F.when(n <= limit, one) if out is None else out.when(n <= limit, one)) if limit else out.otherwise(one)
    return out


#: Pages of a file that are ranked in one task; a longer file is ranked in parts whose counts are then added up.
PART_PAGES = 65_536


def plan_batches(pages: DataFrame, cap: Column | int, file_id: str = "file_id", page: str = "page_index") -> DataFrame:
    """Adds run and batch: runs of consecutive pages of a file, cut at cap pages.

    Pages of a file must be distinct.  A file's pages are ranked by parts, so a file that holds a third of all pages is
    spread over tasks; what is gathered by file is one count a part.
    """
    cap = F.lit(cap) if isinstance(cap, int) else cap
    df = pages.withColumn("_part", F.floor(F.col(page) / PART_PAGES))
    df = df.withColumn("_rank", F.row_number().over(W.partitionBy(file_id, "_part").orderBy(page)))
    before = W.partitionBy(file_id).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = df.groupBy(file_id, "_part").agg(F.count("*").alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    df = df.join(parts.select(file_id, "_part", "_off"), [file_id, "_part"])
    df = df.withColumn("run", (F.col(page) - F.col("_off") - F.col("_rank")).cast("bigint"))
    starts = df.groupBy(file_id, "run").agg(F.min(page).alias("_start"))
    df = df.join(starts, [file_id, "run"])
    return df.withColumn("batch", F.floor((F.col(page) - F.col("_start")) / cap).cast("bigint")).drop("_part", "_rank", "_off", "_start")


def zip_rendered(batch_pages: Column, rendered: Column) -> Column:
    """Pages paired with rendered images by position, cut at the shorter side."""
    return F.slice(F.arrays_zip(batch_pages.alias("page"), rendered.alias("image")), 1, F.least(F.size(batch_pages), F.size(rendered)))


def prepared_size(width: Column, height: Column) -> Column:
    """Size an image is enlarged to before OCR: at most twice, up to 1,400 on the longer side; whole numbers of 1 or more."""
    long = F.greatest(width, height)
    scale = F.when(long < 1400, F.least(F.lit(2.0), 1400 / long)).otherwise(1.0)
    side = lambda x: F.greatest(F.lit(1), F.floor(x * scale)).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def progress(extracted: Column, pages: Column, read: Column, due: Column) -> Column:
    """Share of a file's work that is done: 0.35 for extraction, 0.64 for OCR where any is due."""
    return F.when(due > 0, 0.35 * extracted / pages + 0.64 * read / due).otherwise(extracted / pages)
