"""python -m foliant INPUT OUTPUT [options]: convert files; exit code 1 for no input, 2 for any failed file."""

from __future__ import annotations

import argparse
import importlib
import sys
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engines import dispatch, preflight
from .plans.pipeline import Options, convert
from .session import ship


def _load(name: str | None):
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="foliant")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--ocr-threshold", type=int, default=30, help="characters below which a page counts as short (1-5000)")
    p.add_argument("--ocr-dpi", type=int, default=300, help="300-450")
    p.add_argument("--lang", default="por")
    p.add_argument("--output-format", choices=("md", "txt"), default="txt")
    p.add_argument("--no-ocr", action="store_true")
    p.add_argument("--force-ocr", action="store_true")
    p.add_argument("--page-audit", action="store_true")
    p.add_argument("--compiled", action="store_true", help="one document of all files")
    p.add_argument("--engine", help="module:callable that makes an OcrEngine")
    p.add_argument("--renderer", help="module:callable that makes a PageRenderer")
    p.add_argument("--state", help="folder that keeps OCR results over runs")
    p.add_argument("--drop-state", action="store_true", help="remove that folder once every file is done")
    p.add_argument("--workers", type=int, help="most OCR tasks at a time (1-32)")
    p.add_argument("--ocr-backend", choices=("auto", "tesseract", "vision"), default="auto")
    p.add_argument("--vision-engine", help="module:callable of the engine that auto tries first")
    p.add_argument("--layout", choices=("files", "packed"), default="files")
    a = p.parse_args(argv)
    options = Options.of(
        ocr_threshold=a.ocr_threshold, ocr_dpi=a.ocr_dpi, lang=a.lang, output_format=a.output_format, use_ocr=not a.no_ocr, force_ocr=a.force_ocr, page_audit=a.page_audit, compiled=a.compiled,
        workers=a.workers, ocr_backend=a.ocr_backend, layout=a.layout, drop_state=a.drop_state,
    )
    engine, renderer = dispatch(a.ocr_backend, _load(a.vision_engine), _load(a.engine)), _load(a.renderer)
    for issue in preflight(engine, renderer, a.lang) if options.use_ocr else ():
        print(issue, file=sys.stderr)
    spark = ship(SparkSession.builder.appName("foliant").getOrCreate())
    table = convert(spark, a.input, a.output, engine, renderer, options, datetime.now().isoformat(" ", "seconds"), a.state)
    counts = table.agg(F.count("*").alias("n"), F.count_if(F.col("status") != "ok").alias("failed")).first()
    table.write.mode("overwrite").parquet(f"{a.output}/results")
    print(f"{counts.n - counts.failed} ok, {counts.failed} failed", file=sys.stderr)
    return 1 if not counts.n else 2 if counts.failed else 0


if __name__ == "__main__":
    sys.exit(main())
