"""Reading order of positioned blocks, text lines from word boxes, image coverage of graphics operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

COLUMN_GAP = 0.18


def block_text(text: Column) -> Column:
    return F.array_join(T.lines(text), "\n")


def kept_blocks(blocks: DataFrame, text: str = "text", kind: str = "kind") -> DataFrame:
    """Blocks of text, of kind 0 or unknown, with their normal text; blocks without any are left out."""
    df = blocks.where(F.coalesce(F.col(kind), F.lit(0)) == 0).withColumn(text, block_text(F.col(text)))
    return df.where(F.col(text) != "")


def columns_of(blocks: DataFrame, page: list[str], x: str = "x0", width: str = "page_width", seq: str = "seq") -> DataFrame:
    """Adds column_no (0, or 1 right of the gap) and two_columns to each block.

    The first largest gap between sorted left edges splits a page if it is wide enough and two blocks or more are on either side.
    """
    by_x = W.partitionBy(*page).orderBy(x, seq)
    whole = W.partitionBy(*page)
    df = blocks.withColumn("_rank", F.row_number().over(by_x)).withColumn("_gap", F.coalesce(F.col(x) - F.lag(x).over(by_x), F.lit(0.0)))
    df = df.withColumn("_n", F.count("*").over(whole)).withColumn("_most", F.max("_gap").over(whole))
    df = df.withColumn("_at", F.min(F.when((F.col("_gap") == F.col("_most")) & (F.col("_most") > 0), F.col("_rank"))).over(whole))
    split = (F.col("_at").isNotNull()) & (F.col(width) > 0) & (F.col("_most") >= F.col(width) * COLUMN_GAP) & (F.col("_at") - 1 >= 2) & (F.col("_n") - F.col("_at") + 1 >= 2)
    df = df.withColumn("two_columns", F.coalesce(split, F.lit(False)))
    return df.withColumn("column_no", F.when(F.col("two_columns") & (F.col("_rank") >= F.col("_at")), 1).otherwise(0))


def order_blocks(blocks: DataFrame, page: list[str], x: str = "x0", y: str = "y0", width: str = "page_width", seq: str = "seq") -> DataFrame:
    """Adds reading_no, the 1-based place of each block on its page; blocks of a page only meet each other."""
    df = columns_of(blocks, page, x, width, seq)
    tie = F.when(F.col("two_columns"), F.col("_rank")).otherwise(F.col(seq))
    order = W.partitionBy(*page).orderBy("column_no", F.bround(F.col(y).cast("decimal(18,6)"), 1), F.bround(F.col(x).cast("decimal(18,6)"), 1), tie)
    return df.withColumn("reading_no", F.row_number().over(order)).drop("_rank", "_gap", "_n", "_most", "_at")


def page_text(ordered: DataFrame, page: list[str], text: str = "text") -> DataFrame:
    """One text per page, blocks a blank line apart."""
    return ordered.groupBy(*page).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("reading_no", text))), lambda b: b[text]), "\n\n").alias("text"))


def kept_words(boxes: DataFrame) -> DataFrame:
    """Drops blank words and those of a confidence of exactly 0; an unreadable confidence counts as -1."""
    conf = F.coalesce(F.expr("try_cast(conf AS DOUBLE)"), F.lit(-1.0))
    return boxes.withColumn("txt", T.strip(F.col("txt"))).where((F.col("txt") != "") & (conf != 0))


def separators(boxes: DataFrame, line: list[str]) -> DataFrame:
    """Adds place, the words' order in a line, and sep, what stands before each: nothing, one or two blanks, or a bar."""
    in_line = W.partitionBy(*line).orderBy("left", "top", "seq")
    whole = W.partitionBy(*line)
    df = kept_words(boxes).withColumn("place", F.row_number().over(in_line)).withColumn("_before", F.lag(F.col("left") + F.col("width")).over(in_line))
    letters = F.greatest(F.lit(1), F.sum(F.greatest(F.lit(1), F.length("txt"))).over(whole))
    df = df.withColumn("_avg", F.greatest(F.lit(8.0), F.sum("width").over(whole) / letters))
    gap = F.col("left") - F.col("_before")
    sep = F.when(F.col("_before").isNull(), "").when(gap >= F.greatest(F.lit(24.0), F.col("_avg") * 7), " | ").when(gap >= F.greatest(F.lit(10.0), F.col("_avg") * 3), "  ").otherwise(" ")
    return df.withColumn("sep", sep).drop("_before", "_avg")


def rebuild_lines(boxes: DataFrame, page: list[str], parts: tuple[str, ...] = ("block", "par", "line")) -> DataFrame:
    """The lines of each page in order: page..., line_no, line_text."""
    line = [*page, *parts]
    words = separators(boxes, line).withColumn("_w", F.struct("place", F.concat("sep", "txt").alias("t")))
    lines = words.groupBy(*line).agg(F.min("top").alias("top"), F.min("left").alias("left"), F.min("seq").alias("_first"), F.array_join(F.transform(F.sort_array(F.collect_list("_w")), lambda w: w["t"]), "").alias("line_text"))
    order = W.partitionBy(*page).orderBy("top", "left", "_first")
    return lines.withColumn("line_no", F.row_number().over(order)).select(*page, "line_no", "line_text")


def matrix_scale(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Area scale of a transform matrix; 1 for a malformed one."""
    return F.coalesce(F.abs(a * d - b * c), F.lit(1.0))


def coverage_fold(ops: Column, page_area: Column, initial: Column | None = None) -> Column:
    """Shares of the page covered by the images a stream of operators draws, in order.

    ops: array of structs with op ("q", "Q", "cm", "Do") and scale, a matrix's area scale.  A stack machine as one
    fold: "q" keeps the scale, "Q" brings the last kept one back if there is any, "cm" multiplies, "Do" draws.
    """
    start = F.struct((F.lit(1.0) if initial is None else initial).alias("scale"), F.array().cast("array<double>").alias("stack"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, o: Column) -> Column:
        some = F.size(s["stack"]) > 0
        scale = F.when((o["op"] == "Q") & some, F.try_element_at(s["stack"], F.lit(-1))).when(o["op"] == "cm", s["scale"] * o["scale"]).otherwise(s["scale"])
        stack = F.when(o["op"] == "q", F.array_append(s["stack"], s["scale"])).when((o["op"] == "Q") & some, F.slice(s["stack"], 1, F.greatest(F.lit(0), F.size(s["stack"]) - 1))).otherwise(s["stack"])
        out = F.when(o["op"] == "Do", F.array_append(s["out"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["scale"] / page_area)))).otherwise(s["out"])
        return F.struct(scale.alias("scale"), stack.alias("stack"), out.alias("out"))

    return F.aggregate(ops, start, step, lambda s: s["out"])
