"""Helpers shared by the text operators: reading, Arrow passes, lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAYERS = ("native_text", "ocr_text")

#: Distinct tokens a task holds before it hands its partial counts on.
FLUSH_TOKENS = 200_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Where it names none, one of this machine serves only a session that has no executors elsewhere; any other must name one.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), "foliant-checkpoint")
    sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a derived table once, outside the executors, and cut its lineage.

    Its files go when the table is no longer referred to, by spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def layer_rows(df: DataFrame, fields: Iterable[str] = LAYERS, keep: Iterable[str] = ()) -> DataFrame:
    """One row per present text layer: keep..., layer_id, field_name, text.

    Only the named columns are read, so other columns of whatever name are ignored.
    """
    parts = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("text")) for f in fields])
    keep = list(keep)
    out = df.select(*keep, F.col("layer_id").cast("bigint").alias("layer_id"), F.explode(parts).alias("_l"))
    return out.select(*keep, "layer_id", "_l.field_name", "_l.text").where(F.col("text").isNotNull())


def arrow_pass(df: DataFrame, row_fn: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """Run a generator per row over Arrow batches: row_fn(*columns) yields output tuples."""
    names, spark_schema = df.columns, T._parse_datatype_string(schema)
    kinds = _arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                out.extend(row_fn(*row))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), kinds, strict=True)], schema=kinds)

    return df.mapInArrow(run, spark_schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def token_counts(texts: DataFrame, tokens: Callable[[str], Iterable[str]], normal: Callable[[str], str | None]) -> DataFrame:
    """(word, cnt) over all rows of the one text column: counted within each task, then summed.

    tokens splits a text; normal maps a distinct token to the counted form, or None to drop it.
    """
    column = texts.columns[0]
    kinds = pa.schema([("word", pa.string()), ("cnt", pa.int64())])

    def flush(raw: Counter) -> pa.RecordBatch:
        done: Counter = Counter()
        for token, n in raw.items():
            word = normal(token)
            if word:
                done[word] += n
        return pa.RecordBatch.from_arrays([pa.array(list(done), pa.string()), pa.array(list(done.values()), pa.int64())], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: Counter = Counter()
        for batch in batches:
            for text in batch.column(column).to_pylist():
                if text:
                    raw.update(tokens(text))
            if len(raw) > FLUSH_TOKENS:
                yield flush(raw)
                raw = Counter()
        if raw:
            yield flush(raw)

    return texts.mapInArrow(run, "word string, cnt bigint").groupBy("word").agg(F.sum("cnt").alias("cnt"))


def frequent(vocab: DataFrame, share: float) -> dict[str, int]:
    """Words that make up at least ``share`` of all counted tokens: at most 1/share words, so bounded."""
    total = vocab.agg(F.sum("cnt")).first()[0] or 0
    return dict(vocab.where(F.col("cnt") >= F.lit(max(2.0, share * total))).select("word", "cnt").toPandas().itertuples(index=False, name=None))


#: Classes of single shapes a scanner mixes up; the first stands for all.
SCAN_CLASSES = ("o0о", "l1|!iі", "s5$", "b86hóвб", "g9q", "a@4ч", "ec3€зсе", "tf7†ſ", "z2", "nu", "ç¢", "ãä", "íï", "õö", "úü", "инц", "пл")
SCAN_JOINED = (("cl", "d"), ("rn", "m"), ("ri", "n"), ("vv", "w"), ("ii", "u"))
SCAN_FOLD = {ord(x): c[0] for c in SCAN_CLASSES for x in c}


def scan_fold(word: str) -> str:
    """Classes of shapes a scanner mixes up, for comparing damaged with undamaged words."""
    for a, b in SCAN_JOINED:
        if a in word:
            word = word.replace(a, b)
    return word.translate(SCAN_FOLD)


WORD_EDGE = ".,;:()[]{}<>\"'“”„«»‘’‹›…·•*#–—"
_WS = re.compile(r"[ \t\r\n\f\v]+")
