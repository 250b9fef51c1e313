"""SQL names for the page-text functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators import quality as Q
from ..operators.merge import merge_udf, normal_udf
from . import text as T


@udtf(returnType="line_no int, line string")
class TextLines:
    """text_lines(text): the stripped lines of a text that are not blank, numbered from 1."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        n = 0
        for line in (text or "").splitlines():
            if line := line.strip():
                n += 1
                yield n, line


def _sql(pattern: str) -> str:
    return "r'" + pattern + "'"


def _count(text: str, pattern: str) -> str:
    return f"(length({text}) - length(regexp_replace({text}, {_sql(pattern + '+')}, '')))"


_QUALITY_TYPE = "STRUCT<char_count: BIGINT, word_count: BIGINT, longest_token: BIGINT, quality_score: BIGINT, whitespace_ratio: DOUBLE, suspicious_ratio: DOUBLE, avg_word_len: DOUBLE, flags: ARRAY<STRING>, needs_ocr: BOOLEAN>"


def _quality() -> str:
    """The quality of a text as one SQL expression; each step names what the one before computed."""
    strip = f"regexp_replace(coalesce(t, ''), {_sql(f'^{T.WS}+|{T.WS}+$')}, '')"
    one = f"named_struct('r', coalesce(t, ''), 's', {strip}, 'w', regexp_extract_all({strip}, {_sql(f'({T.NOT_WS}+)')}, 1))"
    two = f"""named_struct('c', CAST(length(a.s) AS BIGINT), 'n', CAST(size(a.w) AS BIGINT), 'l', CAST(coalesce(array_max(transform(a.w, x -> length(x))), 0) AS BIGINT),
      'avg', IF(size(a.w) > 0, aggregate(a.w, 0, (x, y) -> x + length(y)) / size(a.w), 0D), 'ws', IF(length(a.r) > 0, {_count('a.r', T.WS)} / length(a.r), 0D),
      'su', IF(length(a.s) > 0, {_count('a.r', T.SUSPICIOUS)} / length(a.s), 0D), 'le', {_count('a.r', T.LETTER)}, 'di', {_count('a.r', T.DIGIT)})"""
    lost = " + ".join(f"IF({cond}, {cost}, 0)" for cond, _, cost in _RULES)
    flags = ", ".join(f"IF({cond}, '{flag}', NULL)" for cond, flag, _ in _RULES)
    three = f"named_struct('q', CAST(greatest(0, least(100, 100 - ({lost}))) AS BIGINT), 'f', filter(array({flags}), x -> x IS NOT NULL))"
    out = "named_struct('char_count', b.c, 'word_count', b.n, 'longest_token', b.l, 'quality_score', d.q, 'whitespace_ratio', b.ws, 'suspicious_ratio', b.su, 'avg_word_len', b.avg, 'flags', d.f, 'needs_ocr', b.c = 0 OR d.q < 55)"
    return f"transform(array({one}), a -> transform(array({two}), b -> transform(array({three}), d -> {out})[0])[0])[0]"


#: Conditions, flags and penalties, as in operators.quality.
_RULES = (
    ("b.c = 0", "sem-texto", 100),
    ("b.c > 0 AND b.c < greatest(1, coalesce(nullif(min_chars, 0), 30))", "texto-curto", 45),
    ("b.su > 0.05", "caracteres-suspeitos", 55),
    ("b.su > 0.02 AND b.su <= 0.05", "caracteres-suspeitos", 25),
    ("b.c >= 180 AND b.n <= 4", "poucas-palavras", 35),
    ("b.c >= 180 AND b.ws < 0.02", "baixa-separacao", 30),
    ("b.l >= 45 AND b.n <= 8", "token-muito-longo", 25),
    ("b.avg >= 18 AND b.n >= 4", "palavras-coladas", 18),
    ("b.le = 0 AND b.di > 0 AND b.c > 50", "quase-so-numeros", 12),
)


def _hints() -> str:
    lines = f"filter(transform(split(coalesce(t, ''), {_sql(T.LINE_END)}), x -> regexp_replace(x, {_sql(f'^{T.WS}+|{T.WS}+$')}, '')), x -> x <> '')"
    many = lambda cond, n, hint: f"IF(size(filter(ls, x -> {cond})) >= {n}, '{hint}', NULL)"
    rules = ", ".join(
        (
            many(f"contains(x, chr(9)) OR regexp_count(x, {_sql(' [|] ')}) >= 2", 2, "table-like"),
            many(f"x RLIKE {_sql(Q.TIME)}", 2, "chat-like"),
            many(f"x RLIKE {_sql(Q.ATTACHMENT)}", 1, "attachment-mention"),
            many(f"x RLIKE {_sql(Q.NUMBERED)}", 3, "list-like"),
        )
    )
    return f"transform(array({lines}), ls -> filter(array({rules}), h -> h IS NOT NULL))[0]"


def register(spark: SparkSession) -> None:
    """page_chars(text), page_words(text), suspicious_share(text), page_quality(text, min_chars) and structure_hints(text) as
    SQL expressions; merge_layers(native, ocr) and normal_line(text) as Arrow functions; text_lines(text) as a table function."""
    strip = f"regexp_replace(coalesce(t, ''), {_sql(f'^{T.WS}+|{T.WS}+$')}, '')"
    for name, kind, body in (
        ("page_chars", "INT", f"length({strip})"),
        ("page_words", "INT", f"regexp_count({strip}, {_sql(T.NOT_WS + '+')})"),
        ("suspicious_share", "DOUBLE", f"CASE WHEN length({strip}) > 0 THEN regexp_count(t, {_sql(T.SUSPICIOUS)}) / length({strip}) ELSE 0D END"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION page_quality(t STRING, min_chars INT) RETURNS {_QUALITY_TYPE} RETURN {_quality()}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION structure_hints(t STRING) RETURNS ARRAY<STRING> RETURN {_hints()}")
    spark.udf.register("merge_layers", merge_udf)
    spark.udf.register("normal_line", normal_udf)
    spark.udtf.register("text_lines", TextLines)
