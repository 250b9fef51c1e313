"""Page text quality, structure hints and page details, as expressions inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.labels import flag_labels, hint_labels, source_label

MIN_SCORE = 55
MIN_CHARS = 30
LONG_TOKEN = 45

#: Patterns of the structure hints.
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
TIME = rf"{_BEFORE}\p{{Nd}}{{1,2}}:\p{{Nd}}{{2}}{_AFTER}"
ATTACHMENT = rf"(?iu){_BEFORE}(anexo|anexa|foto|imagem|print|captura|evid[eê]ncia){_AFTER}"
NUMBERED = rf"^\p{{Nd}}+[.)-]{T.WS}+{T.NOT_WS}"


def with_statistics(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Adds char_count, word_count, longest_token, avg_word_len, whitespace_ratio, suspicious_ratio, letters, digits.

    Counts of characters are over the raw text, lengths over the stripped one.
    """
    p = prefix
    step = df.withColumn(f"{p}_s", T.strip(F.col(text)))
    step = step.withColumn(f"{p}_w", T.words(F.col(f"{p}_s")))
    t, s, w = T.raw(F.col(text)), F.col(f"{p}_s"), F.col(f"{p}_w")
    chars = F.length(s).cast("bigint")
    n = F.size(w).cast("bigint")
    longest = F.coalesce(F.array_max(F.transform(w, F.length)), F.lit(0)).cast("bigint")
    letters = F.length(F.regexp_replace(s, f"{T.WS}+", ""))
    return (
        step.withColumn(f"{p}char_count", chars)
        .withColumn(f"{p}word_count", n)
        .withColumn(f"{p}longest_token", longest)
        .withColumn(f"{p}avg_word_len", F.when(n > 0, letters / n).otherwise(0.0))
        .withColumn(f"{p}whitespace_ratio", F.when(F.length(t) > 0, T.count_of(t, T.WS) / F.length(t)).otherwise(0.0))
        .withColumn(f"{p}suspicious_ratio", F.when(chars > 0, T.count_of(t, T.SUSPICIOUS) / chars).otherwise(0.0))
        .withColumn(f"{p}letters", T.count_of(t, T.LETTER))
        .withColumn(f"{p}digits", T.count_of(t, T.DIGIT))
        .drop(f"{p}_s", f"{p}_w")
    )


def penalties(p: str = "", min_chars: int | Column | None = MIN_CHARS) -> list[tuple[Column, str, int]]:
    """(condition, flag, penalty) in the order flags are listed; a page without text has the score 0.

    Fixed values: the limits, flags and penalties below.
    """
    c = lambda name: F.col(p + name)
    least = min_chars if isinstance(min_chars, Column) else max(1, int(min_chars or MIN_CHARS))
    cc, words, longest = c("char_count"), c("word_count"), c("longest_token")
    return [
        (cc == 0, "sem-texto", 100),
        ((cc > 0) & (cc < least), "texto-curto", 45),
        (c("suspicious_ratio") > 0.05, "caracteres-suspeitos", 55),
        ((c("suspicious_ratio") > 0.02) & (c("suspicious_ratio") <= 0.05), "caracteres-suspeitos", 25),
        ((cc >= 180) & (words <= 4), "poucas-palavras", 35),
        ((cc >= 180) & (c("whitespace_ratio") < 0.02), "baixa-separacao", 30),
        ((longest >= LONG_TOKEN) & (words <= 8), "token-muito-longo", 25),
        ((c("avg_word_len") >= 18) & (words >= 4), "palavras-coladas", 18),
        ((c("letters") == 0) & (c("digits") > 0) & (cc > 50), "quase-so-numeros", 12),
    ]


def with_quality(df: DataFrame, text: str, prefix: str = "", min_chars: int | Column | None = MIN_CHARS) -> DataFrame:
    """Adds the statistics, quality_score, flags and needs_ocr.

    A null text is an empty one; extra columns pass through, ones of the added names are replaced.
    """
    p = prefix
    df = with_statistics(df, text, p)
    rules = penalties(p, min_chars)
    lost = sum((F.when(cond, cost).otherwise(0) for cond, _, cost in rules), F.lit(0))
    flags = F.filter(F.array(*[F.when(cond, F.lit(flag)) for cond, flag, _ in rules]), lambda x: x.isNotNull())
    df = df.withColumn(f"{p}quality_score", F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost)).cast("bigint")).withColumn(f"{p}flags", flags)
    return df.withColumn(f"{p}needs_ocr", (F.col(f"{p}char_count") == 0) | (F.col(f"{p}quality_score") < MIN_SCORE))


def analysis(p: str = "") -> Column:
    """The quality columns as one struct."""
    names = ["char_count", "word_count", "longest_token", "quality_score", "whitespace_ratio", "suspicious_ratio", "avg_word_len", "flags", "needs_ocr"]
    return F.struct(*[F.col(p + n).alias(n) for n in names])


def structure_hints(text: Column) -> Column:
    """Coarse structures a text suggests, in a fixed order."""

    def hints(ls: Column) -> Column:
        def many(cond) -> Column:
            return F.size(F.filter(ls, cond))

        rules = [
            (many(lambda x: x.contains("\t") | (F.regexp_count(x, F.lit(r" \| ")) >= 2)) >= 2, "table-like"),
            (many(lambda x: x.rlike(TIME)) >= 2, "chat-like"),
            (many(lambda x: x.rlike(ATTACHMENT)) >= 1, "attachment-mention"),
            (many(lambda x: x.rlike(NUMBERED)) >= 3, "list-like"),
        ]
        return F.filter(F.array(*[F.when(c, F.lit(h)) for c, h in rules]), lambda x: x.isNotNull())

    return T.let(T.lines(text), hints)


def summary(text: Column, most: int = 240) -> Column:
    """The text's lines joined by one blank, cut, stripped; a note where there is none."""
    joined = F.array_join(F.split(T.strip(text), T.LINE_END), " ")
    short = T.strip(F.substring(joined, 1, most))
    return F.when(short == "", "<sem texto>").otherwise(short)


def percent(share: Column) -> Column:
    """A share as a percentage of one decimal, ties to even."""
    return F.format_number(share * 100, 1)


def detail_line(source: Column, score: Column, chars: Column, flags: Column, images: Column, coverage: Column, reason: Column, issue: Column, hints: Column) -> Column:
    """One line about a page; parts that do not apply are left out."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    shown = F.coalesce(images, F.lit(0)) > 0
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Origem: "), source_label(source)),
        F.concat(F.lit("Qualidade: "), score.cast("string"), F.lit("/100")),
        F.concat(F.lit("Caracteres: "), chars.cast("string")),
        F.when(F.size(flag_labels(flags)) > 0, F.concat(F.lit("Alertas: "), F.array_join(flag_labels(flags), ", "))),
        F.when(shown, F.concat(F.lit("Imagens detectadas: "), images.cast("string"))),
        F.when(shown & (F.coalesce(coverage, F.lit(0.0)) != 0), F.concat(F.lit("Maior imagem: "), percent(coverage), F.lit("% da página"))),
        F.when(some(reason), F.concat(F.lit("Motivo do OCR: "), reason)),
        F.when(some(issue), "Camada nativa sinalizada como incompleta"),
        F.when(F.size(hint_labels(hints)) > 0, F.concat(F.lit("Estrutura: "), F.array_join(hint_labels(hints), ", "))),
    )
