"""Quality and hints against a plain model, on cases and on random strings."""

import random
import re

from foliant.operators.quality import structure_hints, summary, with_quality
from pyspark.sql import functions as F


def model(text):
    raw = text or ""
    s = raw.strip()
    tokens = s.split()
    cc, wc = len(s), len(tokens)
    sus = sum(0xE000 <= ord(c) <= 0xF8FF or ord(c) == 0xFFFD or (ord(c) < 32 and c not in "\t\n\r") for c in raw)
    ratio = sus / cc if cc else 0
    ws = sum(c.isspace() for c in raw) / len(raw) if raw else 0
    longest, mean = max(map(len, tokens), default=0), sum(map(len, tokens)) / wc if wc else 0
    rules = [
        (cc == 0, "sem-texto", 100), (0 < cc < 30, "texto-curto", 45), (ratio > 0.05, "caracteres-suspeitos", 55), (0.02 < ratio <= 0.05, "caracteres-suspeitos", 25),
        (cc >= 180 and wc <= 4, "poucas-palavras", 35), (cc >= 180 and ws < 0.02, "baixa-separacao", 30), (longest >= 45 and wc <= 8, "token-muito-longo", 25),
        (mean >= 18 and wc >= 4, "palavras-coladas", 18), (not any(map(str.isalpha, raw)) and any(map(str.isdigit, raw)) and cc > 50, "quase-so-numeros", 12),
    ]
    score = max(0, 100 - sum(c for hit, _, c in rules if hit))
    return score, [f for hit, f, _ in rules if hit], cc == 0 or score < 55


def test_quality_equals_the_model(spark):
    r = random.Random(1)
    bits = ["palavra", "é", " ", "\n", "\t", " ", " ", "\x1c", "�", "", "12", "x" * 50, "　", "²", "😀", "0123456789 " * 8, "a" * 20 + " "]
    texts = [None, "", "   \n", "�" * 3 + "x" * 57] + ["".join(r.choices(bits, k=r.randrange(1, 40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x.i: (x.quality_score, x.flags, x.needs_ocr) for x in with_quality(df, "t").collect()}
    assert {i: model(t) for i, t in enumerate(texts)} == got


def test_a_short_page_alone_needs_no_ocr(spark):
    row = with_quality(spark.createDataFrame([("curto",)], "t string"), "t").first()
    assert (row.quality_score, row.needs_ocr) == (55, False)


def test_extra_columns_of_clashing_names_are_replaced(spark):
    row = with_quality(spark.createDataFrame([("curto", "x")], "t string, flags string"), "t").first()
    assert row.flags == ["texto-curto"]


def test_structure_hints(spark):
    cases = {
        "a\tb\nc\td": ["table-like"],
        "a | b | c\nd | e | f": ["table-like"],
        "10:20 oi\n11:30 ok\nveja o ANEXO": ["chat-like", "attachment-mention"],
        "éanexo": [],
        "1. a\n2) b\n3- c": ["list-like"],
        "\ta\nb\t": [],
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.h for r in df.select("t", structure_hints(F.col("t")).alias("h")).collect()}
    assert got == cases | {None: []}


def test_summary(spark):
    texts = [None, " \n", "  a\nb \r\nc  ", "x" * 300, "a" * 239 + "\nb"]
    got = [r.s for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(summary(F.col("t")).alias("s")).collect()]
    want = [" ".join((t or "").strip().splitlines())[:240].strip() or "<sem texto>" for t in texts]
    assert [re.sub(r"\s", "_", x) for x in got] == [re.sub(r"\s", "_", x) for x in want]


def test_sql_functions_equal_the_columns(spark):
    from foliant.functions.register import register
    from foliant.operators.quality import analysis, structure_hints, with_quality

    register(spark)
    texts = [None, "", "curto", "a" * 60, "um dois\ttrês\nquatro\t5\ncinco 10:20\n11:30 anexo", "1. a\n2. b\n3. c", "12 34 " * 20, " abc def ghi jkl mno pqr", "x" * 200 + " y", "  texto com espaços  "]
    df = with_quality(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "", 40).withColumn("a", analysis()).withColumn("h", structure_hints(F.col("t")))
    for r in df.selectExpr("a", "page_quality(t, 40) AS b", "h", "structure_hints(t) AS g").collect():
        assert r.a == r.b and r.h == r.g
