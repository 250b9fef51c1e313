import random
from difflib import SequenceMatcher

from foliant.functions import labels
from foliant.operators import geometry, merge, policy, resume
from foliant.sinks import output_name, unique_names
from pyspark.sql import functions as F


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_image_policy(spark):
    cases = [(True, 0.011, 10, 100, False, False), (True, 0.22, 2000, 100, False, True), (True, 0.78, 1500, 95, False, False), (True, 0.78, 120, 95, False, True), (True, None, 2000, 100, False, True), (False, None, 0, 0, True, False), (None, 0.5, 0, 0, True, False)]
    df = spark.createDataFrame(cases, "h boolean, c double, n int, s int, o boolean, want boolean")
    assert all(r[0] == r[1] for r in rows(df.select(policy.image_needs_ocr(*map(F.col, "hcnso")), "want")))


def test_profiles(spark):
    df = spark.createDataFrame([(n,) for n in (None, 0, 250, 251, 2000, 2001, 5000, 5001)], "n int").select(policy.profile(F.col("n"), F.lit(100)).alias("p"))
    assert [r.p.name for r in df.collect()] == ["pequeno"] * 3 + ["grande"] * 2 + ["muito-grande"] * 2 + ["gigante"]
    assert {r.p.ocr_dpi for r in df.collect()} == {300}


def test_language_tags(spark):
    cases = {None: "en-US", "": "en-US", "por": "pt-BR", "por+eng": "pt-BR", "pt_BR": "pt-BR", "zh-Hans": "zh-Hans", "xyz": "en-US", " DEU ": "de-DE"}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    assert dict(rows(df.select("l", labels.language_tag(F.col("l"))))) == cases


def test_batches_run_and_cap(spark):
    df = spark.createDataFrame([("f", p) for p in (0, 1, 2, 3, 4, 7, 8)] + [("g", 5)], "file_id string, page_index int")
    got = {(r.file_id, r.page_index): (r.run, r.batch) for r in policy.plan_batches(df, 3).collect()}
    assert len(set(got.values()) | {("g",)}) == 5
    assert got[("f", 0)] == got[("f", 2)] != got[("f", 3)] and got[("f", 7)] == got[("f", 8)]


def test_reasons_and_issues(spark):
    df = spark.createDataFrame([(True, True, 0.25, "x", True), (False, True, 0.0, None, False), (False, False, None, None, True), (False, False, None, "", False)], "f boolean, c boolean, v double, i string, n boolean")
    got = [r[0] for r in rows(df.select(policy.ocr_reason(*map(F.col, "fcvin"))))]
    assert got == ["OCR integral solicitado; imagem relevante detectada (25.0% da página); camada nativa incompleta", "imagem relevante detectada", "texto nativo ausente ou de baixa qualidade", "verificação OCR"]
    m = spark.createDataFrame([("a", 3, "y"), ("a", 1, "x"), ("a", 2, "y")], "k string, at int, m string")
    assert rows(policy.joined_issues(m, ["k"], "at", "m")) == [("a", "x; y")]


def test_two_columns(spark):
    blocks = [(1, 0, 50.0, 10.0), (1, 1, 310.0, 5.0), (1, 2, 52.0, 40.0), (1, 3, 305.0, 30.0), (2, 0, 50.0, 30.0), (2, 1, 50.0, 10.0), (2, 2, 400.0, 20.0)]
    df = spark.createDataFrame([(p, s, x, y, 595.0) for p, s, x, y in blocks], "page int, seq int, x0 double, y0 double, page_width double")
    got = {(r.page, r.seq): r.reading_no for r in geometry.order_blocks(df, ["page"]).collect()}
    assert [got[1, s] for s in (0, 2, 1, 3)] == [1, 2, 3, 4]
    assert [got[2, s] for s in (1, 2, 0)] == [1, 2, 3]


def test_lines_from_words(spark):
    words = [(1, 1, 1, 1, 10, 5, 20, "90", "ab"), (1, 1, 1, 1, 34, 5, 20, "-1", "cd"), (1, 1, 1, 1, 300, 5, 20, "x", "ef"), (1, 1, 1, 2, 10, 1, 20, "50", "gh"), (1, 1, 1, 2, 40, 1, 20, "0", "no"), (1, 1, 1, 2, 60, 1, 20, "9", " ")]
    df = spark.createDataFrame([(*w[:8], w[8], i) for i, w in enumerate(words)], "page int, block int, par int, line int, left int, top int, width int, conf string, txt string, seq int")
    assert [r.line_text for r in geometry.rebuild_lines(df, ["page"]).orderBy("line_no").collect()] == ["gh", "ab cd | ef"]


def test_coverage_fold_equals_a_stack_machine(spark):
    r = random.Random(2)
    data, want = [], []
    for i in range(60):
        ops = [(r.choice(["q", "Q", "cm", "Do"]), r.uniform(0.1, 9)) for _ in range(r.randrange(0, 25))]
        scale, stack, out = 1.0, [], []
        for op, f in ops:
            if op == "q":
                stack.append(scale)
            elif op == "Q" and stack:
                scale = stack.pop()
            elif op == "cm":
                scale *= f
            elif op == "Do":
                out.append(max(0.0, min(1.0, scale / 50)))
        data.append((i, ops))
        want.append(out)
    df = spark.createDataFrame(data, "i int, ops array<struct<op:string,scale:double>>").orderBy("i")
    assert [x[0] for x in rows(df.select(geometry.coverage_fold(F.col("ops"), F.lit(50.0))))] == want


def test_merge_keeps_native_and_adds_only_new_lines():
    assert merge.merge_layers(None, " só ocr ") == "só ocr" and merge.merge_layers("nativo", "") == "nativo"
    assert merge.merge_layers("Linha igual do texto", "LINHA IGUAL DO TEXTO") == "Linha igual do texto"
    assert merge.merge_layers("A decisão foi\npublicada ontem", "A decisao foi publicada ontem") == "A decisão foi\npublicada ontem"
    got = merge.merge_layers("Texto nativo da página.", "Texto nativo da página.\nTexto dentro da imagem")
    assert got.startswith("Texto nativo da página.") and got.endswith("\n\nTexto dentro da imagem") and merge.HEADING in got
    assert merge.merge_layers("um dois tres quatro cinco seis sete oito nove", "nove oito sete seis cinco quatro tres dois um") == "um dois tres quatro cinco seis sete oito nove"


def test_longest_run_equals_difflib():
    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(1, 15))] for _ in range(2))
        assert merge.longest_run(a, b) == SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size


def test_layer_joins(spark):
    df = spark.createDataFrame([(1, "um dois tres quatro cinco\noutra linha aqui", "dois tres quatro\nUm dois tres quatro cinco\ntotalmente novo texto da imagem"), (2, None, "x y"), (3, "a a b", "a b b")], "k int, n string, o string")
    runs = {(r.k, r.line_no): (r.tokens, r.run) for r in merge.token_runs(df, ["k"], "n", "o").collect()}
    assert runs[1, 0] == (3, 3) and runs[1, 1] == (5, 5) and runs[1, 2] == (5, 0) and runs[2, 0] == (2, 0)
    bags = {r.k: (r.tokens, r.shared) for r in merge.bag_overlap(df, ["k"], "n", "o").collect()}
    assert bags[3] == (3, 2) and bags[2] == (2, 0)
    assert {(r.k, r.line_no): r.contained for r in merge.contained(df, ["k"], "n", "o").collect()}[1, 0]
    same = merge.similar_lines(df, ["k"], "n", "o").where("k = 1").collect()
    assert [(r.ocr_line_no, r.native_line_no, r.ratio) for r in same] == [(1, 0, 1.0)]


def test_reconcile_takes_the_better_text(spark):
    q = "struct<char_count:int,quality_score:int,flags:array<string>,needs_ocr:boolean>"
    good, bad = (40, 100, [], False), (40, 30, [], True)
    data = [(1, "a" * 40, good, "b" * 40, good, False, False), (2, "a" * 40, bad, "b" * 40, good, False, False), (3, "a b c", good, "nova linha inteira", good, True, False), (4, None, None, None, None, False, False), (5, " ", None, "ocr", good, None, None)]
    df = spark.createDataFrame(data, f"i int, native_text string, native_analysis {q}, ocr_text string, ocr_analysis {q}, force_ocr boolean, preserve_both boolean")
    got = {r.i: (r.source, r.text) for r in merge.reconcile(df).collect()}
    assert {i: s for i, (s, _) in got.items()} == {1: "nativo", 2: "ocr", 3: "nativo+ocr", 4: "sem-texto", 5: "ocr"}
    assert got[3][1].startswith("a b c") and got[4][1] == ""


def test_names_and_state(spark):
    df = spark.createDataFrame([("d/a.md",), ("d/a.docx",), ("b",), ("x.y.pdf",)], "p string").withColumn("t", output_name(F.col("p"), ".md"))
    taken = spark.createDataFrame([("b.md",), ("b_2.md",)], "n string")
    got = {r.p: r.name for r in unique_names(df, "t", ["p"], taken).collect()}
    assert got == {"d/a.docx": "d/a.md", "d/a.md": "d/a_2.md", "b": "b_3.md", "x.y.pdf": "x.y.md"}
    pages, state = spark.createDataFrame([("f", 0), ("f", 1)], "k string, p int"), spark.createDataFrame([("f", 1)], "k string, p int")
    assert rows(resume.pending(pages, state, ["k", "p"])) == [("f", 0)]
    prints = spark.range(1).select(resume.fingerprint(F.lit("/a"), F.lit(1), F.lit(2), {"dpi": 300}), resume.fingerprint(F.lit("/a"), F.lit(1), F.lit(2), {"dpi": 301})).first()
    assert prints[0] != prints[1]


def test_long_files_are_ranked_in_parts(spark, monkeypatch):
    pages = [p for p in range(60) if p not in (7, 20, 21, 40)]
    df = spark.createDataFrame([("f", p) for p in pages], "file_id string, page_index int")
    whole = sorted(rows(policy.plan_batches(df, 5).select("page_index", "run", "batch")))
    monkeypatch.setattr(policy, "PART_PAGES", 8)
    assert sorted(rows(policy.plan_batches(df, 5).select("page_index", "run", "batch"))) == whole


def test_sql_functions(spark):
    from foliant.functions.register import register

    register(spark)
    assert rows(spark.sql("SELECT page_chars(' a b '), page_words(' a b '), suspicious_share('ab��'), merge_layers('x', NULL), normal_line(' Ção, é! ')")) == [(3, 2, 0.5, "x", "cao e")]
    assert rows(spark.sql("SELECT * FROM text_lines(' a\n\n b ')")) == [(1, "a"), (2, "b")]
    assert rows(spark.sql("SELECT page_chars(NULL), page_words(''), suspicious_share(NULL)")) == [(0, 0, 0.0)]


def test_lines_are_compared_without_accents_composition_and_width(spark):
    pages = {
        1: ("A conciliação de Órgãos públicos\nﬁnal do ofício", "A conciliacao de Orgaos publicos\nfinal do oficio\noutra coisa"),
        2: ("Straße e número", "STRASSE E NUMERO"),
        3: ("Ｔｅｘｔｏ ｄｅ ｌａｒｇｕｒａ ｃｈｅｉａ", "texto de largura cheia\nTEXTO DE LARGURA CHEIO"),
        4: ("e\u0301poca de cafe\u0301 e pa\u0303o", "época de café e pão"),
        5: (None, "a"),
        6: ("x", None),
    }
    df = spark.createDataFrame([(k, *v) for k, v in pages.items()], "k int, n string, o string")
    held, runs, bags, alike = {}, {}, {}, {}
    for k, (n, o) in pages.items():
        flat = merge.normal(n)
        lines = [merge.normal(x) for x in (o or "").split("\n")]
        words = [w for x in lines for w in x.split()]
        if words:
            bags[k] = (len(words), sum(min(words.count(w), flat.split().count(w)) for w in set(words)))
        for i, x in enumerate(lines):
            if x:
                held[k, i] = x == flat or (len(x) >= 8 and x in flat) or (len(x.replace(" ", "")) >= 12 and x.replace(" ", "") in flat.replace(" ", ""))
                runs[k, i] = (len(x.split()), merge.longest_run(x.split(), flat.split()))
            for j, y in enumerate(map(merge.normal, (n or "").split("\n"))):
                if min(len(x), len(y)) >= 12 and (r := SequenceMatcher(None, x, y).ratio()) >= merge.SIMILAR:
                    alike[k, i, j] = r
    args = (df, ["k"], "n", "o")
    assert {(r.k, r.line_no): r.contained for r in merge.contained(*args).collect()} == held and sum(held.values()) == 5
    assert {(r.k, r.line_no): (r.tokens, r.run) for r in merge.token_runs(*args).collect()} == runs
    assert {r.k: (r.tokens, r.shared) for r in merge.bag_overlap(*args).collect()} == bags
    assert {(r.k, r.ocr_line_no, r.native_line_no): r.ratio for r in merge.similar_lines(*args).collect()} == alike and len(alike) == 6
