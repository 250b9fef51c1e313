import random

import pytest

from foliant.llm import scan_noise as S

WORDS = "O escrevente substituto apresentou o depoimento prestado ao conselho fiscal na segunda-feira e manteve-se em silêncio sobre a cláusula do contrato"


@pytest.fixture()
def book(spark, pages, audit):
    clean = [(WORDS + ". " + WORDS, None)] * 12
    head = "Câmara de Mediação de Nova Candeia"
    ocr = [
        f"{head}\no depoi-\nmento do e5crevente na segunda-\nfeira e manteve-\nse em s|lêncio\nfls. 7",
        f"{head.upper()} .\n{WORDS}\numa linha do meio\noutra linha\nfls. 8",
        f"{head}\n{WORDS}\numa linha\n\nfls. 9",
        "Título único 12/2001\no contrato de 1O de maio\nxii",
        "",
        None,
    ]
    files = {i: "f" if i < 15 else "g" for i in range(12, 18)}
    p = pages(*clean, *[(None, o) for o in ocr], files={**files, **{i: "h" for i in range(12)}})
    a = audit(("in/f", 13, f"{head} o depoi- mento do e5crevente na segunda- feira e manteve-", None), ("in/f", 99, None, None), (None, None, "", None))
    f = spark.createDataFrame([("f", "in/f"), ("g", "in/g"), (None, None)], "file_id string, input_path string")
    return p, a, f


def test_kinds(book):
    got = {(r.field_name, r.rec_id, r.noise_kind) for r in S.found(*book).collect()}
    pages_ = {(i, k) for f, i, k in got if f == "ocr_text"}
    assert pages_ == {(12, "hyphen"), (12, "misread"), (12, "header"), (12, "page_number"), (13, "header"), (13, "page_number"), (14, "header"), (14, "page_number"), (15, "page_number")}
    assert {k for f, i, k in got if f == "summary" and i == 0} == {"hyphen", "misread", "header"}
    assert not any(f == "summary" and i for f, i, _ in got)


def test_repair(book):
    got = {(r.field_name, r.rec_id): r.repaired for r in S.repaired(*book).collect()}
    assert got["ocr_text", 12] == "o depoimento do escrevente na segunda-feira e manteve-se em silêncio"
    assert got["ocr_text", 16] == "" and ("ocr_text", 17) not in got
    assert got["summary", 0].startswith("o depoimento do escrevente na segunda-feira")


def test_empty(book):
    assert S.found(*(t.limit(0) for t in book)).count() == 0


def test_hash_differences_find_variants_as_brute_force_does(spark):
    often = {"prestado": 90, "comprovante": 80, "digitalizada": 70, "testemunha": 60, "torno": 50, "tomo": 50}
    rare = {"pre5taclo": "prestado", "cornprovante": "comprovante", "digitahzada": "digitalizada", "testemuriha": "testemunha", "0000S": None, "outro": None}
    vocab = spark.createDataFrame([*often.items(), *((w, 1) for w in rare)], "word string, cnt bigint")
    got = dict(map(tuple, S.corrections(vocab).collect()))
    assert got == {k: v for k, v in rare.items() if v}


def test_page_numbers():
    for line in ("fls. 7", "- 11 -", "Página 24 de 35", "p. 0037", "[41]", "16/25", "vi", "24", "Pág. 29", "fls. 2l"):
        assert S._PAGE_ONLY.match(line), line
    for line in ("de inverno.", "mil", "2007.", "vi a casa", "kg. 12 x", "d", "civil"):
        assert not S._PAGE_ONLY.match(line), line
    assert S._PAGE_LAST.match("Câmara de Nova - - 21 -")[1] == "Câmara de Nova" and not S._PAGE_LAST.match("Livro de atas nº 211")


def test_an_error_that_recurs_is_found(pages, audit, spark):
    p = pages(*[("a parte requereu vista do contrato", None)] * 40, *[(None, "a parte rcquereu vista do con†rato")] * 3)
    files = spark.createDataFrame([], "file_id string, input_path string")
    rows = S.texts(p, audit((None, None, "", None)))
    vocab = S.vocabulary(p)
    got = {(r.rec_id, r.word, r.correction) for r in S.word_noise(rows, vocab, S.corrections(vocab)).collect()}
    assert got == {(i, w, c) for i in (40, 41, 42) for w, c in (("rcquereu", "requereu"), ("con†rato", "contrato"))}
    assert {r.repaired for r in S.repaired(p, audit((None, None, "", None)), files).where("rec_id >= 40").collect()} == {"a parte requereu vista do contrato"}


def test_corrected_numbers_keep_their_letters():
    assert S._corrected("S123O4", {"S000O0": "S00000"}) == "S12304"
    assert S._corrected("(l2.3O4,", {"l0.0O0": "00.000"}) == "(12.304,"


def test_lines_go_from_where_they_stand_and_items_keep_theirs():
    assert S.reflow("Cabeçalho\ntexto\nCabeçalho", [("top", 0), ("bottom", 0)], {}, set()) == "texto"
    assert S.reflow("Cabeçalho\ntexto\nCabeçalho", [("bottom", 0)], {}, set()) == "Cabeçalho texto"
    assert S.reflow("lista:\n- item a\nque segue\n- item b\n1) item c\n\noutro", [], {}, set()) == "lista:\n- item a que segue\n- item b\n1) item c\n\noutro"


def test_headers_of_many_lines(pages, audit, spark):
    head = ["Comarca de Nova Candeia", "Cartório do Segundo Ofício", "Livro Geral de Atas", "Registro de Imóveis"]
    p = pages(*[(None, "\n".join([*head, f"texto corrido da página número {i} que segue", "e termina aqui."])) for i in range(6)], *[(None, f"Uma linha comum {i} aqui.\nTexto {i} sem nada.\n{head[2]}\noutra linha {i}.\nfim {i}.") for i in range(3)])
    got = {(r.rec_id, r.place, r.depth) for r in S.edge_cases(p, audit((None, None, "", None)), spark.createDataFrame([], "file_id string, input_path string")).collect()}
    assert got == {(i, "top", d) for i in range(6) for d in range(4)}


def test_short_and_much_damaged_words(spark):
    vocab = [("rua", 2000), ("rna", 2), ("de", 9000), ("dc", 3), ("ele", 900), ("clc", 400), ("modernamente", 50), ("rnoclernarnente", 1)]
    got = dict(map(tuple, S.corrections(spark.createDataFrame(vocab, "word string, cnt bigint")).collect()))
    assert got == {"rna": "rua", "dc": "de", "rnoclernarnente": "modernamente"}


def test_words_both_broken_and_misread(pages, audit, spark):
    p = pages(*[("o requerimento foi lido", None)] * 40, (None, "o reque-\nrirnento foi lido"))
    files = spark.createDataFrame([], "file_id string, input_path string")
    got = {(r.rec_id, r.noise_kind) for r in S.found(p, audit((None, None, "", None)), files).collect()}
    assert got == {(40, "hyphen"), (40, "misread")}


def test_altered_headers_equal_brute_force(spark):
    rng = random.Random(2)

    def change(w):
        w = list(w)
        for _ in range(rng.randrange(0, 5)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["x"], [w[k], "y"]])
        return "".join(w)

    base = ["".join(rng.choice("aeiorstnm") for _ in range(rng.randrange(6, 40))) for _ in range(40)]
    lines = {("f", change(b)) for b in base for _ in range(12)} | {("g", b) for b in base[:5]}
    lines = {x for x in lines if x[1]}
    known = [("f", b, few) for b, few in zip(base, [True] * 10 + [False] * 25 + [None] * 5)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    want = {(f, k) for f, k in lines if any(f == g and distance(k, of) <= S.HEADER_EDITS * len(of) for g, of, _ in known)}
    tables = spark.createDataFrame(sorted(lines), "file_id string, key string"), spark.createDataFrame(known, "file_id string, key string, few boolean")
    for many in (0, 1000):
        assert {tuple(r) for r in S.altered(*tables, many).collect()} == want and len(want) > 100
