import random

import pytest

from foliant.llm import personal as P

FIRST, LAST = ["Murilo", "Helena", "Edson", "Bruna"], ["Quirelles", "Ardovaz", "Telvorin", "Seprano"]


@pytest.fixture(scope="module")
def corpus():
    out = []
    for i in range(80):
        f, n = FIRST[i % 4], LAST[(i // 4) % 4]
        mail = f"{f}.{n}@posta.invalid".lower()
        out += [
            f"{f} {n} pediu cópia pelo e-mail {mail}. O protocolo 793.649.6{i:02d}-54 continua sem resposta.",
            f"Compareceu {f} {n}, CPF 184.000.2{i:02d}-99, com domicílio na Rua das Acácias, nº {i + 10}, Nova Candeia, CEP 00{i + 100}-576. A Padaria {n} abriu.",
            f"A Sra. {f} {n} informou o telefone (30) 932{i:02d}-9521 para recados. Contato: {mail} ou (30) 941{i:02d}-1234.",
            f"Compareceu {f} {n}, NIS 524.171{i:02d}.23-1, com domicílio na Alameda Maria Brizande, s/n - Serra Lisa, à tarde.",
        ]
    return out


@pytest.fixture(scope="module")
def known(spark, corpus):
    return P.learn(spark.createDataFrame([(i, t, None) for i, t in enumerate(corpus)], "layer_id bigint, native_text string, ocr_text string"))


def found(known, text):
    return [(k, text[a:b]) for k, a, b in P.Finder(known).spans(text)]


def test_stretches_of_every_type(known):
    text = "Compareceu ARDOVAZ, Bruna, CPF 184.111.222-33, com domicílio na Av. do Moinho, 45, bloco B, Serra Lisa, CEP 00123-456. Recado de H. Telvorin: (30) 93288-1111 ou h.telv (arroba) posta.invalid"
    assert found(known, text) == [("NAME", "ARDOVAZ, Bruna"), ("ID_NUMBER", "184.111.222-33"), ("ADDRESS", "Av. do Moinho, 45, bloco B, Serra Lisa, CEP 00123-456"), ("NAME", "H. Telvorin"), ("PHONE", "(30) 93288-1111"), ("EMAIL", "h.telv (arroba) posta.invalid")]


def test_unseen_label_is_discovered(known):
    assert ("ID_NUMBER", "999.88877.66-5") in found(known, "Assinado por Bruna Seprano, NIS 999.88877.66-5.")


def test_what_looks_alike_is_left(known):
    assert found(known, "O protocolo 111.222.333-44 sumiu. A Padaria Quirelles abriu. A Praça da Concórdia recebeu 12 caixas.") == []


def test_stretches_across_lines_and_noise(known):
    text = "A Sra. Hele-\nna Ar​dovaz informou o telefone (30)\n932O1-9S21 para recados."
    assert found(known, text) == [("NAME", "Hele-\nna Ar​dovaz"), ("PHONE", "(30)\n932O1-9S21")]


def test_query(spark, known, pages):
    p = pages(("Fale com edson@posta.invalid já", None), (None, ""), ("x " * 100_000, "\n"), ("Fale com edson@posta.invalid já", None))
    got = [tuple(r) for r in P.find(p, known).collect()]
    assert sorted(got) == [("native_text", 0, "EMAIL", 9, 28), ("native_text", 3, "EMAIL", 9, 28)]
    texts = {(r.field_name, r.layer_id): r.text for r in P.replaced(p, known).collect()}
    assert texts["native_text", 0] == "Fale com [EMAIL] já" and texts["ocr_text", 1] == "" and len(texts) == 5
    assert P.find(p.limit(0)).count() == 0


def test_unknown_names_by_patterns(known):
    assert found(known, "A Sra. Zulmira Xandrovic informou o telefone (30) 93288-1111 para recados.")[0] == ("NAME", "Zulmira Xandrovic")
    assert found(known, "A Padaria Xandrovic Zulmira abriu.") == []


def test_tables_beyond_the_bound_are_joined(spark, corpus, monkeypatch):
    extra = ["Compareceu Zulmira Xandrovic, CPF 184.000.299-99, e saiu.", "A Sra. Zulmira Xandrovic informou o telefone (30) 93299-9521 para recados."]
    texts = [*corpus, *extra, "Ontem veio zulmira xandrovic sozinha da Av. do Moinho, 45, Serra Lisa."]
    p = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "layer_id bigint, native_text string, ocr_text string")
    rows = lambda: sorted(tuple(r) for r in P.find(p).collect())
    few = rows()
    assert ("native_text", len(texts) - 1, "NAME", 11, 28) in few
    for held in (1, 12):  # as if the tables were many times as large
        monkeypatch.setattr(P, "HELD", held)
        assert rows() == few


@pytest.mark.parametrize("lead", ["Nome:", "Assinado/", "Sr.", "contato=", "—", "(", "x" * 300 + " ", "A" * 300 + " "])
def test_names_after_any_sign(known, lead):
    assert found(known, f"{lead}Bruna Seprano") == [("NAME", "Bruna Seprano")]


def test_prune_equals_full_scan(known, corpus):
    rng, signs = random.Random(5), [" ", "\n", ":", "/", "=", "-\n", "—", ".", ", ", "(", "'", "_", "|", "! "]
    words = [w for t in corpus[:8] for w in t.split()] + ["bruna", "SEPRANO", "H.", "Hel3na", "Quirelles'", "@rdovaz"]
    f = P.Finder(known)
    for _ in range(400):
        t = "".join(rng.choice(words) + rng.choice(signs) for _ in range(rng.randrange(1, 30)))
        full = list(f.names(P.plain(t)[0]))
        assert not full or f.has_names(P.plain(t)[0])


def test_whole_stretches_however_long(known):
    assert found(known, "Fale com " + "a" * 70 + "@posta.invalid já") == [("EMAIL", "a" * 70 + "@posta.invalid")]
    assert found(known, "telefone " + "9" * 80) == [("PHONE", "9" * 80)]
    assert len(found(known, "Bruna Seprano " * 3000)) == 3000
    assert found(known, "l" * 20_000 + " a" * 20_000 + "@" * 500) == []


def test_addresses_by_learned_street_words(known):
    for t in ("Rua T 63, 1200", "Rua C 104, nº 77", "Alameda Velha Guarda, 12"):
        assert found(known, f"Mora na {t} hoje.") == [("ADDRESS", t)]
    assert found(known, "Pagou à Mercearia Velha, 12 reais. Em Mercearia Velha, 12, havia luz.") == []


def test_signs_of_mail_addresses_are_learned(spark, corpus):
    more = [f"Escreva a {f.lower()}.{n.lower()} {{arob}} posta.invalid já." for f in FIRST for n in LAST] + ["Foi publicado (em) jornal.exemplo ontem, o texto (em) folha.exemplo e {em} jornal.exemplo."] * 3
    k = P.learn(spark.createDataFrame([(i, t, None) for i, t in enumerate([*corpus, *more])], "layer_id bigint, native_text string, ocr_text string"))
    assert found(k, "Escreva a zu {arob} posta.invalid já, está (em) jornal.exemplo") == [("EMAIL", "zu {arob} posta.invalid")]


def test_numbers_need_a_fitting_form(known):
    assert found(known, "para 1.250.000 alunos e 2.345.678 habitantes, em 13-06-1990") == []
    assert found(known, "call +44 20 7946 0958 or SSN 123-45-6789") == [("PHONE", "+44 20 7946 0958"), ("ID_NUMBER", "123-45-6789")]
    assert found(known, "telefone (BO)\n9321O-9S21 14:36") == [("PHONE", "(BO)\n9321O-9S21")]


def test_breaks_with_blanks(known):
    assert found(known, "Hele= \nna Ardovaz e Hele-  \n na Ardovaz") == [("NAME", "Hele= \nna Ardovaz"), ("NAME", "Hele-  \n na Ardovaz")]


def test_number_scan_equals_the_pattern(monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choice("0123456789012345OolISBZ|x+( .()-/\nAXQ,:a") for _ in range(rng.randrange(1, 80))) for _ in range(4000)]
    fast = [list(P.numbers(t)) for t in texts]
    monkeypatch.setattr(P, "_numbers_in", P._NUM.finditer)
    assert fast == [list(P.numbers(t)) for t in texts] and sum(map(len, fast)) > 500


def test_last_label_is_that_of_the_words_before(corpus):
    for t in [*corpus, "CPF nº 1", "nº 2", "", "( . 3", "12/3 a@b 4", "Tel.: (", "x" * 200 + " 5"]:
        for a in range(0, len(t) + 1, 3):
            assert P.label_before(t, a) == (P.before(t, a) or ["^"])[-1]


def layers(spark, texts):
    return spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "layer_id bigint, native_text string, ocr_text string")


@pytest.mark.parametrize("times", [1, 25])
def test_a_last_name_that_stands_first_now_and_then_stays_one(spark, corpus, times):
    # in a table 25 times as large, what stands wrong is there 25 times as often
    wrong = [f"Compareceu glória dos {n} Telvorin, CPF 184.000.299-99, com domicílio." for n in ("Ardovaz", "Quirelles")]
    k = P.learn(layers(spark, [*corpus, *wrong] * times))
    for n in ("Ardovaz", "Quirelles", "Telvorin", "Seprano"):
        assert found(k, f"À tarde veio {n}, Bruna sozinha. Então disse helena {n.lower()} que sim.") == [("NAME", f"{n}, Bruna"), ("NAME", f"helena {n.lower()}")]


def test_places_behind_each_end_of_a_place_are_asked_for(known):
    text = "Mora na Av. do Moinho, 45, Serra\nLisa, Nova Candeia, à tarde."
    rest = P.Learned(held={k: v for k, v in known.held.items() if k[0] != "p"}, hashes=b"\xff" * (P.HASHES // 8), places=True)
    asked = P.Finder(rest).open_keys(text)
    assert {"p serra hsa", "p nova eandela"} <= set(asked)
    assert P.Finder(rest).spans(text, {k: known.held[k] for k in asked if k in known.held and k[0] == "p"}) == P.Finder(known).spans(text)


def test_the_next_sentence_tells_nothing_of_a_number(spark, corpus):
    more = []
    for i in range(40):
        after = ("The audit ended.", "The witness left.", "Even so, it rained.")[i % 3]
        more += [f"He showed tax number 732 232 8{i:02d}. {after}", f"He showed ID card no. 991{i:02d}208-U. {after}", *[f"O protocolo 793.649.6{i:02d}-54. {after}"] * 20]
    k = P.learn(layers(spark, [*corpus, *more]))
    assert found(k, "He showed ID card no. 99104208-U. The audit ended.") == [("ID_NUMBER", "99104208-U")]
    assert P.behind("CPF 1. The audit", 5) == "" and P.behind("CPF 1, the audit", 5) == "the audit"


def test_damaged_labels_are_labels(known):
    assert P.label_before("O te1efone 5", 11) == P.label("telefone") and P.label_before("O pr|t@colo 5", 12) == P.label("prltacolo")
    for t in ("lote AB92-15 5", "bruna.s@posta.invalid 5", "às 12h47min 5", "a@b 5"):
        assert P.label_before(t, len(t) - 1) == "#"
    assert found(known, "O pr0toco1o 184.000.211-99 sumiu.") == []


def test_a_phone_on_file(known):
    assert found(known, "Phone on file: (30) 93288-1111. See file 134-54/2023.") == [("PHONE", "(30) 93288-1111")]


def test_places_among_the_rest_count(spark, corpus):
    assert P.learn(layers(spark, corpus), 1).places
