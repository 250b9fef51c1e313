import unicodedata
from itertools import combinations

from foliant.llm import lookalike as L

BASE = "O ofício final, nº 945/2021:\nA ação é só de São João - fim."
SAME = [BASE.replace("o", "о"), BASE.replace(" ", "\xa0"), unicodedata.normalize("NFD", BASE), BASE.replace("fi", "ﬁ"), BASE.replace("ação", "a​ç­ão"), BASE.replace("945", "９４５"), unicodedata.normalize("NFD", BASE).replace("fi", "ﬁ")]
OTHER = [BASE.upper(), BASE.replace("ç", "c"), BASE.replace("5", "6"), BASE.replace("\n", " "), BASE.replace("nº", "no"), BASE.replace("ofício", "oficio"), BASE.replace("  ", " ") + "."]


def test_pairs_equal_brute_force(pages):
    texts = [BASE, *SAME, *OTHER, BASE, " \xa0", "  ", None, ""]
    got = {(r.layer_id_a, r.layer_id_b) for r in L.pairs(pages(*[(t, None) for t in texts])).collect()}
    same = {0, *range(1, len(SAME) + 1), texts.index(BASE, 1)}
    assert got == {(a, b) for a, b in combinations(sorted(same), 2) if texts[a] != texts[b]}


def test_fields_do_not_mix_and_empty_tables_are_empty(pages):
    p = pages((BASE, SAME[0]), (None, BASE))
    assert [(r.field_name, r.layer_id_a, r.layer_id_b) for r in L.pairs(p).collect()] == [("ocr_text", 0, 1)]
    assert L.pairs(p.limit(0)).count() == 0


def test_forms(pages):
    forms = {r.layer_id: r.form for r in L.consistent(pages(*[(t, None) for t in [BASE, *SAME, "x" * 200_000]])).collect()}
    assert {forms[i] for i in range(len(SAME) + 1)} == {BASE} and len(forms[len(SAME) + 1]) == 200_000


def test_classes_are_closed_and_rewriting_settles():
    table = {k: v for k, v in L.representatives({c: 1000 for c in "abcdefghijklmnopqrstuvwxyz"}).items() if k != v}
    assert table["о"] == table["ο"] == "o" and table["ｏ"] == "o"
    auto = L.automaton(table)
    for t in SAME:
        once = L.rewrite(t, auto)
        assert L.rewrite(once, auto) == once


def test_canonically_equal_texts_are_one():
    table = {k: v for k, v in L.representatives({}).items() if k != v}
    auto = L.automaton(table)
    for a, b in (("한국어", unicodedata.normalize("NFD", "한국어")), ("ẹ́", "ẹ́"), ("ẹ́", "ẹ́"), ("а̣́", "ạ́"), ("한", unicodedata.normalize("NFD", "한")[:2] + "​" + unicodedata.normalize("NFD", "한")[2:])):
        assert L.rewrite(a, auto) == L.rewrite(b, auto)
    assert L.rewrite("a" + "​‌" * 50 + "e​́", auto) == L.rewrite("aé", auto)


def test_hot_class_and_membership(pages):
    texts = [BASE] * 300 + [SAME[0]] + [OTHER[0]]
    p = pages(*[(t, None) for t in texts])
    assert {(r.layer_id_a, r.layer_id_b) for r in L.pairs(p).collect()} == {(i, 300) for i in range(300)}
    rows = {r.layer_id: (r.class_id, r.stored_texts) for r in L.membership(p).collect()}
    assert rows[299] == rows[300] == (0, 2) and rows[301] == (301, 1)
