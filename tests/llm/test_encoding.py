import random

from foliant.llm import encoding as E

CLEAN = ["A comissão de inventário confirmou a existência do contrato.", "O perito nomeado impugnou a avaliação dos móveis, após negociação.", "À margem do relatório, a câmara de conciliação pediu decisão até três dias.", "NÃO, MAÇÃ e ÂNGULO; façade, naïve, Þórður, coração, função, público, técnica, agrícola."] * 20
RUSSIAN = ["Назначенный эксперт оспорил оценку мебели при двух соседках.", "Совет жильцов отметил отсутствие подписи, том 5 весит 6 кг."] * 30


def model():
    from collections import Counter

    words = Counter(w for t in CLEAN + RUSSIAN for w in E._high_words(t))
    known, pairs = Counter(), Counter()
    for w, n in words.items():
        if k := E._clean(w):
            known[k] += n
    for w, n in known.items():
        E.pairs_of(w, n, pairs)
    return E.Garbling(dict(pairs), dict(known))


def test_every_pair_and_layer_is_undone():
    fix = E.repairer(model())
    garble = lambda t, read, wrote="utf-8": t.encode(wrote).decode(read)
    for t in CLEAN[:2]:
        once = garble(t, "cp1252")
        for bad in (once, garble(once, "cp1252"), garble(t, "mac_roman"), garble(t, "cp437"), once.lower()):
            affected, lost, done = fix(bad)
            assert affected and not lost
            assert done == (t if bad != once.lower() else t.lower())
        for wrote, read in (("cp1252", "cp850"), ("cp850", "cp1252")):
            assert fix(garble(t, read, wrote)) == (True, False, t)
    for read in ("cp1252", "koi8_r"):
        bad = RUSSIAN[0].encode("cp1251").decode(read)
        assert fix(bad)[0] and sum(a != b for a, b in zip(fix(bad)[2], RUSSIAN[0])) <= 4


def test_right_text_stays():
    fix = E.repairer(model())
    for t in [*CLEAN[:4], *RUSSIAN[:2], "conf а e ｔｒａｔａ  ​ ­", "Quem assinou? A parte.", "http://x/?a=b", "", None]:
        assert fix(t) == (False, False, t)


def test_losses_are_found():
    fix = E.repairer(model())
    for t in ("a decis�o", "a cau??o", "Ap?s a vistoria", "OBJE??ES", "no guich? de atendimento"):
        assert fix(t)[:2] == (True, True)


def test_query(spark, pages, audit):
    rows = [(t, None) for t in CLEAN[:8]] + [(None, None), ("", ""), (CLEAN[0].encode().decode("cp1252") * 500, None), (CLEAN[1].encode().decode("cp1252"), None), (CLEAN[1].encode().decode("cp1252"), None)]
    a = audit(("f", 1, "s", ["não-lida", "nÃ£o-lida"]), ("f", 2, None, None), ("f", 3, "", [None, ""]))
    got = E.damaged(pages(*rows), a).collect()
    assert {(r.field_name, r.rec_id) for r in got} == {("native_text", 10), ("native_text", 11), ("native_text", 12), ("quality_flags", 0)}
    assert {r.rec_id: r.repaired for r in got if r.field_name == "native_text"}[11] == CLEAN[1]
    assert E.damaged(pages(*rows).limit(0), a.limit(0)).count() == 0


def test_random_bytes_do_not_break_it():
    fix, r = E.repairer(model()), random.Random(4)
    for _ in range(300):
        fix(bytes(r.randrange(256) for _ in range(30)).decode("latin-1"))


def test_question_marks_are_no_losses():
    m = model()
    fix = E.repairer(E.Garbling(dict.fromkeys(m.cost, 10), m.known, ["foi", "quem", "disse"]))
    for t in ("quem foi? disse o perito", "quem foi?disse o perito", "veja x.com/a?b=ção", "o que ? disse", "foi?? disse"):
        assert fix(t) == (False, False, t)
    assert fix("a inspe??o foi? disse")[:2] == (True, True)
