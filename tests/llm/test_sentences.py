import random

import pytest

from foliant.llm import sentences as S

CASES = {
    "por": ["O Dr. A. B. Silva pagou R$ 1.234,56 em 02.03.2004.", "Vieram mesas, cadeiras etc.", "O prazo... bem, o prazo acabou!", "“Nada a declarar.”", "(Tudo foi lido.)", "Quem assinou?", "Ref. ao n. 12/2009, a Exma. Sra. X. pediu vista."],
    "eng": ["Mr. F. L. Ardovaz arrived at 8:57 a.m. with the file.", 'He asked, "Where is the original?" and waited.', '"I got nothing. Nobody told me," said the witness.', "It rose from 1.2 to 2.36, i.e. slightly.", "Inc. papers went to Acme Inc.", "The end."],
    "spa": ["Preguntó: «¿Dónde está el original?», y esperó.", "«No recibí nada. Nadie me avisó», declaró la testigo.", "Ganó el lote núm. 44.", "¿Quién firmó?"],
    "deu": ["Hr. Dr. G. Z. kam am 02. März um 11.51 Uhr an.", "„Ich habe nichts erhalten. Niemand hat mich gewarnt“, sagte die Zeugin.", "Nach § 5 Abs. 3 kostet ein Band 8,24 Euro."],
    "rus": ["Там были столы, стулья и т. д.", "Г-н А. Велторин прибыл в 10.23 с делом, т. е. слишком рано.", "Какая задержка!"],
    "hin": ["वादी पक्ष ने रसीद खोजी।", "शुल्क 59.821 रुपये है।"],
}


@pytest.mark.parametrize("lang", CASES)
def test_sentences(lang):
    text = " ".join(CASES[lang])
    assert [text[a:b] for a, b in S.spans(text)] == CASES[lang]


@pytest.mark.parametrize("lang", CASES)
def test_wrapping_changes_nothing(lang):
    text = " ".join(CASES[lang]).replace(" ", "\n", 30)
    assert [text[a:b].replace("\n", " ") for a, b in S.spans(text)] == CASES[lang]


def test_scripts_without_blanks():
    for whole in (["証人は「何もない。誰もいない。」と述べた。", "指数は3.15から9.1へ動いた。", "「終わった。」"], ["证人说：“我没收到。没有人通知我。”然后沉默了。", "拖得太久了！", "“一式两份。”"]):
        text = "".join(whole)
        assert [text[a:b] for a, b in S.spans(text)] == whole


def test_thai_blanks():
    text = "เอกสารมาถึงเวลา 13.37 นาฬิกา เสมียนขอเลื่อน"
    assert [text[a:b] for a, b in S.spans(text)] == ["เอกสารมาถึงเวลา 13.37 นาฬิกา", "เสมียนขอเลื่อน"]


def test_blocks():
    text = "Título do capítulo\n\n1. primeiro item\n2. segundo. item\n\n- a\n- b;\n\n# Outro título\n\nUma linha\nquebrada sem ponto"
    assert [text[a:b] for a, b in S.spans(text)] == ["Título do capítulo", "1. primeiro item", "2. segundo. item", "- a", "- b;", "# Outro título", "Uma linha\nquebrada sem ponto"]


def test_spans_cover_every_mark_once():
    for lang in CASES:
        text = "  " + "\n\n".join(CASES[lang]) + "  fim "
        spans = list(S.spans(text))
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert sum(len("".join(text[a:b].split())) for a, b in spans) == len("".join(text.split()))


def test_query(spark):
    docs = spark.createDataFrame([(1, "Um. Dois.", 0), (2, None, 0), (3, " \n ", 0), (4, "Frase longa. " * 20_000, 0), (1, "Um. Dois.", 0)], "doc_id bigint, text string, char_start int")
    got = S.split(docs)
    assert sorted(tuple(r) for r in got.where("doc_id = 1").collect()) == [(1, 0, 3), (1, 0, 3), (1, 4, 9), (1, 4, 9)]
    assert got.where("doc_id = 4").count() == 20_000 and got.where("doc_id in (2, 3)").count() == 0
    assert S.split(docs.limit(0)).count() == 0


def test_sentences_of_any_number_of_atoms():
    t = "Foi visto por " + " ".join(f"{c}." for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGHIJ") + " Silva ontem."
    assert list(S.spans(t)) == [(0, len(t))]


def _best(text):
    """Score of the best segmentation, by weighing every span."""
    ends = S.cuts(text, 0, len(text))
    starts = [0, *ends[:-1]]
    gaps = [S.gap_score(text, 0, starts[i], e, len(text), S.ABBREVIATIONS) for i, e in enumerate(ends[:-1])] + [0.0]
    span = lambda i, j: gaps[j] - 0.25 * sum(gaps[i:j]) + S.length_score(ends[j] - starts[i]) + S.balance(text, starts[i], ends[j])
    best = [0.0]
    for j in range(len(ends)):
        best.append(max(best[i] + span(i, j) for i in range(j + 1)))
    return best[-1], starts, ends, span


def test_segmentation_is_the_best_of_all():
    rng = random.Random(1)
    words = ["A.", "B.", "Dr.", "casa", "foi.", "disse.", '"Oi.', 'ali."', "(ver", "lá.)", "12.", "Sim!", "etc.", "«Não.", "x»", "o", "Maria", "ontem."]
    for k in range(200):
        t = " ".join(rng.choice(words) for _ in range(rng.randrange(2, 60 if k % 3 else 200)))
        best, starts, ends, span = _best(t)
        if len(ends) > 1:
            got = sum(span(starts.index(s), ends.index(e)) for s, e in S.segment(t, 0, len(t)))
            assert abs(got - best) < 1e-6


def test_long_texts_take_linear_time():
    for t in ("A. " * 20_000 + "Silva veio.", "( . " * 10_000, "Ele foi. " * 10_000, '"Ele foi. ' + "Ela veio. " * 10_000):
        assert list(S.spans(t))
