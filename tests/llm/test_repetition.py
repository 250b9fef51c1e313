import random

from foliant.llm import repetition as R

PLAIN = "A testemunha entregou a mídia com as gravações. O síndico pediu nova vistoria do prédio inteiro. Depois o perito anexou fotografias ao laudo final."
SPAM = "\n".join(f"{x} a planilha do lote {i}{y}" for i, (x, y) in enumerate([("Consulte", "."), ("CONSULTE", "!"), ("** consulte", " **"), ("C0nsulte", "...")] * 6))


def brute(ws):
    pairs = list(zip(ws, ws[1:]))
    hit = set()
    for i, p in enumerate(pairs):
        if p not in R._NUMBERS and any(q == p for j, q in enumerate(pairs[:i]) if j < i - 1 or (j == i - 1 and p[0] == p[1])):
            hit |= {i, i + 1}
    return len(hit) / len(ws) if len(ws) > 1 else 0.0


def test_share_equals_brute_force():
    r = random.Random(5)
    for _ in range(300):
        ws = [r.choice(["a", "b", "c", R._ZERO]) for _ in range(r.randrange(0, 20))]
        assert R.repeated_share(ws) == brute(ws)


def test_noise_counts_as_the_same():
    a, b = R.words("Na data indi-\ncada, o perito 12 saiu!"), R.words("NA  DATA 1ndicada o pcrito 7 saiu")
    assert a == b
    assert R.repeated_share(R.words(SPAM)) > 0.9 and R.repeated_share(R.words(PLAIN)) == 0


def test_em_finds_the_bad_rule():
    patterns = {(1, 1, 0): 90, (0, 0, 0): 800, (0, 0, 1): 60, (1, 1, 1): 5, (-1, 0, -1): 45}
    prior, rates = R.fit(patterns)
    assert 0.05 < prior < 0.2
    assert R.posterior((1, 1, 0), prior, rates) > 0.9 > 0.1 > R.posterior((0, 0, 1), prior, rates)


def test_query(pages):
    rows = [(PLAIN, SPAM), (None, ""), ("um", "um um"), (SPAM, PLAIN * 300), (SPAM, None)] + [(PLAIN, None)] * 30
    p = pages(*rows)
    assert {(r.field_name, r.layer_id) for r in R.repetitive(p).collect()} == {("ocr_text", 0), ("native_text", 3), ("native_text", 4), ("ocr_text", 3)}
    assert R.measure(p).count() == 38 and R.judged(p.limit(0)).count() == 0


def test_no_rate_is_certain_and_the_posterior_decides(pages):
    prior, rates = R.fit({(1, 1, 1, 1): 90, (0, 0, 0, 0): 900, (-1, 1, 0, 0): 10})
    assert 0.001 < prior < 0.999 and all(q > 0.0005 and p < 0.9995 for p, q in rates)
    found = {(r.field_name, r.layer_id) for r in R.judged(pages((SPAM, PLAIN), *[(PLAIN, None)] * 20)).where("posterior >= 0.5").collect()}
    assert found == {("native_text", 0)}


def test_breaks_with_blanks():
    assert R.words("na ins- \n pe=\t\nção") == R.words("na inspeção")
