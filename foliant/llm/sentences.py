"""Problem 8: sentence boundaries across languages and scripts.

Semi-Markov dynamic programming.  Possible boundaries cut a block of text into
atoms; a sentence is a span of one or more atoms, and the best segmentation is
the one whose spans score highest in sum.  A span is scored as a whole: its
length, the words it opens and closes with, and whether its quotation marks and
brackets are balanced.

Defined results: null, empty and blank texts give no row; equal texts give equal
spans; an empty table gives an empty result; columns other than doc_id and text
are ignored.  A text of any length is treated whole, in linear time.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass

#: Marks that end sentences, opening and closing marks.
ENDS = ".!?…。！？｡।॥؟۔"
OPEN, CLOSE = "([{«“„‘「『（【《〈", ")]}»”’」』）】》〉"
QUOTES = "\"”“»«’'"

_BLANK_LINE = re.compile(r"\n[ \t\r\f\v 　]*(?:\n[ \t\r\f\v 　]*)+")
_ITEM = re.compile(r"[ \t]*(?:[-•*–—·▪◦‣]|(?:\(?\d{1,3}|\(?[ivx]{1,4})[.)]|\(?[a-zа-яA-ZА-Я]\))[ \t]+(?=\S)")
_HEAD = re.compile(r"[ \t]*#{1,6}[ \t]+\S")

#: A candidate: an end mark with the closing marks behind it.
_CANDIDATE = re.compile(
    r"(?:\.{2,}|…+|[.!?…]+|[。！？｡।॥؟۔]+)"
    r"(?:[)\]}»”’」』）】》〉\"']|“(?!\w))*"
)
_THAI = re.compile(r"[฀-๿]")
_THAI_GAP = re.compile(r"(?<=[฀-๿”\"')\]!?.])[ \t\n ]+(?=[฀-๿“\"'(\[])")
_WORD_BEFORE = re.compile(r"[\w.ऀ-ॿ'’-]*$")

#: Abbreviations of the languages at hand that need more words behind them.
ABBREVIATIONS = frozenset(
    """
    art arts av al cf ed eds fig fls fl inc jr ltda me mr mrs ms n no nº núm nos nr obs op p pág págs pp par prof profa
    dr dra drs drª dres sr sra srs sras srta d dª exmo exma ilmo ilma v vs vol vols ref refs seg tel ex trav pça rod des eng
    min proc gen cel cap sgt st sta sto rev col dept est univ vd pto ee uu apdo
    mt sgt capt gov sen rep hon messrs mme mlle mm m me bd éd env
    hr fr hrn abs bzw bzgl ca evtl ggf inkl nr str tel vgl z b zb d h u a o ä s sog usf bd jan feb mär apr jun jul aug sept okt nov dez
    sig dott ssa dott.ssa dr.ssa avv ing geom rag pag pagg cfr lett es
    г-н г-жа г ст гл п пп рис см ср стр тов ул д кв обл р т тыс проф акад им инж
    डॉ श्री सुश्री प्रो द م د أ ص
    """.split()
)
#: Abbreviations that may also close a sentence.
CLOSING_ABBREVIATIONS = frozenset("etc ecc usw segs ss co jr ltda a.m p.m s.a s.p.a др д т.д т.п пр руб usf ff sq a.c d.c u.a u.s us cia inc ltd corp".split())
#: Words that carry on a clause behind quoted speech.
CONTINUES = frozenset(
    """e and y und et и que then disse declarou afirmou perguntou respondeu dijo declaró preguntó said asked replied sagte fragte erklärte
    dit déclara demanda disse dichiarò rispose ha сказал сказала заявил заявила спросил ответил""".split()
)
_CLOSED = frozenset(CLOSE + QUOTES)
_FOLLOW = re.compile(r"[^\W\d_]+")
_ENUMERATED = frozenset("etc ecc usw".split())

def blocks(text: str):
    """(start, end) of stretches between blank lines, list items and headings each on their own."""
    at, n = 0, len(text)
    for m in _BLANK_LINE.finditer(text):
        if m.start() > at:
            yield from _lines(text, at, m.start())
        at = m.end()
    if at < n:
        yield from _lines(text, at, n)


def _lines(text: str, a: int, b: int):
    if "\n" not in text[a:b]:
        if text[a:b].strip():
            yield a, b, _ITEM.match(text, a, b) is not None or _HEAD.match(text, a, b) is not None
        return
    starts, at = [], a
    while at < b:
        nl = text.find("\n", at, b)
        end = b if nl < 0 else nl
        starts.append((at, end, _ITEM.match(text, at, end), _HEAD.match(text, at, end)))
        at = end + 1
    items = [s for s in starts if s[2]]
    listed = len(items) > 1 and _listed(text, items)
    start = a
    kind = False
    for s, e, item, head in starts:
        if (listed and item) or head:
            if text[start:s].strip():
                yield start, s, kind
            start, kind = s, True
        if head:
            yield s, e, True
            start, kind = min(e + 1, b), False
    if text[start:b].strip():
        yield start, b, kind


def _listed(text: str, items) -> bool:
    kinds = [re.sub(r"\w+", lambda m: "1" if m[0].isdigit() else "a", i[2][0].strip()) for i in items]
    return len(set(kinds)) < len(kinds)


def cuts(text: str, a: int, b: int, thai: bool = False) -> list[int]:
    """Ends of the atoms of a block, the last being b."""
    out = []
    for m in _CANDIDATE.finditer(text, a, b):
        e = m.end()
        if e >= b:
            break
        if m[0][0] == "." and e - m.start() == 1:
            nxt = text[e]
            if nxt in " \n":
                pass
            elif nxt.isdigit() or nxt.islower() or nxt in ",;:-/":
                continue
            elif nxt.isupper():
                before = text[m.start() - 1 : m.start()]
                if not before.islower() and not before.isdigit() and before not in _CLOSED:
                    continue
        out.append(e)
    if thai:
        out = sorted({*out, *(m.start() for m in _THAI_GAP.finditer(text, a, b))})
    out = [e for e in out if text[e:b].strip()]
    out.append(b)
    return out


def gap_score(text: str, a: int, s: int, e: int, b: int, abbreviations: frozenset[str]) -> float:
    """How well, in the block from a to b, a sentence whose last atom began at s closes at e and another opens there."""
    k = e - 1
    while k > s and text[k] in CLOSE + QUOTES:
        k -= 1
    mark = text[k]
    closed = k < e - 1
    j = e
    while j < b and text[j].isspace():
        j += 1
    blank = j > e
    nxt = text[j] if j < b else ""
    after = j
    while after < b and text[after] in OPEN + QUOTES + "¿¡":
        after += 1
    first = text[after] if after < b else ""
    if mark in "。！？｡":
        if closed:
            return _after_quote_cjk(text, j, b)
        return 4.0
    if mark in "।॥؟۔":
        return 4.0 if not closed else 2.0
    if not (mark in ENDS):  # a Thai blank
        return _thai(text, e, j)
    if "぀" <= first <= "鿿":
        return 3.0 if mark != "…" else -3.0
    lower = first.islower()
    if mark in "!?":
        if closed:
            return -4.0 if lower or nxt in ",;" else 3.0
        if not blank and nxt and nxt in ",;)":
            return -5.0
        return 1.0 if lower else 4.0
    if mark == "…" or text[k - 1 : k] == ".":
        if closed:
            return -4.0 if lower else 3.0
        if lower:
            return -3.0 if not blank else (0.6 if k - s > 30 else -1.5)  # hesitation comes early
        return 3.0
    # a full stop
    if nxt in (",", ";", ":"):
        return -6.0
    word = _WORD_BEFORE.search(text, max(a, k - 24), k)[0]
    low = word.lower().replace("’", "'").rpartition("'")[2].lstrip("-")
    if closed:
        if not lower:
            return 3.5
        # speech goes on with a verb or "and"; a whole sentence in marks of its own does not
        follow = _FOLLOW.match(text, j)
        return -4.0 if nxt in ",;" or (follow and follow[0] in CONTINUES and text[e - 1] != ")") else 1.5
    if len(low) == 1 and low.isalpha():
        if low in CLOSING_ABBREVIATIONS and _TAIL.search(text, max(a, k - 6), k):
            return -1.5 if lower else 2.0
        if word.isupper() or "." in text[max(s, k - 4) : k - 1]:
            return -4.0  # an initial
        if low in abbreviations:
            return -4.0
        return -1.0 if lower else 1.0
    if low in CLOSING_ABBREVIATIONS or low.rpartition(".")[2] in CLOSING_ABBREVIATIONS:
        if not first or first.isdigit():
            return -3.0
        return (0.4 if low in _ENUMERATED and k - s > 20 else -1.5) if lower else 1.5
    if low in abbreviations or low.rpartition(".")[2] in abbreviations or ("." in low and not low.replace(".", "").isdigit()):
        return -5.0
    if low.replace(".", "").replace(",", "").isdigit():
        if k - len(low) <= a + 1:
            return -6.0  # the number of an item
        if first.isdigit() or (not blank and not first.isupper()):
            return -4.0
        if len(low) <= 2 and _MONTH.match(text, after):
            return -5.0  # a day
        return 0.5 if lower else 2.0
    if not blank:
        return -6.0 if lower or first.isdigit() or not first.isalpha() else 2.5
    if first.isdigit():
        return -3.0 if len(low) <= 4 and k - len(low) <= s + 1 else 2.5
    return 1.2 if lower else 4.0


#: The first letters of the months where a day is written with a full stop.
_MONTH = re.compile(r"Jan|Jän|Feb|Mär|Apr|Mai|Jun|Jul|Aug|Sep|Okt|Nov|Dez")
_TAIL = re.compile(r"\bт\.\s?[дп]$|\bи\s[дп][рд]?$")


def _thai(text: str, e: int, j: int) -> float:
    before = text[e - 1 : e]
    return -4.0 if before.isdigit() or text[j : j + 1].isdigit() else 4.0


def _after_quote_cjk(text: str, j: int, b: int) -> float:
    """Quoted speech is continued by a particle, or by the comma or verb that names the speaker."""
    rest = text[j : j + 2]
    if rest[:1] in ("と", "、", "，", ",", "。") or rest in ("って", "など", "然后", "他说", "她说"):
        return -6.0
    return 3.0


def balance(text: str, s: int, e: int) -> float:
    """0 if the quotation marks and brackets of a span are balanced, less if it opens or closes what it does not hold."""
    depth, straight, bad = [], 0, 0
    for m in _MARKS.finditer(text, s, e):
        c = m[0]
        if c == '"':
            straight ^= 1
        elif depth and c in depth[-1]:
            depth.pop()
        elif c in _PAIRS:
            depth.append(_PAIRS[c])
        else:
            bad += 1
    return -3.5 * (len(depth) + bad + straight)


_MARKS = re.compile(r"[()\[\]«»“”„「」『』（）\"]")
_OPENING = frozenset("([«„「『（")
_PAIRS = {"(": ")", "[": "]", "«": "»", "“": "”", "„": "“”", "「": "」", "『": "』", "（": "）"}


def length_score(n: int) -> float:
    return -1.5 if n < 4 else -0.5 if n < 8 else 0.0 if n < _LONG else -(n - _LONG) / _SLOPE


_LONG, _SLOPE = 500, 400
#: A boundary inside a span counts this share of its score against it.
_INNER = 0.25
#: A boundary of this score is sure: a span without quotation marks or brackets gains by parting there.
_SURE = 4.0
#: Most quotation marks and brackets of one sentence.
MOST_MARKS = 64
#: A mark that lacks its partner, and the least length_score of a piece.
_ODD, _SHORT = 3.5, 1.5


def segment(text: str, a: int, b: int, abbreviations: frozenset[str] = ABBREVIATIONS, thai: bool = False) -> list[tuple[int, int]]:
    """The best spans of one block; spans of any number of atoms are weighed, with up to MOST_MARKS marks.

    Going back from an end, spans that cannot win are left out: those that gain by parting at one boundary behind which no
    mark needs a partner before it, and those that gain by parting at all boundaries more than the marks behind can lose.
    Beyond _LONG characters the score of a span without marks falls evenly, so the best of all longer ones is read from a
    running maximum.
    """
    ends = cuts(text, a, b, thai)
    if len(ends) == 1:
        return [(a, b)]
    starts = [a, *ends[:-1]]
    gaps = [gap_score(text, a, starts[i], e, b, abbreviations) for i, e in enumerate(ends[:-1])] + [0.0]
    some = _MARKS.search(text, a, b) is not None
    marks = [_MARKS.findall(text, starts[i], e) if some else () for i, e in enumerate(ends)]
    n = len(ends)
    below, pieces = [0.0] * n, [0.0] * (n + 1)  # sums of the scores of the boundaries before an atom, of the lengths of atoms
    for i in range(n):
        below[i] = below[i - 1] + gaps[i - 1] if i else 0.0
        pieces[i + 1] = pieces[i] + length_score(ends[i] - starts[i])
    best, back = [0.0] + [-1e18] * n, [0] * (n + 1)
    far: list[tuple[float, int]] = []  # per start, the best one of a long span among all back to the last mark or sure boundary
    edge: list[int] = []  # where these begin
    for j in range(1, n + 1):
        k = j - 1
        here = (best[k] + _INNER * below[k] + starts[k] / _SLOPE, k)
        joined = k > 0 and not marks[k] and not marks[k - 1] and gaps[k - 1] < _SURE
        far.append(max(here, far[k - 1], key=lambda x: x[0]) if joined else here)
        edge.append(edge[k - 1] if joined else k)
        last, held, closing, straight, i = ends[k], 0, 0, 0, k
        while i >= 0:
            for c in marks[i]:
                held += 1
                straight += c == '"'
                closing += c != '"' and c not in _OPENING
            if held > MOST_MARKS and i < k:
                break
            s = starts[i]
            if not held and last - s > _LONG and i < k:
                score, at = far[i]
                score += gaps[k] - _INNER * below[k] - (last - _LONG) / _SLOPE
                i = edge[i]
            else:
                at = i
                score = best[i] + gaps[k] - _INNER * (below[k] - below[i]) + length_score(last - s)
                if held:
                    score += balance(text, s, last)
            if score > best[j]:
                best[j], back[j] = score, at
            if i and not closing and not straight % 2:
                if (1 + _INNER) * gaps[i - 1] + length_score(last - starts[i]) > _SHORT:
                    break
            elif i and (1 + _INNER) * (below[k] - below[i - 1]) + pieces[j] - pieces[i] - _SHORT > _ODD * (2 * closing + straight + 1):
                break
            i -= 1
    out, j = [], n
    while j:
        i = back[j]
        out.append((starts[i], ends[j - 1]))
        j = i
    return out[::-1]


def spans(text: str | None, abbreviations: frozenset[str] = ABBREVIATIONS):
    """(start, end) of the sentences, in order, without surrounding blanks."""
    if not text:
        return
    thai = not text.isascii() and _THAI.search(text) is not None
    for a, b, whole in blocks(text):
        for s, e in [(a, b)] if whole else segment(text, a, b, abbreviations, thai):
            piece = text[s:e]
            s += len(piece) - len(piece.lstrip())
            e -= len(piece) - len(piece.rstrip())
            if e > s:
                yield s, e


def split(documents: DataFrame) -> DataFrame:
    """doc_id, char_start, char_end; one row per sentence."""

    def one(doc_id, text):
        return [(doc_id, s, e) for s, e in spans(text)]

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    return arrow_pass(rows, one, "doc_id bigint, char_start int, char_end int")
