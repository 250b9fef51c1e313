"""Problem 2: personal information inside free text.

Bootstrapped contextual extraction.  Candidates are counted over all layers as
edges of graphs between lexical patterns and instances:

* numbers: the words around them, and their label with their shape;
* mail addresses: the sign between local part and domain, and the address and its domain;
* addresses: the words before and the place, complement or postal code behind, and the street word;
* names: the words on either side, and the capitalised words.

A few seed entities (plain mail addresses, some street words, labels of numbers,
names that a mail address repeats) start with a score.  Spark spreads scores
over the graphs, from instances to patterns and back, for a few rounds.
Patterns and instances of high confidence then decide about every stretch, also
those that no seed knows.

Defined results: null, empty and blank layers give no row; equal layers give
equal stretches; empty tables give empty results; columns other than the named
ones are ignored.  Stretches of a layer never overlap.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, cut, layer_rows
from .lookalike import LOOK_ALIKE

ROUNDS = 3
#: Scores from which a pattern or instance counts as one of its type.
CONFIDENT = 0.5
#: What is seen less often gives no evidence: a fixed number, whatever the size of the tables.
LEAST = 2
#: The same for street words and places.
LEAST_PLACES = 3
#: A pattern of this score, around so many different names, makes a name of unknown words.
SURE, SURE_NAMES = 0.9, 3
#: A number's label says this many times as much as the words farther off.
LABEL_WEIGHT = 3
#: The share of a number's form that a type must have for a label to give it that type.
POSSIBLE = 0.1
#: Rows of what was learned that every task holds, the most frequent ones; the rest is joined to the texts that need it.
HELD = 50_000
#: Size of the table of hashes that tells which words, labels and places may be among the rest.
HASHES = 1 << 23

#: Seed words before a number, by type; "-" marks numbers that are issued to no person.
SEEDS = {
    "PHONE": "telefone fone tel celular call llame phone mobile teléfono móvil téléphone telefon handy телефон",
    "ID_NUMBER": "cpf rg identidade dni passaporte passport pasaporte passeport nif tax ssn ausweis паспорт инн",
    "-": "processo protocolo nota fiscal lote file expediente dossier akte дело том r$",
}
TYPES = (*SEEDS, "EMAIL", "ADDRESS", "NAME")
#: Seed street words, before a name and number and behind a number and name.
STREETS = ("rua avenida av. calle rue", "street road avenue")
#: Seed signs between the parts of a mail address; brackets of all kinds are one.
SIGNS = ("@", "(arroba)", "(at)", "arroba")
#: Words before a capitalised word that make it the name of a firm, school or street.
NOT_PERSONS = frozenset(
    """padaria escola clínica instituto construtora editora transportes empresa condomínio associação fundação farmácia hospital colégio
    bakery company school firma secretaria câmara cartório arquivo comissão rua avenida travessa alameda rodovia praça calle plaza street""".split()
)
PARTICLES = frozenset("de da do dos das e del della von van".split())
#: Words that stand before a street word and are none.
BEFORE_STREETS = frozenset("na no da do de em à ao a o nas nos en la el at to in the per por para e und im".split())

_TITLE = r"[A-ZÀ-ÖØ-ÞЀ-Я][a-zß-öø-ÿа-џ]+"
_NAME = re.compile(rf"{_TITLE}(?:\s(?:de|da|do|dos|das)\s{_TITLE}|\s{_TITLE}){{1,2}}(?![\w])|{_TITLE},\s{_TITLE}(?=[\s,:(])")
_D = "0-9OolISBZ|"
_G = rf"(?=[OolISBZ|]*\d)[{_D}]"  # one of a group of digits, at least one of them beyond doubt
_GROUP = rf"(?:(?=[{_D}]*\d[OolISBZ|]*\d)[{_D}]{{2,}}|{_G}{{2,}})"
_NUM = re.compile(
    rf"(?<![\w/@.,-])(?:\+|\({{0,2}})(?:[OoQ0]?xx[{_D}]{{2}}|[A-Z]{{2}}{_G}{{6}}(?!\w)|(?<=\()[{_D}]{{2}}(?=\)[ \n-]?{_G})|(?<=\+)[{_D}]{{2}} [OolISBZ|]{{2}}(?= {_G})|(?<=\+)[{_D}]{{1,2}}(?=[ \n]?[ (]{_G})|{_G}(?=[{_D} .()\n-]))"
    rf"[{_D}]*(?:(?:[ .\n-]|\)[ \n-]?|[ \n]?\()?(?<=\D)(?!\d\d?:\d){_GROUP}|[./-]{_G}(?!\w)|\){_G}+|[ \n]?\([{_D}]{{2}}(?=\)[ \n-]?{_G}))*(?:-[A-Z{_D}](?!\w))?"
)
_SIGN = re.compile(r"[@(\[{<](?:(?<=@)|\s?([^\W\d_]{2,8})\s?[)\]}>])")
_BRACKET = re.compile(r"[(\[{<]\s?[^\W\d_]{2,8}\s?[)\]}>]\s?[A-Za-z0-9][\w-]*\.")
_DOTTED = re.compile(r"\.[^\W\d_]{2}")
_BARE = re.compile(r"\s([^\W\d_]{2,8})\s$")
_LOCAL = re.compile(r"[A-Za-z0-9_À-ÿ][\w+-]*(?:\.[\w+-]+)*$")
_DOMAIN = re.compile(r"[A-Za-z0-9][\w-]*(?:\.[\w-]*\w)+")
_LETTER = re.compile(r"[^\W\d_]")


def _local(t: str, e: int) -> int:
    """Where the local part that ends at e begins; e itself if there is none."""
    a = e
    while a and (t[a - 1].isalnum() or t[a - 1] in "._+-"):
        a -= 1
    m = _LOCAL.search(t[a:e])
    return a + m.start() if m else e


def _mail(t: str, a: int, e: int, sign: str):
    start, right = _local(t, a), _DOMAIN.match(t, e)
    if start < a and right and _LETTER.search(right[0].rpartition(".")[2]):
        yield start, right.end(), t[start:a], right[0].lower(), sign


def mails(t: str):
    """Candidate mail addresses: (start, end, local part, domain, sign between them)."""
    if "@" in t or _BRACKET.search(t):
        for m in _SIGN.finditer(t):
            a, e = m.span()  # and a blank on either side
            yield from _mail(t, a - (t[a - 1 : a].isspace()), e + (t[e : e + 1].isspace()), f"({m[1].lower()})" if m[1] else "@")
    done = -1
    for m in _DOTTED.finditer(t):  # a bare word for the sign
        a = m.start()
        while a and (t[a - 1].isalnum() or t[a - 1] in "_.-"):
            a -= 1
        if a > done and (w := _BARE.search(t, max(0, a - 10), a)):
            yield from _mail(t, w.start(), a, w[1].lower())
        done = a


_NO = r"(?:(?:[Nn][º°.o]?\s*|[Kk][Mm]\s*)?(?=[OolISB|]*\d)[0-9OolISB|]{1,5}|[Ss]\s?/\s?[Nn])(?![\w/])"
_PART = r"(?:,\s*(?:apto\.?|ap\.|bloco|casa|sala|lote|fundos|andar|quadra|cj\.?|conj\.?|piso|puerta|flat|apt\.?)\s*\w+|,\s*\d{1,2}\.?º(?:\s?[A-Z](?!\w))?)"
_CEP = r"(?:,?\s*CEP\s*[0-9OolISB|]{5}-?[0-9OolISB|]{3})"
_CAPS = r"[A-ZÀ-Ý0-9|@][\w'’|@†-]+(?:\s(?:(?:de|da|do|dos|das|del|la)\s)?[A-ZÀ-Ý][\w'’|@†-]+){0,3}"
_PLACE = rf"(?:(?:,|\s[-–])\s{_CAPS})"
#: A house number behind a comma; the comma comes first, so the search is for one sign.
_HOUSE = re.compile(rf",\s*{_NO}", re.I)
_PARTS = re.compile(rf"{_PART}", re.I)
_PLACE_AT, _CEP_AT = re.compile(_PLACE), re.compile(_CEP, re.I)
_STREET_WORD = re.compile(r"[\w'’.|@†/-]+")
_STREET_WORDS = 7  # a street's words, the street word among them
#: A house number before capitalised words: a digit, more signs of the number, and the words; the number may begin before the digit.
_FIRST = re.compile(r"\d[0-9OolISB|]{0,4}((?:\s[A-Z][\w'’|@†]+){2,4})\b")
_HOUSE_SIGNS = frozenset("0123456789OolISB|")

_SAME_WIDTH = {ord(x): y for a, b in LOOK_ALIKE.items() for x, y in zip(a, b)} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {c: " " for c in (0xA0, 0x2007, 0x202F, 0x2009, 0x200A, 0x3000)}
_WIDE = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_SAME_WIDTH)) + "]")
_UNSEEN = "\u00ad\u200b-\u200f\u2060\ufeff"
_BREAK = re.compile(f"[-¬=‐{_UNSEEN}](?:(?<=\\w[-¬=‐\u00ad])[ \\t]*\\n[ \\t]*(?=\\w)|(?<=[{_UNSEEN}]))")


@lru_cache(maxsize=200_000)
def fold(word: str) -> str:
    """Lower-case letters without accents, shapes a scanner mixes up together."""
    w = word.lower()
    if not w.isascii():
        w = "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))
    for a, b in (("cl", "d"), ("rn", "m"), ("ri", "n"), ("li", "h")):
        w = w.replace(a, b)
    return w.translate(_FOLD)


_FOLD = str.maketrans({"0": "o", "1": "l", "|": "l", "!": "l", "i": "l", "5": "s", "$": "s", "6": "b", "8": "b", "@": "a", "4": "a", "c": "e", "3": "e", "†": "t", "f": "t", "ſ": "t", "9": "g", "q": "g", "'": None, "’": None})


def _one_width(text: str) -> str:
    try:
        text.encode("latin-1")
        if "\xa0" in text:
            text = text.replace("\xa0", " ")
    except UnicodeEncodeError:
        if _WIDE.search(text):
            text = text.translate(_SAME_WIDTH)
    return text


def _stays(text: str, m: re.Match) -> bool:
    """A hyphen between parts of a number or address stays."""
    return "\n" in m[0] and (text[m.start() - 1].isdigit() or text[m.end()].isdigit())


def flat(text: str) -> str:
    """The text of plain, without the places."""
    text = _one_width(text)
    return _BREAK.sub(lambda m: m[0][0] if _stays(text, m) else "", text)


def plain(text: str) -> tuple[str, list[int] | None]:
    """The text without breaks inside words and unseen marks, in one width; and where each character was, if any moved."""
    text = _one_width(text)
    at, out, places = 0, [], []
    for m in _BREAK.finditer(text):
        end = m.start() + _stays(text, m)
        out.append(text[at:end])
        places.extend(range(at, end))
        at = m.end()
    if not out:
        return text, None
    out.append(text[at:])
    places.extend(range(at, len(text) + 1))
    return "".join(out), places


_LEAD = re.compile(r"[A-Z]{2}(?=[0-9OolISBZ|]{6}$)")
_SHAPE = {c: "0" for c in "0123456789OolISBZ|"}


def shape(s: str) -> str:
    lead = 2 * (_LEAD.match(s) is not None)
    return "A" * lead + "".join(_SHAPE.get(c) or (" " if c.isspace() else c if not c.isalpha() or c == "x" else "A") for c in s.strip()[lead:])


@lru_cache(maxsize=10_000)
def form(shape_: str) -> str:
    """What a shape begins with and the lengths of its groups: (00) 00000-0000 and (00)00000 0000 are one form."""
    return (shape_[:1] if shape_[:1] in "+(A" else "") + "-".join(str(len(g)) for g in re.findall(r"0+", shape_)) + ("A" if shape_[-1:] == "A" else "")


@lru_cache(maxsize=100_000)
def label(word: str) -> str:
    """One form for a word before a number: "C.P.F.", "cpf/mf" and a misread "CPf" are one label."""
    return fold(re.sub(r"[^\w@|!†$]", "", word.split("/")[0])) or word


#: Characters around a candidate in which the words of its context are looked for.
_CONTEXT = 96


def before(t: str, a: int) -> list[str]:
    """Labels of the up to three words before a candidate; "#" for what holds a digit or is an address."""
    words = [w.strip(".:,;()[]-–\"'“”º°") or w for w in t[max(0, a - _CONTEXT) : a].lower().split()[-6:]]
    words = [_unread(w) for w in words if w.strip(_DOTS)]
    words = [w for w in words if w not in _NO_LABELS] or words
    return [label(w) for w in words[-3:]]


def label_before(t: str, a: int) -> str:
    """The last of before(t, a), without the others; "^" if there is none."""
    last = None
    for w in reversed(t[max(0, a - _CONTEXT) : a].lower().split()[-6:]):
        w = w.strip(".:,;()[]-–\"'“”º°") or w
        if not w.strip(_DOTS):
            continue
        w = _unread(w)
        if w not in _NO_LABELS:
            return label(w)
        last = last or w
    return label(last) if last else "^"


_DOTS = ".:-(º°"
_NO_LABELS = frozenset(["nº", "n", "no", "núm", "número", "number", "sob"])
_DIGIT_OR_AT = re.compile(r"[\d@]")


def _masked(word: str) -> str:
    return "#" if _DIGIT_OR_AT.search(word) else word


def _unread(word: str) -> str:
    """As _masked, but a word in which a scanner took some letters for digits or signs stays: "te1efone", "protoc@lo"."""
    if not _DIGIT_OR_AT.search(word):
        return word
    letters = sum(map(str.isalpha, word))
    return word if letters > 3 and letters >= 2 * (len(word) - letters) and "." not in word else "#"


def behind(t: str, e: int) -> str:
    """The words behind a number in its sentence."""
    if t[e : e + 1] == "." and t[e + 1 : e + 2].isspace():
        return ""
    return " ".join(_masked(w) for w in t[e : e + 32].lower().split()[:3] if w not in (",", ".", ";"))


_STOPS_OF_NUMBERS = " .-(\n"
#: Runs of all signs that _NUM can match: a match lies within one, and one of a number has six signs and four digits.
_RUN = re.compile(rf"[{_D}A-Zx+() .\n/-]{{6,}}")
_DIGIT = re.compile(r"\d")


def _numbers_in(t: str):
    """The matches of _NUM that can be of numbers; what stands behind a run is seen by the pattern, so it ends as in the whole text."""
    for r in _RUN.finditer(t):
        if len(_DIGIT.findall(r[0])) >= 4:
            yield from _NUM.finditer(t, r.start(), r.end() + 4)


def numbers(t: str):
    """Candidate numbers: (start, end, shape)."""
    for m in _numbers_in(t):
        a, b = m.span()
        if b - a < 6:
            continue
        s = t[a:b]
        while s and s[0] == "(" and s.count("(") > s.count(")"):
            a, s = a + 1, s[1:]
        while s and (s[-1] in _STOPS_OF_NUMBERS or (s[-1] == ")" and s.count(")") > s.count("("))):
            b, s = b - 1, s[:-1]
        if sum(c in _SHAPE for c in s) < 6 or sum(map(str.isdigit, s)) < 4:
            continue
        yield a, b, shape(s)


def name_contexts(t: str):
    """Title-case sequences: (first word, last word, words to the left, words to the right, start, end)."""
    for m in _NAME.finditer(t):
        whole = m[0]
        words = [w for w in whole.replace(",", " ").split() if w not in PARTICLES]
        if len(words) < 2 or "\n" in whole:  # a line's end may part two fields
            continue
        start = m.start()
        if "," in whole:
            words = words[1:] + words[:1]
        elif len(words) == 3 and t[max(0, start - 8) : start].rstrip()[-1:] in _STOPS:
            start += len(words[0]) + 1  # the first word of a sentence is taken as context
            words = words[1:]
            if not t.startswith(words[0], start):
                continue
        left = [w.strip(".:,;()") for w in t[max(0, m.start() - 30) : start].lower().split()[-2:]]
        yield words[0], words[-1], left, t[m.end() : m.end() + 24].lower().split()[:2], start, m.end()


def _left(words: list[str]) -> str:
    return " ".join([fold(_masked(w)) for w in words]) or "^"


def _right(words: list[str]) -> str:
    return " ".join([_masked(w) for w in words]) or "$"


def _no_person(word: str, left: list[str], right: list[str]) -> bool:
    """A word of a firm, school or street stands before, behind or in front."""
    if left and (left[-1] in NOT_PERSONS or (len(left) > 1 and left[-2] in NOT_PERSONS and left[-1] in PARTICLES)) or word.lower() in NOT_PERSONS:
        return True
    return bool(right) and right[0].strip(".,;:") in NOT_PERSONS


def name_candidates(t: str, locals_: list[str]):
    """(instance, left pattern, right pattern, seed): seed 1 where a mail address repeats the name, 0 where it is none, -1 else."""
    for first, last, left, right, _a, _e in name_contexts(t):
        one, two = fold(first), fold(last)
        seed = -1
        if _no_person(first, left, right):
            seed = 0
        elif len(one) > 2 and any(x.startswith(one) or (one in x and two[:3] in x) or (x[:1] == one[:1] and x[1:] == two) for x in locals_):
            seed = 1
        yield f"{one} {two}", _left(left), _right(right), seed


_STOPS = frozenset(["", ".", "!", "?", "\n"])


@lru_cache(maxsize=100_000)
def street_key(word: str) -> str:
    """A street word as it is learned; an abbreviation keeps its full stop or slash."""
    core = word.rstrip(".")
    return fold(core) + ("." if core != word else "")


def houses(t: str):
    """(words before, their starts, start and end of the number) of house numbers behind a comma, words from near to far."""
    for m in _HOUSE.finditer(t):
        p = e = m.start()
        lo = max(0, p - 400)
        words, starts = [], []
        for w in reversed(t[lo:p].rsplit(None, _STREET_WORDS)[-_STREET_WORDS:]):
            s = t.rfind(w, lo, e)
            if words and "\t" in t[s + len(w) : e]:
                break  # another field
            if not _STREET_WORD.fullmatch(w) or (w[-1] == "." and not words):
                # the street word may hang on a label or bracket, all else is a word of its own
                if words and (hung := _HUNG_WORD.search(w)):
                    words.append(hung[0])
                    starts.append(s + hung.start())
                break
            words.append(w)
            starts.append(s)
            e = s
        if len(words) > 1:
            yield words, starts, p, m.end()


_HUNG_WORD = re.compile(r"(?<![\w.])[^\W\d_][\w'’|@†]*[./]?$")


def _run(words: list[str]) -> tuple[int, int]:
    """How many words before a number belong to a name, capitalised ones and particles between them; and with the particles before."""
    n = 0
    for k, w in enumerate(words):
        if w[0].isupper() or w[0].isdigit() or w[0] in "|@":
            n = k + 1
        elif w.lower() not in _IN_STREETS:
            return n, k
    return n, len(words)


_IN_STREETS = PARTICLES | {"la", "las", "los", "du", "des"}


def heads(words: list[str]) -> tuple[int | None, int | None]:
    """Where the street word of a house number can be: the first of the capitalised words, and the small word before them."""
    n, m = _run(words)
    if not n:
        return None, None
    return n - 1 if n > 1 else None, m if m < len(words) and words[m].lower() not in BEFORE_STREETS else None


_SEED_STREETS = frozenset(f"h {street_key(w)}" for w in STREETS[0].split())


def firsts(t: str):
    """(start, words, ends) of house numbers, of one to five signs, before capitalised words."""
    for m in _FIRST.finditer(t):
        a = m.start()
        while a and t[a - 1] in _HOUSE_SIGNS:
            a -= 1
        if m.start(1) - a > 5 or (a and (t[a - 1].isalnum() or t[a - 1] in "_./-")):
            continue
        ws = list(_PIECE.finditer(m[1]))
        yield a, [w[0] for w in ws], [m.start(1) + w.end() for w in ws]


_PIECE = re.compile(r"\S+")


def around(t: str, a: int, e: int) -> list[str]:
    """Patterns around an address whose street word begins at a and whose number or street ends at e."""
    left = [_masked(w.strip(".:,;()")) for w in t[max(0, a - 40) : a].lower().split()][-2:]
    out = [f"< {' '.join(left)}"] if left else []
    if _CEP_AT.match(t, e):
        out.append("z")
    elif c := _PARTS.match(t, e):
        out.append(f"c {''.join(x for x in c[0].split()[1][:4] if x.isalpha()).lower() if len(c[0].split()) > 1 else 'º'}")
    elif c := _PLACE_AT.match(t, e):
        out.append(f"p {place_key(_place_text(c[0]))}")
    else:
        out.append(f"> {' '.join(t[e : e + 16].lower().split()[:1])}")
    return out


def _place_text(s: str) -> str:
    return re.sub(r"^(?:,|\s[-–])\s+", "", s)


@dataclass
class Learned:
    """What the graphs say, by key: the most frequent rows in held, and any number of others in rest.

    Keys: "w" words of names (F first, L last), "l" and "r" patterns around names, "n" labels with shapes, "b" labels and
    "f" forms of numbers, "s" signs and "d" domains of mail addresses, "h" and "t" street words, "p" places, "q" their first words.
    """

    held: dict[str, str] = field(default_factory=dict)
    #: (key, value), and the hashes of its keys; None if everything is held.
    rest: DataFrame | None = None
    hashes: bytes = b""
    places: bool = False


def tail(t: str, e: int, place) -> int:
    """The end of an address whose number or street ends at e; place(start, end) gives the end of a place that may be there."""
    while True:
        if c := _CEP_AT.match(t, e):
            e = c.end()
        elif c := _PARTS.match(t, e):
            e = c.end()
        elif c := _PLACE_AT.match(t, e):
            stop = place(c.start(), c.end())
            if stop <= e:
                return e
            e = stop
            if stop < c.end():
                if x := _CEP_AT.match(t, e):
                    e = x.end()
                elif not _PLACE_AT.match(t, e):
                    return e
        else:
            return e


def _at_line(t: str, a: int, e: int) -> int:
    """Without known places, a place ends with its line."""
    nl = t.find("\n", a + 2, e)
    return e if nl < 0 else nl


def place_key(s: str) -> str:
    return " ".join(fold(w) for w in s.split())


def places_in(t: str, a: int, e: int):
    """(key, end) of what may be a place in t[a:e], the longest first."""
    s = a + re.match(r"(?:,|\s[-–])\s+", t[a:e]).end()
    words = list(re.finditer(r"\S+", t[s:e]))
    for k in range(len(words), 0, -1):
        end = s + words[k - 1].end()
        yield place_key(t[s:end]), end


def observe(text: str, counts: Counter) -> None:
    """Add a layer's candidates to the counts of graph edges (kind, pattern, instance, seed)."""
    t = flat(text)
    for a, e, sh in numbers(t):
        *others, one = before(t, a) or ["^"]
        after = behind(t, e)
        for p in (f"1 {one}", *(f"< {w}" for w in others if len(w) > 2), *([f"> {after}"] if after else [])):
            counts[("n", p, f"{one}\t{sh}\t{form(sh)}", -1)] += 1
        counts[("n", f"1 {one}", f"\t\t{form(sh)}", -1)] += 1  # labels of one form are near each other
    locals_ = []
    for _a, _b, local, domain, sign in mails(t):
        counts[("@", sign, f"a {local.lower()}@{domain}", -1)] += 1
        counts[("@", sign, f"d {domain}", -1)] += 1
        if sign in SIGNS:
            locals_.append(fold(re.sub(r"[\W\d_]", "", local)))
    for inst, left, right, seed in name_candidates(t, locals_):
        counts[("l", left, inst, seed)] += 1
        counts[("r", right, inst, seed)] += 1
    for words, starts, _p, e in houses(t):
        keys = {f"h {street_key(words[k])}": k for k in heads(words) if k is not None}
        if len(keys) > 1 and not _SEED_STREETS.intersection(keys):
            counts[("b", *keys, -1)] += 1
        if seeds := [k for k in keys if k in _SEED_STREETS]:
            inner = {f"h {street_key(w)}" for w in words[: keys[seeds[0]]]}
            keys = {k: keys[k] for k in seeds}
            for x in inner:  # what stands in a street's name
                counts[("a", "inner", x, -1)] += 4
        for key, k in keys.items():
            for x in around(t, starts[k], e):
                counts[("a", x, key, -1)] += 1
        _observe_places(t, e, tail(t, e, lambda a, b: _at_line(t, a, b)), keys, counts)
    for a, words, ends in firsts(t):
        for x in around(t, a, ends[-1]):
            counts[("a", x, f"t {street_key(words[-1])}", -1)] += 1
        _observe_places(t, ends[-1], tail(t, ends[-1], lambda a, b: _at_line(t, a, b)), [f"t {street_key(words[-1])}"], counts)


def _observe_places(t: str, a: int, e: int, streets, counts: Counter) -> None:
    for m in _PLACE_AT.finditer(t, a, e):
        for s in streets:
            counts[("p", s, place_key(_place_text(m[0])), -1)] += 1


def edges(pages: DataFrame) -> DataFrame:
    """The graphs over all layers of all rows: kind, pattern, instance, seed, n; counted within tasks first."""
    import pyarrow as pa

    kinds = pa.schema([("kind", pa.string()), ("pattern", pa.string()), ("instance", pa.string()), ("seed", pa.int32()), ("n", pa.int64())])

    def flush(c: Counter) -> pa.RecordBatch:
        cols = list(zip(*c)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in cols[:3]), pa.array(cols[3], pa.int32()), pa.array(list(c.values()), pa.int64())], schema=kinds)

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                observe(t, counts)
                if len(counts) > 200_000:
                    yield flush(counts)
                    counts = Counter()
        if counts:
            yield flush(counts)

    rows = layer_rows(pages).select("text").mapInArrow(run, "kind string, pattern string, instance string, seed int, n bigint")
    return rows.groupBy("kind", "pattern", "instance", "seed").agg(F.sum("n").alias("n"))


def spread(graph: DataFrame, seeds: DataFrame, types: list[str], rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns and of instances, a column s0, s1, ... for each type.

    graph: pattern, instance, n, doubt.  seeds: pattern and the score columns; they hold in every round.
    An instance's score is the mean of its patterns', weighted by n, and the other way round; what has no score yet has
    no weight, or counts as 0 on edges with doubt.  A round is two joins and two aggregations of one chain, which is cut
    at its end.
    """
    cols = [f"s{k}" for k in range(len(types))]
    edges_ = cut(graph.join(seeds.select("pattern", *[F.col(c).alias(f"_{c}") for c in cols]), "pattern", "left"))

    def mean(c: str):
        score = F.coalesce(F.col(c), F.when(F.col("doubt"), 0.0))
        return F.sum(F.col("n") * score) / F.sum(F.when(score.isNotNull(), F.col("n")))

    patterns = seeds.select("pattern", *cols)
    for _ in range(rounds):
        instances = edges_.join(patterns, "pattern", "left").groupBy("instance").agg(*[mean(c).alias(c) for c in cols])
        patterns = edges_.join(instances, "instance", "left").groupBy("pattern").agg(*[F.coalesce(F.max(f"_{c}"), mean(c)).alias(c) for c in cols])
    patterns = cut(patterns)
    instances = cut(edges_.join(patterns, "pattern", "left").groupBy("instance").agg(*[mean(c).alias(c) for c in cols]))
    return patterns, instances


def _best(types: list[str], least: float = CONFIDENT):
    """The type of the best score, null where it is not confident."""
    cols = [F.col(f"s{k}") for k in range(len(types))]
    top = F.greatest(*cols) if len(cols) > 1 else cols[0]
    out = F.lit(None).cast("string")
    for c, t in reversed(list(zip(cols, types))):
        out = F.when((top >= least) & (c == top), t).otherwise(out)
    return out


def _edges_of(graph: DataFrame) -> DataFrame:
    """All graphs as one of pattern, instance, n, doubt and seed, told apart by how patterns and instances begin.

    Mail addresses and streets have no seeds against them, so their edges are doubted.
    """
    kind, c = F.col("kind"), F.col
    near = (kind == "n") & F.startswith("pattern", F.lit("1 "))
    g = graph.where("kind in ('n', '@', 'a', 'l', 'r')").select(
        F.when(kind == "a", c("instance")).when(kind == "@", F.concat(F.lit("s "), "pattern")).when(kind == "n", c("pattern")).otherwise(F.concat(kind, F.lit(" "), "pattern")).alias("pattern"),
        F.when(kind == "a", F.concat(F.lit("a "), "pattern")).when(kind.isin("l", "r"), F.concat(F.lit("w "), "instance")).otherwise(F.concat(kind, F.lit(" "), "instance")).alias("instance"),
        (c("n") * F.when(near, LABEL_WEIGHT).otherwise(1)).alias("n"), kind.isin("@", "a").alias("doubt"), F.when(kind.isin("l", "r"), c("seed")).otherwise(-1).alias("seed"),
    )
    often = g.groupBy("pattern").agg(F.sum("n").alias("all")).where(F.col("all") >= LEAST).select("pattern")
    return cut(g.join(often, "pattern", "left_semi"))


def _seeds(edges_: DataFrame) -> DataFrame:
    """Patterns that have a score from the start: seed words, signs and streets, and what stands around names that a mail address
    repeats, against firms and streets."""
    rows = [(f"1 {one}", kind) for one, kind in _SEED_LABELS.items()] + [(f"s {x}", "EMAIL") for x in SIGNS] + [(f"{k} {street_key(w)}", "ADDRESS") for k, ws in zip("ht", STREETS) for w in ws.split()]
    schema = "pattern string, " + ", ".join(f"s{k} double" for k in range(len(TYPES)))
    fixed = edges_.sparkSession.createDataFrame([(p, *(float(t == kind) if (t in SEEDS) == (kind in SEEDS) and t != "NAME" else None for t in TYPES)) for p, kind in rows], schema)
    names = edges_.where("seed >= 0").groupBy("pattern").agg((F.sum(F.col("n") * F.col("seed")) / F.sum("n")).alias(f"s{len(TYPES) - 1}"), F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    return fixed.unionByName(names.drop("n"), allowMissingColumns=True)


def _numbers_learned(graph: DataFrame, instances: DataFrame) -> DataFrame:
    """key, value, n of labels with shapes, labels, and forms.

    Labels and forms are judged over all their numbers: one that no pattern scores counts against every type.
    """
    kinds = list(SEEDS)
    cols = [f"s{k}" for k in range(len(kinds))]
    seen = graph.where("kind = 'n'").where(F.startswith("pattern", F.lit("1 ")) & ~F.startswith("instance", F.lit("\t"))).groupBy("instance").agg(F.sum("n").alias("n"))
    part = F.split("instance", "\t")
    scores = instances.where(F.startswith("instance", F.lit("n "))).select(F.substr("instance", F.lit(3)).alias("instance"), *cols)
    fine = cut(seen.join(scores, "instance", "left").select(part[0].alias("label"), part[1].alias("shape"), part[2].alias("form"), "n", *cols))

    def shares(key: str) -> DataFrame:
        return fine.groupBy(key).agg(F.sum("n").alias("n"), *[(F.sum(F.col("n") * F.coalesce(c, F.lit(0.0))) / F.sum("n")).alias(c) for c in cols]).where(F.col("n") >= LEAST)

    possible = [F.when(F.col(c) >= POSSIBLE, F.concat(F.lit(f"{t}="), F.round(c, 3).cast("string"))) for c, t in zip(cols, kinds)]
    return (
        fine.where(F.col("n") >= LEAST).select(F.concat(F.lit("n "), "label", F.lit("\t"), "shape").alias("key"), _best(kinds).alias("value"), "n")
        .unionByName(shares("label").select(F.concat(F.lit("b "), "label").alias("key"), _best(kinds).alias("value"), "n"))
        .unionByName(shares("form").select(F.concat(F.lit("f "), "form").alias("key"), F.nullif(F.concat_ws(" ", *possible), F.lit("")).alias("value"), "n"))
        .where("value is not null")
    )


_SEED_LABELS = {label(w): kind for kind, ws in SEEDS.items() for w in ws.split()}


_NAME_SCORE = f"s{len(TYPES) - 1}"


def _places_learned(graph: DataFrame, patterns: DataFrame, instances: DataFrame) -> DataFrame:
    """key, value, n of signs and domains of mail addresses, street words, places and their first words."""
    n = graph.where("kind in ('@', 'a')").groupBy(F.when(F.col("kind") == "a", F.col("instance")).otherwise(F.concat(F.lit("s "), "pattern")).alias("pattern")).agg(F.sum("n").alias("n"))
    score = F.greatest("s3", "s4")
    # a bare word for the sign takes more than a bracketed one: it also stands before domains in sentences
    bare = F.col("pattern").rlike("^s [^(@]")
    sure = patterns.where(F.col("pattern").rlike("^[sht] ") & (score >= F.when(bare, 0.75).otherwise(CONFIDENT))).join(n, "pattern").where(F.col("n") >= LEAST_PLACES).select("pattern", "n")
    fixed = [f"s {x}" for x in SIGNS] + [f"{k} {street_key(w)}" for k, ws in zip("ht", STREETS) for w in ws.split()]
    known = cut(sure.unionByName(graph.sparkSession.createDataFrame([(x, LEAST_PLACES) for x in fixed], "pattern string, n bigint")).groupBy("pattern").agg(F.max("n").alias("n")))
    # a small word before capitalised ones is no street word where these mostly begin with one
    other = graph.where("kind = 'b'").join(known.select("pattern", F.lit(1).alias("own")), "pattern", "left")
    other = other.groupBy(F.col("instance").alias("pattern")).agg((F.sum(F.coalesce("own", F.lit(0)) * F.col("n")) / F.sum("n")).alias("own")).where(F.col("own") >= CONFIDENT).select("pattern")
    known = cut(known.join(other, "pattern", "left_anti"))
    places = graph.where("kind = 'p'").join(known.select("pattern"), "pattern", "left_semi").groupBy(F.col("instance").alias("place")).agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_PLACES)
    places = cut(places)
    # what follows a place without a mark is no part of it: its shorter form is much more frequent
    words = F.split("place", " ")
    longer = places.where(F.size(words) > 1).select("place", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.array_join(F.slice(words, 1, k), " "))).alias("short"))
    junk = longer.join(places.select(F.col("place").alias("short"), F.col("n").alias("often")), "short").where("often >= 20 * n").select("place").distinct()
    places = cut(places.join(junk, "place", "left_anti"))
    openings = places.where(F.instr("place", " ") > 0).groupBy(F.split("place", " ")[0].alias("w")).agg(F.sum("n").alias("n"))
    mail = graph.where("kind = '@'").groupBy(F.concat(F.lit("@ "), "instance").alias("instance")).agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_PLACES)
    domains = instances.where(F.startswith("instance", F.lit("@ d ")) & (F.col("s3") >= CONFIDENT)).join(mail, "instance").select(F.substr("instance", F.lit(3)).alias("instance"), "n")
    row = lambda df, key, value: df.select(key.alias("key"), F.lit(value).alias("value"), "n")
    return (
        row(known, F.col("pattern"), "+")
        .unionByName(row(domains, F.col("instance"), "+"))
        .unionByName(row(places, F.concat(F.lit("p "), "place"), "+"))
        .unionByName(row(openings, F.concat(F.lit("q "), "w"), "+"))
    )


def _names_learned(people: DataFrame, patterns: DataFrame, instances: DataFrame, places: DataFrame) -> DataFrame:
    """key, value, n of words of names and of sure patterns around them; what is a place, or stands behind the first word of one, is no person."""
    words = F.filter(F.split(F.substr("key", F.lit(3)), " "), lambda w: ~w.isin(sorted(PARTICLES)))
    place = places.where(F.startswith("key", F.lit("p "))).select(F.concat_ws(" ", F.lit("w"), F.element_at(words, 1), F.element_at(words, -1)).alias("instance")).distinct()
    opening = places.where(F.startswith("key", F.lit("q "))).select(F.substr("key", F.lit(3)).alias("_w"))
    lefts = people.where(F.startswith("pattern", F.lit("l ")) & (F.col("seed") != 0)).withColumn("_w", F.element_at(F.split("pattern", " "), -1))
    lefts = lefts.join(place, "instance", "left_anti").join(opening, "_w", "left_anti")
    # words: first names by their instances' scores, last names by the first names they follow
    weight = lefts.groupBy("instance").agg(F.sum("n").alias("n"))
    scored = weight.join(instances.select("instance", _NAME_SCORE), "instance", "left").select(F.element_at(F.split("instance", " "), 2).alias("first"), F.element_at(F.split("instance", " "), 3).alias("last"), F.coalesce(_NAME_SCORE, F.lit(0.0)).alias("score"), "n", "instance")
    scored = cut(scored)
    firsts_ = scored.where(F.length("first") >= 3).groupBy("first").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("s"), F.sum("n").alias("n"))
    firsts_ = cut(firsts_.where((F.col("s") >= CONFIDENT) & (F.col("n") >= LEAST)).select("first", "n"))
    follow = scored.where(F.length("last") >= 3).join(firsts_.select("first", F.lit(1).alias("known")), "first", "left").groupBy("last").agg(F.sum(F.coalesce("known", F.lit(0)) * F.col("n")).alias("behind"), F.sum("n").alias("n"))
    follow = cut(follow.select("last", "n", "behind", (F.col("behind") / F.col("n")).alias("s")))
    # a last name stands first now and then, in a large table more than LEAST times: a word is what it is more often
    firsts_ = cut(firsts_.join(follow.select(F.col("last").alias("first"), "behind"), "first", "left").where(F.col("n") >= F.coalesce("behind", F.lit(0))).select("first", "n"))
    lasts = follow.join(firsts_.select(F.col("first").alias("last")), "last", "left_anti").where((F.col("s") >= CONFIDENT) & (F.col("n") >= LEAST))
    # a sure pattern stands around known names for the most part, and has a word of its own
    lasts = cut(lasts.select("last", "n"))
    named = scored.join(firsts_.select("first"), "first", "left_semi").join(lasts.select("last"), "last", "left_semi").select("instance", F.lit(1).alias("known"))
    seen = people.join(named, "instance", "left").groupBy("pattern").agg(F.sum("n").alias("n"), F.countDistinct("instance").alias("names"), (F.sum(F.col("n") * F.coalesce("known", F.lit(0))) / F.sum("n")).alias("share"))
    seen = seen.where((F.col("names") >= SURE_NAMES) & (F.col("share") >= CONFIDENT))
    sure = patterns.where((F.col(_NAME_SCORE) >= SURE) & F.col("pattern").rlike(r"^. .*\p{L}\p{L}")).join(seen, "pattern")
    word = lambda df, c, value: df.select(F.concat(F.lit("w "), c).alias("key"), F.lit(value).alias("value"), "n")
    return word(firsts_, "first", "F").unionByName(word(lasts, "last", "L")).unionByName(sure.select(F.col("pattern").alias("key"), F.lit("P").alias("value"), "n"))


def learn(pages: DataFrame, held: int | None = None) -> Learned:
    """Run the bootstrap over all layers; at most held rows and the hashes of the others reach the driver."""
    held = held or HELD
    graph = cut(edges(pages))
    all_edges = _edges_of(graph)
    patterns, instances = spread(all_edges.drop("seed"), _seeds(all_edges), list(TYPES))
    people = all_edges.where(F.col("pattern").rlike("^[lr] "))
    places = cut(_places_learned(graph, patterns, instances))
    table = cut(_numbers_learned(graph, instances).unionByName(places).unionByName(_names_learned(people, patterns, instances, places)))
    first = table.orderBy(F.desc("n"), "key").limit(held).select("key", "value", "n").collect()
    out = Learned(places=any(r["key"].startswith("p ") for r in first))
    for r in first:
        out.held[r["key"]] = out.held.get(r["key"], "") + r["value"]
    if len(first) == held and table.count() > held:
        last = first[-1]
        rest = table.where((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("key") >= last["key"]))).select("key", "value")
        bits = bytearray(HASHES // 8)
        for h in rest.select((F.crc32("key") % HASHES).alias("h")).distinct().toPandas()["h"]:
            bits[h >> 3] |= 1 << (h & 7)
        out.rest, out.hashes = rest, bytes(bits)
        out.places = out.places or not rest.where(F.startswith("key", F.lit("p "))).isEmpty()
    return out


@lru_cache(maxsize=10_000)
def _shares(value: str) -> dict[str, float]:
    return {k: float(v) for k, v in (x.split("=") for x in value.split())}


class Finder:
    """Stretches of one layer, by what was learned."""

    def __init__(self, known: Learned):
        self.known = known
        self.kinds: dict[str, str] = {}
        self.nothing: set[str] = set()
        self.extra: dict[str, str] = {}

    def look(self, key: str) -> str | None:
        return self.known.held.get(key) or (self.extra.get(key) if self.extra else None)

    def open_keys(self, text: str | None) -> list[str]:
        """Keys that the text may be asked for and that may be in the table of the rest."""
        if not text:
            return []
        t, _ = plain(text)
        keys = {f"w {fold(w)}" for w in set(_TOKEN.findall(t))}
        for _first, _last, left, right, _a, _e in name_contexts(t):
            keys.update((f"l {_left(left)}", f"r {_right(right)}"))
        for a, _e, sh in numbers(t):
            one = label_before(t, a)
            keys.update((f"n {one}\t{sh}", f"b {one}", f"f {form(sh)}"))
        for _a, e, _local_, domain, sign in mails(t):
            keys.update((f"s {sign}", f"d {domain}", *(f"d {d}" for d, _ in self._longer(t, e, domain))))
        ends = []
        for words, _starts, _p, e in houses(t):
            keys.update(f"h {street_key(w)}" for w in words)
            ends.append(e)
        for _a, words, stops in firsts(t):
            keys.update(f"t {street_key(w)}" for w in words[1:])
            ends += stops[1:]
        done: set[int] = set()

        def place(a: int, b: int) -> int:
            for key, end in places_in(t, a, b):
                keys.add(f"p {key}")
                ends.append(end)  # the address may go on behind each of them
            return _at_line(t, a, b)

        while ends:
            if (e := ends.pop()) not in done:
                done.add(e)
                tail(t, e, place)
        for w in {k[2:] for k in keys if k[0] == "w"}:
            keys.update((f"q {w}", f"h {w}", f"h {w}."))
        return sorted(k for k in keys if self._hashed(k))

    def _hashed(self, key: str) -> bool:
        h = zlib.crc32(key.encode()) % HASHES
        return self.known.hashes[h >> 3] >> (h & 7) & 1 == 1

    def kind(self, word: str) -> str:
        """Whether a word is a first or a last name, or both."""
        got = self.kinds.get(word)
        if got is None:
            if len(self.kinds) > 200_000:
                self.kinds.clear()
            got = self.kinds[word] = self.known.held.get(f"w {fold(word)}") or ""
        if self.extra:
            return got or self.extra.get(f"w {fold(word)}") or ""
        return got

    def has_names(self, t: str) -> bool:
        """Whether names can find any: there is a first name, or a last name and an initial.

        Words lie between blanks; a piece between blanks in which no word is known is taken away at once the next time.
        """
        last = False
        for piece in set(t.split()) - (_NOTHING if self.extra else self.nothing):
            kinds = "".join(self.kind(w) for w in _TOKEN.findall(piece))
            if "F" in kinds:
                return True
            last = last or bool(kinds)
            if not kinds and not self.extra:
                if len(self.nothing) > 500_000:
                    self.nothing.clear()
                self.nothing.add(piece)
        return last and any("L" in self.kind(w[0]) for m in _INITIAL.finditer(t) if (w := _TOKEN.match(t, m.end())))

    @staticmethod
    def _longer(t: str, e: int, domain: str):
        if x := re.compile(r"\.?\s?[\w-]+(?:\.[\w-]+)*").match(t, e):
            yield domain + re.sub(r"\s", "", x[0]).lower(), x.end()

    def mails(self, t: str):
        for a, e, _l, domain, sign in mails(t):
            if not self.look(f"s {sign}"):
                continue
            if not self.look(f"d {domain}"):
                for longer, end in self._longer(t, e, domain):
                    if self.look(f"d {longer}"):
                        e = end
            yield a, e

    def place(self, t: str, a: int, e: int) -> int:
        """The end of the longest known place that begins in t[a:e]; else that of the line, if it goes on; a if there is none."""
        if self.known.places:
            for key, end in places_in(t, a, e):
                if self.look(f"p {key}"):
                    return end
        s = a + re.match(r"(?:,|\s[-–])\s+", t[a:e]).end()
        nl = t.find("\n", s, e)
        return e if nl < 0 else nl if nl > s else a

    def addresses(self, t: str):
        for words, starts, _p, e in houses(t):
            # the street word: the first of the capitalised words if it is known, else the small word before, else the nearest
            known = [k for k in range(1, len(words)) if self.look(f"h {street_key(words[k])}")]
            if not known:
                continue
            k = next((x for x in heads(words) if x in known), known[0])
            body = words[:k]
            if any(w.rstrip(".").count(".") for w in body) or not any(c.isupper() for w in body for c in w):
                continue
            yield starts[k], tail(t, e, lambda a, b: self.place(t, a, b))
        for a, words, stops in firsts(t):
            for k in range(len(words) - 1, 0, -1):
                if self.look(f"t {street_key(words[k])}"):
                    yield a, tail(t, stops[k], lambda x, y: self.place(t, x, y))
                    break

    def number_type(self, sh: str, one: str) -> str | None:
        """By label and shape where they were seen together, else by both apart; a label alone does not suffice, unless it is a seed."""
        shares = _shares(self.look(f"f {form(sh)}") or "")
        best = max(shares, key=shares.__getitem__, default=None)
        seed = _SEED_LABELS.get(one)
        kind = self.look(f"n {one}\t{sh}")
        if kind is not None:
            kind = kind if kind in shares or kind == seed else None
        elif seed is not None:
            kind = seed
        elif (kind := self.look(f"b {one}")) is not None:
            kind = kind if kind == best else None
        elif best is not None and shares[best] >= CONFIDENT and all(3 * v <= shares[best] for k, v in shares.items() if k != best):
            kind = best
        return None if kind == "-" else kind

    def farther_type(self, sh: str, words: list[str]) -> str | None:
        """The type of a form whose label is against it, where a seed farther off is for it: "phone on file:"."""
        shares = _shares(self.look(f"f {form(sh)}") or "")
        best = max(shares, key=shares.__getitem__, default="-")
        return best if best != "-" and shares[best] >= CONFIDENT and best in map(_SEED_LABELS.get, words) else None

    def named_by_pattern(self, t: str):
        """(start, end) of capitalised words that a pattern of high confidence makes a name."""
        for first, _last, left, right, a, e in name_contexts(t):
            if (self.look(f"l {_left(left)}") or self.look(f"r {_right(right)}")) and not _no_person(first, left, right) and not (left and self.look(f"q {fold(left[-1])}")):
                yield a, e

    def names(self, t: str):
        words = list(_TOKEN.finditer(t))
        kind = self.kind if self.extra else lambda w, get=self.kinds.get: k if (k := get(w)) is not None else self.kind(w)
        kinds = [kind(m[0]) for m in words]
        n, i = len(words), 0
        hits = [k for k, x in enumerate(kinds) if x]
        gap = lambda x, y: t[words[x].end() : words[y].start()]
        while i < n:
            k = kinds[i]
            if not k:
                # an initial before a last name
                if i + 1 < n and "L" in kinds[i + 1] and len(words[i][0]) == 1 and words[i][0].isupper() and gap(i, i + 1).strip() == "." and len(gap(i, i + 1)) <= 2 and not self._firm(words, i):
                    yield words[i].start(), words[i + 1].end()
                    i += 2
                    continue
                near = bisect_left(hits, i)  # to the word before the next known one
                i = max(i + 1, hits[near] - 1) if near < len(hits) else n
                continue
            if "L" in k and i + 1 < n and "F" in kinds[i + 1] and re.fullmatch(r",\s", gap(i, i + 1)) and not self._firm(words, i):
                j = i + 1
                while j + 1 < n and "F" in kinds[j + 1] and gap(j, j + 1).isspace():
                    j += 1
                yield words[i].start(), words[j].end()
                i = j + 1
                continue
            if "F" in k and not self._firm(words, i):
                j, end = i, None
                while j + 1 < n and len(gap(j, j + 1)) <= 2 and gap(j, j + 1).isspace():
                    if "L" in kinds[j + 1]:
                        end = j + 1
                    elif end is not None and ("F" in kinds[j + 1] or words[j + 1][0].lower() == "e" and j + 2 < n and "F" in kinds[j + 2]):
                        break  # another person
                    elif not ("F" in kinds[j + 1] or words[j + 1][0].lower() in PARTICLES):
                        break
                    j += 1
                if end is not None:
                    yield words[i].start(), words[end].end()
                    i = end + 1
                    continue
            i += 1

    def _firm(self, words: list, i: int) -> bool:
        """A word of a firm, school, street or place stands before."""
        for back in (1, 2):
            if i < back:
                return False
            w = words[i - back][0].lower()
            if w in NOT_PERSONS:
                return True
            if w not in PARTICLES:
                f = fold(w)
                return words[i - back][0][0].isupper() and bool(self.look(f"h {f}") or self.look(f"h {f}.") or self.look(f"q {f}"))
        return False

    def spans(self, text: str | None, extra: dict[str, str] | None = None) -> list[tuple[str, int, int]]:
        """(type, start, end) in the stored text, in order and without overlap; extra is what the text has of the rest."""
        self.extra = extra or {}
        if not text:
            return []
        t, places = plain(text)
        starts: list[int] = []
        out: list[tuple[int, int, str]] = []

        def take(kind: str, a: int, e: int) -> None:
            k = bisect_right(starts, a)
            if a < e and (not k or out[k - 1][1] <= a) and (k == len(out) or e <= out[k][0]):
                starts.insert(k, a)
                out.insert(k, (a, e, kind))

        for a, e in self.mails(t):
            take("EMAIL", a, e)
        for a, e in self.addresses(t):
            take("ADDRESS", a, e)
        for a, e, sh in numbers(t):
            one = label_before(t, a)
            kind = self.number_type(sh, one)
            if kind is None and _SEED_LABELS.get(one) == "-":
                kind = self.farther_type(sh, before(t, a)[:-1])
            if kind:
                take(kind, a, e)
        if self.has_names(t):
            for a, e in self.names(t):
                take("NAME", a, e)
        for a, e in self.named_by_pattern(t):
            take("NAME", a, e)
        if places is None:
            return [(k, a, e) for a, e, k in out]
        return [(k, places[a], places[e - 1] + 1) for a, e, k in out]


_TOKEN = re.compile(r"[^\W\d_](?:[\w|@†!$]*[^\W_|@†!$])?(?:['’][^\W\d_]+)?[@|†0-9]?(?!\w)|[^\W_]")
#: An initial before a word; more than names takes for one.
_INITIAL = re.compile(r"[A-ZÀ-ÖØ-ÞĀ-\U0010ffff]\s?\.\s?(?=[^\W_])")
_NOTHING: frozenset[str] = frozenset()


def _by_layer(pages: DataFrame, known: Learned, emit: Callable, schema: str) -> DataFrame:
    """emit(field_name, layer_id, text, stretches) over all layers.

    Layers with keys that may be among the rest wait until these are joined; the others are done in one pass.
    """
    rows = layer_rows(pages).select("field_name", "layer_id", "text")
    rare, lean, maker = known.rest, replace(known, rest=None), {}
    waiting = rare is not None
    width = schema.count(",") + 1

    def finder() -> Finder:
        if "f" not in maker:
            maker["f"] = Finder(lean)
        return maker["f"]

    def one(field_name, layer_id, text):
        f = finder()
        if not waiting:
            yield from emit(field_name, layer_id, text, f.spans(text))
        elif keys := f.open_keys(text):
            yield (*[None] * width, field_name, layer_id, text, keys)
        else:
            for row in emit(field_name, layer_id, text, f.spans(text)):
                yield (*row, None, None, None, None)

    def two(field_name, layer_id, text, held):
        extra: dict[str, str] = {}
        for x in held or ():
            extra[x["key"]] = extra.get(x["key"], "") + x["value"]
        yield from emit(field_name, layer_id, text, finder().spans(text, extra))

    if not waiting:
        return arrow_pass(rows, one, schema)
    done = cut(arrow_pass(rows, one, f"{schema}, _field string, _layer bigint, _text string, _keys array<string>"))
    left = done.where("_text is not null").select("_field", "_layer", "_text", "_keys", F.monotonically_increasing_id().alias("_row"))
    held = left.select("_row", F.explode("_keys").alias("key")).join(rare, "key").groupBy("_row").agg(F.collect_set(F.struct("key", "value")).alias("_held"))
    again = arrow_pass(left.join(held, "_row", "left").select("_field", "_layer", "_text", "_held"), two, schema)
    return done.where("_text is null").select(*again.columns).unionByName(again)


def find(pages: DataFrame, known: Learned | None = None) -> DataFrame:
    """field_name, layer_id, pii_type, char_start, char_end; one row per stretch."""
    known = learn(pages) if known is None else known

    def one(field_name, layer_id, text, found):
        return [(field_name, layer_id, k, a, e) for k, a, e in found]

    return _by_layer(pages, known, one, "field_name string, layer_id bigint, pii_type string, char_start int, char_end int")


def replaced(pages: DataFrame, known: Learned | None = None) -> DataFrame:
    """Every present layer with each stretch replaced by its type in brackets: field_name, layer_id, text, stretches."""
    known = learn(pages) if known is None else known

    def one(field_name, layer_id, text, found):
        out, at = [], 0
        for k, a, e in found:
            out += [text[at:a], f"[{k}]"]
            at = e
        yield field_name, layer_id, "".join(out) + text[at:], len(found)

    return _by_layer(pages, known, one, "field_name string, layer_id bigint, text string, stretches int")
