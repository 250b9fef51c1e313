"""Problem 4: texts that look the same and are stored with other characters.

Look-alike classes are the connected components, by union-find, of a graph
whose nodes are strings and code points and whose edges are pairs that read the
same.  The most frequent member of a class in the corpus represents it, and
every text is rewritten greedily, longest member first, by an Aho-Corasick
automaton over all members.

Defined results: a null text gives no row, a blank one is rewritten but never
paired; equal texts share one form; an empty table gives an empty result;
columns other than the named ones are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAYERS, arrow_pass, cut, layer_rows

#: Letters of other scripts and the Latin letters they look like, in the same order.
LOOK_ALIKE = {
    "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһӏԛԝвкмнтѵӒӓЁёЇїӦӧ": "ABESIJKMHOPCTYXaesijopcyxdhlqwвкмнтvÄäËëÏïÖö",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορικϲϳυγχτηωεβμ": "ABEZHIKMNOPTYXavopıκcjυγχτηωεβμ",
    "ОоОοΟοԚԜҮҺ": "OoOoOoQWYh",
    "ɑɡıſ": "agıs",
    "ՕօՍսՏոհցզ": "OoUuSnhgq",
}
#: Marks that read as the same mark.
SAME_MARKS = ("-‐‑", "'ʼ＇", "|ǀ")
#: Characters that leave no mark on the page.
UNSEEN = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufe00\ufe01\ufe02\ufe0e\ufe0f\ufeff"
#: Letters drawn alike that the standard does not relate.
LIGATURES = {"ﬅ": "st", "ﬆ": "st"}


class UnionFind:
    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[b] = a

    def classes(self) -> dict[str, list[str]]:
        out = defaultdict(list)
        for x in list(self.up):
            out[self.find(x)].append(x)
        return out


def edges() -> list[tuple[str, str]]:
    """Pairs that read the same, mostly by rule from the character database."""
    out = []
    for a, b in LOOK_ALIKE.items():
        out += [(x, y) for x, y in zip(a, b) if x != y]
    out += [(m[0], x) for m in SAME_MARKS for x in m[1:]]
    out += LIGATURES.items()
    for cp in range(0xA0, sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000 or 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4:
            continue
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Cn":
            continue
        if kind == "Zs":
            out.append((" ", c))
            continue
        what = unicodedata.decomposition(c)
        if not what:
            continue
        if what.startswith(("<wide>", "<narrow>")) or (what.startswith("<compat>") and 0xFB00 <= cp <= 0xFB06):
            out.append((unicodedata.normalize("NFKC", c), c))
        elif what[0] != "<":
            full = unicodedata.normalize("NFD", c)
            out.append((c, full))
            for base in _first_alike(full[0]):  # the same mark on a look-alike letter
                out.append((c, base + full[1:]))
    return out


@lru_cache(maxsize=1)
def _alike() -> dict[str, list[str]]:
    uf = UnionFind()
    for a, b in LOOK_ALIKE.items():
        for x, y in zip(a, b):
            uf.union(y, x)
    return {x: [y for y in c if y != x] for c in uf.classes().values() for x in c}


def _first_alike(c: str) -> list[str]:
    return _alike().get(c, [])


@lru_cache(maxsize=1)
def classes() -> tuple[tuple[str, ...], ...]:
    uf = UnionFind()
    for a, b in edges():
        uf.union(a, b)
    return tuple(tuple(sorted(c)) for c in uf.classes().values())


def members() -> set[str]:
    return {x for c in classes() for x in c}


def representatives(freq: dict[str, int]) -> dict[str, str]:
    """member -> the most frequent member of its class; ties go to the shorter, then lower code point."""
    out = {}
    for c in classes():
        best = min(c, key=lambda x: (-freq.get(x, 0), len(x), x))
        for x in c:
            out[x] = best
    return out | dict.fromkeys(UNSEEN, "")


def automaton(table: dict[str, str]):
    """The automaton over the members that are not their class's representative, and the characters without which none can occur."""
    import ahocorasick

    a = ahocorasick.Automaton()
    needs: set[str] = set()
    for k, v in table.items():
        if k != v:
            a.add_word(k, (len(k), v))
            needs.add(max(k))  # the rarest character of a member by code point
    a.make_automaton()
    return a, frozenset(needs)


#: Letters with marks, and the parts that Hangul syllables are composed of.
_MARKS = "".join(chr(c) for c in range(0x300, sys.maxunicode + 1) if unicodedata.combining(chr(c)))
_CLUSTER = re.compile(f".[{re.escape(_MARKS)}]+|[\uac00-\ud7a3]?[\u1100-\u11ff]+", re.S)
_PARTED = re.compile(f"[{re.escape(_MARKS)}\u1100-\u11ff]")


def composed(text: str) -> str:
    """Marks in their canonical order and Hangul in syllables: one form of what is canonically equal."""
    try:
        text.encode("latin-1")  # no marks or parts of syllables are among these
        return text
    except UnicodeEncodeError:
        if _PARTED.search(text) is None:
            return text
    return _CLUSTER.sub(lambda m: unicodedata.normalize("NFC", m[0]), text)


def rewrite(text: str, auto, memo: dict[str, str] | None = None) -> str:
    """Greedy, leftmost longest, piece by piece between blanks; a piece seen before is looked up."""
    tree, needs = auto
    text = composed(text)
    if needs.isdisjoint(text):
        return text
    memo = {} if memo is None else memo
    out = []
    for piece in text.split(" "):
        if needs.isdisjoint(piece):
            out.append(piece)
            continue
        done = memo.get(piece)
        if done is None:
            if len(memo) > 200_000:
                memo.clear()
            done = memo[piece] = _rewrite(piece, tree, needs)
        out.append(done)
    return " ".join(out)


def _rewrite(text: str, tree, needs: frozenset[str]) -> str:
    before: set[str] = set()
    while text not in before and not needs.isdisjoint(text):  # what a removed mark joined is looked at again
        before.add(text)
        out, at = [], 0
        for end, (n, v) in tree.iter_long(text):
            out.append(text[at : end - n + 1])
            out.append(v)
            at = end + 1
        out.append(text[at:])
        text = composed("".join(out)) if out[:-1] and _UNSEEN_SET & set(text) else "".join(out)
    return text


_UNSEEN_SET = frozenset(UNSEEN)
_MARKED = re.compile("[^\u0300-\u036f][\u0300-\u036f]+")


def learn(rows: DataFrame) -> dict[str, str]:
    """Counts of the class members over all texts; at most one row per member of the fixed classes."""
    known = frozenset(members())
    joined = [x for x in known if len(x) > 1 and x.isascii()]

    def run(batches):
        import pyarrow as pa

        found: Counter = Counter()
        for batch in batches:
            for t in batch.column("text").to_pylist():
                found.update(t)
                for x in joined:
                    if n := t.count(x):
                        found[x] += n
                if not t.isascii():
                    found.update(_MARKED.findall(t))
        found = {c: n for c, n in found.items() if c in known}
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["c", "n"])

    counts = rows.select("text").mapInArrow(run, "c string, n bigint").groupBy("c").agg(F.sum("n").alias("n"))
    return representatives(dict(counts.toPandas().itertuples(index=False, name=None)))


def consistent(pages: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """Every present layer in one form: field_name, layer_id, stored (hash of the text), form."""
    rows = layer_rows(pages)
    table = learn(rows) if table is None else table
    table = {k: v for k, v in table.items() if k != v}
    maker: dict = {}

    def run(batches):
        import pyarrow as pa

        if "auto" not in maker:
            maker["auto"], maker["memo"] = automaton(table), {}
        auto, memo = maker["auto"], maker["memo"]
        for b in batches:
            forms = [rewrite(t, auto, memo) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("field_name", "layer_id", "stored")), pa.array(forms, pa.string())], names=["field_name", "layer_id", "stored", "form"])

    rows = rows.select("field_name", "layer_id", F.xxhash64("text").alias("stored"), "text")
    return rows.mapInArrow(run, "field_name string, layer_id bigint, stored bigint, form string")


_KEY = ["field_name", "h1", "h2", "h3"]


def _keyed(pages: DataFrame, table: dict[str, str] | None) -> DataFrame:
    """Digests only: 128 bits of the form, 64 of the stored text; blank texts are left out, whichever kind of blank."""
    forms = consistent(pages, table)
    return forms.where(F.length(F.trim(F.regexp_replace("form", r"\s", ""))) > 0).select("field_name", "layer_id", "stored", F.xxhash64("form").alias("h1"), F.hash("form").alias("h2"), F.length("form").alias("h3"))


def pairs(pages: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """Rows of one field whose texts read the same and are not stored identically (field_name, layer_id_a, layer_id_b).

    Stored texts of a class meet first, each once; ids are joined last, so rows that are stored alike never meet and all
    work but this is in proportion to the pairs asked for.  Classes with one stored text reach no join; AQE splits a hot one.
    """
    keyed = cut(_keyed(pages, table))
    mixed = keyed.groupBy(*_KEY).agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where("lo <> hi").select(*_KEY)
    members_ = keyed.join(mixed, _KEY, "left_semi")
    texts = members_.select(*_KEY, "stored").distinct()
    met = texts.withColumnRenamed("stored", "sa").join(texts.withColumnRenamed("stored", "sb"), _KEY).where("sa < sb")
    a = members_.select(*_KEY, F.col("layer_id").alias("a"), F.col("stored").alias("sa"))
    b = members_.select(*_KEY, F.col("layer_id").alias("b"), F.col("stored").alias("sb"))
    return met.join(a, [*_KEY, "sa"]).join(b, [*_KEY, "sb"]).select("field_name", F.least("a", "b").alias("layer_id_a"), F.greatest("a", "b").alias("layer_id_b"))


def membership(pages: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """One row per layer that is not blank: field_name, layer_id, class_id (the class's least layer_id), stored_texts (how many differ in it)."""
    keyed = cut(_keyed(pages, table))
    texts = keyed.groupBy(*_KEY, "stored").agg(F.min("layer_id").alias("first"))
    sums = texts.groupBy(*_KEY).agg(F.min("first").alias("class_id"), F.count("*").alias("stored_texts"))
    return keyed.join(sums, _KEY).select("field_name", "layer_id", "class_id", "stored_texts")
