"""Problem 3: text decoded with the wrong character encoding.

Round-trip repair.  A damaged word is encoded back to bytes with a legacy
encoding it may have been read in, and the bytes are decoded strictly in the
encoding they may have been written in.  This is repeated for nested layers.  A
step is taken only if it lowers the word's garbling cost, its improbability
under letter-pair frequencies counted over the whole column.

Defined results: a null or empty text, and one with ASCII only and no lost
letters, is unaffected; an empty table gives an empty result; equal rows give
equal results; columns other than the named ones are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Collection
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, cut, frequent, token_counts

#: Encodings text is found to have been read in, and written in.
READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "iso8859_5", "koi8_r", "cp866")
WRITTEN_IN = ("cp1252", "cp1251", "koi8_r", "cp850", "cp866", "mac_roman", "iso8859_5")

#: A word's cost, in nats, must fall by at least this much per damaged character.
MIN_GAIN = 1.5
#: Letter pairs below this share of all pairs count as unseen; so at most 1/PAIR_SHARE are kept.
PAIR_SHARE = 1e-6
#: Words of at least this share of the words with non-ASCII letters are known words.
KNOWN_SHARE = 2e-5
#: A repaired word is known if it occurs this many times as often as the damaged one.
MIN_RATIO = 5
MAX_LAYERS = 5

#: ASCII only: any other mark may be half of a damaged character.
WORD_EDGE = ".,;:()[]{}<>\"'*#-_|/"

_HIGH = re.compile(r"[^\x00-\x7f]+")
#: Where a letter may be lost to a question mark: inside a word, before its lower-case rest, or at its end within a sentence.
_MAYBE_LOST = re.compile(r"[^\W\d_]\?+[a-zà-ÿа-яё]|[A-ZÀ-Þ]\?+[A-ZÀ-Þ]|(?<![\w?.!/=&])\?+[a-zà-ÿ]{2}|[a-zà-ÿ]\? [a-zà-ÿ]")
_WORDS = re.compile(r"[^ \t\r\n\f\v]+")
#: Cyrillic letters that stand in Latin words for their look-alikes; alone they are no sign of a wrong decoding.
_STAND_INS = frozenset("аеоріѕјһԁАВЕКМНОРСТХІЅЈ")
_LATIN = re.compile(r"[a-zA-Z]")
_CYRILLIC = re.compile(r"[\u0400-\u04ff]")
_LOWERED = str.maketrans("ãâðñ", "ÃÂÐÑ")


def _byte_tables() -> dict[str, dict[str, int]]:
    tables = {}
    for name in READ_AS:
        table = {}
        for b in range(128, 256):
            try:
                table[bytes([b]).decode(name)] = b
            except UnicodeDecodeError:
                table[chr(b)] = b  # bytes without a meaning come out as control characters
        tables[name] = table
    tables["cp1252"] = {chr(b): b for b in range(128, 160)} | tables["cp1252"]
    return tables


_BYTES = _byte_tables()
_LETTERS = {name: frozenset(table) for name, table in _BYTES.items()}


def _utf8_runs(word: str, table: dict[str, int]) -> str | None:
    """Every run of non-ASCII characters, read strictly as UTF-8; None if one is not, or nothing changes."""

    def one(m: re.Match) -> str:
        return bytes([table[c] for c in m[0]]).decode("utf-8")

    try:
        done = _HIGH.sub(one, word)
    except (KeyError, UnicodeDecodeError):
        return None
    return done if done != word else None


def _legacy(word: str, table: dict[str, int], written: str) -> str | None:
    try:
        done = _HIGH.sub(lambda m: bytes([table[c] for c in m[0]]).decode(written), word)
    except (KeyError, UnicodeDecodeError):
        return None
    return done if done != word else None


class Garbling:
    """Improbability of a word's letter pairs, in nats; pairs of letters, word edges and all other characters."""

    def __init__(self, pairs: dict[str, int], known: dict[str, int], plain: Collection[str] = ()):
        self.total = sum(pairs.values()) + 1
        self.cost = {p: math.log(self.total / n) for p, n in pairs.items()}
        self.unseen = math.log(self.total) + 2
        self.known = known
        self.plain = frozenset(plain)  # known words of ASCII letters only

    def __call__(self, word: str) -> float:
        word = f" {word.strip(WORD_EDGE).lower()} "
        cost, unseen = self.cost, self.unseen
        total = 0.0
        for a, b in zip(word, word[1:]):
            if a > "\x7f" or b > "\x7f":
                total += cost.get(a + b, unseen)
        return total

    def count(self, word: str) -> int:
        return self.known.get(word.strip(WORD_EDGE).lower(), 0)

    @cached_property
    def masked(self) -> frozenset[str]:
        """The known words as they look with their letters beyond ASCII lost."""
        return frozenset(_HIGH.sub(lambda m: "?" * len(m[0]), w) for w in self.known if _LATIN.search(w))

    def lost(self, word: str) -> bool:
        """Whether question marks in or at the end of a word stand for lost letters, by the known words.

        They do if letters in their place give a known word; they do not behind a known word or between known words, nor in
        what looks like an address.  What is left reads as no word with the marks as marks, so it has lost letters; marks
        before a word are lost letters of known words only.
        """
        w = word.strip(WORD_EDGE).lower()
        stem = w.strip("?")
        if not stem:
            return False
        if w in self.masked or (w[-1] == "?" and w[:-1] in self.masked):
            return True
        if w[0] == "?" or any(c in w for c in "/=&@"):
            return False
        return not all(x in self.plain or x in self.known for x in stem.split("?") if x)


def pairs_of(word: str, n: int, into: Counter) -> None:
    word = f" {word} "
    for a, b in zip(word, word[1:]):
        if a > "\x7f" or b > "\x7f":
            into[a + b] += n


def strict_layers(word: str) -> str:
    """Undo every layer of UTF-8 read in a single-byte encoding; strict, so it needs no model."""
    for _ in range(MAX_LAYERS):
        for name in ("cp1252", "mac_roman", "cp437", "cp850", "cp1251"):
            done = _utf8_runs(word, _BYTES[name])
            if done is not None and "\ufffd" not in done:
                break
        else:
            lifted = word.translate(_LOWERED)
            done = _utf8_runs(lifted, _BYTES["cp1252"]) if lifted != word else None
            if done is not None:
                done = done.lower()
        if done is None:
            return word
        word = done
    return word


def repair_word(word: str, garbling: Garbling) -> str:
    """The word with its wrong decodings undone, as far as each step lowers the cost."""
    if any("\ue000" <= c <= "\uf8ff" for c in word):
        return word  # glyphs of a faulty font, not bytes
    now = garbling(word)
    for _ in range(MAX_LAYERS):
        letters = {c for c in word if c > "\x7f"}
        able = [name for name in READ_AS if letters <= _LETTERS[name]]
        if not letters or not able:
            break
        high = sum(c > "\x7f" for c in word)
        best, least, strict = None, now, False
        steps = [_utf8_runs(word, _BYTES[name]) for name in able]
        if (lifted := word.translate(_LOWERED)) != word and (done := _utf8_runs(lifted, _BYTES["cp1252"])):
            steps.append(done.lower())
        for done in steps:
            if done is not None and (c := garbling(done)) < least:
                best, least, strict = done, c, True
        if best is None:
            often = garbling.count(word)
            mixed = _LATIN.search(word) is not None and _CYRILLIC.search(word) is not None
            if letters <= _STAND_INS:
                break
            blank = "\xa0" in word or "\xad" in word
            for name in able:
                for written in WRITTEN_IN:
                    if written == name:
                        continue
                    done = _legacy(word, _BYTES[name], written)
                    if done is None:
                        continue
                    known = garbling.count(done) >= MIN_RATIO * max(1, often)
                    if not known and (blank or often or mixed):
                        continue
                    gain = MIN_GAIN * high * (0.5 if known else 2)
                    if (c := garbling(done) - 3 * known) < least and c < now - gain:
                        best, least = done, c
        if best is None:
            break
        word, now = best, least
        if not strict:
            break
    return word


def repairer(garbling: Garbling) -> Callable[[str | None], tuple[bool, bool, str | None]]:
    """text -> (affected, a loss cannot be undone, repaired text); words already seen are looked up."""
    memo: dict[str, str] = {}
    gone = lru_cache(maxsize=100_000)(garbling.lost)

    def changed(w: str) -> bool:
        done = memo.get(w)
        if done is None:
            if len(memo) > 200_000:
                memo.clear()
            done = memo[w] = repair_word(w, garbling)
        return done != w

    def text(t: str | None) -> tuple[bool, bool, str | None]:
        if not t:
            return False, False, t
        lost = "?" in t and _MAYBE_LOST.search(t) is not None and any(gone(w) for w in set(_WORDS.findall(t)) if "?" in w)
        if t.isascii():
            return lost, lost, t
        lost = lost or "\ufffd" in t
        bad = [w for w in set(_WORDS.findall(t)) if not w.isascii() and changed(w)]
        if not bad:
            return lost, lost, t
        fixes = {w: memo.get(w) or repair_word(w, garbling) for w in bad}
        return True, lost, _WORDS.sub(lambda m: fixes.get(m[0], m[0]), t)

    return text


def _high_words(text: str) -> list[str]:
    return [] if text.isascii() else [w for w in _WORDS.findall(text) if not w.isascii()]


#: Marks the counted words of ASCII letters only.
_PLAIN = "\x01"


def _clean(word: str) -> str | None:
    """Counted form of a word, of words that are certainly not damaged."""
    if word.isascii():
        word = word.strip(WORD_EDGE).lower()
        return _PLAIN + word if word.isalpha() else None
    if "\ufffd" in word or any("\ue000" <= c <= "\uf8ff" or "\x80" <= c < "\xa0" for c in word):
        return None
    if strict_layers(word) != word:
        return None
    return word.strip(WORD_EDGE).lower() or None


def learn(texts: DataFrame) -> Garbling:
    """Letter pairs and known words over all rows of the one text column.

    Both tables are cut at a share of the total, so what reaches the driver is bounded at any size.
    """
    words = cut(token_counts(texts, _WORDS.findall, _clean))
    plain = F.startswith("word", F.lit(_PLAIN))
    vocab = words.where(~plain)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found: Counter = Counter()
            for word, n in zip(batch.column("word").to_pylist(), batch.column("cnt").to_pylist(), strict=True):
                pairs_of(word, n, found)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "cnt"])

    pairs = vocab.mapInArrow(run, "word string, cnt bigint").groupBy("word").agg(F.sum("cnt").alias("cnt"))
    return Garbling(frequent(pairs, PAIR_SHARE), frequent(vocab, KNOWN_SHARE), [w[1:] for w in frequent(words.where(plain), KNOWN_SHARE)])


def repair_rows(rows: DataFrame, garbling: Garbling) -> DataFrame:
    """rows: field_name, rec_id, text.  Adds affected, lost and repaired; keeps affected rows only."""
    maker: dict = {}

    def one(field_name, rec_id, text):
        fix = maker.get("fix")
        if fix is None:
            fix = maker["fix"] = repairer(garbling)
        affected, lost, done = fix(text)
        if affected:
            yield field_name, rec_id, text, lost, done

    return arrow_pass(rows.select("field_name", "rec_id", "text"), one, "field_name string, rec_id bigint, text string, lost boolean, repaired string")


def damaged(pages: DataFrame, audit: DataFrame) -> DataFrame:
    """Affected records of native_text and quality_flags with their restored text (field_name, rec_id, text, lost, repaired)."""
    native = pages.select(F.lit("native_text").alias("field_name"), F.col("layer_id").cast("bigint").alias("rec_id"), F.col("native_text").cast("string").alias("text"))
    flags = audit.select(F.lit("quality_flags").alias("field_name"), F.col("audit_id").cast("bigint").alias("rec_id"), F.explode("quality_flags").alias("text"))
    rows = native.unionByName(flags).where(F.col("text").isNotNull() & F.col("text").rlike(r"[^\x00-\x7F]|\?"))
    return repair_rows(rows, learn(rows.select("text")))
