"""Problem 1: noise in text from scanned pages.

* Misread characters.  Words are counted over all layers.  Every word has an
  anagram hash, the sum of its characters' values, in which shapes a scanner
  takes for one another share a value.  Shapes of two strokes taken for one
  ("cl" for "d") change the hash by a known difference, so a rare word is joined
  in SQL, on hash plus difference, with the frequent words it can be a misread
  variant of.  Candidates are ranked, and the first is the correction.
* Running headers and page numbers.  Lines at the edges of pages are counted by
  file; what several pages of a file carry is a header, the same or altered.
* Broken words.  The joined and the hyphenated form are looked up in the counts;
  the better attested one decides.

Defined results: null, empty and blank texts give no row and stay as they are;
pages delivered twice count once as evidence and are each reported; empty tables
give empty results; columns other than the named ones are ignored.
"""

from __future__ import annotations

import re
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SCAN_CLASSES, SCAN_FOLD, WORD_EDGE, arrow_pass, cut, frequent, layer_rows, scan_fold, token_counts

#: A correction must be this many times as frequent as the word it replaces, in plain words ...
RATIO = 8
#: ... and in words with digits or signs among their letters.
RATIO_SIGNS = 2
#: Least count of a correction.
LEAST = 3
#: Words of this share of all words are frequent; so there are at most 1/FREQUENT_SHARE.
FREQUENT_SHARE = 1e-5
#: The same in words of two or three letters, where more words are near each other.
RATIO_SHORT = 500
#: Two-stroke confusions that are tried one by one; one-stroke ones are not limited, and more two-stroke ones are found by
#: a form in which all of them are undone.
MAX_JOINED = 2
#: A header is on this share of a file's pages, and on HEADER_PAGES of them if it is title-like, else on one more.
HEADER_SHARE, HEADER_PAGES = 0.03, 2
#: The share of all files, and their least number, at whose edges a title-like line is a header anywhere.
HEADER_FILES_SHARE, HEADER_FILES = 0.002, 3
#: A pattern of lines is a header's if on this many further pages of its files, and this share of them, its line is the same.
TEMPLATE_PAGES, TEMPLATE_SAME = 5, 0.5
#: Headers of a file that every line of it is compared with.
MANY = 200
#: Lines this much of their length apart are one header, altered.
HEADER_EDITS = 0.15

#: Two strokes a scanner takes for one, or one for two (seen, printed).
JOINED = (("cl", "d"), ("rn", "m"), ("ri", "n"), ("li", "h"), ("ii", "u"), ("vv", "w"), ("d", "cl"), ("m", "rn"), ("n", "ri"), ("h", "li"))
#: Letters and signs a scanner puts for digits.
FOR_DIGITS = "OoQDlIi|!SsBZzGbqg"
#: Pronouns that hang on a verb with a hyphen of their own.
ENCLITICS = frozenset("se me te lhe lhes nos vos o a os as lo la los las no na nos nas mo ma ei á ão ia iam feira ci là".split())

_FROM = "".join(c[1:] for c in SCAN_CLASSES)
_TO = "".join(c[0] * (len(c) - 1) for c in SCAN_CLASSES)
_HYPHENS = "-¬=‐­"
_BREAK = re.compile(rf"([^\W\d_][\w'’|@†!$-]*?)[{_HYPHENS}]([ \t]*\n[ \t]*|[ ])(?=([^\W_][\w'’|@†!$]*(?:-[^\W\d_]+)*))")
_EDGE = WORD_EDGE + "!?"
_DIGITS = re.compile(r"\d")
_PLAIN = re.compile(r"[\w|!@$†€¢.,/:'’+-]+")
_SCRIPTS = (re.compile(r"[A-Za-zÀ-ɏ]"), re.compile(r"[Ѐ-ӿ]"), re.compile(r"[Ͱ-Ͽ＀-￯̀-ͯ]"))
_SIGN = re.compile(r"[^\W\d_].*[\d|!@$†€¢ſ]|[\d|!@$†€¢ſ].*[^\W\d_]")
_MAIL = re.compile(r"@.*\.|\.\w+@")
_D = r"[0-9OolISBZ|]"
_ROMAN = r"(?=[ivxlcIVXLC])(?:x{0,3}|X{0,3}|xl|XL|l|L)(?:ix|iv|vi{0,3}|i{1,3}|IX|IV|VI{0,3}|I{1,3}|x|X)?"
_NUMBER = rf"(?:{_D}{{0,4}}[0-9]{_D}{{0,4}}|{_ROMAN})"
_PAGE = rf"(?:[-–—\[(]\s*)*(?:(?:p[aáà@]g(?:[i|l1]na|[.,])?|p[.,]|f[l1|I]s?[.,]?|f[o0][l1|]ha|page|seite|s\.|стр[.,]?|лист)\s*)?{_NUMBER}(?:\s*(?:/|d[ec]|of|von|di|из|sur)\s*{_NUMBER})?(?:\s*[-–—\])])*"
_PAGE_ONLY = re.compile(rf"\s*{_PAGE}\s*$", re.I)
_PAGE_LAST = re.compile(rf"^(.*\w\S*)\s+[-–—|·]\s*({_PAGE})\s*$", re.I)
_PAGE_FIRST = re.compile(rf"^\s*({_PAGE})\s*[-–—|·]\s+(\w.*)$", re.I)
_SENTENCE_END = re.compile(r"[^\W_A-Z][.;,!?]+$")


def normal(token: str) -> str | None:
    """Counted form of a token: a lower-case word, or a number with its digits as zeros; None for what is no plain word."""
    w = token.strip(_EDGE)
    if not w or (not w.isascii() and (not _PLAIN.fullmatch(w) or sum(s.search(w) is not None for s in _SCRIPTS) > 1)):
        return None
    if "@" in w and _MAIL.search(w):
        return None
    if not w.isalpha() and (digits := sum(map(str.isdigit, w))):
        letters = [c for c in w if c.isalpha()]
        alike = sum(c in FOR_DIGITS for c in letters)
        plain = len(letters) - alike
        if (digits > plain or (digits == plain and w[0].isdigit())) and alike <= 2 * digits:
            return _DIGITS.sub("0", w)
    return w.lower()


_LINE_BREAK = re.compile(rf"[{_HYPHENS}][ \t]*\n[ \t]*")
_BLANK = re.compile(r"\s")
#: Marks a word whose two parts stood on two lines.
_REJOINED = "\x01"


def tokens(text: str) -> list[str]:
    """Words as they stand, and those that a line's end breaks, marked."""
    out = [t for t in text.split() if t[-1] not in _HYPHENS]
    for m in _LINE_BREAK.finditer(text):
        begin = max(text.rfind(" ", 0, m.start()), text.rfind("\n", 0, m.start())) + 1
        end = _BLANK.search(text, m.end())
        if (b := _BREAK.search(text, begin, end.start() if end else len(text))) and b.start(2) == m.start() + 1:
            out.append(_REJOINED + b[1] + b[3])
    return out


def _counted(token: str) -> str | None:
    if token[0] == _REJOINED:
        w = normal(token[1:])
        return w and _REJOINED + w
    return normal(token)


def vocabulary(pages: DataFrame) -> DataFrame:
    """(word, cnt, whole) over both layers of all pages; whole is the count without words that a line's end breaks.

    The latter are evidence for the spelling of a word, but not for its being written without a hyphen.
    """
    counts = token_counts(layer_rows(pages).select("text"), tokens, _counted)
    part = F.startswith("word", F.lit(_REJOINED))
    sums = counts.groupBy(F.when(part, F.substr("word", F.lit(2))).otherwise(F.col("word")).alias("word"))
    return sums.agg(F.sum("cnt").alias("cnt"), F.sum(F.when(~part, F.col("cnt")).otherwise(0)).alias("whole"))


def _value(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(1 << 40))


def anagram_hash(word: Column) -> Column:
    """Sum of the characters' values; characters of one class of shapes have one value."""
    return F.aggregate(F.split(F.translate(word, _FROM, _TO), ""), F.lit(0).cast("bigint"), lambda acc, c: acc + F.when(c == "", F.lit(0)).otherwise(_value(c)))


def often_count(words: DataFrame) -> int:
    """The count of the most frequent word: a word of more than its RATIOth part can be nobody's misreading."""
    return words.agg(F.max("cnt")).first()[0] or 0


def corrections(vocab: DataFrame) -> DataFrame:
    """(word, correction): the best ranked frequent word that each rare word can be a misread variant of."""
    words = vocab.where(F.length("word") >= 2)
    digit = F.translate("word", FOR_DIGITS, "0" * len(FOR_DIGITS))
    # numbers: letters among digits, whose all-digit form is frequent
    rare_n = words.where(F.col("word").rlike("[0-9]") & F.col("word").rlike(f"[{re.escape(FOR_DIGITS)}]") & (F.length(F.regexp_replace("word", "[^0]", "")) * 2 >= F.length(F.regexp_replace("word", "[^0-9A-Za-z|!]", ""))))
    prefix = F.regexp_extract("word", "^[A-Za-z]*", 0)
    behind = F.concat(prefix, F.translate(F.substr("word", F.length(prefix) + 1), FOR_DIGITS, "0" * len(FOR_DIGITS)))
    rare_n = rare_n.select("word", F.col("cnt").alias("rare"), F.explode(F.array_distinct(F.array(digit, behind))).alias("correction"), F.lit(0).alias("joined"))
    as_number = rare_n.join(words.select(F.col("word").alias("correction"), F.col("cnt").alias("often")), "correction")
    as_number = as_number.where((F.col("often") >= LEAST) & (F.col("often") >= RATIO * F.col("rare")) & (F.col("word") != F.col("correction")))
    # words: equal anagram hash after up to MAX_JOINED two-stroke differences
    letters = words.where(F.col("word").rlike(r"[a-zß-ÿа-яё]"))
    hashed = letters.withColumn("h", anagram_hash(F.col("word")))
    options = F.array(*[F.struct(F.lit(a).alias("seen"), F.lit(b).alias("printed"), F.lit(i).alias("i")) for i, (a, b) in enumerate(JOINED)])
    possible = F.transform(
        F.filter(options, lambda o: F.instr(F.col("word"), o["seen"]) > 0),
        lambda o: F.struct(o["i"].alias("i"), (anagram_hash(o["printed"]) - anagram_hash(o["seen"])).alias("d"), (F.length(F.col("word")) - F.length(F.replace(F.col("word"), o["seen"], F.lit("")))).alias("room"), F.length(o["seen"]).alias("n")),
    )
    none = F.array(F.struct(F.lit(0).cast("bigint").alias("d"), F.lit(0).alias("k")))
    one = F.transform(F.col("possible"), lambda o: F.struct(o["d"].alias("d"), F.lit(1).alias("k")))
    both = F.flatten(F.transform(F.col("possible"), lambda a: F.transform(F.filter(F.col("possible"), lambda b: (b["i"] > a["i"]) | ((b["i"] == a["i"]) & (a["room"] >= 2 * a["n"]))), lambda b: F.struct((a["d"] + b["d"]).alias("d"), F.lit(2).alias("k")))))
    variants = [none, one, both][: MAX_JOINED + 1]
    signs = F.col("word").rlike(_SIGN.pattern.replace(r"[^\W\d_]", r"\p{L}"))
    ratio = F.when(F.col("signs"), RATIO_SIGNS).when(F.length("word") < 4, RATIO_SHORT).otherwise(RATIO)
    most = often_count(words)
    rare = hashed.where(F.col("cnt") * F.when(signs, RATIO_SIGNS).otherwise(RATIO) <= most).select("word", F.col("cnt").alias("rare"), "h", signs.alias("signs"), possible.alias("possible"))
    rare = rare.select("word", "rare", "signs", "h", F.explode(F.concat(*variants)).alias("v")).select("word", "rare", "signs", (F.col("h") + F.col("v.d")).alias("h"), F.col("v.k").alias("joined"))
    often = hashed.where((F.col("cnt") >= LEAST) & ~signs & ~F.col("word").rlike("[0-9|!@$†€¢ſ]")).select(F.col("word").alias("correction"), F.col("cnt").alias("often"), "h")
    pairs = rare.join(often, "h").where(
        (F.col("word") != F.col("correction"))
        & (F.col("often") >= ratio * F.col("rare"))
        & (F.levenshtein(F.translate("word", _FROM, _TO), F.translate("correction", _FROM, _TO)) <= 2 * F.col("joined"))
    )
    # words with more confusions than are tried one by one: both sides with all of them undone
    two = [j for j in JOINED if len(j[0]) == 2]
    whole = F.translate(reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), two, F.col("word")), _FROM, _TO)
    places = sum((F.length("word") - F.length(F.replace("word", F.lit(a), F.lit(""))) for a, _ in two), F.lit(0)) / 2
    many = letters.where((F.length("word") >= 4) & (places > MAX_JOINED) & (F.col("cnt") * RATIO <= most)).select("word", F.col("cnt").alias("rare"), whole.alias("w"))
    plain = letters.where((F.col("cnt") >= LEAST) & ~signs & ~F.col("word").rlike("[0-9|!@$†€¢ſ]")).select(F.col("word").alias("correction"), F.col("cnt").alias("often"), whole.alias("w"))
    as_many = many.join(plain, "w").where((F.col("word") != F.col("correction")) & (F.col("often") >= RATIO * F.col("rare"))).withColumn("joined", F.lit(MAX_JOINED + 1))
    as_word = pairs.select("word", "rare", "correction", "joined", "often").unionByName(as_many.select("word", "rare", "correction", "joined", "often"))
    ranked = as_number.select("word", "rare", "correction", "joined", "often").unionByName(as_word)
    best = W.partitionBy("word").orderBy("joined", F.desc("often"), F.levenshtein("word", "correction"), "correction")
    return ranked.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("word", "correction")


def broken(text: str):
    """(left, right) of the words that a hyphen parts at a line's end, or before a blank where lines were joined."""
    for m in _BREAK.finditer(text):
        yield m[1], m[3]


def rejoin(text: str) -> str:
    return _BREAK.sub(lambda m: m[1], text)


def edge_lines(text: str):
    """(place, depth, line, context, header text, page number only, page number inside, next line inward) of the first and last lines.

    The two outermost lines are always looked at, further ones as long as every line so far could be noise.
    """
    lines = [x for x in (x.strip() for x in text.split("\n")) if x]
    n = len(lines)
    for place in ("top", "bottom"):
        could = True
        for depth in range(n if place == "top" else n - 2):
            if depth >= 2 and not could:
                break
            i = depth if place == "top" else n - 1 - depth
            line = lines[i]
            context = " ".join(lines[: i + 1]) if place == "top" else " ".join(lines[i:])
            if _PAGE_ONLY.match(line):
                yield place, depth, line, context, "", True, False, ""
                continue
            inside, core = False, line
            if m := _PAGE_LAST.match(line):
                inside, core = True, m[1]
            elif m := _PAGE_FIRST.match(line):
                inside, core = True, m[2]
            could = could and _looks_running(core)
            inner = i + 1 if place == "top" else i - 1
            yield place, depth, line, context, core, False, inside, _digest(header_key(lines[inner])) if 0 <= inner < n else ""


def _digest(key: str) -> str:
    """A line's key in eight characters: neighbours are only compared for being the same."""
    return f"{zlib.crc32(key.encode()):08x}"


def header_key(core: str) -> str:
    return scan_fold("".join(c for c in core.lower() if c.isalnum() or c in "|!@$†"))


def _looks_running(core: str) -> bool:
    return len(core) > 5 and not core[:1].islower() and not _SENTENCE_END.search(core) and "\t" not in core and not re.search(r"\d,\d\d$", core)


def template(core: str) -> str:
    """A line with its numbers and capitalised words, but the first, masked."""
    first, _, rest = " ".join(core.split()).rstrip(" .").partition(" ")
    return re.sub(r"\d+", "0", first) + " " + _MASK.sub(lambda m: "0" if m[0][0].isdigit() else "X", rest)


_MASK = re.compile(r"\d+|[A-ZÀ-Þ]\w*")


def _title_like(core: str) -> bool:
    """Most of the longer words begin with a capital."""
    long = [w for w in re.findall(r"[^\W\d_]+", core) if len(w) > 3]
    return 2 * sum(w[0].isupper() for w in long) > len(long)


def edges(pages: DataFrame) -> DataFrame:
    """Edge lines of the OCR layer that may be headers or page numbers."""

    def one(layer_id, file_id, page_index, text):
        for place, depth, line, context, core, number, inside, beside in edge_lines(text):
            fit = not number and _looks_running(core)
            if number or fit:
                yield layer_id, file_id, page_index, place, depth, line, context, header_key(core) if fit else None, number, inside, beside, _title_like(core), template(core)

    rows = pages.select(F.col("layer_id").cast("bigint").alias("layer_id"), F.col("file_id").cast("string").alias("file_id"), F.col("page_index").cast("int").alias("page_index"), F.col("ocr_text").cast("string").alias("text")).where("text is not null")
    schema = "layer_id bigint, file_id string, page_index int, place string, depth int, line string, context string, key string, number boolean, inside boolean, beside string, title boolean, template string"
    return arrow_pass(rows, one, schema)


def headers(edge: DataFrame, pages: DataFrame) -> DataFrame:
    """(file_id, key, few) of running headers; few are those on a share of the file's pages, so a bounded number in any file."""
    sizes = pages.where(F.col("ocr_text").isNotNull()).select(F.col("file_id").cast("string").alias("file_id"), F.col("page_index").cast("int").alias("page_index")).distinct().groupBy("file_id").agg(F.count("*").alias("pages"))
    seen = edge.where("key is not null").groupBy("file_id", "key", "page_index").agg(F.min("beside").alias("beside"), F.max("title").alias("title"), F.max("template").alias("template"))
    by_file = seen.groupBy("file_id", "key").agg(F.count("*").alias("on"), F.min("beside").alias("a"), F.max("beside").alias("b"), F.max("title").alias("title"), F.max("template").alias("template"))
    # the neighbours tell headers from copies of a page, whose neighbours are the same
    everywhere = by_file.where("title").groupBy("key").agg(F.count("*").alias("files"), F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b")
    least = sizes.agg(F.greatest(F.lit(HEADER_FILES), F.lit(HEADER_FILES_SHARE) * F.count("*")).alias("least"))
    wide = everywhere.join(F.broadcast(least), F.col("files") >= F.col("least")).select("key", F.lit(True).alias("wide"))
    # a pattern whose lines stay the same within files is a header's, one whose lines change from page to page a title's
    within = by_file.where("title").groupBy("file_id", "template").agg(F.sum("on").alias("n"), F.max("on").alias("same"))
    kept = within.where("n >= 2").groupBy("template").agg(F.sum(F.col("same") - 1).alias("same"), F.sum(F.col("n") - 1).alias("all"))
    kept = kept.where((F.col("all") >= TEMPLATE_PAGES) & (F.col("same") >= TEMPLATE_SAME * F.col("all"))).select("template", F.lit(True).alias("running"))
    judged = by_file.join(sizes, "file_id").join(wide, "key", "left").join(kept, "template", "left")
    enough = F.col("on") >= F.when(F.col("title"), HEADER_PAGES).otherwise(HEADER_PAGES + 1)
    few = enough & (F.col("a") != F.col("b")) & (F.col("on") >= HEADER_SHARE * F.col("pages"))
    return judged.where(few | F.col("wide") | (F.col("running") & F.col("title"))).select("file_id", "key", few.alias("few"))


def _grams(key: Column) -> Column:
    """The signature of a key: so many of its three-letter parts, in the order of their hashes, that keys within HEADER_EDITS share one.

    Keys of n letters with e = HEADER_EDITS * n edits share at least n - 2 - 3 e parts, so one of all but that many, less one.
    """
    parts = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(key) - 2)), lambda i: F.xxhash64(F.substring(key, i, F.lit(3))))))
    return F.slice(parts, 1, F.least(F.size(parts), (F.ceil(3 * HEADER_EDITS / (1 - HEADER_EDITS) * F.length(key)) + 1).cast("int")))


def altered(lines: DataFrame, known: DataFrame, many: int = MANY) -> DataFrame:
    """(file_id, key) of the lines that are a header of their file, the same or altered.

    Headers on a share of a file's pages are few, so every other line of the file is compared with each of them, and so with
    others where a file has no more than MANY of these.  Where it has more, they meet the lines that share a part of their
    signature, with the same result.
    """
    near = (F.abs(F.length("key") - F.length("of")) <= HEADER_EDITS * F.length("of")) & (F.levenshtein("key", "of") <= HEADER_EDITS * F.length("of"))
    same = lines.join(known.select("file_id", "key"), ["file_id", "key"], "left_semi")
    open_ = cut(lines.join(known.select("file_id", "key"), ["file_id", "key"], "left_anti"))
    large = cut(known.where("not coalesce(few, false)").groupBy("file_id").agg(F.count("*").alias("n")).where(F.col("n") > many).select("file_id"))
    of = known.withColumnRenamed("key", "of").join(large.withColumn("_large", F.lit(True)), "file_id", "left").withColumn("few", F.coalesce("few", F.lit(False)) | F.col("_large").isNull())
    by_few = open_.join(of.where("few").select("file_id", "of"), "file_id").where(near).select("file_id", "key")
    rest = of.where("not few").select("file_id", "of", F.explode(_grams(F.col("of"))).alias("g"))
    by_many = open_.join(large, "file_id", "left_semi").select("file_id", "key", F.explode(_grams(F.col("key"))).alias("g")).join(rest, ["file_id", "g"]).where(near).select("file_id", "key")
    return same.unionByName(by_few).unionByName(by_many).distinct()


def edge_noise(pages: DataFrame) -> DataFrame:
    """Edge lines that are headers or page numbers: layer_id, file_id, page_index, place, depth, line, context, header, page_number."""
    edge = cut(edges(pages))
    known = cut(headers(edge, pages))
    lines = edge.where("key is not null").select("file_id", "key").distinct()
    close = altered(lines, known).withColumn("header", F.lit(True))
    marked = edge.join(close, ["file_id", "key"], "left").withColumn("header", F.coalesce("header", F.lit(False)))
    marked = marked.withColumn("page_number", F.col("number") | (F.col("inside") & F.col("header"))).where("header or page_number")
    noise = cut(marked.select("layer_id", "file_id", "page_index", "place", "depth", "line", "context", "header", "page_number"))
    # a line further in is noise only behind noise
    side = ["layer_id", "place"]
    deep = noise.where("depth >= 2").withColumn("_k", F.row_number().over(W.partitionBy(*side).orderBy("depth")))
    outer = noise.where("depth < 2").join(deep.select(*side).distinct(), side, "left_semi").groupBy(*side).agg(F.count("*").alias("_n")).where("_n = 2").select(*side)
    deep = deep.where(F.col("_k") == F.col("depth") - 1).join(outer, side, "left_semi").drop("_k")
    return noise.where("depth < 2").unionByName(deep)


def word_noise(rows: DataFrame, vocab: DataFrame, fixes: DataFrame) -> DataFrame:
    """rows: field_name, rec_id, text.  Cases of the kinds hyphen and misread: field_name, rec_id, noise_kind, word, correction."""
    common = frequent(vocab.select("word", F.col("whole").alias("cnt")), FREQUENT_SHARE)
    fixes = cut(fixes)
    # an error that recurs is frequent itself; as few as common words have a correction
    recurring = fixes.join(vocab.where(F.col("cnt") >= min(common.values(), default=float("inf"))), "word", "left_semi").select("word").toPandas()["word"]
    skip = frozenset(common).difference(recurring)

    def one(field_name, rec_id, text):
        if not text:
            return
        for left, right in set(broken(text)):
            whole, parted = (left + right).lower(), f"{left}-{right}".lower()
            a, b = common.get(whole), common.get(parted)
            if a and a > 3 * (b or 0):
                yield field_name, rec_id, "hyphen", parted, whole, None
            elif not b or a:
                yield field_name, rec_id, "parted", parted, whole, right.lower() in ENCLITICS
            # the hyphenated form is the frequent one: the word's own hyphen
        if any(h in text for h in _HYPHENS):
            text = rejoin(text)
        words = text.split()
        if field_name == "summary" and words and words[-1].isalnum() and len(words[-1]) < 4:
            words.pop()  # it may be the beginning of a longer word, cut off
        unknown = {normal(t) for t in set(words)}
        for w in unknown:
            if w and w not in skip:
                yield field_name, rec_id, "word", w, None, None

    schema = "field_name string, rec_id bigint, noise_kind string, word string, correction string, clitic boolean"
    found = cut(arrow_pass(rows.select("field_name", "rec_id", "text"), one, schema))
    sure = found.where("noise_kind = 'hyphen'").select("field_name", "rec_id", "noise_kind", "word", "correction")
    counts = vocab.where("whole > 0").select("word", F.col("whole").alias("cnt"))
    open_ = found.where("noise_kind = 'parted'")
    open_ = open_.join(counts.select("word", F.col("cnt").alias("as_parted")), "word", "left").join(counts.select(F.col("word").alias("correction"), F.col("cnt").alias("as_whole")), "correction", "left")
    whole, parted = F.coalesce("as_whole", F.lit(0)), F.coalesce("as_parted", F.lit(0))
    judged = open_.where(F.when(whole + parted > 0, whole > parted).otherwise(~F.col("clitic"))).select("field_name", "rec_id", F.lit("hyphen").alias("noise_kind"), "word", "correction")
    misread = found.where("noise_kind = 'word'").select("field_name", "rec_id", "word").join(fixes, "word").select("field_name", "rec_id", F.lit("misread").alias("noise_kind"), "word", "correction")
    return sure.unionByName(judged).unionByName(misread)


def texts(pages: DataFrame, audit: DataFrame) -> DataFrame:
    a = pages.select(F.lit("ocr_text").alias("field_name"), F.col("layer_id").cast("bigint").alias("rec_id"), F.col("ocr_text").cast("string").alias("text"))
    b = audit.select(F.lit("summary").alias("field_name"), F.col("audit_id").cast("bigint").alias("rec_id"), F.col("summary").cast("string").alias("text"))
    return a.unionByName(b).where(F.col("text").isNotNull())


def edge_cases(pages: DataFrame, audit: DataFrame, files: DataFrame) -> DataFrame:
    """field_name, rec_id, noise_kind, place, depth, line: headers and page numbers of pages, and of the summaries that hold them whole."""
    noise = cut(edge_noise(pages))
    kinds = F.explode(F.filter(F.array(F.when(F.col("header"), "header"), F.when(F.col("page_number"), "page_number")), lambda x: x.isNotNull())).alias("noise_kind")
    on_pages = noise.select(F.lit("ocr_text").alias("field_name"), F.col("layer_id").alias("rec_id"), kinds, "place", "depth", "line")
    where = files.select(F.col("file_id").cast("string").alias("file_id"), F.col("input_path").cast("string").alias("input_path")).where("input_path is not null").distinct()
    summaries = audit.select(F.col("audit_id").cast("bigint").alias("rec_id"), F.col("input_file").cast("string").alias("input_path"), (F.col("page").cast("int") - 1).alias("page_index"), F.col("summary").cast("string").alias("summary")).where("summary is not null")
    carried = noise.select("file_id", "page_index", "place", "depth", "line", "context", "header", "page_number").distinct().join(where, "file_id")
    held = F.when(F.col("place") == "top", F.startswith("summary", "context")).otherwise(F.endswith("summary", "context"))
    on_summaries = summaries.join(carried, ["input_path", "page_index"]).where(held & (F.length("context") > 0)).select(F.lit("summary").alias("field_name"), "rec_id", kinds, "place", "depth", "line")
    return on_pages.unionByName(on_summaries)


def found(pages: DataFrame, audit: DataFrame, files: DataFrame) -> DataFrame:
    """One row per record, field and kind of noise present: field_name, rec_id, noise_kind."""
    vocab = cut(vocabulary(pages))
    words = word_noise(texts(pages, audit), vocab, corrections(vocab)).select("field_name", "rec_id", "noise_kind")
    lines = edge_cases(pages, audit, files).select("field_name", "rec_id", "noise_kind")
    return words.unionByName(lines).distinct()


_ITEM = re.compile(r"[ \t]*\n[ \t]*(?!(?:[-–—•*▪]|\(?\d{1,3}[.)]|\(?[a-z]\))[ \t])")


def reflow(text: str, gone: list[tuple[str, int]], fixes: dict[str, str], joins: set[str]) -> str:
    """The text without the lines in gone (place, depth), words joined and corrected, lines of a paragraph in one.

    An item of a list keeps its line.
    """
    if gone:
        lines = text.split("\n")
        at = [k for k, x in enumerate(lines) if x.strip()]
        out = {at[depth] if place == "top" else at[-1 - depth] for place, depth in gone if depth < len(at)}
        text = "\n".join(x for k, x in enumerate(lines) if k not in out)

    def join(m: re.Match) -> str:
        return m[1] if f"{m[1]}-{m[3]}".lower() in joins else m[1] + "-"

    text = _BREAK.sub(join, text)
    if fixes:
        text = re.sub(r"\S+", lambda m: _corrected(m[0], fixes), text)
    paragraphs = [_ITEM.sub(" ", p.strip()) for p in re.split(r"\n\s*\n", text)]
    return "\n\n".join(p for p in paragraphs if p)


#: The digits that letters and signs in FOR_DIGITS stand for.
_AS_DIGITS = str.maketrans(FOR_DIGITS, "000011111558226699")


def _corrected(token: str, fixes: dict[str, str]) -> str:
    w = normal(token)
    to = fixes.get(w) if w else None
    if to is None:
        return token
    core = token.strip(_EDGE)
    if w.lower() != core.lower():  # a number: the correction's letters and signs, its own digits
        if len(to) != len(core):
            return token
        to = "".join(c.translate(_AS_DIGITS) if x == "0" else x for c, x in zip(core, to))
    elif core[:1].isupper():
        to = to.upper() if core.isupper() and len(core) > 1 else to[:1].upper() + to[1:]
    return token.replace(core, to, 1)


def repaired(pages: DataFrame, audit: DataFrame, files: DataFrame) -> DataFrame:
    """Every OCR text and summary as continuous paragraphs: field_name, rec_id, text, repaired.

    A record's corrections are gathered by record only; a record has no more of them than words.
    """
    vocab = cut(vocabulary(pages))
    rows = texts(pages, audit)
    key = ["field_name", "rec_id"]
    words = word_noise(rows, vocab, corrections(vocab)).groupBy(*key).agg(F.collect_set(F.struct("noise_kind", "word", "correction")).alias("words"))
    lines = edge_cases(pages, audit, files).groupBy(*key).agg(F.collect_set(F.struct("place", "depth", "line")).alias("lines"))

    def one(field_name, rec_id, text, words, lines):
        words = words or []
        fixes = {w["word"]: w["correction"] for w in words if w["noise_kind"] == "misread"}
        joins = {w["word"] for w in words if w["noise_kind"] == "hyphen"}
        lines = sorted(lines or [], key=lambda x: x["depth"])
        if field_name == "summary":  # one line: what stands outermost goes first
            for x in lines:
                line = x["line"]
                if x["place"] == "top" and text.startswith(line):
                    text = text[len(line) :].lstrip()
                elif x["place"] == "bottom" and text.endswith(line):
                    text = text[: -len(line)].rstrip()
            lines = []
        yield field_name, rec_id, text, reflow(text, [(x["place"], x["depth"]) for x in lines], fixes, joins)

    joined = rows.join(words, key, "left").join(lines, key, "left").select(*key, "text", "words", "lines")
    return arrow_pass(joined, one, "field_name string, rec_id bigint, text string, repaired string")
