"""Reconciling a page's native and OCR layers: which lines are already there, which text is kept."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ..functions import text as T
from .quality import MIN_CHARS, analysis, with_quality

HEADING = "### Conteúdo adicional detectado por OCR"
RUN_SHARE, SIMILAR, BAG_SHARE = 0.82, 0.90, 0.90

_LINE_END = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
_NOT_WORD = re.compile(r"[^\w]+")


def normal(text: str | None) -> str:
    """Compatibility form without case and combining marks, everything between words one blank."""
    t = unicodedata.normalize("NFKD", text or "").casefold()
    return _NOT_WORD.sub(" ", "".join(c for c in t if not unicodedata.combining(c))).strip()


@F.pandas_udf(StringType())
def normal_udf(text: pd.Series) -> pd.Series:
    return text.map(normal)


def longest_run(a: list[str], b: list[str]) -> int:
    """Length of the longest run of tokens of a that b has."""
    at: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        at.setdefault(w, []).append(j)
    best, before = 0, {}
    for w in a:
        now = {j: before.get(j - 1, 0) + 1 for j in at.get(w, ())}
        best = max(best, max(now.values(), default=0))
        before = now
    return best


class NativeLayer:
    """What a page's native text offers for comparison, prepared once per page."""

    def __init__(self, text: str):
        self.flat = normal(text)
        self.compact = self.flat.replace(" ", "")
        self.tokens = self.flat.split()
        self.lines = [n for n in map(normal, _LINE_END.split(text)) if n]
        self.short = frozenset(self.lines)
        self.runs: Runs | None = None

    def longest(self, tokens: list[str]) -> int:
        if len(self.tokens) <= 500:
            return longest_run(tokens, self.tokens)
        self.runs = self.runs or Runs(self.tokens)
        return self.runs.longest(tokens)

    def has(self, n: str) -> bool:
        """A normalized line is there already: whole, without its blanks, as a long run of tokens, or much alike.

        Cheap tests come first; similarity is only measured between lines of nearly one length.
        """
        if n == self.flat or (len(n) >= 8 and n in self.flat) or n in self.short:
            return True
        compact = n.replace(" ", "")
        if len(compact) >= 12 and compact in self.compact:
            return True
        tokens = n.split()
        if len(tokens) >= 4 and self.longest(tokens) / len(tokens) >= RUN_SHARE:
            return True
        if len(n) < 12:
            return False
        band = SIMILAR / (2 - SIMILAR)  # below this ratio of lengths the similarity cannot be reached
        for e in self.lines:
            if len(e) >= 12 and min(len(n), len(e)) >= band * max(len(n), len(e)):
                m = SequenceMatcher(None, n, e)
                if m.real_quick_ratio() >= SIMILAR and m.quick_ratio() >= SIMILAR and m.ratio() >= SIMILAR:
                    return True
        return False


def merge_layers(native: str | None, ocr: str | None) -> str:
    """The native text, with what only the OCR has under a heading; a null or blank side gives the other."""
    native, ocr = (native or "").strip(), (ocr or "").strip()
    if not native or not ocr:
        return native or ocr
    layer, extra, seen = NativeLayer(native), [], set()
    for line in _LINE_END.split(ocr):
        n = normal(line)
        if n and n not in seen and not layer.has(n):
            extra.append(line.strip())
            seen.add(n)
    tokens = normal(" ".join(extra)).split()
    if len(tokens) >= 8:
        shared = Counter(tokens) & Counter(layer.tokens)
        if shared.total() / len(tokens) >= BAG_SHARE:
            return native
    return f"{native}\n\n{HEADING}\n\n" + "\n".join(extra) if extra else native


@F.pandas_udf(StringType())
def merge_udf(native: pd.Series, ocr: pd.Series) -> pd.Series:
    return pd.Series([merge_layers(a, b) for a, b in zip(native, ocr, strict=True)], dtype=object)


@F.pandas_udf(DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """The similarity of two lines; 1 for what is left out because it is equal."""
    return pd.Series([1.0 if x is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


#: A text's form for comparison: normal_udf, or T.simple_normal where SQL is to give the same.
Form = Callable[[Column], Column]


def line_rows(df: DataFrame, key: list[str], text: str, form: Form = normal_udf) -> DataFrame:
    """key..., line_no, line, norm: one row per line that is not blank, in its form for comparison."""
    rows = df.select(*key, F.posexplode(T.lines(F.col(text))).alias("line_no", "line"))
    return rows.withColumn("norm", form(F.col("line"))).where("norm <> ''")


def contained(df: DataFrame, key: list[str], native: str, ocr: str, form: Form = normal_udf) -> DataFrame:
    """OCR lines with contained: whether the page's native text has the line, whole or without its blanks.

    Both texts are in the page's row, so there is no join.
    """
    flat = df.select(*key, form(F.col(native)).alias("flat"), F.col(ocr).alias("_ocr"))
    rows = line_rows(flat.withColumn("compact", F.replace("flat", F.lit(" "), F.lit(""))), [*key, "flat", "compact"], "_ocr", form)
    squeezed = F.replace("norm", F.lit(" "), F.lit(""))
    hit = (F.col("norm") == F.col("flat")) | ((F.length("norm") >= 8) & F.col("flat").contains(F.col("norm"))) | ((F.length(squeezed) >= 12) & F.col("compact").contains(squeezed))
    return rows.select(*key, "line_no", "norm", hit.alias("contained"))


class Runs:
    """All runs of tokens of a text, as a suffix automaton: built and asked in time linear in the tokens, also where one recurs often."""

    def __init__(self, tokens: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in tokens:
            now = self._add({}, 0, self.length[last] + 1)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[p] + 1 < self.length[q]:
                    copy = self._add(dict(self.next[q]), self.link[q], self.length[p] + 1)
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = copy
                        p = self.link[p]
                    self.link[q] = q = copy
                self.link[now] = q
            last = now

    def _add(self, edges: dict[str, int], link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def longest(self, tokens: list[str]) -> int:
        """Length of the longest run of the tokens that the text has."""
        state = n = best = 0
        for w in tokens:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
                best = max(best, n)
        return best


def token_runs(df: DataFrame, key: list[str], native: str, ocr: str, form: Form = normal_udf) -> DataFrame:
    """key..., line_no, tokens, run: the longest run of a line's tokens in the native text.

    Both texts are in the page's row: one pass without a join, linear in a page's tokens.
    """
    import pyarrow as pa

    lines = T.lines(F.col(ocr))
    own = form is not normal_udf
    rows = df.select(*key, (form(F.col(native)) if own else T.raw(F.col(native))).alias("_n"), (F.transform(lines, form) if own else lines).alias("_l"))
    schema = rows.select(*key, F.lit(0).alias("line_no"), F.lit(0).cast("bigint").alias("tokens"), F.lit(0).cast("bigint").alias("run")).schema

    def run(batches):
        for b in batches:
            at: list[int] = []
            out: list[tuple[int, int, int]] = []
            for i, (text, ls) in enumerate(zip(b.column("_n").to_pylist(), b.column("_l").to_pylist(), strict=True)):
                runs = None
                for no, line in enumerate(ls or ()):
                    if words := (line if own else normal(line)).split():
                        runs = runs or Runs((text if own else normal(text)).split())
                        at.append(i)
                        out.append((no, len(words), runs.longest(words)))
            cols = list(zip(*out)) or [(), (), ()]
            keys = [b.column(k).take(pa.array(at, pa.int64())) for k in key]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=[*key, "line_no", "tokens", "run"])

    return rows.mapInArrow(run, schema)


def bag_overlap(df: DataFrame, key: list[str], native: str, ocr: str, form: Form = normal_udf) -> DataFrame:
    """key..., tokens, shared: how many tokens of the OCR text the native one has, as bags."""

    def bag(column: str, name: str) -> DataFrame:
        words = df.select(*key, F.explode(F.split(form(F.col(column)), " ")).alias("w")).where("w <> ''")
        return words.groupBy(*key, "w").agg(F.count("*").alias(name))

    both = bag(ocr, "a").join(bag(native, "b"), [*key, "w"], "left")
    return both.groupBy(*key).agg(F.sum("a").alias("tokens"), F.sum(F.least("a", F.coalesce("b", F.lit(0)))).alias("shared"))


def equal_lines(df: DataFrame, key: list[str], native: str, ocr: str, form: Form = normal_udf) -> DataFrame:
    """key..., ocr_line_no, native_line_no: lines of a page that are the same in their form, by a join on it."""
    a = line_rows(df, key, ocr, form).select(*key, F.col("line_no").alias("ocr_line_no"), "norm")
    b = line_rows(df, key, native, form).select(*key, F.col("line_no").alias("native_line_no"), "norm")
    return a.join(b, [*key, "norm"]).where(F.length("norm") >= 12).select(*key, "ocr_line_no", "native_line_no")


#: Pairs of lines of a page up to which all are compared; lines of larger pages meet by their parts, with the same result.
PAIRS = 100_000


def _grams(text: Column) -> Column:
    """So many three-letter parts of a line, in the order of their hashes, that lines as alike as SIMILAR share one.

    An edit takes three parts away, and lines of n letters that are so much alike are less than n * e edits apart.
    """
    e = (1 - SIMILAR) * (1 + (2 - SIMILAR) / SIMILAR)
    parts = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.xxhash64(F.substring(text, i, F.lit(3))))))
    return F.slice(parts, 1, (F.ceil(3 * e * F.length(text)) + 1).cast("int"))


def similar_lines(df: DataFrame, key: list[str], native: str, ocr: str, pairs: int = PAIRS) -> DataFrame:
    """key..., ocr_line_no, native_line_no, ratio: pairs of lines of a page that are much alike.

    Pairs in a band of lengths and within the edit distance that the ratio allows are found in the JVM; only these reach
    Python, and equal lines are not measured there.
    """
    band = SIMILAR / (2 - SIMILAR)
    both = df.select(*key, F.size(T.lines(F.col(native))).cast("bigint").alias("_n"), F.size(T.lines(F.col(ocr))).cast("bigint").alias("_m"), F.col(native), F.col(ocr))
    near = (F.least(F.length("x"), F.length("y")) >= band * F.greatest(F.length("x"), F.length("y"))) & (
        (F.col("x") == F.col("y")) | (F.levenshtein("x", "y") <= (1 - SIMILAR) * (F.length("x") + F.length("y")) + 1e-9)
    )

    def sides(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
        a = line_rows(pages, key, ocr).select(*key, F.col("line_no").alias("ocr_line_no"), F.col("norm").alias("x")).where(F.length("x") >= 12)
        b = line_rows(pages, key, native).select(*key, F.col("line_no").alias("native_line_no"), F.col("norm").alias("y")).where(F.length("y") >= 12)
        return a, b

    a, b = sides(both.where(F.col("_n") * F.col("_m") <= pairs))
    close = a.join(b, key).where(near)
    c, d = sides(both.where(F.col("_n") * F.col("_m") > pairs))
    met = c.select("*", F.explode(_grams(F.col("x"))).alias("_g")).join(d.select("*", F.explode(_grams(F.col("y"))).alias("_g")), [*key, "_g"])
    close = close.unionByName(met.where(near).drop("_g").distinct())
    other = F.col("x") != F.col("y")
    out = close.withColumn("ratio", ratio_udf(F.when(other, F.col("x")), F.when(other, F.col("y"))))
    return out.where(F.col("ratio") >= SIMILAR).select(*key, "ocr_line_no", "native_line_no", "ratio")


def has_text(text: Column) -> Column:
    return T.strip(text) != ""


def chosen_source(native: Column, n: Column, ocr: Column, o: Column, force: Column, both: Column) -> Column:
    """Which text of a page is kept: "nativo", "ocr", "nativo+ocr" or "sem-texto".

    n and o are the layers' quality structs; a missing score counts as 0, a missing length is measured.
    """
    has_n, has_o = has_text(native), has_text(ocr)
    force, both = F.coalesce(force, F.lit(False)), F.coalesce(both, F.lit(False))
    n_score, o_score = F.coalesce(n["quality_score"], F.lit(0)), F.coalesce(o["quality_score"], F.lit(0))
    n_chars, o_chars = F.coalesce(n["char_count"], F.length(T.strip(native))), F.coalesce(o["char_count"], F.length(T.strip(ocr)))
    part = lambda x: (n_chars * F.lit(x)).cast("bigint")
    return (
        F.when((force | both) & has_n & has_o, "nativo+ocr")
        .when(force, F.when(has_o, "ocr").otherwise("nativo"))
        .when(~has_n & has_o, "ocr")
        .when(has_n & ~has_o, "nativo")
        .when(~has_n & ~has_o, "sem-texto")
        .when(F.coalesce(n["needs_ocr"], F.lit(False)), "ocr")
        .when((o_score >= n_score + 10) & (o_chars >= F.greatest(F.lit(20), part(0.55))), "ocr")
        .when((o_chars > part(1.35)) & (o_score + 3 >= n_score), "ocr")
        .otherwise("nativo")
    )


def reconcile(pages: DataFrame, native: str = "native_text", n: str = "native_analysis", ocr: str = "ocr_text", o: str = "ocr_analysis", force: str = "force_ocr", both: str = "preserve_both") -> DataFrame:
    """Adds source, text and analysis of each page.

    Only pages that keep both texts go through Python, and their merged text is scored anew with the default least length.
    """
    df = pages.withColumn("source", chosen_source(F.col(native), F.col(n), F.col(ocr), F.col(o), F.col(force), F.col(both)))
    one = df.where("source <> 'nativo+ocr'").withColumn("text", F.when(F.col("source") == "ocr", F.col(ocr)).otherwise(T.raw(F.col(native))))
    two = df.where("source = 'nativo+ocr'").withColumn("text", merge_udf(F.col(native), F.col(ocr)))
    out = with_quality(one.unionByName(two), "text", "_q_", MIN_CHARS).withColumn("analysis", analysis("_q_"))
    return out.drop(*[c for c in out.columns if c.startswith("_q_")])
