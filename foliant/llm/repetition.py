"""Problem 5: repetition inside a single document.

Weak supervision.  Rules look at one layer each and vote "repetitive", "not
repetitive" or abstain.  Expectation-maximisation over the counts of the vote
patterns of all layers estimates each rule's accuracy without labels, and a
layer's posterior probability replaces a filter that every rule must pass.

Defined results: a null layer gives no row, one of under two words the share 0;
equal layers get equal shares; an empty table gives an empty result; columns
other than the named ones are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SCAN_FOLD, SCAN_JOINED, cut, layer_rows

#: The share of repeated words that makes the first rule vote for repetition.
SHARE = 0.4
#: Layers whose posterior probability reaches this are repetitive.
POSTERIOR = 0.5
#: Weight of what is held of a rule before it is seen, as a share of all layers.
PRIOR_WEIGHT = 0.005

_BREAK = re.compile(r"(?<=[^\W\d_])[-=¬‐\u00ad][ \t]*\n[ \t]*(?=[^\W\d_])")
_NUMBER = re.compile(r"(?<!\w)[OolISBZ]{0,2}\d[\dOolISBZ.,/]*(?!\w)")
_END = re.compile(rb"[.!?;\n]+\s*")
#: What is left of a number.
_ZERO = "\xd8"
#: Below U+3000 all but letters, digits and blanks goes; shapes a scanner mixes up come together.
_COMPARE = {i: None for i in range(0x3000) if not (chr(i).isalnum() or chr(i).isspace())} | {ord("_"): None, 0xFEFF: None, 0xA0: " ", ord(_ZERO): _ZERO} | SCAN_FOLD | {ord("!"): None}
_BYTE = bytes(ord(x) if isinstance(x := _COMPARE.get(i, chr(i)), str) and ord(x) < 256 else i for i in range(256))
_GONE = bytes(i for i in range(256) if i in _COMPARE and _COMPARE[i] is None)


def words(text: str) -> list:
    """Comparable words, one for each whitespace-separated word that has letters or digits; a number is one sign.

    They are bytes where the text fits in one byte a character, as bytes are compared faster.
    """
    if "\n" in text:
        text = _BREAK.sub("", text)
    text = _NUMBER.sub(_ZERO, text.lower())
    for a, b in SCAN_JOINED:
        if a in text:
            text = text.replace(a, b)
    try:
        return text.encode("latin-1").translate(_BYTE, _GONE).split()
    except UnicodeEncodeError:
        return text.translate(_COMPARE).split()


#: Two numbers in a row are no passage: the columns of a table.
_NUMBERS = ((_ZERO, _ZERO), (_ZERO.encode("latin-1"), _ZERO.encode("latin-1")))


def repeated_share(ws: list) -> float:
    """Share of the words that lie in a passage of two or more words that occurred before."""
    n = len(ws)
    if n < 2:
        return 0.0
    pairs = list(zip(ws, ws[1:]))
    if len(set(pairs)) == n - 1:
        return 0.0
    seen: dict[tuple, int] = {}
    covered = bytearray(n)
    for i, pair in enumerate(pairs):
        first = seen.setdefault(pair, i)
        if first < i and pair not in _NUMBERS and (first < i - 1 or pair[0] == pair[1]):
            covered[i] = covered[i + 1] = 1
    return sum(covered) / n


def votes(text: str, ws: list, share: float) -> tuple[int, ...]:
    """1 repetitive, 0 not, -1 abstains; one vote per rule."""

    def rule(x: float, low: float, high: float) -> int:
        return 1 if x >= high else 0 if x <= low else -1

    n = len(ws)
    if n < 8:
        return (rule(share, 0.3, SHARE), -1, -1, -1)
    raw = text.lower().encode()
    parts = [p for p in _END.split(raw) if len(p) > 8]
    again = 1 - len(set(parts)) / len(parts) if len(parts) > 2 else None
    squeezed = len(zlib.compress(raw, 1)) / len(raw)
    kinds = len(set(ws)) / n
    return (
        rule(share, 0.25, SHARE),
        -1 if again is None else rule(again, 0.1, 0.3),
        rule(-squeezed, -0.5, -0.3),
        rule(-kinds, -0.6, -0.4),
    )


def fit(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[float, list[tuple[float, float]]]:
    """EM over pattern counts: prior, and each rule's rates of voting 1 given a repetitive and another layer.

    Rates are estimated with what was held before (0.8 and 0.1) as so many more votes, so none runs to 0 or 1; a rule that
    would be right less often than not is taken to say nothing.
    """
    rules = len(next(iter(patterns), ()))
    prior, rates = 0.1, [(0.8, 0.1)] * rules
    weight = max(1.0, PRIOR_WEIGHT * sum(patterns.values()))
    for _ in range(rounds):
        yes, total = 0.1 * weight, weight
        up = [[0.8 * weight, weight, 0.1 * weight, weight] for _ in range(rules)]  # votes of 1 and all, of either class
        for votes_, n in patterns.items():
            p = posterior(votes_, prior, rates) * n
            yes, total = yes + p, total + n
            for k, v in enumerate(votes_):
                if v >= 0:
                    up[k][0] += p * v
                    up[k][1] += p
                    up[k][2] += (n - p) * v
                    up[k][3] += n - p
        prior = yes / total
        rates = [(max(0.5, a / b), min(0.5, c / d)) for a, b, c, d in up]
    return prior, rates


def posterior(votes_: tuple[int, ...], prior: float, rates: list[tuple[float, float]]) -> float:
    a, b = prior, 1 - prior
    for v, (p, q) in zip(votes_, rates):
        if v >= 0:
            a *= p if v else 1 - p
            b *= q if v else 1 - q
    return a / (a + b)


def measure(pages: DataFrame) -> DataFrame:
    """Every present layer's repeated share and votes: field_name, layer_id, share, votes (comma-separated)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            shares, cast = [], []
            for t in b.column("text").to_pylist():
                ws = words(t)
                s = repeated_share(ws)
                shares.append(s)
                cast.append(",".join(map(str, votes(t, ws, s))))
            yield pa.RecordBatch.from_arrays([b.column("field_name"), b.column("layer_id"), pa.array(shares, pa.float64()), pa.array(cast, pa.string())], names=["field_name", "layer_id", "share", "votes"])

    return layer_rows(pages).select("field_name", "layer_id", "text").mapInArrow(run, "field_name string, layer_id bigint, share double, votes string")


def judged(pages: DataFrame) -> DataFrame:
    """Adds the posterior probability of being repetitive to every layer of every row.

    At most 3^4 vote patterns reach the driver.
    """
    measured = cut(measure(pages))
    counts = {tuple(map(int, r["votes"].split(","))): r["count"] for r in measured.groupBy("votes").count().collect()}
    prior, rates = fit(counts)
    table = [(",".join(map(str, v)), posterior(v, prior, rates)) for v in product((-1, 0, 1), repeat=4) if v in counts]
    spark = pages.sparkSession
    known = spark.createDataFrame(table, "votes string, posterior double")
    return measured.join(F.broadcast(known), "votes").select("field_name", "layer_id", "share", "posterior")


def repetitive(pages: DataFrame, least: float = POSTERIOR) -> DataFrame:
    """Layers that are more probably repetitive than not: field_name, layer_id."""
    return judged(pages).where(F.col("posterior") >= least).select("field_name", "layer_id")
