"""Sizes of texts in tokens of a public tokenizer; the vocabulary file's place is a parameter."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the executors find the vocabulary.
VOCABULARY = os.environ.get("FOLIANT_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: the pattern byte-level BPE vocabularies of this family were made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: About as many characters are given to the tokenizer at once; a text is parted only before a blank behind another sign,
#: where the pattern parts it in any case, so the count is that of the whole text.
LONGEST = 100_000
_PARTING = re.compile(r"(?<=\S)[ \n]")


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > LONGEST and (m := _PARTING.search(text, at + LONGEST)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def count(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of a text; none for a null or empty one."""
    if not text:
        return 0
    enc = encoding(path)
    return sum(len(enc.encode_ordinary(part)) for part in parts(text))


def with_sizes(rows: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The rows' other columns and n_tokens; the text itself goes no further."""
    import pyarrow as pa

    keep = [c for c in rows.columns if c != text]
    schema = rows.select(*keep, F.lit(0).cast("int").alias("n_tokens")).schema

    def run(batches):
        for b in batches:
            sizes = [count(t, path) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sizes, pa.int32())], names=[*keep, "n_tokens"])

    return rows.mapInArrow(run, schema)
