"""Token counts by a public byte-pair tokenizer, exact, with a cache over blank-separated units.

Where a text has no two white-space characters of which one follows or precedes a blank, the tokenizer's own splitter
cuts it before every blank, so the count is the sum over the units, and frequent units are looked up instead of encoded.
Any other text is encoded whole.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.plans.runtime import spread

#: The folder of tokenizer files; ``tokenizer_path`` parameters take precedence.
TOKENIZER_DIR = "/opt/tokenizers"
DEFAULT_TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern by which the public byte-level vocabularies split text.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units in the cache at most; it is emptied when full, which changes no count.
CACHE_UNITS = 500_000

_JOINED = re.compile(r"\s \s| \s|\s\Z")


def default_tokenizer() -> str:
    return os.path.join(TOKENIZER_DIR, DEFAULT_TOKENIZER)


def load(tokenizer_path: str):
    import tiktoken

    with open(tokenizer_path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Counts the tokens of texts; one per task."""

    def __init__(self, tokenizer_path: str) -> None:
        self.encode = load(tokenizer_path).encode_ordinary
        self.units: dict[str, int] = {}

    def __missing(self, unit: str) -> int:
        if len(self.units) >= CACHE_UNITS:
            self.units.clear()
        n = self.units[unit] = len(self.encode(unit))
        return n

    def count(self, text: str) -> int:
        if " " not in text or _JOINED.search(text):
            return len(self.encode(text))
        first, *rest = text.split(" ")
        units, total = self.units, len(self.encode(first)) if first else 0
        for word in rest:
            unit = " " + word
            n = units.get(unit)
            total += self.__missing(unit) if n is None else n
        return total


def token_counts(df: DataFrame, text_col: str, keep: list[str], tokenizer_path: str | None = None) -> DataFrame:
    """The ``keep`` columns and ``n_tokens``. Null and empty texts are left out; a blank text has tokens."""
    path = tokenizer_path or default_tokenizer()
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            counts = pa.array([counter.count(t) for t in batch.column(n).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], counts], names=[*keep, "n_tokens"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    given = df.select(*keep, F.col(text_col)).where(F.length(text_col) > 0)
    return spread(given).mapInArrow(run, f"{schema}, n_tokens bigint")
