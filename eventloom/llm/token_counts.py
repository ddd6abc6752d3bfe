"""Token counts with a byte-level BPE: texts go through Arrow batches of about equal bytes, only lengths come back.

Every text is split at safe boundaries: before a single space between two characters that are not white space. The
vocabulary's pre-tokenizer never joins characters across such a place (only white space may lead a token there, and
then only the one space), and no special token holds white space, so the lengths of the pieces add up to the length of
the text. Pieces repeat, so each is encoded once per worker while it stays in a bounded table.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from eventloom.llm.common import batches_of_texts, text_or_empty

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_UNSAFE = re.compile(r"\s | \s|\A | \Z")

#: Entries and length of what a worker remembers; beyond, the table starts anew.
MEMO_ENTRIES, MEMO_CHARS = 600_000, 40
_tables: dict[str, tuple[object, dict[str, int]]] = {}


def _tokenizer(file: str) -> tuple[object, dict[str, int]]:
    if file not in _tables:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _tables[file] = tokenizer, {}
    return _tables[file]


def _lengths(tokenizer, texts: list[str]) -> list[int]:
    return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def pieces(text: str) -> list[str]:
    """The text cut at its safe boundaries; the space before each piece but the first is left out."""
    return _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")


def count_tokens(texts: list[str], file: str) -> list[int]:
    """Numbers of tokens without begin, end or added tokens."""
    tokenizer, memo = _tokenizer(file)
    if len(memo) > MEMO_ENTRIES:
        memo.clear()
    cut = [pieces(t) for t in texts]
    firsts = _lengths(tokenizer, [c.pop(0) for c in cut])
    new = list(set().union(*cut).difference(memo))
    counts = dict(zip(new, _lengths(tokenizer, [" " + p for p in new])))
    long = {p: n for p, n in counts.items() if len(p) > MEMO_CHARS}
    memo.update((p, n) for p, n in counts.items() if p not in long)
    if long:
        look = lambda p: long[p] if p in long else memo[p]
        return [n + sum(map(look, c)) for n, c in zip(firsts, cut)]
    return [n + sum(map(memo.__getitem__, c)) for n, c in zip(firsts, cut)]


def token_counts(docs: DataFrame, file: str = "byte_bpe_50k.json", limit: int = 512, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit. Null text is empty and has no tokens."""

    def lengths(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            found: list[int] = []
            for at, end in batches_of_texts(part.str.len().to_numpy()):
                found += count_tokens(part.iloc[at:end].tolist(), file)
            yield pd.Series(found, dtype="int64")

    counted = F.pandas_udf(lengths, "long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("content"))
    out = rows.select("doc_id", F.octet_length("content").cast("long").alias("n_bytes"), counted("content").alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
