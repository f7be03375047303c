"""Sizes of texts in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The vocabulary's file; it must lie at this path on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The public pre-tokenizer pattern of this vocabulary without its look-ahead for trailing blanks, and
# the white space that it means. The look-ahead makes matching several times slower; cutting the text before the
# last white-space character of a run that a word follows has the same effect.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_BLANK = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_CUT = re.compile(f"(?<=[{_BLANK}])(?=[{_BLANK}][^{_BLANK}])")
_TURN = re.compile(r"\n?## T\d+ \[[^\]\n]*\] (\w+)")


@functools.cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def measure(text: str | None, path: str = TOKENIZER) -> tuple[int, int, int]:
    """(tokens, segments, loss-bearing tokens) of a text.

    A rendered transcript has a segment for each turn (and one for a preamble), and its assistant turns bear loss; any
    other text is one segment that bears loss as a whole. Null and empty texts have 0 of each.
    """
    if not text:
        return 0, 0, 0
    encode, total, loss, segments, bears = _encoding(path).encode_ordinary, 0, 0, 0, None
    for piece in _CUT.split(text):
        n = len(encode(piece))
        if turn := _TURN.match(piece):
            bears, segments = turn[1].lower() == "assistant", segments + 1 + (bears is None and total > 0)
        total += n
        loss += n if bears else 0
    return (total, 1, total) if bears is None else (total, segments, loss)


def sizes(text: Column, path: str = TOKENIZER) -> Column:
    """A struct of tokens, segments and loss for each text."""

    @F.pandas_udf("tokens long, segments long, loss long")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t, path) for t in texts], columns=["tokens", "segments", "loss"], dtype="int64")

    return run(text)
