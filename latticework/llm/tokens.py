"""Sizes of texts in tokens of a public byte-level vocabulary; whole texts are encoded.

The vocabulary is read where it lies (``vocabulary`` names the file) once per Python worker.
Null and empty texts have no tokens. Texts are passed over in batches, never row by row.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame

from latticework.session import spread

#: Default vocabulary file; every operator that counts tokens takes another as a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how byte-level vocabularies of this kind cut a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Characters from which on a text is cut for the encoder, at the next place that no word of PATTERN spans, so that a cut adds no token.
RUN = 50_000
#: Before a blank between two characters that are none, and between an ASCII letter and a digit.
CUT = re.compile(r"(?<=\S)(?= \S)|(?<=[A-Za-z])(?=[0-9])")


@cache
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    """The text in runs that are cheap to encode, each of whole words; one that has no place to cut stays whole."""
    at = 0
    while len(text) - at > RUN:
        m = CUT.search(text, at + RUN)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def count(text: str | None, vocabulary: str = VOCABULARY) -> int:
    return sum(len(encoder(vocabulary).encode_ordinary(p)) for p in pieces(text)) if text else 0


def sizes(documents: DataFrame, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, *keep) of every document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["n_tokens"] = [count(t, vocabulary) for t in f["text"]]
            yield f[["doc_id", "n_tokens", *keep]]

    form = "doc_id long, n_tokens long" + "".join(f", {c} {documents.schema[c].dataType.simpleString()}" for c in keep)
    return spread(documents.select("doc_id", "text", *keep)).mapInPandas(run, form)
