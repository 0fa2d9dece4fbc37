"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the tokenizer files and the file used, unless the caller names others.
FOLDER, RANKS = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Words to the tokenizer's usual pre-tokens.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_HEAD = re.compile(r"\n[ \t]*\n")


def encoder(folder: str = FOLDER, name: str = RANKS):
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(documents: DataFrame, folder: str = FOLDER, name: str = RANKS) -> DataFrame:
    """doc_id, source, tokens, loss_tokens and letters (share of letters among characters) of each document.

    ``loss_tokens``: of a text with several paragraphs the first is read as the instruction and the rest as
    what is learned; of other texts all tokens bear loss.  Null and blank texts have 0 tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for b in batches:
            tokens, loss, letters = [], [], []
            for text in b[2].to_pylist():
                t = (text or "").strip()
                head = _HEAD.search(t)
                first = len(enc.encode_ordinary(t[: head.start()])) if head else 0
                rest = len(enc.encode_ordinary(t[head.start() :] if head else t)) if t else 0
                tokens.append(first + rest)
                loss.append(rest)
                letters.append(sum(map(str.isalpha, t)) / len(t) if t else 0.0)
            yield pa.RecordBatch.from_arrays([b[0], b[1], pa.array(tokens, pa.int32()), pa.array(loss, pa.int32()), pa.array(letters, pa.float64())], names=["doc_id", "source", "tokens", "loss_tokens", "letters"])

    return documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, source string, tokens int, loss_tokens int, letters double")
