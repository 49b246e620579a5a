"""Cutting texts into overlapping chunks."""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE, OVERLAP = 512, 50
SEPARATORS = ("\n\n", "\n", " ", "")


def fixed_chunks(df: DataFrame, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Rows of df with chunk_idx and chunk: windows of `size` characters, each `overlap` into the last one."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step))
    chunk = lambda i: F.substring(F.col(text), (i * step + 1).cast("int"), F.lit(size))
    chunks = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), chunk)
    return df.where(F.length(text) > 0).select("*", F.posexplode(chunks).alias("chunk_idx", "chunk"))


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces at the first separator that occurs, joined up to `size` characters with `overlap` carried over; pieces that are too long are cut at the next separators."""
    at = next((k for k, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, finer = separators[at], separators[at + 1 :]
    pieces = [p for p in (text.split(mark) if mark else list(text)) if p]
    out: list[str] = []
    run: deque[str] = deque()
    held = 0  # characters of run, joined by marks

    def longer(piece: str) -> int:
        return held + len(piece) + (len(mark) if run else 0)

    def flush() -> None:
        joined = mark.join(run).strip()
        if joined:
            out.append(joined)

    for piece in pieces:
        if len(piece) > size and finer:
            flush()
            run, held = deque(), 0
            out += split_text(piece, size, overlap, finer)
            continue
        if run and longer(piece) > size:
            flush()
            while run and (held > overlap or longer(piece) > size):
                held -= len(run.popleft()) + (len(mark) if run else 0)
        held = longer(piece)
        run.append(piece)
    flush()
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def recursive_chunks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: split_text(t) if t else [])


def token_chunks(df: DataFrame, tokens: str, size: int, stride: int) -> DataFrame:
    """Rows of df with chunk_idx and chunk: windows of `size` tokens, each beginning `stride` after the last; none without tokens."""
    n = F.greatest(F.lit(1), F.ceil((F.size(tokens) - (size - stride)) / stride))
    windows = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.slice(F.col(tokens), (i * stride + 1).cast("int"), F.lit(size)))
    return df.where(F.size(tokens) > 0).select(*(c for c in df.columns if c != tokens), F.posexplode(windows).alias("chunk_idx", "chunk"))


def tokenized(text: Column, path: str, special: bool = False) -> Column:
    """The token ids of a text by a tokenizers file, read once a worker; none for null."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        found = _tokenizer(path).encode_batch([t or "" for t in texts], add_special_tokens=special)
        return pd.Series([None if t is None else e.ids for t, e in zip(texts, found, strict=True)])

    return encode(text)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def chunk_id(doc_id: Column, index: Column) -> Column:
    """The same id for the same chunk at every run."""
    return F.sha2(F.concat_ws(":", doc_id.cast("string"), index.cast("string")), 256)
