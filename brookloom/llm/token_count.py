"""Operator 7, token counts by rank-synchronous array merging.

The pre-tokens of a batch are held as ragged numpy arrays.  Each round finds the pair of lowest rank
of every sequence and merges it in all sequences at once; the symbols that survive are counted.  A
symbol outside the vocabulary counts one token for each of its UTF-8 bytes.

The vocabulary is a sentencepiece BPE model with byte fallback; its path is a parameter.  White space
is marked by U+2581 and a marker is put before the text, so no piece reaches from a word to the next
marker, and texts are cut there.  That property is checked when the model is loaded.

Within a sequence all occurrences of the lowest pair are merged in one round where that equals
merging from left to right one by one: no new neighbour ranks at or below the pair.  Where that
doesn't hold, and for sequences of over LONG symbols, a heap merges one pair at a time.

Defined cases: null and empty texts have no tokens; texts of any length are counted whole; repeated rows
are counted one by one; an empty table gives an empty one; an input column that has the name of an output
column is replaced.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns, texts_of

MARK = "▁"
#: Distinct pre-tokens that a Python worker remembers; it keeps the older half beyond.
CACHE = 600_000
#: Symbols of a pre-token beyond which a heap merges it alone.
LONG = 512
_CUT = re.compile(f"{MARK}+[^{MARK}]*")
_NONE = np.int64(1 << 40)


class PieceVocabulary:
    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        skip = [i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)]
        gone = set(skip)
        pieces = {model.id_to_piece(i): model.get_score(i) for i in range(size) if i not in gone}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece of this model spans words")
        ranks = {s: k for k, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.rank = {p: ranks[s] for p, s in pieces.items()}
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        self._build(pieces)

    def symbol(self, text: str) -> int:
        at = self.number.get(text)
        if at is None:
            at = self.number[text] = len(self.texts)
            self.texts.append(text)
        return at

    def _build(self, pieces: dict[str, float]) -> None:
        """All ways to make a piece of two symbols, as sorted keys for look-up in bulk."""
        for p in sorted(pieces):
            self.symbol(p)
        keys, ranks, made = [], [], []
        for p in pieces:
            for i in range(1, len(p)):
                a, b = p[:i], p[i:]
                if (len(a) == 1 or a in pieces) and (len(b) == 1 or b in pieces):
                    keys.append(self.symbol(a) << 24 | self.symbol(b))
                    ranks.append(self.rank[p])
                    made.append(self.number[p])
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = (np.array(x, np.int64)[order] for x in (keys, ranks, made))
        self.costs = np.array([1 if t in self.rank else len(t.encode()) for t in self.texts], np.int64)
        self.of_char = -np.repeat([1, 2, 3, 4], [0x80, 0x780, 0xF800, 0x100000])
        for t, at in self.number.items():
            if len(t) == 1:
                self.of_char[ord(t)] = at

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; _NONE for pairs that make no piece."""
        key = left << 24 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.made[at]

    def encode(self, texts: list[str]) -> np.ndarray:
        """The characters of all texts as symbols; minus its number of bytes for one of no piece, which joins no pair."""
        return self.of_char[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]

    def count_one(self, text: str) -> int:
        """Merge one sequence, a pair at a time, the leftmost of the lowest rank first."""
        symbols: list[str | None] = list(text)
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        heap: list[tuple[int, int, str, str]] = []

        def push(i: int, j: int) -> None:
            r = self.rank.get(symbols[i] + symbols[j])
            if r is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[j]))

        for i in range(len(symbols) - 1):
            push(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if symbols[i] is not None else len(symbols)
            if symbols[i] != a or j >= len(symbols) or symbols[j] != b:
                continue
            symbols[i], symbols[j] = a + b, None
            after[i] = after[j]
            if after[j] < len(symbols):
                before[after[j]] = i
                push(i, after[j])
            if before[i] >= 0:
                push(before[i], i)
        return sum(1 if s in self.rank else len(s.encode()) for s in symbols if s is not None)

    def count_many(self, texts: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        out = np.zeros(len(texts), np.int64)
        short = []
        for k, t in enumerate(texts):
            if len(t) > LONG:
                out[k] = self.count_one(t)
            else:
                short.append(k)
        if not short:
            return out.tolist()
        lengths = np.fromiter((len(texts[k]) for k in short), np.int64, len(short))
        symbols = self.encode([texts[k] for k in short])
        owner = np.repeat(np.arange(len(short)), lengths)
        done = np.zeros(len(short), np.int64)
        costs = self.costs

        def settle(symbols: np.ndarray, owner: np.ndarray) -> None:
            cost = np.where(symbols < 0, -symbols, costs[np.maximum(symbols, 0)])
            done[:] += np.bincount(owner, weights=cost, minlength=len(done)).astype(np.int64)

        alone: list[int] = []
        while len(symbols):
            rank = np.full(len(symbols), _NONE)
            made = np.zeros(len(symbols), np.int64)
            pair = (owner[1:] == owner[:-1]) & (symbols[1:] >= 0) & (symbols[:-1] >= 0)
            at = np.flatnonzero(pair)
            rank[at], made[at] = self.look(symbols[at], symbols[at + 1])
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(owner)])))
            lowest = np.minimum.reduceat(rank, starts)
            lowest_each = np.repeat(lowest, sizes)
            ended = lowest_each == _NONE
            if ended.any():
                settle(symbols[ended], owner[ended])
                live = ~ended
                symbols, owner, rank, made, lowest_each = symbols[live], owner[live], rank[live], made[live], lowest_each[live]
                if not len(symbols):
                    break
            chosen = rank == lowest_each
            at = np.flatnonzero(chosen)
            # of pairs that overlap (aaa) take the first, third, ... of their run, as from left to right
            run = np.concatenate(([True], np.diff(at) > 1))
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            before_rank = lowest_each[at]
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            new = (np.cumsum(keep) - 1)[at]
            symbols, owner = symbols[keep], owner[keep]
            # a new pair that ranks at or below the merged one: one by one would differ
            risky = np.zeros(len(done), bool)
            for shift in (0, -1):
                i = new + shift
                ok = (i >= 0) & (i + 1 < len(symbols))
                i, was = i[ok], before_rank[ok]
                ok = (owner[i] == owner[i + 1]) & (symbols[i] >= 0) & (symbols[i + 1] >= 0)
                i, was = i[ok], was[ok]
                r, _ = self.look(symbols[i], symbols[i + 1])
                risky[owner[i[r <= was]]] = True
            if risky.any():
                alone.extend(np.flatnonzero(risky).tolist())
                live = ~risky[owner]
                symbols, owner = symbols[live], owner[live]
        for k in alone:
            done[k] = self.count_one(texts[short[k]])
        out[short] = done
        return out.tolist()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[PieceVocabulary, dict[str, int]]:
    return PieceVocabulary(path), {}


def cut_text(text: str) -> list[str]:
    """Pre-tokens, without the one marker that every one of them begins with."""
    if MARK not in text and "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ")
    return [p[1:] for p in _CUT.findall(MARK + text.replace(" ", MARK))]


def count_texts(texts: list[bytes | None], path: str) -> list[int]:
    """Tokens of each text."""
    own, known = vocabulary(path)
    cut = [cut_text(t.decode()) if t else [] for t in texts]
    new = list(set().union(*cut).difference(known))
    if len(known) + len(new) > CACHE:
        older = dict(islice(known.items(), CACHE // 2))  # frequent ones are among them
        known.clear()
        known.update(older)
        new = list(set().union(*cut).difference(known))
    for at in range(0, len(new), 50_000):
        some = new[at : at + 50_000]
        known.update(zip(some, own.count_many([MARK + p for p in some]), strict=True))
    return [sum(map(known.__getitem__, parts)) for parts in cut]


def count_tokens(df: DataFrame, path: str, *, text_col: str = "text", limit: int = 4096, keep: list[str] | None = None) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit (more than `limit` tokens) for each row."""

    def compute(batches):
        for batch in batches:
            texts = texts_of(batch, text_col)
            counts = count_texts(texts, path)
            yield [[len(t or b"") for t in texts], counts, [c > limit for c in counts]]

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return add_columns(df, fields, compute, [text_col], keep)
