"""Class-based bigram scores: counts and probabilities by brute force, the exchange, blocks, odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brookloom.llm import class_lm
from brookloom.llm.queries import QUERIES

ODD = [(1, None), (2, ""), (3, " \n\t\x0b\x0c\r"), (4, "One two"), (5, "ONE two İ É"), (6, "unseen words only"), (7, "x " * 3000), (8, "one two"), (8, "one two"), (None, "null id"), (9, "a\x1cb\x85c")]


def split(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [""]


def base(rows):
    c = Counter(t for _, text, train in rows if train for t in split(text))
    n, v = sum(c.values()), len(c)
    out = []
    for i, text, _ in rows:
        own = split(text)
        out.append((i, len(own), sum(c[t] > 0 for t in own), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in own), 6)))
    return sorted(out, key=repr)


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    nouns, verbs, others = [f"n{k}" for k in range(30)], [f"v{k}" for k in range(30)], ["the", "a"]
    return [(100 + i, " ".join(f"{rng.choice(others)} {rng.choice(nouns)} {rng.choice(verbs)}" for _ in range(rng.randint(1, 30))), i % 4 != 2) for i in range(n)]


def made(spark, rows, **options):
    df = spark.createDataFrame([(i, t, m, "kept", 1) for i, t, m in rows], "doc_id long, text string, train boolean, extra string, Score int").repartition(3)
    return class_lm.fit_and_score(df, train=F.col("train"), **options)


@pytest.mark.parametrize("block", [class_lm.BLOCK, 40])
def test_counts_are_brute_force(spark, block):
    rows = [(i, t, i != 6) for i, t in ODD] + corpus()
    found = made(spark, rows, block=block, classes=5, seeds=8, most=20)
    assert found.columns == ["doc_id", "text", "train", "extra", *(n for n, _ in class_lm.SCORES)]
    got = found.collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == base(rows)
    assert {(r.doc_id, r.text) for r in got} == {(i, t) for i, t, _ in rows}
    assert all(r.score < 0 for r in got)


def test_scores_are_the_models_probabilities(spark):
    rows = [(i, t, i != 6) for i, t in ODD] + corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    model = class_lm.fit(docs, train=F.col("train"), classes=5, seeds=8, most=20)
    known = {w: (int(c), int(k)) for w, c, k in zip(model.words, model.counts, model.code, strict=True) if c}
    known |= {bytes(r["word"]): (r["n"], r["class"]) for r in model.rest.collect()}
    c = Counter(t.encode() for _, text, train in rows if train for t in split(text))
    assert {w: n for w, (n, _) in known.items()} == dict(c) and model.n == sum(c.values()) and model.types == len(c)
    moves, size = Counter(), Counter()
    for _, text, train in rows:
        if train:
            before = b""
            for t in (t.encode() for t in split(text)):
                moves[known[before][1], known[t][1]] += 1
                size[known[t][1]] += 1
                before = t
    assert {(int(a), int(b)): int(model.moves[a, b]) for a, b in zip(*np.nonzero(model.moves), strict=True)} == dict(moves)
    out = Counter()
    for (g, _), n in moves.items():
        out[g] += n
    unknown = (sum(n == 1 for n in c.values()) + 1) / (model.n + 2)

    def chance(before, token):
        if token not in known:
            return unknown
        n, k = known[token]
        share = size[k] / model.n
        step = share if before not in known else (moves[known[before][1], k] + class_lm.ALPHA * share) / (out[known[before][1]] + class_lm.ALPHA)
        return (1 - unknown) * step * n / size[k]

    for before in (b"", b"the", b"n1", b"never seen"):
        assert sum(chance(before, w) for w in known) + unknown == pytest.approx(1)
    want = {}
    for i, text, _ in rows:
        tokens = [t.encode() for t in split(text)]
        want[i] = sum(math.log10(chance(a, b)) for a, b in zip([b"", *tokens], tokens, strict=False))
    got = class_lm.score(docs.withColumn("score", F.lit("gone")), model, keep=["doc_id", "score"])
    assert got.columns[0] == "doc_id" and len(got.columns) == 6
    assert {r.doc_id: pytest.approx(r.score) for r in got.collect()} == want


def likelihood(pairs, code, classes):
    both = np.append(code, classes)
    cells = np.zeros((classes + 1, classes + 1))
    for a in range(len(pairs)):
        for b in range(len(pairs)):
            cells[both[a], both[b]] += pairs[a, b]
    f = lambda x: float(sum(v * math.log(v) for v in x.ravel() if v > 0))
    return f(cells) - f(cells.sum(1)) - f(cells.sum(0))


def test_exchange_ends_where_no_word_wants_to_move():
    rng = np.random.default_rng(2)
    pairs = rng.poisson(0.7, (13, 13)).astype(float)
    code = class_lm.exchange_seeds(pairs, 4, sweeps=100)
    best = likelihood(pairs, code, 4)
    assert best > likelihood(pairs, np.arange(12) % 4, 4)
    for w in range(12):
        for k in range(4):
            other = code.copy()
            other[w] = k
            assert likelihood(pairs, other, 4) <= best + 1e-6


def test_classes_find_the_parts_of_speech(spark):
    rows = corpus(200)
    model = class_lm.fit(spark.createDataFrame(rows, "doc_id long, text string, train boolean"), classes=4, seeds=20, most=40)
    of = {w.decode(): int(k) for w, k in zip(model.words, model.code, strict=True)} | {bytes(r["word"]).decode(): r["class"] for r in model.rest.collect()}
    groups = [{of[w] for w in of if re.fullmatch(f"{c}\\d+", w)} for c in "nv"]
    assert all(len(g) == 1 for g in groups) and groups[0] != groups[1] and of["the"] == of["a"] not in (groups[0] | groups[1])
    scored = {r.doc_id: r for r in made(spark, rows, classes=4, seeds=20, most=40).collect()}
    held = [scored[i] for i, _, train in rows if not train]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)


def test_no_training_texts_and_no_rows(spark):
    got = made(spark, [(1, "a b", False), (2, None, None)]).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)}
    df = spark.createDataFrame([], "doc_id long, text string")
    assert class_lm.fit_and_score(df, train=F.lit(True)).collect() == []


def test_query_counts(spark, sf):
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op12_class_lm"](spark, sf).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == base(rows)
    assert {(r.doc_id, r.held_out) for r in got} == {(i, not m) for i, _, m in rows}
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
