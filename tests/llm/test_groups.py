"""Operators on groups: exact and near duplicates, mixing, token files, the pipeline."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brookloom.llm import entropy_mix, exact_dedup, near_dedup, token_files
from brookloom.llm.common import words_of
from brookloom.llm.queries import tokenizer_path

from .test_rows import ODD, odd, rows_of


def brute_copies(rows):
    out = []
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"capacity": 2, "key_of": lambda t: len(t) % 13, "key_bits": 16}])
def test_exact_copies(spark, options):
    rng = random.Random(1)
    rows = ODD + [(1000 + k, rng.choice(["a", "b", "c" * 9, None, ""])) for k in range(60)] + [(2000 + k, f"text {k % 40}") for k in range(80)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _keep string").repartition(3)
    found = exact_dedup.find_duplicates(df, **options)
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows_of(found)), key=repr)
    assert got == brute_copies(rows)
    left = rows_of(exact_dedup.deduplicate(df, **options))
    assert sorted(r["text"] or "" for r in left) == sorted({t or "" for _, t in rows})
    assert set(left[0]) == {"doc_id", "text", "_keep"}
    assert rows_of(exact_dedup.find_duplicates(df.where("false"))) == []


def test_extendible_index(tmp_path):
    store = exact_dedup.PageStore(str(tmp_path), "range-00000")
    index = exact_dedup.ExtendibleIndex(skip=0, capacity=4, page_bytes=2000, store=store, key_bits=16)
    rng = random.Random(2)
    texts = [b"t%d" % k for k in range(300)]
    seen = {}
    for n in range(900):
        t = rng.choice(texts)
        index.add(zlib.crc32(t) % 977, t, n, 1)
        seen[t] = (n, seen.get(t, (0, 0))[1] + 1)
    assert index.depth > 3 and index.chained and index.paged
    assert all(len(b.chains) <= 4 for b in index.buckets())
    store.close(index)
    again = exact_dedup.load(str(tmp_path), "range-00000")
    assert all(again.find(zlib.crc32(t) % 977, t) == s for t, s in seen.items())
    assert again.find(5, b"absent") is None
    assert [p.name for p in tmp_path.iterdir()] == ["range-00000.ehx"]


def brute_classes(rows, threshold=0.8):
    def shingles(text):
        w = words_of((text or "").encode())
        n = min(5, len(w))
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = sum((sets[a] & sets[b]).values())
        if both and both / sum((sets[a] | sets[b]).values()) >= threshold:
            parent[top(a)] = top(b)
    group = {}
    for k in range(len(rows)):
        group.setdefault(top(k), []).append(k)
    out = []
    for members in group.values():
        ids = [rows[k][0] for k in members]
        least = min((i for i in ids if i is not None), default=None)
        out += [(i, least, len(members)) for i in ids]
    return sorted(out, key=repr)


def near_rows(seed, n=260):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randint(0, 5000)
    base = [word() for _ in range(120)]
    rows = list(ODD)
    for k in range(n):
        kind = k % 4
        w = list(base) if kind < 3 else [word() for _ in range(rng.randint(1, 60))]
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6]) if kind < 3 else 0):  # edits of one text: many pairs about 0.8
            w[rng.randrange(len(w))] = word()
        rows.append((10_000 + k, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1])
def test_near_copies_are_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)  # several tiles in a bucket
    monkeypatch.setattr(near_dedup, "PART", 32)  # several parts of a bucket and of a pivot
    rows = near_rows(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, class_id int").repartition(3)
    found = rows_of(near_dedup.near_duplicates(df))
    assert sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in found), key=repr) == brute_classes(rows)
    left = rows_of(near_dedup.deduplicate(df))
    words = [r for r in rows if words_of((r[1] or "").encode())]
    classes = {c for _, c, _ in brute_classes(words)}
    assert len([r for r in left if words_of((r["text"] or "").encode())]) == len(classes)
    assert len(left) == len(classes) + len(rows) - len(words)


def test_near_copies_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert rows_of(near_dedup.near_duplicates(df)) == [] and rows_of(near_dedup.deduplicate(df)) == []


def test_components(spark):
    rng = random.Random(3)
    edges = [(bytes([a]), bytes([b])) for a, b in ((rng.randrange(80), rng.randrange(80)) for _ in range(55))] + [(bytes([100 + k]), bytes([101 + k])) for k in range(20)]
    parent = {}

    def top(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    got, _ = near_dedup.components(spark.createDataFrame(edges, "a binary, b binary"))
    found = {bytes(r["node"]): bytes(r["root"]) for r in rows_of(got)}
    roots = {}
    for k in parent:
        roots.setdefault(top(k), set()).add(found.get(k, k))
    assert all(len(r) == 1 for r in roots.values()) and len(set.union(*roots.values())) == len(roots)


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """Sources in order, null last; those above their cap are closed one after the other."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    done = {}
    while len(done) < len(order):
        left = sum(sizes.values()) - sum(done.values())
        unit = left / sum(weight[s] for s in order if s not in done)
        over = next((s for s in order if s not in done and weight[s] * unit > cap * sizes[s]), None)
        if over is None and None not in [s for s in order if s not in done and weight[s] * unit > cap * sizes[s]]:
            return done | {s: weight[s] * unit for s in order if s not in done}
        done[over] = cap * sizes[over]
    return done


def stats_of(spark, sizes):
    return spark.createDataFrame([(s, n) for s, n in sizes.items()], "_source string, tokens long")


def test_targets(spark):
    rng = random.Random(9)
    for sizes in ({"a": 10, "b": 1000, "c": 100, None: 0}, {"é" * k + "z": rng.choice([0, 1, 7, 300, 9000]) for k in range(12)}):
        found, _ = entropy_mix.with_targets(stats_of(spark, sizes))
        got = {r["_source"]: r["target"] for r in rows_of(found)}
        assert got == pytest.approx(brute_targets(sizes))
        assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_dual_meets_overlapping_constraints(spark):
    """Sources meet their targets exactly; the multipliers of the length classes are the minimum of the dual."""
    rng = np.random.default_rng(4)
    words, cap, slack = rng.integers(0, 1000, (6, 4)).astype(float), 3.0, 0.02
    target = words.sum() * np.array([0.3, 0.25, 0.2, 0.1, 0.1, 0.05])
    target = np.minimum(target, cap * words.sum(axis=1))
    df = spark.createDataFrame([(float(t), [int(x) for x in w]) for t, w in zip(target, words, strict=True)], "target double, words array<long>").repartition(3)
    mu = entropy_mix.solve_dual(df, cap, slack=slack)
    lam, rate = entropy_mix.source_rates(words, target, mu, cap)
    assert (words * rate).sum(axis=1) == pytest.approx(target) and rate.max() <= cap
    share, total = words.sum(axis=0) / words.sum(), words.sum()
    miss = (words * rate).sum(axis=0) / total - share
    assert miss == pytest.approx(-slack * mu, abs=1e-5)  # what a departure costs
    plain = (words * entropy_mix.source_rates(words, target, np.zeros(4), cap)[1]).sum(axis=0) / total - share
    assert np.abs(miss).max() < 0.5 * np.abs(plain).max()


def test_mix(spark):
    rng = random.Random(5)
    rows = [(k, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(600)] + [(i, t, "d") for i, t in ODD]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = rows_of(entropy_mix.mix(df))
    assert len(got) == len(rows)
    again = rows_of(entropy_mix.mix(df.repartition(5)))
    key = lambda r: repr((r["doc_id"], r["taken"]))
    assert sorted(map(key, got)) == sorted(map(key, again))
    for s in ("a", "b", "c", None):
        own = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], rel=0.03)
        assert sum(r["size"] for r in own) == own[0]["source_size"]
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert all(r["size"] == len((dict((k, t) for k, t, _ in rows)[r["doc_id"]] or "").split()) for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and r["doc_id"] > 8)
    assert rows_of(entropy_mix.mix(df.where("false"))) == []
    copies = rows_of(entropy_mix.mixed_documents(df))
    assert len(copies) == sum(r["copies"] for r in got) and set(copies[0]) == {"doc_id", "text", "source", "size"}


@pytest.mark.parametrize("rate", [0.4, 0.49, 0.55])
def test_mix_of_few_long_documents(spark, rate):
    """Long documents that hold most words are rounded for the whole source, and the short ones take what they leave owed."""
    rng = random.Random(2)
    sizes = [1_000_000] * 20 + [rng.randint(50, 550) for _ in range(19_980)]
    other = int(sum(sizes) * 0.9)
    rows = [(k, "a", n) for k, n in enumerate(sizes)] + [(20_000 + k, "b", other // 3000) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    tokens = sum(sizes)
    got = rows_of(entropy_mix.mix(df, size_col="n", classes=1, weights=(rate * tokens, other // 3000 * 3000 + (1 - rate) * tokens)))
    own = [r for r in got if r["source"] == "a"]
    assert len(got) == len(rows) and own[0]["rate"] == pytest.approx(rate)
    assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], rel=0.001)
    assert all(r["taken"] == r["copies"] * r["size"] and r["copies"] in (0, 1) for r in own)


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 5000):
        for high in (1, 2, 300, 2**32):
            ids = rng.integers(0, high, n)
            if n > 10:
                ids[::17] = 2**32 - 1
            f = token_files.TokenFile(token_files.encode_file([1], [n], ids))
            assert (f.ids() == ids).all() and f.n == n
            if n > 300:
                assert (f.ids(250, 300) == ids[250:300]).all()
    data = bytearray(token_files.encode_file([1], [3], np.array([1, 2, 3])))
    data[30] ^= 1
    with pytest.raises(ValueError):
        token_files.TokenFile(bytes(data))


@pytest.mark.parametrize("size", [2_000_000, 50])
def test_token_files(spark, size):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want, start = [], 0
    for i, t in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r.values()) for r in rows_of(token_files.token_digest(odd(spark).repartition(3), path, file_tokens=size))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert rows_of(token_files.token_digest(odd(spark).where("false"), path)) == []


def test_pipeline(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_files"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0.5 * docs.count() < out.count() <= docs.count(), name
    rows = rows_of(corpus_pipeline.run(spark, sf))
    assert rows and sum(r["n_tokens"] for r in rows) == max(r["start"] + r["n_tokens"] for r in rows)


def test_a_second_run_into_a_folder_hides_the_first(spark, tmp_path):
    path, folder = tokenizer_path("word_bpe_49k.json"), str(tmp_path / "tokens")
    many = spark.createDataFrame([(k, f"text {k} of the first run") for k in range(60)], "doc_id long, text string").repartition(4)
    token_files.write_token_files(many, folder, path, file_tokens=20)
    assert token_files.read_tokens(spark, folder).count() == 60
    token_files.write_token_files(many.where("doc_id < 3").withColumn("text", F.lit("second")), folder, path)
    got = {r["doc_id"]: len(r["ids"]) for r in token_files.read_tokens(spark, folder).collect()}
    assert sorted(got) == [0, 1, 2] and len(set(got.values())) == 1


def test_a_hot_text_is_held_back_in_its_task(spark, tmp_path, monkeypatch):
    """Copies over many slices of one task, beside texts of their own."""
    rows = [(k, "hot " * 30_000 if k % 2 else f"{k} " * 30_000) for k in range(80)] + [(k, "warm") for k in range(100, 140)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in rows_of(exact_dedup.find_duplicates(df))}
    assert got == {i: (79, 40, i == 79) if t.startswith("hot") else (139, 40, i == 139) if t == "warm" else (i, 1, True) for i, t in rows}


def test_recall_on_a_whole_table(spark):
    """All pairs of the documents at sf0.01, by an index of their shingles, against the classes that are found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = []
    for _, t in rows:
        w = words_of((t or "").encode())
        n = min(5, len(w))
        sets.append(Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter())
    sizes, holders, shared = [sum(s.values()) for s in sets], {}, Counter()
    for k, s in enumerate(sets):
        for shingle, n in s.items():
            for j, m in holders.setdefault(shingle, []):
                if min(sizes[j], sizes[k]) >= 0.8 * max(sizes[j], sizes[k]):
                    shared[j, k] += min(n, m)
            holders[shingle].append((k, n))
    links = [(j, k) for (j, k), both in shared.items() if both >= 0.8 * (sizes[j] + sizes[k] - both)]
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for j, k in links:
        parent[top(j)] = top(k)
    want = {}
    for k, (i, _) in enumerate(rows):
        want.setdefault(top(k) if sizes[k] else "no words", set()).add(i)
    found = {}
    for r in rows_of(near_dedup.near_duplicates(docs)):
        found.setdefault(r["class_id"], set()).add(r["doc_id"])
    class_of = {i: c for c, members in found.items() for i in members}
    assert len(links) > 100
    assert sum(class_of[rows[j][0]] == class_of[rows[k][0]] for j, k in links) == len(links)  # recall 1
    empty = want.pop("no words", set())
    assert {frozenset(m - empty) for m in found.values() if m - empty} == {frozenset(m) for m in want.values()}
