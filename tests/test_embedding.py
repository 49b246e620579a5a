"""Embedders, stores embedded anew, the index as a stream, and wide exports of long threads."""

import csv
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from brookloom.functions import chunks, vectors
from brookloom.operators import conversation, embedding
from brookloom.streaming import ingest


def test_batches_are_full_and_of_one_length():
    seen = []

    def model(texts):
        seen.append([len(t) for t in texts])
        return np.array([[len(t), ord(t[0])] for t in texts])

    texts = [c * n for n, c in zip([5, 1, 9, 1, 7, 3, 2, 8, 6, 4], "abcdefghij", strict=True)]
    got = embedding.in_batches(texts, model, 4)
    assert seen == [[1, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert got.tolist() == [[len(t), ord(t[0])] for t in texts]
    with pytest.raises(ValueError, match="1 vectors for 2 texts"):
        embedding.in_batches(["a", "b"], lambda t: np.zeros((1, 2)))


def test_pooled_means():
    tokens = np.array([[[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [[1.0, 1.0]] * 3])
    got = embedding.by_tokens(lambda: lambda texts: (tokens, np.array([[1, 1, 0], [0, 0, 0]])))()(["a", "b"])
    assert got.round(6).tolist() == [[0.6, 0.8], [0.0, 0.0]]


def test_model_is_loaded_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        open(os.path.join(folder, f"load-{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.range(3000).select("id", F.when(F.col("id") % 100 != 7, F.repeat(F.lit("x"), F.col("id").cast("int") % 13 + 1)).alias("text"), F.lit("old").alias("Embedding")).repartition(8)
    for _ in range(2):
        got = embedding.embedded(df, "text", load, f"counting-{folder}", prefix="p ", batch=16)
        assert got.columns == ["id", "text", "embedding"]
        rows = got.collect()
        assert len(rows) == 3000 and all(r.embedding == (None if r.text is None else [len(r.text) + 2, 1.0]) for r in rows)
    loads = [p.name.split("-")[1] for p in tmp_path.iterdir()]
    assert len(loads) == len(set(loads))  # once in a process, in 16 tasks or more


def test_hashing_embedder_is_the_column(spark):
    texts = ["one two two", "", "A b-c", "one", "é è"]
    want = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(vectors.hashed_embedding(F.col("t"), 16)).collect()]
    assert embedding.hashing_embedder(16)()(texts).round(6).tolist() == np.array(want).round(6).tolist()


def counted(texts, log):
    with open(log, "a") as f:
        f.writelines(t + "\n" for t in texts)
    return np.array([[len(t), 0.0] for t in texts])


def test_only_what_changed_is_embedded(spark, tmp_path):
    log = str(tmp_path / "log")
    load = lambda: lambda texts: counted(texts, log)
    texts = spark.createDataFrame([(1, "aa"), (2, "b"), (3, None)], "id long, text string")
    empty = spark.createDataFrame([], "id long, doc_hash string, model string, embedding array<float>")
    embedding.embedded_anew(empty, texts, "id", "text", load, f"m1-{log}").write.parquet(f"{tmp_path}/v1")
    assert sorted(open(log).read().split()) == ["aa", "b"]
    changed = spark.createDataFrame([(1, "aa"), (2, "new"), (4, "four")], "id long, text string")
    second = embedding.embedded_anew(spark.read.parquet(f"{tmp_path}/v1"), changed, "id", "text", load, f"m1-{log}")
    second.write.parquet(f"{tmp_path}/v2")
    assert sorted(open(log).read().split()) == ["aa", "b", "four", "new"]
    assert sorted((r.id, r.embedding[0]) for r in spark.read.parquet(f"{tmp_path}/v2").collect()) == [(1, 2), (2, 3), (4, 4)]
    embedding.embedded_anew(spark.read.parquet(f"{tmp_path}/v2"), changed, "id", "text", load, f"m2-{log}").collect()
    assert sorted(open(log).read().split()) == sorted(["aa", "b", "four", "new", "aa", "four", "new"])  # another model


def test_store_is_embedded_anew(spark, tmp_path):
    rows = [(f"{k}", f"text {k}", {"source": "s"}, k % 3, [0.0]) for k in range(10)]
    spark.createDataFrame(rows, "id string, document string, metadata map<string,string>, batch long, embedding array<float>").write.partitionBy("batch").parquet(f"{tmp_path}/old")
    got = embedding.rewrite_store(spark, f"{tmp_path}/old", f"{tmp_path}/new", embedding.hashing_embedder(8), "hashing-8")
    assert sorted((r.id, r.document, r.batch, r.metadata["source"]) for r in got.collect()) == [(i, d, b, "s") for i, d, _, b, _ in rows]
    assert all(len(r.embedding) == 8 and abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in got.collect())


def test_two_runs_of_the_index_give_each_chunk_once(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    texts = {k: " ".join(f"w{k}.{i}" for i in range(200)) for k in range(6)}

    def arrive(ids, name):
        spark.createDataFrame([(i, texts[i % 100], name) for i in ids], "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(source)

    def run(**options):
        ingest.index_stream(spark, source, "doc_id long, text string, source string", store, str(tmp_path / "cp"), split=chunks.recursive_chunks, load=embedding.hashing_embedder(8), name="hashing-8", files=1, start=3, **options).awaitTermination()

    arrive([0, 1, 2], "first")
    arrive([103 - 100, 1], "second")  # a known text again in another file
    run()
    one = spark.read.parquet(store)
    assert {r.batch for r in one.collect()} <= {3, 4} and sorted({r.doc_id for r in one.collect()}) == [0, 1, 2, 3]
    before = {(r.id, r.batch) for r in one.collect()}
    arrive([4, 105, 0, 5], "third")  # a restart; 105 and 5 are one text, in one batch
    run()
    rows = spark.read.parquet(store).collect()
    assert before < {(r.id, r.batch) for r in rows}
    want = {(i, j): c for i in (0, 1, 2, 3, 4, 5, 105) for j, c in enumerate(chunks.split_text(texts[i % 100]))}
    assert len(rows) == len(want) and {(r.doc_id, r.chunk_idx): r.chunk for r in rows} == want
    assert max(r.batch for r in rows) == 5 and all(len(r.embedding) == 8 for r in rows)
    run()
    assert spark.read.parquet(store).count() == len(want)


def test_repeats_inside_a_batch(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    for once, want in ((False, [1, 2, 3]), (True, None)):
        store = str(tmp_path / f"store{once}")
        ingest.ingest_stream(spark, str(tmp_path / "in"), "doc_id long, text string", store, str(tmp_path / f"cp{once}"), once=once).awaitTermination()
        rows = spark.read.parquet(store).collect()
        assert sorted(r.doc_id for r in rows) == want if want else sorted(r.text for r in rows) == ["a", "b"]


def test_a_thread_of_2000_messages(spark):
    rows = spark.range(2000).select(F.lit(1).alias("t"), F.col("id").cast("int").alias("idx"), F.concat(F.lit("m,\n\""), "id").alias("text"), (F.col("id") % 5).alias("score"))
    short = spark.createDataFrame([(2, 0, "only", None), (2, 1, None, 3)], "t int, idx int, text string, score long")
    lines = [r.value for r in conversation.wide_lines(rows.union(short), "t", "idx", ["text", "score"]).collect()]
    table = [dict(zip(header, row, strict=True)) for block in blocks(lines) for header, *rest in [list(csv.reader(block))] for row in rest]
    assert {r["t"] for r in table} == {"1", "2"}
    one, two = (next(r for r in table if r["t"] == k) for k in "12")
    assert len(one) == 1 + 2 * 2000 and all(one[f"msg_{k}_text"] == f'm,\n"{k}' and one[f"msg_{k}_score"] == str(k % 5) for k in range(2000))
    assert (two["msg_0_text"], two["msg_0_score"], two["msg_1_text"], two["msg_1_score"], two["msg_2_text"]) == ("only", "", "", "3", "")


def blocks(lines):
    """Lines of each partition, its header first."""
    starts = [k for k, line in enumerate(lines) if line.startswith("t,msg_0_text")]
    return [[x + "\n" for x in "\n".join(lines[a:b]).split("\n")] for a, b in zip(starts, [*starts[1:], len(lines)], strict=True)]
