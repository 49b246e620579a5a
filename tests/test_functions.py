import io
import itertools
import random
import sqlite3
import zipfile

from pyspark.sql import functions as F

from brookloom.functions import chunks, text, vectors
from brookloom.functions.numeric import bin_half_even, pearson, percent
from brookloom.operators import conversation, filters, nearest, report, scoring
from brookloom.sources import archives, sinks
from brookloom.streaming import ingest


def values(df):
    return [tuple(r) for r in df.collect()]


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(2.5,), (-0.5,), (0.5,), (3.5,)], "v double")
    assert [r[0] for r in values(df.select(bin_half_even(F.col("v"))))] == [2, 0, 0, 4]
    assert values(spark.range(1).select(percent(F.lit(1), F.lit(0)), percent(F.lit(1), F.lit(3)))) == [(0.0, 33.33)]


def test_pearson_guards(spark):
    constant = spark.createDataFrame([(1.0, 2.0)] * 4, "x double, y double")
    assert values(constant.agg(pearson(F.col("x"), F.col("y")))) == [(None,)]
    two = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "x double, y double")
    assert values(two.agg(pearson(F.col("x"), F.col("y")))) == [(None,)]
    line = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "x double, y double")
    assert values(line.agg(pearson(F.col("x"), F.col("y")))) == [(1.0,)]


def test_best_gain_is_the_pairwise_definition(spark):
    random.seed(3)
    rows = [([random.choice([None, *range(6)]) for _ in range(random.randint(0, 7))],) for _ in range(60)]
    got = values(spark.createDataFrame([([None if x is None else float(x) for x in r[0]],) for r in rows], "v array<double>").select("v", conversation.best_gain(F.col("v"))))
    for v, gain in got:
        known = [x for x in v if x is not None]
        assert gain == max((b - a for a, b in itertools.combinations(known, 2)), default=None)


def test_text_functions(spark):
    df = spark.createDataFrame([("a&amp;lt;b&amp;gt;\\n c\td  ",), ("<p>x</p> é",), (None,)], "t string")
    assert [r[0] for r in values(df.select(text.strip_html(F.col("t"))))] == ["a&lt;b&gt;\\n c\td", "x é", ""]
    assert [r[0] for r in values(df.select(text.sanitize(text.strip_html(F.col("t")))))] == ["a<b> c d", "x é", ""]
    assert text.word_diff_of("a b c d e f g h", "a b c d e f g x") == "a b c ... e f g [~~h~~ ➝ **x**]"
    assert text.word_diff_of("", "") == ""
    assert text.first_json('so {"a": 1') == '{"a": 1}'
    assert text.first_json('so {"a": {"b": 1}}') is None
    page = spark.createDataFrame([('x <img src="data:image/png;base64,AAAA"> y <img src="data:;base64,BB==">',)], "t string")
    r = page.select(text.image_placeholders(F.lit("Long"), F.col("t")).alias("x")).first()["x"]
    assert r["text"] == "x [Long Image 1] y [Long Image 2]"
    assert [i["base64"] for i in r["images"]] == ["AAAA", "BB=="]
    assert values(spark.range(1).select(text.signed_delta(F.lit("3"), F.lit("5")), text.signed_delta(F.lit("3"), F.lit("3.5")), text.signed_delta(F.lit("3"), F.lit("3")))) == [("+2", "", "+0")]


def test_chunks(spark):
    long = "word " * 300
    parts = chunks.split_text(long)
    assert all(len(p) <= 512 for p in parts)
    assert chunks.split_text("a\n\nb") == ["a\n\nb"]
    fixed = values(chunks.fixed_chunks(spark.createDataFrame([("x" * 1000,), ("",), ("y",)], "t string"), "t").select("chunk_idx", F.length("chunk")))
    assert fixed == [(0, 512), (1, 512), (2, 76), (0, 1)]


def test_top_k_is_a_full_sort(spark):
    random.seed(1)
    rows = [(i, [float(random.randint(-2, 2)) for _ in range(4)]) for i in range(40)] + [(40, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = values(vectors.top_k(df.where("id < 3"), df, 5).select("query_id", "vec_id", "rank").orderBy("query_id", "rank"))
    pairs = df.where("id < 3").alias("a").crossJoin(df.alias("b")).select(F.col("a.id").alias("q"), F.col("b.id").alias("v"), F.round(vectors.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("s"))
    want = []
    for q, own in itertools.groupby(sorted(values(pairs), key=lambda r: (r[0], -r[2], r[1])), key=lambda r: r[0]):
        want += [(q, r[1], k + 1) for k, r in enumerate(itertools.islice(own, 5))]
    assert got == want


def test_filters_are_existential_by_rule(spark):
    schema = "thread long, conversation array<struct<short_answer:string,response:string,rubrics:struct<strategy:int>>>"
    rows = [(1, [("aaaa", "bad", (1,)), ("b", "ok", (3,))]), (2, [("aaaa", "bad", (3,)), ("b", "bad", (1,))]), (3, [])]
    df = spark.createDataFrame(rows, schema)
    shape = {"top": ["thread"], "inner": ["short_answer", "response"], "rubric": ["strategy"]}
    keep = lambda config: sorted(r[0] for r in values(filters.kept(df, config, **shape).select("thread")))
    assert keep({"short_answer": {"min_length": 4}, "response": {"contains": "OK"}}) == [1]
    assert keep({"response": {"not_contains": ["bad"]}}) == [1]
    assert keep({"strategy": {"improvement": 2}}) == [1]
    assert keep({"mentor_replies": {"is_synthetic": True, "min_value": 2}}) == [1, 2]
    assert keep({"missing": {"required": True}}) == []


def test_first_last_deltas(spark):
    df = spark.createDataFrame([(1, 10, 1, 2), (1, 20, 2, 5), (1, 20, 1, 4), (2, 5, 1, None)], "t long, at long, id long, clarity int")
    out = report.first_last_deltas(df, "t", ["at", "id"], ["clarity"])
    assert sorted(values(out.select("t", "replies", "delta_clarity", "delta_total"))) == [(1, 3, 3, 3), (2, 1, 0, 0)]


def test_scoring_uses_its_cache(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("clarity", T.LongType())])
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "fail")], "k string, p string")
    cache = spark.createDataFrame([("a", 9)], "k string, clarity long")

    def client(prompt):
        if prompt == "fail":
            raise ValueError
        return {"clarity": 2}

    assert sorted(values(scoring.scored(rows, "k", "p", client, schema, cache))) == [("a", 9), ("b", 2)]


def test_sources_and_sinks(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("thread_1.json", '{"thread_id": 1}')
        z.writestr("thread_2.json", "")
        z.writestr("thread_3.txt", "x")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.zip").write_bytes(data.getvalue())
    got = archives.read_json_archives(spark, str(tmp_path / "in"), "thread_id long")
    assert values(got.select("member", "thread_id")) == [("thread_1.json", 1)]
    with sqlite3.connect(tmp_path / "x.db") as c:
        c.execute("CREATE TABLE t (id INTEGER, name TEXT)")
        c.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"n{i}") for i in range(10)])
    rows = archives.read_sqlite(spark, str(tmp_path / "x.db"), "id long, name string", table="t", parts=3)
    assert sorted(values(rows)) == [(i, f"n{i}") for i in range(10)]
    files = spark.createDataFrame([("a", "p1", "x"), ("a", "p1", "x"), ("a", "p2", "y"), ("b", "p3", "z")], "g string, path string, content string")
    sinks.write_files(files.where("g = 'b'"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "p3").read_text() == "z"


def test_ingest(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.ingest_stream(spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "store")).collect()) == ["a", "a", "b"]
    assert sorted(values(ingest.numbered_batches(spark.range(7).repartition(3), "id", 3, str(tmp_path / "work"), 5))) == [(i, 5 + i // 3) for i in range(7)]


def test_drift_covers_whole_labels(spark, tmp_path):
    """The nearest vectors stand far apart by id."""
    from brookloom.plans.catalog import QUERIES

    rows = [(0, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0]), (2, 1, [-1.0, 0.0]), (900, 1, [1.0, 0.0]), (901, 1, [0.0, 2.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["a"], r["b"]): (r["mean_cosine"], r["relative_drift_pct"]) for r in QUERIES["q_drift_nearest"](spark, str(tmp_path)).collect()}
    assert got == {(0, 0): (1.0, 0.0), (1, 1): (1.0, 0.0), (0, 1): (1.0, 0.0)}
    small = nearest.label_nearest(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), "vec_id", "label", "embedding", block=1)
    assert {(r["a"], r["b"], r["id"]): r["sim"] for r in small.collect()} == {(0, 0, 0): 1.0, (0, 0, 1): 1.0, (0, 1, 0): 1.0, (0, 1, 1): 1.0, (1, 1, 2): 1.0, (1, 1, 900): 1.0, (1, 1, 901): 1.0}


def test_sanitize_covers_texts_with_entities(spark, tmp_path):
    import html

    from brookloom.plans.catalog import QUERIES

    texts = ["a &lt; b", "R&D", "&amp;amp; &eacute;&#39;", "x&nbsp;&nbsp;y\\n z", "plain", None]
    spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["turn"]: r["text"] for r in QUERIES["q_sanitize_text"](spark, str(tmp_path)).collect()}
    assert got == {k: " ".join(html.unescape(t or "").replace("\\n", " ").split()) for k, t in enumerate(texts)}


def test_wide_query_has_every_message(spark, tmp_path):
    from brookloom.plans.catalog import QUERIES

    rows = [(1, 2 * k, "user", f"m{k}") for k in range(7)] + [(1, 1, "assistant", "reply"), (2, 0, "user", "only")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r.asDict() for r in QUERIES["q_wide_flatten"](spark, str(tmp_path)).collect()}
    assert got[1] == {"conv_id": 1} | {f"msg_{k}_text": f"m{k}" for k in range(7)}
    assert got[2] == {"conv_id": 2} | {f"msg_{k}_text": None if k else "only" for k in range(7)}


def test_cleaning_golden():
    """Worked out by hand from the order of the cleaning steps."""
    assert text.compat_of("a\\frac <b>caf\u00e9</b> &amp; x\ty {\\*\\fld x} end\\") == "arac caf\u00c3\u00a9 & xy end\\x5c"
    assert text.compat_of("<style>p {}</style> [Long Image 1]x /* gone */y\\u2019s") == "p {} x y's"
    assert text.compat_of(None) == "" and text.compat_of("  ") == ""
    assert text.web_text("a<b>b</b>\\nline caf\u00e9 <br/> z") == "ab<br>line caf z"
    assert text.web_text('a<img src="data:image/png;base64,AA=="> <i>z</i>', keep_images=True) == 'a<br><img src="data:image/png;base64,AA=="><br> z'
    assert text.web_text("t\\tx") == "t&nbsp;&nbsp;&nbsp;&nbsp;x"
    assert text.viewer_text("a [Long Image 1] \\u0041 &lt;x&gt;b <i>c</i>") == "a [Long Image 1] A b c"
    assert text.viewer_text("bad \\u12") is None
    assert text.page_text("<p>a&amp;b</p><script>x</script> <i>c</i>") == "a&b c"
    assert text.first_json("x 1}") is None and text.first_json('"a": 1}') == '{"a": 1}'


def test_text_columns_golden(spark):
    rows = [("a/b:c*?", "\u00e2\u0080\u0099 \u00c3\u00a9 \u00c2x", "$x$ and \\frac{1}{2} \u00e9^2"), (None, None, None), (" ", "", "")]
    df = spark.createDataFrame(rows, "n string, m string, t string")
    got = values(df.select(text.safe_name(F.col("n")), text.fix_mojibake(F.col("m")), text.mathiness(F.col("t"))))
    assert [r[0] for r in got] == ["a_b - c__", "NULL", "NULL"]
    assert [r[1] for r in got] == ["\u2019 \u00e9 x", None, ""]
    assert [round(r[2], 3) for r in got] == [round(2 / max(1, __import__("math").log10(len(rows[0][2]) + 1)), 3), 0.0, 0.0]
    page = spark.createDataFrame([("<IMG x=\"data:a;base64,AA\"> <embed src='data:;base64,B_-'/>",)], "t string")
    assert [(i["index"], i["base64"]) for i in page.select(text.image_placeholders(F.lit("Long"), F.col("t")).alias("x")).first()["x"]["images"]] == [(1, "AA"), (2, "B_-")]
    said = spark.createDataFrame([('x {"k": 1} y',), ("none",), ("{broken}",)], "t string")
    assert values(said.select(text.verdict_json(F.col("t"), "k int").alias("v")).select("v.answer.k", "v.error", "v.raw")) == [(1, None, None), (None, "No JSON found in response", "none"), (None, "not valid JSON", None)]
    assert values(said.select(text.greedy_json(F.col("t"), "k int").isNull())) == [(False,), (True,), (True,)]
    assert values(spark.createDataFrame([(b"a\xff",)], "b binary").select(text.safe_decode(F.col("b")))) == [("a\ufffd",)]


def test_histogram_cases(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (3.0,)], "v double")
    assert sorted(values(report.histogram(df, "v", 2))) == [(0, 1, 0.333333), (1, 2, 0.666667)]
    assert values(report.histogram(df.where("v = 2"), "v", 50)) == [(0, 1, 1.0)]
    assert values(report.histogram(df.where("false"), "v", 50)) == []


def test_wide_has_every_message(spark):
    df = spark.createDataFrame([(1, i, f"m{i}") for i in range(6)] + [(2, 0, "x")], "t int, idx int, text string")
    got = conversation.wide(df, "t", "idx", ["text"])
    assert got.columns == ["t", *(f"msg_{i}_text" for i in range(6))]
    assert sorted(values(got))[0] == (1, "m0", "m1", "m2", "m3", "m4", "m5")


def test_top_k_of_odd_rows(spark):
    df = spark.createDataFrame([(-1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (None, [1.0, 1.0]), (5, [1.0, 0.1])], "id long, embedding array<float>")
    got = sorted(values(vectors.top_k(df, df, 2, size=2).select("query_id", "vec_id", "rank")))
    assert got == [(-1, -1, 1), (-1, 5, 2), (2, 2, 1), (2, 5, 2), (5, -1, 2), (5, 5, 1)]
    assert values(vectors.top_k(df.where("false"), df, 2)) == []


def test_archives_of_odd_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("good.json", '{"k": 1}')
        z.writestr("bad.json", '{"k": ')
    (tmp_path / "b.zip").write_bytes(b"no archive")
    got = archives.read_json_archives(spark, str(tmp_path / "*.zip"), "k int")
    assert [(r["member"], r["k"]) for r in got.collect()] == [("good.json", 1)]


def test_sqlite_rows_without_a_split_value(spark, tmp_path):
    path = str(tmp_path / "x.db")
    c = sqlite3.connect(path)
    c.execute("CREATE TABLE t (k INTEGER, v TEXT)")
    c.executemany("INSERT INTO t VALUES (?, ?)", [(1, "a"), (None, "b"), (-3, "c"), (4, "d")])
    c.commit()
    c.close()
    got = archives.read_sqlite(spark, path, "k int, v string", query="SELECT * FROM t")
    assert sorted(r["v"] for r in got.collect()) == ["a", "b", "c", "d"]


def test_stored_scores_call_once(spark, tmp_path):
    from pyspark.sql import types as T

    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, p string")
    schema = T.StructType([T.StructField("clarity", T.LongType())])
    log = tmp_path / "calls"
    log.mkdir()

    def client(prompt):
        (log / f"{prompt}-{__import__('uuid').uuid4().hex}").write_text("")
        return {"clarity": 2}

    for _ in range(2):
        got = scoring.stored_scores(rows, "k", "p", client, schema, str(tmp_path / "store"), wait=0.0)
        assert sorted(values(got)) == [("a", 2), ("b", 2)]
        got.count()
    assert len(list(log.iterdir())) == 2


def test_answers_and_stores(spark, tmp_path):
    found = spark.createDataFrame([(1, "why", 2, "b"), (1, "why", 1, "a")], "q int, question string, rank int, t string")
    echo = lambda p: p.replace("\n", "|")
    assert values(scoring.answered(found, "q", "t", "rank", echo)) == [(1, "Question: why|Context: a||b")]
    assert "Context: b" in values(scoring.answered(found, "q", "t", "rank", echo, how="refine"))[0][1]
    assert values(scoring.answered(found, "q", "t", "rank", echo, how="none")) == [(1, "Question: why")]
    store = str(tmp_path / "s")
    rows = spark.createDataFrame([(1, "x", 0), (2, "y", 1)], "id int, v string, batch int")
    sinks.append_store(rows, store)
    sinks.replace_batches(rows.where("batch = 1").withColumn("v", F.lit("z")).select("id", "v", "batch"), store)
    assert sorted((r["id"], r["v"]) for r in archives.read_store(spark, store).collect()) == [(1, "x"), (2, "z")]
    assert [r["id"] for r in archives.read_store(spark, store, batches=[0]).collect()] == [1]
    sinks.append_feedback(spark.createDataFrame([(7, "good")], "thread_id int, note string"), str(tmp_path / "f"), ["note"])
    assert '"note":"good"' in spark.read.parquet(str(tmp_path / "f")).first()["entry"]
    (tmp_path / "c.json").write_text('{"short_answer": {"min_length": 3}}')
    assert archives.read_config(str(tmp_path / "c.json"), {"min_length"}) == {"short_answer": {"min_length": 3}}
    (tmp_path / "l.jsonl").write_text('{"k": 1}\nno\n')
    assert values(archives.read_jsonl(spark, str(tmp_path / "l.jsonl"), "k int")) == [(1,)]
    pooled = spark.createDataFrame([([[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "t array<array<double>>, m array<int>")
    assert values(pooled.select(vectors.mean_pooled(F.col("t"), F.col("m")))) == [([0.6, 0.8],)]
