"""Vector stores, retrieval, drift between embeddings, samples and completeness."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chunks, vectors
from ..functions import text as X
from ..operators import embedding, nearest, scoring
from ..sources.tables import table
from .catalog import _COS, _TOP, ORACLE_SQL, query, vecs

_DOT = "list_dot_product({0}, {1}) / greatest(sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})), 1e-12)"


@query(f"""WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round({_DOT.format('x[1:32]', 'y[1:32]')}, 5) AS truncated, round({_DOT.format('list_resize(x, 80, 0.0)', 'list_resize(y, 80, 0.0)')}, 5) AS padded FROM p""")
def q_paired_cosine(spark, d):
    """Rows of two matrices paired by number, at the shorter and at a longer length."""
    rows = table(spark, d, "embeddings")
    left = rows.select("vec_id", F.col("embedding").alias("x"))
    pairs = left.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    each = lambda n: F.round(vectors.cosine(vectors.aligned(F.col("x"), n), vectors.aligned(F.col("y"), n)), 5)
    return pairs.select("vec_id", each(32).alias("truncated"), each(80).alias("padded"))


@query()
def q_projected_cosine(spark, d):
    """Pairs after a seeded Gaussian projection."""
    rows = table(spark, d, "embeddings")
    each = lambda c: vectors.projected(F.col(c), 64, 48, 7)
    left = rows.select("vec_id", each("embedding").alias("x"))
    pairs = left.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), each("embedding").alias("y")), "vec_id")
    return pairs.select("vec_id", F.round(vectors.cosine(F.col("x"), F.col("y")), 5).alias("projected"))


@query("WITH p AS (" + ORACLE_SQL["q_drift_nearest"] + ") SELECT a AS label, b AS other, mean_cosine FROM p UNION SELECT b, a, mean_cosine FROM p")
def q_shift_matrix(spark, d):
    """The drift between all labels as a matrix in long form: a row for each cell."""
    found = nearest.label_nearest(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), "vec_id", "label", "embedding")
    means = found.groupBy("a", "b").agg(F.round(F.avg("sim"), 4).alias("mean_cosine"))
    sides = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return means.select(F.explode(sides).alias("s"), "mean_cosine").select(F.col("s.a").alias("label"), F.col("s.b").alias("other"), "mean_cosine")


@query(f"""WITH h AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 5 <> 0), s AS (SELECT a.vec_id, max(round({_COS}, 6)) AS sim FROM h a, h b WHERE a.vec_id % 50 = 1 AND b.label = 0 GROUP BY 1)
SELECT vec_id, round(sim, 4) AS max_sim FROM s""")
def q_subset_knn(spark, d):
    """Nearest neighbours within a subset (as of math-heavy texts), by row id, so that pairs stay together."""
    heavy = vecs(spark, d).where("id % 5 <> 0")
    best = vectors.top_k(heavy.where("id % 50 = 1"), heavy.where("label = 0"), 1)
    return best.select(F.col("query_id").alias("vec_id"), F.round("sim", 4).alias("max_sim"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS numbers FROM documents WHERE len(regexp_extract_all(text, '[0-9]+')) / greatest(1.0, log10(length(text) + 1)) >= 0.5")
def q_number_heavy(spark, d):
    """Texts with many numbers for their length: a threshold on a count over the logarithm of the length."""
    n = F.regexp_count("text", F.lit("[0-9]+"))
    return table(spark, d, "documents").select("doc_id", n.cast("bigint").alias("numbers"), F.length("text").alias("l")).where(F.col("numbers") / F.greatest(F.lit(1.0), F.log10(F.col("l") + 1)) >= 0.5).drop("l")


_HEAVY = ORACLE_SQL["q_mathiness"]


@query(f"SELECT doc_id, score FROM ({_HEAVY}) WHERE score >= 0.5")
def q_math_heavy(spark, d):
    """Texts with a sign of mathematics for every other digit of their length at least."""
    return table(spark, d, "documents").select("doc_id", F.bround(X.mathiness(F.col("text")), 6).alias("score")).where("score >= 0.5")


@query(_TOP + "SELECT query_id, string_agg('doc ' || vec_id, chr(10) || chr(10) ORDER BY rank) AS context FROM t WHERE rank <= 4 GROUP BY 1")
def q_context(spark, d):
    """The texts of the best four as one context for a prompt."""
    corpus = vecs(spark, d)
    best = vectors.top_k(corpus.where("id % 50 = 0"), corpus, 4).select("query_id", "rank", F.concat(F.lit("doc "), F.col("vec_id").cast("string")).alias("t"))
    return best.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda s: s["t"]), "\n\n").alias("context"))


@query("SELECT doc_id, 'passage: ' || text AS passage, 'query: ' || coalesce(lang, '') AS query FROM documents")
def q_prefixes(spark, d):
    """Texts with the prefixes that some embedding models want."""
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("passage: "), "text").alias("passage"), F.concat(F.lit("query: "), F.coalesce("lang", F.lit(""))).alias("query"))


@query("SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 20")
def q_store_caps(spark, d):
    """At most 20 rows of each collection; the limit is the feature."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, d, "embeddings").select("vec_id", "label", F.row_number().over(w).alias("_n")).where("_n <= 20").drop("_n")


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 10 = 0")
def q_store_overlay(spark, d):
    """A store with new and changed rows laid over it: for one id the newer row holds."""
    store = table(spark, d, "embeddings").select("vec_id", "label", F.lit(0).alias("batch"))
    changed = store.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(1).alias("batch"))
    added = store.where("vec_id % 10 = 0").select((F.col("vec_id") + 1_000_000).alias("vec_id"), "label", F.lit(1).alias("batch"))
    return store.unionByName(changed).unionByName(added).groupBy("vec_id").agg(F.max_by("label", "batch").alias("label"))


@query("SELECT DISTINCT doc_id, sha256(text) AS doc_hash, source FROM documents")
def q_store_known(spark, d):
    """What a store knows: ids, hashes and sources."""
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("doc_hash"), "source").distinct()


@query("SELECT d.doc_id, b.vec_id AS batch_row, b.label FROM documents d JOIN (SELECT vec_id, arg_min(label, label) AS label FROM embeddings GROUP BY 1) b ON d.doc_id = b.vec_id")
def q_lookup_by_id(spark, d):
    """Documents looked up in all batches of a store by id; the first batch that has one."""
    first = table(spark, d, "embeddings").groupBy("vec_id").agg(F.min("label").alias("label"))
    return table(spark, d, "documents").select("doc_id").join(first, F.col("doc_id") == F.col("vec_id")).select("doc_id", F.col("vec_id").alias("batch_row"), "label")


@query("SELECT a.label AS a, b.label AS b FROM (SELECT DISTINCT label FROM embeddings) a, (SELECT DISTINCT label FROM embeddings) b WHERE a.label <= b.label EXCEPT SELECT label, label FROM embeddings WHERE label > 0")
def q_missing_pairs(spark, d):
    """Expected pairs of labels that a result doesn't have: a run is complete when none are left."""
    labels = table(spark, d, "embeddings").select("label").distinct()
    listed = labels.agg(F.array_sort(F.collect_set("label")).alias("all"))  # the labels of a comparison
    expected = listed.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a <= b")
    seen = labels.where("label > 0").select(F.col("label").alias("a"), F.col("label").alias("b"))
    return expected.join(seen, ["a", "b"], "left_anti")


@query("SELECT doc_id FROM documents ORDER BY sha256(doc_id || ':7'), doc_id LIMIT 100")
def q_sample(spark, d):
    """A sample without replacement that is the same at every run: rows of the smallest hashes; the limit is the feature."""
    docs = table(spark, d, "documents").select("doc_id")
    return docs.orderBy(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":7")), 256), "doc_id").limit(100)


@query()
def q_embedded_chunks(spark, d):
    """New texts cut into chunks and embedded, as rows of a store."""
    rows = table(spark, d, "documents").select("doc_id", "source", F.posexplode(chunks.recursive_chunks(F.col("text"))).alias("chunk_idx", "chunk"))
    out = embedding.embedded(rows, "chunk", embedding.hashing_embedder(16), "hashing-16", prefix="passage: ")
    return out.select(chunks.chunk_id(F.col("doc_id"), F.col("chunk_idx")).alias("id"), "doc_id", "source", "chunk_idx", "embedding")


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+') AS t FROM documents), s AS (SELECT doc_id, t, unnest(range(0, greatest(1, ceil((len(t) - 256) / 256.0)::BIGINT))) AS i FROM w WHERE len(t) > 0)
SELECT doc_id, i::BIGINT AS chunk_idx, len(t[i * 256 + 1 : i * 256 + 512]) AS tokens, sha256(array_to_string(t[i * 256 + 1 : i * 256 + 512], ' ')) AS digest FROM s""")
def q_token_chunks(spark, d):
    """Windows of 512 tokens, each 256 into the last one; white space stands for the tokenizer."""
    words = table(spark, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"[^ \t\n\x0B\f\r]+"), 0).alias("t"))
    return chunks.token_chunks(words, "t", 512, 256).select("doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.size("chunk").cast("bigint").alias("tokens"), F.sha2(F.array_join("chunk", " "), 256).alias("digest"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (props->>'$.k')::BIGINT END AS k, CASE WHEN event_id % 3 = 0 THEN 'No JSON found in response' END AS error, CASE WHEN event_id % 3 = 0 THEN 'nothing to say' END AS raw FROM events")
def q_feedback_verdicts(spark, d):
    """Verdicts of a judge: the JSON in an answer, or the error and the answer."""
    said = F.when(F.col("event_id") % 3 == 0, "nothing to say").otherwise(F.concat(F.lit("Scores: "), "props", F.lit(" as asked.")))
    rows = table(spark, d, "events").select("event_id", X.verdict_json(said, "k bigint").alias("v"))
    return rows.select("event_id", F.col("v.answer.k").alias("k"), F.col("v.error").alias("error"), F.col("v.raw").alias("raw"))


@query("SELECT vec_id, model, 'm' || vec_id % 4 AS answer FROM embeddings, (SELECT unnest(['a', 'b', 'c']) AS model) WHERE vec_id % 50 = 0")
def q_model_comparison(spark, d):
    """Questions put to three clients."""
    asked = vecs(spark, d).where("id % 50 = 0").select(F.col("id").alias("vec_id"))
    return scoring.compared(asked, "vec_id", {m: _answer for m in "abc"}).select("vec_id", "model", "answer")


def _answer(question) -> str:
    return f"m{question % 4}"
