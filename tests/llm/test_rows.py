"""Row-wise operators: language, toxicity, tokens, quality, URLs, decontamination."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from brookloom.llm import decontaminate, langid, near_dedup, quality, token_count, token_files, toxicity, url_filter
from brookloom.llm.common import held_out, words_of
from brookloom.llm.queries import QUERIES, tokenizer_path

ODD = [(1, None), (2, ""), (3, "  \n"), (4, "x" * 5000), (5, "a b " * 3000), (None, "A null id."), (6, "Same."), (6, "Same."), (7, "日本語 🙂 ▁ <s> <|endoftext|> it's 12"), (8, "1234 !!")]


def odd(spark):
    return spark.createDataFrame([(i, t, "x", 9) for i, t in ODD], "doc_id long, text string, score string, N_words int")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def brute_contamination(text, items, n=13):
    words = words_of(text.encode() if text else None)
    hit, names = set(), set()
    for name, item in items:
        w = words_of(item.encode() if item else None)
        windows = {tuple(w[i : i + min(n, len(w))]) for i in range(len(w) - min(n, len(w)) + 1)} if w else set()
        for x in windows:
            for i in range(len(words) - len(x) + 1):
                if tuple(words[i : i + len(x)]) == x:
                    hit.update(range(i, i + len(x)))
                    names.add("" if name is None else str(name))
    return len(words), len(hit), names


@pytest.mark.parametrize("most", [500_000, 3])
def test_decontamination_is_brute_force(spark, most):
    rng = random.Random(4)
    word = lambda: rng.choice(["ab", "Cd", "é", "7", "x"])
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 2, 5, 13, 16])))) for k in range(12)] + [(3, "again ab"), (None, "null item"), (99, None)]
    docs = [(i, t) for i, t in ODD] + [(100 + k, ", ".join(word() for _ in range(60)) + (" " + items[k % 12][1]) * (k % 3)) for k in range(20)] + [(200, "null item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(i, t, "kept") for i, t in docs], "doc_id long, text string, n_words string")
    found = decontaminate.judged(decontaminate.find_contamination(df, bench, max_windows=most))
    got = sorted(((r["doc_id"], r["text"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows_of(found)), key=repr)
    want = []
    for i, t in docs:
        n, hit, names = brute_contamination(t, items)
        want.append((i, t, n, hit, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), hit > 0 and 20 * hit >= n))
    assert got == sorted(want, key=repr)


def test_decontamination_modes(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    df = spark.createDataFrame([(1, "Keep this. One, two THREE! And that."), (2, "clean"), (3, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in rows_of(decontaminate.decontaminate(df, bench))) == [2, 3]
    spans = {r["doc_id"]: r["text"] for r in rows_of(decontaminate.decontaminate(df, bench, mode="spans"))}
    assert spans == {1: "Keep this. ! And that.", 2: "clean", 3: None}
    empty = bench.where("false")
    assert decontaminate.decontaminate(df, empty).count() == 3
    assert decontaminate.decontaminate(df.where("false"), bench).count() == 0


def test_token_counts_are_the_librarys(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    parts = ["a", "b", " ", "  ", "▁", "é", "中", "🙂", "\n", "th", "ing", "<s>", "<unk>", "\x00", "ab" * 300, "ﬁ"]
    texts = [t or "" for _, t in ODD] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(800)] + [" " * 300, "a" * 900]
    assert token_count.count_texts([t.encode() for t in texts], path) == [len(library.encode(t)) for t in texts]
    got = rows_of(token_count.count_tokens(odd(spark), path, limit=1000))
    assert [r["over_limit"] for r in got] == [len(library.encode(t or "")) > 1000 for _, t in ODD]
    assert got[0]["n_tokens"] == 0 and got[0]["N_words"] == 9


def test_token_ids_are_the_librarys():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(6)
    parts = ["a", "B", "It's", "'s", " ", "é", "é", "中", "\n", ".", ", ", ". ", "th", "<|endoftext|>", "<|ENDOFTEXT|>", "\x0b", "\x1c", "\xa0", "Σ", "ΑΣ", "12", "--", "ẞ"]
    texts = [t or "" for _, t in ODD] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    ids, ends = token_files.encode_texts([t.encode() for t in texts], path)
    start = 0
    for t, end in zip(texts, ends.tolist(), strict=True):
        assert ids[start:end].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
        start = end


def test_language(spark):
    rows = [(i, t, l) for i in range(60) for t, l in [(f"the house and the garden of {i}", "en"), (f"das haus und der garten von {i}", "de"), (f"la maison et le jardin de {i}", "fr"), (f"la casa y el jardín del {i}", "es")]]
    df = spark.createDataFrame(rows + [(900, "no language", None)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    got = rows_of(langid.identify(df.where("lang IS NOT NULL"), model))
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    found = rows_of(langid.identify(odd(spark), model))
    assert [r["lang_pred"] == "und" for r in found] == [not t or not any(c.isalpha() for c in t) for _, t in ODD]
    assert all(0 <= r["score"] <= 1 for r in found)
    assert langid.fit(df.where("lang <> 'es' OR doc_id < 20"), languages=3).languages == ["de", "en", "fr"]  # those of most rows
    none = langid.fit(df.where("false"))
    assert {r["lang_pred"] for r in rows_of(langid.identify(odd(spark), none))} == {"und"}
    three = langid.LanguageModel.fit([(lang, *langid.counts(t, langid.WORD_TABLE, langid.SIZES)) for lang, t in [("ru", "это дом".encode()), ("en", b"this is a house"), ("fr", b"une maison rouge")] * 5])
    assert three.predict([b"this house", "дом".encode(), b"maison"])[0] == ["en", "ru", "fr"]


def test_toxicity(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        words = [rng.choice(["sun", "moon", "tree", "river", "stone"]) + str(rng.randint(0, 30)) for _ in range(40)] + ["idiot"] * (bad and i % 10 == 0) + [f"zorgle{i % 7}"] * (bad and i % 10 == 5)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    truth = spark.createDataFrame(labels + [(5000, None), (1, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, truth)
    got = {r["doc_id"]: r["is_toxic"] for r in rows_of(toxicity.score(docs, model))}
    assert got == {i: bool(y) for i, y in labels}
    assert not any(r["is_toxic"] for r in rows_of(toxicity.score(odd(spark), model)))
    assert len(rows_of(toxicity.score(odd(spark), toxicity.fit(docs, truth.where("false"))))) == len(ODD)


def test_a_folds_labels_have_no_say_in_what_it_gets():
    """Out-of-fold probabilities of a fold stay when its labels are turned; those of the others don't."""
    import numpy as np

    rng = random.Random(9)
    words, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        words.append(sorted({f"w{rng.randint(0, 60)}".encode() for _ in range(12)} | ({b"vile" if i % 8 else b"grim", f"bad{i % 3}".encode()} if bad else set())))
        labels.append([int(bad)])
    labels, folds = np.array(labels), np.arange(240) % 3
    first = toxicity.ToxicityChain.fit(words, labels, folds, ("toxic",), kinds=2)
    for k in range(3):
        turned = labels.copy()
        turned[folds == k] = 1 - turned[folds == k]
        second = toxicity.ToxicityChain.fit(words, turned, folds, ("toxic",), kinds=2)
        same = np.abs(first.out_of_fold - second.out_of_fold).max(axis=1) < 1e-12
        assert same[folds == k].all() and not same[folds != k].all()
    assert first.out_of_fold.shape == (240, 2) and "out_of_fold" not in first.__getstate__()


def test_quality_risk_is_the_non_negative_one():
    """The fitted weights are where plain descent on the risk, written out row by row, leads."""
    import numpy as np

    texts = [b"Good words here.", b"More good words.", b"Fine text too."], [b"### $$$", b"Good words again.", b"%% || %%", b"@@ ##"]
    rows = [[quality.features_of(t) for t in part] for part in texts]
    model = quality.QualityModel.fit(*rows, prior=0.3, rounds=400)

    def risk(scores):
        p, u = (np.array([math_log1pexp(s) for s in part]) for part in scores)
        pos = np.mean([math_log1pexp(-s) for s in scores[0]])
        return 0.3 * pos + max(0.0, u.mean() - 0.3 * p.mean())

    def math_log1pexp(z):
        return float(np.logaddexp(0, z))

    margin = lambda part: [float(np.log(q / (1 - q))) for q in model.predict(part)]
    fitted = risk([margin(part) for part in texts])
    assert fitted < risk([[0.0] * 3, [0.0] * 4]) - 0.2
    assert min(margin(texts[0])) > max(margin([texts[1][0], texts[1][2], texts[1][3]]))
    # the gradient that the fit descends is that of the risk: moving the bias either way does not help
    for step in (-0.5, 0.5):
        assert risk([[m + step for m in margin(part)] for part in texts]) > fitted - 0.02


def test_prior_by_hand():
    import numpy as np

    positive = np.arange(10.0)
    unlabelled = np.concatenate([np.arange(10.0), np.full(10, -5.0)])
    # at thresholds 0 and 1: all and nine tenths of the positives are above, half and 0.45 of the others
    assert quality.estimate_prior(positive, unlabelled) == pytest.approx(0.5)
    assert quality.estimate_prior(positive, positive - 100) == 0.05 and quality.estimate_prior(positive, positive + 100) == 0.98


def test_language_votes_by_hand():
    """Two families of which one has three languages: votes, then margins, then the least of the winner's pairs."""
    import numpy as np

    model = langid.LanguageModel(["en", "de", "nl", "fr"])
    assert model.families == ["germanic", "romance"] and model.members["germanic"] == ["de", "en", "nl"]
    # probabilities come from the biases alone: no weights
    model.machines = [(("family", "germanic"), 1.0, 1.0, 0.0), (("pair", "de", "en"), -2.0, 1.0, 0.0), (("pair", "de", "nl"), 0.5, 1.0, 0.0), (("pair", "en", "nl"), 3.0, 1.0, 0.0)]
    model.weights = np.zeros((4, langid.WIDTH), np.float32)
    s = lambda z: 1 / (1 + np.exp(-z))
    names, scores = model.predict([b"any text", None, b"12"])
    assert names == ["en", "und", "und"] and scores[1:] == [0.0, 0.0]
    assert scores[0] == pytest.approx(s(1.0) * min(s(2.0), s(3.0)), abs=1e-9)
    model.machines[2] = (("pair", "de", "nl"), 4.0, 1.0, 0.0)
    model.machines[1], model.machines[3] = (("pair", "de", "en"), -0.1, 1.0, 0.0), (("pair", "en", "nl"), -0.1, 1.0, 0.0)
    # one vote each: de by a wide margin over nl
    assert model.predict([b"any text"])[0] == ["de"]


@pytest.mark.parametrize("name", ["langid", "toxicity", "token_count", "quality"])
def test_defined_cases_of_scoring(spark, name):
    """No rows, repeated rows, very long texts, nulls, and columns named as the results."""
    path = tokenizer_path("piece_bpe_32k.model")
    run, new = {
        "langid": (lambda df: langid.identify(df, langid.LanguageModel([])), ["lang_pred", "score"]),
        "toxicity": (lambda df: toxicity.score(df, toxicity.ToxicityChain(("toxic",))), ["p_toxic", "is_toxic"]),
        "token_count": (lambda df: token_count.count_tokens(df, path), ["n_bytes", "n_tokens", "over_limit"]),
        "quality": (lambda df: quality.score(df, quality.QualityModel()), ["score", "predicted"]),
    }[name]
    rows = [(i, t, "kept", "gone") for i, t in [*ODD, (77, "long word " * 60_000)]]
    df = spark.createDataFrame(rows, f"doc_id long, text string, other string, {new[0].upper()} string")
    got = rows_of(run(df))
    assert [list(r) for r in got[:1]] == [["doc_id", "text", "other", *new]]
    assert len(got) == len(rows) and all(r["other"] == "kept" for r in got)
    same = [tuple(r[c] for c in new) for r in got if r["doc_id"] == 6]
    assert len(same) == 2 and same[0] == same[1] and None not in same[0]
    assert rows_of(run(df.where("false"))) == [] and run(df.where("false")).columns == ["doc_id", "text", "other", *new]


def test_quality(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["river", "stone", "garden", "house"]) for _ in range(40)) + "."
    junk = lambda: " ".join(rng.choice(["###", "$$$x", "%%%", "|"]) for _ in range(40))
    rows = [(i, junk() if i % 4 == 0 else good()) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400, 2)], "doc_id long, quality int")
    model = quality.fit(docs, labels, use=~held_out())
    assert 0.6 < model.prior < 0.9
    got = rows_of(quality.score(docs, model))
    assert sum(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in got) >= 390
    found = rows_of(quality.score(odd(spark), model))
    assert all(0 <= r["score"] <= 1 for r in found) and len(found) == len(ODD)
    assert {r["score"] for r in rows_of(quality.score(odd(spark), quality.QualityModel()))} == {0.5}


def test_held_out(spark):
    df = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    got = {r["doc_id"]: r["h"] for r in rows_of(df.select("doc_id", held_out().alias("h")))}
    assert got == {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in [*range(50), None]}


def test_urls(spark):
    urls = [None, "", "nothing", "HTTP://WWW.A.ORG/x?y#z", "http://example.org/es/1", "http://m.example.org/en/12/", "http://b.com/fr/a", "http://b.com/de/a", "http://b.com/en/a", "http://b.net#f", "http://xorg/", "http://org", "http://a.org?q", "x://y://z/p", "http://Ünï.org/ä\nb?"]
    df = spark.createDataFrame([(k, u, "mine", u) for k, u in enumerate(urls)] * 2, "page_id long, url string, verdict string, _host string").withColumn("note", F.col("_host"))
    got = {r["page_id"]: r for r in rows_of(url_filter.judge(df))}

    def split(u):
        if not u or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut], rest[cut:]
        cut = min([path.find(c) for c in "?#" if c in path], default=len(path))
        return "".join(c.lower() if c.isascii() else c for c in host), path[:cut]

    for k, u in enumerate(urls):
        host, path = split(u)
        assert (got[k]["host"], got[k]["path"]) == (host, path)
        fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[k]["rule"] == (max(fit)[1] if fit else None)
        assert got[k]["verdict"] == (max(fit)[2] if fit else got[k]["verdict"]) and got[k]["verdict"] in ("allow", "block")
        assert got[k]["note"] == u and got[k]["_host"] == u
    assert url_filter.judge(df.where("false")).count() == 0
    unruled = url_filter.judge(df, rules=[])
    assert {r["verdict"] for r in rows_of(unruled.where("host <> ''"))} == {"allow"}


def test_url_grams_are_brute_force(spark):
    """Log ratios from tables of n-grams equal a plain Witten-Bell interpolation over orders 0 to 5."""
    import math
    from collections import Counter

    yes, no, order = ["http://a.org/x?id=Aé1", "http://a.org/x?id=Aé2"], ["http://a.org/x?id=B91", "http://b.com/#B"], url_filter.ORDER
    df = spark.createDataFrame([("allow", t) for t in yes] + [("block", t) for t in no], "_by_rule string, _text string")
    asked = ["http://a.org/x?id=Aé9", "ftp://Q"]
    grams = [("\x01" * order + t)[i : i + order + 1] for t in asked for i in range(len(t))]
    counts = url_filter.gram_counts(df)
    got = {r["gram"]: r["v"] for r in rows_of(url_filter.gram_ratios(spark.createDataFrame([(g,) for g in grams], "gram string"), counts)[0])}
    side = len(set("".join(yes + no))) + 1

    def log(texts, gram):
        seen = Counter(("\x01" * order + t)[order + i - k : order + i + 1] for t in texts for i in range(len(t)) for k in range(order + 1))
        p = 1 / side
        for k in range(order + 1):
            end = gram[len(gram) - k - 1 :]
            after = [n for g, n in seen.items() if len(g) == k + 1 and g[:-1] == end[:-1]]
            w = max(1, len(after))
            p = (seen[end] + w * p) / (sum(after) + w)
        return math.log(p)

    assert set(got) == set(grams)
    for g in grams:
        assert got[g] == pytest.approx(log(yes, g) - log(no, g), abs=1e-9)


def test_urls_are_judged_by_query_and_digits(spark):
    """URLs that differ only in their query, or in a digit or the case of a letter, can get other verdicts."""
    rules = [("allow", "good.org", "/"), ("block", "bad.org", "/")]
    rows = [f"http://good.org/p{k}?mode=alpha1&n=Z" for k in range(60)] + [f"http://bad.org/p{k}?mode=delta2&n=z" for k in range(60)]
    asked = ["http://c.net/p?mode=alpha1&n=Z", "http://c.net/p?mode=delta2&n=z", "http://c.net/p1?n=Z", "http://c.net/p1?n=z"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(rows + asked)], "page_id long, url string")
    got = {r["url"]: r for r in rows_of(url_filter.judge(df, rules=rules))}
    assert len(got) == len(rows) + len(asked)
    assert [got[u]["verdict"] for u in asked[:2]] == ["allow", "block"]
    assert got[asked[2]]["log_ratio"] > got[asked[3]]["log_ratio"]


def test_all_queries_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


def test_signatures_estimate_weighted_jaccard():
    import numpy as np

    rng = np.random.default_rng(0)
    off = []
    for _ in range(10):
        h = np.sort(rng.integers(0, 1 << 60, 150).astype(np.uint64))
        w = rng.integers(1, 30, 150)
        v = np.maximum(1, w + rng.integers(-8, 9, 150))
        s = near_dedup.signatures([(h, w), (h, v)], m=2000)
        off.append((s[0] == s[1]).mean() - near_dedup.similarity((h, w), (h, v)))
    assert abs(np.mean(off)) < 0.015
    alone = near_dedup.signatures([(h, w)], m=2000)
    assert (alone[0] == s[0]).mean() < 1.01  # the same numbers whatever else is in the batch
    assert (near_dedup.signatures([(h, w), (h, v)], m=2000)[0] == alone[0]).all()
