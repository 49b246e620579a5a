"""Operator 8, URL filters: rules first, then a character language-model ratio.

Rules allow or block a host with its subdomains and a path prefix; the longest rule that fits decides.
The URLs so accepted and rejected train two variable-order Markov models over characters (contexts of 0
to ORDER characters, interpolated with Witten-Bell weights, so an unseen context falls back to a shorter
one).  All other URLs are judged by the difference of the two log-likelihoods, divided by the number of
characters, against a threshold calibrated on held-out rule-labelled URLs: the point between the two class means at
equal distance in standard deviations.

Models see the whole URL, query and fragment too; only scheme and host are put in lower case.  Everything
is DataFrame and SQL functions.  A model is a table of n-grams that grows with the labelled URLs; of each
distinct n-gram of the other URLs the log ratio is found once, by joins, and URLs are joined to these.
Ends of n-grams are made distinct before any join, so no short context is a hot key.  Log ratios are added as
whole numbers, so sums don't depend on the order of rows.

Defined cases: a null URL, or one without "://", has an empty host and path and fits no rule; the models judge
it as any other, by its characters as they are; one without a character has a log ratio of 0; without any
accepted or any rejected URL the rest is allowed; URLs of any length are read whole; repeated rows are judged one
by one; an empty table gives an empty one; an input column that has the name of an output column is replaced,
and all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

#: Verdict, host and path of each rule of the query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of the longest context.
ORDER = 5
#: Stands before the first character.
START = "\x01"
#: Units of a log ratio of 1.
UNITS = 1 << 32
#: One rule-labelled URL in HOLD is kept for the threshold.
HOLD = 5
#: A gram with at least one of so many places is scored by a broadcast; there are no more of them than this.
HOT = 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def whole_url(url: Column) -> Column:
    """The URL with scheme and host in lower case; as it is without "://", empty for null."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    scheme = F.translate(F.substring_index(url, "://", 1), _UPPER, _LOWER)
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host_and_path(url)[0], F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1))), url, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (the earlier one of two alike) and its verdict; null where none does."""
    rule = verdict = None
    for what, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def grams_of(text: Column, order: int = ORDER) -> Column:
    """For each character of a text the `order` characters before it and itself."""
    # bound as the element of an array, so it is split once and not for each character
    bound = F.array(F.filter(F.split(F.concat(F.lit(START * order), text), ""), lambda c: c != ""))

    def each(chars: Column) -> Column:
        n = F.size(chars) - order
        return F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(chars, i, order + 1), ""))

    return F.get(F.transform(bound, each), 0)


def gram_counts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """labelled: _text and _by_rule.  gram (context and next character, of all lengths), yes and no (how often in accepted and rejected URLs)."""
    longest = (
        labelled.select("_by_rule", F.explode(grams_of(F.col("_text"), order)).alias("gram")).groupBy("gram")
        .agg(F.count_if(F.col("_by_rule") == "allow").alias("yes"), F.count_if(F.col("_by_rule") == "block").alias("no"))
    )
    ends = F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda k: F.right(F.col("gram"), k))
    return longest.select(F.explode(ends).alias("gram"), "yes", "no").groupBy("gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))


def gram_ratios(grams: DataFrame, counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, str]:
    """gram and v, the log ratio of its last character after the others, for each distinct gram of `order` + 1 characters; and a path to drop when it has been used.

    grams: each once.  Every distinct end of a gram is one row, so a context, or a shorter end, is met by no more
    rows than there are characters: no key of a join here is hot.  Probabilities are then found from the shortest ends to the longest.
    """
    contexts = counts.groupBy(F.substring("gram", F.lit(1), F.length("gram") - 1).alias("ctx")).agg(*(f(k).alias(f"{k}_{n}") for k in ("yes", "no") for f, n in ((F.sum, "n"), (lambda x: F.count_if(F.col(x) > 0), "t"))))
    levels = grams.distinct().select("gram", F.explode(F.sequence(F.lit(1), F.lit(order + 1))).alias("k")).select("k", F.right("gram", F.col("k")).alias("end")).distinct()
    levels = levels.withColumn("ctx", F.substring("end", F.lit(1), F.col("k") - 1))
    met = levels.join(counts.withColumnRenamed("gram", "end"), "end", "left").join(contexts, "ctx", "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in ("yes", "no", "yes_n", "no_n", "yes_t", "no_t")]
    met, met_at = cut(met.select("k", "end", *numbers), "url-levels")

    def chance(c: str, shorter: Column) -> Column:
        weight = F.greatest(F.col(f"{c}_t"), F.lit(1.0))
        return ((F.col(c) + weight * shorter) / (F.col(f"{c}_n") + weight)).alias(f"p_{c}")

    # one more than the characters met
    side = (counts.where(F.length("gram") == 1).agg(F.count("*")).scalar() + 1).cast("double")
    found = met.where("k = 1").select("end", *(chance(c, 1.0 / side) for c in ("yes", "no")))
    for k in range(2, order + 2):
        shorter = found.select(F.col("end").alias("tail"), F.col("p_yes").alias("s_yes"), F.col("p_no").alias("s_no"))
        longer = met.where(F.col("k") == k).withColumn("tail", F.right("end", F.lit(k - 1)))
        found = longer.join(shorter, "tail").select("end", *(chance(c, F.col(f"s_{c}")) for c in ("yes", "no")))
    return found.select(F.col("end").alias("gram"), (F.log("p_yes") - F.log("p_no")).alias("v")), met_at


def judge(pages: DataFrame, *, url_col: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages with host, path, rule, log_ratio (mean of a character; null by rule) and verdict."""
    out = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "log_ratio", "verdict")]
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    inner = [f"_in{k}" for k in range(len(out))]  # no clash with the columns of the judgement
    parsed = pages.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(out, inner, strict=True)), host.alias("_host"), path.alias("_path"), whole_url(F.col(f"`{url_col}`").cast("string")).alias("_text"))
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    parsed = parsed.withColumns({"_rule": rule, "_by_rule": verdict})
    open_ = parsed.where(F.col("_rule").isNull())

    labelled = parsed.where(F.col("_rule").isNotNull()).select("_text", "_by_rule", F.pmod(F.xxhash64("_text"), F.lit(HOLD)).alias("_fold"))
    counts, counts_at = cut(gram_counts(labelled.where("_fold <> 0")), "url-counts")
    # each URL once; a row of the held-out ones for each time they were met
    texts = open_.select("_text").union(labelled.where("_fold = 0").select("_text")).where("_text <> ''").distinct()
    places = texts.select(F.unhex(F.md5("_text")).alias("_key"), F.explode(grams_of(F.col("_text"))).alias("gram"))
    met, met_at = cut(places.groupBy("gram").agg(F.count("*").alias("n")), "url-grams")
    ratios, levels_at = gram_ratios(met.select("gram"), counts)
    # a gram with a thousandth of all places, as all URLs begin with, is one of a thousand at most: those are broadcast
    total = met.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ratios, ratios_at = cut(ratios.join(met, "gram").select("gram", F.round(F.col("v") * UNITS).cast("long").alias("v"), (F.col("n") * HOT >= total).alias("hot")), "url-ratios")
    hot, cold = F.broadcast(ratios.where("hot").select("gram", "v")), ratios.where("NOT hot").select("gram", "v")
    valued = places.join(hot, "gram").unionByName(places.join(hot, "gram", "left_anti").join(cold, "gram"))
    scores, _ = cut(valued.groupBy("_key").agg((F.sum("v") / F.count("*") / UNITS).alias("_ratio")), "url-scores")
    drop(parsed.sparkSession, counts_at, levels_at, met_at, ratios_at)

    key = F.unhex(F.md5("_text")).alias("_key")
    held = labelled.where("_fold = 0").select("_by_rule", key).join(scores, "_key").select("_by_rule", F.col("_ratio").alias("r"))
    yes, no = (F.when(F.col("_by_rule") == k, F.col("r")) for k in ("allow", "block"))
    sd_yes, sd_no = F.stddev_pop(yes) + 1e-6, F.stddev_pop(no) + 1e-6
    threshold = held.agg(F.round((F.avg(yes) * sd_no + F.avg(no) * sd_yes) / (sd_yes + sd_no), 9).alias("t")).scalar()
    by_model = F.when(F.coalesce("_ratio", F.lit(0.0)) >= F.coalesce(threshold, F.lit(float("-inf"))), "allow").otherwise("block")
    judged = open_.withColumn("_key", F.unhex(F.md5("_text"))).join(scores, "_key", "left").withColumn("_verdict", by_model)
    ruled = parsed.where(F.col("_rule").isNotNull()).withColumns({"_ratio": F.lit(None).cast("double"), "_verdict": F.col("_by_rule")})

    def columns(df: DataFrame) -> DataFrame:
        return df.select(
            *(F.col(i).alias(c) for c, i in zip(out, inner, strict=True)), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"),
            F.col("_ratio").alias("log_ratio"), F.col("_verdict").alias("verdict"),
        )

    return columns(ruled).union(columns(judged))
