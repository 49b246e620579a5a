"""Operator 11, fill-in-the-middle examples from relational units.

The units of a text (lines, or the matches of another pattern) are exploded with their ordinals, a window
sums their lengths, the two cuts of each document are requests for unit ordinals, and the sums at the
requested units give the offsets at which `substring` parts the text.  A text is shuffled once, to meet its
offsets; of its units only the lengths move.

Whether a document is transformed, in which order its parts go, and where it is cut are functions of a hash
of its id alone, so runs again agree.

Defined cases: null and empty texts are plain, with an empty text as output; a text that contains one of
the markers is plain; null ids hash as an empty id; repeated rows give repeated results; rows are told apart
by a number of their own, so no id or text is a hot key; texts of any length are read whole; an empty table
gives an empty one; an input column that has the name of an output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Unit patterns by name; the units of a text, one after the other, are the text.
UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"\s+|\S+", "char": r"(?s)."}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_ROW = "_fim_row"
NEW = ["n", "form", "prefix_chars", "middle_chars", "output"]


def drawn(id_col: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the hash of a seed and an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def repeatable(df: DataFrame) -> bool:
    """Whether df is files read with columns and filters only, so that its rows have the same places in every run."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.deterministic():
        kind, below = node.getClass().getSimpleName(), node.children()
        if below.size() == 0:
            return kind == "LogicalRelation"
        if kind not in ("Project", "Filter") or below.size() > 1:
            return False
        node = below.apply(0)
    return False


def marked(text: Column) -> Column:
    return F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))


def assembled(form: Column, prefix: Column, middle: Column, suffix: Column, text: Column) -> Column:
    """A text in its form."""
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from.  Parts hold no marker, so the first of each is the one that was put in."""
    inner = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    third = F.instr(output, MIDDLE)
    second = F.when(form == "psm", F.instr(output, SUFFIX)).otherwise(F.instr(output, PREFIX))
    size = len(PREFIX)
    a = F.substring(output, F.lit(1 + size), second - 1 - size)
    b = F.substring(output, second + F.length(inner), third - second - size)
    c = F.substring(output, third + F.lit(size), F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(a, c, b)).otherwise(F.concat(b, c, a))


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points) and output.

    unit: a name of UNITS or a pattern whose matches cover every text.  rate: percent of the texts that are
    transformed; spm: percent of those whose suffix comes first.

    Rows are numbered where they are read, so they must come back in the same order each time: docs that are
    more than columns and filters of files are written to the shared folder first.
    """
    if not repeatable(docs):
        docs, _ = cut(docs, "fill-middle")
    new = {c.lower() for c in NEW}
    kept = [c for c in docs.columns if c.lower() not in new]
    h1, h2, h3, h4 = drawn(F.col(f"`{id_col}`"), seed)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    numbered = docs.withColumn(_ROW, F.monotonically_increasing_id())

    # lengths go to their row's partition as one array and are exploded there
    sizes = F.transform(F.regexp_extract_all(text, F.lit(UNITS.get(unit, unit)), F.lit(0)), F.length)
    units = numbered.select(F.col(_ROW).alias("_fim_of"), sizes.alias("_fim_sizes")).repartition("_fim_of").select("_fim_of", F.posexplode("_fim_sizes").alias("_fim_at", "_fim_size"))
    row = Window.partitionBy("_fim_of")
    up_to = row.orderBy("_fim_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = row.orderBy("_fim_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = units.select("_fim_of", (F.col("_fim_at") + 1).alias("_fim_unit"), F.sum("_fim_size").over(up_to).alias("_fim_end"), F.count("*").over(every).alias("_fim_n"))

    # a cut before the first unit meets none and stays at 0; the last unit is always met, for the number of units
    requests = numbered.select(_ROW, h1.alias("_fim_h1"), h2.alias("_fim_h2"))
    cuts = [F.col(h) % (F.col("_fim_n") + 1) for h in ("_fim_h1", "_fim_h2")]
    at = F.col("_fim_unit")
    met = requests.join(ends, (F.col(_ROW) == F.col("_fim_of")) & ((at == F.col("_fim_n")) | at.isin(*cuts)), "left")
    offset = lambda cut: F.coalesce(F.max(F.when(at == cut, F.col("_fim_end"))), F.lit(0)).cast("int")
    offsets = met.groupBy(F.col(_ROW).alias("_fim_key")).agg(F.coalesce(F.max("_fim_n"), F.lit(0)).alias("n"), offset(F.least(*cuts)).alias("_fim_a"), offset(F.greatest(*cuts)).alias("_fim_b"))

    form = F.when((text == "") | marked(text) | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    rows = numbered.select(*(F.col(f"`{c}`") for c in kept if c.lower() != text_col.lower()), text.alias(text_col), form.alias("form"), _ROW)
    a, b, text = F.col("_fim_a"), F.col("_fim_b"), F.col(f"`{text_col}`")
    parts = [F.substring(text, F.lit(1), a), F.substring(text, a + 1, b - a), F.substring(text, b + 1, F.length(text))]
    output = assembled(F.col("form"), parts[0], parts[1], parts[2], text)
    transformed = F.col("form") != "plain"
    counts = [F.when(transformed, x.cast("bigint")).alias(name) for name, x in (("prefix_chars", a), ("middle_chars", b - a))]
    whole = rows.join(offsets.hint("shuffle_hash"), F.col(_ROW) == F.col("_fim_key"))
    return whole.select(*(F.col(f"`{c}`") for c in rows.columns[:-2]), "n", "form", *counts, output.alias("output"))
