"""Operator 13, joining names within an edit distance by trie descent.

The distance counts insertions, deletions and substitutions of a code point and exchanges of two adjacent
ones, no substring edited twice (optimal string alignment).

The names of one side form a trie for each length.  A trie is kept in pages: a page holds the names (or, where
they are more than PAGE, the beginnings of STEP more characters) below one prefix, as rows of a table.  The
names of the other side go to the tries whose length is within the distance and descend, all names of a batch
a level at a time: a node's row of the dynamic programme is computed once for all names below it, the row
before it is retained for exchanges, and a node is left when no cell of its row can still end within the
distance.  As all names of a trie are equally long, the cells that can are a band of a few.  What is alive at
the end of an inner page goes on to the pages below.

Names descend from both ends, for one half of a name takes half of the edits at most: up to the middle a
descent leaves nodes that took more.  A trie of one page is searched from both ends in one go; a paged one is
kept twice, by beginnings and by ends.

A page and the names that visit it meet in groups: a page that many names visit is copied to as many groups
as it takes for about CHUNK names each, a page of many entries is dealt out in parts.  Repeated names of
either side are one.  Nothing is broadcast by hand, and the driver gets only whether a level has pages.

Defined cases: null and empty names take no part; names are compared by code points as they are, without
any folding; names of any length have their trie; repeated rows count as often as they are there; empty
tables give an empty one; columns of either side that aren't named are left out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, cut, ship

#: Entries of a page, names of a group, and characters from a page to the next.
PAGE, CHUNK, STEP = 8192, 8192, 6
#: Names that descend at a time: bounds the pairs of names and nodes that are held.
AT_ONCE = 2048
_FAR = 100  # more than any distance; sums of two stay in a byte


def codes(names: list[str], width: int) -> np.ndarray:
    """Equally long names as rows of code points."""
    return np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).reshape(len(names), width)


class Trie:
    """The nodes of sorted, distinct, equally long names by depth, as arrays: a node's children are neighbours."""

    def __init__(self, names: list[str]) -> None:
        self.depth = len(names[0])
        rows = codes(names, self.depth)
        self.children: list[np.ndarray] = []
        self.chars: list[np.ndarray] = []
        fresh = np.zeros(len(names), bool)
        fresh[0] = True
        parent = np.zeros(len(names), np.int64)
        for d in range(self.depth):
            fresh = fresh.copy()
            fresh[1:] |= rows[1:, d] != rows[:-1, d]
            at = np.flatnonzero(fresh)
            self.chars.append(rows[at, d])
            self.children.append(np.searchsorted(parent[at], np.arange(parent[-1] + 2)))
            parent = np.cumsum(fresh) - 1


class Band:
    """The cells of a row that can still end within the distance, for whole names of one length and texts of another.

    A cell of the row at depth d is the distance to the first d + o characters of a text; o edits at least lead to
    it, and as many as o differs from the last offset lead on.
    """

    def __init__(self, length: int, texts: np.ndarray, most: int) -> None:
        n, self.width = texts.shape
        end = self.width - length
        self.offsets = [o for o in range(-most, most + 1) if abs(o) + abs(o - end) <= most]
        self.onward = np.array([abs(o - end) for o in self.offsets], np.int8)
        self.most, self.pad, self.stride = most, most + 2, length + 3 * most + 5
        padded = np.full((n, self.stride), 0xFFFFFFFF, np.uint32)
        padded[:, self.pad : self.pad + self.width] = texts
        self.flat = padded.reshape(-1)

    def start(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The row at the root, and none before it."""
        row = np.tile(np.array([o if 0 <= o <= self.width else _FAR for o in self.offsets], np.int8), (n, 1))
        return row, np.full_like(row, _FAR)

    def after(self, d: int, above: np.ndarray, higher: np.ndarray, was: np.ndarray, own: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The rows at depth d from the two rows above, the characters that led to them, and the places of the texts."""
        low, wide = self.offsets[0], len(self.offsets)
        base = text * self.stride + (self.pad + d + low - 2)
        chars = [self.flat[base + k] for k in range(wide + 1)]
        own_is, was_is = [own == c for c in chars], [was == c for c in chars]
        new = np.empty_like(above)
        for k in range(wide):
            if not 0 <= d + low + k <= self.width:
                new[:, k] = _FAR
                continue
            best = above[:, k] + ~own_is[k + 1]
            if k + 1 < wide:
                np.minimum(best, above[:, k + 1] + 1, out=best)
            if k:
                np.minimum(best, new[:, k - 1] + 1, out=best)
            swapped = was_is[k + 1] & own_is[k]
            new[:, k] = np.where(swapped, np.minimum(best, higher[:, k] + 1), best)
        return new

    def alive(self, rows: np.ndarray, strict: int) -> np.ndarray:
        """Rows with a cell that took at most `strict` edits and can end within the distance."""
        ok = rows + self.onward <= self.most
        if strict < self.most:
            ok &= rows <= strict
        return ok.any(1)


def halves(length: int, most: int, backward: bool) -> tuple[int, int]:
    """Up to which depth a descent may make how many edits only.

    Of the two halves of a name one takes half of the edits at most: the descent from that end finds the name.
    An exchange across the middle counts as one more for either half.
    """
    return (length - length // 2 if backward else length // 2), (most + 1) // 2


def descend(trie: Trie, length: int, texts: np.ndarray, most: int, backward: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes at the trie's depth, texts and least distances of what is alive there.

    length: of the whole names that the trie holds or begins; texts: equally long names as code points.
    """
    band, half = Band(length, texts, most), halves(length, most, backward)
    if not band.offsets:
        return (np.zeros(0, np.int64),) * 3
    node, text = np.zeros(len(texts), np.int64), np.arange(len(texts))
    row, before = band.start(len(texts))
    last = np.full(len(texts), 0xFFFFFFFE, np.uint32)
    for d in range(1, trie.depth + 1):
        first = trie.children[d - 1][node]
        count = trie.children[d - 1][node + 1] - first
        of = np.repeat(np.arange(len(node)), count)
        child = np.arange(len(of)) + np.repeat(first - (np.cumsum(count) - count), count)
        own, text, above = trie.chars[d - 1][child], text[of], row[of]
        new = band.after(d, above, before[of], last[of], own, text)
        live = np.flatnonzero(band.alive(new, half[1] if d <= half[0] else most))
        node, text, last, row, before = child[live], text[live], own[live], new[live], above[live]
        if not len(node):
            return (np.zeros(0, np.int64),) * 3
    return node, text, (row + band.onward).min(1).astype(np.int64)


def found_forward(names: np.ndarray, texts: np.ndarray, most: int) -> np.ndarray:
    """Which pairs of names and texts a forward descent has found too."""
    band, (depth, strict) = Band(names.shape[1], texts, most), halves(names.shape[1], most, False)
    every, last = np.arange(len(texts)), np.full(len(texts), 0xFFFFFFFE, np.uint32)
    (row, before), ok = band.start(len(texts)), np.ones(len(texts), bool)
    for d in range(1, depth + 1):
        row, before = band.after(d, row, before, last, names[:, d - 1], every), row
        last = names[:, d - 1]
        ok &= band.alive(row, strict)
    return ok


FORWARD, BACKWARD, BOTH = 0, 1, 2


def _search(names: list[str], length: int, texts: list[str], most: int, way: int = BOTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `descend`, for names in any order and texts of several lengths, some at a time, from one end or both.

    Whole names that the other descent finds are left out of the backward one.
    """
    tries = []
    for backward in (False, True):
        if way in (int(backward), BOTH):
            own = [x[::-1] for x in names] if backward and way == BOTH else names
            order = sorted(range(len(own)), key=own.__getitem__)
            tries.append((backward, np.array(order), Trie([own[i] for i in order])))
    rows, sizes = codes(names, len(names[0])), np.fromiter(map(len, texts), np.int64, len(texts))
    found = [(np.zeros(0, np.int64),) * 3]
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        for at in range(0, len(own), AT_ONCE):
            some = own[at : at + AT_ONCE]
            plain = codes([texts[i] for i in some], int(size))
            for backward, order, trie in tries:
                turned = backward and way == BOTH
                node, text, distance = descend(trie, length, plain[:, ::-1] if turned else plain, most, backward)
                node = order[node]
                if backward and trie.depth == length and len(node):
                    a, b = rows[node], plain[text]
                    new = ~(found_forward(a, b, most) if turned else found_forward(a[:, ::-1], b[:, ::-1], most))
                    node, text, distance = node[new], text[new], distance[new]
                found.append((node, some[text], distance))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _paged(names: DataFrame, page: int, step: int) -> tuple[DataFrame, list[DataFrame]]:
    """Entries of the last pages, and of the inner pages by level: _of (length), _way, _prefix, _entry."""
    prefix = lambda d: F.substring("_entry", 1, d)
    rest, leaves, inner, depth = names, [], [], 0
    while True:
        rest = rest.withColumn("_prefix", prefix(depth))
        large = rest.groupBy("_of", "_way", "_prefix").agg(F.count("*").alias("_n")).where(F.col("_n") > page).select("_of", "_way", "_prefix", F.lit(True).alias("_large"))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*leaves, rest]), inner
        told = rest.join(large, ["_of", "_way", "_prefix"], "left")
        leaves.append(told.where("_large IS NULL").drop("_large"))
        rest = told.where("_large").drop("_large")
        inner.append(rest.select("_of", "_way", "_prefix", prefix(depth + step).alias("_entry")).distinct())
        depth += step


def _visit(visits: DataFrame, entries: DataFrame, out: T.StructType, most: int, page: int, chunk: int) -> DataFrame:
    """What is alive of each visitor at the end of its page: the columns of visits, _entry and _distance."""
    key = ["_of", "_way", "_prefix"]
    pages = entries.groupBy(*key).agg(F.ceil(F.count("*") / page).alias("_parts"))
    crowds = visits.groupBy(*key).agg(F.ceil(F.count("*") / chunk).alias("_groups"))
    deal = pages.join(crowds, key)
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = visits.join(deal, key).select(*visits.columns, place("_text", "_groups").alias("_group"), every("_parts").alias("_part"))
    right = entries.join(deal, key).select(*key, "_entry", place("_entry", "_parts").alias("_part"), every("_groups").alias("_group"))
    meet = [*key, "_group", "_part"]
    arrow = pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in out])

    def run(keys: tuple, some: pa.Table, own: pa.Table) -> pa.Table:
        if not (some.num_rows and own.num_rows):
            return arrow.empty_table()
        names = own.column("_entry").to_pylist()
        node, text, distance = _search(names, keys[0].as_py(), some.column("_text").to_pylist(), most, keys[1].as_py())
        columns = {c: some.column(c).take(pa.array(text)) for c in some.column_names if c not in ("_group", "_part")}
        columns["_entry"] = pa.array(names, pa.string()).take(pa.array(node))
        columns["_distance"] = pa.array(distance, pa.int32())
        return pa.Table.from_arrays([columns[f.name].cast(f.type) for f in arrow], schema=arrow)

    return left.groupBy(*meet).cogroup(right.groupBy(*meet)).applyInArrow(run, out)


def near_names(texts: DataFrame, names: DataFrame, *, text_col: str = "name", name_col: str = "name", most: int = 2, page: int = PAGE, chunk: int = CHUNK, step: int = STEP) -> DataFrame:
    """name, distance and the columns of texts, for each text and each distinct name of names within `most` edits.

    texts should hold each text once, with what is known of its rows already summed up.
    """
    ship(texts.sparkSession)
    if step <= most:
        raise ValueError("a page must reach further than the distance, or all its entries stay alive")
    kept = [c for c in texts.columns if c != text_col]
    held = F.struct(*(F.col(f"`{c}`") for c in kept), F.lit(0).alias("_"))
    trie, _ = cut(names.select(F.col(f"`{name_col}`").alias("_entry")).where("_entry <> ''").distinct().select(F.length("_entry").alias("_of"), "_entry"), "name-trie")
    size = F.length("_text")
    lengths = F.explode(F.sequence(F.greatest(size - most, F.lit(1)), size + most)).alias("_of")
    visits = texts.select(F.col(f"`{text_col}`").alias("_text"), held.alias("_held")).where("_text <> ''").select("_text", "_held", lengths, F.lit("").alias("_prefix"))

    large = trie.groupBy("_of").agg(F.count("*").alias("_n")).where(F.col("_n") > page).select("_of")
    out = T.StructType([T.StructField(c, t) for c, t in (("_text", T.StringType()), ("_held", visits.schema["_held"].dataType), ("_of", T.IntegerType()), ("_way", T.IntegerType()), ("_entry", T.StringType()), ("_distance", T.IntegerType()))])
    sizes = (out, most, page, chunk)
    one = trie.join(large, "_of", "left_anti").select("_of", F.lit(BOTH).alias("_way"), F.lit("").alias("_prefix"), "_entry")
    found = _visit(visits.withColumn("_way", F.lit(BOTH)), one, *sizes)
    if not large.isEmpty():
        ways = F.explode(F.array(F.lit(FORWARD), F.lit(BACKWARD))).alias("_way")
        turned = lambda df, c: df.withColumn(c, F.when(F.col("_way") == BACKWARD, F.reverse(c)).otherwise(F.col(c)))
        leaves, inner = _paged(turned(trie.join(large, "_of", "left_semi").select("*", ways), "_entry"), page, step)
        visits = turned(visits.join(large, "_of", "left_semi").select("*", ways), "_text")
        levels = [visits]
        for entries in inner:
            visits, _ = cut(_visit(visits, entries, *sizes).select("_text", "_held", "_of", "_way", F.col("_entry").alias("_prefix")), "name-visits")
            levels.append(visits)
        found = found.unionByName(turned(turned(_visit(reduce(DataFrame.unionByName, levels), leaves, *sizes), "_text"), "_entry"))
    return found.select(F.col("_entry").alias("name"), F.col("_distance").alias("distance"), F.col("_text").alias("text"), *(F.col(f"_held.`{c}`") for c in kept))


def misspelt(name: Column, key: Column) -> Column:
    """A name with two adjacent code points exchanged where the crc32 of the key is even, at a place it names."""
    h, n = F.crc32(key.cast("string")), F.length(name)
    p = (h % F.greatest(n - 1, F.lit(1))).cast("int")
    changed = F.concat(F.substring(name, F.lit(1), p), F.substring(name, p + 2, F.lit(1)), F.substring(name, p + 1, F.lit(1)), F.substring(name, p + 3, n))
    return F.when((h % 2 == 0) & (n >= 2), changed).otherwise(name)


def summed_matches(clients: DataFrame, vendors: DataFrame, *, client_id: str = "client_id", vendor_id: str = "vendor_id", name_col: str = "name", most: int = 2, **sizes: int) -> DataFrame:
    """vendor_id, distance, n_clients, first_client_id and clients_crc of the clients named like each (misspelt) vendor.

    Clients of one name are summed up before they descend, and matches by vendor name before they meet the vendors.
    """
    texts = clients.where(F.col(name_col) != "").groupBy(F.col(name_col).alias("text")).agg(
        F.count("*").alias("n"), F.min(client_id).alias("first"), F.sum(F.crc32(F.col(client_id).cast("string"))).alias("crc"))
    named = vendors.select(F.col(vendor_id), misspelt(F.col(name_col), F.col(vendor_id)).alias("name")).where("name <> ''")
    pairs = near_names(texts, named, text_col="text", most=most, **sizes)
    of_name = pairs.groupBy("name", "distance").agg(F.sum("n").alias("n_clients"), F.min("first").alias("first_client_id"), F.sum("crc").alias("clients_crc"))
    return named.join(of_name, "name").select(vendor_id, "distance", "n_clients", "first_client_id", "clients_crc")
