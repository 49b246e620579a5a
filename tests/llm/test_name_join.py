"""Names within an edit distance: the distance, the descent, pages, hot names and the query against brute force."""

import random
import zlib
from collections import defaultdict

import pytest

from brookloom.llm import name_join
from brookloom.llm.queries import QUERIES


def osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def swapped(name, key):
    h = zlib.crc32(str(key).encode())
    if name is None or len(name) < 2 or h % 2:
        return name
    p = h % (len(name) - 1)
    return name[:p] + name[p + 1] + name[p] + name[p + 2 :]


def brute(clients, vendors, most):
    groups = defaultdict(list)
    for v, stored in vendors:
        name = swapped(stored, v)
        for c, text in clients:
            if name and text and abs(len(name) - len(text)) <= most and osa(name, text) <= most:
                groups[v, osa(name, text)].append(c)
    return sorted((v, k, len(c), min(c), sum(zlib.crc32(str(i).encode()) for i in c)) for (v, k), c in groups.items())


@pytest.mark.parametrize("most", [1, 2, 3])
def test_descent_is_brute_force(most):
    rng = random.Random(most)
    for _ in range(300):
        width = rng.randint(1, 8)
        word = lambda n: "".join(rng.choice("abé") for _ in range(n))
        names = sorted({word(width) for _ in range(rng.randint(1, 40))})
        texts = [word(rng.randint(max(1, width - most), width + most)) for _ in range(20)] + [x[:k] + x[k : k + 2][::-1] + x[k + 2 :] for x in names for k in [rng.randrange(width)]]
        want = sorted((a, b, osa(a, b)) for a in names for b in texts if osa(a, b) <= most)
        got = sorted((names[a], texts[b], int(k)) for a, b, k in zip(*name_join._search(names, width, texts, most), strict=True))
        assert got == want
        back = name_join._search([x[::-1] for x in names], width, [x[::-1] for x in texts], most, name_join.BACKWARD)
        ahead = name_join._search(names, width, texts, most, name_join.FORWARD)
        assert sorted((names[a], texts[b], int(k)) for part in (ahead, back) for a, b, k in zip(*part, strict=True)) == want


NAMES = ["Anna Karlsson", "Ana Karlsson", "Anna Karlson", "nAna Karlsson", "Jo", "oJ", "J", "", None, "中文", "文中", "🙂", "a b", "ab ", "Anna Karlsson ", "Jo  Jo", "x" * 300, "x" * 299 + "y", "a\x00b", "ca", "abc"]


@pytest.mark.parametrize("sizes", [{}, {"page": 7, "chunk": 5, "step": 3}])
def test_matches_are_brute_force(spark, sizes):
    rng = random.Random(3)
    part = lambda: rng.choice(["An", "Jo", "el", "ma", "Vi", "ström", "son", "ez"])
    names = NAMES + ["".join(part() for _ in range(rng.randint(1, 5))) for _ in range(150)]
    names += [n[:k] + n[k + 1 :] + rng.choice("axz") * rng.randint(0, 1) for n in names[21:] for k in [rng.randrange(len(n))]]
    clients = [(i, rng.choice(names)) for i in range(500)] + [(i, "Anna Karlsson") for i in range(500, 900)] + [(7, "Jo"), (7, "Jo")]
    vendors = [(i, rng.choice(names)) for i in range(200)] + [(i, "Jo") for i in range(200, 260)] + [(1000, None), (1001, "")]
    c = spark.createDataFrame([(i, n, "x") for i, n in clients], "client_id long, name string, vendor_id string")
    v = spark.createDataFrame([(i, n, 1) for i, n in vendors], "vendor_id long, name string, distance int")
    got = sorted(map(tuple, name_join.summed_matches(c, v, **sizes).collect()))
    assert got == brute(clients, vendors, 2)


def test_empty_sides_and_short_steps(spark):
    c = spark.createDataFrame([(1, "ab")], "client_id long, name string")
    v = spark.createDataFrame([(1, "ab")], "vendor_id long, name string")
    assert name_join.summed_matches(c.where("false"), v).collect() == []
    assert name_join.summed_matches(c, v.where("false")).collect() == []
    with pytest.raises(ValueError, match="further"):
        name_join.near_names(c, v, step=2)


def test_query_on_a_small_table(spark, sf):
    clients = [(r.client_id, r.name) for r in spark.read.parquet(f"{sf}/clients.parquet").collect()]
    vendors = [(r.vendor_id, r.name) for r in spark.read.parquet(f"{sf}/vendors.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op13_name_join"](spark, sf).select("vendor_id", "distance", "n_clients", "first_client_id", "clients_crc").collect())
    assert got == brute(clients, vendors, 2)
