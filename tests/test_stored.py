"""Stored structures: inverted index, cells of vectors, pages, and what they are built on."""

import math
import random
from collections import Counter

import pytest

from inkfield.operators import cells, inverted, pages, quantiles
from inkfield.plans import retrieval

K1, B = 1.5, 0.75


def folder(tmp_path, name):
    return f"file://{tmp_path}/{name}"


# ------------------------------------------------------------------ inverted index


def best(docs, queries, k):
    words = {d: (t or "").lower().split() for d, t in docs}
    n, avg = len(words), sum(map(len, words.values())) / max(1, len(words))
    df = Counter(w for ws in words.values() for w in set(ws))
    out = []
    for q, text in queries:
        score = {}
        for w, qtf in Counter(text.lower().split()).items():
            for d, ws in words.items():
                if tf := ws.count(w):
                    idf = math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1)
                    score[d] = score.get(d, 0.0) + qtf * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / avg))
        order = sorted((-round(s, 6), d) for d, s in score.items())[:k]
        out += [(q, d, i + 1, round(-s, 5)) for i, (s, d) in enumerate(order)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    text = lambda: " ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randint(1, 40)))
    return [(i, text()) for i in range(400)] + [(400, None), (401, ""), (402, "w0 " * 300), (403, "w0 " * 300)], [(i, text()) for i in range(12)] + [(90, "nowhere"), (91, "")]


def test_index_answers_as_all_postings_do(spark, tmp_path, corpus, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 4)
    docs, queries = corpus
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for segment in range(3):
        index = inverted.append(table.filter(f"doc_id % 3 = {segment}"), folder(tmp_path, "i"), segment)
    got, report = inverted.search(index, spark.createDataFrame(queries, "item_id long, text string"), 5)
    assert sorted((r["item_id"], r["doc_id"], r["rank"], round(r["score"], 5)) for r in got.collect()) == best(docs, queries, 5)
    seen = report.collect()
    assert all(r["read"] <= r["blocks"] for r in seen) and sum(r["read"] for r in seen) < 0.9 * sum(r["blocks"] for r in seen)


def test_index_of_odd_tables(spark, tmp_path, corpus):
    empty = spark.createDataFrame([], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    index = inverted.append(empty, folder(tmp_path, "e"), 0)
    assert inverted.search(index, queries, 3)[0].count() == 0
    index = inverted.append(spark.createDataFrame([(5, "a a", 1), (6, None, 1)], "doc_id long, text string, term int"), folder(tmp_path, "e"), 1)
    assert [(r["item_id"], r["doc_id"]) for r in inverted.search(index, queries, 3)[0].collect()] == [(1, 5)]
    with pytest.raises(Exception, match="exists"):
        inverted.append(empty, folder(tmp_path, "e"), 1)


# ------------------------------------------------------------------ cells of vectors


def nearest_of(rows, queries, k):
    out = []
    for q, v in queries:
        far = sorted((round(sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), 9), i) for i, x in rows)[:k]
        out += [(q, i, n + 1, round(d, 6)) for n, (d, i) in enumerate(far)]
    return sorted(out)


def found(df):
    return sorted((r["query_id"], r["vec_id"], r["rank"], round(r["distance"], 6)) for r in df.collect())


@pytest.fixture(scope="module")
def clustered():
    rng = random.Random(8)
    hearts = [[rng.uniform(-50, 50) for _ in range(4)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 1) for c in rng.choice(hearts)]) for i in range(900)]
    rows += [(900 + i, rows[0][1]) for i in range(60)] + [(960, [1e3, 0.0, 0.0, 0.0])]
    return rows, [(i, [c + rng.gauss(0, 0.1) for c in rows[i * 40][1]]) for i in range(20)] + [(90, [0.0] * 4), (91, [1e3, 1.0, 0.0, 0.0])]


def test_cells_give_the_nearest_of_all_rows(spark, tmp_path, clustered, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 16)
    monkeypatch.setattr(cells, "VISITS", 3)
    rows, queries = clustered
    kind = "vec_id long, embedding array<double>"
    store = cells.build(spark.createDataFrame([*rows, (2000, None), (2001, [None, 1.0, 1.0, 1.0]), (2002, [float("nan")] * 4)], kind), folder(tmp_path, "c"))
    asked = spark.createDataFrame([*queries, (92, None), (90, [0.0] * 4)], "query_id long, embedding array<double>")
    got, report = cells.search(store, asked, 7)
    assert found(got) == nearest_of(rows, queries, 7)
    seen = report.collect()
    assert len(seen) == len(queries) and all(r["blocks_visited"] <= r["blocks"] and r["cells_visited"] <= r["cells"] for r in seen)
    assert sum(r["blocks_visited"] for r in seen) < 0.5 * sum(r["blocks"] for r in seen)


def test_cells_of_odd_tables(spark, tmp_path):
    kind = "vec_id long, embedding array<double>"
    asked = spark.createDataFrame([(1, [0.5])], "query_id long, embedding array<double>")
    assert cells.search(cells.build(spark.createDataFrame([], kind), folder(tmp_path, "none")), asked, 3)[0].count() == 0
    few = cells.build(spark.createDataFrame([(5, [1.0]), (4, [0.0]), (5, [1.0])], kind), folder(tmp_path, "few"))
    assert found(cells.search(few, asked, 9)[0]) == [(1, 4, 1, 0.25), (1, 5, 2, 0.25), (1, 5, 3, 0.25)]


@pytest.mark.parametrize("block", [3, 1_024])
def test_scan_gives_the_nearest_of_all_rows(spark, clustered, monkeypatch, block):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    rows, queries = clustered
    asked = spark.createDataFrame([*queries, (92, None)], "query_id long, embedding array<double>")
    for part in (rows, rows[:3]):
        table = spark.createDataFrame([*part, (2000, None)], "vec_id long, embedding array<double>")
        assert found(retrieval.nearest(asked, table, "query_id", "vec_id", 7)) == nearest_of(part, queries, 7)


# ------------------------------------------------------------------ pages and order statistics


def test_pages_at_any_depth_read_few_files(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "hot", "hot", None]), rng.randint(0, 30), "x") for _ in range(1_000)]
    table = spark.createDataFrame(rows, "k string, n int, part string").drop("part")
    stored = pages.store(table.repartition(5), folder(tmp_path, "p"), ["k", "n"], 50)
    order = sorted(((k, n) for k, n, _ in rows), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert stored.total() == 1_000 and stored.files.count() > 12
    for limit, offset in ((10, 0), (10, 501), (25, 990), (7, 5_000), (120, 300), (0, 3)):
        page = stored.page(limit, offset)
        assert [tuple(r) for r in page.collect()] == order[offset : offset + limit]
        assert len(page.inputFiles()) <= 2 + limit // 20
    last = order[700]
    got = stored.after(last, 15)
    assert [tuple(r) for r in got.collect()] == [r for r in order if r[0] is not None and r > last][:15] and len(got.inputFiles()) <= 4
    assert stored.after(("zz", 0), 5).count() == 0


def test_pages_of_an_empty_table(spark, tmp_path):
    stored = pages.store(spark.createDataFrame([], "k string, n int"), folder(tmp_path, "q"), ["k"])
    assert stored.total() == 0 and stored.page(5, 2).columns == ["k", "n"] and stored.page(5).count() == 0 and stored.after(("a",), 3).count() == 0


@pytest.mark.parametrize("bins", [64, 4_096])
def test_percentiles_equal_sorting(spark, bins):
    rng = random.Random(1)
    columns = {
        "even": [rng.uniform(-5, 5) for _ in range(501)], "steep": [math.exp(rng.uniform(-300, 300)) for _ in range(300)], "hot": [7.0] * 400 + [rng.gauss(0, 1) for _ in range(100)],
        "wide": [-1.7e308, 1.7e308, 0.0, 5e-324, 1.0], "one": [3.5], "two": [1.0, 2.0],
    }
    for name, values in columns.items():
        table = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double")
        s = sorted(values)
        for share, got in zip((0.0, 0.5, 0.95, 1.0), quantiles.percentiles(table, "x", [0.0, 0.5, 0.95, 1.0], bins), strict=True):
            at = share * (len(s) - 1)
            low, high = s[int(at)], s[min(int(at) + 1, len(s) - 1)]
            assert got == low + (high - low) * (at - int(at)), (name, share)
    assert quantiles.percentiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == [None]
