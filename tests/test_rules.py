"""Invariants and sequential models that SQL does not state."""

import os
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkfield.functions import people as kin
from inkfield.functions import text as tx
from inkfield.operators import graph, relational
from inkfield.plans import catalog
from inkfield.plans import retrieval as rt
from inkfield.sources import tables as src

from .conftest import SF


def pack_model(text, most, overlap, ends):
    """Greedy packing, sentence by sentence."""
    import re

    sents = [s for s in re.findall(f"[^{ends}]*[{ends}]?", text) if re.sub(f"[{ends}]$", "", s).strip(" ") != ""]
    out, cur, n = [], [], 0
    size = lambda s: len(s.rstrip(ends))
    for s in sents:
        if cur and n + size(s) > most:
            out.append("".join(cur))
            keep, total = [], 0
            for t in reversed(cur):
                if total + size(t) > overlap:
                    break
                keep.insert(0, t)
                total += size(t)
            if n <= overlap:
                keep, total = [], 0
            cur, n = keep, total
        cur.append(s)
        n += size(s)
    if cur:
        out.append("".join(cur))
    return out


def test_chunks_by_size_follow_the_sequential_model(spark):
    docs = src.load(spark, SF, "documents")
    got = {}
    for r in tx.chunks_by_size(docs, "doc_id", 200, 50, ".!?;").orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    for r in docs.collect():
        assert got.get(r["doc_id"], []) == pack_model(r["text"], 200, 50, ".!?;"), r["doc_id"]


def test_pages_are_disjoint_and_exhaustive(spark):
    p = src.people(spark, SF)
    seen = [r["uri"] for k in range(0, 160, 40) for r in relational.page(p, 40, k).collect()]
    assert sorted(seen) == sorted(r["uri"] for r in p.collect()) and len(set(seen)) == len(seen)


def test_degrees_sum_to_twice_the_edges(spark):
    r = src.relations(spark, SF)
    assert graph.degrees(r).agg(F.sum("degree")).first()[0] == 2 * r.count()


def test_clusters_are_connected_components(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 10), (10, 3)], "a long, b long")
    got = {r["node"]: r["cluster"] for r in graph.clusters(pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 1, 9: 1, 10: 1}


def test_few_collections_give_more_of_each(spark, tmp_path):
    spark.createDataFrame([(i, f"word{i % 3} common text", "ab"[i % 2]) for i in range(12)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "common text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = catalog.QUERIES["per_collection_topk"](spark, str(tmp_path)).collect()
    assert sorted(Counter(r["source"] for r in rows).values()) == [2, 3]


def test_bounded_subgraph_has_its_centre_once_and_keeps_the_cap(spark):
    nodes, edges = graph.bounded_subgraph(src.relations(spark, SF), "c:7", 2, 30)
    rows = nodes.collect()
    assert len(rows) <= 30 and sum(r["is_centre"] for r in rows) == 1
    ids = {r["uri"] for r in rows}
    assert all(e["src"] in ids and e["dst"] in ids for e in edges.collect())


def test_fused_scores_lie_between_zero_and_one(spark):
    v = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.5)], "q int, d int, distance double")
    b = spark.createDataFrame([(1, 2, 3.0), (1, 3, 1.0)], "q int, d int, score double")
    assert all(0 <= r["score"] <= 1 for r in rt.hybrid(v, b, "q", "d", 0.5, 5).collect())


def test_kinship_is_found_across_long_texts_and_repeats_count_once(spark):
    filler = "之乎者也矣焉哉，" * 700
    docs = spark.createDataFrame([(1, f"{filler}苏辙之父苏洵。{filler}苏辙之父苏洵。"), (2, ""), (3, "苏辙之父嘉靖"), (4, "苏辙之父宋，")], "id int, text string")
    names = spark.createDataFrame([("苏辙",), ("苏洵",)], "name string")
    assert [(r["id"], r["src"], r["dst"], r["type"]) for r in kin.kin_relations(docs, names, "id").collect()] == [(1, "苏辙", "苏洵", "FATHER")]


def test_kinship_looks_back_and_every_suffix_counts(spark):
    texts = [(1, "苏轼之母王氏，苏辙之姐也。"), (2, "苏辙之父苏洵之父苏序"), (3, "苏轼之弟，苏洵之子苏辙"), (4, "苏洵之孙后裔苏籥"), (5, "苏洵之师嘉祐二年"), (6, "苏洵，一二三四五六七八九苏轼之子苏过")]
    docs = spark.createDataFrame(texts, "id int, text string")
    names = spark.createDataFrame([(n,) for n in ("苏辙", "苏洵", "苏轼", "王氏")], "name string")
    rows = lambda **o: {(r["id"], r["src"], r["dst"], r["type"]) for r in kin.kin_relations(docs, names, "id", **o).collect()}
    both = {(1, "苏轼", "王氏", "MOTHER"), (2, "苏辙", "苏洵", "FATHER"), (4, "苏洵", "苏籥", "GRANDSON"), (5, "苏洵", "嘉祐二", "TEACHER"), (6, "苏轼", "苏过", "SON")}
    assert rows() == both | {(1, "苏辙", "王氏", "ELDER_SISTER"), (2, "苏洵", "苏辙", "FATHER"), (3, "苏轼", "苏洵", "YOUNGER_BROTHER"), (3, "苏洵", "苏轼", "SON")}
    assert rows(look_back=False) == both | {(2, "苏洵", "苏序", "FATHER"), (3, "苏轼", "苏洵", "YOUNGER_BROTHER"), (3, "苏洵", "苏辙", "SON")}


def test_no_query_plans_a_cartesian_product_for_names(spark):
    docs = src.load(spark, SF, "documents").select(F.col("doc_id").alias("id"), "text")
    plan = kin.kin_relations(docs, spark.createDataFrame([("苏辙",)], "name string"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_boxes_must_have_four_numbers():
    with pytest.raises(ValueError):
        relational.parse_box("1,2,3")
    with pytest.raises(ValueError):
        relational.parse_box("1,2,3,x")


def test_source_registry_states_its_errors(tmp_path):
    reg = src.SourceRegistry()
    reg.add(src.Source("a", str(tmp_path)))
    reg.add(src.Source("b", str(tmp_path), enabled=False))
    reg.add(src.Source("c", str(tmp_path / "none")))
    assert reg.names() == ["a", "b", "c"] and reg.names(enabled_only=True) == ["a", "c"]
    assert reg.require_enabled("a").name == "a"
    for name, error in (("x", ValueError), ("b", ValueError), ("c", FileNotFoundError)):
        with pytest.raises(error):
            reg.require_enabled(name)


def test_text_folder_and_collections(spark, tmp_path):
    for name, body in (("one", "x" * 60), ("two", "short"), ("skip", "y" * 60)):
        (tmp_path / f"{name}.txt").write_text(body)
    assert [r["title"] for r in src.read_text_folder(spark, str(tmp_path), ("skip",)).collect()] == ["one"]
    out = str(tmp_path / "vec")
    rows = lambda *x: spark.createDataFrame(list(x), "collection string, text string")
    src.write_collection(rows(("a", "1"), ("b", "2")), out)
    src.write_collection(rows(("a", "3")), out)
    assert sorted((r["collection"], r["text"]) for r in spark.read.parquet(out).collect()) == [("a", "3"), ("b", "2")]
    assert os.path.isdir(out)


def test_streamed_chunks_arrive_once(spark, tmp_path):
    from inkfield.streaming import ingest

    docs = spark.createDataFrame([(1, "One. Two. Three."), (2, "One. Two. Three.")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = ingest.document_stream(spark, str(tmp_path / "in"), docs.schema)
    q = ingest.append_chunks(ingest.chunk_stream(stream, "doc_id", 100, 0, ".!?;"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_alignment_is_global_and_optimal():
    from inkfield.operators.alignment import align

    assert align(list("abc"), list("abc")) == [(0, 0), (1, 1), (2, 2)]
    assert align([], ["x"]) == [(None, 0)] and align([], []) == []
    assert [p for p in align(list("axbc"), list("abc")) if None in p] == [(1, None)]


def test_images_are_read_whatever_their_case(spark, tmp_path):
    from inkfield.functions import ocr

    for name in ("a.jpg", "b.PNG", "c.txt"):
        (tmp_path / name).write_bytes(b"123")
    assert ocr.image_files(spark, str(tmp_path)).count() == 2


def test_stand_in_layout_is_stable(spark):
    from inkfield.operators import graph as g

    nodes = spark.createDataFrame([(f"c:{i}",) for i in range(50)], "uri string")
    a, b = (sorted(map(tuple, g.stand_in_layout(nodes.repartition(k), 5000).collect())) for k in (1, 4))
    assert a == b


def test_layout_sink_keeps_edges_between_nodes(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 1.0)], "uri string, x double, y double")
    edges = spark.createDataFrame([("a", "b"), ("a", "z")], "src string, dst string")
    src.write_layout(nodes, edges, str(tmp_path / "l"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "l" / "edges")).select("src", "dst").collect()] == [("a", "b")]


def test_graph_json(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"persons":[{"name":"甲","stub":true}],"relations":[{"from":"甲","to":"乙","type":"FATHER","confidence":0.9}]}')
    persons, rels = src.read_graph_json(spark, str(tmp_path / "g.json"))
    assert persons.count() == 1 and [r["to"] for r in rels.collect()] == ["乙"]


def test_a_long_chain_is_one_cluster(spark):
    edges = [(k, k + 1) for k in range(61)] + [(100, 100), (200, 201), (None, 5)]
    got = {r["node"]: r["cluster"] for r in graph.clusters(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(62), 0), 100: 100, 200: 200, 201: 200}


def test_hubs_and_cold_keys_join_alike(spark, monkeypatch):
    from inkfield.operators import skew

    big = spark.createDataFrame([(k % 7 if k % 2 else 0, k) for k in range(400)] + [(None, 1)], "k int, v int")
    small = spark.createDataFrame([(0, 257, "a"), (3, 28, "b"), (9, 0, "c")], "k int, n long, w string")
    for how in ("inner", "left", "left_semi"):
        want = sorted(map(str, big.join(small, ["k"], how).collect()))
        monkeypatch.setattr(skew, "HOT_ROWS", 100)
        assert sorted(map(str, skew.join_counted(big, small, ["k"], "n", 401, how).collect())) == want
        monkeypatch.undo()


def test_numbers_follow_the_order(spark):
    from pyspark.sql import functions as F

    from inkfield.operators import skew

    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x")).repartition(7)
    assert all(r["place"] == r["x"] + 1 for r in skew.numbered(rows, [F.col("x")], "place").collect())
    assert skew.numbered(rows.limit(0), [F.col("x")], "place").count() == 0


def plain_prefixes(text, names):
    """Rules of prefix kinship for one text, character by character."""
    han, out = re.compile("[一-鿿]"), set()
    at = 0
    while at < len(text):
        word = next((w for w, _ in kin.KIN_PREFIXES if text.startswith(w, at)), None)
        run = re.match("[一-鿿]{2,4}", text[at + len(word) :]) if word else None
        if word and run and at and not han.match(text[at - 1]):
            before = text[max(0, at - 50) : at]
            best = max(((i + len(n), len(n), n) for n in names for i in range(len(before)) if before.startswith(n, i)), default=None)
            if best:
                out.add((best[2], run[0], dict(kin.KIN_PREFIXES)[word]))
            at += len(word)
        else:
            at += 1
    return out


def test_prefix_relations_follow_a_plain_model(spark):
    rng, names = random.Random(1), ["苏轼", "苏辙", "王安石", "安石"]
    bits = [*names, "，", "父", "母", "祖父", "祖母", "字", "号", "甲", "乙丙", "。", "x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r["id"], r["src"], r["dst"], r["type"]) for r in kin.prefix_relations(docs, spark.createDataFrame([(n,) for n in names], "name string"), "id").collect()}
    assert got == {(k, *x) for k, t in enumerate(texts) for x in plain_prefixes(t, names)}


def test_prefix_relations_look_back_over_any_character(spark, monkeypatch):
    names = ["苏轼", "王安石", "甲乙丙丁戊", "𠮷，", "甲乙丙丁戊己", "苏"]
    texts = ["。" * 60 + "苏轼😀，父苏洵也", "苏轼𠮷，父苏洵", "苏轼" + "。" * 48 + "父苏洵", "苏轼" + "。" * 49 + "父苏洵", "父苏洵，父苏序，", "苏轼" + "，父某某" * 13, "甲乙丙丁戊己，号某某", "", None]
    docs = spark.createDataFrame([*enumerate(texts), (0, "王安石，父王益")], "id long, text string")
    want = {(k, *x) for k, t in [*enumerate(texts), (0, "王安石，父王益")] for x in plain_prefixes(t or "", [n for n in names if 2 <= len(n) <= 5])}
    for most in (kin.MOST_BROADCAST, -1):
        monkeypatch.setattr(kin, "MOST_BROADCAST", most)
        got = [(r["id"], r["src"], r["dst"], r["type"]) for r in kin.prefix_relations(docs, spark.createDataFrame([(n,) for n in [*names, None]], "name string"), "id").collect()]
        assert len(want) == 6 and sorted(got) == sorted(want)


def test_prefix_relations_read_dense_texts_once(spark):
    docs = spark.createDataFrame([(1, "苏轼，" + "父" * 300_000 + "，父苏洵")], "id long, text string")
    began = time.monotonic()
    got = [(r["src"], r["dst"]) for r in kin.prefix_relations(docs, spark.createDataFrame([("苏轼",)], "name string"), "id").collect()]
    assert got == [("苏轼", "父父父父")] and time.monotonic() - began < 30  # two minutes, where each 父 looks back


def test_chained_kinship_and_names_before(spark):
    docs = spark.createDataFrame([(1, "苏辙之父苏洵之友欧阳修"), (2, "苏轼，苏辙之兄也")], "id long, text string")
    names = spark.createDataFrame([(n,) for n in ("苏辙", "苏洵", "苏轼", "欧阳修")], "name string")
    got = {(r["id"], r["src"], r["dst"]) for r in kin.kin_relations(docs, names, "id").collect()}
    assert got == {(1, "苏辙", "苏洵"), (1, "苏洵", "苏辙"), (2, "苏辙", "苏轼")}  # a stored name before goes before one that follows


def test_collections_are_listed_read_and_dropped(spark, tmp_path):
    path = str(tmp_path / "store")
    assert src.collections(spark, path) == []
    src.write_collection(spark.createDataFrame([("a", "x", [1.0]), ("b", "y", [2.0])], "collection string, text string, embedding array<double>"), path)
    assert src.collections(spark, path) == ["a", "b"] and src.read_collection(spark, path, "b").count() == 1
    src.write_collection(spark.createDataFrame([("a", "z", [1.0])], "collection string, text string, embedding array<double>"), path)
    assert {r["text"] for r in spark.read.parquet(path).collect()} == {"z", "y"}
    assert src.drop_collection(spark, path, "a") and not src.drop_collection(spark, path, "a") and src.collections(spark, path) == ["b"]
    with pytest.raises(ValueError):
        src.read_collection(spark, path, "a")


def test_metadata_is_plain(spark):
    df = spark.createDataFrame([(None, 3, [1, 2], True)], "s string, n int, l array<int>, b boolean")
    assert tuple(src.plain_metadata(df, df.columns).first()) == ("", 3, "[1,2]", True)


def test_graph_and_pages_as_json(spark, tmp_path):
    persons = spark.createDataFrame([("甲", "传")], "name string, biography string")
    relations = spark.createDataFrame([("甲", "乙", "FATHER")], "src string, dst string, type string")
    src.write_graph_json(persons, relations, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g/relations")).first()["dst"] == "乙"
    src.write_ocr_json(spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "page int, line int, text string"), str(tmp_path / "o"))
    assert [x["text"] for x in spark.read.json(str(tmp_path / "o")).first()["lines"]] == ["a", "b"]


def test_strategies_are_named(spark):
    from inkfield.functions import text as tx

    docs = spark.createDataFrame([(1, "卷一\n甲\n第一节 乙\n丙")], "id long, text string")
    assert [(r["chapter"], r["section"], r["text"]) for r in tx.chunks(docs, "id").orderBy("chunk_index").collect()] == [("卷一", None, "甲"), ("卷一", "第一节 乙", "丙")]
    assert tx.chunks(docs, "id", "by_max_tokens", most=5).count() > 0
    for f in (lambda: tx.chunks(docs, "id", "x"), lambda: kin.merged_versions(docs, "x"), lambda: src.text_records(docs, "x")):
        with pytest.raises(ValueError):
            f()


def test_no_scratch_folder_is_invented_on_a_cluster(monkeypatch):
    from inkfield.sources import scratch

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        scratch.root(Session())
