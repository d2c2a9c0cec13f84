"""Own formats, the store of people and the stored layout."""

import random
import sqlite3

import numpy as np
import pytest
from inkfield.functions import ocr
from inkfield.operators import spatial
from inkfield.sources import formats, people_store, tables


def test_sqlite_files_round_trip(spark, tmp_path):
    formats.register(spark)
    path = str(tmp_path / "db")
    rows = [(i, f"n{i % 7}", i / 4, None if i % 5 == 0 else "x'\"") for i in range(230)]
    spark.createDataFrame(rows, "id long, name string, v double, note string").repartition(3).write.format("sqlite_files").option("table", "my people").mode("append").save(path)
    read = spark.read.format("sqlite_files").option("table", "my people").option("split", "20").load(path)
    assert read.dtypes == [("id", "bigint"), ("name", "string"), ("v", "double"), ("note", "string"), ("_error", "string")]
    assert read.rdd.getNumPartitions() > 10
    assert sorted(tuple(r)[:4] for r in read.collect()) == rows
    for condition in ("id < 17", "name = 'n3' AND v >= 10", "note IS NULL", "id IN (1, 5, 900)", "length(name) = 2 AND id > 200", "note IS NOT NULL AND name <> 'n1'"):
        want = spark.createDataFrame(rows, "id long, name string, v double, note string").filter(condition).count()
        assert read.filter(condition).count() == want, condition
    (tmp_path / "db" / "bad.db").write_bytes(b"no database at all, but long enough to be looked at" * 9)
    sqlite3.connect(str(tmp_path / "db" / "other.db")).execute("CREATE TABLE t (a)").close()
    errors = [r["_error"] for r in spark.read.format("sqlite_files").option("table", "my people").load(path).filter("_error IS NOT NULL").collect()]
    assert sorted(e.split(":")[0] for e in errors) == ["bad.db", "other.db"]


def test_archives_are_rows(spark, tmp_path):
    formats.register(spark)
    for k in range(2):
        np.savez(tmp_path / f"{k}.npz", node_id=np.array([f"u{k}{i}" for i in range(5)]), x=np.arange(5) + 0.5, edge=np.arange(10).reshape(5, 2))
    (tmp_path / "9.npz").write_bytes(b"PK broken")
    got = spark.read.format("npz").option("split", "2").load(str(tmp_path)).collect()
    assert sorted((r["node_id"], r["x"], r["edge"]) for r in got if r["_error"] is None) == sorted((f"u{k}{i}", i + 0.5, [2 * i, 2 * i + 1]) for k in range(2) for i in range(5))
    assert [r["_error"].split(":")[0] for r in got if r["_error"]] == ["9.npz"]
    with pytest.raises(Exception, match="no readable archive"):
        spark.read.format("npz").load(str(tmp_path / "none")).count()


def test_people_store_writes_only_touched_ranges(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"u{i:04d}", f"name{i}", rng.choice(["", "宋"]), 1.0) for i in range(600)]
    table = spark.createDataFrame(rows, "uri string, name string, dynasty string, balance double")
    made = people_store.create(table, f"file://{tmp_path}/people", range_rows=60)
    before = made.manifest()
    assert made.version() == 1 and len(before) >= 8 and sum(n for _, _, n in before) == 600
    changes = [("u0003", 1, "", "明"), ("u0003", 2, "new", ""), ("u0003", 3, "", ""), ("u0004", 1, "", ""), ("u0599", 1, "last", ""), ("u0599x", 9, "", "清"), (None, 1, "x", "x")]
    written, kept = made.upsert(spark.createDataFrame(changes, "uri string, seq long, name string, dynasty string"), ["name", "dynasty"])
    assert (written, kept) == (2, len(before) - 2) and made.version() == 2
    want = {u: (n, d) for u, n, d, _ in rows}
    want["u0003"], want["u0599"], want["u0599x"] = ("new", "明"), ("last", want["u0599"][1]), ("", "清")
    assert {r["uri"]: (r["name"], r["dynasty"]) for r in made.read().collect()} == want
    assert {r["uri"]: r["name"] for r in made.read(1).collect()} == {u: n for u, n, _, _ in rows}
    assert len({f for _, f, _ in made.manifest()} & {f for _, f, _ in before}) == kept
    for uri in ("u0003", "u0300", "u0599x", "a", "zz"):
        assert [r["uri"] for r in made.lookup(uri).collect()] == ([uri] if uri in want else [])
    assert made.upsert(spark.createDataFrame([], "uri string, seq long, name string"), ["name"]) == (0, len(before)) and made.version() == 2
    with pytest.raises(RuntimeError, match="another change"):
        made._point(2)
    with pytest.raises(FileExistsError):
        people_store.create(table, f"file://{tmp_path}/people")


def test_an_empty_people_store_takes_changes(spark, tmp_path):
    made = people_store.create(spark.createDataFrame([], "uri string, name string"), f"file://{tmp_path}/none")
    assert made.read().count() == 0 and made.lookup("a").count() == 0
    made.upsert(spark.createDataFrame([("b", 1, "x")], "uri string, seq long, name string"), ["name"])
    assert [tuple(r) for r in made.read().collect()] == [("b", "x")]


def test_boxes_read_only_files_that_they_meet(spark, tmp_path):
    rng = random.Random(7)
    points = [(f"p{i}", rng.uniform(-9, 9), rng.uniform(0, 1), 0.0) for i in range(2_000)] + [("corner", 9.5, 1.0, 0.0), ("none", None, 1.0, 0.0)]
    kept = spatial.store_layout(spark.createDataFrame(points, "uri string, x double, y double, z double"), f"file://{tmp_path}/layout", 50)
    for box in ("-1,0.4,0.5,0.5", "-100,-100,100,100", "9.5,1,9.5,1", "20,20,30,30", "-9,0,-8.5,0.02", "3,0.5,2,0.4"):
        x0, y0, x1, y1 = map(float, box.split(","))
        got, report = kept.box(box)
        assert sorted(r["uri"] for r in got.collect()) == sorted(u for u, x, y, _ in points if x is not None and x0 <= x <= x1 and y0 <= y <= y1), box
        r = report.first()
        assert r["rows"] == 2_001 and r["rows_read"] >= got.count() and (r["files_read"] < r["files"] / 2 or "100" in box)
    assert spatial.store_layout(spark.createDataFrame([], "uri string, x double, y double"), f"file://{tmp_path}/empty").box("0,0,1,1")[0].count() == 0


def test_ranges_of_a_box_hold_its_cells():
    rng = random.Random(1)
    for most in (4, 10_000):
        for _ in range(60):
            x0, x1, y0, y1 = *sorted(rng.choices(range(16), k=2)), *sorted(rng.choices(range(16), k=2))
            ranges = spatial.box_ranges(x0, y0, x1, y1, 4, most)
            code = lambda x, y: sum(((x >> k & 1) << 2 * k) | ((y >> k & 1) << 2 * k + 1) for k in range(4))
            held = {z for a, b in ranges for z in range(a, b + 1)}
            inside = {code(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)}
            assert inside <= held and (most == 4 or held == inside)


def test_unreadable_pages_have_error_rows(spark, tmp_path):
    for name, data in (("2.JPG", b"\xff\xd8\xff\xe0rest"), ("1.png", b"\x89PNG\r\n\x1a\nrest"), ("3.tif", b"MM\x00*x"), ("4.bmp", b"plain words"), ("6.txt", b"no page")):
        (tmp_path / name).write_bytes(data)
    got = ocr.page_files(ocr.image_files(spark, str(tmp_path))).collect()
    assert [(r["image_path"].rsplit("/", 1)[1], r["kind"], r["error"]) for r in got] == [("1.png", "png", None), ("2.JPG", "jpeg", None), ("3.tif", "tiff", None), ("4.bmp", None, "not an image")]
    assert all((r["content"] is None) == (r["error"] is not None) for r in got)


def test_an_environment_variable_overrides_a_path(monkeypatch, tmp_path):
    known = tables.SourceRegistry()
    known.add(tables.Source("poems", path=str(tmp_path / "absent")))
    with pytest.raises(FileNotFoundError):
        known.require_enabled("poems")
    monkeypatch.setenv("INKFIELD_SOURCE_POEMS", str(tmp_path))
    assert known.path("poems") == str(tmp_path) and known.require_enabled("poems").name == "poems"
    with pytest.raises(ValueError, match="unknown"):
        known.get("songs")
