"""Nulls, empty and very long texts, repeated rows, extra columns with clashing names, and empty tables, for every operator."""

import pytest

from inkfield.llm import ann, lattice_sampling, license_scan, packing, pii, quality_classifier, quality_rules, sharding, simhash_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 long, score double, fp string, kept string, uid long"
LONG = "word " * 9_000 + "x" * 12_000
ROWS = [(1, None), (2, ""), (3, LONG), (4, "plain words here, mail a.b@mail.example.com now"), (4, "plain words here, mail a.b@mail.example.com now"), (None, "no id but text"), (6, "  \n\t \n"), (7, "é梦\x00 odd\x85chars"), (8, "plain words here, mail a.b@mail.example.com now")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 5, 0.5, "f", "k", 9) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (4, 1, 0), (4, 1, 0), (7, None, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "pii": lambda d, _: pii.find_pii(d),
    "simhash": lambda d, _: simhash_dedup.near_duplicates(d),
    "rules": lambda d, _: quality_rules.judge(d),
    "classifier": quality_classifier.score_documents,
    "suffix": lambda d, _: suffix_dedup.removed_bytes(d),
    "license": lambda d, _: license_scan.scan_licenses(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each_row(docs, labels, name):
    got = [r["doc_id"] for r in OPERATORS[name](docs, labels).collect()]
    assert sorted(got, key=str) == sorted((i for i, _ in ROWS), key=str)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, labels, name):
    assert OPERATORS[name](table(spark, []), labels).count() == 0


def test_no_labels_gives_even_scores(spark, docs, labels):
    assert {r["score"] for r in quality_classifier.score_documents(docs, labels.limit(0)).collect()} == {0.5}


def test_pii_of_repeated_rows_is_equal(docs):
    rows = {(r["doc_id"], r["n_email"], r["spans"]) for r in pii.find_pii(docs).collect()}
    assert (4, 1, "email:23:43") in rows and (8, 1, "email:23:43") in rows and (2, 0, "") in rows and (1, 0, "") in rows


def test_components_of_copies_and_of_texts_without_words(docs):
    rows = {(r["doc_id"], r["fp"], r["component_id"]) for r in simhash_dedup.near_duplicates(docs).collect()}
    assert (2, 0, 1) in rows and (1, 0, 1) in rows and (6, 0, 1) in rows
    assert {c for d, _, c in rows if d in (4, 8)} == {4}


def test_masking_and_cutting_keep_rows_and_columns(docs):
    for f in (pii.mask_pii, suffix_dedup.cut_documents):
        out = f(docs)
        assert out.columns == docs.columns and out.count() == len(ROWS)
    assert [r["text"] for r in pii.mask_pii(docs).filter("doc_id = 8").collect()] == ["plain words here, mail [EMAIL] now"]
    assert pii.mask_pii(docs).filter("text IS NULL").count() == 1


def test_filters_keep_columns(spark, docs, labels):
    assert quality_classifier.keep_good(docs, labels).columns == docs.columns
    kept = simhash_dedup.keep_one(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(4) == 1 and 8 not in ids and 2 not in ids and None in ids


def test_rows_of_one_id_are_told_apart_by_text(spark):
    rows = [(5, "one two three four five six"), (5, "seven eight nine ten eleven twelve"), (5, "one two three four five six"), (None, "a b c d e"), (None, "k l m n o p"), (9, "a b c d e")]
    kept = simhash_dedup.keep_one(table(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("5", "one two three four five six"), ("5", "seven eight nine ten eleven twelve"), ("9", "a b c d e"), ("None", "k l m n o p")]


def test_packing_places_every_piece_once(spark, docs):
    for d in (docs, table(spark, [])):
        rows = packing.packed_documents(d).collect()
        by: dict = {}
        for r in rows:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for places in by.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 4096
        if d is docs:
            assert {r["length"] for r in rows if r["doc_id"] in (1, 2)} == {1}
            assert sum(r["doc_id"] == 4 for r in rows) == 2


def test_sampling_of_texts_with_one_segmentation(docs):
    rows = lattice_sampling.sample_segmentations(docs, with_ids=True)
    got = {(r["doc_id"], r["draw"]): r for r in rows.collect()}
    assert got[1, 0]["n_tokens"] == 0 and got[1, 1]["inclusion"] == 1.0 and (1, 2) not in got
    texts = {r["doc_id"]: r["decoded"] for r in lattice_sampling.decode_ids(rows).collect() if r["doc_id"] in (3, 7)}
    assert texts == {3: LONG, 7: "é梦\x00 odd\x85chars"}


def test_sharding_of_few_and_no_rows(spark, docs):
    facts = docs.selectExpr("doc_id", "coalesce(octet_length(text), 0) + 16L AS size", "crc32(coalesce(text, '')) AS text_crc32", "lang")
    out = sharding.shuffle_into_shards(facts, tie_columns=("text_crc32", "size")).collect()
    assert sorted((r["doc_id"] for r in out), key=str) == sorted((i for i, _ in ROWS), key=str)
    assert all(r["slot"] == 0 for r in out) and len({r["shard"] for r in out}) == len(ROWS)
    assert sharding.shuffle_into_shards(facts.limit(0)).count() == 0


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0]), (9, [-1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.0]), (20, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(v, "vec_id % 20 = 0").orderBy("rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 1), (0, 3, 9)]
    assert ann.nearest(v.limit(0), "vec_id % 20 = 0").count() == 0


def test_sampling_of_repeated_rows_and_no_rows(spark, docs):
    rows = [tuple(r) for r in lattice_sampling.sample_segmentations(docs).filter("doc_id = 4").collect()]
    assert len(rows) == 6 and len(set(rows)) == 3
    assert lattice_sampling.sample_segmentations(table(spark, [])).count() == 0


def test_packing_keeps_a_callers_columns(spark):
    rows = spark.createDataFrame([(1, 10, "a", 5), (None, 4096, "b", 6), (None, 4086, "c", 7)], "doc_id long, length long, uid string, offset long")
    got = {r["uid"]: r for r in packing.pack(rows).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"]["sequence_id"] == got["c"]["sequence_id"] != got["b"]["sequence_id"]


def test_vectors_with_clashing_columns(spark):
    rows = [(k, [float(k % 7), 1.0, float(k)], 3, "x", 0.1, 9) for k in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell string, score double, gid long")
    assert ann.nearest(v, "vec_id % 20 = 0").count() == 60


def test_pipeline_stages_on_odd_rows(spark, docs, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for d in (docs, table(spark, [])):
            out = stage(spark, d, str(tmp_path))
            assert name == "packing" or out.columns == docs.columns
            out.count()
