"""Operators 11 to 13 against brute force, the library of the vocabulary, and odd rows."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkfield.llm import byte_bpe, code_compression, hard_negatives

from ..conftest import SF

NAN, INF = float("nan"), float("inf")


# ------------------------------------------------------------------ 11


def coded(vectors, parts, entries, rounds, scale):
    """Codes, errors and codebooks by plain loops; ``vectors`` in the order of ids."""
    x = np.floor(scale * np.array(vectors, dtype=float)).astype(int)
    cut = x.reshape(len(x), parts, -1)
    books = [[list(map(int, r[p])) for r in cut[:entries]] for p in range(parts)]
    near = lambda p, v: min(range(len(books[p])), key=lambda e: (sum((int(a) - b) ** 2 for a, b in zip(v, books[p][e], strict=True)), e))
    for _ in range(rounds):
        now = [[near(p, r[p]) for r in cut] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [r[p] for r, k in zip(cut, now[p], strict=True) if k == e]
                if own:
                    books[p][e] = [int(sum(map(int, c))) // len(own) for c in zip(*own, strict=True)]
    codes = [[near(p, r[p]) for p in range(parts)] for r in cut]
    errors = [sum(int(((r[p] - np.array(books[p][k])) ** 2).sum()) for p, k in enumerate(c)) for r, c in zip(cut, codes, strict=True)]
    return codes, errors, books


def vectors_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string, error double, n int")


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(5)
    good = [(i, [rng.choice([-1, 1]) * rng.random() ** 3 for _ in range(8)], rng.choice([None, 1, 2]), "x", 0.5, i) for i in range(60)]
    good += [(100 + i, good[3][1], 2, "x", 0.5, 0) for i in range(25)]  # many copies of one vector
    bad = [(200, None, 1, "x", 0.5, 0), (201, [None] * 8, 1, "x", 0.5, 0), (202, [0.0] * 7 + [NAN], 1, "x", 0.5, 0), (203, [0.0] * 7 + [-INF], 1, "x", 0.5, 0)]
    return good, vectors_table(spark, random.Random(6).sample(good + bad, len(good + bad)))


def test_codes_equal_plain_loops(some):
    good, rows = some
    codes, errors, books = coded([g[1] for g in good], 4, 6, 3, 64)
    got, codebooks = code_compression.compress(rows, parts=4, entries=6, rounds=3, scale=64)
    assert codebooks.tolist() == books
    by_id = {r["id"]: r for r in got.collect()}
    assert sorted(by_id) == [g[0] for g in good]
    sums = {k: sum(e for g, e in zip(good, errors, strict=True) if g[2] == k) for k in (None, 1, 2)}
    for g, code, error in zip(good, codes, errors, strict=True):
        r = by_id[g[0]]
        assert (r["code"], r["error"], r["label"], r["label_error"]) == (code, error, None if g[2] is None else str(g[2]), sums[g[2]])


def test_blocks_and_branches_change_nothing(some, monkeypatch):
    _, rows = some
    one = code_compression.compress(rows.coalesce(1), parts=2, entries=5, rounds=2)[1]
    monkeypatch.setattr(code_compression, "BLOCK_ROWS", 3)
    assert code_compression.compress(rows.repartition(13), parts=2, entries=5, rounds=2)[1].tolist() == one.tolist()


def test_decoded_vectors_are_the_entries(some):
    _, rows = some
    got, books = code_compression.compress(rows, parts=4, entries=16, rounds=4, scale=64)
    for r in code_compression.decoded(got, books, 64).limit(5).collect():
        assert r["vector"] == [(int(x) + 0.5) / 64 for p, c in enumerate(r["code"]) for x in books[p, c]]


def test_codes_of_odd_tables(spark):
    empty, books = code_compression.compress(vectors_table(spark, []))
    assert empty.count() == 0 and books.shape[1] == 0 and code_compression.digest(books) == hashlib.sha256(b"").hexdigest()
    few = vectors_table(spark, [(2, [0.5] * 8, None, "", 0.0, 0), (None, [-0.5] * 8, 7, "", 0.0, 0), (2, [0.5] * 8, None, "", 0.0, 0)])
    got, books = code_compression.compress(few, scale=8)
    assert books[0, :, 0].tolist() == [4, 4, -4]  # equal rows both count; the null id is last
    assert sorted((str(r["id"]), r["code"][0], r["error"], r["label_error"]) for r in got.collect()) == [("2", 0, 0, 0), ("2", 0, 0, 0), ("None", 2, 0, 0)]
    for rows, error in (([(1, [1.0] * 8, 1, "", 0.0, 0), (2, [1.0] * 16, 1, "", 0.0, 0)], "lengths"), ([(1, [1.0] * 9, 1, "", 0.0, 0)], "equal parts"), ([(1, [1e300] * 8, 1, "", 0.0, 0)], "too large")):
        with pytest.raises(Exception, match=error):
            code_compression.compress(vectors_table(spark, rows))


def test_a_hot_label_is_summed_whole(spark, monkeypatch):
    monkeypatch.setattr("inkfield.operators.skew.HOT_ROWS", 3)
    monkeypatch.setattr("inkfield.operators.skew.HOT_KEYS", 3)
    rows = [(i, [i / 100.0, 1.0], 1 if i < 30 else i % 3, "", 0.0, 0) for i in range(40)]
    got = code_compression.compress(vectors_table(spark, rows), parts=2, entries=2, rounds=2)[0].collect()
    for label in "012":
        own = [r for r in got if r["label"] == label]
        assert {r["label_error"] for r in own} == {sum(r["error"] for r in own)}
    assert len(got) == 40


# ------------------------------------------------------------------ 12


def mined(rows, anchors, scale, positives=5, negatives=10, low=30, high=90):
    x = {i: (label, [int(np.floor(scale * c)) for c in v]) for i, v, label in rows}
    out = []
    for a in anchors:
        score = lambda i: sum(p * q for p, q in zip(x[a][1], x[i][1], strict=True))
        others = [i for i in x if i != a]
        order = sorted(others, key=lambda i: (-score(i), i))
        for p in [i for i in order if x[i][0] == x[a][0]][:positives]:
            fit = [i for i in order if x[i][0] != x[a][0] and low * score(p) <= 100 * score(i) <= high * score(p)][:negatives]
            out += [(a, p, n + 1, i, score(p), score(i)) for n, i in enumerate(fit)]
    return sorted(out)


def rows_of(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


@pytest.mark.parametrize("shape", ["even", "steep", "copies", "long"])
def test_hard_negatives_equal_all_scores(spark, shape, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 12))
    if shape == "steep":
        x *= 0.5 ** np.arange(12)
    if shape == "copies":
        x[50:170] = x[5]
    if shape == "long":
        x[::9] *= 1e5
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, rng.integers(0, 4, 300), strict=True))]
    for name, n in (("GROUP", 7), ("SHARD_ROWS", 70), ("ROWS_AT_ONCE", 16), ("ANCHORS_AT_ONCE", 3), ("PAIRS", 20)):
        monkeypatch.setattr(hard_negatives, name, n)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = rows_of(hard_negatives.mine(table, F.col("vec_id") % 15 == 0, scale=64))
    assert got == mined(rows, range(0, 300, 15), 64) and got


def test_hard_negatives_of_odd_rows(spark):
    kind = "vec_id long, embedding array<double>, label int, score long, slot int, v string"
    base = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.5, 0.5], 2), (3, [0.5, 0.5], 3), (4, [-1.0, 0.0], 2), (5, [0.0, 1.0], 1)]
    odd = [(None, [1.0, 0.0], 1), (7, None, 1), (8, [None, 1.0], 2), (9, [NAN, 1.0], 2), (10, [INF, 0.0], 2), (11, [0.5, 0.5], None), (3, [0.5, 0.5], 3), (0, [1.0, 0.0], 1)]
    table = spark.createDataFrame([(*r, 1, 2, "v") for r in base + odd], kind)
    got = hard_negatives.mine(table, F.col("vec_id") == 0, scale=8)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert rows_of(got) == mined([(i, v, k) for i, v, k in base], [0], 8) and len(rows_of(got)) == 2
    assert hard_negatives.mine(table.limit(0), F.col("vec_id") == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1, 1, 2, "v"), (1, [1.0], 2, 1, 2, "v")], kind)
    assert hard_negatives.mine(alone, F.col("vec_id") == 0).count() == 0  # no positive
    with pytest.raises(ValueError, match="lengths"):
        hard_negatives.mine(spark.createDataFrame([(0, [1.0], 1, 1, 2, "v"), (1, [1.0, 2.0], 2, 1, 2, "v")], kind), F.col("vec_id") == 0)
    with pytest.raises(OverflowError):
        hard_negatives.mine(spark.createDataFrame([(0, [1e12], 1, 1, 2, "v")], kind), F.col("vec_id") == 0)


def test_partial_products_discard_most_pairs_of_steep_vectors():
    rng = np.random.default_rng(9)
    x = np.floor(256 * rng.normal(size=(400, 32)) * 0.6 ** np.arange(32)).astype(np.int64)
    rotation = hard_negatives.Rotation((x.T @ x).astype(float))
    turned = rotation.turned(x)
    exact = x[:50] @ x.T
    least = np.sort(exact, axis=1)[:, -5].astype(float)
    i, j = hard_negatives.surviving(rotation, [t[:50] for t in turned], turned, np.ones((50, 400), dtype=bool), least, np.full(50, np.inf))
    assert {(a, b) for a, b in zip(*np.nonzero(exact >= least[:, None]), strict=True)} <= set(zip(i, j, strict=True))
    assert rotation.ends[0] <= 4 and len(i) < 0.1 * exact.size


# ------------------------------------------------------------------ 13


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = byte_bpe.read_ranks(byte_bpe.ranks_path())
    return tiktoken.Encoding("own", pat_str=byte_bpe.pattern(), mergeable_ranks=ranks, special_tokens={})


def own_ids(bpe, text):
    return np.frombuffer(bpe.encode([text])[0], dtype="<u4").tolist()


PIECES = st.sampled_from(["a", "b", "the", " ", "  ", "\n", "\t", "'", "'re", "'r", "e", "s", "1", "22", "é", "梦", "<|endoftext|>", "　", "\x85", "\x1c", "!", "...", "́", "ß", "x" * 50, "\x00", "\U0001f600"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=60).map("".join), st.sampled_from([5, 16, 1 << 16]))
def test_any_text_encodes_as_the_library_does(library, text, leaf):
    bpe = byte_bpe.bpe(byte_bpe.ranks_path(), byte_bpe.pattern())
    kept, byte_bpe.LEAF = byte_bpe.LEAF, leaf
    try:
        ids = own_ids(bpe, text)
    finally:
        byte_bpe.LEAF = kept
    assert ids == library.encode_ordinary(text)
    assert bpe.decode(np.array(ids, dtype="<u4")) == text.encode()


@pytest.mark.parametrize("text", ["a" * 30_001, "ab" * 9_999, " " * 9_001 + "x", "=-" * 3_000 + "=" * 5_001, "é" * 4_001], ids=["run", "pairs", "spaces", "signs", "two bytes"])
def test_long_matches_settle(library, text):
    assert own_ids(byte_bpe.bpe(byte_bpe.ranks_path(), byte_bpe.pattern()), text) == library.encode_ordinary(text)


def merged_plainly(ranks, own):
    """Merges over all bytes, one at a time: the lowest rank, the leftmost of equal ones."""
    pieces = [own[k : k + 1] for k in range(len(own))]
    while found := [(ranks[a + b], k) for k, (a, b) in enumerate(zip(pieces, pieces[1:])) if a + b in ranks]:  # noqa: B905
        k = min(found)[1]
        pieces[k : k + 2] = [pieces[k] + pieces[k + 1]]
    return [ranks[p] for p in pieces]


@pytest.mark.parametrize("listed", [0, 3, 64])
@pytest.mark.parametrize("leaf", [1, 2, 8])
def test_joins_equal_merging_the_whole(monkeypatch, leaf, listed):
    """Halves joined against merges over all bytes, under ranks whose merges are not in the order of their parts; many strings at once."""
    monkeypatch.setattr(byte_bpe, "OWN_LEAF", leaf)
    monkeypatch.setattr(byte_bpe, "LISTED", listed)
    rng = random.Random(2)
    ranks = {bytes([c]): c for c in range(256)}
    for n, t in enumerate([b"bc", b"abc", b"ab", b"aa", b"aaa", b"ca", b"cab", b"bb", b"abca", b"aab"]):
        ranks[t] = 300 + n
    merges = byte_bpe.Merges(ranks)
    strings = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 60))) for _ in range(400)] + [b"", b"a", b"z" * 9]
    tokens, count = merges.encode(strings)
    ends = np.cumsum(count)
    assert [tokens[e - n : e].tolist() for e, n in zip(ends, count, strict=True)] == [merged_plainly(ranks, s) for s in strings]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 2)
    bpe = byte_bpe.ByteBpe(byte_bpe.ranks_path(), byte_bpe.pattern())
    texts = ["one two  three", "one two\n three four", "", "two three's  ", " one"] * 2
    for text in texts:
        assert own_ids(bpe, text) == library.encode_ordinary(text)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in bpe.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_texts_of_tables(spark, library):
    docs = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 1), (3, "It's 2 o'clock  now\n\n", "x", 1), (3, "It's 2 o'clock  now\n\n", "x", 1), (None, "word " * 30_000 + "x" * 20_000, "x", 1)], "doc_id long, text string, ids string, row int")
    got = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    assert len(got) == 5 and got[0].__fields__ == ["doc_id", "text", "row", "ids", "decoded"]
    for r in got:
        assert np.frombuffer(r["ids"], dtype="<u4").tolist() == library.encode_ordinary(r["text"] or "") and r["decoded"] == (r["text"] or "").encode()
    assert byte_bpe.encode(docs.limit(0)).count() == 0


def test_documents_encode_as_the_library_does(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = byte_bpe.op13_byte_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
