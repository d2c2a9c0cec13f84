"""Places of names, names that are one, alignment of long versions and chunks of long texts, against plain models."""

import random
import time

import pytest

from inkfield.functions import text as tx
from inkfield.operators import alignment, names, resolution


@pytest.mark.parametrize("shard", [2, 1_000])
def test_places_of_names_equal_a_scan(spark, shard):
    rng = random.Random(shard)
    known = ["a", "ab", "bc", "abc", "苏", "苏轼", "轼之", "ca", "zz"]
    docs = [(i, "".join(rng.choice("abc苏轼之 ") for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(90, None), (91, ""), (92, "ab" * 3_000)]
    want = sorted((d, i, i + len(n), n) for d, t in docs for n in known for i in range(len(t or "")) if t.startswith(n, i))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    listed = spark.createDataFrame([(n,) for n in [*known, None, "", "ab"]], "name string")
    found = names.places(table, listed, "doc_id", shard=shard).cache()
    assert sorted(tuple(r) for r in found.collect()) == want
    kept = [w for w in want if not any(o[0] == w[0] and o[1] <= w[1] and o[2] >= w[2] and o != w for o in want)]
    assert sorted(tuple(r) for r in names.longest(found, "doc_id").select("doc_id", "start", "end", "name").collect()) == kept
    marks = [(d, at) for d, t in docs[:40] for at in range(0, len(t or ""), 7)]
    near = names.nearest_before(found.filter("doc_id < 90"), spark.createDataFrame(marks, "doc_id long, at int"), "doc_id", 5)
    ends = lambda d, at: max(((e, e - s, n) for k, s, e, n in want if k == d and at - 5 <= e <= at), default=None)
    assert sorted(tuple(r) for r in near.collect()) == sorted((d, at, ends(d, at)[2]) for d, at in marks if ends(d, at))
    assert names.places(table, listed.limit(0), "doc_id").count() == 0 and names.places(table.limit(0), listed, "doc_id").count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("percent,hot", [(75, 1_000), (75, 3), (90, 1_000), (50, 1_000)])
def test_similar_names_equal_all_pairs(spark, monkeypatch, percent, hot):
    monkeypatch.setattr(resolution, "HOT_SEGMENT", hot)
    rng = random.Random(percent)
    made = {"".join(rng.choice("ab苏c") for _ in range(rng.randint(1, 11))) for _ in range(60)}
    made |= {m[:k] + rng.choice("abx") + m[k + 1 :] for m in list(made) if len(m) > 4 for k in (1, 3)} | {"shared start " + c for c in "abcdef"}
    table = spark.createDataFrame([(m,) for m in [*made, *list(made)[:9], None, ""]], "name string")
    want = sorted((a, b, d) for a in made for b in made if a < b and 100 * (d := edits(a, b)) <= (100 - percent) * max(len(a), len(b)))
    got = sorted(tuple(r) for r in resolution.similar_pairs(table, percent).collect())
    assert sorted((min(a, b), max(a, b), d) for a, b, d in got) == want and len(want) > 10
    if percent == 75:
        root = {m: m for m in made}
        for _ in made:
            for a, b, _ in want:
                root[a] = root[b] = min(root[a], root[b])
        assert {r["name"]: r["cluster"] for r in resolution.resolved(table).collect()} == root


def full_table(a, b):
    best = [[-0.5 * (i + j) if not i or not j else 0.0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            best[i][j] = max(best[i - 1][j - 1] + (1.0 if x == y else -0.5), best[i - 1][j] - 0.5, best[i][j - 1] - 0.5)
    return best[-1][-1]


def test_alignments_score_what_the_full_table_does():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 16))] for _ in range(2))
        pairs = alignment.align(a, b)
        assert [i for i, _ in pairs if i is not None] == list(range(len(a))) and [j for _, j in pairs if j is not None] == list(range(len(b)))
        assert alignment.alignment_score(a, b, pairs) == full_table(a, b)


def test_books_align_in_strips():
    rng = random.Random(3)
    a = [f"s{rng.randint(0, 9_000)}" for _ in range(20_000)]
    b = [s if rng.random() > 0.1 else "changed" for s in a if rng.random() > 0.05]
    pairs = alignment.align(a, b)
    assert len([1 for i, j in pairs if i is not None and j is not None and a[i] == b[j]]) > 15_000
    assert alignment.alignment_score(a, b, pairs) > 14_000


def test_long_texts_are_cut_in_linear_time(spark):
    text = "".join(f"sentence {i}." for i in range(40_000))
    table = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    tx.chunks_by_size(table, "doc_id", 200, 50, ".").count()
    began = time.time()
    cut = tx.chunks_by_size(table, "doc_id", 200, 50, ".").collect()
    placed = tx.sentence_offsets(table, "doc_id", ".").collect()
    assert time.time() - began < 20 and len(placed) == 40_000 and all(text[r["start"] : r["end"]] == r["sentence"] for r in placed)
    assert {r["doc_id"] for r in cut} == {1} and text.endswith(cut[-1]["text"]) and text.startswith(cut[0]["text"])
