"""Operator 3: quality rules as weak supervision.

Each rule looks at a few counts of a text and votes *good*, *bad* or abstains. The votes of
all documents are pre-aggregated to a histogram of vote patterns (at most 3**rules rows,
whatever the corpus). Expectation-maximisation over that histogram estimates the share of
good documents and, for each rule, how often it votes good on good and on bad ones. A
document is kept if its posterior probability of being good reaches the threshold; base
failures are never kept.

The main path is DataFrame expressions only. Counts need no shuffle: repeated windows are
found inside each row by sorting 64-bit hashes of its 3-word windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, WORD_GAP, stash, table

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Common short words of the four languages (fixed values).
STOPWORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "was", "on", "as", "with", "be", "by", "are",
    "de", "la", "et", "le", "les", "des", "que", "un", "une", "du", "en", "dans", "pour", "est", "sur",
    "der", "die", "und", "das", "ist", "von", "mit", "den", "ein", "eine", "zu", "nicht", "auf", "es",
    "el", "los", "las", "una", "del", "por", "con", "para", "se", "su", "al", "lo", "y",
)

#: name, condition of a vote for good, condition of a vote for bad; neither: abstains. Valid in Spark and DuckDB.
RULES = (
    ("long_enough", "n_words >= 120", "n_words < 50"),
    ("symbols", "n_symbols * 100 <= n_words", "n_symbols * 10 > n_words"),
    ("word_length", "word_chars >= 3 * n_words AND word_chars <= 8 * n_words", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    ("repeats", "n_repeat_words * 20 <= n_words", "n_repeat_words * 4 > n_words"),
    ("lines", "n_dup_lines = 0", "n_dup_lines * 10 > 3 * n_lines"),
    ("stopwords", "n_stop * 10 >= n_words", "n_stop * 50 < n_words"),
    ("capitals", "n_caps * 10 <= word_chars", "n_caps * 10 > 3 * word_chars"),
    ("shouting", "n_bang * 100 <= n_words", "n_bang * 10 > n_words"),
)
ROUNDS = 12
PSEUDO = 2.0
#: First guess of the posterior by the number of votes for bad, from none to two or more.
FIRST_GUESS = (0.95, 0.35, 0.05)
KEEP_FROM = 0.5


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def document_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and the counts that rules look at. A null text counts as empty; all counts are long."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    longs = lambda c: c.cast("long")
    n_of = lambda char: F.length("_k") - F.length(F.replace("_k", F.lit(char), F.lit("")))
    # One pass maps each class of characters to one of its own, so that each count is a cheap replace.
    classes = F.translate("_t", SYMBOLS + CAPITALS + SPACES, "#" * len(SYMBOLS) + "A" * len(CAPITALS) + " " * len(SPACES))
    a = docs.select(F.col(id_column), text.alias("_t"))
    b = a.select(id_column, classes.alias("_k"), word_array(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    hashes = F.transform("_w", lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)))
    c = b.select(
        id_column,
        longs(F.size("_w")).alias("n_words"),
        longs(F.length("_k") - n_of(" ")).alias("word_chars"),
        longs(n_of("#")).alias("n_symbols"),
        longs(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        longs(F.size("_l")).alias("n_lines"),
        longs(F.size(F.filter("_w", lambda w: w.isin(*STOPWORDS)))).alias("n_stop"),
        longs(n_of("A")).alias("n_caps"),
        longs(n_of("!")).alias("n_bang"),
        F.slice(hashes, F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0))).alias("_h"),
        F.length(F.bin(F.size("_w").cast("long"))).alias("_b"),
    )
    # Leading bits of the hash and, below them, the place: sorting these longs brings equal windows together.
    packed = F.expr("sort_array(transform(_h, (h, i) -> shiftleft(shiftright(h, _b), _b) | i))")
    near = F.expr("filter(transform(_p, (x, k) -> if(shiftright(x ^ get(_p, k + 1), _b) = 0, k, null)), k -> k is not null)")
    d = c.withColumn("_p", packed).withColumn("_k", near)
    d = d.withColumn("_m", F.expr("shiftleft(1L, _b) - 1"))
    # The whole hashes decide: places with a neighbour of the same leading bits are sorted again, by them.
    places = F.expr("array_distinct(flatten(transform(_k, k -> array(cast(get(_p, k) & _m as int), cast(get(_p, k + 1) & _m as int)))))")
    d = d.withColumn("_e", F.sort_array(F.transform(places, lambda p: F.struct(F.get("_h", p).alias("h"), p.alias("p")))))
    equal = F.expr("filter(_e, (x, k) -> coalesce(x.h = get(_e, k + 1).h, false) or coalesce(x.h = get(_e, k - 1).h, false))")
    starts = F.sort_array(F.transform(equal, lambda x: x["p"]))
    d = d.withColumn("_r", starts).drop("_h", "_p", "_k", "_m", "_e", "_b")
    # A window covers three words; a window that starts d < 3 words before the next one adds d.
    covered = F.aggregate(
        F.transform("_r", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_r", k + 1) - p, F.lit(3)))), F.lit(0), lambda acc, x: acc + x
    )
    return d.withColumn("n_repeat_words", longs(covered)).drop("_r")


def votes() -> list[str]:
    """SQL of each rule's vote: 1 good, -1 bad, 0 abstains. A text without words gets only bad votes or none."""
    return [f"CASE WHEN {bad} THEN -1 WHEN n_words > 0 AND ({good}) THEN 1 ELSE 0 END" for _, good, bad in RULES]


BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"


def fit(histogram: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float, float, float]]]:
    """EM over (vote pattern, documents). Returns the prior and per rule P(+|good), P(-|good), P(+|bad), P(-|bad) among its votes."""
    m = len(RULES)
    posterior = [FIRST_GUESS[min(2, sum(v < 0 for v in votes_))] for votes_, _ in histogram]
    prior, rates = 0.5, [(0.5, 0.5, 0.5, 0.5)] * m
    for _ in range(rounds):
        good = sum(n * q for (_, n), q in zip(histogram, posterior, strict=True))
        total = sum(n for _, n in histogram)
        prior = (good + PSEUDO) / (total + 2 * PSEUDO)
        rates = []
        for j in range(m):
            gp = sum(n * q for (v, n), q in zip(histogram, posterior, strict=True) if v[j] > 0)
            gm = sum(n * q for (v, n), q in zip(histogram, posterior, strict=True) if v[j] < 0)
            bp = sum(n * (1 - q) for (v, n), q in zip(histogram, posterior, strict=True) if v[j] > 0)
            bm = sum(n * (1 - q) for (v, n), q in zip(histogram, posterior, strict=True) if v[j] < 0)
            g, b = gp + gm + 2 * PSEUDO, bp + bm + 2 * PSEUDO
            rates.append(((gp + PSEUDO) / g, (gm + PSEUDO) / g, (bp + PSEUDO) / b, (bm + PSEUDO) / b))
        posterior = []
        for v, _ in histogram:
            z = math.log(prior / (1 - prior))
            for j in range(m):
                if v[j] > 0:
                    z += math.log(rates[j][0] / rates[j][2])
                elif v[j] < 0:
                    z += math.log(rates[j][1] / rates[j][3])
            posterior.append(1 / (1 + math.exp(-z)))
    return prior, rates


def posterior_column(prior: float, rates: list[tuple[float, float, float, float]]) -> Column:
    """P(good) from the vote columns _v0, _v1, ..."""
    z = F.lit(math.log(prior / (1 - prior)))
    for j, (gp, gm, bp, bm) in enumerate(rates):
        v = F.col(f"_v{j}")
        z = z + F.when(v > 0, F.lit(math.log(gp / bp))).when(v < 0, F.lit(math.log(gm / bm))).otherwise(F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-z))


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """Counts, base_failed, posterior and kept, one row for each row of ``docs``.

    Null text: as empty, so base_failed. Repeated rows: each counts and is judged. Empty
    table: no rows. Extra columns are ignored.
    """
    counted = stash(document_counts(docs, id_column, text_column), "op3-counts")
    voted = counted.select("*", *[F.expr(v).alias(f"_v{j}") for j, v in enumerate(votes())])
    names = [f"_v{j}" for j in range(len(RULES))]
    # At most 3**8 patterns come to the driver.
    histogram = [(tuple(r[:-1]), r[-1]) for r in sorted(map(tuple, voted.groupBy(*names).count().collect()))]
    prior, rates = fit(histogram)
    return (
        voted.withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("posterior", posterior_column(prior, rates))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_from))
        .drop(*names)
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def oracle() -> str:
    """The same in DuckDB: counts by unnesting, EM unrolled round by round."""
    m = len(RULES)
    p, q2 = repr(PSEUDO), repr(2 * PSEUDO)
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    n_in = lambda chars: f"length(t) - length(translate(t, '{chars}', ''))"
    sql = f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, row_number() OVER () AS rid, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM a),
tri AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM b WHERE len(w) >= 3),
tri2 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i+1], w[i+2]) AS c FROM tri),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM tri2, (VALUES (0), (1), (2)) o(k) WHERE c > 1 GROUP BY rid),
counted AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  ({n_in(SYMBOLS)})::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines,
  len(list_filter(w, lambda x: x IN ({stop})))::BIGINT AS n_stop, ({n_in(CAPITALS)})::BIGINT AS n_caps, ({n_in("!")})::BIGINT AS n_bang,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM b LEFT JOIN rep USING (rid)),
voted AS (SELECT *, {", ".join(f"{v} AS v{j}" for j, v in enumerate(votes()))} FROM counted),
hist AS MATERIALIZED (SELECT {", ".join(f"v{j}" for j in range(m))}, count(*)::DOUBLE AS n FROM voted GROUP BY ALL),
q0 AS MATERIALIZED (SELECT *, CASE {" + ".join(f"(v{j} < 0)::INT" for j in range(m))} WHEN 0 THEN {FIRST_GUESS[0]!r}::DOUBLE WHEN 1 THEN {FIRST_GUESS[1]!r}::DOUBLE ELSE {FIRST_GUESS[2]!r}::DOUBLE END AS q FROM hist)"""
    for k in range(1, ROUNDS + 1):
        sums = ", ".join(
            f"coalesce(sum(n * q) FILTER (v{j} > 0), 0) AS gp{j}, coalesce(sum(n * q) FILTER (v{j} < 0), 0) AS gm{j}, "
            f"coalesce(sum(n * (1 - q)) FILTER (v{j} > 0), 0) AS bp{j}, coalesce(sum(n * (1 - q)) FILTER (v{j} < 0), 0) AS bm{j}"
            for j in range(m)
        )
        prior = f"((good + {p}) / (total + {q2}))"
        plus = lambda j: f"ln(((gp{j} + {p}) / (gp{j} + gm{j} + {q2})) / ((bp{j} + {p}) / (bp{j} + bm{j} + {q2})))"
        minus = lambda j: f"ln(((gm{j} + {p}) / (gp{j} + gm{j} + {q2})) / ((bm{j} + {p}) / (bp{j} + bm{j} + {q2})))"
        w = ", ".join(f"{plus(j)} AS wp{j}, {minus(j)} AS wm{j}" for j in range(m))
        z = " + ".join(f"CASE WHEN v{j} > 0 THEN wp{j} WHEN v{j} < 0 THEN wm{j} ELSE 0 END" for j in range(m))
        sql += f""",
s{k} AS MATERIALIZED (SELECT sum(n * q) AS good, sum(n) AS total, {sums} FROM q{k - 1}),
w{k} AS MATERIALIZED (SELECT ln({prior} / (1 - {prior})) AS w0, {w} FROM s{k}),
q{k} AS MATERIALIZED (SELECT {", ".join(f"v{j}" for j in range(m))}, n, 1 / (1 + exp(-(w0 + {z}))) AS q FROM hist, w{k})"""
    join = " AND ".join(f"voted.v{j} = f.v{j}" for j in range(m))
    return (
        sql
        + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE_FAILED} AS base_failed,
  NOT {BASE_FAILED} AND f.q >= {KEEP_FROM!r} AS kept FROM voted JOIN q{ROUNDS} f ON {join}"""
    )
