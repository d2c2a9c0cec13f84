"""Sentences, chunks, windows and character tables of texts, as column expressions and plans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sentence ends of Chinese prose (fixed values); any character class will do.
CHINESE_ENDS = "。！？；"
#: Lines that open a chapter or a section (fixed values).
CHAPTER_PATTERNS = (
    r"^(卷[零一二三四五六七八九十百\d]+)",
    r"^([上中下篇章节][\u4e00-\u9fa5]*)",
    r"^([\u4e00-\u9fa5]{2,4}[志传记表])",
)
SECTION_PATTERNS = (
    r"^(第[零一二三四五六七八九十百\d]+[节章])",
    r"^([上中下篇章节][\u4e00-\u9fa5]*)",
)


def sentences(text: Column, ends: str = CHINESE_ENDS) -> Column:
    """Sentences with their delimiter, blank ones skipped."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"([^{ends}]*[{ends}]?)"), F.lit(1)), lambda s: F.trim(F.regexp_replace(s, f"[{ends}]$", "")) != "")


def sentence_offsets(docs: DataFrame, key: str, ends: str = CHINESE_ENDS) -> DataFrame:
    """(key, n, start, end, sentence): sentences with their delimiter and places in the text, in characters; blank ones skipped.

    Places are prefix sums of the sentences' lengths, taken over arrays of many texts at once: linear in a text's sentences.
    """
    parts = docs.select(key, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"([^{ends}]*[{ends}]?)"), F.lit(1)).alias("p"))
    kind = parts.schema[key].dataType.simpleString()

    def run(it):
        for b in it:
            lists = pa.concat_arrays([b.column(1)])
            size = pc.utf8_length(lists.values).to_numpy(zero_copy_only=False)
            ends_at = np.concatenate(([0], np.cumsum(size)))
            offsets = lists.offsets.to_numpy()
            starts = (ends_at[:-1] - np.repeat(ends_at[offsets[:-1]], np.diff(offsets))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.ListArray.from_arrays(lists.offsets, pa.array(starts))], names=[key, "p", "at"])

    placed = F.transform("p", lambda x, i: F.struct(F.get("at", i).alias("start"), (F.get("at", i) + F.length(x)).alias("end"), x.alias("sentence")))
    kept = F.filter(placed, lambda s: F.trim(F.regexp_replace(s["sentence"], f"[{ends}]$", "")) != "")
    return parts.mapInArrow(run, f"{key} {kind}, p array<string>, at array<int>").select(key, F.posexplode(kept).alias("n", "s")).select(key, "n", "s.*")


def chunks(docs: DataFrame, key: str, strategy: str = "by_chapter", **options) -> DataFrame:
    """Chunks by ``by_chapter`` (the patterns above unless given) or ``by_max_tokens``."""
    if strategy == "by_chapter":
        heading, section = options.get("heading", "|".join(CHAPTER_PATTERNS)), options.get("section", "|".join(SECTION_PATTERNS))
        return chunks_by_heading(docs, key, heading, section)
    if strategy == "by_max_tokens":
        return chunks_by_size(docs, key, options.get("most", 500), options.get("overlap", 50), options.get("ends", CHINESE_ENDS))
    raise ValueError(f"unknown strategy of chunks: {strategy}")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 1.5).cast("int")


def sliding_windows(docs: DataFrame, key: str, size: int, overlap: int) -> DataFrame:
    """(key, start, piece): windows of ``size`` characters, each beginning ``overlap`` before the last one's end."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(size - overlap))
    return docs.select(key, "text", F.explode(starts).alias("start")).select(key, "start", F.substring(F.col("text"), F.col("start") + 1, F.lit(size)).alias("piece"))


def chunks_by_heading(docs: DataFrame, key: str, heading: str, section: str | None = None) -> DataFrame:
    """(key, chapter, section, chunk_index, text): paragraphs under their headings, lines of a paragraph joined.

    Headings and sections are lines that match a pattern and are dropped; blank lines end
    paragraphs. A running count of boundaries names the paragraph, so one window by document does it.
    """
    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("n", "line"))
    is_heading = F.col("line").rlike(heading)
    is_section = F.col("line").rlike(section) & ~is_heading if section else F.lit(False)
    by = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.select(key, "n", "line", is_heading.alias("h"), is_section.alias("s"), (F.trim("line") == "").alias("blank"))
    run = marked.select(
        key, "n", "line", "h", "s", "blank",
        F.last(F.when(F.col("h"), F.col("line")), ignorenulls=True).over(by).alias("chapter"),
        F.sum(F.when(F.col("h"), 1).otherwise(0)).over(by).alias("chapter_no"),
        F.sum(F.when(F.col("h") | F.col("s") | F.col("blank"), 1).otherwise(0)).over(by).alias("paragraph"),
    )
    in_chapter = Window.partitionBy(key, "chapter_no").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    named = run.withColumn("section", F.last(F.when(F.col("s"), F.col("line")), ignorenulls=True).over(in_chapter)).filter("NOT h AND NOT s AND NOT blank")
    paragraphs = named.groupBy(key, "paragraph").agg(
        F.first("chapter").alias("chapter"), F.first("section").alias("section"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text")
    )
    order = Window.partitionBy(key).orderBy("paragraph")
    return paragraphs.select(key, F.coalesce("chapter", F.lit("Unknown")).alias("chapter"), "section", (F.row_number().over(order) - 1).alias("chunk_index"), "text")


def chunk_bounds(sizes: np.ndarray, most: int, overlap: int) -> list[tuple[int, int]]:
    """First sentence and the one after the last of each chunk; each step is a search in the prefix sums."""
    upto = np.concatenate(([0], np.cumsum(sizes)))
    out, first, own, n = [], 0, 0, len(sizes)  # where the chunk begins, and its first sentence that the chunk before does not have
    while own < n:
        stop = max(int(np.searchsorted(upto, upto[first] + most, side="right")) - 1, own + 1)
        out.append((first, stop))
        first = stop if upto[stop] - upto[first] <= overlap else int(np.searchsorted(upto, upto[stop] - overlap, side="left"))
        own = stop
    return out


def chunks_by_size(docs: DataFrame, key: str, most: int, overlap: int, ends: str = CHINESE_ENDS) -> DataFrame:
    """(key, chunk_index, text): greedy runs of sentences of at most ``most`` characters (delimiters not counted); a chunk
    begins with the last sentences of the one before that fit ``overlap``, none if that whole chunk would fit.

    A text's chunks follow one from the other; each costs one search in the prefix sums of its sentences' sizes. Null and blank texts have none.
    """
    parts = docs.select(key, F.coalesce(sentences(F.col("text"), ends), F.array().cast("array<string>")).alias("s"))
    parts = parts.select(key, "s", F.transform("s", lambda x: F.length(F.rtrim(x, F.lit(ends)))).alias("size"))
    kind = parts.schema[key].dataType.simpleString()

    def run(it):
        for b in it:
            for i in range(b.num_rows):
                s = b.column(1)[i].as_py()
                bounds = chunk_bounds(b.column(2)[i].values.to_numpy(), most, overlap)
                texts = ["".join(s[first:stop]) for first, stop in bounds]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(texts), type=pa.int64())), pa.array(range(len(texts)), type=pa.int32()), pa.array(texts, type=pa.string())], names=[key, "chunk_index", "text"])

    return parts.mapInArrow(run, f"{key} {kind}, chunk_index int, text string")


def characters(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each character: position from 0, and the character."""
    return lines.select(*keys, F.posexplode(F.split("text", "")).alias("pos", "ch")).filter("ch <> ''")


def character_boxes(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Even shares of a line's box (x0, y0, x1, y1) for its characters, cut to whole numbers."""
    each = lines.select(*keys, "x0", "y0", "x1", "y1", F.length("text").alias("n"), F.posexplode(F.split("text", "")).alias("pos", "ch")).filter("ch <> ''")
    w = (F.col("x1") - F.col("x0")) / F.col("n")
    return each.select(*keys, "pos", "ch", (F.col("x0") + F.col("pos") * w).cast("int").alias("left"), "y0", (F.col("x0") + (F.col("pos") + 1) * w).cast("int").alias("right"), "y1")


def polygon_box(points: Column) -> Column:
    """[left, top, right, bottom] of [[x, y], ...]."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def variant_index(variants: DataFrame) -> DataFrame:
    """(variant, standard) from (standard, variant) rows, each standard also its own variant; entries of several characters are dropped."""
    clean = variants.filter("length(standard) = 1 AND length(variant) = 1 AND variant <> '�'")
    return clean.select("variant", "standard").union(clean.select("standard", "standard")).toDF("variant", "standard").distinct()


def normal_forms(variants: DataFrame, traditional: bool = False) -> DataFrame:
    """(variant, normal): of a character's standards other than itself, the one of fewest UTF-8 bytes (most, if ``traditional``), ties by code point."""
    size = F.octet_length("standard")
    best = F.min_by("standard", F.struct((-size if traditional else size).alias("n"), F.expr("ascii(standard)").alias("c")))
    return variant_index(variants).filter("variant <> standard").groupBy("variant").agg(best.alias("normal"))


def normalize(docs: DataFrame, variants: DataFrame, traditional: bool = False, text: str = "text") -> DataFrame:
    """Fold variant characters. The map is a table of characters, bounded by Unicode, and becomes one ``translate``."""
    pairs = sorted((r[0], r[1]) for r in normal_forms(variants, traditional).collect())
    if not pairs:
        return docs
    return docs.withColumn(text, F.translate(F.col(text), "".join(a for a, _ in pairs), "".join(b for _, b in pairs)))


def taboo_hits(docs: DataFrame, taboo: DataFrame, key: str, dynasty: str) -> DataFrame:
    """(key, pos, ch, replacement, context): characters avoided under a dynasty, with five characters on each side."""
    rules = taboo.filter(F.col("dynasty") == dynasty).groupBy("ch").agg(F.max_by("replacement", "seq").alias("replacement"))
    context = F.substring(F.col("text"), F.greatest(F.col("pos") - 4, F.lit(1)), F.least(F.col("pos"), F.lit(5)) + F.lit(6))
    return docs.select(key, "text", F.posexplode(F.split("text", "")).alias("pos", "ch")).join(F.broadcast(rules), "ch").select(key, "pos", "ch", "replacement", context.alias("context"))


def replace_taboo(docs: DataFrame, taboo: DataFrame, dynasty: str) -> DataFrame:
    pairs = sorted((r[0], r[1]) for r in taboo.filter(F.col("dynasty") == dynasty).groupBy("ch").agg(F.max_by("replacement", "seq")).collect())
    return docs.withColumn("text", F.translate("text", "".join(a for a, _ in pairs), "".join(b for _, b in pairs))) if pairs else docs
