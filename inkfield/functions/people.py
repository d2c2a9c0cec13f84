"""Rules for people in Chinese local histories: classes, names, kinship, offices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HAN = "一-鿿"

# ---- Fixed values: they must equal the source's for right results.
CLAN_SURNAMES = tuple(
    """
    赵 钱 孙 李 周 吴 郑 王 冯 陈
    褚 卫 蒋 沈 韩 杨 朱 秦 尤 许
    何 吕 施 张 孔 曹 严 华 金 魏
    陶 姜 戚 谢 邹 喻 柏 水 窦 章
    云 苏 潘 葛 奚 范 彭 郎 鲁 韦
    昌 马 苗 凤 花 方 俞 任 袁 柳
    酆 鲍 史 唐 费 廉 岑 薛 雷 贺
    倪 汤 滕 殷 罗 毕 郝 邬 安 常
    乐 于 时 傅 皮 卞 齐 康 伍 余
    元 卜 顾 孟 平 黄 和 穆 萧 尹
    姚 邵 湛 汪 祁 毛 禹 狄 米 贝
    """.split()
)
WIFE_WORDS = ("妻", "妾", "孺人", "夫人", "氏")
DYNASTIES = ("西汉", "东汉", "三国", "晋", "南北朝", "南朝", "北朝", "隋", "唐", "五代", "宋", "辽", "金", "元", "明", "清")
ERAS = ("天监", "永乐", "正统", "景泰", "成化", "弘治", "正德", "嘉靖", "隆庆", "万历", "泰昌", "天启", "崇祯", "康熙", "雍正", "乾隆", "嘉庆", "道光", "咸丰", "光绪", "宣统", "建元", "永元", "中元")
KIN_SUFFIXES = (
    ("之父", "FATHER"), ("之母", "MOTHER"), ("之子", "SON"), ("之女", "DAUGHTER"), ("之孙", "GRANDSON"), ("之曾孙", "GREAT_GRANDSON"),
    ("之外祖", "MATERNAL_GRANDFATHER"), ("之外祖母", "MATERNAL_GRANDMOTHER"), ("之兄", "ELDER_BROTHER"), ("之弟", "YOUNGER_BROTHER"),
    ("之姐", "ELDER_SISTER"), ("之妹", "YOUNGER_SISTER"), ("之伯父", "ELDER_UNCLE"), ("之叔父", "YOUNGER_UNCLE"), ("之姑母", "AUNT"),
    ("之妻", "WIFE"), ("之妾", "CONCUBINE"), ("之夫", "HUSBAND"), ("之婿", "SON_IN_LAW"), ("之媳", "DAUGHTER_IN_LAW"),
    ("之师", "TEACHER"), ("之徒", "STUDENT"), ("之友", "FRIEND"), ("之同僚", "COLLEAGUE"),
)
STOP_CHARS = "以，。；、：（）''【】《》0123456789 为乃即是之于乎也与及其所自而"
NOISE_WORDS = (
    "太守", "将军", "博士", "侍郎", "尚书", "司马", "刺史", "长史", "著作", "太傅", "公侯", "帝即", "王之", "知州", "知府", "县令", "主簿", "判官", "推官",
    "安抚", "转运", "节度", "观察", "防御", "团练", "翰林", "御史", "中书", "门下", "太尉", "司徒", "司空", "大将军", "骠骑", "车骑", "郡守", "亭侯", "乡侯",
    "县侯", "列侯", "光禄", "卫尉", "太仆", "大理", "鸿胪", "宗正", "太子", "王世子", "长子", "次子",
    "京兆", "河南", "河北", "山西", "山东", "江南", "江左", "江右", "岭南", "塞北", "辽东", "关中", "塞外", "西域",
)
NOISE_YEAR_ENDS = ("年",)
NOISE_PLACE_ENDS = ("县", "州", "府", "城", "乡", "镇", "村", "里", "亭", "山", "水", "江", "河", "湖", "海", "港", "澳", "岛", "洲")
NOISE_TITLE_ENDS = ("守", "尉", "监", "使", "相", "伯", "侯", "公", "王", "君", "臣", "郎", "史", "民", "仆")
NOISE_EVENT_ENDS = ("位", "立", "崩", "薨", "卒")
NOISE_BOOK_ENDS = ("记", "志", "传", "录", "史", "典", "论", "集", "编", "考", "略", "图", "谱", "表", "诏", "令", "策", "书")
NOISE_HOUSE_ENDS = ("学", "寺", "观", "庙", "宫", "殿", "阁", "院", "府", "部", "省", "司")
NOISE_STATES = ("汉", "唐", "宋", "元", "明", "清", "魏", "蜀", "吴", "晋", "隋", "秦", "周", "商", "夏", "虞", "金", "辽", "齐", "楚", "燕", "赵", "韩", "梁")
NOISE_DATES = (
    "正月", "二月", "三月", "四月", "五月", "六月", "七月", "八月", "九月", "十月", "十一月", "十二月",
    "一日", "二日", "三日", "四日", "五日", "六日", "七日", "八日", "九日", "十日",
    "十一日", "十二日", "十三日", "十四日", "十五日", "十六日", "十七日", "十八日", "十九日", "二十日",
)
BIOGRAPHY_STARTS = ("西汉", "东汉", "唐朝", "宋代", "元朝", "明朝", "清朝", "南北朝", "字", "号", "仕", "举", "进士", "举人", "生", "卒", "殁", "配", "继", "知", "任", "拜", "授", "封", "赠", "擢", "迁", "史", "公")
YEAR_DYNASTIES = ((220, "汉"), (420, "魏晋"), (589, "南北朝"), (618, "隋"), (907, "唐"), (960, "五代"), (1279, "宋"), (1368, "元"), (1644, "明"), (1912, "清"))
# ---- End of fixed values.

#: Longest first, so that the grandmother is not read as the grandfather.
_SUFFIX_PATTERN = "|".join(sorted((s for s, _ in KIN_SUFFIXES), key=len, reverse=True))


def filled(*names: str) -> Column:
    """The first of several fields that is not empty."""
    return F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names], F.lit(""))


def surname(family: Column, name: Column) -> Column:
    """The first Chinese character of the family name, or else of the name."""
    own = F.regexp_extract(F.coalesce(family, F.lit("")), f"[{HAN}]", 0)
    return F.when(own != "", own).otherwise(F.regexp_extract(F.coalesce(name, F.lit("")), f"[{HAN}]", 0))


def person_class(family: Column, name: Column, role: Column, dynasty: Column, title: Column) -> Column:
    """0 clan, 1 wife, 3 official, 2 other."""
    wife = F.coalesce(role, F.lit("")).rlike("|".join(WIFE_WORDS)) | F.coalesce(name, F.lit("")).rlike("妻|妾|孺人|夫人|^.氏$")
    clan = surname(family, name).isin(*CLAN_SURNAMES)
    there = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(wife, 1).when(clan, 0).when(there(dynasty) & there(title), 3).otherwise(2)


def classify(people: DataFrame) -> DataFrame:
    return people.withColumn("person_type", person_class(F.col("family_name"), filled("label_chs", "name"), F.col("role_of_family"), F.col("dynasty"), F.col("title")))


def is_noise(name: Column) -> Column:
    """Offices, places, dates, books and the like, which rules for names must not take for people."""
    ends = (*NOISE_YEAR_ENDS, *NOISE_PLACE_ENDS, *NOISE_TITLE_ENDS, *NOISE_EVENT_ENDS, *NOISE_BOOK_ENDS, *NOISE_HOUSE_ENDS)
    return name.isin(*NOISE_WORDS, *NOISE_STATES, *NOISE_DATES) | ((F.length(name) >= 2) & F.substring(name, -1, 1).isin(*ends))


def _all(pattern: str, line: str = "line", group: int = 1) -> Column:
    return F.explode(F.regexp_extract_all(F.col(line), F.lit(pattern), F.lit(group)))


def named_entities(docs: DataFrame, key: str) -> DataFrame:
    """(key, type, name), each once: people by four line formats and places by "(今X)" and administrative endings.

    Places with an administrative ending are noise by the same rules and never come out, so
    only the first form gives places.
    """
    text = docs.filter(F.length("text") >= 10)
    lines = text.select(key, F.posexplode(F.split("text", "\n")).alias("n", "line")).filter(F.trim("line") != "")
    start = "|".join(BIOGRAPHY_STARTS)
    person = lambda df: df.withColumn("type", F.lit("PER"))
    a = person(lines.select(key, F.regexp_extract("line", f"^([{HAN}]{{2,3}})，(?:{start})", 1).alias("name")).filter("name <> ''"))
    b = person(lines.select(key, _all(rf"([{HAN}]{{2,3}})\([\d‐–—．·～\-]+\)").alias("name")))
    c = person(lines.select(key, F.regexp_extract("line", f"^([{HAN}]{{3}})，字", 1).alias("name")).filter("name <> ''"))
    d = person(lines.select(key, _all(f"([{HAN}]{{2,3}})之[父母子女兄弟姐妹]").alias("name")))
    p = lines.select(key, _all(rf"\(今([{HAN}]{{2,5}})\)").alias("name")).withColumn("type", F.lit("LOC"))
    every = reduce(DataFrame.unionByName, [a, b, c, d, p])
    return every.filter(~is_noise(F.col("name"))).select(key, "type", "name").distinct()


def kin_relations(docs: DataFrame, names: DataFrame, key: str, look_back: bool = True) -> DataFrame:
    """(key, src, dst, type, confidence) of "X之父Y" for stored names X.

    Every place of a kinship suffix is a candidate, with the 14 characters before and the 8 after it;
    the endings of 2 to 4 characters before it meet the names by an equi-join, so texts and names are
    never crossed. Y is the nearest stored name in the 10 characters before X (of those that end at the
    same place, the longest; not one that stands where X does), as in "Y，X之子". Without one, and without
    ``look_back``, Y follows: "Y年" of 2 or 3 characters, or else 2 to 4 characters to the next stop
    character, less a leading 后裔 or 后. Y is not a dynasty, an era, or a proper part of a stored name.
    """
    # The look-ahead comes first, so that only places of a suffix look back.
    place = rf"(?=(?:{_SUFFIX_PATTERN}))(?<=(\A[\s\S]{{0,13}}|[\s\S]{{14}}))({_SUFFIX_PATTERN})(?=([\s\S]{{0,8}}))"
    group = lambda i: F.regexp_extract_all("text", F.lit(place), F.lit(i))
    hit = docs.select(key, F.explode(F.arrays_zip(group(1).alias("before"), group(2).alias("suffix"), group(3).alias("after"))).alias("m")).select(key, "m.*").distinct()
    rest = F.regexp_extract("after", rf"^[^{HAN}]*([\s\S]*)", 1)
    year = F.regexp_extract(rest, f"^([{HAN}]{{2,3}})年", 1)
    run = F.regexp_extract(rest, f"^[^{STOP_CHARS}]*", 0)
    plain = F.regexp_extract(F.when(run == "", F.substring(rest, 1, 4)).otherwise(run), f"^[{HAN}]{{2,4}}", 0)
    kinds = F.create_map(*[F.lit(x) for pair in KIN_SUFFIXES for x in pair])
    long = F.length("before")
    ends = hit.filter(long >= 2).select(
        key,
        F.explode(F.sequence(F.lit(2), F.least(F.lit(4), long))).alias("k"),
        "before",
        F.concat("suffix", "after").alias("tail"),
        kinds[F.col("suffix")].alias("type"),
        F.when(year != "", year).otherwise(F.regexp_replace(plain, "^(后裔|后)", "")).alias("dst"),
    )
    ends = ends.select(key, F.substring(F.col("before"), long - F.col("k") + 1, F.col("k")).alias("src"), F.substring(F.col("before"), F.greatest(F.lit(1), long - F.col("k") - 9), F.least(F.lit(10), long - F.col("k"))).alias("window"), "tail", "type", "dst")
    known = names.select(F.col("name").alias("src")).distinct()
    found = ends.join(known, "src", "left_semi").withColumn("end", F.lit(0)).withColumn("k", F.lit(0))
    if look_back:
        wide = F.length("window")
        spots = found.filter(wide >= 2).select(key, "src", "window", "tail", "type", F.explode(F.sequence(F.lit(1), wide - 1)).alias("i"))
        spots = spots.select("*", F.explode(F.sequence(F.lit(2), wide - F.col("i") + 1)).alias("k"))
        spots = spots.select(key, "src", "window", "tail", "type", F.substring(F.col("window"), F.col("i"), F.col("k")).alias("dst"), (F.col("i") + F.col("k")).alias("end"), "k")
        spots = spots.filter(~F.concat("src", "tail").startswith(F.col("dst"))).join(known.select(F.col("src").alias("dst")), "dst", "left_semi")
        found = found.unionByName(spots).groupBy(key, "src", "window", "tail", "type").agg(F.max_by("dst", F.struct("end", "k")).alias("dst"))
    found = found.select(key, "src", "type", "dst").filter((F.length("dst") >= 2) & ~F.col("dst").startswith("之") & ~F.col("dst").isin(*DYNASTIES, *ERAS)).distinct()
    # Proper parts of stored names, by their character runs rather than by comparing all pairs.
    runs = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("i")).select("name", "i", F.explode(F.sequence(F.lit(1), F.length("name") - F.col("i") + 1)).alias("k"))
    inner = runs.select("name", F.substring(F.col("name"), F.col("i"), F.col("k")).alias("dst")).filter("dst <> name").select("dst").distinct()
    return found.join(inner, "dst", "left_anti").select(key, "src", "dst", "type", F.lit(0.85).alias("confidence"))


def places_of(docs: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, src, relation, location, confidence) of stored names: "name，X人", and offices held in a prefecture or county.

    Names are met as endings of the characters before, by an equi-join.
    """
    def hits(pattern: str, tail: str, relation: str, sure: float) -> DataFrame:
        m = docs.select(key, F.explode(F.regexp_extract_all("text", F.lit(f"([{HAN}]{{2,4}}{pattern})"), F.lit(1))).alias("m"))
        cut = m.select(key, F.regexp_extract("m", f"^([{HAN}]{{2,4}}?){tail}$", 1).alias("before"), F.regexp_extract("m", f"^[{HAN}]{{2,4}}?{tail}$", 1).alias("location"))
        ends = F.transform(F.sequence(F.lit(2), F.length("before")), lambda k: F.substring(F.col("before"), F.length("before") - k + 1, k))
        return cut.filter("before <> ''").select(key, F.explode(ends).alias("src"), F.lit(relation).alias("relation"), "location", F.lit(sure).alias("confidence"))

    native = hits(f"，[{HAN}]{{2,6}}人", f"，([{HAN}]{{2,6}})人", "NATIVE_OF", 0.8)
    office = hits(f"[知任拜][{HAN}]{{1,3}}[州府县]", f"[知任拜]([{HAN}]{{1,3}}[州府县])", "OFFICIAL", 0.75)
    known = names.select(F.col("name").alias("src")).distinct()
    return native.unionByName(office).join(known, "src", "left_semi").select(key, "src", "relation", "location", "confidence").distinct()


def dynasty_of(text: Column) -> Column:
    """The first dynasty, in the list's order, that a text names."""
    return F.coalesce(*[F.when(text.contains(d), F.lit(d)) for d in DYNASTIES])


def dynasty_of_year(year: Column) -> Column:
    named = reduce(lambda c, p: c.when(year < p[0], p[1]), YEAR_DYNASTIES[1:], F.when(year < YEAR_DYNASTIES[0][0], YEAR_DYNASTIES[0][1]))
    return F.when(year.isNull(), "未知").otherwise(named.otherwise("近现代"))


def upsert(changes: DataFrame, fields: list[str]) -> DataFrame:
    """One person a name from ordered changes (name, seq, fields): of each field the last value that is not empty; the class anew."""
    last = [F.coalesce(F.max_by(f, F.when(F.coalesce(F.col(f), F.lit("")) != "", F.col("seq"))), F.lit("")).alias(f) for f in fields]
    merged = changes.groupBy("name").agg(*last)
    pick = lambda f: F.col(f) if f in fields else F.lit("")
    return merged.withColumn("person_type", person_class(pick("family_name"), F.col("name"), pick("role_of_family"), pick("dynasty"), pick("title")))


def stubs(relations: DataFrame, people: DataFrame) -> DataFrame:
    """Names on either side of a relation that are no stored people."""
    return relations.select(F.col("src").alias("name")).union(relations.select("dst")).distinct().join(people.select("name"), "name", "left_anti")


def resolve(entities: DataFrame) -> DataFrame:
    """One entity for each (name, type): the first by position, with the longest biography."""
    return entities.groupBy("name", "type").agg(F.min("position").alias("position"), F.max_by("biography", F.struct(F.length("biography"), F.col("biography"))).alias("biography"))


def repair_json(reply: Column, schema: str) -> Column:
    """Rows of a model's reply: code fences cut off, a bare list or one under ``entities`` or else ``relations``; null if it is no JSON."""
    body = F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))
    rows = F.when(body.startswith("["), body).otherwise(F.coalesce(F.get_json_object(body, "$.entities"), F.get_json_object(body, "$.relations")))
    return F.from_json(rows, f"array<struct<{schema}>>", {"mode": "PERMISSIVE"})


def similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / most)


def ranked_versions(versions: DataFrame) -> DataFrame:
    """Versions of a text by a weighted sum of age, completeness, source and rarity (weights .4, .3, .2, .1)."""
    score = F.round(0.4 * F.col("age") + 0.3 * F.col("completeness") + 0.2 * F.col("authority") + 0.1 * F.col("rarity"), 6)
    return versions.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("work").orderBy(F.desc("score"), "version")))


# ---- Fixed values: kinship and name words that stand before a name.
KIN_PREFIXES = (("祖父", "PATERNAL_GRANDFATHER"), ("祖母", "PATERNAL_GRANDMOTHER"), ("父", "FATHER"), ("母", "MOTHER"), ("字", "COURTESY_NAME"), ("号", "ART_NAME"))
# ---- End of fixed values.


#: Names, and heads of names, that are broadcast at most.
MOST_BROADCAST = 200_000


def prefix_relations(docs: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, src, dst, type, confidence) of "父Y", "字Y" and the like where no Chinese character stands before the word.

    The source is the nearest stored name of 2 to 5 characters in the 50 characters before (of those that end
    at the same place, the longest). Texts are cut in one pass where such a word stands, and the 50 characters
    are put together from the ends of the pieces. Names are met by equi-joins: the pairs of characters there
    with the first two of the names, and only the runs that begin so with the names. Names and pairs are
    broadcast where they are few (counted first); beyond, they meet by shuffle.
    """
    words = "|".join(p for p, _ in KIN_PREFIXES)
    kinds = F.create_map(*[F.lit(x) for pair in KIN_PREFIXES for x in pair])
    cut = F.split("text", f"(?<![{HAN}])(?=(?:{words})[{HAN}]{{2}})")
    pieces = docs.select(key, F.transform(cut, lambda p: F.struct(F.right(p, F.lit(50)).alias("tail"), F.substring(p, 1, 6).alias("head"))).alias("pieces"))
    # A piece after the first has a word, two characters and one that is not Chinese, so that 13 hold 50.
    ends = lambda i: F.concat(*[F.coalesce(F.get("pieces", i - j)["tail"], F.lit("")) for j in range(13, 0, -1)])
    found = pieces.select(key, F.explode(F.transform("pieces", lambda p, i: F.struct(F.right(ends(i), F.lit(50)).alias("before"), p["head"].alias("head")))).alias("m")).select(key, "m.*")
    spots = found.filter(F.length("before") >= 2).select(key, "before", "head", F.explode(F.sequence(F.lit(1), F.length("before") - 1)).alias("i"))
    sent = lambda df: F.broadcast(df) if df.count() <= MOST_BROADCAST else df
    known = names.filter(F.length("name").between(2, 5)).select(F.col("name").alias("src")).distinct()
    pairs = known.select(F.substring("src", 1, 2).alias("pair"), F.length("src").alias("k")).distinct()
    runs = spots.withColumn("pair", F.substring(F.col("before"), F.col("i"), F.lit(2))).join(sent(pairs), "pair").filter(F.col("i") + F.col("k") - 1 <= F.length("before"))
    cand = runs.select(key, "before", "head", "i", "k", F.substring(F.col("before"), F.col("i"), F.col("k")).alias("src")).join(sent(known), "src", "left_semi")
    # The end and the length as one number, of which a hash aggregate takes the largest.
    best = cand.groupBy(key, "before", "head").agg(F.max((F.col("i") + F.col("k")) * 10 + F.col("k")).alias("at"))
    end, k = F.floor(F.col("at") / 10).cast("int"), (F.col("at") % 10).cast("int")
    part = lambda i: F.regexp_extract("head", f"^({words})([{HAN}]{{2,4}})", i)
    return best.select(key, F.substring(F.col("before"), end - k, k).alias("src"), part(2).alias("dst"), kinds[part(1)].alias("type"), F.lit(0.8).alias("confidence")).distinct()


def life_years(text: Column, name: Column) -> tuple[Column, Column]:
    """Years of birth and death that follow a name; the death year is read as well as the birth year."""
    year = lambda words: F.nullif(F.call_function("regexp_extract", text, F.concat(F.lit("\\Q"), name, F.lit(f"\\E[^字]*?(?:{words})于?([0-9]{{4}})年?")), F.lit(1)), F.lit("")).cast("int")
    return year("生"), year("卒|殁")


def anti_merge(rules: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Rule rows, and those of a model that have no rule row of the same keys."""
    return rules.unionByName(model.join(rules.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def entity_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Weighted likeness of two people: name .3, years .25, place .25, title .2; years by their overlap over their union."""
    overlap = F.greatest(F.lit(0), F.least(a["to"], b["to"]) - F.greatest(a["from"], b["from"]))
    union = F.greatest(a["to"], b["to"]) - F.least(a["from"], b["from"])
    years = F.when(union > 0, overlap / union).otherwise(F.lit(0.0))
    same = lambda f: F.when(a[f] == b[f], 1.0).otherwise(0.0)
    return F.round(0.3 * similarity(a["name"], b["name"]) + 0.25 * years + 0.25 * same("place") + 0.2 * same("title"), 6)


def decorated(docs: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """(key, type, name, context, biography) of named entities: 50 characters about the first mention, and 100 with white space folded."""
    met = found.join(docs.select(key, "text"), key).withColumn("at", F.instr(F.col("text"), F.col("name")) - 1).filter("at >= 0")
    about = lambda n: F.substring(F.col("text"), F.greatest(F.col("at") - n, F.lit(0)) + 1, F.least(F.col("at"), F.lit(n)) + F.length("name") + n)
    return met.select(key, "type", "name", about(50).alias("context"), F.trim(F.regexp_replace(about(100), r"\s+", " ")).alias("biography"))


def dynasty_before(text: Column, position: Column, most: int = 200) -> Column:
    """The first dynasty, in the list's order, that the characters before a place (from 0) name."""
    return F.coalesce(dynasty_of(F.substring(text, F.greatest(position - most, F.lit(0)) + 1, F.least(position, F.lit(most)))), F.lit(""))


def stored_relations(docs: DataFrame, names: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """(key, src, dst, type, confidence), each relation once: kinship of stored names in the texts, and the relations ``found`` whose ends are both stored and whose target is no dynasty."""
    known = names.select("name").distinct()
    ends = lambda c: known.withColumnRenamed("name", c)
    kept = found.filter(~F.col("dst").isin(*DYNASTIES)).join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi")
    every = kin_relations(docs, names, key).unionByName(kept.select(key, "src", "dst", "type", F.coalesce("confidence", F.lit(0.5)).alias("confidence")))
    return every.groupBy(key, "src", "dst", "type").agg(F.max("confidence").alias("confidence"))


def graph_of_texts(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, stats) of texts by rules: named entities with their context, the relations of the people among them, and counts of each text."""
    found = named_entities(docs, key)
    people = found.filter("type = 'PER'")
    entities = resolve(decorated(docs, key, found).select("name", "type", F.col(key).alias("position"), "biography"))
    relations = kin_relations(docs, people.select("name").distinct(), key)
    counts = found.groupBy(key).agg(F.count(F.lit(1)).alias("total_entities"), F.count(F.when(F.col("type") == "PER", 1)).alias("person_entities"))
    stats = docs.select(key).join(counts, key, "left").join(relations.groupBy(key).agg(F.count(F.lit(1)).alias("total_relations")), key, "left")
    return entities, relations, stats.fillna(0, ["total_entities", "person_entities", "total_relations"])


def merged_versions(versions: DataFrame, strategy: str, weights: str = "weight") -> DataFrame:
    """(work, place, text) of several versions' sentences (work, version, place, text, completeness, quality, age, weight).

    ``complete``, ``quality`` and ``original`` take all of the version that is best by completeness, quality or age
    (ties: the smaller version); ``vote`` takes at each place the text with the largest sum of weights, and
    ``structural`` the first version, by quality, that has a text there.
    """
    if strategy == "vote":
        tally = versions.groupBy("work", "place", "text").agg(F.sum(weights).alias("w"))
        return tally.groupBy("work", "place").agg(F.max_by("text", F.struct("w", "text")).alias("text"))
    if strategy == "structural":
        there = versions.filter(F.coalesce("text", F.lit("")) != "")
        return there.groupBy("work", "place").agg(F.max_by("text", F.struct("quality", -F.col("version"))).alias("text"))
    by = {"complete": "completeness", "quality": "quality", "original": "age"}
    if strategy not in by:
        raise ValueError(f"unknown strategy of merging: {strategy}")
    best = versions.groupBy("work").agg(F.max_by("version", F.struct(F.col(by[strategy]), -F.col("version"))).alias("version"))
    return versions.join(best, ["work", "version"], "left_semi").select("work", "place", "text")
