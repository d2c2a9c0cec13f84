"""Inputs of the queries about people, pages and versions, derived from the given tables.

The tables hold no Chinese text, so rows take names, offices and phrases from short lists by their ids, and texts map their letters
to characters. Each input is one SQL text that Spark and DuckDB read alike; its rows grow with the table it is derived from.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import load


def pick(values: list[str], number: str) -> str:
    """One of some strings by a number."""
    return f"split_part('{'|'.join(values)}', '|', CAST(1 + ({number}) % {len(values)} AS INT))"


def character(characters: str, number: str) -> str:
    return f"substr('{characters}', CAST(1 + ({number}) % {len(characters)} AS INT), 1)"


def lines(text: str) -> str:
    """A string whose line ends are written as ~, and braces as « and »."""
    return f"translate({text}, '~«»', chr(10) || chr(123) || chr(125))"


def han(text: str, letters: str, characters: str) -> str:
    """A text's letters and marks as Chinese characters; those without one go."""
    return f"translate(lower({text}), '{letters}', '{characters}')"


LABELS = ["苏辙", "王安石", "李白", "欧阳修", "苏夫人", "苏氏", "苏妾", "王氏", "王阳明", "某人", "", "无名氏", "苏蘅", "司马光", "苏洵", "苏轼"]
PHRASES = [
    "苏辙之父苏洵为唐宋八大家之一", "苏轼之母王氏，苏辙之姐也。", "苏轼之弟苏辙，字子由", "苏辙之妻王氏，眉山人", "苏洵之孙苏籥", "之乎者也矣焉哉，苏辙之父苏洵。之乎者也，苏辙之父苏洵。",
    "苏辙之父宋，", "苏辙之父嘉祐", "苏辙之父嘉靖", "", "苏辙之父 子。", "王安石，字介甫，抚州临川人。~韩琦(1008—1075)，相州安阳人~司马光之父司马池~清苑(今保定)旧志", "范仲淹知苏州，任开封府", "苏轼之外祖母程氏，眉山人也",
]
#: Of texts about kinship the rarer letters become names and relations and the others go; of recognised lines the frequent ones become variants and avoided characters.
KIN_LETTERS = ("fgpbwvyk.etaoinshrdlucmjxqz ,", "之父母子苏轼洵弟。")
LINE_LETTERS = ("etaoinshrdlucm. ", "玄弘历吳後臺之三年氏居焉一里")
BIOGRAPHIES = ["北宋苏洵子", "宋临川人", "唐诗人", "", "明余姚人", "清刻本载", "西汉元鼎", "宋吉州永丰人，明道间", "无年"]
REPLIES = ['```json~[«"name":"<x>","type":"PER"»]~```', '«"entities":[«"name":"<x>","type":"LOC"»,«"name":"<y>","type":"PER"»]»', "none", "[]", '«"relations":[«"name":"<y>","type":"FATHER"»]»', '```~«"entities":[]»~```']
SERVICES = [
    '«"success":true,"data":«"results":[«"text":"<x>","rect":«"x":<n>,"y":2,"width":10,"height":5»,"probability":«"average":0.7»»,«"text":"","probability":«"max":0.4»»]»»',
    '«"success":true,"data":«"text":"<y>","probability":«"average":0.8»»»', '«"success":false,"error_code":"<x>"»', "broken",
]
HEADING, SECTION = "^卷[零一二三四五六七八九十百0-9]+", "^第[零一二三四五六七八九十百0-9]+[节章]"
UPSERT_COLUMNS = ("family_name", "dynasty", "title", "role_of_family")


def _filled(templates: list[str]) -> str:
    """A reply of an event: its type, its user and its number put into a template."""
    return lines(f"replace(replace(replace({pick(templates, 'event_id')}, '<x>', event_type), '<y>', CAST(user_id AS STRING)), '<n>', CAST(event_id % 50 AS STRING))")


_ORDER = "o_orderkey + o_custkey"
SOURCES = {
    "persons": f"""SELECT c_custkey AS id, {pick(LABELS, "c_custkey * 7 + c_nationkey")} AS label_chs, {pick(["苏", "王", "李", "欧阳", "", "司马", "某"], "c_custkey")} AS family_name,
  {pick(["", "", "", "妻", "子", "夫人", "孺人"], "c_nationkey")} AS role_of_family, {pick(["", "宋", "唐", "明", "", "清"], "c_custkey + c_nationkey")} AS dynasty, {pick(["", "翰林学士", "", "尚书", "知县"], "c_custkey * 3 + c_nationkey")} AS title,
  {pick(BIOGRAPHIES, "c_custkey * 5 + c_nationkey")} || CASE WHEN c_acctbal < 0 THEN '' ELSE {pick(BIOGRAPHIES, "c_custkey")} || c_name END AS biography FROM {{customer}}""",
    "names": f"SELECT DISTINCT name FROM (SELECT {pick([*LABELS, '苏籥', '王氏', '苏东坡', '司马池', '之苏', '父王', '王子', '介甫', '范仲淹', '苏序'], 'c_custkey')} AS name FROM {{customer}}) n WHERE name <> ''",
    "texts": f"""SELECT doc_id AS id, {lines(pick(PHRASES, "doc_id"))} || {han("text", *KIN_LETTERS)} AS text FROM {{documents}}""",
    "prefix_texts": f"""SELECT doc_id AS id, {pick(["王安石，父益，字介甫，号半山，临川人", "苏轼苏辙，父苏洵。", "字无人", "其祖父苏序，祖父某某甲"], "doc_id")} || {han("text", *KIN_LETTERS)} AS text FROM {{documents}}""",
    "found": f"""SELECT doc_id AS id, {pick(LABELS, "doc_id")} AS src, {pick(["苏洵", "苏辙", "宋", "路人甲"], "doc_id * 3 + n_chars")} AS dst, {pick(["FATHER", "FRIEND"], "n_chars")} AS type, CAST(n_chars % 10 AS DOUBLE) / 10 AS confidence FROM {{documents}}""",
    "relations": f"""SELECT o_orderkey AS id, {pick(["甲", "苏辙", "X", "王安石", "丁"], "o_custkey")} || CASE WHEN o_custkey % 3 = 0 THEN CAST(o_custkey AS STRING) ELSE '' END AS src, {pick(["乙", "苏洵", "Y", "丙", "戊", "李白"], "o_orderkey")} AS dst,
  {pick(["FATHER", "SON", "FRIEND"], _ORDER)} AS type, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS confidence FROM {{orders}}""",
    "upserts": f"""SELECT {pick(LABELS, "o_custkey")} || CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS STRING) ELSE '' END AS name, o_orderkey AS seq, {pick(["", "苏", "", "欧阳", "王"], "o_orderkey")} AS family_name,
  {pick(["", "宋", "", "明"], "o_orderkey * 3")} AS dynasty, {pick(["", "", "翰林学士", "尚书"], _ORDER)} AS title, {pick(["", "", "", "妻", "子"], _ORDER)} AS role_of_family FROM {{orders}}""",
    "variants": f"""SELECT DISTINCT standard, variant FROM (SELECT CASE WHEN p_size % 13 = 0 THEN '祝福' ELSE {character("吴后台历志里元宏", "p_partkey")} END AS standard,
  CASE WHEN p_size % 17 = 0 THEN '祝褔' ELSE {character("吳呉後臺颱歷曆誌裏裡壹參", "p_partkey * 7 + p_size")} END AS variant FROM {{part}}) v""",
    "taboo": f"""SELECT {pick(["qing", "qing", "jianwen", "confucius"], "n_nationkey")} AS dynasty, {pick(["康熙", "乾隆", "建文帝", "孔子"], "n_nationkey")} AS emperor, n_nationkey AS seq,
  {character("玄弘历炆允丘武門之變治三年吳氏居焉一里志后台王李张", "n_nationkey")} AS ch, {character("元宏歷息缘邱文门子变理参岁吴世住也壹裡誌後臺汪理章", "n_nationkey")} AS replacement FROM {{nation}}""",
    "ocr": f"""SELECT conv_id AS page, turn AS line, CASE WHEN turn % 5 = 4 THEN '' ELSE {han("text", *LINE_LETTERS)} END AS text, 10 + turn * 3 AS x0, turn * 20 AS y0, 10 + turn * 4 + length(text) * 3 AS x1, turn * 20 + 18 AS y1,
  CAST((conv_id * 37 + turn * 11) % 100 AS DOUBLE) / 100 AS confidence FROM {{conversations}}""",
    "replies": f"SELECT event_id AS id, CASE WHEN event_id % 9 = 8 THEN props ELSE {_filled(REPLIES)} END AS reply FROM {{events}}",
    "services": f"SELECT event_id AS id, CASE WHEN event_id % 9 = 8 THEN props ELSE {_filled(SERVICES)} END AS reply FROM {{events}}",
    "chapters": f"""SELECT doc_id AS id, {lines(pick(["卷一 总志~", "", "第二节 山川~水~", "~~"], "doc_id"))} || replace(text, '. ', '.' || chr(10) || chr(10)) || {lines("'~第一节 建置~汉置~卷二~'")} || source || {lines(pick(["", "~卷十 杂记~末", "~~终"], "doc_id"))} AS text FROM {{documents}}""",
    "findings": "SELECT event_type AS kind, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 WHEN 'error' THEN 4 ELSE 5 END AS kind_no, event_id AS seq, props AS text FROM {events}",
    "checks": "SELECT s_name AS name, CASE WHEN s_acctbal < 0 THEN 'WARN' ELSE 'PASS' END AS status FROM {supplier}",
    "audited": "SELECT source AS name, CAST(max(doc_id) % 3 AS BIGINT) % 2 AS enabled FROM {documents} GROUP BY source",
    "versions": "SELECT p_brand AS work, p_partkey AS version, CAST(p_size AS DOUBLE) / 50 AS age, CAST(p_partkey * 3 % 10 AS DOUBLE) / 10 AS completeness, CAST(p_partkey % 10 AS DOUBLE) / 10 AS authority, CAST(p_partkey * 7 % 10 AS DOUBLE) / 10 AS rarity FROM {part}",
    "version_a": "SELECT conv_id AS id, turn AS n, text FROM {conversations} WHERE turn % 5 <> 3",
    "version_b": "SELECT conv_id AS id, turn AS n, CASE WHEN (conv_id + turn) % 3 = 0 THEN upper(text) ELSE text END AS text FROM {conversations} WHERE (turn + conv_id) % 4 <> 1",
    "lives": f"SELECT c_custkey AS id, {pick(LABELS, 'c_custkey')} || {pick(['生于', '生', '字子由，生', '无'], 'c_custkey')} || CAST(1000 + c_custkey % 90 AS STRING) || '年，' || {pick(['卒于', '殁', '葬'], 'c_nationkey')} || CAST(1100 + c_custkey % 80 AS STRING) AS text, {pick(LABELS, 'c_custkey')} AS name FROM {{customer}}",
    "alike": """SELECT c_custkey AS id, c_name AS n1, 900 + c_nationkey AS f1, 950 + c_custkey % 50 AS t1, c_mktsegment AS p1, 'n' || CAST(c_nationkey % 3 AS STRING) AS o1,
  replace(c_name, '0', CAST(c_custkey % 4 AS STRING)) AS n2, 900 + c_custkey % 60 AS f2, 965 + c_custkey % 60 AS t2, CASE WHEN c_acctbal < 4000 THEN c_mktsegment ELSE '' END AS p2, 'n' || CAST(c_custkey % 3 AS STRING) AS o2 FROM {customer}""",
    "typed": """SELECT id, a, b, translate(a, 'ëè', 'ee') AS na, translate(b, 'ëè', 'ee') AS nb, translate(a, 'à', 'a') AS pa, translate(b, 'à', 'a') AS pb FROM (SELECT conv_id * 100 + turn AS id, CASE WHEN turn = 3 THEN '' ELSE text END AS a,
  CASE conv_id % 7 WHEN 0 THEN text WHEN 1 THEN '' WHEN 2 THEN substr(text, 2) || substr(text, 1, 1) WHEN 3 THEN translate(text, 'e', 'ë') WHEN 4 THEN translate(text, 'a', 'à') WHEN 5 THEN text || '.' ELSE replace(text, 'e', 'o') END AS b FROM {conversations}) t""",
}


def rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = SOURCES[name]
    return spark.sql(sql, **{t: load(spark, sf_dir, t) for t in re.findall(r"\{(\w+)\}", sql)})


def values(name: str) -> str:
    """The same rows for DuckDB."""
    return "(" + re.sub(r"\{(\w+)\}", r"\1", SOURCES[name]) + ")"
