"""The queries over the reference tables and their SQL, name by name."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfield.catalogue import ANCHORS, INLINE, LOOKALIKES, SEPARATORS, SPATIAL, WEIGHTS
from inkfield.functions import geometry as g
from inkfield.functions import numbers as n
from inkfield.functions import text as t
from inkfield.operators import blocks as b
from inkfield.operators import labels as lab
from inkfield.options import Options
from inkfield.plans.certificates import AT, HEADER, LABELS, LOOSE, VARIANTS, facts, rendered, table
from inkfield.plans.parse import envelope, log_lines, parse_blocks, summary
from inkfield.sources.pages import render_scale
from inkfield.sources.wire import model_blocks, read_bodies, upload_kind, wire_blocks

TODAY = dt.date(2026, 1, 1)
OPTIONS = Options(today=TODAY)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


FROM, TO = t.fold_table()


def s_fold(x: str) -> str:
    return f"translate({x}, {q(FROM)}, {q(TO)})"


def s_words(x: str) -> str:
    return rf"coalesce(trim(regexp_replace({s_fold(x)}, '[^\p{{L}}\p{{Nd}}]+', ' ', 'g')), '')"


def s_clean(x: str) -> str:
    one = rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
    return f"coalesce(trim(regexp_replace(regexp_replace({one}, '^[:\\-.,;=–]+', ''), '[:\\-,;=–]+$', '')), '')"


def s_digits(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g')"


def s_digit(x: str, place: int) -> str:
    return f"CAST(substr({x}, {place}, 1) AS INTEGER)"


def s_tax_check(x: str) -> str:
    terms = []
    for p in range(1, 10):
        d = f"(({s_digit(x, p)} + {10 - p}) % 10)"
        terms.append(f"CASE WHEN {d} = 0 THEN 0 WHEN ({d} * {1 << (10 - p)}) % 9 = 0 THEN 9 ELSE ({d} * {1 << (10 - p)}) % 9 END")
    return "((10 - (" + " + ".join(f"({x})" for x in terms) + ") % 10) % 10)"


def s_person(x: str) -> tuple[str, str]:
    odd = "(" + " + ".join(s_digit(x, p) for p in range(1, 10, 2)) + ")"
    even = "(" + " + ".join(s_digit(x, p) for p in range(2, 9, 2)) + ")"
    tenth = f"((7 * {odd} - {even}) % 10 + 10) % 10"
    return tenth, f"({odd} + {even} + ({tenth})) % 10"


FACTS = f"""
first AS (SELECT o_custkey AS key, min(o_orderdate) AS since FROM orders GROUP BY o_custkey),
raw AS (SELECT c_custkey AS key, c_custkey % {len(VARIANTS)} AS variant, CAST(100000000 + c_custkey * 1777 AS VARCHAR) AS body, CAST(500000000 + c_custkey * 1777 AS VARCHAR) AS other, c_name, n_name, r_name, c_mktsegment, since
  FROM customer JOIN first ON c_custkey = key JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
facts AS (SELECT key, variant, body || CAST((({s_tax_check('body')}) + CASE WHEN variant = {AT['wrong check digit']} THEN 1 ELSE 0 END) % 10 AS VARCHAR) AS vkn, other || CAST({s_tax_check('other')} AS VARCHAR) AS second,
  body || CAST({s_person('body')[0]} AS VARCHAR) || CAST({s_person('body')[1]} AS VARCHAR) AS tckn, c_name || ' A.Ş.' AS name, 'AYŞE ' || c_mktsegment AS person, n_name AS office,
  strftime(since, '%d.%m.%Y') AS since, lpad(CAST(key * 37 % 1000000 AS VARCHAR), 6, '0') AS code, c_mktsegment AS said, r_name || ' MAH. NO: ' || CAST(key % 97 AS VARCHAR) AS address FROM raw)"""


def s_on(*names: str) -> str:
    return f"variant IN ({', '.join(str(AT[n]) for n in names)})"


def s_case(*cases: tuple[str, str], rest: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in cases) + f" ELSE {rest} END"


def blocks_sql() -> str:
    sure, other = s_case((s_on("page badly read"), "0.5"), rest="0.98"), s_on("another document")
    rows = [(i, i, x, s_case((other, q("FATURA") if i == 0 else "NULL"), (s_on("without header"), "NULL"), rest=q(text)), sure) for i, (text, x) in enumerate(HEADER)]
    label = s_case(
        (s_on("misspelt label"), q("Vergi Kimlik Numarasl")), (s_on("person"), q("TC KİMLİK NO")), (s_on("label over two lines"), q("NUMARASI")), (s_on("number after its label"), "'VERGİ KİMLİK NO: ' || vkn"),
        (s_on("label without space"), q("VERGİ KİMLİKNUMARASI")), (s_on("number without label", "another document"), "NULL"), rest=q("VERGİ KİMLİK NUMARASI"),
    )
    number = s_case(
        (s_on("number in groups"), "substr(vkn, 1, 3) || ' ' || substr(vkn, 4, 3) || ' ' || substr(vkn, 7, 4)"), (s_on("number over two blocks"), "substr(vkn, 1, 5)"), (s_on("person"), "tckn"),
        (s_on("letters for digits"), "translate(vkn, '05', 'OS')"), (s_on("number after its label"), "NULL"), rest="vkn",
    )
    cell = s_on("code and description in a cell")
    said = {
        "name": s_case((s_on("person"), "person"), (s_on("name over two lines"), "replace(name, ' A.Ş.', '')"), rest="name"),
        "office": s_case((s_on("office with ending"), "office || ' V.D.'"), rest="office"),
        "since": s_case((s_on("date unreadable"), "'--.--.----'"), rest="since"),
        "code": s_case((cell, "code || '-' || said"), rest="code"),
        "said": s_case((s_on("description of digits"), "code || ' AB'"), (cell, "NULL"), rest="said"),
        "address": "address",
    }
    heads = {"name": s_case((s_on("person"), q("ADI SOYADI")), rest=q("TİCARET UNVANI")), "code": s_case((cell, q("ANA FAALİYET KODU VE ADI")), rest=q("ANA FAALİYET KODU")), "said": s_case((cell, "NULL"), rest=q("ANA FAALİYET"))}
    rows += [(4, 4, 100, label, sure), (5, 5, 150, number, s_case((s_on("number badly read"), "0.6"), rest=sure))]
    for i, (text, value) in enumerate(LABELS):
        rows.append((6 + 2 * i, 6 + 2 * i, 100, s_case((other, "NULL"), rest=heads.get(value, q(text))), sure))
        rows.append((7 + 2 * i, 7 + 2 * i, 150, said[value] if value == "said" else s_case((other, "NULL"), rest=said[value]), sure))
    for i, at, x, when, text in (
        (18, 5, 260, "number over two blocks", "substr(vkn, 6, 5)"), (19, 3, 100, "label over two lines", q("VERGİ KİMLİK")), (20, 18, 150, "address of three lines", q(LOOSE[0])), (21, 19, 150, "address of three lines", q(LOOSE[1])),
        (22, 8, 150, "name over two lines", q(LOOSE[2])), (24, 19, 150, "two numbers", "second"), (25, 18, 226, "another label's value below", q("2024 YILI")),
    ):
        rows.append((i, at, x, s_case((s_on(when), text)), sure))
    rows.append((23, 18, 100, s_case((s_on("two numbers"), q("VERGİ NUMARASI")), (s_on("another label's value below"), q("TAKVİM"))), sure))
    parts = " UNION ALL ".join(f"SELECT key, variant, {i} AS block_idx, {at} AS line, {text} AS text, CAST({c} AS DOUBLE) AS confidence, CAST({x} AS DOUBLE) AS x FROM facts" for i, at, x, text, c in rows)
    beside = f"{s_on('values beside labels')} AND block_idx BETWEEN 5 AND 17 AND block_idx % 2 = 1"
    return f"""{FACTS}, parts AS ({parts}),
lined AS (SELECT *, {s_case((beside, "130.0 + 5.0 * (block_idx - 5) + greatest(60.0, 16.0 * length(lag(text) OVER (PARTITION BY key ORDER BY block_idx)))"), rest="x")} AS x1,
  CAST(100 + 66 * (line - CASE WHEN {beside} THEN 1 ELSE 0 END + CASE WHEN {s_on('name over two lines')} AND block_idx BETWEEN 8 AND 17 THEN 1 ELSE 0 END) AS DOUBLE) AS y1 FROM parts),
blocks AS (SELECT CAST(key AS VARCHAR) AS doc_id, 1 AS page, block_idx, text, confidence, x1, y1, x1 + greatest(60.0, 16.0 * length(text)) AS x2, y1 + 40.0 AS y2 FROM lined WHERE text IS NOT NULL)"""


BLOCKS = blocks_sql()
CATALOGUE = "catalogue(field, alias, compact, size, least, slack, edits, rank) AS (VALUES " + ", ".join(f"({q(r['field'])}, {q(r['alias'])}, {q(r['compact'])}, {r['size']}, {r['least']}::DOUBLE, {r['slack']}::DOUBLE, {r['edits']}, {r['rank']})" for r in lab.catalogue()) + ")"
JUDGED = f"""{BLOCKS}, {CATALOGUE},
folded AS (SELECT *, {s_words('text')} AS words, replace({s_words('text')}, ' ', '') AS joined FROM blocks),
judged AS (SELECT f.*, c.*, CASE WHEN words = alias OR starts_with(words, alias || ' ') THEN 1.0::DOUBLE WHEN joined = compact THEN 0.99::DOUBLE WHEN starts_with(joined, compact) THEN 0.98::DOUBLE
  WHEN least < 1 AND abs(length(words) - size) <= slack AND levenshtein(words, alias) <= edits AND 1.0::DOUBLE - levenshtein(words, alias)::DOUBLE / greatest(length(words), size) >= least THEN 1.0::DOUBLE - levenshtein(words, alias)::DOUBLE / greatest(length(words), size) END AS similarity
  FROM folded f CROSS JOIN catalogue c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block_idx ORDER BY similarity DESC, rank) AS nth FROM judged WHERE similarity IS NOT NULL AND words <> ''),
labelled AS (SELECT * FROM ranked WHERE nth = 1)"""


def s_box(a: str, b: str) -> dict[str, str]:
    """SQL of overlaps and scores of two aliased boxes."""
    h = f"greatest({a}.y2 - {a}.y1, 1.0)"
    across = f"CASE WHEN least(greatest({a}.x2 - {a}.x1, 0.0), greatest({b}.x2 - {b}.x1, 0.0)) <= 0 THEN 0.0 ELSE least(1.0, greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) / least({a}.x2 - {a}.x1, {b}.x2 - {b}.x1)) END"
    upright = f"CASE WHEN least(greatest({a}.y2 - {a}.y1, 0.0), greatest({b}.y2 - {b}.y1, 0.0)) <= 0 THEN 0.0 ELSE least(1.0, greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)) / least({a}.y2 - {a}.y1, {b}.y2 - {b}.y1)) END"
    down, aside = f"({b}.y1 - {a}.y2)", f"({b}.x1 - {a}.x2)"
    below = f"CASE WHEN {down} BETWEEN -0.35 * {h} AND 3.0 * {h} AND ({across}) > 0.15 THEN 0.55 * ({across}) + 0.30 * exp(-greatest({down}, 0.0) / (1.5 * {h})) + 0.15 * (1.0 - least(1.0, abs({b}.x1 - {a}.x1) / (4.0 * {h}))) END"
    beside = f"CASE WHEN {aside} BETWEEN -0.2 * {h} AND 10.0 * {h} AND ({upright}) > 0.35 THEN 0.92 * (0.55 * ({upright}) + 0.30 * exp(-greatest({aside}, 0.0) / (4.0 * {h})) + 0.15 * (1.0 - least(1.0, abs(({b}.y1 + {b}.y2) / 2 - ({a}.y1 + {a}.y2) / 2) / {h}))) END"
    return {"h": h, "across": across, "upright": upright, "below": below, "beside": beside, "down": down, "aside": aside}


BOX = s_box("l", "v")
PAIRS = f"""{JUDGED},
pool AS (SELECT * FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM labelled x WHERE x.doc_id = b.doc_id AND x.block_idx = b.block_idx)),
met AS (SELECT l.doc_id, l.field, l.block_idx AS label_idx, l.similarity, v.block_idx, v.text, v.confidence, {BOX['below']} AS below, {BOX['beside']} AS beside FROM labelled l JOIN pool v ON l.doc_id = v.doc_id AND l.page = v.page),
pairs AS (SELECT *, CASE WHEN below IS NOT NULL AND (beside IS NULL OR below >= beside) THEN 'below' ELSE 'right' END AS position, CASE WHEN below IS NOT NULL AND (beside IS NULL OR below >= beside) THEN below ELSE beside END AS geometry FROM met WHERE below IS NOT NULL OR beside IS NOT NULL)"""


def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(facts(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.with_labels(certificates(spark, sf_dir)).where("label is not null").select("*", "label.field", "label.alias", "label.similarity", "label.inline")


def split_blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels with l-prefixed boxes, and the other blocks, both taken from pages that are matched and shuffled once."""
    every = lab.grouped(lab.with_labels(certificates(spark, sf_dir))).select("doc_id", "page", F.explode("rows").alias("b")).select("doc_id", "page", "b.*")
    box = [F.col(c).alias(f"l{c}") for c in ("x1", "y1", "x2", "y2")]
    labels = every.where("label is not null").select("doc_id", "page", F.col("block_idx").alias("label_idx"), "label.field", "label.similarity", *box)
    return labels, every.where("label is null").select("doc_id", "page", "block_idx", "text", "confidence", "x1", "y1", "x2", "y2")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.candidates(*split_blocks(spark, sf_dir))


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


LINES = "lines AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"

# text


@query(f"SELECT doc_id, md5({s_words('text')}) AS words_md5, length({s_words('text')}) AS n FROM documents")
def fold_normalize(spark, sf_dir):
    words = t.normalize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(words).alias("words_md5"), F.length(words).cast("long").alias("n"))


@query(f"SELECT doc_id, md5(replace({s_words('text')}, ' ', '')) AS words_md5 FROM documents")
def fold_compact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.compact(F.col("text"))).alias("words_md5"))


@query(f"WITH {LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, md5({s_clean('line')}) AS cleaned FROM lines")
def clean_value(spark, sf_dir):
    return lines_of(spark, sf_dir).select("doc_id", F.col("line_no").cast("long"), F.md5(t.clean_value(F.col("line"))).alias("cleaned"))


@query("SELECT p_partkey, levenshtein(p_type, 'STANDARD BRASS') AS distance, round_even(1.0 - levenshtein(p_type, 'STANDARD BRASS')::DOUBLE / greatest(length(p_type), 14), 6) AS alike FROM part")
def label_edit_distance(spark, sf_dir):
    a, c = F.col("p_type"), F.lit("STANDARD BRASS")
    return table(spark, sf_dir, "part").select("p_partkey", t.edit_distance(a, c).cast("long").alias("distance"), F.bround(t.similarity(a, c), 6).alias("alike"))


@query("WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN p_type ELSE p_brand END AS x FROM part) SELECT p_partkey, CASE WHEN length(x) = 0 THEN 7 WHEN levenshtein(x, 'Brand#1') > 2 THEN 3 ELSE levenshtein(x, 'Brand#1') END AS distance FROM p")
def bounded_edit_distance(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 5 == 0, "").when(F.col("p_partkey") % 5 == 1, F.col("p_type")).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", t.edit_distance(text, F.lit("Brand#1"), 2).cast("long").alias("distance"))


@query("WITH c AS (SELECT c_custkey, left(c_name, CAST(c_custkey % 12 AS INTEGER)) AS x FROM customer) SELECT c_custkey, CASE WHEN length(x) <= 4 THEN repeat('*', length(x)) ELSE repeat('*', length(x) - 4) || right(x, 4) END AS masked, CASE WHEN x = '' THEN '<empty>' ELSE '<' || length(x) || ' chars>' END AS redacted FROM c")
def mask_identity(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr("left(c_name, cast(c_custkey % 12 as int))").alias("x"))
    return rows.select("c_custkey", t.mask_number(F.col("x")).alias("masked"), t.redact(F.col("x")).alias("redacted"))


@query("SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN '<empty>' ELSE '<' || length(text) || ' chars>' END AS redacted FROM documents")
def redact_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.redact(F.col("text")).alias("redacted"))


@query(r"SELECT page_id, 'upload' || lower(regexp_extract(regexp_extract(url, '([^/\\]*)$', 1), '(\.[A-Za-z0-9]{1,4})$', 1)) AS name FROM pages")
def safe_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.safe_name(F.col("url")).alias("name"))


@query(r"WITH " + LINES + r", p AS (SELECT doc_id, line_no, repeat(' ', CAST(line_no % 3 AS INTEGER)) || left(line, CAST((doc_id + line_no) % 5 AS INTEGER)) AS line FROM lines) SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, regexp_matches(line, '^\s*$') AS blank, length(trim(regexp_replace(line, '\s+', ' ', 'g'))) >= 2 AS usable FROM p")
def usable_text(spark, sf_dir):
    """The first few characters of every line, indented."""
    part = F.concat(F.repeat(F.lit(" "), F.expr("cast(line_no % 3 as int)")), F.expr("substring(line, 1, cast((doc_id + line_no) % 5 as int))"))
    return lines_of(spark, sf_dir).select("doc_id", F.col("line_no").cast("long"), t.is_blank(part).alias("blank"), t.is_usable(part).alias("usable"))


# numbers


@query(f"SELECT doc_id, {s_digits('text')} AS digits FROM documents")
def digits_only(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", n.digits_only(F.col("text")).alias("digits"))


def s_run(x: str, length: int) -> str:
    """RE2 has no look-around: runs of the length among all runs of digits."""
    runs = f"list_filter(regexp_extract_all(translate({x}, {q(SEPARATORS)}, ''), '[0-9]+'), lambda r: length(r) = {length})"
    return f"CASE WHEN len({runs}) = 1 THEN {runs}[1] END"


TENS = "CASE page_id % 4 WHEN 0 THEN 'No: ' || CAST(1000000000 + page_id AS VARCHAR(10)) WHEN 1 THEN 'a 100.200/' || CAST(1000 + page_id % 9000 AS VARCHAR(4)) WHEN 2 THEN CAST(1000000000 + page_id AS VARCHAR(10)) || 'x1000000000' ELSE html END"


@query(f"WITH p AS (SELECT page_id, CAST(page_id * 97 AS VARCHAR(20)) || 'x12' AS fours, {TENS} AS tens FROM pages) SELECT page_id, {s_run('fours', 4)} AS four, {s_run('tens', 10)} AS ten FROM p")
def fixed_length_digits(spark, sf_dir):
    """Numbers alone, with separators, twice, and none."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr("cast(page_id * 97 as string) || 'x12'").alias("fours"), F.expr(TENS).alias("tens"))
    return rows.select("page_id", n.fixed_length(F.col("fours"), 4)["digits"].alias("four"), n.fixed_length(F.col("tens"), 10)["digits"].alias("ten"))


READ = q("".join(LOOKALIKES.values())), q("".join(d * len(s) for d, s in LOOKALIKES.items()))
NOISY = "CASE WHEN o_orderkey % 3 = 0 THEN CAST(100000000000 + o_orderkey * 7919 AS VARCHAR) ELSE replace(replace(CAST(100000000000 + o_orderkey * 7919 AS VARCHAR), '0', 'O'), CASE WHEN o_orderkey % 2 = 0 THEN '5' ELSE 'x' END, 'S') END"


@query(f"WITH n AS (SELECT o_orderkey, {NOISY} AS noisy FROM orders), r AS (SELECT o_orderkey, noisy, {s_run('noisy', 12)} AS plain, {s_run(f'translate(noisy, {READ[0]}, {READ[1]})', 12)} AS second FROM n) SELECT o_orderkey, noisy, coalesce(plain, second) AS digits, plain IS NULL AND second IS NOT NULL AS substituted FROM r")
def digit_substitution(spark, sf_dir):
    number = (100_000_000_000 + F.col("o_orderkey") * 7919).cast("string")
    noisy = F.when(F.col("o_orderkey") % 3 == 0, number).otherwise(F.replace(F.replace(number, F.lit("0"), F.lit("O")), F.when(F.col("o_orderkey") % 2 == 0, "5").otherwise("x"), F.lit("S")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", noisy.alias("noisy"))
    return rows.withColumn("found", n.fixed_length(F.col("noisy"), 12, allow_substitution=True)).select("o_orderkey", "noisy", "found.digits", "found.substituted")


DATED = "CASE o_orderkey % 8 WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 3 THEN strftime(o_orderdate, '%d.%m.%y') WHEN 4 THEN 'No ' || strftime(o_orderdate, '%d %m %Y') WHEN 5 THEN '31.02.' || strftime(o_orderdate, '%Y') WHEN 6 THEN '--.--.----' ELSE '01.01.2999' END"


@query(f"SELECT o_orderkey, {DATED} AS written, CASE WHEN o_orderkey % 8 <= 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders")
def date_normalize(spark, sf_dir):
    styles = ("dd.MM.yyyy", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yy")
    written, day = F, F.col("o_orderkey") % 8
    for i, style in enumerate(styles):
        written = written.when(day == i, F.date_format("o_orderdate", style))
    written = written.when(day == 4, F.concat(F.lit("No "), F.date_format("o_orderdate", "dd MM yyyy"))).when(day == 5, F.concat(F.lit("31.02."), F.date_format("o_orderdate", "yyyy"))).when(day == 6, "--.--.----").otherwise("01.01.2999")
    return table(spark, sf_dir, "orders").select("o_orderkey", written.alias("written")).withColumn("iso", n.iso_date(F.col("written"), TODAY))


PART_NAME = "p_name || ' ' || p_size || '-' || p_partkey"


@query(f"SELECT p_partkey, CASE WHEN length({s_digits(PART_NAME)}) BETWEEN 4 AND 6 THEN {s_digits(PART_NAME)} END AS name_code, CASE WHEN length(CAST(p_partkey * 97 AS VARCHAR)) BETWEEN 4 AND 6 THEN CAST(p_partkey * 97 AS VARCHAR) END AS key_code FROM part")
def activity_code(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", n.activity_code(F.expr(PART_NAME)).alias("name_code"), n.activity_code((F.col("p_partkey") * 97).cast("string")).alias("key_code"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 2 AND p_partkey < 990000 THEN CAST(10000 + p_partkey AS VARCHAR) END AS code, CASE WHEN p_partkey % 3 <> 2 AND p_partkey < 990000 AND length(p_type) >= 3 THEN p_type END AS description FROM part")
def activity_split(spark, sf_dir):
    key = (10_000 + F.col("p_partkey")).cast("string")
    dash = F.when(F.col("p_partkey") % 3 == 0, "-").otherwise(" – ")
    cell = F.when(F.col("p_partkey") % 3 == 2, F.concat(F.lit("A"), key, F.lit("-"), "p_type")).otherwise(F.concat(key, dash, "p_type"))
    rows = table(spark, sf_dir, "part").select("p_partkey", n.split_activity(cell).alias("s"))
    return rows.select("p_partkey", "s.code", "s.description")


TEN = "CAST(1000000000 + o_orderkey * 7 AS VARCHAR)"


@query(f"SELECT o_orderkey, {s_tax_check(TEN)} AS check_digit, {s_tax_check(TEN)} = {s_digit(TEN, 10)} AS valid FROM orders")
def tax_number_check(spark, sf_dir):
    ten = (1_000_000_000 + F.col("o_orderkey") * 7).cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", ten.alias("ten")).select("o_orderkey", n.tax_check_digit(F.col("ten")).cast("long").alias("check_digit"), n.tax_number_valid(F.col("ten")).alias("valid"))


ELEVEN = "CAST(10000000000 + c_custkey * 3 AS VARCHAR)"


@query(f"SELECT c_custkey, {s_person(ELEVEN)[0]} AS tenth, {s_person(ELEVEN)[1]} AS eleventh, ({s_person(ELEVEN)[0]}) = {s_digit(ELEVEN, 10)} AND ({s_person(ELEVEN)[1]}) = {s_digit(ELEVEN, 11)} AS valid FROM customer")
def person_number_check(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", (10_000_000_000 + F.col("c_custkey") * 3).cast("string").alias("e"))
    check = n.person_check_digits(F.col("e"))
    return rows.select("c_custkey", check["tenth"].cast("long").alias("tenth"), check["eleventh"].cast("long").alias("eleventh"), n.person_number_valid(F.col("e")).alias("valid"))


# sources


HEADS = "CASE event_id % 6 WHEN 0 THEN '255044462D312E37' WHEN 1 THEN '89504E470D0A1A0A00' WHEN 2 THEN 'FFD8FFE0' WHEN 3 THEN '48656C6C6F' WHEN 4 THEN '89504E47' ELSE '' END"


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Pdf' WHEN 1 THEN 'Png' WHEN 2 THEN 'Jpeg' END AS kind, CASE event_id % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' END AS media_type, CASE WHEN event_id % 6 IN (3, 4) THEN 'UNSUPPORTED_FILE_TYPE' WHEN event_id % 6 = 5 THEN 'EMPTY_FILE' END AS error FROM events")
def magic_bytes(spark, sf_dir):
    content = F.unhex(F.expr(HEADS))
    rows = table(spark, sf_dir, "events").select("event_id", content.alias("content"))
    return rows.select("event_id", upload_kind(F.col("content"), F.length("content"), OPTIONS.max_upload_bytes).alias("u")).select("event_id", "u.kind", "u.media_type", "u.error")


@query(rf"WITH {LINES}, kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS block_idx FROM lines WHERE NOT regexp_matches(line, '^\s*$')) SELECT doc_id, block_idx, CAST(line_no AS BIGINT) AS line_no, md5(line) AS line_md5, 100.0::DOUBLE + 16.0 * length(line) AS x2, 40.0 * line_no AS y1 FROM kept")
def blocks_from_lines(spark, sf_dir):
    rows = lines_of(spark, sf_dir).where(~t.is_blank(F.col("line")))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1
    return rows.select("doc_id", index.cast("long").alias("block_idx"), F.col("line_no").cast("long"), F.md5("line").alias("line_md5"), (100.0 + 16.0 * F.length("line")).alias("x2"), (40.0 * F.col("line_no")).alias("y1"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_scan(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# A reply a certificate: every third block has its place as a polygon, texts are blank, without place or too sure here and there.
BODY = """CASE pmod(cast(doc_id as bigint), 9) WHEN 7 THEN '<html>busy</html>' WHEN 8 THEN '{"success":false,"error":{"code":"ENGINE_CRASHED","message":"m"}}' ELSE json END"""
STATUS = "CASE key % 9 WHEN 1 THEN 408 WHEN 2 THEN 503 WHEN 3 THEN NULL WHEN 4 THEN 504 WHEN 7 THEN CASE WHEN key % 2 = 0 THEN 200 ELSE 500 END WHEN 8 THEN CASE WHEN key % 2 = 0 THEN 200 ELSE 422 END ELSE 200 END"
ANSWERED = f"answered AS (SELECT CAST(key AS VARCHAR) AS doc_id, key % 9 IN (0, 5, 6) AS fine, {STATUS} AS status, key FROM facts)"
FAILED = "CASE WHEN status IS NULL OR status = 503 THEN 'OCR_SERVICE_UNAVAILABLE' WHEN status IN (408, 504) THEN 'OCR_SERVICE_TIMEOUT' WHEN key % 9 = 7 THEN 'OCR_FAILED' WHEN key % 9 = 8 THEN CASE WHEN status = 200 THEN 'OCR_FAILED' ELSE 'ENGINE_CRASHED' END END"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The certificates as a recognition service would answer: doc_id, status, body (JSON)."""
    rows = certificates(spark, sf_dir)
    kind = F.pmod(F.col("block_idx"), F.lit(3))
    box = F.when(kind != 0, F.struct("x1", "y1", "x2", "y2"))
    corners = F.array(F.array("x1", "y1"), F.array("x2", "y1"), F.array("x2", "y2"))
    polygon = F.when((kind == 0) & (F.col("block_idx") != 9), corners)
    text = F.when(F.col("block_idx") == 11, "  ").otherwise(F.col("text"))
    sure = F.when(F.col("block_idx") == 13, 1.4).when(F.col("block_idx") == 14, -0.2).otherwise(F.col("confidence"))
    block = F.struct(F.col("block_idx").alias("i"), F.struct(text.alias("text"), sure.alias("confidence"), box.alias("box"), polygon.alias("polygon")).alias("b"))
    pages = rows.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(block)).alias("rows"))
    page = F.struct("page", F.lit(1240).alias("width"), F.lit(1754).alias("height"), F.lit(0.0).alias("applied_rotation"), F.transform("rows", lambda r: r["b"]).alias("blocks"))
    body = pages.select("doc_id", F.to_json(F.struct(F.lit(True).alias("success"), F.lit(5).alias("duration_ms"), F.lit("engine").alias("engine"), F.array(page).alias("pages"))).alias("json"))
    return body.withColumn("key", F.col("doc_id").cast("long")).select("doc_id", F.expr(STATUS).alias("status"), F.expr(BODY).alias("body"))


@query(f"WITH {FACTS}, {ANSWERED} SELECT doc_id, {FAILED} AS error FROM answered")
def reply_failures(spark, sf_dir):
    return read_bodies(answers(spark, sf_dir)).select("doc_id", "error")


@query(f"WITH {BLOCKS}, {ANSWERED}, kept AS (SELECT b.*, row_number() OVER (PARTITION BY b.doc_id ORDER BY b.block_idx) - 1 AS place FROM blocks b JOIN answered a ON a.doc_id = b.doc_id AND a.fine WHERE b.block_idx NOT IN (9, 11)) SELECT doc_id, place AS block_idx, text, CASE block_idx WHEN 13 THEN 1.0 WHEN 14 THEN 0.0 ELSE confidence END AS confidence, x1, y1, x2, y2 FROM kept")
def reply_blocks(spark, sf_dir):
    told = read_bodies(answers(spark, sf_dir)).where("error is null")
    return wire_blocks(told).select("doc_id", F.col("block_idx").cast("long"), "text", "confidence", "x1", "y1", "x2", "y2")


MODEL = "CASE WHEN vec_id % 4 = 3 THEN 0 ELSE 3 END"


@query("""WITH e AS (SELECT vec_id, [round_even(CAST(v AS DOUBLE) * 100, 0) FOR v IN embedding] AS r, [CAST(v AS DOUBLE) FOR v IN embedding] AS e FROM embeddings),
b AS (SELECT vec_id, i, r[4*i+1] AS a, r[4*i+2] AS b, r[4*i+3] AS c, r[4*i+4] AS d, CASE WHEN i < 2 THEN greatest(0.0, least(1.0, abs(e[i + 20]) * 10)) ELSE 0.0 END AS confidence, CASE i WHEN 1 THEN '   ' ELSE 't' || i END AS text FROM e, (SELECT unnest(range(4)) AS i)),
k AS (SELECT vec_id, i, text, confidence, least(a, c) AS x1, least(b, d) AS y1, greatest(a, c) AS x2, greatest(b, d) AS y2 FROM b WHERE i <> 1 AND (i < 3 OR vec_id % 4 = 3))
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY y1, x1, i) - 1 AS place, text, round_even(confidence, 9) AS confidence, x1, y1, x2, y2 FROM k""")
def model_results(spark, sf_dir):
    """Texts with polygons and scores as a model gives them; every fourth has detected polygons only, the others one polygon too few."""
    value = lambda i: F.get("embedding", F.lit(i)).cast("double")
    corners = lambda i: F.array(F.array(100 * value(4 * i), 100 * value(4 * i + 1)), F.array(100 * value(4 * i + 2), 100 * value(4 * i + 3)))
    detected, scores = F.array(*[corners(i) for i in range(4)]), F.array(*[F.abs(value(i + 19)) * 10 for i in range(2)])
    texts = F.array(F.lit("t0"), F.lit("   "), F.lit("t2"), F.lit("t3"))
    made = model_blocks(texts, scores, F.slice(detected, F.lit(1), F.expr(MODEL)), detected)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(made).alias("place", "b"))
    return rows.select("vec_id", F.col("place").cast("long"), "b.text", F.bround("b.confidence", 9).alias("confidence"), "b.box.*")


PIXELS, SIDE, DPI = 40_000_000, 1600, 220


@query(f"WITH p AS (SELECT p_partkey, 100.0 + p_partkey * 37 % 3000 AS w, 100.0 + p_size * 60 AS h FROM part) SELECT p_partkey, round_even(CASE WHEN w * ({DPI} / 72.0::DOUBLE) * (h * ({DPI} / 72.0::DOUBLE)) <= {PIXELS} THEN {DPI} / 72.0::DOUBLE ELSE sqrt({PIXELS}.0::DOUBLE / (w * h)) END, 9) AS scale FROM p")
def page_scale(spark, sf_dir):
    """Pixels to the point for pages of many sizes, under the limit of pixels."""
    width, height = 100.0 + F.col("p_partkey") * 37 % 3000, 100.0 + F.col("p_size") * 60
    return table(spark, sf_dir, "part").select("p_partkey", F.bround(render_scale(width, height, DPI, PIXELS), 9).alias("scale"))


# geometry and joins


EMB = "CAST(embedding[1] AS DOUBLE) AS x1, CAST(embedding[2] AS DOUBLE) AS y1, CAST(embedding[1] AS DOUBLE) + abs(CAST(embedding[3] AS DOUBLE)) AS x2, CAST(embedding[2] AS DOUBLE) + abs(CAST(embedding[4] AS DOUBLE)) AS y2"


@query(f"WITH e AS (SELECT vec_id, {EMB} FROM embeddings) SELECT l.vec_id, round_even({BOX['across']}, 6) AS across, round_even({BOX['upright']}, 6) AS upright FROM e l JOIN e v ON v.vec_id = l.vec_id + 1")
def box_overlap(spark, sf_dir):
    at = [F.get("embedding", F.lit(i)).cast("double") for i in range(4)]
    boxes = table(spark, sf_dir, "embeddings").select("vec_id", at[0].alias("x1"), at[1].alias("y1"), (at[0] + F.abs(at[2])).alias("x2"), (at[1] + F.abs(at[3])).alias("y2"))
    other = boxes.select((F.col("vec_id") - 1).alias("vec_id"), *[F.col(c).alias(f"o{c}") for c in ("x1", "y1", "x2", "y2")])
    met = boxes.join(other, "vec_id")
    return met.select("vec_id", F.bround(g.across(g.Box.of(), g.Box.of("o")), 6).alias("across"), F.bround(g.upright(g.Box.of(), g.Box.of("o")), 6).alias("upright"))


@query("SELECT vec_id, CAST(list_min([embedding[1], embedding[3], embedding[5]]) AS DOUBLE) AS x1, CAST(list_min([embedding[2], embedding[4], embedding[6]]) AS DOUBLE) AS y1, CAST(list_max([embedding[1], embedding[3], embedding[5]]) AS DOUBLE) AS x2, CAST(list_max([embedding[2], embedding[4], embedding[6]]) AS DOUBLE) AS y2 FROM embeddings")
def polygon_extent(spark, sf_dir):
    point = lambda i: F.array(*[F.get("embedding", F.lit(j)).cast("double") for j in (i, i + 1)])
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array(point(0), point(2), point(4)).alias("polygon"))
    return rows.select("vec_id", g.extent(F.col("polygon")).alias("e")).select("vec_id", "e.*")


@query(f"WITH {JUDGED} SELECT doc_id, block_idx, field, alias, round_even(similarity, 6) AS similarity FROM labelled")
def label_best_alias(spark, sf_dir):
    return labelled(spark, sf_dir).select("doc_id", "block_idx", "field", "alias", F.bround("similarity", 6).alias("similarity"))


@query(f"WITH {JUDGED} SELECT doc_id, block_idx, alias, round_even(similarity, 6) AS similarity FROM judged WHERE similarity IS NOT NULL AND words <> ''")
def label_match_cascade(spark, sf_dir):
    """Every block with all aliases that it is like: different texts are judged, their blocks joined back."""
    blocks = certificates(spark, sf_dir).select("doc_id", "block_idx", "text")
    folded = blocks.select("text").distinct().withColumn("words", t.normalize(F.col("text"))).where("words <> ''")
    each = folded.select("text", "words", F.explode(lab.catalogue_array()).alias("a"))
    alike = lab.evaluate(F.col("words"), F.replace("words", F.lit(" "), F.lit("")), F.col("a"))
    judged = each.select("text", "a.alias", F.bround(alike, 6).alias("similarity")).where("similarity is not null")
    return blocks.join(judged, "text").select("doc_id", "block_idx", "alias", "similarity")


@query(f"WITH {FACTS} SELECT key, CASE WHEN variant % 4 < 3 THEN name END AS inline FROM facts")
def inline_remainder(spark, sf_dir):
    rest = F.when(F.col("variant") % 4 < 3, F.col("name")).otherwise(" :")
    rows = facts(spark, sf_dir).select("key", F.concat(F.when(F.col("variant") % 2 == 0, "ADRES: ").otherwise("  Adres - "), rest).alias("text"))
    return rows.select("key", lab.label_of(F.col("text"))["inline"].alias("inline"))


@query(f"WITH {PAIRS} SELECT doc_id, label_idx, block_idx, round_even(below, 6) AS score FROM met WHERE below IS NOT NULL")
def label_value_below(spark, sf_dir):
    return pairs(spark, sf_dir).where("below is not null").select("doc_id", "label_idx", "block_idx", F.bround("below", 6).alias("score"))


@query(f"WITH {PAIRS} SELECT doc_id, label_idx, block_idx, round_even(beside, 6) AS score FROM met WHERE beside IS NOT NULL")
def label_value_right(spark, sf_dir):
    return pairs(spark, sf_dir).where("beside is not null").select("doc_id", "label_idx", "block_idx", F.bround("beside", 6).alias("score"))


@query(f"WITH {PAIRS}, nth AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label_idx ORDER BY geometry DESC, block_idx) AS n FROM pairs) SELECT doc_id, label_idx, field, block_idx, position, round_even(geometry, 6) AS geometry FROM nth WHERE n = 1")
def label_value_best(spark, sf_dir):
    best = b.top(pairs(spark, sf_dir), 1, ["doc_id", "label_idx"], F.desc("geometry"), "block_idx")
    return best.select("doc_id", "label_idx", "field", "block_idx", "position", F.bround("geometry", 6).alias("geometry"))


@query(f"WITH {PAIRS}, nth AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY geometry DESC, label_idx, block_idx) AS n FROM pairs) SELECT doc_id, label_idx, block_idx, n AS nth FROM nth WHERE n <= 3")
def top_k_candidates(spark, sf_dir):
    best = b.top(pairs(spark, sf_dir), 3, ["doc_id"], F.desc("geometry"), "label_idx", "block_idx")
    return best.select("doc_id", "label_idx", "block_idx", F.col("nth").cast("long"))


CLOSE = f"{BLOCKS}, near AS (SELECT doc_id, page, block_idx, x1, x2, text, confidence, 100 + block_idx * 60.0 AS y1, 100 + block_idx * 60.0 + 40.0 AS y2 FROM blocks)"


def stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The certificates set tight, a line under the other."""
    top = 100 + F.col("block_idx") * 60.0
    return certificates(spark, sf_dir).withColumn("y1", top).withColumn("y2", top + 40.0)


@query(f"WITH {CLOSE}, met AS (SELECT a.doc_id, a.block_idx, b.block_idx AS next_idx, row_number() OVER (PARTITION BY a.doc_id, a.block_idx ORDER BY b.y1, b.x1, b.block_idx) AS n FROM near a JOIN near b ON a.doc_id = b.doc_id AND a.page = b.page AND a.block_idx <> b.block_idx WHERE b.y1 - a.y2 BETWEEN -20.0 AND 28.0 AND abs(a.x1 - b.x1) <= 32.0) SELECT doc_id, block_idx, next_idx FROM met WHERE n = 1")
def stacked_continuation(spark, sf_dir):
    return b.continuation(stacked(spark, sf_dir))


@query(f"WITH {JUDGED} SELECT v.doc_id, v.block_idx FROM blocks v WHERE v.x1 > 100 AND EXISTS (SELECT 1 FROM labelled l WHERE l.doc_id = v.doc_id AND l.page = v.page AND l.block_idx <> 16 AND l.x2 <= v.x1 AND ({s_box('l', 'v')['upright']}) > 0.5)")
def belongs_to_other_label(spark, sf_dir):
    """Blocks that the address cannot have, as they stand beside another label."""
    labels, _ = split_blocks(spark, sf_dir)
    values = certificates(spark, sf_dir).where("x1 > 100").withColumn("owner_idx", F.lit(16))
    return b.owned_by_others(values, labels).select("doc_id", "block_idx")


@query(f"WITH {JUDGED} SELECT b.doc_id, b.block_idx FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM labelled l WHERE l.doc_id = b.doc_id AND l.block_idx = b.block_idx) AND b.block_idx <> 5")
def available_values(spark, sf_dir):
    labels, values = split_blocks(spark, sf_dir)
    every = certificates(spark, sf_dir)
    claimed = every.where("block_idx = 5").select("doc_id", "block_idx")
    return b.free_values(every, labels, claimed).select("doc_id", "block_idx")


# windows, folds and aggregates


@query(f"WITH {FACTS} SELECT CAST(key AS VARCHAR) AS doc_id, vkn AS text, 2 AS n_parts, 150.0::DOUBLE AS x1, 340.0::DOUBLE AS x2 FROM facts WHERE {s_on('number over two blocks')}")
def digit_islands(spark, sf_dir):
    labels, values = split_blocks(spark, sf_dir)
    return b.digit_islands(values).select("doc_id", "text", F.col("n_parts").cast("long"), "x1", "x2")


@query("WITH e AS (SELECT user_id, ts, event_id, value, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) <= 3600 THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e) SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(event_id) AS first_id FROM i GROUP BY user_id, island")
def event_islands(spark, sf_dir):
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events")
    apart = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(line).cast("timestamp"))
    marked = rows.withColumn("s", F.when(apart <= 3_600_000_000, 0).otherwise(1))
    island = marked.withColumn("island", F.sum("s").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(f"WITH {BLOCKS} SELECT doc_id, string_agg(text, ' ' ORDER BY y1, x1, block_idx) AS text, min(confidence) AS confidence, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n_parts FROM blocks GROUP BY doc_id")
def merge_boxes(spark, sf_dir):
    return b.merged(certificates(spark, sf_dir), ["doc_id"], "text", " ").select("doc_id", "text", "confidence", "x1", "y1", "x2", "y2", F.col("n_parts").cast("long"))


WALK = f"""RECURSIVE {CLOSE},
anchors AS (SELECT doc_id, x1 AS ax1, x2 AS ax2, y2 AS low FROM near WHERE block_idx = 7),
seq AS (SELECT n.doc_id, n.block_idx, n.y1, n.y2, row_number() OVER (PARTITION BY n.doc_id ORDER BY n.block_idx) AS n, n.block_idx = 10 + 2 * (CAST(n.doc_id AS BIGINT) % 4) AS stop,
  greatest(0.0, least(ax2, x2) - greatest(ax1, x1)) / least(ax2 - ax1, x2 - x1) > 0.15 OR abs(x1 - ax1) <= 160 AS inside FROM near n JOIN anchors a ON a.doc_id = n.doc_id WHERE n.block_idx > 7),
walk AS (SELECT doc_id, CAST(0 AS BIGINT) AS n, 7 AS block_idx, low, false AS ended, false AS taken FROM anchors
  UNION ALL SELECT s.doc_id, s.n, s.block_idx, CASE WHEN s.inside AND NOT (w.ended OR s.stop OR s.y1 - w.low > 64.0) THEN s.y2 ELSE w.low END, w.ended OR s.stop OR s.y1 - w.low > 64.0, s.inside AND NOT (w.ended OR s.stop OR s.y1 - w.low > 64.0)
  FROM walk w JOIN seq s ON s.doc_id = w.doc_id AND s.n = w.n + 1)"""


@query(f"WITH {WALK} SELECT doc_id, coalesce(string_agg(CAST(block_idx AS VARCHAR), ',' ORDER BY n) FILTER (taken), '') AS lines FROM walk GROUP BY doc_id")
def column_walk(spark, sf_dir):
    """What goes on under the name: up to a stop that depends on the document, a gap, and past other columns."""
    near = stacked(spark, sf_dir).withColumn("stop", F.col("block_idx") == 10 + 2 * (F.col("doc_id").cast("long") % 4))
    anchors = near.where("block_idx = 7").select("doc_id", "page", F.col("block_idx").alias("anchor_idx"), *[F.col(c).alias(f"a{c}") for c in ("x1", "y1", "x2", "y2")])
    told = b.column_walk(anchors, near, 99)
    return told.select("doc_id", F.array_join(F.transform("lines", lambda x: x["block_idx"].cast("string")), ",").alias("lines"))


@query(f"WITH {BLOCKS} SELECT doc_id, round_even(sum(confidence * greatest(length(text), 1)) / sum(greatest(length(text), 1)), 6) AS confidence FROM blocks GROUP BY doc_id")
def weighted_confidence(spark, sf_dir):
    return b.page_confidence(certificates(spark, sf_dir)).select("doc_id", F.bround("confidence", 6).alias("confidence"))


SAID = f"said AS (SELECT doc_id, string_agg({s_words('text')}, ' ' ORDER BY block_idx) AS said FROM blocks GROUP BY doc_id)"


@query(f"WITH {BLOCKS}, {SAID} SELECT doc_id, round_even(least(1.0, {' + '.join(f'CASE WHEN contains(said, {q(a)}) THEN {w}::DOUBLE ELSE 0 END' for a, w in ANCHORS)}), 6) AS score FROM said")
def document_score(spark, sf_dir):
    return b.document_score(certificates(spark, sf_dir)).select("doc_id", F.bround("score", 6).alias("score"))


def s_score(said: str) -> str:
    return "round_even(least(1.0, " + " + ".join(f"CASE WHEN contains({said}, {q(a)}) THEN {w}::DOUBLE ELSE 0 END" for a, w in ANCHORS) + "), 6)"


@query(f"WITH {BLOCKS}, {SAID} SELECT 'd' || doc_id AS doc_id, {s_score(s_words('text'))} >= 0.35 AS accepted FROM documents UNION ALL SELECT 'c' || doc_id, {s_score('said')} >= 0.35 FROM said")
def document_gate(spark, sf_dir):
    """Prose and certificates, those of other documents among them."""
    prose = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("block_idx"), F.coalesce("text", F.lit("")).alias("text"))
    read = certificates(spark, sf_dir).select(F.concat(F.lit("c"), "doc_id").alias("doc_id"), "page", "block_idx", "text")
    return b.document_score(prose.unionByName(read)).select("doc_id", (F.bround("score", 6) >= OPTIONS.min_document_score).alias("accepted"))


@query("SELECT user_id, event_id % 40 AS slot, count(DISTINCT event_type) AS types, count(DISTINCT event_type) > 1 AS ambiguous, count(*) AS n FROM events GROUP BY user_id, event_id % 40")
def distinct_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 40).alias("slot")).agg(F.count_distinct("event_type").alias("types"), F.count("*").alias("n"))
    return rows.select("user_id", "slot", "types", (F.col("types") > 1).alias("ambiguous"), "n")


@query(f"WITH {PAIRS} SELECT doc_id, label_idx, block_idx, round_even(confidence * least(1.0, {SPATIAL} * similarity * (0.75 + 0.25 * geometry) * 0.92), 4) AS confidence, round_even(confidence * {INLINE} * similarity * 0.5 * 0.75, 4) AS doubted FROM pairs")
def field_confidence(spark, sf_dir):
    one = F.lit(1.0)
    sure = g.parser_confidence(F.lit(SPATIAL), F.col("similarity"), F.col("geometry"), F.lit(0.92), one)
    doubt = g.parser_confidence(F.lit(INLINE), F.col("similarity"), one, F.lit(0.5), F.lit(0.75))
    return pairs(spark, sf_dir).select("doc_id", "label_idx", "block_idx", g.combined(F.col("confidence"), sure).alias("confidence"), g.combined(F.col("confidence"), doubt).alias("doubted"))


@query(f"WITH {BLOCKS} SELECT DISTINCT text FROM blocks")
def distinct_values(spark, sf_dir):
    return certificates(spark, sf_dir).select("text").distinct()


@query(f"WITH {JUDGED} SELECT doc_id, block_idx, 'block' AS kind FROM blocks UNION ALL SELECT doc_id, block_idx, 'label' AS kind FROM labelled")
def concat_blocks(spark, sf_dir):
    every = certificates(spark, sf_dir).select("doc_id", "block_idx", F.lit("block").alias("kind"))
    return every.unionByName(labelled(spark, sf_dir).select("doc_id", "block_idx", F.lit("label").alias("kind")))


@query(f"WITH {BLOCKS}, nth AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, y1, x1, block_idx) AS n FROM blocks) SELECT doc_id, block_idx, n - 1 AS place FROM nth WHERE n <= 6")
def limit_lines(spark, sf_dir):
    return b.in_order(certificates(spark, sf_dir)).where(F.col("place") < OPTIONS.max_address_lines).select("doc_id", "block_idx", F.col("place").cast("long"))


# the whole plan


def parsed(spark: SparkSession, sf_dir: str, options: Options = OPTIONS) -> DataFrame:
    return parse_blocks(certificates(spark, sf_dir), options)


FREE = f"NOT ({s_on('another document')})"
LETTERS = f"{s_on('letters for digits')} AND (contains(vkn, '0') OR contains(vkn, '5'))"
NUMBER = s_case((f"{s_on('person', 'another document')} OR {LETTERS}", "NULL"), rest="vkn")
WARNED = s_case(
    (s_on("wrong check digit"), "'INVALID_VKN_CHECKSUM:vkn,LOW_CONFIDENCE_FIELD:vkn'"), (s_on("number badly read"), "'LOW_CONFIDENCE_FIELD:vkn'"), (s_on("number without label"), "'VKN_LABEL_NOT_FOUND:vkn,LOW_CONFIDENCE_FIELD:vkn'"),
    (s_on("person"), "'VKN_NOT_FOUND:vkn'"), (s_on("date unreadable"), "'DATE_PARSE_FAILED:iseBaslamaTarihi'"), (s_on("two numbers"), "'MULTIPLE_VKN_CANDIDATES:vkn'"), (s_on("another document"), "'UNSUPPORTED_DOCUMENT'"),
    (s_on("page badly read"), "'LOW_OCR_CONFIDENCE,LOW_CONFIDENCE_FIELD:vkn,LOW_CONFIDENCE_FIELD:ticaretUnvani,LOW_CONFIDENCE_FIELD:vergiDairesi,LOW_CONFIDENCE_ADDRESS:adres,LOW_CONFIDENCE_FIELD:iseBaslamaTarihi,LOW_CONFIDENCE_FIELD:anaFaaliyetKodu,LOW_CONFIDENCE_FIELD:anaFaaliyetAciklamasi'"),
    (LETTERS, "'VKN_NOT_FOUND:vkn,NO_IDENTITY_NUMBER_FOUND'"), rest="''",
)
TRUE = f"""{FACTS} SELECT CAST(key AS VARCHAR) AS doc_id, {FREE} AS success, {NUMBER} AS vkn, CASE WHEN {NUMBER} IS NOT NULL THEN NOT ({s_on('wrong check digit')}) END AS vkn_valid,
  {s_case((s_on('person'), 'tckn'))} AS tckn, {s_case((s_on('person', 'another document'), 'NULL'), (s_on('name over two lines'), f"replace(name, ' A.Ş.', ' {LOOSE[2]}')"), rest='name')} AS name, {s_case((s_on('person'), 'person'))} AS person,
  CASE WHEN {FREE} THEN office END AS office, {s_case((s_on('date unreadable', 'another document'), 'NULL'), rest="strftime(strptime(since, '%d.%m.%Y'), '%Y-%m-%d')")} AS since, CASE WHEN {FREE} THEN code END AS code,
  {s_case((s_on('another document'), 'NULL'), (s_on('code and description in a cell'), "code || '-' || said"), rest='code')} AS raw, {s_case((s_on('description of digits', 'another document'), 'NULL'), rest='said')} AS said,
  {s_case((s_on('another document'), 'NULL'), (s_on('address of three lines'), f"address || ' {LOOSE[0]} {LOOSE[1]}'"), rest='address')} AS address FROM facts"""
DATA = {"vkn": "vkn", "tckn": "tckn", "ticaretUnvani": "name", "adiSoyadi": "person", "vergiDairesi": "office", "iseBaslamaTarihi": "since", "anaFaaliyetKodu": "code", "anaFaaliyetKoduRaw": "raw", "anaFaaliyetAciklamasi": "said", "adres": "address"}


@query(f"WITH {TRUE}")
def flagship_roundtrip(spark, sf_dir):
    return parsed(spark, sf_dir).select("doc_id", "success", F.col("validation.vkn.valid").alias("vkn_valid"), *[F.col(f"data.{k}").alias(v) for k, v in DATA.items()])


@query(f"WITH {FACTS} SELECT CAST(key AS VARCHAR) AS doc_id, {WARNED} AS warnings FROM facts")
def warning_codes(spark, sf_dir):
    return parsed(spark, sf_dir).select("doc_id", F.array_join(F.transform("warnings", lambda w: F.concat_ws(":", w["code"], w["field"])), ",").alias("warnings"))


@query(f"WITH {FACTS} SELECT CAST(key AS VARCHAR) AS doc_id, {s_case((s_on('person', 'another document'), 'NULL'), rest='vkn')} AS vkn, {LETTERS} AS substituted FROM facts")
def substituted_numbers(spark, sf_dir):
    """The plan where letters may be read as digits."""
    rows = parsed(spark, sf_dir, Options(today=TODAY, substitute_digits=True))
    return rows.select("doc_id", "data.vkn", F.exists("warnings", lambda w: w["code"] == "DIGIT_SUBSTITUTION_APPLIED").alias("substituted"))


@query(f"WITH {TRUE.replace('SELECT CAST(key', ', told AS (SELECT CAST(key', 1)}) SELECT doc_id, {' + '.join(f'CASE WHEN {c} IS NULL THEN 0 ELSE 1 END' for k, c in DATA.items() if c != 'raw')} AS n_found, coalesce(raw <> code, false) AS other_code FROM told")
def found_fields(spark, sf_dir):
    return summary(parsed(spark, sf_dir)).drop("n_fields")


def s_mask(x: str) -> str:
    return f"coalesce(repeat('*', length({x}) - 4) || right({x}, 4), '<none>')"


@query(f"WITH {FACTS}, w AS (SELECT key, {WARNED} AS w, {NUMBER} AS v, {s_case((s_on('person'), 'tckn'))} AS t, {FREE} AS success FROM facts) SELECT CAST(key AS VARCHAR) AS doc_id, success, CASE WHEN success THEN 'VERGI_LEVHASI' ELSE 'UNKNOWN' END AS document_type, CASE WHEN NOT success THEN 'NOT_TAX_CERTIFICATE' END AS error, regexp_replace(w, ':[a-zA-Z]+', '', 'g') AS warnings, {s_mask('v')} AS masked_vkn, {s_mask('t')} AS masked_tckn FROM w")
def masked_log(spark, sf_dir):
    return log_lines(parsed(spark, sf_dir)).drop("overall")


@query(f"""WITH {TRUE.replace('SELECT CAST(key', ', told AS (SELECT CAST(key', 1)}) SELECT doc_id, success, {', '.join(c for k, c in DATA.items())}, CASE WHEN success THEN 'VERGI_LEVHASI' ELSE 'UNKNOWN' END AS kind, NOT success AS has_error FROM told""")
def json_envelope(spark, sf_dir):
    """Results written as JSON and read again; members of data are there even if they are null."""
    rows = envelope(parsed(spark, sf_dir))
    at = lambda path: F.get_json_object("json", f"$.{path}")
    return rows.select("doc_id", (at("success") == "true").alias("success"), *[at(f"data.{k}").alias(c) for k, c in DATA.items()], at("documentType").alias("kind"), at("error").isNotNull().alias("has_error"))


# A label over two lines is one box around both. The address's place counts as 0.9 whatever it is.
SURE = f"""{JUDGED}, heads AS (SELECT doc_id, block_idx, similarity, x1, y1, x2, y2 FROM labelled UNION ALL SELECT CAST(key AS VARCHAR), 4, 1.0, 100.0, 298.0, 292.0, 404.0 FROM facts WHERE {s_on('label over two lines')}),
wanted(field, l_idx, v_idx, form) AS (VALUES ('vkn', 4, 5, 1.0::DOUBLE), ('tckn', 4, 5, 1.0), ('ticaretUnvani', 6, 7, 1.0), ('adiSoyadi', 6, 7, 0.92), ('vergiDairesi', 8, 9, 0.92), ('iseBaslamaTarihi', 10, 11, 1.0), ('anaFaaliyetKodu', 12, 13, 1.0), ('anaFaaliyetAciklamasi', 14, 15, 0.92), ('adres', 16, 17, 0.92)),
near_by AS (SELECT l.doc_id, w.field, variant, v.confidence * 0.95::DOUBLE * similarity * (0.75 + 0.25 * CASE WHEN w.field = 'adres' THEN 0.9 ELSE greatest({BOX['below']}, {BOX['beside']}) END) * CASE WHEN w.field = 'vkn' AND {s_on('wrong check digit')} THEN 0.5 ELSE form END AS c
  FROM wanted w JOIN heads l ON l.block_idx = l_idx JOIN blocks v ON v.doc_id = l.doc_id AND v.block_idx = v_idx JOIN facts ON CAST(key AS VARCHAR) = l.doc_id
  WHERE CASE w.field WHEN 'vkn' THEN {NUMBER} IS NOT NULL WHEN 'ticaretUnvani' THEN NOT ({s_on('person')}) WHEN 'tckn' THEN {s_on('person')} WHEN 'adiSoyadi' THEN {s_on('person')} WHEN 'iseBaslamaTarihi' THEN NOT ({s_on('date unreadable')}) WHEN 'anaFaaliyetAciklamasi' THEN NOT ({s_on('description of digits')}) ELSE true END),
every_c AS (SELECT doc_id, field, c FROM near_by UNION ALL SELECT doc_id, 'anaFaaliyetAciklamasi', c FROM near_by WHERE field = 'anaFaaliyetKodu' AND {s_on('code and description in a cell')}
  UNION ALL SELECT CAST(key AS VARCHAR), 'vkn', CASE WHEN {s_on('number without label')} THEN 0.98::DOUBLE * 0.55 ELSE 0.98::DOUBLE * 0.98 END FROM facts WHERE {s_on('number without label', 'number after its label')}),
told AS (SELECT CAST(key AS VARCHAR) AS doc_id, {', '.join(f"max(CASE WHEN field = '{f}' THEN round_even(c, 4) END) AS {f}" for f in WEIGHTS)} FROM facts LEFT JOIN every_c ON every_c.doc_id = CAST(key AS VARCHAR) GROUP BY key)"""


@query(f"WITH {SURE} SELECT doc_id, vkn AS confidence FROM told")
def number_confidence(spark, sf_dir):
    return parsed(spark, sf_dir).select("doc_id", F.col("confidence.vkn").alias("confidence"))


@query(f"WITH {SURE} SELECT * FROM told")
def every_confidence(spark, sf_dir):
    return parsed(spark, sf_dir).select("doc_id", *[f"confidence.{f}" for f in WEIGHTS])


RIVALS = {"vkn": "tckn", "tckn": "vkn", "ticaretUnvani": "adiSoyadi", "adiSoyadi": "ticaretUnvani"}
HAVE = " + ".join(f"CASE WHEN {f} IS NULL THEN 0 ELSE {x}::DOUBLE END" for f, x in WEIGHTS.items())
ALL = " + ".join(f"CASE WHEN {f} IS NULL AND {RIVALS[f]} IS NOT NULL THEN 0 ELSE {x}::DOUBLE END" if f in RIVALS else f"{x}::DOUBLE" for f, x in WEIGHTS.items())
SCORED = " + ".join(f"coalesce({f} * {x}::DOUBLE, 0)" for f, x in WEIGHTS.items())


@query(f"WITH {SURE}, sums AS (SELECT doc_id, {HAVE} AS have, {ALL} AS whole, {SCORED} AS scored FROM told) SELECT doc_id, CASE WHEN have = 0 THEN 0.0 ELSE round_even(scored / have * (0.6 + 0.4 * have / whole), 4) END AS overall FROM sums")
def overall_confidence(spark, sf_dir):
    return parsed(spark, sf_dir).select("doc_id", F.col("confidence.overall").alias("overall"))


def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan over nested documents, the map that a stream runs; its rows equal the batch's."""
    from inkfield.plans.parse import nest, parse_nested

    told = parse_nested(nest(certificates(spark, sf_dir)), OPTIONS)
    return told.select("doc_id", "success", "data.vkn", F.size("warnings").cast("long").alias("n_warnings"))


QUERIES["stream_equals_batch"] = stream_equals_batch
ORACLES["stream_equals_batch"] = f"WITH {FACTS} SELECT CAST(key AS VARCHAR) AS doc_id, {FREE} AS success, {NUMBER} AS vkn, CASE WHEN {WARNED} = '' THEN 0 ELSE len(string_split({WARNED}, ',')) END AS n_warnings FROM facts"

