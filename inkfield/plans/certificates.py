"""Certificates rendered from the customer tables, as blocks: an input whose right results plain SQL tells.

A customer's key decides how their certificate is written: plainly, or with one of the troubles that the plan has to cope with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfield.functions.numbers import person_check_digits, tax_check_digit

HEADER = (("T.C.", 500), ("HAZİNE VE MALİYE BAKANLIĞI", 400), ("GELİR İDARESİ BAŞKANLIĞI", 420), ("VERGİ LEVHASI", 480))
LABEL_X, VALUE_X, TOP, PITCH, HEIGHT, LETTER, LEAST, GAP = 100.0, 150.0, 100.0, 66.0, 40.0, 16.0, 60.0, 30.0
# What is special about a certificate, by the customer's key modulo the number of these.
VARIANTS = (
    "plain", "wrong check digit", "number in groups", "number over two blocks", "number badly read", "number without label", "misspelt label",
    "person", "values beside labels", "office with ending", "code and description in a cell", "address of three lines", "date unreadable",
    "label over two lines", "two numbers", "number after its label", "another document", "name over two lines", "another label's value below",
    "page badly read", "letters for digits", "without header", "label without space", "description of digits",
)
AT = {name: n for n, name in enumerate(VARIANTS)}
LABELS = (("TİCARET UNVANI", "name"), ("VERGİ DAİRESİ", "office"), ("İŞE BAŞLAMA TARİHİ", "since"), ("ANA FAALİYET KODU", "code"), ("ANA FAALİYET", "said"), ("ADRES", "address"))
LOOSE = ("KAT: 3 DAİRE: 5", "MERKEZ / TÜRKİYE", "LOJİSTİK A.Ş.")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, variant and the true values of every customer with an order."""
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("since"))
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(first, "c_custkey").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    body, second = ((start + F.col("c_custkey") * 1777).cast("string") for start in (100_000_000, 500_000_000))
    variant = F.pmod("c_custkey", F.lit(len(VARIANTS)))
    check = F.when(variant == AT["wrong check digit"], F.pmod(tax_check_digit(body) + 1, F.lit(10))).otherwise(tax_check_digit(body))
    person = person_check_digits(body)
    return rows.select(
        F.col("c_custkey").alias("key"),
        variant.alias("variant"),
        F.concat(body, check.cast("string")).alias("vkn"),
        F.concat(second, tax_check_digit(second).cast("string")).alias("second"),
        F.concat(body, person["tenth"].cast("string"), person["eleventh"].cast("string")).alias("tckn"),
        F.concat("c_name", F.lit(" A.Ş.")).alias("name"),
        F.concat(F.lit("AYŞE "), "c_mktsegment").alias("person"),
        F.col("n_name").alias("office"),
        F.date_format("since", "dd.MM.yyyy").alias("since"),
        F.lpad(F.pmod(F.col("c_custkey") * 37, F.lit(1_000_000)).cast("string"), 6, "0").alias("code"),
        F.col("c_mktsegment").alias("said"),
        F.concat("r_name", F.lit(" MAH. NO: "), F.pmod("c_custkey", F.lit(97)).cast("string")).alias("address"),
    )


def on(*names: str) -> Column:
    return F.col("variant").isin(*[AT[n] for n in names])


def rendered(rows: DataFrame) -> DataFrame:
    """Blocks of the certificates; doc_id is the customer's key. A block has its number, its line, its left edge and its text."""
    other = on("another document")
    groups = F.concat_ws(" ", F.substring("vkn", 1, 3), F.substring("vkn", 4, 3), F.substring("vkn", 7, 4))
    number = F.when(on("number in groups"), groups).when(on("number over two blocks"), F.substring("vkn", 1, 5)).when(on("person"), F.col("tckn")).when(on("letters for digits"), F.translate("vkn", "05", "OS")).when(~on("number after its label"), F.col("vkn"))
    label = (
        F.when(on("misspelt label"), "Vergi Kimlik Numarasl")
        .when(on("person"), "TC KİMLİK NO")
        .when(on("label over two lines"), "NUMARASI")
        .when(on("number after its label"), F.concat(F.lit("VERGİ KİMLİK NO: "), "vkn"))
        .when(on("label without space"), "VERGİ KİMLİKNUMARASI")
        .when(~on("number without label", "another document"), "VERGİ KİMLİK NUMARASI")
    )
    said = {
        "name": F.when(on("person"), F.col("person")).when(on("name over two lines"), F.regexp_replace("name", " A\\.Ş\\.$", "")).otherwise(F.col("name")),
        "office": F.when(on("office with ending"), F.concat("office", F.lit(" V.D."))).otherwise(F.col("office")),
        "since": F.when(on("date unreadable"), "--.--.----").otherwise(F.col("since")),
        "code": F.when(on("code and description in a cell"), F.concat("code", F.lit("-"), "said")).otherwise(F.col("code")),
        "said": F.when(on("description of digits"), F.concat("code", F.lit(" AB"))).when(~on("code and description in a cell"), F.col("said")),
        "address": F.col("address"),
    }
    sure = F.when(on("page badly read"), 0.5).otherwise(0.98)
    plain = lambda text: F.when(~other, text)
    lines: list[tuple[int, int, Column, Column, Column]] = []
    for n, (text, x) in enumerate(HEADER):
        shown = F.when(~on("another document", "without header"), text)
        lines.append((n, n, F.lit(float(x)), F.when(other, "FATURA").otherwise(shown) if n == 0 else shown, sure))
    lines.append((4, 4, F.lit(LABEL_X), label, sure))
    lines.append((5, 5, F.lit(VALUE_X), number, F.when(on("number badly read"), 0.6).otherwise(sure)))
    for n, (text, value) in enumerate(LABELS):
        shown = F.when(on("person"), "ADI SOYADI").otherwise(text) if value == "name" else F.when(on("code and description in a cell"), "ANA FAALİYET KODU VE ADI").otherwise(text) if value == "code" else F.when(~on("code and description in a cell"), text) if value == "said" else F.lit(text)
        lines.append((6 + 2 * n, 6 + 2 * n, F.lit(LABEL_X), plain(shown), sure))
        lines.append((7 + 2 * n, 7 + 2 * n, F.lit(VALUE_X), F.when(~other | F.lit(value == "said"), said[value]), sure))
    lines += [
        (18, 5, F.lit(VALUE_X + 5 * LETTER + GAP), F.when(on("number over two blocks"), F.substring("vkn", 6, 5)), sure),
        (19, 3, F.lit(LABEL_X), F.when(on("label over two lines"), "VERGİ KİMLİK"), sure),
        (20, 18, F.lit(VALUE_X), F.when(on("address of three lines"), LOOSE[0]), sure),
        (21, 19, F.lit(VALUE_X), F.when(on("address of three lines"), LOOSE[1]), sure),
        (22, 8, F.lit(VALUE_X), F.when(on("name over two lines"), LOOSE[2]), sure),
        (23, 18, F.lit(LABEL_X), F.when(on("two numbers"), "VERGİ NUMARASI").when(on("another label's value below"), "TAKVİM"), sure),
        (24, 19, F.lit(VALUE_X), F.when(on("two numbers"), F.col("second")), sure),
        (25, 18, F.lit(LABEL_X + 6 * LETTER + GAP), F.when(on("another label's value below"), "2024 YILI"), sure),
    ]
    each = F.array(*[F.struct(F.lit(i).alias("block_idx"), t.alias("text"), c.alias("confidence"), x.alias("x1"), F.lit(at).alias("line")) for i, at, x, t, c in lines])
    blocks = rows.select(F.col("key").cast("string").alias("doc_id"), "variant", F.explode(each).alias("b"), F.transform(each, lambda e: e["text"]).alias("texts")).where("b.text is not null")
    # Beside its label a value stands on the label's line; under a name's second line all moves down by one.
    beside = on("values beside labels") & F.col("b.block_idx").between(5, 17) & (F.col("b.block_idx") % 2 == 1)
    line = F.col("b.line") - F.when(beside, 1).otherwise(0) + F.when(on("name over two lines") & F.col("b.block_idx").between(8, 17), 1).otherwise(0)
    before = F.length(F.get("texts", F.col("b.block_idx") - 1))
    x1 = F.when(beside, LABEL_X + F.greatest(F.lit(LEAST), LETTER * before) + GAP + 5 * (F.col("b.block_idx") - 5)).otherwise(F.col("b.x1"))
    placed = blocks.select("doc_id", F.lit(1).alias("page"), "b.block_idx", "b.text", "b.confidence", x1.alias("x1"), (TOP + PITCH * line).alias("y1"))
    return placed.withColumn("x2", F.col("x1") + F.greatest(F.lit(LEAST), LETTER * F.length("text"))).withColumn("y2", F.col("y1") + HEIGHT)


def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(facts(spark, sf_dir))
