import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkfield.functions import geometry as g
from inkfield.functions import numbers as n
from inkfield.functions import text as t
from inkfield.operators.labels import label_of
from inkfield.plans import words as w

TODAY = dt.date(2026, 1, 1)


def values(spark, make, inputs):
    """make(column) of each input, in order."""
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in rows.select(make(F.col("x")), "i").orderBy("i").collect()]


def test_folding(spark):
    cases = {"Vergi Kimlik Numarası": "VERGI KIMLIK NUMARASI", "İŞ YERİ ADRESİ": "IS YERI ADRESI", "  a--b__c ": "A B C", "ÄÖÜ ñ é": "AOU N E", "KİMLIK": "KI MLIK", "ß": "ß", "": "", None: "", "²": ""}
    assert values(spark, t.normalize, cases) == list(cases.values())
    assert [w.normalize(x) for x in cases if x is not None] == [v for k, v in cases.items() if k is not None]
    assert values(spark, t.compact, ["T.C. Kimlik No"]) == ["TCKIMLIKNO"]


def test_cleaning_takes_one_run_of_separators_at_each_end(spark):
    cases = {": 7319052840": "7319052840", "A.Ş.": "A.Ş.", "CAD. :": "CAD.", " a \t b c ": "a b c", ": - X": "- X", "--": "", None: "", "– x –": "x"}
    assert values(spark, t.clean_value, cases) == list(cases.values())
    assert [w.clean(x) for x in cases if x is not None] == [v for k, v in cases.items() if k is not None]


def test_bounded_distance(spark):
    pairs = [("kitten", "sitting", 9, 3), ("ABCDEFGH", "ZZZZZZZZ", 1, 2), ("", "ABC", 1, 3), ("ABC", "", 1, 3), ("same", "same", 0, 0), ("abcd", "a", 2, 3)]
    rows = spark.createDataFrame([(a, b, m, d) for a, b, m, d in pairs], "a string, b string, m int, d int")
    for a, b, m, d in pairs:
        assert rows.where((F.col("a") == a) & (F.col("b") == b)).select(t.edit_distance(F.col("a"), F.col("b"), m)).first()[0] == d


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9), st.integers(0, 4))
def test_python_distance_is_the_edit_distance(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    assert w.distance(a, b, most) == min(row[-1], most + 1)


def test_masking(spark):
    assert values(spark, t.mask_number, ["7319052840", "123", "1234", "", None]) == ["******2840", "***", "****", "", None]
    assert values(spark, t.redact, ["abc", "", None]) == ["<3 chars>", "<empty>", "<empty>"]
    assert values(spark, t.safe_name, ["a/b.PDF", "x.jpeg", "noext", "../../e.t;c", "x.toolong"]) == ["upload.pdf", "upload.jpeg", "upload", "upload", "upload"]


def test_fixed_length_digits(spark):
    cases = {"731 905 28 40": "7319052840", "VKN: 7319052840": "7319052840", "731-905.28/40": "7319052840", "7319052840 1234567890": None, "731905284": None, "73190528401": None, "731905284x0": None, "7319052840 x 1234567890": None, "731 905 2840": "7319052840", None: None}
    assert values(spark, lambda c: n.single_run(c, 10), cases) == list(cases.values())
    assert [(w.run_of(x, 10) or (None,))[0] for x in cases if x is not None] == [v for k, v in cases.items() if k is not None]
    assert values(spark, lambda c: n.fixed_length(c, 10, True), ["7319O5Z84O", "7319052840"]) == [("7319052840", True), ("7319052840", False)]
    assert w.run_of("7319O5Z84O", 10, True) == ("7319052840", True) and w.run_of("7319O5Z84O", 10) is None


def test_dates(spark):
    cases = {"01.03.2019": "2019-03-01", "1.3.2019": "2019-03-01", "01/03/2019": "2019-03-01", "01-03-2019": "2019-03-01", "1.3.19": "2019-03-01", "1.3.50": "1950-03-01", "01032019": "2019-03-01", "No: 01 03 2019": "2019-03-01", "31.02.2019": None, "--.--.----": None, "01.01.1899": None, "01.01.2999": None, "01.01.2027": "2027-01-01", "02.01.2027": None, "1/3/19": None, "01.03-2019": "2019-03-01", "": None, None: None}
    assert values(spark, lambda c: n.iso_date(c, TODAY), cases) == list(cases.values())
    assert [w.date_of(x, TODAY, 2049) for x in cases if x is not None] == [v for k, v in cases.items() if k is not None]


def test_codes(spark):
    assert values(spark, n.activity_code, ["49.41.03", "494103", "4941", "494", "4941031", None]) == ["494103", "494103", "4941", None, None, None]
    cases = {"479114-RADYO, TV": ("479114", "RADYO, TV"), "479114 – ab": ("479114", None), "49.41.03-ABC": (None, None), "-479114": (None, None), "479114-": (None, None), "479114": (None, None)}
    assert [tuple(r) for r in values(spark, n.split_activity, cases)] == list(cases.values())
    assert w.code_of("49.41.03-ABC") == ("494103", None) and w.code_of("479114-RADYO, TV") == ("479114", "RADYO, TV")


def test_check_digits(spark):
    cases = {"7319052840": True, "3905718267": True, "6082149371": True, "7319052841": False, "0000000000": False, "731905284": False, "73190528400": False, "45405369a0": False, "": False, None: False}
    assert values(spark, n.tax_number_valid, cases) == list(cases.values())
    assert [w.tax_number_valid(x) for x in cases if x and x.isdigit()] == [v for k, v in cases.items() if k and k.isdigit()]
    people = {"27183046540": True, "10000000146": True, "27183046541": False, "07183046540": False, "2718304654": False, None: False}
    assert values(spark, n.person_number_valid, people) == list(people.values())
    assert [w.person_number_valid(x) for x in people if x] == [v for k, v in people.items() if k]


def test_every_body_has_one_valid_check_digit(spark):
    rows = spark.range(100_000_000, 100_000_500).select(F.col("id").cast("string").alias("b")).select("b", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("d"))
    good = rows.where(n.tax_number_valid(F.concat("b", F.col("d").cast("string"))))
    assert good.count() == 500 and good.select("b").distinct().count() == 500


def test_boxes(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 8.0, 25.0, 18.0), (0.0, 0.0, 0.0, 5.0, 0.0, 0.0, 3.0, 3.0)], ", ".join(f"{p}{c} double" for p in ("l", "") for c in ("x1", "y1", "x2", "y2")))
    assert [tuple(r) for r in rows.select(g.across(g.Box.of("l"), g.Box.of()), g.upright(g.Box.of("l"), g.Box.of())).collect()] == [(0.5, 0.2), (0.0, 1.0)]
    poly = spark.createDataFrame([([[10.0, 20.0], [61.0, 22.0], [60.0, 48.0]],), ([[1.0]],), ([],), (None,)], "p array<array<double>>")
    assert [r[0] and tuple(r[0]) for r in poly.select(g.extent(F.col("p"))).collect()] == [(10.0, 20.0, 61.0, 48.0), None, None, None]


LABELS = {
    "VERGİ KİMLİK NUMARASI": ("Vkn", "VERGI KIMLIK NUMARASI", 1.0, None),
    "Vergi Kimlik No: 7319052840": ("Vkn", "VERGI KIMLIK NO", 1.0, "7319052840"),
    "VERGIKIMLIKNO": ("Vkn", "VERGI KIMLIK NO", 0.99, None),
    "ANA FAALİYET KODU": ("AnaFaaliyetKodu", "ANA FAALIYET KODU", 1.0, None),
    "ANA FAALİYET K0DU": ("AnaFaaliyetAciklamasi", "ANA FAALIYET", 1.0, "K0DU"),
    "TİCARET ÜNVANI": ("TicaretUnvani", "TICARET UNVANI", 1.0, None),
    "TİCARET UNVANl": ("TicaretUnvani", "TICARET UNVANI", 1 - 1 / 14, None),
    "ADRESİMİZ": ("Adres", "ADRESI", 0.98, "MİZ"),
    "VKM": None,
    "KARAYOLU": None,
    "": None,
}


def test_labels(spark):
    found = values(spark, label_of, LABELS)
    assert [f and (f.field, f.alias, pytest.approx(f.similarity), f.inline) for f in found] == list(LABELS.values())
    for text, label in LABELS.items():
        assert (w.label_of(text) and tuple(w.label_of(text))) == (label and (label[0], label[1], pytest.approx(label[2]), label[3])), text
