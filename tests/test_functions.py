"""Text, ids, amounts and dates against hand-made values."""

import pytest
from pyspark.sql import functions as F

from fiscora.functions import dates, money, taxid, text
from fiscora.functions.cascade import zero_padded


def values(spark, column, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_text(spark):
    assert values(spark, text.search_key, [" Año-nuevo, ß ", None, "--"]) == ["ANO NUEVO SS", "", ""]
    assert values(spark, text.clean_lines, ["a  b\r\n\r\n  c\t d \rx", ""]) == ["a b\nc d\nx", ""]
    assert values(spark, text.path_token, ["La Casa S.A.", " ¿? "]) == ["LA_CASA_S_A", "SIN_DATO"]
    assert values(spark, text.drop_legal_form, ["La Casa S.A.", "Uno Dos SRL", "SA"]) == ["LA CASA", "UNO DOS", "SA"]
    assert values(spark, lambda c: text.upper_collapsed(c, True), ["N° 1\n ñandú"]) == ["NO 1 NANDU"]
    assert values(spark, lambda c: text.preview(c, 5), ["abc", "abcd efgh"]) == ["abc", "abcd\n[...]"]


def test_tax_ids(spark):
    assert values(spark, taxid.valid, ["30-71111111-1", "30711111118", "1", None]) == [True, False, False, False]
    assert values(spark, taxid.formatted, ["30 71111111 8", "12"]) == ["30-71111111-8", None]
    found = values(spark, lambda c: F.array_join(taxid.valid_in(c), ","), ["CUIT 30-71111111-1 y 30711111111, 30-71111111-2, 123456789012345"])
    assert found == ["30-71111111-1"]


@pytest.mark.parametrize(
    "told, wanted",
    [("1.234,56", "1234.56"), ("1,234.56", "1234.56"), ("1.234", "1234.00"), ("1,5", "1.50"), ("$ -0012,3", "-12.30"), ("12-3", "123.00"), ("--1", None), ("abc", None), ("1.234.567", "1234567.00"), ("0,05", "0.05")],
)
def test_amounts(spark, told, wanted):
    assert values(spark, money.amount_text, [told]) == [wanted]


def test_dates(spark):
    shown = lambda rule: lambda c: dates.told(rule(c))
    assert values(spark, shown(dates.header_date), ["01/02/2024", "1-2-24", "1.2.24", "31/02/2024", "1/8-2026", "01/02/70"]) == ["01/02/2024", "01/02/2024", None, None, None, "01/02/1970"]
    assert values(spark, shown(dates.field_date), ["01.02.79", "01/02/80"]) == ["01/02/2079", "01/02/1980"]


def test_padding(spark):
    assert values(spark, lambda c: zero_padded(c, 5), ["12", "1234567"]) == ["00012", "1234567"]
