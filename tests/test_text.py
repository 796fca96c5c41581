"""Micro-fixtures of the text functions."""

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as T


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(c) for c in df.columns])).first()[0]


@pytest.mark.parametrize(
    "f, given, expected",
    [
        (T.drop_header, "| nav |\n# T\nshort\nThis line is long enough.\nrest", "This line is long enough.\nrest"),
        (T.drop_header, "# a\nshort", "# a\nshort"),
        (T.drop_header, "x\n   exactly15chars.  \n   exactly 16 char.  \ny", "   exactly 16 char.  \ny"),
        (T.drop_footnotes, "x[(1)](#ntr1-L)y", "xy"),
        (T.drop_footnotes, "x[(*1)](#ntc*1-L)y", "xy"),
        (T.drop_top_link, "body\n---\n[Top](#document1)", "body"),
        (T.drop_top_link, "a --- b\n--- ---\n", "a --- b"),
        (T.drop_links, "![a](u)[t](v)", "t"),
        (T.drop_markup, "**b** *i* `c` \n## H", "b i c \nH"),
        (T.flatten_tables, "| (1) | text |", "(1) text"),
        (T.flatten_tables, "| a | b | c |", "| a | b | c |"),
        (T.tidy_space, "a b\n\n\n\nc", "a b\n\nc"),
        (T.tidy_space, "---\n---\nx", "---\nx"),
        (T.date_part, "17/04/2019; Date of document", "17/04/2019"),
        (T.date_kind, "17/04/2019; Date of document", "Date of document"),
        (T.date_kind, "17/04/2019", ""),
        (T.year, "17/04/2019", 2019),
        (T.year, "", None),
        (T.year, "2019", None),
        (T.year, "17/04/abcd", None),
        (T.model_slug, "avr/sfr-embedding-mistral", "sfrembeddingmistral"),
        (T.metric_name, "noise_sensitivity(mode=relevant)", "noise_sensitivity_mode_relevant"),
        (lambda c: T.list_lines(c, 2), "1. a\n\n- b\n2) c", ["a", "b"]),
        (T.numbers, "[3, 9, 3, 0]", [3, 9, 3, 0]),
        (T.word_count, "a b\x1cc  d\n", 4),
        (T.word_count, "", 0),
        (T.word_count, None, None),
        (T.strip, "  a \n", "a"),
        (T.drop_control, "a\x07b\x0bc\n", "abc\n"),
    ],
)
def test_function(spark, f, given, expected):
    assert one(spark, f, given) == expected


@pytest.mark.parametrize(
    "celex, form, expected",
    [
        ("32019L0790", "", "LEGISLATIVE"), ("32001H0100", "", "POLICY"), ("62008CJ0005", "", "JUDICIAL"), ("52011DC0001", "Communication", "POLICY"), ("52011PC0001", "Proposal", "OTHER"),
        ("92000E0001", "", "POLICY"), ("", "", "OTHER"), ("7x", "", "OTHER"), ("320190790", "", "LEGISLATIVE"), (None, None, "OTHER"),
    ],
)
def test_family(spark, celex, form, expected):
    assert one(spark, T.family, celex, form) == expected


def test_long_white_space_is_linear(spark):
    assert one(spark, T.clean, "A heading line of text" + " " * 200_000 + "end") .endswith("end")


def test_template(spark):
    assert one(spark, lambda c: T.fill("{{x}} {q} {n}", q=c, n=F.lit("3")), "a{n}") == "{x} a3 3"
