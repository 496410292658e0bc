"""HTML to text against the same two passes in Python."""

import re

import pytest

from sluicegate.functions.text import WHITE_SPACE, html_to_text


def test_white_space_is_what_python_takes_for_it():
    assert set(WHITE_SPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


@pytest.mark.parametrize(
    "html",
    [
        "",
        "plain",
        "<p>a</p><p>b</p>",
        "  <b>x</b>\n\t y  ",
        "a <> b < c > d",
        "<a\nhref='x'>link</a>",
        "unclosed <b text",
        "<script>var t='</p>';</script>",
        "".join(f"{c}x" for c in WHITE_SPACE),
        WHITE_SPACE,
        "&nbsp;&amp;",
        "é\u00a0ü\u3000漢",
    ],
)
def test_html_to_text(spark, html):
    expected = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", html)).strip()
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(html_to_text("html")).first()[0] == expected


def test_null_stays_null(spark):
    assert spark.createDataFrame([(None,)], "html string").select(html_to_text("html")).first()[0] is None
