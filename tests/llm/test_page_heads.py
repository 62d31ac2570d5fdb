"""Heads without a closing tag."""

import pytest

from quarry.llm import warc


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>t</title><meta charset=utf-8><body><p>kept</p></body></html>", "kept"),
        ("<head><script>if (a < b) '<p>no</p>'</script><!-- <p>no</p> --><link rel=x><p>kept<p>more", "kept\nmore"),
        ("<head>\n<style>p {}</style>text at once", "text at once"),
        ("<head><title>t</title><p>odd but closed</p></head><body>kept", "kept"),
        ("<header>shown</header><p>kept", "shown\nkept"),
    ],
)
def test_head_without_closing_tag(spark, page, text):
    pages = spark.createDataFrame([(1, "http://a.example/", page)], "page_id long, url string, html string")
    records = warc.page_responses(pages, ["page_id"])
    assert warc.derivatives(records, ["page_id"]).first().text == text
