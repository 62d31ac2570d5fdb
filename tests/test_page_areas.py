"""Pages whose main part isn't the first closed element."""

import pytest

from quarry.sources.pages import page_clauses


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>teaser</p></article><main><h1>T</h1><p>whole</p></main>", "whole"),
        ("<article><p>one</p><article><p>inner</p></article><p>rest</p></article>", "one\n\ninner\n\nrest"),
        ("<p>a</p><main><p>never closed</p>", "a\n\nnever closed"),
        ("</article><article><p>b</p></article>", "b"),
    ],
)
def test_area_of_a_page(page, text):
    assert [c[2] for c in page_clauses(page)] == [text]
