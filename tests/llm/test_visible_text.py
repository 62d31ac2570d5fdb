"""Page text by one forward scan: quoted values, unclosed elements, preformatted text, pieces, and linear time."""

import gzip
import random
import time

import pytest

from quarry.llm import warc
from tests.llm.test_warc import Visible, response


@pytest.mark.parametrize(
    "page, text",
    [
        ('<a title="a > b" href="x">link</a>', "link"),
        ("<a title='a > b' href=x>link</a> <b class=\"q'>\">bold</b>", "link bold"),
        ("one<pre>a\n  b\nc</pre>two\nthree", "one\na\nb\nc\ntwo three"),
        ("a < b and b > c &lt;p&gt; &amp;amp; 1<2", "a < b and b > c <p> &amp; 1<2"),
        ("kept<!-- <p>no</p> --> too<!-- open <p>no", "kept too"),
        ("kept<script>if (a < b) '</p>'</script> too<style>open", "kept too"),
        ("kept<a href='x", "kept"),
        ("x<?php echo 1 ?>y<!DOCTYPE html>z</ >w", "xyzw"),
        ("<p>caf&eacute; &#8211; &nbsp;x", "café – x"),
    ],
)
def test_text(page, text):
    assert warc.plain_text(page) == text
    for size in (1, 2, 3, 7):
        scan = warc.VisibleText()
        for i in range(0, len(page), size):
            scan.feed(page[i : i + size])
        assert scan.text() == text


class Spaced(Visible):
    def handle_comment(self, data):
        self.out.append(" ")


@pytest.mark.parametrize("part", ["<head>", "<a ", "<a href='x", "<!--", "<script>", "</", "<", "&", "<p title=\"", "<template><head>", "=\"'"])
def test_two_megabytes_of_one_part_take_linear_time(part):
    began = time.process_time()
    warc.plain_text(part * ((2 << 20) // len(part)))
    assert time.process_time() - began < 4


def test_malformed_pages_against_a_tree():
    rng = random.Random(6)
    words = ["alpha", "be ta\n", "x&amp;y", "1 < 2 ", "é", " "]
    for _ in range(400):
        page = "".join(
            rng.choice([
                rng.choice(words), f"<{(t := rng.choice(['p', 'b', 'div', 'li', 'span', 'td', 'h2']))}>", f"</{t}>", "<!-- c -->",
                f'<{t} title="a > b" x=\'>\'>', "<br/>", "<script>a<b</script>", "<style>p</style>", "<img src=x>",
            ])
            for _ in range(rng.randrange(1, 30))
        )
        parser = Spaced()
        parser.feed(page)
        parser.close()
        assert warc.plain_text(page) == parser.text(), page


def test_a_chunked_body_that_is_cut_off():
    kind = [("Content-Type", "text/html"), ("Transfer-Encoding", "chunked")]
    for body, text, whole in ((b"5\r\nhello\r\n6\r\n wor", "hello wor", False), (b"5\r\nhello\r\n", "hello", False), (b"5\r\nhello\r\n0\r\n\r\n", "hello", True), (b"plain", "plain", True)):
        _, _, metadata, conversion, got, why = warc.derive(response(kind, body))
        assert (got, why) == (text, None)
        meta, conv = warc.parse_at(metadata)[0], warc.parse_at(conversion)[0]
        assert ("source-truncated" in meta.block.decode()) == (not whole) == (conv.get("WARC-Truncated") == "unspecified")


def test_bodies_of_any_size_and_unstated_types():
    page = b"<p>" + b"word " * 30_000_000 + b"</p>end"
    text, whole = warc.body_text([("Content-Type", "text/html"), ("Content-Encoding", "gzip")], gzip.compress(page, 1))
    assert whole and len(text) == 5 * 30_000_000 + 3 and text.endswith("word\nend")
    for head, media in ((b" <!-- c --> <p>", "text/html"), (b"<?xml version='1.0'?><html>", "text/html"), (b"words", "text/plain"), (b"a\0b", "unknown bytes"), (b"x" * 2000 + b"\0", "text/plain")):
        assert warc.sniffed(head[: warc.SNIFFED]) == media
