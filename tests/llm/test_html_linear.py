import time

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import html_style_tree

MB = 1 << 20


@pytest.mark.parametrize("part", ["<a ", '<a b="', "<a b='", "<div>a", "<blockquote>", "<p ", "<b><p>x", "<span>y", "</div>", "<li><b>", "<!-", "<article>z", "&amp;<", "<td><table>q"])
def test_a_megabyte_takes_seconds(spark, part):
    """Unclosed tags, unclosed quotes and deep nesting: time and features grow with the page, not with its square."""
    html, small = part * (MB // len(part)), part * (MB // 16 // len(part))
    began = time.process_time()
    text = html_style_tree.main_text(html, {(1, 1)}, {1})
    took = time.process_time() - began
    assert took < 30 and isinstance(text, str)
    began = time.process_time()
    html_style_tree.main_text(small, {(1, 1)}, {1})
    assert took < 60 * max(time.process_time() - began, 0.05)


def test_deep_pages_have_short_lines(spark):
    pages = spark.createDataFrame([(1, "http://h/1", "<div>a" * 20_000), (2, "http://h/2", "<p>b</p>")], "page_id long, url string, html string")
    row = html_style_tree.features(pages).where("page_id = 1").first()
    assert len(row.nodes) <= html_style_tree.DEEPEST + 1 and max(len(n.up) for n in row.nodes) <= html_style_tree.DEEPEST + 1
    assert len(row.contents) == 20_000
    got = {r.page_id: r.text for r in html_style_tree.extract(pages).collect()}
    assert got == {1: "\n".join(["a"] * 20_000), 2: "b"}


def test_unclosed_tags_are_text():
    assert html_style_tree.main_text("<p>1 <a 2 <b>3</b> <i x='4'>5</i></p>", set()) == "1 <a 2 3 5"
    assert html_style_tree.main_text('<p title="a < b > c">x</p><a href="<q>">y</a>', set()) == "x\ny"


def test_the_tree_takes_most_where_it_can_tell(spark):
    """On hosts of the given pages with a hundred pages or more, nearly all that goes does so by importance; the lists are asked
    only about what the tree leaves."""
    rows = html_style_tree.extract(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))
    hosts = rows.groupBy(html_style_tree.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.sum("n_by_tree").alias("tree"), F.sum("n_by_lists").alias("lists"))
    taken = hosts.where("n >= 100").agg(F.sum("tree").alias("tree"), F.sum("lists").alias("lists")).first()
    assert taken.tree > 9 * taken.lists
