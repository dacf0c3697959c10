import pytest
from helpers import plan_of, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from jobtrail.operators import (
    new_roles,
    page_fields,
    page_key,
    page_roles,
    site_activity,
    snapshot_diff,
)
from jobtrail.sources import scan_pages

PAGES = "page_id bigint, url string, html string"


def fields(spark, html):
    row = page_fields(spark.createDataFrame([(1, "u", html)], PAGES)).first()
    return row.heading, row.language, row.body


def test_fields_of_a_plain_page(spark):
    html = (
        '<html lang="en"><head><title>T</title><script>var t="</p><article>no</article>"</script></head>'
        "<body><nav>menu</nav><!-- <article>no</article> --><article><h1>A &amp; B</h1>\n"
        "<p>one<br>two</p><style>p{}</style>  three</article><footer>end</footer></body></html>"
    )
    assert fields(spark, html) == ("A & B", "en", "A & B one two three")


def test_tags_in_capitals_and_over_lines(spark):
    html = '<HTML\nLANG=\'De-AT\'><BODY><ARTICLE class="x"><H1\nid=a>Kopf</H1>Text</ARTICLE></BODY></HTML>'
    assert fields(spark, html) == ("Kopf", "de-at", "Kopf Text")


def test_entities_are_decoded_once(spark):
    assert fields(spark, "<article>&amp;lt; &lt;b&gt; &quot;x&quot;&nbsp;y</article>")[2] == '&lt; <b> "x" y'


def test_page_without_article_is_read_whole(spark):
    assert fields(spark, "<head><title>T</title></head><p>all</p>of it") == ("", "", "all of it")


@pytest.mark.parametrize(
    ("html", "body"),
    [
        ("<p>menu</p><article>never closed", "never closed"),
        ("<article>outer <article>in</article> tail</article> end", "outer in tail"),
        ("<article>one</article><article>two</article> end", "one two"),
        ("<article>one</article> <article>two", "one two"),
        ("<articles>no</articles>", "no"),
    ],
)
def test_no_article_is_lost(spark, html, body):
    assert fields(spark, html)[2] == body


def test_roles_of_a_page(spark):
    html = '<html lang="en"><p>menu</p><article><h1>A</h1>one</article><p>ad</p><ARTICLE id=2><h1>B</h1>two'
    pages = spark.createDataFrame([(1, "u", html), (2, "u", "<p>whole</p>"), (3, "u", None)], PAGES)
    assert rows(page_roles(pages), "page_id", "position", "heading", "body") == [
        (1, 0, "A", "A one"), (1, 1, "B", "B two"), (2, 0, "", "whole"),
    ]


def test_null_and_empty_html(spark):
    assert fields(spark, None) == (None, None, None)
    assert fields(spark, "") == ("", "", "")


def test_text_after_a_long_page_is_kept(spark):
    assert fields(spark, "<article>" + "word " * 200_000 + "last</article>")[2].endswith("word last")


def keys(spark, *urls):
    pages = spark.createDataFrame([(i, url, "") for i, url in enumerate(urls)], PAGES)
    return [row.page_key for row in page_key(pages).orderBy("page_id").collect()]


def test_spellings_of_one_address_share_a_key(spark):
    found = keys(
        spark,
        "http://www.a.example/jobs/1.html",
        "https://a.example/jobs/1",
        "https://A.example/jobs/1/?ref=x&utm_source=feed",
        "https://m.a.example:443/jobs/1#top",
        "http://user@a.example:80/jobs/1?",
    )
    assert set(found) == {"a.example/jobs/1"}


def test_other_addresses_have_other_keys(spark):
    found = keys(
        spark, "https://blog.a.example/x", "https://a.example/x", "https://a.example/y", "https://a.example/",
        "https://a.example/x?id=1", "https://a.example/x?id=2&ref=z", "https://a.example/x?referrer=1",
        "https://a.example/x#/job/1", "https://a.example/x#/job/2", "https://a.example:8080/x", "http://a.example:443/x",
    )
    assert len(set(found)) == 11


def test_malformed_address_is_its_own_key(spark):
    assert keys(spark, "Not a url ", "https://a b/c", None) == ["not a url", "https://a b/c", None]


def test_keys_do_not_read_html(spark):
    pages = scan_pages(spark, "/root/testdata/sf0.001")
    plan = plan_of(page_key(pages).select("page_id", "page_key"))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan


def diff_of(spark, prev, cur):
    def pages(contents):
        return spark.createDataFrame([(k, f"https://h{k}.example/", v) for k, v in contents], PAGES)

    return snapshot_diff(pages(prev), pages(cur))


def test_diff_states(spark):
    found = diff_of(
        spark,
        [(1, "a"), (2, "b"), (3, "c"), (4, None), (5, None)],
        [(2, "b"), (3, "C"), (4, None), (5, "e"), (6, "f")],
    )
    assert rows(found, "page_id", "state") == [
        (1, "removed"), (2, "same"), (3, "changed"), (4, "same"), (5, "changed"), (6, "added"),
    ]


def test_diff_with_an_empty_side(spark):
    assert rows(diff_of(spark, [], [(1, "a")]), "page_id", "state") == [(1, "added")]
    assert rows(diff_of(spark, [(1, "a")], []), "page_id", "state") == [(1, "removed")]
    assert rows(diff_of(spark, [], []), "page_id", "state") == []


def test_copies_of_a_page_count_once(spark):
    found = diff_of(spark, [(1, "a")] * 500, [(1, "a")] * 700 + [(2, "b")] * 300)
    assert rows(found, "page_id", "state") == [(1, "same"), (2, "added")]


contents = st.dictionaries(st.integers(0, 8), st.sampled_from(["a", "b", None]), max_size=8)


@settings(max_examples=10, deadline=None)
@given(prev=contents, cur=contents)
def test_states_partition_the_union_of_pages(spark, prev, cur):
    found = dict(rows(diff_of(spark, list(prev.items()), list(cur.items())), "page_id", "state"))
    want = {}
    for page in prev.keys() | cur.keys():
        if page not in prev:
            want[page] = "added"
        elif page not in cur:
            want[page] = "removed"
        else:
            want[page] = "same" if prev[page] == cur[page] else "changed"
    assert found == want


def test_site_activity(spark):
    diff = spark.createDataFrame(
        [("http://a.example/1", "added"), ("https://A.example/2", "same"), ("http://b.example/", "added")],
        "url string, state string",
    )
    found = rows(site_activity(diff), "host", "added", "removed", "changed", "same")
    assert found == [("a.example", 1, 0, 0, 1), ("b.example", 1, 0, 0, 0)]


def test_new_roles(spark):
    roles = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, None)], "page_id bigint, page_key string")
    seen = spark.createDataFrame([("a",)] * 50 + [(None,)], "page_key string")
    assert rows(new_roles(roles, seen), "page_id") == [(2,), (3,), (4,), (5,)]


def test_page_new_by_id_is_not_new_by_key(spark):
    prev = spark.createDataFrame([(1, "http://www.a.example/x.html", "")], PAGES)
    cur = spark.createDataFrame([(2, "https://a.example/x", ""), (3, "https://a.example/z", "")], PAGES)
    assert rows(new_roles(page_key(cur), page_key(prev)), "page_id") == [(3,)]
