"""Page texts, url rules and nearest neighbours against plain computations."""

import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ann, html_extract, url_filter
from plumbline.llm.oracles import oracles
from plumbline.llm.queries import op6_url_filter
from tests.oracle import connect, spark_rows, sql_rows

ARTICLE = "A sentence of the article that is long enough to count, with &amp; and caf&eacute;."
PAGES = [
    (f"<html><body><nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>{ARTICLE}<p>Two<br>lines &#33;</article><footer>Foot</footer>",
     "Title\n\nA sentence of the article that is long enough to count, with & and café.\n\nTwo lines !"),
    (f"<body><header>Site</header><div id='cookie-notice'>We use cookies. " + "Really. " * 60 + f"</div><div class='post'><p>{ARTICLE}</p><p>{ARTICLE}</p>"
     f"<form>Name <input></form></div><div class='comments'>{'<p>A comment of a reader, quite long too.</p>' * 9}</div></body>",
     "\n\n".join(["A sentence of the article that is long enough to count, with & and café."] * 2)),
    ("<article><script>var t='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p title='a>b'>Only  this\n text</article>", "Only this text"),
    ("<div><ul><li>one</li><li>two</li></ul></div>", "one\n\ntwo"),
    ("no markup at all", "no markup at all"), ("", ""), (None, ""), ("<p>", ""), ("<<< >>> <b", None), ("<div>" * 3000 + "deep", "deep"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_main_text(page, text):
    found = html_extract.main_text(page)
    assert text is None or found == text


def paragraphs(name, n=10):
    return [f"{name} {i} " + "says a little more about it all, " * 3 + "and ends." for i in range(n)]


def as_html(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_main_text_of_several_containers():
    """No article or main element; what is linked or short beside the text is left out."""
    one, two, three = (paragraphs(x) for x in ("one", "two", "three"))
    links = "<div>" + "".join(f"<a href=x{i}>Another page {i}</a> " for i in range(30)) + "</div>"
    page = f"<body>{links}<div id=content><div>{as_html(one)}</div><div>{as_html(two)}</div></div>{links}<div>Imprint</div>"
    assert html_extract.main_text(page) == "\n\n".join(one + two)
    page = f"<body>{links}<div><div>{as_html(one)}</div>{links}<section><div>{as_html(two)}</div></section></div><div>{as_html(three)}</div>"
    assert html_extract.main_text(page) == "\n\n".join(one + two + three)
    bare = "Text <b>of its own</b> between containers, " + "which goes on and on, " * 5 + "and ends."
    page = f"<body><div>{as_html(one)}</div>{bare}<div>{as_html(two)}</div>{links}"
    assert html_extract.main_text(page) == "\n\n".join([*one, re.sub("<.*?>", "", bare), *two])


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "page with-comments", "post-share", "layout--without_ads", "sidebar"])
@pytest.mark.parametrize("tag", ["div", "article", "main"])
def test_main_text_in_a_part_that_mentions_something_else(name, tag):
    texts = paragraphs("text")
    inner = "".join(f"<p>{t}</p>" for t in texts)
    other = "<div class='comments'>" + "<p>A comment of a reader, quite long too.</p>" * 2 + "</div><div>Imprint</div>"
    page = f"<body><div>Name</div><div class='{name}'><{tag}>{inner}</{tag}>{other}</div>"
    assert html_extract.main_text(page) == "\n\n".join(texts)


def test_main_text_leaves_comments_out_as_before():
    texts = paragraphs("text", 3)
    inner = "".join(f"<p>{t}</p>" for t in texts)
    replies = "<article class='comment'>" + "<p>A comment of a reader, quite long too, and not the article.</p>" * 20 + "</article>"
    for tag in ("div", "article"):
        page = f"<body><{tag}>{inner}</{tag}><div id='comments'>{replies}</div>"
        assert html_extract.main_text(page) == "\n\n".join(texts)


@pytest.mark.parametrize("raw", [
    "<svg viewBox='0 0 1 1'/>", "<svg/>", "<svg><path d='M0'/>", "<select><option>one<option>two", "<select name=a>", "<template>", "<noscript>",
    "<svg><foreignObject><div>drawn</div></foreignObject></svg>", "<svg><text>drawn</text></svg>", "<select><option>one</select>", "<svg><g><svg><text>x</text></svg>",
])
def test_main_text_after_elements_without_end(raw):
    texts = paragraphs("text")
    page = f"<body>{raw}<div>{''.join(f'<p>{t}</p>' for t in texts)}</div>"
    assert html_extract.main_text(page) == "\n\n".join(texts)
    assert html_extract.main_text(page + "<svg></svg><select></select>") == "\n\n".join(texts)


def test_extract_text(spark):
    rows = [(i, None if i == 3 else f"u{i}", page, "x") for i, (page, _) in enumerate(PAGES)] * 2
    schema = "page_id bigint, url string, html string, text string"
    found = html_extract.extract_text(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.text == html_extract.main_text(PAGES[r.page_id][0]) and r.n_chars == len(r.text)
        assert r.url == (None if r.page_id == 3 else f"u{r.page_id}")
    assert html_extract.extract_text(spark.createDataFrame([], schema)).count() == 0


def test_given_pages_hold_their_articles(spark, folder):
    """The article element of the given pages, by pattern."""
    found = html_extract.extract_text(spark.read.parquet(f"{folder}/pages.parquet"))
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in found.collect():
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [html.unescape(re.sub(r"<[^>]*>", " ", b)) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n\n".join(t for b in blocks if (t := " ".join(b.split())))


URLS = [
    None, "", "no scheme", "http://a.net", "http://a.net/", "https://EXAMPLE.net/en/1?x", "http://x.example.net/de/", "http://example.com/de/x#y",
    "ftp://www.Example.com/de", "http://b.org/fr/1", "http://b.org/en/", "http://net/x", "http://notexample.com/de/", "a://b://c.net/", "http://a.net?q=/en/",
    "http://c.org/fr/?a", "http:///en/", "http://ünï.net/é",
]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best.key if best else None, best.verdict if best else "allow"


def test_url_rules(spark):
    schema = "page_id bigint, url string, host string, rule int"
    rows = [(i, u, "h", 1) for i, u in enumerate(URLS * 2)]
    found = url_filter.judge_urls(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.host, r.path, r.rule, r.verdict) == judged(rows[r.page_id][1])
    assert url_filter.judge_urls(spark.createDataFrame([], schema)).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows, schema), rules=[]).collect()} == {"allow"}


def test_url_rules_as_in_sql(spark, folder):
    assert spark_rows(op6_url_filter(spark, folder)) == sql_rows(connect(folder), oracles()["op6_url_filter"])


@pytest.mark.parametrize("listed", [0, 1, 40, 2000])
def test_cascade_is_exact_over_its_universe(spark, listed):
    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = url_filter.build_cascade(universe.where(F.substring("key", 2, 9).cast("int") < listed), universe)
    wrong = universe.where(cascade.holds(F.col("key")) != (F.substring("key", 2, 9).cast("int") < listed))
    assert wrong.count() == 0
    assert listed == 0 or len(cascade.levels) >= 1


def exact(vectors, k):
    out = {}
    ids = np.array([i for i, _ in vectors])
    matrix = np.array([v for _, v in vectors])
    for i, v in vectors:
        if i % 20 == 0:
            scores = (matrix * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), scores[j]) for j in order]
    return out


def test_nearest_recall(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    vectors = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in table.collect()]
    expected = exact(vectors, 20)
    found = ann.nearest(table, forest=ann.Forest(meet=1.5)).collect()
    hits = sum(r.vec_id in {j for j, _ in expected[r.query_id]} for r in found)
    assert hits >= 0.9 * sum(map(len, expected.values()))
    by_id = dict(vectors)
    assert all(r.score == (by_id[r.query_id] * by_id[r.vec_id]).sum() for r in found)


def test_recall_of_the_default_forest(spark):
    """More vectors than any query meets by the least number alone."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in table.collect()]
    more = np.random.default_rng(6).normal(size=(2_000, len(vectors[0][1])))
    scale = np.std([v for _, v in vectors])
    vectors += [(100_000 + i, v * scale) for i, v in enumerate(more)]
    assert len(vectors) > 1.5 * ann.Forest().least
    expected = exact(vectors, 20)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors], "vec_id bigint, embedding array<double>")
    found = ann.nearest(df).collect()
    hits = sum(r.vec_id in {j for j, _ in expected[r.query_id]} for r in found)
    assert hits >= 0.9 * sum(map(len, expected.values()))


def test_nearest_of_awkward_vectors(spark):
    """Copies, ties, several lengths, and vectors that take no part; small enough to be exact."""
    random = np.random.default_rng(3)
    rows = [(i, [float(x) for x in random.integers(-2, 3, 4)]) for i in range(1, 60)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(60, 160)]
    good = [(i, np.array(v)) for i, v in rows if any(v)]
    bad = [(200, None), (220, [0.0] * 4), (240, [1.0, None, 1.0, 1.0]), (260, [float("nan")] * 4), (280, [float("inf")] * 4), (300, []), (320, [1.0]), (None, [1.0] * 4)]
    schema = "vec_id bigint, embedding array<double>, rank int, score string"
    df = spark.createDataFrame([(i, v, 0, "s") for i, v in [*rows, *bad, rows[70]]], schema)
    found = ann.nearest(df, k=20).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == exact(good, 20)
    assert all([r["rank"] for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] == list(range(1, 21)) for q in got)
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    assert ann.nearest(spark.createDataFrame([(20, [1.0], 0, "s")], schema)).count() == 0


def test_nearest_searches_large_leaves_in_parts(spark):
    random = np.random.default_rng(4)
    rows = [(i, [float(x) for x in random.normal(size=6)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = ann.nearest(df, k=5, forest=ann.Forest(trees=2, leaf=1.0, rows_per_part=50, queries_per_part=7)).collect()
    expected = exact([(i, np.array(v)) for i, v in rows], 5)
    assert {(r.query_id, r["rank"], r.vec_id) for r in found} == {(q, k + 1, j) for q, best in expected.items() for k, (j, _) in enumerate(best)}
