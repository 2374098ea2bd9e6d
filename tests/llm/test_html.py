import html as entities
import random
import re
import time

from collections import Counter

import pytest

from spindrift.llm import html as H

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "markup, text",
    [
        ("<article><h1>T</h1><p>a &amp; b&nbsp;  c<br>d<p>e</article>", "T\na & b c d\ne"),
        ("<nav>n</nav><main><p>m</p><aside>x</aside><p>k<script>var t='</p>'</script>k</p></main><footer>f</footer>", "m\nkk"),
        ("<header>h</header><article><header><h1>T</h1></header><p>a<div class='cookie-notice'>no</div></article>", "T\na"),
        ("<article><p>a</p><div id=comments><article><p>c</p></article></div><p>z</article>", "a\nz"),
        ("<nav><a>x</a><article><p>t</p></article>", "t"),
        ("<article><p>a<b>b</b>c<!-- <p>no</p> --><style>p{}</style><form><p>f</p></form><p>d", "abc\nd"),
        ('<article><p title="a > b">x</p><p role="navigation">n</p><p hidden>h</p><p>1 < 2</p></article>', "x\n1 < 2"),
        ("<article></article>", ""),
    ],
)
def test_articles(markup, text):
    page = H.parse(markup)
    assert page.has_article and "\n".join(t for _, t in page.blocks) == text


@pytest.mark.parametrize(
    "markup, text",
    [
        ('<article><p>a</p><img src="a" data-analytics-trackid="tru', "a"),
        ("<article><p>a</p><p " + "a" * 60 + '"', "a"),
        ("<article><p>a</p><p " + "a" * 60 + '">b</p>', "a\nb"),
        ('<article><p class="x>a</p><p id="y">b</p>', 'b'),
        ("<article><p title=it's>a</p><p title='>' x=\">\">b", "a\nb"),
        ("<article><p>a < b <3 c</p><p class=>d</p><p =x>e</p><", "a < b <3 c\nd\ne\n<"),
        ("<article><p>a</p><!-- b", "a"),
        ("<article><p>a</p><script>b", "a"),
        ('<article><p title="hidden ad">a</p><div class="article-header"><h1>b</h1></div>', "a\nb"),
    ],
)
def test_broken_markup(markup, text):
    assert "\n".join(t for _, t in H.parse(markup).blocks) == text


@pytest.mark.parametrize(
    "part",
    ["<p a='", '<p x"', "<p " + "a" * 30 + '"', "<nav>", "</nav>", "<div class=ad>", "<nav></p>", "<!", "<!--", "<?", "&", "<a =", "<script", "<article>", "<p\n/", "<b ' \" = ", "<script>a</script"],
)
def test_time_follows_the_length(part):
    start = time.perf_counter()
    H.parse("<article><p>" + part * (400_000 // len(part)))
    H.parse(part * (400_000 // len(part)))
    assert time.perf_counter() - start < 8


def test_marked_blocks_in_articles(spark):
    """A word that chrome and text share decides nothing in an article; other pages of the host do."""
    boiler = " ".join(f"shared{i}" for i in range(20))
    page = "<article><p>text {i}</p><div class='related widget'>{boiler}</div><div class='header'>{own}</div></article>"
    own = [" ".join(f"own{i}-{k}" for k in range(20)) for i in range(4)]
    df = spark.createDataFrame([(i, "http://a.com/", page.format(i=i, boiler=boiler, own=own[i])) for i in range(4)], "page_id int, url string, html string")
    for r in H.extract(df).collect():
        assert (r.text, r.n_boilerplate) == (f"text {r.page_id}\n{own[r.page_id]}", 20)


def test_pages_of_the_data(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r.page_id: r for r in H.extract(df).collect()}
    for r in df.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"</?b>", "", re.sub("<br>", " ", b)))).strip() for b in re.split(r"</?(?:p|h1)>", body)]
        text = "\n".join(b for b in blocks if b)
        assert (found[r.page_id].text, found[r.page_id].n_chars, found[r.page_id].url) == (text, len(text), r.url)


def test_hosts_whose_pages_have_no_article(spark):
    """Templates without any telling element or class: only repetition shows what is boilerplate."""
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) BETWEEN 500 AND 5000").orderBy("doc_id").limit(60).collect()]
    texts = list(dict.fromkeys(" ".join(t.split()) for t in texts))
    r = random.Random(9)
    own = lambda n: " ".join(f"c{r.randrange(10**6)}" for _ in range(n))
    templates = [(own(14), own(25)) for _ in range(3)]
    rows = []
    for i, t in enumerate(texts):
        top, bottom = templates[i % 3]
        rows.append((i, f"http://host{i % 3}.org/{i}", f"<body><div><a>{top}</a></div><div><p>{entities.escape(t)}</p></div><div>{bottom}<br>page {i}</div></body>"))
    found = {x.page_id: x for x in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    truth = {i: Counter(t.split()) for i, t in enumerate(texts)}
    words = {i: Counter(x.text.split()) for i, x in found.items()}
    right = sum(sum((truth[i] & words[i]).values()) for i in truth)
    recall, precision = right / sum(sum(t.values()) for t in truth.values()), right / sum(sum(t.values()) for t in words.values())
    assert recall > 0.9 and precision > 0.99 and all(x.n_boilerplate >= 39 for x in found.values()), (recall, precision)


def test_repeated_stretches_of_a_host(spark):
    boiler = "this site uses many small words to say that all rights are reserved here today ok"
    rows = [(i, f"http://a.com/{i}", f"<body><div>{boiler}</div><div>own text {i * 7}</div><p>{boiler} tail{i}</p>") for i in range(5)]
    rows += [(9, "http://b.com/1", f"<div>{boiler}</div>"), (9, "http://b.com/1", f"<div>{boiler}</div>"), (10, None, None), (11, "http://a.com/x", ""), (12, None, "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = sorted(((r.page_id, r.text, r.n_boilerplate) for r in H.extract(df.withColumn("text", df.url)).collect()))
    assert out[:5] == [(i, f"{i * 7}\ntail{i}", 34) for i in range(5)]
    assert out[5:] == [(9, boiler, 0), (9, boiler, 0), (10, "", 0), (11, "", 0), (12, "x", 0)]
    assert H.extract(df.limit(0)).collect() == []


def test_long_page_and_clashing_columns(spark):
    body = "".join(f"<p>word{i} and more</p>" for i in range(60_000))
    df = spark.createDataFrame([(1, "http://a.com", f"<article>{body}</article>", 3, b"x"), (2, "http://a.com", f"<div>{body}</div>", 4, b"y")], "page_id short, url string, html string, n_chars int, sid binary")
    found = {r.page_id: r for r in H.extract(df).collect()}
    text = "\n".join(f"word{i} and more" for i in range(60_000))
    assert found[1].text == text and found[1].n_chars == len(text) and found[2].text == text
