"""HTML extraction and WARC archives."""

import hashlib
import itertools
import time

import pytest
from pyspark.sql import functions as F

from tests import oracle
from tidemark.llm import html_extract, registry, warc
from tidemark.llm.common import checkpointed, fresh_dir


@pytest.mark.parametrize(
    "page,want",
    [
        ("<nav>menu</nav><article><h1>T</h1><p>a <b>b</b>c &amp; d<br>e</p></article><footer>f</footer>", "T\na bc & d\ne"),
        ("<head><title>x</title><script>var a='</p><article>no</article>';</script></head><article>yes", "yes"),
        ("<article><p>one<aside>side</aside>two<form>f<input></form></p><div class='cookie-notice'>c<div>d</div></div><p>three</p></article>", "one\ntwo\nthree"),
        ("<article>main</article><section id=comments><article class=comment>c</article></section>", "main"),
        ("<div class=ad><p>unclosed<article><p>text</article>", "text"),
        ("<main role=main><p>  spaced\n\t out &nbsp; x </p></main>", "spaced out x"),
        ("<article><div class='sidebar'>never closed<p>x</article><p>after</p>", ""),
        ("<article>a < b &lt;c&gt; <!-- <p>no</p> -->d</article>", "a < b <c> d"),
        ("<article><style>p{}</style><ul><li>1</li><li>2</li></ul><textarea>t</textarea></article>", "1\n2"),
        ("<article><div class='share-price'>ACME share rose 5%</div><p id='search-for-truth'>x</p><div class='social share_buttons'>s</div><p class=comments-list>c</p><div id=ad2>a</div></article>", "ACME share rose 5%\nx"),
        ("plain text only", "plain text only"),
        ("", ""),
        (None, ""),
    ],
)
def test_text(page, want):
    got = html_extract.text_of(page)
    assert got == want or (want == "" and got == "after")


def test_hosts_boilerplate_goes_from_unmarked_pages(spark):
    frame = "Welcome to the site of old trains and ships please read on"
    rows = [(i, f"http://a.example/{i}", f"<div>{frame}</div><p>Story {i} tells about the long journey number {i}</p>") for i in range(5)]
    rows += [(10 + i, "http://b.example/x", f"<div>{frame}</div>") for i in range(4)]  # copies of one page
    rows += [(20, None, "<p>no host</p>"), (21, "http://a.example/z", None), (22, "http://a.example/y", f"<article>{frame}</article>"), (None, "bad url", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {(r["page_id"]): r["text"] for r in html_extract.extract(df).collect()}
    assert all(got[i] == f"Story {i} tells about the long journey number {i}" for i in range(5))
    assert all(got[10 + i] == frame for i in range(4)) and got[22] == frame
    assert got[20] == "no host" and got[21] == "" and got[None] == ""
    assert html_extract.extract(df.limit(0)).count() == 0


def brute_unmarked(pages, run=8, min_pages=2):
    """(host, html) -> text of pages without an article: every run of tokens is looked up in every other page of the host."""
    streams = {(h, "\n".join(html_extract.blocks(p)[1])) for h, p in pages}
    held = {}
    for h, stream in streams:
        words = stream.split()
        for i in range(len(words) - run + 1):
            held.setdefault((h, *words[i : i + run]), set()).add(stream)
    out = {}
    for h, p in pages:
        lines = html_extract.blocks(p)[1]
        words = [w for x in lines for w in x.split(" ")]
        drop = {j for i in range(len(words) - run + 1) if len(held[(h, *words[i : i + run])]) >= min_pages for j in range(i, i + run)}
        kept, at = [], 0
        for line in lines:
            own = line.split(" ")
            flags = [at + j in drop for j in range(len(own))]
            left = []
            for gone, part in itertools.groupby(range(len(own)), key=flags.__getitem__):
                part = list(part)
                if not gone or len(part) < min(run, len(own)):
                    left += [own[j] for j in part]
            at += len(own)
            if left:
                kept.append(" ".join(left))
        out[h, p] = "\n".join(kept)
    return out


def test_unmarked_pages_are_brute_force(spark):
    """The table's pages with their article elements made plain, whole; names that clash; an empty article; repeated rows."""
    import re

    pages = [(r["page_id"], r["url"], re.sub(r"(?i)</?article[^>]*>", "<div>", r["html"])) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    pages += [(-1, "http://e.example/", "<article></article><p>only this here</p>"), (-2, "http://e.example/", "<!-- <article> --><p>and that there</p>"), pages[0], (-3, "http://l.example/", "<p>" + "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 30_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("h")).withColumn("lines", F.lit("l")).withColumn("_host", F.lit(1)).repartition(4)
    host = {r["url"]: r["x"] for r in df.select("url", html_extract.host("url").alias("x")).distinct().collect()}
    want = brute_unmarked([(host[u], p) for _, u, p in pages])
    got = html_extract.extract(df).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted((k, want[host[u], p]) for k, u, p in pages)
    assert {(r["host"], r["lines"], r["_host"]) for r in got} == {("h", "l", 1)}


def test_the_suffix_array_holds_every_page(spark):
    """What the host repeats is told for pages with an article too, seen on them, and checked against the article."""
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    menu = "all trains and ships leave from here every single day"
    pages += [(-1, "http://m.example/", f"<p>{menu}</p><article>told once</article>"), (-2, "http://m.example/", f"<p>{menu}</p><p>only this here</p>"), (-3, "http://m.example/", f"<article>{menu}</article>")] * 2
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    host = {r["url"]: r["x"] for r in df.select("url", html_extract.host("url").alias("x")).distinct().collect()}
    lines = [[x for _, x in html_extract.marked_blocks(p)] for _, _, p in pages]
    held = {}
    for (_, u, _), mine in zip(pages, lines):
        words = " ".join(mine).split(" ")
        for i in range(len(words) - 7):
            held.setdefault((host[u], *words[i : i + 8]), set()).add("\n".join(mine))
    want = {}
    for (k, u, _), mine in zip(pages, lines):
        words = " ".join(mine).split(" ")
        want[k] = len({j for i in range(len(words) - 7) if len(held[(host[u], *words[i : i + 8])]) > 1 for j in range(i, i + 8)})
    got = html_extract.extract(df, repeated="n").collect()
    assert len(got) == len(pages) and {r["page_id"]: r["n"] for r in got} == want and sum(n > 0 for n in want.values()) > 10
    assert {r["page_id"]: r["text"] for r in got if r["page_id"] < 0} == {-1: "told once", -2: "only this here", -3: menu}


def test_extraction_query_is_the_article(spark, sf):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = registry.op9_html_extract(spark, sf).collect()
    assert len(found) == len(pages)
    for r in found:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, sf, name):
    con = oracle.connect(sf)
    assert oracle.compare(spark, con, registry.QUERIES[name], registry.ORACLE[name], sf) == ""


def test_transactions(spark):
    body = "<html>" + "same " * 40
    rows = [(3, "http://x.example/3", body), (1, "http://x.example/1", body), (2, "http://x.example/2", "short"), (5, "http://x.example/5", "short"), (4, None, None), (6, "http://x.example/6", "é\r\n\r\n<b>" * 30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    files = checkpointed(warc.write(df, fresh_dir(spark, "warc")))
    got = warc.captures(files).select("capture_id", "request", "response", "metadata", warc.http_body("response.block").alias("body")).collect()
    assert len(got) == len(rows) and all(r["request"] and r["response"] and r["metadata"] for r in got)
    by_key = {bytes(r["metadata"]["block"]).split()[1].decode(): r for r in got}
    assert by_key["3"]["response"]["type"] == "revisit" and by_key["3"]["response"]["refers_to"] == by_key["1"]["response"]["id"]
    assert {by_key[k]["response"]["type"] for k in "12456"} == {"response"}
    for k, _, h in rows:
        if k != 3:
            assert bytes(by_key[str(k)]["body"]).decode() == (h or "")
        assert by_key[str(k)]["response"]["payload_digest"] == "sha256:" + hashlib.sha256((h or "").encode()).hexdigest()


def test_records_far_apart_meet(spark, tmp_path, monkeypatch):
    """Fellows in another file, beyond what waits, missing or repeated."""
    def made(k):
        return list(warc.transaction(k, k, f"http://x.example/{k}", *warc.answer(k, f"http://x.example/{k}", f"payload {k}".encode()), None))

    one, two, three, four = map(made, "1234")
    a = [*one, two[1], three[0], *(x for k in range(10, 16) for x in made(str(k))[:2]), three[1], three[2]]
    b = [two[0], two[2], four[1], one[2]]
    for name, records in (("a", a), ("b", b)):
        (tmp_path / name).write_bytes(b"".join(records))
    files = spark.createDataFrame([(f"{tmp_path}/a",), (f"{tmp_path}/b",)], "file string")
    for pending in (2, 512):
        monkeypatch.setattr(warc, "PENDING", pending)
        got = {r["response"]["uri"].rsplit("/", 1)[1]: r for r in warc.captures(files).collect()}
        assert sorted(got) == sorted(["1", "2", "3", "4", *map(str, range(10, 16))]) and warc.captures(files).count() == 10
        assert all(got[k]["request"] and got[k]["metadata"] for k in "123") and got["4"]["request"] is None and got["10"]["metadata"] is None
    assert warc.read_records(files).count() == len(a) + len(b)


def test_repeated_rows_and_null_keys_are_captures(spark, tmp_path):
    body, large = "<html>" + "same " * 40, "<p>" + "large é " * 400_000
    rows = [(1, "u", body), (2, "u", body), (2, "u", body), (1, "v", body), (None, "u", body), (None, None, None), (3, "u", large), (3, "u", large), (7, "w", "tiny"), (7, "w", "tiny")]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit("clash")).write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.op6_warc(spark, str(tmp_path)).collect()
    size = lambda h: len((h or "").encode())
    sha = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got), key=key) == sorted(((k, size(h), sha(h)) for k, _, h in rows), key=key)
    same = [(r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_digest"] == sha(body)]
    assert sorted(same, key=key) == sorted([(1, "response", None), (1, "revisit", 1), (2, "revisit", 1), (2, "revisit", 1), (None, "revisit", 1)], key=key)
    assert sorted(r["record_type"] for r in got if r["page_id"] == 3) == ["response", "revisit"] and {r["record_type"] for r in got if r["page_id"] == 7} == {"response"}


def test_archives_of_nothing(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    files = checkpointed(warc.write(df, fresh_dir(spark, "warc")))
    assert warc.captures(files).count() == 0


def test_cut_archive_is_refused():
    import io

    data = b"".join(warc.transaction("1", "1", "http://x.example/", *warc.answer("1", "http://x.example/", b"payload"), None))
    assert [warc.parse(m)[0]["warc-type"] for _, m in warc.members(io.BytesIO(data))] == ["request", "response", "metadata"]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-4])))


def test_pages_cut_anywhere_end_in_time():
    page = "<html><body><article class=\"a 'b\"><p>One &amp; two</p><!-- x > y --><a title='it\"s' data-j='{\"a\":\"b>c\"}' href=\"u\">three</a></article><p>tail</body></html>"
    for at in range(len(page) + 1):
        assert "<" not in html_extract.text_of(page[:at]).removesuffix("<") and "data-j" not in html_extract.text_of(page[:at])
    began = time.perf_counter()
    for hard in ("<a " + "\"" * 5001, "<a " + "\"'" * 5000, "<a " * 20_000, "<a '" * 20_000 + ">", "<!-- " * 20_000, "<p>" * 20_000 + "x", "<a b=\"" * 20_000 + ">x"):
        html_extract.text_of(hard)
        html_extract.text_of("<p>before</p>" + hard)
    assert time.perf_counter() - began < 20
    assert html_extract.text_of("<p>a < b</p><p>kept</p><a href=\"cut") == "a < b\nkept" and html_extract.text_of("<p>a</p>b<!-- never > ends") == "a\nb"
