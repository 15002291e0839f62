"""Archives, main text and URL rules against plain Python."""

import gzip
import hashlib
import itertools
import random
import re
from pathlib import Path

import pytest

from skyloom.llm import html_text, url_rules, warc

@pytest.mark.parametrize("open_, close", [("<form><article>", "</article></form>"), ("<form id=page><div>", "</div></form>"), ("<div role=form><main>", "</main></div>")])
def test_a_form_around_the_page_is_no_form(open_, close):
    controls = "<label>Your name</label><select><option>One</option></select><button>Go</button><input value=x>"
    text = html_text.Page(f"<body>{open_}<h1>Title</h1><p>{LONG}</p>{controls}<p>The end</p>{close}</body>").main_text(None)
    assert text == f"Title\n{LONG.strip()}\nThe end"


@pytest.mark.parametrize("form", ["<form>Search this site<input></form>", "<form><p>Leave a reply below</p><textarea>x</textarea></form>"])
def test_forms_beside_and_in_the_article_go(form):
    for page in (f"<body>{form}<article><p>{LONG}</p></article></body>", f"<body><article><p>{LONG}</p>{form}</article></body>"):
        assert html_text.Page(page).main_text(None) == LONG.strip()


def test_deep_pages_take_time_and_memory_in_proportion():
    import time

    def seconds(n):
        began = time.process_time()
        page = html_text.Page("<div class=a>" * n + "</b></i>" * n + f"<p>{LONG}</p>")
        assert page.main_text(None) == LONG.strip() and max(len(x.path) for x in page.nodes) <= html_text.PATH
        return time.process_time() - began

    seconds(1000)
    assert seconds(64_000) < 40 * seconds(4_000) + 1


# ---- op8


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, digest string")


def page_rows():
    big, other = "b" * 1500, "é" * 500
    html = [None, "", "small", "small", big, big, other, other, big, "é" * 499, "x" * 3_000_000]
    return [(i, f"http://h/{i}", h, "own", "own") for i, h in enumerate(html)] + [
        (8, "http://h/again\r\nWARC-Type: x", big, "", ""),
        (None, None, big, "", ""),
    ]


def expected_records(rows):
    out = []
    payloads = [(r[0], (r[2] or "").encode()) for r in rows]
    for i, p in payloads:
        largest = max((j for j, q in payloads if q == p and j is not None), default=None)
        refers = largest if len(p) >= 1000 and i != largest else None
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def records_of(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


def test_archives_come_back_whole(spark, tmp_path):
    folder, rows = f"file://{tmp_path}/w", page_rows()
    archives = warc.write_archives(pages(spark, rows).repartition(3), folder)
    assert sum(r["records"] for r in archives.collect()) == len(rows)
    records, gaps = warc.read_archives(spark, folder)
    assert gaps.count() == 0 and records_of(records) == expected_records(rows)
    by_id = {r["page_id"]: r for r in records.collect()}
    assert bytes(by_id[10]["payload"]) == b"x" * 3_000_000 and by_id[4]["payload"] is None
    empty = warc.write_archives(pages(spark, rows).limit(0), f"file://{tmp_path}/none")
    assert empty.count() == 0


def test_damage_costs_only_the_damaged_record(spark, tmp_path):
    pick, folder = random.Random(1), tmp_path / "w"
    rows = [(i, f"http://h/{i}", "".join(pick.choice("abc <>") for _ in range(400)), "", "") for i in range(40)]
    warc.write_archives(pages(spark, rows).coalesce(1), f"file://{folder}")
    (path,) = Path(folder).glob("*.warc.gz")
    whole = path.read_bytes()
    spans = [(a, b) for kind, a, b, _, _ in warc.salvage(whole)]
    bad = bytearray(whole)
    bad[spans[5][0] + 60] ^= 255  # inside a member
    bad[spans[9][0]] ^= 255  # its first byte
    text = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:skyloom:page:77>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    damaged = bytes(bad[: spans[20][0]]) + b"junk \x1f\x8b\x08 junk WARC/1 junk" + bytes(bad[spans[20][0] :]) + text + bytes(whole[:100])
    found = list(warc.salvage(damaged))
    assert [a for kind, a, *_ in found if kind == "record"][:5] == [a for a, _ in spans[:5]]
    assert sum(kind == "record" for kind, *_ in found) == 40 - 2 + 1
    covered = sorted((a, b) for _, a, b, _, _ in found)
    assert covered[0][0] == 0 and covered[-1][1] == len(damaged) and all(x[1] == y[0] for x, y in zip(covered, covered[1:]))
    assert [b"".join([x[4]]) for x in found if x[3].get("warc-record-id") == "<urn:skyloom:page:77>"] == [b"hi"]
    path.write_bytes(damaged)
    records, gaps = warc.read_archives(spark, f"file://{folder}")
    # the added plain record has no payload digest, so it is logged as a gap
    assert records.count() == 38 and gaps.count() == sum(kind == "gap" for kind, *_ in found) + 1
    assert list(warc.salvage(b"")) == [] and [x[:3] for x in warc.salvage(b"nothing here")] == [("gap", 0, 12)]


@pytest.mark.parametrize("bad", [(), (0,), (1,), (2,), (0, 1), (0, 2), (0, 1, 2)])
def test_damage_inside_a_member_costs_only_its_records(spark, tmp_path, bad):
    records = [bytearray(gzip.decompress(warc.record(i, f"http://h/{i}", text, hashlib.sha1(text).hexdigest(), None))) for i in range(3) for text in [b"payload %d" % i]]
    for k in bad:
        records[k][-6] ^= 1  # in the block: its digest fails
    alone = warc.record(9, "http://h/9", b"nine", hashlib.sha1(b"nine").hexdigest(), None)
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(b"".join(records)) + alone)
    found, gaps = warc.read_archives(spark, f"file://{tmp_path}")
    assert [r["page_id"] for r in found.collect()] == [k for k in range(3) if k not in bad] + [9]
    assert gaps.count() == (2 if bad == (0, 2) else min(len(bad), 1))


def test_heads_of_any_length_are_records(spark, tmp_path):
    rows = [(1, "https://a.example/" + "q" * 3_000_000, "<p>one</p>"), (2, None, "<p>two</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/heads"
    warc.write_archives(pages, folder)
    records, gaps = warc.read_archives(spark, folder)
    assert {r["page_id"]: len(r["url"] or "") for r in records.collect()} == {1: len(rows[0][1]), 2: 0} and gaps.isEmpty()


def test_a_lost_page_stops_the_query(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "u", "<p>one</p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    written = warc.record
    monkeypatch.setattr(warc, "record", lambda *a: written(*a)[:-3])
    with pytest.raises(Exception, match="a record is lost"):
        warc.op8_warc(spark, str(tmp_path)).collect()


# ---- op5

FRAME = """<html><head><title>T</title><style>p{{}}</style></head><body class="x">
<header><h1>Site</h1></header><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="wrap"><div class="{holder}">{body}</div><aside>Side <p>bar text that is long, long, long</p></aside></div>
<div id="comments"><article><p>A reader says a lot of things here, more than the text has.</p></article></div>
<form><p>Sign up</p></form><footer>Foot &copy;</footer><script>var t = "<p>no</p>";</script></body></html>"""


def test_main_text_of_a_page():
    body = "<h2>A &amp; B</h2><p>One\n  two&nbsp;<b>three</b></p><p>four<br>five<ul><li>x<li>y</ul><!-- <p>no</p> --><div class='ad'>Buy</div><p>a <a href='/'>link</a> &lt;b&gt;"
    text = html_text.Page(FRAME.format(holder="story-12", body=body)).main_text(None)
    assert text == "A & B\nOne two three\nfour five\nx\ny\na link <b>"


@pytest.mark.parametrize("source", ["", "<", "<p", "<<>>", "</div></p>", "<p>a", "<b><p>x</b>y", "<a href='" + "q" * 50_000, "<div>" * 3000 + "z", "<script>never ends", "<!-- never ends <p>a"])
def test_broken_pages_do_not_fail(source):
    assert isinstance(html_text.Page(source).main_text("/body"), str)


LONG = "Some words of the story. " * 60
PARTS = f"<h1>Title</h1><p>The lead of it</p><section><p>{LONG}</p></section><section><p>{LONG}</p></section><p>The end</p>"
BODY = f"<h1>Title</h1><p>The lead of it</p><div class='entry-content'><p>{LONG}</p><p>{LONG}</p></div><p>The end</p>"


@pytest.mark.parametrize("parts", [PARTS, BODY])
@pytest.mark.parametrize("holder", ["article", "main", "div", "section"])
def test_title_and_lead_beside_the_containers(parts, holder):
    other = f"<div class='teasers'><p>{LONG[:200]}</p></div>"
    page = html_text.Page(f"<body><div class='page'>{other}<{holder} class='x'>{parts}</{holder}></div></body>")
    want = "\n".join(["Title", "The lead of it", LONG.strip(), LONG.strip(), "The end"])
    assert page.main_text(None) == want
    assert all(page.main_text(path) == want for path in page.scores() if "x" in path)


def test_title_and_lead_in_the_body():
    lead, other = "The lead of this story, which is a sentence.", "<div class='teasers'><p>Other</p></div><a href='/'>Home</a>"
    body = BODY.replace("The lead of it", lead).replace("The end", lead)
    text = html_text.Page(f"<body>{other}{body}</body>").main_text(None)
    assert text == "\n".join(["Title", lead, LONG.strip(), LONG.strip(), lead])


NAMES = [
    "class='layout with-sidebar'", "class=no-sidebar", "class='elementor-widget-text-editor'", "class='post category-social'",
    "class='comments-open'", "id='related-work'", "title='the hidden one'", "class='sidebar-page'", "class=widget", "class='page-header'",
]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("tag", ["div", "section", "article", "main", "td", "body"])
def test_names_of_wrappers_keep_the_article(name, tag):
    side = "<div class='site-sidebar'><p>Side</p></div><ul id='main-nav'><li>Menu</ul><p hidden>No</p><div class='related-posts'>More</div>"
    open_, close = ("<table><tr>", "</table>") if tag == "td" else ("", "")
    page = html_text.Page(f"<body>{open_}<{tag} {name}><h1>Title</h1><p>{LONG}</p>{side}<p>The end</p></{tag}>{close}</body>")
    assert page.main_text(None) == f"Title\n{LONG.strip()}\nThe end"


def test_parts_of_an_article_are_not_dropped_for_a_modifier():
    parts = "".join(f"<div {n}><p>part {k}</p></div>" for k, n in enumerate(NAMES[:7]))
    text = html_text.Page(f"<body><article>{parts}<p>{LONG}</p></article></body>").main_text(None)
    assert text == "\n".join([*(f"part {k}" for k in range(7)), LONG.strip()])


def test_containers_of_containers_keep_their_score():
    page = html_text.Page("<body><div class=a><div class=b><p>" + "b" * 100 + "</div><div class=c><p>" + "c" * 90 + "</div></div>")
    assert page.scores() == {"/body/div.a": 95, "/body/div.a/div.b": 100, "/body/div.a/div.c": 90}
    assert html_text.Page("<article><p>a</p>" + "<div class=x>" * 3000 + LONG).main_text(None) == "a\n" + LONG.strip()


@pytest.mark.parametrize("size", [100, 8192, 8193, 10_000, 1_000_000])
@pytest.mark.parametrize("quote", ["'", '"'])
def test_attributes_of_any_length(size, quote):
    long = f"{quote}{'<p> d>' * (size // 6)}{quote}"
    source = f"<div class='story'><p>one<img src={long}>two</p><div data-x={long} class='nav'><p>Menu</p></div><p>three</p></div>"
    assert html_text.Page(source).main_text(None) == "onetwo\nthree"


@pytest.mark.parametrize("part", ["<a href=\"", "<a b='", "<a ", "<p a=\"x", "<a b='\" "])
def test_quotes_that_stay_open_take_linear_time(part):
    assert isinstance(html_text.Page(part * 20_000 + "'\">").main_text(None), str)
    assert "left <a b=" in html_text.Page("<p>left <a b='c>right").main_text(None)


def test_hosts_vote_and_every_row_gets_a_text(spark):
    long, short = "<p>" + "words of the story " * 20 + "</p>", "<p>tiny</p>"
    rows = [(i, "https://a.org/x", FRAME.format(holder=f"post-{i}", body=long * 3), "own", "t") for i in range(5)]
    # alone, this page's best container would be the long list beside its story
    beside = FRAME.format(holder="post-9", body=long).replace("<aside>", "<div class='list'>" + "<p>other text, not of it</p>" * 40 + "</div><aside>")
    rows += [(5, "https://a.org/y", beside, "", ""), (6, "https://a.org/z", None, "", ""), (7, None, short, "", ""), (7, None, short, "", ""), (8, "https://a.org/q", "<p>no container of the host</p>", "", "")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, voted string, text string")
    chosen = {r["host"]: r["voted"] for r in html_text.winners(html_text.votes(table)).collect()}
    assert chosen["a.org"].endswith("div.wrap/div.post-#")
    got = html_text.main_texts(table).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by_id = {r["page_id"]: r["text"] for r in got}
    story = ("words of the story " * 20).strip()
    assert by_id[0] == "\n".join([story] * 3) and by_id[6] == "" and by_id[7] == "tiny"
    assert by_id[8] == "no container of the host"
    assert html_text.main_texts(table.limit(0)).count() == 0


# ---- op9

URLS = [
    None, "", "no scheme", "://", "http://", "https://Example.ORG/es/x?a=1", "http://www.example.org/en/12", "http://example.org/en/2",
    "http://example.org", "http://notexample.org/es/", "https://shop.com/fr/a#b", "https://shop.com/de/", "https://shop.com?u=http://a.org/", "ftp://x.net/a/b.html",
    "http://ÄB.com/de/x", "HTTP://a.ORG/",
]


def plain_judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = (None, "allow")
    for verdict, h, p in url_rules.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and len(h + p) > len(best[0] or ""):
            best = (h + p, verdict)
    return host, path, *best


def test_rules_fit_as_written(spark):
    table = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    mined = url_rules.mine(spark.createDataFrame([], "url string, bad boolean"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judged(table, mined).collect()}
    assert got == {i: plain_judged(u) for i, u in enumerate(URLS)}


def test_mined_rules_equal_brute_force(spark):
    pick = random.Random(2)
    rows = []
    for _ in range(300):
        host, word, key = pick.choice(["a.net", "b.net", "spam.net"]), pick.choice(["win", "news", "log"]), pick.choice(["", "?ref=x"])
        bad = host == "spam.net" and word == "win" or pick.random() < 0.1
        rows.append((f"http://{host}/{word}/{pick.randint(1, 99)}{key}", bad))
    table = spark.createDataFrame([*rows, ("http://a.net/", None), (None, True)], "url string, bad boolean")
    tokens = [tuple(r[0]) for r in table.where("bad is not null and url is not null").select(url_rules.tokens(table["url"])).collect()]
    bads = [b for _, b in rows]
    fits = {}
    for size in range(1, 8):
        for needs in itertools.combinations(sorted({t for x in tokens for t in x}), size):
            have = [b for x, b in zip(tokens, bads) if set(needs) <= set(x)]
            base = sum(bads) / len(bads)
            if have and sum(have) / len(bads) >= 0.05 and sum(have) / len(have) >= 0.6 and sum(have) / len(have) / base >= 1.5:
                fits[frozenset(needs)] = True
    least = {n for n in fits if not any(m < n for m in fits)}
    mined = url_rules.mine(table, min_support=0.05)
    assert {frozenset(r["needs"]) for r in mined.collect()} == least and least
    assert all(r["filed_under"] in r["needs"] for r in mined.collect())
    asked = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)] + [(0, rows[0][0])], "page_id long, url string")
    out = url_rules.judged(asked, mined).collect()
    assert len(out) == len(rows) + 1
    for r in out:
        assert r["mined"] == any(n <= set(tokens[r["page_id"]]) for n in least)
        assert r["verdict"] == ("block" if r["mined"] else "allow")
