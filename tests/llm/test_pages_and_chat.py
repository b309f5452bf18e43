"""Page extraction and tool-call linking."""

import json

import pytest

from tidewatch.llm import host_paths, tool_calls

SHELL = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>if(a<b)"</p>"</script></head><body class="has-sidebar"><header><h1>Site</h1></header>'
    '<nav><ul><li><a href="/a">Menu one</a></li></ul></nav><!-- ad > --><div class="cookie-notice">We use cookies</div><div class="ad">Buy <b>this</b></div>'
    '{main}<aside><p>Side text that is fairly long, and longer still, and more of it here.</p></aside><form><p>Your mail</p><input name=x></form>'
    '<div id="comments"><p>{noise}</p></div><footer>&copy; us</footer></body></html>'
)
MAIN = '<div class="post post-{n}"><h2>A &lt;title&gt; {n}</h2><p>First <b>bo</b>ld &eacute;\n  and\tmore &amp; text<br>new line<p>Second, unclosed <a href="x>y">link</a><ul><li>x<li>y</ul></div>'
WANT = "A <title> {n} First bold é and more & text new line Second, unclosed link x y"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(n, f"https://a.example.org/p/{n}", SHELL.format(main=MAIN.format(n=n), noise="short"), "clash", 1) for n in range(20)]
    # more comments than article: the page alone would be in doubt, the host's path is not
    rows += [(20, "https://a.example.org/odd", SHELL.format(main='<div class="x"><p>' + "other words " * 40 + "</p></div>" + MAIN.format(n=20), noise="many words " * 90), "c", 1)]
    rows += [(21, "https://b.example.org/", "just text &amp; no tags", None, None), (22, None, None, None, None), (23, "", "", None, None), (24, "::", "<p>open <div", None, None),
             (None, "https://a.example.org/n", SHELL.format(main=MAIN.format(n=0), noise=""), None, None), (5, "https://a.example.org/p/5", SHELL.format(main=MAIN.format(n=5), noise="short"), "clash", 1),
             (25, "https://c.example.org/", "<article>" + "<p>long words here</p>" * 5000 + "</article>", None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, paths int")


def test_main_texts(pages):
    got = [r.asDict() for r in host_paths.main_texts(pages).collect()]
    assert len(got) == pages.count() and set(got[0]) == {"page_id", "url", "text", "n_chars"}
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
        assert r["n_chars"] == len(r["text"])
    for n in range(20):
        assert all(r["text"] == WANT.format(n=n) for r in by[n])
    assert len(by[5]) == 2 and by[20][0]["text"] == WANT.format(n=20) and by[None][0]["text"] == WANT.format(n=0)
    assert by[21][0]["text"] == "just text & no tags" and by[22][0]["text"] == "" == by[23][0]["text"]
    assert by[25][0]["text"] == " ".join(["long words here"] * 5000)
    assert host_paths.main_texts(pages.limit(0)).count() == 0


def test_the_whole_article_is_kept(spark):
    body, more = "<p>" + "body words " * 40 + "</p>", "<p>" + "more words " * 15 + "</p>"
    want = "Headline " + ("body words " * 40 + "more words " * 15).strip()
    menu = '<div class="links"><p><a href="/x">' + "another story " * 60 + "</a></p></div>"
    kinds = {
        "a": f"<main><article><h1>Headline</h1><div class=entry>{body}{more}</div></article>{menu}</main>",
        "b": f"<article><h1>Headline</h1><section class=a>{body}</section><section class=b>{more}</section></article>",
        "c": f"<div class=wrap><div class=post><h1>Headline</h1><div class=entry><section>{body}</section><section>{more}</section></div></div>{menu}</div>",
        "d": f"<main><h1>Headline</h1><div class=entry>{body}</div><div class=rest>{more}</div></main>",
    }
    rows = [(i, f"https://{k}.example.org/{i}", SHELL.format(main=m, noise="short")) for k, m in kinds.items() for i in range(5)]
    got = host_paths.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 20 and {r["url"]: r["text"] for r in got} == {u: want for _, u, _ in rows}


ARTICLE = "<h1>Head</h1>" + "<p>" + "running words here " * 30 + "</p>"
CLEAN = "Head " + ("running words here " * 30).strip()


@pytest.mark.parametrize("page", [
    f'<div class="content-sidebar-wrap"><main><article>{ARTICLE}</article></main><div class="sidebar"><p>{"side " * 40}</p></div></div>',
    f'<div class="layout has-sidebar"><article>{ARTICLE}</article></div><div class="sidebar">{"side " * 90}</div>',
    f'<div id="page" class="site with-nav"><article>{ARTICLE}</article></div>',
    f'<form action="/"><div><input name=q><label>Search here</label><button>Go</button></div><article>{ARTICLE}</article><div class="newsletter"><p>Your mail</p></div></form>',
    f'<form><div class="entry">{ARTICLE}</div></form><div class="promo">Buy this</div>',
    f'<div class="page nav-open">{ARTICLE}<div id="comments"><p>{"reader says " * 300}</p></div></div>',
    f'<article>{ARTICLE}<div class="share"><a href=x>Post</a> <a href=y>Mail</a></div></article><div id=comments><article class="comment-body"><p>{"reader says " * 200}</p></article></div>',
    f'<div class="related"><article class="teaser"><p>Another story</p></article></div><main>{ARTICLE}</main>',
    f'<article>{ARTICLE}<aside class="ad">Buy</aside><div class="newsletter"><p>{"subscribe now " * 10}</p></div></article>',
])
def test_articles_below_doubtful_containers(page):
    assert host_paths.extract(f"<html><body>{page}</body></html>", []) == CLEAN


def test_running_text_with_the_name_of_a_list():
    more = "<section class='market share'><p>" + "numbers grew again " * 10 + "</p></section>"
    got = host_paths.extract(f"<article>{ARTICLE}{more}<p>End.</p></article>", [])
    assert got == f"{CLEAN} {('numbers grew again ' * 10).strip()} End."


def test_winning_paths_are_those_of_the_host(pages):
    paths = {r["host"]: r["paths"] for r in host_paths.winning_paths(pages).collect()}
    assert paths["a.example.org"][0] == "body.has-sidebar>div.post.post-#"


def test_links_order_and_schemas(spark):
    calls = [
        ("c1", "a", 0, "add", '{"y": 2, "x": 1.5}', []), ("c1", "b", 1, "add", '{"x": "one", "z": [1,2]}', ["a"]), ("c1", "d", 2, "add", "no json", ["b", "a"]),
        ("c1", "e", 3, "add", '{"x":1,"y":null}', ["gone"]), ("c1", "a", 9, "add", "{}", []), ("c1", "f", 4, "sub", '{ "k" : {"b":1, "a":[true, null]} }', ["g"]),
        ("c1", "g", 5, "add", '{"x":1,"y":2}', ["f"]), ("c1", "h", 6, "add", None, ["g"]), ("c2", "a", 0, "add", '{"x":1,"y":2,"t":"\\u00e9\\n"}', None),
        ("c2", "a", 0, "add", '{"x":1,"y":2,"t":"\\u00e9\\n"}', None), (None, None, 0, None, "[1]", []),
    ]
    results = [("c1", "a", 10, "ok a"), ("c1", "a", 11, "late"), ("c1", "b", 12, None), ("c1", "zz", 13, "nobody asked"), ("c2", "a", 1, "ok"), ("c2", "a", 1, "ok")]
    schemas = spark.createDataFrame([("add", "x", "number", True), ("add", "y", "integer", True), ("add", "t", "string", False)], tool_calls.SCHEMA_COLUMNS)
    got = tool_calls.link(
        spark.createDataFrame(calls, "conv_id string, call_id string, position long, name string, arguments string, needs array<string>").withColumn("content", tool_calls.F.lit(1)),
        spark.createDataFrame(results, "conv_id string, call_id string, position long, content string").withColumn("name", tool_calls.F.lit(1)), schemas)
    rows = {(r["conv_id"], r["call_id"], r["position"]): r for r in got.collect()}
    assert len(rows) == got.count() == 11
    status = {k: (r["level"], r["status"], r["errors"], r["valid"]) for k, r in rows.items()}
    assert status["c1", "a", 0] == (0, "linked", "", True)
    assert status["c1", "b", 1] == (1, "linked", "missing y; unexpected z; x is string, not number", False)
    assert status["c1", "d", 2] == (2, "unanswered", "arguments are no JSON object", False)
    assert status["c1", "e", 3] == (0, "unanswered", "needs unknown call gone; y is null, not integer", False)
    assert status["c1", "a", 9][1] == "duplicate" and status["c1", "f", 4][:2] == (None, "cycle") and status["c1", "h", 6][1] == "cycle"
    assert status["c1", "zz", 13] == (None, "orphan", "", False) and status["c2", "a", 0] == (0, "linked", "", True)
    assert rows["c1", "a", 0]["canonical"] == '{"arguments":{"x":1.5,"y":2},"id":"a","name":"add","result":"ok a"}' and rows["c1", "a", 0]["n_results"] == 2
    assert json.loads(rows["c1", "f", 4]["canonical"])["arguments"] == {"k": {"a": [True, None], "b": 1}} and '{"k":{"a":[true,null],"b":1}}' in rows["c1", "f", 4]["canonical"]
    order = [r["call_id"] for r in sorted((r for k, r in rows.items() if k[0] == "c1"), key=lambda r: r["place"])]
    assert order.index("a") < order.index("b") < order.index("d")
    assert tool_calls.link(got.limit(0).select("conv_id", "call_id", "position", "name", tool_calls.F.lit("").alias("arguments"), tool_calls.F.array().cast("array<string>").alias("needs")),
                           spark.createDataFrame([], "conv_id string, call_id string, position long, content string"), schemas).count() == 0


def test_levels_equal_longest_paths(spark):
    import random

    rng = random.Random(4)
    edges, calls = [], [("chain", f"n{i}") for i in range(70)]
    edges += [("chain", f"n{i}", f"n{i - 1}") for i in range(1, 70)]
    for c in range(6):
        names = [f"m{i}" for i in range(25)]
        calls += [(f"g{c}", n) for n in names]
        for i in range(1, 25):
            edges += [(f"g{c}", names[i], names[j]) for j in rng.sample(range(i), min(i, rng.choice((0, 1, 1, 1, 2, 3))))]
    calls += [("loop", x) for x in "abcde"]
    edges += [("loop", "a", "b"), ("loop", "b", "c"), ("loop", "c", "a"), ("loop", "d", "a"), ("loop", "e", "d"), ("loop", "e", "e")]
    want = {}

    def level(conv, call, seen=()):
        if call in seen:
            return None
        up = [level(conv, n, (*seen, call)) for c, x, n in edges if c == conv and x == call]
        return None if None in up else 1 + max(up, default=-1)

    memo = {}
    for conv, call in calls:
        if conv == "chain":
            memo[conv, call] = int(call[1:])
        elif conv == "loop":
            memo[conv, call] = None
        else:
            ups = [memo[conv, n] for c, x, n in edges if c == conv and x == call]
            memo[conv, call] = 1 + max(ups, default=-1)
    want = {k: v for k, v in memo.items() if v is not None}
    assert all(level("loop", x) is None for x in "abcde")
    got = tool_calls.levels(spark.createDataFrame(calls, "conv_id string, call_id string"), spark.createDataFrame(edges, "conv_id string, call_id string, needs string"))
    rows = got.collect()
    assert len(rows) == len(want) and {(r["conv_id"], r["call_id"]): r["level"] for r in rows} == want
