import json
import random

import pytest

from tapebook.llm import chat, wrappers

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{x:"</p>"}}</style><script>var a = "<p>no</p>";</script></head><body><header>Head</header>
<nav><ul><li><a href="/a">A</a></li><li>B</ul></nav><!-- c <p>no</p> --><div class="cookie-notice">we use</div><div class="ad">Buy <b>now</b></div>
<article><h1>{h}</h1>{body}</article><aside class="sidebar"><p>side</p></aside><form><input value="x"><p>mail</p></form>
<section class="comments"><article class="comment"><p>first!</p></article></section><footer>&copy; me</footer></body></html>"""
CASES = [
    (PAGE.format(h="T &amp; t", body="<p>one&nbsp;  two\n<a title='x>y' href=z>link</a>.<p><b>bold<br><p>x &lt;y&gt; &amp;amp;</p>"), "T & t\none two link.\nbold\nx <y> &amp;"),
    (PAGE.format(h="", body="<p>only</p><ul><li>a<li>b<aside>no</aside></ul><div class='ads'>no</div><p>z"), "only\na\nb\nz"),
    (PAGE.format(h="Cut", body="<p>start of &#233;<table><tr><td>c1<td>c2</table>")[:-80], "Cut\nstart of é\nc1\nc2"),
    ("<html><body><main><p>main text</p></main><footer>f</footer>", "main text"),
    ("<div><p>bare</p><p>words</p></div><footer>f</footer>", "bare\nwords"),
    ("plain text, no tags &amp; none", "plain text, no tags & none"),
    ("", ""), (None, ""), ("<<>< a <b", "<<>< a <b"), ("<article>" * 50 + "deep", "deep"),
]


@pytest.fixture
def pages_of(spark):
    return lambda rows: spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, text string, _wrapper string")


def test_pages(spark, pages_of):
    rows = [(i, f"http://h{i}.example.org/x", h) for i, (h, _) in enumerate(CASES)] + [(100, None, CASES[0][0]), (None, "no url", CASES[1][0])]
    got = {r["page_id"]: r for r in wrappers.report(pages_of(rows)).collect()}
    for i, (_, want) in enumerate(CASES):
        assert (got[i]["text"], got[i]["n_chars"]) == (want, len(want)), i
    assert got[100]["text"] == CASES[0][1] and got[None]["text"] == CASES[1][1] and got[3]["url"] == "http://h3.example.org/x"
    assert wrappers.report(pages_of([])).count() == 0


def test_one_host_of_many_shapes(spark, pages_of):
    rows = [(i * 10 + k, "https://Same.example.org:80/p?x", CASES[k][0]) for i in range(4) for k in range(3)]
    got = {r["page_id"]: r["text"] for r in wrappers.report(pages_of(rows)).collect()}
    assert all(got[i * 10 + k] == CASES[k][1] for i in range(4) for k in range(3))
    assert wrappers.infer(pages_of(rows)).count() == 1


def test_wrappers_say_what_pages_share():
    one, two = (wrappers.skeleton(wrappers.parse(p)) for p in ("<div><h1>a</h1><p>b<p>c</div>", "<div><p>x<ul><li>y</ul><p>z</div>"))
    assert wrappers.expression(one) == "<div><h1>a</>(<p>b|c</>)+</>"
    assert wrappers.expression(two) == "<div>(<p>x|z</>(<ul><li>y</></>)?)+</>"
    both = wrappers.align(one, two)
    assert wrappers.expression(both) == "<div>(<h1>a</>)?(<p>TEXT</>(<ul><li>y</></>)?)+</>" and wrappers.align(both, one) == both


def test_any_order_of_alignment_covers_every_page():
    r = random.Random(2)

    def page():
        def some(depth):
            return "".join(f"<{t}>{some(depth - 1) if depth else 'w'}</{t}>" for t in r.choices(["div", "section", "p", "ul"], k=r.randrange(4)))

        return f"<body><article>{some(3)}</article></body>"

    for _ in range(60):
        pages = [page() for _ in range(6)]
        nodes = None
        for p in pages:
            s = json.loads(json.dumps(wrappers.skeleton(wrappers.parse(p))))
            nodes = s if nodes is None else wrappers.align(nodes, s)
        assert all(wrappers.covers(nodes, p) for p in pages)


def site(n, notice="<div class='x7'>Share this story with your friends</div>"):
    """Pages of one host: a site's head line and a notice inside the article, in elements whose names say nothing."""
    r = random.Random(9)
    words = lambda k: " ".join(f"w{r.randrange(500)}" for _ in range(k))
    out = []
    for k in range(n):
        body = [words(r.randrange(5, 40)) for _ in range(r.randrange(1, 6))]
        parts = "".join(f"<p>{b}</p>" for b in body)
        out.append((k, "http://site.example/a", f"<body><div class='top'>The Daily Site</div><article><h1>T{k}</h1>{parts}{notice}</article></body>", "\n".join([f"T{k}", *body])))
    return out


def test_a_notice_that_stands_on_every_page_is_the_template_s(spark, pages_of):
    pages = site(40)
    got = {r["page_id"]: r["text"] for r in wrappers.report(pages_of([p[:3] for p in pages])).collect()}
    assert all(got[k] == want for k, _, _, want in pages)
    alone = [wrappers.read(h, json.dumps(wrappers.skeleton(wrappers.parse(h)))) for _, _, h, _ in pages]
    assert sum(a != want for a, (*_, want) in zip(alone, pages)) == 40  # one page's own wrapper cannot know
    few = {r["page_id"]: r["text"] for r in wrappers.report(pages_of([p[:3] for p in pages[:11]])).collect()}
    assert all(few[k] == want + "\nShare this story with your friends" for k, _, _, want in pages[:11])
    copies = [(k, u, h) for k in range(50) for _, u, h, _ in pages[:1]]  # one page fifty times is one page
    assert {r["text"] for r in wrappers.report(pages_of(copies)).collect()} == {pages[0][3] + "\nShare this story with your friends"}


def test_pages_without_an_article_lose_the_site_s_own_texts(spark, pages_of):
    r = random.Random(3)
    rows, want = [], {}
    for k in range(30):
        body = [" ".join(f"w{r.randrange(300)}" for _ in range(20)) for _ in range(3)]
        rows.append((k, "http://plain.example/", f"<body><div class='a'>Plain News</div><div class='b'>{''.join(f'<div>{b}</div>' for b in body)}</div><div class='c'>Written in Plainville</div></body>"))
        want[k] = "\n".join(body)
    got = {x["page_id"]: x["text"] for x in wrappers.report(pages_of(rows)).collect()}
    assert got == want


def test_names_inside_the_article(spark, pages_of):
    page = """<body><header>Site</header><article><header><h1>Title</h1></header><p>a</p><section class="content related-work"><p>b</p></section>
    <div class="share-price"><p>c</p></div><p class="menu">d</p><div class="share">no</div><footer>no</footer></article></body>"""
    got = wrappers.report(pages_of([(1, "http://x.example/", page), (2, None, page)])).collect()
    assert {r["text"] for r in got} == {"Title\na\nb\nc\nd"}


def read_alone(page):
    return wrappers.read(page, json.dumps(wrappers.skeleton(wrappers.parse(page))))


@pytest.mark.parametrize("name", ["comment-section", "reader-comments", "user-comments", "ad-slot", "promo-box", "site-notice", "related-posts", "adSlot", "ad_unit_12", "share-bar top"])
def test_names_made_of_telling_words(name):
    assert read_alone(f"<body><article><p>a</p><div class='{name}'><p>no</p></div><p>b</p></article></body>") == "a\nb"


@pytest.mark.parametrize("name", ["related-work", "share-price", "notice-of-meeting", "address", "adapter", "layout-with-sidebar", "post-list", "comments-open", "sectionTop"])
def test_names_that_only_look_so(name):
    assert read_alone(f"<body><article><p>a</p><div class='{name}'><p>c</p></div><p>b</p></article></body>") == "a\nc\nb"


@pytest.mark.parametrize("depth", [1, 90, 95, 96, 97, 98, 99, 100, 101, 150, 2000])
def test_depth_changes_nothing(depth):
    inner = "<p>a</p>b<nav><div><p>no</p></div><nav>no</nav></nav><form>no</form><ul><li>c<li>d</ul><div class='ad-slot'><div>no</div>no</div>e"
    assert read_alone("<body><article>" + "<div>" * depth + inner + "</div>" * depth + "<p>f</p></article><footer>no</footer></body>") == "a\nb\nc\nd\ne\nf"


HOSTILE = {
    "unclosed tags": "<a " * 350_000, "one long tag": "<a " * 350_000 + ">", "quotes": "<a '>'" * 100_000, "open quotes": '<a "' * 200_000 + ">", "comments": "<!--" * 200_000,
    "deep": "<div>" * 10_000 + "deep" + "</div>" * 10_000, "deep and open": "<div><p>" * 10_000, "scripts": "<script>" * 100_000, "ends": "</div>" * 100_000,
    "many names": "<ul>" + "".join(f"<li class={chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}>x</li>" for i in range(5000)) + "</ul>",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    import time

    page = HOSTILE[name]
    began = time.process_time()
    text = wrappers.read(page, json.dumps(wrappers.skeleton(wrappers.parse(page))))
    assert time.process_time() - began < 20
    assert name != "deep" or text == "deep"


def test_stray_quotes_leave_no_markup():
    said = lambda h: wrappers.read(h, json.dumps(wrappers.skeleton(wrappers.parse(h))))
    assert said('<p class="x>one') == "one" and said('<p class="x>one</p><p>two</p>') == "one\ntwo" and said("<p title=it's>one</p>") == "one" and said("<p title='x>y' lang=\"a>b\">one") == "one"


@pytest.mark.parametrize("fan", [2, 1000])
def test_hosts_are_folded_as_a_tree(spark, pages_of, fan):
    pages = site(40)
    rows = pages_of([p[:3] for p in pages] + [(99, "http://other.example", "<p>x</p>")]).repartition(20)
    found = {r["host"]: json.loads(r["wrapper"]) for r in wrappers.infer(rows, fan).collect()}
    assert found.keys() == {"site.example", "other.example"} and all(wrappers.covers(found["site.example"], p[2]) for p in pages)
    assert "Share this story with your friends" in wrappers.expression(found["site.example"]) and "T1" not in wrappers.expression(found["site.example"])


def text_by_parser(page):
    """The given pages' articles by the standard library's parser: blocks are what stands between block tags."""
    from html.parser import HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.out, self.held = 0, [], []

        def flush(self):
            if (t := " ".join("".join(self.held).split())) and self.depth:
                self.out.append(t)
            self.held = []

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.held.append(" ")
            elif tag not in ("b", "i", "em", "a", "span", "strong"):
                self.flush()
            self.depth += tag == "article"

        def handle_endtag(self, tag):
            if tag not in ("b", "i", "em", "a", "span", "strong"):
                self.flush()
            self.depth -= tag == "article"

        def handle_data(self, data):
            self.held.append(data)

    p = P()
    p.feed(page)
    p.close()
    return "\n".join(p.out)


def test_pages_query_against_another_parser(spark, sf):
    from tapebook.llm import queries

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in queries.op8_wrappers(spark, sf).collect()}
    assert got.keys() == pages.keys()
    assert all(got[k]["text"] == text_by_parser(h) and got[k]["n_chars"] == len(got[k]["text"]) for k, h in pages.items())


# ---------------------------------------------------------------- chat

SCHEMA = {"f": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"type": "string", "maxLength": 2}}, "c": {"enum": ["x"]}}}}


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a, "after": list(after)} for i, n, a, after in calls]})


def result(i, text):
    return json.dumps({"tool_call_id": i, "content": text})


def test_schemas():
    bad = chat.errors({"a": 0, "b": ["x", "long", 3], "c": "y", "d": 1}, SCHEMA["f"])
    assert bad == ["$.a: too small", "$.b[1]: too long", "$.b[2]: not string", "$.c: not one of the values", "$.d: unknown"]
    assert chat.errors({}, SCHEMA["f"]) == ["$.a: missing"] and chat.errors([], SCHEMA["f"]) == ["$: not object"] and chat.errors({"a": True}, SCHEMA["f"]) == ["$.a: not integer"]
    assert chat.canonical({"b": 1, "a": "é"}) == '{"a":"é","b":1}'


def test_linking(spark):
    rows = [
        (1, 0, "user", "hello"), (1, 1, "assistant", call(("c1", "f", '{"a": 1}', ["c2"]), ("c2", "f", "{", []), ("c1", "f", '{"a": 9}', []))),
        (1, 2, "tool", result("c1", "r1")), (1, 3, "tool", result("c1", "again")), (1, 4, "tool", result("zz", "lost")), (1, 5, "assistant", call(("c3", "g", None, ["c1"]))), (1, 5, "tool", result("c3", "too early")),
        (2, 0, "assistant", call(("x", "f", '{"b": [], "a": 2}', ["y"]), ("y", "f", '{"a": 3}', ["x"]), ("z", "f", '{"a": 4}', []))), (2, 1, "tool", result("z", "ok")),
        (None, 0, "assistant", call(("n", "f", '{"a": 5}', []))), (None, 1, "tool", result("n", None)), (3, None, None, None), (4, 0, "assistant", "no JSON"), (4, 1, "tool", "{"), (4, 2, "assistant", ""),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, level int, status string")
    got = {(r["conv_id"], r["call_id"]): r for r in chat.link(df, SCHEMA).collect()}
    say = {k: (r["status"], r["level"], len(r["errors"]), r["duplicates"]) for k, r in got.items()}
    assert say == {
        (1, "c1"): ("linked", 1, 0, 2), (1, "c2"): ("unanswered", 0, 1, 0), (1, "c3"): ("early", 2, 1, 0), (1, "zz"): ("orphan", 0, 0, 0),
        (2, "x"): ("cyclic", None, 0, 0), (2, "y"): ("cyclic", None, 0, 0), (2, "z"): ("linked", 0, 0, 0), (None, "n"): ("linked", 0, 0, 0),
    }
    assert got[1, "c1"]["record"] == '{"after":["c2"],"arguments":{"a":1},"id":"c1","name":"f","result":"r1"}'
    assert chat.link(df.limit(0), SCHEMA).count() == 0


def reach(needs, start):
    seen, todo = set(), [start]
    while todo:
        for x in needs.get(todo.pop(), ()):
            if x not in seen and x in needs:
                seen.add(x)
                todo.append(x)
    return seen


@pytest.mark.parametrize("density", [0.06, 0.2])
def test_order_against_brute_force(spark, density):
    """Needs at random, cycles among them: the order, slots and what is cyclic."""
    r = random.Random(6)
    rows, deps = [], {}
    for conv in range(10):
        order = list(range(12))
        r.shuffle(order)
        place = {c: k for k, c in enumerate(order)}
        for c in range(12):
            deps[conv, c] = [x for x in range(12) if (place[x] < place[c] or conv > 6 and r.random() < 0.15) and r.random() < density]
            rows.append((conv, c, "assistant", call((str(c), "f", "{}", [*map(str, deps[conv, c]), "elsewhere"]))))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {(x["conv_id"], int(x["call_id"])): x for x in chat.link(df, SCHEMA).collect()}
    needs = {k: [(k[0], x) for x in v] for k, v in deps.items()}
    far = {k: reach(needs, k) for k in needs}
    cyclic = {k for k in needs if k in far[k] or any(x in far[x] for x in far[k])}
    assert len(out) == 120 and {k for k, x in out.items() if x["status"] == "cyclic"} == cyclic and (cyclic or density < 0.1)
    key = lambda k: (tuple(out[k]["slot"]), out[k]["level"], out[k]["turn"], out[k]["pos"])
    for k in needs:
        assert out[k]["slot"]["turn"] == max([k[1], *(x[1] for x in far[k])])
        assert k in cyclic or all(key(x) < key(k) for x in needs[k])


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A hundred calls that each need the next one: by the logarithm of a hundred."""
    rounds, plain = [], chat.write_table
    monkeypatch.setattr(chat, "write_table", lambda df, label: (rounds.append(label), plain(df, label))[1])
    rows = [(1, t, "assistant", call((f"c{t}", "f", "{}", [f"c{t + 1}"]))) for t in range(100)]
    out = {r["turn"]: r for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMA).collect()}
    assert all(r["slot"]["turn"] == 99 and r["level"] == 99 - t for t, r in out.items()) and len(rounds) <= 2 * 10


def test_what_may_not_crash_it(spark):
    from decimal import Decimal

    deep = "[" * 100_000 + "]" * 100_000
    args = ['{"a": 1, "s": "\\ud800"}', deep, '{"a": NaN}', '{"a": Infinity}', '{"a": 1e999}', '{"\\udfff": 1, "a": 2}', "", None, "7", '"x"']
    calls = [{"id": f"c{k}", "name": "f", "arguments": a, "after": [None, "c0", None, "c0"]} for k, a in enumerate(args)]
    text = json.dumps({"tool_calls": calls})
    for kind, ids in (("long", [-1, None]), ("string", ["", None, "-", "="]), ("decimal(10,2)", [Decimal("-1.00"), None]), ("binary", [b"\xff", None])):
        rows = [(i, 0, "assistant", text) for i in ids] + [(i, 1, "tool", result("c0", "r")) for i in ids]
        out = chat.link(spark.createDataFrame(rows, f"conv_id {kind}, turn long, role string, text string"), SCHEMA).collect()
        assert len(out) == len(ids) * len(args) and {(None if r["conv_id"] is None else bytes(r["conv_id"]) if kind == "binary" else r["conv_id"]) for r in out} == set(ids)
        mine = {r["call_id"]: r for r in out if r["conv_id"] is None}
        assert mine["c0"]["status"] == "cyclic" and mine["c1"]["errors"] == mine["c2"]["errors"] == mine["c3"]["errors"] == mine["c4"]["errors"] == ["$: no JSON"]
        for r in out:
            assert json.loads(r["record"], parse_constant=lambda x: 1 / 0)["after"] == ["c0"]
        assert mine["c5"]["errors"] == ["$.\\udfff: unknown"] and mine["c8"]["errors"] == ["$: not object"]


def brute_link(messages, schemas):
    """The linking by plain dictionaries: (conv, id) -> (turn, slot turn, status, duplicates, errors, record)."""
    first, again, answer, more = {}, {}, {}, {}
    for conv, turn, role, text in sorted(messages, key=lambda m: (m[0], m[1])):
        if role == "assistant":
            for pos, c in enumerate(json.loads(text)["tool_calls"]):
                k = (conv, c["id"])
                again[k] = again.get(k, -1) + 1
                first.setdefault(k, (turn, pos, c))
        else:
            r = json.loads(text)
            k = (conv, r["tool_call_id"])
            more[k] = more.get(k, -1) + 1
            answer.setdefault(k, (turn, r["content"]))
    needs = {k: [(k[0], x) for x in c["after"]] for k, (_, _, c) in first.items()}
    out = {}
    for k in first.keys() | answer.keys():
        if k not in first:
            out[k] = (answer[k][0], answer[k][0], "orphan", more[k], [], chat.canonical({"id": k[1], "result": answer[k][1]}))
            continue
        turn, _, c = first[k]
        far = reach(needs, k)
        status = "cyclic" if k in far or any(x in reach(needs, x) for x in far) else "unanswered" if k not in answer else "early" if answer[k][0] <= turn else "linked"
        value = json.loads(c["arguments"])
        bad = chat.errors(value, schemas[c["name"]]) if c["name"] in schemas else [f"$: no tool {c['name']}"]
        record = {"id": k[1], "result": answer.get(k, (0, None))[1], "name": c["name"], "arguments": value, "after": sorted(set(c["after"]))}
        out[k] = (turn, max([turn, *(first[x][0] for x in far)]), status, again[k] + more.get(k, 0), bad, json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
    return out


def test_query_against_brute_force(spark, sf):
    import hashlib

    talk = spark.read.parquet(f"{sf}/conversations.parquet")
    messages = [tuple(r) for r in chat.as_tool_messages(talk).select("conv_id", "turn", "role", "text").collect()]
    want = brute_link(messages, chat.TOOLS)
    got = {(r["conv_id"], r["call_id"]): r for r in chat.report(talk).collect()}
    assert got.keys() == want.keys() and len(got) > 50
    for k, (turn, slot, status, duplicates, bad, record) in want.items():
        r = got[k]
        assert (r["turn"], r["slot_turn"], r["status"], r["duplicates"], r["n_errors"], r["record_sha256"]) == (turn, slot, status, duplicates, len(bad), hashlib.sha256(record.encode()).hexdigest()), k
    assert {r["status"] for r in got.values()} >= {"linked", "orphan"}


def test_mixed_templates_on_one_host(spark):
    """Each page is read by the best kind of root that it has itself."""
    bodies = ["<nav>menu</nav><article><p>in article</p></article><div>aside text</div>", "<nav>menu</nav><main><p>in main</p></main>", "<nav>menu</nav><div class='post-content'><p>in post</p></div>", "<nav>menu</nav><p>bare</p>", "only text"]
    pages = [(k, url, f"<html><body>{b}</body></html>") for k, b in enumerate(bodies) for url in ("https://one.example/x", None)]
    out = wrappers.report(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    want = ["in article", "in main", "in post", "bare", "only text"]
    assert sorted((r["page_id"], r["text"]) for r in out) == [(k, w) for k, w in enumerate(want) for _ in range(2)]
