"""The page parse against trees that the pages are written from."""

import random
from time import process_time

import pytest
from pyspark.sql import functions as F

from siftline.sources.pages import parse_page


def tree(rng, depth=0):
    """A random element as [tag, attributes, children]; children are texts or elements."""
    kinds = ["div", "span", "b", "article", "section", "ul", "table", "card", "a", "img"]
    kind = rng.choice(kinds if depth < 5 else ["span", "b", "img", "a"])
    inner = lambda: [rng.choice([f"w{rng.randint(0, 99)} ", "x", " ", "\n "]) if rng.random() < 0.5 else tree(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    if kind == "ul":
        return ["ul", {}, [["li", {}, inner()] for _ in range(rng.randint(1, 3))]]
    if kind == "table":
        rows = [["tr", {}, [[rng.choice(["td", "td", "th"]), {}, inner()] for _ in range(rng.randint(1, 3))]] for _ in range(rng.randint(1, 3))]
        return ["table", {}, rows]
    if kind == "img":
        return ["img", {"src": f"/i{rng.randint(0, 9)}"}, []]
    if kind == "a":
        return ["a", {"href": f"/p{rng.randint(0, 9)}"}, [f"t{rng.randint(0, 99)}"]]
    return ["div" if kind == "card" else kind, {"class": "card"} if kind == "card" else {}, inner()]


def written(node, rng):
    if isinstance(node, str):
        return node
    tag, have, children = node
    attributes = "".join(f' {k}="{v}"' for k, v in have.items())
    inner = "".join(written(x, rng) for x in children)
    # What HTML lets out: the end of items, rows and cells. A p of its own element doesn't occur here.
    end = "" if tag == "img" or tag in ("li", "tr", "td", "th") and rng.random() < 0.5 else f"</{tag}>"
    return f"<{tag}{attributes}>{inner}{end}"


BREAKS = {"div", "article", "section", "ul", "li", "table", "tr", "td", "th"}


def text(node):
    if isinstance(node, str):
        return node
    inner = "".join(map(text, node[2]))
    return f"\n{inner}\n" if node[0] in BREAKS else inner


def clean(node):
    return " ".join(text(node).split())


def below(node):
    for x in node[2]:
        if not isinstance(x, str):
            yield x
            yield from below(x)


def expected(root):
    every = list(below(root))
    first = lambda node, tag, name: next((f"http://a{x[1][name]}" for x in below(node) if x[0] == tag), None)
    blocks = [(x[0], clean(x), first(x, "a", "href"), first(x, "img", "src")) for x in every if x[0] in ("article", "li") or x[1].get("class") == "card"]
    tables = []
    for t in (x for x in every if x[0] == "table"):
        rows = [[clean(c) for c in below(r) if c[0] == "td"] for r in below(t) if r[0] == "tr"]
        tables.append(([clean(h) for h in below(t) if h[0] == "th"], [r for r in rows if r]))
    anchors = [(f"http://a{x[1]['href']}", clean(x)) for x in every if x[0] == "a"]
    return [b for b in blocks if b[1]], [t for t in tables if t[0] and t[1]], anchors, clean(root)


def test_random_trees():
    rng = random.Random(1)
    seen = 0
    for _ in range(1500):
        root = ["body", {}, [tree(rng) for _ in range(rng.randint(1, 4))]]
        got = parse_page("".join(written(x, rng) for x in root[2]), "http://a/")
        blocks, tables, anchors, whole = expected(root)
        document = got["document"]
        assert [(b["tag"], b["text"], b["href"], b["image_url"]) for b in document["blocks"]] == blocks
        assert [(t["headers"], t["rows"]) for t in document["tables"]] == tables
        assert [(s["href"], s["text"]) for s in got["signals"]] == anchors
        assert document["page_text"] == whole
        seen += sum(len(t[1]) for t in tables)
    assert seen > 500


def texts(html):
    return [b["text"] for b in parse_page(html, "http://a/")["document"]["blocks"]]


def test_implied_ends():
    assert texts("<ul><li>one <ul><li>two</li></ul> tail</li><li>three</ul>") == ["one two tail", "two", "three"]
    assert texts("<ul><li>one<li>two<p>in two<li>three</ul>after") == ["one", "two in two", "three"]
    assert texts("<ol><li>a<section><li>b</section>c</ol>") == ["a b c", "b"]
    assert texts("<li>a</ul></b></li>b") == ["a"]
    assert texts("<article>a</div></p>b</article>c") == ["a b"]
    assert texts('<p class="card">one<div>two</div>') == ["one"]
    assert texts("<article>never closed <b>bold") == ["never closed bold"]
    assert texts("<article><script>var x = '<li>no</li>'</script><style>li{}</style><template><li>no</li></template>yes</article>")[0] == "yes"


def test_cut_off():
    document = parse_page("<li>" + "ab " * 3000 + "</li>" + "<li>x</li>" * 600, "http://a/")["document"]
    assert len(document["blocks"]) == 500 and document["truncated"] and len(document["blocks"][0]["text"]) == 4000
    assert parse_page(None, None)["document"]["blocks"] == []
    assert parse_page("<a href='http://[x'>bad</a><li><a href='http://[x'>bad</a>", "http://a/")["signals"] == []


@pytest.mark.parametrize("unit", ["<article>a ", "<ul><li>a ", "<table><tr><td>a ", "<table><tr><th>h<td>a ", "<li>a", "<p>a", "<b>a", "</b></li></td>", "<span><li>", "<div><p>", "<b><table><td></b>"])
def test_time_is_linear(unit):
    def seconds(n):
        start = process_time()
        parse_page(unit * n, "http://a/")
        return process_time() - start

    seconds(100)
    assert seconds(20_000) < 40 * max(0.02, seconds(2_000))


def test_references_without_semicolon():
    html = '<h1>a &amp;&amp b&copy &lt;</h1><ul><li>x&amp<li><a href="/p?a=1&amp;b=2&copy=3">y&ampz</a></ul><script type="application/ld+json">{"a": "b && c&amp;"}</script>'
    as_html, closed = (parse_page(html, "https://a.example.com/", closed_references=x) for x in (False, True))
    assert as_html["document"]["page_text"] == "a && b© < x& y&z"
    assert closed["document"]["page_text"] == "a &&amp b&copy < x&amp y&ampz"
    assert [b["text"] for b in closed["document"]["blocks"]] == ["x&amp", "y&ampz"]
    assert closed["signals"][0]["href"] == "https://a.example.com/p?a=1&b=2&copy=3"
    assert closed["document"]["json_ld"] == as_html["document"]["json_ld"] == ['{"a": "b && c&amp;"}']


def test_parses_are_held_for_few_pages_at_once():
    import pyarrow as pa

    from siftline.sources.pages import _slices

    batch = pa.RecordBatch.from_pydict({"i": list(range(7)), "html": ["a" * 5, "b" * 5, None, "é" * 9, "", "c" * 3, "d" * 11]})
    assert [x.column("i").to_pylist() for x in _slices(batch, "html", 10)] == [[0, 1, 2], [3], [4, 5], [6]]
    assert [x.num_rows for x in _slices(batch.slice(0, 0), "html", 10)] == [0]


def test_nested_structures_parse_each_page_once_on_all_tasks(spark, tmp_path):
    from siftline import queries as engine

    spark.read.parquet("/root/testdata/sf0.001/part.parquet").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made = engine.QUERIES["nested_structures"](spark, str(tmp_path))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() >= 4


def test_whole_pages_are_not_cut():
    row = "<tr><td>" + "c" * 3000 + "<td>d"
    html = '<meta property="og:title" content="' + "t" * 3000 + '">' + "".join(f'<script type="application/ld+json">{i}</script><li>item {i}' for i in range(600)) + "x " * 150_000
    document = parse_page(html + f"<table><tr><th>h<th>k{row * 900}</table>" + "<table><tr><th>h<td>x</table>" * 600, "http://a/", whole=True)["document"]
    assert [b["text"][:8] for b in document["blocks"]][:-1] == [f"item {i}" for i in range(599)] and document["json_ld"] == [str(i) for i in range(600)]
    assert document["tables"][0]["rows"] == [["c" * 3000, "d"]] * 900 and len(document["tables"]) == 601
    assert len(document["page_text"]) > 3_000_000 and len(dict(document["open_graph"])["title"]) == 3000 and not document["truncated"]
