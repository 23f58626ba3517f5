from __future__ import annotations

import gzip
import hashlib
import io
import random
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import chat, html_text, warc
from spanloom.llm.common import shared_dir
from spanloom.llm.registry import ORACLES, QUERIES
from tests.oracle import by_sql, normal


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    assert normal(QUERIES[name](spark, small).toPandas()) == normal(by_sql(ORACLES[name], small))


# pages

P1, P2 = "The mill stood by the river, and nobody knew how old it was; some said two hundred years.", "Its wheel turned at night, they said, whether or not there was water in the race."


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("body", "blocks"),
    [
        (f"<nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Mill</h1><p>{P1}</p><p>{P2}</p></article><footer>&copy; us</footer>", ["Mill", P1, P2]),
        (f"<div class='ad'>Buy, buy, buy</div><article><p><b>{P1}<br><p>{P2}</article>", [P1, P2]),
        (f"<header><h1>Site</h1></header><main><header><h1>Mill</h1></header><section><p>{P1}</p></section><section><p>{P2}</p><p>Short.</p></section></main>", ["Mill", P1, P2, "Short."]),
        (f"<div id=content><h2>Mill</h2><p>{P1}</p><p>{P2}</p></div><div id=comments><p>I like it, really, very much indeed, and so on.</p></div><aside><p>{P1}</p></aside>", ["Mill", P1, P2]),
        (f"<div class='page with-sidebar'><article><p>{P1}</p><form><p>Mail me, please, {P2}</p></form></article><div class=sidebar>{P2}</div></div>", [P1]),
        (f"<article><p>A &amp;amp; B &lt;i&gt; caf&eacute; &#x41;&#66;\n\t  c</p><ul><li>one<li>two</ul><pre>x\n  y</pre><table><tr><td>1<td>2</table>{P1}</article>", ["A &amp; B <i> café AB c", "one", "two", "x y", "1", "2", P1]),
        (f"<div hidden>{P1}</div><article><p>{P2}</p><noscript>no</noscript><!-- {P1} --></article><div class='cookie-notice'>We use cookies, {P1}</div>", [P2]),
        ("Bare text", ["Bare text"]),
        ("<p></p> <div><br></div>", []),
    ],
)
def test_main_text(body, blocks):
    assert html_text.main_text(page(body)) == "\n\n".join(blocks)


FIVE = [f"{P1} {k}" for k in range(5)]
THREE = "".join(f"<p>{t}</p>" for t in FIVE[:3])
TWO = "".join(f"<p>{t}</p>" for t in FIVE[3:])


@pytest.mark.parametrize(
    ("body", "blocks"),
    [
        (f"<div><section>{THREE}</section></div><div><section>{TWO}</section></div>", FIVE),
        (f"<div><div><section>{THREE}</section></div></div><div><p>&copy; us</p></div>", FIVE[:3]),
        (f"<div><article>{THREE}</article></div><div><section>{TWO}</section></div>", FIVE[:3]),
        (f"<form><article>{THREE}</article></form>", FIVE[:3]),
        (f"<form><div id=content>{THREE}</div><input></form>", FIVE[:3]),
        (f'<div class="post social-issues">{THREE}</div>', FIVE[:3]),
        (f'<div id="search-results">{THREE}</div>', FIVE[:3]),
        (f'<div class="page-header-menu">{THREE}</div>', FIVE[:3]),
        (f'<article class="notice">{THREE}</article><footer>&copy; us</footer>', FIVE[:3]),
        (f"<div id=c><p>{P1}</p><p>{P2}</p></div><div class=comments>{THREE}{TWO}</div>", [P1, P2]),
        (f"<div class=comments>{THREE}</div>", FIVE[:3]),
        (f"<article><h1>Mill</h1></article><div class=ad>{P1}</div>", ["Mill"]),
        (f"<article><p>Hi.</p></article><aside>{THREE}{TWO}</aside><form>{THREE}</form>", ["Hi."]),
        ("<ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul>", []),
        (f"<ul><li><a href=x>Home</a></li></ul><p>{P1}</p><p>{P2}</p>", [P1, P2]),
    ],
)
def test_no_article_is_lost(body, blocks):
    assert html_text.main_text(page(body)) == "\n\n".join(blocks)


def test_main_text_of_odd_pages():
    for html in (None, "", "   ", "<", "<p", "</p></div>", "<!--", "<script>", "<a" * 50, "\0"):
        assert isinstance(html_text.main_text(html), str)
    deep = "<div>" * 5000 + P1 + "</div>" * 5000
    assert html_text.main_text(deep) == P1
    long = f"<article>{''.join(f'<p>{P1} {k}</p>' for k in range(20_000))}</article>"
    assert html_text.main_text(long).count("\n\n") == 19_999


@pytest.mark.parametrize("unit", ["<a", "<a ", "<div>a", '<a x="', "<ul><li>x", "<header>x", "<article>x", "</script ", "<!--", "<![CDATA[", "<!", "<p><b>x</p>", "<table><tr><td>"])
def test_time_grows_with_length_only(unit):
    """A hundred kB of malformed or deep markup takes about a hundred times as long as one kB: seconds, not hours."""
    began = time.process_time()
    for text in (unit * (10**5 // len(unit)), "<" + "a" * 10**5, f"<script>{unit * (10**5 // len(unit))}"):
        assert isinstance(html_text.main_text(text), str)
    assert time.process_time() - began < 20


def above(n):
    while n is not None:
        yield n
        n = n.parent


def slow_main_text(html: str) -> str:
    """Tree scoring over the standard library's parser, every block walking up to the root. For well-formed pages."""
    root = here = html_text.Node("html", "", None)

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            nonlocal here
            if tag in ("html", "body"):
                return
            node = html_text.Node(tag, " ".join(f'{k}="{v or ""}"' for k, v in attrs), here)
            here.kids.append(node)
            if tag in html_text.CONTENT and not node.bar:
                for up in above(node.parent):
                    up.bar = 0 if up.layout else up.bar
                    up.holds = True
            if tag not in html_text.VOID:
                here = node

        def handle_endtag(self, tag):
            nonlocal here
            up = here
            while up is not root and up.tag != tag:
                up = up.parent
            here = up.parent if up is not root else here

        def handle_data(self, data):
            here.kids.append(data)

    Reader(convert_charrefs=True).feed(html)

    def order(n):
        yield n
        for k in n.kids:
            if not isinstance(k, str):
                yield from order(k)

    nodes = list(order(root))
    for n in nodes:
        if n.tag == "header" and not any(u.tag in ("article", "section", "main") for u in above(n.parent)):
            n.bar = n.bar or 1
    found = html_text.blocks(root)
    points = lambda owner, text, links: 0.0 if owner.tag in html_text.HEADINGS else (1 + text.count(",") + min(3.0, len(text) / 100)) * (1 - links / len(text))
    barred = lambda n: any(u.bar for u in above(n))
    article = any(any(u.tag in html_text.CONTENT for u in above(o)) and not barred(o) for o, _, _ in found)
    while not article:
        free = sum(points(*b) for b in found if not barred(b[0]))
        inside = {id(n): round(sum(points(*b) for b in found if any(u is n for u in above(b[0]))), 6) for n in nodes if n.bar and not barred(n.parent)}
        first = [n for n in nodes if inside.get(id(n), 0) > 0 and n.bar == 1] or [n for n in nodes if inside.get(id(n), 0) > 0]
        best = max(first, key=lambda n: inside[id(n)], default=None)
        if best is None or free >= 4 or free > 0 and (best.bar == 2 or free >= 0.2 * inside[id(best)]):
            break
        best.bar = 0
    found = [b for b in found if not barred(b[0])]
    score, length, linked, total = Counter(), Counter(), Counter(), Counter()
    for owner, text, links in found:
        p = points(owner, text, links)
        for k, n in enumerate(above(owner if owner.tag == "div" or owner.parent is None else owner.parent)):
            score[id(n)] += p * (1 if k == 0 else 0.5 * (2 / 3) ** (k - 1))
        for n in above(owner):
            length[id(n)] += len(text)
            linked[id(n)] += links
            total[id(n)] += p
    density = lambda n: linked[id(n)] / max(1, length[id(n)])
    best = max(nodes, key=lambda n: round(score[id(n)] * (1 - density(n)), 6))
    if score[id(best)] <= 0:
        return "\n\n".join(t for _, t, links in found if links < len(t) / 2)
    for n in above(best):
        best = n if n.tag in html_text.CONTENT else best
    if best.parent is None:
        return "\n\n".join(t for o, t, _ in found if o is best or any(n.parent is best and density(n) < 0.5 for n in above(o)))
    kept, article = [best], best.tag in html_text.CONTENT
    for n in above(best):
        for k in n.parent.kids if n.parent is not None else []:
            if not isinstance(k, str) and k is not n and not barred(k) and length[id(k)] and density(k) < 0.3:
                near = score[id(k)] >= max(1.0, 0.2 * score[id(best)]) or k.tag == "p" and length[id(k)] >= 80 or not article and k.tag in html_text.HEADINGS
                far = total[id(k)] >= max(3.0, 0.2 * total[id(best)]) and (not article or any(x.tag in html_text.CONTENT and not x.bar for x in order(k)))
                kept += [k] if (near if n is best else far) else []
    return "\n\n".join(t for owner, t, _ in found if any(n is k for n in above(owner) for k in kept))


def test_main_text_equals_slow_scoring():
    """On made pages of well-formed markup: nested containers, link lists, headings, lists and text here and there."""
    rng = random.Random(14)
    words = lambda n: " ".join(rng.choice(["mill", "river,", "old", "wheel", "&amp;", "night,", "water."]) for _ in range(n))

    def some(depth: int) -> str:
        kind = rng.randrange(9)
        if depth == 0 or kind < 3:
            return f"<p>{words(rng.randint(3, 60))}</p>"
        if kind == 3:
            return f"<ul>{''.join(f'<li><a href=x>{words(3)}</a></li>' for _ in range(rng.randint(1, 6)))}</ul>"
        if kind == 4:
            return f"<h2>{words(3)}</h2>"
        tag = rng.choice(["div", "section", "div class='sidebar'", "blockquote", "article", "header", "nav", "div id='c1'", "form", "div class='comments'", "aside", "div", "section"])
        return f"<{tag}>{''.join(some(depth - 1) for _ in range(rng.randint(1, 5)))}</{tag.split()[0]}>"

    for _ in range(400):
        html = "<html><body>" + "".join(some(4) for _ in range(rng.randint(1, 5))) + "</body></html>"
        assert html_text.main_text(html) == slow_main_text(html), html


def test_pages_keep_rows_and_columns(spark, small):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, page(f"<article><p>{P1}</p></article>"), None)], "page_id long, url string, html string, TEXT string")
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert Counter((r.page_id, r.text, r.n_chars) for r in got.collect()) == Counter([(1, "", 0), (1, "", 0), (None, P1, len(P1))])
    assert html_text.extract(df.where("false")).count() == 0
    for r in QUERIES["op1_html_text"](spark, small).collect():
        assert r.n_chars == len(r.text) and r.text == "\n\n".join(" ".join(b.split()) for b in r.text.split("\n\n"))


# archives


def test_archives_in_any_ranges():
    rng = random.Random(1)
    payloads = [rng.randbytes(rng.choice([0, 10, 5000])) + warc.MAGIC * rng.randint(0, 3) for _ in range(60)]
    file = b"".join(warc.record(str(k), f"http://x/{k}\r\né", p, hashlib.sha256(p).hexdigest(), "0" if k % 7 == 6 else None) for k, p in enumerate(payloads))
    assert gzip.decompress(file).count(b"WARC/1.1\r\n") == 60
    for size in (1, 37, 1000, 4096, len(file)):
        found = [r for a in range(0, len(file), size) for r in warc.records(io.BytesIO(file), len(file), a, a + size)]
        assert [r.headers["warc-record-id"] for r in found] == [f"<urn:x-page:{k}>" for k in range(60)]
        assert [r.block.partition(b"\r\n\r\n")[2] for r in found] == [b"" if k % 7 == 6 else p for k, p in enumerate(payloads)]


def test_archives_of_odd_pages(spark):
    big, small_ = "x" * 150, "y" * 20
    data = [(3, "u", big), (1, "u", big), (1, "u", big), (2, None, small_), (4, "u", small_), (5, "u", None), (None, "u", big), (6, "", "é" * 60)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit("mine"))
    manifest = warc.archive(df, shared_dir(spark))
    assert sum(r.records for r in manifest.collect()) == len(data)
    for size in (100, 1 << 20):
        got = Counter((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.url) for r in warc.read_archives(manifest, size).collect())
        assert got == Counter(
            [("3", "revisit", "1", 150, "u"), ("1", "response", None, 150, "u"), ("1", "response", None, 150, "u"), ("2", "response", None, 20, None), ("4", "response", None, 20, "u"),
             ("5", "response", None, 0, "u"), ("", "revisit", "1", 150, "u"), ("6", "response", None, 120, "")]
        )
    none = warc.archive(df.where("false"), shared_dir(spark))
    assert none.count() == 0 == warc.read_archives(none).count()


# conversations


def test_escapes_are_reversible():
    rng = random.Random(2)
    parts = [*chat.CONTROLS, "\\", "<", "[", "s>", "/INST]", "<SYS>>", "a", "é"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        said = chat.escape(text)
        assert chat.unescape(said) == text
        assert not any(c in said for c in chat.CONTROLS)


def test_masks_by_prefix_sums():
    rng = random.Random(3)
    for _ in range(200):
        parts = [([rng.randrange(9) for _ in range(rng.randint(0, 4))], rng.random() < 0.4) for _ in range(rng.randint(0, 6))]
        ids, mask = chat.assemble(parts)
        assert ids.tolist() == [i for p, _ in parts for i in p] and mask.tolist() == [int(m) for p, m in parts for _ in p]


def test_chats_read_back(spark):
    data = [
        (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", "<\\s> \\[INST]"), (1, 0, "user", "<\\s> \\[INST]"), (1, None, None, None), (1, 2, "tool<s>", "x<</ROLE>>"),
        (4, 0, "user", "zebra"), (4, 0, "user", "apple"), (4, 0, "user", "Zoo"), (4, 0, "user", "\u00e9t\u00e9"), (4, 0, "user", "app"), (4, 0, "assistant", "two words"), (2, 0, "assistant", ""), (None, 0, "system", "<<SYS>>"), (3, 0, "assistant", "é\U0001f642" * 5000),
    ]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(df.withColumn("IDS", F.lit(1)))).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv in got:
        turns = [("" if r is None else r, "" if t is None else t) for _, _, r, t in sorted((x for x in data if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
        learned = "".join(t for r, t in turns if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.digests(chat.format_turns(df.where("false"))).count() == 0
    placed = chat.format_turns(df).where("conv_id = 1").orderBy("place").collect()
    assert [r.token_offset for r in placed] == np.cumsum([0, *(len(r.ids) for r in placed)])[:-1].tolist()
