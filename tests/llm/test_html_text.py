import random
import time

import pytest

from colloquy.llm.html_text import BLOCK_TAGS, CLOSED_BY, OpenTags, main_text

PROSE = "The house of the old man was at the end of the road and it had been there for a long time. "
CASES = {
    "article": (f"<nav><a>m</a></nav><article><h1>T &amp; t</h1><p>{PROSE}<br>b&nbsp; c<p>x</article><footer>f</footer>", f"T & t {PROSE}b c x"),
    "in article": (f"<article><p>{PROSE}</p><div class='ad box'>buy</div><aside>s</aside><p>!!</p><form>f</form></article>", PROSE + "!!"),
    "main": ("<header>h</header><main><header>Head</header><div>a<span> b</span><i>c</i></div><section id=comments><p>hi</section></main>", "Head a bc"),
    "raw": ("<article>a<script>var t='</p><p>no';</script><style>p{}</style><!-- <p>no --><noscript>n</noscript> b</article>", "a b"),
    "comments": (f"<article>{PROSE}</article><article class=comment>{PROSE}</article>", PROSE),
    "hidden": ("<article>a<p hidden>x</p><p style='display: none'>y</p><div aria-hidden=\"true\">z</div><p>b</article>", "a b"),
    "references": ("<article>&lt;b&gt; &#228;&#x20AC; &amp;amp; &unknown; a&b</article>", "<b> ä€ &amp; &unknown; a&b"),
    "edge links": (f"<article><p>{PROSE}</p><ul><li><a>one</a></li><li><a>two</a></li></ul></article>", PROSE),
    "inner links": (f"<article><p>{PROSE}</p><p><a>one</a></p><p><a>two</a></p><p>{PROSE}</p></article>", PROSE + "one two " + PROSE),
    "no mark": (f"<div><a>Home</a></div><p>{PROSE * 3}</p><p>Short.</p><p>{PROSE * 3}</p><div class=footer-note>c</div>", f"{PROSE * 3}Short. {PROSE * 3}"),
    "between": (f"<div><a>Home</a></div><p>Near the menu</p><div><a>x</a></div><p>{PROSE * 3}</p>", PROSE * 3),
    "other language": ("<p>Zzz qqq www vvv.</p><p><a>link</a></p>", "Zzz qqq www vvv."),
    "broken": ("<p title='it's>foo</p> < b <p", "foo < b"),
    "names": ("<body class='has-sidebar'><article class='post-header'><p>a</p></article></body>", "a"),
    "stems": (f"<article><p>{PROSE}</p><ol class=commentlist><li>x</li></ol><p class=commentary>y</p></article>", PROSE + "y"),
    "named content": ("<div id=page><div class='menu'>m</div><div id='main-content'><p>OF!! IS!! ZZ!!</p><p>q</p></div><div>d</div></div>", "OF!! IS!! ZZ!! q"),
    "unclosed": ("<article>a<!-- never", "a"),
    "empty": ("", ""),
    "unclosed inline": (f"<article><p><b>{PROSE}<br><p>b</p></article><footer>f</footer>", PROSE + "b"),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_cases(name):
    page, want = CASES[name]
    assert main_text(page) == " ".join(want.split())


def test_table_articles(spark, sf_dir):
    """Every test page marks its article: all of it comes out, and nothing else."""
    import html
    import re

    from colloquy.llm.everything import REGISTRY

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = REGISTRY["op5_html_extraction"].run(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())
        assert (r["text"], r["n_chars"]) == (want, len(want))


@pytest.mark.parametrize("page", ["<b>" * 20_000 + "</i>" * 20_000, "<b>" * 20_000 + "<p>x" * 20_000, "<script/>" * 20_000, "<head>" * 20_000 + "<p>" * 20_000, "<div><p>" * 10_000 + "</b>" * 20_000])
def test_deep_and_stray_tags_cost_in_proportion(page):
    began = time.perf_counter()
    main_text(f"<p>{PROSE}{page}")
    assert time.perf_counter() - began < 5


def test_open_tags_end_as_a_walk_over_all_would():
    rng = random.Random(5)
    tags = ["p", "b", "i", "li", "ul", "td", "tr", "th", "dt", "dd", "div", "head", "body", "option", "a"]
    for _ in range(300):
        fast, slow = OpenTags(), []
        for _ in range(60):
            tag = rng.choice(tags)
            if rng.random() < 0.5:
                fast.close(tag)
                for i in range(len(slow) - 1, -1, -1):
                    if slow[i] == tag:
                        del slow[i:]
                        break
                    if tag not in BLOCK_TAGS and slow[i] in BLOCK_TAGS:
                        break
            else:
                fast.make_way(tag)
                for i in range(len(slow) - 1, -1, -1):
                    if slow[i] in CLOSED_BY.get(tag, set()) or (slow[i] == "p" and tag in BLOCK_TAGS):
                        del slow[i:]
                        break
                    if slow[i] in BLOCK_TAGS and slow[i] != "head":
                        break
                fast.push((tag, False, False, False, False))
                slow.append(tag)
            assert [x[0] for x in fast.items] == slow
