"""Pages whose articles carry words that sound like boilerplate, forms around articles, shared passages, large and
repeated pages, and the whole query against a plain version on small hosts."""

import re
from collections import defaultdict

import numpy as np
import pytest

from trellis.llm import html

LONG = "a paragraph that belongs to the article and to nothing else on this page at all"


@pytest.mark.parametrize("mark", ["class='ad-hoc-network'", "class='cookie-recipe'", "id='comment-on-policy'", "id='newsletter-history'", "id=\"pagination-algorithms\"", "class=breadcrumb-topping", "class='my-sidebar-story x'", "role='sponsored-research'"])
def test_names_that_only_sound_like_boilerplate(mark):
    page = f"<body><nav>menu</nav><article><h1>Title</h1><section {mark}><p>{LONG}</p></section></article></body>"
    assert html.main_texts([page] * 1)[0][0] == f"Title\n{LONG}"


@pytest.mark.parametrize("mark", ["ad", "comment-list", "cookie-banner", "right-sidebar", "x sponsored"])
def test_names_that_say_so(mark):
    page = f"<body><article><p>{LONG}</p><div class='{mark}'><p>gone</p></div></article></body>"
    assert html.main_texts([page])[0][0] == LONG


def test_forms():
    around = f"<body><form action='/x'><nav>menu</nav><article><p>{LONG}</p><form><p>Search here</p></form></article></form></body>"
    whole = f"<body><form id=aspnet><div>{LONG}</div><p>{LONG}</p><button>go</button><select><option>1</select></form></body>"
    beside = f"<body><p>{LONG}</p><form><label>Name</label></form></body>"
    article = f"<body><form><input></form><article><p>{LONG}</p></article><form><p>{LONG * 3}</p></form></body>"
    assert [t for t, _ in map(lambda p: html.main_texts([p])[0], (around, whole, beside, article))] == [LONG, f"{LONG}\n{LONG}", LONG, LONG]


@pytest.mark.parametrize("share", [49, 50, 75, 100])
def test_passages_that_articles_share_stay(share):
    passage = "the same words that many articles quote from one well known source in full"
    pages = [f"<article><p>start {i} of this page {i * 7}</p><p>second {i} {i * 3}</p>" + (f"<p>{passage}</p>" if i < share else "") + f"<p>third {i}</p><p>fourth {i} end</p></article>" for i in range(100)]
    assert sum(passage in t for t, _ in html.main_texts(pages)) == share


def test_a_notice_at_the_edge_goes_and_quotes_there_stay():
    notice, quote = "write to us at any time about what you read here today please", "as the old saying goes there is nothing new under the sun at all"
    pages = [f"<article><p>start {i} {i * 7} of this page and some more words for it</p><p>{quote if i % 2 else i}</p><p>part {i} x</p><p>{i} more</p>" + (f"<p>{notice}</p>" if i % 5 else "") + "</article>" for i in range(40)]
    got = [t for t, _ in html.main_texts(pages)]
    assert not any(notice in t for t in got) and sum(quote in t for t in got) == 20


def plain(rows):
    """{row: text} by the rules, runs looked for among all windows of a host's pages by sets of tuples."""
    hosts = defaultdict(list)
    for i, (_, url, page) in enumerate(rows):
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", url or "")
        hosts[m[1].lower() if m else ""].append((i, html.blocks(page or "")))
    out = {}
    for pages in hosts.values():
        held = defaultdict(set)
        streams = {}
        for i, b in pages:
            words = [w.lower() for x, _ in b for w in re.findall(r"[^\x20\x09-\x0D]+", x)]
            streams[i] = words
            for k in range(len(words) - 7):
                held[tuple(words[k : k + 8])].add(i)
        for i, b in pages:
            words, covered = streams[i], {}
            for least in (3, max(3, -(-len(pages) * 3 // 4))):
                c = [False] * len(words)
                for k in range(len(words) - 7):
                    if len(held[tuple(words[k : k + 8])]) >= least:
                        c[k : k + 8] = [True] * 8
                covered[least] = c
            often, most = covered[3], covered[max(3, -(-len(pages) * 3 // 4))]
            on = html._main([x for x, _ in b], [k for _, k in b])
            has = any(b[j][1] > html.OUTSIDE for j in on)
            at, cuts = 0, {}
            own = [j for j in on if b[j][1] != html.UNSURE]
            edge = own[:2] + own[-2:]
            for j, (x, kind) in enumerate(b):
                n = len(re.findall(r"[^\x20\x09-\x0D]+", x))
                span = slice(at, at + n)
                at += n
                if j in on:
                    whole = j in edge and all(most[span])
                    cuts[j] = often[span] if kind == html.UNSURE or not has else [whole] * n
            size, gone = sum(len(cuts[j]) for j in own), sum(sum(cuts[j]) for j in own)
            if (gone > size / 2) if has else gone == size:
                cuts.update({j: [False] * len(cuts[j]) for j in own})
            texts = [b[j][0] if not any(cuts[j]) else " ".join(w for w, c in zip(re.findall(r"[^\x20\x09-\x0D]+", b[j][0]), cuts[j], strict=True) if not c) for j in on]
            out[i] = "\n".join(t for t in texts if t)
    return out


@pytest.mark.parametrize("shard,size", [(64, 16 << 20), (3, 16 << 20), (64, 3000)])
def test_the_whole_query_on_small_hosts(spark, monkeypatch, shard, size):
    """Shards change the size of tasks only; repeated rows, null ids and urls, a page without an article, a page of 20 MB."""
    monkeypatch.setattr(html, "SHARD", shard)
    monkeypatch.setattr(html, "SHARD_BYTES", size)
    rng = np.random.default_rng(12)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    common = [word(12) for _ in range(6)]
    rows = []
    for i in range(90):
        body = "".join(f"<p>{common[rng.integers(0, 6)] if rng.random() < 0.4 else word(rng.integers(1, 25))}</p>" for _ in range(rng.integers(1, 7)))
        side = f"<div class='related-{i % 4}'>{common[0]} {word(3)}</div>"
        page = [f"<article>{body}{side}</article>", f"<div>{body}</div>{side}", f"<form>{body}</form>", ""][rng.choice(4, p=[0.6, 0.25, 0.1, 0.05])]
        rows.append((int(i), f"https://h{i % 3}.example/{i}", page))
    rows += [rows[4]] * 9 + [(None, None, "<article>no address</article>"), (500, "https://h1.example/null", None)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, _host string, held int").repartition(4)
    want = sorted(((rows[i][0], rows[i][1], t, len(t)) for i, t in plain(rows).items()), key=str)
    assert sorted((tuple(r)[:4] for r in html.extract(table).collect()), key=str) == want


def test_a_very_long_page(spark):
    text = " ".join(f"word{i}" for i in range(1_600_000))
    rows = [(1, "https://h/1", f"<article><p>{text}</p></article>"), (2, "https://h/2", "<article>short</article>")]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].n_chars == len(text) and got[1].text == text and got[2].text == "short"
