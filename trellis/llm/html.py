"""Main text of web pages: markup rules parts out, a suffix array of the host finds repeated runs."""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, mix64, trimmed, words

#: Tokens of the shortest run that counts as repeated, and distinct pages that must hold it.
RUN, PAGES = 8, 3
#: Share of its host's pages that must hold a run before it is boilerplate even at an article's edge, blocks at
#: either end of an article that are its edge, and share of a page beyond which what is covered makes the
#: page a copy.
MOST_PAGES, EDGE, COPY = 0.75, 2, 0.5
#: Pages of one host that share a task, their bytes, and buckets that hosts are counted in.
SHARD, SHARD_BYTES, BUCKETS = 64, 16 << 20, 1 << 20
#: Runs by shard that may be broadcast to the shards; more are joined by shuffle.
BROADCAST_RUNS = 200_000

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: One attribute, or the end of the tag; a quote that never closes is part of an unquoted value.
_ATTR = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)")
_SPACE = re.compile(r"\s+")
#: Elements whose content is no markup.
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Elements that hold no main text.
_DROP = {"head", "nav", "footer", "aside", "menu", "button", "select", "dialog", "svg", "canvas", "object", "audio", "video"}
#: Classes, ids and roles that say so, each as a whole: a longer one that merely has such a word (cookie-recipe) may
#: be an article's own.
_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies",
    "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "respond", "sidebar", "sponsor", "sponsored",
    "subscribe", "toolbar",
    "ad-banner", "ad-box", "ad-container", "ad-slot", "ad-unit", "ad-wrapper", "banner-ad", "comment-body", "comment-content", "comment-form", "comment-list", "comment-respond", "comment-section",
    "comment-text", "comment-thread", "commentlist", "comments-area", "comments-list", "comments-section", "comments-wrapper", "cookie-banner", "cookie-bar", "cookie-consent", "cookie-notice",
    "left-sidebar", "main-menu", "main-nav", "main-navigation", "nav-menu", "navbar-nav", "newsletter-form", "newsletter-signup", "page-footer", "page-nav", "right-sidebar", "side-bar", "sidebar-left",
    "sidebar-right", "site-footer", "site-nav", "site-navigation", "top-nav", "user-comments",
}
#: Words that may say so in a longer one: what they mark goes where the host repeats it.
_MAYBE = {x for x in _NAMES if "-" not in x} | {"related", "search", "share", "sharing", "social", "widget"}
_HEAD = {"header", "banner", "masthead"}
_MAIN = {"article", "main"}
#: What an opening tag closes without saying so.
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
#: Kinds of blocks: in a form outside of articles, outside of articles, inside, and inside an element that may be
#: boilerplate.
FORM, OUTSIDE, INSIDE, UNSURE = -1, 0, 1, 2


def _tag(html: str, at: int, ends: list[int]) -> tuple[int, str, bool, list[str], bool] | None:
    """(end, name, closing, classes with id and role, self-closing) of the tag that begins at ``at``; the
    name is empty for comments and declarations. None if no tag begins there or none ends, which is
    noted in ``ends`` so that it is looked for once."""
    if html.startswith("<!--", at):
        end = html.find("-->", at + 4)
        return (end + 3 if end >= 0 else len(html)), "", False, [], False
    after = html[at + 1 : at + 2]
    if after in ("!", "?"):
        end = html.find(">", at)
        return (end + 1 if end >= 0 else len(html)), "", False, [], False
    closing = after == "/"
    m = _NAME.match(html, at + 1 + closing)
    if not m or at >= ends[0]:
        return None
    if html.find(">", m.end()) < 0:
        ends[0] = at
        return None
    marks: list[str] = []
    place = m.end()
    while True:
        x = _ATTR.match(html, place)
        if not x:  # the page ends inside a quoted value's tag
            return len(html), m[0].lower(), closing, marks, False
        if x[1]:
            return x.end(), m[0].lower(), closing, marks, html[x.end() - 2] == "/"
        if x[3] and x[2].lower() in ("class", "id", "role"):
            marks += x[3].strip("\"'").lower().replace("_", "-").split()
        place = x.end()


def _says(marks: list[str]) -> tuple[bool, bool, bool]:
    """Whether classes, ids or roles name boilerplate, a page's head, or what may be boilerplate."""
    sure = head = maybe = False
    for mark in marks:
        parts = mark.split("-")
        head |= mark in _HEAD or len(parts) > 1 and parts[-1] == "header" and parts[0] in ("site", "page", "main")
        sure |= mark in _NAMES - _HEAD
        maybe |= any(p in _MAYBE for p in parts)
    return sure, head, maybe


def blocks(html: str) -> list[tuple[str, int]]:
    """(text, kind) of each block that the markup doesn't rule out, in page order; one scan of the page."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # name, dropped, kind
    held: Counter = Counter()  # names in the stack, so that it is only searched for what it holds
    ends = [len(html)]

    def pop():
        held[stack.pop()[0]] -= 1

    def close_block():
        if parts:
            text = "".join(parts)
            parts.clear()
            if "&" in text:
                text = unescape(text)
            text = _SPACE.sub(" ", text).strip()
            if text:
                out.append((text, stack[-1][2] if stack else OUTSIDE))

    at = begun = 0
    while True:
        lt = html.find("<", at)
        tag = _tag(html, lt, ends) if lt >= 0 else None
        if lt >= 0 and tag is None:
            at = lt + 1
            continue
        if not (stack and stack[-1][1]):
            piece = html[begun : lt if lt >= 0 else len(html)]
            if piece:
                parts.append(piece)
        if tag is None:
            break
        at, name, closing, marks, alone = tag
        begun = at
        if not name or name in _INLINE:
            continue
        if name in _RAW and not closing:  # unseen, so all but a title doesn't part a block
            if name == "title":
                close_block()
            end = re.compile(rf"</{re.escape(name)}\b[^>]*+>?", re.I).search(html, at)
            at = begun = end.end() if end else len(html)
            continue
        if name == "br":
            if not (stack and stack[-1][1]):
                parts.append(" ")
            continue
        close_block()
        if closing:
            if held[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in _VOID or alone:
            continue
        if stack and name in _CLOSES and stack[-1][0] in _CLOSES[name]:
            pop()
        sure, head, maybe = _says(marks)
        if name in _MAIN and not sure and stack and stack[0][0] in ("html", "body", "head") and held["nav"] + held["header"]:
            while stack and (stack[-1][1] or stack[-1][0] in ("nav", "header")):  # never closed
                pop()
        dropped, kind = (stack[-1][1], stack[-1][2]) if stack else (False, OUTSIDE)
        page = name in ("html", "body", "main", "article")
        reply = any(mark in ("comment", "comments") for mark in marks)
        bad = name in _DROP or name == "form" and kind > OUTSIDE or sure and not page or (name == "header" or head) and kind <= OUTSIDE and not page or reply
        if name in _MAIN:
            kind = max(kind, INSIDE)
        elif name == "form" and kind == OUTSIDE:  # it may hold the article, or the whole page
            kind = FORM
        elif maybe and kind == INSIDE:
            kind = UNSURE
        stack.append((name, dropped or bad, kind))
        held[name] += 1
    close_block()
    return out


def runs(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct runs of ``run`` tokens of the pages: the places where runs start, the number of the run at
    each, and of each run its first place and how many distinct pages hold it.

    The suffix array of the concatenated streams, with an end of its own after each page, sorted by
    doubling until ``run`` tokens tell suffixes apart; equal neighbours are one run's places, and
    longer runs are unions of overlapping ones.
    """
    n, none = len(tokens), np.zeros(0, np.int64)
    if not n:
        return none, none, none, none
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    left = np.searchsorted(page, page, "right") - np.arange(n)  # tokens up to the page's end
    depth = 1
    while depth < run:
        step = min(depth, run - depth)
        follow = np.zeros(n, np.int64)
        follow[: n - step] = np.where(left[: n - step] > step, rank[step:], 0)
        code = rank * (rank.max() + 1) + follow
        rank = np.unique(code, return_inverse=True)[1].astype(np.int64) + 1
        depth += step
    order = np.lexsort((page, rank))
    order = order[(left >= run)[order]]
    if not len(order):
        return none, none, none, none
    r, p = rank[order], page[order]
    new = np.append(True, r[1:] != r[:-1])
    fresh = new | np.append(True, p[1:] != p[:-1])
    group = np.cumsum(new) - 1
    return order, group, order[new], np.bincount(group, fresh).astype(np.int64)


def run_pages(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> np.ndarray:
    """In how many distinct pages the run of ``run`` tokens that starts at each token stands; 0 where the
    page ends sooner."""
    at, group, _, pages = runs(tokens, page, run)
    out = np.zeros(len(tokens), np.int64)
    out[at] = pages[group]
    return out


def repeated(tokens: np.ndarray, page: np.ndarray, run: int = RUN, pages: int = PAGES) -> np.ndarray:
    """Which tokens lie in a run of ``run`` tokens or more that ``pages`` distinct pages hold."""
    return _covered(np.flatnonzero(run_pages(tokens, page, run) >= pages), len(tokens), run)


def _covered(starts: np.ndarray, n: int, run: int) -> np.ndarray:
    """Which of ``n`` tokens lie in one of the runs that start at ``starts``."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + run, -1)
    return np.cumsum(delta[:-1]) > 0


def names(tokens: np.ndarray, first: np.ndarray, run: int = RUN) -> np.ndarray:
    """A 64-bit name for each run, by its tokens: runs of different tasks are the same if their names are."""
    code = np.zeros(len(first), np.uint64)
    for k in range(run):
        code = mix64(code + tokens[first + k])
    return code.view(np.int64)


def _streams(found: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the blocks of each page, their page, and where each block's tokens start."""
    data = [x.encode() for b in found for x in b]
    offs = np.cumsum([0, *map(len, data)])
    tokens, block, _ = words(np.frombuffer(b"".join(data), np.uint8), offs)
    page = np.repeat(np.arange(len(found)), [len(b) for b in found])[block] if len(block) else block
    return tokens, page, np.searchsorted(block, np.arange(len(data) + 1))


def _own(x: str, cut: np.ndarray) -> str:
    """A block without the tokens that are cut."""
    return " ".join(w for w, c in zip(re.findall(r"[^\x20\x09-\x0D]+", x), cut, strict=True) if not c) if cut.any() else x


def _main(b: list[str], kinds: list[int]) -> list[int]:
    """The blocks that may be main text: those of articles; without any, those outside of forms, or those in forms
    where that is most of the page."""
    if any(k > OUTSIDE for k in kinds):
        return [i for i, k in enumerate(kinds) if k > OUTSIDE]
    size = {k: sum(len(x) for x, y in zip(b, kinds, strict=True) if y == k) for k in (FORM, OUTSIDE)}
    return [i for i, k in enumerate(kinds) if k == OUTSIDE or size[FORM] > size[OUTSIDE]]


def _text(b: list[str], kinds: list[int], ends: np.ndarray | None, often: np.ndarray, most: np.ndarray) -> tuple[str, int]:
    """(main text, tokens removed as boilerplate) of a page; ``often`` and ``most`` say for each token
    whether a run over it stands on PAGES pages, or on most of its host's too. ``ends`` has where each
    block's tokens start, and the end; without it nothing is repeated.

    With an article, its blocks stay but for whole blocks at its edges that stand on most pages of the host,
    and those that the markup calls in question but for what stands on PAGES pages. Without one, what
    stands on PAGES pages goes. A page that would lose all of its text, or most of an article, is a copy
    and stays whole.
    """
    on = _main(b, kinds)
    has = any(kinds[i] > OUTSIDE for i in on)
    if ends is None:
        return "\n".join(b[i] for i in on), 0
    unsure = {i: often[ends[i] : ends[i + 1]] for i in on if kinds[i] == UNSURE}
    own = [i for i in on if kinds[i] != UNSURE]
    edge = {*own[:EDGE], *own[-EDGE:]}
    plain = {i: often[ends[i] : ends[i + 1]] for i in own} if not has else {i: most[ends[i] : ends[i + 1]] & (i in edge and most[ends[i] : ends[i + 1]].all()) for i in own}
    size, gone = sum(map(len, plain.values())), sum(int(c.sum()) for c in plain.values())
    if gone > COPY * size if has else gone == size:
        plain = {i: np.zeros(len(c), bool) for i, c in plain.items()}
    cuts = plain | unsure
    kept = [_own(b[i], cuts[i]) for i in on]
    return "\n".join(x for x in kept if x), sum(int(c.sum()) for c in cuts.values())


def _least(pages: int) -> int:
    """Pages that must hold a run before it goes from articles too."""
    return max(PAGES, int(np.ceil(MOST_PAGES * pages)))


def _texts(found: list[tuple[list[str], list[int]]], often: np.ndarray, most: np.ndarray, starts: np.ndarray) -> list[tuple[str, int]]:
    out, at = [], 0
    some = np.cumsum(np.append(0, often | most))
    for b, kinds in found:
        ends = starts[at : at + len(b) + 1]
        i, j = ends[0], ends[-1]
        out.append(_text(b, kinds, ends - i if some[j] > some[i] else None, often[i:j], most[i:j]))
        at += len(b)
    return out


def main_texts(htmls: list[str | None]) -> list[tuple[str, int]]:
    """(main text, tokens removed as boilerplate) of each page of one host; see ``_text``."""
    found = [([x for x, _ in b], [k for _, k in b]) for b in (blocks(h or "") for h in htmls)]
    tokens, page, starts = _streams([b for b, _ in found])
    pages = run_pages(tokens, page)
    return _texts(found, *[_covered(np.flatnonzero(pages >= n), len(tokens), RUN) for n in (PAGES, _least(len(htmls)))], starts)


def _held(found: list[tuple[str, int]]) -> bytes:
    """The blocks of a page for the way through shuffles and files: texts of a host are much alike in
    bytes, so they travel packed."""
    return zlib.compress(json.dumps([[x for x, _ in found], [k for _, k in found]], ensure_ascii=False).encode("utf-8", "surrogatepass"), 1)


def _found(page: dict) -> tuple[list[str], list[int]]:
    b, kinds = json.loads(zlib.decompress(page["held"]).decode("utf-8", "surrogatepass"))
    return b, kinds


def _parse(batches):
    for batch in batches:
        cols = [batch.column(i) for i in (0, 1, 3, 4, 5, 6)] + [pa.array([_held(blocks(h.as_py() or "")) for h in batch.column(2)], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "_host", "_b", "_shard", "_alone", "held"])


_STACK = "_host string, _b int, _shard int, _alone boolean, pages array<struct<page_id:long,url:string,held:binary>>, local array<long>, asks boolean, n long"
_STACK_TYPE = pa.schema([
    ("_host", pa.string()), ("_b", pa.int32()), ("_shard", pa.int32()), ("_alone", pa.bool_()),
    ("pages", pa.list_(pa.struct([("page_id", pa.int64()), ("url", pa.string()), ("held", pa.binary())]))),
    ("local", pa.list_(pa.int64())), ("asks", pa.bool_()), ("n", pa.int64()),
])


def _page_counts(tokens: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of all runs of a shard's suffix array and the distinct pages that hold each."""
    _, _, first, pages = runs(tokens, page)
    return names(tokens, first), pages


def _stack(table: pa.Table) -> pa.Table:
    """The pages of a shard as one row. ``local`` holds the runs on MOST_PAGES of the shard's pages: a run
    on that share of the host's pages is on that share of some shard's, so no other run can be."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0, r["url"] is None, r["url"] or ""))
    first = rows[0]
    pages = [{c: r[c] for c in ("page_id", "url", "held")} for r in rows]
    found = [_found(p) for p in pages]
    asks = any(UNSURE in kinds or kinds and max(kinds) <= OUTSIDE for _, kinds in found)
    local = np.zeros(0, np.int64)
    if not first["_alone"]:
        w, n = _page_counts(*_streams([b for b, _ in found])[:2])
        local = w[n >= np.ceil(MOST_PAGES * len(pages))]
    out = {k: first[k] for k in ("_host", "_b", "_shard", "_alone")} | {"pages": pages, "local": local.tolist(), "asks": asks, "n": len(pages)}
    return pa.Table.from_pylist([out], schema=_STACK_TYPE)


_OUT = "page_id long, url string, text string, n_chars long, n_boilerplate long"


def _answer(pages: list[dict], got: list[tuple[str, int]]) -> pa.RecordBatch:
    cols = [pa.array([p["page_id"] for p in pages], pa.int64()), pa.array([p["url"] for p in pages], pa.string()), pa.array([t for t, _ in got], pa.string())]
    cols += [pa.array([len(t) for t, _ in got], pa.int64()), pa.array([n for _, n in got], pa.int64())]
    return pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars", "n_boilerplate"])


def _alone(batches):
    """Pages of hosts that are one shard: the suffix array decides there."""
    for batch in batches:
        for r in batch.to_pylist():
            found = [_found(p) for p in r["pages"]]
            tokens, page, starts = _streams([b for b, _ in found])
            pages = run_pages(tokens, page)
            yield _answer(r["pages"], _texts(found, *[_covered(np.flatnonzero(pages >= n), len(tokens), RUN) for n in (PAGES, _least(len(found)))], starts))


def _run_rows(pick):
    """A function from shards to (_host, _shard, w, n): the runs that ``pick`` takes of a shard's and
    how many of its pages hold each."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                w, n = pick(r, *_page_counts(*_streams([_found(p)[0] for p in r["pages"]])[:2]))
                yield pa.RecordBatch.from_arrays([pa.array([r["_host"]] * len(w), pa.string()), pa.array([r["_shard"]] * len(w), pa.int32()), pa.array(w, pa.int64()), pa.array(n, pa.int64())], ["_host", "_shard", "w", "n"])

    return run


def _cut(batches):
    """Pages of a shard without the runs that its host holds often, or on most pages."""
    for batch in batches:
        for r in batch.to_pylist():
            found = [_found(p) for p in r["pages"]]
            often, most = (np.array(r[c] or [], np.int64) for c in ("often", "most"))
            if not len(often) + len(most):
                yield _answer(r["pages"], [_text(b, kinds, None, often, most) for b, kinds in found])
                continue
            tokens, page, starts = _streams([b for b, _ in found])
            at, group, first, _ = runs(tokens, page)
            name = names(tokens, first)
            yield _answer(r["pages"], _texts(found, *[_covered(at[np.isin(name, x)[group]], len(tokens), RUN) for x in (np.concatenate([often, most]), most)], starts))


def _large(work: Workspace, shards: DataFrame) -> DataFrame:
    """Pages of hosts that are several shards: each run's pages are counted over the whole host."""
    runs = "_host string, _shard int, w long, n long"
    key = ["_host", "_shard"]

    def to_shards(left: DataFrame, found: DataFrame, name: str) -> DataFrame:
        """``left`` with the runs in ``found`` (_host, _shard, w) of each shard as an array."""
        found = work.keep(found.groupBy(*key).agg(F.collect_list("w").alias(name)), name)
        n = found.agg(F.sum(F.size(name))).first()[0] or 0
        return left.join(F.broadcast(found) if n <= BROADCAST_RUNS else found, key, "left")

    # runs on most pages: those that are so in one shard are counted in all
    local = work.keep(shards.select("_host", F.explode("local").alias("w")).distinct(), "local")
    done = shards
    if local.isEmpty():
        done = done.withColumn("most", F.lit(None).cast("array<long>"))
    else:
        asked = to_shards(shards, shards.select(*key).join(local, "_host"), "wanted").where("wanted is not null")

        def wanted(r, w, n):
            on = np.isin(w, np.array(r["wanted"], np.int64))
            return w[on], n[on]

        counts = asked.select(*key, "pages", "wanted").mapInArrow(_run_rows(wanted), runs).groupBy("_host", "w").agg(F.sum("n").alias("n"))
        sizes = shards.groupBy("_host").agg(F.greatest(F.lit(PAGES), F.ceil(F.sum("n") * MOST_PAGES)).alias("least"))
        most = counts.join(sizes, "_host").where("n >= least").select("_host", "w")
        done = to_shards(done, shards.select(*key).join(most, "_host"), "most")
    # runs on PAGES pages: counted only for buckets that have a page they decide on
    asking = shards.where("asks")
    if asking.isEmpty():
        done = done.withColumn("often", F.lit(None).cast("array<long>"))
    else:
        near = shards.join(F.broadcast(asking.select("_b").distinct()), "_b", "left_semi")
        every = lambda r, w, n: (w, n)
        counts = near.select(*key, "pages").mapInArrow(_run_rows(every), runs).groupBy("_host", "w").agg(F.sum("n").alias("n")).where(F.col("n") >= PAGES)
        own = asking.select(*key, "pages").mapInArrow(_run_rows(every), runs)
        done = to_shards(done, own.join(counts.select("_host", "w"), ["_host", "w"], "left_semi").select(*key, "w"), "often")
    return done.select("pages", "often", "most").mapInArrow(trimmed(_cut), _OUT)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_boilerplate (tokens that repeated runs removed) per page.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments go by
    element and by whole classes, ids or roles; unclosed and crossing tags are put up with. A form that
    holds an article, or most of a page, is no reason. What the suffix array of the host's token streams
    finds repeated decides on the rest: on all text of pages without an article, on parts of an article
    that a word in a class calls in question, and on whole blocks at an article's edges that stand on
    most pages of the host. A passage that articles share stays in all of them.

    Pages of a host meet in one task, or in shards of about SHARD pages and SHARD_BYTES, by a hash, so a
    large host is many tasks. Each builds the suffix array of its streams; where a host is several, its
    runs are told by name and their pages added up over the host, so that what is repeated doesn't
    depend on the shards.

    Null and empty pages give an empty text; rows with a null id or url stay; repeated rows are rows of
    their own, and pages of their own for what is repeated; an empty table gives no rows.
    """
    work = Workspace(pages.sparkSession, "pages")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    bucket = F.pmod(F.xxhash64(host), F.lit(BUCKETS)).cast("int")
    counts = rows.select(bucket.alias("_b"), F.octet_length("html").alias("_size")).groupBy("_b").agg(F.count("*").alias("_n"), F.sum("_size").alias("_size"))
    shards_ = F.greatest(F.ceil(F.col("_n") / SHARD), F.ceil(F.coalesce("_size", F.lit(0)) / SHARD_BYTES)).cast("int")
    many = counts.select("_b", shards_.alias("_shards")).where("_shards > 1")
    dealt = rows.withColumns({"_host": host, "_b": bucket}).join(F.broadcast(many), "_b", "left")
    shard = F.when(F.col("_shards").isNull(), 0).otherwise(F.pmod(F.xxhash64("page_id", "url", F.monotonically_increasing_id()), F.col("_shards")).cast("int"))
    dealt = dealt.select("page_id", "url", "html", "_host", "_b", shard.alias("_shard"), F.col("_shards").isNull().alias("_alone"))
    parsed = dealt.mapInArrow(trimmed(_parse), "page_id long, url string, _host string, _b int, _shard int, _alone boolean, held binary")
    shards = work.keep(parsed.groupBy("_host", "_shard").applyInArrow(_stack, _STACK), "shards")
    alone = shards.where("_alone").select("pages").mapInArrow(trimmed(_alone), _OUT)
    return alone.unionByName(_large(work, shards.where("not _alone")))
