"""Main text of web pages by consensus over hosts.

1. Every page is read into blocks of text. Each container gets the characters of its blocks outside links, its parent
   container a part of them; menus, headers, footers, sidebars, notices, adverts, forms and comments count for nothing, unless
   such a name or form wraps the article or most of the page (see ``_whole``). A name counts when all of its words are of
   boilerplate or layout: ``share-buttons`` does, ``social-history`` and ``post-header`` do not. The page votes for the widest container around the best one that adds text outside links, and for an article or main around
   it in any case. Paths are of tags and classes, generalised (digits stand for any number).
2. Spark counts the votes by host and path, folded before the shuffle; a host's path with most votes wins.
3. Every page is read again with its host's path; blocks under it, without boilerplate, are the text. Where the page's best
   container is an article or main or in one, of what stands outside any article or main only headings of the page (h1) stay; elsewhere
   lists of links outside the best container are left out. A page that has nothing there is read by its own path.

Defined cases: null or empty html gives an empty text; a page without a host votes for itself alone; a tie goes to the
greater path in string order; repeated rows vote each; other columns are kept and not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenwatch.llm.common import table
from lumenwatch.session import settle

#: Winners are sent to every task up to this many hosts; more are joined by a shuffle on the host.
BROADCAST_HOSTS = 50_000
PARENT_SHARE = 0.4
HOME_SHARE = 0.1

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = set("script style textarea title noscript template iframe svg annotation annotation-xml xmp noembed noframes".split())
CONTAINERS = set("html body div section article main center td header footer nav aside form fieldset dialog menu".split())
BLOCKS = CONTAINERS | set(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th caption blockquote pre figure figcaption details summary address hr hgroup search".split()
)
CLOSES_P = BLOCKS - {"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}
#: An opening tag ends an open element of these tags, up to the nearest of their parents.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ASIDE_TAGS = set("nav footer aside dialog menu button select search".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar toolbar".split())
ASIDE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner nav navbar navigation menu menubar breadcrumb "
    "breadcrumbs pagination pager sidebar sidenav rail footer masthead toolbar comment comments commentlist reply replies respond discussion disqus cookie "
    "cookies consent gdpr notice notification alert newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "popup modal overlay widget search reactions dfp adslot".split()
)
#: Words of layout that may stand in a name beside one of boilerplate.
LAYOUT_NAMES = set(
    "area bar block body bottom box btn button buttons center column container content desktop form global group holder icon icons inline inner item "
    "items layout left link links list main mobile module outer page panel primary right row secondary section site slot space strip top unit wrap wrapper zone".split()
)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Element(NamedTuple):
    tag: str
    path: str
    aside: bool
    wrappers: tuple[int, ...]  # forms and elements with a name of boilerplate around it, itself included
    home: bool  # an article or main element, or inside one
    story: tuple[int, int]  # wrappers around the main and around the innermost article without such a name; -1: none
    container: int  # index in the stack of the nearest container, itself included


class Block(NamedTuple):
    text: str
    linked: int  # characters inside links
    paths: tuple[str, ...]  # containers around it, outermost first
    aside: bool
    wrappers: tuple[int, ...] = ()
    story: tuple[int, int] = (-1, -1)
    head: bool = False  # an h1


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(raw)} if raw.strip() else {}


def _aside(tag: str, given: dict[str, str], home: bool) -> bool:
    if tag in ASIDE_TAGS or (tag == "header" and not home) or given.get("role", "").lower() in ASIDE_ROLES:
        return True
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", given.get("style", ""), re.I):
        return True
    return False


def _named(tag: str, given: dict[str, str], home: bool) -> bool:
    """A form, or an element with a name of boilerplate and layout words alone. Such an element may also be a wrapper of the page."""
    if tag in ("html", "body"):
        return False
    if tag == "form" or given.get("role", "").lower() == "form":
        return True
    boilerplate = ASIDE_NAMES if home else ASIDE_NAMES | {"header"}
    for name in (given.get("class", "") + " " + given.get("id", "")).split():
        words = {w.lower() for w in WORDS.findall(name) if not w.isdigit()}
        if words & boilerplate and words <= boilerplate | LAYOUT_NAMES:
            return True
    return False


def _general(tag: str, given: dict[str, str]) -> str:
    name = given.get("class", "").split()
    return re.sub(r"\d+", "#", ".".join([tag, *name[:2]]))


def blocks(html: str | None) -> Iterator[Block]:
    """The blocks of a page in order; those in wrappers are not yet aside."""
    html, at, pieces, linked, in_link = html or "", 0, [], 0, False
    stack = [Element("", "", False, (), False, (-1, -1), 0)]

    def flush() -> Block | None:
        nonlocal pieces, linked
        text, was = " ".join("".join(pieces).split()), linked
        pieces, linked = [], 0
        if not text:
            return None
        paths, k = [], stack[-1].container
        while k:
            paths.append(stack[k].path)
            k = stack[k - 1].container
        return Block(text, min(was, len(text)), tuple(reversed(paths)), stack[-1].aside, stack[-1].wrappers, stack[-1].story, stack[-1].tag == "h1")

    def push(tag: str, given: dict[str, str]) -> None:
        top, home = stack[-1], stack[-1].home or tag in ("article", "main")
        own = tag in CONTAINERS
        path = f"{stack[top.container].path}/{_general(tag, given)}" if own else top.path
        named = _named(tag, given, top.home)
        depth = len(top.wrappers)
        story = (depth, top.story[1]) if tag == "main" else (top.story[0], depth) if tag == "article" and not named else top.story
        wrappers = (*top.wrappers, at) if named and tag not in ("article", "main") else top.wrappers
        stack.append(Element(tag, path, top.aside or _aside(tag, given, top.home), wrappers, home, story, len(stack) if own else top.container))

    def pop(tags: set[str], until: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in until:
                return

    for m in TOKEN.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at:
            text = unescape(html[at : m.start()])
            pieces.append(text)
            linked += len(text) if in_link else 0
        at, tag = m.end(), m["tag"]
        if not tag:
            continue
        tag, end = tag.lower(), m["end"]
        if tag in RAW:
            if not end and not m["attributes"].endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>|\Z", re.I).search(html, at)
                at = close.end()
        elif tag == "a":
            in_link = not end
        elif tag == "br":
            pieces.append(" ")
        elif tag in BLOCKS or tag in ("button", "select"):
            if block := flush():
                yield block
            in_link = False
            if end:
                if any(e.tag == tag for e in stack[1:]):
                    pop({tag}, set())
            else:
                if tag in CLOSES_P and any(e.tag == "p" for e in stack[1:]):
                    pop({"p"}, CONTAINERS)
                if tag in SIBLINGS:
                    pop(*SIBLINGS[tag])
                if tag != "hr":
                    push(tag, _attributes(m["attributes"]))
    if at < len(html):
        pieces.append(unescape(html[at:]))
    if block := flush():
        yield block


def _whole(page: list[Block]) -> set[int]:
    """Wrappers that are no boilerplate, outermost first: they hold a main; or an article, where none stands outside wrappers (but
    not a teaser beside a larger one); or most of the page's text outside links, where what stands outside is no article."""
    shown = [b for b in page if not b.aside]
    every, words, mains, tellers, levels = 0, defaultdict(int), set(), set(), defaultdict(set)
    for b in shown:
        every += len(b.text) - b.linked
        for level, w in enumerate(b.wrappers):
            words[w] += len(b.text) - b.linked
            levels[level].add(w)
            mains |= {w} if b.story[0] > level else set()
            tellers |= {w} if max(b.story) > level else set()
    found: set[int] = set()
    for level in range(len(levels)):
        held = levels[level] & tellers
        large = {w for w in levels[level] if 2 * words[w] > every}
        if not held | large:
            continue
        clear = [b for b in shown if found.issuperset(b.wrappers)]
        outside, most = sum(len(b.text) - b.linked for b in clear), max((words[w] for w in held), default=0)
        found |= held & mains
        if all(max(b.story) < 0 for b in clear):
            headed = any(b.head for b in clear)
            found |= {w for w in held if 2 * words[w] >= most} | {w for w in large if not (headed and 5 * outside >= words[w])}
    return found


def read_page(html: str | None) -> list[Block]:
    """The blocks of a page; where all would be boilerplate, names of wrappers do not count."""
    page = list(blocks(html))
    if not any(b.wrappers for b in page):
        return page
    whole = _whole(page)
    judged = [b._replace(aside=b.aside or not whole.issuperset(b.wrappers)) for b in page]
    return page if all(b.aside for b in judged) else judged


def _core(page: list[Block]) -> tuple[str, ...] | None:
    """The container with most text of its own, outside links and boilerplate, after those around it; the page itself is ().

    An article or main with the page's heading, or any main, is not outdone from outside unless it has little of the text.
    """
    shown = [b for b in page if not b.aside]
    inside = [b for b in shown if _home(b.paths)]
    if any(b.head or b.story[0] >= 0 for b in inside) and sum(map(_own, inside)) >= HOME_SHARE * sum(map(_own, shown)):
        shown = inside
    scores: dict[tuple[str, ...], float] = defaultdict(float)
    for b in shown:
        scores[b.paths] += _own(b)
        if b.paths:
            scores[b.paths[:-1]] += PARENT_SHARE * _own(b)
    best = max(scores.items(), key=lambda s: (s[1], s[0]), default=(None, 0))
    return best[0] if best[1] > 0 else None


def _own(b: Block) -> int:
    return len(b.text) - b.linked


def _shared(one: tuple[str, ...], other: tuple[str, ...]) -> int:
    """How many outermost containers two blocks share."""
    return next((k for k, (a, b) in enumerate(zip(one, other)) if a != b), min(len(one), len(other)))


def _home(paths: tuple[str, ...]) -> int:
    """How many outermost containers there are up to the first article or main; 0 without one."""
    return next((k for k, p in enumerate(paths, 1) if p.rpartition("/")[2].partition(".")[0] in ("article", "main")), 0)


def _kept(page: list[Block], core: tuple[str, ...]) -> list[tuple[Block, int]]:
    """Blocks that are text, and how many containers they share with the core. Outside it and any article or main, a branch
    of the page whose text is mostly links is none, and where the core is in an article or main, only a heading is."""
    rows = [(b, _shared(b.paths, core)) for b in page if not b.aside]
    links: dict[tuple[str, ...], int] = defaultdict(int)
    for b, k in rows:
        links[b.paths[: k + 1]] += 2 * b.linked - len(b.text)

    def branch(b: Block, k: int) -> int:
        return links[b.paths[: k + 1]] if len(b.paths) > k else 2 * b.linked - len(b.text)

    home = _home(core)
    return [(b, k) for b, k in rows if k == len(core) or _home(b.paths) or ((b.head or not home) and branch(b, k) <= 0)]


def best_path(page: list[Block]) -> str | None:
    """The widest container around the core that adds text to it, at least the first article or main around it; "" is the page."""
    core = _core(page)
    if core is None:
        return None
    widest = min(*(k for _, k in _kept(page, core)), _home(core) or len(core))
    return core[widest - 1] if widest else ""


def text_under(page: list[Block], path: str | None) -> str:
    under = [b for b in page if not b.aside and (not path or path in b.paths)]
    return "\n".join(b.text for b, _ in _kept(under, _core(under) or ()))


def extract(html: str | None, path: str | None = None) -> str:
    page = read_page(html)
    text = "" if path is None else text_under(page, path)
    return text or text_under(page, best_path(page))


def host_of(url):
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, path, votes: the path that most pages of a host vote for."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [best_path(read_page(h)) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["host", "path"])

    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).where("host IS NOT NULL")
    votes = rows.mapInArrow(vote, "host string, path string").where("path IS NOT NULL").groupBy("host", "path").count()
    won = votes.groupBy("host").agg(F.max(F.struct("count", "path")).alias("won"))
    return settle(won.select("host", F.col("won.path").alias("path"), F.col("won.count").alias("votes")), "host-paths")


def main_text(pages: DataFrame, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    winners = host_paths(pages, url, html).select("host", "path")
    small = winners.count() <= BROADCAST_HOSTS
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    joined = rows.join(F.broadcast(winners) if small else winners, "host", "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(read, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op4_html_extraction": op4_html_extraction}
ORACLES: dict[str, str] = {}
