"""HTML extraction by consensus host paths.

Each page's containers are scored by the text of their blocks; they vote, per host, for their generalised tag-class path
(tags and class names from the root down, without numbers and positions), which stands as a 64-bit hash. Spark sums the
votes, and each page is extracted again from all containers on its host's winning paths: those that hold a fair share of
the text of the pages that have them. A page of whose text the winners hold only a small part uses its own best ones as
well. A title right above the winners, and what stands between, belongs to them.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of

#: Least share of a page's score that a main path has, that it is voted for with; share that the winners must hold.
SHARE, VOTE, COVER = 0.05, 0.01, 0.5
#: Winning paths kept for a host (pages of others use their own); hosts, paths (8 bytes each) and bytes of host names up to
#: which the winners are broadcast.
WINNERS, BROADCAST_HOSTS, BROADCAST_PATHS, BROADCAST_BYTES = 100, 20_000, 60_000, 4 << 20
#: Share of a page's text that must be left when what its classes mark as aside is taken away.
LEFT = 0.1

#: Elements that stand as blocks of their own; fixed values of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, and elements that are never main text.
RAW = frozenset("script style noscript template textarea title iframe noframes noembed xmp svg annotation select".split())
ASIDE = frozenset("nav aside footer form menu dialog button label head".split())
#: An element that starts closes open ones of these kinds, up to a border.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"),
}
BORDERS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "tbody": ("table",), "tfoot": ("table",)}
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li pre td th blockquote dd dt figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: A name in a class, id or role marks what is not main text if its last word is one of MARKS, or if it holds one and no
#: word but these and PARTS. Names with a word of LAYOUT tell what a page has, names that start with one of TOPICS what it
#: is about. Readers' comments stay out even where nothing else is left.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner billboard breadcrumb breadcrumbs byline captcha comment comments commentlist consent cookie "
    "cookies copyright disclaimer disqus footer form gdpr login menu menus modal nav navbar navigation navi newsletter notice notices notification "
    "pager pagination paywall popup promo promotion promoted recommended related replies respond search share sharing sidebar signup skip skiplink social sponsor "
    "sponsored subscribe subscription toc toolbar tracking widget widgets contentinfo complementary dialog alert cta discussion feedback reply reviews".split()
)
PARTS = frozenset(
    "wrapper wrap container box block area list section bar inner outer item items link links panel unit slot zone region top bottom left right main primary secondary "
    "sticky title body text message overlay icons icon user users reader readers customer button buttons group row column col site page post article entry blog header heading to content template thread form".split()
)
LAYOUT = frozenset("has no with without".split())
TOPICS = frozenset("category cat tag topic section subject type format status post term".split())
COMMENTS = frozenset("comment comments commentlist discussion disqus feedback respond replies reply reviews".split())
HEADERS = frozenset("header masthead".split())

_TAG = re.compile(
    r"""<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>|[^>]*+\Z)|[!?/][^>]*+(?:>|\Z))""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[a-z]+")


def marked(name: str) -> frozenset[str]:
    """The words of MARKS for which a name of a class, id or role marks what is not main text; none if it does not."""
    words = _WORDS.findall(name)
    found = frozenset(words) & MARKS
    if not found or LAYOUT & set(words) or words[0] in TOPICS and len(words) > 1 and words[-1] not in COMMENTS:
        return frozenset()
    return found if words[-1] in MARKS or all(w in MARKS or w in PARTS for w in words) else frozenset()


@lru_cache(maxsize=4096)
def _read(name: str, rest: str) -> tuple[str, int, bool, bool]:
    """An element's generalised step; how surely it is aside: 0 main, 1 by its classes, 2 surely; whether it is marked as the
    main part, and whether it is a header.
    """
    classes, found, main, header, hidden = [], set(), name == "main", name == "header", False
    for key, *values in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values).lower()
        hidden = hidden or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and bool(_UNSEEN.search(value))
        if key not in ("class", "id", "role"):
            continue
        if key == "class":
            classes += [re.sub(r"[\d>]+", "", x) for x in value.split()]
        main = main or value == "main" and key == "role"
        for x in value.split():
            found |= marked(x)
            words = _WORDS.findall(x)
            if HEADERS & set(words) and not LAYOUT & set(words):
                header = header or words[-1] in HEADERS or all(w in PARTS or w in HEADERS for w in words)
    whole_page = name in ("html", "body")
    sure = name in ASIDE or hidden and not whole_page or bool(found & COMMENTS)
    aside = 0 if whole_page else 2 if sure else int(bool(found) and name not in ("main", "article"))
    return ".".join([name, *sorted({x for x in classes if x})]), aside, main, header and not whole_page


def worth(text: str, links: int) -> int:
    """A block's score: its text without links."""
    return max(0, len(text) - 2 * links) + 10 * text.count(",") + 1


def longer(path: int, step: str) -> int:
    """The signed 64-bit key of a path that goes on from the one of key ``path``."""
    return int(np.uint64(xxhash.xxh64_intdigest(step.encode("utf-8", "surrogatepass"), path & 0xFFFFFFFFFFFFFFFF)).view(np.int64))


def path_key(path: str) -> int:
    """The key of a written path such as ``html>body>div.content``; 0 for the page itself."""
    key = 0
    for step in path.split(">") if path else ():
        key = longer(key, step)
    return key


class Page:
    """A page's elements, each with what it takes from those that hold it, and its blocks (element, text, characters in links).

    Elements stand in page order as entries of lists, so memory is linear in the page however deep it is. Of an element:
    parent, name, path (its key), aside (0, 1, 2), header that holds it, whether a heading stands between, the article or
    main part that holds it (0: none), the container that it counts for, the block element that it stands in. Of a path: what it goes on from, whether it is
    the whole page's.
    """

    def __init__(self, source: str):
        self.parent, self.name, self.path, self.aside = [-1], [""], [0], [0]
        self.header, self.heading, self.article, self.container, self.base = [0], [False], [0], [0], [0]
        self.above: dict[int, int] = {}
        self.whole = {0}
        self.blocks: list[tuple[int, str, int]] = []
        self._parse(source)
        self.kept = self._kept()

    def _parse(self, source: str) -> None:
        stack, held, links, in_link, at, n = [0], [], 0, 0, 0, len(source)
        parent, names, blocks, opened = self.parent, self.name, self.blocks, Counter()

        def flush() -> None:
            nonlocal links
            if held:
                text = " ".join("".join(held).split())
                if text:
                    blocks.append((stack[-1], text, min(links, len(text))))
                held.clear()
            links = 0

        def put(a: int, b: int) -> None:
            nonlocal links
            x = stack[-1]
            if a < b and self.aside[x] <= self.aside[self.base[x]]:  # else an aside within a line
                part = source[a:b]
                if "&" in part:
                    part = html.unescape(part)
                held.append(part)
                if in_link:
                    links += len(part)

        def close_to(place: int) -> None:
            nonlocal in_link
            if any(names[x] in BLOCKS for x in stack[place:]):
                flush()
            for x in stack[place:]:
                in_link -= names[x] == "a"
                opened[names[x]] -= 1
            del stack[place:]

        while at < n:
            low = source.find("<", at)
            if low < 0:
                put(at, n)
                break
            put(at, low)
            m = _TAG.match(source, low)
            if m is None:
                put(low, low + 1)
                at = low + 1
                continue
            at = m.end()
            name = m["name"]
            if not name:
                continue
            name, rest = name.lower(), m["rest"]
            if m["end"]:
                if name == "p" and not opened["p"]:
                    flush()
                elif name == "br":
                    held.append(" ")
                for place in range(len(stack) - 1, 0, -1) if opened[name] else ():
                    if names[stack[place]] == name:
                        close_to(place)
                        break
                    if names[stack[place]] in BLOCKS and name not in BLOCKS and name != "a":
                        break  # an inline end tag does not close blocks
                continue
            if name in RAW:
                if not rest.rstrip(">").endswith("/") or name != "svg":
                    ends = re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, at)
                    at = ends.end() if ends else n
                held.append(" ")
                continue
            if name in BLOCKS:
                for place in range(len(stack) - 1, 0, -1):
                    if names[stack[place]] == "p":
                        close_to(place)
                        break
                    if names[stack[place]] in BLOCKS:
                        break
                if any(opened[x] for x in CLOSES.get(name, ())):
                    for place in range(len(stack) - 1, 0, -1):
                        if names[stack[place]] in CLOSES[name]:
                            close_to(place)
                        elif names[stack[place]] in BORDERS.get(name, ()):
                            break
                flush()
            elif name in ("br", "img"):
                held.append(" ")
            if name in VOID:
                continue
            self._open(name, rest, stack[-1])
            stack.append(len(names) - 1)
            opened[name] += 1
            in_link += name == "a"
            if rest.endswith("/>") and name not in BLOCKS:
                close_to(len(stack) - 1)
        flush()

    def _open(self, name: str, rest: str, above: int) -> None:
        step, aside, main, header = _read(name, rest)
        x, path, block = len(self.name), self.path[above], name in BLOCKS
        if block:
            key = longer(path, step)
            self.above[key] = path
            if path in self.whole and name in ("html", "body"):
                self.whole.add(key)
            path = key
        self.parent.append(above)
        self.name.append(name)
        self.path.append(path)
        self.aside.append(max(aside, self.aside[above]))
        self.header.append(x if header else self.header[above])
        self.heading.append(not header and (self.heading[above] or name in HEADINGS))
        # an article or main part stands for the containers in it
        self.article.append(x if name == "article" or main and self.name[self.article[above]] != "article" else self.article[above])
        self.container.append(x if block and name not in LEAVES else self.container[above])
        self.base.append(x if block else self.base[above])

    def _kept(self) -> list[tuple[int, str, int]]:
        """Blocks that may be main text: not in an aside; of a header, only the headings, and those in an article.

        If nearly nothing is left, what only its classes mark as aside may be main text, too.
        """
        out, soft = [], []
        for block in self.blocks:
            x = block[0]
            h = self.header[x]
            if self.aside[x] < 2 and (not h or self.heading[x] and self.article[h]):
                soft.append(block)
                if not self.aside[x]:
                    out.append(block)
        weigh = lambda blocks: sum(worth(text, links) - 1 for _, text, links in blocks)
        return out if weigh(out) >= LEFT * weigh(soft) else soft

    def _top(self, x: int) -> int:
        """What a block in element ``x`` counts for: the article or main part that holds it, or else its container."""
        x = self.container[x]
        return self.article[x] or x

    def scores(self) -> dict[int, float]:
        """Paths by score: text without links of the blocks in them, half of it for what holds the container."""
        score: dict[int, float] = defaultdict(float)
        for x, text, links in self.kept:
            x = self.container[x]
            score[x] += worth(text, links)
            if x > 0:
                score[self.parent[x]] += worth(text, links) / 2
        by: dict[int, float] = defaultdict(float)
        for x, value in score.items():
            top = self._top(x)
            by[self.path[top]] += value * (1.5 if top != x or self.name[x] == "article" else 1.0)
        return by

    def own(self) -> dict[int, float]:
        """Paths by their share of the page's score, without what containers get for those in them."""
        by: dict[int, float] = defaultdict(float)
        for x, text, links in self.kept:
            by[self.path[self._top(x)]] += worth(text, links)
        total = sum(by.values())
        return {p: w / total for p, w in by.items()}

    def _within(self, path: int, of: int) -> bool:
        while path and path != of:
            path = self.above[path]
        return path == of

    def chosen(self, own: dict[int, float]) -> dict[int, float]:
        """The page's main paths: those of a fair share, what holds two or more of them, and the best one if they are small."""
        out = {p: w for p, w in own.items() if w >= SHARE}
        if own and sum(out.values()) < COVER:
            by = self.scores()
            best = min(by, key=lambda p: (-by[p], p))
            out[best] = sum(w for p, w in own.items() if self._within(p, best))
        holding: dict[int, list[int]] = defaultdict(list)
        for p in out:
            holding[self.above.get(p, 0)].append(p)
        for p, parts in holding.items():
            if len(parts) > 1 and p not in self.whole:
                out[p] = max(out.get(p, 0.0), sum(out[x] for x in parts))
        return out

    def votes(self) -> dict[int, float]:
        own = self.own()
        return {p: w for p, w in own.items() if w >= VOTE} | self.chosen(own)

    def _under(self, winners: set[int]) -> list[bool]:
        out = [0 in winners]
        for x in range(1, len(self.name)):
            out.append(out[self.parent[x]] or self.path[x] in winners)
        return [out[x] for x, *_ in self.kept]

    def text(self, paths: list[int]) -> str:
        """The blocks under any of ``paths`` in page order; if these hold little of the page, with those of its own main paths."""
        kept, own = self.kept, self.own()
        # what holds a whole page wins on the pages whose text stands right in it
        winners = {p for p in paths if p not in self.whole or own.get(p, 0.0) >= SHARE}
        inside = self._under(winners)
        total = sum(worth(text, links) for _, text, links in kept)
        if sum(worth(text, links) for (_, text, links), use in zip(kept, inside) if use) < COVER * total:
            inside = self._under(winners | self.chosen(own).keys())
        inside = self._beside(inside)
        first, title = inside.index(True) if True in inside else 0, lambda i: self._titled(kept[i][0])
        if first and not any(use and title(i) for i, use in enumerate(inside)):
            above = next((i for i in range(first - 1, -1, -1) if title(i)), first)
            for i in range(above, first):  # the title and what stands between, without lists of links
                inside[i] = i == above or 2 * kept[i][2] < len(kept[i][1])
        return "\n\n".join(text for (_, text, _), use in zip(kept, inside) if use)

    def _beside(self, inside: list[bool]) -> list[bool]:
        """On a page without an article or main part, also the containers beside what is inside: of three words or more, most of it no links."""
        tops = [self._top(x) for x, *_ in self.kept]
        if any(use and self.article[top] for use, top in zip(inside, tops)):
            return inside
        beside = {self.parent[top] for use, top in zip(inside, tops) if use and top}
        words, linked, size = Counter(), Counter(), Counter()
        for top, (_, text, links) in zip(tops, self.kept):
            words[top] += len(text.split())
            linked[top] += links
            size[top] += len(text)
        more = {t for t in words if t and self.parent[t] in beside and words[t] >= 3 and 2 * linked[t] < size[t]}
        return [use or top in more for use, top in zip(inside, tops)]

    def _titled(self, x: int) -> bool:
        while self.name[x] not in BLOCKS and x:
            x = self.parent[x]
        return self.name[x] == "h1"


def host_of(url: str):
    """The host of a URL column, lower-cased, without a port; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per host: its winning paths, at most WINNERS, best first.

    A path wins if it holds SHARE of the text of the pages that vote for it, on average, so that a rare template's paths
    are not measured by a common one's. Votes are summed in each task before they shuffle, in whole millionths, so that
    the sum does not depend on the order of its parts.
    """

    def vote(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        votes: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0])

        def counted() -> pd.DataFrame:
            out = pd.DataFrame([(*k, *v) for k, v in votes.items()], columns=["host", "path", "votes", "pages"])
            votes.clear()
            return out

        for frame in frames:
            for host, source in zip(frame["host"], frame["html"]):
                for path, share in Page(source).votes().items():
                    count = votes[host, path]
                    count[0] += round(share * 1_000_000)
                    count[1] += 1
            if len(votes) > 100_000:
                yield counted()
        yield counted()

    given = pages.select(host_of(url_col).alias("host"), text_of(html_col).alias("html")).mapInPandas(vote, "host string, path long, votes long, pages long")
    summed = given.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("pages").alias("pages"))
    fair = summed.where(F.col("votes") >= F.col("pages") * int(SHARE * 1_000_000))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    top = fair.withColumn("place", place).where(F.col("place") <= WINNERS)
    return top.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("paths"))


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """``pages`` with text (the main text, '' if none) and n_chars (long, its code points).

    Character references are decoded, white space in a block becomes one space, blocks are joined by an empty line.
    Null or empty html has no text; a null url, or one without a host, belongs to the host ''. Repeated rows are
    extracted each (and vote each). Columns named text or n_chars are replaced, all others pass through. The winning
    paths are broadcast up to ``broadcast_hosts`` hosts, and joined by a shuffle that Spark may split beyond.
    """
    winners = stored(host_paths(pages, url_col, html_col).withColumnRenamed("host", "__ws_host").withColumnRenamed("paths", "__ws_paths"), "paths")
    zero = F.lit(0)
    hosts, paths, size = winners.agg(F.count("*"), F.coalesce(F.sum(F.size("__ws_paths")), zero), F.coalesce(F.sum(F.octet_length("__ws_host")), zero)).first()
    few = hosts <= broadcast_hosts and paths <= BROADCAST_PATHS and size <= BROADCAST_BYTES

    @F.pandas_udf("string")
    def main_text(sources: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([Page(s).text(p.tolist()) for s, p in zip(sources, paths)], dtype=object)

    out = pages.drop("text", "n_chars").withColumn("__ws_of", host_of(url_col))
    out = out.join(F.broadcast(winners) if few else winners, F.col("__ws_of") == F.col("__ws_host"), "left")
    none = F.array().cast("array<bigint>")
    out = out.withColumn("text", main_text(text_of(html_col), F.coalesce("__ws_paths", none)))
    return out.drop("__ws_of", "__ws_host", "__ws_paths").withColumn("n_chars", F.length("text").cast("long"))
