"""HTML extraction by consensus of a host's pages on the path of the main container."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import Aside, Stash

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never main text.
DROPPED = frozenset("aside button canvas datalist dialog footer form head iframe input label menu nav noscript object option script select style svg template textarea title".split())
#: Words of a class or id that mark an element as not main text, as marked() says; a word ends at a hyphen, underscore, digit or capital.
MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr "
    "login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related reply "
    "replies respond responses share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that say no more than where an element stands.
PLACES = frozenset("area bar block bottom box button buttons container inner item items left links list main outer page primary right row secondary section site top wrap wrapper".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li pre td dd dt blockquote".split())
#: Steps above a block that its text counts for; 2 ** -ABOVE of it is nothing.
ABOVE = 48
ROLES = frozenset("alert banner complementary contentinfo dialog form menu navigation search".split())
#: What an open element ends at when a sibling of its kind begins.
ENDED_BY = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tr": ("tr td th", ("table",)), "option": ("option", ("select",))}
#: Attributes by which an element says what it is.
SAYS = ("class", "id", "hidden", "aria-hidden", "role")
#: The common form of tags and attributes, read in one step; elements with text of their own kind go the long way.
START, PAIRS, END = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z][a-z-]*="[^"&<>]*")*)>'), re.compile(r' ([a-z][a-z-]*)="([^"]*)"'), re.compile(r"</([a-z][a-z0-9]*)>")
RAW = frozenset("script style textarea title iframe noembed noframes noscript plaintext xmp".split())


def general(tag: str, attrs: dict[str, str]) -> str:
    """The element's step in a path: tag and classes, digits left out."""
    names = sorted({re.sub(r"\d+", "", c) for c in attrs.get("class", "").lower().split()} - {""})
    return ".".join([tag, *names])


def marked(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether an element is not main text by what it says of itself. A class or id says so as a whole: its
    last word is one of MARKS (site-footer, cookieNotice), or all are of MARKS or PLACES (menu-left)."""
    if tag in DROPPED or tag == "header" and not in_article or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in ROLES:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        said = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)]
        if said and (said[-1] in MARKS or any(w in MARKS for w in said) and all(w in MARKS or w in PLACES for w in said)):
            return True
        if tag == "div" and said and said[-1] in ("header", "head") and not in_article:
            return True
    return False


@lru_cache(maxsize=4096)
def step_and_mark(tag: str, said: tuple[str | None, ...], in_article: bool) -> tuple[str, bool]:
    """general() and marked() of an element that has those values of SAYS."""
    named = {k: v for k, v in zip(SAYS, said) if v is not None}
    return general(tag, named), marked(tag, named, in_article)


class Blocks(HTMLParser):
    """The blocks of a page, in order: (path, text, characters in links). Paths are numbered; path 0 is that of
    no element, and each other one is a step below its parent, so that a deep page takes no more room than a flat one."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        #: Open elements: (tag, path, hidden); and how many there are of each tag.
        self.open: list[tuple[str, int, bool]] = []
        self.count: defaultdict[str, int] = defaultdict(int)
        self.steps: list[tuple[int, str]] = [(0, "")]
        self.numbers: dict[tuple[int, str], int] = {}
        self.found: list[tuple[int, str, int]] = []
        self.text: list[str] = []
        self.links = 0
        self.feed(html)
        self.close()
        self.flush()

    def path(self) -> int:
        return self.open[-1][1] if self.open else 0

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for lines

    def parse_starttag(self, i: int) -> int:
        m = START.match(self.rawdata, i)
        if not m or m[1] in RAW:
            return super().parse_starttag(i)
        self.lasttag = m[1]
        self.handle_starttag(m[1], PAIRS.findall(m[2]) if m[2] else ())
        return m.end()

    def parse_endtag(self, i: int) -> int:
        m = None if self.cdata_elem else END.match(self.rawdata, i)
        if not m or m[1] in RAW:
            return super().parse_endtag(i)
        self.handle_endtag(m[1])
        return m.end()

    def flush(self) -> None:
        if not self.text:
            return
        text = " ".join("".join(self.text).split())
        if text:
            self.found.append((self.path(), text, min(self.links, len(text))))
        self.text, self.links = [], 0

    def pop_to(self, depth: int) -> None:
        if depth == len(self.open) - 1:
            tag = self.open[-1][0]
            if tag in BLOCK:
                self.flush()
            self.count[tag] -= 1
            self.open.pop()
            return
        if any(t in BLOCK for t, _, _ in self.open[depth:]):
            self.flush()
        for t, _, _ in self.open[depth:]:
            self.count[t] -= 1
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.text.append(" ")
            return
        if tag in BLOCK:
            self.flush()
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == "p":
                    self.pop_to(i)
                    break
                if self.open[i][0] in BLOCK:
                    break
        if tag in ENDED_BY:
            ends, bounds = ENDED_BY[tag]
            ends = ends.split()
            for i in range(len(self.open) - 1, -1, -1) if any(self.count[t] > 0 for t in ends) else ():
                if self.open[i][0] in bounds:
                    break
                if self.open[i][0] in ends:
                    self.pop_to(i)
                    break
        named = {k: v or "" for k, v in attrs}
        above = bool(self.open) and self.open[-1][2]
        said = tuple(map(named.get, SAYS))
        look = step_and_mark if sum(map(len, filter(None, said))) <= 256 else step_and_mark.__wrapped__  # the cache holds short ones
        step, own = look(tag, said, self.count["article"] > 0)
        hidden = above or own
        if hidden and tag not in BLOCK and not above:
            self.text.append(" ")
        at = self.path()
        if tag in BLOCK:  # inline elements are no containers: they have the path of what they stand in
            key = (at, step)
            if key not in self.numbers:
                self.numbers[key] = len(self.steps)
                self.steps.append(key)
            at = self.numbers[key]
        self.open.append((tag, at, hidden))
        self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.count[tag] <= 0:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.pop_to(i)
                return

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][2]:
            return
        self.text.append(data)
        if self.count["a"] > 0:
            self.links += len(data)

    def name(self, path: int) -> str:
        """The steps of a path from the root."""
        steps = []
        while path:
            path, step = self.steps[path]
            steps.append(step)
        return ">".join(reversed(steps))

    def number(self, name: str) -> int | None:
        """The path of that name, if the page has it."""
        at = 0
        for step in name.split(">"):
            at = self.numbers.get((at, step), -1)
            if at < 0:
                return None
        return at


def parsed(html: str | None) -> Blocks:
    return Blocks(html or "")


def container_scores(page: Blocks) -> dict[int, float]:
    """By path the characters outside links of the blocks in its elements, whole for the element that holds
    the block, less by half for every step above up to ABOVE. The names article and main count double."""
    scores: dict[int, float] = {}
    for path, text, links in page.found:
        value = float(len(text) - links)
        # a block's own p, h1 or li is not its container
        if page.steps[path][1].split(".")[0] in LEAVES and page.steps[path][0]:
            path = page.steps[path][0]
        for _ in range(ABOVE):
            if not path or value <= 0:
                break
            scores[path] = scores.get(path, 0.0) + value
            path, value = page.steps[path][0], value / 2
    return {p: s * (2 if page.steps[p][1].split(".")[0] in ("article", "main") else 1) for p, s in scores.items()}


def best_path(page: Blocks, scores: dict[int, float]) -> int | None:
    """The path of the best score, of equal ones the first on the page."""
    return min(scores, key=lambda p: (-scores[p], p)) if scores else None


def text_of(page: Blocks, path: int, repeated: set[str]) -> str:
    """The main text: every block in the container; and of those around it, such as a headline or a lead that stands before it, the
    ones that are neither mostly links nor repeated over the host."""
    under = [False] * len(page.steps)
    for p, (parent, _) in enumerate(page.steps):  # a path stands after its parent
        under[p] = p == path or (p > 0 and under[parent])
    return "\n".join(text for p, text, links in page.found if under[p] or (2 * links < len(text) and mark_of(text) not in repeated))


def mark_of(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def extract_main_text(pages: DataFrame, min_share: float = 0.02, repeat_share: float = 0.5) -> DataFrame:
    """The main text of every page, by the container paths that its host's pages agree on.

    pages: url, html and any other columns. Returned: those columns, host, text (empty if none), n_chars
    long (its code points) and path, the container's. Each page votes for the generalised tag-class
    path of its best-scored container; a host's paths with min_share of its votes or more are its
    winners, and a page is read again by the most voted of them whose score on the page is at least
    half of its own best, which keeps a page of another layout from being read by a corner of it; else by its own.
    The text is every block of the container, and around it the blocks that are not mostly links and not found on three pages of the host or more and
    on repeat_share of them. What says by tag, role, class or id that it is something else is no block at all.
    Character references are decoded, white space in a block is one space, blocks stand in page order, one a line; br is white space.

    A null or empty html has the empty text and a null path. A null url or one without a host is of the
    host "". Paths of equal votes go by name, containers of equal score by their place on the page. Repeated rows vote each. A page is
    parsed by one task, at some hundred bytes an element, however deep. Columns with the names returned are replaced; others may have
    any name. An empty table gives no rows.
    """
    given = Aside(pages, ("host", "text", "n_chars", "path"))
    host = F.lower(F.regexp_extract(F.coalesce(given.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    hosted = given.df.withColumns({"host": host, "html": given.col("html")})

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: Counter[tuple] = Counter()
            for name, html in zip(batch["host"], batch["html"]):
                page = parsed(html)
                own = best_path(page, container_scores(page))
                if own is not None:
                    rows[name, "path", page.name(own)] += 1
                    rows.update((name, "block", m) for m in {mark_of(t) for _, t, _ in page.found})
            yield pd.DataFrame([(*key, n) for key, n in rows.items()], columns=["host", "kind", "what", "n"])

    votes = hosted.select("host", "html").mapInPandas(vote, "host string, kind string, what string, n long")
    counted = Stash(votes.groupBy("host", "kind", "what").agg(F.sum("n").alias("n")).where("kind = 'path' or n >= 3"), "votes")
    totals = Stash(counted.df.where("kind = 'path'").groupBy("host").agg(F.sum("n").alias("all_n")), "totals")
    won = counted.df.join(totals.side(), "host").where(F.col("n") >= F.col("all_n") * F.when(F.col("kind") == "path", min_share).otherwise(repeat_share))
    # at most 1 / min_share paths a host, and as many blocks as 1 / repeat_share pages hold
    of = lambda kind: F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct((-F.col("n")).alias("minus"), "what")))), lambda x: x["what"]))
    winners = Stash(won.groupBy("host").agg(of("path").alias("winners"), of("block").alias("repeated")), "winners")
    counted.drop()
    totals.drop()
    out = hosted.join(winners.side(), "host", "left")
    shape = StructType([*out.schema.fields, StructField("text", StringType()), StructField("path", StringType())])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, paths = [], []
            for html, listed, repeated in zip(batch["html"], batch["winners"], batch["repeated"]):
                page = parsed(html)
                scores = container_scores(page)
                own = best_path(page, scores)
                fit = (p for p in map(page.number, (listed or "").split("\n")) if own and scores.get(p, 0.0) >= scores[own] / 2)
                path = next(fit, own)
                paths.append(page.name(path) if path else None)
                # text outside all elements is main text where no element holds any
                bare = any(p == 0 for p, _, _ in page.found)
                texts.append(text_of(page, path or 0, set((repeated or "").split("\n"))) if path or bare else "")
            yield batch.assign(text=texts, path=paths)

    return out.mapInPandas(read, shape).select(*given.back(), "host", "text", F.length("text").cast("long").alias("n_chars"), "path")
