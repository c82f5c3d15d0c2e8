"""Main text of web pages by consensus host paths.

1. Every page's containers are scored by the paragraphs they hold (length, commas, few links, telling names). The
   page votes for the generalised path of its best one: tags with classes from the body down, digits made equal.
2. Votes add up per host, each page's with the share of its text that the container holds, so long pages and short
   ones count alike. The path with the most votes wins.
3. Every page is read again with its host's path. A page that lacks it, or has no text there, keeps its own best
   container, and one without any container the text that is left of its body.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments of readers are left out by
tag, role and the words of class and id; words leave nothing out that holds the page's article or most of its text.
Within an article or main element a name must say so as a whole ("share-buttons", but not "social-security"), or have a
listed word and stand over links mostly; names of inline elements say nothing. A container within an article stands for
all of it. What stands beside the chosen container comes along if it is of one piece with it: headings before it,
paragraphs that are sentences, containers of the same kind or of a score near to its own. White space within a block,
line breaks included, becomes one blank; blocks are joined by a line feed.

Defined results: null and empty html gives an empty text; pages without a host keep their own best container;
repeated rows are read one by one; markup may be cut off or not closed anywhere; a page is read as a whole, whatever its
length; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .common import pieces, table

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
# a quote opens a value only after an equals sign; one that nothing closes is a sign like others
_TAG_END = re.compile(r"""(?:[^>=]|=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)?+)*+>""")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# elements that are skipped with all they hold: up to their end tag, or else the page's end
RAW = frozenset("script style textarea title".split())
# up to the end tag that belongs to them; without one only the tag itself
SKIPPED = frozenset("xmp iframe noembed noframes noscript template svg annotation annotation-xml button select label object canvas audio video".split())
_SKIPPED = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(sorted(RAW))})(?=[\s/>]).*?(?:</\1|\Z)|<(/?)({'|'.join(sorted(SKIPPED, key=len, reverse=True))})(?=[\s/>])", re.I | re.S
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead tr ul video audio select button".split()
)
CONTAINERS = frozenset("article main section div td body blockquote center".split())
LEFT_OUT = frozenset("nav footer aside form menu dialog fieldset head".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination "
    "popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
GOOD_WORDS = frozenset("article body content entry main page post story text blog".split())
POST_WORDS = frozenset("article entry post story".split())
# words that say of a name only what kind of box it is
BOX_WORDS = frozenset("area bar block body box button buttons container content form group icons inner item items link links list posts row section wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 hgroup header".split())
RUNNING = frozenset("p pre blockquote ul ol dl table figure h4 h5 h6".split())
# an open element of the first kind ends where one of the second kind begins
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
SCOPES = frozenset("ul ol table article section div main body dl td th".split())


# why an element is left out: by its tag, role or style; by its name; as what readers write; by a word of its name, if it is links
SURE, LIKELY, OF_READERS, IF_LINKS = 1, 2, 3, 4
READERS = frozenset("comment comments disqus replies reply respond".split())
_STATE = re.compile(r"(?:has|no|with|without)[-_]", re.I)


def _left_out(name: str) -> bool:
    """Whether a class or id has a word that is left out; names of states ("has-sidebar") and of a page builder have none."""
    words = {w.lower() for w in _WORDS.findall(name)}
    if "elementor" in words:
        words -= {"widget", "widgets"}
    return not _STATE.match(name) and bool(words & LEFT_OUT_WORDS)


def _says_so(name: str) -> bool:
    """Whether a class or id is made of words that are left out, and of words for boxes."""
    words = [w.lower() for w in _WORDS.findall(name)]
    return _left_out(name) and all(w in LEFT_OUT_WORDS or w in BOX_WORDS for w in words)


def _ends(html: str) -> dict[int, int]:
    """Where the elements of SKIPPED end, by where they begin; those that nothing closes are missing."""
    open_: dict[str, list[int]] = {}
    out = {}
    for m in _SKIPPED.finditer(html):
        if not m[3]:
            continue
        tag, gt = m[3].lower(), html.find(">", m.end())
        if not m[2]:
            if tag != "svg" or gt < 0 or html[gt - 1] != "/":
                open_.setdefault(tag, []).append(m.start())
        elif open_.get(tag):
            out[open_[tag].pop()] = gt + 1 or len(html)
    return out


def _inline_end(html: str, tag: str, at: int) -> int:
    """Behind the end tag of an inline element, over those of its own kind within it; where it stands if there is none."""
    depth = 1
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I).finditer(html, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return at


class Page:
    """Nodes (parent, tag, label, mark, words) and blocks (node, text, letters in links) of a page."""

    def __init__(self, html: str) -> None:
        self.parent, self.tag, self.label, self.mark, self.names = [-1], ["#"], [""], [0], [frozenset()]
        self.blocks: list[tuple[int, str, int]] = []
        self._stack, self._text, self._links, self._in_link = [0], [], 0, 0
        self._read(html)

    # ---- reading

    def _flush(self) -> None:
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            if text:
                self.blocks.append((self._stack[-1], text, self._links))
            self._text, self._links = [], 0

    def _add(self, text: str) -> None:
        if text:
            self._text.append(text)
            if self._in_link:
                self._links += len(text.strip())

    def _open(self, tag: str, attributes: str) -> None:
        above = self._stack[-1]
        found = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
        names = frozenset(w.lower() for k in ("class", "id") if k in found for w in _WORDS.findall(found[k]))
        inside_article = any(self.tag[n] in ("article", "main") for n in self._stack)
        mark = 0
        if (
            (tag in LEFT_OUT and tag != "form") or (tag == "header" and not inside_article) or found.get("role", "").lower() in LEFT_OUT_ROLES
            or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(found.get("style", "")))
        ):
            mark = SURE
        elif tag == "form":
            mark = LIKELY
        elif names & (LEFT_OUT_WORDS | {"header"}) and tag not in ("html", "body", "article", "main"):
            tokens = [t for k in ("class", "id") for t in found.get(k, "").split()]
            if any(t.lower() in READERS for t in tokens):
                mark = OF_READERS
            elif any((_says_so if inside_article or tag in HEADINGS else _left_out)(t) for t in tokens):
                mark = LIKELY
            elif tag in ("div", "section") and not inside_article and any(t.lower() in ("header", "site-header", "page-header") for t in tokens):
                mark = LIKELY
            elif any(_left_out(t) for t in tokens):
                mark = IF_LINKS
        self.parent.append(above)
        self.tag.append(tag)
        self.label.append(".".join([tag, *sorted({re.sub(r"\d+", "0", c) for c in found.get("class", "").split()})]))
        self.mark.append(mark)
        self.names.append(names)
        self._stack.append(len(self.tag) - 1)

    def _leave_out(self) -> None:
        """Drop the blocks of elements that are left out.

        A name is no reason to leave out what holds the page's main element, its largest article or most of its text.
        """
        n = len(self.tag)

        def inherited(marks: list) -> list[bool]:
            out = [False] * n
            for k in range(1, n):
                out[k] = out[self.parent[k]] or bool(marks[k])
            return out

        sure = inherited([m == SURE for m in self.mark])
        if any(m not in (0, SURE) for m in self.mark):
            letters, linked, articles, mains = [0] * n, [0] * n, [0] * n, [0] * n
            for node, text, links in self.blocks:
                if not sure[node]:
                    letters[node] += max(0, len(text) - links)
                    linked[node] += links
            for k in range(n - 1, 0, -1):
                letters[self.parent[k]] += letters[k]
                linked[self.parent[k]] += linked[k]
                articles[self.parent[k]] += articles[k] + (self.tag[k] == "article" and letters[k] > 0)
                mains[self.parent[k]] += mains[k] + (self.tag[k] == "main" and letters[k] > 0)
            self.mark = [0 if m == IF_LINKS and linked[k] <= letters[k] else m for k, m in enumerate(self.mark)]
            out = inherited(self.mark)
            free = max((letters[k] for k in range(n) if self.tag[k] in ("article", "main") and not out[k]), default=0)
            sure = inherited([
                m == SURE or (m > 0 and not (
                    mains[k] or (articles[k] and letters[k] > free) or (m == LIKELY and 2 * letters[k] > letters[0])
                )) for k, m in enumerate(self.mark)
            ])
        self.blocks = [b for b in self.blocks if not sure[b[0]]]

    def _close(self, tag: str) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            if self.tag[self._stack[k]] == tag:
                del self._stack[k:]
                return

    def _implied_end(self, tag: str) -> None:
        if tag in BLOCKS:
            for k in range(len(self._stack) - 1, 0, -1):
                name = self.tag[self._stack[k]]
                if name == "p":
                    del self._stack[k:]
                    break
                if name in SCOPES:
                    break
        for k in range(len(self._stack) - 1, 0, -1):
            name = self.tag[self._stack[k]]
            if tag in CLOSES.get(name, ()):
                del self._stack[k:]
                return
            if name in ("ul", "ol", "table", "dl") or name in ("article", "section", "div", "main", "body"):
                return

    def _read(self, html: str) -> None:
        at, n, lower, ends = 0, len(html), None, None
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self._add(html[at:])
                break
            self._add(html[at:lt])
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            mark = html[lt + 1 : lt + 2]
            if mark in ("!", "?"):
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            closing = mark == "/"
            name = _NAME.match(html, lt + 1 + closing)
            if not name:
                self._add("<")
                at = lt + 1
                continue
            end = _TAG_END.match(html, name.end())
            stop = end.end() if end else html.find(">", name.end()) + 1
            if not stop:  # cut off within a tag
                break
            tag, at = name.group().lower(), stop
            block = tag in BLOCKS
            if block:
                self._flush()
            if closing:
                if tag == "a":
                    self._in_link = max(0, self._in_link - 1)
                elif block or tag not in VOID:
                    self._close(tag) if block or self.tag[self._stack[-1]] == tag else None
                continue
            if tag in RAW:
                lower = html.lower() if lower is None or len(lower) != n else lower
                stop = lower.find(f"</{tag}", at)
                if stop < 0:
                    at = n
                else:
                    gt = html.find(">", stop)
                    at = n if gt < 0 else gt + 1
                continue
            if tag in SKIPPED:
                if tag != "svg" or html[at - 2] != "/":
                    ends = _ends(html) if ends is None else ends
                    at = ends.get(lt, at)
                continue
            if tag == "br":
                self._add(" ")
            elif tag == "a":
                self._in_link += 1
            elif block and tag not in VOID:
                self._implied_end(tag)
                self._open(tag, html[name.end() : at - 1])
            elif tag in ("span", "ins", "del", "small", "time") and not html.startswith(">", name.end()):
                # an inline element that isn't shown; what its names say is no reason
                self._open(tag, html[name.end() : at - 1])
                if self.mark[self._stack[-1]] == SURE:
                    at = _inline_end(html, tag, at)
                self.mark[self._stack.pop()] = 0
        self._flush()
        self._leave_out()

    # ---- scoring

    def path(self, node: int) -> str:
        parts = []
        while node > 0:
            if self.tag[node] != "html":
                parts.append(self.label[node])
            node = self.parent[node]
        return ">".join(reversed(parts))

    def best(self) -> tuple[int, float]:
        """(the container with the highest score, the share of the page's text that it holds); (-1, 0.0) without one."""
        scores: dict[int, float] = {}
        inside: dict[int, int] = {}
        linked: dict[int, int] = {}
        total = 0
        for node, text, links in self.blocks:
            total += len(text)
            worth = min(len(text) / 25, 1.0) + text.count(",") + min(len(text) / 100, 3.0) if links < len(text) / 2 else 0.0
            share = 1.0
            while node > 0:
                if self.tag[node] in CONTAINERS:
                    inside[node] = inside.get(node, 0) + len(text)
                    linked[node] = linked.get(node, 0) + links
                    if share > 0.2:
                        scores[node] = scores.get(node, 0.0) + worth * share
                        share /= 2
                node = self.parent[node]
        best, most = -1, 0.0
        self.scores = {}
        for node, score in scores.items():
            hint = 1.5 if self.tag[node] in ("article", "main") else 1.2 if self.names[node] & GOOD_WORDS else 1.0
            score *= hint * (1 - linked[node] / max(inside[node], 1))
            self.scores[node] = score
            if score > most or (score == most and best >= 0 and score > 0 and node < best):
                best, most = node, score
        best = self._widened(best)
        return (best, inside[best] / max(total, 1)) if best >= 0 else (-1, 0.0)

    def _widened(self, node: int) -> int:
        """The article around a container, or else the main element, or else the parent that is named as a post: headline and lead stand there."""
        way, k = [], node
        while k > 0:
            way.append(k)
            k = self.parent[k]
        for tag in ("article", "main"):
            for k in way:
                if self.tag[k] == tag:
                    return k
        for k in way[1:2]:
            if self.tag[k] in ("div", "section", "td") and self.names[k] & POST_WORDS:
                return k
        return node

    def _beside(self, chosen: set[int], agreed: bool) -> tuple[set[int], set[int]]:
        """(the containers and what is of one piece with them, parents whose own sentences are).

        Where the host's pages agreed on the container, no other one comes along for its score alone.
        """
        n = len(self.tag)
        letters, linked, last = [0] * n, [0] * n, [""] * n
        for node, text, links in self.blocks:
            letters[node] += len(text)
            linked[node] += links
            last[node] = text
        own = {k: (letters[k], linked[k], last[k]) for k in {self.parent[c] for c in chosen}}
        for k in range(n - 1, 0, -1):
            above = self.parent[k]
            letters[above] += letters[k]
            linked[above] += linked[k]
            last[above] = last[k] if not last[above] else last[above]
        around: dict[int, list[int]] = {}
        for k in range(1, n):
            if self.parent[k] in own and letters[k] and k not in chosen:
                around.setdefault(self.parent[k], []).append(k)

        def sentence(size: int, links: int, text: str) -> bool:
            return 4 * links < size and (size > 80 or (not links and text[-1:] in ".!?:\u2026\u3002"))

        more, parents = set(chosen), set()
        for c in chosen:
            above = self.parent[c]
            if above <= 0 or self.tag[c] == "body":
                continue
            for k in around.get(above, ()):
                if 3 * linked[k] >= letters[k]:
                    continue
                tag, score = self.tag[k], self.scores.get(k, 0.0)
                if self.tag[c] in ("article", "main") and tag != "article":
                    joins = False  # they hold their headline themselves
                elif tag in HEADINGS:
                    joins = k < c
                elif tag in RUNNING:
                    joins = sentence(letters[k], linked[k], last[k]) and (tag == "p" or self.tag[above] != "body")
                elif tag in CONTAINERS:
                    same = self.label[k] == self.label[c] and (tag == "article" or "." in self.label[k])
                    near = not agreed and score >= 0.3 * self.scores.get(c, 0.0)
                    joins = score > 0 and (near or (same and letters[k] > 80))
                else:
                    joins = False
                if joins:
                    more.add(k)
            if self.tag[above] != "body" and own[above][0] and sentence(*own[above]):
                parents.add(above)
        return more, parents

    def text(self, path: str | None = None) -> str:
        """The text at a host's path, or of the page's own best container, or of all that is left."""
        best, _ = self.best()
        if path:
            last = path.rpartition(">")[2]
            chosen = {k for k in range(1, len(self.tag)) if self.label[k] == last and self.path(k) == path}
            if chosen and self._under(chosen, set()):
                return self._under(*self._beside(chosen, True))
        return self._under(*self._beside({best}, False)) if best >= 0 else "\n".join(t for _, t, _ in self.blocks)

    def _under(self, chosen: set[int], parents: set[int]) -> str:
        held: dict[int, bool] = {}

        def within(node: int) -> bool:
            way = []
            while node > 0 and node not in held and node not in chosen:
                way.append(node)
                node = self.parent[node]
            answer = node > 0 and (node in chosen or held[node])
            for k in way:
                held[k] = answer
            return answer

        return "\n".join(t for node, t, _ in self.blocks if node in parents or within(node))


def host(url):
    """The lower-case host of a url column; null without one."""
    name = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))
    return F.when(name != "", name)


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, weight): each page's vote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html", 1 << 21):
                hosts, paths, weights = part.column(part.schema.get_field_index("host")).to_pylist(), [], []
                for source in part.column(part.schema.get_field_index("html")).to_pylist():
                    page = Page(source or "")
                    node, share = page.best()
                    paths.append(page.path(node) if node >= 0 else None)
                    weights.append(round(share, 6))
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(weights, pa.float64())], names=["host", "path", "weight"])

    voters = pages.select(host(F.col("url")).alias("host"), "html").where(F.col("host").isNotNull())
    return voters.mapInArrow(run, "host string, path string, weight double").where(F.col("path").isNotNull())


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with the most votes of each host; of equals the first by name."""
    summed = votes(pages).groupBy("host", "path").agg(F.sum(F.col("weight").cast("decimal(18,6)")).alias("weight"))
    first = F.min_by("path", F.struct((-F.col("weight")).alias("w"), F.col("path")))
    return summed.groupBy("host").agg(first.alias("path"))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text and n_chars of every page, with its host's consensus path."""
    kinds = dict(pages.dtypes)
    paths = settle(host_paths(pages), "host-paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html", 1 << 21):
                column = lambda name: part.column(part.schema.get_field_index(name))  # noqa: E731, B023
                found = [Page(h or "").text(p) for h, p in zip(column("html").to_pylist(), column("_path").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[column(c) for c in keep], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                    names=[*keep, "text", "n_chars"],
                )

    named = pages.select(*keep, "html", host(F.col("url")).alias("_host"))
    known = paths.select(F.col("host").alias("_host"), F.col("path").alias("_path"))
    # pages without a host need no join, and would all meet in one task
    joined = named.where("_host is not null").join(known, "_host", "left").select(*keep, "html", "_path")
    alone = named.where("_host is null").select(*keep, "html", F.lit(None).cast("string").alias("_path"))
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "text string, n_chars bigint"])
    return joined.unionByName(alone).mapInArrow(run, schema)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
