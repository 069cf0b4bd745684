"""Main-text extraction from HTML by tag-path ratios.

A page is cut into text blocks, each with the path of tags from the root to it. Text length, punctuation and link text
are aggregated per path; the ratios are smoothed over the blocks in page order, fused with each other and with what
the tags and class names say, and a threshold on the fused ratio chooses the content paths. A name that marks boilerplate is a
factor like the others, and none where the element holds an article or most of the text. The smallest container that holds
all chosen blocks gives the result, with its headings and short paragraphs but without its boilerplate subtrees.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

# Element names of HTML by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
SKIP = set(
    "script style noscript template title textarea xmp iframe noembed noframes plaintext head nav footer aside button select option "
    "datalist svg math canvas object audio video map dialog menu input".split()
)
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An opening tag of the left closes an open element of the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: White space as HTML has it, and the no-break space.
SPACE = " \t\n\r\f\v\xa0               　 \x85"

#: A tag; possessive, so that it is found or not in one go.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: The same where a quote of an earlier tag was never closed: a quote then means nothing.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
COMMENT_END = re.compile(r"--!?>")
ATTR = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
BLANK = re.compile(f"[{SPACE}]+")
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？；：]")
#: Words in a class, id or role that mark boilerplate, each at a word's start or end.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side|aside|footer|foot|"
    r"header|masthead|topbar|toolbar|comments?|commentlist|disqus|replies|reply|respond|share|sharing|social\w*|cookie\w*|consent|gdpr|notice\w*|alert|popup|"
    r"modal|overlay|newsletter|subscri\w*|signup|login|related|recommend\w*|widget\w*|pager|pagination|copyright|legal|disclaimer|skip\w*|hidden|search\w*|"
    r"tags|taglist|navigation|contentinfo|complementary|dialog|form)(?=$|[\s_-])",
    re.I,
)
#: Of these, what readers write: it can be longer than the article and hold articles of its own.
TALK = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|reply|respond)(?=$|[\s_-])", re.I)
#: Of these, what an article can be about: within a longer name, in an article, its element is boilerplate only if it doesn't read like prose.
TOPIC = re.compile(r"(?<=[_-])(?:share|sharing|search\w*|legal|side|foot|tags|alert|notice\w*|social\w*|related|form|skip\w*|header)(?=$|[\s_-])|(?:share|sharing|search\w*|legal|side|foot|tags|alert|notice\w*|social\w*|related|form|skip\w*|header)(?=[_-])", re.I)
#: Names that nothing but an article inside overrules, however much of the page their element has.
STRUCTURE = re.compile(r"(?:^|\s)(?:nav|navigation|menu|breadcrumbs?|sidebar|aside|footer|cookies?|consent|newsletter|copyright|contentinfo|complementary)(?=$|\s)", re.I)
#: A header that is an article's title, not the site's.
HEADER = re.compile(r"(?:^|[\s_-])header(?=$|[\s_-])", re.I)
TITLED = re.compile(r"(?:article|post|entry|story|content|main)[_-]+header(?=$|[\s_-])", re.I)
#: A noisy name is overruled if the element holds an article with the second share of the page's text, or the first share where no article has the second.
MOST, ARTICLE = 0.5, 0.25
#: Prose has so many characters for each one of a link or of punctuation.
PROSE = 8
#: The factor of a noisy name that is not.
NOISY = 0.1
MAIN = re.compile(r"(?:^|[\s_-])(?:article\w*|main\w*|content|post\w*|entry\w*|story\w*|body|text|page)(?=$|[\s_-])", re.I)

RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("blocks", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.StringType()))])


@dataclass(slots=True, eq=False)
class Node:
    """An element. What holds for all below it is handed down when it is made, so that no step walks up the tree."""

    parent: Node | None
    tag: str
    label: str = ""
    number: int = 0  # in the order of the opening tags
    path: int = 0  # number of the path of labels from the root to it, inline elements left out
    silent: bool = False  # its text is never shown
    link: bool = False
    prior: float = 1.0
    named: bool = False  # its own name marks boilerplate
    talk: bool = False  # ... that readers write
    topic: bool = False  # ... or, in an article, what it is about
    fixed: bool = False  # ... or a part of every page
    noisy: bool = False  # it or an element around it is named and not overruled
    top: bool = False  # in an article or main element
    block: Node | None = None  # the innermost element around it, or itself, that is not inline
    last: int = 0  # the largest number below it
    text: int = 0  # characters of its text but links
    links: int = 0  # characters of its links
    marks: int = 0  # its punctuation
    inner: int = 0  # most such characters of an article or main element below it
    main: bool = False  # a main element with text is below it


@dataclass
class Block:
    node: Node
    text: str
    link: int


@dataclass
class Page:
    """Parses a page into ``blocks``, in order. Unclosed and misnested tags end where the enclosing block ends; time is linear."""

    html: str
    nodes: list[Node] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)

    def __post_init__(self):
        root = Node(None, "")
        root.block = root
        self.nodes.append(root)
        # places in the stack of the open elements of each tag, and of those that are not inline
        self.stack, self.open, self.walls, self.paths = [root], defaultdict(list), [0], {}
        self.parts: list[str] = []
        self.linked = 0
        self.parse()
        self.flush()
        for n in reversed(self.nodes[1:]):
            p, is_top = n.parent, n.tag in ("article", "main")
            p.last, p.text, p.links, p.marks = max(p.last, n.last), p.text + n.text, p.links + n.links, p.marks + n.marks
            p.inner = max(p.inner, n.inner, n.text if is_top else 0)
            p.main = p.main or n.main or n.tag == "main" and n.text > 0

    def parse(self) -> None:
        html, at, start, tag = self.html, 0, 0, TAG
        while (start := html.find("<", start)) >= 0:
            follows = html[start + 1 : start + 2]
            if follows in ("!", "?"):
                self.add(html[at:start])
                if html.startswith("<!--", start):
                    m = COMMENT_END.search(html, start + 2)
                    end = m.end() if m else len(html)
                elif html.startswith("<![CDATA[", start):
                    end = html.find("]]>", start)
                    end = end + 3 if end >= 0 else len(html)
                else:
                    end = html.find(">", start)
                    end = end + 1 if end >= 0 else len(html)
                at = start = end
                continue
            m = tag.match(html, start) if follows == "/" or follows.isalpha() else None
            if m is None and tag is TAG and (follows == "/" and html[start + 2 : start + 3].isalpha() or follows.isalpha()):
                tag = PLAIN_TAG
                m = tag.match(html, start)
            if m is None:
                if tag is PLAIN_TAG and html.find(">", start) < 0:
                    break
                start += 1
                continue
            self.add(html[at:start])
            at = start = m.end()
            name = m[2].lower()
            if m[1]:
                self.close(name)
            elif self.begin(name, m[3]) and name in RAW:
                end = _closing(name).search(html, at)
                at = start = end.start() if end else len(html)
        self.add(html[at:])

    def add(self, piece: str) -> None:
        top = self.stack[-1]
        if piece and not top.silent:
            self.parts.append(piece)
            if top.link:
                self.linked += len(BLANK.sub(" ", piece).strip())

    def flush(self) -> None:
        if self.parts:
            text = BLANK.sub(" ", unescape("".join(self.parts))).strip(" ")
            self.parts.clear()
            if text:
                node = self.stack[-1].block
                self.blocks.append(Block(node, text, min(self.linked, len(text))))
                node.text += len(text) - self.blocks[-1].link
                node.links += self.blocks[-1].link
                node.marks += len(PUNCTUATION.findall(text))
        self.linked = 0

    def pop(self) -> Node:
        n = self.stack.pop()
        self.open[n.tag].pop()
        if n.tag not in INLINE:
            self.walls.pop()
        return n

    def close(self, tag: str) -> None:
        if not self.open[tag]:
            return
        if tag not in INLINE:
            self.flush()
        elif self.open[tag][-1] < self.walls[-1]:
            return  # an inline element can only be closed within its block
        while self.pop().tag != tag:
            pass

    def begin(self, tag: str, rest: str) -> bool:
        """Opens an element; whether it has content."""
        if tag == "br":
            self.parts.append(" ")
        if tag not in INLINE:
            self.flush()
            if tag not in VOID:
                i = self.walls[-1]
                ended = self.stack[i].tag
                if ended in CLOSES.get(tag, ()) or ended == "p" or ended in HEADING and tag in HEADING:
                    while len(self.stack) > i:
                        self.pop()
        if tag in VOID or rest.endswith("/") and tag not in RAW:
            return False
        attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTR.findall(rest)} if rest else {}
        name = " ".join(attrs.get(k, "") for k in ("class", "id", "role")).strip()
        p = self.stack[-1]
        n = Node(p, tag, f"{tag}.{'.'.join(name.split())}" if name else tag, len(self.nodes))
        n.last = n.number
        hidden = re.search(r"(?<![\w-])hidden(?![\w-])", rest) is not None and "hidden" not in name or attrs.get("aria-hidden") == "true"
        hidden = hidden or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        n.silent = p.silent or tag in SKIP or hidden
        n.link, n.top = p.link or tag == "a", p.top or tag in ("article", "main")
        clean = (HEADER if p.top else TITLED).sub(" ", name)
        if tag not in ("article", "main", "body", "html"):
            n.named = tag == "form" or tag == "header" and not p.top and not TITLED.search(name) or bool(name) and bool(NOISE.search(clean))
            n.talk = n.named and bool(TALK.search(name))
            n.topic = n.named and p.top and not n.talk and not NOISE.search(TOPIC.sub("x", clean))
            n.fixed = n.named and bool(STRUCTURE.search(name))
        n.prior, n.block, n.path = p.prior, p.block, p.path
        if tag not in INLINE:
            own = 4.0 if tag in ("article", "main") or attrs.get("role") in ("main", "article") or attrs.get("itemprop") == "articleBody" else 2.0 if name and MAIN.search(name) else 1.0
            n.prior, n.block, n.path = max(p.prior, own), n, self.paths.setdefault((p.path, n.label), len(self.paths) + 1)
        self.nodes.append(n)
        self.open[tag].append(len(self.stack))
        if tag not in INLINE:
            self.walls.append(len(self.stack))
        self.stack.append(n)
        return True

    def mark(self) -> None:
        """Tell which elements are boilerplate by a name that nothing overrules."""
        total, article = self.nodes[0].text, self.nodes[0].inner
        for n in self.nodes[1:]:
            holds = n.inner >= max(1, ARTICLE * total)
            prose = n.topic and n.marks > 0 and n.text >= PROSE * (n.links + n.marks)
            spared = holds and n.main if n.talk else holds or prose or not n.fixed and n.text > MOST * total and article < ARTICLE * total
            n.noisy = n.parent.noisy or n.named and not spared


@functools.cache
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I)


def extract(html: str | None, *, width: int = 1, level: float = 0.5) -> list[Block]:
    """The content blocks of a page: ``width`` blocks on either side smooth the ratios, ``level`` scales the threshold."""
    page = Page(html or "")
    page.mark()
    found = page.blocks
    if not found:
        return []
    total: dict[int, list[float]] = defaultdict(lambda: [0.0] * 4)
    for b in found:
        t = total[b.node.path]
        for i, x in enumerate((1, len(b.text), len(PUNCTUATION.findall(b.text)), b.link)):
            t[i] += x
    ratio = {p: (n, chars / n * (1 - link / chars), 1 + marks / n) for p, (n, chars, marks, link) in total.items()}
    kernel = [math.exp(-(d * d) / (2 * max(width, 1) ** 2)) for d in range(-width, width + 1)]
    quiet = [b for b in found if not b.node.noisy] or found
    place = {id(b): i for i, b in enumerate(quiet)}
    score = []
    for b in found:
        own = ratio[b.node.path]
        smooth = own[1]
        if (i := place.get(id(b))) is not None:  # boilerplate is no neighbour
            near = [(kernel[d + width], ratio[quiet[i + d].node.path]) for d in range(-width, width + 1) if 0 <= i + d < len(quiet)]
            smooth = sum(k * r[1] for k, r in near) / sum(k for k, _ in near)
        score.append(math.log1p(math.sqrt(smooth * own[1])) * math.log2(1 + own[2]) * b.node.prior * (NOISY if b.node.noisy else 1))
    fused: dict[int, float] = defaultdict(float)
    for b, s in zip(found, score, strict=True):
        fused[b.node.path] = max(fused[b.node.path], s)
    of = [fused[p] for p in {b.node.path for b in quiet}]
    mean = sum(of) / len(of)
    spread = math.sqrt(sum((x - mean) ** 2 for x in of) / len(of))
    best = max(fused.values())
    cut = min(best, max(level * spread, best / 2))
    chosen = [fused[b.node.path] >= cut and (not b.node.noisy or s >= cut) for b, s in zip(found, score, strict=True)]
    # the innermost container, not a paragraph itself, that holds all chosen blocks: that of the first and the last element
    ends = [b.node for b, on in zip(found, chosen, strict=True) if on]
    low, high = min(ends, key=lambda n: n.number), max(ends, key=lambda n: n.number)
    root = low.parent or low
    while root.parent is not None and not (root.number <= high.number <= root.last and root.tag not in INLINE and root is not high):
        root = root.parent
    keep = lambda b, on: on or not b.node.noisy and (b.node.tag in HEADING or b.node.prior >= 2 or b.link * 2 <= len(b.text))
    return [b for b, on in zip(found, chosen, strict=True) if root.number <= b.node.number <= root.last and keep(b, on)]


def main_text(pages: DataFrame, *, html: str = "html", into: str = "main") -> DataFrame:
    """``pages`` with a struct column ``into``: text (blocks joined by an empty line), blocks and the labels of their elements.

    Null, empty and text-free pages give an empty text and no blocks. Whole pages are read, however long. All columns of
    ``pages`` stay; one that is called ``into`` is replaced.
    """
    small_batches(pages.sparkSession)

    @F.pandas_udf(RESULT)
    def run(htmls: pd.Series) -> pd.DataFrame:
        rows = []
        for h in htmls:
            got = extract(h)
            rows.append(("\n\n".join(b.text for b in got), [b.text for b in got], [b.node.label for b in got]))
        return pd.DataFrame(rows, columns=["text", "blocks", "labels"])

    return pages.withColumn(into, run(F.col(html)))
