"""Main text of HTML pages: flat text blocks, shallow features of a block and its neighbours, a decision tree.

A page becomes a list of blocks. Each has a word count, a link density (share of its words inside links), the same of
the blocks before and after it, its place (inside the article, inside a menu, header, footer, sidebar, notice, advert,
form or comment, or neither) and whether it stands outside a page's marked article. Spark ML fits a decision tree to
the blocks of a small labelled table of pages; the blocks that it takes for content are the main text. Where a page marks
its article the marks decide; elsewhere a block's own size and links and those of its neighbours do. Pages are rows,
a page's work depends on that page alone, and the tree (a few nodes) goes out with the tasks: no shuffle.
"""

from __future__ import annotations

import html
import re
from itertools import islice
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import batches

FEATURES = ["words", "density", "words_before", "density_before", "words_after", "density_after", "place", "outside"]
DEPTH = 8

#: Elements by their role in HTML, and names that pages give to parts other than the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small strike strong sub sup time tt u var svg".split())
#: MathML is text of its paragraph.
INLINE |= set("math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mphantom mfenced menclose mtable mtr mtd semantics".split())
GAP = set("br img input wbr".split())
NOT_ARTICLE = set("nav header footer aside form menu dialog button select label fieldset".split())
ARTICLE = {"article", "main"}
OTHER_NAMES = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup sidebar aside menu nav navbar navigation breadcrumb "
    "breadcrumbs footer header masthead topbar toolbar share sharing social related recommended widget login search pagination pager "
    "copyright legal disclaimer hidden toc".split()
)
REMARK_NAMES = set("comment comments commentlist disqus reply replies respond discussion".split())
OTHER_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
ARTICLE_NAMES = set("article content post entry story".split())
#: In a class name of several words the last one names the element, and some of the others when they come first.
FIRST_NAMES = set("ad ads advert advertisement sponsored promo cookie cookies newsletter related share sharing comment comments nav footer sidebar breadcrumb menu".split())
#: Class names with one of the former words, or that end in one of the latter, tell what a page has or how it is laid out.
STATE = set("has no not without with is in hide show".split())
STATE_LAST = set("page layout template enabled disabled open closed on off free".split())
#: A class name that begins so says what an article is about; page builders put every paragraph into a "...-widget".
TOPIC_FIRST = set("category cat tag topic term taxonomy section keyword".split())
LAYOUT_LAST = {"widget"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|head|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|(?P<open>(?=<body\b))|\Z)"
    r"|<(?P<empty>svg|canvas|video|audio)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?<=/)>"
    r"|<(?P<drawn>svg)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:(?!<(?:article|main|section|div|p|h[1-6]|ul|ol|table|blockquote)\b).)*?</svg\s*>"
    r"|<(?P<media>canvas|video|audio)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:(?!<(?:(?P=media)|article|main|h[1-6])\b).)*?</(?P=media)\s*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s>/]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*>|<[!?][^>]*>",
    re.S | re.I,
)
#: An attribute and its value: values are taken whole, so that no word inside one is read as a name.
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
WORD = re.compile(r"\S+")
FORM_END, WHOLE, PARAGRAPH = re.compile(r"</form\b", re.I), re.compile(r"<(?:article|main)\b", re.I), re.compile(r"<(?:p|h[1-3])\b", re.I)


def place_of(tag: str, rest: str) -> int:
    """1 article, 0 neither, -1 another part by name, -2 another part by element, or readers' remarks."""
    names: set[str] = set()
    for kind, value in ATTRIBUTE.findall(rest) if rest else ():
        kind, value = kind.lower(), value.strip("\"'").lower()
        if kind not in ("class", "id", "role", "hidden", "aria-hidden"):
            continue
        if kind == "role":
            names |= {"@" + x for x in value.split()}
        elif kind == "hidden" or kind == "aria-hidden" and value == "true":
            names.add("hidden")
        else:
            for name in value.split():
                parts = [x for x in re.split(r"[^a-z]+", name) if x]
                if len(parts) < 2:
                    names.update(parts)
                elif not STATE & set(parts) and parts[-1] not in STATE_LAST and parts[0] not in TOPIC_FIRST:
                    names.update([x for x in parts[-1:] if x not in LAYOUT_LAST] + [x for x in parts[:1] if x in FIRST_NAMES])
    if tag in NOT_ARTICLE or names & REMARK_NAMES:
        return -2
    if tag in ARTICLE:
        names -= {"widget", "search"}  # of a page's own article these tell where it stands
    if names & OTHER_NAMES or any(x[1:] in OTHER_ROLES for x in names if x[0] == "@"):
        return -1
    return 1 if tag in ARTICLE or "@main" in names or names & ARTICLE_NAMES else 0


def holds_page(page: str, at: int) -> bool:
    """Whether a form that begins here is a wrapper of the page: it holds an article, or paragraphs and headings."""
    found = FORM_END.search(page, at)
    end = found.start() if found else len(page)
    return bool(WHOLE.search(page, at, end)) or sum(1 for _ in islice(PARAGRAPH.finditer(page, at, end), 3)) == 3


def blocks(page: str | None) -> list[tuple[str, int, int, int]]:
    """(text, words, words in links, place) of a page's flat text blocks, in page order. Null gives none."""
    out: list[tuple[str, int, int, int]] = []
    held: list[tuple[str, bool]] = []
    stack: list[tuple[str, int]] = []
    link, at, page = False, 0, page or ""

    def close() -> None:
        if not held:
            return
        text = " ".join("".join([t for t, _ in held]).split())
        if text:
            linked = sum(len(t.split()) for t, in_link in held if in_link)
            out.append((text, len(text.split()), linked, stack[-1][1] if stack else 0))
        held.clear()

    def text_to(end: int) -> None:
        if end > at:
            raw = page[at:end]
            held.append((html.unescape(raw) if "&" in raw else raw, link))

    for m in TOKEN.finditer(page):
        text_to(m.start())
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag or tag in GAP:
            if tag:
                held.append((" ", False))
            elif m["raw"] or m["media"] or m["empty"] and m["empty"].lower() != "svg":
                close()
            continue
        if tag in INLINE:
            if tag == "a":
                link = not m["end"]
            continue
        place = 0 if m["end"] or tag in ("html", "body") or tag == "form" and holds_page(page, at) else place_of(tag, m["rest"])
        if tag != "span" or place:
            close()
            link = link and tag == "span"
        if tag in VOID:
            continue
        if m["end"]:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if i >= 0:
                if tag == "span" and stack[i][1] != (stack[i - 1][1] if i else 0):
                    close()
                del stack[i:]
            continue
        if tag != "span" and stack and stack[-1][0] == "p":
            stack.pop()
        if tag == "li":
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ("li", "ul", "ol")), -1)
            if i >= 0 and stack[i][0] == "li":
                del stack[i:]
        above = stack[-1][1] if stack else 0
        if place == 0 or above == -2 or above == -1 and not (tag in ARTICLE and place == 1):
            place = above if place > above or place == 0 else place
        stack.append((tag, place))
    text_to(len(page))
    close()
    return out


def features(found: list[tuple[str, int, int, int]]) -> list[list[float]]:
    marked = any(b[3] == 1 for b in found)
    own = [(float(w), n / w) for _, w, n, _ in found]
    edge = (0.0, 0.0)
    return [
        [*own[i], *(own[i - 1] if i else edge), *(own[i + 1] if i + 1 < len(own) else edge), float(max(-1, found[i][3])), float(marked and found[i][3] != 1)]
        for i in range(len(found))
    ]


#: The labelled table: pages, and for each of their blocks in order 1 for content and 0 for the rest.
_A = "A first paragraph of the article that says in some twenty words what it is all about and why it matters."
_B = "Another one goes on, with more detail on each point that was raised before, and closes the case."
_C = "Some prose points <a>elsewhere</a> now and then, which makes it no menu, for most of its words are no link at all."
_MENU = "<div><a>Home</a> <a>News</a> <a>About us</a></div>"
LABELLED = [
    (f"<nav><a>Home</a> <a>News</a></nav><article><h1>A title of it</h1><p>{_A}</p><p>Short.</p><p>{_B}</p></article><footer>&copy; site, all rights kept here</footer>", [0, 1, 1, 1, 1, 0]),
    (f"<header>Site name</header><div class=ad>Buy this thing now, it is very cheap today.</div><article><h1>Title</h1><p>{_A}</p></article>", [0, 0, 1, 1]),
    (f"<div><a>Home</a> <a>About us</a> <a>Contact</a></div><div><h1>Title of page</h1><p>{_A}</p><p>{_B}</p></div><div><a>Terms</a> <a>Privacy</a></div>", [0, 1, 1, 1, 0]),
    (f"<main><p>One.</p><p>{_A}</p><p>See <a>this</a>.</p><ul><li>First point</li><li>Second point</li></ul></main><aside>{_B}</aside>", [1, 1, 1, 1, 1, 0]),
    (f"<div class='cookie notice'>{_A}</div><div><p>{_B}</p><p>{_A}</p><p>Yes.</p></div><div class=comments><p>{_A}</p><p>I agree.</p></div>", [0, 1, 1, 1, 0, 0]),
    (f"<form>Search here</form><article><p>{_B}</p><div class=related><a>More</a></div><p>No.</p></article><section id=comments>{_B}</section>", [0, 1, 0, 1, 0]),
    (f"<p>{_A}</p><p>{_B}</p><p>{_A} {_B}</p><div><a>One</a> <a>two</a> <a>three</a> <a>four</a></div>", [1, 1, 1, 0]),
    (f"<div>Welcome to the site of things</div><article><p>{_A}</p></article><div>Last change was made on a Monday</div><div>{_B}</div>", [0, 1, 0, 0]),
    ("<ul><li><a>Start</a></li><li><a>Products</a></li></ul><article><h1>Notes</h1><p><a>A link that is the whole of it</a></p><p>End.</p></article>", [0, 0, 1, 1, 1]),
    (f"<article><p>Only.</p></article><footer>{_A}</footer><nav>{_B}</nav>", [1, 0, 0]),
    (f"<article><p>{_B}</p><aside>Aside text stands here</aside><blockquote>{_A}</blockquote><form>Write to us and get news</form></article>", [1, 0, 1, 0]),
    (f"<p>{_A}</p>", [1]),
    ("<p>Brief note only.</p><p>Word.</p>", [1, 1]),
    (f"<article><p>{_A}</p><ul><li><a>One</a></li><li><a>Two more</a></li></ul><p><a>Source</a></p><p>{_B}</p><p><a>A</a></p></article>", [1, 1, 1, 1, 1, 1]),
    (f"<main><h2><a>Linked title</a></h2><p>{_C}</p><p><a>Next</a></p></main><div><a>Home</a></div>", [1, 1, 1, 0]),
    (f"<article><p>{_A}</p></article><div>Last words</div>", [1, 0]),
    (f"<div>Top</div><main><p>{_B}</p><p>Short.</p></main><div>Made here</div><div>O</div>", [0, 1, 1, 0, 0]),
    (f"<div>A line of some words</div><div>X</div><main><p>{_B}</p></main><div>{_A}</div>", [0, 0, 1, 0]),
    (f"<article><h1>Title</h1><p>{_C}</p><p>{_A}</p></article>", [1, 1, 1]),
    (f"<article><h1>Title</h1><p><a>Link</a></p><p>Text.</p><p><a>Link</a></p></article><nav><a>Home</a></nav>", [1, 1, 1, 1, 0]),
    (f"<h1>Title of it</h1><p>{_C}</p><p>{_A}</p>{_MENU}", [1, 1, 1, 0]),
    (f"{_MENU}<div class='cookie notice'>{_A}</div><p>{_B}</p>{_MENU}<div class=sidebar>{_C}</div><p>{_A}</p><div class=footer>{_B}</div>", [0, 0, 1, 0, 0, 1, 0]),
    (f"{_MENU}<div class=banner>{_A} {_B}</div>{_MENU}<div class=ad>{_B} {_A}</div><p>{_A}</p>{_MENU}<div class=legal>{_A} {_B} {_A}</div>", [0, 0, 0, 0, 1, 0, 0]),
    (f"<div class=banner>Hello</div><p>{_A}</p><div class=share>Tell others</div><p>{_B}</p><div class=promo>New</div>", [0, 1, 0, 1, 0]),
    (f"<table><tr><td>Topics of the day</td><td><a>Start</a></td><td><a>Sport</a> <a>Money</a></td></tr><tr><td>{_C}</td><td>Yes.</td><td>{_B}</td></tr><tr><td><a>Terms of use</a></td><td>By Some Company</td></tr></table>", [0, 0, 0, 1, 1, 1, 0, 0]),
    (f"{_MENU}<div>See also <a>this</a> <a>that</a></div>{_MENU}<h1>What came of it</h1><p>{_C}</p><p>{_A}</p><p>The end.</p>", [0, 0, 0, 1, 1, 1, 1]),
]


def _unmarked(kinds: str) -> tuple[str, list[int]]:
    """A labelled page of plain divs: m menu of links, l label among links, t text of the article, each with its words."""
    told = [(k[0], " ".join(["word"] * int(k[1:]))) for k in kinds.split()]
    return "".join(f"<div><a>{x}</a></div>" if k == "m" else f"<div>{x}</div>" for k, x in told), [int(k == "t") for k, _ in told]


#: Pages without marks: a short block among links is a label of them, one beside prose belongs to it.
LABELLED += map(_unmarked, (
    "m4 l1 m21 t2 t40 t22 m9 l6 m3 l8",
    "m60 l2 m12 t7 t15 t60 t2 t33 m40 l1 m2 l5",
    "l9 m1 l2 m35 t1 t27 t6 t19 m5 l3",
    "m15 l5 m50 l3 m8 t9 t70 t1 t12 t4 t45 m25 l2",
    "m2 t4 t18 t80 t3 t30 m70 l7 m18 l4",
    "m30 l4 m6 l1 m45 t3 t13 t50 m12 l9 m28 l1",
    "m8 t6 t35 t9 t24 t5 t16 m2 l6 m65 l2 m1",
    "m80 l7 m22 t5 t90 t14 t8 t55 m33 l3",
    "m11 l3 m17 t8 t20 t28 t7 t38 t1 t65 m7 l8 m10 l5",
    "m26 l8 m3 l6 m55 t2 t100 t11 t25 m14 l4 m38 l7 m5",
    "m9 t40",
    "m10 t45 m12 l9",
    "m37 t26 m4 t17 m20 l6 m3 l2",
    "m5 t95 m44 l8 m10 t20",
    "m6 t40 t4",
    "m3 t20 t30 t8",
    "m12 t5 t9 t2",
))


def fit_tree(spark: SparkSession, labelled: list[tuple[str, list[int]]] | None = None, depth: int = DEPTH) -> tuple:
    """Nested (feature, threshold, left, right) down to leaves True or False, fitted by Spark ML; few nodes."""
    rows = []
    for page, kinds in labelled or LABELLED:
        found = blocks(page)
        if len(found) != len(kinds):
            raise ValueError(f"{len(kinds)} labels for {len(found)} blocks: {page[:80]}")
        rows += [(f, float(k)) for f, k in zip(features(found), kinds, strict=True)]
    df = spark.createDataFrame(rows, "f array<double>, label double").coalesce(1).select(array_to_vector("f").alias("features"), "label")
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=1, seed=1).fit(df)

    def node(n) -> tuple | bool:
        if n.numDescendants() == 0:
            return n.prediction() > 0.5
        return n.split().featureIndex(), n.split().threshold(), node(n.leftChild()), node(n.rightChild())

    return node(model._call_java("rootNode"))


def is_content(tree, row: list[float]) -> bool:
    while not isinstance(tree, bool):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str | None, tree) -> str:
    found = blocks(page)
    return " ".join([b[0] for b, f in zip(found, features(found), strict=True) if is_content(tree, f)])


def extract(pages: DataFrame, source: str = "html", tree=None) -> DataFrame:
    """pages without `source`, plus text string and n_chars long (code points); one row per input row.

    Null and empty pages, and pages without content blocks, give the empty text. Broken markup is read as far as it
    goes: elements left open end with the page. Columns named text and n_chars are replaced.
    """
    tree = fit_tree(pages.sparkSession) if tree is None else tree
    own = [c for c in pages.columns if c not in (source, "text", "n_chars")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*own).schema)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows, 16 << 20):
            text = [main_text(x.as_py(), tree) for x in b.column(len(own))]
            cols = [*b.columns[: len(own)], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*own, "text", "n_chars"])

    return pages.select(*own, F.col(source)).mapInArrow(run, f"{schema}, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
