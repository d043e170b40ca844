"""Problem 7: markup residue found, weighed in a style tree of its source, and turned into clean text.

Each field is parsed into branches: a markup kind, what it is, and the content it holds. HTML is
parsed into nested nodes; a node's branch is its path of tags and classes. The branches of all fields
of one paper (the "site") are merged into one style tree. A branch's importance is the entropy of its
contents over the fields that have it, as a share of the highest entropy so many fields could have: a
category, label or comment that says the same everywhere carries nothing. Among the HTML nodes of one
path, each way to present text (the tags within) and each content with it has an importance too: 1
less the logarithm of the places that show it as a share of that of the places with the path. Low
branches, and nodes that are low in both, are removed; a mark around a lone sign or figure (a star, an
underscore) is markup only if the source's tree has the branch with words in it, else it is notation; structure (headings, lists, code, formulas,
tables) is always kept as plain text, as are inline elements within running text, and what other
branches hold is kept without its marks.

Defined results. Content of table and formula blocks is markup by definition and left alone; their
captions are not. Null and empty fields have no markup; a null stays null. A page number between
dashes, a comparison, a bracketed citation number, a lone star, underscore, ampersand or dollar sign
is not markup. A block delivered twice gives one row. A branch seen once keeps importance 1.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from html.entities import html5
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.session import cut_lineage

LOW = 0.3
#: Fields without any of these hold no markup; the test runs in the JVM.
HINT = r"[<&*_`#\[{\\$=|~]|''|(?m)^\s{0,3}([-+>]|\d+[.)])\s"

# Element names of HTML.
_TAGS = "a abbr article aside b big blockquote body br button caption center cite code col colgroup dd del details div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i img input ins kbd label li link main mark meta nav ol option p pre q ref s samp script section select small span strike strong style sub summary sup table tbody td tfoot th thead title tr tt u ul var"
_TAG = re.compile(rf"</?(?P<tag>{'|'.join(sorted(_TAGS.split(), key=len, reverse=True))})(?:\s[^<>]*)?\s*/?>", re.I)
_COMMENT = re.compile(r"<!--.*?-->|<!doctype[^>]*>|<!\[CDATA\[.*?\]\]>", re.S | re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|(?P<name>[A-Za-z][A-Za-z0-9]{1,31}));")

_FENCE = re.compile(r"^(?:```|~~~)[^\n]*\n(?P<code>.*?)(?:^(?:```|~~~)\s*$|\Z)", re.S | re.M)
_MD = {
    "heading": re.compile(r"^ {0,3}#{1,6}[ \t]+(?P<in>\S[^\n]*)$", re.M),
    "image": re.compile(r"!\[(?P<in>[^\]\n]*)\]\([^)\s]*(?:\s+\"[^\"]*\")?\)"),
    "link": re.compile(r"(?<![!\[])\[(?P<in>[^\[\]\n]+)\]\((?:https?://|/|\.|#|mailto:|[\w-]+\.)[^)\s]*\)"),
    "emphasis": re.compile(r"(?<![*\\])(?P<m>\*{1,3})(?=[^\s*])(?P<in>[^*\n]+?)(?<=[^\s*])(?P=m)(?!\*)|(?<![\w_\\])(?P<u>_{1,3})(?=[^\s_])(?P<in2>[^_\n]+?)(?<=[^\s_])(?P=u)(?![\w_])|__(?P<in3>[一-鿿][^_\n]*?)__|__(?P<in5>[^\s_][^_\n]*?[一-鿿])__|~~(?=\S)(?P<in4>[^~\n]+?)(?<=\S)~~"),
    "code": re.compile(r"(?<!`)(?P<t>`{1,2})(?!`)(?P<in>[^`\n]+?)(?<!`)(?P=t)(?!`)"),
    "quote": re.compile(r"^ {0,3}>[ \t]?(?P<in>\S[^\n]*)$", re.M),
    "list": re.compile(r"^[ \t]*(?:[*+]|-(?![ \t]*\d{1,4}[ \t]*[-–—]?[ \t]*$))[ \t]+(?:\[[ xX]\][ \t]+)?(?P<in>\S[^\n]*)$", re.M),
    "table": re.compile(r"^[ \t]*\|(?P<in>[^\n]*)\|[ \t]*\n[ \t]*\|?[ \t]*:?-{2,}[^\n]*$", re.M),
}
_NUMBERED = re.compile(r"^[ \t]*(?P<n>\d{1,3})[.)][ \t]+\S[^\n]*$", re.M)
_WIKI = {
    "heading": re.compile(r"^(?P<e>={2,6})[ \t]*(?P<in>[^=\n]+?)[ \t]*(?P=e)[ \t]*$", re.M),
    "category": re.compile(r"\[\[(?:Category|File|Image|分类|Kategorie|Catégorie):(?P<in>[^\[\]\n]*)\]\]", re.I),
    "link": re.compile(r"\[\[(?!(?:Category|File|Image|分类|Kategorie|Catégorie):)(?:[^\[\]|\n]*\|)?(?P<in>[^\[\]|\n]+)\]\]", re.I),
    "template": re.compile(r"(?<![\\\w{}])\{\{(?P<in>[^{}\n]+)\}\}"),
    "emphasis": re.compile(r"(?<!')(?P<q>'{2,5})(?=[^\s'])(?P<in>[^'\n]+?(?:'(?!')[^'\n]+?)*)(?P=q)(?!')"),
}
_TEX_FORMULA = re.compile(
    r"\$\$(?P<a>.+?)\$\$|\\\[(?P<b>.+?)\\\]|\\\((?P<c>.+?)\\\)"
    r"|(?<![\\$\w])\$(?!\s)(?P<d>(?:[^$\n\\]|\\.)*?(?:[\\^_=<>+]|(?<=\$)[A-Za-z](?=\$))(?:[^$\n\\]|\\.)*?)(?<!\s)\$(?![\d$])"
    r"|\\begin\{(?P<env>equation|align|eqnarray|gather|multline|displaymath|math)\*?\}(?P<e>.*?)\\end\{(?P=env)\*?\}",
    re.S,
)
_TEX_ENV = re.compile(r"\\(?:begin|end)\{(?P<in>[A-Za-z]+)\*?\}(?:\[[^\]\n]*\])?")
_TEX_BLOCK = re.compile(r"\\begin\{(?P<in>[A-Za-z]+)(?P<star>\*?)\}(?:\[[^\]\n]*\])?(?P<text>.*?)\\end\{(?P=in)(?P=star)\}", re.S)
_TEX_SWITCH = re.compile(r"\{\\(?P<in>it|bf|em|tt|rm|sc|sl|sf)\b\s*(?P<text>[^{}]*)\}")
_TEX_COMMAND = re.compile(r"\\(?P<in>[A-Za-z]{2,})\*?(?P<opt>\[[^\]\n]*\])?(?P<args>(?:\{[^{}\n]*(?:\{[^{}\n]*\}[^{}\n]*)*\})*)")
_TEX_SILENT = {"label", "cite", "citep", "citet", "ref", "eqref", "pageref", "index", "vspace", "hspace", "includegraphics", "bibliography", "usepackage", "documentclass"}
_TEX_HEADING = {"section", "subsection", "subsubsection", "chapter", "paragraph", "title"}


def _entity(m: re.Match) -> bool:
    return m["name"] is None or f"{m['name']};" in html5


def _list_numbers(text: str) -> list[re.Match]:
    """Numbered lines that form a list: at least two in a row, counting up from one."""
    found = list(_NUMBERED.finditer(text))
    runs: list[list[re.Match]] = []
    for m in found:
        if runs and int(m["n"]) == int(runs[-1][-1]["n"]) + 1:
            runs[-1].append(m)
        elif int(m["n"]) == 1:
            runs.append([m])
    return [m for run in runs if len(run) > 1 for m in run]


def _opens(text: str, at: int, marks: str) -> bool:
    """Whether a line begins a paragraph or follows a line that begins with one of ``marks``; a wrapped line doesn't."""
    if at == 0:
        return True
    before = text[text.rfind("\n", 0, at - 1) + 1 : at - 1].strip()
    return not before or before[0] in marks


def _lines(kind: str, text: str) -> list[re.Match]:
    """Quoted lines or list items that stand where such a line can begin."""
    marks = ">" if kind == "quote" else "*+-•"
    out: list[re.Match] = []
    for m in _MD[kind].finditer(text):
        at = text.rfind("\n", 0, m.end("in") - len(m["in"])) + 1
        if _opens(text, at, marks) and (_opens(text, at, "") or (out and text[out[-1].end() : m.start()].count("\n") <= 3)):
            out.append(m)
    return out


_VOID = {"br", "hr", "img", "input", "link", "meta", "col"}
#: Elements that end an open element of the second set, up to the nearest of the third.
_ENDS = [({"li"}, {"li"}, {"ul", "ol"}), ({"td", "th"}, {"td", "th"}, {"tr", "table"}), ({"tr"}, {"td", "th", "tr"}, {"table"}), ({"dt", "dd"}, {"dt", "dd"}, {"dl"}), ({"option"}, {"option"}, {"select"})]
_BLOCKS = set("article aside blockquote body center details div figcaption figure footer form header main nav p section summary".split())
_ENDS_P = _BLOCKS | set("dl h1 h2 h3 h4 h5 h6 hr li ol pre table tr td th ul".split())
#: Elements that may be removed if they say nothing; of the last four only those that stand by themselves.
_REMOVABLE = (_BLOCKS - {"body", "main", "blockquote"}) | {"span", "font", "small", "label"}
_STRUCTURE = re.compile(r"<(?:h[1-6]|[uod]l|li|pre|code|table|tr|td|th|blockquote)\b|```|~~~|^ {0,3}#{1,6}[ \t]|^={2,6}[^=\n]|^[ \t]*(?:[*+-]|\d{1,3}[.)])[ \t]|\\(?:item|section|subsection|begin)\b|^[ \t]*\|", re.I | re.M)


def content_key(content: str) -> str:
    """What stands for the whole of a content: itself with plain spacing, or its beginning and a hash."""
    content = re.sub(r"\s+", " ", content)
    return content if len(content) <= 200 else f"{content[:160]} {hashlib.md5(content.encode('utf-8', 'replace')).hexdigest()}"


class Node(NamedTuple):
    """An HTML element: its path, its place in the text, the tags and the text within."""

    path: str
    start: int
    end: int
    shape: str
    content: str

    def key(self) -> str:
        return content_key(f"{self.shape}: {self.content}")


def _blank(m: re.Match) -> str:
    return " " * len(m[0])


def html_nodes(text: str) -> list[Node]:
    """The elements of a text, each after those within it; code fences and comments hold none."""
    if "<" not in text:
        return []
    text = _COMMENT.sub(_blank, _FENCE.sub(_blank, text))
    stack: list[list] = []  # [tag, step of the path, start, end of the start tag, tags within]
    out: list[Node] = []

    def close(inner: int, outer: int) -> None:
        tag, _, start, begun, tags = stack[-1]
        path = "/".join(x[1] for x in stack)
        stack.pop()
        said = " ".join(html.unescape(_TAG.sub(" ", text[begun:inner])).split())
        out.append(Node(path, start, outer, " ".join(tags), said))

    for m in _TAG.finditer(text):
        tag = m["tag"].lower()
        if m[0].startswith("</"):
            if any(x[0] == tag for x in stack):
                while stack[-1][0] != tag:
                    close(m.start(), m.start())
                close(m.start(), m.end())
            continue
        while stack and stack[-1][0] == "p" and tag in _ENDS_P:
            close(m.start(), m.start())
        for begins, ended, within in _ENDS:
            if tag in begins:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in within), -1)
                at = next((i for i in range(depth + 1, len(stack)) if stack[i][0] in ended), len(stack))
                while len(stack) > at:
                    close(m.start(), m.start())
        kind = re.search(r"\sclass\s*=\s*[\"']?([^\"'>]*)", m[0], re.I)
        step = f"{tag}.{'.'.join(kind[1].lower().split())}" if kind and kind[1].strip() else tag
        for x in stack:
            x[4].append(step)
        stack.append([tag, step, m.start(), m.end(), []])
        if tag in _VOID or m[0].endswith("/>"):
            close(m.end(), m.end())
    while stack:
        close(len(text), len(text))
    return out


def _removable(node: Node, text: str) -> bool:
    """Whether a node is a block, or stands by itself, and holds no structure."""
    tag = re.split(r"[./]", node.path.rpartition("/")[2])[0]
    inside = text[node.start : node.end]
    if tag not in _REMOVABLE or _STRUCTURE.search(inside) or _TEX_FORMULA.search(inside):
        return False
    if tag in _BLOCKS:
        return True
    before, after = text[: node.start].rstrip(" \t"), text[node.end :].lstrip(" \t")
    edge = r"(?:div|p|section|header|footer|nav|aside|article|td|th|li|br|hr)"
    return (not before or before[-1] == "\n" or bool(re.search(rf"</?{edge}\b[^<>]*>$", before[-200:], re.I))) and (not after or after[0] == "\n" or bool(re.match(rf"</?{edge}\b[^<>]*>", after, re.I)))


def branches(text: str | None) -> list[tuple[str, str, str]]:
    """(markup, branch, content) of every piece of markup."""
    if not text:
        return []
    out: list[tuple[str, str, str]] = []
    whole = text
    code = [(m.start(), m.end()) for m in _FENCE.finditer(text)]
    if code:
        out += [("markdown", "code", m["code"]) for m in _FENCE.finditer(text)]
        text = _FENCE.sub("\n", text)
    if "<" in text:
        out += [("html", f"node {x.path}", f"{x.shape}: {x.content}") for x in html_nodes(whole)]
        out += [("html", "comment", m[0]) for m in _COMMENT.finditer(text)]
        text = _COMMENT.sub("", text)
        out += [("html", m["tag"].lower(), m[0].lower()) for m in _TAG.finditer(text)]
    if "&" in text:
        out += [("html", "entity", m[0]) for m in _ENTITY.finditer(text) if _entity(m)]
    formulas = "\\" in text or "$" in text
    if formulas:
        out += [("latex", "formula", m[0]) for m in _TEX_FORMULA.finditer(text)]
        text = _TEX_FORMULA.sub(" ", text)
        closed = {m.start(): m["text"] for m in _TEX_BLOCK.finditer(text)}
        out += [("latex", f"environment {m['in']}", closed.get(m.start(), "")) for m in _TEX_ENV.finditer(text) if m[0].startswith("\\begin") or m.end() not in {x.end() for x in _TEX_BLOCK.finditer(text)}]
        text = _TEX_ENV.sub("", text)
        out += [("latex", m["in"], m["args"] or "") for m in _TEX_COMMAND.finditer(text)]
    for kind, pattern in _WIKI.items():
        out += [("wiki", kind, m["in"]) for m in pattern.finditer(text)]
    if "[[" in text or "''" in text or "{{" in text:
        for pattern in _WIKI.values():
            text = pattern.sub(" ", text)
    for kind, pattern in _MD.items():
        if kind in ("quote", "list"):
            out += [("markdown", kind, m["in"]) for m in _lines(kind, text)]
            continue
        out += [("markdown", kind, next((g for k, g in m.groupdict().items() if k.startswith("in") and g), "")) for m in pattern.finditer(text)]
    out += [("markdown", "list", m[0]) for m in _list_numbers(text)]
    return out


_KEPT = {"heading", "list", "code", "formula", "table", "quote", "emphasis", "link", "entity", "section", "subsection"}


def clean(text: str | None, low: set[str] = frozenset()) -> str | None:
    """Plain text that keeps headings and list items as lines, code, formulas and table cells; ``low`` are branches to drop."""
    if not text:
        return text
    gone = [x for x in html_nodes(text) if f"html node {x.path} {x.key()}" in low and _removable(x, text)] if low else []
    for x in sorted(gone, key=lambda x: (-x.start, -x.end)):
        if not any(y.start <= x.start and x.end <= y.end and y is not x for y in gone):
            text = text[: x.start] + "\n" + text[x.end :]
    held: list[str] = []

    def hold(value: str) -> str:
        held.append(value)
        return f"\x00{len(held) - 1}\x00"

    text = _FENCE.sub(lambda m: "\n" + hold(m["code"].rstrip("\n")) + "\n", text)
    text = re.sub(r"<pre[^>]*>\s*(?:<code[^>]*>)?(.*?)(?:</code>)?\s*</pre>", lambda m: "\n" + hold(html.unescape(m[1])) + "\n", text, flags=re.S | re.I)
    text = _TEX_FORMULA.sub(lambda m: hold(next(g for k, g in m.groupdict().items() if k != "env" and g is not None).strip()), text)
    text = _COMMENT.sub("", text)
    text = re.sub(r"<(h[1-6])[^>]*>(.*?)</\1>", lambda m: f"\n\n{m[2]}\n\n", text, flags=re.S | re.I)
    text = re.sub(r"<li[^>]*>\s*", "\n• ", text, flags=re.I)
    text = re.sub(r"</t[dh]>\s*<t[dh][^>]*>", "\t", text, flags=re.I)
    text = re.sub(r"<(?:br|hr)\s*/?>|</(?:p|div|li|tr|ul|ol|table|blockquote)>|<(?:p|div|tr|blockquote)(?:\s[^<>]*)?>", "\n", text, flags=re.I)
    text = _TAG.sub("", text)
    text = _ENTITY.sub(lambda m: html.unescape(m[0]) if _entity(m) else m[0], text)
    text = _TEX_SWITCH.sub(lambda m: m["text"], text)
    text = _TEX_BLOCK.sub(lambda m: "" if f"latex environment {m['in']}" in low and not _STRUCTURE.search(m["text"]) and "\x00" not in m["text"] else m[0], text)
    text = re.sub(r"\\item\b\s*", "\n• ", text)
    text = _TEX_ENV.sub("", text)

    def command(m: re.Match) -> str:
        name, args = m["in"], re.findall(r"\{((?:[^{}]|\{[^{}]*\})*)\}", m["args"])
        if name in _TEX_SILENT or f"latex {name}" in low:
            return ""
        if name in _TEX_HEADING:
            return f"\n\n{' '.join(args)}\n\n"
        return " ".join(args) if args else hold(m[0])

    text = _TEX_COMMAND.sub(command, text)
    text = _WIKI["heading"].sub(lambda m: f"\n\n{m['in']}\n\n", text)
    text = _WIKI["category"].sub(lambda m: "" if "wiki category" in low else m["in"], text)
    text = _WIKI["link"].sub(lambda m: m["in"], text)
    text = _WIKI["template"].sub(lambda m: "" if "wiki template" in low else m["in"].replace("|", " "), text)
    text = _WIKI["emphasis"].sub(lambda m: m["in"], text)
    text = _MD["image"].sub(lambda m: "" if "markdown image" in low else m["in"], text)
    text = _MD["link"].sub(lambda m: m["in"], text)
    text = _MD["code"].sub(lambda m: hold(m["in"]), text)
    for _ in range(2):
        text = _MD["emphasis"].sub(lambda m: next(g for k, g in m.groupdict().items() if k.startswith("in") and g), text)
    text = _MD["heading"].sub(lambda m: f"\n{m['in'].rstrip(' #')}\n", text)
    for kind, mark in (("quote", ""), ("list", "• ")):
        for m in reversed(_lines(kind, text)):
            text = text[: m.start()] + mark + m["in"] + text[m.end() :]
    text = re.sub(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$\n?", "", text, flags=re.M) if "|" in text else text
    text = re.sub(r"^[ \t]*\|([^\n]*)\|[ \t]*$", lambda m: "\t".join(c.strip() for c in m[1].split("|")), text, flags=re.M)
    text = re.sub(r"[ \u00a0]*\n[ \u00a0]*", "\n", re.sub(r"[ \u00a0\u2002]{2,}", " ", text))
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    while "\x00" in text:
        text = re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], text)
    return text


def marked_fields(blocks: DataFrame) -> DataFrame:
    """(block_id, paper_id, field, text, place) of the fields that may hold markup, once per block; a caption is one place wherever it is copied to."""
    base = blocks.select("block_id", F.col("address.paper_id").alias("paper_id"), "modality", "content", "caption")
    hint = lambda c: F.coalesce(F.col(c).rlike(HINT), F.lit(False))
    body = ~F.col("modality").isin("table", "formula") & hint("content")
    fields = F.array(F.struct(F.lit("content").alias("field"), F.when(body, F.col("content")).alias("text")), F.struct(F.lit("caption").alias("field"), F.when(hint("caption"), F.col("caption")).alias("text")))
    marked = base.where(F.coalesce(body, F.lit(False)) | hint("caption"))
    return marked.select("block_id", "paper_id", "modality", F.explode(fields).alias("f")).select("block_id", "paper_id", "f.field", "f.text", F.when((F.col("modality") == "text") & (F.col("f.field") == "content"), F.col("block_id")).otherwise(F.md5("f.text")).alias("place")).where("text is not null")


def parsed(blocks: DataFrame) -> DataFrame:
    """(block_id, paper_id, field, place, markup, branch, content): one row per branch of each field."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, p, f, w, m, k, content_key(c)) for i, p, f, w, t in zip(b["block_id"], b["paper_id"], b["field"], b["place"], b["text"]) for m, k, c in branches(t)]
            yield pd.DataFrame(rows, columns=["block_id", "paper_id", "field", "place", "markup", "branch", "content"])

    return marked_fields(blocks).mapInPandas(run, "block_id string, paper_id string, field string, place string, markup string, branch string, content string").distinct()


#: Contents with a word.
WORDED = r"\p{L}{2}|\p{IsHan}"
#: Branches whose marks are also signs of their own.
DOUBTFUL = ["emphasis"]


def style_tree(rows: DataFrame) -> DataFrame:
    """(paper_id, markup, branch, fields, worded, importance) of each paper's merged tree."""
    leaves = rows.groupBy("paper_id", "markup", "branch", "content").agg(F.count("*").alias("c"))
    sums = leaves.groupBy("paper_id", "markup", "branch").agg(F.sum("c").alias("fields"), F.sum(F.col("c") * F.log("c")).alias("clogc"), F.max(F.col("content").rlike(WORDED)).alias("worded"))
    entropy = F.log("fields") - F.col("clogc") / F.col("fields")
    return sums.select("paper_id", "markup", "branch", "fields", "worded", F.when(F.col("fields") > 1, F.greatest(F.lit(0.0), entropy) / F.log("fields")).otherwise(F.lit(1.0)).alias("importance"))


def low_nodes(rows: DataFrame) -> DataFrame:
    """(paper_id, low): HTML nodes whose presentation and content together say too little among the nodes of their path.

    A content is counted with its presentation, so it is shown by no more fields than the presentation alone: it is low only if both are."""
    nodes = rows.where("markup = 'html' and branch like 'node %'")
    paths = nodes.groupBy("paper_id", "branch").agg(F.countDistinct("place").alias("m")).where("m > 1")
    kinds = nodes.groupBy("paper_id", "branch", "content").agg(F.countDistinct("place").alias("k")).where("k > 1")
    shared = kinds.join(paths.withColumnRenamed("paper_id", "__p").withColumnRenamed("branch", "__b"), F.col("paper_id").eqNullSafe(F.col("__p")) & (F.col("branch") == F.col("__b")))
    return shared.where(1 - F.log("k") / F.log("m") < LOW).select("paper_id", F.concat_ws(" ", F.lit("html"), "branch", "content").alias("low"))


def found_markup(blocks: DataFrame) -> DataFrame:
    """(block_id, field, markup): what the nodes of each source's style tree say is markup, in each field that has them."""
    rows = cut_lineage(parsed(blocks))  # merged into the tree and asked of it
    tree = style_tree(rows).select(F.coalesce("paper_id", F.lit("")).alias("site"), "markup", "branch", "worded")
    own = rows.select("block_id", "field", F.coalesce("paper_id", F.lit("")).alias("site"), "markup", "branch", F.col("content").rlike(WORDED).alias("words")).distinct()
    asked = own.join(tree, ["site", "markup", "branch"])
    return asked.where(~F.col("branch").isin(DOUBTFUL) | F.col("words") | F.col("worded")).select("block_id", "field", "markup").distinct()


def clean_blocks(blocks: DataFrame) -> DataFrame:
    """(block_id, field, clean): every field that held markup, as clean text."""
    kept = sorted(_KEPT)
    rows = cut_lineage(parsed(blocks))  # read twice below
    names = style_tree(rows).where((F.col("importance") < LOW) & ~F.col("branch").isin(kept)).select("paper_id", F.concat_ws(" ", "markup", "branch").alias("low"))
    low = names.unionByName(low_nodes(rows)).groupBy("paper_id").agg(F.collect_set("low").alias("low"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [clean(t, set(x) if x is not None else set()) for t, x in zip(b["text"], b["low"])]
            yield pd.DataFrame({"block_id": b["block_id"], "field": b["field"], "clean": texts})

    fields = marked_fields(blocks).dropDuplicates(["block_id", "field"])
    return fields.join(low, "paper_id", "left").select("block_id", "field", "text", "low").mapInPandas(run, "block_id string, field string, clean string")
