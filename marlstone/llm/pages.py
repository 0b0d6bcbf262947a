"""HTML extraction by site style trees: the pages of a host merged into one tree, and its unimportant branches left out.

A page's elements are merged by path: the names and classes of the containers around them, repeated siblings being one.
Every container and block is a node. Its importance joins the entropy of its styles (the order of its children) over the
host's pages and the mean entropy of the texts in its branch; a branch whose content is the same everywhere goes whole, as
do branches whose element or class says that they are noise. Copies of a page count once.
"""

from __future__ import annotations

import html
import re
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import map_batches, table, written

#: Importance below which a branch goes, fewest different pages that tell; share of presentation in it; rows broadcast at most.
UNIMPORTANT, PAGES, PRESENTATION, SMALL = 0.1, 10, 0.1, 100_000
#: Elements whose content is never text of an article; containers that are noise by name; elements that are containers; blocks.
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "button", "object", "math"))
NOISE = frozenset(("nav", "footer", "aside", "form", "header", "menu", "dialog", "head"))
CONTAINERS = NOISE | frozenset(("html", "body", "div", "section", "article", "main", "ul", "ol", "dl", "table", "figure", "details", "blockquote", "fieldset"))
BLOCKS = CONTAINERS | frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "pre", "hr", "address", "figcaption", "caption", "summary", "tbody", "thead", "tfoot", "center", "option"))
MAIN = frozenset(("article", "main"))
NOISY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alert|popup|modal|sidebar|side-?bar|widget|menu|nav|navbar|navigation|"
    r"breadcrumbs?|header|masthead|footer|comments?|comment-?list|respond|replies|disqus|related|share|sharing|social|subscribe|newsletter|login|signup|pagination|toolbar)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form"))
OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|[!?/])")
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
TITLED = re.compile(r"\b(?:class|id)\s*=\s*[\"']?[^\"'>]*(?:article|entry|post|story|content)[-_]?header", re.I)
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


def named(name: str, attributes: str) -> tuple[str, bool]:
    """An element's name in paths, and whether it says of itself that it is noise."""
    if not attributes.strip():
        return name, name in NOISE
    said = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    words = f"{said.get('class', '')} {said.get('id', '')}"
    noise = name in NOISE or bool(NOISY.search(words)) or said.get("role", "").lower() in ROLES or bool(HIDDEN.search(re.sub(r"\"[^\"]*\"", lambda m: m[0] if ":" in m[0] or "true" in m[0] else "", attributes)))
    kind = said.get("class", "").split()
    return name + ("." + kind[0] if kind else ""), noise


def tags(page: str):
    """(start, end, closing, name, attributes) of each tag, comment or declaration in page order; without a name for the last two.

    One pass: once quotes run to the page's end without closing a tag, later tags end at the next > whatever the quotes,
    so broken quotes cost no second look. A tag that never ends takes the rest of the page.
    """
    at, end, quoted = 0, len(page), True
    while m := OPEN.search(page, at):
        if page.startswith("<!--", m.start()):
            close = page.find("-->", m.start() + 4)
            at = end if close < 0 else close + 3
            yield m.start(), at, "", "", ""
            continue
        rest = REST.match(page, m.end()) if quoted and m[2] else None
        if rest is None:
            quoted &= not m[2]
            close = page.find(">", m.end())
            at = end if close < 0 else close + 1
        else:
            at = rest.end()
        yield m.start(), at, m[1] or "", (m[2] or "").lower(), page[m.end() : max(m.end(), at - 1)]


def blocks(page: str | None) -> list[tuple[str, str, bool, bool]]:
    """(path, text, noise, within the article) of each block with text, in page order; whole page, references decoded.

    A path names the block and the containers around it, each once, with its first class.
    """
    if not page:
        return []
    out: list[tuple[str, str, bool, bool]] = []
    stack: list[tuple[str, str, bool, bool]] = []
    text: list[str] = []
    at, raw, block, own = 0, "", "", False

    def flush() -> None:
        said = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if said:
            noise, main = own or bool(stack) and stack[-1][2], bool(stack) and stack[-1][3]
            out.append(("/".join([*dict.fromkeys(s[1] for s in stack), block]), said, noise, main))

    for start, end, closing, name, attributes in tags(page):
        if start < at:
            continue
        if raw:  # within an element whose content is no text
            if closing and name == raw:
                raw, at = "", end
            continue
        text.append(page[at:start])
        at = end
        if name in RAW and not closing:
            if not attributes.endswith("/"):
                raw = name
                text.append(" ")
        elif name in BLOCKS:
            flush()
            block, own = "", False
            if name in CONTAINERS and closing:
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if k is not None:
                    del stack[k:]
            elif name in CONTAINERS:
                if name == "body":
                    stack[:] = [s for s in stack if s[0] != "head"]
                label, noise = named(name, attributes)
                above, main = bool(stack) and stack[-1][2], bool(stack) and stack[-1][3]
                # an article's own header, whatever its element, holds its title
                noise = noise and not (main and (name == "header" or TITLED.search(attributes)))
                if not attributes.rstrip().endswith("/"):
                    stack.append((name, label, above or noise, main or (name in MAIN and not above and not noise)))
            elif not closing:
                block, own = named(name, attributes)
                own = own and not name.startswith("h")
        elif name in ("br", "img", "input", "wbr"):
            text.append(" " if name != "wbr" else "")
    if not raw:
        text.append(page[at:])
    flush()
    return out


def branches(path: str) -> list[str]:
    """The path's nodes, from the root to itself."""
    parts = path.split("/")
    return ["/".join(parts[:i]) for i in range(1, len(parts) + 1)]


def digest(*parts: str) -> int:
    data = "\0".join(parts).encode("utf-8", "surrogatepass")
    return crc32(data) << 31 ^ crc32(data[::-1])


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][\w+.-]*://([^/?#]*)", url or "")
    return (m[1] if m else "").lower()


def style_tree(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, path, m, importance) of every node of every host's tree; m is the number of its different pages.

    Every container is a node, with or without text of its own. A node's presentation importance is the entropy of its
    styles, the orders of its children; that of its content the mean, over the blocks in its branch, of what the entropy
    of a block's texts leaves. A null page has no nodes, a null url the empty host; an empty table gives no tree.
    """

    def make():
        def step(x: dict) -> dict:
            out = {c: [] for c in ("host", "page", "path", "style", "content")}
            for u, h in zip(x["__url"], x["__html"], strict=True):
                found = blocks(h)
                whole, texts, children = digest(*[b[1] for b in found]), {}, {}
                for path, said, _, _ in found:
                    texts.setdefault(path, []).append(said)
                    nodes = branches(path)
                    for node, child in zip(nodes, [*nodes[1:], ""], strict=True):
                        children.setdefault(node, {})[child] = None
                for node, below in children.items():
                    content = digest(*texts[node]) if node in texts else None
                    for c, v in (("host", host_of(u)), ("page", whole), ("path", node), ("style", digest(*below)), ("content", content)):
                        out[c].append(v)
            return out

        return step

    seen = map_batches(pages.select(F.col(url).alias("__url"), F.col(page).alias("__html")), make, "host string, page bigint, path string, style bigint, content bigint").distinct()
    seen = written(seen)

    def entropy(of: DataFrame, by: str) -> DataFrame:
        """Per node: m, and the entropy of `by` over its m pages, as a share of the greatest one (0 if there is one page)."""
        k = of.groupBy("host", "path", by).agg(F.count("*").alias("k")).groupBy("host", "path").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.log("k")).alias("s"))
        return k.select("host", "path", "m", F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(0.0).alias("e"))

    # a text that k of m pages share tells 1 - log k / log m, so a block's texts tell as much as their entropy is great
    own = entropy(seen.filter("content IS NOT NULL"), "content").withColumn("content", F.when(F.col("m") > 1, F.col("e")).otherwise(1.0))
    up = own.withColumn("path", F.explode(above("path")))
    below = up.groupBy("host", "path").agg((F.sum(F.col("content") * F.col("m")) / F.sum("m")).alias("content"))
    tree = entropy(seen, "style").join(below, ["host", "path"])
    importance = F.when(F.col("m") == 1, 1.0).otherwise(PRESENTATION * F.col("e") + (1 - PRESENTATION) * F.col("content"))
    return tree.select("host", "path", "m", importance.alias("importance"))


def above(path: str) -> Column:
    """A path's nodes, as `branches` gives them."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def main_text(page: str | None, low: frozenset = frozenset()) -> str:
    """Blocks of the page's article (of the whole page, if it marks none) that aren't noise or in a branch of `low`."""
    found = blocks(page)
    within = any(m and not n for _, _, n, m in found)
    return "\n\n".join(t for p, t, n, m in found if not n and (m or not within) and low.isdisjoint(branches(p)))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per row: key, url, text, n_chars.

    A null page is an empty one, with empty text; a null or odd url has the empty host. Repeated rows repeat their
    result; an empty table gives an empty one.
    """
    tree = style_tree(pages, url, page).filter((F.col("importance") < UNIMPORTANT) & (F.col("m") >= PAGES))
    low = written(tree.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("__low")).withColumnRenamed("host", "__host"))
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(key).alias("__key"), F.col(url).alias("__url"), F.col(page).alias("__html"), host.alias("__at"))
    low = F.broadcast(low) if low.count() <= SMALL else low
    rows = rows.join(low, F.col("__at") == F.col("__host"), "left").drop("__at", "__host")

    def make():
        def step(x: dict) -> dict:
            text = [main_text(h, frozenset(w or ())) for h, w in zip(x["__html"], x["__low"], strict=True)]
            return {key: x["__key"], "url": x["__url"], "text": text, "n_chars": [len(t) for t in text]}

        return step

    return map_batches(rows, make, f"`{key}` {pages.schema[key].dataType.simpleString()}, url string, text string, n_chars bigint")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: the main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
