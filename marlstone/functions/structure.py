"""Nested text that regular expressions can't take apart: LaTeX arguments and environments, TikZ and SVG graphs, XML, command lines.

Plain functions on one text, and tables made from them by Arrow batches: one file gives rows.
"""

from __future__ import annotations

import html
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

COMMENT = re.compile(r"(?<!\\)((?:\\\\)*)%[^\n]*")
NODE_AT = re.compile(r"\\node\b")


def uncommented(text: str) -> str:
    return COMMENT.sub(r"\1", text)


def closing(text: str, at: int, pair: str = "{}") -> int:
    """Where the bracket opened at `at` closes, -1 if it doesn't; escaped ones don't count."""
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        depth += (c == pair[0]) - (c == pair[1])
        if not depth:
            return i
        i += 1
    return -1


def argument(text: str, command: str, start: int = 0) -> str | None:
    """The braced argument of the first such command, nested braces kept; an optional argument before it is skipped."""
    for m in re.compile(rf"\\{re.escape(command)}(?![A-Za-z])\*?\s*").finditer(text, start):
        at = m.end()
        if text[at : at + 1] == "[":
            at = closing(text, at, "[]") + 1
            while at and text[at : at + 1].isspace():
                at += 1
        if at and text[at : at + 1] == "{" and (end := closing(text, at)) > 0:
            return text[at + 1 : end]
    return None


def environments(text: str, name: str) -> list[str]:
    """Outermost blocks of an environment, its starred form too."""
    out, depth, start = [], 0, 0
    for m in re.finditer(rf"\\(begin|end)\s*\{{{name}\*?\}}", text):
        if m[1] == "begin":
            start = m.start() if not depth else start
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                out.append(text[start : m.end()])
    return out


def brace_groups(text: str) -> list[str]:
    """Contents of the outermost braces."""
    out, at = [], 0
    while (at := text.find("{", at)) >= 0:
        end = closing(text, at)
        if end < 0:
            break
        out.append(text[at + 1 : end])
        at = end + 1
    return out


def commands(text: str) -> list[str]:
    """Parts that end at a semicolon outside of all brackets."""
    out, depth, last, i = [], 0, 0, 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        depth += (c in "{[(") - (c in "}])")
        if c == ";" and depth <= 0:
            out.append(text[last : i + 1].strip())
            last, depth = i + 1, 0
        i += 1
    return out


def macros(text: str) -> list[str]:
    """Definitions that a picture may need: libraries, styles, colours, new commands; only those whose braces close."""
    out = []
    for m in re.finditer(r"\\(usetikzlibrary|tikzset|definecolor|colorlet|newcommand|renewcommand|def|pgfplotsset|usepackage)\b\*?", text):
        at = text.find("{", m.end())
        end, wanted = -1, {"definecolor": 3, "colorlet": 2, "newcommand": 2, "renewcommand": 2}.get(m[1], 1)
        for _ in range(wanted):
            while at >= 0 and text[at : at + 1] == "[" and (skip := closing(text, at, "[]")) > 0:
                at = skip + 1
            if text[at : at + 1] != "{" or (end := closing(text, at)) < 0:
                end = -1
                break
            at = end + 1
        if end > 0:
            out.append(text[m.start() : end + 1])
    return out


def latex_figures(name: str, text: str) -> list[tuple]:
    """(file, figure, graphic, of, path, caption, label): a row for each included graphic of each figure."""
    out = []
    for k, block in enumerate(environments(uncommented(text), "figure")):
        paths = [m[1].strip() for m in re.finditer(r"\\includegraphics\*?\s*(?:\[[^\]]*\])?\s*\{([^{}]+)\}", block)]
        caption, label = argument(block, "caption"), argument(block, "label")
        out += [(name, k, i, len(paths), p, caption or "", label or "") for i, p in enumerate(paths)]
    return out


def tikz_graph(text: str) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """(label by node id, edges): ids count once, an edge needs an arrow or connector and two known ends."""
    nodes, edges = {}, []
    for i, c in enumerate(x for x in commands(uncommented(text)) if x):
        if m := NODE_AT.search(c):
            body = c[m.end() :]
            named = re.search(r"\(([^()]*)\)", re.sub(r"\[[^\]]*\]", "", body.split("{")[0]))
            label = brace_groups(body)
            nodes.setdefault((named[1].strip() if named else "") or f"node{i}", " ".join(re.sub(r"\\[A-Za-z]+|[{}$~\\]", " ", label[-1] if label else "").split()))
    for c in commands(uncommented(text)):
        if re.match(r"\\(draw|path|edge)\b", c) and re.search(r"->|<-|--|-\||\|-|\bedge\b|\bto\b", c):
            ends = [e.split(".")[0].strip() for e in re.findall(r"\(([^()]*)\)", re.sub(r"\{[^{}]*\}", "", c))]
            known = [e for e in ends if e in nodes]
            edges += list(zip(known, known[1:], strict=False))
    return nodes, edges


def local(tag: str) -> str:
    """A tag's name without its namespace."""
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def svg_graph(text: str) -> tuple[dict[str, str], int]:
    """(label by node, connectors): shapes with the texts in their order; lines, and paths that have a mark or no fill."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return {}, 0
    shapes, texts, edges = [], [], 0
    for e in root.iter():
        tag, style = local(e.tag), f"{e.get('style', '')};fill:{e.get('fill', '')}".replace(" ", "")
        if tag in ("rect", "circle", "ellipse", "polygon"):
            shapes.append(e.get("id") or f"{tag}{len(shapes)}")
        elif tag == "text":
            texts.append(" ".join("".join(e.itertext()).split()))
        elif tag in ("line", "polyline") or tag == "path" and (e.get("marker-end") or e.get("marker-start") or "marker" in style or "fill:none" in style):
            edges += 1
    return {s: texts[i] if i < len(texts) else "" for i, s in enumerate(shapes)}, edges


def infoset(text: str) -> str:
    """An XML document in one spelling: names by namespace, sorted attributes, no prefixes; equal for equal infosets."""

    def said(e) -> list:
        return [e.tag, sorted(e.attrib.items()), (e.text or "").strip(), [said(c) for c in e], (e.tail or "").strip()]

    return json.dumps(said(ET.fromstring(text)), ensure_ascii=False)


def canonical_json(value) -> str:
    """Sorted keys, no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def flag_values(arguments: list[str], flag: str) -> list[str]:
    """Values of `--flag x` and `--flag=x`; a flag without a value is an error."""
    out, rest = [], iter(arguments)
    for a in rest:
        if a == flag:
            v = next(rest, None)
            if v is None or v.startswith("--"):
                raise ValueError(f"{flag} without a value")
            out.append(v)
        elif a.startswith(flag + "="):
            if a == flag + "=":
                raise ValueError(f"{flag} without a value")
            out.append(a[len(flag) + 1 :])
    return out


def unescaped(text: str | None) -> str | None:
    return None if text is None else html.unescape(text)


def slide_shapes(name: str, xml_text: str) -> list[tuple]:
    """(file, z, kind, name, x, y, w, h, text) of a slide's shapes, groups flattened, their offsets and scales applied; EMU."""
    out = []

    def number(e, k: str) -> float:
        return float(e.get(k, 0)) if e is not None else 0.0

    def box(e):
        for x in e.iter():
            if local(x.tag) == "xfrm":
                parts = {local(c.tag): c for c in x}
                return [number(parts.get(p), k) for p, k in (("off", "x"), ("off", "y"), ("ext", "cx"), ("ext", "cy"))], [number(parts.get(p), k) for p, k in (("chOff", "x"), ("chOff", "y"), ("chExt", "cx"), ("chExt", "cy"))]
        return [0.0] * 4, [0.0] * 4

    todo = [(e, (0.0, 0.0, 1.0, 1.0)) for t in ET.fromstring(xml_text).iter() if local(t.tag) == "spTree" for e in t][::-1]
    while todo:
        e, (dx, dy, sx, sy) = todo.pop()
        kind = local(e.tag)
        if kind not in ("sp", "pic", "cxnSp", "graphicFrame", "grpSp"):
            continue
        (x, y, w, h), (cx, cy, cw, ch) = box(e)
        x, y, w, h = dx + x * sx, dy + y * sy, w * sx, h * sy
        if kind == "grpSp":
            gx, gy = (w / cw if cw else sx), (h / ch if ch else sy)
            todo += [(c, (x - cx * gx, y - cy * gy, gx, gy)) for c in e][::-1]
            continue
        label = next((n.get("name", "") for n in e.iter() if local(n.tag) == "cNvPr"), "")
        text = " ".join(t.text or "" for t in e.iter() if local(t.tag) == "t").strip()
        out.append((name, len(out), kind, label, x, y, w, h, text))
    return out


def atom_papers(name: str, text: str) -> list[tuple]:
    """(file, id, title, summary, authors, categories, published) of a feed's entries; white space collapsed."""
    out = []
    for e in ET.fromstring(text):
        if local(e.tag) == "entry":
            one = {local(c.tag): " ".join((c.text or "").split()) for c in e}
            authors = [" ".join((n.text or "").split()) for a in e if local(a.tag) == "author" for n in a if local(n.tag) == "name"]
            out.append((name, re.sub(r"v\d+$", "", one.get("id", "").rsplit("/abs/", 1)[-1]), one.get("title", ""), one.get("summary", ""), authors, [c.get("term", "") for c in e if local(c.tag) == "category"], one.get("published", "")))
    return out


#: Tables from texts: the function of a name and a text, and the columns of its rows.
TABLES: dict[str, tuple[Callable[[str, str], list[tuple]], str]] = {
    "latex_figures": (latex_figures, "file string, figure int, graphic int, of int, path string, caption string, label string"),
    "tikz_nodes": (lambda n, t: [(n, k, v) for k, v in tikz_graph(t)[0].items()], "file string, node string, label string"),
    "tikz_edges": (lambda n, t: [(n, i, a, b) for i, (a, b) in enumerate(tikz_graph(t)[1])], "file string, edge int, source string, target string"),
    "svg_nodes": (lambda n, t: [(n, k, v) for k, v in svg_graph(t)[0].items()], "file string, node string, label string"),
    "slide_shapes": (slide_shapes, "file string, z int, kind string, name string, x double, y double, w double, h double, text string"),
    "atom_papers": (atom_papers, "file string, id string, title string, summary string, authors array<string>, categories array<string>, published string"),
}


def rows_of(df: DataFrame, table: str, name: str = "file", text: str = "text") -> DataFrame:
    """One of TABLES from every row's text; a null text gives no rows, neither does XML that can't be read."""
    of, schema = TABLES[table]
    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        for b in batches:
            for n, t in zip(*[b.column(i).to_pylist() for i in (0, 1)], strict=True):
                try:
                    rows = of(n, t) if t is not None else []
                except ET.ParseError:
                    rows = []
                for at in range(0, len(rows), 1024):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 1024], strict=True), arrow, strict=True)], schema=arrow)

    return df.select(F.col(name).cast("string"), F.col(text)).mapInArrow(run, kind)


def resolved_graphics(figures: DataFrame, files: DataFrame) -> DataFrame:
    """Figures (folder, path) with the file they mean: the path itself or with a suffix, by priority, else the only file of that name."""
    suffixes = F.array(*map(F.lit, ("", ".pdf", ".png", ".jpg", ".jpeg", ".svg", ".eps")))
    clean = F.regexp_replace("path", r"^\./", "")
    tried = figures.withColumn("__c", clean).select("*", F.posexplode(suffixes).alias("__p", "__s")).withColumn("file", F.concat("__c", "__s"))
    own = tried.join(files.select("folder", "file"), ["folder", "file"]).groupBy("folder", "path").agg(F.min_by("file", "__p").alias("exact"))
    base = files.select("folder", "file", F.regexp_replace("file", r"^.*/", "").alias("__b"))
    only = base.groupBy("folder", "__b").agg(F.count("*").alias("__n"), F.min("file").alias("alone")).filter("__n = 1").drop("__n")
    named = tried.withColumn("__b", F.regexp_replace("file", r"^.*/", "")).join(only, ["folder", "__b"]).groupBy("folder", "path").agg(F.min_by("alone", "__p").alias("alone"))
    return figures.join(own, ["folder", "path"], "left").join(named, ["folder", "path"], "left").withColumn("resolved", F.coalesce("exact", "alone")).drop("exact", "alone")
