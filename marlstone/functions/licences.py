"""Licences by their URL: an ordered ladder of rules, and the link of a page's licence block. No Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CC = "creativecommons.org/licenses/"
#: Fixed values, in order: what the URL holds, family, status, whether the licence grants redistribution, its conditions. Then why, in own words.
LADDER = (
    (("arxiv.org/licenses/nonexclusive-distrib", "arxiv.org/licenses/assumed-1991-2003"), "arxiv-nonexclusive", "exclude-assets", False, (), "rights go to the archive alone"),
    (("creativecommons.org/publicdomain/zero",), "cc0", "release-ready", True, (), "no conditions"),
    (("creativecommons.org/publicdomain/mark",), "public-domain-mark", "release-ready", True, (), "marked as public domain"),
    ((CC + "by-nc-nd/",), "cc-by-nc-nd", "exclude-assets", False, ("attribution", "noncommercial", "no-derivatives"), "a rendering is a derivative"),
    ((CC + "by-nc-sa/",), "cc-by-nc-sa", "review-required", True, ("attribution", "noncommercial", "share-alike"), "conditions limit the use"),
    ((CC + "by-nc/",), "cc-by-nc", "review-required", True, ("attribution", "noncommercial"), "not for commercial use"),
    ((CC + "by-nd/",), "cc-by-nd", "exclude-assets", False, ("attribution", "no-derivatives"), "a rendering is a derivative"),
    ((CC + "by-sa/",), "cc-by-sa", "release-ready", True, ("attribution", "share-alike"), "credit and the same licence"),
    ((CC + "by/",), "cc-by", "release-ready", True, ("attribution",), "credit"),
)
NONE = ("unknown", "review-required", False, (), "no licence was found")
OTHER = ("other", "review-required", False, (), "no rule covers this licence")


def decision(url: Column) -> Column:
    """struct(family, status, grant, conditions, rationale) of the first rule that holds; null and blank URLs are `unknown`."""

    def said(family: str, status: str, grant: bool, conditions: tuple[str, ...], rationale: str) -> Column:
        listed = F.array(*map(F.lit, conditions)).cast("array<string>")
        return F.struct(F.lit(family).alias("family"), F.lit(status).alias("status"), F.lit(grant).alias("grant"), listed.alias("conditions"), F.lit(rationale).alias("rationale"))

    plain = F.regexp_replace(F.replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), F.lit("https://"), F.lit("http://")), r"(?:license\.html)?/?$", "")
    out = said(*OTHER)
    for parts, *rest in reversed(LADDER):
        held = F.lit(False)
        for part in parts:
            held = held | F.contains(plain, F.lit(part))
        out = F.when(held, said(*rest)).otherwise(out)
    return F.when(plain == "", said(*NONE)).otherwise(out)


TAG = r"""(?s)</?[A-Za-z](?:[^>"']|"[^"]*"|'[^']*')*>"""


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or bare, its common character references read; '' without it."""
    found = F.concat(*[F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", i) for i in (1, 2, 3)])
    for code, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        found = F.replace(found, F.lit(code), F.lit(char))
    return found


def block_href(html: Column, block: str = "abs-license") -> Column:
    """The first link's target inside a div of the class `block`; '' without one, for null and for empty text.

    A fold over the page's tags that counts how deep the block is open: every start tag is one deeper, every end tag one
    less, a self-closing one neither. Comments, scripts and styles hold no tags.
    """
    clean = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    tags = F.regexp_extract_all(clean, F.lit(TAG), F.lit(0))

    def step(state: Column, tag: Column) -> Column:
        depth, url = state["depth"], state["url"]
        closing, alone = tag.startswith("</"), tag.endswith("/>")
        name = F.lower(F.regexp_extract(tag, r"^</?([A-Za-z][^\s/>]*)", 1))
        opens = ~closing & (name == "div") & F.array_contains(F.split(attribute(tag, "class"), r"\s+"), block)
        inside = F.when(depth > 0, F.when(alone, depth).when(closing, depth - 1).otherwise(depth + 1)).otherwise(depth)
        link = (depth > 0) & ~closing & (name == "a") & (url == "")
        return F.struct(F.when(opens, F.when(alone, 0).otherwise(1)).otherwise(inside).alias("depth"), F.when(link, F.trim(attribute(tag, "href"))).otherwise(url).alias("url"))

    return F.aggregate(tags, F.struct(F.lit(0).alias("depth"), F.lit("").alias("url")), step, lambda s: s["url"])
