"""Files that name other files: included sources and what they reach, graphics, and the blocks of figures.

Tables of files have (paper, file, text); paths count from the paper's root, with / between folders.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import cut

# Suffixes in the order in which they are tried, and the commands that name files.
SOURCES = (".tex", ".tikz", ".pgf", ".ltx")
GRAPHICS = (".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".eps", ".svg")
INPUT = r"(?i)\\(?:input|include|subfile)\s*\{([^{}]+)\}"
GRAPHIC = r"(?is)\\includegraphics\s*\*?\s*(?:\[[^\]]*\])?\s*\{([^{}]+)\}"
FIGURE = r"(?is)\\begin\s*\{figure\*?\}(.*?)\\end\s*\{figure\*?\}"
FOLDERS = r"(?s)\\graphicspath\s*\{((?:\s*\{[^{}]*\})*)\s*\}"
BRACES = r"\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"


def nested(name: str, depth: int = 4) -> str:
    """A pattern of an environment that holds itself up to `depth` deep."""
    begin, end = rf"\\begin\s*\{{{name}\}}", rf"\\end\s*\{{{name}\}}"
    plain = rf"(?:(?!{begin}|{end}).)"
    return "(?s)" + reduce(lambda inner, _: rf"{begin}(?:{plain}|{inner})*+{end}", range(depth - 1), rf"{begin}{plain}*+{end}")


def folder(path: Column) -> Column:
    """A path's folder with its slash, empty at the root."""
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)


def plain(path: Column) -> Column:
    """A path without `.` and `..`; one that leaves the root keeps its `..` and so names no file."""
    step = lambda a, x: F.when(x.isin("", "."), a).when((x == "..") & (F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, 1, F.size(a) - 1)).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def named(files: DataFrame, pattern: str, source: str = "text") -> DataFrame:
    """(paper, file, value): what a pattern's first group names, each once a file; nothing with a macro's # in it."""
    value = F.explode(F.array_distinct(F.regexp_extract_all(source, F.lit(pattern), F.lit(1))))
    rows = files.select("paper", "file", value.alias("value")).withColumn("value", F.translate(F.trim("value"), "\\", "/"))
    return rows.filter((F.col("value") != "") & ~F.contains("value", F.lit("#"))).distinct()


def first_file(asked: DataFrame, tried: Column, files: DataFrame) -> DataFrame:
    """`asked` with `target`: the first of the paths `tried` that is a file of the paper, null if none is."""
    each = asked.select("*", F.posexplode(tried).alias("__p", "__path")).withColumn("__path", plain(F.col("__path")))
    there = files.select("paper", F.col("file").alias("__path")).distinct()
    found = each.join(there, ["paper", "__path"]).groupBy(*asked.columns).agg(F.min_by("__path", "__p").alias("target"))
    return asked.join(found, asked.columns, "left")


def includes(files: DataFrame) -> DataFrame:
    """(paper, file, value, target) of every file that another names; a suffix that lacks is tried by SOURCES, beside the file and from the root."""
    asked = named(files, INPUT)
    bases = [F.concat(folder(F.col("file")), "value"), F.col("value")]
    more = F.array(*[F.concat(b, F.lit(s)) for s in SOURCES for b in bases])
    bare = ~F.col("value").rlike(r"\.[^./]+$")
    return first_file(asked, F.when(bare, F.concat(F.array(*bases), more)).otherwise(F.array(*bases)), files)


def closure(edges: DataFrame) -> DataFrame:
    """(paper, root, file, depth): all files that a file includes by any way, with the fewest steps; a cycle is an error that names a file on it.

    A fixpoint of joins that doubles its reach: with all ways of up to n steps known, those of exactly n steps go on by each
    of them, so its rounds are the logarithm of the longest way. A shortest way of up to 2n steps is two shortest ones.
    """
    last = all_ = cut(edges.filter("target IS NOT NULL").select("paper", F.col("file").alias("root"), F.col("target").alias("file")).distinct().withColumn("depth", F.lit(1)))
    reach = 1
    while True:
        ring = last.filter("root = file").orderBy("depth").take(1)
        if ring:
            raise ValueError(f"{ring[0].paper}: {ring[0].root} includes itself, in {ring[0].depth} steps")
        far = last.filter(F.col("depth") == reach).select("paper", "root", "file")
        onward = all_.select("paper", F.col("root").alias("file"), F.col("file").alias("next"), "depth")
        new = far.join(onward, ["paper", "file"]).groupBy("paper", "root", F.col("next").alias("file")).agg((F.min("depth") + reach).alias("depth"))
        # what comes back to its root is known by its depth, so it isn't taken for something found before
        last = cut(new.join(all_, ["paper", "root", "file"], "left_anti"))
        reach *= 2
        if not last.take(1):
            return all_
        all_ = all_.unionByName(last)


def graphics(files: DataFrame, text: str = "text") -> DataFrame:
    """(paper, file, value, target) of every graphic that a file names.

    Tried in order beside the file, from the root and in the folders of \\graphicspath, as named and then with GRAPHICS; else
    the only graphic of the paper with that name, whatever its folder and case.
    """
    given = F.regexp_extract_all(F.regexp_extract(text, FOLDERS, 1), F.lit(r"\{([^{}]*)\}"), F.lit(1))
    extra = files.select("paper", "file", F.transform(given, lambda x: F.regexp_replace(x, "/?$", "/")).alias("extra"))
    asked = named(files, GRAPHIC, text)
    asked = asked.withColumn("value", F.regexp_replace("value", r"^/detokenize\{(.*)\}$", "$1")).join(extra.groupBy("paper", "file").agg(F.first("extra").alias("extra")), ["paper", "file"])
    bare = ~F.col("value").rlike(r"\.[^./]+$")
    suffixes = F.when(bare, F.array(*map(F.lit, ("", *GRAPHICS)))).otherwise(F.array(F.lit("")))
    own = folder(F.col("file"))
    bases = F.concat(F.array(own, F.lit("")), F.transform("extra", lambda x: F.concat(own, x)))
    tried = F.flatten(F.transform(bases, lambda b: F.transform(suffixes, lambda s: F.concat(b, F.col("value"), s))))
    exact = first_file(asked, tried, files)
    low = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    pictures = files.select("paper", F.col("file").alias("path")).filter(F.lower("path").rlike("(" + "|".join(map("\\{}".format, GRAPHICS)) + ")$"))
    names = pictures.select("paper", "path", F.explode(F.array(low, F.regexp_replace(low, r"\.[^.]*$", ""))).alias("name"))
    only = names.groupBy("paper", "name").agg(F.count_distinct("path").alias("n"), F.min("path").alias("alone")).filter("n = 1").drop("n")
    wanted = exact.withColumn("name", F.lower(F.regexp_extract("value", r"([^/]*)$", 1)))
    return wanted.join(only, ["paper", "name"], "left").select("paper", "file", "value", F.coalesce("target", "alone").alias("target"))


def figure_blocks(files: DataFrame, name: str = "tikzpicture") -> DataFrame:
    """(paper, file, block, in_figure, caption, label): each block of each file once, first as part of a figure.

    A figure's blocks are those in it and those of the files that it includes; then come the blocks outside of all figures.
    Of equal blocks of a file the first figure, by file and place, gives caption and label.
    """
    sources = files.filter(F.lower("file").rlike(r"\.(tex|ltx|tikz|pgf)$"))
    blocks = F.regexp_extract_all("text", F.lit(nested(name)), F.lit(0))
    figures = sources.select("paper", "file", F.posexplode(F.regexp_extract_all("text", F.lit(FIGURE), F.lit(1))).alias("place", "text"))
    argument = lambda command: F.regexp_extract("text", rf"(?s)\\{command}\s*(?:\[[^\]]*\])?\s*{BRACES}", 1)
    figures = figures.withColumns({"caption": argument("caption"), "label": argument("label")})
    at = F.struct(F.lit(0).alias("loose"), F.col("file").alias("by"), "place", "caption", "label").alias("at")
    inside = figures.select("paper", "file", F.explode(blocks).alias("block"), at)
    held = sources.select("paper", "file", F.explode(blocks).alias("block"))
    # a figure is named by its file and place while its inclusions are resolved beside that file
    asked = figures.select("paper", "file", "place", at, F.explode(F.regexp_extract_all("text", F.lit(INPUT), F.lit(1))).alias("value")).withColumn("value", F.translate(F.trim("value"), "\\", "/"))
    known = includes(sources).filter("target IS NOT NULL")
    included = asked.join(known, ["paper", "file", "value"]).select("paper", F.col("target").alias("file"), "at").join(held, ["paper", "file"]).select("paper", "file", "block", "at")
    nowhere = F.struct(F.lit(1).alias("loose"), F.col("file").alias("by"), F.lit(0).alias("place"), F.lit("").alias("caption"), F.lit("").alias("label")).alias("at")
    every = inside.unionByName(included).unionByName(held.select("paper", "file", "block", nowhere))
    first = every.groupBy("paper", "file", "block").agg(F.min("at").alias("at"))
    return first.select("paper", "file", "block", (F.col("at.loose") == 0).alias("in_figure"), "at.caption", "at.label")
