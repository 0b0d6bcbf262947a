"""Rows kept against the latest kept one, over vectors and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import chains as C
from marlstone.operators import files as G
from marlstone.plans.base import Tables, query
from marlstone.plans.selecting import BITS, sign_bits


@query(f"""WITH RECURSIVE {BITS}, o AS (SELECT vec_id, h, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM bits JOIN embeddings USING (vec_id)),
r(label, k, h, vec_id, kept) AS (SELECT label, k, h, vec_id, true FROM o WHERE k = 1 UNION ALL
  SELECT o.label, o.k, CASE WHEN bit_count(xor(o.h, r.h)) > 28 THEN o.h ELSE r.h END, o.vec_id, bit_count(xor(o.h, r.h)) > 28 FROM r JOIN o ON o.label = r.label AND o.k = r.k + 1)
SELECT label, vec_id FROM r WHERE kept""")
def latest_kept(t: Tables) -> DataFrame:
    """Vectors of a label that are more than 28 bits from the latest kept one, in the order of their ids."""
    rows = sign_bits(t).join(t.embeddings.select("vec_id", "label"), "vec_id")
    return C.latest_kept(rows, ["label"], "vec_id", "h", 28).select("label", "vec_id")


@query("""WITH s AS (SELECT doc_id, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS caption,
  list_sort(list_distinct([x FOR x IN [trim(regexp_replace(lower(y), '[^\\p{L}\\p{N}_]+', ' ', 'g')) FOR y IN [lang, source, split_part(text, ' ', 1)]] IF x <> ''])) AS labels FROM documents)
SELECT caption, array_to_string(labels, ',') AS labels, count(*) AS n, min(doc_id) AS first_id FROM s WHERE caption <> '' AND len(labels) >= 2 GROUP BY 1, 2""")
def labelled_signatures(t: Tables) -> DataFrame:
    """Documents by the signature of their first line and three labels."""
    caption, labels = C.semantic_signature(F.substring_index("text", "\n", 1), F.array("lang", "source", F.substring_index("text", " ", 1)))
    rows = t.documents.select("doc_id", caption.alias("caption"), F.array_join(labels, ",").alias("labels"))
    return rows.filter("caption IS NOT NULL").groupBy("caption", "labels").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def sources(t: Tables) -> DataFrame:
    """(paper, file, text): a document is a file that includes those of twice its number and one, and two, and has a block."""
    d = F.col("doc_id")
    names = [(2 * d + k).cast("string") for k in (1, 2)]
    text = F.concat(
        F.coalesce("text", F.lit("")), F.format_string("\n\\begin{figure}\\input{d%s}\\caption{c{x}}\\end{figure} \\include{../a/d%s.tex}\n", *names),
        F.format_string("\\begin{tikzpicture}b%s\\end{tikzpicture}", (d % 7).cast("string")),
    )
    return t.documents.select(F.lit("p").alias("paper"), F.format_string("a/d%s.tex", d.cast("string")).alias("file"), text.alias("text"))


@query("""WITH RECURSIVE e AS (SELECT a.doc_id AS root, b.doc_id AS file FROM documents a JOIN documents b ON b.doc_id IN (2 * a.doc_id + 1, 2 * a.doc_id + 2)),
r AS (SELECT root, file, 1 AS depth FROM e UNION ALL SELECT r.root, e.file, depth + 1 FROM r JOIN e ON e.root = r.file)
SELECT 'a/d' || root || '.tex' AS root, 'a/d' || file || '.tex' AS file, min(depth) AS depth FROM r GROUP BY ALL""")
def included_files(t: Tables) -> DataFrame:
    return G.closure(G.includes(sources(t))).select("root", "file", "depth")


@query("""SELECT *, CASE WHEN in_figure THEN 'c{x}' ELSE '' END AS caption FROM (SELECT 'a/d' || d.doc_id || '.tex' AS file, '\\begin{tikzpicture}b' || d.doc_id % 7 || '\\end{tikzpicture}' AS block, e.doc_id IS NOT NULL AS in_figure
FROM documents d LEFT JOIN documents e ON d.doc_id = 2 * e.doc_id + 1)""")
def figure_blocks(t: Tables) -> DataFrame:
    return G.figure_blocks(sources(t)).select("file", "block", "in_figure", "caption")
