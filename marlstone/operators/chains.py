"""Sequential rules as pointers followed by path doubling: what a pass keeps that compares each row with the latest kept one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.select import hamming
from marlstone.session import cut, written

#: Rows of a block are numbered in 2^BLOCK; doublings after which a chain has ended for sure.
BLOCK, DOUBLINGS = 10, 64


def reached(pointers: DataFrame, heads: DataFrame) -> DataFrame:
    """(g): all that chains of `pointers` (g, next) reach from `heads` (g), these included; next is greater than g.

    Each round doubles the pointers' length, so a chain of n rows takes log2 n rounds; a pointer past the end goes.
    """
    marked, jump = cut(heads.select("g").distinct()), cut(pointers.select("g", "next"))
    for _ in range(DOUBLINGS):
        if not jump.take(1):
            return marked
        onward = jump.join(marked, "g", "left_semi").select(F.col("next").alias("g"))
        marked = cut(marked.unionByName(onward).distinct())
        jump = cut(jump.join(jump.select(F.col("g").alias("next"), F.col("next").alias("after")), "next").select("g", F.col("after").alias("next")))
    raise RuntimeError("a chain doesn't end")


def numbered(rows: DataFrame, signature: list[str], order: str) -> DataFrame:
    """Rows with `g`, ascending by signature and order, and `block`, runs of at most 2^BLOCK rows; written, so that numbers stay."""
    placed = rows.repartitionByRange(*signature, order).sortWithinPartitions(*signature, order)
    return written(placed.withColumn("g", F.monotonically_increasing_id()).withColumn("block", F.shiftright("g", BLOCK)))


def next_far(rows: DataFrame, signature: list[str], bits: str, most: int) -> DataFrame:
    """(g, next): the first later row of the signature more than `most` bits away; rows without one have no pointer.

    A row looks through its own block, then through 1, 2, 4, ... further blocks of its signature until one has such a row.
    A block is passed by where its centre and radius say that all its hashes are near.
    """
    each = rows.groupBy(*signature, "block", F.col(bits).alias("h")).agg(F.collect_list("g").alias("gs"))
    # for a hash the last row of the block counts in the own block, the first in a later one, so both ends are held
    held = each.select(*signature, "block", "h", F.array_sort("gs").alias("gs")).groupBy(*signature, "block").agg(F.collect_list(F.struct("h", "gs")).alias("of"))
    centre = F.col("of")[0]["h"]
    held = held.withColumn("centre", centre).withColumn("radius", F.array_max(F.transform("of", lambda x: hamming(x["h"], F.col("centre")))))
    number = Window.partitionBy(*signature).orderBy("block")
    held = cut(held.withColumn("bi", F.row_number().over(number)))
    last = held.groupBy(*signature).agg(F.max("bi").alias("blocks"))
    far = lambda x: hamming(x["h"], F.col("u")) > most
    own = rows.select(*signature, "block", "g", F.col(bits).alias("u")).join(held, [*signature, "block"])
    later = F.array_min(F.flatten(F.transform(F.filter("of", far), lambda x: F.filter(x["gs"], lambda g: g > F.col("g")))))
    own = cut(own.select(*signature, "bi", "g", "u", later.alias("next")))
    # beyond its block, rows of one hash share what they find
    open_ = cut(own.filter("next IS NULL").select(*signature, "bi", "u").distinct().join(last, signature))
    found, low, width = None, 1, 1
    while open_.filter(F.col("bi") + low <= F.col("blocks")).take(1):
        asked = open_.filter(F.col("bi") + low <= F.col("blocks"))
        asked = asked.withColumn("to", F.explode(F.sequence(F.col("bi") + low, F.least(F.col("bi") + low + width - 1, F.col("blocks")))))
        met = asked.join(held.select(*signature, F.col("bi").alias("to"), "of", "centre", "radius"), [*signature, "to"])
        met = met.filter(hamming(F.col("u"), F.col("centre")) + F.col("radius") > most)
        first = met.select(*signature, "bi", "u", F.array_min(F.transform(F.filter("of", far), lambda x: x["gs"][0])).alias("next")).filter("next IS NOT NULL")
        first = cut(first.groupBy(*signature, "bi", "u").agg(F.min("next").alias("next")))
        found = first if found is None else found.unionByName(first)
        open_ = cut(open_.join(first.select(*signature, "bi", "u"), [*signature, "bi", "u"], "left_anti"))
        low, width = low + width, 2 * width
    inside = own.filter("next IS NOT NULL").select("g", "next")
    if found is None:
        return inside
    return inside.unionByName(own.filter("next IS NULL").drop("next").join(found, [*signature, "bi", "u"]).select("g", "next"))


def latest_kept(rows: DataFrame, signature: list[str], order: str, bits: str, most: int) -> DataFrame:
    """Rows that stay when a pass in `order` drops each one within `most` bits of the latest kept row of its signature.

    What a kept row leads to is the first later row that is far from it, whatever comes between; so the kept rows are the
    chain of such pointers from a signature's first row. A row whose signature has a null, or without bits, stays, and is
    compared with none. `order` is unique within a signature.
    """
    known = F.col(bits).isNotNull()
    for c in signature:
        known = known & F.col(c).isNotNull()
    other = rows.filter(~known)
    own = numbered(rows.filter(known), signature, order)
    heads = own.groupBy(*signature).agg(F.min("g").alias("g"))
    kept = reached(next_far(own, signature, bits, most), heads)
    return own.join(kept, "g", "left_semi").select(*rows.columns).unionByName(other)


def semantic_signature(caption: Column, labels: Column) -> tuple[Column, Column]:
    """(caption, labels): both lower-cased with runs of other signs as one space, labels distinct and sorted; null where the caption is empty or fewer than two labels are left."""
    bare = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))
    own = F.array_sort(F.array_distinct(F.filter(F.transform(labels, bare), lambda x: x != "")))
    fine = (bare(caption) != "") & (F.size(own) >= 2)
    return F.when(fine, bare(caption)), F.when(fine, own)
