"""Line dedup: an exact set-similarity join of lines; later matches go.

A line's set is its 5-word shingles (all its words as one if it has fewer); lines match from a Jaccard similarity of
0.75. A line goes if an earlier line, by (document id, line number), matches it, whether or not that one stays. The join
is that of setjoin.py: tokens by rarity, prefixes, position and length bounds, verified Jaccard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .setjoin import COLD, Rule, link
from .shared import staged


def later_matches(docs: DataFrame, percent: int = 75, size: int = 5, id_col: str = "doc_id", text_col: str = "text", cold: int = COLD) -> DataFrame:
    """(doc_id, row, unit): the lines that go; row is the xxhash64 of the text, unit the line's number from 0."""
    rule = Rule(percent, size, lines=True, cold=cold)
    found = link(docs.where(F.col(f"`{id_col}`").isNotNull()), rule, id_col, text_col)
    at = F.struct("doc_id", "unit")
    # copies: only lines whose key may come again are listed; they come together before the shuffle
    copies = staged(found.units.groupBy("key").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first"), "copies")
    again = found.units.join(copies, "key").where(F.col("first") < at)
    # near copies: a key is late if it links with one first seen earlier
    first = staged(found.members.groupBy("key").agg(F.min(at).alias("at")), "first")
    own, other = first.select(F.col("key").alias("a"), F.col("at").alias("at_a")), first.select(F.col("key").alias("b"), F.col("at").alias("at_b"))
    ends = found.links.join(own, "a").join(other, "b")
    late = staged(ends.select(F.when(F.col("at_b") < F.col("at_a"), F.col("a")).otherwise(F.col("b")).alias("key")).distinct(), "late")
    gone = again.select("doc_id", "row", "unit").unionByName(found.members.join(late, "key").select("doc_id", "row", "unit"))
    return gone


def drop_later_lines(docs: DataFrame, percent: int = 75, size: int = 5, id_col: str = "doc_id", text_col: str = "text", cold: int = COLD) -> DataFrame:
    """(row, text, n_lines, n_removed) for every row of docs: row has all its columns, text is what stays of its lines.

    Lines are cut at \\n; lines without words stay. Null and empty texts, and rows with a null id, stay as they are
    and match nothing. Rows of one id with one text are one document: both keep or lose the same lines.
    """
    gone = later_matches(docs, percent, size, id_col, text_col, cold).groupBy("doc_id", "row").agg(F.collect_set("unit").alias("units"))
    key = [F.col(f"`{id_col}`").cast("bigint").alias("__id"), F.xxhash64(F.col(f"`{text_col}`")).alias("__row")]
    rows = docs.select(F.struct("*").alias("row"), *key)
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "units")
    joined = rows.join(gone.hint("shuffle_hash"), ["__id", "__row"], "left")
    old = F.col(f"row.`{text_col}`")
    lines = F.split(old, "\n", -1)
    left = F.filter(lines, lambda x, i: ~F.array_contains(F.col("units"), i.cast("bigint")))
    text = F.when(F.col("units").isNull(), old).otherwise(F.array_join(left, "\n"))
    return joined.select("row", text.alias("text"), F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce(F.size("units"), F.lit(0)).alias("n_removed"))
