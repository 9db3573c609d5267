"""N-gram Jaccard join: documents by 5-word shingles, linked from a Jaccard similarity of 0.75, as components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .setjoin import COLD, Rule, components, link
from .shared import staged


def near_duplicates(docs: DataFrame, percent: int = 75, size: int = 5, id_col: str = "doc_id", text_col: str = "text", cold: int = COLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    Null or empty texts and texts without words: no shingles, linked with nothing, their own component. A text of
    fewer than `size` words is one shingle. Repeated rows each come back. Rows with a null id are grouped by their
    text but give no id to a component. Texts are equal or linked by 64-bit hashes of words and shingles.
    """
    rule = Rule(percent, size, cold=cold)
    found = link(docs, rule, id_col, text_col)
    units, labels = found.units, components(found.links)
    # per distinct text, then per component: partial aggregation takes copies together before any shuffle
    texts = units.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    grouped = texts.join(labels, "key", "left").select("key", F.coalesce("label", "key").alias("label"), "least")
    heads = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    member = grouped.join(heads, "label").select("key", "component_id")
    return units.join(member, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 75, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of each group of rows that link, directly or by a chain: the one with the smallest id.

    Rows are told apart by (id, xxhash64 of the text), so another text of a removed row's id stays if it isn't linked
    itself. Of texts with one id the one with the smallest hash stays, of equal rows any one. A null id is no larger
    than another: of a group's rows with a null id one stays, beside the one with the smallest id.
    """
    rule = Rule(percent, size)
    found = link(docs, rule, id_col, text_col)
    units = found.units.where("key is not null").select("key", F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    labels = components(found.links)
    # per distinct text, then per component: partial aggregation takes copies together before any shuffle
    texts = units.groupBy("key", "none").agg(F.min(F.struct("doc_id", "row")).alias("at"), F.count("*").alias("n"))
    grouped = texts.join(labels, "key", "left").select("key", "none", F.coalesce("label", "key").alias("label"), "at", "n")
    heads = grouped.groupBy("label", "none").agg(F.min("at").alias("head"), F.sum("n").alias("rows")).where("rows > 1")
    member = grouped.join(heads, ["label", "none"]).select("key", "none", "head")
    stays = (F.struct("doc_id", "row").eqNullSafe(F.col("head"))).alias("stays")
    judged = units.join(member, ["key", "none"]).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), stays)
    judged = staged(judged.groupBy("__id", "__row").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"), "judged")
    rows, own, text = docs.alias("docs"), F.col(f"docs.`{id_col}`").cast("bigint"), F.xxhash64(F.col(f"docs.`{text_col}`"))

    def same(side: str):  # columns of docs may have any name
        return own.eqNullSafe(F.col(f"{side}.__id")) & (text == F.col(f"{side}.__row"))

    out = rows.join(judged.select("__id", "__row").alias("judged"), same("judged"), "left_anti")
    repeated = judged.where("stays").select("__id", "__row")
    if repeated.isEmpty():
        return out
    once = rows.join(repeated.alias("repeated"), same("repeated"), "left_semi").groupBy(own.alias("__id"), text.alias("__row")).agg(F.first(F.struct("*")).alias("__kept"))
    return out.unionByName(once.select("__kept.*"))
