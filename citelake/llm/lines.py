"""Line dedup (operator 4): drop lines whose key occurs in many documents and put the rest together again.

Rows of one id are one document; a row without id is a document of its own. Keys are compared by two independent 64-bit
hashes. Documents per key are counted as distinct (key, document), pre-aggregated on the map side and dealt by both, so a
line that all documents share is spread over all tasks and then sends one count a task; the join that finds the places of
each document's lines to drop is a plain equi-join whose hot keys Spark may split (or broadcast, by its own size check,
when the table of common keys is small). Documents are met again by (id, hash of the text), null ids included, and the
places that stay are read from the split text, so work is linear in a text's lines.

Defined results: a null or empty text is one empty line, which has no key and stays; repeated rows count as one
document and get the same result each, and several texts of one id are told apart; an empty table gives no rows; other columns pass through, whatever their names, unless
these are the names of results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


RESULTS = ("n_lines", "n_dropped", "kept_text")


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"))


def drop_common_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text."""
    docs = docs.drop(*RESULTS)
    one, two = common.text_key(F.col(text))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("id"), one.alias("t1"), two.alias("t2"), F.col(text).alias("text"))
    # keys are made once per text and then hashed; a lambda's repeated parts would be evaluated again and again
    keys = F.transform(split_lines(common.lower_ascii(F.col("text"))), lambda x: F.btrim(x, F.lit(common.BLANKS)))
    hashes = F.transform(keys, lambda x: F.when(F.length(x) >= min_chars, _hash(x)))
    doc = F.when(F.col("id").isNotNull(), F.struct(F.col("id"), F.lit(-1).cast("long").alias("n"))).otherwise(F.struct(F.col("id"), F.monotonically_increasing_id().alias("n")))
    each = rows.select(doc.alias("doc"), F.explode(F.array_distinct(hashes)).alias("h")).select("doc", "h.a", "h.b").where("a is not null")
    common_keys = each.groupBy("a", "b").agg(F.count_distinct("doc").alias("n")).where(F.col("n") >= min_docs).select("a", "b")
    common_keys = common.written(common_keys, "common-lines")
    places = rows.select("id", "t1", "t2", F.posexplode(hashes).alias("at", "h")).select("id", "t1", "t2", "at", "h.a", "h.b").where("a is not null")
    drops = places.join(common_keys, ["a", "b"], "left_semi").groupBy("id", "t1", "t2").agg(F.collect_set("at").alias("gone"))
    drops = drops.select(F.col("id").alias("d"), F.col("t1").alias("u1"), F.col("t2").alias("u2"), "gone")
    joined = rows.join(drops, F.col("id").eqNullSafe(F.col("d")) & (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")), "left")
    # a generator, so that the split is a value of its own and is not made anew for every place that is read from it
    split = joined.select("row", "text", "gone", F.explode(F.array(split_lines(F.col("text")))).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.col("lines")[i]), "\n"))
    dropped = F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long")
    done = split.select("row", F.struct(F.size("lines").cast("long").alias("n_lines"), dropped.alias("n_dropped"), kept.alias("kept_text")).alias("result"))
    return done.select("row.*", "result.*")
