"""Conversation prefix trie: one row for each distinct sequence of first turns, with counts over its subtree.

Every conversation gets a chain of SHA-256 digests, each over the one before it and the next turn; two conversations share
a prefix exactly when they share its digest. Every prefix is a row, and grouping by (depth, digest) makes the nodes. Sums
over subtrees come from exploding every node to all its ancestors: a node is known by its smallest member, and that
conversation's prefixes are its ancestors. The nodes of one member lie on one path, so they are summed along it first and
each path is exploded once, to the ancestors that other members stand for; so there are never more such rows than turns.

Texts leave the first step as digests and lengths. All counts are pre-aggregated; joins on hot nodes (a first turn that a
third of all conversations share) have written tables on both sides, so that Spark may split them. Two things are
sequential by their definition and stream through one task in sorted order, with constant memory: the chain of one
conversation, and the digest over the ids of the conversations that end in one node.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_of, written

ROOT = hashlib.sha256(b"").digest()


def turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, mark, chars): each conversation's turns in order, place from 1; mark is a digest of role and text,
    chars the code points of the text. Null turns come first; rows with one turn number are ordered by their marks, and
    repeated rows are turns of their own. Null roles and texts are empty. Rows without conv_id belong to no conversation."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    mark = F.unhex(F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said), 256))
    slim = rows.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), mark.alias("mark"), F.length(said).cast("long").alias("chars"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "mark"))
    return slim.select("conv_id", place.cast("long").alias("place"), "mark", "chars")


def grafted(places: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """Conversations whose first `heads` turns (a column over conv_id, at most `most`) are those of conversation `base`; their
    own turns follow after as many. Conversations that lose all turns stay, with a row without place. A base conversation
    sends its first `most` turns only, so a row a conversation and turn is all that is made."""
    places = written(places, "turns")
    ids = places.groupBy("conv_id").agg(F.lit(1).alias("one")).drop("one")
    own = places.where(F.col("place") > heads).withColumn("own", F.lit(True))
    first = places.where(F.col("place") <= most).select(F.col("conv_id").alias("from"), "place", "mark", "chars")
    wanted = ids.select("conv_id", base.alias("from"), heads.alias("heads"))
    head = wanted.join(first, "from").where("place <= heads").select("conv_id", "place", "mark", "chars", F.lit(False).alias("own"))
    bare = ids.select("conv_id", F.lit(None).cast("long").alias("place"), F.lit(None).cast("binary").alias("mark"), F.lit(0).cast("long").alias("chars"), F.lit(False).alias("own"))
    return own.unionByName(head).unionByName(bare)


def prefixes(places: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, parent, chars, ends): every prefix of every conversation, the root included. Turns are taken
    in the order of `own` (where there is one) and `place`; ends marks a conversation's last prefix. Rows without place only
    say that the conversation is there."""
    import pyarrow as pa

    by = [*(["own"] if "own" in places.columns else []), "place"]
    dealt = places.repartition(buckets_of(places.sparkSession), "conv_id").sortWithinPartitions("conv_id", *by).select("conv_id", "place", "mark", "chars")
    names = ["conv_id", "depth", "digest", "parent", "chars", "ends"]

    def chain(batches):
        conv = depth = digest = last = None
        for batch in batches:
            out = []
            for c, place, mark, chars in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if c != conv:
                    if last:
                        out.append((*last, True))
                    conv, depth, digest, last = c, 0, ROOT, (c, 0, ROOT, None, 0)
                if place is not None:
                    out.append((*last, False))
                    depth, parent, digest = depth + 1, digest, hashlib.sha256(digest + mark).digest()
                    last = (c, depth, digest, parent, chars)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), KINDS, strict=True)], names=names)
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*last, True), KINDS, strict=True)], names=names)

    KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    return dealt.mapInArrow(chain, "conv_id long, depth long, digest binary, parent binary, chars long, ends boolean")


def id_digests(ends: DataFrame) -> DataFrame:
    """(depth, digest, conv_id) -> (depth, digest, ends_sha256): hex SHA-256 of a node's decimal ids, ascending, joined by
    commas. The ids of a node stream through in order; no list of them is ever made."""
    import pyarrow as pa

    dealt = ends.repartition(buckets_of(ends.sparkSession), "digest", "depth").sortWithinPartitions("digest", "depth", "conv_id").select("depth", "digest", "conv_id")
    names = ["depth", "digest", "ends_sha256"]

    def fold(batches):
        node = state = None
        for batch in batches:
            out = []
            for depth, digest, conv in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if (depth, digest) != node:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (depth, digest), hashlib.sha256(b"%d" % conv)
                else:
                    state.update(b",%d" % conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), KINDS, strict=True)], names=names)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*node, state.hexdigest()), KINDS, strict=True)], names=names)

    KINDS = [pa.int64(), pa.binary(), pa.string()]
    return dealt.mapInArrow(fold, "depth long, digest binary, ends_sha256 string")


def prefix_trie(places: DataFrame) -> DataFrame:
    """Rows of turns() or grafted() -> one row per node: digest, conv_id (smallest member), depth, parent_conv_id (root: null),
    n_convs, n_children, n_leaves (childless nodes of the subtree, itself included), saved_tokens (for each node of the
    subtree, (n_convs - 1) times the code points of its last text) and ends_sha256 (id_digests; none: that of the empty
    string). Without conversations there are no nodes, not even a root."""
    node = ["depth", "digest"]
    every = written(prefixes(places), "prefixes")
    nodes = written(every.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("chars").alias("chars")), "nodes")
    children = nodes.where("parent is not null").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(above, ["depth", "parent"], "left").join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    # sums along the path of each node's smallest member, from its end upward
    upward = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    leaf, saved = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), (F.col("n_convs") - 1) * F.col("chars")
    nodes = written(nodes.withColumns({"leaves_below": F.sum(leaf).over(upward), "saved_below": F.sum(saved).over(upward)}), "node-paths")
    paths = written(nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("leaves_below").alias("leaves"), F.max("saved_below").alias("saved")), "path-sums")
    up = every.select("conv_id", *node).join(paths, "conv_id").where("depth < top").groupBy(*node).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    done = nodes.join(up, node, "left").join(id_digests(every.where("ends").select(*node, "conv_id")), node, "left")
    return done.select(
        "digest", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves_below") + F.coalesce("leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved_below") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
