"""Registered queries of the engine's own operators over the driver's tables, with their SQL.

The tables hold Latin-script prose, so question terms are words. Questions are the whole texts of the whole `benchmark`
table; their terms are their distinct words of four characters or more, whatever their letters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citelake.functions import clauses, text
from citelake.functions.embedding import cosine
from citelake.operators import dense_index, evaluate, evidence, extract, filters, fulltext, jobs, merge_store, normalize, payload_index, quality, registry, retrieval, stores, tables
from citelake.plans import hybrid
from citelake.sources import pages as source_pages
from citelake.sources import scroll
from citelake.stages import small_batches, stage_path
from citelake.stages import table as plain_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return plain_table(spark, sf_dir, name)


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


WORD4 = r"[\p{L}\p{M}\p{Nd}_]{4,}"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD4), F.lit(0))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.array_distinct(words).alias("terms"))


QUESTIONS_SQL = f"q AS (SELECT item_id AS query_id, text AS query, list_distinct(regexp_extract_all(lower(text), '{WORD4}')) AS terms FROM benchmark)"
SCORED_SQL = f"""{QUESTIONS_SQL},
t AS (SELECT query_id, unnest(terms) AS term FROM q),
s AS (SELECT query_id, doc_id, sum((1 + least(length(term), 12) / 12.0) * ln(1 + (length(body) - length(replace(body, term, ''))) / length(term))) AS score
      FROM (SELECT doc_id, lower(text) AS body FROM documents) d JOIN t ON contains(body, term) GROUP BY 1, 2)"""


def _keyword(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return retrieval.keyword_search(docs_of(spark, sf_dir), questions(spark, sf_dir), k, F.lower("text"), "doc_id")


def doc_dedupe_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd documents as uploads against the even ones, which are registered: the first version of the same content."""
    docs = docs_of(spark, sf_dir)
    stored = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.lit("processed").alias("status"), F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("created_at"))
    found = registry.content_duplicates(docs.where("doc_id % 2 = 1").withColumnRenamed("text", "content"), stored)
    return found.select("doc_id", "content_hash", F.coalesce("existing_version_id", F.lit(-1)).alias("existing_version_id"))


def quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    rows = docs_of(spark, sf_dir).select("doc_id", F.size(lines).cast("long").alias("block_count"), F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(F.trim(x))).alias("text_len"))
    score, grade = quality.grade_of(F.col("text_len"), F.col("block_count"), F.lit(0))
    return rows.select("doc_id", "block_count", "text_len", score.cast("long").alias("score"), grade.alias("grade"))


def readable_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).select("doc_id", F.round(text.readable_ratio(F.col("text")), 6).alias("ratio"))


def noisy_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).select("doc_id", text.is_noisy(F.col("text")).alias("noisy"))


def _line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = docs_of(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "text"))
    return each.select("doc_id", "ordinal", "text", F.lit("text").alias("source_type"), F.lit("c").alias("chunk_id"))


def chunk_gate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = quality.chunk_gate(_line_chunks(spark, sf_dir), keys=("doc_id",))
    return gated.groupBy("doc_id").agg(F.count_if(F.col("gate") == "keep").alias("kept"), F.count_if(F.col("gate") == "dup").alias("dropped_dup"), F.count_if(F.col("gate") == "noise").alias("dropped_noise"), F.count_if(F.col("gate") == "short").alias("dropped_short"))


def repeat_line_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of a source are the pages of one document."""
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), "text")
    kept = normalize.denoised_lines(pages, ["licen[sc]e"], keys=("doc_id",))
    return kept.groupBy(F.col("page_no").alias("doc_id")).agg(F.count("*").alias("kept"), F.sum(F.length("line").cast("long")).alias("kept_chars"))


def denoised_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by blocks: each line of a document is a block of its page."""
    block = lambda x: F.struct(F.lit("paragraph").alias("type"), x.alias("text"))
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), F.transform(F.split("text", r"\r\n|[\n\r]", -1), block).alias("blocks"))
    kept = normalize.denoised_blocks(pages, ["licen[sc]e"], keys=("doc_id",))
    return kept.select(F.col("page_no").alias("doc_id"), F.size("blocks").alias("blocks"), F.aggregate("blocks", F.lit(0).cast("long"), lambda s, b: s + F.length(b["text"])).alias("chars"))


def page_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of web pages and documents."""
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("body"))
    docs = docs_of(spark, sf_dir).select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return pages.unionByName(docs).select("source", "id", text.excerpt(F.col("body")).alias("excerpt"))


def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = retrieval.keyword_best(docs_of(spark, sf_dir), questions(spark, sf_dir), 10, F.lower("text"), "doc_id")
    return best.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def like_fallback_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = docs_of(spark, sf_dir).withColumn("page_no", F.lit(1))
    return retrieval.like_best(pages, questions(spark, sf_dir), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of all vectors for each whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = retrieval.dense_best(vectors, asked, 10, "embedding", "vec_id")
    return got.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def dense_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the kept index: odd vectors are its second run."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ordinal"), F.col("embedding").alias("vector"))
    longest = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    index = dense_index.DenseIndex(spark, stage_path(spark, "dense-index"))
    index.create(vectors.where("ordinal % 2 = 0"), longest)
    index.add(vectors.where("ordinal % 2 = 1"))
    asked = vectors.where("ordinal % 100 = 0").select(F.col("ordinal").alias("query_id"), F.col("vector").alias("query_vector"))
    return index.search(asked, 10).select("query_id", F.col("ordinal").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and containment routes fused."""
    pages = docs_of(spark, sf_dir).withColumn("page_no", F.lit(1))
    asked = questions(spark, sf_dir)
    one = retrieval.keyword_best(pages, asked, 20, F.lower("text"), "doc_id").select("query_id", "rank", F.col("doc_id").alias("id"))
    two = retrieval.like_best(pages, asked.withColumn("query", F.lit("")), 20).select("query_id", "rank", F.col("doc_id").alias("id"))
    return retrieval.fuse_rrf([one.withColumn("route", F.lit("keyword")), two.withColumn("route", F.lit("sparse"))], 10).select("query_id", F.col("id").alias("doc_id"), F.round("rrf", 9).alias("rrf"), "rank", "route")


def lexical_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    hits = retrieval.keyword_best(docs_of(spark, sf_dir), asked, 20, F.lower("text"), "doc_id").join(asked, "query_id")
    gated = retrieval.lexical_gate(hits, F.lit(""), ratio=0.9, lex=F.col("score"))  # the route has scored already
    return gated.select("query_id", "doc_id", "rank")


def filter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"must": [{"key": "l_quantity", "range": {"gte": 10, "lt": 25}}, {"key": "l_discount", "range": {"gt": 0.02, "lte": 0.06}}, {"key": "l_returnflag", "match": {"any": ["A", "R"]}}]}
    return filters.apply_filter(table(spark, sf_dir, "lineitem"), spec).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity").cast("double")), 2).alias("quantity"))


def filter_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"must": [{"key": "p_size", "match": {"any": [1, 7, 23]}}, {"key": "p_brand", "match": {"value": "Brand#7"}}]}
    return filters.apply_filter(table(spark, sf_dir, "part"), spec).select("p_partkey", "p_size")


def payload_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filter_range over rows that are laid out for it."""
    index = payload_index.PayloadIndex(spark, stage_path(spark, "payload-index"))
    index.write(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_returnflag"], files=32)
    spec = {"must": [{"key": "l_quantity", "range": {"gte": 10, "lt": 25}}, {"key": "l_discount", "range": {"gt": 0.02, "lte": 0.06}}, {"key": "l_returnflag", "match": {"any": ["A", "R"]}}]}
    return index.read(spec).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity").cast("double")), 2).alias("quantity"))


def payload_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filter_any over two runs laid out for it."""
    index, parts = payload_index.PayloadIndex(spark, stage_path(spark, "payload-index")), table(spark, sf_dir, "part")
    for half in (0, 1):
        index.write(parts.where(F.col("p_partkey") % 2 == half), ["p_size", "p_brand"], bloom=("p_brand",), files=8)
    return index.read({"must": [{"key": "p_size", "match": {"any": [1, 7, 23]}}, {"key": "p_brand", "match": {"value": "Brand#7"}}]}).select("p_partkey", "p_size")


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is relevant for a benchmark item if it holds the item's text; the keyword route answers and is measured by
    the evaluation's own metrics."""
    spec, none = "struct<" + ",".join(f"{f}:string" for f in evaluate.SPEC_TEXT) + ",is_mandatory:boolean,page:int>", lambda t: F.lit(None).cast(t)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    hits = _keyword(spark, sf_dir).select("query_id", "rank", F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("chunk_text"))
    empty = {"version_id": "string", "doc_name": "string", "chapter_id": "string", "clause_id": "string", "clause_no": "string", "article_no": "string", "constraint_type": "string", "excerpt": "string", "is_mandatory": "boolean"}
    hits = hits.withColumns({c: none(t) for c, t in empty.items()} | {"page_start": F.lit(1), "page_end": F.lit(1)})
    holds = hits.join(items, "query_id").where(F.contains("chunk_text", "passage"))
    wanted = F.from_json(F.to_json(F.struct("doc_id")), spec)
    samples = items.join(holds.groupBy("query_id").agg(F.collect_list(wanted).alias("relevant_any")), "query_id", "left")
    expected = {"doc_id": "string", "version_id": "string", "doc_name": "string", "pages": "array<int>", "clause_id": "string", "clause_ids": "array<string>", "is_mandatory": "boolean", "constraint_type": "string"}
    samples = samples.withColumns({f"expected_{c}": none(t) for c, t in expected.items()} | {"constraint_specs": none(f"array<{spec}>")}).drop("passage")
    got = evaluate.metrics(evaluate.per_sample(samples, hits, 10))
    rates = [F.round(c, 6).alias(c) for c in ("hit_at_5", "hit_at_10", "mrr", "evidence_hit_rate_at_10", "citation_completeness")]
    return got.select("query_count", "relevant_hits", *rates, "passed")


def eval_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "orders").select("o_orderstatus", F.pmod(F.col("o_orderkey"), F.lit(101)).cast("double").alias("score_total"))
    got = evaluate.trends(results, "o_orderstatus")
    return got.select("o_orderstatus", "count", "failed", F.round("avg_score", 6).alias("avg_score"), F.round("failure_rate", 6).alias("failure_rate"))


def registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's newest order, customers without orders included."""
    newest = registry.latest(table(spark, sf_dir, "orders"), "o_custkey", order=[F.desc("o_orderdate"), F.desc("o_orderkey")])
    joined = table(spark, sf_dir, "customer").join(newest, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "o_orderkey")


def orphan_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers left once orders of status F are gone and customers without any other order with them."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("order"), F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("id"))
    left, _ = registry.delete_version(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), orders, "F")
    return left.select(F.col("id").alias("c_custkey"))


def status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = registry.latest(table(spark, sf_dir, "events"), "user_id", order=[F.desc("ts"), F.desc("event_id")])
    return newest.select("user_id", "event_id", "event_type")


def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stream: a micro-batch replaces the state of the users it touches."""
    from citelake.streaming import status

    source = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(source).schema
    # a pattern, since a stream reads folders or patterns and the table may be one file
    stream = spark.readStream.schema(schema).parquet(f"{source[:-1]}[t]").select("user_id", "event_id", "event_type", "ts")
    base = stage_path(spark, "stream")
    keys, order = ["user_id"], ["ts", "event_id"]
    status.run_latest(stream, f"{base}/state", f"{base}/checkpoint", keys, order).awaitTermination()
    return status.read_latest(spark, f"{base}/state", stream.schema.toDDL(), keys, order).select("user_id", "event_id", "event_type")


#: A job's silence that fails it, and how late events may come, in hours.
SILENCE, LATE = 24, 1


def job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as events of versions' jobs (a signup queues, an error fails an attempt, a purchase is done), taken in by
    a stateful stream that is stopped and started again twice from one checkpoint."""
    from citelake.streaming import consumer

    names = F.create_map(*[F.lit(x) for x in ("signup", consumer.QUEUED, "error", consumer.FAILED, "purchase", consumer.DONE)])
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("version_id"), "event_id", F.coalesce(names[F.col("event_type")], "event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    base, third = stage_path(spark, "job-stream"), F.ntile(3).over(Window.orderBy(F.col("day")))
    days = events.select(F.to_date("ts").alias("day")).distinct().withColumn("part", third)  # a row a day
    parts = events.join(days, F.to_date("ts") == F.col("day")).drop("day")
    for part in (1, 2, 3):
        parts.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{base}/events")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/events")
        consumer.run(stream, f"{base}/results", f"{base}/checkpoint", SILENCE * 3_600_000, f"{LATE} hours").awaitTermination()
    return spark.read.schema(consumer.RESULT).parquet(f"{base}/results").withColumn("at", F.unix_millis("at"))


def snapshot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in two batches joined with a dictionary of their types; between the batches it changes (a name, and one type is
    left out)."""
    from citelake.streaming import snapshots

    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.to_date("ts").alias("day"))
    types, base = events.select("event_type").distinct(), stage_path(spark, "snapshot-stream")
    known = snapshots.Snapshots(spark, f"{base}/types")
    versions = (types.select("event_type", F.upper("event_type").alias("name")), types.where("event_type <> 'error'").select("event_type", F.concat("event_type", F.lit("!")).alias("name")))
    for half, version in enumerate(versions):
        known.publish(version)
        events.where((F.dayofmonth("day") > 15) == bool(half)).write.mode("append").parquet(f"{base}/events")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/events")
        snapshots.run_joined(stream, known, lambda batch, names: batch.join(names, "event_type"), f"{base}/joined").awaitTermination()
    return snapshots.results(spark, f"{base}/joined").select("event_id", "name")


def scroll_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of some sizes, scrolled by key from a payload folder."""
    path = stage_path(spark, "payload")
    table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand").write.parquet(path)
    return scroll.scrolled(spark, path, "p_partkey", {"must": [{"key": "p_size", "range": {"gte": 10, "lt": 20}}, {"key": "p_brand", "match": {"any": ["Brand#7", "Brand#12", "Brand#3"]}}]}).select("p_partkey", "p_size")


def constraint_group_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best row of each group, then the first sixteen groups of each supplier."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("score"))
    best = registry.latest(rows, "l_suppkey", "l_partkey", order=[F.desc("score"), F.col("l_orderkey"), F.col("l_linenumber")])
    return retrieval.top_k(best, 16, F.desc("score"), F.col("l_partkey"), group="l_suppkey").select("l_suppkey", "l_partkey", "l_orderkey", "rank")


def citation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands around the middle twenty characters of each turn, at their first place."""
    needle = F.substring("text", (F.length("text") / 2).cast("int") + 1, F.lit(20))
    before, after = text.window_around(F.col("text"), needle, 80)
    rows = table(spark, sf_dir, "conversations").where("text <> ''")
    return rows.select("conv_id", "turn", before.alias("context_before"), after.alias("context_after"))


def redact_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and conversations without personal data."""
    docs = docs_of(spark, sf_dir).select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), "text")
    said = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("source"), F.col("conv_id").alias("id"), "turn", "text")
    return docs.unionByName(said).select("source", "id", "turn", F.sha2(text.redact(F.col("text")), 256).alias("redacted_sha256"))


def offset_to_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are a conversation's pages; which turn holds each hundredth character?"""
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    spans = extract.page_spans(pages)
    offsets = spans.groupBy("doc_id").agg(F.max("stop").alias("_m")).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("_m", F.lit(0).cast("long")), F.lit(100).cast("long"))).alias("offset"))
    return extract.page_of_offset(offsets, spans).select(F.col("doc_id").alias("conv_id"), "offset", F.col("page_no").alias("turn"))


def names_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which names of a dictionary (customers, and the benchmark's longer words) each document holds: how many, and the first
    and last."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\s]{5,}"), F.lit(0))).alias("name"))
    names = words.unionByName(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")))
    found = filters.names_in(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question")), names)
    return found.groupBy(F.col("query_id").alias("doc_id")).agg(F.count("*").alias("n_names"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


def tables_across_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, their turns as pages with a table each: a table goes on where its first line is that of the
    table before (likeness of headers is left out here: SQL has no such measure)."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.lit("v").alias("version_id"), F.concat(F.lit("t"), "turn").alias("table_id"), (F.col("turn") + 1 + F.floor(F.col("turn") / 3)).cast("int").alias("page_no"), F.lit(1).alias("order_in_page"), F.concat(F.col("turn").cast("int").bitwiseAND(2).cast("string"), F.lit(" head\n"), F.col("role"), F.lit(" "), F.length("text").cast("string")).alias("raw_text"))
    got = normalize.merged_across_pages(turns, least_similarity=1.1)
    return got.select("doc_id", "table_id", "page_start", "page_end", "raw_text")


def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select("c_custkey", text.name_id(F.lit("person"), F.col("c_name")).alias("entity_id"))
    return names


def clause_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause ids made of order numbers, through the algebra."""
    made = F.concat_ws(".", (F.col("o_orderkey") % 40 + 1).cast("string"), (F.col("o_custkey") % 30).cast("string"), (F.col("o_orderkey") % 7).cast("string"))
    node = F.when(F.col("o_orderkey") % 3 == 0, F.concat(made, F.lit("("), F.col("o_orderkey") % 5, F.lit(")"))).otherwise(made)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", node.alias("node"))
    return rows.select("o_orderkey", clauses.parent(F.col("node")).alias("parent"), clauses.level(F.col("node")).cast("long").alias("level"), clauses.root(F.col("node")).alias("root"), F.array_join(clauses.article_path(F.col("node")), ">").alias("path"))


def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by packed sentences (260 to 520 characters, 80 of overlap)."""
    pieces = text.packed_sentences(F.col("text"), 520, 80)
    return docs_of(spark, sf_dir).select("doc_id", F.posexplode(pieces).alias("chunk_no", "chunk_text"))


def ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through the whole ingest: pages, blocks, chapters, chunks, gate, index rows."""
    return hybrid.ingest_texts(table(spark, sf_dir, "documents")).select("id", "doc_id", "chunk_id", "page_start", "page_end", "chunk_text", "clause_id", "constraint_type")


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages asked of all documents by the dense (hash vectors), keyword and full-text routes (containment for
    Chinese ones without full-text hits); ten citations each, and explanation siblings where rows bear clauses."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("chunk_text"), F.col("doc_id").alias("ordinal"))
    return hybrid.cited(hybrid.plain_rows(rows), asked, 10).select("query_id", "rank", "doc_id", "excerpt", "route")


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("v1").alias("version_id"), "text")
    got = source_pages.text_to_pages(docs)
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), "page_no", F.size("blocks").alias("blocks"))


def cited_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid hits as de-duplicated citations."""
    hits = hybrid_search(spark, sf_dir)
    rows = hits.withColumns({"question": F.lit(""), **{c: F.lit(None).cast(t) for c, t in {"doc_name": "string", "page_start": "int", "page_end": "int", "chunk_text": "string", "source_type": "string", "page_type": "string", "table_id": "string", "row_index": "int", "clause_id": "string", "table_repr": "string"}.items()}})
    return evidence.dedupe_citations(rows.withColumn("rank", F.col("rank").cast("int"))).select("query_id", "rank", "doc_id", "excerpt", "merged_count")


def fts_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold all of an item's words (four characters or more), by the inverted index."""
    pages = docs_of(spark, sf_dir).withColumn("page_no", F.lit(1))
    asked = questions(spark, sf_dir).select("query_id", "terms")
    return retrieval.fts_search(retrieval.inverted_index(pages), asked, 1_000_000_000).select("query_id", "doc_id")


def fts_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of these by cover density, by one reading of the documents."""
    pages = docs_of(spark, sf_dir).withColumn("page_no", F.lit(1))
    asked = questions(spark, sf_dir).select("query_id", F.array_join("terms", " ").alias("query"))
    return retrieval.fts_best(pages, asked, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _fts_index(spark: SparkSession, sf_dir: str) -> fulltext.FullTextIndex:
    """Documents in two batches; the second replaces some pages of the first, which held other texts there."""
    docs = docs_of(spark, sf_dir).withColumn("page_no", F.lit(1))
    index = fulltext.FullTextIndex(spark, stage_path(spark, "full-text-index"))
    index.add(docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.reverse("text")).otherwise(F.col("text"))).where("doc_id % 2 = 0"))
    index.add(docs.where("doc_id % 2 = 1 or doc_id % 3 = 0"))
    return index


def _word_questions(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    """The first distinct words of each item, each in quotation marks (so that none is taken for an operator)."""
    words = F.slice(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}\p{Nd}_]+"), F.lit(0))), 1, most)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " ").alias("query"))


def fts_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole items asked of the kept index: the ten best documents that hold all their words."""
    hits = _fts_index(spark, sf_dir).search(_word_questions(spark, sf_dir, 100_000), 10)
    return hits.select("query_id", F.col("doc_id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def fts_index_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words of each item, which many documents hold, asked of the kept index: the five best."""
    hits = _fts_index(spark, sf_dir).search(_word_questions(spark, sf_dir, 2), 5)
    return hits.select("query_id", F.col("doc_id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def sidecar_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = docs_of(spark, sf_dir).withColumn("page_no", F.lit(1))
    asked = questions(spark, sf_dir).select("query_id", "query", F.col("terms").alias("tokens"))
    return retrieval.sidecar_search(pages, asked, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def sidecar_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of each turn around its middle twenty characters."""
    rows = table(spark, sf_dir, "conversations").where("text <> ''")
    middle = F.substring("text", (F.length("text") / 2).cast("int") + 1, F.lit(20))
    return rows.select("conv_id", "turn", text.excerpt_at(F.col("text"), middle, 90).alias("excerpt"))


def reranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits in the order of a rerank service's answer, made here: best are the smallest ids of even ranks; odd ranks
    are not answered for and come behind."""
    hits = retrieval.keyword_best(docs_of(spark, sf_dir), questions(spark, sf_dir), 10, F.lower("text"), "doc_id").select("query_id", "doc_id", "rank")
    said = F.to_json(F.struct(F.collect_list(F.when(F.col("rank") % 2 == 0, F.struct((F.col("rank") - 1).alias("index"), (-F.col("doc_id")).cast("double").alias("relevance_score")))).alias("results")))
    return retrieval.with_ranking(hits, hits.groupBy("query_id").agg(said.alias("answer")))


def explanation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as clauses (odd suppliers) and explanations (even ones) of their parts: the three dearest of an order, each
    with the first row of the other kind of its part."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.format_string("%010d-%02d-%d-%d", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("chunk_id"), F.col("l_partkey").cast("string").alias("clause_id"), F.when(F.col("l_suppkey") % 2 == 1, "clause").otherwise("explanation").alias("doc_type"), F.col("l_extendedprice").cast("double").alias("price"))
    hits = retrieval.top_k(rows, 3, F.desc("price"), F.col("chunk_id")).drop("price")
    return retrieval.pair_explanations(hits, rows.drop("query_id", "price")).select("query_id", "chunk_id", "rank")


def entity_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers (kinds by their nation, some odd ones) against a dictionary that holds every other one with ids of
    its own."""
    kind = F.element_at(F.array(F.lit(" Person "), F.lit("project"), F.lit("")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    names = table(spark, sf_dir, "customer").select(kind.alias("kind"), F.concat(F.lit(" "), "c_name").alias("name"), "c_custkey")
    known = stores.entities(names.where("c_custkey % 2 = 0")).withColumn("id", F.concat(F.lit("old_"), "entity_name"))
    added, ids = stores.get_or_create(known, names)
    return ids.join(added.select("entity_kind", "entity_name", F.lit(True).alias("added")), ["entity_kind", "entity_name"], "left").withColumn("added", F.coalesce("added", F.lit(False)))


def result_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of runs (an order each, its line items the samples) as rows of the result table."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_linenumber").cast("string").alias("sample_id"), F.col("l_quantity").cast("double").alias("score_total"), F.when(F.col("l_partkey") % 2 == 0, "openai").alias("provider"))
    return stores.result_rows(rows).select("id", "run_id", "sample_id", "provider", "model", "score_total")


def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four score formulas, on metrics made of line items."""
    share = lambda c, n: (F.col(c).cast("long") % n) / float(n)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", share("l_partkey", 10).alias("a"), share("l_suppkey", 7).alias("b"), share("l_orderkey", 9).alias("c"), (F.col("l_linenumber") * 3).cast("double").alias("d"))
    x = [F.col(c) for c in "abcd"]
    return rows.select("l_orderkey", "l_linenumber", F.round(evaluate.score_ie(x[0], x[1], x[2], x[0], x[3], x[3]), 6).alias("ie"), F.round(evaluate.score_table(*x), 6).alias("tab"), F.round(evaluate.score_qa(*x), 6).alias("qa"), F.round(evaluate.score_retrieval(*x), 6).alias("retr"), evaluate.amount_close(x[0], x[1], 0.05).alias("close"))


def key_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tenth order replaced and as many new ones added."""
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    tenth = base.where("o_orderkey % 10 = 0")
    new = tenth.select("o_orderkey", F.lit("X").alias("o_orderstatus")).unionByName(tenth.select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit("N").alias("o_orderstatus")))
    return registry.upsert(base, new, "o_orderkey")


def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in four batches, kept as runs: all of them; each tenth replaced and as many new ones; each fifteenth deleted;
    each thirtieth written again."""
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    store = merge_store.MergeStore(spark, stage_path(spark, "orders-store"), "o_orderkey long, o_custkey long, o_orderstatus string", ("o_orderkey",), 8)
    tenth = base.where("o_orderkey % 10 = 0")
    store.upsert(base)
    store.upsert(tenth.withColumn("o_orderstatus", F.lit("X")).unionByName(tenth.select((-F.col("o_orderkey") - 1).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"))))
    store.delete(base.where("o_orderkey % 15 = 0"))
    store.upsert(base.where("o_orderkey % 30 = 0").withColumn("o_orderstatus", F.lit("again")))
    return store.read()


def question_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions made of orders, compiled to filters: the voltage bound and the clause."""
    kv, op = (F.col("o_orderkey") % 900 + 10).cast("string"), F.element_at(F.array(F.lit("不低于"), F.lit("不超过"), F.lit("高于"), F.lit("低于"), F.lit("电压为")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    clause = F.concat_ws(".", (F.col("o_custkey") % 30 + 1).cast("string"), (F.col("o_orderkey") % 8).cast("string"))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.concat(op, kv, F.lit("kV的设备按第"), clause, F.lit("条执行")).alias("question"))
    parsed = filters.parse_questions(asked)
    volt, named = F.element_at("must", 1), F.element_at("must", 2)
    return parsed.select("query_id", volt["gte"].alias("gte"), volt["lte"].alias("lte"), volt["gt"].alias("gt"), volt["lt"].alias("lt"), named["key"].alias("key"), F.element_at(named["any_of"], 1).alias("clause"))


def table_row_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables made of orders: a header and a row a line item."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.col("l_partkey").cast("string")))), "\n").alias("body"))
    made = lines.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit("v").alias("version_id"), F.lit("t1").alias("table_id"), F.lit(1).alias("page_no"), F.lit(1).alias("page_start"), F.when(F.col("l_orderkey") % 2 == 0, 2).otherwise(1).alias("page_end"), F.concat(F.lit("no|part\n"), "body").alias("raw_text"))
    return tables.row_chunks(made).select(F.col("doc_id").cast("long").alias("l_orderkey"), "chunk_id", "text", "source_type", "row_index")


def stable_hit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).select("doc_id", text.stable_hit_id(F.lit("sparse"), F.col("doc_id").cast("string"), F.lit(1), F.col("text")).alias("hit_id"))


def low_quality_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades and counts made of orders."""
    o = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(o.alias("doc_id"), o.alias("version_id"), F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("c"), F.lit("D")), (o % 4 + 1).cast("int")).alias("grade"), (F.col("o_custkey") % 50).alias("score"), (o % 400).alias("text_len"), (o % 9).alias("chunks"), (F.col("o_custkey") % 6).alias("dropped_short"))
    return quality.low_quality(rows).select("doc_id")


def eval_dataset_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with the truth written last (its newest order's status)."""
    truths = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderstatus").alias("answer"), F.col("o_orderkey").alias("ordinal"))
    return evaluate.dataset_rows(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id")), truths)


def scored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval runs scored by their task's formula, as reports would hold them."""
    metrics = F.create_map(F.lit("hit5"), (F.col("o_orderkey") % 2).cast("double"), F.lit("hit10"), F.lit(1.0), F.lit("mrr"), (F.col("o_custkey") % 10) / 10.0, F.lit("latency_score"), F.lit(0.5))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.lit("RETR").alias("task_type"), metrics.alias("metrics"))
    return jobs.scored(rows).select("sample_id", F.round("score_total", 6).alias("score_total"))


def executed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over the benchmark: an item asks for itself, and the stored answer is the text of its best keyword hit."""
    items, asked = table(spark, sf_dir, "benchmark"), questions(spark, sf_dir)
    docs = docs_of(spark, sf_dir)
    best = retrieval.keyword_best(docs, asked, 1, F.lower("text"), "doc_id").join(docs, "doc_id")
    answers = best.select(F.col("query_id").alias("sample_id"), F.col("text").alias("pred"), F.lit("stored").alias("provider"), F.lit("keyword").alias("model"))
    samples = items.select(F.col("item_id").alias("sample_id"), F.lit("qa").alias("task_type"), F.col("text").alias("question"), F.col("text").alias("answer"))
    got = jobs.executed(samples, answers)
    return got.select("sample_id", "task_type", "provider", F.round("score_total", 6).alias("score_total"), F.col("breakdown.exact_hit").alias("exact_hit"), F.get_json_object("diff_json", "$.diff.qa.match").alias("matched"), F.length(F.get_json_object("pred_json", "$.pred")).alias("pred_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        doc_dedupe_sha256, quality_grade, readable_ratio, noisy_chunk, chunk_gate_stats, repeat_line_denoise, denoised_blocks, page_excerpt, keyword_topk, like_fallback_rank, dense_topk, dense_index_topk, rrf_fusion, lexical_gate, filter_range, filter_any, payload_range, payload_any,
        retrieval_metrics, eval_trends, registry_latest, orphan_anti_join, status_latest, stream_status, job_results, snapshot_events, scroll_parts, constraint_group_best, citation_context, redact_prompt, offset_to_page, entity_ids, names_in_documents, tables_across_pages, clause_algebra, sentence_chunks, ingest_chunks, hybrid_search, text_pages, cited_answers, fts_match, fts_rank, fts_index_topk, fts_index_pairs, sidecar_topk, sidecar_excerpts, reranked_hits, explanation_pairs, entity_dictionary, result_appends, eval_scores, key_upsert, merge_upsert, question_bounds, table_row_chunks, stable_hit_ids, low_quality_versions, eval_dataset_join, scored_runs, executed_run,
    )
}

READABLE_SQL = r"regexp_replace(text, '[\p{L}\p{N}，。！？；：、（）()\[\]【】《》“”‘’+\-*/%=._:;,\"'' \n\t]', '', 'g')"
NOISY_SQL = rf"""(trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' OR contains(lower(text), '%pdf-') OR contains(lower(text), 'endstream') OR contains(lower(text), 'obj<</filter/flatedecode')
  OR (length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) >= 120 AND 1 - length({READABLE_SQL}) / length(text) < 0.5))"""
LATEST_STATUS_SQL = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"
LIKE_SQL = f"""{QUESTIONS_SQL},
d AS (SELECT doc_id, lower(regexp_replace(text, '\\s+', '', 'g')) AS body FROM documents),
l AS (SELECT query_id, doc_id, list_sum(list_transform(terms, lambda t: CASE WHEN contains(body, t) THEN round(1 + least(length(t), 8) / 8.0, 3) ELSE 0.0 END)) AS part, lower(regexp_replace(query, '\\s+', '', 'g')) AS phrase, body FROM d, q WHERE len(terms) > 0)"""

GATE_SQL = rf"""
WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS o FROM documents),
f AS (SELECT doc_id, o, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM c),
j AS (SELECT doc_id, o, regexp_replace(lower(flat), '[^\p{{L}}\p{{M}}\p{{Nd}}]', '', 'g') AS sig, {NOISY_SQL} AS noise,
        length(flat) < 100 AND NOT regexp_matches(flat, '\b\d+\.\d+(?:\.\d+)?\b') AND NOT regexp_matches(flat, '(?i)\d+\s*(?:kV|千伏|MVA|万元|万|亿)')
        AND NOT regexp_matches(flat, '(^|[^0-9])[0-9]{{1,2}}(\.[0-9]+){{1,4}}(\([0-9A-Za-z]+\))?([^0-9]|$)') AS short FROM f),
m AS (SELECT *, min(CASE WHEN NOT noise AND NOT short THEN o END) OVER (PARTITION BY doc_id, sig) AS first FROM j),
g AS (SELECT *, CASE WHEN first < o THEN 'dup' WHEN noise THEN 'noise' WHEN short THEN 'short' ELSE 'keep' END AS gate FROM m),
k AS (SELECT *, count(*) FILTER (WHERE gate = 'keep') OVER (PARTITION BY doc_id) AS kept FROM g),
e AS (SELECT doc_id, CASE WHEN kept = 0 AND o <= 8 THEN 'keep' ELSE gate END AS gate FROM k)
SELECT doc_id, count(*) FILTER (WHERE gate = 'keep') AS kept, count(*) FILTER (WHERE gate = 'dup') AS dropped_dup, count(*) FILTER (WHERE gate = 'noise') AS dropped_noise, count(*) FILTER (WHERE gate = 'short') AS dropped_short FROM e GROUP BY doc_id
"""

DENSE_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.e, b.e) AS score FROM v a, v b WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(score, 6) AS score, rank::int AS rank FROM r WHERE rank <= 10"""
WORDS_SQL = r"q AS (SELECT item_id AS query_id, list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, {most}) AS terms FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{Nd}}_]+') AS w FROM benchmark))"


def _fts_rank_sql(questions: str, k: int, order: str) -> str:
    """Cover density of all documents that hold all terms, and the k best of each question."""
    return rf"""
        WITH {questions}, d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{Nd}}_]+') AS w FROM documents),
        m AS (SELECT query_id, doc_id, terms, w FROM q JOIN d ON len(terms) > 0 AND list_has_all(w, terms)),
        e AS (SELECT * FROM (SELECT query_id, doc_id, terms, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM m) WHERE list_contains(terms, word)),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY pos) AS n FROM e),
        t AS (SELECT query_id, doc_id, pos, n, unnest(terms) AS term, word FROM o),
        l AS (SELECT query_id, doc_id, pos, n, max(CASE WHEN term = word THEN pos END) OVER (PARTITION BY query_id, doc_id, term ORDER BY pos) AS last FROM t),
        c AS (SELECT query_id, doc_id, pos, n, CASE WHEN count(last) = count(*) THEN min(last) END AS start FROM l GROUP BY 1, 2, 3, 4),
        v AS (SELECT *, lag(start) OVER (PARTITION BY query_id, doc_id ORDER BY pos) AS before FROM c),
        x AS (SELECT v.query_id, v.doc_id, (v.pos - v.start) - (v.n - s.n) AS noise FROM v JOIN c s ON s.query_id = v.query_id AND s.doc_id = v.doc_id AND s.pos = v.start WHERE v.start IS NOT NULL AND (before IS NULL OR v.start > before)),
        r AS (SELECT query_id, doc_id, sum(0.1::double / (1 + noise)) AS score FROM x GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {order}) AS rank FROM r)
        SELECT query_id, doc_id, round(score, 6) AS score, rank::int AS rank FROM k WHERE rank <= {k}"""


ORACLE = {
    "doc_dedupe_sha256": "SELECT d.doc_id, sha256(text) AS content_hash, coalesce(e.id, -1) AS existing_version_id FROM documents d LEFT JOIN (SELECT sha256(text) AS h, min(doc_id) AS id FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) e ON e.h = sha256(text) WHERE doc_id % 2 = 1",
    "quality_grade": """
        WITH b AS (SELECT doc_id, count(*) FILTER (WHERE trim(l) <> '') AS block_count, coalesce(sum(length(trim(l))), 0)::bigint AS text_len FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id)
        SELECT doc_id, block_count, text_len, least(100, text_len // 40 + 4 * block_count)::bigint AS score,
               CASE WHEN least(100, text_len // 40 + 4 * block_count) >= 75 THEN 'A' WHEN least(100, text_len // 40 + 4 * block_count) >= 45 THEN 'B' ELSE 'C' END AS grade FROM b""",
    "readable_ratio": f"SELECT doc_id, CASE WHEN length(text) = 0 THEN 0.0 ELSE round(1 - length({READABLE_SQL}) / length(text), 6) END AS ratio FROM documents",
    "noisy_chunk": f"SELECT doc_id, {NOISY_SQL} AS noisy FROM documents",
    "chunk_gate_stats": GATE_SQL,
    "repeat_line_denoise": r"""
        WITH l AS (SELECT source, doc_id, trim(unnest(regexp_split_to_array(text, '\r\n|[\n\r]')), ' ' || chr(9)) AS line FROM documents), k AS (SELECT * FROM l WHERE line <> '' AND NOT regexp_matches(line, '(?i)licen[sc]e')),
        p AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1), c AS (SELECT source, line, count(*) AS n FROM k WHERE length(line) <= 50 GROUP BY 1, 2),
        d AS (SELECT c.source, line FROM c JOIN p ON p.source = c.source WHERE n >= greatest(1, floor(pages * 0.2)))
        SELECT doc_id, count(*) AS kept, sum(length(k.line))::bigint AS kept_chars FROM k LEFT JOIN d ON d.source = k.source AND d.line = k.line WHERE d.line IS NULL GROUP BY 1""",
    "page_excerpt": r"""SELECT source, id, left(trim(regexp_replace(regexp_replace(regexp_replace(body, '(?i)table\s+images/\S+', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 200) AS excerpt
        FROM (SELECT 'pages' AS source, page_id AS id, html AS body FROM pages UNION ALL SELECT 'documents', doc_id, text FROM documents)""",
    "keyword_topk": f"WITH {SCORED_SQL}, r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, round(score, 6) AS score, rank::int AS rank FROM r WHERE rank <= 10",
    "like_fallback_rank": f"""WITH {LIKE_SQL},
        s AS (SELECT query_id, doc_id, part + CASE WHEN length(phrase) BETWEEN 1 AND 40 AND contains(body, phrase) THEN 6.0 ELSE 0.0 END AS score FROM l),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0) SELECT query_id, doc_id, round(score, 6)::double AS score, rank::int AS rank FROM r WHERE rank <= 10""",
    "dense_topk": DENSE_SQL,
    "dense_index_topk": DENSE_SQL,
    "rrf_fusion": f"""WITH {SCORED_SQL},
        a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s),
        {LIKE_SQL.split("FROM benchmark),", 1)[-1].strip()},
        b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(part, 9) DESC, doc_id) AS rank FROM l WHERE part > 0),
        u AS (SELECT query_id, doc_id, rank, 0 AS o FROM a WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank, 1 FROM b WHERE rank <= 20),
        f AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS rrf, min(o * 1000 + rank) AS seen FROM u GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, seen) AS rank FROM f)
        SELECT query_id, doc_id, round(rrf, 9)::double AS rrf, rank::int AS rank, CASE WHEN seen < 1000 THEN 'keyword' ELSE 'sparse' END AS route FROM r WHERE rank <= 10""",
    "lexical_gate": f"""WITH {SCORED_SQL}, r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s),
        t20 AS (SELECT * FROM r WHERE rank <= 20), g AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM t20)
        SELECT query_id, doc_id, rank::int AS rank FROM g WHERE score >= greatest(0.3, 0.9 * top)""",
    "filter_range": "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity::double), 2) AS quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 25 AND l_discount > 0.02 AND l_discount <= 0.06 AND l_returnflag IN ('A', 'R') GROUP BY 1",
    "filter_any": "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 7, 23) AND p_brand = 'Brand#7'",
    "payload_range": "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity::double), 2) AS quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 25 AND l_discount > 0.02 AND l_discount <= 0.06 AND l_returnflag IN ('A', 'R') GROUP BY 1",
    "payload_any": "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 7, 23) AND p_brand = 'Brand#7'",
    "retrieval_metrics": f"""WITH {SCORED_SQL}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s),
        h AS (SELECT b.item_id, min(r.rank) FILTER (WHERE contains(d.text, b.text)) AS rank, count(*) FILTER (WHERE contains(d.text, b.text)) AS n FROM benchmark b LEFT JOIN (SELECT * FROM r WHERE rank <= 10) r ON r.query_id = b.item_id LEFT JOIN documents d ON d.doc_id = r.doc_id GROUP BY 1),
        m AS (SELECT count(*) AS query_count, sum(n)::bigint AS relevant_hits, count(*) FILTER (WHERE rank <= 5) / count(*) AS at5, count(*) FILTER (WHERE rank <= 10) / count(*) AS at10, coalesce(sum(1.0 / rank), 0)::double / count(*) AS mrr FROM h)
        SELECT query_count, relevant_hits, round(at5, 6) AS hit_at_5, round(at10, 6) AS hit_at_10, round(mrr, 6) AS mrr, round(at10, 6) AS evidence_hit_rate_at_10, CASE WHEN relevant_hits > 0 THEN 1.0 ELSE 0.0 END::double AS citation_completeness,
               query_count >= 30 AND at10 >= 0.75 AND mrr >= 0.45 AND at10 >= 0.8 AS passed FROM m""",
    "eval_trends": """
        SELECT o_orderstatus, count(*) AS count, count(*) FILTER (WHERE o_orderkey % 101 < 60) AS failed, round(avg((o_orderkey % 101)::double), 6) AS avg_score, round(count(*) FILTER (WHERE o_orderkey % 101 < 60) / count(*), 6) AS failure_rate
        FROM orders GROUP BY 1""",
    "registry_latest": """
        WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
        SELECT c_custkey, o_orderkey FROM customer LEFT JOIN n ON o_custkey = c_custkey AND n = 1""",
    "orphan_anti_join": """
        SELECT c_custkey FROM customer c WHERE NOT (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F'))""",
    "status_latest": LATEST_STATUS_SQL,
    "stream_status": LATEST_STATUS_SQL,
    "constraint_group_best": """
        WITH b AS (SELECT l_suppkey, l_partkey, l_orderkey, l_extendedprice::double AS score, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_extendedprice::double DESC, l_orderkey, l_linenumber) AS n FROM lineitem),
        r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, l_partkey) AS rank FROM b WHERE n = 1) SELECT l_suppkey, l_partkey, l_orderkey, rank::int AS rank FROM r WHERE rank <= 16""",
    "citation_context": """
        WITH c AS (SELECT conv_id, turn, text, substr(text, length(text) // 2 + 1, 20) AS x, strpos(text, substr(text, length(text) // 2 + 1, 20)) AS p FROM conversations WHERE text <> '')
        SELECT conv_id, turn, substr(text, greatest(p - 80, 1)::bigint, (p - greatest(p - 80, 1))::bigint) AS context_before, substr(text, (p + length(x))::bigint, 80) AS context_after FROM c""",
    "redact_prompt": r"""
        WITH a AS (SELECT 'documents' AS source, doc_id AS id, 0::bigint AS turn, text FROM documents UNION ALL SELECT 'conversations', conv_id, turn, text FROM conversations),
        p AS (SELECT source, id, turn, regexp_replace(regexp_replace(text, '(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])', '\1[PHONE]\2', 'g'), '(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])', '\1[PHONE]\2', 'g') AS t FROM a),
        e AS (SELECT source, id, turn, regexp_replace(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g') AS t FROM p)
        SELECT source, id, turn, sha256(regexp_replace(regexp_replace(t, '(^|[^\p{L}\p{N}_])[0-9]{17}[0-9Xx]($|[^\p{L}\p{N}_])', '\1[IDCARD]\2', 'g'), '(^|[^\p{L}\p{N}_])[0-9]{17}[0-9Xx]($|[^\p{L}\p{N}_])', '\1[IDCARD]\2', 'g')) AS redacted_sha256 FROM e""",
    "offset_to_page": """
        WITH p AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations),
        s AS (SELECT conv_id, turn, (e - n - 1)::bigint AS start, (e - 1)::bigint AS stop FROM p), m AS (SELECT conv_id, max(stop) AS m FROM s GROUP BY 1), o AS (SELECT conv_id, unnest(range(0, m + 1, 100)) AS offset FROM m)
        SELECT o.conv_id, o.offset, min(s.turn) AS turn FROM o JOIN s ON s.conv_id = o.conv_id AND o.offset BETWEEN s.start AND s.stop GROUP BY 1, 2""",
    "clause_algebra": """
        WITH n AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS sub, concat_ws('.', o_orderkey % 40 + 1, o_custkey % 30, o_orderkey % 7) AS m, o_orderkey % 5 AS s, o_orderkey % 40 + 1 AS a, o_custkey % 30 AS b, o_orderkey % 7 AS c FROM orders)
        SELECT o_orderkey, CASE WHEN sub THEN m ELSE a || '.' || b END AS parent, CASE WHEN sub THEN 4 ELSE 3 END::bigint AS level, a || '.' || b AS root, a || '>' || a || '.' || b || '>' || m AS path FROM n""",
    "entity_ids": r"SELECT c_custkey, 'person_' || substr(h, 1, 12) || '5' || substr(h, 14, 3) AS entity_id FROM (SELECT c_custkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('person:' || c_name)) AS h FROM customer)",
    "text_pages": """
        WITH l AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r]')) AS x FROM documents) WHERE trim(x, ' ' || chr(9) || chr(160)) <> '' GROUP BY 1),
        p AS (SELECT doc_id, n, unnest(range(0, n, 120)) AS s FROM l) SELECT doc_id, (s // 120 + 1)::int AS page_no, least(120, n - s)::int AS blocks FROM p""",
    "fts_match": rf"""
        WITH {QUESTIONS_SQL}, d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{Nd}}_]+') AS w FROM documents)
        SELECT query_id, doc_id FROM q JOIN d ON len(terms) > 0 AND list_has_all(w, terms)""",
    "fts_rank": _fts_rank_sql(QUESTIONS_SQL, 10, "doc_id"),
    "fts_index_topk": _fts_rank_sql(WORDS_SQL.format(most=100_000), 10, "doc_id::varchar"),
    "fts_index_pairs": _fts_rank_sql(WORDS_SQL.format(most=2), 5, "doc_id::varchar"),
    "sidecar_topk": rf"""
        WITH {QUESTIONS_SQL}, d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS b, lower(regexp_replace(text, '\s+', '', 'g')) AS c FROM documents),
        p AS (SELECT query_id, terms AS t, lower(trim(regexp_replace(query, '\s+', ' ', 'g'))) AS one, lower(regexp_replace(query, '\s+', '', 'g')) AS two FROM q),
        s AS (SELECT query_id, doc_id, CASE WHEN one <> '' AND contains(b, one) THEN 20.0 ELSE 0 END + CASE WHEN two <> '' AND contains(c, two) THEN 28.0 ELSE 0 END
              + coalesce(list_sum(list_transform(t, lambda x: ((length(b) - length(replace(b, x, ''))) / length(x) + (length(c) - length(replace(c, x, ''))) / length(x)) * (1 + least(length(x), 10) / 10.0))), 0) AS score FROM p, d),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0) SELECT query_id, doc_id, round(score, 6)::double AS score, rank::int AS rank FROM r WHERE rank <= 10""",
    "sidecar_excerpts": r"""
        WITH c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(text, '([A-Za-z0-9])\s+([A-Za-z0-9])', '\1\2', 'g'), '([A-Za-z0-9])\s+([A-Za-z0-9])', '\1\2', 'g'), '\s+', ' ', 'g')) AS body,
          trim(regexp_replace(regexp_replace(regexp_replace(substr(text, length(text) // 2 + 1, 20), '([A-Za-z0-9])\s+([A-Za-z0-9])', '\1\2', 'g'), '([A-Za-z0-9])\s+([A-Za-z0-9])', '\1\2', 'g'), '\s+', ' ', 'g')) AS x FROM conversations WHERE text <> ''),
        p AS (SELECT *, CASE WHEN x <> '' THEN strpos(lower(body), lower(x)) ELSE 0 END AS pos FROM c)
        SELECT conv_id, turn, substr(body, greatest(pos - 30, 1)::bigint, 90) AS excerpt FROM p""",
    "reranked_hits": f"""WITH {SCORED_SQL}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
        SELECT query_id, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank % 2, CASE WHEN rank % 2 = 0 THEN doc_id ELSE rank END))::int AS rank FROM r WHERE rank <= 10""",
    "explanation_pairs": """
        WITH l AS (SELECT l_orderkey AS q, printf('%010d-%02d-%d-%d', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS c, l_partkey AS k, l_suppkey % 2 = 1 AS clause, l_extendedprice::double AS price FROM lineitem),
        h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY price DESC, c) AS rank FROM l) WHERE rank <= 3),
        f AS (SELECT k, clause, min(c) AS c FROM l GROUP BY 1, 2),
        a AS (SELECT h.q, f.c, f.clause, min(h.rank) AS rank FROM h JOIN f ON f.k = h.k AND f.clause <> h.clause WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.q = h.q AND o.c = f.c) GROUP BY 1, 2, 3),
        u AS (SELECT q, c, clause, 0 AS added, rank FROM h UNION ALL SELECT q, c, clause, 1, rank FROM a)
        SELECT q AS query_id, c AS chunk_id, (row_number() OVER (PARTITION BY q ORDER BY NOT clause, added, rank, c))::int AS rank FROM u""",
    "entity_dictionary": r"""
        WITH n AS (SELECT DISTINCT CASE c_nationkey % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'project' ELSE 'unknown' END AS entity_kind, trim(c_name) AS entity_name, c_custkey % 2 = 0 AS known FROM customer),
        h AS (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(entity_kind || ':' || entity_name)) AS h FROM n)
        SELECT entity_kind, entity_name, CASE WHEN known THEN 'old_' || entity_name ELSE entity_kind || '_' || substr(h, 1, 12) || '5' || substr(h, 14, 3) END AS id, NOT known AS added FROM h""",
    "result_appends": r"""
        WITH r AS (SELECT l_orderkey::varchar AS run_id, l_linenumber::varchar AS sample_id, CASE WHEN l_partkey % 2 = 0 THEN 'openai' ELSE 'stub' END AS provider, l_quantity::double AS score_total FROM lineitem)
        SELECT 'res_' || substr(sha256(concat_ws(chr(31), run_id, sample_id, provider, 'stub-mvp', score_total::varchar, '{}', '', '')), 1, 12) AS id, run_id, sample_id, provider, 'stub-mvp' AS model, score_total FROM r""",
    "sentence_chunks": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^[\s\p{Z}\x0B\x{85}]+|[\s\p{Z}\x0B\x{85}]+$', '', 'g') AS t FROM documents),
        s AS (SELECT doc_id, t, list_filter(list_transform(regexp_extract_all(t, '[^。！？；;!?\n]*[。！？；;!?\n]|[^。！？；;!?\n]+'), lambda x: regexp_replace(x, '^[\s\p{Z}\x0B\x{85}]+|[\s\p{Z}\x0B\x{85}]+$', '', 'g')), lambda x: x <> '') AS ss FROM d WHERE t <> ''),
        r AS (
          SELECT doc_id, ss, 1 AS i, 0 AS no, ss[1] AS open FROM s WHERE length(t) > 520
          UNION ALL SELECT doc_id, ss, i + 1, no + CASE WHEN length(open) + length(ss[i + 1]) <= 520 THEN 0 ELSE 1 END,
            CASE WHEN length(open) + length(ss[i + 1]) <= 520 THEN open ELSE right(open, 80) END || ss[i + 1] FROM r WHERE i < len(ss))
        SELECT doc_id, no::int AS chunk_no, arg_max(open, i) AS chunk_text FROM r GROUP BY doc_id, no UNION ALL SELECT doc_id, 0, t FROM s WHERE length(t) <= 520""",
    "eval_scores": """
        WITH m AS (SELECT l_orderkey, l_linenumber, (l_partkey % 10) / 10.0::double AS a, (l_suppkey % 7) / 7.0::double AS b, (l_orderkey % 9) / 9.0::double AS c, (l_linenumber * 3)::double AS d FROM lineitem)
        SELECT l_orderkey, l_linenumber, round(greatest(0, least(100, 40 * a + 20 * b + 20 * c + 10 * a)), 6)::double AS ie, round(greatest(0, least(100, 25 * a + 25 * b + 35 * c + 15 * d)), 6)::double AS tab,
               round(greatest(0, least(100, 20 * a + 30 * b + 30 * c + 20 * d)), 6)::double AS qa, round(greatest(0, least(100, 40 * a + 30 * b + 20 * c + 10 * d)), 6)::double AS retr, CASE WHEN b = 0 THEN a = 0 ELSE abs(a - b) <= abs(b) * 0.05 END AS close FROM m""",
    "job_results": f"""
        WITH e AS (SELECT user_id, event_type AS kind, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        s AS (SELECT user_id, min(n) AS first FROM e WHERE kind = 'signup' GROUP BY 1),
        a AS (SELECT e.user_id, kind, t, n, n = first AS starts, lag(t) OVER w AS before, count(*) FILTER (WHERE kind = 'error') OVER w AS failures FROM e JOIN s ON s.user_id = e.user_id AND n >= first WINDOW w AS (PARTITION BY e.user_id ORDER BY n)),
        o AS (SELECT *, t > before + {SILENCE} * 3600000 AS late FROM a),
        f AS (SELECT * FROM o WHERE NOT starts AND (late OR kind = 'purchase' OR (kind = 'error' AND failures = 3)) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n) = 1),
        l AS (SELECT user_id, max(t) AS t, max(failures) AS failures FROM o GROUP BY 1)
        SELECT user_id::varchar AS version_id, CASE WHEN NOT late AND kind = 'purchase' THEN 'processed' ELSE 'failed' END AS status, CASE WHEN late THEN 'timeout' WHEN kind = 'purchase' THEN '' ELSE 'attempts' END AS reason,
               (CASE WHEN late AND kind = 'error' THEN failures - 1 WHEN NOT late AND kind = 'purchase' THEN failures + 1 ELSE failures END)::int AS attempts, CASE WHEN late THEN before + {SILENCE} * 3600000 ELSE t END AS at FROM f
        UNION ALL SELECT user_id::varchar, 'failed', 'timeout', failures::int, t + {SILENCE} * 3600000 FROM l
        WHERE user_id NOT IN (SELECT user_id FROM f) AND t + {SILENCE} * 3600000 < (SELECT max(epoch_us(ts) // 1000) FROM events) - {LATE} * 3600000""",
    "snapshot_events": "SELECT event_id, CASE WHEN day(ts) > 15 THEN event_type || '!' ELSE upper(event_type) END AS name FROM events WHERE day(ts) <= 15 OR event_type <> 'error'",
    "scroll_parts": "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20 AND p_brand IN ('Brand#7', 'Brand#12', 'Brand#3')",
    "denoised_blocks": r"""
        WITH b AS (SELECT source, doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r]')) AS raw FROM documents), l AS (SELECT *, trim(raw, ' ' || chr(9) || chr(11) || chr(12)) AS line FROM b),
        p AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1),
        c AS (SELECT source, line, count(*) AS n FROM l WHERE line <> '' AND NOT regexp_matches(line, '(?i)licen[sc]e') AND length(line) <= 50 GROUP BY 1, 2),
        d AS (SELECT c.source, line FROM c JOIN p ON p.source = c.source WHERE n >= greatest(1, floor(pages * 0.2)))
        SELECT doc_id, count(raw)::int AS blocks, coalesce(sum(length(raw)), 0)::bigint AS chars FROM documents LEFT JOIN (SELECT l.doc_id, raw FROM l LEFT JOIN d ON d.source = l.source AND d.line = l.line
          WHERE l.line = '' OR (d.line IS NULL AND NOT regexp_matches(l.line, '(?i)licen[sc]e'))) USING (doc_id) GROUP BY doc_id""",
    "executed_run": f"""
        WITH {SCORED_SQL}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s),
        a AS (SELECT b.item_id AS sample_id, b.text AS truth, coalesce(d.text, '') AS pred, d.doc_id IS NOT NULL AS told FROM benchmark b LEFT JOIN (SELECT * FROM r WHERE rank = 1) r ON r.query_id = b.item_id LEFT JOIN documents d ON d.doc_id = r.doc_id),
        h AS (SELECT *, CASE WHEN trim(truth) <> '' AND contains(pred, trim(truth)) THEN 1.0 ELSE 0.0 END AS hit, CASE WHEN contains(pred, '引用') OR contains(pred, '证据') THEN 1.0 ELSE 0.5 END AS cited FROM a)
        SELECT sample_id, 'QA' AS task_type, CASE WHEN told THEN 'stored' ELSE 'stub' END AS provider, (20 * cited + 80 * hit)::double AS score_total, hit::double AS exact_hit, CASE WHEN 20 * cited + 80 * hit >= 80 THEN 'true' ELSE 'false' END AS matched, length(pred)::int AS pred_chars FROM h""",
    "names_in_documents": r"""
        WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\s]{5,}')) AS name FROM benchmark UNION SELECT c_name FROM customer)
        SELECT doc_id, count(*) AS n_names, min(name) AS first_name, max(name) AS last_name FROM documents JOIN n ON contains(text, name) GROUP BY doc_id""",
    "tables_across_pages": """
        WITH t AS (SELECT conv_id, turn, turn + 1 + turn // 3 AS page, (turn & 2) || ' head' AS head, role || ' ' || length(text) AS line FROM conversations),
        g AS (SELECT *, CASE WHEN page = lag(page) OVER w + 1 AND head = lag(head) OVER w THEN 0 ELSE 1 END AS fresh, lag(line) OVER w AS above FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY page)),
        r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY page) AS run FROM g)
        SELECT conv_id::varchar AS doc_id, 't' || min(turn) AS table_id, min(page)::int AS page_start, max(page)::int AS page_end,
               any_value(head) || chr(10) || string_agg(line, chr(10) ORDER BY page) FILTER (WHERE fresh = 1 OR line <> above) AS raw_text FROM r GROUP BY conv_id, run""",
    "merge_upsert": """
        SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 30 = 0 THEN 'again' WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 15 <> 0 OR o_orderkey % 30 = 0
        UNION ALL SELECT -o_orderkey - 1, o_custkey, 'N' FROM orders WHERE o_orderkey % 10 = 0""",
    "key_upsert": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -o_orderkey - 1, 'N' FROM orders WHERE o_orderkey % 10 = 0""",
    "question_bounds": """
        WITH o AS (SELECT o_orderkey AS query_id, (o_orderkey % 900 + 10)::double AS kv, o_orderkey % 5 AS op, (o_custkey % 30 + 1) || '.' || (o_orderkey % 8) AS clause FROM orders)
        SELECT query_id, CASE WHEN op IN (0, 4) THEN kv END AS gte, CASE WHEN op IN (1, 4) THEN kv END AS lte, CASE WHEN op = 2 THEN kv END AS gt, CASE WHEN op = 3 THEN kv END AS lt, 'clause_no' AS key, clause FROM o""",
    "table_row_chunks": """
        SELECT l_orderkey, 'tbl_t1_' || n AS chunk_id, 'no|part | ' || line AS text, CASE WHEN l_orderkey % 2 = 0 THEN 'cross_page_table_row' ELSE 'table_row' END AS source_type, n::int AS row_index
        FROM (SELECT l_orderkey, lpad(l_linenumber::varchar, 2, '0') || '|' || l_partkey AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY lpad(l_linenumber::varchar, 2, '0') || '|' || l_partkey) AS n FROM lineitem)""",
    "stable_hit_ids": "SELECT doc_id, 'sparse:' || doc_id || ':1:' || substr(sha256('sparse|' || doc_id || '|1|' || text), 1, 12) AS hit_id FROM documents",
    "low_quality_versions": """
        WITH v AS (SELECT o_orderkey AS doc_id, o_orderkey % 4 AS g, o_custkey % 50 AS score, o_orderkey % 400 AS text_len, o_orderkey % 9 AS chunks, o_custkey % 6 AS short FROM orders)
        SELECT doc_id FROM v WHERE g = 3 OR (g = 2 AND (text_len <= 200 OR chunks <= 3 OR short >= greatest(chunks, 2))) OR (score > 0 AND score < 20 AND chunks <= 4)""",
    "eval_dataset_join": "SELECT c_custkey AS sample_id, a.answer FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS answer FROM orders GROUP BY 1) a ON o_custkey = c_custkey",
    "scored_runs": "SELECT o_orderkey AS sample_id, round(40 * (o_orderkey % 2) + 30 + 20 * ((o_custkey % 10) / 10.0) + 5, 6)::double AS score_total FROM orders",
}
