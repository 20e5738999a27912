"""The two large plans: documents to index rows, and questions to ranked hits."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citelake.functions import terms, text
from citelake.operators import chapters, chunking, filters, normalize, payload, quality, retrieval, tables
from citelake.sources import pages as source_pages
from citelake.stages import written

ROW_FIELDS = {"doc_name": "string", "doc_id": "string", "version_id": "string", "page_start": "int", "page_end": "int", "excerpt": "string", "chunk_text": "string", "source_type": "string", "page_type": "string", "table_id": "string", "row_index": "int", "clause_id": "string", "table_repr": "string", "standard_no": "string", "doc_type": "string", "chapter_id": "string"}


def document_pages(documents: DataFrame) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("v1").alias("version_id"), "text")
    return source_pages.text_to_pages(docs)


def ingest(pages: DataFrame, assets: DataFrame | None = None, relations: DataFrame | None = None) -> DataFrame:
    """Index rows of parsed pages: text, table, summary and explanation chunks that pass the gate."""
    return _index_rows(normalize.blocks(pages), normalize.merged_across_pages(normalize.tables(pages)), assets, relations)


def ingest_texts(documents: DataFrame, assets: DataFrame | None = None, relations: DataFrame | None = None) -> DataFrame:
    """Index rows of plain texts (doc_id, text), whose ids are distinct: ingest() of document_pages(), which hold no tables."""
    docs = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("v1").alias("version_id"), "text")
    return _index_rows(normalize.blocks_of_texts(docs), None, assets, relations)


def _index_rows(blocks: DataFrame, found: DataFrame | None, assets: DataFrame | None, relations: DataFrame | None) -> DataFrame:
    """Texts move twice, and are written once between: blocks meet their document, and chunks do."""
    parts = written(chapters.chapters(normalize.without_repeated_edges(blocks)).drop("text"), "chapters")  # two kinds of chunks are made from them; blocks hold the text
    kind = lambda df: df.withColumns({k: F.lit(None).cast(t) for k, t in payload.OPTIONAL.items() if k not in df.columns})
    every = kind(tables.with_explanations(chunking.chunk_chapters(parts, 260, 520, 80), "chunk_no"))
    opening = parts.withColumn("text", chapters.joined(F.slice("blocks", 1, 4)))  # clean blocks are lines, and a summary takes four
    for more in (tables.section_summaries(opening), *([tables.row_chunks(found)] if found is not None else [])):
        every = every.unionByName(kind(more), allowMissingColumns=True)
    order = F.row_number().over(Window.partitionBy("doc_id", "version_id").orderBy("page_start", "chapter_id", "source_type", "chunk_id"))
    gated = quality.chunk_gate(every.repartition("doc_id").withColumn("ordinal", order)).where("gate = 'keep'").drop("gate")
    return payload.build(gated, assets, relations)


def plain_rows(rows: DataFrame) -> DataFrame:
    """Rows for search with all fields: absent ones are null; id and excerpt are made where missing."""
    full = rows.withColumns({k: F.lit(None).cast(t) for k, t in ROW_FIELDS.items() if k not in rows.columns})
    full = full.withColumn("excerpt", F.coalesce("excerpt", text.excerpt(F.col("chunk_text"))))
    return full if "id" in full.columns else full.withColumn("id", F.col("doc_id"))


def prepared(questions: DataFrame, entities: DataFrame | None = None, mode: str = "words", dim: int | None = None, search_filter: dict | None = None) -> DataFrame:
    """(query_id, question) with terms, identifiers, filter and route flags. The filter (must) is the question's own, the
    caller's, and the type of document that the question speaks of unless documents or versions are named."""
    parsed = filters.parse_questions(questions, entities)
    own = F.coalesce(F.flatten(F.transform(F.filter("must", lambda c: c["key"] == "clause_no"), lambda c: c["any_of"])), F.array().cast("array<string>"))
    asked = parsed.withColumns({"terms": terms.query_terms_col(F.col("question"), mode), "standards": terms.standard_tokens_col(F.col("question")), "clauses": own, "must": F.concat("must", filters.spec_column(search_filter))})
    scope = F.exists("must", lambda c: c["key"].isin("doc_id", "version_id") & (c["value"].isNotNull() | F.coalesce(F.size(c["any_of"]) > 0, F.lit(False))))
    flagged = retrieval.plan_questions(asked.withColumn("doc_scoped", scope))
    typed = F.concat("must", filters.of_type(F.col("query_doc_type")))
    return flagged.withColumn("must", F.when(F.col("query_doc_type").isNotNull() & ~F.col("doc_scoped"), typed).otherwise(F.col("must")))


def with_filters(rows: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with _pass, which of the questions' filters they pass, and questions with the places therein of their whole
    filter, of it without clauses (chapter route) and of its documents and versions alone (sparse route, whose pages bear
    no other field in the reference); null where nothing is asked. Questions are few; their filters are collected."""
    kept = {"spec_all": F.col("must"), "spec_chapter": F.filter("must", lambda c: ~c["key"].isin(*filters.STAND_IN)), "spec_scope": F.filter("must", lambda c: c["key"].isin("doc_id", "version_id"))}
    said = asked.withColumns({k: F.when(F.size(v) > 0, F.to_json(v)) for k, v in kept.items()})
    specs = sorted({x for r in said.select(*kept).distinct().collect() for x in r if x})
    place = lambda c: F.nullif(F.array_position(F.from_json(F.lit(json.dumps(specs)), "array<string>"), F.col(c)), F.lit(0)).cast("int") - 1
    return rows.withColumn("_pass", filters.passes(specs, rows.schema)), said.withColumns({k: place(k) for k in kept})


FLAGS = ["question", "terms", "standards", "clauses", "precision", "table_query", "listing_query", "query_doc_type", "doc_scoped"]


def search(rows: DataFrame, questions: DataFrame, k: int = 16, entities: DataFrame | None = None, low: DataFrame | None = None, routes: dict[str, int] | None = None, search_filter: dict | None = None) -> DataFrame:
    """The hits of _search(), for questions in blocks of a bounded number."""
    return reduce(DataFrame.unionByName, [_search(rows, some, k, entities, low, routes, search_filter)[0] for some in retrieval.query_blocks(questions)])


def cited(rows: DataFrame, questions: DataFrame, k: int = 16, explanations: int = 1, **how) -> DataFrame:
    """Citations of the hits with up to `explanations` explanation siblings of each clause cited (0: none, which is the
    reference's default), for questions in blocks of a bounded number."""
    return reduce(DataFrame.unionByName, [_cited(rows, some, k, explanations, **how) for some in retrieval.query_blocks(questions)])


def _cited(rows: DataFrame, questions: DataFrame, k: int, explanations: int, **how) -> DataFrame:
    hits, rows, asked = _search(rows, questions, k, **how)
    shown = retrieval.citations(hits)
    if not explanations:
        return shown
    spec = F.when(F.col("route") == "chapter_prefix", F.col("spec_chapter")).otherwise(F.col("spec_all"))
    anchors = shown.join(asked.select("query_id", "spec_all", "spec_chapter"), "query_id").withColumn("spec", spec).drop("spec_all", "spec_chapter")
    return retrieval.attach_explanations(anchors, rows, explanations)


def _local(questions: DataFrame) -> DataFrame:
    """A block of questions as rows of the plan itself: every route reads them, none makes them again."""
    return questions.sparkSession.createDataFrame(questions.collect(), questions.schema)


def _search(rows: DataFrame, questions: DataFrame, k: int = 16, entities: DataFrame | None = None, low: DataFrame | None = None, routes: dict[str, int] | None = None, search_filter: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions against rows: chapter prefix, else exact clause, else fused dense (by the rows' and questions' vectors, or
    by hash vectors where they bear none), keyword and sparse routes (full text; for Chinese questions without full-text
    hits, containment); then overlap rerank and boost. (hits, rows with their filters, questions). Each route keeps to its questions' filters, before its top-k.
    A question answered by an earlier way is left out of the later ones by an anti-join on its id. The text routes share one
    reading of the rows and name them by ordinal; the hits' rows, a bounded number, are then fetched once, and all that
    follows reads these alone."""
    depth = {"dense": max(k, 48), "keyword": 24, "sparse": max(k, 24), "fused": max(3 * k, 80), "clause": max(4 * k, 48), "chapter": max(8 * k, 96)} | (routes or {})
    depth = {"listing": max(depth["keyword"], 64)} | depth  # keyword hits of questions that ask for a list
    rows, asked = with_filters(rows, _local(prepared(questions, entities, search_filter=search_filter)))
    asked = _local(asked)
    named = asked.agg(*[F.coalesce(F.max(c), F.lit(0)) for c in (F.size("prefixes"), F.size("clauses"), F.col("doc_scoped").cast("int"), F.col("question").rlike("[一-鿿]").cast("int"), F.size("standards") + F.size("clauses"))]).first()
    body = retrieval.search_text("chunk_text", "excerpt", "doc_name", "chapter_id")
    flags = asked.select("query_id", *FLAGS)
    place = ["query_id", "rank", "score", "route", "ordinal"]
    whole = rows.select("ordinal", "id", *ROW_FIELDS)
    fields = [*place, "id", *ROW_FIELDS]

    def routed(hits: DataFrame, route: str) -> DataFrame:
        return hits.withColumn("route", F.lit(route)).select(*place)

    def hit_rows(*hits: DataFrame) -> DataFrame:
        """The rows of hits, a bounded number for each question; no other row leaves the tasks that read them."""
        named = reduce(DataFrame.union, [h.select("ordinal") for h in hits]).distinct()
        return whole.join(F.broadcast(named), "ordinal", "left_semi")

    def fetched(hits: DataFrame, whole: DataFrame) -> DataFrame:
        """Hits with their rows."""
        return whole.join(F.broadcast(hits), "ordinal").select(*fields)

    def wanting(df: DataFrame, spec: str, *columns) -> DataFrame:
        return df.select("query_id", *columns, F.col(spec).alias("spec"))

    early, open_ = [], asked
    if named[0]:
        asked_of = asked.where(F.size("prefixes") > 0)
        passes = [F.array_distinct(F.concat("terms", "prefixes")), F.col("prefixes")]  # the loose pass: continuations that share no word
        found = [retrieval.keyword_best(rows, wanting(asked_of, "spec_chapter", t.alias("terms")), depth["chapter"], body).withColumn("_pass_no", F.lit(i)) for i, t in enumerate(passes)]
        both = found[0].unionByName(found[1]).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_pass_no", "rank")))
        both = both.groupBy("query_id", "ordinal").agg(F.min_by("score", "rank").alias("score"), F.min("rank").alias("rank"))
        both = written(routed(both, "chapter_prefix"), "chapter-found")
        chapter = retrieval.clause_prefix_hits(fetched(both, hit_rows(both)).join(asked.select("query_id", "prefixes"), "query_id"))
        early.append(written(chapter.select(*fields), "chapter-hits"))
        open_ = open_.join(early[-1].select("query_id").distinct(), "query_id", "left_anti")
    if named[1]:
        wanted = wanting(open_.where(F.size("clauses") > 0), "spec_all", F.explode("clauses").alias("clause_id"))
        exact = rows.join(wanted, "clause_id").where(F.col("spec").isNull() | F.get("_pass", F.col("spec"))).withColumn("score", F.lit(0.0))
        told = F.coalesce("source_type", F.lit("")) != "explanation"
        exact = exact.withColumn("_told", F.max(told).over(Window.partitionBy("query_id"))).where(~F.col("_told") | told)
        early.append(written(retrieval.top_k(exact, depth["clause"], F.col("ordinal")).withColumn("route", F.lit("clause_exact")).select(*fields), "clause-hits"))
        open_ = open_.join(early[-1].select("query_id").distinct(), "query_id", "left_anti")
    open_ = _local(open_)

    listed = F.when(F.col("listing_query"), depth["listing"]).otherwise(depth["keyword"]).alias("_most")

    def by_keyword(df: DataFrame, least: int = 0) -> DataFrame:
        hits = retrieval.keyword_best(rows, wanting(df, "spec_all", "terms"), max(depth["listing"], depth["keyword"], least), body)
        return hits.join(F.broadcast(df.select("query_id", listed)), "query_id").where(F.col("rank") <= F.greatest("_most", F.lit(least))).drop("_most")

    asked_of = {"keyword": wanting(open_, "spec_all", "terms"), "sparse": wanting(open_.where("use_sparse"), "spec_scope", F.regexp_replace("sparse_query", r"[/\-&|!():*<>]+", " ").alias("query"), "terms")}
    vectors = "vector" in rows.columns and "query_vector" in questions.columns
    if not vectors:
        asked_of["dense"] = wanting(open_, "spec_all", F.col("dense_text").alias("query"))
    said, rest = F.lower(F.coalesce("chunk_text", F.lit(""))), retrieval.search_text("excerpt", "doc_name", "chapter_id")
    joint = retrieval.text_routes_best(rows, asked_of, depth | {"keyword": max(depth["listing"], depth["keyword"])}, said, rest)
    if vectors:
        dense = retrieval.dense_best(rows, wanting(open_, "spec_all", "query_vector"), depth["dense"])
        joint = joint.unionByName(dense.select(F.lit("dense").alias("route"), "query_id", "ordinal", "score", "rank"))
    joint = written(joint, "route-hits")  # the one reading of the rows' texts; read by what follows
    of = lambda route: joint.where(F.col("route") == route).drop("route")
    short = of("keyword").join(F.broadcast(open_.select("query_id", listed)), "query_id").where(F.col("rank") <= F.col("_most")).drop("_most")
    found, words, dense = {"dense": of("dense"), "keyword": short}, of("sparse"), of("dense")
    if named[3]:
        pages = rows.select(F.col("ordinal").alias("doc_id"), F.coalesce("page_start", F.lit(0)).alias("page_no"), F.col("chunk_text").alias("text"), "_pass")
        left = _local(asked_of["sparse"].where(F.col("query").rlike("[一-鿿]")).join(words.select("query_id").distinct(), "query_id", "left_anti"))
        like = retrieval.like_best(pages, left, depth["sparse"]).withColumnRenamed("doc_id", "ordinal")
        words = words.unionByName(like.select(*words.columns))
    found["sparse"] = words
    if named[2]:
        lost = _local(open_.where("doc_scoped").join(dense.select("query_id").distinct(), "query_id", "left_anti"))
        found["filter_keyword"] = by_keyword(lost, k).withColumn("score", F.col("score") * 5.0)
    # what gates ask of texts is known of keyword hits and not asked of dense ones; where no question bears identifiers,
    # only sparse hits are read. Texts are fetched for what is fused, measured, left behind, and fetched for the last k
    every = reduce(DataFrame.unionByName, [routed(h, r) for r, h in found.items()])
    if named[2] or named[3]:
        every = written(every, "all-hits")
    near = written(hit_rows(every, *early), "hit-rows")
    known = {"keyword": F.col("score"), "filter_keyword": F.col("score") / 5.0, "dense": F.lit(0.0)}
    flagged = lambda df: df.join(F.broadcast(flags), "query_id")
    says, fits = retrieval.keyword_measure(body, F.col("terms"))["score"], retrieval.matches_precision(F.col("standards"), F.col("clauses"))
    slim = ["id", "doc_id", "version_id", "_fits", "_says"]
    if named[4]:
        judged = flagged(fetched(every, near)).withColumns({"_fits": fits, "_says": says}).select(*place, *slim)
    else:
        read = flagged(fetched(every.where("route = 'sparse'"), near)).withColumns({"_fits": F.lit(True), "_says": says}).select(*place, *slim)
        worth = reduce(lambda c, x: c.when(F.col("route") == x[0], x[1]), known.items(), F.when(F.lit(False), F.lit(0.0)))
        rest = near.select("ordinal", "id", "doc_id", "version_id").join(F.broadcast(every.where("route <> 'sparse'")), "ordinal")
        judged = read.unionByName(rest.withColumns({"_fits": F.lit(True), "_says": worth}).select(*place, *slim))
    judged = flagged(judged)
    dense_hit = F.col("route") == "dense"  # passes every gate, and only sparse hits of unfit documents go
    met = judged.select(*place, *slim, F.when(~dense_hit, F.col("terms")).alias("terms"), (F.col("precision") & ~dense_hit).alias("precision"), (F.col("doc_scoped") | (F.col("route") != "sparse")).alias("doc_scoped"))
    met = met if low is None else retrieval.without_low_quality(met, low)
    gated = retrieval.route_gate(met, body, F.col("_fits"), F.col("_says"), ("query_id", "route"))
    order = [r for r in ("dense", "filter_keyword", "keyword", "sparse") if r in found]
    placed = gated.select(*place, "id", (F.array_position(F.array(*map(F.lit, order)), F.col("route")) - 1).alias("_route"))
    fused = retrieval.fuse(placed, depth["fused"]).select(*place)
    hits = flagged(reduce(DataFrame.unionByName, [*early, fetched(fused, near)]))
    if low is not None:
        bad = low.select("doc_id").distinct().withColumn("low_quality", F.lit(True))
        hits = hits.join(bad, "doc_id", "left").withColumn("low_quality", F.coalesce("low_quality", F.lit(False)))
    else:
        hits = hits.withColumn("low_quality", F.lit(False))
    measured = hits.withColumns({"_overlap": retrieval.rerank_value(hits), "_measure": retrieval.keyword_measure(body, F.col("terms"))})
    valued = measured.select(*place, "low_quality", "_overlap", retrieval.boost_value(F.col("_measure")).alias("_boost"))
    best = retrieval.by_boost(retrieval.by_value(valued, F.col("_overlap")), F.col("_boost"), k)
    shown = near.join(F.broadcast(best.select(*place, "low_quality", "boost")), "ordinal").select(*fields, "low_quality", "boost")
    return flagged(shown), rows, asked
