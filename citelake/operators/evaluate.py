"""Retrieval and answer quality: metrics over hits, scores, trends and the release gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.functions.text import strip

SPEC_TEXT = ("doc_id", "version_id", "doc_name", "chapter_id", "clause_id", "clause_no", "article_no", "constraint_type")
#: Default thresholds of the release gate.
GATE = {"queries": 30, "hit_at_10": 0.75, "mrr": 0.45, "evidence_hit_rate_at_10": 0.80, "clause_hit_at_k": 0.70, "constraint_coverage": 0.70, "citation_completeness": 0.85}


def _same(field: str, wanted: Column) -> Column:
    w = strip(wanted)
    return (w == "") | (strip(F.col(field)) == w)


def within(page: Column) -> Column:
    return F.coalesce(page.between(F.coalesce("page_start", F.lit(0)), F.coalesce("page_end", "page_start", F.lit(0))), F.lit(False))


def matches_spec(spec: Column) -> Column:
    """Whether a hit satisfies every given part of a spec (struct of SPEC_TEXT fields, is_mandatory, page)."""
    ok = F.lit(True)
    for f in SPEC_TEXT:
        ok = ok & _same(f, spec[f])
    must, page = spec["is_mandatory"], spec["page"]
    return ok & (must.isNull() | (F.coalesce("is_mandatory", F.lit(False)) == must)) & (page.isNull() | within(page))


def is_relevant() -> Column:
    """A hit against its sample: document, version, name, any expected page, any spec. A sample that expects nothing has
    no relevant hit."""
    e = {k: strip(F.col(f"expected_{k}")) for k in ("doc_id", "version_id", "doc_name")}
    pages, specs = F.coalesce("expected_pages", F.array().cast("array<int>")), F.col("relevant_any")
    ok = _same("doc_id", e["doc_id"]) & _same("version_id", e["version_id"]) & _same("doc_name", e["doc_name"]) & ((F.size(pages) == 0) | F.exists(pages, within))
    some = (e["doc_id"] != "") | (e["version_id"] != "") | (e["doc_name"] != "") | (F.size(pages) > 0)
    return ok & F.when(F.coalesce(F.size(specs), F.lit(0)) > 0, F.exists(specs, matches_spec)).otherwise(some)


def is_complete() -> Column:
    """Document, page and text are all there."""
    return (F.coalesce(F.nullif(strip(F.col("doc_name")), F.lit("")), F.nullif(strip(F.col("doc_id")), F.lit(""))).isNotNull()) & F.col("page_start").isNotNull() & (F.coalesce(F.nullif(strip(F.col("excerpt")), F.lit("")), strip(F.col("chunk_text"))) != "")


def expected_clauses() -> Column:
    listed = F.transform(F.coalesce("expected_clause_ids", F.array().cast("array<string>")), strip)
    return F.filter(F.array_distinct(F.concat(listed, F.array(strip(F.col("expected_clause_id"))))), lambda x: x != "")


def per_sample(samples: DataFrame, hits: DataFrame, k: int = 10) -> DataFrame:
    """One row a sample: rank of the first relevant hit, evidence, clause hit, constraint specs found, completeness.

    samples: query_id, expected_*, relevant_any, constraint_specs; hits: query_id, rank and payload fields."""
    k = max(1, k)
    s = samples.withColumn("_clauses", expected_clauses())
    implied = F.transform("_clauses", lambda c: F.struct(*[(c if f == "clause_id" else strip(F.col("expected_constraint_type")) if f == "constraint_type" else F.lit("")).alias(f) for f in SPEC_TEXT], F.col("expected_is_mandatory").alias("is_mandatory"), F.lit(None).cast("int").alias("page")))
    wanted = F.coalesce("constraint_specs", F.array().cast("array<struct<" + ",".join(f"{f}:string" for f in SPEC_TEXT) + ",is_mandatory:boolean,page:int>>"))
    with_rules = F.col("expected_is_mandatory").isNotNull() | (strip(F.col("expected_constraint_type")) != "")
    s = s.withColumn("_specs", F.when(with_rules, F.concat(wanted, implied)).otherwise(wanted))
    clause_specs = F.filter("relevant_any", lambda x: F.greatest(*[F.length(strip(x[f])) for f in ("clause_id", "clause_no", "article_no")]) > 0)
    s = s.withColumn("_clause_specs", F.coalesce(clause_specs, F.array().cast(s.schema["relevant_any"].dataType)))
    own = F.filter(F.transform(F.array("clause_id", "clause_no", "article_no"), strip), lambda x: x != "")
    by_clause = F.when(F.size("_clauses") > 0, F.arrays_overlap("_clauses", own)).when(F.size("_clause_specs") > 0, F.exists("_clause_specs", matches_spec))
    joined = s.join(hits.where(F.col("rank") <= k), "query_id", "left").withColumns({"_rel": F.col("rank").isNotNull() & is_relevant(), "_done": is_complete()})
    found = F.transform("_specs", lambda x: F.when(F.col("rank").isNotNull() & matches_spec(x), 1).otherwise(0))
    joined = joined.withColumns({"_clause": F.when(F.col("rank").isNotNull(), by_clause).otherwise(F.when((F.size("_clauses") > 0) | (F.size("_clause_specs") > 0), False)), "_found": found})
    row = joined.groupBy("query_id").agg(
        F.min(F.when(F.col("_rel"), F.col("rank"))).alias("rank"), F.coalesce(F.max(F.col("_rel") & F.col("_done") & (F.col("rank") <= 10)), F.lit(False)).alias("_evidence"), F.max("_clause").alias("clause_hit"),
        F.max(F.size("_specs")).alias("specs"), F.collect_list("_found").alias("_found"), F.sum(F.col("_rel").cast("long")).alias("relevant"), F.sum((F.col("_rel") & F.col("_done")).cast("long")).alias("complete"),
    )
    hit = F.aggregate("_found", F.transform(F.element_at("_found", 1), lambda x: F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    return row.select("query_id", "rank", (F.col("rank").isNotNull() & (F.col("rank") <= 10) & F.col("_evidence")).alias("evidence_at_10"), "clause_hit", "specs", F.aggregate(hit, F.lit(0), lambda a, x: a + x).alias("specs_hit"), "relevant", "complete")


def metrics(rows: DataFrame) -> DataFrame:
    """One row over all samples, with the gate."""
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    n, g = F.count("*"), GATE
    clause_n, specs_n, relevant_n = F.count("clause_hit"), F.coalesce(F.sum("specs"), F.lit(0)), F.coalesce(F.sum("relevant"), F.lit(0))
    out = rows.agg(
        n.alias("query_count"), share(F.count_if(F.col("rank") <= 5), n).alias("hit_at_5"), share(F.count_if(F.col("rank") <= 10), n).alias("hit_at_10"), share(F.count_if("evidence_at_10"), n).alias("evidence_hit_rate_at_10"),
        share(F.coalesce(F.sum(1.0 / F.col("rank")), F.lit(0.0)), n).alias("mrr"), share(F.count_if("clause_hit"), clause_n).alias("clause_hit_at_k"), share(F.coalesce(F.sum("specs_hit"), F.lit(0)), specs_n).alias("constraint_coverage"),
        share(F.coalesce(F.sum("complete"), F.lit(0)), relevant_n).alias("citation_completeness"), clause_n.alias("clause_samples"), specs_n.alias("constraint_specs"), relevant_n.alias("relevant_hits"),
    )
    passed = (F.col("query_count") >= g["queries"]) & (F.col("hit_at_10") >= g["hit_at_10"]) & (F.col("mrr") >= g["mrr"]) & (F.col("evidence_hit_rate_at_10") >= g["evidence_hit_rate_at_10"])
    for count, name in (("clause_samples", "clause_hit_at_k"), ("constraint_specs", "constraint_coverage"), ("relevant_hits", "citation_completeness")):
        passed = passed & ((F.col(count) == 0) | (F.col(name) >= g[name]))
    return out.withColumn("passed", passed).withColumn("reason", F.when(F.col("query_count") == 0, "empty dataset").when(F.col("passed"), "ok").otherwise("metrics or sample count below threshold"))


def clamped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def score_ie(precision: Column, recall: Column, source: Column, valid: Column, penalty: Column, bonus: Column) -> Column:
    return clamped(40 * precision + 20 * recall + 20 * source + 10 * valid - penalty + bonus)


def score_table(rows: Column, columns: Column, cells: Column, numbers: Column) -> Column:
    return clamped(25 * rows + 25 * columns + 35 * cells + 15 * numbers)


def score_qa(cited: Column, citation: Column, fact: Column, refusal: Column) -> Column:
    return clamped(20 * cited + 30 * citation + 30 * fact + 20 * refusal)


def score_retrieval(hit5: Column, hit10: Column, mrr: Column, latency: Column) -> Column:
    return clamped(40 * hit5 + 30 * hit10 + 20 * mrr + 10 * latency)


def score_answer(cited: Column, hit: Column) -> Column:
    return 20 * F.when(cited, 1.0).otherwise(0.5) + 80 * F.when(hit, 1.0).otherwise(0.0)


def amount_close(got: Column, truth: Column, share: float = 0.01) -> Column:
    return F.when(truth == 0, got == 0).otherwise(F.abs(got - truth) <= F.abs(truth) * share)


def length_close(got: Column, truth: Column, km: float = 0.1) -> Column:
    return F.abs(got - truth) <= km


def trends(results: DataFrame, *by: str) -> DataFrame:
    """Count, failed (below 60), mean score and failure rate."""
    n, failed = F.count("*"), F.count_if(F.col("score_total") < 60)
    return results.groupBy(*by).agg(n.alias("count"), failed.alias("failed"), F.coalesce(F.avg("score_total"), F.lit(0.0)).alias("avg_score"), F.when(n > 0, failed / n).otherwise(0.0).alias("failure_rate"))


def answer_grade(mean: Column) -> Column:
    return F.when(mean >= 85, "A").when(mean >= 65, "B").otherwise("C")


def dataset_rows(inputs: DataFrame, truths: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Inputs with their truth; of several truths the last."""
    last = truths.groupBy("sample_id").agg(F.max_by("answer", ordinal).alias("answer"))
    return inputs.join(last, "sample_id", "left")
