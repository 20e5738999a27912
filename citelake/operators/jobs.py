"""Work on versions: failed, archived and retried ones, job summaries, evaluation runs and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.functions.text import strip
from citelake.operators import evaluate

#: Parts of key names whose values are secret.
SECRETS = ("key", "token", "secret", "password")


def redacted(config: Column) -> Column:
    """A map without the values of secret keys."""
    secret = lambda k: F.rlike(F.lower(k), F.lit("|".join(SECRETS)))
    return F.transform_values(config, lambda k, v: F.when(secret(k) & (F.coalesce(v, F.lit("")) != ""), "***").otherwise(v))


def failed(versions: DataFrame, limit: int | None = None) -> DataFrame:
    """Failed versions, newest first."""
    rows = versions.where("status = 'failed'").orderBy(F.desc("created_at"), "id")
    return rows if limit is None else rows.limit(limit)


def _event(rows: DataFrame, status: str, note: str, before: Column) -> DataFrame:
    return rows.select("id", F.lit(status).alias("status"), F.to_json(F.struct(before.alias(note), F.col("notes").alias("previous_notes"))).alias("notes"))


def archive_failed(versions: DataFrame, limit: int | None = None) -> DataFrame:
    """Status events that archive failed versions."""
    return _event(failed(versions, limit), "failed_archived", "cleanup_from", F.lit("failed"))


def retry_failed(versions: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(jobs to enqueue, status events) of failed versions that know their document and object."""
    whole = failed(versions, limit).where((strip(F.col("storage_key")) != "") & (strip(F.col("doc_id")) != ""))
    return jobs(whole), _event(whole, "retry_queued", "retry_from", F.lit("failed"))


def reprocess(versions: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    one = versions.where((F.col("id") == version) & (strip(F.col("storage_key")) != "") & (strip(F.col("doc_id")) != ""))
    return jobs(one), _event(one, "retry_queued", "retry_from", F.coalesce("status", F.lit("unknown")))


def jobs(versions: DataFrame) -> DataFrame:
    return versions.select("doc_id", F.col("id").alias("version_id"), F.col("storage_key").alias("object_key"), "doc_type")


def with_events(versions: DataFrame, events: DataFrame) -> DataFrame:
    """Versions with the status and notes of their event, where there is one."""
    new = events.select("id", F.col("status").alias("_s"), F.col("notes").alias("_n"))
    return versions.join(new, "id", "left").withColumns({"status": F.coalesce("_s", "status"), "notes": F.coalesce("_n", "notes")}).drop("_s", "_n")


def summary(parts: dict[str, DataFrame], keys: tuple[str, ...] = ("doc_id", "version_id")) -> DataFrame:
    """Rows a version of each named part (blocks, tables, chapters, chunks, ...); one narrow aggregation and one pivot."""
    named = None
    for name, df in parts.items():
        counted = df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("part", F.lit(name))
        named = counted if named is None else named.unionByName(counted)
    return named.groupBy(*keys).pivot("part", list(parts)).agg(F.first("n")).na.fill(0)


METRICS = {
    "IE": (evaluate.score_ie, ("precision", "recall", "source_acc", "json_valid", "hall_penalty", "power_bonus")),
    "TABLE": (evaluate.score_table, ("row_acc", "col_acc", "cell_acc", "num_acc")),
    "QA": (evaluate.score_qa, ("cite_presence", "cite_acc", "fact_acc", "refusal_acc")),
    "RETR": (evaluate.score_retrieval, ("hit5", "hit10", "mrr", "latency_score")),
}


def scored(samples: DataFrame) -> DataFrame:
    """samples (sample_id, task_type, metrics map<string,double>) with score_total by the task's formula."""
    value = lambda name: F.coalesce(F.try_element_at("metrics", F.lit(name)), F.lit(0.0))
    score = None
    for prefix in ("IE", "TABLE", "QA"):
        formula, names = METRICS[prefix]
        made, hit = formula(*map(value, names)), F.startswith("task_type", F.lit(prefix))
        score = F.when(hit, made) if score is None else score.when(hit, made)
    formula, names = METRICS["RETR"]
    return samples.withColumn("score_total", score.otherwise(formula(*map(value, names))))


def executed(samples: DataFrame, answers: DataFrame) -> DataFrame:
    """An evaluation run over stored answers: samples (sample_id, task_type, question, answer: the truth) with answers
    (sample_id, pred, provider, model; one a sample) -> sample_id, task_type, provider, model, score_total, breakdown, and
    the two documents of a sample's outcome, pred_json and diff_json. A sample without an answer counts as an empty one."""
    rows = samples.join(answers, "sample_id", "left")
    pred, truth = strip(F.col("pred")), strip(F.col("answer"))
    cited, hit = F.contains(pred, F.lit("引用")) | F.contains(pred, F.lit("证据")), (truth != "") & F.contains(pred, truth)
    kind = F.upper(F.coalesce(F.nullif("task_type", F.lit("")), F.lit("QA")))
    made = rows.select("sample_id", kind.alias("task_type"), F.coalesce("provider", F.lit("stub")).alias("provider"), F.coalesce("model", F.lit("stub-mvp")).alias("model"), F.coalesce("pred", F.lit("")).alias("pred"), F.coalesce("answer", F.lit("")).alias("truth"), F.struct(F.when(cited, 1.0).otherwise(0.5).alias("cite_presence"), F.when(hit, 1.0).otherwise(0.0).alias("exact_hit")).alias("breakdown"), evaluate.score_answer(cited, hit).alias("score_total"))
    none, match = F.create_map().cast("map<string,string>"), F.col("score_total") >= 80
    diff = F.struct(F.struct("truth", "pred", match.alias("match")).alias("qa"), none.alias("ie"), none.alias("table"), none.alias("retrieval"))
    said = F.to_json(F.struct("sample_id", "task_type", "provider", "model", "pred", "truth"))
    return made.select("sample_id", "task_type", "provider", "model", "score_total", "breakdown", said.alias("pred_json"), F.to_json(F.struct("sample_id", "task_type", "score_total", "breakdown", diff.alias("diff"))).alias("diff_json"))


def diff_reports(results: DataFrame) -> DataFrame:
    """Reports of scored samples (run_id, sample_id, task_type, provider, model, score_total, metrics)."""
    advice = F.when(F.col("score_total") < 60, "consider_tier_upgrade").otherwise("keep_current_tier")
    return results.select("run_id", "sample_id", F.to_json(F.struct("run_id", "sample_id", "task_type", "provider", "model", "score_total", F.col("metrics").alias("breakdown"), F.array().cast("array<string>").alias("errors"), F.struct(advice.alias("model_switch")).alias("suggestions"))).alias("report"))
