"""Tables that only grow: assets, evaluation runs, results and samples, call logs, entities.

New rows get the defaults of their table and, where they bring no id, one made from their content, so that a write that is
repeated after a failure makes the same rows. Appends are Parquet or JSON-lines writes; a status changes by an appended
event, of which the newest counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.functions import text
from citelake.operators import registry

#: Columns of each table with the defaults of absent or null ones.
ASSETS = {"asset_type": "'unknown'", "data_json": "'{}'", "source_page": "0", "source_excerpt": "''", "source_type": "'chapter_text'", "block_id": "CAST(null AS string)", "table_id": "CAST(null AS string)", "row_index": "CAST(null AS int)"}
RESULTS = {"sample_id": "'unknown'", "provider": "'stub'", "model": "'stub-mvp'", "score_total": "0.0D", "breakdown_json": "'{}'", "output_path": "''", "diff_path": "''"}
LOGS = {"task_type": "'unknown'", "provider": "'unknown'", "model": "'unknown'", "latency_ms": "CAST(null AS int)", "tokens_in": "CAST(null AS int)", "tokens_out": "CAST(null AS int)", "error": "CAST(null AS string)", "metadata_json": "'{}'"}
RUNS_SHOWN, RESULTS_SHOWN = 200, 500


def content_id(prefix: str, *columns: str, digits: int = 12) -> Column:
    """prefix and the first hex digits of a hash of the columns (as text, parted by a control character; null is another)."""
    body = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns])
    return F.concat(F.lit(prefix), F.substring(F.sha2(body, 256), 1, digits))


def _filled(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Absent columns and nulls take the defaults."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.expr(d)) if c in rows.columns else F.expr(d) for c, d in columns.items()})


def _named(rows: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    made = content_id(prefix, *columns)
    return rows.withColumn("id", F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), made) if "id" in rows.columns else made)


def asset_rows(assets: DataFrame) -> DataFrame:
    """Assets of documents' versions as rows of the asset table."""
    keys = ["doc_id", "version_id", *ASSETS]
    return _named(_filled(assets, ASSETS), "ast_", keys).select("id", *keys)


def result_rows(results: DataFrame) -> DataFrame:
    """Results of runs (run_id, ...) as rows of the result table."""
    keys = ["run_id", *RESULTS]
    return _named(_filled(results, RESULTS), "res_", keys).select("id", *keys)


def log_rows(records: DataFrame) -> DataFrame:
    """Model calls (request_id, ...) as rows of the call log."""
    request = records if "request_id" in records.columns else records.withColumn("request_id", F.lit(None).cast("string"))
    filled = _filled(request, LOGS)
    filled = filled.withColumn("request_id", F.coalesce("request_id", content_id("req_", *LOGS)))
    return _named(filled, "llm_", ["request_id", *LOGS]).select("id", "request_id", *LOGS)


def run_rows(requests: DataFrame, status: str = "queued") -> DataFrame:
    """Runs asked for (dataset_version, created_at) as rows of the run table."""
    return requests.select(content_id("run_", "dataset_version", "created_at").alias("id"), "dataset_version", F.lit(status).alias("status"), "created_at")


def with_run_status(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Runs with the status of their newest event (events: id, status, at); events of unknown runs change nothing."""
    newest = events.groupBy("id").agg(F.max_by("status", "at").alias("now"))
    return runs.join(newest, "id", "left").withColumn("status", F.coalesce("now", "status")).drop("now")


def newest(rows: DataFrame, most: int) -> DataFrame:
    """The newest rows, by created_at, then id."""
    return rows.orderBy(F.desc("created_at"), "id").limit(most)


def by_id(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col("id") == key)


def append(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """kind: parquet or json (one object a line)."""
    rows.write.mode("append").format(kind).save(path)


def sample_rows(samples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples (doc_id, version_id, question, answer, task_type) as new rows of a dataset's inputs, truths and manifest."""
    typed = _filled(samples, {"task_type": "'QA'"})
    named = typed.withColumn("sample_id", content_id("s_", "doc_id", "version_id", "question", "answer", "task_type", digits=10))
    inputs = named.select("sample_id", "doc_id", "version_id", "task_type", "question")
    truths = named.select("sample_id", "task_type", "answer")
    return inputs, truths, named.select("sample_id", "task_type", F.lit("inputs.jsonl").alias("input_ref"), F.lit("truths.jsonl").alias("truth_ref"))


def dataset_paths(root: str, version: str) -> dict[str, str]:
    """Where a dataset's tables lie."""
    base = f"{root.rstrip('/')}/{version}"
    return {"inputs": f"{base}/inputs.jsonl", "truths": f"{base}/truths.jsonl", "manifest": f"{base}/manifest.jsonl"}


def add_samples(spark: SparkSession, samples: DataFrame, root: str, version: str) -> DataFrame:
    """Append samples to a dataset, whose tables are made where they are absent; the manifest's new rows."""
    inputs, truths, manifest = sample_rows(samples)
    for rows, path in zip((inputs, truths, manifest), dataset_paths(root, version).values(), strict=True):
        append(rows, path, "json")
    return manifest


def entities(names: DataFrame) -> DataFrame:
    """(kind, name) -> (id, entity_kind, entity_name), each once; blank names are left out, blank kinds are `unknown`."""
    kind = F.coalesce(F.nullif(F.lower(text.strip(F.col("kind"))), F.lit("")), F.lit("unknown"))
    clean = names.select(kind.alias("entity_kind"), text.strip(F.col("name")).alias("entity_name")).where("entity_name <> ''").distinct()
    return clean.select(text.name_id(F.col("entity_kind"), F.col("entity_name")).alias("id"), "entity_kind", "entity_name")


def get_or_create(dictionary: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities to be added to the dictionary, the ids of all names); a name that is known keeps its id."""
    asked = entities(names)
    key = ["entity_kind", "entity_name"]
    return registry.insert_absent(dictionary, asked, *key), asked.withColumnRenamed("id", "made").join(dictionary.select("id", *key), key, "left").select(F.coalesce("id", "made").alias("id"), *key)


def entity_lookup(dictionary: DataFrame, names: DataFrame) -> DataFrame:
    """(kind, name) with the id of the dictionary, null where it is not known."""
    known = dictionary.select(F.lower(text.strip(F.col("entity_kind"))).alias("k"), text.strip(F.col("entity_name")).alias("n"), F.nullif(text.strip(F.col("id")), F.lit("")).alias("id"))
    asked = names.withColumns({"k": F.lower(text.strip(F.col("kind"))), "n": text.strip(F.col("name"))})
    return asked.join(known.groupBy("k", "n").agg(F.min("id").alias("id")), ["k", "n"], "left").drop("k", "n")
