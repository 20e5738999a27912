"""Chunks to typed index rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.functions import clauses, fixed, text

from .extract import amount_wan, voltage

DOC = ["doc_id", "version_id"]
PERSON = f"([一-龥]{{2,4}})(?:任|担任)(?:{'|'.join(fixed.ROLES)})"
OPTIONAL = {"doc_name": "string", "doc_type": "string", "source_type": "string", "page_type": "string", "table_repr": "string", "table_id": "string", "row_index": "int", "clause_id": "string", "clause_node_id": "string", "clause_parent_id": "string", "clause_level": "int", "block_ids": "array<string>"}


def document_values(assets: DataFrame) -> DataFrame:
    """First known value of each kind over all assets of a document, in order; these go before a chunk's own text."""
    order = F.struct("page_no", "asset_no")

    def first(value: Column) -> Column:
        return F.min_by(value, F.when(value.isNotNull(), order))

    filled = lambda c: F.nullif(F.upper(text.strip(F.col(c))), F.lit(""))
    return assets.groupBy(*DOC).agg(
        first(F.col("data.voltage_level_kv")).alias("_kv"), (first(F.col("data.contract_amount_rmb")) / 10000.0).alias("_wan"), first(F.col("data.line_length_km")).alias("_km"),
        first(F.coalesce(F.nullif(F.col("data.substation_capacity_mva"), F.lit(0.0)), "data.transformer_capacity_mva")).alias("_mva"),
        first(filled("data.standard_name")).alias("_standard"), first(filled("data.certificate")).alias("_cert"), first(F.col("data.is_mandatory")).alias("_must"),
    )


def relation_values(relations: DataFrame) -> DataFrame:
    """(doc_id, version_id, type, source_name, target_name, role, relation_no) -> persons, projects and their ties."""
    ties = relations.where("type = 'PERSON_TO_PROJECT'")
    who, what = text.name_id(F.lit("person"), F.coalesce("source_name", F.lit(""))), text.name_id(F.lit("project"), F.coalesce("target_name", F.lit("")))

    def listed(value: Column) -> Column:
        return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("relation_no", value.alias("v"))))), lambda x: x["v"]))

    role = F.nullif(F.col("role"), F.lit(""))
    return ties.groupBy(*DOC).agg(
        listed(F.nullif(F.col("source_name"), F.lit(""))).alias("_persons"), listed(F.nullif(F.col("target_name"), F.lit(""))).alias("_projects"), listed(F.concat_ws("|", who, what)).alias("rel_person_project"),
        listed(F.when(role.isNotNull(), F.concat_ws("|", who, role))).alias("rel_person_role"), listed(F.when(role.isNotNull(), F.concat_ws("|", who, role, what))).alias("rel_person_role_project"),
    )


def is_mandatory(c: Column) -> Column:
    return text.contains_any(c, fixed.MANDATORY_TEXT.strip("()").split("|"))


def constraint_type(c: Column, mandatory: Column) -> Column:
    return F.when(mandatory | text.contains_any(c, ("强制性条文", "不得", "严禁", "禁止")), "mandatory").when(text.contains_any(c, ("应", "宜")), "recommended").otherwise("informative")


def page_types(structs: DataFrame) -> DataFrame:
    """(doc_id, version_id, kind, page_no) of structured tables -> one page type a page: power before device before
    qualification."""
    rank = F.when(F.col("kind") == "power_param_table", 1).when(F.col("kind") == "device_inventory_table", 2).otherwise(3)
    return structs.groupBy(*DOC, F.col("page_no").alias("page_start")).agg(F.min_by("kind", rank).alias("_page_type"))


def build(chunks: DataFrame, assets: DataFrame | None = None, relations: DataFrame | None = None, structs: DataFrame | None = None) -> DataFrame:
    """Index rows. Joins are on the document and bring in one short row each; absent inputs mean none."""
    c = chunks.withColumns({k: F.lit(None).cast(t) for k, t in OPTIONAL.items() if k not in chunks.columns})
    values = {"_kv": "int", "_wan": "double", "_km": "double", "_mva": "double", "_standard": "string", "_cert": "string", "_must": "boolean"}
    ties = {k: "array<string>" for k in ("_persons", "_projects", "rel_person_project", "rel_person_role", "rel_person_role_project")}
    c = c.join(document_values(assets), DOC, "left") if assets is not None else c.withColumns({k: F.lit(None).cast(t) for k, t in values.items()})
    c = c.join(relation_values(relations), DOC, "left") if relations is not None else c.withColumns({k: F.lit(None).cast(t) for k, t in ties.items()})
    c = c.join(page_types(structs), [*DOC, "page_start"], "left") if structs is not None else c.withColumn("_page_type", F.lit(None).cast("string"))
    t, none = F.coalesce("text", F.lit("")), F.array().cast("array<string>")
    persons = F.array_distinct(F.concat(F.coalesce("_persons", none), F.regexp_extract_all(t, F.lit(PERSON), F.lit(1))))
    projects = F.coalesce("_projects", none)
    clause = F.coalesce(F.nullif(text.strip(F.col("clause_id")), F.lit("")), clauses.first_clause(t))
    node = F.coalesce(F.nullif(text.strip(F.col("clause_node_id")), F.lit("")), clause)
    path = clauses.article_path(F.coalesce(clause, F.lit("")))
    must = F.coalesce("_must", is_mandatory(t))
    standard = F.coalesce("_standard", F.nullif(F.upper(F.trim(F.regexp_extract(t, f"(?i){fixed.STANDARD}", 1))), F.lit("")))
    cert = F.coalesce("_cert", F.nullif(F.regexp_extract(t, fixed.CERTIFICATE, 1), F.lit("")))
    return c.select(
        F.concat_ws(":", "doc_id", F.coalesce("version_id", F.lit("")), "chunk_id").alias("id"), "doc_id", F.coalesce("version_id", F.lit("")).alias("version_id"), F.coalesce("doc_name", F.lit("")).alias("doc_name"), "chunk_id", "chapter_id", "page_start", "page_end",
        F.coalesce("doc_type", F.lit("unknown")).alias("doc_type"), F.coalesce("_page_type", "page_type", F.lit("other")).alias("page_type"), F.coalesce("source_type", F.lit("text")).alias("source_type"), "table_repr", "table_id", "row_index",
        F.lit(True).alias("has_citation"), text.excerpt(t).alias("excerpt"), t.alias("chunk_text"), F.coalesce("block_ids", none).alias("block_ids"),
        persons.alias("entity_person_names"), projects.alias("entity_project_names"), none.alias("entity_equipment_names"),
        F.transform(persons, lambda n: text.name_id(F.lit("person"), n)).alias("entity_person_ids"), F.transform(projects, lambda n: text.name_id(F.lit("project"), n)).alias("entity_project_ids"), none.alias("entity_equipment_ids"),
        *[F.coalesce(k, none).alias(k) for k in ("rel_person_role", "rel_person_project", "rel_person_role_project")],
        F.coalesce("_kv", voltage(t)).alias("val_voltage_kv"), F.coalesce("_wan", amount_wan(t)).alias("val_contract_amount_w"), F.col("_km").alias("val_line_length_km"), F.col("_mva").alias("val_capacity_mva"),
        clause.alias("clause_id"), clause.alias("clause_no"), node.alias("clause_node_id"), F.coalesce(F.nullif(text.strip(F.col("clause_parent_id")), F.lit("")), clauses.parent(F.coalesce(node, F.lit("")))).alias("clause_parent_id"),
        F.coalesce("clause_level", clauses.level(F.coalesce(node, F.lit("")))).alias("clause_level"), must.alias("is_mandatory"), standard.alias("standard_no"), cert.alias("certificate_no"),
        path.alias("article_path"), F.coalesce(F.try_element_at(path, F.lit(1)), F.lit("")).alias("chapter_no"), F.coalesce(F.try_element_at(path, F.lit(2)), F.lit("")).alias("section_no"), clause.alias("article_no"), constraint_type(t, must).alias("constraint_type"),
    )
