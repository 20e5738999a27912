"""Quality: the gate before indexing, document grades and document classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.functions import fixed, text


def chunk_gate(chunks: DataFrame, keys: tuple[str, ...] = ("doc_id", "version_id"), ordinal: str = "ordinal", min_chars: int = 100, fallback: int = 8) -> DataFrame:
    """chunks with gate: 'keep', 'dup', 'noise' or 'short'.

    A chunk is kept if it is neither noise nor too short and is the first such of its signature (source type and word
    characters). A repetition is called dup only after a kept chunk of the signature. Where a document would keep nothing,
    its first `fallback` chunks are kept. Columns used: text, source_type, chunk_id and the ordinal."""
    t = text.strip(F.col("text"))
    flat = text.single_spaced(t)
    kind = text.strip(F.col("source_type"))
    row = kind.isin(*fixed.TABLE_ROW_TYPES) | F.startswith(F.coalesce("chunk_id", F.lit("")), F.lit("tbl_"))
    noise = F.when(row, text.is_noisy_row(t)).otherwise(text.is_noisy(t))
    short = ~row & (F.length(flat) < min_chars) & ~text.has_evidence(flat) & ~text.is_short_clause(flat)
    judged = chunks.withColumns({"_sig": F.sha2(F.concat(kind, F.lit("|"), F.regexp_replace(F.lower(flat), r"(?U)[\W_]+", "")), 256), "_noise": noise, "_short": short})
    good = ~F.col("_noise") & ~F.col("_short")
    first = F.min(F.when(good, F.col(ordinal))).over(Window.partitionBy(*keys, "_sig"))
    judged = judged.withColumn("_first", first)
    gate = F.when(F.col("_first") < F.col(ordinal), "dup").when(F.col("_noise"), "noise").when(F.col("_short"), "short").otherwise("keep")
    judged = judged.withColumn("gate", gate)
    doc = Window.partitionBy(*keys)
    judged = judged.withColumns({"_kept": F.sum((F.col("gate") == "keep").cast("int")).over(doc), "_nth": F.row_number().over(doc.orderBy(ordinal))})
    gated = judged.withColumn("gate", F.when((F.col("_kept") == 0) & (F.col("_nth") <= fallback), "keep").otherwise(F.col("gate")))
    return gated.drop("_sig", "_noise", "_short", "_first", "_kept", "_nth")


def grade_of(text_len: Column, blocks: Column, tables: Column) -> tuple[Column, Column]:
    """(score, grade): characters / 40 + 4 a block + 8 a table, at most 100; A from 75, B from 45, else C."""
    score = F.least(F.lit(100).cast("long"), F.floor(text_len / 40) + blocks * 4 + tables * 8)
    return score, F.when(score >= 75, "A").when(score >= 45, "B").otherwise("C")


def grades(blocks: DataFrame, tables: DataFrame, keys: tuple[str, ...] = ("doc_id", "version_id")) -> DataFrame:
    b = blocks.groupBy(*keys).agg(F.count("*").alias("block_count"), F.sum(F.length("text").cast("long")).alias("text_len"))
    t = tables.groupBy(*keys).agg(F.count("*").alias("table_count"))
    both = b.join(t, list(keys), "full").na.fill(0, ["block_count", "text_len", "table_count"])
    score, grade = grade_of(F.col("text_len"), F.col("block_count"), F.col("table_count"))
    return both.withColumns({"score": score, "grade": grade})


def classify(corpus: Column) -> Column:
    """struct(doc_type, confidence, keyword_hits): the class with most of its keywords present, the first on ties."""
    hits = [(kind, reduce(Column.__add__, [F.contains(corpus, F.lit(w)).cast("int") for w in words])) for kind, words in fixed.DOC_TYPE_KEYWORDS]
    best = F.greatest(*[h for _, h in hits])
    kind = reduce(lambda c, x: c.when(x[1] == best, x[0]), hits[1:], F.when(hits[0][1] == best, hits[0][0]))
    confidence = F.greatest(F.lit(0.3), F.least(F.lit(0.99), 0.3 + best * 0.15))
    return F.struct(kind.alias("doc_type"), confidence.alias("confidence"), best.alias("keyword_hits"))


def low_quality(versions: DataFrame) -> DataFrame:
    """Processed versions unfit for the sparse route. Columns: doc_id, version_id, grade, score, text_len, chunks, dropped_short."""
    g, s = F.upper(F.coalesce("grade", F.lit(""))), F.coalesce("score", F.lit(0))
    thin = (F.coalesce("text_len", F.lit(0)) <= 200) | (F.coalesce("chunks", F.lit(0)) <= 3) | (F.coalesce("dropped_short", F.lit(0)) >= F.greatest(F.coalesce("chunks", F.lit(0)), F.lit(2)))
    bad = g.isin("D", "F") | ((g == "C") & thin) | ((s > 0) & (s < 20) & (F.coalesce("chunks", F.lit(0)) <= 4))
    return versions.where(bad).select("doc_id", "version_id")


def noise_line_ratio(body: Column) -> Column:
    """Share of lines that are site marks, unreadable, or short without Chinese; 1 without lines."""
    rows = text.lines(body)
    bare = lambda x: text.without_space(x)
    noisy = F.filter(rows, lambda x: text.contains_any(F.lower(x), ("www.", ".com", "bzfxw")) | (text.readable_ratio(x) < 0.45) | ((bare(x) != "") & (text.cjk_ratio(bare(x)) < 0.05) & (F.length(bare(x)) <= 48)))
    return F.when(F.size(rows) > 0, F.size(noisy) / F.size(rows)).otherwise(1.0)


def needs_ocr(page_text: Column) -> Column:
    """A page whose text layer is too short, unreadable, mostly noise lines, or short without Chinese."""
    t = text.strip(page_text)
    return (F.length(t) < 48) | (text.readable_ratio(t) < 0.55) | (noise_line_ratio(t) >= 0.4) | ((text.cjk_ratio(t) == 0) & (F.length(t) <= 160))


def needs_full_ocr(pages: DataFrame, keys: tuple[str, ...] = ("doc_id", "version_id")) -> DataFrame:
    """(keys, bad_pages, full): whether so many pages are bad that the whole document is read again."""
    per = pages.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(needs_ocr(F.col("text"))).alias("bad_pages"), F.avg(F.length(F.coalesce("text", F.lit("")))).alias("_chars"))
    share = F.col("bad_pages") / F.col("_n")
    full = (F.col("bad_pages") > 0) & ((F.col("bad_pages") >= 24) | (share >= 0.3) | ((F.col("_chars") <= 180) & (share >= 0.15)))
    return per.select(*keys, "bad_pages", full.alias("full"))


def field_errors(voltage_kv: Column, amount_wan: Column) -> Column:
    """array<struct<field,fatal,reason>>: values outside what can be."""

    def error(field: str, value: Column, bad: Column) -> Column:
        return F.when(value.isNotNull() & bad, F.struct(F.lit(field).alias("field"), F.lit(True).alias("fatal"), F.concat(F.lit(f"{field} out of range: "), value.cast("double").cast("string")).alias("reason")))

    found = F.array(error("voltage_kv", voltage_kv, (voltage_kv < 1) | (voltage_kv > 1500)), error("amount_wan", amount_wan, (amount_wan <= 0.01) | (amount_wan > 1e8)))
    return F.filter(found, lambda x: x.isNotNull())
