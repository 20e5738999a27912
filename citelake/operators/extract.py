"""Facts from page texts: two rule engines, their merge, and facts as sentences and chunks.

Assets: (keys..., page_no, asset_no, asset_type, data struct, source_excerpt, engine). One pass of expressions a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.functions import fixed, text

ROLE = "(项目经理|技术负责人|总工|安全员|质量员)"
FIELDS = {
    "project_name": "string", "owner_unit": "string", "contract_sign_date": "string", "contract_amount_original": "string", "contract_amount_rmb": "double", "voltage_level_kv": "int",
    "substation_capacity_mva": "double", "line_length_km": "double", "transformer_capacity_mva": "double", "cable_type": "string", "certificate_no": "string", "standard_no": "string", "clause_no": "string",
    "name": "string", "role": "string", "person_name": "string", "certificate": "string", "standard_name": "string", "is_mandatory": "boolean",
}
EXCERPT_WORDS = ("项目名称", "工程名称", "业主单位", "建设单位", "合同金额", "中标价", "项目经理", "技术负责人", "资格证", "证书", "设备", "断路器", "标准", "条款")


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(text.strip(F.regexp_extract(c, pattern, group)), F.lit(""))


def after_label(c: Column, labels: str, value: str = r"([^\n]+)") -> Column:
    """The value after the first of some labels."""
    return _found(c, rf"(?:{labels})[:：\s]*{value}")


def amount_rmb(raw: Column) -> Column:
    """`5,000万元` -> 5e7."""
    n = F.regexp_replace(F.regexp_extract(raw, r"([0-9,.]+)", 1), ",", "").try_cast("double")
    unit = F.regexp_extract(raw, r"[0-9,.]+\s*(亿元|万元|万|元)?", 1)
    return n * F.when(unit == "亿元", 1e8).when(unit.isin("万元", "万"), 1e4).otherwise(1.0)


def amount_wan(c: Column) -> Column:
    """The first amount in ten thousands."""
    n = F.regexp_extract(c, fixed.AMOUNT, 1).try_cast("double")
    return F.when(F.regexp_extract(c, fixed.AMOUNT, 2) == "亿", n * 10000).otherwise(n)


def voltage(c: Column) -> Column:
    return F.regexp_extract(c, fixed.VOLTAGE, 1).try_cast("int")


def person(c: Column) -> Column:
    return F.coalesce(after_label(c, "项目经理|技术负责人|总工|安全员|质量员", "([一-龥]{2,4})"), _found(c, f"([一-龥]{{2,4}})(?:任|担任){ROLE}"))


def readable_excerpt(c: Column, limit: int = 220) -> Column:
    """Readable lines with key words (else any readable lines) joined until the limit is reached."""
    marks = fixed.READABLE_MARKS.replace("\n", "").replace("\t", "")

    def plain(line: Column) -> Column:
        t = F.regexp_replace(line, r"\$[^$]{0,200}\$|\\[a-zA-Z]+\s*\{[^}]*\}|\\[a-zA-Z]+|[{}\x00]", " ")
        return text.squeeze(t)

    def toc(line: Column) -> Column:
        low = F.lower(line)
        return (low.rlike(r"\b\d{1,2}\.\d{1,2}(?:\.\d+)?\s*[a-z]") & low.rlike(r"\(\s*\d{1,3}\s*\)")) | line.rlike(r"[.…]{2,}\s*\(?\d{1,3}\)?\s*$") | F.contains(low, F.lit("table of content")) | (low == "contents")

    rows = F.filter(F.transform(text.lines(c), plain), lambda x: (x != "") & ~toc(x))
    strong = F.filter(rows, lambda x: text.contains_any(x, EXCERPT_WORDS))
    pool = F.filter(F.when(F.size(strong) > 0, strong).otherwise(rows), lambda x: (text.readable_ratio(x, marks) >= 0.6) & (F.length(x) >= 4))
    joined = F.aggregate(pool, F.lit(""), lambda s, x: F.when(F.length(s) >= limit, s).when(s == "", x).otherwise(F.concat(s, F.lit("；"), x)))
    whole = plain(F.coalesce(c, F.lit("")))
    return F.substring(F.when(joined != "", joined).when(text.readable_ratio(whole, marks) >= 0.55, whole).otherwise(""), 1, limit)


def _data(**known: Column) -> Column:
    return F.struct(*[known.get(k, F.lit(None)).cast(t).alias(k) for k, t in FIELDS.items()])


def _assets(pages: DataFrame, keys: list[str], made: list[tuple[str, Column, Column]], engine: str) -> DataFrame:
    """made: (asset type, condition, data) in order."""
    each = F.filter(F.array(*[F.when(cond, F.struct(F.lit(kind).alias("asset_type"), data.alias("data"))) for kind, cond, data in made]), lambda x: x.isNotNull())
    rows = pages.select(*keys, "page_no", readable_excerpt(F.col("text")).alias("source_excerpt"), F.posexplode(each).alias("asset_no", "a"))
    return rows.select(*keys, "page_no", "asset_no", "a.asset_type", "a.data", "source_excerpt", F.lit(engine).alias("engine"))


def label_rules(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Facts after labels. A page with any fact gives a project; a person, a certificate, a device and a standard each
    give one more."""
    t = F.coalesce("text", F.lit(""))
    project, owner = after_label(t, "项目名称|工程名称"), after_label(t, "业主单位|建设单位|发包人")
    date = after_label(t, "签订日期|合同签订|签约日期", "([0-9]{4}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2})")
    amount = after_label(t, "合同金额|合同价|中标价", "([0-9,.]+\\s*(?:亿元|万元|万|元)?)")
    who, role = person(t), _found(t, ROLE)
    cert, device, standard = after_label(t, "资格证书|执业资格|证书"), after_label(t, "主要设备|设备名称|设备"), after_label(t, "执行标准|标准编号|标准")
    kv = voltage(t)
    any_fact = F.coalesce(project, owner, date, amount, kv.cast("string"), who, cert, device, standard).isNotNull()
    made = [
        ("project", any_fact, _data(project_name=project, owner_unit=owner, contract_sign_date=date, contract_amount_original=amount, contract_amount_rmb=amount_rmb(amount), voltage_level_kv=kv)),
        ("person", who.isNotNull(), _data(name=who, role=role, project_name=project)),
        ("qualification", cert.isNotNull(), _data(person_name=who, certificate=cert)),
        ("equipment", device.isNotNull(), _data(name=device, project_name=project)),
        ("standard", standard.isNotNull(), _data(standard_name=standard)),
    ]
    return _assets(pages, keys, made, "custom")


def pattern_rules(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Facts by shape: amounts, voltages, standards, certificates, clauses and persons anywhere in the text."""
    t = F.coalesce("text", F.lit(""))
    wan, kv, who = amount_wan(t), voltage(t), person(t)
    standard = F.nullif(F.upper(F.trim(F.regexp_extract(t, f"(?i){fixed.STANDARD}", 1))), F.lit(""))
    cert, clause = _found(t, fixed.CERTIFICATE), _found(t, fixed.CLAUSE)
    any_fact = F.coalesce(wan.cast("string"), kv.cast("string"), standard, cert, clause, who).isNotNull()
    made = [
        ("project", any_fact, _data(contract_amount_rmb=wan * 10000, voltage_level_kv=kv, certificate_no=cert, standard_no=standard, clause_no=clause)),
        ("person", who.isNotNull(), _data(name=who, role=_found(t, ROLE), certificate_no=cert)),
        ("standard", standard.isNotNull(), _data(standard_name=standard)),
    ]
    return _assets(pages, keys, made, "langextract")


def asset_identity() -> Column:
    core = F.when(F.col("asset_type") == "person", F.col("data.name")).when(F.col("asset_type") == "qualification", F.col("data.certificate")).when(F.col("asset_type") == "standard", F.col("data.standard_name")).otherwise(F.col("data.project_name"))
    return F.concat_ws("|", "asset_type", F.col("page_no").cast("string"), text.strip(core))


def hybrid(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Both engines' assets by identity: the first one's fields, gaps filled from the second, the longer excerpt."""
    def side(df: DataFrame, mark: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*keys, "_id").orderBy(F.desc("asset_no")))  # of equal ones the last stands
        one = df.withColumn("_id", asset_identity()).withColumn("_nth", nth).where("_nth = 1")
        return one.select(*keys, "_id", *[F.col(c).alias(f"{mark}_{c}") for c in ("page_no", "asset_no", "asset_type", "data", "source_excerpt")])

    both = side(first, "p").join(side(second, "s"), [*keys, "_id"], "full")
    data = F.struct(*[(F.coalesce(F.nullif(F.col(f"p_data.{k}"), F.lit("")), F.col(f"s_data.{k}")) if t == "string" else F.coalesce(f"p_data.{k}", f"s_data.{k}")).alias(k) for k, t in FIELDS.items()])
    longer = F.when(F.length(F.coalesce("p_source_excerpt", F.lit(""))) >= F.length(F.coalesce("s_source_excerpt", F.lit(""))), F.col("p_source_excerpt")).otherwise(F.col("s_source_excerpt"))
    engine = F.when(F.col("p_asset_type").isNull(), "langextract").when(F.col("s_asset_type").isNull(), "custom").otherwise("hybrid")
    order = F.when(F.col("p_asset_no").isNotNull(), F.col("p_asset_no")).otherwise(F.col("s_asset_no") + 1000)
    return both.select(*keys, F.coalesce("p_page_no", "s_page_no").alias("page_no"), order.alias("asset_no"), F.coalesce("p_asset_type", "s_asset_type").alias("asset_type"), data.alias("data"), longer.alias("source_excerpt"), engine.alias("engine"))


def extract(pages: DataFrame, engine: str = "custom", keys: tuple[str, ...] = ("doc_id", "version_id")) -> DataFrame:
    """engine: custom, langextract (pages without a pattern fact fall back to labels) or hybrid."""
    k = list(keys)
    if engine == "custom":
        return label_rules(pages, k)
    if engine == "langextract":
        found = pattern_rules(pages, k)
        return found.unionByName(label_rules(pages.join(found.select(*k, "page_no").distinct(), [*k, "page_no"], "left_anti"), k))
    if engine == "hybrid":
        return hybrid(label_rules(pages, k), pattern_rules(pages, k), k)
    raise ValueError(f"no such engine: {engine}")


def fact_text() -> Column:
    """An asset as a sentence; equipment has none."""

    def said(*parts: tuple[str, str, str]) -> Column:
        some = [F.when(F.nullif(text.strip(F.col(f"data.{f}").cast("string")), F.lit("")).isNotNull(), F.concat(F.lit(a), F.col(f"data.{f}").cast("string"), F.lit(z))) for a, f, z in parts]
        return F.concat_ws("；", *some)

    return (
        F.when(F.col("asset_type") == "project", said(("条款 ", "clause_no", ""), ("电压等级 ", "voltage_level_kv", "kV"), ("合同金额 ", "contract_amount_rmb", " 元"), ("标准号 ", "standard_no", ""), ("证书号 ", "certificate_no", "")))
        .when(F.col("asset_type") == "person", said(("人员 ", "name", ""), ("角色 ", "role", ""), ("证书号 ", "certificate_no", "")))
        .when(F.col("asset_type") == "qualification", said(("人员 ", "person_name", ""), ("资质证书 ", "certificate", "")))
        .when(F.col("asset_type") == "standard", said(("执行标准 ", "standard_name", "")))
        .otherwise("")
    )


def fact_chunks(assets: DataFrame, keys: tuple[str, ...] = ("doc_id", "version_id")) -> DataFrame:
    """Facts as chunks, each sentence once a page; numbers count all assets of the document."""
    doc = Window.partitionBy(*keys).orderBy("page_no", "asset_no")
    numbered = assets.withColumns({"_i": F.row_number().over(doc), "text": fact_text()}).where("text <> '' and page_no > 0")
    first = F.row_number().over(Window.partitionBy(*keys, "page_no", "text").orderBy("_i"))
    return numbered.withColumn("_nth", first).where("_nth = 1").select(*keys, F.concat(F.lit("fact_"), "_i").alias("chunk_id"), F.lit("structured_facts").alias("chapter_id"), F.col("page_no").alias("page_start"), F.col("page_no").alias("page_end"), "text", F.array().cast("array<string>").alias("block_ids"), F.lit("structured_fact").alias("source_type"), F.lit("structured").alias("page_type"), F.nullif(text.strip(F.col("data.clause_no")), F.lit("")).alias("clause_id"))


def page_spans(pages: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, page_no, start, stop): where each page lies in its document's pages joined by line feeds."""
    up_to = Window.partitionBy(*keys).orderBy("page_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length(F.coalesce("text", F.lit("")))
    return pages.select(*keys, "page_no", (F.sum(size + 1).over(up_to) - size - 1).alias("start"), (F.sum(size + 1).over(up_to) - 1).alias("stop"))


def page_of_offset(offsets: DataFrame, spans: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """offsets (keys, offset) with page_no: an equi-join on the document with a range test, else the last page."""
    last = spans.groupBy(*keys).agg(F.max("page_no").alias("_last"))
    inside = offsets.join(spans, list(keys), "left").where("offset >= start and offset <= stop").groupBy(*offsets.columns).agg(F.min("page_no").alias("_page"))
    return offsets.join(inside, offsets.columns, "left").join(last, list(keys), "left").select(*offsets.columns, F.coalesce("_page", "_last").alias("page_no"))
