"""Patterns, word lists and limits that results depend on. They are given, not designed."""

# Identifiers in engineering documents (Java and Python read these patterns alike).
CLAUSE = r"(?<!\d)(\d{1,2}(?:\.\d+){1,4}(?:\([0-9A-Za-z]+\))?)(?!\d)"
STANDARD = r"(?<![A-Za-z0-9])((?:GB|DL/T|DL|NB/T|IEC|ISO)\s*[-A-Z]*\s*\d{2,6}(?:-\d{4})?)(?![A-Za-z0-9])"
CERTIFICATE = r"(?<![A-Z0-9])([A-Z]{1,6}(?:-[A-Z0-9]{1,10}){2,})(?![A-Z0-9])"
TOP_CLAUSE_START = r"^\s*(\d{1,2}(?:\.\d+){1,4}(?:\([0-9A-Za-z]+\))?)(?=\s|$|[:：])"
SUB_CLAUSE_START = r"^\s*[\(（]([0-9]{1,2})[\)）](?=\s|$|[:：])"
ITEM_START = r"^\s*([0-9]{1,2})[)）](?=\s|$|[:：])"
ITEM_SPACE_START = r"^\s*([0-9]{1,2})(?=\s|$|[:：])"
VOLTAGE = r"(\d{2,3})\s*(?:kV|KV|千伏)"
AMOUNT = r"([0-9]+(?:\.[0-9]+)?)\s*(亿|万|万元)"
MANDATORY_TEXT = r"(强制性条文|必须|不得|严禁|应当)"
MANDATORY_QUESTION = r"(强制性条文|强制条文|必须执行|一票否决|不得|必须)"
ROLES = ("项目经理", "技术负责人", "总工", "安全员", "质量员")

# Comparison words around a number, in order of precedence.
COMPARISONS = (
    ("gte", r"(不低于|不少于|至少|大于等于|>=|≥)"),
    ("lte", r"(不高于|不超过|至多|小于等于|<=|≤)"),
    ("gt", r"(高于|大于|>)"),
    ("lt", r"(低于|小于|<)"),
    ("eq", r"(等于|为)"),
)

# Query terms.
STOP_TERMS = ("哪些", "哪些规定", "有哪些", "有什么", "规定", "要求", "相关", "有关", "请问", "一下", "一下子", "说明", "什么", "怎么", "如何", "应当", "应该", "是否")
STOP_CHARS = "的了吗呢吧啊呀和及并且或与在对将把为于被就都与其"
CHAT_STOP_CHARS = "的了吗呢吧啊呀和及且或与在对将把为于被就都与其"
LISTING_HINTS = ("有哪些", "包括哪些", "包含哪些", "列出", "清单", "哪些要求", "what are", "which are", "list", "include")
TABLE_HINTS = ("表", "表格", "续表", "跨页", "行", "列", "参数表", "清单", "table", "rows", "columns", "schedule")
TABLE_UNITS = r"(?i)\d+(?:\.\d+)?\s*(kv|mva|kw|mw|v|a|hz|pa|mpa|mm|cm|m|km|℃|万元|万|亿|%|％)"
DOC_TYPE_HINTS = (
    ("规范规程", ("规范", "规程", "标准", "强制性条文", "国标", "gb", "dl/t", "nb/t", "iec", "iso")),
    ("投标文件", ("投标", "招标", "商务条款", "技术条款", "评标")),
    ("公司资质", ("公司资质", "企业资质", "许可证", "营业执照")),
    ("人员资质", ("人员资质", "项目经理证", "注册证", "职称")),
    ("公司业绩", ("公司业绩", "类似业绩", "合同业绩")),
    ("人员业绩", ("人员业绩", "个人业绩")),
)

# Classification of whole documents.
DOC_TYPE_KEYWORDS = (
    ("规范规程", ("规范", "规程", "标准", "条文", "术语", "总则")),
    ("投标文件", ("投标", "招标", "评标", "报价", "投标人")),
    ("公司资质", ("资质", "营业执照", "许可", "认证", "体系证书")),
    ("公司业绩", ("业绩", "项目", "中标", "合同", "竣工")),
    ("公司资产", ("资产", "设备清单", "固定资产", "产权", "库存")),
    ("人员资质", ("人员资质", "证书", "建造师", "执业", "岗位证")),
    ("人员业绩", ("项目经理", "负责人", "履历", "个人业绩", "任职")),
    ("优秀标书", ("优秀标书", "样板", "范本", "最佳实践")),
)

# Signs of readable text and of residue.
READABLE_MARKS = "，。！？；：、（）()[]【】《》“”‘’+-*/%=._:;,\"' \n\t"
RESIDUE = ("%pdf-", "obj<</filter/flatedecode", "endstream")
EVIDENCE_WORDS = r"(证书|合同|项目|业主|负责人|断路器|电容器|验收|规范|标准|适用范围|适用|术语|定义|总则)"
SHORT_CLAUSE_WORDS = r"(定义|术语|总则|适用范围|条文说明|强制性条文)"
TITLE_PATTERNS = (r"^第[一二三四五六七八九十0-9]+章", r"^[一二三四五六七八九十]+、", r"^[0-9]{1,2}\s+\S+", r"^\d+\.\d+")
LATEX_SYMBOLS = {"sim": "~", "times": "x", "cdot": "·", "leq": "<=", "geq": ">=", "pm": "±"}
CONTINUATION = r"(?i)^(续表(?:\s*\d+)?|continued(?:\s*table)?|cont\.)\s*[:：\-]?\s*"
CONTINUATION_WORDS = ("续表", "continued", "cont.")

# Statuses, categories and sources.
TABLE_ROW_TYPES = ("table_row", "cross_page_table_row")
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"

# Evidence and answers.
GUARDS = ("必须", "应当", "应", "不得", "严禁", "禁止", "方可", "只允许")
CONDITIONS = ("在", "当", "若", "如果", "前", "后", "时")
ARTIFACTS = ("标准分享网", "免费下载", "www.bzfxw.com", "bzfxw.com", "value of the article", "value of the product", "value of the power system")
LISTING_NOISE = ("统一书号", "定价", "印张", "印刷", "前言", "公告", "住房和城乡建设部")
VACUUM = ("真空", "注油", "抽真空", "氮气")
VACUUM_TEXT = ("真空", "注油", "抽真空", "氮气", "储油柜")
GENERIC_FOCUS = ("安装", "规定", "要求", "条文", "内容", "清单", "规范", "标准", "工程", "设备", "电器", "高压电器")
FOCUS_SUFFIXES = ("安装", "规定", "要求", "条文", "内容", "清单", "相关", "有关")
#: Cleaning steps for evidence, in order: pattern and replacement.
CLEANING = (
    (r"(?i)table\s+images/\S+", " "), (r"(?is)<table[^>]*>.*?</table>", " "), (r"<[^>]+>", " "), (r"\$[^$]{0,200}\$", " "), (r"\\[a-zA-Z]+\s*\{[^}]*\}", " "), (r"\\[a-zA-Z]+", " "), (r"[{}]", " "),
    (r"·\s*\d+\s*·", " "), (r"[：:]\s*\d+\s*·", " "), (r"(?i):\s*\d{1,3}\.\s*text\s*\d+", " "), (r"(?i)\btext\s+\d+\b", " "), (r"(?i)\btext\b", " "),
    (r"\b\d{1,2}\.\d{1,2}(?:\.\d+)?\s*[A-Za-z][^；。]{0,100}\(\d{1,3}\)", " "), (r"[.…]{2,}\s*\(?\d{1,3}\)?", " "), (r"(.{24,140}?)\s+\1", r"\1"), (r"[\x00-\x08\x0b-\x1f]", ""),
)
LISTING = ("有哪些", "包括哪些", "包含哪些", "列出", "清单", "哪些要求", "哪些规定")
DOUBTS = ("没查询到", "没有查询到", "回复", "还是", "但是", "却")
CLAUSE_WORDS = ("条文", "规定", "服从", "应符合")
#: Parts of a standard in questions about installing: first number, weight of a clause, weight of a root, whether its roots
#: hold rules.
INSTALL_PARTS = ((0, -3.0, -2.0, "never"), (3, 0.0, 1.5, "always"), (5, 0.0, 0.0, "always"), (10, -0.8, -1.0, "if told"))
