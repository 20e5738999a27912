"""Answers from citations alone: which clauses a question is after, their fixed layout, and the prompt for a model.

What is special to one subject (installing electrical equipment) stands in INSTALLING, as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citelake.functions.fixed import CLAUSE_WORDS, DOUBTS, LISTING
from citelake.functions.terms import clause_tokens

from .evidence import VACUUM, _per_query, _SUB, best_text, clause_line, clause_weight, focus_terms, is_noise, match_text, number, part_rule, rank_clauses, rank_roots, stub_answer, text_of, word

@dataclass(frozen=True)
class Subject:
    """Rules for listings about one subject."""

    word: str
    roots: tuple[str, ...]
    required: tuple[str, ...]
    required_root: str
    anchor_root: str
    anchor_words: tuple[str, ...]
    narrow: tuple[str, ...]
    hints: tuple[tuple[str, ...], ...]
    before: tuple[str, ...]
    signals: tuple[str, ...]
    rules: tuple[str, ...]


INSTALLING = Subject(
    word="安装", roots=("3.0", "4.6", "4.8"), required=("3.0.6", "3.0.7"), required_root="3.0", anchor_root="4.8", anchor_words=("本体及附件安装",), narrow=("变压器", "电抗器", "互感器"),
    hints=(("内部安装、连接", "内部安装"), ("本体及附件安装", "附件安装", "冷却装置的安装", "套管的安装", "压力释放装置")),
    before=("施工前", "安装前", "投入运行前", "具备下列条件"), signals=("安装", "连接", "附件", "本体", "施工", "就位", "变压器"), rules=("应", "不得", "规定", "符合", "条文"),
)


def root_of(clause: str) -> str:
    return ".".join([p for p in _SUB.sub("", clause.strip()).split(".") if p][:2])


def in_family(clause: str, root: str) -> bool:
    return bool(clause and root) and (clause == root or clause.startswith((f"{root}.", f"{root}(")))


def is_listing(question: str) -> bool:
    return any(w in question.lower() for w in LISTING)


def named_clauses(question: str) -> list[str]:
    """Clauses a question names, unless it reports a failed look-up."""
    if any(w in question for w in DOUBTS):
        return []
    return list(dict.fromkeys(_SUB.sub("", c) for c in clause_tokens(question)))


def is_clause_question(question: str, rows: list[dict]) -> bool:
    return any(word(c, "clause_id") for c in rows) and (bool(clause_tokens(question)) or any(w in question for w in CLAUSE_WORDS))


def explains(c: dict) -> bool:
    return word(c, "source_type").lower() == "explanation" or word(c, "route").lower() == "explanation_sibling"


def _on_subject(question: str, s: Subject = INSTALLING) -> tuple[bool, bool]:
    """(whether the question is about the subject, and about its narrow part)."""
    on = s.word in question and not any(v in question for v in VACUUM)
    return on, on and any(w in question for w in s.narrow)


def _fits_subject(root: str, said: str, s: Subject = INSTALLING) -> bool:
    """Whether a root can hold the subject's rules, by its part of the standard and what it says."""
    told = (
        lambda: any(w in said for w in (*s.hints[0], *s.hints[1], *s.before)),
        lambda: any(w in said for w in s.signals) and any(w in said for w in s.rules),
    )
    holds = {"always": lambda: True, "never": lambda: False, "if told": lambda: not is_noise(said) and any(t() for t in told)}
    return root in s.roots or holds[part_rule(root).holds]()


def target_clauses(question: str, rows: list[dict], most: int = 3, s: Subject = INSTALLING) -> tuple[list[str], bool]:
    """(clauses or roots, whether they are roots): those named, else the strongest; for listings the best roots, led by
    roots that speak of the question's focus."""
    named = named_clauses(question)
    if named:
        return named, False
    ranked = rank_clauses(question, rows)
    if not ranked or not is_listing(question):
        return [c for c, _ in ranked[:1]], False
    roots = [r for r, _ in rank_roots(question, rows)]
    on, narrow = _on_subject(question, s)
    if not on:
        return roots[: max(2, most)], bool(roots)
    seen = list(dict.fromkeys(root_of(word(c, "clause_id")) for c in rows if word(c, "clause_id")))
    said = {r: [match_text(c, 900) for c in rows if in_family(word(c, "clause_id"), r)] for r in seen}
    whole = {r: "\n".join(t[:500] for t in x) for r, x in said.items()}
    usable = [r for r in seen if _fits_subject(r, whole[r], s) and (not narrow or r in s.roots)]
    focus = focus_terms(question)
    both = [r for r in usable if any(s.word in t and any(f in t for f in focus) for t in said[r])]
    focused = both or [r for r in usable if any(f in t for t in said[r] for f in focus)]
    out = focused[: max(2, most)] + [r for r in s.roots if r not in focused[: max(2, most)]]
    if not narrow:
        out += [r for hints in s.hints if (r := next((r for r in roots if any(h in whole.get(r, "") for h in hints)), None)) and r not in out]
    if not narrow and not focused:
        out += [r for r in roots if r not in out and _fits_subject(r, whole.get(r, ""), s)][: max(0, max(2, most) - len(out))]
    return list(dict.fromkeys(out)), True


class Picks:
    """Citations in order, none twice, preferably one a clause."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.keys: set = set()
        self.clauses: set = set()

    @staticmethod
    def key(c: dict) -> tuple:
        return tuple(word(c, k) for k in ("doc_name", "page_start", "page_end", "source_type", "clause_id", "table_id"))

    def is_new(self, c: dict) -> bool:
        return self.key(c) not in self.keys and word(c, "clause_id") not in self.clauses

    def take(self, c: dict | None, even_if_clause_is_there: bool = False) -> bool:
        if c is None or self.key(c) in self.keys or (not even_if_clause_is_there and word(c, "clause_id") in self.clauses):
            return False
        self.rows.append(c)
        self.keys.add(self.key(c))
        if word(c, "clause_id"):
            self.clauses.add(word(c, "clause_id"))
        return True


def _before(clause: str) -> tuple[int, ...] | None:
    """The number of the clause just before."""
    parts = [p for p in _SUB.sub("", clause).split(".") if p]
    if not parts or not all(p.isdigit() for p in parts) or int(parts[-1]) <= 0:
        return None
    return (*map(int, parts[:-1]), int(parts[-1]) - 1)


def _numbers(clause: str) -> tuple[int, ...] | None:
    parts = [p for p in _SUB.sub("", clause).split(".") if p]
    return tuple(map(int, parts)) if parts and all(p.isdigit() for p in parts) else None


def listing_order(question: str, clauses: list[dict], roots: list[str], most: int, s: Subject = INSTALLING) -> list[dict]:
    """For each root its strongest clause, with the clause before it and, on the subject, what must be met first; then the
    strongest of the rest."""
    on, narrow = _on_subject(question, s)
    by_weight = lambda rows: sorted(rows, key=lambda c: (-clause_weight(question, c, True), number(c, "page_start") or 0, word(c, "clause_id")))
    picks = Picks()
    for root in roots:
        family = by_weight(c for c in clauses if in_family(word(c, "clause_id"), root))
        if not family:
            continue
        if narrow and root == s.required_root:
            for clause in s.required:
                picks.take(next((c for c in family if word(c, "clause_id") == clause), None))
            if set(s.required) <= picks.clauses:
                continue
        first_choice = family
        if narrow and root == s.anchor_root:
            summaries = (c for c in family if word(c, "source_type").lower() == "section_summary")
            picks.take(next((c for c in summaries if word(c, "clause_id") == root or any(w in match_text(c, 800) for w in s.anchor_words)), None))
            first_choice = [c for c in family if s.word in match_text(c, 900)] or family
        best = next((c for c in first_choice if word(c, "source_type").lower() != "section_summary"), first_choice[0])
        if word(best, "clause_id") in picks.clauses:
            best = next((c for c in first_choice if word(c, "clause_id") and picks.is_new(c)), best)
        if not picks.take(best, even_if_clause_is_there=True):
            continue
        before = _before(word(best, "clause_id"))
        if before and not (narrow and root == s.required_root):
            picks.take(next((c for c in family if _numbers(word(c, "clause_id")) == before), None))
        if on:
            picks.take(next((c for c in family if word(c, "clause_id") not in picks.clauses and any(w in match_text(c, 800) for w in s.before)), None))
    for c in by_weight([c for c in clauses if word(c, "source_type").lower() != "section_summary"] or clauses):
        if len(picks.rows) >= most:
            break
        picks.take(c)
    return picks.rows


def distinct_lines(rows: list[dict], most: int, concise: bool, chars: int) -> list[str]:
    lines: dict[str, str] = {}
    for c in rows:
        line = clause_line(c, chars, concise)
        lines.setdefault("".join(line.split()), line)
    return list(lines.values())[:most]


def clause_answer(question: str, rows: list[dict], s: Subject = INSTALLING) -> str | None:
    """Clauses and their explanations in the fixed layout; None where the question does not ask for clauses."""
    if not is_clause_question(question, rows):
        return None
    named, listing = named_clauses(question), is_listing(question)
    if named:
        roots = list(dict.fromkeys(filter(None, map(root_of, named))))
    elif listing:
        roots = target_clauses(question, rows, s=s)[0]
    else:
        roots = [root_of(c) for c, _ in rank_clauses(question, rows)[:1]]
    scoped = [c for c in rows if not roots or any(in_family(word(c, "clause_id"), r) for r in roots)]
    focus = focus_terms(question)
    if listing and s.word in question and focus:
        met = any(s.word in (t := match_text(c, 1200)) and any(f in t for f in focus) for c in scoped)
        if not met and not any(root_of(word(c, "clause_id")) in s.roots for c in scoped if word(c, "clause_id")):
            topic = "、".join(focus[:2])
            return f"条文规定：\n1. 证据不足：当前检索结果未找到与“{topic}{s.word}”直接对应的条文证据。\n2. 建议：限定标准号或指定文档后重试，避免跨章节误命中。"
    scoped = scoped or rows
    notes, clauses = [c for c in scoped if explains(c)], [c for c in scoped if not explains(c)]
    chars = 320 if listing else 520
    if listing and roots:
        lines = distinct_lines(listing_order(question, clauses, roots, 6, s), 6, True, chars)
    else:
        lines = distinct_lines([c for c in clauses if word(c, "source_type").lower() != "section_summary"] or clauses or rows, 6 if listing else 5, False, chars)
    out = ["条文规定：", *(f"{i}. {x}" for i, x in enumerate(lines, start=1))]
    said = distinct_lines(notes, 5 if listing else 4, listing, chars)
    if said:
        out += ["", "条文说明：", *(f"{i}. {x}" for i, x in enumerate(said, start=1))]
    return "\n".join(out).strip()


def output_citations(question: str, rows: list[dict], most: int = 24) -> list[dict]:
    """The citations shown with a listing: those of its targets, strongest first."""
    if not is_listing(question):
        return rows
    roots, _ = target_clauses(question, rows)
    fit = [c for c in rows if word(c, "clause_id") and (not roots or any(in_family(word(c, "clause_id"), r) for r in roots)) and word(c, "source_type").lower() in ("text", "explanation", "section_summary") and not is_noise(match_text(c, 1200))]
    return sorted(fit, key=lambda c: (-clause_weight(question, c, True), number(c, "page_start") or 0, word(c, "clause_id"), word(c, "source_type")))[: max(8, most)]


def prompt(question: str, rows: list[dict]) -> str:
    """Evidence and rules for a model: at most six pieces."""
    lines = [f"[E{i}] {'条文说明' if word(c, 'source_type').lower() == 'explanation' else '条文正文'} | {text_of(c, 'doc_name') or 'unknown'} p.{number(c, 'page_start') or '-'}: {best_text(c, 220) or '（该页未提取到可读文本）'}" for i, c in enumerate(rows[:6], start=1)]
    rules = ["你是投标文档问答助手。必须仅基于证据回答，禁止编造。", "回答要求：", "1) 先给出直接答案（中文，1-3句，尽量具体到数值/条款/时间/主体）。", "2) 若证据不足，明确说明“证据不足”并指出缺什么信息。", "3) 不要输出与问题无关的泛化套话。", ""]
    if any(map(explains, rows)):
        rules.append("4) 若证据含“条文说明”，必须单列“条文说明”并给出对应解释要点。")
    return "\n".join([*rules, f"问题：{question}", "证据：", *(lines or ["（无可用证据）"])])


def answer(question: str, rows: list[dict]) -> str:
    """The fixed layout where it applies, else the evidence listed."""
    return (clause_answer(question, rows) or stub_answer(question, rows)) if rows else "未检索到可用证据，无法给出有引用支撑的回答。"


def answers(citations: DataFrame) -> DataFrame:
    """Citations with their question -> one answer a question."""
    return _per_query(citations, "query_id long, answer string, citations int", lambda q, rows: [{"answer": answer(q, rows), "citations": len(output_citations(q, rows))}])


#: Rows of an index that may stand beside a clause, and how many.
FAMILY_TYPES, FAMILY_ROWS, FAMILY_ROWS_LISTED = ("text", "explanation", "section_summary"), 12, 16


def family_targets(citations: DataFrame) -> DataFrame:
    """Citations with their question -> (query_id, target, root, family, doc, most): the clauses or roots whose other rows
    belong beside them, in the first cited document; nothing for questions that do not ask for clauses."""

    def each(question: str, rows: list[dict]) -> list[dict]:
        if not is_clause_question(question, rows):
            return []
        found, family = target_clauses(question, rows)
        doc = next((word(c, "doc_id") for c in rows if word(c, "doc_id")), None)
        most = FAMILY_ROWS_LISTED if is_listing(question) else FAMILY_ROWS
        return [{"target": t, "root": root_of(t), "family": family, "doc": doc, "most": max(3 * most, 36) if family else most} for t in found]

    return _per_query(citations, "query_id long, target string, root string, family boolean, doc string, most int", each)


def with_family(citations: DataFrame, rows: DataFrame) -> DataFrame:
    """Citations with the rows of their target clauses from the whole index (an equi-join on the clause's root): of a clause
    named, its own and what is below it; of a root, its whole section. Each place once, by clause, page and kind."""
    names = [c for c in citations.columns if c in rows.columns and c != "route"]
    root = F.array_join(F.slice(F.filter(F.split(F.regexp_replace(F.trim("clause_id"), r"\(.*$", ""), r"\."), lambda x: x != ""), 1, 2), ".")
    targets = family_targets(citations)
    met = rows.where(F.col("source_type").isin(*FAMILY_TYPES)).withColumn("root", root).join(targets, "root").where(F.col("doc").isNull() | (F.col("doc_id") == F.col("doc")))
    met = met.where((F.col("clause_id") == F.col("target")) | F.startswith("clause_id", F.concat("target", F.lit("."))) | F.startswith("clause_id", F.concat("target", F.lit("("))))
    nth = F.row_number().over(Window.partitionBy("query_id", "target").orderBy("page_start", "clause_id", "source_type", "chunk_text"))
    added = met.withColumn("nth", nth).where(F.col("nth") <= F.col("most")).select("query_id", *names, F.lit("clause_family").alias("route"))
    every = citations.withColumn("added", F.lit(0)).unionByName(added.withColumn("added", F.lit(1)), allowMissingColumns=True)
    place = Window.partitionBy("query_id", "doc_id", "page_start", "page_end", "source_type", "clause_id").orderBy("added", "rank", "chunk_text")
    kept = every.withColumns({"nth": F.row_number().over(place), "question": F.coalesce("question", F.first("question", ignorenulls=True).over(Window.partitionBy("query_id")))}).where("nth = 1 or added = 0")
    order = Window.partitionBy("query_id").orderBy(F.coalesce("clause_id", F.lit("")), F.coalesce("page_start", F.lit(0)), F.coalesce("source_type", F.lit("")), "added", "rank")
    return kept.withColumn("rank", F.row_number().over(order)).drop("nth", "added")


def search_depth(question: str, mode: str = "qa", scoped: bool = False) -> int:
    """How many hits a chat asks for."""
    k = 48 if is_listing(question) else 16
    k = max(k, 32) if scoped else k
    if mode == "constraint":
        k = max(k, 48 if scoped else 24)
    return k
