"""Text functions as Columns. `(?U)` makes Java's classes Unicode-aware; lengths are code points."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


#: What (?U)\s matches; runs of it that are not one plain space already. Patterns here leave ordinary text without a match, since
#: each match costs far more than the characters between.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = r"(?U)\s(?:(?<! )\s*|\s+)"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(WHITE))


def single_spaced(c: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(c, _RUN, " ")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; ends are stripped."""
    return strip(single_spaced(F.coalesce(c, F.lit(""))))


def without_space(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")


def closed_up(c: Column) -> Column:
    """White space between letters or digits goes, as recognised Chinese wants; what is left of it is squeezed."""
    word = "[\u4e00-\u9fffA-Za-z0-9]"
    return squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?U)(?<={word})\s+(?={word})", ""))


def excerpt_at(c: Column, query: Column, limit: int = 220) -> Column:
    """limit characters of a closed-up text, opening a third of that before the first place of the query, else at its start."""
    body, asked = closed_up(c), closed_up(query)
    at = F.when(asked != "", F.position(F.lower(asked), F.lower(body))).otherwise(0)
    return F.substring(body, F.greatest(at - limit // 3, F.lit(1)), F.lit(limit))


def quoted_class(chars: str) -> str:
    """A regex class body for these very characters."""
    return "".join("\\" + c if c in "\\]-[^&" else c for c in chars)


def contains_any(c: Column, words) -> Column:
    return reduce(Column.__or__, [F.contains(c, F.lit(w)) for w in words])


#: Letters and digits of ASCII one by one: in a class they are one table, which is asked before ranges and properties are.
PLAIN = string.ascii_letters + string.digits


def char_share(c: Column, body: str) -> Column:
    """Share of characters in a regex class; 0 for empty text."""
    t = F.coalesce(c, F.lit(""))
    return F.when(F.length(t) > 0, F.regexp_count(t, F.lit(f"[{body}]")) / F.length(t)).otherwise(F.lit(0.0))


def readable_ratio(c: Column, marks: str = fixed.READABLE_MARKS) -> Column:
    """Share of letters, digits and ordinary marks."""
    t = F.coalesce(c, F.lit(""))  # the others are counted, being few
    return F.when(F.length(t) > 0, (F.length(t) - F.regexp_count(t, F.lit(f"[{unreadable(marks)}]"))) / F.length(t)).otherwise(F.lit(0.0))


def unreadable(marks: str = fixed.READABLE_MARKS) -> str:
    """A regex class body for all but letters, digits and marks, which settles the commonest of these first."""
    common = PLAIN + "".join(c for c in " .," if c in marks)
    return f"[^{common}]&&" + r"[^\p{L}\p{N}" + quoted_class(marks) + "]"


def cjk_ratio(c: Column) -> Column:
    return char_share(c, "一-鿿")


def printable(c: Column) -> Column:
    """Without control characters other than tab and line feed."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0b-\x1f]", "")


def lines(c: Column) -> Column:
    """Stripped non-empty lines."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1), strip), lambda x: x != "")


def without_latex(c: Column) -> Column:
    """Formula residue removed: commands with an argument leave the argument (its unit-like pieces closed up), known
    symbols become characters, and numbers are set apart from units. Texts without a backslash skip the command rules."""
    unit = r"A-Za-z0-9%°Ωμµ./:+\-~"
    plain = F.replace(F.coalesce(c, F.lit("")), F.lit("$"), F.lit(" "))
    t = F.regexp_replace(plain, r"\\{2,}(?=[A-Za-z])", r"\\")
    opened = r"(?<=\\[A-Za-z]{1,40}\s{0,4}\{[" + unit + r"\s]{0,120})"
    t = F.regexp_replace(t, opened + r"\s+(?=[" + unit + r"\s]{0,120}\})", "")
    for name, sign in fixed.LATEX_SYMBOLS.items():
        t = F.regexp_replace(t, rf"(?i)\\{name}\s*\{{\s*\}}", sign)
    t = F.regexp_replace(t, r"\\[A-Za-z]+\s*\{\s*([^{}]{0,120}?)\s*\}", "$1")
    for name, sign in fixed.LATEX_SYMBOLS.items():
        t = F.regexp_replace(t, rf"\\{name}\b", f" {sign} ")
    t = F.regexp_replace(t, r"\\[A-Za-z]+", " ")
    t = F.when(F.contains(plain, F.lit("\\")), t).otherwise(plain)
    t = F.replace(F.replace(t, F.lit("{"), F.lit(" ")), F.lit("}"), F.lit(" "))
    return F.regexp_replace(t, r"\d(?=[A-Za-zμµΩ%°])", "$0 ")


def clean_block(c: Column) -> Column:
    return squeeze(printable(without_latex(c)))


def clean_table(c: Column) -> Column:
    return F.array_join(F.transform(lines(printable(without_latex(c))), squeeze), "\n")


def repeat_signature(c: Column, cleaned: bool = False) -> Column:
    """What stays the same when a header is repeated: lower case, no digits, word characters only."""
    return F.regexp_replace(F.lower(c if cleaned else clean_block(c)), r"(?U)[\d\s\W_]+", "")


def is_toc_like(c: Column, cleaned: bool = False) -> Column:
    """cleaned: c is clean_block() of something. Patterns are asked where a sign is there that they cannot do without."""
    s = c if cleaned else strip(c)
    refs = F.regexp_count(s, F.lit(r"[\(（]\s*\d{1,3}\s*[\)）]"))
    bracket = contains_any(s, ("(", "（"))
    return (
        (s == "")
        | F.contains(F.lower(s), F.lit("contents"))
        | (bracket & (refs >= 2) & (F.regexp_count(s, F.lit(r"\d+\.\d+(?:\.\d+)?")) >= 2))
        | ((F.length(s) <= 100) & bracket & (refs >= 1) & s.rlike(r"^\d+(?:\s|[.、])"))
        | (contains_any(s, ("..", "…")) & s.rlike(r"[.…]{2,}\s*[\(（]?\s*\d{1,3}\s*[\)）]?\s*$"))
    )


#: A regex class body: neither letters, digits nor white space.
SYMBOLS = f"[^{PLAIN} ]&&" + r"[^\p{L}\p{N}\s\x85\xa0\u2000-\u200a\u3000]"


def is_low_quality(c: Column, cleaned: bool = False) -> Column:
    """Nothing, file residue, or mostly symbols; rows of tables are spared. cleaned: c is clean_block() of something."""
    s = c if cleaned else clean_block(c)
    low = F.lower(s)
    bad = contains_any(low, ("%pdf-", "endstream")) | ((F.length(s) > 80) & (char_share(s, SYMBOLS) > 0.45))
    return (s == "") | (~(F.contains(s, F.lit("|")) & s.rlike("[A-Za-z0-9一-鿿]")) & bad)


def is_noisy(c: Column) -> Column:
    """Residue of files, dense formulas or unreadable long text."""
    s = strip(c)
    commands = F.when(F.contains(s, F.lit("\\")), F.regexp_extract_all(s, F.lit(r"\\[A-Za-z]+"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    density = F.aggregate(commands, F.lit(0), lambda a, x: a + F.length(x)) / F.greatest(F.length(s), F.lit(1))
    bare = F.regexp_replace(s, r"\\[A-Za-z]+\s*(?:\{[^{}]{0,40}\})?", " ")
    formulas = (F.size(commands) >= 4) & (F.length(s) >= 80) & ((density >= 0.10) | (readable_ratio(bare) < 0.45))
    return (s == "") | contains_any(F.lower(s), fixed.RESIDUE) | formulas | ((F.length(s) >= 120) & (readable_ratio(s) < 0.5))


def is_noisy_row(c: Column) -> Column:
    """A table row most of whose cells are noise."""
    cells = F.filter(F.transform(F.split(strip(c), r"[|｜\t]", -1), strip), lambda x: x != "")
    bad = F.size(F.filter(cells, is_noisy))
    return is_noisy(c) | ((F.size(cells) > 0) & (bad >= F.greatest(F.lit(2), F.size(cells) - 1)))


def has_evidence(c: Column) -> Column:
    t = F.coalesce(c, F.lit(""))
    return t.rlike(r"(?U)\b\d+\.\d+(?:\.\d+)?\b") | t.rlike(r"(?i)\d+\s*(?:kV|千伏|MVA|万元|万|亿)") | t.rlike(fixed.EVIDENCE_WORDS)


def is_short_clause(c: Column) -> Column:
    s = strip(c)
    return s.rlike(fixed.CLAUSE) | s.rlike(fixed.SHORT_CLAUSE_WORDS)


def html_to_text(c: Column) -> Column:
    """Closing blocks break words, other tags are spaces, white space is squeezed."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)</(?:p|div|tr|li|h[1-6]|table)>|<br\s*/?>", "\n")
    return squeeze(F.regexp_replace(t, r"<[^>]+>", " "))


def excerpt(c: Column, limit: int = 200) -> Column:
    """A snippet without image references and tags."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)table\s+images/\S+", " ")
    return F.substring(squeeze(F.regexp_replace(t, r"<[^>]+>", " ")), 1, limit)


def sentences(c: Column) -> Column:
    """Stripped sentences; a full stop inside a clause number never ends one."""
    return F.filter(F.transform(F.split(strip(c), r"(?<=[。！？；;!?\n])", -1), strip), lambda x: x != "")


def packed_sentences(c: Column, max_chars: int, overlap: int) -> Column:
    """Sentences packed into pieces of at most max_chars where they fit, each piece after the first opening with the last
    `overlap` characters of the one before."""
    raw = strip(c)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, s: Column) -> Column:
        tail = F.when(F.length(state["open"]) > overlap, F.substring(state["open"], -overlap, overlap)).otherwise(state["open"]) if overlap > 0 else F.lit("")
        fits = (state["open"] == "") | (F.length(state["open"]) + F.length(s) <= max_chars)
        return F.struct(F.when(fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["open"]))).alias("done"), F.when(fits, F.concat(state["open"], s)).otherwise(F.concat(tail, s)).alias("open"))

    packed = F.aggregate(sentences(raw), start, step, lambda s: F.filter(F.concat(s["done"], F.array(s["open"])), lambda x: x != ""))
    return F.when(F.length(raw) <= max_chars, F.filter(F.array(raw), lambda x: x != "")).otherwise(packed)


def redact(c: Column) -> Column:
    """Phone numbers, e-mail addresses and identity-card numbers masked."""
    t = F.regexp_replace(c, r"(?<!\d)1[3-9]\d{9}(?!\d)", "[PHONE]")
    t = F.regexp_replace(t, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")
    return F.regexp_replace(t, r"(?U)\b\d{17}[\dXx]\b", "[IDCARD]")


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a literal term."""
    return F.when(F.length(term) > 0, (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).otherwise(F.lit(0.0))


def window_around(text: Column, needle: Column, chars: int) -> tuple[Column, Column]:
    """(before, after): at most chars characters on either side of the first occurrence; empty without one."""
    at = F.position(needle, text)
    start = F.greatest(at - chars, F.lit(1))
    before = F.when(at > 0, F.substring(text, start, at - start)).otherwise("")
    after = F.when(at > 0, F.substring(text, at + F.length(needle), F.lit(chars))).otherwise("")
    return before, after


def stable_hit_id(route: Column, doc_id: Column, page: Column, body: Column) -> Column:
    digest = F.substring(F.sha2(F.concat_ws("|", route, doc_id, page.cast("string"), body), 256), 1, 12)
    return F.concat_ws(":", route, doc_id, page.cast("string"), digest)


def name_id(kind: Column, name: Column, namespace: str = fixed.DNS_NAMESPACE) -> Column:
    """Deterministic entity id: the kind and the first 16 digits of the version-5 UUID of `kind:name`."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(F.concat_ws(":", kind, name), "UTF-8")))
    return F.concat(kind, F.lit("_"), F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3))
