"""Cleaning, quality and hashing of text as Column functions.

All are built-in expressions but for NFKC, HTML tables and the short-line merge, which have no JVM
form, and the windows of the min-shingle hash; these run as Arrow-batched UDFs. Null text gives null, except where a docstring says otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from hashlib import md5

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lodewell.functions.tokens import let
from lodewell.lexicon import MODULES, SUBSYSTEMS, UNKNOWN_SUBSYSTEM
from lodewell.plans.storage import small_batches

#: Characters of standard Chinese punctuation.
CJK_PUNCT = "，。！？、；：“”‘’【】（）《》"
CJK = "\\x{4e00}-\\x{9fff}"
_ZERO_WIDTH = "​‌‍⁠﻿"
_QUOTES = {"‘": "'", "’": "'", "“": '"', "”": '"', "　": " ", " ": " "}
#: Forms that look like common characters: radicals, vertical forms and compatibility ideographs, by NFKC's own tables.
_FORMS = {chr(c): n for lo, hi in ((0x2E80, 0x2FD6), (0xFE10, 0xFE20), (0xFE30, 0xFE50), (0xF900, 0xFAFF)) for c in range(lo, hi) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n != chr(c)}
#: How list items begin.
LIST_START = r"^([0-9]+[.．、)]|[(（][0-9]+[)）]|[-*+•◦•‣⁃◦▪●])"


def _batched(f: Callable[[str], str], text: Column) -> Column:
    """f over every non-null text, in small Arrow batches; made when called, since workers import this module too."""
    if (spark := SparkSession.getActiveSession()) is not None:
        small_batches(spark)

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def normalize_nfkc(text: Column) -> Column:
    return _batched(lambda t: unicodedata.normalize("NFKC", t), text)


def normalize_forms(text: Column) -> Column:
    """Radicals, vertical forms and compatibility ideographs become the plain characters."""
    return F.translate(text, "".join(_FORMS), "".join(_FORMS.values()))


def remove_zero_width(text: Column) -> Column:
    return F.translate(text, _ZERO_WIDTH, "")


def normalize_punctuation(text: Column) -> Column:
    """Curly quotes become straight, ideographic and no-break spaces become blanks."""
    return F.translate(text, "".join(_QUOTES), "".join(_QUOTES.values()))


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_whitespace(text: Column) -> Column:
    """CR LF and CR become LF, runs of blanks one blank, three and more LF two; ends are trimmed."""
    for pattern, new in ((r"\r\n?", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, new)
    return _trim(text)


def remove_page_numbers(text: Column) -> Column:
    """Lines between others that hold a page number only go, every second of adjacent ones."""
    for pattern in (r"\n[0-9]+\n", r"\n第\s*[0-9]+\s*页?\n", r"(?i)\nPage\s*[0-9]+\n"):
        text = F.regexp_replace(text, pattern, "\n")
    return text


#: First and last lines that are headers or footers.
MARGINS = (r"^.{1,30}[页Pageg|]\s*[0-9]+.{0,10}$", r"^\s*[\x{4e00}-\x{9fa5}]{1,10}\s*$", r"^[0-9\-\s]+$")


def remove_headers_footers(text: Column) -> Column:
    """Of more than two lines, the first and the last go if they look like a header or footer."""
    lines = F.split(text, "\n", -1)

    def odd(line: Column) -> Column:
        found = F.lit(False)
        for m in MARGINS:
            found = found | _trim(line).rlike(m)
        return found

    n = F.size(lines)
    first, last = F.element_at(lines, 1), F.element_at(lines, -1)
    from_ = F.when(odd(first), 2).otherwise(1)
    kept = F.slice(lines, from_, F.when(odd(last), n - from_).otherwise(n - from_ + 1))
    return F.when(n <= 2, text).otherwise(F.array_join(kept, "\n"))


def remove_html_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


_TABLE = re.compile(r"<table[^>]*>.*?</table>", re.S | re.I)
_ROW = re.compile(r"<tr[^>]*>(.*?)</tr>", re.S | re.I)
_CELL = re.compile(r"<(t[hd])[^>]*>(.*?)</\1>", re.S | re.I)


def markdown_table(html: str) -> str:
    """A pipe table of the rows of an HTML table: a separator after the first row, nested tags removed."""
    rows = [[re.sub("<[^>]+>", "", cell).strip() for _, cell in _CELL.findall(row)] for row in _ROW.findall(html)]
    rows = [r for r in rows if r]
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join([lines[0], "|" + "|".join(["---"] * len(rows[0])) + "|", *lines[1:]]) if rows else ""


def tables_in(html: str) -> str:
    return _TABLE.sub(lambda m: markdown_table(m[0]), html)


def html_table_to_markdown(text: Column) -> Column:
    return _batched(tables_in, text)


_LIST = re.compile(LIST_START)


def merge_lines(lines: list[str], shortest: int = 20) -> list[str]:
    """Short lines take the next one to them, unless either is blank, a list item, or the line ends in a colon or comma."""
    out, held = [], None
    for line in map(str.strip, lines):
        if held is not None:
            if line and not _LIST.match(line):
                out.append(held + line)
                held = None
                continue
            out.append(held)
            held = None
        if line and not _LIST.match(line) and len(line) < shortest and not line.endswith((":", "：", "，", ",")):
            held = line
        else:
            out.append(line)
    return out + ([held] if held is not None else [])


def merged_text(text: str) -> str:
    return "\n".join(merge_lines(text.split("\n")))


def merge_short_lines(text: Column) -> Column:
    return _batched(merged_text, text)


def sanitize(text: Column) -> Column:
    """No byte-order marks and no control characters but tab, LF and CR; at most two LF together; trimmed."""
    text = F.regexp_replace(text, "[\\x{feff}\\x{fffe}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]", "")
    return _trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def clean(text: Column, structure: bool = True) -> Column:
    """The whole cleaning in its fixed order."""
    text = normalize_punctuation(remove_zero_width(normalize_forms(normalize_nfkc(text))))
    text = remove_page_numbers(normalize_whitespace(remove_html_tags(html_table_to_markdown(text))))
    return sanitize(merge_short_lines(remove_headers_footers(text)) if structure else text)


def clean_fast(text: Column) -> Column:
    """The part of the cleaning that stays in the JVM: everything but NFKC, HTML tables and line merging."""
    text = normalize_punctuation(remove_zero_width(normalize_forms(text)))
    return sanitize(remove_headers_footers(remove_page_numbers(normalize_whitespace(remove_html_tags(text)))))


def metadata(text: Column) -> Column:
    """Counts of characters and lines, and the first line as title if it has 5 to 50 characters."""
    first = _trim(F.element_at(F.split(text, "\n", -1), 1))
    title = F.when(F.length(first).between(5, 50), first)
    return F.struct(F.length(text).alias("char_count"), F.size(F.split(text, "\n", -1)).alias("line_count"), title.alias("title"))


def count_chars(text: Column, kind: str) -> Column:
    """Characters of a class, counted by taking runs of them out."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{kind}]+", ""))


def looks_corrupted(text: Column, threshold: float = 0.05) -> Column:
    """Whether control characters (x00-x1f, x80-xa0) are more than a share of the text; true for null and empty text."""
    bad = count_chars(text, "\\x00-\\x1f\\x80-\\xa0")
    return F.coalesce(F.when(F.length(text) > 0, bad / F.length(text) > threshold), F.lit(True))


def garbage_ratio(text: Column) -> Column:
    """Share of characters that are neither Chinese, printable ASCII nor standard punctuation; 1 for empty text."""
    n = F.length(text)
    good = count_chars(text, f"{CJK}\\x20-\\x7e{CJK_PUNCT}")
    return F.when(F.coalesce(n, F.lit(0)) == 0, 1.0).otherwise((n - good) / n)


def structure_score(text: Column) -> Column:
    """A fifth for each of: more than half of the lines blank, more than 30 % of them of one or two characters."""
    lines = F.split(text, "\n", -1)
    n = F.size(lines)
    blank = F.size(F.filter(lines, lambda x: F.length(_trim(x)) == 0))
    short = F.size(F.filter(lines, lambda x: F.length(_trim(x)).between(1, 2)))
    return (F.when(blank > n * 0.5, 1).otherwise(0) + F.when(short > n * 0.3, 1).otherwise(0)) / 5.0


def quality(text: Column, shortest: int = 20) -> Column:
    """struct(score, is_quality, garbage_ratio, structure, issues): 1 - 0.4 garbage - 0.2 structure - 0.1 if any issue."""
    n = F.length(text)
    share = lambda kind: F.when(n > 0, count_chars(text, kind) / n).otherwise(0.0)
    parts = F.struct(n.alias("n"), garbage_ratio(text).alias("garbage"), structure_score(text).alias("structure"), share(CJK).alias("chinese"), share("\\x20-\\x7e").alias("ascii"))

    def of(p: Column) -> Column:
        short, odd = p["n"] < shortest, (p["chinese"] < 0.05) & (p["ascii"] < 0.1)
        issues = F.array_compact(F.array(F.when(short, "too short"), F.when(p["garbage"] > 0.07, "high garbage ratio"), F.when(p["structure"] > 0, "bad structure"), F.when(odd & ~short, "low density")))
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - p["garbage"] * 0.4 - p["structure"] * 0.2 - F.when(F.size(issues) > 0, 0.1).otherwise(0.0)))
        return F.struct(score.alias("score"), ((score >= 0.6) & ~short).alias("is_quality"), p["garbage"].alias("garbage_ratio"), p["structure"].alias("structure"), issues.alias("issues"))

    return let(parts, of)


def garble_rate(text: Column) -> Column:
    """Control characters, runs of replacement characters (twice) and of question marks, in percent of the length."""
    hits = F.regexp_count(text, F.lit("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]")) + 2 * F.regexp_count(text, F.lit("\\x{fffd}+")) + F.regexp_count(text, F.lit("\\?{2,}"))
    return F.when(F.length(text) > 0, F.round(hits / F.length(text) * 100, 2)).otherwise(0.0)


def is_garbled_block(text: Column) -> Column:
    """Whether over 15 % of a block are radicals, compatibility ideographs or replacement characters."""
    odd = F.regexp_count(text, F.lit("[\\x{2e80}-\\x{2fdf}\\x{f900}-\\x{faff}\\x{fffd}]"))
    return F.coalesce(odd / F.nullif(F.length(text), F.lit(0)) > 0.15, F.lit(False))


def min_shingle_hash(text: Column, window: int = 50) -> Column:
    """The smallest md5 prefix of all windows of the lower-cased, space-folded text; short texts: md5 prefix of 12."""
    t = F.regexp_replace(F.lower(_trim(text)), r"\s+", " ")

    @F.pandas_udf("string")
    def least(texts: pd.Series) -> pd.Series:
        """In Arrow batches: built-in substrings count from the start of the text for each window; ASCII texts are cut as bytes."""
        def of(s: str) -> str:
            cut = s.encode() if s.isascii() else None
            best = b"\xff" * 16
            for lo in range(0, len(s) - window + 1, 65536):
                at = range(lo, min(lo + 65536, len(s) - window + 1))
                best = min(best, min([md5(cut[i : i + window]).digest() for i in at] if cut else [md5(s[i : i + window].encode()).digest() for i in at]))
            return best[:4].hex()

        return texts.map(lambda s: of(s) if s is not None and len(s) > window else None)

    return F.when(F.length(t) <= window, F.substring(F.md5(t.cast("binary")), 1, 12)).otherwise(least(t))


def edit_ratio(a: Column, b: Column, longest: int = 500) -> Column:
    """1 - edit distance / longer length, on lower-cased starts; 0 if one is empty or lengths differ by over half."""
    a, b = F.lower(F.substring(a, 1, longest)), F.lower(F.substring(b, 1, longest))
    m = F.greatest(F.length(a), F.length(b))
    far = F.abs(F.length(a) - F.length(b)) > m * 0.5
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(a == b, 1.0).when(far, 0.0).otherwise(1.0 - F.levenshtein(a, b) / m)


def scene(text: Column, words: tuple[str, ...] = ("场景", "使用", "触发", "条件", "何时", "适用")) -> Column:
    """100 characters from the first of the words that occurs; empty if none does."""
    found = [F.when(F.instr(text, w) > 0, F.substring(text, F.instr(text, F.lit(w)), F.lit(100))) for w in words]
    return F.coalesce(*found, F.lit(""))


#: Heading patterns with their levels, in order of trial.
HEADINGS = (
    (r"^第[一二三四五六七八九十百千]+[章节部分篇]", 0),
    (r"^[一二三四五六七八九十百千]+[、.．]", 0),
    (r"^[0-9]+[.．、]\s*(?=[\x{4e00}-\x{9fa5}])", 1),
    (r"^[0-9]+(?=[\x{4e00}-\x{9fa5}]{2,})", 1),
    (r"^[0-9]+\.[0-9]+\s*", 2),
    (r"^[A-Z][.．]\s*", 1),
    (r"^[A-Z]\.[0-9]+\s*", 2),
    (r"^#{1,6}\s*", 0),
    (r"^\[[0-9]+\]\s*", 1),
    (r"^\([0-9]+\)\s*", 1),
)


def heading(line: Column, longest: int = 20) -> Column:
    """struct(text, level) of the first heading pattern that the line begins with; null if none does."""
    line = _trim(line)
    out = F.lit(None).cast("struct<text:string,level:int>")
    for pattern, level in reversed(HEADINGS):
        text = F.substring(_trim(F.regexp_replace(line, pattern, "")), 1, longest)
        out = F.when(line.rlike(pattern), F.struct(text.alias("text"), F.lit(level).alias("level"))).otherwise(out)
    return out


def is_list_item(line: Column) -> Column:
    return _trim(line).rlike(r"^([•◦\-*+]|[0-9]+[.．)）]|[(（][0-9]+[)）])")


def truncate_node(title: Column, longest: int = 20) -> Column:
    return F.when(F.length(title) > longest, F.concat(F.substring(title, 1, longest), F.lit("..."))).otherwise(title)


def is_semantic_break(line: Column, words: tuple[str, ...] = ("条件", "机制", "规则", "逻辑", "说明", "场景")) -> Column:
    return (F.length(_trim(line)) < 30) & line.rlike("|".join(words))


def block_name(kind: Column, content: Column, name: Column, nth: Column) -> Column:
    """A name for a parsed block: by its table header, command code, heading or first line, else the old one."""
    text = _trim(content)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(_trim(x)) > 5)
    top = F.try_element_at(lines, F.lit(1))
    head = F.regexp_replace(heading(top)["text"], r"^[第0-9一二三四五六七八九十百千]+[章节部分篇]?\s*", "")
    first = F.regexp_replace(F.substring(F.coalesce(top, F.substring(text, 1, 30)), 1, 30), r"^[【\[]?\s*", "")
    table = F.regexp_extract(text, r"^[\x{4e00}-\x{9fa5}A-Za-z]+", 0)
    code = F.regexp_extract(text, "0x[0-9A-Fa-f]+", 0)
    other = F.when(F.length(head).between(4, 30), head).when(F.length(first).between(4, 25), first).otherwise(name)
    return F.when(F.length(text) == 0, name).when(kind == "table", F.when(table != "", F.substring(table, 1, 30)).otherwise(F.concat(F.lit("表格_"), nth.cast("string")))).when(kind == "command", F.when(code != "", F.concat(F.lit("命令_"), code)).otherwise(name)).otherwise(other)


def is_incomplete_name(name: Column) -> Column:
    return name.rlike(r"^(Section_[0-9]+|Table_[0-9]+|表格_[0-9]+|第?[0-9]*[章节部分篇]?)$") | ~F.length(name).between(4, 30)


def module_of(path: Column, content: Column) -> Column:
    """The first module whose words occur in the path or the text, else General."""
    out = F.lit("General")
    for name, words in reversed(MODULES):
        out = F.when(F.lower(path).rlike(words) | F.lower(F.coalesce(content, F.lit(""))).rlike(words), name).otherwise(out)
    return out


def _subsystem(path: Column, which: int) -> Column:
    out = F.lit(UNKNOWN_SUBSYSTEM[which])
    for part, *names in reversed(SUBSYSTEMS):
        out = F.when(F.lower(F.translate(path, "\\", "/")).contains(part), names[which]).otherwise(out)
    return out


def subsystem_of(path: Column) -> Column:
    """The subsystem of the first part that the path holds."""
    return _subsystem(path, 0)


def subsystem_context(path: Column) -> Column:
    return _subsystem(path, 1)


def with_context(content: Column, file_name: Column, module: Column) -> Column:
    """The block under a comment that names its module and file."""
    mark = F.when(module != "General", F.concat(F.lit("["), module, F.lit("]"))).otherwise("")
    return F.concat(F.lit("/* "), mark, F.lit(" "), file_name, F.lit(" */\n"), content)


def log_level(line: Column) -> Column:
    up = F.upper(line)
    return F.when(up.rlike("ERR|FAIL"), "ERROR").when(up.contains("WARN"), "WARN").when(up.rlike("DEBUG|DBG"), "DEBUG").otherwise("INFO")


def hex_fields(text: Column) -> Column:
    """Hex numbers that can be protocol fields: function codes, four digits and more, or known short codes."""
    found = F.regexp_extract_all(text, F.lit("0x[0-9A-Fa-f]{2,8}"), F.lit(0))
    return F.filter(found, lambda x: (F.length(x) >= 6) | x.isin("0x01", "0x02", "0x03", "0x04", "0x83", "0x96"))


def dp_ids(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?i)(?:dp_id|dp|数据点|功能点)[_\s]*([0-9]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def hex_bytes(text: Column) -> Column:
    """struct(byte_count, byte_values) of a hex string; both null if it is not one."""
    clean_ = F.regexp_replace(F.regexp_replace(text, " ", ""), "0x", "")
    ok = clean_.rlike("^([0-9A-Fa-f]{2})+$")
    values = F.transform(F.sequence(F.lit(1), F.length(clean_) - 1, F.lit(2)), lambda i: F.conv(F.substring(clean_, i, F.lit(2)), 16, 10).cast("int"))
    return F.struct(F.when(ok, (F.length(clean_) / 2).cast("int")).alias("byte_count"), F.when(ok, values).alias("byte_values"))


def json_in(text: Column) -> Column:
    """The outermost JSON object in noisy text, after thinking notes are taken out; null if there is none."""
    bare = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def image_description(width: Column, height: Column, context: Column, nth: Column) -> Column:
    """A label from size and nearby words: icons first, then the kind the words name, then the shape."""
    low, ratio = F.lower(F.coalesce(context, F.lit(""))), F.when(height > 0, width / height).otherwise(1.0)
    shape = F.when(ratio > 1.2, "横版").when(ratio < 0.8, "竖版").otherwise("方型")
    named = [("表格|table|参数", "参数对照表"), ("流程|flow", "流程图"), ("协议|protocol|命令|cmd", "协议示意图"), ("状态|state", "状态机图"), ("时序|sequence", "时序图"), ("帧|frame|packet", "数据帧格式图"), ("连接|connect|session", "连接示意图")]
    out = F.when((width > 0) & (height > 0) & ((width < 100) | (height < 100)), "图标/装饰图")
    for words, label in named:
        out = out.when(low.rlike(words), label)
    return out.when((width > 0) & (height > 0), F.concat(F.lit("图片"), (nth + 1).cast("string"), F.lit(" ("), shape, F.lit(", "), width.cast("string"), F.lit("×"), height.cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("图片"), (nth + 1).cast("string")))


def node_keywords(kind: Column, name: Column, has_params: Column) -> Column:
    return F.array_join(F.array_compact(F.array(F.when(kind == "function", "function"), F.when((kind == "function") & has_params, "has_params"), F.when(kind == "variable", "variable"), F.coalesce(name, F.lit("")))), ",")


def code_to_business(text: Column, names: dict[str, str]) -> Column:
    """Code names put as business terms in one pass for each, comments dropped, white space folded."""
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")
    for name, term in names.items():
        text = F.regexp_replace(text, rf"(?i)\b{re.escape(name)}\b", term)
    return _trim(F.regexp_replace(text, r"\s+", " "))
