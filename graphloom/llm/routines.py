"""Procedures and functions paired with their documentation.

Method: a packrat parsing-expression grammar of the language recognises strings, comments, directives and
routine headers with their source offsets; its actions emit (documentation, routine) pairs, which are then
filtered by whether the documentation tells anything.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.peg import Parser, choice, opt, plus, rule, rx, seq

# White space within a line, and characters that show nothing.
_BLANK = r"(?:[^\S\r\n]|[﻿​-‏⁠-⁤­᠎])"
_NEWLINE = r"(?:\r\n|\r|\n)"
# Keywords of the language, Russian and English.
_OPEN = r"(?:процедура|функция|procedure|function)\b"
_CLOSE = r"(?:конецпроцедуры|конецфункции|endprocedure|endfunction)\b"
_ASYNC = r"(?:асинх|async)\b"
_WORD = r"[^\W\d]\w*"

_LINE_END = re.compile(_NEWLINE)


class _Bsl:
    """The grammar of modules with Russian or English keywords, as far as routines and what may hide them need it."""

    newline = rx(_NEWLINE)
    comment = rx(r"//[^\r\n]*")
    comment_line = rx(rf"{_BLANK}*//[^\r\n]*{_NEWLINE}")
    string = rule(rx(rf'"(?:[^"\r\n]|""|{_NEWLINE}(?:{_BLANK}*//[^\r\n]*{_NEWLINE}|{_BLANK}*{_NEWLINE})*+{_BLANK}*\|)*+"?'))
    date = rx(r"'[^'\r\n]*'?")
    preprocessor = rx(rf"{_BLANK}*#[^\r\n]*")
    directive = seq(rx(rf"{_BLANK}*&{_BLANK}*{_WORD}{_BLANK}*"), opt(seq(rx(rf"\({_BLANK}*"), string, rx(r"[^)\r\n]*\)"))), rx(rf"{_BLANK}*(?://[^\r\n]*)?{_NEWLINE}?"))
    run = rule(plus(comment_line))
    directives = rule(plus(directive))
    gap = rx(rf"(?:{_BLANK}|{_NEWLINE}|//[^\r\n]*)+")
    lead = rx(rf"{_BLANK}*(?:{_ASYNC}{_BLANK}+)?(?={_OPEN})")
    kind = rx(_OPEN)
    name = rx(_WORD)
    params = rx(rf"(?:{_BLANK}|{_NEWLINE}|//[^\r\n]*)*\(")
    header = rule(seq(lead, kind, gap, name, params))
    documented = seq(opt(run), opt(directives), header)
    close = rx(_CLOSE)
    code = rx(rf"(?:(?!{_OPEN}|{_CLOSE}|{_ASYNC}){_WORD}(?:{_BLANK}*\.{_BLANK}*{_WORD})*+|\.{_BLANK}*{_WORD}|\d\w*|[^\w\"'/\r\n]|/(?!/))++")
    plain = choice(comment, string, date, code, newline)
    at_line = choice(run, directives, preprocessor)
    may_open = re.compile(rf"{_BLANK}*(?://|&|{_OPEN}|{_ASYNC})", re.I).match


    #: What stands before the words of a documentation line; None: where a routine ends is told by its end keyword.
    margin = re.compile(rf"^{_BLANK}*/+")
    body = None


def _block(p: Parser, at: int) -> int:
    """The end of the braces that open after the rest of a parameter list; literals and comments hide braces. No recursion, whatever the depth."""
    depth, opened = 1, ["("]
    for m in _SCRIPT_PART.finditer(p.text, at):
        mark = m.group()
        if mark in "([{":
            opened.append(mark)
        elif mark in ")]}" and opened:
            was = opened.pop()
            if not opened:
                if was == "{":
                    return m.end()
                depth = 0
        elif mark == ";" and not opened and depth == 0:
            return m.end()
    return -1


_SCRIPT_TEXT = r"""(?:"(?:[^"\\\r\n]|\\.)*"?|'(?:[^'\\\r\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?)"""
_SCRIPT_COMMENT = r"(?://[^\r\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/)?)"
_SCRIPT_PART = re.compile(rf"{_SCRIPT_TEXT}|{_SCRIPT_COMMENT}|[()\[\]{{}};]", re.S)


class _Script:
    """The grammar of scripts with braces, as far as named functions, their comments and what may hide them need it."""

    newline = rx(_NEWLINE)
    comment = rx(_SCRIPT_COMMENT, re.S)
    string = rule(rx(_SCRIPT_TEXT, re.S))
    comment_line = rx(rf"{_BLANK}*//[^\r\n]*{_NEWLINE}", 0)
    doc_block = rx(rf"{_BLANK}*/\*\*(?:[^*]|\*(?!/))*\*/{_BLANK}*{_NEWLINE}", re.S)
    directive = rx(rf"{_BLANK}*@{_WORD}(?:\.{_WORD})*(?:\([^()\r\n]*\))?{_BLANK}*{_NEWLINE}", 0)
    run = rule(choice(doc_block, plus(comment_line)))
    directives = rule(plus(directive))
    lead = rx(rf"{_BLANK}*(?:export{_BLANK}+)?(?:default{_BLANK}+)?(?:async{_BLANK}+)?(?=function\b)", 0)
    kind = rx(r"function\b", 0)
    gap = rx(rf"(?:{_BLANK}|{_NEWLINE}|\*|{_SCRIPT_COMMENT})+", re.S)
    name = rx(r"[^\W\d][\w$]*", 0)
    params = rx(rf"{_BLANK}*\(", 0)
    header = rule(seq(lead, kind, gap, name, params))
    documented = seq(opt(run), opt(directives), header)
    close = rx(r"(?!)")
    code = rx(r"(?:(?!function\b|export\b|async\b)[^\W\d][\w$]*|\d\w*|[^\w\"'`/\r\n]|/(?![/*]))+", 0)
    plain = choice(comment, string, code, newline)
    at_line = choice(run, directives)
    may_open = re.compile(rf"{_BLANK}*(?://|/\*\*|@|export\b|default\b|async\b|function\b)").match
    margin = re.compile(rf"^{_BLANK}*(?:/\*\*+|\*+/|\*+|/+)|\*+/{_BLANK}*$")
    body = staticmethod(_block)


GRAMMARS = {"bsl": _Bsl, "script": _Script}


@dataclass
class Routine:
    kind: str
    name: str
    start: int
    line_no: int
    doc: list[str]
    end: int = -1


class _Lines:
    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in _LINE_END.finditer(text))]

    def number(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)


def parse_routines(text: str | None, language: str = "bsl") -> list[Routine]:
    """All routines of a module in order, with the comment lines that document them.

    Null and empty text have none. A routine whose end keyword is missing ends where the next one, or the
    text, begins or ends.
    """
    if not text:
        return []
    g, p, lines, found = GRAMMARS[language], Parser(text), _Lines(text), []
    at, size, line_start = 0, len(text), True

    def emit(begin: int) -> int:
        """Action of a recognised header that, with its documentation, begins at ``begin``."""
        after_run = g.run(p, begin) if line_start else -1
        doc_end = begin if after_run < 0 else after_run
        after_directives = g.directives(p, doc_end) if line_start else -1
        head = doc_end if after_directives < 0 else after_directives
        kind_at = g.lead(p, head)
        kind_end = g.kind(p, kind_at)
        name_at = g.gap(p, kind_end)
        name_end = g.name(p, name_at)
        doc = [x for x in _LINE_END.split(text[begin:doc_end])[:-1]] if doc_end > begin else []
        if found and found[-1].end < 0:
            found[-1].end = begin
        found.append(Routine(text[kind_at:kind_end], text[name_at:name_end], kind_at, lines.number(kind_at), doc))
        end = g.header(p, head)
        if g.body is not None:
            found[-1].end = g.body(p, end)
        return end

    while at < size:
        if line_start:
            if g.may_open(text, at):
                if g.documented(p, at) >= 0:
                    at, line_start = emit(at), False
                    p.commit()
                    continue
            end = g.at_line(p, at)
            if end > at:
                at, line_start = end, text[end - 1] in "\r\n"
                p.commit()
                continue
        if g.header(p, at) >= 0:
            at, line_start = emit(at), False
        else:
            end = g.close(p, at)
            if end > at:
                if found and found[-1].end < 0:
                    found[-1].end = end
            else:
                end = g.plain(p, at)
                if end <= at:
                    end = at + 1
            line_start = text[end - 1] in "\r\n" and text[at] in "\r\n"
            at = end
        p.commit()
    if found and found[-1].end < 0:
        found[-1].end = size
    return found


# Headings that end the description.
_SECTION = re.compile(r"(?i)^(?:(?:параметры|возвращаемое\s+значение)\s*:|@(?:param|returns?|throws|type)\b)")
_DATE = re.compile(r"\d{1,4}[./-]\d{1,2}[./-]\d{2,4}")
_TODO = re.compile(r"(?i)^\W*(?:todo|to\s?do|fixme|xxx|hack|тудо|доделать|дописать|переделать)\b")
_CODE = re.compile(
    r"""(?ix) ;\s*(?://.*)?$ | ^[\w.\[\]]+\s*=\s*\S | ^[\w]+(?:\.\w+)*\s*\(.*\)\s*\.?$ | ^[&\#~|]\s*\w |
    ^(?:если|иначеесли|if|elsif)\b.*\b(?:тогда|then)\s*$ | ^(?:пока|для|while|for)\b.*\b(?:цикл|do|loop)\s*$ |
    ^(?:процедура|функция|procedure|function)\s+\w+\s*\( |
    ^(?:конец(?:если|цикла|попытки|процедуры|функции)|end(?:if|do|try|procedure|function)|попытка|исключение|иначе|else|try|except|возврат|return|прервать|продолжить)\W*$"""
)
_WORDS = re.compile(r"[^\W\d_]+")
#: Words that by themselves tell nothing about a routine.
_STUB_WORDS = frozenset(
    """описание описания описать процедура процедуры функция функции метод метода краткое краткого подробное без нет не пусто комментарий комментария
    комментарии добавить вставить вставьте заполнить написать текст документация документации документировать отсутствует назначение заглушка здесь тут позже имя
    description describe descriptions procedure function routine method short brief no none insert add here comment comments text documentation
    document summary missing empty placeholder stub tbd na n a of the this for later name write is your goes nothing undocumented
    beschreibung keine kommentar""".split()
)
#: Words of change stamps.
_STAMP_WORDS = frozenset(
    """добавлено добавил добавила изменено изменил исправлено исправил создано создал удалено доработка доработано правка автор задача заявка версия начало конец от по г год
    added changed fixed modified created edited author task ticket issue version begin end by on date""".split()
)


def _letters(text: str) -> str:
    return "".join(_WORDS.findall(text)).casefold().replace("ё", "е") + "".join(re.findall(r"\d+", text))


def _tells_nothing(line: str, name: str) -> bool:
    words = [w.casefold() for w in _WORDS.findall(line)]
    if not words:
        return True  # rulings, marks, numbers
    if _TODO.search(line) or _CODE.search(line):
        return True
    rest = re.sub(r"\(.*?\)", "", line)
    rest = re.sub(r"(?i)^\W*(?:процедура|функция|метод|procedure|function|method|routine)\b", "", rest)
    if _letters(rest) in ("", _letters(name)) or _letters(line) == _letters(name):
        return True
    if _DATE.search(line) or re.match(r"\s*(?:\+\+|--|\(\+\)|\(-\))", line):
        left = [w for w in _WORDS.findall(_DATE.sub("", line)) if w.casefold() not in _STAMP_WORDS and len(w) > 3]
        if len(left) <= 1:
            return True
    return all(w in _STUB_WORDS for w in words)


def description(doc: list[str], name: str, language: str = "bsl") -> str | None:
    """The telling lines before the sections; None if there are none."""
    told = []
    for raw in doc:
        line = GRAMMARS[language].margin.sub("", raw)
        line = re.sub(rf"^{_BLANK}+|{_BLANK}+$", "", line)
        line = re.sub(r"[​-‏⁠-⁤­﻿]", "", line)
        if _SECTION.match(line):
            break
        if not _tells_nothing(line, name):
            told.append(line)
    return "\n".join(told) or None


_PAIR = "array<struct<line_no: int, name: string>>"
_FULL = "array<struct<line_no: int, name: string, kind: string, description: string, char_start: int, char_end: int, body: string>>"


def _documented(text: str | None, language: str, full: bool) -> list[dict]:
    out = []
    for r in parse_routines(text, language):
        told = description(r.doc, r.name, language) if r.doc else None
        if told is not None:
            row = {"line_no": r.line_no, "name": r.name}
            out.append(row | {"kind": r.kind, "description": told, "char_start": r.start, "char_end": r.end, "body": text[r.start : r.end]} if full else row)
    return out


def documented_routines(df: DataFrame, key: str = "module_id", text: str = "source_text", loaded: str = "loaded_at", language: str = "bsl", full: bool = False) -> DataFrame:
    """(key, line_no, name[, kind, description, char_start, char_end, body]) of each documented routine of the current modules.

    The current row of a key has the latest ``loaded``; a null time is the earliest, ties take the larger
    result. Offsets count code points of the text, ``char_end`` exclusive. Null or empty texts and texts
    without documented routines give no rows; rows with a null key are no module; extra columns are ignored.

    Scale: texts are parsed where they are read; only the pairs are shuffled, never whole modules.
    """
    kind = _FULL if full else _PAIR

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "loaded": b["loaded"], "pairs": [_documented(t, language, full) for t in b["text"]]})

    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(loaded).cast("timestamp_ntz").alias("loaded"), F.col(text).alias("text"))
    parsed = rows.mapInPandas(parse, f"key string, loaded timestamp_ntz, pairs {kind}")
    current = parsed.groupBy("key").agg(F.max(F.struct("loaded", "pairs")).alias("v"))
    return current.select(F.col("key").alias(key), F.explode("v.pairs").alias("p")).select(key, "p.*")
