"""Routines with their documentation from small modules."""

import datetime

import pytest

from graphloom.llm.routines import description, documented_routines, parse_routines

AT = datetime.datetime(2024, 1, 1)
MODULE = """#Область Служебные
// Считает остатки по складу.
//
// Параметры:
//  Склад - СправочникСсылка.Склады
&НаСервере
Функция ОстаткиПоСкладу(Знач Склад = "Процедура Ложная()", // Функция Ещё()
\tДата) Экспорт
\tТекст = "ВЫБРАТЬ
\t|// Процедура ВСтроке()
\t|ИЗ Регистр";
\tВозврат Текст;
КонецФункции

// Stub
procedure Stub()
EndProcedure

// The comment of nothing, for a blank line follows.

Процедура БезОписания()
КонецПроцедуры
// Асинхронно получает курсы валют
Асинх Функция Курсы() КонецФункции
"""


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_headers_lines_and_bodies(end):
    text = "﻿" + MODULE.replace("\n", end)
    found = parse_routines(text)
    assert [(r.name, r.line_no) for r in found] == [("ОстаткиПоСкладу", 7), ("Stub", 16), ("БезОписания", 21), ("Курсы", 24)]
    assert text[found[0].start : found[0].end].startswith("Функция ОстаткиПоСкладу(") and text[found[0].start : found[0].end].endswith("КонецФункции")
    assert description(found[0].doc, found[0].name) == "Считает остатки по складу."
    assert description(found[1].doc, found[1].name) is None and found[2].doc == []


@pytest.mark.parametrize("doc", ["// ------", "// TODO: описать", "// 01.02.2024 Иванов", "// Процедура Проверить остатки", "// ПроверитьОстатки", "// А = Б + 1;", "// Описание", "// Параметры:\n// Склад - важный"])
def test_what_tells_nothing(doc):
    assert description(doc.split("\n"), "ПроверитьОстатки") is None


def test_current_rows_nulls_and_ties(spark):
    rows = [("m", MODULE, AT, 1), ("m", "// Старое описание модуля\nПроцедура Старая()\nКонецПроцедуры", AT - datetime.timedelta(days=1), 1), ("n", None, AT, 1), (None, MODULE, AT, 1), ("e", "", AT, 1), ("long", "// Длинный текст справки\nПроцедура Длинная()\n" + "А = 1;\n" * 20_000, AT, 1)]
    df = spark.createDataFrame(rows + rows[:1], "module_id string, source_text string, loaded_at timestamp_ntz, name int")
    found = {(r["module_id"], r["line_no"], r["name"]) for r in documented_routines(df).collect()}
    assert found == {("m", 7, "ОстаткиПоСкладу"), ("m", 24, "Курсы"), ("long", 2, "Длинная")}
    full = {r["name"]: r for r in documented_routines(df, full=True).where("module_id = 'm'").collect()}
    assert full["Курсы"]["body"] == "Функция Курсы() КонецФункции"
    assert documented_routines(df.where("false")).collect() == []


SCRIPT = """import x from "y"; // function hidden(
/**
 * Adds two prices with their taxes.
 * @param {number} a the first
 */
@cached("k")
export async function addPrices(a, b = ")", {c} = {}) {
  const f = `function no( {`; /* function never() { */
  if (a) { return "}"; }
  function inner(z) { return z; }
}

// TODO: describe
function stub() {}
// Formats the number of a ticket
// for letters.
function* tickets$(n) { yield n }
function open(
"""


def test_scripts():
    found = parse_routines(SCRIPT, "script")
    assert [(r.name, r.line_no, description(r.doc, r.name, "script")) for r in found] == [
        ("addPrices", 7, "Adds two prices with their taxes."), ("inner", 10, None), ("stub", 14, None), ("tickets$", 17, "Formats the number of a ticket\nfor letters."), ("open", 18, None),
    ]
    bodies = [SCRIPT[r.start : r.end] for r in found]
    assert bodies[0].startswith("function addPrices(") and bodies[0].endswith("return z; }\n}") and bodies[1] == "function inner(z) { return z; }" and bodies[3] == "function* tickets$(n) { yield n }"


@pytest.mark.parametrize("text", ["{" * 50_000, "/*" * 50_000, "function f(" * 5_000, "`" + "x" * 100_000, "@a\n" * 20_000])
@pytest.mark.parametrize("language", ["bsl", "script"])
def test_any_text_ends(text, language):
    parse_routines(text, language)
