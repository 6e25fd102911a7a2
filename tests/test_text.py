"""Text functions on small texts, the odd ones included."""

import html

import pytest
from pyspark.sql import functions as F

from graphloom.functions import predicates as P
from graphloom.functions import text as X


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r["v"] for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_html(spark):
    rows = ["<p>a&nbsp;&lt;b&gt;</p><script>x</script><!-- c -->d", "&#1078;&#x416;&mdash;&amp;lt;", "&unknown; &#xD800; &#0; & &;", None, "", "<style>\n.x{}</style >&laquo;q&raquo;", "plain"]
    assert values(spark, rows, X.html_text) == ["a <b> d", "жЖ—&lt;", "&unknown; &#xD800; &#0; & &;", None, "", "«q»", "plain"]
    assert values(spark, ["&eacute;&szlig;&#8364;&hellip;"], X.characters) == [html.unescape("&eacute;&szlig;&#8364;&hellip;")]


def test_splits_and_folds(spark):
    assert values(spark, ["ПолучитьHTMLТекст2Ё", "", None], X.word_split) == ["Получить HTMLТекст2Ё", "", None]
    assert values(spark, ["Ёлка_1-2 x"], X.folded) == ["елка12x"]
    assert values(spark, ["складами", "Дату", "цена_ми", "abcами", "ой"], X.stem) == ["склад", "дату", "ценам", "abcами", "ой"]


def test_params(spark):
    assert values(spark, ['А, Знач Б = "x,y(", В = Новый(1, 2)', "", None], X.split_params) == [["А", 'Знач Б = "x,y("', "В = Новый(1, 2)"], [], None]
    facts = values(spark, ['Знач Б = "x"', "А"], X.param_facts)
    assert [(f["name"], f["by_value"], f["default"]) for f in facts] == [("Б", True, '"x"'), ("А", False, None)]


def test_sections(spark):
    (s,) = values(spark, ["// Считает.\n// Долго.\n// Параметры:\n//  А - число\n// Возвращаемое значение:\n//  Число"], X.doc_sections)
    assert s["description"] == "Считает.\nДолго." and s["params"] == "А - число" and s["returns"] == "Число"
    (n,) = values(spark, ["Параметры:\nА"], X.doc_sections)
    assert n["description"] is None and n["params"] == "А" and n["returns"] is None


def test_queries_in_code(spark):
    code = 'А = "ВЫБРАТЬ\n\t|Т.Имя КАК ""Имя""\n|ИЗ Т"; Б = "Нет ВЫБРАТЬ"; В = "select 1; выбрать 2 объединить все выбрать 3";'
    (found,) = values(spark, [code], X.embedded_queries)
    assert found == ['ВЫБРАТЬ\nТ.Имя КАК "Имя"\nИЗ Т', "select 1; выбрать 2 объединить все выбрать 3"]
    assert values(spark, [found[1]], X.query_parts) == [["select 1", "выбрать 2", "выбрать 3"]]


def test_types(spark):
    assert values(spark, ["CatalogRef.Т", "СправочникСсылка.Т", "string", "DocumentObject.Д.х", "Unknown.X"], X.russian_type) == ["СправочникСсылка.Т", "СправочникСсылка.Т", "Строка", "ДокументОбъект.Д.х", "Unknown.X"]
    assert values(spark, ["Массив из СправочникСсылка.Т", "Array<Строка(10)|Число>", "Дата", ""], X.unwrapped) == [["СправочникСсылка.Т"], ["Строка", "Число"], ["Дата"], []]
    assert values(spark, ["СправочникСсылка.Б|Строка|СправочникСсылка.А|ДокументСсылка.Д"], lambda c: X.short_union(F.split(c, r"\|"))) == ["СС.(Б|А)|ДС.Д|С"]


@pytest.mark.parametrize("size", [10, 300_000])
def test_long_texts_do_not_overflow(spark, size):
    text = 'Если А Тогда "' + "x" * size + '""' + "(" * size + "\n//" + "'" * size
    for f in (X.code_facts, X.called_names, X.string_literals, X.split_params, X.embedded_queries, X.segments, X.tokens, X.html_text, X.doc_sections, X.quoted):
        assert len(values(spark, [text], f)) == 1


def test_categories_and_policies():
    assert P.canonical_categories(["catalogs", "Общий модуль", "регистры", "нет", "Document"]) == ["Справочники", "ОбщиеМодули", "РегистрыСведений", "РегистрыНакопления", "Документы"]


@pytest.mark.parametrize("piece", [1, 3, 4_096])
def test_number_runs_at_any_piece(spark, monkeypatch, piece):
    from graphloom.operators import relations as R

    monkeypatch.setattr(R, "RUN_PIECE", piece)
    rows = [("a", n) for n in (1, 2, 3, 3, 5, 7, 8, -1, 0, 10_000, 10_001, None)] + [("b", 4)]
    df = spark.createDataFrame(rows, "g string, n int")
    found = {r["g"]: r["t"] for r in R.runs_text(R.number_runs(df, ["g"], "n"), ["g"], "t").collect()}
    assert found == {"a": "-1..3|5|7..8|10000..10001", "b": "4"}
    assert values(spark, ["x"], lambda c: X.number_ranges(F.array(F.lit(3), F.lit(1), F.lit(2), F.lit(7)))) == ["1..3|7"]
