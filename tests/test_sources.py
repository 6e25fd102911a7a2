"""Scans of files written for the test, of every kind, broken and empty ones included."""

import codecs

import pytest
from pyspark.sql import functions as F

from graphloom.sources import code, files, reports, xml_files

FORM = """<?xml version="1.0" encoding="UTF-8"?>
<Form xmlns="urn:form" xmlns:v8="urn:v8"><Events><Event name="OnOpen">ПриОткрытии</Event></Events>
<ChildItems><UsualGroup name="Группа" id="1"><ChildItems><InputField name="Поле" id="2"><DataPath>Объект.Цена</DataPath><ContextMenu name="Меню" id="9"/><Events><Event name="OnChange" callType="After">ПолеПриИзменении</Event></Events></InputField></ChildItems></UsualGroup><Button name="Кнопка" id="3"><CommandName>Form.Command.Печать</CommandName></Button></ChildItems>
<Attributes><Attribute name="Объект" id="1"><Type><v8:Type>cfg:CatalogObject.Товары</v8:Type></Type></Attribute></Attributes><Commands><Command name="Печать" id="1"><Action>Печать</Action></Command></Commands>{base}</Form>"""
BASE = """<BaseForm><ChildItems><UsualGroup name="Группа" id="7"/><InputField name="Старое" id="8"/></ChildItems><Attributes><Attribute name="Объект" id="5"><Type><v8:Type>cfg:CatalogObject.Иное</v8:Type></Type></Attribute></Attributes></BaseForm>"""


def given(spark, *rows):
    return spark.createDataFrame([(p, t, 1) for p, t in rows], "path string, text string, kind int")


def test_directory_scan_and_decoding(spark, tmp_path):
    made = {"src/A/Ext/Module.bsl": "Процедура А()".encode(), "src/Catalogs/T/Forms/F/Ext/Form.xml": codecs.BOM_UTF8 + "<Form/>".encode(), "Roles/R/Ext/Rights.xml": codecs.BOM_UTF16_LE + "<Rights/>".encode("utf-16-le"), "report.txt": "- Конфигурации.Ё №1".encode("cp1251"), "ConfigDumpInfo.xml": b"", "x/Help/ru.html": b"<p>", "EventSubscriptions/E.xml": b"<E/>", "note.md": b"", "C.xml": codecs.BOM_UTF16_BE + "<C/>".encode("utf-16-be")}
    for name, content in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = {r["path"].split(str(tmp_path) + "/")[1]: r["kind"] for r in files.tree(spark, str(tmp_path)).collect()}
    assert found == dict(zip(made, ["code", "form", "rights", "report", "dump_info", "help", "subscription", "other", "descriptor"]))
    texts = {r["kind"]: r["text"] for r in files.texts(spark, str(tmp_path)).collect()}
    assert texts["code"] == "Процедура А()" and texts["form"] == "<Form/>" and texts["rights"] == "<Rights/>" and texts["report"] == "- Конфигурации.Ё №1" and texts["descriptor"] == "<C/>"


def test_code_in_form_containers(spark):
    sizes = "0003a6b2 0003a6b2 7fffffff"
    rows = [("a", f"junk\r\nxx m\x00o\x00d\x00u\x00l\x00e\x00\r\n{sizes}\r\nПроцедура А()\x00\r\nКонецПроцедуры​\r\n{{1,2}}\r\nmore"), ("b", f"module\n{sizes}\nline\n{sizes}\nrest"), ("c", "no markers"), ("d", None), ("e", f"module\n{sizes}\n{{}}"), ("long", f"module\n{sizes}\n" + "А = 1;\n" * 50_000)]
    found = {r["path"]: r["c"] for r in given(spark, *rows).select("path", files.container_code(F.col("text")).alias("c")).collect()}
    assert found["a"] == "Процедура А()\nКонецПроцедуры" and found["b"] == "line" and found["c"] is None and found["d"] is None and found["e"] is None
    assert len(found["long"]) == 50_000 * 7 - 1


def test_descriptors(spark):
    text = """<MetaDataObject xmlns="urn:m" xmlns:v8="urn:v8"><Document><Properties><Name>Заказ</Name><Synonym><v8:item><v8:lang>en</v8:lang><v8:content>Order</v8:content></v8:item><v8:item><v8:lang>ru</v8:lang><v8:content>Заказ клиента</v8:content></v8:item></Synonym><Posting>Allow</Posting></Properties>
    <ChildObjects><Attribute><Properties><Name>Цена</Name><Type><v8:Type>xs:decimal</v8:Type><v8:Type>cfg:CatalogRef.Цены</v8:Type></Type></Properties></Attribute><TabularSection><Properties><Name>Товары</Name></Properties><ChildObjects><Attribute><Properties><Name>Товар</Name></Properties></Attribute></ChildObjects></TabularSection><Form>ФормаСписка</Form></ChildObjects></Document></MetaDataObject>"""
    found = [tuple(r)[1:] for r in xml_files.descriptors(given(spark, ("a", text), ("b", "<broken"), ("c", None), ("d", ""))).collect()]
    head = ("Document", "Заказ")
    assert found == [
        (*head, "property", None, "Synonym", [], "Заказ клиента"), (*head, "property", None, "Posting", [], "Allow"), (*head, "attribute", None, "Цена", ["decimal", "CatalogRef.Цены"], None),
        (*head, "tabular_part", None, "Товары", [], None), (*head, "tabular_attribute", "Товары", "Товар", [], None), (*head, "form", None, "ФормаСписка", [], None),
    ]
    assert {r["path"] for r in xml_files.broken(given(spark, ("a", text), ("b", "<broken"), ("c", None), ("d", ""))).collect()} == {"b", "c", "d"}


def test_forms_and_extension_forms(spark):
    rows = {(r["part"], r["name"]): r for r in xml_files.forms(given(spark, ("f", FORM.format(base="")))).collect()}
    assert rows["event", "OnOpen"]["value"] == "ПриОткрытии" and rows["event", "OnOpen"]["mark"] == "Main"
    assert (rows["control", "Поле"]["owner"], rows["control", "Поле"]["depth"], rows["control", "Поле"]["value"]) == ("Группа", 1, "Объект.Цена")
    assert (rows["control_event", "OnChange"]["owner"], rows["control_event", "OnChange"]["mark"]) == ("Поле", "After")
    assert rows["control", "Кнопка"]["position"] == 1 and rows["attribute", "Объект"]["value"] == "CatalogObject.Товары" and rows["command", "Печать"]["value"] == "Печать"
    assert ("control", "Меню") not in rows
    states = {(r["part"], r["name"]): r["state"] for r in xml_files.extension_forms(given(spark, ("f", FORM.format(base=BASE)), ("g", FORM.format(base="")))).collect()}
    assert states == {("control", "Группа"): "unchanged", ("control", "Старое"): "removed", ("control", "Поле"): "added", ("control", "Кнопка"): "added", ("attribute", "Объект"): "modified", ("command", "Печать"): "added"}


def test_deep_forms(spark):
    deep = "<Form>" + "".join(f'<ChildItems><Group name="g{i}" id="{i}">' for i in range(3_000)) + "</Group></ChildItems>" * 3_000 + "</Form>"
    assert xml_files.forms(given(spark, ("f", deep))).agg(F.max("depth")).first()[0] == 2_999


def test_canonical_text():
    a = xml_files.read('<a x="1" y="2" id="5"><b> t </b></a>')
    b = xml_files.read('<z:a xmlns:z="urn:z" y="2" id="6" x="1">\n<z:b>t</z:b>\n</z:a>')
    assert xml_files.digest(a) == xml_files.digest(b) != xml_files.digest(xml_files.read('<a x="1" y="3"><b>t</b></a>'))


def test_predefined_rights_subscriptions_listing(spark):
    items = '<PredefinedData><Item id="1"><Name>A</Name><IsFolder>true</IsFolder><ChildItems><Item id="2"><Name>B</Name><Code>7</Code></Item></ChildItems></Item><Item id="3"><Name>C</Name></Item></PredefinedData>'
    assert [(r["id"], r["parent_id"], r["depth"], r["name"], r["code"], r["is_folder"]) for r in xml_files.predefined(given(spark, ("p", items))).collect()] == [("1", None, 0, "A", None, True), ("2", "1", 1, "B", "7", False), ("3", None, 0, "C", None, False)]
    rights = "<Rights><object><name>Catalog.T</name><right><name>Read</name><value>true</value><restrictionByCondition><condition>Где 1</condition></restrictionByCondition></right><right><name>Edit</name><value>false</value></right></object></Rights>"
    assert [tuple(r)[1:] for r in xml_files.rights(given(spark, ("r", rights))).collect()] == [("Catalog.T", "Read", True, "Где 1"), ("Catalog.T", "Edit", False, None)]
    event = '<MetaDataObject xmlns:v8="urn:v8"><EventSubscription><Properties><Name>E</Name><Source><v8:Type>cfg:CatalogObject.T</v8:Type></Source><Event>BeforeWrite</Event><Handler>CommonModule.M.Proc</Handler></Properties></EventSubscription></MetaDataObject>'
    assert [tuple(r)[1:] for r in xml_files.subscriptions(given(spark, ("e", event))).collect()] == [("E", "BeforeWrite", "CommonModule.M.Proc", "Proc", ["CatalogObject.T"])]
    listing = xml_files.dump_listing(given(spark, ("d", '<ConfigDumpInfo><ConfigVersions><Metadata name="Catalog.T" id="g1"/><Metadata name="X"/></ConfigVersions></ConfigDumpInfo>')))
    nodes = spark.createDataFrame([("Catalog.T",), ("Catalog.U",)], "n string")
    assert sorted(tuple(r) for r in xml_files.with_ids(nodes, listing, "n").collect()) == [("Catalog.T", "g1"), ("Catalog.U", None)]


def test_reports():
    text = '- Конфигурации.X\n\tИмя: "X"\n\t- Справочники.Т\n\t\tПодсказка: "первая\n\t\t\tвторая"\n        Тип: "А"\n            "Б"\n\n\t- Справочники.У\n\t\tПусто:\n'
    assert list(reports.parse(text)) == [
        (1, None, 0, "Конфигурации.X", None, None), (2, 1, 1, None, "Имя", "X"), (3, 1, 1, "Справочники.Т", None, None), (4, 3, 2, None, "Подсказка", "первая\nвторая"), (6, 3, 2, None, "Тип", "А\nБ"),
        (9, 1, 1, "Справочники.У", None, None), (10, 9, 2, None, "Пусто", None),
    ]
    assert list(reports.parse(None)) == list(reports.parse("")) == []


def test_code_scan(spark):
    text = '#Область Внешняя\n#Область Внутренняя\n// Считает.\n// Дважды.\n&НаСервере\nАсинх Функция Сумма(А,\n\tБ = "Процедура В(") Экспорт\n\tВозврат А; // КонецФункции\nКонецФункции\n#КонецОбласти\nprocedure Second() endprocedure\n#КонецОбласти\nПроцедура Без()\n'
    found = [tuple(r) for r in code.modules(given(spark, ("m", text), ("n", None), ("o", ""))).collect()]
    assert [f[1:10] for f in found] == [
        ("Сумма", "Функция", True, 'А,\n\tБ = "Процедура В("', ["&НаСервере"], "Внешняя/Внутренняя", "// Считает.\n// Дважды.", 6, 9), ("Second", "procedure", False, "", [], "Внешняя", None, 11, 11), ("Без", "Процедура", False, "", [], None, None, 13, 13),
    ]
    assert found[0][10].startswith("Функция Сумма(") and found[0][10].endswith("КонецФункции") and len(found[0][11]) == 64


@pytest.mark.parametrize("text", ["Процедура " * 20_000, '"' * 100_001, "(" * 50_000 + "Функция Ф("])
def test_code_scan_ends_on_any_text(text):
    list(code.scan(text))
