"""Incremental maintenance equals full recomputation; epochs, counters, encoders and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from graphloom.functions import chunks
from graphloom.functions import text as X
from graphloom.operators import incremental as I
from graphloom.operators import retrieval, sinks
from graphloom.streaming import maintain

T = datetime.time


def test_windows_and_due_times():
    assert I.in_window(T(23), T(22), T(4)) and I.in_window(T(3), T(22), T(4)) and not I.in_window(T(4), T(22), T(4)) and I.in_window(T(5), T(1), T(1)) and not I.in_window(T(12), T(1), T(5))
    now = datetime.datetime(2024, 1, 2, 2)
    day = datetime.timedelta(days=1)
    assert not I.reconcile_due(None, now, day, T(0), T(0)) and I.reconcile_due(now - day, now, day, T(1), T(3)) and not I.reconcile_due(now - day / 2, now, day, T(1), T(3)) and not I.reconcile_due(now - day, now, day, T(3), T(4))


def test_epochs_resume_publish_and_clear(spark, tmp_path):
    e = sinks.Epochs(spark, str(tmp_path / "index"))
    assert e.begin("f1") == (1, False) and e.begin("f1") == (1, True)
    docs = spark.createDataFrame([(1, "один два два"), (2, None)], "id long, text string")
    sinks.write_index(docs, "id", X.tokens(F.col("text")), e.folder, 1)
    e.publish(1)
    with pytest.raises(RuntimeError):
        e.publish(1)
    assert e.begin("f2") == (2, False) and e.begin("f3") == (3, False)
    sinks.write_index(docs, "id", X.tokens(F.col("text")), e.folder, 3)
    e.publish(3)
    assert e.clear() == [1] and e.state()["read"] == 3
    read = spark.read.parquet(f"{e.folder}/epoch=3/frequencies")
    assert {r["token"]: (r["df"], r["occurrences"]) for r in read.collect()} == {"один": (1, 1), "два": (1, 2)}


def test_merged_nodes(spark):
    old = spark.createDataFrame([("a", "A", {"x": "1", "y": "2"})], "id string, name string, properties map<string,string>")
    new = spark.createDataFrame([("a", "Z", {"y": None, "z": "3"}, 1), ("a", "Q", {"z": "4"}, 2), ("b", "B", {}, 1)], "id string, name string, properties map<string,string>, ord long")
    assert {r["id"]: (r["name"], r["properties"]) for r in sinks.merged_nodes(old, new, "id", ["name"]).collect()} == {"a": ("A", {"x": "1", "z": "4"}), "b": ("B", {})}


def test_encoders(spark):
    df = spark.createDataFrame([(1, "a,b", None, True), (2, "plain", [1.5], False)], "i int, s string, v array<double>, f boolean")
    assert [r["value"] for r in sinks.as_json(df).collect()] == ['{"i":1,"s":"a,b","f":true}', '{"i":2,"s":"plain","v":[1.5],"f":false}']
    assert sinks.as_table(df.collect()) == 'rows[2]{i,s,v,f}:\n  1,"a,b",,true\n  2,plain,"1.5",false' and sinks.as_table([]) == "rows[0]:"
    names, rows = sinks.interned([{"qn": "project/config/a"}, {"qn": "project/config/a"}, {"qn": "x"}], ["qn"])
    assert names == {"@qn:1": "project/config/a"} and rows[0] == {"qn": "@qn:1"} and rows[2] == {"qn": "x"}
    assert sinks.fingerprint({"a": 1, "b": 2}) == sinks.fingerprint({"b": 2, "a": 1}) != sinks.fingerprint({"a": 1})


def test_streams_go_on_and_count_once(spark, tmp_path):
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    schema = "id string, v int, loaded_at timestamp_ntz"
    at = datetime.datetime(2024, 1, 1)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    parts = [[("a", 1, at), ("b", 1, at)], [("a", 2, at + datetime.timedelta(1)), ("c", 1, None)], [("a", 0, at - datetime.timedelta(1)), ("c", 5, at), (None, 9, at)]]
    got = []
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        got = {r["id"]: r["v"] for r in maintain.current_rows(stream(), "id", ["v"], work).collect()}
    assert got == {"a": 2, "b": 1, "c": 5}
    assert {r["id"]: r["v"] for r in maintain.current_rows(stream(), "id", ["v"], work).collect()} == got
    # A batch that is run again finds its version and changes nothing.
    versions = maintain.Versions(spark, f"{work}/state")
    last = versions.numbers()[-1]
    versions.write(last, versions.last().limit(0))
    assert versions.last().count() == 3


def test_signed_statistics_equal_a_full_count(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j:03d}" for j in range(i % 7, 12, i % 3 + 1))) for i in range(40)], "doc_id long, text string")
    posted = retrieval.postings(docs, "doc_id", X.tokens(F.col("text")))
    none = posted.where("false")
    state = I.contributions(posted.where("doc_id < 25"), none)
    state = I.applied(state, I.contributions(posted.where("doc_id >= 25"), posted.where("doc_id < 5")))
    want = retrieval.document_frequencies(posted.where("doc_id >= 5"))
    assert {tuple(r) for r in state.collect()} == {tuple(r) for r in want.collect()}


def test_stages(spark):
    items = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "k string, s string")
    made = spark.createDataFrame([("a", "1"), ("b", "0"), ("c", "1"), ("x", "1")], "k string, s string")
    assert {r["k"]: r["stage"] for r in I.stages(items, made, made.where("k = 'a'"), "k", "s").collect()} == {"a": "done", "b": "generate", "c": "embed", "d": "generate", "x": "remove"}


@pytest.mark.parametrize("text", ["", "x", "Первая строка.\n\nВторой абзац. Ещё фраза! " * 30, "слово " * 300, "я" * 2_000, "\n" * 500 + "конец"])
def test_chunks_cover_the_text(text):
    bare = text.strip()
    found = chunks.chunks_of(text, 200, 40, 10_000)
    assert (not bare) == (not found)
    if found:
        assert found[0][0] == 0 and found[-1][1] == len(bare) and all(0 < e - s <= 200 for s, e in found)
        assert all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(found, found[1:]))
    assert len(chunks.chunks_of(text, 200, 40, 2)) <= 2


def test_safe_ranges_end_outside_of_blocks():
    code = "\n".join(["Процедура А()", *(["Если Х Тогда", "\tА = 1;", "\tБ = 2;", "КонецЕсли;"] * 60), "КонецПроцедуры"])
    found = chunks.safe_ranges(code, 400, 60, 60)
    depths, starts, at = chunks.line_depths(code), {}, 0
    for line, depth in zip(code.split("\n"), depths):
        starts[at] = depth
        at += len(line) + 1
    assert found[0][0] == 0 and found[-1][1] == len(code) and all(b[0] <= a[1] for a, b in zip(found, found[1:]))
    assert all(starts[e] == 0 for _, e in found[:-1])


def test_compression():
    assert chunks.compressed("Если А Тогда\n\tБ.В(А); // Г\nКонецЕсли;\nБ.В(А, Д)") == "А\nБ.В\nД"
    assert chunks.compressed(None) is None and chunks.compressed("") == "" and chunks.compressed("А") == "А"


def test_load_and_artifacts(spark, tmp_path):
    nodes = {"a": spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "id string, v int"), "b": spark.createDataFrame([("z", 3)], "id string, v int")}
    edges = {"e": spark.createDataFrame([("x", "z"), ("x", "z"), ("x", "gone"), ("none", "y")], "src string, dst string"), "f": spark.createDataFrame([("z", "y")], "src string, dst string")}
    assert sinks.load(nodes, edges, str(tmp_path / "m")) == {"a": 2, "b": 1, "e": 1, "f": 1}
    path = str(tmp_path / "s.txt")
    sinks.write_text(spark, path, "один")
    sinks.write_text(spark, path, "два", str(tmp_path / "old" / "s1.txt"))
    assert (tmp_path / "s.txt").read_text() == "два" and (tmp_path / "old" / "s1.txt").read_text() == "один" and not (tmp_path / "s.txt.new").exists()


def test_start_nodes(spark):
    from graphloom.tools import metadata as T

    objects = spark.createDataFrame([("p/c/Документы/Заказ", "p", "c", "Документы", "Заказ"), ("q/c/Документы/Заказ", "q", "c", "Документы", "Заказ"), ("p/c/Отчеты/Итог", "p", "c", "Отчеты", "Итог")], "object_qn string, project string, config string, category string, object_name string")
    routines = spark.createDataFrame([("r1", "p/c/Отчеты/Итог", "Собрать"), ("r2", None, "Без")], "id string, owner_qn string, name string")
    forms = spark.createDataFrame([("p/c/Отчеты/Итог/Form/Ф",)], "form_qn string")
    refs = spark.createDataFrame([(r,) for r in ("R1", "p/c/отчеты/итог", "p/c/Отчеты/Итог/Form/Ф", "c/Отчеты/Итог", "Отчеты.Итог", "Итог.Собрать", " итог ", "Заказ", "Документы.Заказ", "нет")], "ref string")
    found = {r["ref"]: (r["tier"], r["target"], r["candidates"]) for r in T.start_nodes(objects, routines, forms, refs).collect()}
    assert found == {
        "R1": (0, "r1", 1), "p/c/отчеты/итог": (1, "p/c/Отчеты/Итог", 1), "p/c/Отчеты/Итог/Form/Ф": (2, "p/c/Отчеты/Итог/Form/Ф", 1), "c/Отчеты/Итог": (3, "p/c/Отчеты/Итог", 1), "Отчеты.Итог": (4, "p/c/Отчеты/Итог", 1),
        "Итог.Собрать": (5, "r1", 1), " итог ": (6, "p/c/Отчеты/Итог", 1), "Заказ": (6, None, 2), "Документы.Заказ": (4, None, 2), "нет": (None, None, 0),
    }


def test_removals_are_confirmed_over_cycles(spark, tmp_path):
    source = str(tmp_path / "cycles")
    schema = "scope string, cycle long, present boolean, malformed boolean"
    got = {}

    def keep(batch, number):
        got.update({r["scope"]: (r["cycle"], r["misses"], r["remove"]) for r in batch.collect()})

    cycles = [[("a", 1, True, False), ("b", 1, False, False), ("c", 1, False, True)], [("a", 2, False, False), ("c", 2, False, True), ("c", 1, False, True)], [("a", 3, True, False), ("b", 3, True, False)]]
    want = [{"a": (1, 0, False), "b": (1, 1, True), "c": (1, 1, False)}, {"a": (2, 1, True), "b": (1, 1, True), "c": (2, 2, True)}, {"a": (3, 0, False), "b": (3, 0, False), "c": (2, 2, True)}]
    for rows, after in zip(cycles, want):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = maintain.confirmed_removals(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        assert got == after
