"""Traversals and conversions over whole tables, against brute force."""

from collections import defaultdict
from html import unescape

import pytest

from graphloom.plans import catalog
from graphloom.sources.tables import table

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def calls(spark):
    return [(r["caller"], r["callee"]) for r in catalog.queries()["recovered_calls"](spark, FOLDER).collect()]


@pytest.fixture(scope="module")
def owners(spark):
    latest = {}
    for r in table(spark, FOLDER, "routine").select("id", "owner_qn", "loaded_at").collect():
        if r["id"] not in latest or r["loaded_at"] > latest[r["id"]][0]:
            latest[r["id"]] = r["loaded_at"], r["owner_qn"]
    return {i: owner for i, (_, owner) in latest.items()}


def rows(spark, name):
    found = [tuple(r) for r in catalog.queries()[name](spark, FOLDER).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_depths_from_every_routine(spark, calls, owners):
    near = defaultdict(set)
    for a, b in calls:
        near[a].add(b)
        near[b].add(a)
    want = set()
    for start in owners:
        known = {start: 0}
        for level in range(1, 5):
            for node in {n for k in known if known[k] == level - 1 for n in near[k]} - known.keys():
                known[node] = level
        want |= {(start, n, depth) for n, depth in known.items()}
    assert rows(spark, "call_subtree_depths") == want


def test_paths_of_every_owner(spark, calls, owners):
    ahead = defaultdict(set)
    for a, b in calls:
        ahead[a].add((b, "CALLS"))
    for i, owner in owners.items():
        ahead[owner].add((i, "HAS_ROUTINE"))
    want = set()

    def walk(start, seen, text):
        for b, rel in ahead.get(seen[-1], ()):
            if b not in seen:
                path = f"{text} -[{rel}]-> {b}"
                want.add((start, b, len(seen), path))
                if len(seen) < 3:
                    walk(start, [*seen, b], path)

    for owner in set(owners.values()):
        walk(owner, [owner], owner)
    assert rows(spark, "dependency_paths") == want


def test_closure_of_both_tables(spark):
    found = rows(spark, "closure")
    from graphloom.operators.hierarchy import current_links

    parent = {r["name"]: r["parent"] for r in current_links(table(spark, FOLDER, "child_rel"), "child_rel").collect()}
    want = set()
    for node in {*parent, *parent.values()} - {None}:
        top, depth = node, 0
        while parent.get(top) is not None and depth <= len(parent):
            top, depth = parent[top], depth + 1
        if depth <= len(parent):
            want.add(("child_rel", top, node, depth))
    assert {x for x in found if x[0] == "child_rel"} == want


def test_every_document_is_converted(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()}
    found = dict(rows(spark, "html_to_text"))
    assert found.keys() == texts.keys()
    for k, v in texts.items():
        if v is None:
            assert found[k] is None
        elif v.isascii() and "<" not in v and unescape(v) == v:
            assert found[k] == " ".join(v.split())
