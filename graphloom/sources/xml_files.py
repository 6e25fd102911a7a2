"""Scans of XML files: object descriptors, forms, predefined items, role rights, event subscriptions, dump listings.

Each scan takes rows (path, text) and gives rows; a file is parsed by the task that holds it. Files that are not
XML give no rows and come out of ``broken`` instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Node = ElementTree.Element


def tag(node: Node) -> str:
    """The name of an element without its namespace."""
    return node.tag.rsplit("}", 1)[-1]


def child(node: Node | None, *names: str) -> Node | None:
    """The first descendant by a line of names."""
    for name in names:
        node = next((c for c in node if tag(c) == name), None) if node is not None else None
    return node


def text(node: Node | None, *names: str) -> str | None:
    found = child(node, *names) if names else node
    return found.text.strip() if found is not None and found.text and found.text.strip() else None


def local_text(node: Node | None, language: str = "ru") -> str | None:
    """The text of a node in several languages: that of ``language``, else the first."""
    if node is None:
        return None
    items = {text(i, "lang"): text(i, "content") for i in node if tag(i) == "item"}
    return items.get(language) or next((v for v in items.values() if v), None) or text(node)


def types(node: Node | None) -> list[str]:
    """The type literals of a type description, prefixes of name spaces taken off."""
    return [] if node is None else [t.text.strip().rsplit(":", 1)[-1] for t in node.iter() if tag(t) in ("Type", "TypeSet") and t.text and t.text.strip()]


def _scan(files: DataFrame, parse: Callable[[Node], Iterator[tuple]], schema: str) -> DataFrame:
    full = T._parse_datatype_string(f"path string, {schema}")
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                root = read(content)
                if root is not None:
                    rows += [(path, *r) for r in parse(root)]
            columns = list(zip(*rows)) if rows else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return files.select("path", "text").mapInArrow(run, full)


def read(content: str | None) -> Node | None:
    """The root of an XML text; None if it is missing or can't be read."""
    if not content:
        return None
    try:
        return ElementTree.fromstring(content.encode("utf-8", "surrogatepass") if not content.lstrip().startswith("<?xml") else content.split("?>", 1)[-1].encode("utf-8", "surrogatepass"))
    except ElementTree.ParseError:
        return None


def broken(files: DataFrame) -> DataFrame:
    """(path) of the files that are not XML."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = [p for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if read(t) is None]
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], names=["path"])

    return files.select("path", "text").mapInArrow(run, "path string")


#: Child kinds of a descriptor and what they are called in rows.
_CHILDREN = {
    "Attribute": "attribute", "Dimension": "dimension", "Resource": "resource", "TabularSection": "tabular_part", "Form": "form", "Command": "command", "Template": "layout", "EnumValue": "enum_value",
    "AccountingFlag": "accounting_flag", "ExtDimensionAccountingFlag": "dimension_accounting_flag", "Column": "journal_graph", "URLTemplate": "url_template", "Method": "url_method",
}


def _descriptor(root: Node) -> Iterator[tuple]:
    own = root if tag(root) != "MetaDataObject" else next(iter(root), None)
    if own is None:
        return
    name = text(own, "Properties", "Name")
    head = (tag(own), name)
    for p in child(own, "Properties") if child(own, "Properties") is not None else ():
        if tag(p) not in ("Name", "Type"):
            value = local_text(p)
            if value is not None:
                yield (*head, "property", None, tag(p), [], value)
    stack = [(c, None) for c in reversed(list(child(own, "ChildObjects") if child(own, "ChildObjects") is not None else ()))]
    while stack:
        node, container = stack.pop()
        kind = _CHILDREN.get(tag(node))
        if kind is None:
            continue
        called = text(node, "Properties", "Name") or text(node)
        yield (*head, "tabular_attribute" if container and kind == "attribute" else kind, container, called, types(child(node, "Properties", "Type")), local_text(child(node, "Properties", "Synonym")))
        inner = child(node, "ChildObjects")
        stack += [(c, called) for c in reversed(list(inner if inner is not None else ()))]


def descriptors(files: DataFrame) -> DataFrame:
    """(path, object_kind, object_name, kind, container, name, types, value): properties and children of each object; ``value`` is a property's text or a child's synonym."""
    return _scan(files, _descriptor, "object_kind string, object_name string, kind string, container string, name string, types array<string>, value string")


#: Parts of a form that hold no controls.
_NO_CONTROLS = frozenset(("ContextMenu", "ExtendedTooltip", "Events", "Attributes", "Commands", "BaseForm", "Parameters"))


def _controls(root: Node) -> Iterator[tuple[Node, Node | None, int, int]]:
    """(control, parent control, order, depth) from the top down."""
    top = [(c, None, i, 0) for i, c in enumerate(child(root, "ChildItems") if child(root, "ChildItems") is not None else ())]
    bar = child(root, "AutoCommandBar")
    if bar is not None:
        top.append((bar, None, len(top), 0))
    stack = list(reversed(top))
    while stack:
        node, parent, order, depth = stack.pop()
        if tag(node) in _NO_CONTROLS or node.get("name") is None:
            continue
        yield node, parent, order, depth
        inner = child(node, "ChildItems")
        stack += [(c, node, i, depth + 1) for i, c in reversed(list(enumerate(inner if inner is not None else ())))]


def _events(node: Node) -> Iterator[tuple[str, str, str]]:
    for e in child(node, "Events") if child(node, "Events") is not None else ():
        if e.get("name"):
            yield e.get("name"), text(e), e.get("callType") or "Main"


def _form(root: Node) -> Iterator[tuple]:
    for event, handler, call in _events(root):
        yield ("event", event, None, None, 0, 0, handler, call)
    for node, parent, order, depth in _controls(root):
        owner = parent.get("name") if parent is not None else None
        yield ("control", node.get("name"), owner, tag(node), order, depth, text(node, "DataPath") or text(node, "CommandName"), node.get("id"))
        for event, handler, call in _events(node):
            yield ("control_event", event, node.get("name"), None, 0, depth, handler, call)
    for part, kind in (("Attributes", "attribute"), ("Commands", "command")):
        for i, a in enumerate(child(root, part) if child(root, part) is not None else ()):
            value = "|".join(types(child(a, "Type"))) if kind == "attribute" else text(a, "Action")
            yield (kind, a.get("name"), None, tag(a), i, 0, value, a.get("id"))


def forms(files: DataFrame) -> DataFrame:
    """(path, part, name, owner, kind, position, depth, value, mark) of each form: its events, controls in their tree, their events, attributes and commands.

    ``value`` is a data path or command, a handler, types or an action; ``mark`` an id or, of events, the call type.
    """
    return _scan(files, _form, "part string, name string, owner string, kind string, position int, depth int, value string, mark string")


def canonical(node: Node, ignored: frozenset[str] = frozenset(("id",))) -> str:
    """An element as text that does not depend on prefixes, order of attributes, blanks around texts or the ignored attributes."""
    out: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        attributes = "".join(f' {k.rsplit("}", 1)[-1]}="{v}"' for k, v in sorted(n.attrib.items()) if k.rsplit("}", 1)[-1] not in ignored)
        out.append(f"<{tag(n)}{attributes}>{(n.text or '').strip()}")
        stack.append(f"</{tag(n)}>{(n.tail or '').strip()}" if n is not node else f"</{tag(n)}>")
        stack += list(reversed(n))
    return "".join(out)


def digest(node: Node) -> str:
    """sha1 of the canonical text."""
    return hashlib.sha1(canonical(node).encode()).hexdigest()


def _own(node: Node) -> str:
    """The hash of a control without the controls inside it."""
    copy = ElementTree.Element(tag(node), node.attrib)
    copy.extend([c for c in node if tag(c) != "ChildItems"])
    return digest(copy)


def _extension(root: Node) -> Iterator[tuple]:
    base = child(root, "BaseForm")
    if base is None:
        return
    sides = []
    for side in (base, root):
        found = {("control", n.get("name")): _own(n) for n, *_ in _controls(side)}
        for part, kind in (("Attributes", "attribute"), ("Commands", "command")):
            found |= {(kind, a.get("name")): digest(a) for a in (child(side, part) if child(side, part) is not None else ())}
        sides.append(found)
    old, new = sides
    for key in sorted(old.keys() | new.keys()):
        yield (*key, "added" if key not in old else "removed" if key not in new else "unchanged" if old[key] == new[key] else "modified")


def extension_forms(files: DataFrame) -> DataFrame:
    """(path, part, name, state): what an extension's form changes of the base form it holds a copy of; forms without a copy give nothing."""
    return _scan(files, _extension, "part string, name string, state string")


def _predefined(root: Node) -> Iterator[tuple]:
    stack = [(i, None, 0) for i in reversed([c for c in root if tag(c) == "Item"])]
    while stack:
        node, parent, depth = stack.pop()
        own = node.get("id")
        yield (own, parent, depth, text(node, "Name"), text(node, "Code"), text(node, "Description"), (text(node, "IsFolder") or "false").lower() == "true", types(child(node, "Type")))
        inner = child(node, "ChildItems")
        stack += [(c, own, depth + 1) for c in reversed(list(inner if inner is not None else ())) if tag(c) == "Item"]


def predefined(files: DataFrame) -> DataFrame:
    """(path, id, parent_id, depth, name, code, description, is_folder, types) of predefined items at any depth."""
    return _scan(files, _predefined, "id string, parent_id string, depth int, name string, code string, description string, is_folder boolean, types array<string>")


def _rights(root: Node) -> Iterator[tuple]:
    for o in root:
        if tag(o) == "object":
            for r in o:
                if tag(r) == "right":
                    conditions = [text(c) for c in r.iter() if tag(c) == "condition" and text(c)]
                    yield (text(o, "name"), text(r, "name"), (text(r, "value") or "").lower() == "true", "\n".join(conditions) or None)


def rights(files: DataFrame) -> DataFrame:
    """(path, object, right, allowed, condition) of role rights."""
    return _scan(files, _rights, "object string, right string, allowed boolean, condition string")


def _subscription(root: Node) -> Iterator[tuple]:
    own = root if tag(root) != "MetaDataObject" else next(iter(root), None)
    handler = text(own, "Properties", "Handler")
    yield (text(own, "Properties", "Name"), text(own, "Properties", "Event"), handler, handler.rsplit(".", 1)[-1] if handler else None, types(child(own, "Properties", "Source")))


def subscriptions(files: DataFrame) -> DataFrame:
    """(path, name, event, handler, procedure, sources) of event subscriptions."""
    return _scan(files, _subscription, "name string, event string, handler string, procedure string, sources array<string>")


def _listing(root: Node) -> Iterator[tuple]:
    for n in root.iter():
        if tag(n) == "Metadata" and n.get("name") and n.get("id"):
            yield (n.get("name"), n.get("id"))


def dump_listing(files: DataFrame) -> DataFrame:
    """(path, name, id): the ids of objects in a dump's listing."""
    return _scan(files, _listing, "name string, id string")


def with_ids(nodes: DataFrame, listing: DataFrame, name: str) -> DataFrame:
    """Adds ``guid`` to nodes by the listing's names; nodes it doesn't know keep null. Of several ids the smallest counts."""
    known = listing.groupBy("name").agg({"id": "min"}).toDF("_name", "guid")
    return nodes.join(known, nodes[name] == known["_name"], "left").drop("_name")
