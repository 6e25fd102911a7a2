"""Directory scans without contents, text of any usual encoding, and code embedded in form containers."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of files by their path; the first that fits counts.
KINDS = (
    ("code", r"(?i)\.bsl$"), ("form", r"(?i)/Forms?/[^/]+/Ext/Form\.xml$|/CommonForms/[^/]+/Ext/Form\.xml$"), ("form_container", r"(?i)/Form\.bin$"), ("predefined", r"(?i)/Ext/Predefined\.xml$"),
    ("rights", r"(?i)/Roles/[^/]+/Ext/Rights\.xml$"), ("help", r"(?i)/Help/[^/]+\.html?$"), ("subscription", r"(?i)/EventSubscriptions/[^/]+\.xml$"), ("dump_info", r"(?i)/ConfigDumpInfo\.xml$"),
    ("report", r"(?i)\.txt$"), ("descriptor", r"(?i)\.xml$"),
)
_UPPER = bytes(range(128, 256))


def kind_of(path: Column) -> Column:
    """The kind of a file by its path, ``other`` if none fits."""
    return F.coalesce(*[F.when(path.rlike(rule), F.lit(kind)) for kind, rule in KINDS], F.lit("other"))


def tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, length, modified) of all files below a folder; contents are never opened.

    A scan passes over empty files, so these are added from the listing it was made from, with length 0 and no time.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    listed = [(re.sub("^file:/+", "file:/", unquote(p)),) for p in found.inputFiles()]
    plain = found.select("path", "length", F.col("modificationTime").alias("modified")).withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    empty = spark.createDataFrame(listed, "path string").join(plain.select("path"), "path", "left_anti")
    both = plain.unionByName(empty.select("path", F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modified")))
    return both.select("path", kind_of(F.col("path")).alias("kind"), "length", "modified")


def decoded(content: Column) -> Column:
    """Bytes as text: by byte order mark, else UTF-8 if it is valid, else the Cyrillic Windows code page; the mark itself goes."""
    head = F.hex(F.substring(content, 1, 3))
    # The code page by rule: Latin-1 keeps the byte values, which are then translated.
    pairs = [(bytes([b]).decode("latin-1"), bytes([b]).decode("cp1251", "replace")) for b in _UPPER]
    page = F.translate(F.decode(content, "ISO-8859-1"), "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    text = (
        F.when(head.startswith("FFFE"), F.decode(content, "UTF-16LE")).when(head.startswith("FEFF"), F.decode(content, "UTF-16BE"))
        .otherwise(F.coalesce(F.try_validate_utf8(content.cast("string")), page))
    )
    return F.regexp_replace(text, "^﻿", "")


def texts(spark: SparkSession, root: str, kinds: list[str] | None = None) -> DataFrame:
    """(path, kind, text) of the files of some kinds below a folder; only these are opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).withColumn("kind", kind_of(F.col("path")))
    found = found if kinds is None else found.where(F.col("kind").isin(*kinds))
    return found.select("path", "kind", decoded(F.col("content")).alias("text"))


_SIZES = r"[0-9a-fA-F]{8}\s+[0-9a-fA-F]{8}\s+7fffffff[ \t]*"


def container_code(text: Column) -> Column:
    """The code inside a form container: what follows a line that ends in ``module`` and a line of sizes, up to the next line of sizes or that opens a brace; null if there is none."""
    flat = F.regexp_replace(text, r"\r\n?", "\n")
    head = rf"(?im)^[^\n]*m\x00?[ \t]*o\x00?[ \t]*d\x00?[ \t]*u\x00?[ \t]*l\x00?[ \t]*e[\x00 \t]*\n{_SIZES}$\n?"
    code = F.get(F.split(F.get(F.split(flat, head, 2), F.lit(1)), rf"(?im)^(?:{_SIZES}$|\{{)", 2), F.lit(0))
    clean = F.regexp_replace(F.regexp_replace(code, "[\\x00﻿​‌‍⁠]", ""), r"\s+$", "")
    return F.when(F.trim(clean) != "", clean)
