"""A reader of XML parts as an Arrow column function: well-formedness, content types, relationships. A part is inflated
and parsed piece by piece; neither its bytes nor its tree are ever held."""

from __future__ import annotations

import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from epochlens.functions.codec import CHUNK, inflated

CONTENT_TYPES = T.ArrayType(T.StructType([
    T.StructField("override", T.BooleanType()),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
]))
RELATIONSHIPS = T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("external", T.BooleanType()),
]))


PART_FACTS = T.StructType([
    T.StructField("well_formed", T.BooleanType()),
    T.StructField("rels", RELATIONSHIPS),
    T.StructField("types", CONTENT_TYPES),
])
ENTITY = b"<!ENTITY"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attr(attributes: dict, name: str) -> str:
    return (attributes.get(name) or "").strip()


class _Rows:
    """Parser target that keeps the rows of one kind of part (``rels``, ``types`` or none)."""

    def __init__(self, kind: str | None):
        self.kind, self.depth, self.rows = kind, 0, []

    def start(self, tag: str, attributes: dict) -> None:
        if self.kind == "rels":
            self.relationship(_local(tag), attributes)
        elif self.kind == "types" and self.depth == 1:
            self.content_type(_local(tag), attributes)
        self.depth += 1

    def end(self, tag: str) -> None:
        self.depth -= 1

    def close(self) -> list[dict]:
        return self.rows

    def relationship(self, kind: str, attributes: dict) -> None:
        target, rel_type = _attr(attributes, "Target"), _attr(attributes, "Type")
        if kind.endswith("Relationship") and _attr(attributes, "Id") and rel_type and target:
            external = _attr(attributes, "TargetMode").lower() == "external"
            self.rows.append({"type": rel_type, "target": target, "external": external})

    def content_type(self, kind: str, attributes: dict) -> None:
        name = _attr(attributes, {"Default": "Extension", "Override": "PartName"}.get(kind, ""))
        ctype = _attr(attributes, "ContentType")
        if name and ctype:
            bare = name.lower() if kind == "Default" else name.removeprefix("/")
            self.rows.append({"override": kind == "Override", "name": bare, "type": ctype})


def read_xml(pieces: Iterable[bytes], kind: str | None = None) -> list[dict] | None:
    """Rows of a well-formed part, or null when it is malformed, does not inflate or declares entities."""
    parser, before = ET.XMLParser(target=_Rows(kind)), b""
    try:
        for piece in pieces:
            if ENTITY in before + piece:
                return None
            before = (before + piece)[1 - len(ENTITY):]
            parser.feed(piece)
        return parser.close()
    except (ET.ParseError, ValueError, LookupError, zlib.error):
        return None


@arrow_udf(returnType=PART_FACTS)
def _facts(data: pa.Array, deflated: pa.Array, kinds: pa.Array) -> pa.Array:
    rows = []
    for value, packed, kind in zip(data, deflated, kinds):
        raw, kind = value.as_py() or b"", kind.as_py()
        stored = (raw[a: a + CHUNK] for a in range(0, len(raw), CHUNK))
        found = read_xml(inflated(raw, -15) if packed.as_py() else stored, kind)
        rows.append({"well_formed": found is not None, **({kind: found} if kind else {})})
    return pa.array(rows, to_arrow_type(PART_FACTS))


def part_facts(data: Column, deflated: Column, kind: Column) -> Column:
    """struct(well_formed, rels, types) of a stored or raw DEFLATE part; ``kind`` is rels, types or null."""
    return _facts(data, deflated, kind)
