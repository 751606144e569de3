"""Content-derived identifiers: the start of the SHA-256 of a JSON object with sorted keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_DIGITS = 16


def _escaped(value: Column) -> Column:
    """Inside of a JSON string; control characters other than the five with short forms become ``\\u00XX``."""
    text = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, short in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        text = F.replace(text, F.lit(raw), F.lit(short))
    slow = text
    for c in (x for x in range(0x20) if x not in (8, 9, 10, 12, 13)):
        slow = F.replace(slow, F.lit(chr(c)), F.lit(f"\\u{c:04x}"))
    control = F.regexp_like(value, F.lit("[\\x00-\\x07\\x0B\\x0E-\\x1F]"))
    return F.when(control, slow).otherwise(text)


def _ascii(text: Column) -> Column:
    """Other characters than ASCII as ``\\uXXXX``, those beyond the first plane as two; expressions only."""
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", "\\\\u$1")
    each = F.transform(F.split(text, ""), lambda c: F.when(F.octet_length(c) > 1, units(c)).otherwise(c))
    return F.when(F.octet_length(text) > F.char_length(text), F.array_join(each, "")).otherwise(text)


def json_object(fields: dict[str, Column], ascii_only: bool = True) -> Column:
    """The JSON text with sorted keys, ``", "`` and ``": "``; with ``ascii_only`` other characters are escaped."""
    parts: list[Column] = []
    for key in sorted(fields):
        value = fields[key]
        parts += [F.lit(f'{", " if parts else "{"}"{key}": "'), _escaped(F.coalesce(value.cast("string"), F.lit(""))), F.lit('"')]
    text = F.concat(*parts, F.lit("}"))
    return _ascii(text) if ascii_only else text


def content_id(fields: dict[str, Column], ascii_only: bool = True) -> Column:
    """Never null, and said so: else joins on ids would make each once more to see whether it is."""
    return F.coalesce(F.substring(F.sha2(json_object(fields, ascii_only), 256), 1, ID_DIGITS), F.lit(""))


def entity_id(label: Column, name: Column) -> Column:
    return content_id({"label": label, "name": name})


def document_node_id(document_id: Column) -> Column:
    return content_id({"document_id": document_id})


def relation_node_id(verb: Column, target: Column, description: Column, document_id: Column) -> Column:
    return content_id({"verb": verb, "target": target, "description": description, "doc": document_id})


def mention_id(chunk_id: Column, surface_form: Column, entity_name: Column, entity_label: Column) -> Column:
    """Without the role: one entity in two roles of a chunk is one mention."""
    return content_id({"chunk_id": F.coalesce(chunk_id, F.lit("")), "surface_form": surface_form, "entity_name": entity_name, "entity_label": entity_label})


def chunk_id(document_id: Column, index: Column, text: Column) -> Column:
    """The index is a number in the JSON text, in which only these ids keep other characters as they are."""
    body = F.concat(F.lit('{"chunk_index": '), index.cast("string"), F.lit(', "chunk_text": "'), _escaped(text), F.lit('", "document_id": "'), _escaped(document_id.cast("string")), F.lit('"}'))
    return F.substring(F.sha2(body, 256), 1, ID_DIGITS)


def full_hash(row: Column) -> Column:
    return F.sha2(F.to_json(row), 256)
