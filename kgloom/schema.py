"""Schemas of the tables that operators exchange, as DDL."""

from __future__ import annotations


DOCUMENTS = "document_id STRING, text STRING, metadata MAP<STRING,STRING>"
CHUNKS = "chunk_id STRING, document_id STRING, chunk_index INT, text STRING, start_char INT, end_char INT, token_count INT"
RAW_RELATIONS = "relation_id STRING, document_id STRING, ord BIGINT, description STRING, confidence DOUBLE, axis STRING, verb STRING, target_category STRING, definition STRING"
EVIDENCE = "relation_id STRING, ev_pos INT, quote STRING, chunk_id STRING"
ROLE_FILLERS = "relation_id STRING, role_group INT, role STRING, pos INT, label STRING, name STRING, definition STRING, confidence DOUBLE"
CANDIDATES = "kind STRING, label STRING, definition STRING, source_description STRING"
ONTOLOGY_TYPES = "version INT, kind STRING, label STRING, definition STRING, is_seed BOOLEAN"
DECISIONS = "seq BIGINT, action STRING, kind STRING, label STRING, definition STRING, reasoning STRING, merge_target STRING"
VIOLATIONS = "rule_name STRING, severity STRING, message STRING, subject_type STRING, subject_id STRING"
NODES = "id STRING, kind STRING, labels ARRAY<STRING>, properties MAP<STRING,STRING>"
EDGES = "source_id STRING, target_id STRING, relation_type STRING, properties MAP<STRING,STRING>"
