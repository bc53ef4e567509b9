"""The artifact's tables as Spark schemas, with keys and foreign keys.

A column is ``name type`` with ``?`` where null is allowed; ``SPAN`` stands for the six columns of a source span.
"""

from __future__ import annotations

from pyspark.sql import types as T

VERSION, CONTRACT = 8, 4
_KINDS = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType()}
_SPAN = "start_line:l start_column:l end_line:l end_column:l start_byte:l end_byte:l"
_OPEN_SPAN = _SPAN.replace(":l", ":l?")
_HEAD = "file_id:s path:s language:s"

# Tables and their columns, in order.
_COLUMNS = {
    "artifact_metadata": "key:s value:s",
    "parser_inventory": "language:s parser_package:s parser_version:s? grammar_version:s? source:s? metadata_json:s?",
    "extraction_revisions": "revision_id:l parent_revision_id:l? operation:s mode:s? started_at:s completed_at:s binary_version:s extract_contract_version:l sqlite_schema_version:l input_root:s? counts_json:s",
    "revision_file_changes": "revision_id:l file_id:s path:s change_kind:s",
    "files": "file_id:s path:s language:s content_hash:s content_bytes:l line_count:l? indexed_at:s last_revision_id:l status:s metadata_json:s?",
    "symbols": f"symbol_id:s {_HEAD} name:s kind:s signature:s? doc_comment:s? visibility:s? parent_symbol_id:s? {_SPAN} {' '.join('body_' + c for c in _OPEN_SPAN.split())} body_hash:s? semantic_group:s? confidence:d? content_type:s? is_test:b test_container:b test_lifecycle:b metadata_json:s?",
    "symbol_annotations": "annotation_id:s symbol_id:s annotation:s annotation_key:s raw_text:s? carrier:s? metadata_json:s?",
    "reference_sites": f"reference_site_id:s {_HEAD} containing_symbol_id:s? {_OPEN_SPAN} is_exact:b provenance:s",
    "identifiers": f"identifier_id:s reference_site_id:s? {_HEAD} name:s kind:s containing_symbol_id:s? {_SPAN} confidence:d code_context:s? metadata_json:s?",
    "relationships": f"relationship_id:s reference_site_id:s from_symbol_id:s to_symbol_id:s file_id:s path:s kind:s {_OPEN_SPAN} confidence:d metadata_json:s?",
    "pending_relationships": f"pending_relationship_id:s reference_site_id:s from_symbol_id:s caller_scope_symbol_id:s? file_id:s path:s kind:s target_display_name:s target_terminal_name:s target_receiver:s? target_namespace_json:s target_import_context:s? {_OPEN_SPAN.replace('start_line:l?', 'start_line:l')} confidence:d metadata_json:s?",
    "type_facts": "type_fact_id:s symbol_id:s language:s resolved_type:s generic_params_json:s? constraints_json:s? is_inferred:b metadata_json:s?",
    "type_argument_usages": "usage_id:s identifier_id:s file_id:s path:s language:s metadata_json:s?",
    "type_arguments": "type_argument_id:s usage_id:s parent_type_argument_id:s? ordinal:l type_name:s",
    "literals": f"literal_id:s {_HEAD} literal_text:s kind:s carrier:s? arg_position:l containing_symbol_id:s? {_SPAN} confidence:d metadata_json:s?",
    "source_regions": f"source_region_id:s {_HEAD} kind:s containing_symbol_id:s? {_SPAN} metadata_json:s?",
    "structural_facts": f"structural_fact_id:s {_HEAD} pattern_id:s capture_name:s node_kind:s containing_symbol_id:s? {_SPAN} confidence:d metadata_json:s?",
    "complexity_metrics": f"complexity_metric_id:s {_HEAD} scope:s symbol_id:s? algorithm_id:s covered_lines:l covered_bytes:l decision_count:l loop_count:l max_nesting_depth:l parameter_count:l? {_SPAN} metadata_json:s?",
    "parse_diagnostics": f"diagnostic_id:s {_HEAD} kind:s message:s? {_SPAN} metadata_json:s?",
    "language_capabilities": "language:s parser_package:s extensions_json:s dependency_status:s target_symbols:b target_relationships:b target_pending_relationships:b target_identifiers:b target_types:b actual_symbols:b actual_relationships:b actual_pending_relationships:b actual_identifiers:b actual_types:b kind_coverage_json:s",
    "language_capability_fixtures": "language:s fixture_name:s source_path:s expected_path:s",
    "language_capability_gaps": "gap_id:s language:s capability:s status:s reason:s required_closure:s evidence_json:s",
}


def _schema(columns: str) -> T.StructType:
    out = T.StructType()
    for c in columns.split():
        name, kind = c.split(":")
        out = out.add(name, _KINDS[kind[0]], kind.endswith("?"))
    return out


TABLES: dict[str, T.StructType] = {n: _schema(c) for n, c in _COLUMNS.items()}
#: The row families of one file, in the order they refer to each other.
FAMILIES = (
    "symbols", "symbol_annotations", "reference_sites", "identifiers", "relationships", "pending_relationships", "type_facts",
    "type_argument_usages", "type_arguments", "literals", "source_regions", "structural_facts", "complexity_metrics", "parse_diagnostics",
)
#: (child, column, parent, key, policy): a dangling required key drops the row, a nullable one becomes null.
FOREIGN_KEYS = (
    ("symbols", "parent_symbol_id", "symbols", "symbol_id", "null"), ("symbol_annotations", "symbol_id", "symbols", "symbol_id", "drop"),
    ("reference_sites", "containing_symbol_id", "symbols", "symbol_id", "null"), ("identifiers", "containing_symbol_id", "symbols", "symbol_id", "null"),
    ("relationships", "from_symbol_id", "symbols", "symbol_id", "drop"), ("relationships", "to_symbol_id", "symbols", "symbol_id", "drop"),
    ("pending_relationships", "from_symbol_id", "symbols", "symbol_id", "drop"), ("pending_relationships", "caller_scope_symbol_id", "symbols", "symbol_id", "null"),
    ("type_facts", "symbol_id", "symbols", "symbol_id", "drop"), ("type_argument_usages", "identifier_id", "identifiers", "identifier_id", "drop"),
    ("type_arguments", "usage_id", "type_argument_usages", "usage_id", "drop"), ("literals", "containing_symbol_id", "symbols", "symbol_id", "null"),
    ("source_regions", "containing_symbol_id", "symbols", "symbol_id", "null"), ("structural_facts", "containing_symbol_id", "symbols", "symbol_id", "null"),
    ("complexity_metrics", "symbol_id", "symbols", "symbol_id", "null"),
)
