"""The tools that a model is offered, and their required arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tools and required arguments, in order.
TOOLS = {
    "process_document": ("file_content", "filename"),
    "search_document": ("session_id",),
    "record_document_preview": ("session_id",),
    "build_lca_system": ("session_id", "system_description", "functional_unit"),
    "search_lci_database": ("query",),
    "define_lca_scope": ("session_id", "parameter_name", "description"),
    "record_process_flow": ("session_id", "flow_type", "category", "name", "value", "unit"),
    "record_parameter": ("session_id", "parameter_name", "parameter_value", "selected_chunk"),
    "record_calculation": ("session_id", "calculation_expression", "calculation_result", "data_dependencies", "expert_decision"),
    "execute_calculation": ("expression",),
    "get_session_summary": ("session_id",),
}


def required(tool: Column) -> Column:
    """The arguments that a model must give a tool; none of an unknown one. The session's id is filled in by the service."""
    known = F.create_map(*[c for t, args in TOOLS.items() for c in (F.lit(t), F.array(*[F.lit(a) for a in args if a != "session_id"]).cast("array<string>"))])
    return F.coalesce(F.try_element_at(known, tool), F.array().cast("array<string>"))


def missing(calls: DataFrame) -> DataFrame:
    """``calls`` (tool, given: names of arguments) with ``missing``: required arguments that are not given, in order."""
    return calls.withColumn("missing", F.array_except(required(F.col("tool")), F.coalesce("given", F.array().cast("array<string>"))))
