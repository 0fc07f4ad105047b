"""All checks by name."""

from importlib import import_module

MODULES = ("q_records", "q_functions", "q_rules", "q_canonical", "q_structure", "q_schemas", "q_sources", "q_resume")

QUERIES = {}
ORACLE = {}
for _name in MODULES:
    _module = import_module(f"checks.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
