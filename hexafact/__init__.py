"""hexafact: a six-dimension semantic fact engine on PySpark."""

from hexafact.lang.parser import parse, parse_to_constraints, parseToConstraints
from hexafact.lens.draft import LensDraft, suggest
from hexafact.operators.results import DiscoveryResult, ResultSet
from hexafact.operators.substrate import Substrate, compile_data, discover, execute, execute_plan, explain, query

__all__ = ["DiscoveryResult", "LensDraft", "ResultSet", "Substrate", "compile_data", "discover", "execute", "execute_plan", "explain", "parse", "parseToConstraints", "parse_to_constraints", "query", "suggest"]
