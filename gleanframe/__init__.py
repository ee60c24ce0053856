"""Document extraction on Spark: chunks, pending work, completions, results."""

from gleanframe.operators.completion import FunctionCompleter, RuleCompleter
from gleanframe.operators.store import Store
from gleanframe.plans.run import Breaker, BreakerTripped, run_extraction
from gleanframe.spec import ExtractionSpec, NodeSpec

__all__ = [
    "Breaker",
    "BreakerTripped",
    "ExtractionSpec",
    "FunctionCompleter",
    "NodeSpec",
    "RuleCompleter",
    "Store",
    "run_extraction",
]
