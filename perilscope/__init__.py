"""Dataset risk scoring as Spark jobs.

Every public function takes DataFrames and returns DataFrames; many datasets
are scored in one job by carrying a ``dataset_id`` column.
"""

from perilscope.config import IntegritySettings, PatternRule, SafetyConfig
from perilscope.operators.composite import compute_safety_composite, passes_threshold, to_json
from perilscope.operators.coverage import safety_critical_edge_case_coverage
from perilscope.operators.integrity import label_integrity, row_suspicion
from perilscope.operators.metadata import (
    adversarial_provenance_risk,
    factual_decay_rate,
    poisoning_susceptibility,
)
from perilscope.operators.models import TextScorer, fit_text_scorer
from perilscope.operators.text_harm import (
    harm_content_density,
    physical_harm_enablement_density,
)
from perilscope.plans.assess import Assessment, assess_safety

__version__ = "0.1.0"
__all__ = [
    "Assessment",
    "IntegritySettings",
    "PatternRule",
    "SafetyConfig",
    "TextScorer",
    "adversarial_provenance_risk",
    "assess_safety",
    "compute_safety_composite",
    "factual_decay_rate",
    "fit_text_scorer",
    "harm_content_density",
    "label_integrity",
    "passes_threshold",
    "physical_harm_enablement_density",
    "poisoning_susceptibility",
    "row_suspicion",
    "safety_critical_edge_case_coverage",
    "to_json",
]
