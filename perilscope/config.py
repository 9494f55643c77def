"""Settings. Each becomes literals in the plan; nothing here touches Spark data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

# The scoring rules are defined by them.
HEADS = ("toxicity", "severe_toxicity", "obscene", "threat", "insult", "identity_attack")
LEXICON = ("hate", "kill", "stupid", "idiot")
DUAL_USE_TERMS = ("precursor", "synthesis route", "attack plan", "mass casualty")
EMAIL_PATTERN = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
SSN_LIKE_PATTERN = r"\b\d{3}-\d{2}-\d{4}\b"
BREADTH_SCORES = {"narrow": 0.0, "medium": 0.3, "broad": 0.7, "web_scale": 1.0}
UNKNOWN_BREADTH_SCORE = 0.5
PASS_LIMIT = 0.2


@dataclass(frozen=True)
class PatternRule:
    """A named regular expression over the text.

    ``must_contain`` is a literal every match holds; texts without it skip the
    regular expression, which costs far more per character.
    """

    name: str
    pattern: str
    must_contain: str | None = None


PII_RULES = (
    PatternRule("email", EMAIL_PATTERN, must_contain="@"),
    PatternRule("ssn_like", SSN_LIKE_PATTERN, must_contain="-"),
)


def as_rules(rules: Mapping[str, str] | Sequence[PatternRule] | None) -> tuple[PatternRule, ...]:
    """Accept a name → pattern mapping as well as rule objects; None means the defaults."""
    if rules is None:
        return PII_RULES
    if isinstance(rules, Mapping):
        return tuple(PatternRule(name, pattern) for name, pattern in rules.items())
    return tuple(rules)


@dataclass(frozen=True)
class IntegritySettings:
    """How out-of-fold probabilities are obtained for the label-integrity proxy."""

    n_splits: int = 5
    seed: int = 0
    key_columns: tuple[str, ...] | None = None
    exclude_columns: tuple[str, ...] = ()
    exact_folds: bool = False
    preprocess: bool = True
    inverse_penalty: float = 1.0
    max_iter: int = 2000
    tol: float = 1e-6
    estimator: Any = None
    strict: bool = False

    def __post_init__(self) -> None:
        if self.n_splits < 2:
            raise ValueError("n_splits must be at least 2")


@dataclass(frozen=True)
class SafetyConfig:
    """What to score and how.

    ``harm_sample_size=None`` scores every text; a number scores that many
    texts of each dataset, drawn by a seeded hash of ``key_columns``.
    ``classifier`` is ``"heads"`` (score columns), ``"lexicon"``, a fitted
    ``TextScorer``, or a function from the text column to a Boolean column.
    """

    dataset_column: str = "dataset_id"
    text_column: str | None = None
    label_column: str | None = None
    feature_columns: tuple[str, ...] | None = None
    key_columns: tuple[str, ...] | None = None
    domain_half_life_days: float = 365.0
    physical_process_coupled: bool = False
    required_edge_probes: tuple[str, ...] | None = None
    present_edge_probes: tuple[str, ...] | None = None
    harm_sample_size: int | None = None
    sample_seed: int = 42
    toxicity_threshold: float = 0.7
    classifier: Any = "lexicon"
    head_columns: tuple[str, ...] = HEADS
    lexicon: tuple[str, ...] = LEXICON
    pii_rules: Mapping[str, str] | Sequence[PatternRule] | None = None
    dual_use_terms: tuple[str, ...] | None = None
    as_of: str | None = None
    integrity: IntegritySettings = field(default_factory=IntegritySettings)

    def __post_init__(self) -> None:
        if isinstance(self.classifier, str) and self.classifier not in ("heads", "lexicon"):
            raise ValueError(
                f"unknown classifier {self.classifier!r}: use 'heads', 'lexicon' or a function"
            )
        if not (
            isinstance(self.classifier, str)
            or callable(self.classifier)
            or hasattr(self.classifier, "with_score")
        ):
            raise ValueError("the classifier is neither a name, a function nor a text scorer")
        if self.harm_sample_size is not None and not self.key_columns:
            raise ValueError("harm_sample_size needs key_columns to draw on")
