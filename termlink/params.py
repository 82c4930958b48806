"""Parameters of the linking engine, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# Words, letters and patterns that decide what matches.
STOPWORDS = "of in with and or to due the a an by for at on from".split()

GENERIC_HEADS = """
disease diseases disorder disorders syndrome syndromes deficiency
deficiencies defect defects abnormality abnormalities condition
type subtype form variant variants susceptibility
familial congenital hereditary inherited acquired idiopathic
autosomal recessive dominant linked sporadic juvenile infantile adult
early late onset severe mild moderate progressive chronic acute
""".split()

GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "κ": "kappa", "λ": "lambda", "μ": "mu", "σ": "sigma", "ω": "omega"}
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}
ROMAN_TRIGGERS = ["type", "class", "group", "stage", "grade", "factor"]

TEMPLATES = [
    r"^defective\s+\S+\s+causes?\s+(.+)$",
    r"^\S+\s+deficiency\s+causes?\s+(.+)$",
    r"^\S+\s+variants?\s+causes?\s+(.+)$",
    r"^\S+\s+mutations?\s+cause[sd]?\s+(.+)$",
]

ALIAS_ALLOWLIST = {"hiv": "MONDO_0005109", "sars": "MONDO_0005091", "hse": "MONDO_0012521", "msud": "MONDO_0009563"}


@dataclass(frozen=True)
class Params:
    release: str = "26.06"
    measurement_area: str = "EFO_0001444"
    process_area: str = "GO_0008150"
    max_chunk_tokens: int = 6
    min_specificity: float = 8.0
    single_token_min_specificity: float = 9.0
    alias_min_length: int = 3  # declared for completeness; no rule reads it
    alias_auto_length: int = 6
    max_alias_sharing: int = 15
    alias_allowlist: dict[str, str] = field(default_factory=lambda: dict(ALIAS_ALLOWLIST))
    low_confidence_max_specificity: float = 12.0
    judge_batch_size: int = 25
    judge_model: str = "default"
    judge_seconds: float = 300.0  # for one call of the backend


DEFAULTS = Params()
