"""All queries of the subpackage, by name."""

from playtrace.llm import (  # noqa: F401
    decontamination, filter_audit, fingerprints, jaccard, language, language_model, line_dedup, merkle, mixing, quality, sharding, suffixes, token_counts,
)
from playtrace.llm.common import ORACLES, QUERIES  # noqa: F401
