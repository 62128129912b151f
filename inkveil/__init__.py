"""Detection, reversible redaction and restoring of sensitive values in text, on Spark."""

from inkveil.config import Config, CustomPattern
from inkveil.operators.restore import restore
from inkveil.plans.pipelines import (
    Redaction,
    compare_presets,
    find,
    preview,
    redact,
    redact_documents,
    redacting,
)

__all__ = [
    "Config",
    "CustomPattern",
    "Redaction",
    "compare_presets",
    "find",
    "preview",
    "redact",
    "redact_documents",
    "redacting",
    "restore",
]
