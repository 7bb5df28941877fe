"""All queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["quality_rules", "mixing", "packing", "token_files", "suffix_dedup", "chat_format", "quality_classifier", "fingerprints", "jaccard_join", "html_extraction", "exact_dedup", "merkle_manifest", "whitening"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in importlib.import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: f for m in MODULES for k, f in importlib.import_module(f"{__package__}.{m}").SQL.items()}
