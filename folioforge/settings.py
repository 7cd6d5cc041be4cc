"""Tunables of the engine in one frozen object, and the constants of its stored formats."""

from __future__ import annotations

from dataclasses import dataclass, field

# Stored formats; changing one means indexing anew.
KEY_VALUE = "==="
TITLE_SEPARATOR = "\n\r\n"
SECTION_SEPARATOR = "\n\n"
PUBLIC = "PUBLIC"
USER_PREFIX, GROUP_PREFIX = "user_email:", "external_group:"
IGNORE_FOR_QA = "ignore_for_qa"
CHUNK_SIZE = 512


@dataclass(frozen=True)
class Settings:
    """Defaults of the operators; see each for its meaning."""

    chunk_tokens: int = 512
    blurb_tokens: int = 128
    mini_tokens: int = 150
    large_ratio: int = 4
    metadata_share: float = 0.25
    min_content: int = 256
    strict_limit: bool = False
    max_document_chars: int = 536_870_912
    candidates: int = 500
    result_window: int = 10_000
    hits: int = 50
    llm_sections: int = 25
    selection_slack: float = 2.0
    undated_age_days: int = 90
    k1: float = 1.2
    b: float = 0.75
    minmax_floor: float = 0.001
    weights: dict = field(default_factory=lambda: {"content_vector": 0.5, "keyword": 0.5})
    title_weights: dict = field(default_factory=lambda: {"title_vector": 0.1, "content_vector": 0.45, "keyword": 0.45})
    rrf_k: int = 50
    variant_weights: dict = field(default_factory=lambda: {"rephrase": 1.3, "keyword": 1.0, "model": 0.7, "original": 0.5, "only": 1.0})
    keyword_alpha: float = 0.2
    chunks_per_section: int = 3
    full_radius: int = 5
    near_radius: int = 2
    metadata_token_estimate: int = 75
    max_sections: int = 10
    public_by_default: bool = True
    dim: int = 64


DEFAULT = Settings()
