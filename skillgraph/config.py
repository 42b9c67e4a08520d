"""Options with their defaults, work profiles, and the fixed tables of names."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass
from typing import Any

# Accepted headers of each canonical column.
ALIASES: dict[str, tuple[str, ...]] = {
    "job_id": ("job_id", "job id", "jobid", "id"),
    "job_title": ("job_title", "job title", "title"),
    "skills": ("skills", "skill"),
    "company_name": ("company_name", "company name", "firm", "company"),
    "posted_at": ("posted_at", "posted at", "posting_date", "date_posted"),
    "group": ("group", "occupation_group", "occupation group"),
    "assigned_occupation_group": ("assigned_occupation_group", "assigned occupation group", "category", "occupation_category"),
    "district": ("district", "location", "city", "district/state"),
    "industry": ("industry",),
    "nco_code": ("nco_code", "nco code"),
    "salary_mean_inr_month": ("salary_mean_inr_month", "salary", "salary_mean", "salary_monthly"),
}
REQUIRED = ("job_title", "skills")

# Proficiency buckets and their scores.
BUCKET_SCORES: dict[str, int] = {
    "mission-critical": 4,
    "mission critical": 4,
    "critical": 4,
    "advanced": 3,
    "4: advanced": 3,
    "3: proficient": 2,
    "proficient": 2,
    "working knowledge": 1,
    "1: familiarity": 0,
    "familiarity": 0,
}

# Cell texts that stand for a missing value.
MISSING_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# Limits of each work profile: betweenness (vertices, edges), closeness (vertices, edges), pairs (each feature, all).
PROFILES: dict[str, tuple[tuple[int, int] | None, tuple[int, int], tuple[int, int]]] = {
    "fast": (None, (12_000, 500_000), (1_000_000, 8_000_000)),
    "balanced": ((15_000, 1_000_000), (30_000, 1_500_000), (1_500_000, 25_000_000)),
    "deep": ((30_000, 2_000_000), (60_000, 4_000_000), (3_000_000, 70_000_000)),
}
PROFILE_NAMES = {"quick": "fast", "standard": "balanced", "full": "deep"}


# Texts that stand for true and for false.
TRUE_TEXTS, FALSE_TEXTS = ("1", "true", "yes", "y", "on"), ("0", "false", "no", "n", "off")


def as_bool(value: Any, default: bool) -> bool:
    """A truth value or a text for one; anything else is the default."""
    text = str(value).strip().lower()
    return True if text in TRUE_TEXTS else False if text in FALSE_TEXTS else default


@dataclass(frozen=True)
class Options:
    """What a run may set. A limit of None switches a measure off; no degree (None), no pairs (0) leave no feature out."""

    top_k: int = 20
    threshold: float = 0.0
    method: str = "both"
    default_similarity: float = 0.5
    max_feature_degree: int | None = 2_000
    max_pairs_per_feature: int = 1_500_000
    max_total_pairs: int = 25_000_000
    betweenness_limit: tuple[int, int] | None = (15_000, 1_000_000)
    closeness_limit: tuple[int, int] | None = (30_000, 1_500_000)
    warn_edges: int = 1_000_000
    subset_bytes: int | None = None
    subset_rows: int | None = None
    subset_seed: int = 42
    directed: bool = False
    encodings: tuple[str, ...] = ("utf-8-sig", "utf-8", "latin-1")

    @staticmethod
    def for_profile(name: str | None, **changes: Any) -> Options:
        """Options of a profile (unknown: balanced) with changes; changes that are None or can't be read keep the default."""
        key = (name or "").strip().lower()
        between, close, pairs = PROFILES[PROFILE_NAMES.get(key, key if key in PROFILES else "balanced")]
        base = Options(betweenness_limit=between, closeness_limit=close, max_pairs_per_feature=pairs[0], max_total_pairs=pairs[1])
        kinds = {f.name: type(getattr(base, f.name)) for f in dataclasses.fields(base)} | {"subset_bytes": int, "subset_rows": int}
        kept = {}
        for field, value in changes.items():
            if value is None or field not in kinds:
                continue
            if kinds[field] is bool:
                value = as_bool(value, getattr(base, field))
            elif kinds[field] in (int, float, str):
                try:
                    value = kinds[field](value)
                except (TypeError, ValueError):
                    continue
            kept[field] = value
        return dataclasses.replace(base, **kept)
