"""Parameters of a run.  Defaults are the shipped ones; all can be overridden."""

from __future__ import annotations

from dataclasses import dataclass, field

from voicelode import values


@dataclass(frozen=True)
class Settings:
    # scoring weights
    pain_weight: float = 0.3
    demand_weight: float = 0.25
    cross_query_weight: float = 0.15
    engagement_weight: float = 0.3
    pain_terms: tuple[str, ...] = tuple(values.PAIN_TERMS)
    demand_terms: tuple[str, ...] = tuple(values.DEMAND_TERMS)

    # selection for analysis
    min_score: float = 5.0
    max_analyzed: int = 50
    batch_size: int = 25
    body_limit: int = 2000

    # sources
    platforms: tuple[str, ...] = ("hn", "producthunt")
    enabled: dict[str, bool] = field(default_factory=dict)  # missing platform = enabled
    min_points: int = 2
    comment_threshold: int = 10
    max_age_days: int = 180

    # merging of findings
    similarity: float = 0.5
    quotes_kept: int = 5

    # report
    tool_name: str = "voicelode"
    model_name: str = "Gemini"
    report_posts: int = 20
    report_hubs: int = 10
    hub_min_comments: int = 10
    hub_min_relevance: float = 0.4
