"""All adjustable values of a run, in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass

from rankspark import constants as fixed


@dataclass(frozen=True)
class RankConfig:
    # sizes
    recall_k: int = 1000
    top_n: int = 100
    top_tier_until: int = 20
    mid_tier_until: int = 80
    # similarity and score are rounded to this many digits before sorting: the last bits of a matrix
    # product depend on the shape of its batch, and ties by id must not
    score_digits: int = 9

    # drop rules
    overlap_ratio: float = 1.5
    inflation_ratio: float = 2.0
    expert_score: float = 90.0
    expert_min_years: float = 0.5
    off_domain_words: tuple[str, ...] = fixed.OFF_DOMAIN_TITLE_WORDS
    non_tech_parts: tuple[str, ...] = fixed.NON_TECH_TITLE_PARTS
    ai_keywords: tuple[str, ...] = fixed.AI_KEYWORDS

    # factors
    consulting_firms: tuple[str, ...] = fixed.CONSULTING_FIRMS
    consulting_factor: float = 0.1
    hopper_factor: float = 0.85
    hopper_years: float = 1.5
    notice_free_days: int = 30
    notice_step_days: int = 30
    notice_step_loss: float = 0.15

    # text and reasoning
    max_reason_chars: int = 240
    skills_named: int = 3
    denied_skills: tuple[str, ...] = fixed.DENIED_SKILLS
    # tokens (words and single other characters) of a job text that skills meet by equality; longer skills are compared with the text
    longest_skill_run: int = 8

    # rows of running best matches that one task may hold; more queries mean more passes
    recall_state_rows: int = 1_000_000
    # results of so many tasks make a group in the first step of merging the best matches of a job
    tasks_per_merge: int = 50
    # from so many tasks on, a first pass over a share of the candidates bounds the scores that can win
    bound_from_tasks: int = 64

    def __post_init__(self) -> None:
        for name in ("recall_k", "top_n", "max_reason_chars", "tasks_per_merge", "score_digits", "longest_skill_run"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive, got {getattr(self, name)}")
