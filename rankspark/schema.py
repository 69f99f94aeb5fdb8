"""Declared schemas. Nothing is inferred from data."""

from __future__ import annotations

# One candidate record after ingest.
CANDIDATE = """
    candidate_id string,
    profile struct<headline: string, current_title: string, current_company: string,
                   current_industry: string, summary: string, years_of_experience: double>,
    skills array<struct<name: string>>,
    career_history array<struct<company: string, title: string, description: string,
                                start_date: string, end_date: string, duration_months: double>>,
    education array<struct<field_of_study: string, degree: string>>,
    signals struct<recruiter_response_rate: double, interview_completion_rate: double,
                   github_activity_score: double, notice_period_days: double,
                   skill_assessment_scores: map<string, double>>,
    notice_period_days double
"""

# Vectors and the text they were made from.
FEATURES = """
    candidate_id string,
    text_hash string,
    model string,
    embedding array<float>,
    norm double
"""

# Ranked output as stored in a CSV file.
RANKED_CSV = "candidate_id string, rank int, score double, reasoning string"
