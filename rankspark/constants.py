"""Fixed values.

Word lists, phrases and thresholds in this file decide the results. They are
stated as plain text so that they can be compared and changed in one place.
Nothing here is computed.
"""

# Employers that count as consulting firms (lower case).
CONSULTING_FIRMS = (
    "tcs",
    "tata consultancy services",
    "infosys",
    "wipro",
    "accenture",
    "cognizant",
    "capgemini",
)

# Skills that count as AI engineering (lower case).
AI_KEYWORDS = (
    "rag",
    "pinecone",
    "langchain",
    "vector database",
    "vector databases",
    "llm",
    "llm fine-tuning",
    "embeddings",
    "weaviate",
    "qdrant",
    "milvus",
)

# Parts of a title that point to a non-technical job.
NON_TECH_TITLE_PARTS = ("marketing", "sales", "hr", "human resources")

# Whole words in a title that place it in another profession.
OFF_DOMAIN_TITLE_WORDS = (
    "civil",
    "mechanical",
    "electrical",
    "chemical",
    "structural",
    "hr",
    "human resources",
    "recruiter",
    "recruitment",
    "talent acquisition",
    "marketing",
    "sales",
    "account manager",
    "accountant",
    "accounting",
    "finance",
    "operations",
    "administrative",
    "office manager",
    "customer support",
    "customer success",
    "teacher",
    "professor",
    "nurse",
    "doctor",
    "lawyer",
    "paralegal",
)

# Skills never named as a match (lower case).
DENIED_SKILLS = (
    "marketing",
    "sales",
    "hr",
    "human resources",
    "recruiting",
    "recruitment",
    "accounting",
    "finance",
)

# Fixed value: job text used when neither an inline text nor a file is given.
SAMPLE_JOB_TEXT = (
    "Senior Backend / Platform Engineer with strong distributed systems experience. "
    "Must know Go or Java, Kafka, Kubernetes, PostgreSQL and have built scalable, "
    "fault-tolerant microservices on AWS or GCP. Experience with observability, CI/CD "
    "and high-throughput data pipelines preferred."
)

# Fixed value: text in the reasoning column of the output when there is none.
REASONING_PLACEHOLDER = "AST generation pending Phase 3"

# Sentence patterns per tier. A part in square brackets vanishes
# when one of its slots has no value.
TIER_PATTERNS = {
    "top": (
        "Exceptional fit: [{years}y][ as a {title}] with strong engagement signals[, incl. {skills}]",
        "Top-tier match — [{years}y ][{title}] background; standout engagement[, proven in {skills}]",
        "Outstanding candidate: deep [{title}][ experience ({years}y)] directly matching the JD[, incl. {skills}]",
        "Exceptional fit for this role with strong engagement signals",
    ),
    "mid": (
        "Solid [{title}] background matching JD requirements[, supported by {years}y of experience][, incl. {skills}]",
        "Good match: [{years}y][ as a {title}][, with relevant skills in {skills}]",
        "Relevant [{title}][ profile ({years}y)] aligning with core JD needs[, incl. {skills}]",
        "Solid background matching the JD requirements",
    ),
    "filler": (
        "Adjacent skills only — likely below cutoff but included as final filler given [{years}y of experience]",
        "Borderline profile: partial overlap with the JD, retained as filler ([{years}y][ as a {title}])",
        "Peripheral match — included to complete the shortlist; limited direct JD alignment",
        "Adjacent skills only — likely below cutoff, included as final filler",
    ),
}

# Extra fact after the sentence, per tier.
TIER_FACTS = {
    "top": "[, GitHub activity {github}]",
    "mid": "[, GitHub activity {github}]",
    "filler": "",
}

# Concern clauses.
NOTICE_CONCERN = "[; however, note the extended notice period of {notice} days]"
HOPPER_CONCERN = "; candidate shows frequent job transitions"

# General phrases for rows without a specific sentence.
GENERAL_PHRASES = (
    "Relevant profile aligned with the core requirements of this role",
    "Background that maps to the key needs of the position",
    "Suitable match across several of the role's central competencies",
    "Applicable experience covering important aspects of the position",
    "Profile consistent with the principal expectations of the role",
    "Candidate background aligned with the JD's main requirements",
    "Reasonable fit against the central criteria of the role",
    "Experience relevant to the primary demands of the position",
    "Profile addressing key aspects of the role's requirements",
    "Background broadly matching the JD's core expectations",
    "Competencies that correspond to the role's main needs",
    "Relevant overall alignment with the position's requirements",
    "Applicable profile covering the role's essential areas",
    "Background that fits the principal requirements of the JD",
    "Suitable overall match for the demands of this role",
    "Profile aligned with several core needs of the position",
    "Experience corresponding to the role's key expectations",
    "Relevant candidate background for the requirements of this role",
    "Profile matching important elements of the JD",
    "Background aligned with the central requirements of the position",
    "Adjacent profile with partial overlap against the JD requirements",
    "Peripheral match retained to complete the shortlist for this role",
    "Borderline alignment with the role; limited direct JD overlap",
    "Tangential background with some relevance to the position",
)

# Drop reasons, in the order in which the rules are tried.
DROP_REASONS = (
    "domain_mismatch",
    "overlapping_timeline",
    "experience_inflation",
    "fake_expert",
    "title_mismatch",
)

# Columns of the ranked output.
OUTPUT_COLUMNS = ("candidate_id", "rank", "score", "reasoning")
