"""One sentence per ranked row, built from the facts of the row.

Input columns: ``candidate_id, rank, tier, title, years, github, notice_days, hopper``
and the arrays ``named_skills`` and ``matched_set`` (lower case). Patterns are
turned into Column expressions when the plan is built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark import constants as fixed
from rankspark.config import RankConfig
from rankspark.functions import text
from rankspark.functions.hashing import stable_pick


SLOTS = ("years", "title", "github", "skills", "notice")
# stand for braces and brackets inside values, and for a missing value, while a pattern is filled
_HIDDEN = "\ue000\ue001\ue002\ue003"
_MISSING = "\ue004"


class NoUniqueSentence(RuntimeError):
    """No unused sentence is left for a row."""


def slots(cfg: RankConfig) -> dict[str, Column]:
    """Values a pattern may name; null means that the part around it vanishes."""
    named = F.slice(F.coalesce("named_skills", F.array().cast("array<string>")), 1, cfg.skills_named)
    return {
        "years": F.col("years").cast("bigint").cast("string"),
        "title": text.present(F.col("title")),
        "github": F.when(F.col("github").isNotNull(), F.format_string("%.2f", "github")),
        "skills": F.when(F.size(named) > 0, F.array_join(named, ", ")),
        "notice": F.when(
            F.col("notice_days") > cfg.notice_free_days, F.col("notice_days").cast("bigint").cast("string")
        ),
    }


def with_slots(ranked: DataFrame, cfg: RankConfig) -> DataFrame:
    """Add the slot values as columns ``<slot>_text``, so that each is made once per row."""
    return ranked.withColumns({f"{name}_text": value for name, value in slots(cfg).items()})


def _slot_columns() -> dict[str, Column]:
    return {name: F.col(f"{name}_text") for name in SLOTS}


def fill(pattern: Column) -> Column:
    """A pattern with its slots filled: ``{slot}`` is a value, ``[...]`` a part that needs its values.

    A missing value is marked first and takes its part away. Braces and brackets inside
    values are replaced meanwhile, so that a value is never read as part of the pattern.
    """
    out = pattern
    for name, value in _slot_columns().items():
        shown = F.coalesce(F.translate(value, "{}[]", _HIDDEN), F.lit(_MISSING))
        out = F.replace(out, F.lit("{" + name + "}"), shown)
    out = F.regexp_replace(out, rf"\[[^\[\]]*{_MISSING}[^\[\]]*\]", "")
    return F.translate(F.translate(out, "[]" + _MISSING, ""), _HIDDEN, "{}[]")


def choose(options: Column, start: Column) -> Column:
    """The option at ``start``, or the next one (around the end) that is not empty."""
    turned = F.concat(F.slice(options, start + 1, F.size(options)), F.slice(options, F.lit(1), start))
    return F.get(F.filter(turned, lambda o: o != ""), F.lit(0))


def _per_tier(table: dict[str, Column]) -> Column:
    pairs = [c for name, value in table.items() for c in (F.lit(name), value)]
    return F.element_at(F.create_map(*pairs), F.col("tier"))


def options() -> Column:
    """All sentences the tier of a row offers, without concerns."""
    patterns = {t: F.array(*[F.lit(p) for p in every]) for t, every in fixed.TIER_PATTERNS.items()}
    return F.transform(_per_tier(patterns), fill)


def lead(draw: int) -> Column:
    """The sentence picked for a row out of its ``options`` column."""
    return choose(F.col("options"), stable_pick(F.col("candidate_id"), F.size("options"), draw))


def extra_fact() -> Column:
    return fill(_per_tier({t: F.lit(p) for t, p in fixed.TIER_FACTS.items()}))


def concern() -> Column:
    return F.concat(
        fill(F.lit(fixed.NOTICE_CONCERN)),
        F.when(F.col("hopper"), F.lit(fixed.HOPPER_CONCERN)).otherwise(F.lit("")),
    )


def allowed_digits() -> Column:
    """Digit runs a sentence may contain: those of years, notice, score, title and named skills."""
    shown = _slot_columns() | {"notice": F.col("notice_days").cast("bigint").cast("string")}
    return F.array_distinct(text.digit_runs(F.concat_ws(" ", *shown.values())))


def ungrounded_digits(sentence: Column, allowed: Column) -> Column:
    return F.array_except(text.digit_runs(sentence), allowed)


def is_grounded(sentence: Column, allowed: Column) -> Column:
    """No open placeholder, and no number that the record does not hold."""
    return (
        ~F.contains(sentence, F.lit("{"))
        & ~F.contains(sentence, F.lit("}"))
        & (F.size(ungrounded_digits(sentence, allowed)) == 0)
    )


def is_specific(sentence: Column) -> Column:
    """Does the sentence hold a number, the title or a matched skill?"""
    low = F.lower(sentence)
    title = F.lower("title_text")
    skills = F.coalesce("matched_set", F.array().cast("array<string>"))
    return (
        F.rlike(sentence, F.lit(r"\p{Nd}"))
        | F.coalesce(F.contains(low, title), F.lit(False))
        | F.exists(skills, lambda s: (text.strip(s) != "") & F.contains(low, text.strip(s)))
    )


def closed(body: Column) -> Column:
    """Body plus concerns as one tidy sentence."""
    return text.tidy(F.concat(body, F.col("concern"), F.lit(".")))


def with_sentence(ranked: DataFrame, cfg: RankConfig) -> DataFrame:
    """Add ``reasoning``: the richest sentence that fits, is grounded and says something specific.

    A row without one gets a general phrase chosen by its id, or the first one that fits if
    that is too long. Helper columns ``concern, allowed, general, is_general,
    title_text`` stay for the step that makes sentences unique.
    """
    limit = cfg.max_reason_chars
    phrases = F.array(*[F.lit(p) for p in fixed.GENERAL_PHRASES])
    pick = stable_pick(F.col("candidate_id"), len(fixed.GENERAL_PHRASES))

    def fits(c: Column) -> Column:
        return (F.length(c) <= limit) & is_grounded(c, F.col("allowed")) & is_specific(c)

    # never cut: a phrase that is too long with its concern gives way to the first one that fits
    fitting = F.filter(F.transform(phrases, closed), lambda s: F.length(s) <= limit)
    none = F.raise_error(F.lit(f"no general phrase fits into {limit} characters"))
    short = F.when(F.length("general") <= limit, F.col("general")).otherwise(F.coalesce(F.get(fitting, F.lit(0)), none))
    texts = [f"{name}_text" for name in SLOTS]
    return (
        with_slots(ranked, cfg)
        .withColumns({"concern": concern(), "allowed": allowed_digits(), "options": options()})
        .withColumns({"lead": lead(0), "other_lead": lead(1)})
        .withColumns(
            {
                "with_fact": closed(F.concat("lead", extra_fact())),
                "plain": closed(F.col("other_lead")),
                "general": closed(F.get(phrases, pick)),
            }
        )
        .withColumns({"fact_fits": fits(F.col("with_fact")), "plain_fits": fits(F.col("plain"))})
        .withColumn(
            "reasoning",
            F.when(F.col("fact_fits"), F.col("with_fact"))
            .when(F.col("plain_fits"), F.col("plain"))
            .otherwise(short),
        )
        .withColumn("is_general", ~(F.col("fact_fits") | F.col("plain_fits")))
        .drop("with_fact", "plain", "options", "lead", "other_lead", "fact_fits", "plain_fits", *[t for t in texts if t != "title_text"])
    )


def with_repeat_number(rows: DataFrame) -> DataFrame:
    """Number the uses of the same sentence within a job in rank order; 1 is the first use."""
    w = Window.partitionBy("job_id", "reasoning").orderBy("rank", "candidate_id")
    return rows.withColumn("use_no", F.row_number().over(w))


def unique_by_reference(rows: DataFrame) -> DataFrame:
    """Repeated sentences get the id of their row; no order of work is needed."""
    tagged = F.concat(F.regexp_replace("reasoning", r"\.$", ""), F.lit(" (ref "), F.col("candidate_id"), F.lit(")."))
    return (
        with_repeat_number(rows)
        .withColumn("reasoning", F.when(F.col("use_no") == 1, F.col("reasoning")).otherwise(tagged))
        .drop("use_no")
    )


def other_sentences(cfg: RankConfig) -> Column:
    """Other sentences for a row in order of preference: general phrases from the one of its id on,
    the same with its title, the same with its id; only those that fit and are grounded."""
    n = len(fixed.GENERAL_PHRASES)
    every = F.array(*[F.lit(p) for p in fixed.GENERAL_PHRASES])
    start = stable_pick(F.col("candidate_id"), n)
    turned = F.concat(F.slice(every, start + 1, n), F.slice(every, F.lit(1), start))
    title = F.col("title_text")
    id_digits = text.digit_runs(F.col("candidate_id"))

    def tagged(tag: Column) -> Column:
        return F.transform(turned, lambda p: F.concat(p, F.lit(" ("), tag, F.lit(")")))

    def usable(bodies: Column, allowed: Column) -> Column:
        return F.filter(
            F.transform(bodies, closed),
            lambda s: (F.length(s) <= cfg.max_reason_chars) & is_grounded(s, allowed),
        )

    none = F.array().cast("array<string>")
    return F.concat(
        usable(turned, F.col("allowed")),
        F.when(title.isNotNull(), usable(tagged(title), F.col("allowed"))).otherwise(none),
        usable(tagged(F.concat(F.lit("ref "), F.col("candidate_id"))), F.array_union(F.col("allowed"), id_digits)),
    )


def unique_in_order(rows: DataFrame, cfg: RankConfig) -> DataFrame:
    """Give every row of a job its own sentence, in rank order.

    A row keeps its sentence unless an earlier row has it; then it takes its first
    unused other one. What a row gets depends on all rows of its job before it, so
    tasks read their jobs as sorted streams and remember the sentences of one job (at
    most N). The others are only made for rows that can need them: repeats, and rows
    whose sentence is a general one.
    """
    helpers = ("concern", "allowed", "general", "is_general", "title_text", "use_no")
    needs = (F.col("use_no") > 1) | F.col("is_general")
    none = F.array().cast("array<string>")
    ready = (
        with_repeat_number(rows)
        .withColumn("others", F.when(needs, other_sentences(cfg)).otherwise(none))
        .drop(*helpers)
        .repartition("job_id")
        .sortWithinPartitions("job_id", "rank", "candidate_id")
    )
    out_schema = ready.drop("others").schema

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, used = None, set()
        for batch in batches:
            chosen = []
            columns = (batch.column(c).to_pylist() for c in ("job_id", "reasoning", "others"))
            for row_job, own, others in zip(*columns):
                if row_job != job:
                    job, used = row_job, set()
                sentence = next((t for t in (own, *others) if t not in used), None)
                if sentence is None:
                    raise NoUniqueSentence(f"job {job}")
                used.add(sentence)
                chosen.append(sentence)
            at = batch.schema.get_field_index("reasoning")
            yield batch.set_column(at, "reasoning", pa.array(chosen, pa.string())).drop_columns(["others"])

    return ready.mapInArrow(assign, out_schema)
