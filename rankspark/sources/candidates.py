"""Candidate records from JSON lines.

A line is parsed once into a variant. Lines that are not UTF-8, not JSON or not an
object go to a quarantine table; a wrong type inside a record only empties that field.
Compressed files (``.gz``) are read as they are, but cannot be split: many files of
moderate size load best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.functions import text
from rankspark.session import cut


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with the file they come from and an order to keep the first of repeated ids."""
    return spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("source_pos"),
    )


def parse(lines: DataFrame) -> DataFrame:
    """Lines with content, as a variant ``doc`` and a ``fault`` (null for a good line).

    The variant comes out of an explode of one element: filters on it stay above, so a
    line is parsed once and not again for every condition.
    """
    valid = F.is_valid_utf8("value")
    doc = F.try_parse_json(F.when(valid, F.col("value")))
    kind = F.schema_of_variant("doc")
    return (
        lines.where(~valid | (text.strip(F.col("value")) != ""))
        .withColumn("doc", F.explode(F.array(doc)))
        .withColumn(
            "fault",
            F.when(F.col("doc").isNotNull() & F.startswith(kind, F.lit("OBJECT")), F.lit(None))
            .when(F.col("doc").isNotNull(), F.lit("not an object"))
            .when(valid, F.lit("not json"))
            .otherwise(F.lit("not utf-8")),
        )
    )


def quarantine(parsed: DataFrame) -> DataFrame:
    """Bad lines with the reason."""
    return parsed.where(F.col("fault").isNotNull()).select("value", "source_pos", "fault")


def _is(v: Column, *kinds: str) -> Column:
    found = F.rlike(F.schema_of_variant(v), F.lit(f"^(?:{'|'.join(kinds)})"))
    return F.coalesce(found, F.lit(False))


def _at(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def scalar(v: Column) -> Column:
    """A scalar as text; null for null and for containers."""
    return F.when(~_is(v, "ARRAY", "OBJECT", "VOID"), F.try_variant_get(v, "$", "string"))


def number(v: Column) -> Column:
    """A number as double; null for anything else, text with digits included."""
    return F.when(~_is(v, "ARRAY", "OBJECT", "VOID", "STRING", "BOOLEAN"), F.try_variant_get(v, "$", "double"))


def items(v: Column) -> Column:
    """Elements of an array; an empty array for anything else."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def objects(v: Column) -> Column:
    return F.filter(items(v), lambda x: _is(x, "OBJECT"))


def records(parsed: DataFrame, signals_field: str = "signals", id_field: str = "candidate_id") -> DataFrame:
    """Good lines as records of the declared schema, with ``source_pos``.

    Lines without an id are left out. ``signals_field`` names the object that holds
    the behavioural signals in the input.
    """
    doc = F.col("doc")
    profile = _at(doc, "profile")
    signals = _at(doc, signals_field)
    scores = F.try_variant_get(signals, "$.skill_assessment_scores", "map<string,variant>")
    texts = ("headline", "current_title", "current_company", "current_industry", "summary")
    rates = ("recruiter_response_rate", "interview_completion_rate", "github_activity_score", "notice_period_days")

    def skill_name(s: Column) -> Column:
        name = F.when(_is(s, "OBJECT"), scalar(_at(s, "name"))).otherwise(scalar(s))
        return F.struct(name.alias("name"))

    def role(h: Column) -> Column:
        fields = [scalar(_at(h, k)).alias(k) for k in ("company", "title", "description", "start_date", "end_date")]
        return F.struct(*fields, number(_at(h, "duration_months")).alias("duration_months"))

    def study(e: Column) -> Column:
        return F.struct(*[scalar(_at(e, k)).alias(k) for k in ("field_of_study", "degree")])

    return (
        parsed.where(F.col("fault").isNull())
        .select(
            F.try_variant_get(doc, f"$.{id_field}", "string").alias("candidate_id"),
            F.struct(
                *[scalar(_at(profile, k)).alias(k) for k in texts],
                number(_at(profile, "years_of_experience")).alias("years_of_experience"),
            ).alias("profile"),
            F.transform(items(_at(doc, "skills")), skill_name).alias("skills"),
            F.transform(objects(_at(doc, "career_history")), role).alias("career_history"),
            F.transform(objects(_at(doc, "education")), study).alias("education"),
            F.struct(
                *[number(_at(signals, k)).alias(k) for k in rates],
                F.transform_values(scores, lambda _, v: number(v)).alias("skill_assessment_scores"),
            ).alias("signals"),
            number(_at(doc, "notice_period_days")).alias("notice_period_days"),
            "source_pos",
        )
        .where(F.col("candidate_id").isNotNull())
    )


def keep_first(rows: DataFrame, key: str = "candidate_id", position: str = "source_pos") -> DataFrame:
    """First row per id by position; positions of an id must differ and must not change between two reads.

    Only ids and positions are aggregated, reduced per task before the shuffle; the rows are
    then met by a semi-join, so no whole row is sorted or held in an aggregate.
    """
    first = rows.groupBy(key).agg(F.min(position).alias("first_pos")).withColumnRenamed(key, "first_key")
    same = (F.col(key) == F.col("first_key")) & (F.col(position) == F.col("first_pos"))
    return rows.join(first, same, "left_semi")


def repeated_ids(rows: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Ids that occur more than once, with their number of rows."""
    return (
        rows.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_rows") > 1)
    )


def scan_candidates(
    spark: SparkSession, path: str | list[str], signals_field: str = "signals"
) -> DataFrame:
    """Read, parse and keep the first record per id.

    Positions come from the splits of one scan, and another scan may split the files
    otherwise. So parsed records are stored with their positions once, and everything
    after reads the stored table.
    """
    rows = cut(records(parse(read_lines(spark, path)), signals_field))
    return keep_first(rows).drop("source_pos")


def compose_text() -> Column:
    """The whole text of a record in a fixed order of parts; empty parts vanish."""
    profile, history, education = F.col("profile"), F.col("career_history"), F.col("education")

    def labelled(label: str, c: Column) -> Column:
        return F.when(c != "", F.concat(F.lit(label), c))

    title, company = text.clean(profile["current_title"]), text.clean(profile["current_company"])
    place = F.when(company != "", text.strip(F.concat(title, F.lit(" at "), company))).otherwise(title)

    def field(e: Column) -> Column:
        return F.coalesce(F.nullif(e["field_of_study"], F.lit("")), e["degree"])

    parts = [
        F.nullif(text.clean(profile["headline"]), F.lit("")),
        F.nullif(place, F.lit("")),
        F.nullif(text.clean(profile["current_industry"]), F.lit("")),
        labelled("Skills: ", text.join_nonempty(F.transform("skills", lambda s: s["name"]))),
        F.nullif(text.clean(profile["summary"]), F.lit("")),
        labelled("Experience: ", text.join_nonempty(F.transform(history, lambda h: h["title"]))),
        F.nullif(text.join_nonempty(F.transform(history, lambda h: h["description"]), " "), F.lit("")),
        labelled("Education: ", text.join_nonempty(F.transform(education, field))),
    ]
    return F.concat_ws(" | ", *parts)
