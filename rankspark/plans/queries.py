"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankspark import constants as fixed
from rankspark.config import RankConfig
from rankspark.functions import career, hashing, text, vectors
from rankspark.functions.vectors import HashedTokens
from rankspark.operators import facts as facts_
from rankspark.operators import quality, ranking, reasoning, rules, scoring, similarity, skills
from rankspark.operators.recall import missing_records, score_summary, top_matches
from rankspark.plans import ranking as runs
from rankspark.plans.views import Views
from rankspark.session import cut, scratch_path, tasks_of
from rankspark.sources import candidates, features, jobs, postings, ranked_csv
from rankspark.sources.bucketed import BucketedStore
from rankspark.streaming.keyed import ingest_first

# Sizes for the test tables: every tier and both cuts occur.
CFG = RankConfig(recall_k=200, top_n=20, top_tier_until=4, mid_tier_until=16, score_digits=6)
TEXT_CFG = RankConfig(recall_k=10, top_n=10, score_digits=6)

JOB = 0  # the job of queries about one job

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Views(spark, sf_dir))

    REGISTERED[fn.__name__] = run
    return fn


def r6(c: Column | str) -> Column:
    return scoring.rounded(F.col(c) if isinstance(c, str) else c, 6)


# Shared steps


def all_facts(v: Views) -> DataFrame:
    return facts_.of_all(v.cand, v.roles, v.sig, v.skl, CFG)


def marked(v: Views) -> tuple[DataFrame, DataFrame]:
    return runs.marked_tables(v.vec, v.jobs, v.cand, v.roles, v.sig, v.skl, CFG)


def best(v: Views) -> DataFrame:
    return runs.best(marked(v)[0], CFG)


def ranked(v: Views) -> DataFrame:
    return runs.rank_tables(v.vec, v.jobs, v.cand, v.roles, v.sig, v.skl, CFG)


def explained(v: Views) -> DataFrame:
    return reasoning.with_sentence(ranked(v), CFG)


def final(v: Views) -> DataFrame:
    return runs.output(runs.explain_rows(ranked(v), CFG))


def ranked_bad(v: Views) -> DataFrame:
    """Ranked rows with planted faults, so that every check finds something."""
    rows = reasoning.unique_by_reference(explained(v)).select(
        "job_id", F.col("rank").alias("row_no"), "candidate_id", "rank", "score", "reasoning"
    )
    w = Window.partitionBy("job_id").orderBy("row_no")
    at = F.col("row_no")
    bad = rows.select(
        "job_id",
        "row_no",
        F.when(at == 3, F.lag("candidate_id").over(w))
        .when(at == 13, F.concat(F.lit("NOBODY_"), F.col("job_id").cast("string")))
        .otherwise(F.col("candidate_id"))
        .alias("candidate_id"),
        F.when(at == 5, F.col("rank") + 1).otherwise(F.col("rank")).alias("rank"),
        F.when(at == 7, F.lag("score").over(w) + 0.01)
        .when(at == 9, F.lit(1.5))
        .otherwise(F.col("score"))
        .alias("score"),
        F.when(at == 11, F.lit("  "))
        .when(at == 15, F.concat("reasoning", F.lit(" 99999")))
        .otherwise(F.col("reasoning"))
        .alias("reasoning"),
    )
    return cut(bad)


def facts_of(v: Views, rows: DataFrame) -> DataFrame:
    """Facts of the ids of some ranked rows."""
    return facts_.from_tables(rows, v.cand, v.roles, v.sig, v.skl, CFG)


def records(v: Views) -> DataFrame:
    return candidates.keep_first(candidates.records(v.parsed))


# Scans, sources and sinks


@query
def scan_candidates(v: Views) -> DataFrame:
    history = F.col("career_history")
    return records(v).select(
        "candidate_id",
        "source_pos",
        F.col("profile.headline").alias("headline"),
        F.col("profile.current_company").alias("company"),
        career.known(F.col("profile.years_of_experience")).alias("stated_years"),
        F.length("profile.summary").cast("bigint").alias("summary_chars"),
        F.size("skills").cast("bigint").alias("n_skill_entries"),
        F.size(history).cast("bigint").alias("n_roles"),
        career.tenure_in(history).alias("tenure_months"),
        F.col("signals.notice_period_days").alias("notice_days"),
    )


@query
def quarantine_rows(v: Views) -> DataFrame:
    return candidates.quarantine(v.parsed).select("source_pos", "fault", "value")


@query
def scan_valid_ids(v: Views) -> DataFrame:
    return v.arrivals.where(F.col("candidate_id").isNotNull())


@query
def jobs_resolved(v: Views) -> DataFrame:
    given = v.job_texts.select(
        "job_id",
        F.when(F.col("job_id") % 3 == 0, F.concat(F.lit(" \n"), "jd_text", F.lit(" ")))
        .when(F.col("job_id") % 3 == 1, F.lit(""))
        .alias("inline_text"),
        F.when(F.col("job_id") % 5 != 0, F.concat(F.lit("file: "), "jd_text")).alias("file_text"),
    )
    return jobs.resolve(given).select("job_id", "jd_text")


@query
def features_roundtrip(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "features")
    features.write(features.build(records(v)), path)
    return features.read(v.spark, path).select(
        "candidate_id",
        "text_hash",
        "model",
        F.size("embedding").cast("bigint").alias("dim"),
        r6("norm").alias("norm"),
        *[r6(F.col("embedding")[k].cast("double")).alias(f"w{k}") for k in range(4)],
    )


@query
def manifest_summary(v: Views) -> DataFrame:
    return features.manifest(v.vec)


@query
def ranked_output(v: Views) -> DataFrame:
    return ranked_csv.output_rows(final(v))


@query
def ranked_reload(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "ranked")
    ranked_csv.write(final(v), path, v.job_texts, CFG.top_n)
    rows = ranked_csv.read(v.spark, path)
    return rows.select(F.col("job_id").cast("bigint").alias("job_id"), "candidate_id", "rank", "score", "reasoning")


# Text and records


@query
def compose_text(v: Views) -> DataFrame:
    rows = records(v)
    whole = rows.select("candidate_id", candidates.compose_text().alias("text"))
    return whole.withColumn("text_hash", F.sha2("text", 256))


@query
def join_nonempty(v: Views) -> DataFrame:
    lines = F.split(F.col("text"), "\n", -1)
    return v.table("documents").select("doc_id", text.join_nonempty(lines).alias("joined"))


@query
def tidy_text(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", text.tidy(F.col("text")).alias("tidied"))


@query
def skill_names(v: Views) -> DataFrame:
    names = text.nonempty_items(F.transform("skills", lambda s: s["name"]))
    return records(v).select(
        "candidate_id", F.array_join(names, "|").alias("names"), F.size(names).cast("bigint").alias("n_names")
    )


@query
def skill_intersection(v: Views) -> DataFrame:
    low = F.lower(text.strip(F.col("skill")))
    return (
        v.skl.where(low.isin(list(CFG.ai_keywords)))
        .groupBy("candidate_id")
        .agg(F.array_join(F.array_sort(F.collect_set(low)), ",").alias("ai_skills"))
    )


# Career figures


@query
def month_index(v: Views) -> DataFrame:
    shifted = F.concat(F.lit("  "), F.replace(F.col("start_date"), F.lit("-0"), F.lit("-1")))
    return v.roles.select(
        "role_id",
        career.month_index(F.col("start_date")).cast("bigint").alias("start_month"),
        career.month_index(F.col("end_date")).cast("bigint").alias("end_month"),
        career.month_index(shifted).cast("bigint").alias("shifted_month"),
    )


@query
def career_span(v: Views) -> DataFrame:
    return facts_.career_span(v.roles)


@query
def career_tenure(v: Views) -> DataFrame:
    return v.roles.groupBy("candidate_id").agg(F.sum(career.role_months(F.col("duration_months"))).alias("tenure_months"))


@query
def mean_tenure(v: Views) -> DataFrame:
    return facts_.career_figures(v.roles, CFG).select("candidate_id", r6("mean_tenure_years").alias("mean_tenure_years"))


@query
def consulting_lifer(v: Views) -> DataFrame:
    return facts_.career_figures(v.roles, CFG).select("candidate_id", "only_consulting")


@query
def experience_years(v: Views) -> DataFrame:
    return all_facts(v).select("candidate_id", r6("years").alias("years"))


@query
def sentinel_nulls(v: Views) -> DataFrame:
    return v.sig.select("candidate_id", career.known(F.col("github_activity_score")).alias("github"))


@query
def stable_pick(v: Views) -> DataFrame:
    c = F.col("candidate_id")
    return v.cand.select(
        "candidate_id",
        hashing.stable_pick(c, 24).alias("pick_24"),
        hashing.stable_pick(c, 4).alias("pick_4"),
        hashing.stable_pick(c, 4, draw=1).alias("second_pick_4"),
    )


# Drop rules


def _rule(name: str, *columns: str) -> None:
    def run(v: Views) -> DataFrame:
        fired = all_facts(v).where(rules.rules(CFG)[name])
        return fired.select("candidate_id", *columns)

    short = {"overlapping_timeline": "overlap", "experience_inflation": "inflation"}.get(name, name)
    run.__name__ = f"rule_{short}"
    query(run)


_rule("domain_mismatch", "title")
_rule("overlapping_timeline", "tenure_months", "span_months")
_rule("experience_inflation", "stated_years", "span_months")
_rule("fake_expert", "years")
_rule("title_mismatch", "title")


@query
def drop_reason(v: Views) -> DataFrame:
    return marked(v)[0].select("job_id", "candidate_id", "drop_reason")


@query
def drop_reason_counts(v: Views) -> DataFrame:
    return rules.reason_counts(marked(v)[0])


@query
def funnel_counts(v: Views) -> DataFrame:
    pairs, recalled = marked(v)
    return rules.funnel(recalled, pairs, CFG.top_n)


# Recall and joins


@query
def recall_topk(v: Views) -> DataFrame:
    """One job against all candidates."""
    one = v.jobs.where(F.col("job_id") == JOB)
    return top_matches(v.vec, one, CFG).select("candidate_id", "sem_score", "recall_rank")


@query
def rank_one_job(v: Views) -> DataFrame:
    """One job against all stored vectors with the default sizes and rounding, to the final rows."""
    one = v.jobs.where(F.col("job_id") == JOB)
    top = runs.best(runs.marked_tables(v.vec, one, v.cand, v.roles, v.sig, v.skl, RankConfig())[0], RankConfig())
    return top.select("job_id", "candidate_id", "rank", r6("score").alias("score"))


@query
def recall_topk_multi(v: Views) -> DataFrame:
    return top_matches(v.vec, v.jobs, CFG)


@query
def score_all_pairs(v: Views) -> DataFrame:
    """All jobs against all candidates; the pairs are summed up where they arise."""
    s = score_summary(v.vec, v.jobs, CFG)
    return s.select("job_id", "n_scored", "min_score", "max_score", r6("mean_score").alias("mean_score"))


@query
def recall_join(v: Views) -> DataFrame:
    joined = v.cand.join(runs.recall(v.vec, v.jobs, CFG), "candidate_id")
    return joined.select("job_id", "candidate_id", "sem_score", "current_title", r6("years_of_experience").alias("years"))


@query
def recall_missing(v: Views) -> DataFrame:
    """Recalled ids that never arrived."""
    recalled = runs.recall(v.vec, v.jobs, CFG)
    arrived = v.arrivals.select("candidate_id").distinct()
    return missing_records(recalled, arrived).select("job_id", "candidate_id")


@query
def match_skills(v: Views) -> DataFrame:
    recalled = runs.recall(v.vec, v.jobs, CFG)
    named = skills.named_skills(skills.matched_rows(recalled, v.jobs, v.skl, CFG), CFG)
    return named.select(
        "job_id",
        "candidate_id",
        F.array_join("named_skills", ", ").alias("named"),
        F.size("matched_set").cast("bigint").alias("n_matched"),
    )


@query
def incremental_todo(v: Views) -> DataFrame:
    wanted = v.cand.select("candidate_id", F.lit("m1").alias("model"), F.sha2("candidate_id", 256).alias("text_hash"))
    made_for = F.concat(F.lit("CAND_"), F.lpad(F.col("vec_id").cast("string"), 7, "0"))
    done = v.table("embeddings").select(
        made_for.alias("candidate_id"),
        F.when(F.col("label") % 2 == 0, F.lit("m1")).otherwise(F.lit("m0")).alias("model"),
        F.sha2(made_for, 256).alias("text_hash"),
    )
    return features.todo(wanted, done, ["candidate_id", "model", "text_hash"])


@query
def bucketed_todo(v: Views) -> DataFrame:
    """The same question to a store in buckets, whose side is not shuffled."""
    wanted = v.cand.select("candidate_id", F.lit("m1").alias("model"), F.sha2("candidate_id", 256).alias("text_hash"))
    made_for = F.concat(F.lit("CAND_"), F.lpad(F.col("vec_id").cast("string"), 7, "0"))
    done = v.table("embeddings").select(
        made_for.alias("candidate_id"),
        F.when(F.col("label") % 2 == 0, F.lit("m1")).otherwise(F.lit("m0")).alias("model"),
        F.sha2(made_for, 256).alias("text_hash"),
        "embedding",
    )
    return BucketedStore.create(done, scratch_path(v.spark, "bucketed"), buckets=8).todo(wanted)


@query
def bucketed_merge(v: Views) -> DataFrame:
    """Arrivals of two kinds merged into a store in buckets, which is compacted after."""
    rows = scan_valid_ids(v)
    earlier = F.col("channel").isin("view", "click")
    store = BucketedStore.create(candidates.keep_first(rows.where(earlier)), scratch_path(v.spark, "bucketed"), buckets=8)
    store.merge(rows.where(~earlier))
    store.compact()
    return store.read()


@query
def stream_ingest(v: Views) -> DataFrame:
    """Raw lines through the stream in two runs: those of documents with odd numbers come late, the first file with them again."""
    folder = scratch_path(v.spark, "stream")
    lines = cut(v.lines.withColumn("late", F.col("source_pos") % 2))
    files = min(400, max(4, tasks_of(lines)))  # both folders of the second run fit into one batch

    def put(late: int, name: str) -> None:
        some = lines.where(F.col("late") == late).repartitionByRange(files, "source_pos").sortWithinPartitions("source_pos")
        some.select("value").write.mode("append").text(f"{folder}/in/{name}")

    def run() -> None:
        ingest_first(v.spark, f"{folder}/in/*", f"{folder}/out", f"{folder}/progress", make_encoder=None).awaitTermination()

    put(0, "a")
    run()
    put(1, "b")
    put(0, "c")
    run()
    found = v.spark.read.parquet(f"{folder}/out/records")
    return found.select(
        "candidate_id",
        "batch_id",
        F.col("profile.headline").alias("headline"),
        F.length("profile.summary").cast("bigint").alias("summary_chars"),
        F.col("signals.notice_period_days").alias("notice_days"),
    )


# Repeats, merges, counts


@query
def dedupe_first(v: Views) -> DataFrame:
    return candidates.keep_first(scan_valid_ids(v))


@query
def duplicate_ids(v: Views) -> DataFrame:
    return candidates.repeated_ids(v.arrivals)


@query
def merge_features(v: Views) -> DataFrame:
    rows = scan_valid_ids(v)
    earlier = F.col("channel").isin("view", "click")
    return features.merge(rows.where(earlier), rows.where(~earlier))


@query
def count_consistency(v: Views) -> DataFrame:
    made = v.table("embeddings").select(
        F.concat(F.lit("CAND_"), F.lpad(F.col("vec_id").cast("string"), 7, "0")).alias("candidate_id")
    )
    return features.consistency(v.cand, made)


# Vectors


@query
def l2_normalize(v: Views) -> DataFrame:
    unit = v.table("embeddings").select("vec_id", "embedding", vectors.l2_normalize(F.col("embedding")).alias("unit"))
    return unit.select(
        "vec_id",
        r6(vectors.norm(F.col("embedding"))).alias("length"),
        r6(vectors.norm(F.col("unit"))).alias("unit_length"),
        r6(F.get("unit", F.lit(0))).alias("first_value"),
        r6(F.array_max("unit")).alias("largest_value"),
    )


@query
def cosine_scores(v: Views) -> DataFrame:
    """Every vector with the next one."""
    a = v.table("embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = v.table("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", r6(vectors.cosine(F.col("a"), F.col("b"))).alias("cosine"))


@query
def hashed_vectors(v: Views) -> DataFrame:
    """Token counts per hash bucket over whole documents."""
    made = vectors.encode(v.wide_table("documents").select("doc_id", "text"), "text", HashedTokens, normalize=False)
    return (
        made.select("doc_id", F.posexplode_outer("embedding").alias("bucket", "n"))
        .where(F.col("n") > 0)
        .select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.col("n").cast("bigint").alias("n_tokens"))
    )


@query
def text_similarity_topk(v: Views) -> DataFrame:
    """Documents most similar to every benchmark text."""
    docs = vectors.encode(v.wide_table("documents").select("doc_id", "text"), "text", HashedTokens, normalize=False)
    items = vectors.encode(
        v.table("benchmark").select(F.col("item_id").alias("job_id"), "text"), "text", HashedTokens, "job_vec", False
    )
    made = docs.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("candidate_id"), "embedding")
    return top_matches(made, items, TEXT_CFG).select(
        "job_id", F.col("candidate_id").cast("bigint").alias("doc_id"), "sem_score", "recall_rank"
    )


def posting_index(v: Views) -> postings.Index:
    """Posting lists over the tokens of all documents."""
    path = scratch_path(v.spark, "postings")
    docs = v.wide_table("documents").select(F.col("doc_id").alias("candidate_id"), "text")
    postings.write(docs, path)
    return postings.read(v.spark, path)


@query
def posting_lists(v: Views) -> DataFrame:
    """Number of documents and largest weight per token."""
    lists = postings.list_summary(posting_index(v).blocks)
    return lists.select("term", "n_texts", r6("max_weight").alias("max_weight"))


@query
def token_similarity_topk(v: Views) -> DataFrame:
    """Documents most similar to every benchmark text by whole tokens, through posting lists."""
    items = v.table("benchmark").select(F.col("item_id").alias("job_id"), F.col("text").alias("jd_text"))
    return similarity.similar_texts(posting_index(v), items, TEXT_CFG).withColumnRenamed("candidate_id", "doc_id")


# Factors and scores


@query
def mult_consulting(v: Views) -> DataFrame:
    return all_facts(v).select("candidate_id", scoring.consulting(CFG).alias("f_consulting"))


@query
def mult_hopper(v: Views) -> DataFrame:
    return all_facts(v).select("candidate_id", scoring.hopper(CFG).alias("f_hopper"))


@query
def mult_notice(v: Views) -> DataFrame:
    return all_facts(v).select("candidate_id", "notice_days", r6(scoring.notice(CFG)).alias("f_notice"))


@query
def mult_engagement(v: Views) -> DataFrame:
    return all_facts(v).select("candidate_id", r6(scoring.engagement(CFG)).alias("f_engagement"))


@query
def multiplier_breakdown(v: Views) -> DataFrame:
    return scoring.with_factors(all_facts(v), CFG).select(
        "candidate_id",
        "f_consulting",
        "f_hopper",
        r6("f_notice").alias("f_notice"),
        r6("f_engagement").alias("f_engagement"),
        r6("multiplier").alias("multiplier"),
        "hopper",
    )


@query
def final_scores(v: Views) -> DataFrame:
    return runs.score(marked(v)[0], CFG).select("job_id", "candidate_id", "sem_score", "raw_score")


@query
def final_topn(v: Views) -> DataFrame:
    top = ranking.top_n(runs.score(marked(v)[0], CFG), CFG)
    return top.select("job_id", "candidate_id", "sem_score", "raw_score")


@query
def rank_position(v: Views) -> DataFrame:
    return ranking.top_n(runs.score(marked(v)[0], CFG), CFG).select("job_id", "candidate_id", "rank")


@query
def normalize_scores(v: Views) -> DataFrame:
    return best(v).select("job_id", "candidate_id", "raw_score", r6("score").alias("score"))


@query
def rank_tiers(v: Views) -> DataFrame:
    return best(v).select("job_id", "candidate_id", "rank", "tier")


@query
def rank_candidates(v: Views) -> DataFrame:
    """The whole run over separate tables."""
    return final(v).withColumn("score", r6("score"))


@query
def rank_records(v: Views) -> DataFrame:
    """The whole run from raw lines: ingest, text, vectors, recall, rules, factors, sentences."""
    rows = cut(records(v).drop("source_pos"))
    made = cut(features.build(rows))
    wanted = runs.embed_jobs(v.job_texts.select("job_id", "jd_text"))
    out = runs.rank_candidates(rows, made, wanted, CFG)
    return out.withColumn("score", r6("score"))


# Sentences


@query
def reason_fragments(v: Views) -> DataFrame:
    values = reasoning.slots(CFG)
    return ranked(v).select("job_id", "candidate_id", *[c.alias(f"{n}_text") for n, c in values.items()])


@query
def reason_by_tier(v: Views) -> DataFrame:
    rows = reasoning.with_slots(ranked(v), CFG).withColumn("options", reasoning.options())
    return rows.select(
        "job_id",
        "candidate_id",
        "tier",
        F.concat(reasoning.lead(0), reasoning.extra_fact()).alias("rich"),
        reasoning.lead(1).alias("plain"),
    )


@query
def concern_clause(v: Views) -> DataFrame:
    return reasoning.with_slots(ranked(v), CFG).select("job_id", "candidate_id", reasoning.concern().alias("concern"))


@query
def grounding_check(v: Views) -> DataFrame:
    planted = F.concat("reasoning", F.lit(" 99999"))
    return explained(v).select(
        "job_id",
        "candidate_id",
        reasoning.is_grounded(F.col("reasoning"), F.col("allowed")).alias("grounded"),
        reasoning.is_grounded(planted, F.col("allowed")).alias("planted_grounded"),
    )


@query
def ungrounded_digits(v: Views) -> DataFrame:
    """Digit runs of ranked rows with planted faults that no field of the record holds."""
    bad = ranked_bad(v)
    mine = runs.narrow(v.skl, bad, "candidate_id")
    tokens = quality.record_digits(facts_of(v, bad)).unionByName(quality.skill_digits(mine))
    return quality.loose_digits(bad, tokens).select(
        "job_id", F.col("row_no").cast("bigint").alias("row_no"), "candidate_id", "token"
    )


@query
def reason_specific(v: Views) -> DataFrame:
    return explained(v).select(
        "job_id",
        "candidate_id",
        reasoning.is_specific(F.col("reasoning")).alias("reasoning_specific"),
        reasoning.is_specific(F.col("general")).alias("general_specific"),
    )


@query
def build_reasoning(v: Views) -> DataFrame:
    return explained(v).select("job_id", "candidate_id", "rank", "reasoning")


@query
def reason_collisions(v: Views) -> DataFrame:
    rows = reasoning.with_repeat_number(explained(v)).where(F.col("use_no") > 1)
    return rows.select("job_id", "candidate_id", "rank", "use_no")


@query
def unique_reasoning_ref(v: Views) -> DataFrame:
    return reasoning.unique_by_reference(explained(v)).select("job_id", "candidate_id", "rank", "reasoning")


@query
def unique_reasoning(v: Views) -> DataFrame:
    return final(v).select("job_id", "candidate_id", "rank", "reasoning")


# Checks


@query
def check_row_count(v: Views) -> DataFrame:
    """Jobs whose rows with a sentence are not N."""
    bad = ranked_bad(v)
    return quality.row_count(bad.where(text.strip(F.col("reasoning")) != ""), v.job_texts, CFG)


@query
def check_ids(v: Views) -> DataFrame:
    return quality.ids(ranked_bad(v))


@query
def check_contiguous(v: Views) -> DataFrame:
    return quality.contiguous(ranked_bad(v))


@query
def check_score_bounds(v: Views) -> DataFrame:
    return quality.score_bounds(ranked_bad(v))


@query
def check_monotonic(v: Views) -> DataFrame:
    return quality.monotonic(ranked_bad(v))


@query
def check_reasoning_present(v: Views) -> DataFrame:
    return quality.reasoning_present(ranked_bad(v))


@query
def check_existence(v: Views) -> DataFrame:
    bad = ranked_bad(v)
    return quality.existence(bad, v.cand)


@query
def check_grounded(v: Views) -> DataFrame:
    bad = ranked_bad(v)
    return quality.grounded(bad, v.cand, facts_of(v, bad), v.skl)


@query
def check_named_skills(v: Views) -> DataFrame:
    """Ranked rows with their named skills; the fourth row of each job names one that nobody has."""
    named = F.coalesce("named_skills", F.array().cast("array<string>"))
    planted = F.when(F.col("rank") == 4, F.concat(named, F.array(F.lit("Alchemy")))).otherwise(named)
    rows = ranked(v).select("job_id", F.col("rank").alias("row_no"), "candidate_id", planted.alias("named_skills"))
    return quality.named_skills(rows, v.skl)


@query
def check_columns(v: Views) -> DataFrame:
    """Rows of ranked files without four fields; a second file of broken rows is planted beside each job's."""
    path = scratch_path(v.spark, "ranked-raw")
    rows = cut(final(v))
    ranked_csv.write(rows, path, v.job_texts, CFG.top_n)
    broken = rows.where(F.col("rank") == 1).select("job_id", F.concat_ws(",", "candidate_id", "rank").alias("value"))
    lines = broken.withColumn("value", F.concat(F.lit(",".join(fixed.OUTPUT_COLUMNS) + "\n"), "value"))
    lines.repartition("job_id").write.mode("append").partitionBy("job_id").text(path)
    found = quality.columns(cut(ranked_csv.read_raw(v.spark, path)))
    return found.groupBy("check", "job_id", "detail").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def validation_report(v: Views) -> DataFrame:
    bad = ranked_bad(v)
    return quality.report(bad, v.job_texts, v.cand, facts_of(v, bad), v.skl, CFG)


# Browse


@query
def search_ranked(v: Views) -> DataFrame:
    return ranked_csv.search(final(v), "KAFKA").select("job_id", "candidate_id", "rank", "reasoning")


@query
def ranked_metrics(v: Views) -> DataFrame:
    m = ranked_csv.metrics(best(v))
    return m.select("job_id", "n_ranked", r6("top_score").alias("top_score"), r6("cutoff_score").alias("cutoff_score"))


@query
def preview_head_tail(v: Views) -> DataFrame:
    return ranked_csv.preview(best(v)).select("job_id", "candidate_id", "rank", r6("score").alias("score"))
