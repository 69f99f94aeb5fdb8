"""Exact top K texts per job by the cosine of token counts, from an index of posting lists.

Both vectors have length 1, so what the lists of some tokens can still add to a score is
at most the length of the job's vector over these tokens, and at most the sum of its
weights times the largest weight of each list. With the job's tokens in order of falling
worth (rare ones first), the last lists are left out as soon as that bound is below the
job's K-th score: no text that stands in them alone can be among the best. In the other
lists, blocks and entries below the weight that could lead to the K-th score are left out
likewise. Sums of what was read, with the bounds of what was not, leave few texts, whose
scores are then computed in full from their vectors. No bound drops a text that belongs
to the result.

Jobs of frequent tokens leave little out: nearly all lists would be opened, once per job.
Where more entries are to be opened than the index has, the stored vectors are read once instead,
and each is multiplied with all jobs where it stands. The score reached in the lists
still holds back rows that cannot win.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rankspark.config import RankConfig
from rankspark.operators.recall import BestRows
from rankspark.operators.scoring import rounded
from rankspark.session import cut, narrow
from rankspark.sources.postings import Index, count_terms, list_summary

_SLACK = 1e-9  # for the last bits of sums of products


def job_terms(jobs: DataFrame) -> DataFrame:
    """``job_id, term, n, norm``: one row per job and distinct token of its text."""
    made = count_terms(jobs, "job_id", "jd_text")
    return made.select("job_id", "norm", F.explode("terms").alias("t")).select("job_id", "t.term", "t.n", "norm")


def exact_scores(pairs: DataFrame, index: Index, wanted: DataFrame, cfg: RankConfig) -> DataFrame:
    """``job_id, candidate_id, sem_score`` of the given pairs, from whole vectors; counts are multiplied as whole numbers."""
    own = index.vectors.join(pairs, "candidate_id")
    single = own.select("job_id", "candidate_id", F.col("norm").alias("text_norm"), F.explode("terms").alias("t"))
    met = single.select("job_id", "candidate_id", "text_norm", F.col("t.term").alias("term"), F.col("t.n").alias("m"))
    dots = met.join(wanted, ["job_id", "term"]).groupBy("job_id", "candidate_id", "text_norm", "norm").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    score = F.col("dot").cast("double") / (F.col("norm") * F.col("text_norm"))
    return dots.select("job_id", "candidate_id", rounded(score, cfg.score_digits).alias("sem_score"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("job_id").orderBy(F.desc("sem_score"), "candidate_id")
    return scores.withColumn("recall_rank", F.row_number().over(order)).where(F.col("recall_rank") <= k)


def bounds(wanted: DataFrame, index: Index) -> DataFrame:
    """Job tokens with ``w``, the largest weight of their list, and ``rest``: what all later lists can add.

    The order is that of the job's weight against the number of texts in the list: lists that cost much and
    bring little come last. ``so_far`` counts the texts of the lists up to this one. Tokens that no
    text holds have no list.
    """
    lists = list_summary(narrow(index.blocks.select("term", "size", "max_weight"), wanted, "term"))
    met = wanted.join(lists, "term").withColumn("w", F.col("n") / F.col("norm"))
    order = Window.partitionBy("job_id").orderBy(F.desc(F.col("w") * F.col("w") / F.col("n_texts")), "term")
    later = order.rowsBetween(1, Window.unboundedFollowing)
    adds = F.coalesce(F.sum(F.col("w") * F.col("max_weight")).over(later), F.lit(0.0))
    length = F.sqrt(F.coalesce(F.sum(F.col("w") * F.col("w")).over(later), F.lit(0.0)))
    so_far = F.sum("n_texts").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return met.select("job_id", "term", "w", "max_weight", "n_texts", so_far.alias("so_far"), F.least(adds, length).alias("rest"))


def seeds(index: Index, listed: DataFrame, cfg: RankConfig) -> DataFrame:
    """Pairs worth a first look: texts of the first lists per job, a few times K of them; of a longer list the first ones."""
    n = 8 * cfg.recall_k
    lists = listed.where((F.col("so_far") <= n) | (F.col("so_far") == F.col("n_texts"))).select("job_id", "term")
    heads = narrow(index.blocks.select("term", "block", "size", "max_weight"), lists, "term")
    before = Window.partitionBy("term").orderBy(F.desc("max_weight"), "block").rowsBetween(Window.unboundedPreceding, -1)
    chosen = heads.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).where(F.col("before") < n)
    opened = index.blocks.select("term", "block", "ids").join(chosen.select("term", "block"), ["term", "block"])
    return opened.join(lists, "term").select("job_id", F.explode(F.slice("ids", 1, n)).alias("candidate_id")).distinct()


def open_lists(index: Index, needed: DataFrame, splits: int) -> DataFrame:
    """``job_id, candidate_id, w, d, cap``: entries of weight ``d`` that may lead to the K-th score.

    Blocks are dealt out by token and number, so that the blocks of a frequent token meet its
    jobs in ``splits`` tasks.
    """
    least = needed.groupBy("term").agg(F.min("need").alias("least"))
    part = F.pmod("block", F.lit(splits)).cast("int")
    blocks = index.blocks.select("term", "block", "max_weight", "ids", "weights").join(least, "term").where(F.col("max_weight") >= F.col("least"))
    entries = blocks.select("term", part.alias("part"), "least", F.explode(F.arrays_zip("ids", "weights")).alias("e")).where(
        F.col("e.weights") >= F.col("least")
    )
    parts = F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))
    met = entries.join(needed.withColumn("part", parts), ["term", "part"]).where(F.col("e.weights") >= F.col("need"))
    d = F.col("e.weights")
    return met.select("job_id", F.col("e.ids").alias("candidate_id"), "w", d.alias("d"), "cap")


def opens_more_than_stored(needed: DataFrame, index: Index) -> bool:
    """Whether the lists to be opened, each once per job, have more entries than all lists of the index together."""
    asked = needed.agg(F.sum("n_texts")).first()[0] or 0
    return asked > (index.blocks.agg(F.sum("size")).first()[0] or 0)


def scan_scores(index: Index, wanted: DataFrame, reached: DataFrame, cfg: RankConfig, cells: int = 2_000_000) -> DataFrame:
    """``job_id, candidate_id, sem_score``: the K best of every task per job, each text read once per block of jobs.

    A block of jobs is a matrix of whole counts, a line per token, of about ``cells`` numbers; texts are
    multiplied with it in slices of as many, so products are exact and memory is bounded.
    """
    n_jobs, n_terms = wanted.agg(F.count_distinct("job_id"), F.count_distinct("term")).first()
    if not n_jobs:
        return exact_scores(wanted.select("job_id").limit(0).join(index.vectors.select("candidate_id"), how="cross"), index, wanted, cfg)
    # the matrix shrinks with the jobs of a block and, if they share few tokens, with their tokens as well
    n = max(-(-n_jobs * n_terms // cells), -(-n_jobs * cfg.recall_k // cfg.recall_state_rows))
    job_kind, id_kind = wanted.schema["job_id"].dataType, index.vectors.schema["candidate_id"].dataType
    job_type, id_type, digits, k = to_arrow_type(job_kind), to_arrow_type(id_kind), cfg.score_digits, cfg.recall_k
    floors = wanted.select("job_id").distinct().join(reached, "job_id", "left")

    def one_pass(b: int) -> tuple[DataFrame, Broadcast] | None:
        mine = F.pmod(F.xxhash64("job_id"), F.lit(n)) == b
        rows = wanted.where(mine).select("job_id", "term", "n", "norm").collect()
        if not rows:
            return None
        norms = {r["job_id"]: r["norm"] for r in rows}
        bounds = {r["job_id"]: r["reached"] for r in floors.where(mine).collect() if r["reached"] is not None}
        line, job_at = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}, {j: i for i, j in enumerate(norms)}
        entries = np.array([(line[r["term"]], job_at[r["job_id"]], r["n"]) for r in rows], dtype=np.int64)
        shared = index.vectors.sparkSession.sparkContext.broadcast((list(norms), list(norms.values()), list(line), entries, bounds))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            jobs, lengths, terms, given, least = shared.value
            counts = np.zeros((len(terms), len(jobs)))
            counts[given[:, 0], given[:, 1]] = given[:, 2]
            lengths, terms = np.array(lengths), pa.array(terms, pa.string())
            best = BestRows(jobs, k, least)
            step = max(1, cells // max(len(terms), len(jobs)))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    few = batch.slice(at, step)
                    own = few.column("terms")
                    flat = own.flatten()
                    found = pc.index_in(flat.field("term"), value_set=terms)
                    met = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
                    row = np.repeat(np.arange(few.num_rows), pc.list_value_length(own).to_numpy(zero_copy_only=False))
                    texts = np.zeros((few.num_rows, len(terms)))
                    texts[row[met], found.drop_null().to_numpy()] = flat.field("n").to_numpy(zero_copy_only=False)[met]
                    # a text shares tokens with few jobs or many: those without any have no score
                    dots = (texts @ counts).T
                    scale = lengths[:, None] * few.column("norm").to_numpy()[None, :]
                    scores = np.floor(dots / np.where(scale > 0, scale, 1.0) * 10.0**digits + 0.5) / 10.0**digits
                    best.add(few.column("candidate_id"), np.where(dots > 0, scores, -np.inf))
            for rows_ in best.batches(job_type, id_type):
                yield rows_.filter(pc.is_finite(rows_.column("sem_score")))
            pa.default_memory_pool().release_unused()

        schema = f"job_id {job_kind.simpleString()}, candidate_id {id_kind.simpleString()}, sem_score double"
        return index.vectors.select("candidate_id", "norm", "terms").mapInArrow(run, schema), shared

    parts = []
    for b in range(n):
        made = one_pass(b)
        if made:
            parts.append(cut(made[0]))  # a block of jobs is finished before the next one is fetched
            made[1].destroy()
    return reduce(DataFrame.unionByName, parts)


def similar_texts(index: Index, jobs: DataFrame, cfg: RankConfig, splits: int = 16) -> DataFrame:
    """``job_id, candidate_id, sem_score, recall_rank``: the K most similar texts of the index per job, exactly.

    ``jobs`` has ``job_id, jd_text`` with unique ids. Scores are rounded to ``score_digits`` and ties
    go by id. Texts that share no token with a job have score 0 and follow in order of id
    where fewer than K others exist; so do all texts for a job without tokens. An empty
    index gives no rows.
    """
    jobs = cut(jobs.select("job_id", "jd_text"))
    wanted = cut(job_terms(jobs))
    listed = cut(bounds(wanted, index))

    # a K-th score among some texts: the K-th of all is not lower
    some = _best(exact_scores(seeds(index, listed, cfg), index, wanted, cfg), cfg.recall_k)
    reached = some.where(F.col("recall_rank") == cfg.recall_k).select(
        "job_id", (F.col("sem_score") - 10.0**-cfg.score_digits - _SLACK).alias("reached")
    )
    known = cut(listed.join(reached, "job_id", "left").withColumn("reached", F.coalesce("reached", F.lit(0.0))))

    # an entry of weight d leads to at most w * d + rest; below need it alone cannot
    need = (F.col("reached") - F.col("rest")) / F.col("w")
    limits = known.withColumn("need", need).withColumn("cap", F.col("w") * F.least("max_weight", F.greatest("need", F.lit(0.0))))
    needed = limits.where(F.col("need") <= F.col("max_weight"))
    if opens_more_than_stored(needed, index):
        scores = scan_scores(index, wanted, reached, cfg)
    else:
        needed = cut(needed.select("job_id", "term", "w", "need", "cap"))
        scores = exact_scores(cut(_likely(open_lists(index, needed, splits), limits)), index, wanted, cfg)
    best = cut(_best(scores.where(F.col("sem_score") > 0), cfg.recall_k))
    return _filled(best, index, jobs, cfg.recall_k)


def _likely(entries: DataFrame, limits: DataFrame) -> DataFrame:
    """Pairs whose entries, with what unread ones can add at most, come up to the K-th score.

    An unread entry adds no more than its list's cap, and all of them together no more than the
    product of the lengths that are left of both vectors.
    """
    of_job = limits.groupBy("job_id").agg(
        F.sum("cap").alias("caps"), F.sum(F.col("w") * F.col("w")).alias("length"), F.first("reached").alias("reached")
    )
    read = entries.groupBy("job_id", "candidate_id").agg(
        F.sum(F.col("w") * F.col("d")).alias("added"),
        F.sum("cap").alias("spared"),
        F.sum(F.col("w") * F.col("w")).alias("job_read"),
        F.sum(F.col("d") * F.col("d")).alias("text_read"),
    )
    left = lambda whole, part: F.greatest(whole - F.col(part), F.lit(0.0)) + _SLACK
    unread = F.least(F.col("caps") - F.col("spared"), F.sqrt(left(F.col("length"), "job_read") * left(F.lit(1.0), "text_read")))
    return (
        read.join(of_job, "job_id")
        .where(F.col("added") + unread + _SLACK >= F.col("reached"))
        .select("job_id", "candidate_id")
    )


def _filled(best: DataFrame, index: Index, jobs: DataFrame, k: int) -> DataFrame:
    """Jobs with fewer than K rows get texts of score 0, the smallest ids first.

    The first 2 K ids hold enough that are not among the rows of a job already.
    """
    have = best.groupBy("job_id").agg(F.count(F.lit(1)).alias("have"))
    short = jobs.select("job_id").join(have, "job_id", "left").select("job_id", F.coalesce("have", F.lit(0)).alias("have")).where(F.col("have") < k)
    first = index.vectors.select("candidate_id").orderBy("candidate_id").limit(2 * k)
    rest = short.join(first, how="cross").join(best.select("job_id", "candidate_id"), ["job_id", "candidate_id"], "left_anti")
    nth: Column = F.row_number().over(Window.partitionBy("job_id").orderBy("candidate_id"))
    zeros = (
        rest.withColumn("recall_rank", (F.col("have") + nth).cast("int"))
        .where(F.col("recall_rank") <= k)
        .select("job_id", "candidate_id", F.lit(0.0).alias("sem_score"), "recall_rank")
    )
    return best.unionByName(zeros)
