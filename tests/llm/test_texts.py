"""Extraction, url verdicts, language, toxicity and passages on small fixtures."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankspark.llm import decontaminate, html_extract, language_id, toxicity, url_filter
from rankspark.llm.common import MissingColumn
from rankspark.session import setting

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p</style><script>var t='</p>';</script></head><body>"
    "<nav><ul><li><a href='/a'>a</a><li><a href='/b'>b</a></ul></nav><!-- x --><div class='ad'>Buy now.</div>"
    "<article><h1>Data &amp; ML\n engineer</h1><p><b>First   part.<br><p>Second&nbsp;part, {}.</p></article>"
    "<div class='comments'><p>A reader says hi.</p></div><form>Name</form><footer>&copy; us</footer></body></html>"
)


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("plain &lt;text&gt; only", "plain <text> only"),
        ("<p>one<p>two <i>and</i> three", "one\ntwo and three"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<div>" * 3000 + "deep", "deep"),
        ("<nav>only a menu</nav><footer>foot</footer>", ""),
        (PAGE.format("long"), "Data & ML engineer\nFirst part.\nSecond part, long."),
        (PAGE.format("x" * 300_000), "Data & ML engineer\nFirst part.\nSecond part, " + "x" * 300_000 + "."),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


def test_the_densest_subtree_wins_without_an_article_element():
    body = "".join(f"<p>{'words of the job text ' * 12}{i}</p>" for i in range(5))
    links = "".join(f"<a href='{i}'>link {i}</a> " for i in range(60))
    html = f"<body><div><div>{links}</div></div><div><div>{body}</div></div><div class='sidebar'><p>{'side ' * 90}</p></div></body>"
    assert html_extract.main_text(html).split("\n") == [f"{'words of the job text ' * 12}{i}" for i in range(5)]


def test_an_article_in_several_elements_is_kept_whole():
    part = lambda k, n: f"<article><h2>Part {k}</h2><p>{f'words of part {k} ' * n}.</p><p>Closing line {k}.</p></article>"
    text = lambda k, n: [f"Part {k}", f"{f'words of part {k} ' * n}.", f"Closing line {k}."]
    links = "<div>" + "".join(f"<a href='{i}'>link {i}</a> " for i in range(30)) + "</div>"
    for before, after in (("<main>", "</main>"), ("", "")):
        html = f"<body>{links}{before}{part(1, 30)}{part(2, 40)}{part(3, 25)}{after}</body>"
        got = html_extract.main_text(html).split("\n")
        assert [x for x in got if not x.startswith("link")] == text(1, 30) + text(2, 40) + text(3, 25)
        assert before == "" or not any(x.startswith("link") for x in got)
    # the densest subtree is selected, not the element named article around it
    wrapped = f"<body><article>{links * 9}<div><p>{'words of the text ' * 30}</p><p>{'more of the text ' * 30}</p></div></article></body>"
    assert "link" not in html_extract.main_text(wrapped)


@pytest.mark.parametrize(
    "html, text",
    [
        ('<article><p class="ad">Buy<p>Real text<p>More</article>', "Real text\nMore"),
        ('<article><ul><li class="share">Share<li>one<li>two</ul></article>', "one\ntwo"),
        ('<table><tr class="ad"><td>x<td>y<tr><td>real<td class="promo">no<td>yes</table>', "real\nyes"),
        ("<dl><dd class='ad'>x<dt>term<dd>what it is</dl>", "term\nwhat it is"),
        ("<head><title>T</title><body><p>text", "text"),
        ('<p>one <span class="ad">x <i>y</i></span> two</p><div class="ad"><nav>z</nav> z</div>', "one two"),
    ],
)
def test_marked_out_elements_end_like_others(html, text):
    assert html_extract.main_text(html) == text


def test_extract_job_texts_keeps_every_row(spark):
    rows = spark.createDataFrame(
        [(1, PAGE.format("a"), "x"), (1, PAGE.format("a"), "y"), (None, None, "z")], "job_id long, html string, jd_text string"
    )
    got = html_extract.extract_job_texts(rows)
    assert got.columns == ["job_id", "jd_text", "n_chars"]
    assert sorted((r.job_id or 0, len(r.jd_text) == r.n_chars, r.n_chars > 0) for r in got.collect()) == [
        (0, True, False), (1, True, True), (1, True, True)
    ]
    assert html_extract.extract_job_texts(rows.where("false")).count() == 0
    with pytest.raises(MissingColumn):
        html_extract.extract_job_texts(rows.drop("html"))


RULES = (
    url_filter.Rule("allow", "org"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "spam.net", "/ads/"),
)


def test_rules_and_hosts(spark):
    urls = [
        (1, "https://Example.ORG/es/1?x=/y"),
        (2, "http://a.example.org/en/1#t"),
        (3, "http://notexample.org:80/es/1"),
        (4, "http://x.org"),
        (5, None),
        (6, "no scheme"),
        (7, "http://spam.net/ads/7?u=http://a.org/"),
    ]
    rows = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_filter.judge_urls(rows, RULES).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("example.org", "/es/1", "example.org/es/", "block")
    assert (got[2].host, got[2].rule, got[2].verdict) == ("a.example.org", "org/", "allow")
    assert (got[3].host, got[3].rule) == ("notexample.org:80", None)
    assert (got[4].host, got[4].path, got[4].rule) == ("x.org", "", None)
    assert (got[5].host, got[5].path, got[6].host) == ("", "", "")
    assert (got[7].path, got[7].verdict) == ("/ads/7", "block")
    assert url_filter.judge_urls(rows.where("false"), RULES).count() == 0


def test_templates_follow_the_purity_of_their_branch(spark):
    urls = [(i, f"http://h.net/ads/p{i}/x") for i in range(40)] + [(100 + i, f"http://h.net/news/{i}") for i in range(60)]
    rules = [url_filter.Rule("block", "h.net", f"/ads/p{i}/") for i in range(30)]
    rules += [url_filter.Rule("allow", "h.net", f"/news/{i}") for i in range(10, 60)]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()}
    unseen_ads = [got[i] for i in range(40) if got[i].rule is None]
    unseen_news = [got[100 + i] for i in range(60) if got[100 + i].rule is None]
    assert unseen_ads and {r.verdict for r in unseen_ads} == {"block"} and {r.template for r in unseen_ads} == {"h.net/ads/*/*"}
    assert unseen_news and {r.verdict for r in unseen_news} == {"allow"}


def test_templates_go_as_deep_as_the_paths(spark):
    deep = "http://d.net/a/b/c/x/y"
    urls = [(i, f"{deep}/spam/{chr(97 + i)}x/end/") for i in range(25)] + [(100 + i, f"{deep}/help/{chr(97 + i)}y") for i in range(25)]
    urls += [(200, "http://d.net/a/b/c"), (201, "http://one.net/1/2/a//b/c/")]
    rules = [url_filter.Rule("block", "d.net", f"/a/b/c/x/y/spam/{chr(97 + i)}x") for i in range(15)]
    rules += [url_filter.Rule("allow", "d.net", f"/a/b/c/x/y/help/{chr(97 + i)}y") for i in range(15)]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()}
    assert len(got) == len(urls)
    assert {(got[i].verdict, got[i].template) for i in range(15, 25)} == {("block", "d.net/*/*/*/*/*/spam/*/*")}
    assert {(got[100 + i].verdict, got[100 + i].template) for i in range(15, 25)} == {("allow", "d.net/*/*/*/*/*/help/*")}
    assert (got[200].template, got[201].template) == ("d.net/*/*/*", "one.net/*/*/*/*/*")


def test_a_small_branch_of_a_large_place_is_judged_by_its_own_labels(spark):
    names = [a + b for a in "abcdefghij" for b in "abcdefghij"]
    urls = [(100 * k + i, f"http://big.net/{n}/{i}") for k, n in enumerate(names) for i in range(20)]
    rules = [url_filter.Rule("allow", "big.net"), url_filter.Rule("block", "big.net", "/cc/")]
    # the last ten of each branch have no label
    rows = spark.createDataFrame(urls, "page_id long, url string")
    host, path = url_filter.host_and_path(F.col("url"))
    _, verdict = url_filter.rule_of(host, path, rules)
    paths = rows.select(host.alias("host"), url_filter.segments(path).alias("parts"), F.when(F.col("page_id") % 100 < 10, verdict).alias("v"))
    paths = paths.groupBy("host", "parts").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("n_labelled"), F.count_if(F.col("v") == "block").alias("n_blocked")
    )
    got = {r.parts[0]: r for r in url_filter.templates(paths, url_filter.TemplateConfig()).collect()}
    assert got["cc"].template == "big.net/cc/*" and got["cc"].purity > 0.5
    assert got["aa"].purity < 0.1


def _talk(words, n, rng):
    return " ".join(rng.choice(words) for _ in range(n))


EN = "the and of to in is that for it with as was on are this have from or by at".split()
FR = "le la les des une est dans pour que qui pas sur au avec plus par être cette où élan".split()


def test_language(spark):
    rng = random.Random(1)
    rows = [(i, _talk(EN if i % 2 else FR, 30, rng), "en" if i % 2 else "fr") for i in range(80)]
    known = spark.createDataFrame(rows + [(90, None, "en"), (91, "no label", None)], "candidate_id long, text string, lang string")
    model = language_id.fit(known, language_id.LanguageConfig(clusters=2, texts_per_language=20))
    assert set(model.languages) == {"en", "fr"}
    new = [(1, _talk(EN, 9, rng)), (2, _talk(FR, 9, rng)), (3, None), (4, "12 % --"), (5, ""), (6, "жзийклмн опрст"), (1, _talk(EN, 40_000, rng))]
    table = spark.createDataFrame(new, "candidate_id long, text string").withColumn("score", F.lit("clash"))
    got = language_id.predict(table, model).collect()
    assert [r.lang_pred for r in got[:5]] == ["en", "fr", "und", "und", "und"] and got[6].lang_pred == "en"
    assert [r.rejected for r in got] == [False, False, True, True, True, True, False]
    assert all(0 <= r.score <= 1 for r in got)
    assert [r.candidate_id for r in language_id.with_language(table, model).collect()] == [1, 2, 1]
    nothing = language_id.fit(known.where("false"))
    assert {r.lang_pred for r in language_id.predict(table, nothing).collect()} == {"und"}


def test_toxic_sentences_are_found(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(240):
        parts = [_talk(EN, 8, rng).capitalize() for _ in range(5)]
        if i % 3 == 0:
            parts[rng.randrange(5)] += " you moron and clown"
        rows.append((i, ". ".join(parts) + "."))
        labels.append((i, int(i % 3 == 0)))
    texts = spark.createDataFrame(rows, "candidate_id long, text string").withColumn("toxic", F.lit("clash"))
    known = spark.createDataFrame(labels + [(None, 1), (999, None)], "candidate_id long, toxic int")
    model = toxicity.fit(texts.where("candidate_id < 180"), known)
    got = {r.candidate_id: r for r in toxicity.score(texts, model).collect()}
    assert all(got[i].predicted == int(i % 3 == 0) for i in range(180, 240))
    text = dict(rows)[183]
    assert ["moron" in text[s.start : s.end] for s in got[183].sentences] == [True]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "moron clown " * 30_000)], "candidate_id long, text string")
    found = toxicity.score(odd, model).collect()
    assert [r.score for r in found[:3]] == [0.0, 0.0, 0.0] and found[3].predicted == 1
    assert toxicity.without_toxic(odd, model).count() == 3
    one_kind = toxicity.fit(texts, known.where("toxic = 0"))
    assert {r.predicted for r in toxicity.score(texts, one_kind).collect()} == {0}


def _edits(window: str, text: str) -> int:
    """Smallest edit distance of the window to any part of the text, by the whole table."""
    row = np.zeros(len(text) + 1, dtype=int)
    steps = np.arange(len(text) + 1)
    other = np.array([ord(c) for c in text])
    for i, c in enumerate(window, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (other != ord(c)))
        row = np.minimum.accumulate(np.concatenate(([i], new)) - steps) + steps
    return int(row.min())


def test_passages_against_all_alignments():
    rng = random.Random(3)
    cfg = decontaminate.DecontaminationConfig()
    jobs = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(12, 260))) for _ in range(6)]
    windows = [w for j in jobs for w in decontaminate.windows_of(j, cfg)]
    index = decontaminate.Index(windows, list(range(len(windows))), cfg)
    for _ in range(60):
        w = rng.randrange(len(windows))
        copy = list(windows[w])
        for _ in range(rng.randrange(0, cfg.budget(len(copy)) + 4)):
            at = rng.randrange(len(copy))
            kind = rng.random()
            if kind < 0.4:
                copy[at] = rng.choice("xyz")
            elif kind < 0.7 and len(copy) > 5:
                del copy[at]
            else:
                copy.insert(at, rng.choice("xyz"))
        pad = lambda: "".join(rng.choice("ijklm ") for _ in range(rng.randrange(80)))
        text = decontaminate.normal(pad() + "".join(copy) + pad())
        want = {k: e for k, x in enumerate(windows) if (e := _edits(x, text)) <= cfg.budget(len(x))}
        assert {k: e for k, e, _ in index.search(text)} == want


def test_passages_of_jobs(spark):
    job = "we look for an engineer who builds search and ranking systems for very large collections of documents every day"
    other = "a completely different text about gardens, rivers, mountains and long walks in the evening light by the sea"
    jobs = spark.createDataFrame([(1, job), (2, other), (3, None), (4, "tiny"), (1, job)], "job_id long, jd_text string")
    rows = [
        (1, f"before. {job.upper()}  after"),
        (2, "nothing of it"),
        (3, None),
        (4, ""),
        (5, f"{'filler words here ' * 20_000}{job[:40]}X{job[41:]} and {other}"),
        (None, job),
        (1, "repeated id"),
    ]
    texts = spark.createDataFrame(rows, "candidate_id long, text string").withColumn("job_id", F.lit("clash"))
    got = decontaminate.job_passages(texts, jobs).collect()
    assert sorted((r.candidate_id or 0, r.job_id, r.edits) for r in got) == [(0, 1, 0), (1, 1, 0), (5, 1, 0), (5, 2, 0)] or sorted(
        (r.candidate_id or 0, r.job_id) for r in got
    ) == [(0, 1), (1, 1), (5, 1), (5, 2)]
    assert sorted(r.candidate_id for r in decontaminate.without_job_passages(texts, jobs).collect()) == [1, 2, 3, 4]
    small = decontaminate.DecontaminationConfig(block=1)
    key = lambda rs: sorted((r.candidate_id or 0, r.job_id, r.n_windows) for r in rs)
    assert key(decontaminate.job_passages(texts, jobs, small).collect()) == key(got)
    assert decontaminate.job_passages(texts, jobs.where("false")).count() == 0
    assert decontaminate.job_passages(texts.where("false"), jobs).count() == 0


def test_rows_are_judged_by_their_own_text(spark):
    passage = "a senior engineer who builds ranking systems for retrieval and search at scale every day of the week"
    rows = [(None, passage, 1), (None, "clean text without an id", 2), (7, passage, 3), (7, "clean text of the same id", 4)]
    rows += [(8, None, 5), (8, "", 6), (9, passage, 7), (9, passage, 8)]
    texts = spark.createDataFrame(rows, "candidate_id long, text string, gone_id long")
    jobs = spark.createDataFrame([(1, passage)], "job_id long, jd_text string")
    kept = decontaminate.without_job_passages(texts, jobs)
    assert kept.columns == texts.columns
    assert sorted(r.gone_id for r in kept.collect()) == [2, 4, 5, 6]
    assert decontaminate.without_job_passages(texts, jobs.where("false")).count() == len(rows)
    assert decontaminate.without_job_passages(texts.where("false"), jobs).count() == 0


def test_rows_with_passages_go_without_a_shuffle(spark):
    """Whole texts stay where they are, however large Spark takes the rows with a passage to be."""
    passage = "a senior engineer who builds ranking systems for retrieval and search at scale every day of the week"
    rows = [(k, f"text {k} {passage if k % 3 == 0 else 'without one'}", [k, None], {"a": k}) for k in range(60)] + [(60, None, None, None)]
    texts = spark.createDataFrame(rows, "candidate_id long, text string, more array<int>, props map<string, int>")
    jobs = spark.createDataFrame([(1, passage)], "job_id long, jd_text string")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        kept = decontaminate.without_job_passages(texts, jobs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        assert sorted((tuple(r) for r in kept.collect()), key=lambda r: r[0]) == [r for r in rows if r[0] % 3 or r[1] is None]
        blocks = decontaminate.without_job_passages(texts, jobs, decontaminate.DecontaminationConfig(block=1))
        assert sorted(r.candidate_id for r in blocks.collect()) == sorted(r.candidate_id for r in kept.collect())


def test_passages_at_any_offset_and_short_texts():
    rng = random.Random(7)
    cfg = decontaminate.DecontaminationConfig()
    jobs = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (233, 394, 80)] + ["c++ dev"]
    jobs = [decontaminate.normal(j) for j in jobs]
    pieces = [(k, p, m) for k, j in enumerate(jobs) for p, m in decontaminate.pieces_of(j, cfg)]
    index = decontaminate.Index([p for _, p, _ in pieces], list(range(len(pieces))), cfg, [m for _, _, m in pieces])
    windows = [(k, w) for k, j in enumerate(jobs) for w in decontaminate.windows_of(j, cfg)]
    for k in range(2):
        for at in range(0, len(jobs[k]) - 50, 29):
            text = f"xyz{jobs[k][at : at + 25]}!{jobs[k][at + 26 : at + 52]}xyz"
            want = {n: e for n, (_, w) in enumerate(windows) if len(w) > 9 and (e := _edits(w, text)) <= cfg.budget(len(w))}
            assert {n: e for n, e, _ in index.search(text)} == want and k in {windows[n][0] for n in want}
            assert sum(mask.bit_count() for mask, _, _ in index.pieces_in(text).values()) == len(want)
    # five edits in the middle of a text of 80 characters stand in all its windows of 50
    assert [windows[n][1] for n, _, _ in index.search(jobs[2][:37] + "!!!!!" + jobs[2][42:])] == [jobs[2]]
    assert [(windows[n][0], e, s) for n, e, s in index.search("a c++ dev.")] == [(3, 0, 2)]
    assert not list(index.search("a c++ developer"))


_BODY = "<p>" + "Real words of the article. " * 12 + "</p>"
_AROUND = "Real words of the article. " * 12


@pytest.mark.parametrize(
    "opening, closing",
    [
        ('<div class="sidebar-right">', "</div>"),
        ('<div id="page" class="wrap header-fixed">', "</div>"),
        ('<div class="social-policy">', "</div>"),
        ('<form id="aspnetForm" action="/">', "</form>"),
        ('<div class="share-price">', "</div>"),
    ],
)
def test_layouts_around_the_page_are_kept(opening, closing):
    html = f'<body>{opening}<div class="menu">Home About</div><article>{_BODY}{_BODY}</article><div class="share-buttons">Tweet</div>{closing}</body>'
    want = "\n".join([_AROUND.strip()] * 2)
    assert html_extract.main_text(html) == want
    assert html_extract.main_text(f"<body><article>{_BODY}{_BODY}</article></body>") == want


def test_a_form_and_a_box_beside_the_article_go():
    html = f'<body><form>Search here</form><article>{_BODY}<div class="share-price">Price 12</div><div class="share-bar">Share me</div>{_BODY}</article></body>'
    text = html_extract.main_text(html)
    assert "Price 12" in text and "Search" not in text and "Share me" not in text


@pytest.mark.parametrize("html", ["<i>" * 20_000 + "</b>" * 20_000, "</b>" * 100_000, "<div>" * 20_000 + "x" + "</span></div>" * 20_000])
def test_wrong_end_tags_take_no_time(html):
    t0 = time.process_time()
    html_extract.main_text(f"<body><article>{_BODY}</article>{html}</body>")
    assert time.process_time() - t0 < 3


def test_samples_keep_their_bound_where_an_id_has_many_rows(spark):
    from rankspark.llm.common import first_rows

    hot = spark.range(1200).selectExpr("7L candidate_id", "concat('some words of text ', id) text", "'en' lang")
    others = spark.range(100, 160).selectExpr("id candidate_id", "concat('des mots de texte ', id) text", "'fr' lang")
    cfg = language_id.LanguageConfig(texts_per_language=20)
    sample = language_id._sample(hot.unionByName(others), cfg)
    assert {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()} == {"en": 20, "fr": 20}
    wanted = others.orderBy(F.xxhash64("candidate_id"), "candidate_id").limit(20)
    assert {r.candidate_id for r in sample.where("lang = 'fr'").collect()} == {r.candidate_id for r in wanted.collect()}
    again = language_id._sample(others.unionByName(hot).repartition(7), cfg)
    assert sample.exceptAll(again).isEmpty() and again.exceptAll(sample).isEmpty()
    # a bound above Spark's own threshold is cut before the shuffle too, and the setting is as before
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(name)
    many = spark.range(4000).selectExpr("id candidate_id", "1 toxic")
    assert first_rows(many, "toxic", 3000).count() == 3000 and spark.conf.get(name) == before
