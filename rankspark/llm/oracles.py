"""SQL counterparts of the queries that SQL can express.

Every query reads whole tables and whole texts. Texts, tokens, predictions and scores of
the other queries come from parsers, tokenizers and trained models; ``tests/llm`` holds
those against brute force, round trips and held-out labels.
"""

from __future__ import annotations

from rankspark.llm.fill_middle import FillConfig
from rankspark.llm.queries import RULES
from rankspark.llm.sharding import Node, layout
from rankspark.llm.url_filter import LOWER, UPPER, TemplateConfig

# the connected components of ``links(a, b)``, both directions, by the smallest reachable id
_REACHED = """
    reached AS (
        SELECT id, id AS root FROM ids
        UNION
        SELECT l.b AS id, r.root FROM reached AS r JOIN links AS l ON l.a = r.id WHERE r.root < l.b OR r.root < l.a
    ),
    smallest AS (SELECT id, min(root) AS component_id FROM reached GROUP BY id)
"""


def near_dedup_sql(words: int = 4, percent: int = 80) -> str:
    return rf"""
WITH RECURSIVE
    split AS (
        SELECT doc_id, list_filter(
            regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
        FROM documents
    ),
    sets AS (
        SELECT doc_id, CASE
            WHEN len(w) = 0 THEN []
            WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' ')))
            END AS s
        FROM split
    ),
    classes AS (SELECT min(doc_id) AS id, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
    ids AS (SELECT id FROM classes),
    single AS (SELECT id, n, unnest(s) AS x FROM classes),
    common AS (
        SELECT p.id AS a, q.id AS b, any_value(p.n) + any_value(q.n) AS total, count(*) AS both_n
        FROM single AS p JOIN single AS q ON p.x = q.x AND p.id <> q.id GROUP BY p.id, q.id
    ),
    links AS (SELECT a, b FROM common WHERE 100 * both_n >= {percent} * (total - both_n)),
    {_REACHED}
SELECT t.doc_id, len(t.s)::BIGINT AS n_shingles, coalesce(m.component_id, t.doc_id) AS component_id,
    t.doc_id = coalesce(m.component_id, t.doc_id) AS kept
FROM sets AS t
LEFT JOIN classes AS c ON c.s = list_sort(t.s)
LEFT JOIN smallest AS m ON m.id = c.id
"""


def embedding_dedup_sql(cosine: float = 0.95) -> str:
    return f"""
WITH RECURSIVE
    good AS (
        SELECT vec_id AS id, embedding::DOUBLE[] AS v, list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) AS square
        FROM embeddings
        WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    ),
    usable AS (SELECT id, v FROM good WHERE square > 0),
    ids AS (SELECT id FROM usable),
    links AS (
        SELECT p.id AS a, q.id AS b FROM usable AS p JOIN usable AS q
        ON p.id <> q.id AND len(p.v) = len(q.v) AND list_cosine_similarity(p.v, q.v) >= {cosine}
    ),
    {_REACHED},
    degree AS (SELECT a AS id, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n_links, 0)::BIGINT AS n_links, coalesce(m.component_id, e.vec_id) AS component_id,
    e.vec_id = coalesce(m.component_id, e.vec_id) AS kept
FROM embeddings AS e LEFT JOIN degree AS d ON d.id = e.vec_id LEFT JOIN smallest AS m ON m.id = e.vec_id
"""


def url_filter_sql(cfg: TemplateConfig = TemplateConfig()) -> str:
    rules = sorted(RULES, key=lambda r: -len(r.text))

    def case(pick: str) -> str:
        whens = " ".join(
            f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, pick)}'"
            for r in rules
        )
        return f"CASE {whens} END"

    names = [f"s{k}" for k in range(1, cfg.depth + 1)]
    steps = ", ".join(
        f"CASE WHEN regexp_matches(coalesce(parts[{k}], ''), '[0-9]') THEN '*' ELSE coalesce(parts[{k}], '') END AS s{k}"
        for k in range(1, cfg.depth + 1)
    )
    levels, place = [], ["host"]
    smooth = f"(sum(n_blocked) + {cfg.smoothing} * min(above)) / (sum(n_labelled) + {cfg.smoothing})"
    sums = "sum(n) AS n, sum(n_labelled) AS n_labelled, sum(n_blocked) AS n_blocked"
    for k in range(1, cfg.depth + 1):
        where = " AND ".join(f"c.{p} = w.{p}" for p in place)
        same = " AND ".join(f"x.{p} = d.{p}" for p in [*place, f"s{k}"])
        cols = ", ".join(place)
        before = [f"t{j}" for j in range(1, k)]
        levels.append(
            f"""
    whole{k} AS (SELECT {cols}, {sums}, {smooth} AS purity FROM now{k - 1} GROUP BY {cols}),
    child{k} AS (SELECT {cols}, s{k}, {sums} FROM now{k - 1} GROUP BY {cols}, s{k}),
    decided{k} AS (
        SELECT {", ".join(f"c.{p}" for p in place)}, c.s{k}, w.purity AS above, CASE
            WHEN c.s{k} = '' THEN ''
            WHEN c.s{k} <> '*' AND c.n >= {cfg.least_share} * w.n AND coalesce(
                abs(c.n_blocked::DOUBLE / nullif(c.n_labelled, 0) - w.n_blocked::DOUBLE / nullif(w.n_labelled, 0))
                > {cfg.z} * sqrt((w.n_blocked::DOUBLE / nullif(w.n_labelled, 0)) * (1 - w.n_blocked::DOUBLE / nullif(w.n_labelled, 0)) / nullif(c.n_labelled, 0)),
                false) THEN c.s{k}
            ELSE '*' END AS t{k}
        FROM child{k} AS c JOIN whole{k} AS w ON {where}
    ),
    now{k} AS (
        SELECT x.host, {", ".join(f"x.{s}" for s in names)}, x.n, x.n_labelled, x.n_blocked,
            {"".join(f"x.{t}, " for t in before)} d.t{k}, d.above
        FROM now{k - 1} AS x JOIN decided{k} AS d ON {same}
    )"""
        )
        place = [*place, f"t{k}"]
    cols = ", ".join(place)
    shown = "x.host" + "".join(f" || CASE WHEN x.t{k} <> '' THEN '/' || x.t{k} ELSE '' END" for k in range(1, cfg.depth + 1))
    return rf"""
WITH
    parsed AS (
        SELECT page_id,
            translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
            coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
        FROM pages
    ),
    ruled AS (
        SELECT page_id, host, path, {case("text")} AS rule, {case("verdict")} AS by_rule,
            string_split(regexp_replace(path, '^/', ''), '/') AS parts
        FROM parsed
    ),
    cells AS (SELECT page_id, host, path, rule, by_rule, {steps} FROM ruled),
    paths AS (
        SELECT host, {", ".join(names)}, count(*) AS n, count(by_rule) AS n_labelled, count(*) FILTER (by_rule = 'block') AS n_blocked
        FROM cells GROUP BY ALL
    ),
    overall AS (SELECT (coalesce(sum(n_blocked), 0) + 1)::DOUBLE / (coalesce(sum(n_labelled), 0) + 2) AS share FROM paths),
    now0 AS (SELECT p.*, o.share AS above FROM paths AS p, overall AS o),{",".join(levels)},
    judged AS (SELECT {cols}, {smooth} AS purity FROM now{cfg.depth} GROUP BY {cols}),
    known AS (
        SELECT {", ".join(f"x.{c}" for c in ["host", *names])}, {shown} AS template, j.purity
        FROM now{cfg.depth} AS x JOIN judged AS j ON {" AND ".join(f"x.{p} = j.{p}" for p in place)}
    )
SELECT c.page_id, c.host, c.path, c.rule,
    coalesce(c.by_rule, CASE WHEN k.purity >= {cfg.block_from} THEN 'block' ELSE 'allow' END) AS verdict,
    k.template, floor(k.purity * 1e6 + 0.5) / 1e6 AS purity
FROM cells AS c JOIN known AS k ON {" AND ".join(f"c.{p} = k.{p}" for p in ["host", *names])}
"""


def _place_sql(root: Node, name: str) -> str:
    """CTEs that bring every row of ``docs(nr, key)`` down the tree, one level after the other."""
    ctes, level, at = [], [root], f"(SELECT nr, key, 0 AS node FROM docs)"
    depth = 0
    while any(n.children for n in level):
        below: list[Node] = []
        rows = []
        for parent, node in enumerate(level):
            for child in node.children or (node,):
                rows.append(f"({parent}, '{child.name}', {child.weight}::DOUBLE, {len(below)})")
                below.append(child)
        depth += 1
        drawn = f"-ln((('0x' || substr(md5(d.key || '/' || c.name), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(16**13)}) / c.weight"
        ctes.append(
            f"{name}{depth} AS (SELECT d.nr, d.key, arg_min(c.node, struct_pack(draw := {drawn}, node := c.node)) AS node FROM {at} AS d"
            f" JOIN (VALUES {', '.join(rows)}) AS c(parent, name, weight, node) ON c.parent = d.node GROUP BY d.nr, d.key)"
        )
        at, level = f"{name}{depth}", below
    shards = ", ".join(f"({i}, {n.shard})" for i, n in enumerate(level))
    ctes.append(f"{name} AS (SELECT d.nr, s.shard FROM {at} AS d JOIN (VALUES {shards}) AS s(node, shard) ON s.node = d.node)")
    return ",\n".join(ctes)


# checksum of the bytes of a text, as hexadecimal digits in ``hex``: the usual table, one byte after the other
_CRC = """
    bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
             FROM range(256) AS t(i)),
    crc_table AS (SELECT list(c ORDER BY i) AS cs FROM bits),
    summed AS (
        SELECT nr, xor(list_reduce(
            list_prepend(4294967295, list_transform(range(len(hex) // 2), lambda i: ('0x' || hex[2 * i + 1:2 * i + 2])::BIGINT)),
            lambda c, b: xor(c >> 8, cs[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
        FROM docs, crc_table
    )"""


def sharding_sql(shards: int = 40) -> str:
    """Slots follow ids here: the query numbers by parts, of which tables of this size have one."""
    return f"""
WITH
    docs AS (
        SELECT row_number() OVER () AS nr, doc_id, coalesce(doc_id::VARCHAR, '') AS key, strlen(coalesce(text, '')) + 16 AS size,
            hex(encode(coalesce(text, ''))) AS hex
        FROM documents
    ),
    {_CRC},
    {_place_sql(layout(shards), "now")},
    {_place_sql(layout(shards + 1), "grown")}
SELECT d.doc_id, d.size::BIGINT AS size, s.text_crc32, 'key' AS law, n.shard,
    row_number() OVER (PARTITION BY n.shard ORDER BY d.doc_id NULLS FIRST, s.text_crc32, d.size) - 1 AS slot, g.shard AS grown_shard
FROM docs AS d JOIN summed AS s USING (nr) JOIN now AS n USING (nr) JOIN grown AS g USING (nr)
"""


def divergence_sql(least_texts: int = 10, top_terms: int = 10) -> str:
    """``//`` on 128-bit integers: all values are whole numbers."""
    share = lambda n, size: f"1 + 1000000000::HUGEINT * ({n} + 2) // ({size})"
    return rf"""
WITH
    docs AS (
        SELECT row_number() OVER () AS nr, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
        FROM documents
    ),
    every AS (SELECT nr, lang, source, unnest(ts) AS term FROM docs),
    kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM every GROUP BY lang, term HAVING count(DISTINCT nr) >= {least_texts}),
    counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM every GROUP BY ALL),
    places AS (SELECT DISTINCT lang, source FROM docs),
    vocabulary AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n_all FROM kept GROUP BY lang),
    filled AS (
        SELECT p.lang, p.source, k.term, k.total, coalesce(c.n, 0)::HUGEINT AS n
        FROM places AS p JOIN kept AS k ON k.lang = p.lang
        LEFT JOIN counts AS c ON c.lang = p.lang AND c.source = p.source AND c.term = k.term
    ),
    sizes AS (SELECT lang, source, sum(n)::HUGEINT AS n_own FROM filled GROUP BY lang, source),
    shares AS (
        SELECT f.lang, f.source, f.term, f.n, {share("f.n", "s.n_own + 2 * v.v")} AS p, {share("f.total", "v.n_all + 2 * v.v")} AS q
        FROM filled AS f JOIN sizes AS s ON s.lang = f.lang AND s.source = f.source JOIN vocabulary AS v ON v.lang = f.lang
    ),
    priced AS (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM shares AS a JOIN shares AS b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
    ),
    both_parts AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
        FROM places AS a JOIN places AS b ON b.lang = a.lang AND b.source <> a.source
        LEFT JOIN priced AS p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
        UNION ALL
        SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
    ),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM both_parts
    )
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {top_terms}
"""


def fill_in_middle_sql(cfg: FillConfig = FillConfig()) -> str:
    p, s, m = cfg.prefix_mark, cfg.suffix_mark, cfg.middle_mark
    group = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT"
    return rf"""
WITH
    docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{cfg.seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    split AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units FROM docs),
    drawn AS (
        SELECT *, len(units)::BIGINT AS n, {group(0)} % (len(units) + 1) AS k1, {group(1)} % (len(units) + 1) AS k2,
            {group(2)} % 100 AS d3, {group(3)} % 100 AS d4
        FROM split
    ),
    parts AS (
        SELECT doc_id, text, n, CASE
                WHEN text = '' OR contains(text, '{p}') OR contains(text, '{s}') OR contains(text, '{m}') OR d3 >= {cfg.fill_percent} THEN 'plain'
                WHEN d4 < {cfg.suffix_first_percent} THEN 'spm' ELSE 'psm' END AS form,
            coalesce(array_to_string(units[1:least(k1, k2)], ''), '') AS prefix,
            coalesce(array_to_string(units[least(k1, k2) + 1:greatest(k1, k2)], ''), '') AS middle,
            coalesce(array_to_string(units[greatest(k1, k2) + 1:], ''), '') AS suffix
        FROM drawn
    )
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form
        WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle
        WHEN 'spm' THEN '{s}' || suffix || '{p}' || prefix || '{m}' || middle
        ELSE text END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""


ORACLES: dict[str, str] = {
    "op13_fill_in_middle": fill_in_middle_sql(),
    "op11_source_divergence": divergence_sql(),
    "op6_sharding": sharding_sql(),
    "op2_url_filter": url_filter_sql(),
    "op3_near_dedup": near_dedup_sql(),
    "op7_embedding_dedup": embedding_dedup_sql(),
}
