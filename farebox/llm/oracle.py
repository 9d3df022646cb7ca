"""SQL that states the same results, where SQL can. The others are tested against brute force in tests/llm."""

_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> str:
    lowered = _ASCII_LOWER.format(f"coalesce({text}, '')")
    return f"regexp_extract_all({lowered}, '{_WORD}')"


OP1 = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
b AS (SELECT item_id, {_words("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
    FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
    SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
    FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)
),
met AS (SELECT p.doc_id, p.i, p.n, x.item_id FROM places p JOIN windows x ON p.n = x.n AND p.s = x.s),
hit AS (
    SELECT doc_id, count(DISTINCT j) AS n_hit FROM met, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id
),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM met) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP7 = """
WITH p AS (
    SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
        sha256(coalesce(html, '')) AS payload_digest
    FROM pages
),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

OP10 = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND list_count(embedding) = len(embedding)
        AND len(list_filter(embedding, lambda e: isnan(e) OR isinf(e))) = 0
        AND len(list_filter(embedding, lambda e: e <> 0)) > 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
        ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.x, b.x) >= 0.98
),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links,
    CAST(least(e.vec_id, coalesce(least, e.vec_id)) AS BIGINT) AS component_id,
    e.vec_id = least(e.vec_id, coalesce(least, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts ON counts.a = e.vec_id LEFT JOIN least ON least.a = e.vec_id
"""

_URL_LEVELS = """
g{k} AS (SELECT right(gram, {k}) AS gram, sum(allow) AS allow, sum(block) AS block FROM grams GROUP BY 1),
c{k} AS (
    SELECT left(gram, {k} - 1) AS context, sum(allow) AS allow, sum(block) AS block,
        count(*) FILTER (allow > 0) AS allow_kinds, count(*) FILTER (block > 0) AS block_kinds FROM g{k} GROUP BY 1
),
p{k} AS (
    SELECT g.gram,
        CASE WHEN c.allow >= 2 THEN (g.allow + allow_kinds * {allow}) / (c.allow + allow_kinds) ELSE {allow} END AS allow,
        CASE WHEN c.block >= 2 THEN (g.block + block_kinds * {block}) / (c.block + block_kinds) ELSE {block} END AS block
    FROM g{k} g JOIN c{k} c ON c.context = left(g.gram, {k} - 1) {join}
),"""


def _levels() -> str:
    first = _URL_LEVELS.format(k=1, allow="(1 / 256)", block="(1 / 256)", join="")
    more = (
        _URL_LEVELS.format(k=k, allow="s.allow", block="s.block", join=f"JOIN p{k - 1} s ON s.gram = right(g.gram, {k - 1})")
        for k in range(2, 6)
    )
    return first + "".join(more)


OP12 = f"""
WITH t AS (
    SELECT page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS place,
        CASE WHEN place > 0 THEN substr(coalesce(url, ''), place + 3) ELSE '' END AS tail FROM pages
),
h AS (
    SELECT page_id, {_ASCII_LOWER.format("regexp_extract(tail, '^([^/?#]*)', 1)")} AS host,
        regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path,
        CASE WHEN place > 0 THEN {_ASCII_LOWER.format("regexp_extract(tail, '^([^/?#]*)', 1)")}
            || regexp_extract(tail, '^[^/?#]*((.|\n)*)$', 1) ELSE url END AS text
    FROM t
),
j AS (
    SELECT *, CASE
        WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
        WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
        WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
        WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule,
        CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE '' END AS side
    FROM h
),
texts AS (SELECT DISTINCT text, side, left(md5(text), 1) IN ('0', '1', '2') AS kept_out FROM j),
marked AS (SELECT *, repeat(chr(2), 4) || text || chr(3) AS m FROM texts),
positions AS (SELECT text, side, kept_out, substr(m, i, 5) AS gram FROM marked, unnest(range(1, length(m) - 3)) AS r(i)),
grams AS (
    SELECT gram, count(*) FILTER (side = 'allow' AND NOT kept_out) AS allow,
        count(*) FILTER (side = 'block' AND NOT kept_out) AS block
    FROM positions GROUP BY gram
),{_levels()}
trained AS (SELECT coalesce(sum(allow) > 0 AND sum(block) > 0, false) AS yes FROM grams),
scores AS (
    SELECT text, side, avg(CASE WHEN yes THEN ln(allow) - ln(block) ELSE 0 END) AS score
    FROM positions JOIN p5 USING (gram), trained WHERE side = '' OR kept_out GROUP BY text, side
),
binned AS (SELECT *, greatest(-1000, least(1000, floor(round(score, 6) * 100))) AS bin FROM scores),
bins AS (
    SELECT bin, count(*) FILTER (side = 'allow') AS a, count(*) FILTER (side = 'block') AS b
    FROM binned WHERE side != '' GROUP BY bin
),
cuts AS (
    SELECT greatest(coalesce(lag(bin) OVER (ORDER BY bin) + 1, least(0, bin)), least(0, bin)) AS level,
        sum(a) OVER () AS n_a, sum(b) OVER () AS n_b,
        coalesce(sum(a) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lost,
        n_b - coalesce(sum(b) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed
    FROM bins
),
best AS (
    SELECT coalesce((SELECT level FROM cuts WHERE n_a > 0 AND n_b > 0
        ORDER BY lost * n_b + passed * n_a, abs(level), level LIMIT 1), 0) AS threshold
)
SELECT page_id, host, path, rule,
    CASE WHEN side != '' THEN side WHEN bin >= threshold THEN 'allow' ELSE 'block' END AS verdict
FROM j LEFT JOIN binned USING (text, side), best
"""

ORACLES = {"op1_decontamination": OP1, "op7_warc": OP7, "op10_embedding_graph": OP10, "op12_url_filter": OP12}
