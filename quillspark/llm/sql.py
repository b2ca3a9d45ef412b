"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .chat_format import CONTROL
from .license_scan import BASE, NOTICES
from .line_dedup import PAGES, RATIO
from .url_filter import RULES, SOFT, SOFT_LIMIT, STRICT

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def url_filter() -> str:
    def found(term: str) -> str:
        return rf"CAST(regexp_matches(low, '(^|[^a-z0-9\x{{80}}-\x{{10FFFF}}]){term}([^a-z0-9\x{{80}}-\x{{10FFFF}}]|$)') AS BIGINT)"

    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}', '{r.name}')" for r in RULES)
    return f"""
WITH rules(r_host, r_path, r_verdict, r_name) AS (VALUES {rules}),
u AS (SELECT page_id, coalesce({LOWER.format("url")}, '') AS low,
    CASE WHEN coalesce(strpos(url, '://'), 0) = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, low, {LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
h AS (SELECT page_id, host, path, {" + ".join(map(found, sorted(STRICT)))} AS n_strict, {" + ".join(map(found, sorted(SOFT)))} AS n_soft FROM p),
fit AS (SELECT page_id, arg_max(r_name, length(r_name)) AS r_name, arg_max(r_verdict, length(r_name)) AS r_verdict
    FROM h JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id)
SELECT h.page_id, host, path, r_name AS rule,
    coalesce(r_verdict, CASE WHEN n_strict > 0 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft
FROM h LEFT JOIN fit USING (page_id)"""


DECONTAMINATION = f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS.format("text")} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS window_text
    FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, coalesce({WORDS.format("text")}, CAST([] AS VARCHAR[])) AS w FROM documents),
spots AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS window_text
    FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM windows))),
found AS (SELECT doc_id, item, i, n FROM spots JOIN windows USING (n, window_text)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM found) GROUP BY doc_id),
of AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN of USING (doc_id)"""



def license_scan() -> str:
    """Every place of each template's key phrases; the IDF only says where to look first, not what is found."""

    def texts(ws) -> str:
        return "[" + ", ".join(f"'{w.decode()}'" for w in ws) + "]"

    parts = []
    for is_base, templates in ((True, BASE), (False, NOTICES)):
        for t in templates:
            at0, first = t.key_places[0]
            keys = " AND ".join(f"w[i + {at - at0}:i + {at - at0 + len(k) - 1}] = {texts(k)}" for at, k in t.key_places)
            share = " + ".join(f"CASE WHEN i + {j - at0} > 0 AND w[i + {j - at0}] = '{x.decode()}' THEN 1 ELSE 0 END" for j, x in enumerate(t.words))
            parts.append(f"SELECT doc_id, '{t.label}' AS label, i - 1 - {at0} AS s, ({share}) / {len(t.words)} AS share, {is_base} AS is_base FROM spots WHERE x = '{first[0].decode()}' AND {keys}")
    return f"""
WITH docs AS (SELECT doc_id, coalesce({WORDS.format("text")}, CAST([] AS VARCHAR[])) AS w FROM documents),
spots AS (SELECT doc_id, w, i, w[i] AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM docs)),
m AS ({" UNION ALL ".join(parts)}),
f AS (SELECT doc_id, count(*) FILTER (WHERE is_base) AS n_base, min(s) FILTER (WHERE is_base) AS first_word, max(s) FILTER (WHERE is_base) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE is_base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN f USING (doc_id)"""


TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


LINE_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT r, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
often AS (SELECT source, trim(line) AS t, count(DISTINCT r) AS n FROM l WHERE trim(line) <> '' GROUP BY ALL),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY ALL),
bad AS (SELECT o.source, t FROM often o JOIN totals s ON o.source IS NOT DISTINCT FROM s.source WHERE n >= {PAGES} AND n > {RATIO} * total),
kept AS (SELECT r, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM l
    WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM l.source AND bad.t = trim(l.line)) GROUP BY r)
SELECT doc_id, source, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines), 0) - coalesce(n, 0) AS BIGINT) AS n_dropped
FROM d LEFT JOIN kept USING (r)"""


def chat_format() -> str:
    def escaped(x: str) -> str:
        x = f"replace({x}, '\\', '\\\\')"
        for c in CONTROL:
            x = f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')"
        return x

    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(9 + length(replace({escaped("role")}, chr(10), '\\' || chr(10))) + length({escaped("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


ORACLES = {"op4_line_dedup": LINE_DEDUP, "op9_chat_format": chat_format(), "op3_license_scan": license_scan(), "op8_top_k": TOP_K, "op1_url_filter": url_filter(), "op5_decontamination": DECONTAMINATION}
