"""DuckDB SQL for the text operators that SQL can express."""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (
    SELECT item, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT *, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0))),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (
    SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)),
hit AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

# Shares in multiples of 2^-36; every slot goes to the released block with the earliest deadline.
OP4 = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, sqrt(n::DOUBLE) AS w, row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM n),
l AS (SELECT list_reduce(list(w ORDER BY i), lambda a, b: a + b) AS total FROM w),
r AS (SELECT source, n, i, greatest(1, round(w / total * 68719476736::DOUBLE))::BIGINT AS r FROM w, l),
parts AS (SELECT source, n, i, (r + CASE WHEN row_number() OVER (ORDER BY r DESC, i) = 1 THEN 68719476736 - sum(r) OVER () ELSE 0 END)::BIGINT AS q FROM r),
p AS (SELECT list(q ORDER BY i) AS qs, max(ceil((n // 16 + 1)::DOUBLE * 68719476736::DOUBLE / q))::BIGINT AS slots FROM parts),
sim AS (
    SELECT -1::BIGINT AS t, list_transform(qs, lambda x: 0::BIGINT) AS lead, list_transform(qs, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick, 0::BIGINT AS k FROM p
    UNION ALL
    SELECT t + 1, list_transform(lead, lambda x, i: x + qs[i] - CASE WHEN i = pk THEN 68719476736 ELSE 0 END), list_transform(done, lambda d, i: d + CASE WHEN i = pk THEN 1 ELSE 0 END), pk, done[pk] FROM (
        SELECT t, lead, done, qs, (list_min(list_filter(list_transform(lead, lambda x, i: CASE WHEN x + qs[i] > 0 THEN ((68719476736 - x + qs[i] - 1) // qs[i])::HUGEINT * 100000 + i END), lambda x: x IS NOT NULL)) % 100000)::BIGINT AS pk
        FROM sim, p WHERE t < slots)),
plan AS (SELECT source, t AS slot, k FROM sim JOIN parts ON pick = i AND t >= 0),
o AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS nth FROM documents),
b AS (SELECT doc_id, source, nth // 16 AS mix_block, nth % 16 AS mix_place FROM o),
ends AS (SELECT min(slot) AS e FROM n JOIN plan ON n.source IS NOT DISTINCT FROM plan.source AND n.n // 16 = k)
SELECT doc_id, b.source, mix_block::BIGINT AS mix_block, mix_place::BIGINT AS mix_place, slot::BIGINT AS mix_slot, slot < e AS mix_full
FROM b JOIN plan ON b.source IS NOT DISTINCT FROM plan.source AND mix_block = k, ends
"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.c, d.doc_id))::BIGINT AS component_id,
    d.doc_id <= coalesce(m.c, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) m USING (doc_id)
"""

OP8 = """
WITH v AS (SELECT vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

# ASCII lower case as in the operator; a key's lines stay in the largest document that holds it.
OP12 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE doc_id <> keeper)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id
"""


def op13_sql() -> str:
    """Sequences as lists of turn digests; crc32 of a decimal number is worked out bit by bit (polynomial 0xEDB88320)."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
WITH RECURSIVE o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS p,
    coalesce(role, '') || chr(31) || coalesce(text, '') AS k, length(coalesce(text, ''))::BIGINT AS chars FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM o),
crc(conv_id, s, i, bit, c) AS (
    SELECT conv_id, conv_id::VARCHAR, 0, 8, 4294967295::BIGINT FROM ids
    UNION ALL
    SELECT conv_id, s, CASE WHEN bit = 8 THEN i + 1 ELSE i END, CASE WHEN bit = 8 THEN 1 ELSE bit + 1 END,
        CASE WHEN bit = 8 THEN (SELECT {step} FROM (SELECT xor(crc.c, ascii(s[i + 1])) AS c)) ELSE {step} END
    FROM crc WHERE NOT (bit = 8 AND i = length(s))),
h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(c, 4294967295) % 6 AS h FROM crc WHERE bit = 8 AND i = length(s)),
r AS (SELECT h.conv_id, 0 AS own, o.p, o.k, o.chars FROM h JOIN o ON o.conv_id = h.base AND o.p <= h.h
    UNION ALL SELECT h.conv_id, 1, o.p, o.k, o.chars FROM h JOIN o ON o.conv_id = h.conv_id AND o.p > h.h),
seq AS (SELECT conv_id, list(sha256(k) ORDER BY own, p) AS ks, list(chars ORDER BY own, p) AS cs FROM r GROUP BY conv_id),
full_ AS (SELECT conv_id, coalesce(ks, []) AS ks, coalesce(cs, []) AS cs, coalesce(len(ks), 0)::BIGINT AS n FROM ids LEFT JOIN seq USING (conv_id)),
pre AS (SELECT conv_id, n, d::BIGINT AS depth, sha256(array_to_string(ks[:d], ',')) AS node, sha256(array_to_string(ks[:d - 1], ',')) AS up, CASE WHEN d > 0 THEN cs[d] ELSE 0 END AS chars
    FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM full_)),
nodes AS (SELECT depth, node, min(conv_id) AS conv_id, min(up) AS up, count(*) AS n_convs, min(chars) AS chars, list(conv_id ORDER BY conv_id) FILTER (WHERE n = depth) AS ends FROM pre GROUP BY depth, node),
kids AS (SELECT depth - 1 AS depth, up AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
all_ AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (depth, node)),
anc AS (SELECT DISTINCT a.depth AS d, a.node AS v, b.depth, b.node FROM pre a JOIN pre b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
sub AS (SELECT anc.d AS depth, anc.v AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM anc JOIN all_ USING (depth, node) GROUP BY ALL)
SELECT x.conv_id::BIGINT AS conv_id, x.depth, p.conv_id::BIGINT AS parent_conv_id, x.n_convs::BIGINT AS n_convs, x.n_children::BIGINT AS n_children,
    n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(array_to_string(coalesce(x.ends, []), ',')) AS ends_sha256
FROM all_ x JOIN sub USING (depth, node) LEFT JOIN nodes p ON x.depth > 0 AND p.depth = x.depth - 1 AND p.node = x.up
"""


def license_sql() -> str:
    from .license_scan import KNOWN, RESERVED, SPELLINGS, STATEMENT, UNDATED, whole_licenses

    def canonical(text: str) -> str:
        low = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        for pattern, left in ((STATEMENT, "\\1"), (RESERVED, "\\1\\2"), (UNDATED, "\\1\\2")):
            low = f"regexp_replace({low}, '{pattern}', '{left}', 'g')"
        out = f"trim(regexp_replace({low}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        for old, new in SPELLINGS.items():
            out = f"regexp_replace({out}, '(^| ){old}( |$)', '\\1{new}\\2', 'g')"
        return out

    known = ", ".join("('{}', '{}')".format(k, x.replace("'", "''")) for k, x in KNOWN + whole_licenses())
    return f"""
WITH known AS (SELECT sha256({canonical('t')}) AS kd, min(l) AS l FROM (VALUES {known}) x(l, t) GROUP BY kd),
d AS (SELECT doc_id, text, sha256({canonical('text')}) AS digest FROM documents),
lines AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(translate(x, 'LICENSE', 'license'), 'licen[cs]e'))) AS line FROM d),
named AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT l, ',' ORDER BY l) AS notices FROM (SELECT doc_id, sha256({canonical('line')}) AS ld FROM lines) x JOIN known ON ld = kd GROUP BY doc_id)
SELECT d.doc_id, digest, known.l AS license, coalesce(n, 0)::BIGINT AS n_notice_lines, coalesce(notices, '') AS notices, known.l IS NOT NULL OR coalesce(n, 0) > 0 AS licensed
FROM d LEFT JOIN known ON digest = kd LEFT JOIN named USING (doc_id)
"""
