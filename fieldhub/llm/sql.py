"""SQL of the op queries that SQL can express."""

OP8_SQL = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS points,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
    FROM documents
), g AS (
    SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
           first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id
    FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

OP2_SQL = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
    FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY source
), w AS (
    SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
           2 * source_size AS most
    FROM s
), f AS (
    SELECT *, coalesce(CAST(sum(most) OVER o AS BIGINT), 0) AS full_before,
           (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0) AS open_weight,
           row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS turn
    FROM w
    WINDOW o AS (ORDER BY most / weight, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), m AS (
    SELECT *, 3 * (SELECT CAST(sum(source_size) AS BIGINT) FROM s) - 2 * full_before AS remains,
           2 * open_weight AS opened
    FROM f
), k AS (
    SELECT turn, CAST(remains AS DOUBLE) / opened AS level FROM m
    WHERE most * opened >= remains * weight ORDER BY turn LIMIT 1
), t AS (
    SELECT source, source_size, n, CASE WHEN m.turn < k.turn THEN CAST(most AS DOUBLE)
           ELSE weight * level END AS target
    FROM m, k
), c AS (
    SELECT d.doc_id, d.size, t.source, t.source_size, t.target,
           CASE WHEN t.source_size = 0 THEN 0 ELSE t.target / t.source_size END AS rate,
           CAST('0x' || substr(md5('mix/' || d.doc_id), 1, 8) AS BIGINT)
               % CAST(ceil(t.n / 2000) AS BIGINT) AS cell,
           CAST('0x' || substr(md5('mix:' || d.doc_id), 1, 8) AS BIGINT) AS within
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), r AS (
    SELECT *, row_number() OVER (PARTITION BY source, cell ORDER BY size, within, doc_id) AS k,
           CAST('0x' || substr(md5('mix#' || cell || coalesce('=' || source, '-')), 1, 8) AS BIGINT)
               / 4294967296.0::DOUBLE AS u
    FROM c
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + floor(k * (rate - floor(rate)) + u)
                    - floor((k - 1) * (rate - floor(rate)) + u)) AS BIGINT) AS taken
FROM r
"""

OP7_SQL = r"""
WITH d AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex
    FROM pages
), g AS (
    SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM d
), b AS (
    SELECT *, """ + " || ".join(
    f"to_base(CAST('0x' || substr(hex, {5 * g + 1}, 5) AS BIGINT), 32, 4)" for g in range(8)) + r""" AS digits
    FROM g
)
SELECT page_id, payload_bytes,
       translate(digits, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""

OP9_SQL = r"""
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), s AS (
    SELECT vec_id, x FROM v
    WHERE x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
          AND len(list_filter(x, lambda e: e <> 0)) > 0
), l AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.x, b.x) >= 0.95
), r(node, root) AS (
    SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node
), c AS (
    SELECT node, min(root) AS component_id FROM r GROUP BY node
)
SELECT v.vec_id, coalesce((SELECT count(*) FROM l WHERE l.a = v.vec_id), 0) AS n_links, c.component_id,
       v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.node = v.vec_id
"""

_GRAMS = ", ".join(f"(substr(padded, i + {3 - k}, {k + 1}))" for k in range(4))


def _order(k: int) -> str:
    """Estimates of order k from those of order k - 1, and the ratios of grams and contexts."""
    less = "(1.0::DOUBLE / 39)"
    tail = f"JOIN e{k - 1} s ON s.gram = substr(g.gram, 2)" if k else ""
    p = [f"(g.{side} + 4.0::DOUBLE * {f's.p_{side}' if k else less}) / (c.in_{side} + 4.0::DOUBLE)" for side in ("allow", "block")]
    return f"""
c{k} AS (
    SELECT left(gram, {k}) AS context, sum(allow) AS in_allow, sum(block) AS in_block,
           CAST(round(ln((sum(block) + 4.0::DOUBLE) / (sum(allow) + 4.0::DOUBLE)) * 1000000) AS BIGINT) AS m
    FROM grams WHERE length(gram) = {k + 1} GROUP BY ALL
), e{k} AS (
    SELECT g.gram, {p[0]} AS p_allow, {p[1]} AS p_block,
           CAST(round(ln(({p[0]}) / ({p[1]})) * 1000000) AS BIGINT) AS r
    FROM grams g JOIN c{k} c ON c.context = left(g.gram, {k}) {tail} WHERE length(g.gram) = {k + 1}
), """


def _ratio(k: int) -> str:
    return "0" if k < 0 else f"coalesce(e{k}.r, coalesce(c{k}.m, 0) + {_ratio(k - 1)})"


#: both models, the calibration and the verdicts, in the operator's whole numbers
OP4_SQL = rf"""
WITH rules(verdict, host, path) AS (
    VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
           ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), raw AS (
    SELECT page_id, coalesce(url, '') AS url,
           CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), parts AS (
    SELECT page_id,
           translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
           regexp_replace(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'),
                          '[^a-z0/._:?=&#%-]', '~', 'g') AS spelled,
           CAST('0x' || substr(md5(spelled), 1, 8) AS BIGINT) % 5 = 0 AS aside
    FROM raw
), fits AS (
    SELECT p.page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
           max_by(r.verdict, length(r.host || r.path)) AS ruled
    FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
    GROUP BY p.page_id
), j AS (
    SELECT p.*, f.rule, f.ruled FROM parts p LEFT JOIN fits f USING (page_id)
), urls AS (
    SELECT spelled, count(*) FILTER (ruled = 'allow' AND NOT aside) AS allow,
           count(*) FILTER (ruled = 'block' AND NOT aside) AS block
    FROM j GROUP BY spelled
), spots AS (
    SELECT spelled, allow, block, '^^^' || spelled || '$' AS padded, unnest(range(1, length(spelled) + 2)) AS i FROM urls
), grams AS (
    SELECT gram, sum(allow) AS allow, sum(block) AS block
    FROM (SELECT allow, block, unnest([{_GRAMS}]) AS gram FROM spots WHERE allow + block > 0) GROUP BY gram
), {"".join(_order(k) for k in range(4))}
sums AS (
    SELECT spots.spelled, CAST(floor(sum({_ratio(3)}) / (count(*) * 1000)) AS BIGINT) AS score
    FROM spots
    {"".join(f"LEFT JOIN e{k} ON e{k}.gram = substr(padded, i + {3 - k}, {k + 1}) LEFT JOIN c{k} ON c{k}.context = substr(padded, i + {3 - k}, {k}) " for k in range(4))}
    GROUP BY spots.spelled
), judged AS (
    SELECT j.*, sums.score FROM j JOIN sums USING (spelled)
), bins AS (
    SELECT score, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b
    FROM judged WHERE ruled IS NOT NULL AND aside GROUP BY score
), gains AS (
    SELECT score, lag(score) OVER (ORDER BY score) AS before, (sum(a) OVER () - coalesce(sum(a) OVER lower, 0)) * sum(b) OVER ()
                  + coalesce(sum(b) OVER lower, 0) * sum(a) OVER () AS gain,
           sum(a) OVER () AS every_a, sum(b) OVER () AS every_b
    FROM bins WINDOW lower AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), mark AS (
    SELECT coalesce((SELECT CASE WHEN before IS NULL THEN score
                            ELSE CAST(floor((before + score + 1) / 2.0) AS BIGINT) END FROM gains WHERE every_a > 0 AND every_b > 0
                     ORDER BY gain DESC, abs(score), score LIMIT 1), 0) AS mark
)
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN score >= (SELECT mark FROM mark) THEN 'allow' ELSE 'block' END) AS verdict,
       score AS llr_milli
FROM judged
"""

#: windows of items, documents' runs of the same lengths, and the words that a run covers
OP11_SQL = r"""
WITH words AS (
    SELECT 'item' AS side, CAST(item_id AS VARCHAR) AS id, row_number() OVER () AS line, text FROM benchmark
    UNION ALL SELECT 'doc', CAST(doc_id AS VARCHAR), row_number() OVER (), text FROM documents
), spelled AS (
    SELECT side, id, line, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM words
), windows AS (
    SELECT DISTINCT id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS run
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM spelled WHERE side = 'item' AND len(w) > 0)
), lengths AS (
    SELECT DISTINCT k FROM windows
), runs AS (
    SELECT line, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS run
    FROM (SELECT line, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM spelled, lengths WHERE side = 'doc' AND len(w) >= k)
), met AS (
    SELECT r.line, r.k, r.i, w.id FROM runs r JOIN windows w ON r.k = w.k AND r.run = w.run
), hit AS (
    SELECT line, count(DISTINCT spot) AS n FROM (SELECT line, unnest(range(i, i + k)) AS spot FROM met) GROUP BY line
), found AS (
    SELECT line, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT line, id FROM met WHERE id IS NOT NULL) GROUP BY line
)
SELECT CAST(s.id AS BIGINT) AS doc_id, len(s.w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
       sha256(coalesce(found.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM spelled s LEFT JOIN hit USING (line) LEFT JOIN found USING (line) WHERE s.side = 'doc'
"""


def _crc_steps() -> str:
    """The table of the CRC's 256 remainders, from its polynomial."""
    step = "SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM ({})"
    inner = "SELECT CAST(range AS BIGINT) AS n, CAST(range AS BIGINT) AS c FROM range(256)"
    for _ in range(8):
        inner = step.format(inner)
    return f"crc AS (SELECT list(c ORDER BY n) AS t FROM ({inner}))"


def _crc(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text, with crc.t at hand."""
    return (
        f"xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), "
        "lambda h: CAST('0x' || h AS BIGINT)), lambda c, b: xor(c >> 8, crc.t[xor(c & 255, b) + 1]), 4294967295))"
    )


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: near words share a string with one code point left out or, at one place, blotted out
OP12_SQL = rf"""
WITH RECURSIVE {_crc_steps()}, runs AS (
    SELECT id, run, count(*) AS n
    FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
                 unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run
          FROM documents)
    WHERE length(run) >= 7 GROUP BY id, run
), hashed AS (
    SELECT run, n, {_crc("id || ':' || run")} AS h FROM runs, crc
), words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
          FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), spots AS (
    SELECT word, i, left(word, i) || substr(word, i + 2) AS less
    FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)
), links AS (
    SELECT w.word AS a, s.word AS b FROM words w JOIN spots s ON s.less = w.word
    UNION SELECT s.word, w.word FROM words w JOIN spots s ON s.less = w.word
    UNION SELECT s.word, t.word FROM spots s JOIN spots t ON s.i = t.i AND s.less = t.less AND s.word <> t.word
    WHERE length(s.word) = length(t.word)
), near AS (
    SELECT a AS word, count(*) AS n_near FROM links GROUP BY a
), best AS (
    SELECT l.a AS word, l.b AS form, f.n AS form_n
    FROM links l JOIN words w ON w.word = l.a JOIN words f ON f.word = l.b
    WHERE f.n >= 10 * w.n QUALIFY row_number() OVER (PARTITION BY l.a ORDER BY f.n DESC, l.b) = 1
), chain AS (
    SELECT word, form AS root FROM best
    UNION ALL SELECT c.word, b.form FROM chain c JOIN best b ON b.word = c.root
), roots AS (
    SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM best)
)
SELECT w.word, b.form, coalesce(r.root, w.word) AS root, w.n, coalesce(near.n_near, 0) AS n_near, b.form_n
FROM words w LEFT JOIN near USING (word) LEFT JOIN best b USING (word) LEFT JOIN roots r USING (word)
"""


def _costs(row: str) -> str:
    """Costs before a turn of sign ``y`` ('D' has to go, else s/u/a/o) from those behind it, h."""
    late = f"{row}.late"
    keep = {0: f"WHEN 's' THEN {late} + h[2] WHEN 'u' THEN {late} + h[3]", 1: f"WHEN 'u' THEN {late} + h[3]",
            2: f"WHEN 'a' THEN {late} + h[4]", 3: f"WHEN 'u' THEN {late} + h[3]"}
    onward = [3, 3, 4, 3]
    return ", ".join(
        f"least(3 + h[{s + 1}], CASE WHEN {row}.y = 'D' THEN 9999 ELSE 2 + {late} + h[{onward[s]}] END, "
        f"CASE {row}.y {keep[s]} ELSE 9999 END) AS r{s}"
        for s in range(4)
    )


#: h: costs from a state (1 nothing yet, 2 system, 3 user, 4 assistant) to the end, backward; then the edits, forward
OP13_SQL = rf"""
WITH RECURSIVE {_crc_steps()}, given AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
    FROM conversations
), hit AS (
    SELECT *, {_crc("k")} % 20 AS r FROM given, crc
), turns AS (
    SELECT conv_id, turn, CASE WHEN r = 4 THEN 'user' ELSE role END AS role,
           CASE r WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE WHEN r = 3 THEN 2 ELSE 1 END)) AS again
    FROM hit WHERE r <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS p,
           regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare
    FROM turns
), faults AS (
    SELECT *, bare = '' AS blank,
           bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS duplicate,
           bare <> '' AND NOT regexp_matches(bare, '[.!?]$') AS open,
           coalesce(left(lag(role) OVER (PARTITION BY conv_id ORDER BY p), 1) || left(role, 1) NOT IN ('su', 'ua', 'au')
                    AND p > 1, false) AS illegal
    FROM placed
), signs AS (
    SELECT conv_id, p, role, text,
           CASE WHEN blank OR duplicate THEN 'D' WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS y,
           CASE WHEN open AND NOT duplicate THEN 1 ELSE 0 END AS late
    FROM faults
), counts AS (
    SELECT conv_id, max(p) AS n, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
           count(*) FILTER (open AND NOT duplicate) AS truncated, count(*) FILTER (illegal) AS illegal,
           coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
    FROM faults GROUP BY conv_id
), ahead(conv_id, p, h) AS (
    SELECT conv_id, n + 1, [0, 4, 2, 0] FROM counts
    UNION ALL
    SELECT conv_id, p, [least(r0, 2 + u), least(r1, 2 + u), u, least(r3, 2 + u)]
    FROM (SELECT *, least(r2, 2 + r3) AS u
          FROM (SELECT a.conv_id, a.p - 1 AS p, {_costs("s")}
                FROM ahead a JOIN signs s ON s.conv_id IS NOT DISTINCT FROM a.conv_id AND s.p = a.p - 1))
), steps AS (
    SELECT a.conv_id, a.p, a.h, b.h AS g, s.role, s.text, s.y, s.late
    FROM ahead a LEFT JOIN ahead b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.p = a.p + 1
         LEFT JOIN signs s ON s.conv_id IS NOT DISTINCT FROM a.conv_id AND s.p = a.p
), edits(conv_id, p, s, audit, lines, paid) AS (
    SELECT conv_id, CAST(1 AS BIGINT), 1, '', CAST([] AS VARCHAR[]), 0 FROM counts
    UNION ALL
    SELECT conv_id, CASE WHEN e = 'I' THEN p ELSE p + 1 END, CASE WHEN e = 'D' THEN s WHEN e = 'K' THEN kept ELSE onward END,
           audit || e,
           CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
                  WHEN 'I' THEN list_append(lines, CASE onward WHEN 3 THEN 'user:' ELSE 'assistant:' END)
                  ELSE list_append(lines, CASE onward WHEN 3 THEN 'user:' ELSE 'assistant:' END || text) END,
           paid + CASE e WHEN 'D' THEN 3 WHEN 'I' THEN 2 WHEN 'K' THEN late ELSE 2 + late END
    FROM (SELECT *, CASE WHEN y IS NOT NULL AND 3 + g[s] = h[s] THEN 'D' WHEN 2 + h[onward] = h[s] THEN 'I'
                         WHEN y IS NULL THEN NULL WHEN kept IS NOT NULL AND late + g[kept] = h[s] THEN 'K' ELSE 'R' END AS e
          FROM (SELECT t.*, d.s, d.audit, d.lines, d.paid, CASE d.s WHEN 3 THEN 4 ELSE 3 END AS onward,
                       CASE WHEN t.y = 's' AND d.s = 1 THEN 2 WHEN t.y = 'u' AND d.s IN (1, 2, 4) THEN 3
                            WHEN t.y = 'a' AND d.s = 3 THEN 4 END AS kept
                FROM edits d JOIN steps t ON t.conv_id IS NOT DISTINCT FROM d.conv_id AND t.p = d.p))
    WHERE e IS NOT NULL
), ends AS (
    SELECT conv_id, max_by(audit, p * 100000 + length(audit)) AS audit, max_by(lines, p * 100000 + length(audit)) AS lines,
           max_by(paid, p * 100000 + length(audit)) AS paid
    FROM edits GROUP BY conv_id
)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, CAST(coalesce(e.paid, 0) AS BIGINT) AS cost,
       coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
     LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
