"""DuckDB SQL of the queries that SQL can express."""

from ledgerloom.llm import collocations, orchard
from ledgerloom.llm import quality_rules as rules
from ledgerloom.llm.licenses import ALL_TEMPLATES, THRESHOLD


def words(text: str) -> str:
    lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def clustering() -> str:
    """All distances of every round, plainly; a round's centroids follow from its assignment."""
    rounds = ""
    for n in range(orchard.ROUNDS + 1):
        rounds += f"""
, a{n} AS MATERIALIZED (
    SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
        SELECT row, c, sum((p.x - m.x) * (p.x - m.x)) AS d FROM parts p JOIN c{n} m USING (i) GROUP BY row, c
    ) GROUP BY row
)"""
        if n < orchard.ROUNDS:
            rounds += f"""
, m{n} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{n} JOIN parts USING (row) GROUP BY c, i),
c{n + 1} AS MATERIALIZED (
    SELECT c, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{n} LEFT JOIN m{n} USING (c, i)
)"""
    last = orchard.ROUNDS
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, [CAST(floor({orchard.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS x FROM embeddings
    WHERE len(embedding) = {orchard.WIDTH} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), parts AS MATERIALIZED (
    SELECT row, unnest(x) AS x, unnest(range({orchard.WIDTH})) AS i FROM kept
), firsts AS (
    SELECT row_number() OVER (ORDER BY sha256('{orchard.SEED}:' || vec_id) NULLS LAST, x) - 1 AS c, row FROM kept
    QUALIFY c < {orchard.K}
), c0 AS MATERIALIZED (SELECT c, i, x FROM firsts JOIN parts USING (row)){rounds}
, digest AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM kept JOIN a{last} USING (row) JOIN digest USING (c)
"""


def quality() -> str:
    def broken(rule: rules.Rule) -> str:
        base = "1" if rule.base == "one" else rule.base
        sides = [f"100 * {rule.measure} < {rule.least} * {base}"] if rule.least is not None else []
        sides += [f"100 * {rule.measure} > {rule.most} * {base}"] if rule.most is not None else []
        return "(" + " OR ".join(sides) + ")"

    named = ", ".join(f"CASE WHEN {broken(r)} THEN '{r.name}' END" for r in (*rules.BASE_RULES, *rules.RULES))
    stop_words = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)
    w = rules.WINDOW
    return rf"""
WITH words AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM documents
), windows AS (
    SELECT doc_id, k, md5(array_to_string(w[k:k + {w - 1}], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - {w - 2})) AS k FROM words WHERE len(w) >= {w})
), twice AS (
    SELECT doc_id, h FROM windows GROUP BY ALL HAVING count(*) > 1
), repeated AS (
    SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(k, k + {w})) AS place FROM windows JOIN twice USING (doc_id, h)) GROUP BY doc_id
), measured AS (
    SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
           len(list_filter(w, lambda x: lower(x) IN ({stop_words}))) AS n_stop_words, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
           len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_cut_lines,
           len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines, coalesce(n, 0) AS n_repeat_words
    FROM words LEFT JOIN repeated USING (doc_id)
), judged AS (SELECT *, concat_ws(',', {named}) AS failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {" OR ".join(broken(r) for r in rules.BASE_RULES)} AS base_failed,
       failed = '' AS kept, n_stop_words, n_lines, n_cut_lines, n_bullet_lines, failed
FROM judged
"""


LICENCE_VALUES = ", ".join(f"({number}, '{name}', '{text}')" for number, (name, text) in enumerate(sorted(ALL_TEMPLATES)))

ORACLES = {
    "op3_cover_tree_search": """
WITH v AS (
    SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(d.x AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 20
""",
    "op2_decontamination": r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), items AS (
    SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL
), windows AS (
    SELECT DISTINCT item_id, size, array_to_string(w[k:k + size - 1], ' ') AS seq FROM (
        SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM items WHERE len(w) > 0
    )
), places AS (
    SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS seq FROM (
        SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k
        FROM words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size
    )
), hits AS (
    SELECT doc_id, p.size, k, item_id FROM places p JOIN windows v ON p.seq = v.seq AND p.size = v.size
), covered AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + size)) AS place FROM hits) GROUP BY doc_id
), found AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
""",
    "op4_substring_dedup": r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM words WHERE len(w) >= 50)
), firsts AS (
    SELECT h, min(doc_id) AS lowest FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS place FROM windows JOIN firsts USING (h) WHERE lowest < doc_id
), spread AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM words
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n
    FROM spread ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
""",
    "op7_licenses": rf"""
WITH templates(number, name, text) AS (VALUES {LICENCE_VALUES}),
files AS (
    SELECT doc_id, coalesce(source, 'unknown') || '/k' || CAST(floor(doc_id / 1000) AS BIGINT)
           || CASE WHEN doc_id % 2 = 1 THEN '/h' || CAST(floor(doc_id / 100) AS BIGINT) ELSE '' END AS dir, '/doc' || doc_id AS leaf, text
    FROM documents
), total AS (SELECT count(*) AS n FROM files),
template_words AS (
    SELECT number, name, word, 1 + ln(count(*)) AS tf FROM (SELECT number, name, unnest({words('text')}) AS word FROM templates) GROUP BY ALL
), met AS (
    SELECT word, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({words("coalesce(text, '')")})) AS word FROM files) GROUP BY word
), idf AS (
    SELECT word, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf
    FROM (SELECT word FROM template_words UNION SELECT word FROM met) LEFT JOIN met USING (word), total
), template_vectors AS (
    SELECT number, name, word, tf * idf / sqrt(sum(tf * tf * idf * idf) OVER (PARTITION BY number)) AS x FROM template_words JOIN idf USING (word)
), lines AS (
    SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS no, w
    FROM (SELECT doc_id, k, {words('line')} AS w FROM (
        SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS k
        FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r') AS l FROM files)))
    WHERE len(w) > 0
), placed AS (SELECT *, k - no = min(k - no) OVER (PARTITION BY doc_id) AS opening FROM lines
), parts AS (
    SELECT doc_id, no, 'line' AS kind, w FROM lines
    UNION ALL SELECT doc_id, 0, 'header', flatten(list(w)) FROM placed WHERE opening GROUP BY doc_id HAVING count(*) > 1
    UNION ALL SELECT doc_id, 0, 'file', flatten(list(w)) FROM placed GROUP BY doc_id HAVING NOT bool_and(opening)
), part_words AS (
    SELECT doc_id, no, kind, word, (1 + ln(tf)) * idf AS x
    FROM (SELECT doc_id, no, kind, word, count(*) AS tf FROM (SELECT doc_id, no, kind, unnest(w) AS word FROM parts) GROUP BY ALL) JOIN idf USING (word)
), norms AS (
    SELECT doc_id, no, kind, sqrt(sum(x * x)) AS norm FROM part_words GROUP BY ALL
), cosines AS (
    SELECT doc_id, no, kind, number, any_value(name) AS name, round(sum(l.x * t.x) / any_value(norm), 9) AS cosine
    FROM norms JOIN part_words l USING (doc_id, no, kind) JOIN template_vectors t USING (word) GROUP BY doc_id, no, kind, number
), own AS (
    SELECT doc_id, no, name, cosine FROM cosines WHERE cosine >= {THRESHOLD}
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, name, no) = 1
), given AS (
    SELECT dir AS above, arg_min(name, dir || leaf) AS given FROM files JOIN own USING (doc_id) WHERE no = 0 GROUP BY dir
), nearest AS (
    SELECT dir, arg_max(given, length(above)) AS given, max_by(above, length(above)) AS above
    FROM (SELECT DISTINCT dir FROM files) JOIN given ON dir = above OR starts_with(dir, above || '/') GROUP BY dir
)
SELECT doc_id, f.dir || leaf AS path, o.name AS own_license, coalesce(round(cosine, 6), 0.0) AS similarity, CAST(no AS INTEGER) AS own_line,
       coalesce(o.name, given) AS license, CASE WHEN o.name IS NOT NULL THEN 'own' ELSE above END AS license_from
FROM files f LEFT JOIN own o USING (doc_id) LEFT JOIN nearest USING (dir)
""",
    "op11_centroid_clustering": clustering(),
    "op12_quality_rules": quality(),
    "op13_phrase_collocations": rf"""
WITH pieces AS (
    SELECT row_number() OVER () AS piece, lang, regexp_extract_all(text, '[^\x20\x09]+') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS text FROM documents
    )
), grams AS (
    SELECT lang, size, w[k:k + size - 1] AS w FROM (
        SELECT lang, size, w, unnest(range(1, len(w) - size + 2)) AS k FROM pieces, range(1, {collocations.MAX_WORDS + 1}) sizes(size) WHERE len(w) >= size
    )
), counts AS MATERIALIZED (
    SELECT lang, size, w, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY ALL HAVING f >= {collocations.LEAST_COUNT}
), totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang
), candidates AS (SELECT * FROM counts WHERE size > 1
), cuts AS (SELECT *, unnest(range(1, size)) AS k FROM candidates
), scored AS (
    SELECT c.lang, c.w, c.f AS a, l.f AS l, r.f AS r, n, (1000 * c.f * n) // (l.f * r.f) AS score FROM cuts c
    JOIN counts l ON l.lang = c.lang AND l.w = c.w[1:k] JOIN counts r ON r.lang = c.lang AND r.w = c.w[k + 1:] JOIN totals t ON t.lang = c.lang
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.w ORDER BY score, k) = 1
), inner_parts AS (
    SELECT DISTINCT lang, w[k:k + part - 1] AS w, f FROM (
        SELECT lang, w, f, part, unnest(range(1, size - part + 2)) AS k
        FROM (SELECT *, unnest(range(2, size)) AS part FROM candidates WHERE size > 2)
    )
), gone AS (
    SELECT DISTINCT s.lang, s.w FROM scored s JOIN inner_parts i ON s.lang = i.lang AND s.w = i.w WHERE 100 * i.f >= {collocations.INSIDE_SHARE} * a
), ranked AS (
    SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, n, score,
           row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank
    FROM scored ANTI JOIN gone USING (lang, w)
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= {collocations.LIMIT}
""",
}
