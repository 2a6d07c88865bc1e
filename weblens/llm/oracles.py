"""SQL for the queries that SQL can express."""

#: A table's site of a URL column, as SQL.
SITE = r"nullif(regexp_extract(regexp_extract(lower({0}), '^\s*https?://(?:[^/?#]*@)?([^/?#:@]*)', 1), '([^.\s]+(?:\.[^.\s]+)?)\.*\s*$', 1), '')"
NORM = r"regexp_replace(trim(regexp_replace(lower({0}), '[\s\x{{00a0}}\x{{000b}}\x{{0085}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')), '[0-9]+', '0', 'g')"

P1 = f"""
WITH h AS (SELECT hit_id, max({SITE.format("url")}) AS site, max(CASE WHEN isnan(_sem_score) THEN NULL ELSE _sem_score END) AS s FROM search_hits GROUP BY hit_id),
r AS (SELECT hit_id, row_number() OVER (PARTITION BY site ORDER BY s DESC NULLS LAST, hit_id) AS n FROM h WHERE site IS NOT NULL)
SELECT hit_id FROM r WHERE n > 20
"""
P2 = f"""
WITH d AS (SELECT src_id, {SITE.format("final_url")} AS site, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM research_sources WHERE content IS NOT NULL),
n AS (SELECT src_id, site, line_no, {NORM.format("line")} AS norm FROM d WHERE site IS NOT NULL),
k AS (SELECT site, norm FROM n WHERE norm <> '' GROUP BY site, norm HAVING count(DISTINCT src_id) >= 5)
SELECT DISTINCT src_id, CAST(line_no AS INTEGER) AS line_no FROM n JOIN k USING (site, norm)
"""
WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
P6 = f"""
WITH i AS (SELECT DISTINCT item_id, {WORDS.format("passage")} AS w FROM eval_items WHERE passage IS NOT NULL),
d AS (SELECT DISTINCT doc_id, {WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
a AS (SELECT item_id, array_to_string(list_slice(w, k, k + 9), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM i)),
b AS (SELECT doc_id, array_to_string(list_slice(w, k, k + 9), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM d))
SELECT DISTINCT doc_id, item_id FROM b JOIN a USING (g)
"""
ORACLES = {"p1_found": P1, "p2_found": P2, "p6_found": P6}
