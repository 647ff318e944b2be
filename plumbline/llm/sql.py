"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from plumbline.llm.rules import STOP_WORDS

MIX = r"""WITH r AS (SELECT doc_id, coalesce(concat('1', source), '2') AS source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), '?' || text, ''))) AS h FROM documents),
s AS (SELECT CASE WHEN source IS NULL THEN '2' ELSE source END AS source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY 1),
w AS (SELECT *, (row_number() OVER (ORDER BY source) - 1) % 3 + 1 AS w FROM s), n AS (SELECT *, 3 * source_size AS most, CAST(3 * source_size AS DOUBLE) / w AS need FROM w),
l AS (SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER b, 0) AS DOUBLE) / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER b, 0)) AS level, row_number() OVER (ORDER BY need, source) AS k
  FROM n WINDOW b AS (ORDER BY need, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(CAST(most AS DOUBLE), (SELECT arg_min(level, k) FROM l WHERE level <= need) * w) AS target FROM n),
u AS (SELECT row_number() OVER () AS row, r.doc_id, r.size, r.h, t.*, CAST(sum(size) OVER (PARTITION BY t.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM r JOIN t ON r.source = t.source),
c AS (SELECT *, (e - 1) * source_size + upto - size AS before FROM u, (SELECT unnest([1, 2, 3]) AS e) WHERE size > 0 AND (e - 1) * source_size + upto - size < target),
p AS (SELECT *, least(1e0, CAST(before + size AS DOUBLE) / target) AS finish, least(size, CAST(ceil(target - before) AS BIGINT)) AS piece FROM c),
o AS (SELECT *, CAST(sum(piece) OVER (ORDER BY finish, source, h, doc_id, size, e ROWS UNBOUNDED PRECEDING) AS BIGINT) - piece AS start FROM p),
x AS (SELECT row, greatest(0, least(piece, (SELECT CAST(sum(source_size) AS BIGINT) FROM s) - start)) AS words, start FROM o),
y AS (SELECT row, CAST(sum(words) AS BIGINT) AS taken, count(*) FILTER (words > 0) AS epochs, min(start) FILTER (words > 0) AS first_at FROM x GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, coalesce(epochs, 0) AS epochs, first_at FROM u LEFT JOIN y ON u.row = y.row"""

TOPK = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATE = f"""WITH i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT DISTINCT item, n, array_to_string(w[s + 1:s + n], ' ') AS words FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents), sizes AS (SELECT DISTINCT n FROM k),
p AS (SELECT row, n, s, array_to_string(w[s + 1:s + n], ' ') AS words FROM (SELECT row, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT p.row, p.s, p.n, k.item FROM p JOIN k ON p.n = k.n AND p.words = k.words),
h AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(s, s + n)) AS place FROM m) GROUP BY row),
g AS (SELECT row, list_sort(list(DISTINCT item)) AS items FROM m GROUP BY row)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, CAST(coalesce(len(g.items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(g.items, ','), '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.row = h.row LEFT JOIN g ON d.row = g.row"""

REPEATS = """WITH b AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT row, s, md5(substring(x, 2 * s + 1, 800)) AS m FROM (SELECT row, x, unnest(range(0, len(x) // 2 - 399)) AS s FROM b WHERE len(x) >= 800)),
a AS (SELECT row, s FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
g AS (SELECT *, sum(CASE WHEN s > last + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY row ORDER BY s) AS run FROM (SELECT *, lag(s) OVER (PARTITION BY row ORDER BY s) AS last FROM a)),
r AS (SELECT row, min(s) AS f, max(s) + 400 AS t FROM g GROUP BY row, run), q AS (SELECT *, lag(t, 1, 0) OVER (PARTITION BY row ORDER BY f) AS after FROM r),
k AS (SELECT b.row, count(*) AS n_spans, CAST(sum(t - f) AS BIGINT) AS n_removed, concat(string_agg(substring(x, 2 * after + 1, 2 * (f - after)), '' ORDER BY f), substring(any_value(x), 2 * max(t) + 1)) AS kept FROM b JOIN q ON b.row = q.row GROUP BY b.row)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM b LEFT JOIN k ON b.row = k.row"""

_QUOTED = "'" + "', '".join(sorted(set(" ".join(STOP_WORDS.values()).split()))) + "'"
RULES = rf"""WITH r AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
t AS (SELECT row, i, concat(w[i], ' ', w[i + 1], ' ', w[i + 2]) AS t FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM r WHERE len(w) >= 3)),
a AS (SELECT row, i FROM t QUALIFY count(*) OVER (PARTITION BY row, t) > 1), c AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM a) GROUP BY row),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(text) - len(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  len(list_filter(w, lambda x: lower(trim(x, '.,;:!?"''()')) IN ({_QUOTED}))) AS n_stop, len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{{L}}'))) AS n_plain, len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) AS n_bullets, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) AS n_broken FROM r LEFT JOIN c ON r.row = c.row),
f AS (SELECT *, list_filter([CASE WHEN n_words < 50 THEN 'few_words' END, CASE WHEN n_repeat_words * 1000 > 500 * n_words THEN 'repeated_words' END, CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words) THEN 'word_length' END, CASE WHEN n_symbols * 1000 > 100 * n_words AND n_words > 0 THEN 'symbols' END,
  CASE WHEN n_plain * 1000 > 300 * n_words THEN 'no_letters' END, CASE WHEN n_stop * 1000 < 10 * n_words THEN 'few_stop_words' END, CASE WHEN n_dup_lines * 1000 > 500 * n_lines THEN 'repeated_lines' END, CASE WHEN n_bullets * 1000 > 900 * n_lines THEN 'bullets' END, CASE WHEN n_broken * 1000 > 300 * n_lines THEN 'broken_off' END], lambda x: x IS NOT NULL) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, list_has_any(failed, ['few_words', 'repeated_words']) AS base_failed, len(failed) = 0 AS kept, array_to_string(failed, ',') AS failed FROM f"""

# CRC-32 is folded over the bytes of a run's UTF-8 form with a table of 256 entries that is made first.
VARIANTS = r"""WITH RECURSIVE tab AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
k AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY 1, 2),
b AS (SELECT run, n, flatten(list_transform(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + (u >> 6), 128 + (u & 63)] END)) AS bytes FROM k),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, tab.t[CAST((xor(c, x) & 255) + 1 AS INT)]))) AS h FROM b, tab),
l AS (SELECT CASE WHEN h % 199 = 0 THEN concat(substring(run, 1, CAST(h % len(run) AS INT)), substring(run, CAST(h % len(run) AS INT) + 2)) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM l WHERE len(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
x AS (SELECT word, n, i, concat(substring(word, 1, i - 1), substring(word, i + 1)) AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS other, b.n FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.rest = w.word UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.rest = w.word),
near AS (SELECT word, count(*) AS n_near, arg_min(other, row(-n, other)) AS other, max(n) AS most FROM p GROUP BY word),
f AS (SELECT w.word, CASE WHEN most >= 5 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * n THEN most END AS form_n FROM w LEFT JOIN near ON w.word = near.word),
g AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, g.root FROM f JOIN g ON f.form = g.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN g ON f.word = g.word"""

INTERACTIONS = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, good, toxic, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END + CASE WHEN 100 * (len(d.text) - len(translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * len(d.text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN d.doc_id > first THEN 16 ELSE 0 END AS mask FROM d JOIN e ON d.text = e.text LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f), o AS (SELECT concat(a.f, b.f, c.f, d.f, e.f) AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, CAST(1 << (ascii(filter_order[step]) - 65) AS INT) AS b, CAST(coalesce(list_sum(list_transform(string_split(filter_order[1:step - 1], ''), lambda y: CASE WHEN y = '' THEN 0 ELSE 1 << (ascii(y) - 65) END)), 0) AS INT) AS e FROM (SELECT filter_order, CAST(unnest(range(1, 6)) AS INT) AS step FROM o)),
r AS (SELECT part, filter_order, step, b, CAST(coalesce(sum(n) FILTER (mask & (b | e) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (mask & b > 0 AND mask & e = 0), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (mask & b > 0 AND mask & e > 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (mask = b), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (mask & b > 0 AND mask & e = 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (mask & b > 0 AND mask & e = 0), 0) AS BIGINT) AS toxic_lost FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley FROM r"""

SQL = {"op4_mix": MIX, "op7_topk": TOPK, "op9_decontaminate": DECONTAMINATE, "op10_repeats": REPEATS, "op11_rules": RULES, "op12_variants": VARIANTS, "op13_interactions": INTERACTIONS}
