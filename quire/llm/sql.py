"""DuckDB SQL of the corpus queries that SQL can express, written from the contracts."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS to_ FROM d UNION SELECT r.doc_id, link.y FROM reach r JOIN link ON link.x = r.to_)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(reach.to_) AS component_id
FROM d JOIN reach ON reach.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
least_ AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS p FROM win JOIN least_ USING (k) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (
  SELECT word.doc_id, count(gone.p) AS lost, string_agg(x, ' ' ORDER BY word.p) FILTER (WHERE gone.p IS NULL) AS t
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(lost, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

_KAPPA = """(SELECT CASE WHEN sum(n) IS NULL THEN 2.0 WHEN v <= noise THEN 200.0
    ELSE least(200.0, greatest(2.0, (p * (1 - p) - v) / (v - noise))) END FROM (
  SELECT sum(n) AS n, sum(k) / sum(n) AS p, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n)) AS v,
         (sum(k) / sum(n)) * (1 - sum(k) / sum(n)) * count(*) / sum(n) AS noise
  FROM {} WHERE n > 0) GROUP BY p, v, noise)"""

URL_FILTER = f"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM h),
lab AS (
  SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN bad THEN 1 ELSE 0 END) AS k
  FROM (SELECT doc_id, (quality = 0 OR toxic = 1) AS bad FROM labels) WHERE doc_id IS NOT NULL AND bad IS NOT NULL GROUP BY doc_id),
hosts AS (
  SELECT host, CASE WHEN regexp_extract(host, '([^.]+\\.[^.]+)$', 1) = '' THEN host ELSE regexp_extract(host, '([^.]+\\.[^.]+)$', 1) END AS domain,
         regexp_extract(host, '([^.]*)$', 1) AS suffix, CAST(coalesce(sum(n), 0) AS DOUBLE) AS n, CAST(coalesce(sum(k), 0) AS DOUBLE) AS k
  FROM h LEFT JOIN lab USING (page_id) GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
base AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM suffixes),
kap AS (SELECT coalesce({_KAPPA.format("suffixes")}, 2.0) AS s, coalesce({_KAPPA.format("domains")}, 2.0) AS d, coalesce({_KAPPA.format("hosts")}, 2.0) AS h),
sm AS (SELECT suffix, (k + kap.s * base.m) / (n + kap.s) AS m FROM suffixes, base, kap),
dm AS (SELECT domain, suffix, (k + kap.d * sm.m) / (n + kap.d) AS m FROM domains JOIN sm USING (suffix), kap),
post AS (
  SELECT host, hosts.n, hosts.k, hosts.k + kap.h * dm.m AS a, hosts.n - hosts.k + kap.h * (1 - dm.m) AS b
  FROM hosts JOIN dm USING (domain, suffix), kap),
bound AS (SELECT host, n, k, a / (a + b) - sqrt(a / (a + b) * (b / (a + b)) / (a + b + 1)) AS low FROM post)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN low > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
  CAST(n AS BIGINT) AS labelled, CAST(k AS BIGINT) AS bad
FROM r JOIN bound USING (host)
"""

SOURCE_DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS row_, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT row_, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS al FROM w GROUP BY lang, term HAVING count(DISTINCT row_) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS c FROM w JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(al) AS n FROM k GROUP BY lang),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
s AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 5)) // CAST(coalesce(n.n, 0) + 5 * v.v AS HUGEINT) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * (k.al + 5)) // CAST(v.n + 5 * v.v AS HUGEINT) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM v)
  UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""

PHRASE_MINING = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, CAST(k.k AS BIGINT) AS k, unnest(list_transform(range(1, greatest(len(w) - k.k + 2, 1)), lambda i: array_to_string(w[i:i + k.k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3]) AS k) k),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
inner_ AS (
  SELECT lang, part, max(a) AS m FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inner_ i ON i.lang = c.lang AND i.part = c.phrase WHERE i.m IS NULL OR 100 * i.m < 50 * a),
cut AS (
  SELECT lang, phrase, a, 1 AS place, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM kept
  UNION ALL SELECT lang, phrase, a, 2, array_to_string(w[1:2], ' '), w[3] FROM kept WHERE k = 3),
s AS (
  SELECT cut.*, l.f AS l, r.f AS r, (CAST(1000000 AS HUGEINT) * a * a) // (l.f * r.f) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, place) AS c FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE c = 1)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o JOIN n USING (lang) WHERE rank <= 2000
"""
