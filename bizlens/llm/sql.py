"""DuckDB twins of the registered training-data queries that SQL can express."""

from __future__ import annotations

from bizlens.llm.adaptive_rules import LEAST as LEAST_GROUP
from bizlens.llm.adaptive_rules import RATES, SPREAD
from bizlens.llm.decontaminate import DENOMINATOR, NUMERATOR, REACH, WORDS
from bizlens.llm.line_dedup import BLANK, MIN_SITES
from bizlens.llm.phrase_mining import INSIDE, LEAST, LONGEST, SCALE, TOP
from bizlens.llm.weighted_mix import BUDGET, EPOCHS, SEED, WEIGHTS

BLANKS = " || ".join(f"chr({ord(c)})" for c in BLANK)


def adaptive_rules_sql() -> str:
    rates = " UNION ALL ".join(
        f"SELECT *, '{name}' AS rate, (10000 * {num}) // greatest({den}, 1) AS v, {slack} AS slack FROM m"
        for name, (num, den, slack) in RATES.items())

    def level(by: str, name: str) -> str:
        cut = f"PARTITION BY {by}rate"
        return f"""{name} AS (
  SELECT {by}rate, max(total) AS total, min(CASE WHEN 4 * upto >= total THEN bin END) AS q25,
         min(CASE WHEN 4 * upto >= 3 * total THEN bin END) AS q75
  FROM (SELECT {by}rate, bin, sum(n) OVER ({cut} ORDER BY bin) AS upto, sum(n) OVER ({cut}) AS total
        FROM (SELECT {by}rate, bin, count(*) AS n FROM b GROUP BY ALL)) GROUP BY ALL)"""

    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, len(w) AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines,
        len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed
      FROM w LEFT JOIN r USING (doc_id)),
v AS ({rates}),
b AS (SELECT *, v - v % (1::BIGINT << greatest(length(bin(v)) - 8, 0)) AS bin FROM v WHERE NOT base_failed),
{level("lang, source, ", "tg")}, {level("lang, ", "tl")}, {level("", "ta")},
f AS (SELECT v.doc_id, bool_and(v.v BETWEEN
          t.q25 - {SPREAD} * (t.q75 - t.q25) - slack AND t.q75 + {SPREAD} * (t.q75 - t.q25) + slack) AS ok
      FROM v JOIN (
        SELECT tg.lang, tg.source, tg.rate,
               CASE WHEN tg.total >= {LEAST_GROUP} THEN tg.q25 WHEN tl.total >= {LEAST_GROUP} THEN tl.q25 ELSE ta.q25 END AS q25,
               CASE WHEN tg.total >= {LEAST_GROUP} THEN tg.q75 WHEN tl.total >= {LEAST_GROUP} THEN tl.q75 ELSE ta.q75 END AS q75
        FROM tg JOIN tl ON tg.rate = tl.rate AND tg.lang IS NOT DISTINCT FROM tl.lang
        JOIN ta ON tg.rate = ta.rate) t
      ON v.rate = t.rate AND v.lang IS NOT DISTINCT FROM t.lang AND v.source IS NOT DISTINCT FROM t.source
      GROUP BY v.doc_id)
SELECT m.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(ok, TRUE) AS kept
FROM m LEFT JOIN f USING (doc_id)"""



def decontaminate_sql() -> str:
    words = (r"list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), "
             "lambda x: x <> '')")
    return f"""
WITH i AS (SELECT *, len(w) AS n FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) >= {WORDS}),
d AS (SELECT doc_id, {words} AS w FROM documents),
ish AS (SELECT item_id, n, a, array_to_string(w[a + 1:a + {WORDS}], ' ') AS sh
        FROM (SELECT *, unnest(range(0, n - {WORDS - 1})) AS a FROM i)),
dsh AS (SELECT doc_id, pos, array_to_string(w[pos + 1:pos + {WORDS}], ' ') AS sh
        FROM (SELECT *, unnest(range(0, len(w) - {WORDS - 1})) AS pos FROM d)),
s AS (SELECT DISTINCT doc_id, n, pos - a AS s FROM dsh JOIN (SELECT DISTINCT n, a, sh FROM ish) USING (sh)),
p AS (SELECT DISTINCT doc_id, n, greatest(0, least(s + k, len(w) - n)) AS s
      FROM s JOIN d USING (doc_id), range(-{REACH}, {REACH + 1}) AS r(k)),
win AS (SELECT doc_id, n, s, w[s + 1:s + n] AS w FROM p JOIN d USING (doc_id)),
wsh AS (SELECT doc_id, n, s, sh, count(*) AS c FROM (
          SELECT doc_id, n, s, array_to_string(w[q + 1:q + {WORDS}], ' ') AS sh
          FROM (SELECT *, unnest(range(0, len(w) - {WORDS - 1})) AS q FROM win)) GROUP BY ALL),
isc AS (SELECT item_id, n, sh, count(*) AS c FROM ish GROUP BY ALL),
x AS (SELECT doc_id, n, s, item_id, sum(least(wsh.c, isc.c)) AS i FROM wsh JOIN isc USING (n, sh) GROUP BY ALL),
u AS (SELECT x.*, (SELECT len(w) - {WORDS - 1} FROM win WHERE win.doc_id = x.doc_id AND win.n = x.n AND win.s = x.s)
             + n - {WORDS - 1} - i AS u FROM x)
SELECT doc_id, item_id, CAST(s AS BIGINT) AS start_word, CAST(n AS BIGINT) AS n_words, CAST(i AS DOUBLE) / u AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY CAST(i AS DOUBLE) / u DESC, s) AS k
      FROM u WHERE {DENOMINATOR} * i >= {NUMERATOR} * u) WHERE k = 1"""


def line_dedup_sql() -> str:
    return f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                  unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
b AS (SELECT trim(line, {BLANKS}) AS line, min((doc_id, pos)) AS first FROM l
      WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (SELECT l.doc_id, l.pos, l.line, b.line IS NOT NULL AND (l.doc_id, l.pos) <> b.first AS gone
      FROM l LEFT JOIN b ON trim(l.line, {BLANKS}) = b.line)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
       count(*) FILTER (gone) AS n_removed_lines FROM m GROUP BY doc_id"""


def weighted_mix_sql() -> str:
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    epochs = ", ".join(map(str, range(EPOCHS)))
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r
      FROM d GROUP BY source),
w AS (SELECT *, {EPOCHS} * source_size AS cap, CASE (r - 1) % {len(WEIGHTS)} {weight} END AS w FROM s),
b AS (SELECT CAST(sum(source_size) AS BIGINT) * {BUDGET[0]} / {BUDGET[1]} AS share,
        CAST(sum(source_size) AS BIGINT) * {BUDGET[0]} // {BUDGET[1]} AS words, sum(w) AS all_w FROM w),
v AS (SELECT *, cap / w AS level, CAST(sum(cap) OVER o AS BIGINT) AS caps, CAST(sum(w) OVER o AS BIGINT) AS ws,
        row_number() OVER o AS place FROM w WINDOW o AS (ORDER BY cap / w, r ROWS UNBOUNDED PRECEDING)),
f AS (SELECT coalesce(max(place), 0) AS place, coalesce(max(caps), 0) AS caps, coalesce(max(ws), 0) AS ws
      FROM v, b WHERE caps + level * CAST(all_w - ws AS BIGINT) <= share),
t AS (SELECT source, source_size, r, CASE WHEN v.place <= f.place THEN CAST(cap AS DOUBLE)
        ELSE w * ((share - f.caps) / CAST(all_w - f.ws AS BIGINT)) END AS target FROM v, f, b),
q AS (SELECT row_number() OVER () AS row, doc_id, d.source, key, size, source_size, r, target,
        CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT row, key, size, r, epoch, CASE WHEN target > 0 THEN (upto + source_size * epoch) / target ELSE 0.0 END AS finish
      FROM q, (SELECT unnest([{epochs}]) AS epoch)),
m AS (SELECT row, size, sum(size) OVER (ORDER BY finish, r, key, epoch ROWS UNBOUNDED PRECEDING) AS served FROM c),
k AS (SELECT row, sum(size) AS taken FROM m, b WHERE served <= words GROUP BY row)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM q LEFT JOIN k USING (row)"""


def prefix_trie_sql() -> str:
    # crc32 of the decimal id, a bit at a time (the reflected polynomial of ISO 3309)
    bits = "list_reduce(list_prepend(xor(z, y), range(0, 8)), lambda b, i: xor(b >> 1, (b & 1) * 3988292384::BIGINT))"
    crc = (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), "
           f"lambda x: CAST(ascii(x) AS BIGINT))), lambda z, y: {bits}), 4294967295::BIGINT)")
    return rf"""
WITH t AS (SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w,
        md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d
      FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'d': d, 'w': w}} ORDER BY turn NULLS FIRST, d) AS ts FROM t GROUP BY conv_id),
h AS (SELECT *, {crc} % 4 AS h FROM c),
b AS (SELECT h.conv_id, list_concat(coalesce(list_slice(o.ts, 1, h), []), list_slice(h.ts, h + 1, len(h.ts))) AS ts
      FROM h LEFT JOIN c o ON o.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, len(ts) AS n, k AS depth, coalesce(ts[k].w, 0) AS w,
        md5(array_to_string(list_transform(list_slice(ts, 1, k), lambda x: x.d), '')) AS node,
        CASE WHEN k > 0 THEN md5(array_to_string(list_transform(list_slice(ts, 1, k - 1), lambda x: x.d), '')) END AS up
      FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS k FROM b)),
n AS (SELECT node, up, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
        sha256(coalesce(string_agg(CASE WHEN n = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), ''))
          AS ends_sha256
      FROM p GROUP BY node, up, depth),
k AS (SELECT up, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
e AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN k.up IS NULL THEN 1 ELSE 0 END AS leaf,
        (n_convs - 1) * w AS own FROM n LEFT JOIN k ON k.up = n.node),
s AS (SELECT p.node, sum(leaf) AS n_leaves, sum(own) AS saved_tokens
      FROM e JOIN p ON p.conv_id = e.conv_id AND p.depth <= e.depth GROUP BY p.node)
SELECT e.conv_id, e.depth, u.conv_id AS parent_conv_id, e.n_convs, e.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, e.ends_sha256
FROM e JOIN s ON s.node = e.node LEFT JOIN n u ON u.node = e.up"""


def collocations_sql() -> str:
    share, of = INSIDE
    lengths = range(2, LONGEST + 1)
    grams = " UNION ALL ".join(f"SELECT lang, [{', '.join(f'w{j}' for j in range(k))}] AS w FROM g WHERE w{k - 1} IS NOT NULL"
                               for k in range(1, LONGEST + 1))
    next_words = ", ".join(f"lead(w, {j}) OVER o AS w{j}" for j in range(LONGEST))
    key = "lang || chr(10) || array_to_string({}, ' ')".format      # one key, so that two look-ups are not joined by lang
    cuts = " UNION ALL ".join(f"SELECT lang, w, f, {k} AS cut, {key(f'w[:{k}]')} AS head, {key(f'w[{k + 1}:]')} AS rest "
                              f"FROM c WHERE len(w) > {k}" for k in range(1, LONGEST))
    inner = " UNION ALL ".join(f"SELECT lang, f, w[{i}:{i + n - 1}] AS w FROM c WHERE len(w) > {n} AND len(w) >= {i + n - 1}"
                               for n in lengths for i in range(1, LONGEST - n + 2))
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
q AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, piece, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM q),
g AS (SELECT lang, {next_words} FROM t WINDOW o AS (PARTITION BY piece ORDER BY i)),
f AS MATERIALIZED (SELECT lang, w, {key('w')} AS key, count(*) AS f FROM ({grams}) GROUP BY lang, w),
z AS (SELECT lang, sum(f) AS n FROM f WHERE len(w) = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE f >= {LEAST} AND len(w) > 1),
s AS (SELECT x.lang, x.w, x.f AS a, cut, l.f AS l, r.f AS r,
        ({SCALE}::HUGEINT * x.f) // (l.f + r.f) AS score
      FROM ({cuts}) x JOIN f l ON l.key = x.head
      JOIN f r ON r.key = x.rest),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, cut) = 1),
o AS (SELECT lang, w, max(f) AS longer FROM ({inner}) GROUP BY lang, w),
k AS (SELECT m.*, array_to_string(m.w, ' ') AS phrase FROM m LEFT JOIN o USING (lang, w)
      WHERE longer IS NULL OR {of}::HUGEINT * longer < {share}::HUGEINT * a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM k JOIN z ON z.lang = k.lang QUALIFY rank <= {TOP}"""
