"""The registered queries in DuckDB SQL, for checking. Written from the same rules, not from the Spark plans."""

from __future__ import annotations

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NW = r"[^\p{L}\p{N}_]"
PUNCTUATION = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def tok(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '{WS}+'), lambda t: t <> '')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def normal(c: str) -> str:
    article = lambda x: f"regexp_replace({x}, '(^|{NW})(?:a|an|the)($|{NW})', '\\1 \\2', 'g')"
    bare = f"translate({article(article(f'lower({c})'))}, '{PUNCTUATION}', '')"
    return f"array_to_string(list_filter(regexp_split_to_array({bare}, '{WS}+'), lambda t: t <> ''), ' ')"


def extract(c: str) -> str:
    p1, p2 = (rf"(?i-s){w}(?:[:\s]|{WS})+(.+?)(?:\.|\n?$)" for w in ("(?:the answer is|final answer)", "(?:answer)"))
    return f"""CASE WHEN regexp_matches({c}, '{p1}') THEN {strip(f"regexp_extract({c}, '{p1}', 1)")}
        WHEN regexp_matches({c}, '{p2}') THEN {strip(f"regexp_extract({c}, '{p2}', 1)")}
        ELSE coalesce(list_filter(list_transform(string_split({c}, '\n'), lambda x: {strip('x')}), lambda x: x <> '')[-1], '') END"""


def f1(p: str, g: str) -> str:
    """From two columns with lists of words."""
    both = f"coalesce(list_sum(list_transform(list_distinct({g}), lambda w: least(len(list_filter({p}, lambda x: x = w)), len(list_filter({g}, lambda x: x = w))))), 0)"
    return f"CASE WHEN len({g}) = 0 THEN CASE WHEN len({p}) = 0 THEN 1.0 ELSE 0.0 END WHEN len({p}) = 0 OR {both} = 0 THEN 0.0 ELSE 2.0 * {both} / (len({p}) + len({g})) END"


def words(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda t: t <> '')"


TRAJ = """turns AS (SELECT conv_id, turn, role, text, string_split(text, ' ') AS w FROM conversations),
pieces AS (SELECT conv_id, turn, role, array_to_string(w[1:3], ' ') AS head, array_to_string(w[1:5], ' ') AS query,
  CASE role WHEN 'user' THEN '<think>
' || CASE WHEN conv_id % 3 = 0 THEN 'I need to search for ' || array_to_string(w[1:3], ' ') || '.
' ELSE '' END || text || '
</think>' || CASE WHEN conv_id % 7 = 0 THEN '
<continue>' ELSE '' END
  WHEN 'assistant' THEN '<search>' || array_to_string(w[1:5], ' ') || '</search>
<results>
[1] ' || text || '
</results>' ELSE '' END AS piece FROM turns),
traj AS (SELECT 'c' || conv_id || '_0_traj' AS id, 'c' || conv_id || '_0' AS question_id, conv_id AS pos, 'ds' || (conv_id % 3) AS dataset,
  string_agg(piece, '
' ORDER BY turn) || CASE WHEN conv_id % 10 = 9 THEN '' ELSE '
Answer: ' || arg_max(head, turn) END AS text,
  count(*) FILTER (WHERE role = 'assistant') AS num_search_steps, conv_id % 10 = 9 AS incomplete, arg_max(head, turn) AS answer,
  coalesce(list(query ORDER BY turn) FILTER (WHERE role = 'assistant'), []) AS queries
  FROM pieces GROUP BY conv_id)"""

PAIRS = f"{TRAJ}, pairs AS (SELECT id, question_id, dataset, text, {extract('text')} AS prediction, answer AS gold FROM traj)"
EVALUATED = f"{PAIRS}, normed AS (SELECT *, {normal('prediction')} AS p, {normal('gold')} AS g FROM pairs), evaluated AS (SELECT *, CASE WHEN p = g THEN 1.0::DOUBLE ELSE 0.0 END AS em, ({f1(words('p'), words('g'))})::DOUBLE AS f1 FROM normed)"


def spans_of(pattern: str, source: str, text: str = "text", base: str = "0") -> str:
    """(id, s, e) of all matches of a pattern in a relation with id and a text."""
    return f"""(SELECT id, ahead + gap_sum AS s, ahead + gap_sum + len_m AS e FROM (
      SELECT id, i, len_m, base + coalesce(sum(len_m) OVER (PARTITION BY id, base ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead, sum(len_g) OVER (PARTITION BY id, base ORDER BY i) AS gap_sum FROM (
        SELECT id, base, unnest(range(1, len(m) + 1)) AS i, unnest(list_transform(m, lambda x: length(x))) AS len_m, unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS len_g FROM (
          SELECT id, {base} AS base, regexp_extract_all({text}, '{pattern}') AS m, regexp_split_to_array({text}, '{pattern}') AS g FROM {source}))))"""


def _spans() -> str:
    return f"""blocks AS {spans_of('(?s)<search>.*?</search>', 'traj')}, marks AS {spans_of('<search>|<continue>|<synthesize>', 'traj')},
spans AS (SELECT id, s, e FROM blocks UNION ALL SELECT id, s, e FROM marks k WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.id = k.id AND b.s <= k.s AND k.e <= b.e))"""


INTENT = r"[Ll]et me search\b|[Ll]et me look up\b|[Ll]et me find\b|[Ii] need to (?:search|find|look up)\b|[Ii] should (?:search|find|look up)\b|[Ii] (?:will|''ll) search\b|(?:[Nn]ow|[Ff]irst,?|[Nn]ext,?) (?:let me |I (?:need to |will |should ))?(?:search|find|look up)\b"
SPANS = f"{TRAJ}, {_spans()}"
EXTENDED = f"""{SPANS}, thinks AS {spans_of('(?s)<think>.*?</think>', 'traj')},
inner_text AS (SELECT t.id, substring(t.text, (k.s + 8)::BIGINT, (k.e - k.s - 15)::BIGINT) AS body, k.s + 7 AS off FROM thinks k JOIN traj t ON t.id = k.id),
sentences AS {spans_of('[^.!?' + chr(10) + ']+[.!?' + chr(10) + ']?', 'inner_text', 'body', 'off')},
meant AS (SELECT x.id, x.s, x.e FROM sentences x JOIN traj t ON t.id = x.id WHERE regexp_matches(substring(t.text, (x.s + 1)::BIGINT, (x.e - x.s)::BIGINT), '{INTENT}')
  AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.id = x.id AND b.s <= x.s AND x.e <= b.e))"""

SYNTHESIS = r"\b(?:[Bb]ased on|[Aa]ccording to|[Ff]rom) (?:the|these|those|all|my)(?: \w+)? (?:results?|passages?|evidence|findings|information)\b|\b[Tt]he (?:results?|passages?|evidence) (?:says?|shows?|suggests?|confirms?|indicates?)\b|\b[Ii] (?:now )?(?:have enough|can (?:now )?(?:answer|conclude|combine))\b|\b[Pp]utting (?:this|these|it all) together\b"
THOUGHT = TRAJ.removesuffix("FROM pieces GROUP BY conv_id)").replace("traj AS (", "plain AS (") + f"""FROM pieces GROUP BY conv_id),
traj AS (SELECT * REPLACE (text || CASE WHEN pos % 4 = 0 THEN chr(10) || '<think>Based on the results, it is ' || string_split(text, ' ')[-1] || '. Nothing else? The passages say that, so done.' || chr(10) || 'According to these results: yes</think>' ELSE '' END AS text) FROM plain)"""

TOKENS = f"""{SPANS}, runs AS {spans_of(WS.replace('[', '[^', 1) + '+', 'traj')},
tokens AS (SELECT r.id AS traj_id, row_number() OVER (PARTITION BY r.id ORDER BY r.s) - 1 AS pos, substring(t.text, (r.s + 1)::BIGINT, (r.e - r.s)::BIGINT) AS token, r.s AS "start", r.e AS "end" FROM runs r JOIN traj t ON t.id = r.id),
typed AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM spans p WHERE p.id = k.traj_id AND k."start" >= p.s AND k."end" <= p.e) THEN 'search_decision' ELSE 'reasoning' END AS type FROM tokens k)"""

VOCABULARY = f"""counts AS (SELECT student, token, count(*) AS c FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS student, unnest({tok('text')}) AS token FROM documents) GROUP BY ALL),
totals AS (SELECT student, sum(c) AS t, count(*) AS v FROM counts GROUP BY student),
vocabulary AS (SELECT c.student, token, c, row_number() OVER (PARTITION BY c.student ORDER BY c DESC, token) - 1 AS rank, (c + 1)::DOUBLE / (t + v + 1) AS p FROM counts c JOIN totals USING (student))"""

TABLE = f"""{TOKENS}, {VOCABULARY},
scored AS (SELECT k.traj_id, o.student, k.pos, k.type, coalesce(v.rank, o.v) AS rank, -ln(coalesce(v.p, 1.0::DOUBLE / (o.t + o.v + 1))) AS surprisal
  FROM typed k CROSS JOIN totals o LEFT JOIN vocabulary v ON v.student = o.student AND v.token = lower(k.token) WHERE k.pos > 0)"""


CONTINUED = f"""{VOCABULARY}, toks AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS student, {tok('text')} AS w FROM documents),
continued AS (SELECT *, row_number() OVER (PARTITION BY student, prev ORDER BY c DESC, token) - 1 AS nth FROM (
  SELECT n.student, prev, n.token, n.c, v.p, v.rank AS place FROM (SELECT student, prev, token, count(*) AS c FROM (SELECT student, unnest(w[:-2]) AS prev, unnest(w[2:]) AS token FROM toks) GROUP BY ALL) n JOIN vocabulary v ON v.student = n.student AND v.token = n.token)),
contexts AS (SELECT student, prev, sum(c)::BIGINT AS total, count(*) AS n, sum(p) AS mass FROM continued GROUP BY student, prev)"""
IN_CONTEXT = f"""{TOKENS}, {CONTINUED}, after AS (SELECT *, lower(lag(token) OVER (PARTITION BY traj_id ORDER BY pos)) AS prev, lower(token) AS key FROM typed),
asked AS (SELECT o.student, a.prev, a.key, coalesce(v.rank, o.v) AS place, coalesce(v.p, 1.0::DOUBLE / (o.t + o.v + 1)) AS p FROM (SELECT DISTINCT prev, key FROM after WHERE pos > 0) a CROSS JOIN totals o LEFT JOIN vocabulary v ON v.student = o.student AND v.token = a.key),
earlier AS (SELECT a.student, a.prev, a.key, count(*) AS before FROM asked a JOIN continued c ON c.student = a.student AND c.prev = a.prev AND c.place < a.place GROUP BY ALL),
given AS (SELECT a.student, a.prev, a.key, CASE WHEN c.nth IS NOT NULL THEN c.nth ELSE a.place + coalesce(x.n, 0) - coalesce(e.before, 0) END AS rank,
  CASE WHEN c.nth IS NOT NULL THEN c.c::DOUBLE / (x.total + 1) WHEN x.n IS NOT NULL THEN a.p / ((x.total + 1) * (1 - x.mass)) ELSE a.p END AS p
  FROM asked a LEFT JOIN continued c ON c.student = a.student AND c.prev = a.prev AND c.token = a.key LEFT JOIN contexts x ON x.student = a.student AND x.prev = a.prev LEFT JOIN earlier e ON e.student = a.student AND e.prev = a.prev AND e.key = a.key),
scored AS (SELECT a.traj_id, g.student, a.pos, a.type, g.rank, -ln(g.p) AS surprisal FROM after a JOIN given g ON g.prev = a.prev AND g.key = a.key WHERE a.pos > 0)"""


def _ratio(test: str) -> str:
    return f"CASE WHEN count(*) FILTER (WHERE {test}) = 0 OR sum(surprisal) FILTER (WHERE {test}) < 1e-8 THEN 'inf'::DOUBLE ELSE sum(least(rank, 100)) FILTER (WHERE {test})::DOUBLE / sum(surprisal) FILTER (WHERE {test}) END"


SCORES = f"""{TABLE}, scores AS (SELECT traj_id, student, count(*) AS num_tokens, avg(rank) AS mean_rank, avg(surprisal) AS mean_surprisal, {_ratio('true')} AS rsr_full,
  {_ratio("type = 'reasoning'")} AS rsr_reasoning, {_ratio("type = 'search_decision'")} AS rsr_search_decision,
  count(*) FILTER (WHERE type = 'reasoning') AS num_reasoning_tokens, count(*) FILTER (WHERE type = 'search_decision') AS num_search_decision_tokens FROM scored GROUP BY traj_id, student)"""


def composite(a: str) -> str:
    return f"CASE WHEN isinf(rsr_search_decision) THEN rsr_reasoning WHEN isinf(rsr_reasoning) THEN rsr_search_decision ELSE (1 - {a}) * rsr_reasoning + {a} * rsr_search_decision END"


SWEEP = f"""{SCORES}, sweep AS (SELECT *, row_number() OVER (PARTITION BY student, alpha ORDER BY score, traj_id) AS rnk FROM (
  SELECT traj_id, student, alpha, round({composite('alpha')}, 6) AS score FROM scores, (SELECT unnest([0.0, 0.2, 0.4, 0.6, 0.8, 1.0])::DOUBLE AS alpha)))"""


def finite(c: str, name: str | None = None) -> str:
    return f"CASE WHEN NOT isinf({c}) THEN round({c}, 6) END AS {name or c}, isinf({c}) AS {name or c}_inf"


SELECTABLE = f"""{TRAJ}, q AS (SELECT *, list_transform(queries, lambda x: lower({strip('x')})) AS qs, list_distinct(list_transform(queries, lambda x: string_split(x, ' ')[1])) AS wanted, string_split(answer, ' ')[1:3] AS got FROM traj),
selectable AS (SELECT q.id, q.pos, q.dataset, l.quality = 1 AS answer_correct, q.num_search_steps, len(q.queries) AS num_queries, len(list_distinct(q.qs)) AS num_unique_queries,
  CASE WHEN len(wanted) > 0 THEN round(len(list_intersect(wanted, got))::DOUBLE / len(wanted), 6) ELSE 0.0 END AS evidence_coverage,
  EXISTS (SELECT 1 FROM unnest(range(1, len(qs) + 1)) i(i), unnest(range(1, len(qs) + 1)) j(j) WHERE i < j AND qs[i] <> qs[j] AND len(list_intersect({words('qs[i]')}, {words('qs[j]')})) > 0) AS has_query_refinement
  FROM q LEFT JOIN labels l ON l.doc_id = q.pos),
structural AS (SELECT *, round(0.25 * least(num_search_steps / 5.0::DOUBLE, 1.0) + 0.25 * CASE WHEN num_queries > 0 THEN num_unique_queries::DOUBLE / num_queries ELSE 0.0 END + 0.30 * evidence_coverage + 0.20 * has_query_refinement::INT, 6) AS score FROM selectable)"""

INDEX = f"""passages AS (SELECT doc_id AS pos, source AS title, text, {tok("source || ' ' || text")} AS toks FROM documents),
stats AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM passages),
post AS (SELECT pos, dl, term, count(*) AS tf FROM (SELECT pos, len(toks) AS dl, unnest(toks) AS term FROM passages) GROUP BY ALL),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, stats GROUP BY term),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
BM25 = f"""{INDEX},
asked AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({tok('text')}) AS term FROM benchmark) GROUP BY ALL),
summed AS (SELECT qid, pos, round(sum(qtf * idf * tf * 1.9 / (tf + 0.9 * (1 - 0.4 + 0.4 * dl / avgdl))), 6) AS score FROM asked JOIN post USING (term) JOIN terms USING (term), stats GROUP BY qid, pos),
hits AS (SELECT qid, pos, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS rank FROM summed)"""

LINES = """lines AS (SELECT source AS title, doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS text FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents)),
firsts AS (SELECT title, text, min((doc_id, i)) AS pos FROM lines WHERE text <> '' {filter} GROUP BY title, text),
corpus AS (SELECT title, text, row_number() OVER (PARTITION BY title ORDER BY pos) - 1 AS nth FROM firsts)"""

QA = """base AS (SELECT doc_id, doc_id::VARCHAR AS id, text, string_split(text, ' ') AS w, lang AS answer FROM documents),
qa AS (
 SELECT id, text AS question, answer, list_transform(range(0, least(len(w), 4)), lambda i: {'t': w[i + 1], 's': i::VARCHAR, 'p': NULL::VARCHAR}) AS facts, 'hotpotqa' AS dataset FROM base WHERE doc_id % 3 = 0
 UNION ALL SELECT id, text, CASE WHEN doc_id % 2 = 0 THEN answer ELSE '' END, list_transform(list_filter(range(0, len(w)), lambda i: i % 3 = 0), lambda i: {'t': w[i + 1], 's': NULL::VARCHAR, 'p': w[i + 1] || '!'}), 'musique' FROM base WHERE doc_id % 3 = 1
 UNION ALL SELECT id, text, answer, CASE WHEN doc_id % 4 < 2 THEN list_transform(list_filter(range(0, len(w)), lambda i: i % 2 = 0), lambda i: {'t': w[i + 1], 's': i::VARCHAR, 'p': NULL::VARCHAR})
   ELSE list_transform(range(0, least(len(w), 3)), lambda i: {'t': w[i + 1], 's': i::VARCHAR, 'p': NULL::VARCHAR}) END, '2wikimultihopqa' FROM base WHERE doc_id % 3 = 2),
unified AS (SELECT *, CASE WHEN length(question) % 2 = 0 THEN 'train' ELSE 'validation' END AS split FROM qa)"""

SUMMARY = f"""{TRAJ}, summary AS (SELECT dataset, count(*) AS total, count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE ok AND contains(text, 'Answer:')) AS has_answer, count(*) FILTER (WHERE incomplete) AS incomplete, count(*) FILTER (WHERE NOT ok) AS not_valid
  FROM (SELECT *, NOT incomplete AND num_search_steps > 0 AS ok FROM traj) GROUP BY dataset)"""

PREFIX = "Answer the following question by searching for information step by step.\n\nQuestion: "

MOVED = """inside AS (SELECT p.id, p.s, p.e, min(k.pos) AS lo, max(k.pos) AS hi FROM spans p JOIN tokens k ON k.traj_id = p.id AND k."start" < p.e AND k."end" > p.s GROUP BY ALL),
most AS (SELECT traj_id, max(pos) AS most FROM tokens GROUP BY traj_id),
moved AS (SELECT i.id, a."start" AS s, b."end" AS e FROM inside i JOIN most m ON m.traj_id = i.id JOIN tokens a ON a.traj_id = i.id AND a.pos = greatest(i.lo - 5, 0) JOIN tokens b ON b.traj_id = i.id AND b.pos = least(i.hi + 5, m.most))"""

SPEARMAN = """r AS (SELECT student, rank() OVER (PARTITION BY student ORDER BY x) + (count(*) OVER (PARTITION BY student, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY student ORDER BY y) + (count(*) OVER (PARTITION BY student, y) - 1) / 2.0::DOUBLE AS ry FROM f)
SELECT student, count(*) AS n, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN round(covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)), 6) END AS rho FROM r GROUP BY student"""

LATE = "e AS (SELECT vec_id // 8 AS doc_id, vec_id % 8 AS pos, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL)"


def _moved(i: int) -> str:
    """The next centroids: means of the vectors nearest to each."""
    return f"""near{i} AS (SELECT e.doc_id, e.pos, e.v, k.c, k.v AS k FROM e, c{i} k QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY list_dot_product(e.v, k.v) - list_dot_product(k.v, k.v) / 2 DESC, k.c) = 1),
c{i + 1} AS (SELECT k.c, coalesce(m.v, k.v) AS v FROM c{i} k LEFT JOIN (SELECT c, list(x ORDER BY i) AS v FROM (SELECT c, i, avg(x) AS x FROM (SELECT c, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM near{i}) GROUP BY c, i) GROUP BY c) m USING (c))"""


CODED = f"""{LATE}, c0 AS (SELECT row_number() OVER (ORDER BY spot) - 1 AS c, v FROM (SELECT v, min((doc_id, pos)) AS spot FROM e GROUP BY v ORDER BY spot LIMIT 16)),
{_moved(0)}, {_moved(1)}, {_moved(2)},
residuals AS (SELECT doc_id, pos, c, k, v, unnest(range(1, len(v) + 1)) AS i, round(unnest(list_transform(list_zip(v, k), lambda x: x[1] - x[2])), 9) AS r FROM near2),
cut AS (SELECT 0.9816 * sqrt(avg(r * r)) AS cut FROM residuals),
bucketed AS (SELECT *, (r >= -cut)::INT + (r >= 0)::INT + (r >= cut)::INT AS b FROM residuals, cut),
levels AS (SELECT b, avg(r) AS level FROM bucketed GROUP BY b),
decoded AS (SELECT doc_id, pos, any_value(c) AS c, any_value(v) AS v, list(k[i] + level ORDER BY i) AS w FROM bucketed JOIN levels USING (b) GROUP BY doc_id, pos)"""

SQL = {
    "late_topk": f"""WITH {LATE}, best AS (SELECT q.doc_id AS qid, q.pos, d.doc_id, max(list_dot_product(q.v, d.v)) AS best FROM e q, e d WHERE q.doc_id % 10 = 0 GROUP BY ALL),
total AS (SELECT qid, doc_id, round(sum(best), 5) AS score FROM best GROUP BY ALL), nth AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM total) SELECT * FROM nth WHERE rank <= 5""",
    "late_reconstruction": f"WITH {CODED} SELECT doc_id, pos, c AS centroid, round(list_sum(list_transform(list_zip(v, w), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) AS error FROM decoded",
    "late_quantized": f"""WITH {CODED}, q AS (SELECT doc_id AS qid, pos, v FROM e WHERE doc_id % 10 = 0),
lists AS (SELECT q.qid, q.pos, q.v, k.c FROM q, c2 k QUALIFY row_number() OVER (PARTITION BY q.qid, q.pos ORDER BY list_dot_product(q.v, k.v) DESC, k.c) <= 8),
met AS (SELECT l.qid, l.pos, d.doc_id, d.pos AS place, list_dot_product(l.v, d.w) AS s FROM lists l JOIN decoded d USING (c)),
share AS (SELECT qid, round(count(DISTINCT (doc_id, place))::DOUBLE / (SELECT count(*) FROM e), 6) AS share FROM met GROUP BY qid),
near AS (SELECT qid, doc_id, sum(s) AS s FROM (SELECT qid, pos, doc_id, max(s) AS s FROM met GROUP BY qid, pos, doc_id) GROUP BY qid, doc_id QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(sum(s), 5) DESC, doc_id) <= 24),
total AS (SELECT qid, doc_id, round(sum(s), 5) AS score FROM (SELECT n.qid, q.pos, n.doc_id, max(list_dot_product(q.v, e.v)) AS s FROM near n JOIN q USING (qid) JOIN e ON e.doc_id = n.doc_id GROUP BY ALL) GROUP BY ALL),
nth AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM total) SELECT nth.*, share FROM nth JOIN share USING (qid) WHERE rank <= 5""",
    "bm25_topk": f"WITH {BM25} SELECT qid, rank, pos::VARCHAR AS doc_id, title, md5(text) AS text_md5, score FROM hits JOIN passages USING (pos) WHERE rank <= 5",
    "bm25_corpus_stats": f"WITH {INDEX} SELECT n, round(avgdl, 6) AS avgdl FROM stats",
    "bm25_terms": f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "bm25_context": f"WITH {BM25} SELECT qid, md5('[' || title || '] ' || substring(text, 1, 500)) AS context_md5 FROM hits JOIN passages USING (pos) WHERE rank = 1",
    "bm25_pruned": f"""WITH {BM25}, blocks AS (SELECT term, pos // 8 AS range, max(tf * 1.9 / (tf + 0.9 * (1 - 0.4 + 0.4 * dl / avgdl))) AS best FROM post, stats GROUP BY ALL),
bounds AS (SELECT qid, range, round(sum(qtf * greatest(idf * best, 0)), 6) AS bound, count(*) AS blocks FROM asked JOIN blocks USING (term) JOIN terms USING (term) GROUP BY qid, range),
nth AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bound DESC, range) AS nth FROM bounds),
least AS (SELECT qid, score AS least FROM (SELECT s.qid, s.score, row_number() OVER (PARTITION BY s.qid ORDER BY score DESC) AS k FROM summed s JOIN nth n ON n.qid = s.qid AND n.range = s.pos // 8 AND n.nth <= 8) WHERE k = 5),
sure AS (SELECT qid FROM asked LEFT JOIN terms USING (term) GROUP BY qid HAVING max(df) >= 5 AND min(idf) > 0),
counts AS (SELECT n.qid, sum(blocks)::BIGINT AS blocks, sum(blocks) FILTER (WHERE nth <= 8 OR least IS NULL OR bound + 3e-6 >= least OR n.qid NOT IN (SELECT qid FROM sure))::BIGINT AS blocks_read FROM nth n LEFT JOIN least USING (qid) GROUP BY n.qid)
SELECT qid, rank, pos::VARCHAR AS doc_id, score, blocks, blocks_read FROM hits JOIN counts USING (qid) WHERE rank <= 5""",
    "dense_topk": """WITH pairs AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[]))), 5) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM pairs) SELECT qid, rank, doc_id, score FROM ranked WHERE rank <= 5""",
    "tokenize": f"SELECT doc_id, len({tok('text')}) AS n_tokens, md5(array_to_string({tok('text')}, ' ')) AS tokens_md5 FROM documents",
    "normalize_answer": f"SELECT doc_id, md5({normal('text')}) AS normal_md5 FROM documents",
    "extract_answer": f"WITH {PAIRS} SELECT id, prediction FROM pairs",
    "exact_match": f"WITH {EVALUATED} SELECT id, em FROM evaluated",
    "token_f1": f"WITH n AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM conversations), w AS (SELECT conv_id, turn, {words(normal('text'))} AS p, {words(normal('gold'))} AS g FROM n WHERE gold IS NOT NULL) SELECT conv_id, turn, round(({f1('p', 'g')})::DOUBLE, 6) AS f1 FROM w",
    "eval_rows": f"WITH {EVALUATED} SELECT id, question_id AS question, gold, prediction, md5(text) AS full_md5, em, round(f1, 6) AS f1 FROM evaluated",
    "eval_summary": f"WITH {EVALUATED} SELECT dataset, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1, count(*) AS n FROM evaluated GROUP BY dataset",
    "traj_spans": f"WITH {SPANS} SELECT id AS traj_id, s::BIGINT AS s, e::BIGINT AS e FROM spans",
    "traj_spans_extended": f"WITH {EXTENDED} SELECT id AS traj_id, s::BIGINT AS s, e::BIGINT AS e FROM spans UNION ALL SELECT id, s::BIGINT, e::BIGINT FROM meant",
    "decision_phrases": f"""WITH {EXTENDED.replace(TRAJ, THOUGHT, 1).replace(INTENT, INTENT + '|' + SYNTHESIS)} SELECT id AS traj_id, s::BIGINT AS s, e::BIGINT AS e FROM spans UNION ALL SELECT id, s::BIGINT, e::BIGINT FROM meant""",
    "span_char_share": f"WITH {SPANS} SELECT t.id, count(p.s) AS n_spans, round(coalesce(sum(p.e - p.s), 0)::DOUBLE / length(any_value(t.text)), 6) AS share FROM traj t LEFT JOIN spans p ON p.id = t.id GROUP BY t.id",
    "token_types": f'WITH {TOKENS} SELECT traj_id, pos, token, "start"::BIGINT AS "start", "end"::BIGINT AS "end", type FROM typed',
    "subword_texts": f"WITH {TRAJ} SELECT id AS traj_id, md5(text) AS text_md5, length(text) AS chars, 1::BIGINT AS n_without_width FROM traj",
    "vocab_rank": f"WITH {VOCABULARY} SELECT student, token, c, rank, round(p, 9) AS p FROM vocabulary",
    "token_table": f"WITH {TABLE} SELECT traj_id, student, pos, rank::BIGINT AS rank, round(surprisal, 6) AS surprisal FROM scored",
    "context_students": f"WITH {CONTINUED} SELECT student, prev, total, n, round(mass, 9) AS mass FROM contexts",
    "context_tokens": f"WITH {IN_CONTEXT} SELECT traj_id, student, pos, rank::BIGINT AS rank, round(surprisal, 6) AS surprisal FROM scored",
    "context_rsr": f"WITH {IN_CONTEXT}{SCORES[len(TABLE):]} SELECT traj_id, student, {finite('rsr_full')}, {finite('rsr_reasoning')}, {finite('rsr_search_decision')}, round(mean_rank, 6) AS mean_rank, round(mean_surprisal, 6) AS mean_surprisal FROM scores",
    "rsr": f"WITH {SCORES} SELECT traj_id, student, {finite('rsr_full')}, num_tokens, round(mean_rank, 6) AS mean_rank, round(mean_surprisal, 6) AS mean_surprisal FROM scores",
    "rsr_masked": f"WITH {SCORES} SELECT traj_id, student, {finite('rsr_reasoning')}, {finite('rsr_search_decision')}, num_reasoning_tokens, num_search_decision_tokens, round(CASE WHEN num_reasoning_tokens + num_search_decision_tokens > 0 THEN num_search_decision_tokens::DOUBLE / (num_reasoning_tokens + num_search_decision_tokens) ELSE 0.0 END, 6) AS search_decision_ratio FROM scores",
    "sd_rsr": f"WITH {SCORES}, c AS (SELECT traj_id, student, 0.5::DOUBLE AS alpha, {composite('0.5::DOUBLE')} AS sd_rsr_score FROM scores) SELECT traj_id, student, alpha, {finite('sd_rsr_score')} FROM c",
    "alpha_sweep": f"WITH {SWEEP} SELECT traj_id, student, alpha, rnk, {finite('score', 'sd_rsr_score')} FROM sweep",
    "rsr_top_k": f"WITH {SCORES} SELECT traj_id, round(rsr_full, 6) AS score FROM scores WHERE student = 'even' ORDER BY 2, 1 LIMIT 20",
    "traj_metadata": f"WITH {SELECTABLE} SELECT id, dataset, answer_correct, num_search_steps, num_queries, num_unique_queries, evidence_coverage, has_query_refinement FROM selectable",
    "structural_score": f"WITH {SELECTABLE} SELECT id, score FROM structural",
    "select_random": f"WITH {SELECTABLE} SELECT id, dataset FROM selectable ORDER BY md5('42:' || id), id LIMIT 40",
    "select_correct": f"WITH {SELECTABLE} SELECT id, dataset FROM selectable WHERE answer_correct ORDER BY md5('42:' || id), id LIMIT 20",
    "select_mmr": f"""WITH {SELECTABLE}, keyed AS (SELECT *, CASE WHEN (SELECT count(*) FROM structural) > 20 THEN round(0.7 * score + 0.3 * (row_number() OVER (PARTITION BY dataset ORDER BY score DESC, pos) = 1)::INT, 6) ELSE score END AS key FROM structural)
SELECT id, dataset, score, key FROM keyed ORDER BY key DESC, score DESC, pos LIMIT 20""",
    "select_by_method": f"WITH {SCORES}, c AS (SELECT traj_id, round({composite('0.5::DOUBLE')}, 6) AS score FROM scores WHERE student = 'odd') SELECT t.id, t.dataset, c.score FROM c JOIN traj t ON t.id = c.traj_id ORDER BY c.score, t.id LIMIT 25",
    "corpus_passages": f"WITH {LINES.replace('{filter}', '')} SELECT title || '_' || nth AS id, title, md5(text) AS text_md5 FROM corpus",
    "corpus_filtered": "WITH " + LINES.replace("{filter}", "AND title IN (SELECT source FROM documents WHERE lang = 'fr')") + " SELECT title, count(*) AS n, max(nth) AS last FROM corpus GROUP BY title",
    "qa_unified": f"WITH {QA} SELECT id, md5(question) AS question_md5, answer, len(facts) AS n_facts, md5(array_to_string(list_transform(facts, lambda f: coalesce(f.t, '-') || '|' || coalesce(f.s, '-') || '|' || coalesce(f.p, '-')), ';')) AS facts_md5, dataset, split FROM unified",
    "split_counts": f"WITH {QA} SELECT dataset, split, count(*) AS n FROM unified GROUP BY ROLLUP (dataset, split)",
    "distinct_titles": f"WITH {QA} SELECT DISTINCT unnest(list_transform(facts, lambda f: f.t)) AS title FROM unified",
    "tsv_collection": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, md5(replace(replace(source || ' ' || text, chr(9), ' '), chr(10), ' ')) AS text_md5 FROM documents",
    "transcripts": f"WITH {TRAJ} SELECT id, question_id, dataset, md5(text) AS text_md5, num_search_steps, incomplete, answer FROM traj",
    "gen_summary": f"WITH {SUMMARY} SELECT * FROM summary",
    "gate": f"WITH {SUMMARY} SELECT sum(valid)::BIGINT AS total_valid, sum(valid) >= 500 AS gate_passed FROM summary",
    "retry_pick": """WITH a AS (SELECT conv_id AS question_id, turn AS attempt, CASE WHEN role = 'assistant' AND conv_id % 2 = 0 THEN 1 ELSE 0 END AS n FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, CASE WHEN n > 0 THEN attempt ELSE -attempt END) AS nth FROM a)
SELECT question_id, attempt, n::BIGINT AS num_search_steps, attempt AS retry_count, n = 0 AS no_search_after_retries FROM r WHERE nth = 1""",
    "fan_out": "SELECT item_id::VARCHAR AS id, i AS trajectory_idx, item_id || '_' || i AS question_id, item_id::VARCHAR AS gold_key FROM benchmark, range(3) r(i)",
    "assemble_steps": f"""WITH s AS (SELECT conv_id AS traj_id, turn, text, CASE WHEN (conv_id + turn) % 4 <> 3 THEN {strip('text')} ELSE '' END AS query,
  CASE WHEN (conv_id + turn) % 5 = 4 THEN 'max_tokens' WHEN (conv_id + turn) % 7 = 6 THEN 'eos' ELSE 'search' END AS stop FROM conversations),
n AS (SELECT *, stop = 'search' AND query <> '' AS hit, row_number() OVER (PARTITION BY traj_id ORDER BY turn) AS nth, coalesce(sum((NOT (stop = 'search' AND query <> ''))::INT) OVER (PARTITION BY traj_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM s)
SELECT traj_id, md5(string_agg(text || CASE WHEN hit THEN '<search>' || query || '</search>' ELSE '' END, '' ORDER BY turn)) AS text_md5, count(*) FILTER (WHERE hit) AS num_search_steps, bool_or(stop = 'max_tokens') AS incomplete FROM n WHERE ended = 0 AND nth <= 4 GROUP BY traj_id""",
    "inject_results": f"""WITH {TRAJ}, bodies AS (SELECT id, regexp_replace(text, '(?s)
<results>.*?</results>', '', 'g') AS text FROM traj),
asked AS (SELECT id, unnest(range(0, len(q))) AS i, unnest(q) AS query FROM (SELECT id, list_transform(regexp_extract_all(text, '(?s)<search>(.*?)</search>', 1), lambda x: {strip('x')}) AS q FROM bodies)),
hits AS (SELECT a.id, a.i, d.doc_id, d.source, d.text, row_number() OVER (PARTITION BY a.id, a.i ORDER BY d.doc_id) AS rank FROM asked a JOIN documents d ON string_split(d.text, ' ')[1] = string_split(a.query, ' ')[1]),
blocks AS (SELECT a.id, a.i, '<search>' || any_value(a.query) || '</search>
<results>
' || coalesce(string_agg('[' || h.rank || '] [' || h.source || '] ' || substring(h.text, 1, 500), '
' ORDER BY h.rank), '') || '
</results>' AS block, coalesce(list(h.doc_id::VARCHAR ORDER BY h.rank) FILTER (WHERE h.doc_id IS NOT NULL), []) AS docs FROM asked a LEFT JOIN hits h ON h.id = a.id AND h.i = a.i AND h.rank <= 3 GROUP BY a.id, a.i),
done AS (SELECT id, list(block ORDER BY i) AS blocks, array_to_string(flatten(list(docs ORDER BY i)), ',') AS docs FROM blocks GROUP BY id),
parts AS (SELECT b.id, regexp_split_to_array(b.text, '(?s)<search>.*?</search>') AS p, coalesce(d.blocks, []) AS blocks, coalesce(d.docs, '') AS docs FROM bodies b LEFT JOIN done d ON d.id = b.id)
SELECT id, md5(array_to_string(list_transform(range(1, len(p) + 1), lambda k: p[k] || coalesce(blocks[k], '')), '')) AS text_md5, len(blocks) AS n_records, md5(docs) AS docs_md5 FROM parts""",
    "search_prompt": f"SELECT item_id, 6::BIGINT AS n_messages, '{PREFIX}' || text AS last FROM benchmark",
    "sft_format": f"WITH {TRAJ} SELECT id, md5('<|im_start|>user\n{PREFIX}' || question_id || '<|im_end|>\n<|im_start|>assistant\n' || text || '<|im_end|>\n') AS text_md5 FROM traj",
    "grid": "SELECT * FROM (SELECT DISTINCT source AS condition FROM documents), (SELECT DISTINCT lang AS student FROM documents), (SELECT DISTINCT label::BIGINT AS seed FROM embeddings)",
    "spearman": f"""WITH {SCORES}, f AS (SELECT student, round(rsr_full, 6) AS x, num_tokens AS y FROM scores WHERE NOT isinf(rsr_full)),
r AS (SELECT student, rank() OVER (PARTITION BY student ORDER BY x) + (count(*) OVER (PARTITION BY student, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY student ORDER BY y) + (count(*) OVER (PARTITION BY student, y) - 1) / 2.0::DOUBLE AS ry FROM f),
c AS (SELECT student, count(*) AS n, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN round(covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)), 6) END AS rho FROM r GROUP BY student)
SELECT student, n, rho, coalesce(rho >= 0.8, false) AS holds FROM c""",
    "seed_mean_std": f"WITH {EVALUATED} SELECT dataset, round(avg(f1), 6) AS mean, round(stddev_samp(f1), 6) AS std, count(*) AS n FROM evaluated GROUP BY dataset",
    "student_divergence": f"WITH {SWEEP}, s AS (SELECT traj_id, student, rnk FROM sweep WHERE alpha = 0.4) SELECT a.traj_id, a.rnk AS rank_a, b.rnk AS rank_b, abs(a.rnk - b.rnk) AS shift FROM s a JOIN s b USING (traj_id) WHERE a.student = 'even' AND b.student = 'odd'",
    "best_alpha": f"WITH {SWEEP}, m AS (SELECT student, alpha, round(avg(score), 6) AS metric FROM sweep WHERE NOT isinf(score) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY student ORDER BY metric DESC, alpha) AS nth FROM m) SELECT student, alpha, metric FROM r WHERE nth = 1",
    "k_subsets": f"WITH {TRAJ} SELECT id, ('0x' || substring(md5('42:' || id), 1, 7))::BIGINT % 5 AS subset FROM traj",
    "boundary_shift": f"""WITH {TOKENS}, inside AS (SELECT p.id, p.s, p.e, min(k.pos) AS lo, max(k.pos) AS hi FROM spans p JOIN tokens k ON k.traj_id = p.id AND k."start" < p.e AND k."end" > p.s GROUP BY ALL),
most AS (SELECT traj_id, max(pos) AS most FROM tokens GROUP BY traj_id)
SELECT i.id AS traj_id, a."start"::BIGINT AS s, b."end"::BIGINT AS e FROM inside i JOIN most m ON m.traj_id = i.id JOIN tokens a ON a.traj_id = i.id AND a.pos = greatest(i.lo - 5, 0) JOIN tokens b ON b.traj_id = i.id AND b.pos = least(i.hi + 5, m.most)""",
    "boundary_rescore": f"""WITH {SCORES}, {MOVED}, typed2 AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM moved p WHERE p.id = k.traj_id AND k."start" >= p.s AND k."end" <= p.e) THEN 'search_decision' ELSE 'reasoning' END AS type FROM tokens k),
scored2 AS (SELECT s.traj_id, s.student, s.rank, s.surprisal, t.type FROM scored s JOIN typed2 t USING (traj_id, pos)),
scores2 AS (SELECT traj_id, student, {_ratio("type = 'reasoning'")} AS rsr_reasoning, {_ratio("type = 'search_decision'")} AS rsr_search_decision FROM scored2 GROUP BY traj_id, student),
b AS (SELECT traj_id, student, round({composite('0.5::DOUBLE')}, 6) AS x FROM scores), a AS (SELECT traj_id, student, round({composite('0.5::DOUBLE')}, 6) AS y FROM scores2),
f AS (SELECT student, x, y FROM b JOIN a USING (traj_id, student) WHERE NOT isinf(x) AND NOT isinf(y)), {SPEARMAN}""",
    "subset_correlation": f"""WITH {SCORES}, {EVALUATED[len(TRAJ) + 2:]}, f AS (SELECT s.student, round(avg(s.rsr_full), 6) AS x, round(avg(e.f1), 6) AS y FROM scores s JOIN evaluated e ON e.id = s.traj_id WHERE NOT isinf(s.rsr_full)
GROUP BY s.student, ('0x' || substring(md5('42:' || s.traj_id), 1, 7))::BIGINT % 5), {SPEARMAN}""",
    "jsonl_questions": "SELECT row_number() OVER (ORDER BY item_id) - 1 AS pos, item_id::VARCHAR AS id, md5(text) AS question_md5, CASE WHEN item_id % 2 = 0 THEN 'yes' ELSE '' END AS answer FROM benchmark",
    "jsonl_limit": "SELECT row_number() OVER (ORDER BY item_id) - 1 AS pos, item_id::VARCHAR AS id FROM benchmark ORDER BY item_id LIMIT 25",
    "jsonl_best_effort": "SELECT item_id::VARCHAR AS id FROM benchmark",
    "jsonl_partitioned": f"WITH {TRAJ} SELECT id, dataset, md5(text) AS text_md5, len(queries) AS n_queries FROM traj",
    "bm25_loaded": f"WITH {BM25} SELECT qid, rank, pos::VARCHAR AS doc_id, score FROM hits WHERE rank <= 5",
    "dense_loaded": """WITH pairs AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[]))), 5) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM pairs) SELECT r.qid, r.rank, r.doc_id, coalesce(d.source, '') AS title, md5(coalesce(d.text, '')) AS text_md5, r.score FROM ranked r LEFT JOIN documents d ON d.doc_id = r.doc_id WHERE rank <= 5""",
    "jsonl_quarantine": """SELECT row_number() OVER (ORDER BY item_id) - 1 AS pos, CASE WHEN item_id % 7 <> 3 THEN item_id::VARCHAR END AS id, md5(CASE WHEN item_id % 7 = 3 THEN '{"id": "' || item_id || '", "question' ELSE text END) AS text_md5, item_id % 7 = 3 AS damaged FROM benchmark""",
    "jsonl_glob": "SELECT lang || '_train' AS file, count(*) AS n, sum(doc_id)::BIGINT AS ids, sum(length(text))::BIGINT AS chars, count(*) AS places FROM documents WHERE lang IN ('en', 'de') GROUP BY lang",
    "qa_partitioned": f"WITH {QA} SELECT id, CASE WHEN dataset = 'musique' AND split = 'validation' THEN 'again: ' || coalesce(answer, '') ELSE answer END AS answer, len(facts) AS n_facts, dataset, split FROM unified",
    "write_counters": f"WITH {SUMMARY} SELECT sum(total)::BIGINT AS total, sum(valid)::BIGINT AS valid, sum(has_answer)::BIGINT AS has_answer, sum(incomplete)::BIGINT AS incomplete FROM summary",
    "stream_transcripts": f"""WITH {SPANS}, n AS (SELECT id, sum(e - s) AS n FROM spans GROUP BY id)
SELECT t.id, {extract('text')} AS answer, NOT incomplete AND num_search_steps > 0 AS valid, round(coalesce(n, 0)::DOUBLE / length(text), 6) AS span_share FROM traj t LEFT JOIN n ON n.id = t.id""",
    "stream_summary": f"WITH {SUMMARY} SELECT * FROM summary",
    "context_corpus": """WITH d AS (SELECT doc_id, source, lang, string_split(text, chr(10)) AS l FROM documents),
p AS (SELECT source AS title, array_to_string(l, ' ') AS text, (0, doc_id, 0) AS pos FROM d UNION ALL SELECT lang, array_to_string(l[1:2], ' '), (0, doc_id, 1) FROM d UNION ALL SELECT role, text, (1, conv_id * 1000 + turn, 0) FROM conversations),
firsts AS (SELECT title, text, min(pos) AS pos FROM p WHERE text <> '' GROUP BY title, text)
SELECT title || '_' || (row_number() OVER (PARTITION BY title ORDER BY pos) - 1) AS id, title, md5(text) AS text_md5 FROM firsts""",
    "custom_spans": f"""WITH {TRAJ}, blocks AS {spans_of('(?s)<results>.*?</results>', 'traj')}, marks AS {spans_of('Answer:', 'traj')}
SELECT id AS traj_id, s::BIGINT AS s, e::BIGINT AS e FROM blocks UNION ALL SELECT id, s::BIGINT, e::BIGINT FROM marks k WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.id = k.id AND b.s <= k.s AND k.e <= b.e)""",
    "eval_missing": f"""WITH {TRAJ}, pairs AS (SELECT *, pos % 3 = 1 AS missing, CASE WHEN pos % 3 = 1 THEN '' ELSE {extract('text')} END AS prediction FROM traj),
normed AS (SELECT *, {normal('prediction')} AS np, {normal('answer')} AS ng FROM pairs), lists AS (SELECT *, {words('np')} AS p, {words('ng')} AS g FROM normed)
SELECT dataset, round(avg(CASE WHEN np = ng THEN 1.0 ELSE 0.0 END), 6) AS em, round(avg(({f1('p', 'g')})::DOUBLE), 6) AS f1, count(*) AS n, count(*) FILTER (WHERE missing) AS missing FROM lists GROUP BY dataset""",
    "gen_counters": """WITH a AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' AND conv_id % 2 = 0 THEN 1 ELSE 0 END AS n FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, CASE WHEN n > 0 THEN turn ELSE -turn END) AS nth FROM a)
SELECT 'ds' || (conv_id % 3) AS dataset, sum(turn)::BIGINT AS total_retries, count(*) FILTER (WHERE n = 0) AS no_search_after_retries FROM r WHERE nth = 1 GROUP BY conv_id % 3""",
    "gen_report": f"""WITH {SUMMARY} SELECT e.dataset, CASE WHEN e.dataset = 'ds9' THEN 'skipped' ELSE 'done' END AS status, CASE WHEN e.dataset = 'ds9' THEN 'file not found' END AS reason,
CASE WHEN e.dataset <> 'ds9' THEN coalesce(total, 0) END AS total, CASE WHEN e.dataset <> 'ds9' THEN coalesce(valid, 0) END AS valid, CASE WHEN e.dataset <> 'ds9' THEN coalesce(has_answer, 0) END AS has_answer, CASE WHEN e.dataset <> 'ds9' THEN coalesce(incomplete, 0) END AS incomplete,
CASE e.dataset WHEN 'ds0' THEN 0.0 WHEN 'ds1' THEN 1.5 WHEN 'ds2' THEN 3.0 END::DOUBLE AS elapsed_s, CASE WHEN e.dataset <> 'ds9' THEN e.dataset || '_trajectories.jsonl' END AS output
FROM (SELECT unnest(['ds0', 'ds1', 'ds2', 'ds9']) AS dataset) e LEFT JOIN summary s ON s.dataset = e.dataset""",
    "logit_students": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x, (embedding::DOUBLE[])[(vec_id % len(embedding)) + 1] AS t FROM embeddings WHERE embedding IS NOT NULL)
SELECT vec_id, len(list_filter(x, lambda v: v > t)) AS rank, round(ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) + list_max(x) - t, 6) AS surprisal FROM e""",
    "token_cut": f"""WITH t AS (SELECT doc_id AS id, text FROM documents), runs AS {spans_of(WS.replace('[', '[^', 1) + '+', 't')}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s) AS pos FROM runs)
SELECT id AS traj_id, count(*) AS n, max(e)::BIGINT AS last_end FROM n WHERE pos <= 4096 GROUP BY id""",
    "all_texts": """SELECT doc_id::VARCHAR AS id, md5(text) AS text_md5, 'documents' AS "table" FROM documents UNION ALL SELECT item_id::VARCHAR, md5(text), 'benchmark' FROM benchmark UNION ALL SELECT conv_id::VARCHAR, md5(text), 'conversations' FROM conversations""",
    "inject_bm25": f"""WITH {TRAJ}, bodies AS (SELECT id, regexp_replace(text, '(?s)
<results>.*?</results>', '', 'g') AS text FROM traj),
wants AS (SELECT id, unnest(range(0, len(q))) AS i, unnest(q) AS query FROM (SELECT id, list_transform(regexp_extract_all(text, '(?s)<search>(.*?)</search>', 1), lambda x: {strip('x')}) AS q FROM bodies)),
{BM25.replace("SELECT item_id AS qid, unnest(" + tok('text') + ") AS term FROM benchmark", "SELECT id || '#' || i AS qid, unnest(" + tok('query') + ") AS term FROM wants").split("hits AS (")[0]}
zero AS (SELECT w.id || '#' || w.i AS qid, p.pos, 0.0::DOUBLE AS score FROM wants w, (SELECT pos FROM passages ORDER BY pos LIMIT 5000) p WHERE NOT EXISTS (SELECT 1 FROM summed s WHERE s.qid = w.id || '#' || w.i AND s.pos = p.pos)),
near AS (SELECT qid, pos, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS rank FROM (SELECT * FROM summed UNION ALL SELECT * FROM zero)),
docs AS (SELECT w.id, w.i, coalesce(list(n.pos::VARCHAR ORDER BY n.rank) FILTER (WHERE n.pos IS NOT NULL), []) AS d FROM wants w LEFT JOIN near n ON n.qid = w.id || '#' || w.i AND n.rank <= 5 GROUP BY w.id, w.i),
done AS (SELECT id, count(*) AS n, array_to_string(flatten(list(d ORDER BY i)), ',') AS docs FROM docs GROUP BY id)
SELECT t.id, coalesce(d.n, 0) AS n_records, md5(coalesce(d.docs, '')) AS docs_md5 FROM traj t LEFT JOIN done d ON d.id = t.id""",
}
