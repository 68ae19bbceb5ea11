"""DuckDB SQL for the operators whose next step depends on the last one's outcome: recursive queries that go on by one row of every group at a time."""

from __future__ import annotations

from ..sources import adapters as src

RECURSIVE = src.SQL.replace("WITH", "WITH RECURSIVE", 1)
WORDS = RECURSIVE + """, w AS MATERIALIZED (SELECT * FROM words)"""
SERIES = RECURSIVE + """, s AS MATERIALIZED (SELECT * FROM series)"""

SENTENCES = WORDS + """,
f AS (
  SELECT plan_id, word_i, text, start, "end", 0::BIGINT AS sentence, start AS since FROM w WHERE word_i = 0
  UNION ALL
  SELECT w.plan_id, w.word_i, w.text, w.start, w."end", f.sentence + CASE WHEN f.text LIKE '%purchase' OR f."end" - f.since >= 12000 THEN 1 ELSE 0 END,
         CASE WHEN f.text LIKE '%purchase' OR f."end" - f.since >= 12000 THEN w.start ELSE f.since END
  FROM f JOIN w ON w.plan_id = f.plan_id AND w.word_i = f.word_i + 1)
SELECT plan_id, word_i, text, start, "end", sentence FROM f"""

ATTACK_RELEASE = SERIES + """,
f AS (
  SELECT plan_id, idx, start, value, value AS y FROM s WHERE idx = 0
  UNION ALL
  SELECT s.plan_id, s.idx, s.start, s.value, f.y + CASE WHEN s.value > f.y THEN 0.6::DOUBLE ELSE 0.1::DOUBLE END * (s.value - f.y) FROM f JOIN s ON s.plan_id = f.plan_id AND s.idx = f.idx + 1)
SELECT plan_id, idx, start, value, round(y, 6) AS level FROM f"""

FOLLOWED = SERIES + """,
f AS (
  SELECT plan_id, idx, start, value, value AS x, 0.0::DOUBLE AS v, value AS target FROM s WHERE idx = 0
  UNION ALL
  SELECT plan_id, idx, start, value, t + (x - t + v + 0.5::DOUBLE * (x - t)) * exp(-0.5::DOUBLE), (v - 0.5::DOUBLE * (v + 0.5::DOUBLE * (x - t))) * exp(-0.5::DOUBLE), t
  FROM (SELECT s.plan_id, s.idx, s.start, s.value, f.x, f.v, CASE WHEN abs(s.value - f.target) > 20 THEN s.value ELSE f.target END AS t FROM f JOIN s ON s.plan_id = f.plan_id AND s.idx = f.idx + 1))
SELECT plan_id, idx, start, value, round(x, 6) AS followed FROM f"""

SECTIONS = SERIES + """,
b AS (SELECT plan_id, quantile_cont(value, 0.1) AS low, quantile_cont(value, 0.9) AS high FROM s GROUP BY 1),
q AS MATERIALIZED (
  SELECT plan_id, idx, start, value, greatest(0, least(2, trunc((value - low) / greatest(high - low, 1e-9) * 3)))::INT AS q,
         lead(greatest(0, least(2, trunc((value - low) / greatest(high - low, 1e-9) * 3)))::INT) OVER (PARTITION BY plan_id ORDER BY idx) AS following FROM s JOIN b USING (plan_id)),
f AS (
  SELECT *, q AS level FROM q WHERE idx = 0
  UNION ALL
  SELECT q.*, CASE WHEN q.following IS NOT NULL AND q.q <> f.level AND q.q <> q.following THEN f.level ELSE q.q END FROM f JOIN q ON q.plan_id = f.plan_id AND q.idx = f.idx + 1),
e AS (SELECT *, coalesce((level <> lag(level) OVER (PARTITION BY plan_id ORDER BY idx))::INT, 0) AS edge FROM f),
r AS (SELECT *, sum(edge) OVER (PARTITION BY plan_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM e),
g AS (SELECT plan_id, run, any_value(level) AS level FROM r GROUP BY 1, 2),
n AS (SELECT *, lead(level) OVER (PARTITION BY plan_id ORDER BY run) AS after, max(run) OVER (PARTITION BY plan_id) AS last FROM g)
SELECT r.plan_id, r.idx, r.start, r.value, CASE WHEN n.run = 0 AND n.level < 2 THEN 'intro' WHEN n.run = n.last AND n.level < 2 THEN 'outro' WHEN n.level = 2 THEN 'drop' WHEN n.after = 2 THEN 'build'
       WHEN n.level > 0 THEN 'verse' ELSE 'break' END AS label
FROM r JOIN n USING (plan_id, run)"""

SPACED = SERIES + """,
o AS MATERIALIZED (SELECT plan_id, idx, row_number() OVER (PARTITION BY plan_id ORDER BY -value, idx) AS n FROM s),
f AS (
  SELECT plan_id, n, [idx] AS taken FROM o WHERE n = 1
  UNION ALL
  SELECT o.plan_id, o.n, CASE WHEN len(list_filter(f.taken, lambda t: abs(t - o.idx) < 5)) = 0 THEN list_append(f.taken, o.idx) ELSE f.taken END FROM f JOIN o ON o.plan_id = f.plan_id AND o.n = f.n + 1),
t AS (SELECT plan_id, unnest(arg_max(taken, n)) AS idx FROM f GROUP BY 1)
SELECT s.plan_id, s.idx, s.start, s.value, -s.value AS minus FROM s JOIN t USING (plan_id, idx)"""

SEGMENTED = WORDS + """,
x AS MATERIALIZED (
  SELECT plan_id, word_i, text, start, "end", count(*) OVER (PARTITION BY plan_id) AS n,
         CASE WHEN text = 'view' THEN 15.0::DOUBLE ELSE 0.0::DOUBLE END - 5.0::DOUBLE * least(coalesce(greatest(0.0::DOUBLE, lead(start) OVER v - "end"), 1.0::DOUBLE), 1.0::DOUBLE) AS tail,
         sum(length(text) + 1) OVER (PARTITION BY plan_id ORDER BY word_i ROWS UNBOUNDED PRECEDING) AS until
  FROM w WINDOW v AS (PARTITION BY plan_id ORDER BY word_i)),
f AS (
  SELECT plan_id, 0::BIGINT AS i, [0.0::DOUBLE] AS cost, [0::BIGINT] AS sizes, [0::BIGINT] AS back FROM x WHERE word_i = 0
  UNION ALL
  SELECT plan_id, i, list_append(cost, best.c), list_append(sizes, until), list_append(back, best.j) FROM (
    SELECT f.plan_id, f.i + 1 AS i, f.cost, f.sizes, f.back, x.until::BIGINT AS until, list_reduce(
      list_transform(range(f.i, greatest(-1, f.i - 6), -1), lambda j: {'c': f.cost[j + 1] + abs(x.until - f.sizes[j + 1] - 1 - 22) + 10.0::DOUBLE * greatest(0, x.until - f.sizes[j + 1] - 1 - 32) + x.tail, 'j': j}),
      lambda a, b: CASE WHEN b.c < a.c - 1e-12::DOUBLE THEN b ELSE a END) AS best
    FROM f JOIN x ON x.plan_id = f.plan_id AND x.word_i = f.i)),
done AS (SELECT f.plan_id, f.back, f.i FROM f JOIN (SELECT plan_id, max(i) AS i FROM f GROUP BY 1) m USING (plan_id, i)),
cuts_at AS (
  SELECT plan_id, back, i, back[i + 1] AS j FROM done
  UNION ALL
  SELECT plan_id, back, j, back[j + 1] FROM cuts_at WHERE j > 0),
numbered AS (SELECT plan_id, j, i, row_number() OVER (PARTITION BY plan_id ORDER BY j) - 1 AS segment FROM cuts_at)
SELECT w.plan_id, w.word_i, w.text, w.start, w."end", numbered.segment FROM w JOIN numbered ON w.plan_id = numbered.plan_id AND w.word_i >= numbered.j AND w.word_i < numbered.i"""

PACKED = RECURSIVE + """,
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY start, "end") AS n FROM cuts),
f AS (
  SELECT plan_id, n, ["end"] AS ends, 0::BIGINT AS place FROM o WHERE n = 1
  UNION ALL
  SELECT plan_id, n, CASE WHEN place = len(ends) THEN list_append(ends, until) ELSE list_concat(list_append(ends[1:place], until), ends[place + 2:]) END, place FROM (
    SELECT o.plan_id, o.n, o."end" AS until, f.ends, coalesce(nullif(list_position(list_transform(f.ends, lambda e: e <= o.start), true), 0) - 1, len(f.ends))::BIGINT AS place
    FROM f JOIN o ON o.plan_id = f.plan_id AND o.n = f.n + 1))
SELECT o.plan_id, o.id, o.start, o."end", o.enabled, f.place AS row FROM o JOIN f USING (plan_id, n)"""

GREEDY = RECURSIVE + """,
o AS MATERIALIZED (SELECT plan_id, id, start, "end", row_number() OVER (PARTITION BY plan_id ORDER BY start - "end", id) AS n FROM cuts),
f AS (
  SELECT plan_id, n, [{'id': id, 'start': start, 'end': "end"}] AS taken FROM o WHERE n = 1
  UNION ALL
  SELECT o.plan_id, o.n, CASE WHEN len(list_filter(f.taken, lambda t: o.start < t['end'] AND o."end" > t.start)) = 0 THEN list_append(f.taken, {'id': o.id, 'start': o.start, 'end': o."end"}) ELSE f.taken END
  FROM f JOIN o ON o.plan_id = f.plan_id AND o.n = f.n + 1),
t AS (SELECT plan_id, unnest(arg_max(taken, n)) AS x FROM f GROUP BY 1)
SELECT plan_id, x.id AS id, x.start AS start, x['end'] AS "end" FROM t"""

CROSSFADED = SERIES + """,
f AS (
  SELECT plan_id, idx, value / 100 AS until, 0.0::DOUBLE AS begins FROM s WHERE idx = 0
  UNION ALL
  SELECT plan_id, idx, until + duration - over_, until - over_ FROM (
    SELECT s.plan_id, s.idx, f.until, s.value / 100 AS duration, greatest(0.0::DOUBLE, least(0.5::DOUBLE, s.value / 100 - 0.05::DOUBLE, f.until - 0.05::DOUBLE)) AS over_
    FROM f JOIN s ON s.plan_id = f.plan_id AND s.idx = f.idx + 1))
SELECT plan_id, idx AS i, round(begins, 6) AS "at" FROM f"""

ALTERNATING = SERIES + """,
f AS (
  SELECT plan_id, idx, value > 60 AS taken FROM s WHERE idx = 0
  UNION ALL
  SELECT s.plan_id, s.idx, s.value > 60 AND NOT f.taken FROM f JOIN s ON s.plan_id = f.plan_id AND s.idx = f.idx + 1)
SELECT plan_id, idx FROM f WHERE taken"""

CLAIMS = RECURSIVE + """,
o AS MATERIALIZED (SELECT customer, id, id % 4 AS expected, row_number() OVER (PARTITION BY customer ORDER BY id) AS n FROM jobs),
f AS (
  SELECT customer, id, expected, n, expected = 0 AS accepted, (expected = 0)::BIGINT AS rev FROM o WHERE n = 1
  UNION ALL
  SELECT o.customer, o.id, o.expected, o.n, o.expected = f.rev, f.rev + (o.expected = f.rev)::BIGINT FROM f JOIN o ON o.customer = f.customer AND o.n = f.n + 1)
SELECT customer, id, expected, accepted, rev FROM f"""

STATES = """WITH RECURSIVE
m(now, event, after) AS (VALUES ('', 'create', 'queued'), ('queued', 'claim', 'running'), ('running', 'review', 'review'), ('running', 'finish', 'done'), ('review', 'requeue', 'queued'),
  ('queued', 'cancel', 'canceled'), ('running', 'cancel', 'canceled'), ('running', 'fail', 'error'), ('error', 'requeue', 'queued'), ('canceled', 'requeue', 'queued')),
o AS MATERIALIZED (
  SELECT user_id AS id, event_id AS seq, ['create', 'claim', 'finish', 'cancel', 'requeue'][event_id % 5 + 1] AS event, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (
  SELECT o.id, o.seq, o.event, o.n, coalesce(m.after, '') AS state, m.after IS NOT NULL AS accepted FROM o LEFT JOIN m ON m.now = '' AND m.event = o.event WHERE o.n = 1
  UNION ALL
  SELECT o.id, o.seq, o.event, o.n, coalesce(m.after, f.state), m.after IS NOT NULL FROM f JOIN o ON o.id = f.id AND o.n = f.n + 1 LEFT JOIN m ON m.now = f.state AND m.event = o.event)
SELECT id, seq, event, state, accepted FROM f"""

FRESH = """WITH u AS (SELECT user_id AS id, event_id AS seq, floor((event_id / 7) % 90)::BIGINT AS token, value FROM events),
n AS (SELECT *, coalesce(max(token) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS newest FROM u)
SELECT id, seq, token, value FROM n WHERE token >= newest"""

#: The title of a plan is what the next plan says.
MATCHED = WORDS + """,
t AS MATERIALIZED (SELECT plan_id - 1 AS plan_id, word_i, text FROM w WHERE plan_id - 1 IN (SELECT plan_id FROM w)),
h AS MATERIALIZED (SELECT plan_id, list(lower(text) ORDER BY word_i) AS heard, list(start ORDER BY word_i) AS times FROM w GROUP BY 1),
f AS (
  SELECT plan_id, -1::BIGINT AS word_i, 0::BIGINT AS place, NULL::BIGINT AS hit FROM h WHERE plan_id IN (SELECT plan_id FROM t)
  UNION ALL
  SELECT plan_id, word_i, coalesce(hit + 1, place), hit FROM (
    SELECT f.plan_id, t.word_i, f.place, list_filter(range(f.place, least(f.place + 6, len(h.heard))),
      lambda j: h.heard[j + 1] = lower(t.text) OR (length(t.text) >= 3 AND length(h.heard[j + 1]) >= 3 AND left(h.heard[j + 1], 3) = left(lower(t.text), 3)))[1] AS hit
    FROM f JOIN t ON t.plan_id = f.plan_id AND t.word_i = f.word_i + 1 JOIN h ON h.plan_id = f.plan_id)),
k AS (SELECT f.plan_id, f.word_i, h.times[f.hit + 1] AS time FROM f JOIN h USING (plan_id) WHERE f.word_i >= 0),
e AS (SELECT *, max(CASE WHEN time IS NOT NULL THEN word_i END) OVER (PARTITION BY plan_id ORDER BY word_i ROWS UNBOUNDED PRECEDING) AS i0,
             min(CASE WHEN time IS NOT NULL THEN word_i END) OVER (PARTITION BY plan_id ORDER BY word_i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1 FROM k),
i AS (SELECT e.plan_id, e.word_i, CASE WHEN e.i0 IS NULL THEN b.time WHEN e.i1 IS NULL OR e.i0 = e.i1 THEN a.time ELSE a.time + (b.time - a.time) * (e.word_i - e.i0) / (e.i1 - e.i0) END AS time
      FROM e LEFT JOIN k a ON a.plan_id = e.plan_id AND a.word_i = e.i0 LEFT JOIN k b ON b.plan_id = e.plan_id AND b.word_i = e.i1)
SELECT t.plan_id, t.word_i, t.text, round(max(i.time) OVER (PARTITION BY i.plan_id ORDER BY i.word_i ROWS UNBOUNDED PRECEDING), 3) AS start FROM i JOIN t USING (plan_id, word_i)"""
