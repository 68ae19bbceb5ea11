"""The queries of this subpackage, each an operator applied to its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .centroids import CENTROIDS, COMPONENTS, ROUNDS, SCALE, SEED, clusters
from .common import table
from .decontamination import leaks
from .exact_dedup import exact_dedup
from .host_rules import BASE, LEAST_BETWEEN, LIMIT, MOST_BETWEEN, RULES, quality
from .language_id import languages
from .packing import pack
from .periodic_runs import run_digests
from .secret_scan import secret_spans
from .simhash import near_duplicates
from .token_counts import token_counts
from .toxicity import toxicity
from .url_filter import judged
from .warc import archived

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_k1", "_k2")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH normal AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM normal WINDOW same AS (PARTITION BY text_sha256)
"""


def _centroids_sql() -> str:
    """All rounds spelled out, every vector against every centroid."""
    distance = f"list_sum(list_transform(range(1, {COMPONENTS + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    steps = [
        f"""vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS k, v AS c FROM vectors QUALIFY k < {CENTROIDS})""",
    ]
    near = lambda i: f"SELECT r, min_by(k, (d, k)) AS k, min(d) AS d FROM (SELECT r, k, {distance} AS d FROM vectors, c{i}) GROUP BY r"
    for i in range(ROUNDS):
        steps.append(f"""a{i} AS MATERIALIZED ({near(i)})""")
        steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT k, coalesce(n.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS c FROM (
      SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i} JOIN vectors USING (r)) GROUP BY k, i) GROUP BY k) n USING (k))""")
    return f"""
WITH {", ".join(steps)}, last AS ({near(ROUNDS)})
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM last JOIN vectors USING (r) JOIN c{ROUNDS} USING (k)
"""


OP11_SQL = _centroids_sql()

#: Each rule in SQL, over the measures of a document.
RULES_SQL = {
    "short": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words", "lines": "100 * n_dup_lines > 30 * n_lines", "symbols": "10 * n_symbols > n_words",
    "lengths": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}


def _host_rules_sql() -> str:
    each = lambda f: ", ".join(f(k) for k in RULES)
    fitted = lambda k: (
        f"m_{k} * (1 / least(greatest(CASE WHEN room_{k} > 0 THEN (q_{k} - docs * m_{k} * m_{k} - m_{k} * (1 - m_{k}) * (hosts - 1)) / room_{k} ELSE {LEAST_BETWEEN} END, "
        f"{LEAST_BETWEEN}), {MOST_BETWEEN}) - 1)"
    )
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
split AS MATERIALIZED (SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM texts),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM (
  SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM split))),
repeats AS (SELECT r, count(DISTINCT i + j) AS n FROM windows, (SELECT unnest([0, 1, 2]) AS j) WHERE windows.n > 1 GROUP BY r),
measures AS MATERIALIZED (
  SELECT doc_id, host, len(words) AS n_words, length(regexp_replace(text, '[ 	-
]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM split LEFT JOIN repeats USING (r)),
hosts AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, {each(lambda k: f"CAST(count(*) FILTER ({RULES_SQL[k]}) AS DOUBLE) AS f_{k}")} FROM measures WHERE host IS NOT NULL GROUP BY host),
sums AS (SELECT count(*) AS hosts, sum(n) AS docs, sum(n * n) AS docs2, {each(lambda k: f"sum(f_{k}) / sum(n) AS m_{k}, sum(f_{k} * f_{k} / n) AS q_{k}")} FROM hosts),
rooms AS (SELECT *, {each(lambda k: f"m_{k} * (1 - m_{k}) * (docs - docs2 / docs - hosts + 1) AS room_{k}")} FROM sums),
fitted AS (SELECT {each(lambda k: f"m_{k}, {fitted(k)} AS a_{k}, (1 - m_{k}) / nullif(m_{k}, 0) AS b_{k}")} FROM rooms),
verdicts AS (SELECT host, CAST(n AS BIGINT) AS host_docs, list_filter([{each(lambda k: f"CASE WHEN m_{k} > 0 AND (f_{k} + a_{k}) / (n + a_{k} + a_{k} * b_{k}) >= {LIMIT} THEN '{k}' END")}], lambda x: x IS NOT NULL) AS host_rejected
  FROM hosts, fitted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({") OR (".join(RULES_SQL[k] for k in BASE)}) AS base_failed,
       NOT (({") OR (".join(RULES_SQL[k] for k in BASE)})) AND coalesce(len(host_rejected), 0) = 0 AS kept, host, host_docs, host_rejected
FROM measures LEFT JOIN verdicts USING (host)
"""


OP12_SQL = _host_rules_sql()

#: Every pair of equal words, its distance a period, and islands of neighbouring pairs; crc32 bit by bit.
OP13_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sums AS (SELECT *, len(w) AS n, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))) AS h FROM texts),
planted AS (SELECT *, h % 10 = 0 AND n > 0 AS changed, (h // 10) % greatest(n, 1) AS a, 1 + (n - (h // 10) % greatest(n, 1)) // (3 + (h // 10) % 8) AS p FROM sums),
words AS MATERIALIZED (
  SELECT r, doc_id, n, i, CASE WHEN changed AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM planted)),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM pairs) GROUP BY r, q, g),
runs AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM islands WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
gone AS (SELECT DISTINCT r, i FROM (SELECT r, unnest(range(start + period, start + length)) AS i FROM runs)),
left_over AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY r),
told AS (SELECT r, count(*) AS n_runs, min_by({'start': start, 'length': length, 'period': period}, (-length, start, period)) AS best,
                string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
       sha256(coalesce(told.t, '')) AS runs_sha256, sha256(coalesce(left_over.t, '')) AS collapsed_sha256, n AS n_words
FROM planted LEFT JOIN told USING (r) LEFT JOIN left_over USING (r)
"""


def queries() -> dict[str, Query]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_language_id": op3_language_id,
        "op4_token_counts": op4_token_counts,
        "op5_decontamination": op5_decontamination,
        "op6_simhash": op6_simhash,
        "op7_url_filter": op7_url_filter,
        "op8_toxicity": op8_toxicity,
        "op9_warc": op9_warc,
        "op10_packing": op10_packing,
        "op11_centroids": op11_centroids,
        "op12_host_rules": op12_host_rules,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op11_centroids": OP11_SQL, "op12_host_rules": OP12_SQL, "op13_periodic_runs": OP13_SQL}
