"""The corpus queries of ``__spark_entry__`` and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, media, mixing, packing, quality, secrets, simhash, token_counts, toxicity, urlfilter
from tidemark.llm.common import table

QUERIES = {}
SQL = {}


def query(name: str):
    def put(function):
        QUERIES[name] = function
        return function

    return put


@query("op3_mixing")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rated = mixing.rated(docs)
    return rated.select(
        "doc_id", "size", "source", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


SQL["op3_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS most FROM per_source
), ratios AS (
  SELECT *, most / weight AS ratio, sum(source_size) OVER ()::BIGINT AS all_size, sum(weight) OVER () AS all_weight FROM weighted
), levels AS (
  SELECT ratio, (1.5::DOUBLE * all_size - coalesce(sum(most) OVER before, 0)) / (all_weight - coalesce(sum(weight) OVER before, 0)) AS level
  FROM ratios WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), final AS (
  SELECT arg_min(level, ratio) AS level FROM levels WHERE ratio >= level
), targets AS (
  SELECT source, source_size, coalesce(least(most, (SELECT level FROM final) * weight), most) AS target FROM ratios
), rates AS (
  SELECT s.doc_id, s.size, s.source, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix-1|' || coalesce(s.doc_id::VARCHAR, '') || '|' || coalesce(s.source, '') || '|' || s.size::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source, source_size, target, rate, (floor(rate) + (u < rate - floor(rate))::INT)::BIGINT AS copies,
       (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken
FROM rates
"""


@query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.apply_policy(quality.ledger(docs), version=2)
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        quality.failed(quality.policy_mask(quality.BASE)).alias("base_failed"),
        "kept",
        "failures",
    )


SQL["op7_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
  FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)
), g AS (
  SELECT r, i, word AS a, lead(word, 1) OVER p AS b, lead(word, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY r ORDER BY i)
), hit AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM hit, (VALUES (0), (1), (2)) AS v(k) GROUP BY r
), l AS (
  SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), m AS (
  SELECT d.doc_id, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclaims,
         length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals,
         length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS n_letters,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*([-*]|\x{2022})')))::BIGINT AS n_bullet_lines,
         coalesce(rep.n, 0) AS n_repeat_words
  FROM d JOIN l USING (r) LEFT JOIN rep USING (r)
), f AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
         + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (10 * n_exclaims > 3 * n_words)::BIGINT + 32 * (2 * n_capitals > n_letters)::BIGINT
         + 64 * (word_chars < 2 * n_words)::BIGINT + 128 * (word_chars > 15 * n_words)::BIGINT + 256 * (n_words > 1000000)::BIGINT
         + 512 * (10 * n_bullet_lines > 9 * n_lines)::BIGINT AS failures FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures::BIGINT AS failures
FROM f
"""


@query("op9_secret_scans")
def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scanned(docs)
    return found.select(
        "doc_id",
        *[secrets.counted(F.col("base_found"), kind).alias(f"n_{kind}") for kind, _ in secrets.BASE_KINDS],
        F.sha2(secrets.listed(F.col("base_found")), 256).alias("base_sha256"),
        secrets.listed(F.col("secret_spans")).alias("spans"),
    )


def _spans_sql(kind: str, pattern: str, order: int, where: str, texts: str = "d") -> str:
    """Spans of one kind: the k-th match starts after k pieces and the k - 1 matches before it."""
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT r, t, start, {order} AS k, start + n AS stop, '{kind}' AS kind FROM (
    SELECT r, t, m[i] AS m, v[i] AS v, length(m[i])::BIGINT AS n,
           (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
    FROM (SELECT r, t, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT r, t, regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {2 if kind == "assign" else 0}) AS v,
             string_split_regex(t, '{quoted}') AS g FROM {texts}) WHERE len(m) > 0)
  ) WHERE {where}"""


def _entropy_sql() -> str:
    table_ = ", ".join(str(secrets.weighted(n)) for n in range(1, secrets.WINDOW + 1))
    chars = f"list_transform(range({secrets.WINDOW}), lambda j: m[s + j])"
    least = f"""list_min(list_transform(range(1, length(m) - {secrets.WINDOW} + 2), lambda s: list_sum(
      list_transform(map_values(list_histogram_of({chars})), lambda n: [{table_}][n::BIGINT]))))"""
    least = least.replace(f"map_values(list_histogram_of({chars}))", f"map_values(list_aggregate({chars}, 'histogram'))")
    tests = " AND ".join(f"NOT regexp_matches(m, '{p}')" for p in secrets.ALLOWED)
    limits = " ".join(f"WHEN regexp_matches(m, '{p}') THEN {secrets.most_weight(bits)}" for _, p, bits in secrets.CLASSES)
    return f"{tests} AND {least} <= CASE {limits} END"


SQL["op9_secret_scans"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), base AS (
{_spans_sql("assign", secrets.ASSIGN, 0, f"length(v) >= {secrets.ASSIGN_VALUE}")}
  UNION ALL {_spans_sql("access", secrets.ACCESS, 1, "true")}
  UNION ALL {_spans_sql("hex", secrets.HEX, 2, "true")}
), reached AS (
  SELECT *, coalesce(max(stop) OVER (PARTITION BY r ORDER BY start, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM base
), blanked AS (
  SELECT r, string_agg(substr(t, reach + 1, greatest(start - reach, 0)) || repeat(' ', greatest(stop, reach) - greatest(start, reach)), '' ORDER BY start, k)
            || substr(any_value(t), max(stop) + 1) AS t
  FROM reached GROUP BY r
), rest AS (
  SELECT d.r, coalesce(blanked.t, d.t) AS t FROM d LEFT JOIN blanked USING (r)
), run AS (
{_spans_sql("entropy", secrets.CANDIDATE, 3, _entropy_sql(), "rest")}
), found AS (
  SELECT r, start, k, stop, kind FROM base UNION ALL SELECT r, start, k, stop, kind FROM run
), joined AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < 3), '') AS b,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS s
  FROM found GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans
FROM d LEFT JOIN joined USING (r)
"""


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.suffix_sums(token_counts.histogram(token_counts.encoded_lengths(docs)))


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_media")
def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.stored(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return media.media_index(stored).select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        "feature",
        "codec",
        "duration",
        F.size("key_offsets").cast("long").alias("n_keys"),
    )


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.clusters(docs).select("doc_id", "fingerprint", "component_id")


#: The rules of the contract and the listed names of this corpus.
URL_RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_DOMAINS = tuple(f"{name}.example.{top}" for name in LISTED_NAMES for top in ("com", "net", "org"))


@query("op2_url_filter")
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = spark.createDataFrame([(x,) for x in LISTED_DOMAINS], "key string")
    return urlfilter.judged(pages, listed, list(URL_RULES)).select("page_id", "host", "path", "rule", "listed", "verdict")


def _rules_sql() -> str:
    rows = ", ".join(f"('{r.text}', '{r.host}', '{r.path}', '{r.verdict}')" for r in map(urlfilter.parse_rule, URL_RULES))
    return f"(VALUES {rows}) AS rules(text, host, path, verdict)"


SQL["op2_url_filter"] = f"""
WITH u AS (
  SELECT row_number() OVER () AS r, page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), fit AS (
  SELECT u.r, arg_max(rules.text, length(rules.text)) AS rule, arg_max(rules.verdict, length(rules.text)) AS verdict
  FROM u, {_rules_sql()}
  WHERE (u.host = rules.host OR ends_with(u.host, '.' || rules.host)) AND starts_with(u.path, rules.path) GROUP BY u.r
), hit AS (
  SELECT DISTINCT u.r FROM u, (VALUES {", ".join(f"('{x}')" for x in LISTED_DOMAINS)}) AS listed(d)
  WHERE u.host = listed.d OR ends_with(u.host, '.' || listed.d)
)
SELECT page_id, host, path, rule, hit.r IS NOT NULL AS listed, coalesce(verdict, CASE WHEN hit.r IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fit USING (r) LEFT JOIN hit USING (r)
"""


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predicted(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits", "rejected")


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.judged(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
