"""The registered queries of the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.llm import decontamination, fill_middle, filter_audit, html_text, language, license_scan, line_dedup, ngram_join, packing, quality_rules, sharding, site_quality, suffix_dedup

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_rules")
def op1(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_license_scan")
def op2(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op3_sharding")
def op3(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


@query("op4_site_quality")
def op4(spark, sf_dir):
    return site_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


LINE_DEDUP_SQL = """
WITH docs AS (SELECT doc_id, text, coalesce(source, '') AS host FROM documents),
totals AS (SELECT host, count(*) AS pages FROM docs GROUP BY host),
lines AS (SELECT doc_id, host, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM docs),
boilerplate AS (
  SELECT l.host, l.line FROM lines l JOIN totals USING (host) WHERE trim(l.line) <> ''
  GROUP BY l.host, l.line HAVING count(*) >= 3 AND count(*) > 0.1 * any_value(pages)
),
found AS (SELECT host, list(line) AS dropped FROM boilerplate GROUP BY host),
kept AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines,
    list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(dropped, []), x)) AS rest
  FROM docs LEFT JOIN found USING (host)
)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(rest, chr(10)) END AS text,
  coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(rest), 0) AS n_dropped
FROM kept
"""


@query("op5_line_dedup", LINE_DEDUP_SQL)
def op5(spark, sf_dir):
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers as vocabularies

    return packing.pack(
        docs, vocabularies.path("byte_bpe_50k.json"), vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN
    )


@query("op6_packing")
def op6(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


@query("op7_benchmark_decontamination")
def op7(spark, sf_dir):
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_html_extraction")
def op8(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


@query("op9_language_id")
def op9(spark, sf_dir):
    found = language.identify(table(spark, sf_dir, "documents"), ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op10_ngram_join")
def op10(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"))


SUFFIX_DEDUP_SQL = """
WITH docs AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM docs WHERE n >= 100)),
firsts AS (SELECT w, min({'d': doc_id, 'p': p}) AS f FROM windows GROUP BY w HAVING count(*) > 1),
later AS (SELECT doc_id, p FROM windows JOIN firsts USING (w) WHERE {'d': doc_id, 'p': p} <> f),
steps AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS opens FROM later),
numbered AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM steps),
runs AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) = 1 AS last
  FROM runs
),
rests AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN last THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS rest
  FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM docs LEFT JOIN rests USING (doc_id)
"""


@query("op11_suffix_dedup", SUFFIX_DEDUP_SQL)
def op11(spark, sf_dir):
    rest = suffix_dedup.drop_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rest.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


FILL_MIDDLE_SQL = r"""
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
tokens AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS t,
    list_transform([1, 9, 17, 25], lambda x: ('0x' || substr(h, x, 8))::BIGINT) AS h
  FROM drawn
),
cuts AS (SELECT doc_id, text, t, h, least(h[1] % (len(t) + 1), h[2] % (len(t) + 1)) AS a, greatest(h[1] % (len(t) + 1), h[2] % (len(t) + 1)) AS b FROM tokens),
parts AS (
  SELECT doc_id, text, len(t) AS n, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle, array_to_string(t[b + 1:], '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM cuts
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


@query("op12_fill_middle", FILL_MIDDLE_SQL)
def op12(spark, sf_dir):
    made = fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


FILTER_AUDIT_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
    len(words) < 100,
    100 * len(list_distinct(words)) < 80 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)
  ] AS fails
  FROM docs LEFT JOIN marks USING (doc_id)
),
sets AS (SELECT part, fails, count(*) AS n, sum(good::INT) AS good, sum(toxic::INT) AS toxic FROM failed GROUP BY ALL),
digits AS (SELECT unnest(range(1, 6)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM digits a, digits b, digits c, digits d, digits e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
),
steps AS (SELECT o, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, i AS step, o[i] AS own FROM orders, digits),
hits AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails,
    coalesce(list_bool_or(list_transform(o[1:step - 1], lambda x: fails[x])), false) AS earlier, fails[own] AS mine,
    len(list_filter(fails, lambda x: x)) AS n_fails
  FROM sets, steps
),
found AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT earlier AND NOT mine THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mine AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mine AND earlier THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mine AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mine AND NOT earlier THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mine AND NOT earlier THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM hits GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM found
"""


@query("op13_filter_audit", FILTER_AUDIT_SQL)
def op13(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
