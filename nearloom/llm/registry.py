"""The ``opN_<name>`` queries of this folder and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearloom.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearloom.llm.linededup import line_dedup

    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearloom.llm.urlfilter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearloom.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return done.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearloom.llm.media import texts_as_gif

    return texts_as_gif(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearloom.llm.template import extract

    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearloom.llm import secretscan

    done = secretscan.scan(table(spark, sf_dir, "documents"), secretscan.fit(spark))
    spots = F.transform("findings", lambda f: F.concat_ws(":", f["start"].cast("string"), f["length"].cast("string")))
    best = F.coalesce(F.array_max(F.transform("findings", lambda f: f["score"])), F.lit(0.0))
    return done.select("doc_id", "n_candidates", "n_findings", F.array_join(spots, ",").alias("findings"), best.alias("best_score"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearloom.llm.decontaminate import contamination

    done = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearloom.llm.suffixes import remove_repeats

    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.b - s.a)
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_passages")


def op10_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearloom.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_url_filter, op3_toxicity, op4_gif_media, op5_packing, op6_html_extraction, op7_secret_scan, op8_decontamination, op9_suffix_dedup, op10_setsketch)}


def _lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


OP1_SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         {_lower(r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')")} AS k
  FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT d.doc_id, d.pos, d.line, f.k IS NOT NULL AND d.doc_id <> f.keeper AS gone
  FROM keyed d LEFT JOIN frequent f ON d.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce({_WORDS.format(_lower("text"))}, []) AS w FROM documents
), b AS (
  SELECT item_id, {_WORDS.format(_lower("text"))} AS w FROM benchmark
), win AS (
  SELECT item_id, list_slice(w, p, p + least(10, len(w)) - 1) AS words, least(10, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d
), hit AS (
  SELECT s.doc_id, s.p, v.n, v.item_id
  FROM starts s JOIN win v ON s.w[s.p] = v.words[1] AND list_slice(s.w, s.p, s.p + v.n - 1) = v.words
), covered AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id
), held AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(h.n_items, 0) AS n_items,
       sha256(coalesce(h.items, '')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN held h USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op8_decontamination": OP8_SQL}
