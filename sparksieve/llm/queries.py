"""The numbered queries of the corpus operators and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversations import repair_report
from .decontam import with_hits
from .durable import remove, scratch_path
from .jaccard import jaccard_components
from .licenses import license_scan
from .linededup import line_dedup
from .lm import lm_scores
from .quality import quality_rules
from .quality_model import quality_scores
from .segment import sample_segmentations
from .tokens import with_token_counts
from .toxicity import toxicity
from .warc import captures, deduplicate_archive, write_archive
from .whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary file is; the executors have it at the same place."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", F.length("text").cast("long").alias("n_chars_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "n_removed_lines")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, a row each, with the items found and the best similarity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = with_hits(docs, table(spark, sf_dir, "benchmark")).where(F.size("hits") > 0)
    return hits.select("doc_id", F.lit(True).alias("contaminated"), F.array_sort(F.array_distinct("hits.item_id")).alias("item_ids"), F.array_max("hits.similarity").alias("similarity"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, clean = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc")
    write_archive(captures(table(spark, sf_dir, "pages")), raw)
    headers = deduplicate_archive(spark, raw, clean)
    remove(spark, raw)
    return headers.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri")


#: Samples of each text in op4 and the pipeline.
SAMPLES = 2


def segmented(docs: DataFrame) -> DataFrame:
    """Digest of SAMPLES sampled segmentations of each whole text, decoded again and compared."""
    drawn = sample_segmentations(docs.select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"), k=SAMPLES, check=True, keep=["doc_id"])
    return drawn.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "key", "log_inclusion", "round_trip")


def op4_segmentation_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmented(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_token_counts(docs, tokenizer_path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: eight a directory, the first of which is its licence file."""
    n = F.coalesce("doc_id", F.lit(0))
    name = F.when(F.pmod(n, F.lit(8)) == 0, F.lit("LICENSE")).otherwise(F.concat(n.cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(n / 64).cast("string"), F.floor(n / 8).cast("string"), name)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path"))
    return license_scan(docs).select("doc_id", "path", "license", "license_score", "license_from")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels")).drop("text")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules(docs, host="source").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whiten(vectors).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations (nulls: one space), some of them, by a hash of id and turn, dropped, emptied, stripped of stops, repeated or made the user's."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text = F.when(k == 1, F.lit("")).when(k == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    role = F.when(k == 4, F.lit("user")).otherwise(filled("role"))
    times = F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(k != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_report(damaged(rows), of=rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_segmentation_samples": op4_segmentation_samples,
    "op5_token_counts": op5_token_counts,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_license_scan": op7_license_scan,
    "op8_toxicity": op8_toxicity,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_quality_rules": op10_quality_rules,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_conversation_repair": op13_conversation_repair,
}

_LINES = r"""
lines AS (
  SELECT doc_id, text, i, line,
         CASE WHEN regexp_matches(line, '[^\x20\x09-\x0D]') THEN 1 ELSE 0 END AS is_line
  FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
)"""

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": rf"""
WITH {_LINES},
numbered AS (SELECT *, sum(is_line) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM lines),
full_lines AS (SELECT doc_id, pos, line FROM numbered WHERE is_line = 1),
wins AS (
  SELECT doc_id, pos, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c
  FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS rn
    FROM wins WHERE c IS NOT NULL) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (VALUES (0), (1), (2)) t(k)),
kept AS (
  SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.i) FILTER (WHERE g.pos IS NULL) AS body,
         count(g.pos) AS n_removed_lines
  FROM numbered n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.pos = n.pos AND n.is_line = 1
  GROUP BY n.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE length(coalesce(k.body, '')) END AS n_chars_left,
       CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(k.body, '')) END AS text_md5,
       coalesce(k.n_removed_lines, 0) AS n_removed_lines
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
""",
    "op3_warc_revisits": r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex,
         regexp_replace(coalesce(url, 'urn:page:' || coalesce(page_id::VARCHAR, '')), '[\x00-\x20\x7f]', '%20', 'g') AS uri
  FROM pages),
d AS (
  SELECT page_id, uri, strlen(body) AS payload_bytes,
         array_to_string(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest
  FROM p),
o AS (SELECT payload_digest, min(page_id) AS first_page FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest, uri,
       CASE WHEN first_page IS NULL OR page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_page IS NULL OR page_id = first_page THEN NULL ELSE first_page END AS refers_to
FROM d JOIN o ON o.payload_digest = d.payload_digest
""",
    "op6_jaccard_join": r"""
WITH RECURSIVE ws AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM ws),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id
""",
    "op10_quality_rules": rf"""
WITH {_LINES},
dup AS (
  SELECT doc_id, count(*) AS n_dup_lines FROM (
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS rn FROM lines WHERE is_line = 1)
  WHERE rn > 1 GROUP BY doc_id),
ws AS (SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
toks AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS p FROM ws),
wins AS (
  SELECT doc_id, p, w AS a, lead(w, 1) OVER x AS b, lead(w, 2) OVER x AS c
  FROM toks WINDOW x AS (PARTITION BY doc_id ORDER BY p)),
often AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM wins WHERE c IS NOT NULL) WHERE n > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words
  FROM often, (VALUES (0), (1), (2)) t(k) GROUP BY doc_id),
base AS (
  SELECT ws.doc_id, ws.source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM ws LEFT JOIN dup ON dup.doc_id = ws.doc_id LEFT JOIN rep ON rep.doc_id = ws.doc_id),
flagged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM flagged GROUP BY source),
prior AS (SELECT avg(f / n) AS m, coalesce(var_pop(f / n), 0) AS v FROM hosts),
verdict AS (
  SELECT source, (f + s * m) / (n + s) > 0.5 AS rejected FROM (
    SELECT *, CASE WHEN v <= m * (1 - m) / 1e6 THEN 1e6
                   ELSE greatest(1.0, least(1e6, m * (1 - m) / v - 1)) END AS s FROM hosts, prior))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM flagged LEFT JOIN verdict ON verdict.source IS NOT DISTINCT FROM flagged.source
""",
}
