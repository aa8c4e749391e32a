"""The operators' registered queries over the given tables, with production parameters, and their SQL.

Three can be stated in DuckDB SQL; the others rest on tokenizers, hashes, trained models, code point offsets of
patterns with a rule for overlaps, or iterations. Tests compare all with brute-force versions on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.session import scratch_path

from . import bit_planes
from .conversation_repair import damage, repair_conversations
from .decontaminate import contaminated
from .kd_shards import kd_shards
from .language_id import identify_languages
from .license_scan import scan_licenses
from .occurrence_join import jaccard_groups
from .phrase_mining import collocations
from .prefix_counts import longest_prefix, prefix_counts
from .secret_scan import scan_secrets
from .segment_search import build_index, top_k
from .soft_mixing import mix
from .vector_packing import place_pieces, token_pieces

TOKEN_LIMIT = 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_bit_planes(spark: SparkSession, folder: str) -> DataFrame:
    """Where each document's ids lie in the written stream, and their checksum, as read back."""
    path = scratch_path(spark, "tokens")
    bit_planes.write_tokens(table(spark, folder, "documents"), path)
    return bit_planes.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_occurrence_join(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents linked by 85 % Jaccard similarity of four-word shingles."""
    return jaccard_groups(table(spark, folder, "documents"), width=4, percent=85)


def op3_soft_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Rates and copies of documents that bring expected tokens by domain to the targets, at 0.85 of the corpus."""
    return mix(table(spark, folder, "documents"), table(spark, folder, "labels"), scale=0.85)


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document."""
    return identify_languages(table(spark, folder, "documents"))


def op5_prefix_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, whether they pass the limit, and where a cut at the limit would be."""
    counts = prefix_counts(table(spark, folder, "documents"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
                         longest_prefix("prefix_counts", TOKEN_LIMIT).alias("chars_within_limit"))


def op6_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    """16 shards of nearly equal bytes."""
    return kd_shards(table(spark, folder, "documents"), shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that repeat a benchmark item, with the best window."""
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The licence of every document. The table has no paths: a document lies in its source's folder of its language."""
    return scan_licenses(table(spark, folder, "documents"), path="concat_ws('/', source, lang, doc_id)")


def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document."""
    return scan_secrets(table(spark, folder, "documents")).drop("found")


def op10_segment_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best partners of every hundredth vector among all."""
    vectors = table(spark, folder, "embeddings")
    return top_k(build_index(vectors), vectors.filter("vec_id % 100 = 0"), 10)


def op11_vector_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece's sequence of 1,024 tokens and its place there, with the checksum of its ids as read back."""
    pieces = token_pieces(table(spark, folder, "documents"), scratch_path(spark, "pieces"))
    return place_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repairs of all conversations after the stated damage."""
    conversations = table(spark, folder, "conversations")
    return repair_conversations(conversations, damage(conversations))


def op13_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    """The 2,000 strongest phrases of each language."""
    return collocations(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_bit_planes, op2_occurrence_join, op3_soft_mixing, op4_language_id, op5_prefix_counts, op6_kd_shards,
    op7_decontaminate, op8_license_scan, op9_secret_scan, op10_segment_search, op11_vector_packing,
    op12_conversation_repair, op13_phrase_mining)}

#: Groups by brute force: all pairs that share a shingle, and the transitive closure of their links.
JACCARD_SQL = r"""WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingles FROM words),
  listed AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
  links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM listed a JOIN listed b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
  reached AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
  least AS (SELECT x, min(y) AS y FROM reached GROUP BY x)
  SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id
  FROM sets LEFT JOIN least ON doc_id = x"""

#: Every query against every other vector.
TOP_K_SQL = """WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
  SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10"""

#: Every phrase of every piece, counted by brute force.
PHRASES_SQL = r"""WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
  totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
  sized AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS k FROM worded),
  placed AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM sized),
  counted AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM placed
    GROUP BY ALL HAVING count(*) >= 30),
  candidates AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1),
  cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM candidates),
  scored AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, cut,
      CAST((CAST(2000000 AS HUGEINT) * c.a) // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score FROM cuts c
    JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ')
    JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
  best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
  sizes AS (SELECT *, unnest(range(2, k)) AS size FROM candidates),
  inner_places AS (SELECT *, unnest(range(1, k - size + 2)) AS i FROM sizes),
  covering AS (SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS most FROM inner_places GROUP BY ALL),
  kept AS (SELECT b.* FROM best b LEFT JOIN covering c ON b.lang = c.lang AND b.phrase = c.phrase
    WHERE most IS NULL OR CAST(100 AS HUGEINT) * most < CAST(80 AS HUGEINT) * a),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
  SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

ORACLE_SQL = {"op13_phrase_mining": PHRASES_SQL, "op2_occurrence_join": JACCARD_SQL, "op10_segment_search": TOP_K_SQL}
