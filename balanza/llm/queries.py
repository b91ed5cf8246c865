"""The registered query of each operator: the whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of 0.9 on distinct 3-word shingles, as components."""
    from balanza.llm.ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as token ids in rANS files, read back."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from balanza.llm.token_files import read_token_files, write_token_files

    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(files).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query
def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a 13-word window of a benchmark item."""
    from balanza.llm.winnowing import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, k=5, share=20)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE["op6_winnowing"] = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sizes AS (SELECT DISTINCT least(len(w), 13) AS m FROM iw WHERE len(w) > 0),
needle AS (
  SELECT item_id, least(len(w), 13) AS m, unnest([array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') FOR i IN range(1, len(w) - least(len(w), 13) + 2)]) AS g
  FROM iw WHERE len(w) > 0
), spot AS (
  SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, unnest([array_to_string(list_slice(w, i, i + m - 1), ' ') FOR i IN range(1, len(w) - m + 2)]) AS g
  FROM dw, sizes WHERE len(w) >= m
), hit AS (SELECT DISTINCT doc_id, item_id, i, s.m FROM spot s JOIN needle n ON s.m = n.m AND s.g = n.g),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(t, ',' ORDER BY t)) AS d FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(i.d, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN places p ON d.doc_id = p.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""


def held_out(id_col: str, parts: int, one: int):
    """Whether crc32 of the id as text leaves the remainder; a null id counts as the empty text."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == one


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose id's remainder by 4 is not 2."""
    from balanza.llm.language import detect_languages, fit_languages

    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 4, 2))
    model = fit_languages(docs.filter("not held_out"))
    return detect_languages(docs, model, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")


@query
def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a grey image, read back, decoded, resized to a tile and hashed."""
    from pyspark.sql import functions as F

    from balanza.llm.media import media_features, texts_to_media
    from balanza.session import cut

    media = cut(texts_to_media(table(spark, sf_dir, "documents")), compression="zstd")
    tiles = cut(media_features(media), compression="zstd")
    return tiles.select(
        F.col("id").alias("doc_id"), "n_bytes", F.col("pixel_bytes").alias("payload_bytes"), F.col("pixel_sha256").alias("payload_sha256"),
        "tail_crc32", "media_bytes", "media_sha256", F.concat_ws("-", "dhash", F.sha2("tile", 256)).alias("feature"),
    )


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document in a mix of weights 5, 2, 1, with at most three repeats."""
    from balanza.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, and what the archives hold of it."""
    from balanza.llm.warc import page_table, read_records, reassemble, write_archives

    archives = write_archives(table(spark, sf_dir, "pages"), least=100)
    found = page_table(reassemble(read_records(archives)))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op4_warc_segments"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
low AS (SELECT d, min(page_id) AS m FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN m IS NULL OR m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m <> page_id THEN m END AS refers_to
FROM p LEFT JOIN low ON p.d = low.d
"""


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from balanza.llm.html_text import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of those whose id's remainder by 3 is not 1."""
    from pyspark.sql import functions as F

    from balanza.llm.quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 3, 1))
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id", 3, 1))
    model = fit_quality(docs, labels)
    return score_quality(docs, model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation in windows of 1,024 tokens, and one that speaks in control strings; read back."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from balanza.llm.chat import conversation_digests, format_windows
    from balanza.session import cut

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text")
    )
    windows = cut(format_windows(turns.unionByName(own), public_tokenizers.path("byte_bpe_50k.json"), budget=1024, history=2))
    return conversation_digests(windows).withColumnRenamed("conv", "conv_id")


ORACLE["op3_ngram_jaccard_join"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(list_slice(w, i, i + 2), ' ') FOR i IN range(1, len(w) - 1)] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
edge AS (SELECT a AS s, b AS t FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM w UNION SELECT edge.t, reach.r FROM reach JOIN edge ON edge.s = reach.doc_id)
SELECT reach.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id
"""


@query
def op11_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each document among all, white space apart, and which row stays."""
    from balanza.llm.exact_copies import exact_copies

    return exact_copies(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLE["op11_exact_copies"] = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers aligned by their ends, with corpus-wide counts of linked ids."""
    import public_tokenizers

    from balanza.llm.token_alignment import align_tokenizers

    found = align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score between 30 and 90 % of an anchor's positives."""
    from pyspark.sql import functions as F

    from balanza.llm.hard_negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLE["op12_hard_negatives"] = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT pos.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s ON s.anchor_id = pos.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""
