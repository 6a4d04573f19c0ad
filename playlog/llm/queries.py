"""The operators as queries over the given tables, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlog.llm import (
    bpe_codec,
    centroids,
    hamming,
    html_text,
    language_id,
    lm_scoring,
    mixing,
    near_dedup,
    nearest,
    quality,
    secret_spans,
    spellings,
    token_counts,
)
from playlog.llm.tables import EMBEDDINGS, LABELS, PAGES, documents, read

TOKEN_LIMIT = 512
TOP = 10


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every whole text, and whether they exceed the limit."""
    counted = token_counts.prefix_token_counts(documents(spark, sf_dir))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log10 probability of every whole text, by word counts and by the language model."""
    docs = documents(spark, sf_dir)
    held_out = lm_scoring.held_out(F.col("doc_id"))
    scored = lm_scoring.score_texts(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), *scored.columns[1:])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the documents that are not held out."""
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    predicted = language_id.predict(docs, model)
    return predicted.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text, learned from the labelled documents that are not held out."""
    docs = documents(spark, sf_dir)
    model = quality.fit(quality.learning_rows(docs, read(spark, sf_dir, "labels", LABELS)))
    return quality.score(docs, model).select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract_text(read(spark, sf_dir, "pages", PAGES))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth one."""
    vectors = read(spark, sf_dir, "embeddings", EMBEDDINGS)
    return nearest.nearest_vectors(vectors, vectors.where(F.col("vec_id") % 100 == 0), TOP)


def op7_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows, by the signs of their components, of every hundredth row."""
    codes = hamming.sign_codes(read(spark, sf_dir, "embeddings", EMBEDDINGS))
    return hamming.nearest_codes(codes, codes.where(F.col("vec_id") % 100 == 0), TOP)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of documents that share most of their shingles of three words."""
    return near_dedup.near_duplicates(documents(spark, sf_dir), size=3, percent=85)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text and of the text they decode to."""
    return bpe_codec.digests(bpe_codec.encode(documents(spark, sf_dir)))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the words that a mix of their sources takes of each."""
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components with the nearest of 40 centroids after 5 rounds."""
    return centroids.cluster_vectors(read(spark, sf_dir, "embeddings", EMBEDDINGS)).drop("centroid")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every whole text, by patterns and by character models that learn from what these find."""
    docs = documents(spark, sf_dir)
    model = secret_spans.fit(secret_spans.labelled_samples(docs))
    return secret_spans.find_secrets(docs, model).drop("found")


def op13_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all texts, each with the far more frequent word one edit away that it may stand for."""
    return spellings.spelling_variants(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query for query in (
        op1_token_counts,
        op2_lm_scoring,
        op3_language_id,
        op4_quality,
        op5_html_text,
        op6_nearest,
        op7_hamming_top_k,
        op8_near_dedup,
        op9_bpe_codec,
        op10_mixing,
        op11_centroids,
        op12_secrets,
        op13_spellings,
    )
}

_CLUSTER_START = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY first, x) - 1 AS INTEGER) AS cluster, x AS c
  FROM (SELECT sha256('2:' || vec_id) AS first, x FROM kept ORDER BY first, x LIMIT 40) firsts)"""


def _cluster_round(k: int) -> str:
    """The vectors assigned to the centroids of round ``k``, and the centroids after it."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT row, min(struct_pack(d, cluster)) AS best
  FROM (SELECT row, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
        FROM kept, c{k}) distances
  GROUP BY row),
s{k} AS (
  SELECT best.cluster AS cluster, place, CAST(sum(x[place]) AS BIGINT) AS total, count(*) AS n
  FROM kept JOIN a{k} USING (row), range(1, 65) places(place) GROUP BY ALL),
m{k} AS (
  SELECT cluster, list((total - ((total % n) + n) % n) // n ORDER BY place) AS c FROM s{k} GROUP BY cluster),
c{k + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (cluster))"""


_CLUSTERS = (
    ",".join([_CLUSTER_START, *(_cluster_round(k) for k in range(centroids.ROUNDS + 1))])
    + f""",
assigned AS (
  SELECT vec_id, best.cluster AS cluster, CAST(best.d AS BIGINT) AS distance
  FROM kept JOIN a{centroids.ROUNDS} USING (row))
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM assigned JOIN c{centroids.ROUNDS} USING (cluster)"""
)

_SPELLINGS = """
WITH RECURSIVE steps AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)
              ORDER BY i) AS t FROM range(256) bytes(i)),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
long AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h
         FROM runs WHERE length(run) >= 7 GROUP BY ALL),
summed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS crc
  FROM long, steps),
counted AS (
  SELECT CASE WHEN crc % 31 <> 0 THEN run
              ELSE substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) END AS word, n
  FROM summed),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM counted WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS MATERIALIZED (
  SELECT word, n, place, substr(word, 1, place - 1) || substr(word, place + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM words) places),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
  UNION SELECT w.word, w.n, c.word, c.n FROM words w JOIN cut c ON w.word = c.rest
  UNION SELECT c.word, c.n, w.word, w.n FROM words w JOIN cut c ON w.word = c.rest),
best AS (
  SELECT word, n, count(*) AS n_near, min(struct_pack(k := -near_n, near)) AS best FROM near GROUP BY word, n),
forms AS MATERIALIZED (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.k >= 10 * words.n THEN best.near END AS form,
         CASE WHEN -best.k >= 10 * words.n THEN -best.k END AS form_n
  FROM words LEFT JOIN best ON words.word = best.word),
ways AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT ways.word, forms.word, forms.form FROM ways JOIN forms ON ways.next = forms.word)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN ways ON forms.word = ways.word AND ways.next IS NULL"""

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLE: dict[str, str] = {
    "op11_centroids": _CLUSTERS,
    "op13_spellings": _SPELLINGS,
    "op7_hamming_top_k": """
WITH codes AS (
  SELECT vec_id, CAST(list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '')
                      AS BIT) AS code
  FROM embeddings WHERE len(embedding) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(bit_count(xor(q.code, c.code)) AS INTEGER) AS distance
  FROM codes q JOIN codes c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10""",
    "op8_near_dedup": """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i+2], ' ')) END) AS shingle
  FROM worded WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes sa ON a = sa.doc_id JOIN sizes sb ON b = sb.doc_id
  WHERE 100 * common.n >= 85 * (sa.n + sb.n - common.n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reached.doc_id, ways.b FROM reached JOIN ways ON reached.other = ways.a)
SELECT doc_id, coalesce(max(sizes.n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id""",
    "op10_mixing": f"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS name, CAST({_WORDS} AS BIGINT) AS size FROM documents),
sums AS (SELECT no_source, name, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY ALL),
weighed AS (
  SELECT *, source_size * 3 AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY no_source, name) - 1) % 3 + 1)::INT] AS weight FROM sums),
levels AS (
  SELECT *, cap / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (
       ORDER BY cap / weight, no_source, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, no_source, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT no_source, name, source_size,
    CASE WHEN ratio <= level THEN CAST(cap AS DOUBLE)
         ELSE weight * max(CASE WHEN ratio > level THEN level END) OVER () END AS target,
    CAST('0x' || substr(md5('1:' || no_source || ':' || name), 1, 4) AS INTEGER) / 65536 AS start
  FROM levels),
steps AS (
  SELECT doc_id, size, source_size, target, start,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS share,
    row_number() OVER (PARTITION BY no_source, name ORDER BY size, doc_id) AS place
  FROM sized JOIN targets USING (no_source, name))
SELECT doc_id, size, source_size, target,
       size * CAST(floor(start + place * share) - floor(start + (place - 1) * share) AS BIGINT) AS taken
FROM steps""",
}
