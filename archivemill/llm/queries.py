"""The registered queries of this package, each over the whole of its tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivemill.llm.op1_sharding import default_tree, place
from archivemill.llm.op10_licenses import Matcher, document_frequencies, licenses
from archivemill.llm.op11_hard_negatives import hard_negatives
from archivemill.llm.op12_language import languages, train as train_language
from archivemill.llm.op13_collocations import collocations
from archivemill.llm.op2_quality_rules import log_ratios, quality_rules, trusted_texts
from archivemill.llm.op3_wrappers import main_text
from archivemill.llm.op4_chosen_path import similar
from archivemill.llm.op5_ngram_trie import build, held_out, scores
from archivemill.llm.op6_token_counts import token_counts
from archivemill.llm.op7_decontamination import contamination
from archivemill.llm.op8_line_crf import quality_scores, train
from archivemill.llm.op9_packing import pack
from archivemill.llm.shared import prepared, word_count
from archivemill.plans.staging import staging_root

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

#: DuckDB SQL by query.
CHECKS: dict[str, str] = {
    "op7_fm_index_decontamination": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS doc, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), items AS (
            SELECT CAST(item_id AS VARCHAR) AS item,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ), windows AS (
            SELECT DISTINCT item, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase
            FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i
                  FROM (SELECT *, least(10, len(w)) AS size FROM items WHERE len(w) > 0))
        ), places AS (
            SELECT doc, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase
            FROM (SELECT doc, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM windows))
        ), hits AS (
            SELECT doc, item, i, size FROM places JOIN windows USING (size, phrase)
        ), words AS (
            SELECT doc, count(DISTINCT spot) AS n_hit
            FROM (SELECT doc, unnest(range(i, i + size)) AS spot FROM (SELECT DISTINCT doc, i, size FROM hits)) GROUP BY doc
        ), found AS (
            SELECT doc, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS names FROM hits GROUP BY doc
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN words USING (doc) LEFT JOIN found USING (doc)
    """,
    "op11_strassen_hard_negatives": """
        WITH usable AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
                   CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
            FROM usable a JOIN usable c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
        ), positives AS (
            SELECT * FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        )
        SELECT p.anchor_id, p.other_id AS positive_id,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
               n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
             AND 80 * p.score <= 100 * n.score AND n.score <= p.score
        QUALIFY rank <= 5
    """,
    "op13_prefix_free_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), words AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
        ), runs AS (
            SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest(range(1, 6)) AS k)
        ), f AS (
            SELECT lang, k, list_slice(w, i, i + k - 1) AS words, count(*) AS f FROM runs GROUP BY ALL
        ), totals AS (
            SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
        ), candidates AS (
            SELECT lang, k, words, f AS a FROM f WHERE k > 1 AND f >= 100
        ), inside AS (
            SELECT lang, list_slice(words, i, i + j - 1) AS words, max(a) AS longest
            FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM candidates))
            GROUP BY ALL
        ), kept AS (
            SELECT c.* FROM candidates c LEFT JOIN inside USING (lang, words) WHERE longest IS NULL OR 100 * longest < 100 * a
        ), cuts AS (
            SELECT c.lang, c.words, c.a, c.cut, x.f AS l, y.f AS r, n,
                   CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
            FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept) c
            JOIN f x ON x.lang = c.lang AND x.words = list_slice(c.words, 1, c.cut)
            JOIN f y ON y.lang = c.lang AND y.words = list_slice(c.words, c.cut + 1, c.k)
            JOIN totals t ON t.lang = c.lang
        ), lowest AS (
            SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, n, score FROM cuts
            QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM lowest QUALIFY rank <= 2000
    """,
}


def query(build: Query) -> Query:
    """Register a query under its function's name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(prepared(spark), sf_dir)

    _QUERIES[build.__name__] = run
    return build


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query
def op1_hash_tree_sharding(spark, sf_dir):
    return place(read(spark, sf_dir, "documents"), default_tree(8))


@query
def op2_ngram_ratio_rules(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = trusted_texts(docs, read(spark, sf_dir, "labels"))
    return quality_rules(docs, log_ratios(docs, trusted))


@query
def op3_wrapper_extraction(spark, sf_dir):
    return main_text(read(spark, sf_dir, "pages"))


@query
def op4_chosen_path_join(spark, sf_dir):
    return similar(read(spark, sf_dir, "documents"))


@query
def op5_trie_scores(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scores(docs, build(docs.where(~held_out(docs["doc_id"]))))


@query
def op6_digest_cache_counts(spark, sf_dir):
    """Starts from an empty cache of its own, so that every distinct text is encoded."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    cache = f"{staging_root(spark)}/token-cache-{uuid.uuid4().hex}"
    counts = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), cache)
    return counts.withColumn("over_limit", counts["n_tokens"] > 512)


@query
def op7_fm_index_decontamination(spark, sf_dir):
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")


@query
def op8_line_crf_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, read(spark, sf_dir, "labels")))


@query
def op9_length_bucket_packing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return pack(docs, word_count(docs["text"]))


@query
def op10_license_scan(spark, sf_dir):
    """A document lies in the directory of its language in that of its source."""
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", docs["source"], docs["lang"], docs["doc_id"].cast("string"))
    return licenses(docs, path, Matcher(*document_frequencies(docs)))


@query
def op11_strassen_hard_negatives(spark, sf_dir):
    """Every hundredth row is an anchor; every seventh has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


@query
def op12_byte_gru_language(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return languages(docs, train_language(docs))


@query
def op13_prefix_free_collocations(spark, sf_dir):
    return collocations(read(spark, sf_dir, "documents"))
