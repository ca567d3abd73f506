"""The corpus operators as queries over whole tables: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared, licence_scan, quality_rules, source_mix


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary file `name` lies; /opt/tokenizers if its package is not importable."""
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return f"/opt/tokenizers/{name}"


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_planes import token_index

    docs = _shared.table(spark, sf_dir, "documents")
    return token_index(docs, tokenizer_path("word_bpe_49k.json"), end_id=1).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judged

    rows = judged(_shared.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .personal_data import digest, find_spans

    return digest(find_spans(_shared.table(spark, sf_dir, "documents")))


def op4_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .super_kmers import deduplicated

    return deduplicated(_shared.table(spark, sf_dir, "documents"), width=50)


def op5_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    from .piece_viterbi import encoded

    return encoded(_shared.table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), check=True)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_mix import OTHERS, WEIGHTS, mixed

    return mixed(_shared.table(spark, sf_dir, "documents"), WEIGHTS, others=OTHERS)


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licence_scan import scan
    from .licence_texts import common

    found = scan(_shared.table(spark, sf_dir, "documents"), common())
    return found.withColumn("notices", F.array_join("notices", ","))


def op8_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vantage_points import nearest

    vectors = _shared.table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op9_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_groups import jaccard_components

    return jaccard_components(_shared.table(spark, sf_dir, "documents"), words=5, percent=75)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_zst import archived

    pages = archived(_shared.table(spark, sf_dir, "pages"))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality_rules.oracle(),
        "op4_super_kmers": """
            WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
            g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM w, unnest(range(1, len(w) - 48)) u(i)),
            gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM g) WHERE least < doc_id),
            p AS (SELECT w.doc_id, j, w[j] AS word FROM w, unnest(range(1, len(w) + 1)) u(j)),
            r AS (SELECT DISTINCT doc_id, i + o AS j FROM gone, range(50) t(o)),
            k AS (SELECT p.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY p.j) AS t FROM p ANTI JOIN r ON r.doc_id = p.doc_id AND r.j = p.j GROUP BY p.doc_id)
            SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(kept, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
            FROM w LEFT JOIN k USING (doc_id)""",
        # n_links counts linked documents, equal sets among them
        "op9_token_groups": """
            WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
            s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) u(i)),
            n AS (SELECT doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
            p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
            l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
            r AS (SELECT doc_id AS a, doc_id AS c FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a)
            SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id, (SELECT count(*) FROM l WHERE l.a = n.doc_id) AS n_links
            FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n""",
        "op6_source_mix": source_mix.oracle(source_mix.WEIGHTS, columns="doc_id, text, lang, source, n_chars"),
        "op7_licence_scan": licence_scan.oracle(),
        # DuckDB has no base32: the digest's 160 bits are 32 letters of 5 bits
        "op10_warc": """
            WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
            b AS (SELECT h, n, max(page_id) AS best FROM p GROUP BY h, n),
            bits AS (SELECT h, string_agg(lpad(bin(('0x' || substr(h, 2 * i + 1, 2))::INT), 8, '0'), '' ORDER BY i) AS s
                     FROM b, range(20) t(i) GROUP BY h),
            d AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                     1 + list_sum(list_transform(range(0, 5), lambda k: (substr(s, 5 * j + k + 1, 1))::INT * (16 >> k)))::INT, 1), '' ORDER BY j) AS digest
                  FROM bits, range(32) t(j) GROUP BY h)
            SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
                   CASE WHEN page_id IS DISTINCT FROM best THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to
            FROM p JOIN b USING (h, n) JOIN d USING (h)""",
    }
