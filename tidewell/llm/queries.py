"""Registered queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode, encode
from .decontaminate import find_leaks
from .divergence import divergence
from .embeddings import embedding_groups
from .language import identify_languages
from .lines import dedup_lines
from .merkle import verified
from .mixing import mix
from .quality import resample
from .repeats import remove_repeats
from .shards import shard_documents
from .shared import read
from .simhash import simhash_groups
from .urls import judge_sql, judge_urls


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read(spark, sf_dir, "documents"))


def op2_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"))


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(read(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup by runs of three lines alone, without long lines that are repeated by themselves."""
    cleaned = dedup_lines(read(spark, sf_dir, "documents"), line_words=None)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(read(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(read(spark, sf_dir, "embeddings"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))


def op11_bpe_round_trip(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path(tokenizer), encoding="utf-8") as file:
        vocabulary = file.read()
    decoded = decode(encode(read(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"]), vocabulary)
    return decoded.select("row.doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_quality_resampling": op2_quality_resampling,
        "op3_simhash_groups": op3_simhash_groups,
        "op4_benchmark_leaks": op4_benchmark_leaks,
        "op5_line_dedup": op5_line_dedup,
        "line_runs": line_runs,
        "op6_repeated_passages": op6_repeated_passages,
        "op7_embedding_groups": op7_embedding_groups,
        "op8_source_mix": op8_source_mix,
        "op9_url_filter": op9_url_filter,
        "op10_sharding": op10_sharding,
        "op11_bpe_round_trip": op11_bpe_round_trip,
        "op12_source_divergence": op12_source_divergence,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


OP4_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark
), item_shingles AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM item_words
), sizes AS (
  SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id
), doc_words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
), doc_shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM doc_words
), shared AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM doc_shingles JOIN item_shingles USING (s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n_shingles, n_shared, CAST(n_shared AS DOUBLE) / n_shingles AS containment
FROM shared JOIN sizes USING (item_id) WHERE 5 * n_shared >= 4 * n_shingles
"""

LINE_RUNS_SQL = r"""
WITH lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
), windows AS (
  SELECT doc_id, l, unnest(range(0, len(l) - least(3, len(l)) + 1)) AS start, least(3, len(l)) AS n FROM lines
), keyed AS (
  SELECT doc_id, start, n, array_to_string(l[start + 1:start + n], chr(10)) AS k FROM windows
), ranked AS (
  SELECT doc_id, start, n, row_number() OVER (PARTITION BY k, n ORDER BY doc_id, start) AS place FROM keyed
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + n)) AS j FROM ranked WHERE place > 1
), flat AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS j FROM lines
), kept AS (
  SELECT f.doc_id, string_agg(f.line, chr(10) ORDER BY f.j) AS text
  FROM flat f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.j = g.j WHERE g.j IS NULL GROUP BY f.doc_id
), counts AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(counts.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN lines ON d.doc_id = lines.doc_id LEFT JOIN counts ON d.doc_id = counts.doc_id
LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
), windows AS (
  SELECT doc_id, l, unnest(range(0, len(l) - least(3, len(l)) + 1)) AS start, least(3, len(l)) AS n FROM lines
  UNION
  SELECT doc_id, l, j, 1 FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS j FROM lines)
  WHERE len(regexp_extract_all(l[j + 1], '[^\x20\x09-\x0D]+')) >= 5
), keyed AS (
  SELECT doc_id, start, n, array_to_string(l[start + 1:start + n], chr(10)) AS k FROM windows
), ranked AS (
  SELECT doc_id, start, n, row_number() OVER (PARTITION BY k, n ORDER BY doc_id, start) AS place FROM keyed
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + n)) AS j FROM ranked WHERE place > 1
), flat AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS j FROM lines
), kept AS (
  SELECT f.doc_id, string_agg(f.line, chr(10) ORDER BY f.j) AS text
  FROM flat f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.j = g.j WHERE g.j IS NULL GROUP BY f.doc_id
), counts AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(counts.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN lines ON d.doc_id = lines.doc_id LEFT JOIN counts ON d.doc_id = counts.doc_id
LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM words WHERE len(w) >= 13
), keyed AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM windows
), firsts AS (
  SELECT k, min(doc_id) AS first_id FROM keyed GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM keyed JOIN firsts USING (k) WHERE first_id < doc_id
), flat AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM words
), kept AS (
  SELECT f.doc_id, string_agg(f.word, ' ' ORDER BY f.j) AS text
  FROM flat f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.j = g.j WHERE g.j IS NULL GROUP BY f.doc_id
), counts AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(counts.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN counts ON words.doc_id = counts.doc_id LEFT JOIN kept ON words.doc_id = kept.doc_id
"""

OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), sized AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), occurs AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), totals AS (
  SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups LEFT JOIN occurs USING (lang, source) GROUP BY lang, source
), shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p
  FROM groups JOIN sized USING (lang) JOIN totals USING (lang, source) JOIN kept USING (lang) LEFT JOIN occurs USING (lang, source, term)
), wholes AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM occurs GROUP BY lang, term) JOIN sized USING (lang)
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares JOIN wholes USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

OP13_SQL = r"""
WITH RECURSIVE rows AS (
  SELECT *, n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS changed FROM (
    SELECT doc_id, lang, n_chars, source, text, list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc % 2 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END) AS crc FROM documents)
), hashed AS (
  SELECT doc_id, lang, a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || b AS whole, a || coalesce(strlen(changed::VARCHAR) || ':' || changed, '-') || b AS claim
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
               coalesce(strlen(text) || ':' || text, '-') AS b FROM rows)
), leaves AS (
  SELECT doc_id, lang, sha256(whole) AS leaf, sha256(claim) AS claim,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(whole)) - 1 AS idx FROM hashed
), levels AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY idx) AS h FROM leaves GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(1, len(h) + 1, 2), lambda i: sha256(h[i] || coalesce(h[i + 1], ''))) FROM levels WHERE len(h) > 1
), subroots AS (
  SELECT lang, level AS height, h[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM levels WHERE len(h) = 1
), tops AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS h FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(1, len(h) + 1, 2), lambda i: sha256(h[i] || coalesce(h[i + 1], ''))) FROM tops WHERE len(h) > 1
), root AS (
  SELECT level AS height, h[1] AS root FROM tops WHERE len(h) = 1
), nodes AS (
  SELECT lang, level, unnest(range(len(h))) AS idx, unnest(h) AS hash FROM levels
), top_nodes AS (
  SELECT level, unnest(range(len(h))) AS idx, unnest(h) AS hash FROM tops
), steps AS (
  SELECT l.lang, l.idx, s.level, (l.idx >> s.level) % 2 AS odd, n.hash
  FROM leaves l JOIN (SELECT DISTINCT lang, level, len(h) AS n FROM levels WHERE len(h) > 1) s ON l.lang IS NOT DISTINCT FROM s.lang
  LEFT JOIN nodes n ON n.lang IS NOT DISTINCT FROM l.lang AND n.level = s.level AND n.idx = xor(l.idx >> s.level, 1)
  UNION ALL
  SELECT l.lang, l.idx, 1000 + t.level, (r.place >> t.level) % 2, n.hash
  FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang JOIN (SELECT level FROM tops WHERE len(h) > 1) t ON true
  LEFT JOIN top_nodes n ON n.level = t.level AND n.idx = xor(r.place >> t.level, 1)
), listed AS (
  SELECT lang, idx, list({'odd': odd, 'hash': coalesce(hash, '')} ORDER BY level) AS s FROM steps GROUP BY lang, idx
), proved AS (
  SELECT l.doc_id, l.leaf, r.subroot, root.root, coalesce(p.s, []) AS s, l.claim
  FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang JOIN root ON true LEFT JOIN listed p ON p.lang IS NOT DISTINCT FROM l.lang AND p.idx = l.idx
), folded AS (
  SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(s, lambda x: x.hash), '')) AS proof_sha256,
         list_reduce(list_prepend({'odd': 0::BIGINT, 'hash': claim}, s),
                     lambda acc, x: {'odd': 0::BIGINT, 'hash': sha256(CASE WHEN x.odd = 1 THEN x.hash || acc.hash ELSE acc.hash || x.hash END)}).hash AS folded_root FROM proved
)
SELECT *, folded_root = root AS verified FROM folded
"""

OP7_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), degree AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links, least.component_id, e.vec_id = least.component_id AS kept
FROM embeddings e JOIN least ON e.vec_id = least.vec_id LEFT JOIN degree ON e.vec_id = degree.vec_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB; the other operators rest on seeded hashes or fitted models and are tested against slow versions."""
    return {
        "op4_benchmark_leaks": OP4_SQL,
        "op5_line_dedup": OP5_SQL,
        "line_runs": LINE_RUNS_SQL,
        "op6_repeated_passages": OP6_SQL,
        "op7_embedding_groups": OP7_SQL,
        "op9_url_filter": judge_sql(),
        "op12_source_divergence": OP12_SQL,
        "op13_merkle_manifest": OP13_SQL,
    }
