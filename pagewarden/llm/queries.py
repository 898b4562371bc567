"""The thin queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm import bpe_tree, debruijn, divergence, exact_dedup, language, licence, lsh_forest, order_minhash, packing, prefix_trie, style_tree, token_count, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def held_out() -> Column:
    """Documents that the language model never learns from."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


@_query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language.fit(docs.filter(~held_out()))
    found = language.predict(docs, model, with_spans=False)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@_query
def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_likeness(_documents(spark, sf_dir))


@_query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence.scan_licences(_documents(spark, sf_dir)).drop("spans")


@_query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


ORACLES["op6_exact_dedup"] = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\v\f\r]+', ' ', 'g') AS norm FROM documents)
WINDOW same AS (PARTITION BY norm)
"""


@_query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLES["op7_warc"] = """
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest,
             max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
      FROM pages)
"""


@_query
def op8_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@_query
def op9_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode_decode(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@_query
def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(_documents(spark, sf_dir))


#: Joins of shingles and a transitive closure: for small tables.
ORACLES["op10_lsh_forest"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[k:k + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS k FROM split WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
roots AS (SELECT a AS doc_id, least(a, min(b)) AS root FROM reach GROUP BY a)
SELECT s.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, s.doc_id) AS component_id, s.doc_id = coalesce(root, s.doc_id) AS kept
FROM split s LEFT JOIN sizes z ON z.doc_id = s.doc_id LEFT JOIN roots r ON r.doc_id = s.doc_id
"""


@_query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie.trie(*prefix_trie.forked(turns))


#: The CRC-32 is worked out bit by bit; nodes are lists of turns, subtrees go over the members' paths.
ORACLES["op11_prefix_trie"] = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
         coalesce(role, '') AS role, coalesce(text, '') AS body
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, n,
         xor(list_reduce([4294967295::UBIGINT] || list_transform(range(strlen(x)), lambda i: ord(x[i + 1])::UBIGINT),
             lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
                                      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)),
             4294967295::UBIGINT)::BIGINT % 9 AS h
  FROM (SELECT conv_id, conv_id::VARCHAR AS x, count(*) AS n FROM turns GROUP BY conv_id)),
forks AS (SELECT s.*, least(s.h, coalesce(b.n, 0)) AS has FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.base),
rebuilt AS (
  SELECT f.conv_id, t.place, t.role, t.body FROM forks f JOIN turns t ON t.conv_id = f.base AND t.place <= f.h
  UNION ALL
  SELECT f.conv_id, t.place - f.h + f.has, t.role, t.body FROM forks f JOIN turns t ON t.conv_id = f.conv_id AND t.place > f.h),
paths AS (
  SELECT conv_id, place AS depth, list({'r': role, 'b': body}) OVER (PARTITION BY conv_id ORDER BY place) AS prefix, strlen(body) AS bytes FROM rebuilt
  UNION ALL SELECT conv_id, 0, [], 0 FROM sizes),
nodes AS (SELECT depth, prefix, min(conv_id) AS node, count(*) AS n_convs, min(bytes) AS bytes FROM paths GROUP BY ALL),
member AS (SELECT p.conv_id, depth, n.node FROM paths p JOIN nodes n USING (depth, prefix)),
linked AS (SELECT n.depth, n.node, n.n_convs, n.bytes, m.node AS parent FROM nodes n LEFT JOIN member m ON m.conv_id = n.node AND m.depth = n.depth - 1),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN kids USING (node, depth)),
totals AS (
  SELECT m.node, m.depth, count(*) FILTER (c.n_children = 0) AS n_leaves, sum((c.n_convs - 1) * c.bytes) AS saved
  FROM counted c JOIN member m ON m.conv_id = c.node AND m.depth <= c.depth GROUP BY ALL),
ends AS (
  SELECT node, depth, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha
  FROM member JOIN (SELECT conv_id, max(depth) AS depth FROM member GROUP BY conv_id) USING (conv_id, depth) GROUP BY ALL)
SELECT c.node AS conv_id, c.depth::BIGINT AS depth, c.parent AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved::BIGINT AS saved_tokens,
       coalesce(sha, sha256('')) AS ends_sha256
FROM counted c JOIN totals USING (node, depth) LEFT JOIN ends USING (node, depth)
"""


@_query
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir))


ORACLES["op12_divergence"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
found AS (SELECT doc_id, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM found GROUP BY ALL HAVING count(DISTINCT doc_id) >= 30),
vocab AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL),
sets AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(sum(n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN vocab USING (lang) LEFT JOIN counts USING (lang, source) GROUP BY g.lang, g.source, v),
shares AS (
  SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p
  FROM sets s JOIN kept k USING (lang) LEFT JOIN counts USING (lang, source, term)),
whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q
  FROM counts JOIN vocab USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce((SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM sets a JOIN sets b ON a.lang = b.lang AND a.source <> b.source),
over AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM over))
WHERE part = 'pair' OR rank <= 50
"""


@_query
def op13_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.without_repeats(_documents(spark, sf_dir))


ORACLES["op13_debruijn"] = r"""
WITH split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
windows AS (
  SELECT doc_id, k, array_to_string(words[k:k + 12], ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS k FROM split)),
again AS (SELECT doc_id, k FROM (SELECT *, min(doc_id) OVER (PARTITION BY run) AS first FROM windows) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS k FROM again),
places AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM split),
kept AS (SELECT p.* FROM places p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.k = g.k),
rest AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS words FROM kept GROUP BY doc_id)
SELECT s.doc_id, len(s.words)::BIGINT AS n_words, (len(s.words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(r.words, '')) AS kept_sha256
FROM split s LEFT JOIN rest r USING (doc_id)
"""
