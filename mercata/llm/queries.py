"""Registered queries of the operators: thin, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercata.llm import alignment, ann, chat, decontaminate, fixity, langid, manifest, passages, pieces, quality, simhash, toxicity, vafile
from mercata.llm.common import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_ann(spark, sf_dir):
    """20 nearest by inner product of every vector whose id is divisible by 20."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


@register
def op3_chat(spark, sf_dir):
    """Every conversation (a chain of turns) plus conversation -7, formatted; digests read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(spark.createDataFrame(
        [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")],
        "conv_id long, turn long, role string, text string")).where("conv_id IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    chain = rows.withColumn("nth", nth).withColumn("parent", F.when(F.col("nth") > 1, F.col("nth") - 1)).withColumn("score", F.lit(0.0))
    out = chat.format_trees(chain, "conv_id", "nth", "parent")
    turns = chat.read_back(F.col("formatted"))
    loss = chat.under_mask(F.col("formatted"), F.col("loss_mask"))
    out = out.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                      "formatted_chars")


ORACLE["op3_chat"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS nth
  FROM (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
        UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|start:|>') + 1 + length(role) + length(text) + length('<|end|>') + 1
           + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(role, '\|\\*>'))
           + len(regexp_extract_all(text, '<\\*\|')))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""


@register
def op5_simhash(spark, sf_dir):
    """SimHash component of every document."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


@register
def op9_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op10_langid(spark, sf_dir):
    """Predicted language and language set of every document."""
    return langid.languages(table(spark, sf_dir, "documents"))


@register
def op6_decontamination(spark, sf_dir):
    """Every place of every document where a benchmark item occurs within its edit budget."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op4_substring(spark, sf_dir):
    """Passages of 50 words or more that documents share, and further copies of equal documents."""
    return passages.substring_dedup(table(spark, sf_dir, "documents"))


@register
def op2_sentencepiece(spark, sf_dir):
    """Piece ids of every document, and whether decoding them gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = pieces.encode(docs, pieces.default_model(), check_col="exact", keep=["doc_id"])
    return rows.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "exact")


@register
def op7_warc(spark, sf_dir):
    """Every page as a WARC record, audited against a replica with known damage."""
    return fixity.audit_report(table(spark, sf_dir, "pages"), fixity.damaged)


ORACLE["op7_warc"] = r"""
WITH page AS (SELECT DISTINCT page_id AS number, {'u': coalesce(url, ''), 'h': coalesce(html, '')} AS p
              FROM pages WHERE page_id IS NOT NULL),
made AS (SELECT number, number // 4096 AS file,
           encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
             || 'WARC-Record-ID: <urn:record:' || number || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || p.u
             || chr(13) || chr(10) || 'WARC-Block-Digest: sha256:' || sha256(p.h) || chr(13) || chr(10)
             || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(p.h))
             || chr(13) || chr(10) || chr(13) || chr(10) || p.h || chr(13) || chr(10) || chr(13) || chr(10)) AS r
         FROM page),
parted AS (SELECT *, octet_length(r)::BIGINT AS length, row_number() OVER (PARTITION BY number ORDER BY sha256(r)) - 1 AS part FROM made),
placed AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file, part ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
           FROM parted),
hurt AS (SELECT file, part, count(*) FILTER (number % 997 IN (0, 1, 2)) AS bad FROM placed GROUP BY file, part)
SELECT file, part, number AS page_id, "offset", length, sha256(length || ':' || sha256(r)) AS digest, bad = 0 AS file_intact,
       CASE WHEN number % 997 = 2 THEN 'missing' WHEN number % 997 IN (0, 1) THEN 'corrupt' END AS fault
FROM placed JOIN hurt USING (file, part)
"""


@register
def op8_quality(spark, sf_dir):
    """Co-trained quality score of every document."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op11_alignment(spark, sf_dir):
    """Groups and links of the tokens of every document under two tokenizers."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    rows = alignment.aligned(docs, alignment.default_files()).withColumn("groups_sha256", digest).drop("groups")
    rows = written(rows, "alignment")
    out = alignment.with_counts(rows, alignment.link_counts(rows))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@register
def op13_manifest(spark, sf_dir):
    """Merkle manifest of all documents, every proof, and an audit after known tampering."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "n_chars", "text")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hurt = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    made = manifest.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id",
                             now={"text": F.when(hurt, lower).otherwise(F.col("text"))})
    return manifest.audit(made)


ORACLE["op13_manifest"] = r"""
WITH RECURSIVE
said AS (
  SELECT doc_id, lang, text, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
           coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head
  FROM documents),
hashed AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS hurt,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
           lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc
  FROM said),
leaves AS (
  SELECT *, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN hurt ELSE leaf END AS now,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM hashed),
node AS (
  SELECT lang, 0 AS level, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY lang, level, pos // 8, n),
sub AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
upper AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM sub
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY level, pos // 8, n),
beside AS (
  SELECT *, coalesce(string_agg(h, '') OVER (PARTITION BY lang, level, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (PARTITION BY lang, level, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM node WHERE n > 1),
upper_beside AS (
  SELECT *, coalesce(string_agg(h, '') OVER (PARTITION BY level, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (PARTITION BY level, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM upper WHERE n > 1),
walk AS (
  SELECT doc_id, lang, leaf, pos AS own, 0 AS level, pos, n, now AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, w.own, w.level + 1, w.pos // 8, (w.n + 7) // 8, sha256(b.l || w.h || b.r), w.proof || b.l || b.r
  FROM walk w JOIN beside b ON b.lang IS NOT DISTINCT FROM w.lang AND b.level = w.level AND b.pos = w.pos WHERE w.n > 1),
walk_on AS (
  SELECT w.doc_id, w.leaf, w.own, s.subroot, 0 AS level, s.pos, s.n, w.h, w.proof
  FROM walk w JOIN sub s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT w.doc_id, w.leaf, w.own, w.subroot, w.level + 1, w.pos // 8, (w.n + 7) // 8, sha256(b.l || w.h || b.r), w.proof || b.l || b.r
  FROM walk_on w JOIN upper_beside b ON b.level = w.level AND b.pos = w.pos WHERE w.n > 1)
SELECT doc_id, leaf, subroot, u.h AS root, sha256(proof) AS proof_sha256, w.h AS folded_root, w.h = u.h AS verified
FROM walk_on w JOIN upper u ON u.n = 1 WHERE w.n = 1
"""


@register
def op12_vafile(spark, sf_dir):
    """5 highest integer inner products of every vector whose id is divisible by 50."""
    return vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


ORACLE["op12_vafile"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pair)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
