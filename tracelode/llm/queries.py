"""The operators' registered queries, each over its whole table, and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, langid, mixing, neardup, packing, quality, repair, secrets, simhash, trie, warc
from .common import crc_mod, load, spread


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(spread(load(spark, sf_dir, "documents")))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations and one that holds control strings, formatted and read back."""
    odd = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    logs = chat.from_turns(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))
    back = chat.read_back(chat.format_chat(logs))
    digest = F.sha2(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), ""), 256)
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("messages").cast("long").alias("n_turns"),
        digest.alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(load(spark, sf_dir, "documents"))
    return secrets.digest(secrets.scan(docs, secrets.train(docs)))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(spread(load(spark, sf_dir, "documents")), load(spark, sf_dir, "benchmark"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(load(spark, sf_dir, "documents"))
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    return langid.identify(docs, langid.train(docs.where(~held_out)), {"held_out": held_out})


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(load(spark, sf_dir, "documents"))
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = quality.train(docs, load(spark, sf_dir, "labels"), learn_from=~held_out)
    return quality.scored(docs.withColumn("held_out", held_out), model, "doc_id", "held_out")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(spread(load(spark, sf_dir, "documents")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_files(load(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(load(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op12_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(load(spark, sf_dir, "embeddings"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_conversations(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_chat_formatting, op3_secret_scan, op4_decontamination, op5_nearest, op6_language, op7_quality, op8_simhash, op9_packing, op10_warc, op11_prefix_trie, op12_embedding_groups, op13_structure_repair, pipeline)}


WARC_SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT d.page_id, payload_bytes, d.payload_digest,
       CASE WHEN first_id IS NULL OR first_id = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> d.page_id THEN first_id END AS refers_to, coalesce(url, '') AS url
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND payload_bytes >= 100
"""


CONTROL = r"(s>|/s>|INST\]|/INST\]|ROLE\]|/ROLE\])"
CHAT_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)({CONTROL})', '\1\\\2\3', 'g'))
          + length(regexp_replace(role, '([<\[])(\\*)({CONTROL})', '\1\\\2\3', 'g')) + 20
          + CASE WHEN role = 'assistant' THEN 0 ELSE 15 END AS n
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


#: CRC32 of a number's digits, bit by bit: a step for each digit and eight shifts after it (-1).
CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""
TRIE_SQL = f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS no
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC.format("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM own)
), turns AS (
  SELECT c.conv_id, no, role, text FROM c JOIN own ON own.conv_id = base AND no <= h
  UNION ALL SELECT c.conv_id, no + 1000000, role, text FROM c JOIN own ON own.conv_id = c.conv_id AND no > h
), way AS (
  SELECT conv_id, row_number() OVER w AS depth, list({{'r': role, 't': text}}) OVER w AS node, length(text) AS size FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY no)
  UNION ALL SELECT conv_id, 0, [], 0 FROM c
), last AS (
  SELECT conv_id, max(depth) AS depth FROM way GROUP BY 1
), every AS (
  SELECT way.depth, way.node, min(way.conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(way.conv_id::VARCHAR, ',' ORDER BY way.conv_id) FILTER (way.depth = last.depth), '')) AS ends_sha256
  FROM way JOIN last ON way.conv_id = last.conv_id GROUP BY 1, 2
), up AS (
  SELECT e.*, p.conv_id AS parent_conv_id FROM every e LEFT JOIN way w ON w.conv_id = e.conv_id AND w.depth = e.depth - 1 LEFT JOIN every p ON p.depth = e.depth - 1 AND p.node = w.node
), kids AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM up WHERE depth > 0 GROUP BY 1, 2
), named AS (
  SELECT up.*, coalesce(n, 0) AS n_children FROM up LEFT JOIN kids USING (conv_id, depth)
), sums AS (
  SELECT w.depth, w.node, count(*) FILTER (d.n_children = 0) AS n_leaves, sum((d.n_convs - 1) * d.size) AS saved_tokens FROM named d JOIN way w ON w.conv_id = d.conv_id AND w.depth <= d.depth GROUP BY 1, 2
)
SELECT conv_id, d.depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM named d JOIN sums s ON d.depth = s.depth AND d.node = s.node
"""


GROUPS_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.rid, b.rid AS other FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.rid <> b.rid WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT rid, rid AS other FROM v UNION SELECT r.rid, l.other FROM reach r JOIN links l ON l.rid = r.other
), c AS (
  SELECT r.rid, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.rid = r.other GROUP BY 1
), n AS (
  SELECT rid, count(*) AS n_links FROM links GROUP BY 1
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (rid) LEFT JOIN n USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    """Of the others: trained models, approximate search, 64-bit hashing of shingles, and tokenizers aren't SQL; tests hold them against brute force."""
    return {"op2_chat_formatting": CHAT_SQL, "op10_warc": WARC_SQL, "op11_prefix_trie": TRIE_SQL, "op12_embedding_groups": GROUPS_SQL}
