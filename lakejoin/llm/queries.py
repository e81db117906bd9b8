"""One registered query per operator, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejoin.llm import (bpe, centroids, chat, codes, decontaminate, jaccard, knn, language, line_dedup, pii, reference_sql, sharding, shared,
                          toxicity, url_filter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]
CATEGORIES = ["quality", "toxic"]
PII_KEY = "corpuskey1"
SHARDS = 40


def tokenizer_json(path: str | None = None) -> str:
    """Content of the byte-level tokenizer file; ``path`` defaults to the installed one."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


@register("op1_voronoi_knn", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda t: t[1] * t[2])) AS BIGINT) AS score
      FROM e q JOIN e d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 5""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = knn.quantised(shared.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return knn.top_k(e, e.filter("id % 50 = 0"), 5).withColumnRenamed("id", "vec_id")


@register("op2_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(shared.spread(shared.table(spark, sf_dir, "documents").select("doc_id", "text")), tokenizer_json())


@register("op3_language_ppm")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.spread(shared.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.fit(docs.filter(~held_out))
    return language.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


@register("op4_toxicity_chain")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.spread(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
    chain = toxicity.fit(docs, shared.table(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity.score(docs, chain).drop("text").withColumnRenamed("rejected", "toxic")


@register("op5_url_templates")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = shared.table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).drop("url")


@register("op6_line_dedup", r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i - 1 AS pos, ls[i] AS a, ls[i + 1] AS b, ls[i + 2] AS c
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l WHERE len(ls) >= 3)),
k AS (SELECT *, first_value(doc_id) OVER o AS f_doc, first_value(pos) OVER o AS f_pos FROM w
      WHERE trim(a || b || c, ' ') <> '' WINDOW o AS (PARTITION BY a, b, c ORDER BY doc_id, pos)),
g AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = f_doc THEN greatest(pos, f_pos + 3) ELSE pos END, pos + 3)) AS line
      FROM k WHERE doc_id <> f_doc OR pos > f_pos),
x AS (SELECT doc_id, ls, unnest(range(0, len(ls))) AS line FROM l),
y AS (SELECT x.doc_id, count(*) AS n_lines, count(g.line) AS n_removed,
             string_agg(CASE WHEN g.line IS NULL THEN x.ls[x.line + 1] END, chr(10) ORDER BY x.line) AS kept
      FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.line = g.line GROUP BY x.doc_id)
SELECT d.doc_id, CAST(coalesce(y.n_lines, 1) AS INTEGER) AS n_lines, CAST(coalesce(y.n_removed, 0) AS INTEGER) AS n_removed,
       md5(CASE WHEN d.text IS NOT NULL THEN coalesce(y.kept, '') END) AS text_md5
FROM documents d LEFT JOIN y ON d.doc_id = y.doc_id""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


@register("op7_hypergeometric_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shard(docs, SHARDS)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                      F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register("op8_ngram_jaccard_join", reference_sql.JACCARD_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(shared.spread(shared.table(spark, sf_dir, "documents").select("doc_id", "text")))


@register("op9_pii_feistel")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.pseudonymize(docs, PII_KEY)
    return out.select("doc_id", F.size("pii").alias("n_pii"), "pii", F.md5("text").alias("text_md5"))


@register("op10_winnowing_decontamination", reference_sql.WINNOWING_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.spread(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = decontaminate.contamination(docs, shared.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"   # the turns of conversation -1


@register("op11_reply_trees", rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'),
e AS (SELECT *, length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\1\\|', 'g')) AS role_len,
             length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS text_len FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, sha256(text))) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, sha256(text)) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + role_len + 1 + text_len + 11) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = shared.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], turns.schema)
    out = chat.conversations(chat.chains(turns.unionByName(more), "conv_id", "turn", "role", "text"))
    said = chat.read_back(F.col("formatted"))
    learnt = chat.learnt_text(F.col("formatted"), F.col("loss_spans"))
    return (out.select(F.col("tree").alias("conv_id"), F.length("formatted").cast("long").alias("formatted_chars"), said.alias("said"), learnt.alias("learnt"))
            .select("conv_id", F.size("said").cast("long").alias("n_turns"),
                    F.sha2(F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
                    F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars"))


def _centroid_sql(k: int = 16, dim: int = 64, rounds: int = 3, scale: int = 64) -> str:
    """Rounds unrolled: c<i> are the centroids before round i, a<i> the assignment to them."""
    near = """a{i} AS (SELECT vec_id, v, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
  SELECT e.vec_id, e.v, e.rid, c.j, CAST(list_sum(list_transform(list_zip(e.v, c.v), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT) AS d
  FROM e, c{i} c) GROUP BY vec_id, v, rid)"""
    mean = """s{i} AS (SELECT j, p, CAST(sum(v[p]) AS HUGEINT) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, {top})) AS p) GROUP BY j, p),
m{i} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS v FROM s{i} GROUP BY j),
c{n} AS (SELECT c.j, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.j = c.j)"""
    steps = [f"""e AS (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, v FROM e
  WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))"""]
    for i in range(rounds):
        steps += [near.format(i=i), mean.format(i=i, n=i + 1, top=dim + 1)]
    steps.append(near.format(i=rounds))
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, CAST(a.j AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.j = a.j"""


@register("op12_vantage_point_centroids", _centroid_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(shared.spread(shared.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), k=16, dim=64, rounds=3, scale=64)


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, m: int = 4) -> str:
    near = """a{i} AS (SELECT rid, vec_id, label, p, x, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
  SELECT x.rid, x.vec_id, x.label, x.p, x.x, b.k, CAST(list_sum(list_transform(list_zip(x.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT) AS d
  FROM x JOIN b{i} b ON b.p = x.p) GROUP BY rid, vec_id, label, p, x)"""
    mean = """s{i} AS (SELECT p, k, o, CAST(sum(x[o]) AS HUGEINT) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, {top})) AS o) GROUP BY p, k, o),
m{i} AS (SELECT p, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY o) AS x FROM s{i} GROUP BY p, k),
b{n} AS (SELECT b.p, b.k, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m ON m.p = b.p AND m.k = b.k)"""
    steps = [f"""e AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rid,
  list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"x AS (SELECT rid, vec_id, label, p, v[p * {m} + 1:p * {m} + {m}] AS x FROM e, (SELECT unnest(range(0, {parts})) AS p))",
             f"b0 AS (SELECT p, rid - 1 AS k, x FROM x WHERE rid <= {entries})"]
    for i in range(rounds):
        steps += [near.format(i=i), mean.format(i=i, n=i + 1, top=m + 1)]
    steps.append(near.format(i=rounds))
    steps.append(f"books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) AS h FROM b{rounds})")
    steps.append(f"coded AS (SELECT rid, vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid, vec_id, label)")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded, books"""


@register("op13_grid_cell_codes", _codes_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(shared.spread(shared.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")),
                          parts=16, entries=64, rounds=2, scale=256)
