"""Digests, chains, checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import arrays as A, text as X
from tessera.functions.registry import blake2b_hex, canonical_json_digest
from tessera.operators import order as O, state as ST, verify as V
from tessera.session import table as T

LOG = "log AS (SELECT o_orderkey AS step, sha256(CAST(o_orderkey AS VARCHAR)) AS state_hash, CASE WHEN o_orderkey % 401 = 5 THEN sha256('x') ELSE sha256(CAST(lag(o_orderkey) OVER (ORDER BY o_orderkey) AS VARCHAR)) END AS prev_hash FROM orders)"


def log(spark, d):
    sha = lambda x: F.sha2(x.cast("string"), 256)
    orders = T(spark, d, "orders").select(F.col("o_orderkey").alias("step"), F.expr("o_orderkey div 4096").alias("b"))
    k = F.col("step")
    return O.previous(orders, ["b"], ["step"], "step", "before").select("step", sha(k).alias("state_hash"), F.when(k % 401 == 5, F.sha2(F.lit("x"), 256)).otherwise(sha(F.col("before"))).alias("prev_hash"))


@query("hash_chain_verify", f"WITH {LOG} SELECT step FROM (SELECT step, prev_hash, lag(state_hash) OVER (ORDER BY step) AS was FROM log) WHERE was IS NOT NULL AND prev_hash IS DISTINCT FROM was")
def _(spark, d):
    return V.broken_links(log(spark, d)).select("step")


@query("first_divergence", "SELECT min(o_orderkey) AS first_divergence FROM orders WHERE o_orderkey % 1013 = 77 OR o_orderkey % 997 = 90")
def _(spark, d):
    a = T(spark, d, "orders").select(F.col("o_orderkey").alias("step"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("state_hash"))
    b = a.where("step % 1013 <> 77").withColumn("state_hash", F.when(F.col("step") % 997 == 90, "other").otherwise(F.col("state_hash")))
    return V.first_divergence(a, b)


@query("ckpt_gc_keepset", "SELECT o_orderkey AS step FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 3 OR o_orderkey % 500 = 0")
def _(spark, d):
    k = T(spark, d, "orders").select(F.col("o_orderkey").alias("step"))
    return k.orderBy(F.desc("step")).limit(3).unionByName(k.where("step % 500 = 0")).distinct()


@query("latest_complete", "SELECT max(o_orderkey) AS step FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    return T(spark, d, "orders").where("o_orderstatus = 'F'").agg(F.max("o_orderkey").alias("step"))


@query("digest_syntax", "SELECT doc_id, regexp_matches(h, '^[0-9a-fA-F]{64}$') AS ok, lower(h) AS digest FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN upper(sha256(text)) WHEN 1 THEN sha256(text) || '0' ELSE sha256(text) END AS h FROM documents)")
def _(spark, d):
    h = F.sha2("text", 256)
    h = F.when(F.col("doc_id") % 3 == 0, F.upper(h)).when(F.col("doc_id") % 3 == 1, F.concat(h, F.lit("0"))).otherwise(h)
    return T(spark, d, "documents").select("doc_id", X.is_digest(h).alias("ok"), F.lower(h).alias("digest"))


@query("text_digests")
def _(spark, d):
    """BLAKE2b of every text."""
    return T(spark, d, "documents").select("doc_id", blake2b_hex(F.col("text").cast("binary")).alias("digest"))


@query("batch_digest_chain")
def _(spark, d):
    """Each rank's running digest over its windows, here the word lengths of documents."""
    t = F.btrim("text", F.lit(X.SPACES))
    w = T(spark, d, "documents").where(F.length(t) > 0).select((F.col("doc_id") % 4).alias("rank"), F.col("doc_id").alias("step"), F.transform(F.split(t, r"[\x20\x09-\x0D]+"), lambda x: F.length(x).cast("bigint")).alias("tokens"))
    return V.batch_digests(w)


@query("interval_verify", "SELECT o_orderkey // 100 AS chunk, count(*) AS steps, CAST(sum(o_custkey) AS BIGINT) AS total, count(*) FILTER (WHERE o_totalprice > 200000) AS flagged FROM orders WHERE o_orderkey BETWEEN 200 AND 1199 GROUP BY 1")
def _(spark, d):
    return T(spark, d, "orders").where("o_orderkey between 200 and 1199").groupBy(F.expr("o_orderkey div 100").alias("chunk")).agg(F.count("*").alias("steps"), F.sum("o_custkey").alias("total"), F.count_if(F.col("o_totalprice") > 200000).alias("flagged"))


@query("interval_verdict", "WITH o AS (SELECT o_orderkey AS k, o_orderkey % 1013 <> 77 AS there, o_orderkey % 1013 <> 77 AND o_orderkey % 997 <> 90 AS same FROM orders WHERE o_orderkey BETWEEN 200 AND 1199) SELECT count(*) AS steps, count(*) FILTER (WHERE same) AS agreed, count(*) FILTER (WHERE NOT there) AS missing, min(k) FILTER (WHERE NOT same) AS first_divergence, count(*) > 0 AND count(*) = count(*) FILTER (WHERE same) AS passed FROM o")
def _(spark, d):
    a = log(spark, d).select("step", "state_hash")
    b = a.where("step % 1013 <> 77").withColumn("state_hash", F.when(F.col("step") % 997 == 90, "other").otherwise(F.col("state_hash")))
    return ST.interval_verdict(a, b, 200, 1200)


def state(spark, d):
    """The documents as named arrays in eight shards: texts as weights, lengths as steps, and sources as gradients of every third."""
    docs = T(spark, d, "documents").select((F.col("doc_id") % 8).cast("int").alias("shard"), F.format_string("doc.%012d", "doc_id").alias("name"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), "n_chars", "source")
    parts = F.array(*[F.struct(F.lit(p).alias("part"), c.cast("binary").alias("data")) for p, c in (("weight", F.col("text")), ("optim_step", F.lit("")), ("grad", F.when(F.col("doc_id") % 3 == 0, F.col("source"))))])
    rows = docs.withColumn("p", F.explode(F.filter(parts, lambda x: x["data"].isNotNull())))
    data = F.col("p.data")
    return rows.select("shard", "name", "p.part", F.lit(0).alias("chunk"), F.lit("torch.uint8").alias("kind"), F.array(F.octet_length(data).cast("bigint")).alias("shape"), data.alias("data"), F.coalesce("n_chars", F.lit(0)).cast("bigint").alias("step"))


@query("state_shard_digests")
def _(spark, d):
    return ST.state_digests(state(spark, d), grads=True)


@query("canonical_json_digest")
def _(spark, d):
    return T(spark, d, "events").select("event_id", canonical_json_digest("props").alias("digest"))


@query("continuation_score", "SELECT vec_id, round(e[t + 1] - ln(list_sum(list_transform(e, lambda x: exp(x)))), 6) AS ll, list_position(e, list_max(e)) = t + 1 AS greedy FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, vec_id % len(embedding) AS t FROM embeddings WHERE len(embedding) > 0)")
def _(spark, d):
    e = T(spark, d, "embeddings").where(F.size("embedding") > 0).select("vec_id", F.col("embedding").cast("array<double>").alias("e"), (F.col("vec_id") % F.size("embedding")).cast("int").alias("t"))
    return e.select("vec_id", A.continuation_score(F.array("e"), F.array("t")).alias("s")).select("vec_id", F.round("s.ll", 6).alias("ll"), "s.greedy")


@query("null_not_zero", "SELECT count(*) FILTER (WHERE v IS NULL) AS nulls, count(*) FILTER (WHERE v = 0) AS zeros, count(DISTINCT coalesce(CAST(v AS VARCHAR), 'null')) AS distinct_states FROM (SELECT CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 0 ELSE l_linenumber END AS v FROM lineitem)")
def _(spark, d):
    n = F.col("l_linenumber")
    v = T(spark, d, "lineitem").select(F.when(n == 1, None).when(n == 2, 0).otherwise(n).alias("v"))
    return v.agg(F.count_if(F.col("v").isNull()).alias("nulls"), F.count_if(F.col("v") == 0).alias("zeros"), F.countDistinct(F.coalesce(F.col("v").cast("string"), F.lit("null"))).alias("distinct_states"))


@query("nonfinite_predicate", "SELECT event_id, value > 100 OR event_id % 97 = 0 AS nonfinite FROM events")
def _(spark, d):
    x = F.when(F.col("event_id") % 97 == 0, float("nan")).when(F.col("value") > 100, float("inf")).otherwise(F.col("value"))
    return T(spark, d, "events").select("event_id", (F.isnan(x) | (F.abs(x) == float("inf"))).alias("nonfinite"))
