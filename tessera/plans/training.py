"""Schedules and telemetry. The events table stands in for a run's log: its type for a parameter's category, its value for a norm."""

from __future__ import annotations


from pyspark.sql import Window as W, functions as F

from tessera.catalog import query
from tessera.functions import arrays as A, names as N, schedules as S
from tessera.operators import packing as P, telemetry as M
from tessera.plans.corpus import sized
from tessera.session import table as T

PHASES = S.Phases(3_145_728, 4_718_592, 9_437_184, 4_000_000_000, 360_000_000_000)

#: A run over all tokens of the documents a hundred times, its batch growing at a tenth and at half of them; micro-batches of 4 x 64 tokens.
PLAN = r"""RECURSIVE run AS MATERIALIZED (SELECT 100 * sum(len(regexp_extract_all(coalesce(text,''), '[^ \t\n\x0b\f\r]+'))) AS total FROM documents), p(step, c, w) AS (SELECT 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT step + 1, c + t * 256, w + t * 4 FROM (SELECT p.*, total, CASE WHEN c < total // 10 THEN 64 WHEN c < total // 2 THEN 256 ELSE 512 END AS t FROM p, run) WHERE c + t * 256 < total), plan AS (SELECT step, c, w, CAST(CASE WHEN c < total // 10 THEN 64 WHEN c < total // 2 THEN 256 ELSE 512 END AS BIGINT) AS t FROM p, run)"""


def planned(spark, d):
    total = 100 * (sized(spark, d).agg(F.sum("n_tokens")).first()[0] or 0)
    return P.step_plan(spark, S.Phases(64 * 256, 256 * 256, 512 * 256, total // 10, total // 2), 4, 64, total)


@query("step_plan", f"WITH {PLAN} SELECT CAST(step AS BIGINT) AS step, c AS consumed_tokens, w AS base_window, t AS microbatches, t * 256 AS tokens_this_step FROM plan")
def _(spark, d):
    return planned(spark, d)


@query("run_totals", f"WITH {PLAN} SELECT microbatches, count(*) AS steps, CAST(sum(microbatches * 256) AS BIGINT) AS tokens FROM (SELECT t AS microbatches FROM plan) GROUP BY microbatches")
def _(spark, d):
    """Steps and tokens of each batch size of the run."""
    return planned(spark, d).groupBy("microbatches").agg(F.count("*").alias("steps"), F.sum("tokens_this_step").alias("tokens"))


@query("batch_targets", "SELECT o_orderkey, c AS consumed, t AS target, (t + 131071) // 131072 AS accumulation FROM (SELECT *, CAST(CASE WHEN c < 4000000000 THEN 3145728 WHEN c < 360000000000 THEN 4718592 ELSE 9437184 END AS BIGINT) AS t FROM (SELECT o_orderkey, o_orderkey * 50000000 AS c FROM orders))")
def _(spark, d):
    c = F.col("o_orderkey") * 50_000_000
    return T(spark, d, "orders").select("o_orderkey", c.alias("consumed"), PHASES.target(c).alias("target"), S.legacy_accumulation(PHASES.target(c), 4, 4096, F.lit(8)).alias("accumulation"))


def _points(spark, d):
    """Consumed tokens of a run of a billion, as the orders' keys stand for them."""
    return T(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 66_667 % 1_100_000_000).alias("c"))


C = "(SELECT o_orderkey, o_orderkey * 66667 % 1100000000 AS c FROM orders)"


@query("lr_cosine", f"SELECT o_orderkey, c, round(CASE WHEN c < 20e6 THEN 3e-4 * c / 20e6 ELSE 3e-5 + 0.5 * 2.7e-4 * (1 + cos(pi() * greatest(0, least(1, (c - 20e6) / 980e6)))) END, 12) AS lr FROM {C}")
def _(spark, d):
    return _points(spark, d).select("o_orderkey", "c", F.round(S.lr_cosine(F.col("c"), 3e-4, 20e6, 1e9, 0.1), 12).alias("lr"))


@query("lr_wsd", f"SELECT o_orderkey, c, round(CASE WHEN c < 20e6 THEN 3e-4 * c / 20e6 WHEN c < 8e8 THEN 3e-4 ELSE 3e-4 - 3e-4 * greatest(0, least(1, (c - 8e8) / 2e8)) END, 12) AS lr FROM {C}")
def _(spark, d):
    return _points(spark, d).select("o_orderkey", "c", F.round(S.lr_wsd(F.col("c"), 3e-4, 20e6, 1e9, 0.8, 0.0), 12).alias("lr"))


@query("lr_linear_anneal", f"SELECT o_orderkey, c, round(CASE WHEN c < 20e6 THEN 3e-4 * c / 20e6 WHEN c < 5e8 THEN 3e-4 ELSE 3e-4 + (3e-5 - 3e-4) * greatest(0, least(1, (c - 5e8) / 5e8)) END, 12) AS lr FROM {C}")
def _(spark, d):
    return _points(spark, d).select("o_orderkey", "c", F.round(S.lr_linear_anneal(F.col("c"), 3e-4, 20e6, 1e9, 5e8, 0.1), 12).alias("lr"))


@query("lr_rewarm", f"SELECT o_orderkey, c, round(CASE WHEN c - 3e8 < 5e7 THEN 3e-4 * greatest(0, (c - 3e8) / 5e7) ELSE 3e-4 END, 12) AS lr FROM {C}")
def _(spark, d):
    return _points(spark, d).select("o_orderkey", "c", F.round(S.rewarmed(F.lit(3e-4), F.col("c"), F.lit(3e8), 5e7), 12).alias("lr"))


@query("anchor_inheritance", "SELECT event_id, last_value(CASE WHEN event_id % 50 = 7 THEN event_id END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS anchor FROM events")
def _(spark, d):
    e = T(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 50 == 7, F.col("event_id")).alias("a"))
    return e.select("event_id", M.last_known(e, "a", "event_id", ["event_type"]).alias("anchor"))


def norms(spark, d):
    """(step, ordinal, category, layer, norm): ten events a step."""
    return T(spark, d, "events").select(F.expr("event_id div 10").alias("step"), (F.col("event_id") % 10).alias("ordinal"), F.col("event_type").alias("category"), (F.col("user_id") % 4).alias("layer"), F.col("value").alias("norm"))


@query("gradnorm_rollup", "SELECT event_id // 10 AS step, event_type AS category, user_id % 4 AS layer, round_even(sqrt(sum(value * value)), 6) AS norm, grouping(event_id // 10, event_type, user_id % 4) AS level FROM events GROUP BY GROUPING SETS ((event_id // 10), (event_id // 10, event_type), (event_id // 10, user_id % 4))")
def _(spark, d):
    return M.norm_rollup(norms(spark, d))


@query("gradnorm_topk", "SELECT step, ordinal, norm, CAST(r AS INTEGER) AS rank FROM (SELECT event_id // 10 AS step, event_id % 10 AS ordinal, value AS norm, row_number() OVER (PARTITION BY event_id // 10 ORDER BY value DESC, event_id % 10) AS r FROM events) WHERE r <= 3")
def _(spark, d):
    return M.top_norms(norms(spark, d), 3).select("step", "ordinal", "norm", "rank")


@query("dead_tensor_runs", "WITH e AS (SELECT event_type AS name, event_id AS step, CAST(value AS INTEGER) % 3 = 0 AS z FROM events), g AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY step) - row_number() OVER (PARTITION BY name, z ORDER BY step) AS g FROM e) SELECT name, min(step) AS first_step, max(step) AS last_step, count(*) AS length FROM g WHERE z GROUP BY name, g HAVING count(*) >= 3")
def _(spark, d):
    whole = F.bround("value").cast("int")
    e = T(spark, d, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("step"), F.when(whole % 3 == 0, 0.0).otherwise(F.col("value")).alias("norm"))
    return M.dead_runs(e, 3)


def series(spark, d):
    return T(spark, d, "events").select(F.col("event_type").alias("run_id"), F.col("event_id").alias("step"), F.lit(1.0).alias("loss"), F.col("value").alias("norm"))


@query("spike_events", """WITH RECURSIVE o AS (SELECT event_type AS run_id, event_id AS step, value > 40 AND event_id >= 20 AS bad, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events),
 r AS (SELECT run_id, step, k, bad AS skipped, bad AS fresh, CASE WHEN bad THEN 2 ELSE 0 END AS cool, CASE WHEN bad THEN [step] ELSE CAST([] AS BIGINT[]) END AS recent, false AS halted FROM o WHERE k = 1
  UNION ALL SELECT run_id, step, k, skip, fresh, CASE WHEN fresh THEN 2 WHEN skip THEN cool - 1 ELSE 0 END, rec, halted OR (fresh AND len(rec) >= 3) FROM (SELECT o.run_id, o.step, o.k, r.cool, r.halted, (r.cool > 0 OR o.bad) AS skip, (r.cool = 0 AND o.bad) AS fresh, CASE WHEN r.cool = 0 AND o.bad THEN list_append(list_filter(r.recent, lambda x: x >= o.step - 40), o.step) ELSE r.recent END AS rec FROM r JOIN o ON o.run_id = r.run_id AND o.k = r.k + 1))
 SELECT run_id, step, skipped, fresh, halted FROM r""")
def _(spark, d):
    return M.spike_events(series(spark, d), 40.0, 20, 3, 40, 3)


@query("spike_halt_window", "SELECT event_type AS run_id, event_id AS step, count(*) OVER (PARTITION BY event_type ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS recent, count(*) OVER (PARTITION BY event_type ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) >= 3 AS halted FROM events WHERE value > 20")
def _(spark, d):
    fresh = series(spark, d).where("norm > 20").select("run_id", "step")
    return M.halts(fresh, 100, 3)


@query("mfu", "SELECT p_partkey, p_size AS layers, f AS flops, round(p_retailprice * 1e3 * f / 8e15, 12) AS mfu FROM (SELECT *, CAST(72 * p_size * 64 * 64 + 12 * p_size * 128 * 64 + 6 * 1000 * 64 AS BIGINT) AS f FROM part)")
def _(spark, d):
    """Utilisation for models of as many layers as a part's size, at its price in thousands of tokens a second."""
    f = S.flops_per_token(F.col("p_size").cast("bigint"), F.lit(64), F.lit(128), F.lit(1000)).cast("bigint")
    return T(spark, d, "part").select("p_partkey", F.col("p_size").alias("layers"), f.alias("flops"), F.round(S.mfu(F.col("p_retailprice") * 1e3, f, 8), 12).alias("mfu"))


@query("clip_coefficient", "SELECT event_id, round(least(1.0 / (value + 1e-6), 1.0), 9) AS c FROM events WHERE value >= 0")
def _(spark, d):
    return T(spark, d, "events").where("value >= 0").select("event_id", F.round(S.clip_coefficient(F.col("value"), 1.0), 9).alias("c"))


@query("chunk_bounds", "SELECT p_partkey, s AS shard, least((p_size + 3) // 4 * s, p_size) AS start, least(least((p_size + 3) // 4 * s, p_size) + (p_size + 3) // 4, p_size) AS \"end\" FROM part, (SELECT CAST(range AS INTEGER) AS s FROM range(4))")
def _(spark, d):
    size = F.col("p_size").cast("bigint")
    p = T(spark, d, "part").select("p_partkey", size.alias("p_size"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("shard"))
    b = S.chunk_bounds(F.col("p_size"), 4, F.col("shard"))
    return p.select("p_partkey", "shard", b.alias("b")).select("p_partkey", "shard", F.col("b.start").cast("int").alias("start"), F.col("b.end").cast("int").alias("end"))


@query("ordered_loss_fold", "SELECT event_id // 10 AS step, list_reduce(list_prepend(0.0::DOUBLE, list(value ORDER BY event_id)), lambda a, x: a + x) * (1.0 / count(*)) AS loss FROM events GROUP BY event_id // 10")
def _(spark, d):
    pairs = F.collect_list(F.struct(F.col("ordinal").alias("order"), F.col("norm").alias("value")))
    return norms(spark, d).groupBy("step").agg(pairs.alias("p"), F.count("*").alias("n")).select("step", (A.ordered_fold(F.col("p")) * (F.lit(1.0) / F.col("n"))).alias("loss"))


@query("tree_fold", "SELECT event_id // 10 AS step, (((v[1] + v[2]) + (v[3] + v[4])) + ((v[5] + v[6]) + (v[7] + v[8]))) + (v[9] + v[10]) AS total FROM (SELECT event_id, list(value) OVER (PARTITION BY event_id // 10 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM events) WHERE event_id % 10 = 0")
def _(spark, d):
    v = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "norm"))), lambda x: x["norm"])
    return norms(spark, d).groupBy("step").agg(v.alias("v")).select("step", A.tree_sum(F.col("v")).alias("total"))


@query("log_sum_exp", "SELECT vec_id, round(m + ln(list_sum(list_transform(e, lambda x: exp(x - m)))), 9) AS lse FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, CAST(list_max(embedding) AS DOUBLE) AS m FROM embeddings)")
def _(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return T(spark, d, "embeddings").select("vec_id", F.round(A.log_sum_exp(e), 9).alias("lse"))


NAMES = "(SELECT k, CASE k % 9 WHEN 0 THEN 'tok_embeddings.weight' WHEN 1 THEN 'layers.' || k || '.attn.wq.weight' WHEN 2 THEN 'layers.' || k || '.ffn.w_up.weight' WHEN 3 THEN 'layers.' || k || '.ffn_norm.weight' WHEN 4 THEN 'output.weight' WHEN 5 THEN 'blocks.' || k || '.attn.weight_scale' WHEN 6 THEN 'final_norm.weight' WHEN 7 THEN 'rope.freqs' ELSE 'my.blocks.' || k || '.w_gate' END AS name FROM (SELECT p_partkey AS k FROM part))"


def parameters(spark, d):
    """A parameter for each part, in nine forms of names."""
    k = F.col("p_partkey")
    forms = ["tok_embeddings.weight", ("layers.", ".attn.wq.weight"), ("layers.", ".ffn.w_up.weight"), ("layers.", ".ffn_norm.weight"), "output.weight", ("blocks.", ".attn.weight_scale"), "final_norm.weight", "rope.freqs", ("my.blocks.", ".w_gate")]
    out = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        out = F.when(k % 9 == i, F.lit(f) if isinstance(f, str) else F.concat(F.lit(f[0]), k.cast("string"), F.lit(f[1]))).otherwise(out)
    return T(spark, d, "part").select(k.alias("k"), out.alias("name"), F.when(k % 9 == 3, 1).when(k % 9 == 6, 1).otherwise(2).alias("dims"))


@query("parameter_categories", f"SELECT k, name, CASE WHEN contains(name, 'weight_scale') THEN 'lsq_scale' WHEN contains(name, 'embed') THEN 'embed' WHEN contains(name, 'lm_head') OR suffix(name, 'output.weight') THEN 'lm_head' WHEN contains(name, '.attn.') THEN 'attn' WHEN regexp_matches(name, '\\.ffn\\.|w_gate|w_up|w_down') THEN 'ffn' WHEN contains(name, 'norm') THEN 'norm' ELSE 'other' END AS category, TRY_CAST(nullif(regexp_extract(name, '(?:^|\\.)(?:layers|blocks)\\.(\\d+)(?:\\.|$)', 1), '') AS INTEGER) AS layer FROM {NAMES}")
def _(spark, d):
    n = F.col("name")
    return parameters(spark, d).select("k", "name", N.category(n).alias("category"), N.layer_index(n).alias("layer"))


@query("optimizer_groups", f"SELECT CASE WHEN k % 9 IN (3, 6) OR contains(name, 'norm') OR contains(name, 'embed') THEN 'no_decay' ELSE 'decay' END AS grp, count(*) AS params, CAST(sum((k + 1) * 10) AS BIGINT) AS numel, count(*) FILTER (WHERE k % 9 NOT IN (3, 6) AND NOT regexp_matches(name, 'tok_embeddings|output|norm')) AS hidden FROM {NAMES} GROUP BY grp")
def _(spark, d):
    p, n = parameters(spark, d), F.col("name")
    group = F.when(N.no_decay(F.col("dims"), n, ["norm", "embed"]), "no_decay").otherwise("decay")
    return p.groupBy(group.alias("grp")).agg(F.count("*").alias("params"), F.sum((F.col("k") + 1) * 10).alias("numel"), F.count_if(N.hidden_matrix(F.col("dims"), n)).alias("hidden"))


@query("weight_law", "SELECT event_type AS name, event_id AS step, round(value / lag(value) OVER (PARTITION BY event_type ORDER BY event_id), 9) AS ratio FROM events WHERE value > 0")
def _(spark, d):
    w = W.partitionBy("event_type").orderBy("event_id")
    return T(spark, d, "events").where("value > 0").select(F.col("event_type").alias("name"), F.col("event_id").alias("step"), F.round(F.col("value") / F.lag("value").over(w), 9).alias("ratio"))


@query("token_distributions", "WITH l AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings), p AS (SELECT *, exp(x) / sum(exp(x)) OVER (PARTITION BY label) AS p, rank() OVER (PARTITION BY label ORDER BY x DESC) AS rk, row_number() OVER (PARTITION BY label ORDER BY x DESC, vec_id) AS rn FROM l) SELECT label, vec_id, rk <= 5 AS in_top_k, rn = 1 OR sum(p) OVER (PARTITION BY label ORDER BY rn ROWS UNBOUNDED PRECEDING) <= 0.9 AS in_nucleus, rn = 1 AS greedy FROM p")
def _(spark, d):
    """Top-k with ties, the nucleus, and the greedy choice, of logits by group."""
    x = T(spark, d, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("x"))
    by = W.partitionBy("label")
    p = x.withColumn("p", F.exp("x") / F.sum(F.exp("x")).over(by)).withColumn("rn", F.row_number().over(by.orderBy(F.col("x").desc(), "vec_id")))
    cum = F.sum("p").over(by.orderBy("rn").rowsBetween(W.unboundedPreceding, 0))
    return p.select("label", "vec_id", (F.rank().over(by.orderBy(F.col("x").desc())) <= 5).alias("in_top_k"), ((F.col("rn") == 1) | (cum <= 0.9)).alias("in_nucleus"), (F.col("rn") == 1).alias("greedy"))




@query("interval_bytes", "SELECT o_orderkey // 1000 AS chunk, count(*) AS steps, CAST(sum(o_custkey * 4) AS BIGINT) AS bytes FROM orders GROUP BY 1")
def _(spark, d):
    return T(spark, d, "orders").groupBy(F.expr("o_orderkey div 1000").alias("chunk")).agg(F.count("*").alias("steps"), F.sum(F.col("o_custkey") * 4).alias("bytes"))


@query("moments_by_parameter", "SELECT p.p_partkey, p.p_name, s.s_acctbal AS moment, s.s_suppkey IS NULL AS untouched FROM part p LEFT JOIN supplier s ON s.s_suppkey = p.p_partkey * 2")
def _(spark, d):
    """Each parameter with its moment; one that has none is null, which is not zero."""
    moments = T(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("moment"))
    return T(spark, d, "part").join(moments, F.col("s_suppkey") == F.col("p_partkey") * 2, "left").select("p_partkey", "p_name", "moment", F.col("s_suppkey").isNull().alias("untouched"))


@query("tokens_per_second", "SELECT event_id // 100 AS block, round(count(*) * 4096 / greatest(epoch(max(ts)) - epoch(min(ts)), 1e-9), 4) AS tokens_per_sec FROM events GROUP BY 1")
def _(spark, d):
    at = F.col("ts").cast("timestamp").cast("double")
    return T(spark, d, "events").groupBy(F.expr("event_id div 100").alias("block")).agg(F.round(F.count("*") * 4096 / F.greatest(F.max(at) - F.min(at), F.lit(1e-9)), 4).alias("tokens_per_sec"))


@query("metrics_long", "SELECT event_id AS step, 'value' AS key, value FROM events WHERE value IS NOT NULL UNION ALL SELECT event_id, 'user', CAST(user_id AS DOUBLE) FROM events WHERE user_id % 3 <> 0")
def _(spark, d):
    from tessera.sources.runs import metrics_long

    log = T(spark, d, "events").select(F.col("event_id").alias("step"), "value", F.when(F.col("user_id") % 3 != 0, F.col("user_id").cast("double")).alias("user"))
    return metrics_long(log)
