"""Packing, the step-to-document map, and questions to it."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from tessera.catalog import query
from tessera.functions import arrays as A, schedules as S
from tessera.operators import order as O, packing as P, sampling
from tessera.operators.stream import CanonicalStream, Position
from tessera.plans.corpus import SIZED, manifest, sized, worded
from tessera.session import table as T
from tessera.sources import shared

SEQ, MICRO, WORLD, MICROBATCHES = 256, 4, 4, 6
WINDOW, PER_STEP = SEQ + 1, MICRO * MICROBATCHES

PLACED = f"{SIZED}, placed AS (SELECT *, CAST(coalesce(sum(n_tokens + 1) OVER (ORDER BY source, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM sized WHERE n_tokens > 0)"
SPANS = f"{PLACED}, spans AS (SELECT *, CAST(greatest(g * {WINDOW} - s, 0) AS INTEGER) AS tok_start, CAST(least((g + 1) * {WINDOW} - s, n_tokens) AS INTEGER) AS tok_end FROM (SELECT *, unnest(range(s // {WINDOW}, (s + n_tokens - 1) // {WINDOW} + 1)) AS g FROM placed))"
MAP = f"{SPANS}, map AS (SELECT CAST(g // {PER_STEP} AS INTEGER) AS step, g AS global_window, CAST(g % {PER_STEP} // {MICRO} AS INTEGER) AS microbatch, CAST(g % {PER_STEP} % {MICRO} AS SMALLINT) AS slot, CAST(row_number() OVER (PARTITION BY g ORDER BY s) - 1 AS SMALLINT) AS frag_idx, CAST(g % {PER_STEP} // {MICRO} % {WORLD} AS SMALLINT) AS dp_rank, source, shard_id, local_doc, tok_start, tok_end FROM spans)"


def placed(spark, d):
    """Documents with tokens, in stream order, with where each begins."""
    docs = worded(spark, d).withColumn("b", F.expr("doc_id div 4096")).withColumn("w", F.col("n_tokens") + 1)
    return O.prefix_sum(docs, ["source", "b"], ["doc_id"], "w", "stream_start").drop("b", "w")


def fragments(spark, d):
    return P.spans(placed(spark, d), WINDOW)


def mapped(spark, d):
    return P.doc_map(fragments(spark, d), PER_STEP, MICRO, WORLD, ["stream_start"])


@query("doc_map", f"WITH {MAP} SELECT * FROM map")
def _(spark, d):
    return mapped(spark, d)


#: Batches of 2, 3 and 5 micro-batches; the second begins at 8,000 consumed tokens, the third at 24,000.
PHASED = S.Phases(2 * MICRO * SEQ, 3 * MICRO * SEQ, 5 * MICRO * SEQ, 8_000, 24_000)
UNIT = MICRO * SEQ
WALK = f"most AS MATERIALIZED (SELECT max(g) AS g FROM spans), plan AS (SELECT 0 AS step, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS w, 2 AS m UNION ALL SELECT step + 1, c + m * {UNIT}, w + m * {MICRO}, CASE WHEN c + m * {UNIT} < 8000 THEN 2 WHEN c + m * {UNIT} < 24000 THEN 3 ELSE 5 END FROM plan, most WHERE w + m * {MICRO} <= most.g)"


@query("doc_map_phased", f"WITH RECURSIVE {SPANS}, {WALK} SELECT p.step, s.g AS global_window, CAST((s.g - p.w) // {MICRO} AS INTEGER) AS microbatch, CAST((s.g - p.w) % {MICRO} AS SMALLINT) AS slot, CAST(row_number() OVER (PARTITION BY s.g ORDER BY s.s) - 1 AS SMALLINT) AS frag_idx, CAST((s.g - p.w) // {MICRO} % {WORLD} AS SMALLINT) AS dp_rank, s.source, s.shard_id, s.local_doc, s.tok_start, s.tok_end FROM spans s JOIN plan p ON s.g >= p.w AND s.g < p.w + p.m * {MICRO}")
def _(spark, d):
    """The step-to-document map of a run that crosses two boundaries of its batch size."""
    return P.phased_doc_map(fragments(spark, d), P.plan_pieces(PHASED, MICRO, SEQ, 1 << 60), MICRO, WORLD, ["stream_start"])


@query("pack_spans", f"WITH {SPANS} SELECT doc_id, g AS global_window, tok_start, tok_end FROM spans")
def _(spark, d):
    return fragments(spark, d).select("doc_id", "global_window", "tok_start", "tok_end")


@query("window_fill_check", f"WITH {SPANS} SELECT g AS global_window, CAST(sum(tok_end - tok_start) + count(*) FILTER (WHERE s + n_tokens >= g * {WINDOW} AND s + n_tokens < (g + 1) * {WINDOW}) AS BIGINT) AS filled FROM spans GROUP BY g")
def _(spark, d):
    """Tokens and end tokens of each window, of the fragments in it: all but the last and those that begin with an end token hold a whole window."""
    end = F.col("stream_start") + F.col("n_tokens")
    inside = (end >= F.col("global_window") * WINDOW) & (end < (F.col("global_window") + 1) * WINDOW)
    return fragments(spark, d).groupBy("global_window").agg((F.sum(F.col("tok_end") - F.col("tok_start")) + F.count_if(inside)).alias("filled"))


@query("doc_map_summary", f"WITH {MAP} SELECT source, count(*) AS fragments, count(DISTINCT global_window) AS windows, count(DISTINCT step) AS steps, CAST(sum(tok_end - tok_start) AS BIGINT) AS tokens FROM map GROUP BY source")
def _(spark, d):
    return mapped(spark, d).groupBy("source").agg(F.count("*").alias("fragments"), F.countDistinct("global_window").alias("windows"), F.countDistinct("step").alias("steps"), F.sum(F.col("tok_end") - F.col("tok_start")).cast("bigint").alias("tokens"))


@query("doc_map_chunks", f"WITH {MAP} SELECT step // 4 AS chunk, count(*) AS n, min(step) AS first_step, max(step) AS last_step FROM map GROUP BY step // 4")
def _(spark, d):
    return mapped(spark, d).withColumn("chunk", F.expr("cast(step div 4 as int)")).groupBy("chunk").agg(F.count("*").alias("n"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))


@query("owned_fragments", f"WITH {MAP} SELECT global_window, frag_idx, source, shard_id, local_doc, tok_start, tok_end FROM map WHERE dp_rank = 1")
def _(spark, d):
    frag = F.row_number().over(W.partitionBy("global_window").orderBy("stream_start")) - 1
    return P.owned_only(fragments(spark, d), 1, WORLD, MICRO, PER_STEP).withColumn("frag_idx", frag.cast("smallint")).select("global_window", "frag_idx", "source", "shard_id", "local_doc", "tok_start", "tok_end")


@query("shift_labels", r"SELECT doc_id, w[1:-2] AS input_ids, w[2:] AS labels FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+'), lambda x: CAST(length(x) AS INTEGER)) AS w FROM documents) WHERE len(w) >= 2")
def _(spark, d):
    t = F.btrim("text", F.lit(" \t\n\x0b\f\r"))
    w = T(spark, d, "documents").select("doc_id", F.transform(F.split(t, r"[\x20\x09-\x0D]+"), lambda x: F.length(x)).alias("w")).where(F.size("w") >= 2)
    return w.select("doc_id", A.inputs_and_labels(F.col("w")).alias("x")).select("doc_id", "x.*")


@query("window_position", f"WITH {SPANS} SELECT DISTINCT g AS global_window, g % {PER_STEP} // {MICRO} AS microbatch, g % {PER_STEP} % {MICRO} AS slot, g % {PER_STEP} // {MICRO} % {WORLD} AS rank FROM spans")
def _(spark, d):
    """Where in its step each window of the documents lies."""
    g = F.col("global_window")
    base = F.call_function("div", g, F.lit(PER_STEP).cast("bigint")) * PER_STEP
    at = S.window_position(g, base, F.lit(MICROBATCHES).cast("bigint"), MICRO)
    return fragments(spark, d).select("global_window").distinct().select("global_window", at.alias("p")).select("global_window", "p.microbatch", "p.slot", S.owner_rank(F.col("p.microbatch"), WORLD).alias("rank"))


@query("accum_for_rank", "SELECT o_orderkey, m AS microbatches, r AS rank, len([x for x in range(m) if x % 5 = r]) AS n FROM (SELECT o_orderkey, o_orderkey % 23 + 1 AS m, o_custkey % 5 AS r FROM orders)")
def _(spark, d):
    """The micro-batches of a step that a rank owns, for the steps and ranks that the orders stand for."""
    o = T(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 23 + 1).alias("microbatches"), (F.col("o_custkey") % 5).alias("rank"))
    return o.select("*", S.accumulation(F.col("microbatches"), F.col("rank"), 5).alias("n"))


@query("join_stepdocs_documents", f"WITH {MAP} SELECT m.step, m.global_window, m.frag_idx, d.doc_id, d.lang, m.tok_end - m.tok_start AS n FROM map m JOIN documents d ON d.source = m.source AND d.doc_id // 50 = m.shard_id AND d.doc_id % 50 = m.local_doc")
def _(spark, d):
    docs = T(spark, d, "documents").select("doc_id", "lang", "source", F.expr("cast(doc_id div 50 as int)").alias("shard_id"), F.expr("cast(doc_id % 50 as int)").alias("local_doc"))
    return mapped(spark, d).join(docs, ["source", "shard_id", "local_doc"]).select("step", "global_window", "frag_idx", "doc_id", "lang", (F.col("tok_end") - F.col("tok_start")).alias("n"))


@query("touched_shards", f"WITH {MAP} SELECT source, list(DISTINCT shard_id ORDER BY shard_id) AS shards FROM map WHERE step BETWEEN 3 AND 9 GROUP BY source")
def _(spark, d):
    return mapped(spark, d).where("step between 3 and 9").groupBy("source").agg(F.sort_array(F.collect_set("shard_id")).alias("shards"))


@query("download_list", f"WITH {MAP} SELECT source, shard_id, CAST(sum(n_tokens) AS BIGINT) * 4 AS bytes FROM sized s WHERE EXISTS (SELECT 1 FROM map m WHERE m.source = s.source AND m.shard_id = s.shard_id AND m.step BETWEEN 3 AND 9) GROUP BY ALL")
def _(spark, d):
    touched = mapped(spark, d).where("step between 3 and 9").select("source", "shard_id")
    return manifest(spark, d).join(touched, ["source", "shard_id"], "left_semi").select("source", "shard_id", (F.col("token_count") * 4).alias("bytes"))


@query("untouched_shards", f"WITH {MAP} SELECT DISTINCT source, shard_id FROM sized s WHERE NOT EXISTS (SELECT 1 FROM map m WHERE m.source = s.source AND m.shard_id = s.shard_id AND m.step BETWEEN 3 AND 9)")
def _(spark, d):
    touched = mapped(spark, d).where("step between 3 and 9").select("source", "shard_id")
    return manifest(spark, d).join(touched, ["source", "shard_id"], "left_anti").select("source", "shard_id")


@query("existing_outputs_skipped", f"WITH {SIZED} SELECT DISTINCT source, shard_id FROM sized EXCEPT SELECT source, shard_id FROM sized WHERE shard_id % 3 = 0")
def _(spark, d):
    shards = sized(spark, d).select("source", "shard_id")
    return shards.distinct().join(shards.where("shard_id % 3 = 0"), ["source", "shard_id"], "left_anti")


@query("limit_shards", f"WITH {SIZED} SELECT source, shard_id, count(*) AS n FROM sized WHERE shard_id < 3 GROUP BY ALL")
def _(spark, d):
    return sized(spark, d).where("shard_id < 3").groupBy("source", "shard_id").agg(F.count("*").alias("n"))


@query("duplicate_outputs", f"WITH {SIZED} SELECT source, local_doc, count(DISTINCT shard_id) AS shards FROM sized GROUP BY source, local_doc HAVING count(DISTINCT shard_id) > 1")
def _(spark, d):
    return sized(spark, d).groupBy("source", "local_doc").agg(F.countDistinct("shard_id").alias("shards")).where("shards > 1")


@query("compare_position", "WITH a AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY source), b AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' AND source <> 'src3' AND doc_id % 97 <> 1 GROUP BY source) SELECT coalesce(a.source, b.source) AS source, a.n AS walked, b.n AS stored FROM a FULL JOIN b ON a.source = b.source WHERE a.n IS DISTINCT FROM b.n")
def _(spark, d):
    en = T(spark, d, "documents").where("lang = 'en'")
    a = en.groupBy("source").agg(F.count("*").alias("walked"))
    b = en.where("source <> 'src3' and doc_id % 97 <> 1").groupBy("source").agg(F.count("*").alias("stored"))
    return a.join(b, "source", "full_outer").where(~F.col("walked").eqNullSafe(F.col("stored"))).select("source", "walked", "stored")


@query("interval_refs", f"WITH {PLACED} SELECT DISTINCT source, shard_id, local_doc FROM placed WHERE s < {10 * PER_STEP * WINDOW} AND s + n_tokens + 1 > {4 * PER_STEP * WINDOW}")
def _(spark, d):
    """Documents drawn for steps 4 to 9, a document that is cut by the end among them."""
    s = F.col("stream_start")
    return placed(spark, d).where((s < 10 * PER_STEP * WINDOW) & (s + F.col("n_tokens") + 1 > 4 * PER_STEP * WINDOW)).select("source", "shard_id", "local_doc").distinct()


@query("span_ref_equality", f"WITH {SPANS} SELECT count(*) AS only_one_side FROM ((SELECT DISTINCT doc_id FROM spans EXCEPT SELECT doc_id FROM placed) UNION ALL (SELECT doc_id FROM placed EXCEPT SELECT doc_id FROM spans))")
def _(spark, d):
    a, b = fragments(spark, d).select("doc_id").distinct(), placed(spark, d).select("doc_id")
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg(F.count("*").alias("only_one_side"))


@query("cumulative_docs", f"WITH {SIZED}, c AS (SELECT source, shard_id, count(*) AS n FROM sized GROUP BY ALL) SELECT source, shard_id, CAST(coalesce(sum(n) OVER (PARTITION BY source ORDER BY shard_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum FROM c")
def _(spark, d):
    return cumulative(spark, d).select("source", "shard_id", "cum")


def cumulative(spark, d):
    w = W.partitionBy("source").orderBy("shard_id")
    upto = F.sum("num_documents").over(w.rowsBetween(W.unboundedPreceding, 0))
    return manifest(spark, d).select("source", "shard_id", (upto - F.col("num_documents")).alias("cum"), upto.alias("next_cum"))


@query("global_doc_to_shard_asof", f"WITH {SIZED}, c AS (SELECT source, shard_id, count(*) AS n FROM sized GROUP BY ALL), m AS (SELECT source, shard_id, coalesce(sum(n) OVER (PARTITION BY source ORDER BY shard_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM c), q AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS global_doc FROM sized) SELECT q.source, q.global_doc, m.shard_id, CAST(q.global_doc - m.cum AS BIGINT) AS local_doc FROM q ASOF JOIN m ON q.source = m.source AND q.global_doc >= m.cum")
def _(spark, d):
    docs = sized(spark, d).select("source", (F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1).cast("bigint").alias("global_doc"))
    return sampling.resolve(docs, cumulative(spark, d))


@query("epoch_wrap", "WITH e AS (SELECT event_id AS draw, event_type AS source FROM events), o AS (SELECT draw, source, row_number() OVER (PARTITION BY source ORDER BY draw) - 1 AS ordinal FROM e) SELECT draw, source, ordinal, CAST(ordinal // 700 AS INTEGER) AS epoch, ordinal % 700 AS perm_pos FROM o")
def _(spark, d):
    draws = T(spark, d, "events").select(F.col("event_id").alias("draw"), F.col("event_type").alias("source"))
    sizes = draws.select("source").distinct().withColumn("n_docs", F.lit(700).cast("bigint"))
    return sampling.with_positions(draws, sizes).select("draw", "source", "ordinal", "epoch", "perm_pos")


@query("rank_stride", "SELECT doc_id % 8 AS rank, count(*) AS per_epoch, min(doc_id) AS first_pos, max(doc_id) AS last_pos FROM documents GROUP BY 1")
def _(spark, d):
    """The documents of each of eight ranks, by their stride."""
    return T(spark, d, "documents").groupBy(F.pmod("doc_id", F.lit(8)).alias("rank")).agg(F.count("*").alias("per_epoch"), F.min("doc_id").alias("first_pos"), F.max("doc_id").alias("last_pos"))


@query("source_draws")
def _(spark, d):
    """As many draws as there are documents, over the sources by their token shares."""
    s, _ = stream(spark, d)
    return sampling.source_draws(spark, list(s.shards), s.weights, 42, 0, sum(s.sizes.values()))


@query("epoch_permutation")
def _(spark, d):
    """The second epoch's order of every source."""
    s, _ = stream(spark, d)
    return sampling.permutations(spark, s.shards, 42, [(x, 1) for x in s.shards])


@query("canonical_stream")
def _(spark, d):
    """As many draws as there are documents, resolved to them."""
    s, _ = stream(spark, d)
    return s.draws(Position(), sum(s.sizes.values())).select("draw", "source", "epoch", "global_doc")


@query("resume_equals_continuous", "SELECT CAST(0 AS BIGINT) AS differences")
def _(spark, d):
    """Draws from a saved position, against those of the stream from its beginning."""
    s, windows = stream(spark, d)
    at, last = s.position(windows // 2), sum(s.sizes.values())
    a, b = s.draws(at, last), s.draws(Position(), last).where(F.col("draw") >= at.draws)
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg(F.count("*").alias("differences"))


def stream(spark, d):
    """A canonical stream over the table's sources by their token shares, their documents in shards of five, and the windows its tokens fill."""
    at = shared.cut(worded(spark, d).select("source", "doc_id", "n_tokens"))  # texts are read and counted once
    numbered = O.prefix_sum(at.withColumn("b", F.expr("doc_id div 4096")).withColumn("one", F.lit(1)), ["b"], ["doc_id"], "one", "global_doc", group=["source"])
    lengths = shared.cut(numbered.select("source", "global_doc", "n_tokens"))
    told = {r["source"]: r for r in lengths.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")).collect()}
    shards = {s: [5] * (r["docs"] // 5) + ([r["docs"] % 5] if r["docs"] % 5 else []) for s, r in sorted(told.items())}
    total = sum(r["tokens"] for r in told.values())
    windows = (total + sum(r["docs"] for r in told.values())) // (SEQ + 1)
    return CanonicalStream(spark, lengths, shards, [told[s]["tokens"] / total for s in shards], SEQ, 7), windows


@query("stream_spans")
def _(spark, d):
    s, windows = stream(spark, d)
    return s.spans(windows)


@query("stream_resume", "SELECT CAST(0 AS BIGINT) AS differences")
def _(spark, d):
    """Spans of the later windows after a resume, against the continuous stream's: those of documents drawn since."""
    s, windows = stream(spark, d)
    first = windows * 3 // 8
    at = s.position(first)
    a, b = s.spans(windows - first, at), s.spans(windows).where((F.col("global_window") >= first) & (F.col("draw") >= at.draws))
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg(F.count("*").alias("differences"))


@query("stream_refs")
def _(spark, d):
    s, windows = stream(spark, d)
    return s.refs(windows)
