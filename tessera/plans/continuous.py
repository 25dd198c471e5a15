"""Ordered totals over rows, per-rank streams, pulls, byte ranges and counter-based draws over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.operators import draws, order as O, sampling
from tessera.operators.ranks import RankStream
from tessera.operators.tree import tree_total
from tessera.plans.corpus import SIZED
from tessera.plans.lineage import SEQ
from tessera.session import table as T, table_stream
from tessera.sources import mirror, pullers, shared, text as S
from tessera.streaming import logs, pull as P

WORLD = 8


@query(
    "tree_total",
    """WITH RECURSIVE p AS (SELECT l_returnflag AS f, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_extendedprice) - 1 AS i, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem),
 c AS (SELECT f, count(*) AS n FROM p GROUP BY f),
 t(f, level, i, v) AS (SELECT f, 0, i, v FROM p UNION ALL SELECT a.f, a.level + 1, a.i // 2, a.v + b.v FROM t a JOIN t b ON a.f = b.f AND b.i = a.i + 1 WHERE a.i % 2 = 0),
 r AS (SELECT t.f, level, v FROM t JOIN c ON t.f = c.f WHERE i = (n >> level) - 1 AND (n >> level) % 2 = 1)
SELECT r.f AS l_returnflag, any_value(n) AS n, list_reduce(list(v ORDER BY level DESC), lambda x, y: x + y) AS total FROM r JOIN c ON r.f = c.f GROUP BY r.f""",
)
def _(spark, d):
    """The prices of each return flag, summed in the order of their keys by aligned pairs."""
    rows = T(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice", F.expr("l_orderkey div 4096").alias("b"), F.lit(1).alias("one"))
    at = O.prefix_sum(rows, ["b"], ["l_orderkey", "l_linenumber", "l_extendedprice"], "one", "pos", group=["l_returnflag"])
    return tree_total(at, "pos", "l_extendedprice", ["l_returnflag"])


def rank_stream(spark, d):
    """Eight ranks' stream over the table's sources by their token shares, documents in shards of five; and the windows a rank's share fills."""
    from tessera.plans.lineage import stream

    whole, windows = stream(spark, d)
    return RankStream(spark, whole.lengths, whole.shards, whole.weights, SEQ, 7, WORLD), max(2, windows // WORLD)


@query("per_rank_epoch", f"WITH {SIZED}, n AS (SELECT source, count(*) AS n, sum(n_tokens) AS tokens FROM sized WHERE n_tokens > 0 GROUP BY source) SELECT source, CAST(r AS INTEGER) AS rank, (n - r + {WORLD - 1}) // {WORLD} AS docs, CAST(tokens AS BIGINT) AS source_tokens FROM n, range({WORLD}) t(r)")
def _(spark, d):
    """The documents that each rank takes of an epoch, and the tokens that all ranks take of it together."""
    s, _ = rank_stream(spark, d)
    perm = sampling.permutations(spark, s.shards, s.seed, [(x, 0) for x in s.shards]).join(s.lengths, ["source", "global_doc"])
    of = perm.groupBy("source", (F.col("perm_pos") % WORLD).cast("int").alias("rank")).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("t"))
    tokens = of.groupBy("source").agg(F.sum("t").alias("source_tokens"))
    return of.join(tokens, "source").select("source", "rank", "docs", "source_tokens")


@query("per_rank_stream")
def _(spark, d):
    s, windows = rank_stream(spark, d)
    return s.spans(windows)


@query("per_rank_fill", f"WITH {SIZED}, t AS (SELECT sum(n_tokens + 1) // {SEQ + 1} AS w FROM sized WHERE n_tokens > 0) SELECT CAST(r AS INTEGER) AS rank, CAST(greatest(2, w // {WORLD}) AS BIGINT) AS windows, true AS whole FROM t, range({WORLD}) x(r)")
def _(spark, d):
    """Every rank's windows are there, and all but those with end tokens among them hold a whole window of a document's tokens or less."""
    s, windows = rank_stream(spark, d)
    per = s.spans(windows).groupBy("rank", "rank_window").agg(F.sum(F.col("tok_end") - F.col("tok_start")).alias("n"), F.count("*").alias("parts"))
    fits = (F.col("n") <= SEQ + 1) & (F.col("n") + F.col("parts") + 1 >= SEQ + 1)
    return per.groupBy("rank").agg(F.count("*").alias("windows"), F.bool_and(fits).alias("whole"))


@query("per_rank_resume", "SELECT CAST(0 AS BIGINT) AS differences")
def _(spark, d):
    """The later windows from the ranks' saved positions, against the continuous stream's: those of documents drawn since."""
    s, windows = rank_stream(spark, d)
    first = max(1, windows * 3 // 8)
    at = s.positions(first)
    begun = spark.createDataFrame([(r, p.draws) for r, p in at.items()], "rank int, begun bigint")
    a = s.spans(windows - first, at)
    b = s.spans(windows).join(begun, "rank").where((F.col("rank_window") >= first) & (F.col("draw") >= F.col("begun"))).select(a.columns)
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg(F.count("*").alias("differences"))


@query("pulled_documents", r"SELECT doc_id, source, n_chars FROM documents WHERE regexp_matches(coalesce(text, ''), '[^ \t\n\x0b\f\r]')")
def _(spark, d):
    """A pull of the table's files that is stopped after its first batch and goes on from its cursor: the kept rows, each once."""
    keep = F.coalesce(F.col("text").rlike(r"[^ \t\n\x0b\f\r]"), F.lit(False))
    path = shared.fresh(spark, "pull")
    P.pull(table_stream(spark, d, "documents", maxFilesPerTrigger=1), path, "table", keep, batches=1)
    P.pull(table_stream(spark, d, "documents", maxBytesPerTrigger=1 << 30), path, "table", keep)
    return P.rows(spark, path).select("doc_id", "source", "n_chars")


@query("byte_range_lines", "SELECT count(*) AS lines, CAST(sum(octet_length(encode(l)) + 1) AS BIGINT) AS bytes, true AS whole FROM (SELECT doc_id || ':' || coalesce(lang, '') || ':' || coalesce(source, '') AS l FROM documents)")
def _(spark, d):
    """Lines written as text files and read back by byte ranges: none is lost, and each file's lines end where the file ends."""
    path = shared.fresh(spark, "lines")
    T(spark, d, "documents").select(F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")))).write.text(path)
    at = S.placed_lines(spark, path)
    end = F.max(F.col("offset") + F.octet_length("line") + 1)
    per = at.groupBy("file", "size").agg(F.count("*").alias("n"), end.alias("end"), F.max("number").alias("last"))
    return per.agg(F.sum("n").alias("lines"), F.sum("end").alias("bytes"), F.bool_and((F.col("end") == F.col("size")) & (F.col("last") == F.col("n") - 1)).alias("whole"))


@query("multinomial_draws")
def _(spark, d):
    """An index drawn for each vector by the softmax of its components, whichever task it is in."""
    e = F.col("embedding").cast("array<double>")
    w = F.transform(e, lambda x: F.exp(x))
    rows = T(spark, d, "embeddings").where(F.size("embedding") > 0).withColumn("u", draws.uniform(F.col("vec_id"), 11))
    return rows.select("vec_id", "u", draws.multinomial(w, F.col("u")).alias("drawn"))


def mirrored(lines, path: str, most: int = 16 << 20) -> None:
    """``lines`` (part, line) as text files ``part=<part>/file=<number>/``, each of about ``most`` bytes: a file is read whole, by one task."""
    ways = lines.groupBy("part").agg(F.ceil(F.sum(F.octet_length("line") + 1) / most).cast("int").alias("ways"))
    dealt = lines.alias("l").join(F.broadcast(ways.alias("w")), F.col("l.part").eqNullSafe(F.col("w.part"))).select("l.part", (F.rand(11) * F.col("ways")).cast("int").alias("file"), "line")
    dealt.repartition("part", "file").write.partitionBy("part", "file").text(path)


@query("verified_mirror", "SELECT 'part-' || (page_id % 8) AS name, count(*) AS pages, CAST(sum(octet_length(encode(coalesce(html, '')))) AS BIGINT) AS bytes FROM pages GROUP BY 1")
def _(spark, d):
    """Pages in eight folders of a mirror, in files of bounded size, each read against the digest that was noted when it was written."""
    path = shared.fresh(spark, "mirror")
    pages = T(spark, d, "pages").select(F.concat(F.lit("part-"), (F.col("page_id") % 8).cast("string")).alias("part"), F.coalesce("html", F.lit("")).alias("html"))
    mirrored(pages.select("part", F.hex(F.encode("html", "UTF-8")).alias("line")), path)
    files = mirror.binary(spark, [path])
    name = F.regexp_extract("path", r"(part=[^/]*/file=[^/]*/[^/]*)$", 1)
    manifest = shared.cut(files.select(name.alias("name"), F.sha2("content", 256).alias("digest")))
    got = mirror.verified(spark, path, manifest)
    lines = F.split(F.col("content").cast("string"), "\n")  # each has its end, so nothing is behind the last
    part = F.nullif(F.regexp_extract("name", "part=([^/]*)", 1), F.lit("__HIVE_DEFAULT_PARTITION__"))
    back = got.select(part.alias("name"), F.explode(F.slice(lines, 1, F.size(lines) - 1)).alias("line"))
    return back.groupBy("name").agg(F.count("*").alias("pages"), F.sum(F.octet_length(F.unhex("line"))).alias("bytes"))


@query("observed_map", "SELECT count(*) AS rows, CAST(sum(o_custkey) AS BIGINT) AS keys, true AS same FROM orders")
def _(spark, d):
    """What is counted while a table is written, beside what is there afterwards."""
    path = shared.fresh(spark, "orders")
    told = P.written(T(spark, d, "orders").select("o_orderkey", "o_custkey"), path, rows=F.count("*"), keys=F.coalesce(F.sum("o_custkey"), F.lit(0)))
    there = spark.read.parquet(path).agg(F.count("*").alias("rows"), F.coalesce(F.sum("o_custkey"), F.lit(0)).alias("keys"))
    return there.withColumn("same", (F.col("rows") == told["rows"]) & (F.col("keys") == told["keys"]))


@query("logged_metrics", "SELECT event_id AS step, event_type AS kind, value FROM events")
def _(spark, d):
    """A stream of metrics to JSON lines, whose newest batch is then written again as after a crash: each record is there once."""
    stream = table_stream(spark, d, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("kind"), "value")
    path = shared.fresh(spark, "metrics")
    for _ in range(2):
        logs.lines(stream, path, "a").trigger(availableNow=True).start().awaitTermination()
        shared.delete(spark, f"{path}/_checkpoints/a/commits/0")
    return logs.records(spark, path, "step bigint, kind string, value double").select("step", "kind", "value")


@query("grad_norm_log", "SELECT CAST(event_id // 10 AS BIGINT) AS step, round_even(sqrt(sum(value * value)), 6) AS whole, count(DISTINCT event_type) AS categories, count(DISTINCT user_id % 4) AS layers, least(count(*), 3) AS top FROM events GROUP BY event_id // 10")
def _(spark, d):
    """The gradient log's lines, read back."""
    e = T(spark, d, "events")
    rows = e.select(F.expr("event_id div 10").alias("step"), F.col("event_id").alias("consumed_tokens"), F.col("event_id").cast("string").alias("name"), (F.col("event_id") % 10).alias("ordinal"), F.col("event_type").alias("category"), (F.col("user_id") % 4).alias("layer"), F.col("value").alias("norm"))
    got = logs.norm_records(rows, 3).select(F.from_json("line", "step bigint, global double, by_category map<string,double>, by_layer map<string,double>, top array<array<string>>").alias("r"))
    return got.select("r.step", F.col("r.global").alias("whole"), F.size("r.by_category").cast("bigint").alias("categories"), F.size("r.by_layer").cast("bigint").alias("layers"), F.size("r.top").cast("bigint").alias("top"))


@query("pulled_by_sql", "WITH q AS (SELECT source, count(*) // 3 + 1 AS n FROM documents GROUP BY source), r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) SELECT r.source, doc_id, n_chars FROM r JOIN q ON r.source = q.source WHERE k <= n")
def _(spark, d):
    """A third of each source by a table function in SQL, joined to the quotas."""
    docs = T(spark, d, "documents")
    pullers.register("pull_documents", docs, "source", "doc_id", ["doc_id", "n_chars"])
    docs.groupBy("source").agg(F.expr("count(*) div 3 + 1").alias("n")).createOrReplaceTempView("pull_quotas")
    return spark.sql("SELECT q.source, p.doc_id, p.n_chars FROM pull_quotas q, LATERAL pull_documents(q.source, q.n) p")
