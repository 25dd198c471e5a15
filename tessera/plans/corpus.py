"""Scans, filters, limits, manifests, shards: building a corpus."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from tessera.catalog import query
from tessera.functions import text as X
from tessera.functions.registry import bpe_decoder, bpe_encoder
from tessera.operators import order as O
from tessera.operators import sampling
from tessera.session import table as T
from tessera.sources import idx, manifests, text as S

#: DuckDB's spelling of the white-space token count.
NT = r"CAST(len(regexp_extract_all(coalesce(text,''), '[^ \t\n\x0b\f\r]+')) AS BIGINT)"
SIZED = f"sized AS (SELECT doc_id, source, CAST(doc_id // 50 AS INTEGER) AS shard_id, CAST(doc_id % 50 AS INTEGER) AS local_doc, {NT} AS n_tokens FROM documents)"


def sized(spark, d, keep=None):
    """(doc_id, source, shard_id, local_doc, n_tokens) of the documents table."""
    docs = T(spark, d, "documents")
    docs = docs if keep is None else docs.where(keep)
    return docs.select("doc_id", "source", F.expr("cast(doc_id div 50 as int)").alias("shard_id"), F.expr("cast(doc_id % 50 as int)").alias("local_doc"), X.n_tokens(F.col("text")).alias("n_tokens"))


def worded(spark, d):
    """``sized`` of the documents with tokens, which a text's first word tells without counting the others."""
    return sized(spark, d, X.has_token(F.col("text")))


@query("scan_text_nonempty", "SELECT doc_id, text FROM documents WHERE length(text) > 0")
def _(spark, d):
    return T(spark, d, "documents").where(X.non_empty(F.col("text"))).select("doc_id", "text")


@query("scan_parquet_text", "SELECT text FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return S.parquet_text(spark, f"{d}/documents.parquet")


@query("filter_threshold_missing_zero", "SELECT d.doc_id, coalesce(l.quality, 0) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality, 0) >= 1")
def _(spark, d):
    q = F.coalesce("quality", F.lit(0))
    return T(spark, d, "documents").select("doc_id").join(T(spark, d, "labels"), "doc_id", "left").where(q >= 1).select("doc_id", q.alias("quality"))


@query("filter_multi_predicate", "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND source <> '' AND coalesce(n_chars, 0) <= 2000")
def _(spark, d):
    return T(spark, d, "documents").where((F.col("lang") == "en") & (F.col("source") != "") & (F.coalesce("n_chars", F.lit(0)) <= 2000)).select("doc_id", "n_chars")


BLANK = r"'^[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*$'"


@query("whitespace_only_drop", f"SELECT count(*) FILTER (WHERE text IS NULL) AS failed, count(*) FILTER (WHERE regexp_matches(text, {BLANK})) AS blank, count(*) FILTER (WHERE NOT regexp_matches(text, {BLANK})) AS kept FROM documents")
def _(spark, d):
    t = F.col("text")
    return T(spark, d, "documents").agg(F.count_if(t.isNull()).alias("failed"), F.count_if(t.isNotNull() & X.blank(t)).alias("blank"), F.count_if(~X.blank(t)).alias("kept"))


@query("eval_split_exclusion", r"SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '(?i)(?:^|[_./\-])(test|valid|validation|dev)(?:[_./\-]|$)')")
def _(spark, d):
    return T(spark, d, "pages").where(~X.is_eval_split(F.col("url"))).select("page_id", "url")


@query("ordered_limit", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE lang = 'en') WHERE r <= 100")
def _(spark, d):
    return O.ordered_limit(T(spark, d, "documents").select("doc_id", "lang"), F.col("lang") == "en", ["doc_id"], 100)


@query("limit_by_weight", """WITH w AS (SELECT * FROM (VALUES (0,'src0',0.5),(1,'src1',0.3),(2,'src2',0.2)) t(ordinal, source, weight)),
 s AS (SELECT source, CASE WHEN ordinal = 2 THEN 101 - coalesce(sum(CAST(floor(101*weight) AS BIGINT)) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) ELSE CAST(floor(101*weight) AS BIGINT) END AS share FROM w),
 r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) SELECT doc_id, source, CAST(share AS BIGINT) AS share FROM r JOIN s USING (source) WHERE k <= share""")
def _(spark, d):
    w = spark.createDataFrame([(0, "src0", 0.5), (1, "src1", 0.3), (2, "src2", 0.2)], "ordinal int, source string, weight double")
    share = O.split_by_weight(w, 101).select("source", "share")
    docs = T(spark, d, "documents").select("doc_id", "source").join(F.broadcast(share), "source")
    return O.first_per_group(docs, ["source"], [F.col("doc_id")], F.col("share")).select("doc_id", "source", "share")


@query("worker_quota", "SELECT source, CAST(k AS INTEGER) AS worker, CAST(CASE WHEN k = 6 THEN n - n // 7 * 6 ELSE n // 7 END AS BIGINT) AS quota FROM (SELECT source, count(*) AS n FROM documents GROUP BY source), range(7) t(k)")
def _(spark, d):
    """Each source's documents as quotas of seven workers."""
    n = T(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    rows = n.select("source", "n", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("worker"))
    return rows.select("source", "worker", O.worker_quota(F.col("n"), 7, F.col("worker")).alias("quota"))


@query("worker_file_split", "SELECT page_id FROM (SELECT page_id, row_number() OVER (ORDER BY url, page_id) - 1 AS o FROM pages) WHERE o % 4 = 1")
def _(spark, d):
    pages = T(spark, d, "pages").select("page_id", "url").withColumn("ordinal", F.row_number().over(W.orderBy("url", "page_id")) - 1)
    return S.worker_files(pages, 4, 1).select("page_id")


@query("scan_counters", "SELECT source, count(*) AS scanned, count(*) FILTER (WHERE coalesce(n_chars,0) >= 500) AS kept, count(*) FILTER (WHERE text IS NULL) AS failed FROM documents GROUP BY source")
def _(spark, d):
    return T(spark, d, "documents").groupBy("source").agg(F.count("*").alias("scanned"), F.count_if(F.coalesce("n_chars", F.lit(0)) >= 500).alias("kept"), F.count_if(F.col("text").isNull()).alias("failed"))


@query("blob_lookup", "SELECT p.page_id, d.n_chars, d.text IS NULL AS failed FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id * 3")
def _(spark, d):
    blobs = T(spark, d, "documents").select(F.col("doc_id").alias("blob_id"), "text", "n_chars")
    ids = T(spark, d, "pages").select("page_id", (F.col("page_id") * 3).alias("blob_id"))
    return S.fetched(ids, blobs).select("page_id", "n_chars", F.col("text").isNull().alias("failed"))


@query("byte_segments", "WITH l AS (SELECT doc_id, CAST(n_chars AS BIGINT) + 1 AS n FROM documents), o AS (SELECT doc_id, CAST(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS o, CAST((SELECT sum(n) FROM l) AS BIGINT) AS size FROM l) SELECT doc_id, k AS worker FROM o, (SELECT CAST(range AS INTEGER) AS k FROM range(8)) WHERE size*k//8 <= o AND o < size*(k+1)//8")
def _(spark, d):
    lines = T(spark, d, "documents").select("doc_id", F.expr("doc_id div 256").alias("b"), (F.col("n_chars") + 1).alias("n"))
    placed = O.prefix_sum(lines, ["b"], ["doc_id"], "n", "o").crossJoin(F.broadcast(lines.agg(F.sum("n").alias("size"))))
    return placed.select("doc_id", S.segment_of(F.col("o"), F.col("size"), 8).cast("int").alias("worker"))


@query("stable_name_hash", "SELECT DISTINCT source, CAST(('0x' || substr(sha256(source),1,8)) AS BIGINT) AS h FROM documents")
def _(spark, d):
    return T(spark, d, "documents").select("source").distinct().select("source", X.name_hash(F.col("source")).alias("h"))


@query("bytes_per_token", f"SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0.0 ELSE strlen(text) / greatest({NT}, 1) END, 6) AS ratio FROM documents")
def _(spark, d):
    t = F.col("text")
    return T(spark, d, "documents").select("doc_id", F.round(X.bytes_per_token(t, X.n_tokens(t)), 6).alias("ratio"))


@query("url_parts", r"SELECT page_id, regexp_extract(url, '[^/]*$') AS base, '/mirror/' || regexp_extract(url, '[^/]*$') AS rebased FROM pages")
def _(spark, d):
    u = F.col("url")
    return T(spark, d, "pages").select("page_id", X.base_name(u).alias("base"), X.rebased(u, "/mirror/").alias("rebased"))


@query("shard_names", "SELECT DISTINCT source || '.w01_' || lpad(CAST(doc_id // 50 AS VARCHAR), 5, '0') || '.bin' AS name FROM documents")
def _(spark, d):
    return T(spark, d, "documents").select(X.shard_file(F.col("source"), F.lit(".w01"), F.expr("doc_id div 50"), "bin").alias("name")).distinct()


def manifest(spark, d):
    """A row per shard, from the sized documents."""
    return sized(spark, d).groupBy("source", "shard_id").agg(F.count("*").alias("num_documents"), F.sum("n_tokens").alias("token_count"))


MANIFEST = f"{SIZED}, shards AS (SELECT source, shard_id, count(*) AS num_documents, CAST(sum(n_tokens) AS BIGINT) AS token_count FROM sized GROUP BY ALL), tot AS (SELECT source, CAST(sum(token_count) AS BIGINT) AS total_tokens, CAST(sum(num_documents) AS BIGINT) AS total_documents FROM shards GROUP BY source)"


@query("manifest_totals", f"WITH {MANIFEST} SELECT source, total_tokens, total_documents, round(total_tokens / greatest(total_documents, 1), 6) AS avg_tokens FROM tot")
def _(spark, d):
    return manifests.totals(manifest(spark, d)).withColumn("avg_tokens", F.round("avg_tokens", 6))


@query("token_share_weights", f"WITH {MANIFEST}, w AS (SELECT source, (CAST(substr(source, 4) AS INTEGER) % 3 + 1) / (total_tokens / greatest(total_documents, 1)) AS x FROM tot) SELECT source, round(x / (SELECT sum(x) FROM w), 9) AS p FROM w")
def _(spark, d):
    t = manifests.totals(manifest(spark, d)).withColumn("x", (F.expr("cast(substr(source, 4) as int) % 3") + 1) / F.col("avg_tokens"))
    return t.select("source", F.round(F.col("x") / F.sum("x").over(W.partitionBy()), 9).alias("p"))


@query("mix_summary", f"WITH {MANIFEST} SELECT source, total_tokens, round(100.0 * total_tokens / (SELECT sum(total_tokens) FROM tot), 6) AS percent FROM tot")
def _(spark, d):
    t = manifests.totals(manifest(spark, d))
    return t.select("source", "total_tokens", F.round(F.lit(100.0) * F.col("total_tokens") / F.sum("total_tokens").over(W.partitionBy()), 6).alias("percent"))


@query("merge_manifests", f"WITH {MANIFEST} SELECT source, list(token_count ORDER BY shard_id % 3, shard_id) AS shard_tokens FROM shards GROUP BY source")
def _(spark, d):
    by_worker = F.array_sort(F.collect_list(F.struct(F.expr("shard_id % 3").alias("w"), "shard_id", "token_count")))
    return manifest(spark, d).groupBy("source").agg(F.transform(by_worker, lambda x: x["token_count"]).alias("shard_tokens"))


@query("manifest_conflicts", "SELECT source AS file, count(DISTINCT lang) AS digests FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def _(spark, d):
    return manifests.conflicts(T(spark, d, "documents").select(F.col("source").alias("file"), F.col("lang").alias("digest")))


@query("manifest_agreement", "SELECT source, count(DISTINCT lang) = 1 AS agree FROM documents GROUP BY source")
def _(spark, d):
    return T(spark, d, "documents").groupBy("source").agg((F.countDistinct("lang") == 1).alias("agree"))


@query("shard_assignment", f"""WITH RECURSIVE {SIZED}, o AS (SELECT source, doc_id, n_tokens * 4 AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM sized),
 r AS (SELECT source, doc_id, k, 0 AS shard_id, b AS held FROM o WHERE k = 1 UNION ALL SELECT o.source, o.doc_id, o.k, r.shard_id + CASE WHEN r.held >= 20000 THEN 1 ELSE 0 END, o.b + CASE WHEN r.held >= 20000 THEN 0 ELSE r.held END FROM r JOIN o ON o.source = r.source AND o.k = r.k + 1)
 SELECT source, doc_id, CAST(shard_id AS INTEGER) AS shard_id FROM r""")
def _(spark, d):
    return O.greedy_shards(sized(spark, d).withColumn("bytes", F.col("n_tokens") * 4), 20000, "source", "doc_id", "bytes")


@query("idx_offsets", f"WITH {SIZED} SELECT source, shard_id, local_doc, CAST(coalesce(sum(n_tokens) OVER w, 0) AS BIGINT) AS doc_offset, CAST(4 * coalesce(sum(n_tokens) OVER w, 0) AS BIGINT) AS byte_offset FROM sized WINDOW w AS (PARTITION BY source, shard_id ORDER BY local_doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _(spark, d):
    w = W.partitionBy("source", "shard_id").orderBy("local_doc").rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum("n_tokens").over(w), F.lit(0))
    return sized(spark, d).select("source", "shard_id", "local_doc", at.alias("doc_offset"), (at * 4).alias("byte_offset"))


@query("idx_round_trip", r"""SELECT CAST(doc_id // 100 AS INTEGER) AS shard_id, CAST(row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1 AS INTEGER) AS local_doc, CAST(len(w) AS INTEGER) AS n_tokens, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS checksum FROM (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0b\f\r]+') AS w FROM documents)""")
def _(spark, d):
    """Shards of word lengths, written as .bin and .idx and read back by the source."""
    import os

    from tessera.sources import shared

    folder = shared.fresh(spark, "idx").removeprefix("file:")  # the shards' writer goes through the file system
    os.makedirs(folder, exist_ok=True)
    t = F.btrim("text", F.lit(X.SPACES))
    words = F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+"))
    docs = T(spark, d, "documents").select(F.expr("cast(doc_id div 100 as int)").alias("shard_id"), F.col("doc_id").alias("local_doc"), F.transform(words, lambda x: F.length(x)).alias("tokens"))
    told = idx.write_shards(docs, folder, "s").select("shard_id", "prefix").orderBy("shard_id").collect()
    got = idx.read_shards(spark, [f"{folder}/{r['prefix']}" for r in told])
    return got.select("shard_id", "local_doc", "n_tokens", F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("checksum"))


@query("bpe_encode_round_trip", "SELECT doc_id, true AS same FROM documents")
def _(spark, d):
    """Texts through the byte-level tokenizer and back."""
    import public_tokenizers

    from tessera.sources import shared

    path = public_tokenizers.path("byte_bpe_50k.json")
    shared.bounded(spark)
    ids = T(spark, d, "documents").select("doc_id", "text", bpe_encoder(path)("text").alias("ids"))
    return ids.select("doc_id", (bpe_decoder(path)("ids") == F.coalesce("text", F.lit(""))).alias("same"))


@query("pretoken_counts", r"SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')) AS w FROM documents) GROUP BY w HAVING count(*) >= 2")
def _(spark, d):
    t = F.btrim("text", F.lit(X.SPACES))
    words = T(spark, d, "documents").where(t != "").select(F.explode(F.split(t, r"[\x20\x09-\x0D]+")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")


@query("bucket_shuffle_multiset", f"SELECT text, count(*) AS n FROM documents WHERE NOT regexp_matches(text, {BLANK}) GROUP BY text")
def _(spark, d):
    rows = T(spark, d, "documents").select(F.col("doc_id").alias("pos"), "text")
    return sampling.bucket_shuffle(rows, 1, 8).groupBy("text").agg(F.count("*").alias("n"))


@query("bucket_shuffle_order")
def _(spark, d):
    rows = T(spark, d, "documents").select(F.col("doc_id").alias("pos"), "text")
    return sampling.bucket_shuffle(rows, 1, 8).select("out_bucket", "out_pos", "pos")


@query("round_robin_order", """WITH RECURSIVE f AS (SELECT source AS dir, lang AS file, row_number() OVER (PARTITION BY source ORDER BY lang) AS k FROM (SELECT DISTINCT source, lang FROM documents)),
 s AS (SELECT list(dir ORDER BY dir) AS active, map(list(dir ORDER BY dir), list(n ORDER BY dir)) AS m FROM (SELECT dir, count(*) AS n FROM f GROUP BY dir)),
 r(turn, rotated, m) AS (SELECT 0, active, m FROM s UNION ALL
   SELECT turn + 1, list_concat(n[((turn + 1) % len(n)) + 1 :], n[1 : (turn + 1) % len(n)]), m FROM (SELECT turn, m, list_filter(rotated, lambda x: m[x] >= turn + 2) AS n FROM r) WHERE len(n) > 0),
 w AS (SELECT turn, unnest(rotated) AS dir, generate_subscripts(rotated, 1) AS i FROM r)
 SELECT CAST(row_number() OVER (ORDER BY turn, i) - 1 AS BIGINT) AS work_idx, w.dir, f.file FROM w JOIN f ON f.dir = w.dir AND f.k = w.turn + 1""")
def _(spark, d):
    files = T(spark, d, "documents").select("source", "lang").distinct().groupBy("source").agg(F.sort_array(F.collect_list("lang")).alias("files")).orderBy("source")
    work = O.round_robin({r["source"]: r["files"] for r in files.collect()})
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(work)], "work_idx bigint, dir string, file string")


@query("longest_run", "WITH a AS (SELECT source, doc_id, lang, sum(CASE WHEN lang IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id) AS g FROM (SELECT *, lag(lang) OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents)) SELECT source, max(n) AS longest FROM (SELECT source, g, count(*) AS n FROM a GROUP BY ALL) GROUP BY source")
def _(spark, d):
    marked = O.runs(T(spark, d, "documents").select("source", "doc_id", "lang"), ["source"], "doc_id", F.col("lang"))
    return marked.groupBy("source", "run").count().groupBy("source").agg(F.max("count").alias("longest"))


@query("resume_floor", "WITH t AS (SELECT min(doc_id) FILTER (WHERE n_chars > 20000) AS b, count(*) AS n FROM documents) SELECT coalesce(b, n) AS valid, coalesce(b, n) // 100 * 100 AS resume FROM t")
def _(spark, d):
    lines = T(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.when(F.col("n_chars") > 20000, '{"text": "cut').otherwise('{"text": "ok"}').alias("line"))
    return S.valid_prefix_floor(lines, 100)


@query("json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_type(props) AS kind FROM events WHERE props IS NOT NULL")
def _(spark, d):
    e = T(spark, d, "events").where("props is not null")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), X.json_kind(F.col("props")).alias("kind"))


@query("skip_rows", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) WHERE r > 150")
def _(spark, d):
    """What is left of a scan behind its first rows, by the rows' numbers."""
    return O.skip(T(spark, d, "documents").select("doc_id"), ["doc_id"], 150)


@query("head_inspect", "SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id LIMIT 7")
def _(spark, d):
    from tessera.sources.runs import head

    return head(T(spark, d, "documents"), 7, "doc_id").select("doc_id", "source", "n_chars")


@query("raw_digest_union", "SELECT source AS file, max(sha256(lang)) AS digest, count(*) AS workers FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY source HAVING count(DISTINCT lang) >= 1")
def _(spark, d):
    """Workers' raw digests united; the greatest stands for one file's."""
    raw = T(spark, d, "documents").select(F.col("source").alias("file"), F.sha2("lang", 256).alias("digest")).distinct()
    return raw.groupBy("file").agg(F.max("digest").alias("digest"), F.count("*").alias("workers"))


@query("manifest_state", "SELECT source AS file, CASE WHEN source = 'src1' THEN 'missing' WHEN source = 'src2' THEN 'mismatch' ELSE 'ok' END AS state FROM (SELECT DISTINCT source FROM documents)")
def _(spark, d):
    """A manifest's digests against those found: ok, mismatch or missing."""
    names = T(spark, d, "documents").select(F.col("source").alias("file")).distinct()
    found = names.where("file <> 'src1'").select("file", F.sha2("file", 256).alias("digest"))
    stated = names.select("file", F.when(F.col("file") == "src2", F.sha2(F.lit("x"), 256)).otherwise(F.sha2("file", 256)).alias("digest"))
    return idx.verified(found, stated).select("file", "state")
