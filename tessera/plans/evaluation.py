"""Evaluation analytics. Documents stand in for scores: source for a category, lang for a task, doc_id div 200 for a step."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import schedules as S, text as X
from tessera.operators import evals as E
from tessera.plans.corpus import sized
from tessera.session import table as T

SCORES = "scores AS (SELECT doc_id // 200 AS step, source AS category, lang AS task, round(avg(n_chars), 3) AS score FROM documents GROUP BY ALL)"


def scores(spark, d):
    return T(spark, d, "documents").groupBy(F.expr("doc_id div 200").alias("step"), F.col("source").alias("category"), F.col("lang").alias("task")).agg(F.round(F.avg("n_chars"), 3).alias("score"))


@query("perplexity", "SELECT event_type, round(exp(sum(value) / sum(user_id + 1)), 9) AS ppl FROM events GROUP BY event_type")
def _(spark, d):
    g = T(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("nll"), F.sum(F.col("user_id") + 1).alias("n"))
    return g.select("event_type", F.round(S.perplexity(F.col("nll"), F.col("n")), 9).alias("ppl"))


@query("perplexity_windows", r"SELECT doc_id, k AS length, CASE WHEN k < 17 THEN 0 ELSE (k - 1) // 16 END AS windows, CASE WHEN k < 17 THEN 0 ELSE (k - 1) // 16 * 16 END AS scored FROM (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text,''), '[^ \t\n\x0b\f\r]+')) AS BIGINT) AS k FROM documents)")
def _(spark, d):
    """The whole windows of sixteen scored tokens that each document has."""
    k = sized(spark, d).select("doc_id", F.col("n_tokens").alias("length"))
    w = F.greatest(F.expr("(length - 1) div 16"), F.lit(0).cast("bigint"))
    return k.select("doc_id", "length", w.alias("windows"), (w * 16).alias("scored"))


@query("category_macro", f"WITH {SCORES} SELECT step, category, round(avg(score), 6) AS macro FROM scores GROUP BY step, category")
def _(spark, d):
    return scores(spark, d).groupBy("step", "category").agg(F.round(F.avg("score"), 6).alias("macro"))


@query("macro_average", f"WITH {SCORES}, m AS (SELECT step, category, avg(score) AS macro FROM scores WHERE score IS NOT NULL GROUP BY step, category) SELECT step, round(coalesce(avg(macro), 0.0), 6) AS macro_average FROM m GROUP BY step")
def _(spark, d):
    return E.macro(scores(spark, d), by=["step"])[1].select("step", F.round("macro_average", 6).alias("macro_average"))


@query("olmes_macro", "SELECT doc_id, round((n_chars * 9 + CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id END) / 10, 6) AS macro FROM documents")
def _(spark, d):
    other = F.when(F.col("doc_id") % 5 != 0, F.col("doc_id"))
    return T(spark, d, "documents").select("doc_id", F.round(E.olmes_macro(F.col("n_chars"), other), 6).alias("macro"))


@query("best_of_forms", "WITH a AS (SELECT doc_id, lang || CASE doc_id % 3 WHEN 0 THEN ':mc::olmes' WHEN 1 THEN ':rc' ELSE '' END AS alias, n_chars AS s FROM documents), p AS (SELECT regexp_replace(regexp_replace(alias, '::olmes$', ''), ':(mc|rc)$', '') AS task, nullif(regexp_extract(regexp_replace(alias, '::olmes$', ''), ':(mc|rc)$', 1), '') AS form, s FROM a) SELECT task, max(s) FILTER (WHERE form = 'mc') AS mc, max(s) FILTER (WHERE form = 'rc') AS rc, max(s) FILTER (WHERE form IS NOT NULL) AS best FROM p GROUP BY task")
def _(spark, d):
    suffix = F.when(F.col("doc_id") % 3 == 0, ":mc::olmes").when(F.col("doc_id") % 3 == 1, ":rc").otherwise("")
    p = T(spark, d, "documents").select(X.task_form(F.concat("lang", suffix)).alias("a"), F.col("n_chars").alias("s")).select("a.task", "a.form", "s")
    return p.groupBy("task").pivot("form", ["mc", "rc"]).agg(F.max("s")).select("task", "mc", "rc", F.greatest("mc", "rc").alias("best"))


@query("suite_expand", "SELECT CAST(row_number() OVER (ORDER BY source, lang) - 1 AS BIGINT) AS pos, source || ':' || lang AS task FROM (SELECT DISTINCT coalesce(source, '-') AS source, coalesce(lang, '-') AS lang FROM documents)")
def _(spark, d):
    """The suite of all sources, each a suite of its languages, as its tasks in order."""
    pairs = T(spark, d, "documents").select(F.coalesce("source", F.lit("-")).alias("source"), F.coalesce("lang", F.lit("-")).alias("lang")).distinct()
    tasks = pairs.groupBy("source").agg(F.array_sort(F.collect_list(F.concat_ws(":", "source", "lang"))).alias("tasks")).orderBy("source").collect()  # a row a source
    suites = {f"suite {r['source']}": r["tasks"] for r in tasks}
    got = E.expand(suites | {"all": list(suites)}, {t for r in tasks for t in r["tasks"]}, ["all"])
    return spark.createDataFrame(list(enumerate(got)), "pos bigint, task string")


@query("primary_metric", "SELECT doc_id, CAST(CASE WHEN doc_id % 4 = 0 THEN n_chars WHEN doc_id % 4 = 1 THEN doc_id WHEN doc_id % 4 = 2 THEN 7 WHEN doc_id % 8 = 3 THEN n_chars + 0.5 ELSE 0 END AS DOUBLE) AS score FROM documents")
def _(spark, d):
    i, c = F.col("doc_id").cast("double"), F.col("n_chars").cast("double")
    m = F.when(F.col("doc_id") % 4 == 0, F.create_map(F.lit("acc,none"), i, F.lit("acc_norm,none"), c)).when(F.col("doc_id") % 4 == 1, F.create_map(F.lit("acc,none"), i)).when(F.col("doc_id") % 4 == 2, F.create_map(F.lit("other"), F.lit(7.0))).when(F.col("doc_id") % 8 == 3, F.create_map(F.lit("f1,none"), i, F.lit("pass_at_1,none"), c + 0.5)).otherwise(F.create_map().cast("map<string,double>"))
    return T(spark, d, "documents").select("doc_id", E.primary_metric(m).alias("score"))


@query("merged_points", f"WITH {SCORES}, a AS (SELECT step, max(score) AS mc FROM scores WHERE task = 'en' GROUP BY step), b AS (SELECT step + 1 AS step, max(score) AS ext FROM scores WHERE task = 'de' GROUP BY step) SELECT coalesce(a.step, b.step) AS step, mc, ext FROM a FULL JOIN b ON a.step = b.step")
def _(spark, d):
    s = scores(spark, d)
    a = s.where("task = 'en'").groupBy("step").agg(F.max("score").alias("mc"))
    b = s.where("task = 'de'").groupBy((F.col("step") + 1).alias("step")).agg(F.max("score").alias("ext"))
    return a.join(b, "step", "full_outer").select("step", "mc", "ext")


@query("stitch_runs", "SELECT step, segment, score FROM (SELECT doc_id % 300 AS step, doc_id // 300 AS segment, n_chars AS score, row_number() OVER (PARTITION BY doc_id % 300 ORDER BY doc_id // 300 DESC) AS r FROM documents) WHERE r = 1")
def _(spark, d):
    p = T(spark, d, "documents").select((F.col("doc_id") % 300).alias("step"), F.expr("doc_id div 300").alias("segment"), F.col("n_chars").alias("score"))
    return E.stitched(p)


@query("single_task_categories", f"WITH {SCORES}, m AS (SELECT step, category, max(score) FILTER (WHERE task = 'en') AS macro FROM scores GROUP BY ALL), n AS (SELECT category, count(DISTINCT step) AS steps FROM m GROUP BY category), h AS (SELECT category, task FROM scores JOIN m USING (step, category) WHERE score = macro GROUP BY category, task HAVING count(DISTINCT step) = (SELECT steps FROM n WHERE n.category = scores.category)) SELECT category, min(task) AS task FROM h GROUP BY category HAVING count(*) = 1")
def _(spark, d):
    s = scores(spark, d)
    return E.always_equal(s, s.groupBy("step", "category").agg(F.max(F.when(F.col("task") == "en", F.col("score"))).alias("macro")))


@query("summary_routing", "SELECT CASE WHEN doc_id % 7 = 0 THEN 'aggregate' WHEN lang = 'en' THEN 'extended' ELSE 'per_task' END AS kind, count(*) AS n, list(DISTINCT source ORDER BY source) AS names FROM documents GROUP BY kind")
def _(spark, d):
    task = F.when(F.col("doc_id") % 7 != 0, F.col("doc_id"))
    kind = F.when(task.isNull(), "aggregate").when(F.col("lang") == "en", "extended").otherwise("per_task")
    return T(spark, d, "documents").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("source")).alias("names"))


@query("panels_unpivot", f"WITH {SCORES}, w AS (SELECT step, max(score) FILTER (WHERE task='en') AS en, max(score) FILTER (WHERE task='fr') AS fr FROM scores GROUP BY step) SELECT step, 'task:en' AS key, en AS value FROM w WHERE en IS NOT NULL UNION ALL SELECT step, 'task:fr', fr FROM w WHERE fr IS NOT NULL")
def _(spark, d):
    w = scores(spark, d).groupBy("step").pivot("task", ["en", "fr"]).agg(F.max("score")).select("step", F.col("en").alias("task:en"), F.col("fr").alias("task:fr"))
    return w.unpivot("step", ["task:en", "task:fr"], "key", "value").where("value is not null")


@query("common_tasks", f"WITH {SCORES}, s AS (SELECT step, list(DISTINCT task) AS t FROM scores GROUP BY step) SELECT task, count(DISTINCT step) AS steps FROM scores GROUP BY task HAVING count(DISTINCT step) = (SELECT count(*) FROM s)")
def _(spark, d):
    s = scores(spark, d)
    n = s.agg(F.countDistinct("step").alias("all"))
    return s.groupBy("task").agg(F.countDistinct("step").alias("steps")).join(F.broadcast(n), F.col("steps") == F.col("all")).select("task", "steps")


@query("settings_last_wins", "SELECT source, CAST(max(n_chars) FILTER (WHERE lang = 'en') AS BIGINT) AS a, CAST(coalesce(max(n_chars) FILTER (WHERE lang = 'fr'), min(n_chars) FILTER (WHERE lang = 'en')) AS BIGINT) AS b FROM documents GROUP BY source")
def _(spark, d):
    """Two maps united, the second's keys winning, and a retired key dropped."""
    n = lambda f, lang: f(F.when(F.col("lang") == lang, F.col("n_chars")))
    g = T(spark, d, "documents").groupBy("source").agg(n(F.max, "en").alias("x"), n(F.min, "en").alias("y"), n(F.max, "fr").alias("z"))
    first = F.create_map(F.lit("a"), F.col("x"), F.lit("b"), F.col("y"), F.lit("old"), F.lit(1).cast("bigint"))
    second = F.map_filter(F.create_map(F.lit("b"), F.col("z")), lambda k, v: v.isNotNull())
    kept = F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k) & (k != "old"))
    both = F.map_concat(kept, second)
    return g.select("source", both.alias("m")).select("source", F.element_at("m", "a").alias("a"), F.element_at("m", "b").alias("b"))
