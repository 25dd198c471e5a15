"""Secret scans: fixed patterns, and character Markov models for what no pattern names.

Two first-order Markov chains over the characters of a token, one of random strings and
one of ordinary identifiers, are trained from labelled samples. A token's mean
log-likelihood ratio per character tells how much more it looks like the first. All of it
is DataFrame expressions: the patterns run in the JVM, and a token is scored by lookups in
one constant array of bigram ratios.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm._native import bind, running
from tessera.llm._store import documents

#: The base patterns, with the least length of the part that counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: What the models look at: whole runs of the alphabet, of this length at least.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: What joins a secret to a name or a path in one run, and the length of the windows that look for it there.
JOINTS, WINDOW = "=/_-", 20

#: Parts of ordinary identifiers, words of several languages among them.
PARTS = (
    "get set is has to from user name list item count index value key data file path line code page test main base node tree map type size time date start end first last next open close read write load save send "
    "request response server client config option param default result error message event handler manager service factory builder context session account address number string object array table column record "
    "update delete create insert select process control system network memory buffer stream thread worker queue cache store query model view image color width height length offset version release "
    "the and that with this have which there their other about tion ment able ing ness over under nation action station relation information organisation development environment "
    "und der die das nicht werden schaft ungen lich keit gesellschaft entwicklung les des pour dans avec aux elle que ement ation leurs temps monde los las para con una como mente cion dad estado mundo tiempo"
).split()


def numbered(part, digits) -> Column:
    """One of six ordinary forms that are rich in digits, of the row ``id``; ``part(k)`` and ``digits(k, n)`` are its parts."""
    day = [F.lpad((F.pmod(F.xxhash64("id", F.lit(k)), F.lit(most)) + 1).cast("string"), 2, "0") for k, most in ((90, 12), (91, 28))]
    year, clock = F.concat(F.lit("20"), digits(0, 2)), [digits(k, 2) for k in (1, 2, 3)]
    word, other, third = part(10), part(11), part(12)
    even = F.col("id") % 12 < 6
    form = F.col("id") % 6
    return (
        F.when(form == 0, F.concat(F.concat_ws("-", year, *day), F.when(even, "T").otherwise("_"), F.concat_ws("-", *clock), F.when(even, "Z").otherwise(F.concat(F.lit("_"), word))))
        .when(form == 1, F.concat(word, F.when(even, "_").otherwise("-"), year, *day, F.lit("T"), *clock, F.lit("Z")))
        .when(form == 2, F.concat_ws("-", F.upper(word), digits(4, 8), digits(5, 6), digits(6, 4)))
        .when(form == 3, F.concat(F.upper(F.substring(word, 1, 2)), digits(4, 10), digits(5, 10)))
        .when(form == 4, F.concat(F.concat_ws("-", word, other, digits(4, 1), digits(5, 2), digits(6, 1)), F.when(even, "-x86_64").otherwise("-x64")))
        .otherwise(F.concat(word, F.lit("/lib"), F.initcap(other), digits(4, 1), F.initcap(third), F.initcap(part(13))))
    )


def training_sample(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """(token, random boolean): ``rows`` random ones and a quarter more ordinary ones, the same at every call.

    Random: digests of the row number in base 64, in hexadecimal, and in upper case and
    digits. Ordinary: parts joined as snake, camel and kebab case, paths, constants and plain
    compounds, some with a short number behind; and, for a fifth, time stamps, order and
    account numbers, versions of packages and libraries in paths.
    """
    r = spark.range(rows)
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    secret = r.select(
        F.when(F.col("id") % 4 < 2, F.base64(F.substring(digest, 1, 30))).when(F.col("id") % 4 == 2, F.substring(F.hex(digest), 1, 40)).otherwise(F.upper(F.regexp_replace(F.base64(digest), "[+/=]", ""))).alias("token"),
        F.lit(True).alias("random"),
    )
    parts = F.array(*[F.lit(x) for x in PARTS])
    part = lambda k: F.element_at(parts, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    five = [part(k) for k in range(5)]
    form = F.col("id") % 7
    word = (
        F.when(form == 0, F.concat_ws("_", *five))
        .when(form == 1, F.concat(five[0], *[F.initcap(x) for x in five[1:]]))
        .when(form == 2, F.concat_ws("-", *five))
        .when(form == 3, F.concat_ws("/", *five))
        .when(form == 4, F.upper(F.concat_ws("_", *five[:4])))
        .otherwise(F.concat(*five))
    )
    plain = r.select(F.concat(word, F.when(F.col("id") % 5 == 0, (F.col("id") % 100).cast("string")).otherwise(F.lit(""))).alias("token"), F.lit(False).alias("random"))
    digits = lambda k, n: F.lpad(F.pmod(F.xxhash64("id", F.lit(100 + k)), F.lit(10**n)).cast("string"), n, "0")
    return secret.unionByName(plain).unionByName(spark.range(rows // 4).select(numbered(part, digits).alias("token"), F.lit(False).alias("random")))


def train(sample: DataFrame, smooth: float = 0.2, back: float = 30.0) -> list[float]:
    """The log ratio of each (character, next character), at ``68 * i + j``; 0 stands for a token's start.

    A chain's chances after a character are its counts there and ``back`` times how often each
    character comes at all, so that what a label never showed (a ruler's dash after a dash)
    is rare under it instead of as likely as anything. Only the table of bigram counts, whose
    size the alphabet bounds, comes to the driver. Characters outside the alphabet, null
    tokens and null labels are passed over; an empty sample gives ratios of zero.
    """
    place = lambda c: F.when(c != "", F.instr(F.lit(ALPHABET), c)).otherwise(0)
    chars = F.filter(F.transform(F.split("token", ""), place), lambda i: i > 0)
    pairs = sample.select("random", chars.alias("c")).select("random", F.explode(F.arrays_zip(F.concat(F.array(F.lit(0)), F.col("c")).alias("a"), F.col("c").alias("b"))).alias("p")).select("random", "p.*").where("b is not null")
    n = len(ALPHABET) + 1
    seen = {True: [[0] * n for _ in range(n)], False: [[0] * n for _ in range(n)]}
    for random, a, b, k in pairs.where("random is not null").groupBy("random", "a", "b").count().collect():
        seen[random][a][b] += k

    def chances(rows: list[list[int]]) -> list[list[float]]:
        often = [sum(row[b] for row in rows) + smooth for b in range(1, n)]
        share = [x / sum(often) for x in often]
        return [[(k + back * p) / (sum(row) + back) for k, p in zip(row[1:], share, strict=True)] for row in rows]

    of = {label: chances(rows) for label, rows in seen.items()}
    return [x for a in range(n) for x in (0.0, *(math.log(p / q) for p, q in zip(of[True][a], of[False][a], strict=True)))]


def ratio(token: Column, weights: list[float]) -> Column:
    """The mean log-likelihood ratio per character of a token over the alphabet."""
    n = len(ALPHABET) + 1
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in weights)), ",").cast("array<double>")
    place = F.concat(F.array(F.lit(0)), F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c)))
    score = lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(0.0), lambda s, i: s + F.get(table, F.get(p, i - 1) * n + F.get(p, i)))
    return bind(place, score) / F.length(token)


def _hidden(m: Column, at: Column, weights: list[float], least: float) -> Column:
    """(s, kind, e) of the parts of a run that look random by themselves; ``at`` is the place of the run.

    Every window that does not cross a "=" is scored as a token of its own. Windows that
    meet, or that no joint parts, are one; it is marked out to the joints around it.
    """
    n = len(ALPHABET) + 1
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in weights)), ",").cast("array<double>")
    codes = F.transform(F.split(m, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    steps = lambda p: F.transform(p, lambda c, i: F.when(i > 0, F.get(table, F.get(p, i - 1) * n + c)).otherwise(0.0))
    flat = F.translate(m, JOINTS, "=" * len(JOINTS))
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def hits(p: Column, w: Column) -> Column:
        score = lambda i: F.get(table, F.get(p, i)) + F.aggregate(F.slice(w, i + 2, WINDOW - 1), F.lit(0.0), lambda a, x: a + x)
        return F.filter(F.sequence(F.lit(0), F.length(m) - WINDOW), lambda i: (score(i) >= least * WINDOW) & ~F.contains(F.substr(m, i + 1, F.lit(WINDOW)), F.lit("=")))

    def joined(runs: Column, i: Column) -> Column:
        last = F.element_at(runs, -1)
        one = lambda s: F.array(F.struct(s.cast("int").alias("s"), (i + WINDOW).cast("int").alias("e")))
        return F.when(F.size(runs) == 0, one(i)).when((i <= last["e"]) | ~F.contains(F.substr(flat, last["e"] + 1, i - last["e"]), F.lit("=")), F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), one(last["s"]))).otherwise(F.concat(runs, one(i)))

    def widened(x: Column) -> Column:
        s = x["s"] - F.length(F.substring_index(F.substr(flat, F.lit(1), x["s"]), "=", -1))
        e = x["e"] + F.length(F.substring_index(F.substr(flat, x["e"] + 1), "=", 1))
        return F.struct(s.alias("s"), e.alias("e"))

    runs = bind(codes, lambda p: bind(steps(p), lambda w: F.aggregate(hits(p, w), empty, joined)))
    part = lambda x: F.substr(m, x["s"] + 1, x["e"] - x["s"])
    kept = F.filter(F.transform(runs, widened), lambda x: part(x).rlike("[0-9]") & part(x).rlike("[A-Za-z]"))
    return F.transform(kept, lambda x: F.struct((at + x["s"]).alias("s"), F.lit(3).alias("kind"), (at + x["e"]).alias("e")))


SPAN = "array<struct<s:int,kind:int,e:int>>"
#: Texts are rebuilt in blocks of so many characters, as a part's place is found by counting from the front.
BLOCK = 1 << 14


def _matches(text: Column, pattern: str) -> Column:
    """(s, m) of the matches of ``pattern``, in order; code points."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(m: Column, gaps: Column) -> Column:
        ends = running(F.transform(m, lambda x, i: F.length(F.get(gaps, i)) + F.length(x)), lambda a, x: a + x)
        return bind(ends, lambda e: F.transform(m, lambda x, i: F.struct((F.get(e, i) - F.length(x)).alias("s"), x.alias("m"))))

    empty = F.array().cast("array<struct<s:int,m:string>>")
    return F.when(text.rlike(pattern), bind(found, lambda m: bind(between, lambda gaps: placed(m, gaps)))).otherwise(empty)


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """(s, kind, e) of the matches that ``keep`` accepts."""
    kept = F.filter(_matches(text, pattern), lambda x: keep(x["m"]))
    return F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("kind"), (x["s"] + F.length(x["m"])).cast("int").alias("e")))


def _free(base: Column, guess: Column) -> Column:
    """``base`` and those of ``guess`` that overlap none of it, sorted: the greatest end before and the least start behind tell."""
    far = F.lit(2**31 - 1)

    def told(all_: Column) -> Column:
        before = running(F.transform(all_, lambda x: F.when(x["kind"] < 3, x["e"]).otherwise(0)), F.greatest)
        behind = F.reverse(running(F.reverse(F.transform(all_, lambda x: F.when(x["kind"] < 3, x["s"]).otherwise(far))), F.least))
        return bind(before, lambda b: bind(behind, lambda n: F.filter(all_, lambda x, i: (x["kind"] < 3) | ((F.get(b, i) <= x["s"]) & (F.get(n, i) >= x["e"])))))

    both = F.sort_array(F.concat(base, guess))
    return F.when((F.size(guess) > 0) & (F.size(base) > 0), bind(both, told)).otherwise(both)


def scan(docs: DataFrame, weights: list[float], least: float = 0.8, text: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` with the column ``into``: array of (s, kind, e), by start and then by the order of ``KINDS``.

    The patterns' spans always stay, and may overlap those of other kinds. A token is added
    under ``markov`` if its ratio is ``least`` or more, it has a digit and a letter, and no
    pattern's span overlaps it. Of a token with a lower ratio the parts are added that reach
    ``least`` by themselves, such as a secret behind a name or in a path. Null is taken as the
    empty text, which has no spans. Repeated rows are scanned alike, a text of any length
    whole, in time that hardly grows faster than its length and hits; an empty table gives no
    rows. A column ``into`` is replaced, all others stay.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = F.concat(
        _spans(t, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
        _spans(t, ACCESS, 1, lambda m: F.lit(True)),
        _spans(t, HEX, 2, lambda m: F.lit(True)),
    )
    mixed = F.filter(_matches(t, TOKEN), lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]"))
    whole = lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("kind"), (x["s"] + F.length(x["m"])).cast("int").alias("e"))
    inside = lambda x: F.when(ratio(x["m"], weights) >= least, F.array(whole(x))).otherwise(_hidden(x["m"], x["s"], weights, least))
    guess = bind(mixed, lambda found: F.when(F.size(found) > 0, F.flatten(F.transform(found, inside))).otherwise(F.array().cast(SPAN)))
    return docs.withColumn(into, bind(base, lambda b: bind(guess, lambda g: _free(b, g))))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with every run of overlapping ``spans`` (sorted) replaced by ``mark``."""

    def merged(xs: Column) -> Column:
        """(s, e) of the runs: one begins where a span starts at or behind all ends before it."""

        def runs(ends: Column) -> Column:
            heads = F.filter(F.transform(xs, lambda x, i: F.when((i == 0) | (x["s"] >= F.get(ends, i - 1)), i)), lambda i: i.isNotNull())
            return bind(heads, lambda h: F.transform(h, lambda i, k: F.struct(F.get(xs, i)["s"].alias("s"), F.get(ends, F.coalesce(F.get(h, k + 1), F.size(xs)) - 1).alias("e"))))

        return bind(running(F.transform(xs, lambda x: x["e"]), F.greatest), runs)

    def block(rs: Column, k: Column) -> Column:
        """What is left of the block's characters, with a mark for each run that begins in it."""
        lo, hi = k * BLOCK, k * BLOCK + BLOCK
        here = F.filter(rs, lambda r: (r["e"] > lo) & (r["s"] < hi))
        cut = lambda part, a, b: F.substr(part, a - lo + 1, F.greatest(b - a, F.lit(0)))

        def pieces(part: Column, h: Column) -> Column:
            before = lambda x, i: cut(part, F.when(i == 0, lo).otherwise(F.get(h, i - 1)["e"]), x["s"])
            held = F.transform(h, lambda x, i: F.concat(before(x, i), F.when(x["s"] >= lo, F.lit(mark)).otherwise(F.lit(""))))
            tail = F.when(F.size(h) == 0, part).otherwise(F.substr(part, F.element_at(h, -1)["e"] - lo + 1))
            return F.concat(F.array_join(held, ""), tail)

        return bind(F.substr(text, lo + 1, F.lit(BLOCK)), lambda part: bind(here, lambda h: pieces(part, h)))

    def rebuilt(rs: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / BLOCK).cast("int")), lambda k: block(rs, k)), "")

    return F.when(F.size(spans) > 0, bind(bind(spans, merged), rebuilt)).otherwise(text)


def _named(x: Column) -> Column:
    return F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the secrets of every document."""
    found = scan(documents(spark, sf_dir).select("doc_id", "text"), train(training_sample(spark)))
    of = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("bigint")
    base = F.concat_ws(",", F.transform(F.filter("secrets", lambda x: x["kind"] < 3), _named))
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), F.concat_ws(",", F.transform("secrets", _named)).alias("spans"))
