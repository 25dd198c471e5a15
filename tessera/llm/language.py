"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary have one probability per language. A word's
likelihood is the sum over all its segmentations into pieces, by the forward algorithm; a
text's is the product over its words, and its language the one that makes it likeliest.
The probabilities are fitted by expectation maximisation, whose expected counts come from
the same lattice, on a bounded sample of labelled documents per language.

Words are runs of letters and marks in lower case, each with the vocabulary's word mark
before it (pieces with capitals can therefore not occur, and are left out). All distinct
words of a batch go through the lattice side by side, position by position. A run of over
``LONGEST`` letters, as in scripts without blanks, is first cut where no piece reaches over:
there the sum is a product, and the cut exact. What stays longer is walked alone, rescaled.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tessera.llm import _bytes
from tessera.llm._store import cut, documents, named

MARK = 0x2581
#: The probabilities of so many characters have a product that a double holds.
LONGEST = 23
#: The probability of a character that no piece covers, in any language.
UNKNOWN = 1e-9


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Code points that are letters; those that words consist of (letters and marks)."""
    letter, mark = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        letter[c], mark[c] = kind == "L", kind == "M"
    return letter, letter | mark


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, x, np.uint64)))) for x in (base, inverse))


class Vocabulary:
    """The vocabulary's pieces (lower case, ordinary ones), found by a hash of their characters."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        all_ids = range(sp.get_piece_size())
        pieces = sorted({p for i in all_ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and (p := sp.id_to_piece(i)) == p.lower()})
        self.size, self.longest = len(pieces), max(map(len, pieces), default=1)
        self.bits = 20
        self.keys, self.ids = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        self.depth = 1
        flat = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        length = np.array(list(map(len, pieces)), np.int64)
        for k, h in enumerate(self.hashes(flat, np.cumsum(length) - length, length).tolist()):
            at, d = h >> (64 - self.bits), 1
            while self.ids[at] >= 0:
                at, d = (at + 1) % len(self.ids), d + 1
            self.keys[at], self.ids[at], self.depth = h, k, max(self.depth, d)

    @staticmethod
    def sums(points: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.concatenate(([np.uint64(0)], np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _powers(_size(len(points)))[0][: len(points)])))

    def hashes(self, points: np.ndarray, start: np.ndarray, length: np.ndarray | int, sums: np.ndarray | None = None) -> np.ndarray:
        sums = self.sums(points) if sums is None else sums
        with np.errstate(over="ignore"):
            h = (sums[start + length] - sums[start]) * _powers(_size(len(points)))[1][start]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            return h ^ (h >> np.uint64(32))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[at] == h, self.ids[at], -1)
        for d in range(1, self.depth):
            rows = np.flatnonzero((out < 0) & (self.ids[(at + d - 1) % len(self.ids)] >= 0))
            if not rows.size:
                break
            next_at = (at[rows] + d) % len(self.ids)
            out[rows] = np.where(self.keys[next_at] == h[rows], self.ids[next_at], -1)
        return out


def _size(n: int) -> int:
    return 1 << max(16, int(n).bit_length())


@_bytes.one_model
def vocabulary(name: str) -> Vocabulary:
    if "/" in name:
        return Vocabulary(name)
    import public_tokenizers

    return Vocabulary(public_tokenizers.path(name))


class Words:
    """The distinct words of some texts: ``index`` has the word of each occurrence, ``row`` its text."""

    def __init__(self, texts: Sequence[str]):
        letter, inside_of = _letters()
        texts = [t.lower() for t in texts]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        border_at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
        inside = inside_of[points]
        n = len(points)
        border = np.zeros(n + 1, bool)
        border[border_at] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        starts = np.flatnonzero(inside & (~before | border[:-1]))
        ends = np.flatnonzero(inside & (~after | border[1:])) + 1
        self.row = np.searchsorted(border_at, starts, "right") - 1
        self.has_letter = np.add.reduceat(np.append(letter[points], False).astype(np.int64), border_at[:-1]) > 0 if len(texts) else np.zeros(0, bool)
        self.has_letter &= np.diff(border_at) > 0
        length = ends - starts
        # the word mark, then the letters; one behind the other
        at = np.concatenate(([0], np.cumsum(length + 1)))
        flat = np.full(int(at[-1]), MARK, np.uint32)
        own = np.repeat(np.arange(len(starts)), length)
        inner = np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length)
        flat[at[:-1][own] + 1 + inner] = points[starts[own] + inner]
        folded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(flat)]).dictionary_encode()
        self.index = folded.indices.to_numpy() if len(starts) else np.zeros(0, np.int64)
        data, off = _bytes.raw(folded.dictionary)
        self.points, self.off = np.frombuffer(data.tobytes(), np.uint32), off // 4

    def __len__(self) -> int:
        return len(self.off) - 1


def stretches(vocab: Vocabulary, points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' ends and, in those of over ``LONGEST`` letters, all places that no piece reaches over; and the word of each stretch."""
    far = np.flatnonzero(np.diff(off) > LONGEST + 1)
    if not far.size:
        return off, np.arange(len(off) - 1)
    cuts = [off]
    for w in far:
        own = points[off[w] : off[w + 1]]
        sums, over = vocab.sums(own), np.zeros(len(own) + 1, np.int64)
        for n in range(2, min(vocab.longest, len(own)) + 1):
            at = np.flatnonzero(vocab.find(vocab.hashes(own, np.arange(len(own) - n + 1), n, sums)) >= 0)
            over[at + 1] += 1
            over[at + n] -= 1
        cuts.append(off[w] + np.flatnonzero(np.cumsum(over)[1:-1] == 0) + 1)
    ends = np.unique(np.concatenate(cuts))
    return ends, np.searchsorted(off, ends[:-1], "right") - 1


def walked(vocab: Vocabulary, probs: np.ndarray, points: np.ndarray) -> np.ndarray:
    """log P(points) in each language by the forward algorithm, rescaled as it goes; only the last positions are held."""
    sums, n = vocab.sums(points), len(points)
    found = [vocab.find(vocab.hashes(points, np.arange(n - k + 1), k, sums)).tolist() for k in range(1, min(vocab.longest, n) + 1)]
    window, log = [np.ones(probs.shape[1])], np.zeros(probs.shape[1])
    for end in range(1, n + 1):
        now = window[-1] * probs[found[0][end - 1]]
        for k in range(2, len(window) + 1):
            if k <= len(found) and (piece := found[k - 1][end - k]) >= 0:
                now = now + window[-k] * probs[piece]
        window = [*window[1 - vocab.longest :], now] if vocab.longest > 1 else [now]
        if now.min() < 1e-100:
            log += np.log(now)
            window = [x / now for x in window]
    return log + np.log(window[-1])


def lattice(vocab: Vocabulary, points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """The words by falling length, their lengths, and for each (end, start) the words that have a piece there, with the piece (-1: an uncovered character).

    Those of over ``LONGEST`` letters and a mark count as empty.
    """
    length = np.diff(off)
    length = np.where(length > LONGEST + 1, 0, length)
    order = np.argsort(-length, kind="stable")
    head, length = off[:-1][order], length[order]
    sums, arcs = vocab.sums(points), []
    for end in range(1, int(length.max(initial=0)) + 1):
        n = int(np.searchsorted(-length, -end, "right"))
        for start in range(max(0, end - vocab.longest), end):
            piece = vocab.find(vocab.hashes(points, head[:n] + start, end - start, sums))
            rows = np.arange(n) if end - start == 1 else np.flatnonzero(piece >= 0)
            if rows.size:
                arcs.append((end, start, rows, piece[rows]))
    return order, length, arcs


def forward(probs: np.ndarray, length: np.ndarray, arcs: list) -> list[np.ndarray]:
    """alpha[position][word, language]; ``probs`` (piece, language), its last row for uncovered characters."""
    alpha = [np.ones((len(length), probs.shape[1]))]
    for end, start, rows, piece in arcs:
        if end == len(alpha):
            alpha.append(np.zeros((int(np.searchsorted(-length, -end, "right")), probs.shape[1])))
        alpha[end][rows] += alpha[start][rows] * probs[piece]
    return alpha


def log_likelihood(vocab: Vocabulary, probs: np.ndarray, words: Words, block: int = 1 << 21) -> np.ndarray:
    """log P(word) of each distinct word in each language, summed over all segmentations."""
    ends, owner = stretches(vocab, words.points, words.off)
    each = np.zeros((len(owner), probs.shape[1]))
    step = max(1, block // ((LONGEST + 2) * probs.shape[1]))
    for lo in range(0, len(owner), step):
        off = ends[lo : lo + step + 1]
        order, length, arcs = lattice(vocab, words.points[off[0] : off[-1]], off - off[0])
        alpha = forward(probs, length, arcs)
        total = np.empty((len(length), probs.shape[1]))
        for n, a in enumerate(alpha):
            here = np.searchsorted(-length, -n, "left"), np.searchsorted(-length, -n, "right")
            total[here[0] : here[1]] = a[here[0] : here[1]]
        each[lo + order] = np.log(np.maximum(total, 1e-300))
    for k in np.flatnonzero(np.diff(ends) > LONGEST + 1):
        each[k] = walked(vocab, probs, words.points[ends[k] : ends[k + 1]])
    if len(owner) == len(words):
        return each
    return np.stack([np.bincount(owner, each[:, k], len(words)) for k in range(probs.shape[1])], axis=1)


def fit(vocab: Vocabulary, words: Words, rounds: int = 3, smooth: float = 0.05) -> np.ndarray:
    """Piece probabilities of one language from its words, by expectation maximisation.

    Stretches of over ``LONGEST`` letters that cannot be cut exactly are not learned from.
    """
    ends, owner = stretches(vocab, words.points, words.off)
    times = np.bincount(words.index, minlength=len(words)).astype(float)[owner]
    order, length, arcs = lattice(vocab, words.points, ends)
    times = times[order]
    counts = np.zeros(vocab.size + 1)
    for _, _, rows, piece in arcs:  # to begin with: as often as it occurs
        np.add.at(counts, piece, times[rows])
    for _ in range(rounds):
        counts = np.maximum(counts, 0)
        probs = ((counts + smooth) / (counts[:-1].sum() + smooth * vocab.size))[:, None]
        probs[-1] = UNKNOWN
        alpha = forward(probs, length, arcs)
        beta = [np.zeros_like(a) for a in alpha]
        for n in range(len(alpha)):
            here = np.searchsorted(-length, -n, "left"), np.searchsorted(-length, -n, "right")
            beta[n][here[0] : here[1]] = 1 / np.maximum(alpha[n][here[0] : here[1]], 1e-300)
        counts = np.zeros(vocab.size + 1)
        for end, start, rows, piece in reversed(arcs):
            back = beta[end][rows] * probs[piece]
            beta[start][rows] += back
            np.add.at(counts, piece, times[rows] * (alpha[start][rows] * back)[:, 0])
    probs = (counts + smooth) / (counts[:-1].sum() + smooth * vocab.size)
    probs[-1] = UNKNOWN
    return probs


def training_rows(rows: DataFrame, most: int) -> DataFrame:
    """(lang, text, times) of at most ``most`` of ``rows`` (lang, id, text) for each language, those whose id and text hash lowest.

    Equal rows are one text with its ``times``, so a text that a third of all rows have is sent
    once, and a language all of whose rows share an id has its share like any other. What a
    task hands on of a language is ``most`` hashes at most.
    """
    hashed = rows.select("lang", "text", F.xxhash64("id", "text").alias("hash"))
    order = W.partitionBy("lang").orderBy("hash")
    lowest = hashed.groupBy("lang", "hash").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    taken = cut(lowest.withColumn("before", before).where(F.col("before") < most).select("lang", "hash", F.least("n", most - F.col("before")).cast("int").alias("times")))
    few = taken.count() <= 1_000_000
    drawn = hashed.join(F.broadcast(taken) if few else taken, ["lang", "hash"])
    return drawn.groupBy("lang", "hash").agg(F.first("text").alias("text"), F.first("times").alias("times")).select("lang", "text", "times")


def train(docs: DataFrame, vocab: str = "piece_bpe_32k.model", docs_per_language: int = 400, text: str = "text", lang: str = "lang", id_col: str = "doc_id", learn: Column | None = None, most_mb: int = 256) -> tuple[list[str], np.ndarray]:
    """The languages in order, and the (piece, language) probabilities.

    At most ``docs_per_language`` rows of each language, or all it has, are learned from, whichever
    ids they share or lack; the bound is per language, so the model is fitted alike at every size. The model that comes
    to the driver has one number per piece and language; a column of so many languages that
    it would take more than ``most_mb`` is refused before anything is collected. No labelled
    row: no language.
    """
    def one(key: tuple, rows: pa.Table) -> pa.Table:
        texts = [t for t, k in zip(rows.column("text").to_pylist(), rows.column("times").to_pylist(), strict=True) for _ in range(k)]
        probs = fit(vocabulary(vocab), Words(texts))
        _bytes.release()
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "probs": pa.array([probs.astype("<f8").tobytes()], pa.binary())})

    known = docs.where((F.lit(True) if learn is None else learn) & F.col(lang).isNotNull())
    rows = known.select(F.col(lang).cast("string").alias("lang"), F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    if (n := rows.select("lang").distinct().count()) * 8 * (vocabulary(vocab).size + 1) > most_mb << 20:
        raise ValueError(f"the model of {n} languages takes more than {most_mb} MB")
    models = training_rows(rows, docs_per_language).groupBy("lang").applyInArrow(one, "lang string, probs binary")
    got = sorted((x["lang"], x["probs"]) for x in models.collect())
    return [x for x, _ in got], np.stack([np.frombuffer(p) for _, p in got], axis=1) if got else np.zeros((0, 0))


def predict(texts: Sequence[str], vocab: Vocabulary, names: Sequence[str], probs: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language of each text and its posterior under equal priors; ``und`` and 0 for a text with no letter."""
    if not names:
        return ["und"] * len(texts), np.zeros(len(texts))
    words = Words(texts)
    each = log_likelihood(vocab, probs, words)
    total = np.stack([np.bincount(words.row, each[words.index, k], len(texts)) for k in range(len(names))], axis=1)
    total -= total.max(axis=1, keepdims=True)
    best = total.argmax(axis=1)
    score = np.where(words.has_letter, 1 / np.exp(total).sum(axis=1), 0.0)
    return [names[k] if ok else "und" for k, ok in zip(best, words.has_letter, strict=True)], score


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], vocab: str = "piece_bpe_32k.model", text: str = "text", keep: Sequence[str] = ("doc_id",), pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns ``keep`` of every row with its language in ``pred`` and how sure that is in ``score``.

    Whole texts are scored. Null, empty and letterless texts are ``und`` with score 0, as are
    all texts under a model without languages. Equal likelihoods go to the language that
    sorts first. Repeated rows are told alike; an empty table gives no rows. Other columns of ``docs`` are neither read nor returned.
    """
    names, probs = model
    sent = docs.sparkSession.sparkContext.broadcast((names, probs))
    # Columns go through Python under plain names, as theirs may be any.
    kept = docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).alias("_tessera_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, probs = sent.value
        for b in _bytes.pieces(batches, "_tessera_text", 1 << 20):
            texts = ["" if t is None else t for t in b.column("_tessera_text").to_pylist()]
            lang, sure = predict(texts, vocabulary(vocab), names, probs)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(sure)], [*b.schema.names[:-1], "lang", "sure"])

    told = kept.mapInArrow(run, T.StructType([*kept.schema.fields[:-1], T.StructField("lang", T.StringType()), T.StructField("sure", T.DoubleType())]))
    return told.toDF(*keep, pred, score)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the language of every document, learned from those not held out."""
    docs = documents(spark, sf_dir)
    model = train(docs, learn=~held_out() & F.col("doc_id").isNotNull())
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
