"""The public tokenizers over whole Arrow columns.

The tokenizers library spends most of its time on words that it has met before. Both of
its vocabularies here split a text into pieces by a pattern that looks at character
classes, and encode each piece on its own; so the pieces of a whole column are found with
numpy in its UTF-8 bytes, folded to the distinct ones, and only those that are new go to the
library, many in one string. Texts with a character whose class is not settled go to the
library whole.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

from tessera.llm import _bytes

LETTER, NUMBER, SPACE, OTHER, UNSURE = 1, 2, 3, 4, 0


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point; unsure where it changed since Unicode 3.2, which any later table may not share."""
    old, out = unicodedata.ucd_3_2_0.category, np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if (k := old(ch)) == unicodedata.category(ch):
            out[c] = UNSURE if k == "Cn" else LETTER if k[0] == "L" else NUMBER if k[0] == "N" else OTHER
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    out[0xD800:0xE000] = UNSURE
    return out


@functools.cache
def _lower() -> np.ndarray:
    """The lower case of the code points under 0x250; 0 where it is not one of as many bytes."""
    one = [c.lower() for c in map(chr, range(0x250))]
    return np.array([ord(x) if len(x) == 1 and len(x.encode()) == len(c.encode()) else 0 for c, x in zip(map(chr, range(0x250)), one)], np.int32)


class Characters:
    """The class of each byte's character, and where the characters of more than one byte are.

    ``lower``: the bytes in lower case, as far as that is settled; ``odd``: bytes at which a
    character begins whose class (or lower case) is not.
    """

    def __init__(self, data: np.ndarray, lower: bool):
        if lower:
            data = data + ((data - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32)
        kind = classes()[:256].astype(np.uint8)[data]
        lead = np.flatnonzero(data >= 0xC0)
        wide = np.append(data, np.zeros(3, np.uint8))
        a, b, c, d = (wide[lead + k].astype(np.int32) for k in range(4))
        self.three, self.four = a >= 0xE0, a >= 0xF0
        point = np.where(self.four, ((a & 7) << 18) | ((b & 63) << 12) | ((c & 63) << 6) | (d & 63), np.where(self.three, ((a & 15) << 12) | ((b & 63) << 6) | (c & 63), ((a & 31) << 6) | (b & 63)))
        of = classes()[point]
        bad = of == UNSURE
        if lower:
            small = np.where(point < 0x250, _lower()[np.minimum(point, 0x24F)], 0)
            of = np.where(small > 0, classes()[small], UNSURE)
            bad |= of == UNSURE
            at = lead[~bad]
            data[at], data[at + 1] = 0xC0 | (small[~bad] >> 6), 0x80 | (small[~bad] & 63)
        self.inner = np.concatenate((lead + 1, lead[self.three] + 2, lead[self.four] + 3))
        kind[lead] = of
        kind[self.inner] = np.concatenate((of, of[self.three], of[self.four]))
        self.data, self.kind, self.lead, self.size = data, kind, lead, 2 + self.three + self.four
        self.odd = np.concatenate((lead[bad], np.flatnonzero((data < 0x80) & (kind == UNSURE))))


def _contract(text: Characters, start: np.ndarray, ok: np.ndarray, border: np.ndarray) -> None:
    """Cuts 's 't 'm 'd 're 've 'll off behind, where their apostrophe may begin a piece and does."""
    at = np.flatnonzero((text.data == 0x27) & ok)
    if not at.size:
        return
    n = len(text.data)
    wide = np.append(text.data, np.zeros(2, np.uint8))
    a, b = wide[at + 1], wide[at + 2]
    two = np.isin(a, [ord(x) for x in "stmd"])
    three = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    size = np.where(two, 2, np.where(three, 3, 0))
    fits = size > 0
    for k in (1, 2):
        fits &= (size <= k) | ~border[np.minimum(at + k, n)]
    at, size = at[fits], size[fits]
    start[at + 1] = False
    end = at + size
    start[end[end < n]] = True


def byte_level_starts(text: Characters, borders: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Flags of the bytes that begin a piece of ``'s|..| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

    ``borders``: where texts begin, and the end; ``border`` has them as flags, one more than bytes.
    """
    kind, n = text.kind, len(text.kind)
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[:1], before[1:] = 0, kind[:-1]
    before[borders[:-1]] = 0
    after[-1:], after[:-1] = 0, kind[1:]
    after[borders[1:] - 1] = 0
    then = text.lead + text.size
    after[text.lead] = np.where(border[then], 0, np.append(kind, np.uint8(0))[then])
    blank = np.empty(n, bool)
    blank[:1], blank[1:] = False, text.data[:-1] == 0x20
    blank &= before == SPACE
    space = kind == SPACE
    start = np.where(space, (before != SPACE) | ((after != SPACE) & (after != 0)), (before != kind) & ~blank)
    start[text.inner] = False
    _contract(text, start, start & ~space, border)
    return start


def word_level_starts(text: Characters, borders: np.ndarray, border: np.ndarray) -> np.ndarray:
    """The same for ``'s|..|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+``; runs of white space are pieces here, to be left out."""
    kind = text.kind
    before = np.empty_like(kind)
    before[:1], before[1:] = 0, kind[:-1]
    before[borders[:-1]] = 0
    start = (before != kind) | (kind == NUMBER)
    start[text.inner] = False
    _contract(text, start, start.copy(), border)
    return start


#: Masks for the first 0 to 8 bytes of a little-endian word.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Pieces of up to so many bytes are looked up by their bytes and length as two words.
SHORT = 15


class _Table:
    """Slots by two-word keys, by open addressing; whole columns at once. A row is low word, high word, slot + 1."""

    def __init__(self, bits: int):
        self.bits, self.n = bits, 0
        self.shift, self.wrap = np.uint64(64 - bits), (1 << bits) - 1
        self.rows = np.zeros((1 << bits, 4), np.uint64)

    def _home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
            return (((h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)) >> self.shift).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        at = self._home(low, high)
        got = self.rows.take(at, axis=0)
        out = np.where((got[:, 0] == low) & (got[:, 1] == high), got[:, 2].view(np.int64), 0) - 1
        rows = np.flatnonzero((out < 0) & (got[:, 2] > 0))
        while rows.size:
            at[rows] = here = (at[rows] + 1) & self.wrap
            got = self.rows[here]
            hit = (got[:, 0] == low[rows]) & (got[:, 1] == high[rows])
            out[rows[hit]] = got[hit, 2].view(np.int64) - 1
            rows = rows[~hit & (got[:, 2] > 0)]
        return out

    def add(self, low: np.ndarray, high: np.ndarray, slots: np.ndarray) -> None:
        """Distinct keys that are not there."""
        if 3 * (self.n + len(low)) > 2 * len(self.rows):
            old = self.rows[self.rows[:, 2] > 0]
            self.__init__((3 * (self.n + len(low))).bit_length())
            self.add(old[:, 0], old[:, 1], old[:, 2].view(np.int64) - 1)
        self.n += len(low)
        at, rows, mark = self._home(low, high), np.arange(len(low)), (slots + 1).astype(np.uint64)
        while rows.size:
            free = rows[self.rows[at[rows], 2] == 0]
            self.rows[at[free], 2] = mark[free]  # of several that want a place, one gets it
            won = free[self.rows[at[free], 2] == mark[free]]
            self.rows[at[won], 0], self.rows[at[won], 1] = low[won], high[won]
            rows = rows[self.rows[at[rows], 2] != mark[rows]]
            at[rows] = (at[rows] + 1) & self.wrap


class Encoder:
    """Ids as the tokenizers library gives them for a vocabulary file, without added special tokens."""

    def __init__(self, path: str, cache_pieces: int = 340_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = {t.content.encode(): i for i, t in self.library.get_added_tokens_decoder().items()}
        self.pattern = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or b"(?!)")
        self.word_level = self.library.normalizer is not None
        vocab = self.library.get_vocab()
        #: Ids that end a piece of the word vocabulary, or begin one behind a blank of the other.
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[[i for t, i in vocab.items() if (t.endswith("</w>") if self.word_level else t[0] == "Ġ")]] = True
        self.most = cache_pieces
        self.forget()
        _bytes.release()

    def forget(self) -> None:
        """Pieces met so far have a slot each: how many ids, and where they begin."""
        self.short, self.long = _Table(max(10, (self.most * 3 // 2).bit_length())), {}
        self.size, self.begin, self.flat = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)
        self.slots = self.used = 0

    def _new(self, pieces: list[str]) -> np.ndarray:
        """Slots for pieces that have none."""
        ids, size = self._asked(pieces)
        at, n, total = self.slots, len(pieces), len(ids)
        while at + n > len(self.size):
            self.size, self.begin = np.resize(self.size, 2 * len(self.size)), np.resize(self.begin, 2 * len(self.begin))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.size[at : at + n] = size
        self.begin[at : at + n] = self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + total] = ids
        self.slots, self.used = at + n, self.used + total
        return np.arange(at, at + n)

    def _looked_up(self, data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The slot of each piece ``data[at : at + length]``. Beyond ``most`` slots all are forgotten first but these pieces' own."""
        padded = np.zeros(len(data) + 16, np.uint8)
        padded[: len(data)] = data
        eight = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
        low = eight[at] & _MASK[np.minimum(length, 8)]
        high = (eight[at + 8] & _MASK[np.clip(length - 8, 0, 7)]) | (length.astype(np.uint64) << np.uint64(56))
        short = length <= SHORT
        slots = np.where(short, self.short.find(low, high), -1)
        far = np.flatnonzero(~short)
        if far.size:
            raw, cuts = _bytes.gathered(data, at[far], length[far])
            folded = pa.Array.from_buffers(pa.binary(), len(far), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
            names, which = folded.dictionary.to_pylist(), folded.indices.to_numpy()
            slots[far] = np.array([self.long.get(x, -1) for x in names], np.int64)[which]
        if self.slots > self.most:
            had = np.unique(slots[slots >= 0])
            size, begin, flat = self.size[had].astype(np.int64), self.begin[had].astype(np.int64), self.flat
            self.forget()
            while len(self.size) < len(had):
                self.size, self.begin = np.resize(self.size, 2 * len(self.size)), np.resize(self.begin, 2 * len(self.begin))
            self.slots, self.used = len(had), int(size.sum())
            self.size[: len(had)], self.begin[: len(had)] = size, np.cumsum(size) - size
            self.flat = flat[np.arange(self.used) + np.repeat(begin - self.begin[: len(had)], size)] if self.used else self.flat
            slots = np.where(slots >= 0, np.searchsorted(had, slots), -1)
            rows = np.flatnonzero(short & (slots >= 0))
            _, first = np.unique(slots[rows], return_index=True)
            self.short.add(low[rows[first]], high[rows[first]], slots[rows[first]])
            if far.size:
                self.long = {names[k]: s for k, s in zip(which.tolist(), slots[far].tolist()) if s >= 0}
        miss = np.flatnonzero(short & (slots < 0))
        if miss.size:
            order = miss[np.lexsort((low[miss], high[miss]))]
            lead = np.ones(len(order), bool)
            lead[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
            one = order[lead]
            raw, cuts = _bytes.gathered(data, at[one], length[one])
            new = self._new(pa.Array.from_buffers(pa.string(), len(one), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(raw)]).to_pylist())
            self.short.add(low[one], high[one], new)
            slots[order] = new[np.cumsum(lead) - 1]
        if far.size and len(new_names := [x for x in names if x not in self.long]):
            self.long.update(zip(new_names, self._new([x.decode() for x in new_names]).tolist()))
            slots[far] = np.array([self.long[x] for x in names], np.int64)[which]
        return slots

    def _joined(self, pieces: list[str], glue: str, a_string: int = 512) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of ``pieces`` and how many each has, asked for in long strings; None if the ids do not tell them apart."""
        strings, got = [glue.join(pieces[k : k + a_string]) for k in range(0, len(pieces), a_string)], []
        for k in range(0, len(strings), 16):  # what the library returns is many times larger than the ids
            got += [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(strings[k : k + 16], add_special_tokens=False)]
        ids = np.concatenate(got)
        edges = np.flatnonzero(self.edge[ids])
        if len(edges) != len(pieces) or edges[-1 if self.word_level else 0] != (len(ids) - 1 if self.word_level else 0):
            return None
        return ids, np.diff(edges, prepend=-1) if self.word_level else np.diff(edges, append=len(ids))

    def _asked(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces one behind the other, and how many each has."""
        if self.word_level:
            easy = np.ones(len(pieces), bool)
        else:
            easy = np.fromiter((s[0] == " " and not s.isspace() for s in pieces), bool, len(pieces))
        some = [s for s, ok in zip(pieces, easy.tolist()) if ok]
        quick = self._joined(some, " " if self.word_level else "") if len(some) > 1 else None
        if quick is None:
            easy[:] = False
        rest = self.library.encode_batch_fast([s for s, ok in zip(pieces, easy.tolist()) if not ok], add_special_tokens=False)
        size = np.empty(len(pieces), np.int64)
        size[~easy] = np.fromiter((len(e.ids) for e in rest), np.int64, len(rest))
        ids, parts = np.fromiter((i for e in rest for i in e.ids), np.uint32), size[~easy]
        if quick is not None:
            size[easy] = quick[1]
            ids, parts = np.concatenate((quick[0], ids)), np.concatenate((quick[1], parts))
        first = np.empty(len(pieces), np.int64)
        first[np.concatenate((np.flatnonzero(easy), np.flatnonzero(~easy)))] = np.cumsum(parts) - parts
        total = int(size.sum())
        return ids[np.arange(total) + np.repeat(first - (np.cumsum(size) - size), size)], size

    def parts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The borders of rows and special strings in ``data``, and the special id between each two (-1: plain text)."""
        blob = data.tobytes()
        if not any(s in blob for s in self.special):
            cuts = np.unique(off)
            return cuts, np.full(len(cuts) - 1, -1)
        where = np.array([m.span() for m in self.pattern.finditer(blob)])
        first, last = (np.searchsorted(off, x, "right") - 1 for x in (where[:, 0], where[:, 1] - 1))
        rows = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)]))  # a hit over a row's end is none
        hits = [(*m.span(), self.special[m[0]]) for r in rows for m in self.pattern.finditer(blob, int(off[r]), int(off[r + 1]))]
        begin, end, ids = (np.array(x, np.int64) for x in zip(*hits)) if hits else (np.zeros(0, np.int64),) * 3
        cuts = np.unique(np.concatenate((off, begin, end)))
        then = np.full(len(cuts) - 1, -1)
        then[np.searchsorted(cuts, begin)] = ids
        return cuts, then

    def pieces(self, data: np.ndarray, cuts: np.ndarray, then: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, tokens, place among the ids) of each piece in order, and the ids; special strings are pieces.

        ``data`` is UTF-8, whose ``parts`` are ``cuts`` and ``then``. Of a part that goes to the
        word-level library whole, only the first byte is told.
        """
        if not len(data):
            return (np.zeros(0, np.int64),) * 3 + (self.flat,)
        text = Characters(data, self.word_level)
        border = np.zeros(len(data) + 1, bool)
        border[cuts] = True
        start = (word_level_starts if self.word_level else byte_level_starts)(text, cuts, border)
        start[cuts[:-1]] = True
        at = np.flatnonzero(start)
        length = np.diff(at, append=len(data))
        if self.word_level:
            keep = text.kind[at] != SPACE
            at, length = at[keep], length[keep]
        slots = self._looked_up(text.data, at, length)
        size, begin, flat = self.size[slots].astype(np.int64), self.begin[slots].astype(np.int64), self.flat
        odd = np.unique(np.searchsorted(cuts, text.odd, "right") - 1) if text.odd.size else text.odd
        odd = odd[then[odd] < 0]
        special = np.flatnonzero(then >= 0)
        if not odd.size and not special.size:
            return at, size, begin, flat
        plain = np.ones(len(cuts) - 1, bool)
        plain[odd] = plain[special] = False
        keep = plain[np.repeat(np.arange(len(plain)), np.diff(np.searchsorted(at, cuts)))]
        more = [(at[keep], size[keep], begin[keep]), (cuts[special], np.ones(len(special), np.int64), len(flat) + np.arange(len(special)))]
        extra, base = [flat, then[special].astype(np.uint32)], len(flat) + len(special)
        for i in odd:
            raw = data[cuts[i] : cuts[i + 1]]
            whole = raw.tobytes().decode()
            e = self.library.encode(whole, add_special_tokens=False)
            if self.word_level:
                spans, n = np.zeros(1, np.int64), np.array([len(e.ids)])
            else:
                first = np.array([s for _, (s, _) in self.library.pre_tokenizer.pre_tokenize_str(whole)], np.int64)
                spans = np.flatnonzero((raw & 0xC0) != 0x80)[first]
                n = np.bincount(np.array(e.word_ids, np.int64), minlength=len(spans))
            more.append((cuts[i] + spans, n, base + np.cumsum(n) - n))
            extra.append(np.array(e.ids, np.uint32))
            base += len(e.ids)
        at, size, begin = (np.concatenate(x) for x in zip(*more, strict=True))
        order = np.argsort(at, kind="stable")
        return at[order], size[order], begin[order], np.concatenate(extra)

    def encode(self, texts: pa.Array | Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one behind the other, and each text's first (one more than texts). Null is empty."""
        data, off = _bytes.raw(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        at, size, begin, flat = self.pieces(data, *self.parts(data, off))
        upto = np.concatenate(([0], np.cumsum(size)))
        return flat[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], size)], upto[np.searchsorted(at, off)]


@_bytes.one_model
def encoder(name: str) -> Encoder:
    """One encoder a process for a file that ``public_tokenizers`` names, or for a path."""
    if "/" in name:
        return Encoder(name)
    import public_tokenizers

    return Encoder(public_tokenizers.path(name))
