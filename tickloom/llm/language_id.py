"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary. A word's
probability is the sum, over all its segmentations into pieces, of the product of their
probabilities, which a forward pass over its characters gives; a text's score is the sum of its
words' log probabilities, and the best language wins. Pieces' probabilities are fitted by
expectation maximisation on a bounded sample of labelled rows (``SAMPLE`` documents a language,
taken by least hash of their id); scoring reads all texts in full.

A word is a run without white space, led by the vocabulary's word mark, of any length. A character outside the vocabulary has the
probability ``UNKNOWN``. In each slice of texts a distinct word is scored once, in groups whose memory is bounded by words
times languages (``CELLS``); words of more than ``LONGEST`` characters are scored one by one. The vocabulary's table holds the ends
of all pieces too, so that longer pieces are looked up only where they can end.

Defined results: null, empty and blank texts have the language ``und`` and no score; rows without a
label are not used in fitting but are scored; of equal scores the first language by name wins; with no
labelled row every language is ``und``; repeated rows get equal results; other columns pass through
(``language`` is replaced).
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.kernels import prefix_sums, range_hashes, slices, text_buffers, word_spans

#: The public vocabulary; where it lies is a setting of the environment or a parameter of ``fit``.
VOCABULARY = os.environ.get("TICKLOOM_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")
SAMPLE = 400
ROUNDS = 5
SMOOTHING = 0.02
UNKNOWN = 1e-7
LONGEST = 256
LONGEST_PIECE = 16
CELLS = 1 << 20
SLICE_BYTES = 4 << 20
MARK = 0x2581
RESULT = "lang string, score double, margin double"

_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False


class Pieces:
    """The vocabulary, and all ends of its pieces, as an open-addressed table of hashes of code points."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        size = np.array([len(p) for p in pieces], np.int64)
        end, sums = np.cumsum(size), prefix_sums(codes)
        hashes, ids = [], []
        for k in range(1, int(size.max(initial=0)) + 1):
            of = np.flatnonzero(size >= k)
            hashes.append(range_hashes(sums, end[of] - k, end[of]))
            ids.append(np.where(size[of] == k, of, -2))
        hashes, ids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, ids))
        order = np.lexsort((-ids, hashes))  # of one hash the piece comes first, then a mere end
        hashes, ids = hashes[order], ids[order]
        first = np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)]
        hashes, ids = hashes[first], ids[first]
        bits = max(8, int(len(ids) * 3).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.ids = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, slot, self.probes = np.arange(len(ids)), (hashes & self.mask).astype(np.int64), 1
        while len(left):  # all entries at once, those that meet another go on to the next slot
            free = self.ids[slot] == -1
            _, winner = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[winner]
            self.keys[slot[put]], self.ids[slot[put]] = hashes[left[put]], ids[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, slot = left[rest], (slot[rest] + 1) & int(self.mask)
            self.probes += 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, -2 where only longer pieces end so, -1 where none does."""
        slot = h & self.mask
        out = self.ids[slot]
        left = np.flatnonzero((self.keys[slot] != h) & (out != -1))
        out[left] = -1
        slot = slot[left]
        for _ in range(self.probes):
            if not len(left):
                break
            slot = (slot + np.uint64(1)) & self.mask
            ids = self.ids[slot]
            hit = self.keys[slot] == h[left]
            out[left[hit]] = ids[hit]
            go = ~hit & (ids != -1)
            left, slot = left[go], slot[go]
        return out


def vocabulary(path: str = VOCABULARY) -> list[str]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p for p in pieces if len(p) <= LONGEST_PIECE]


@dataclass
class Model:
    langs: list[str]
    pieces: Pieces
    prob: np.ndarray  # (pieces + 1, languages); the last row is 0


def distinct_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, start, length, which, row): the distinct words' code points; which word each word of each row is."""
    start, end, row = word_spans(buf, off, _SOLID)
    if not len(start):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint32), z, z, z, z
    h, first, which = np.unique(range_hashes(prefix_sums(buf), start, end), return_index=True, return_inverse=True)
    # the words' bytes one after the other, each behind the mark
    n = (end - start)[first]
    at = np.append(0, np.cumsum(n + 3))
    data = np.empty(int(at[-1]), np.uint8)
    for k, byte in enumerate("▁".encode()):
        data[at[:-1] + k] = byte
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    data[np.repeat(at[:-1] + 3, n) + within] = buf[np.repeat(start[first], n) + within]
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    size = np.add.reduceat((data & 0xC0) != 0x80, at[:-1], dtype=np.int64)
    if len(codes) != size.sum():  # some bytes are no characters
        words = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
        codes, size = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.array([len(w) for w in words], np.int64)
    return codes, np.cumsum(size) - size, size, which, row


def forward(codes: np.ndarray, start: np.ndarray, length: np.ndarray, model: Model) -> np.ndarray:
    """The log probability (words, languages) of each word, over all its segmentations."""
    langs, sums = model.prob.shape[1], prefix_sums(codes)
    out = np.zeros((len(start), langs))
    order = np.argsort(-length, kind="stable")
    long = int(np.searchsorted(-length[order], -LONGEST))
    for w in order[:long].tolist():
        out[w] = _forward_one(sums, int(start[w]), int(length[w]), model)
    group = max(256, CELLS // max(langs, 1))
    for i in range(long, len(order), group):
        of = order[i : i + group]
        out[of] = _forward(sums, start[of], length[of], model)
    return out


def _forward(sums: np.ndarray, begin: np.ndarray, size: np.ndarray, model: Model) -> np.ndarray:
    """As ``forward``, of words from the longest to the shortest."""
    n, langs = len(begin), model.prob.shape[1]
    ring = np.zeros((LONGEST_PIECE + 1, n, langs))
    ring[0] = 1
    scale, result = np.zeros((n, langs)), np.zeros((n, langs))
    longest = int(size[0]) if n else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 2), "right")
    for t in range(1, longest + 1):
        a = int(active[t - 1])
        cur = np.zeros((a, langs))
        live, end = np.arange(a), begin[:a] + t
        for k in range(1, min(t, LONGEST_PIECE) + 1):
            found = model.pieces.find(range_hashes(sums, end - k, end))
            before = ring[(t - k) % (LONGEST_PIECE + 1)]
            hit = found >= 0
            rows = live[hit]
            cur[rows] += before[rows] * model.prob[found[hit]]
            if k == 1:
                rows = live[~hit]
                cur[rows] += before[rows] * UNKNOWN
            more = found != -1
            live, end = live[more], end[more]
            if not len(live):
                break
        ring[t % (LONGEST_PIECE + 1), :a] = cur
        done = int(active[t])  # the rows of length t are the last active ones
        if done < a:
            result[done:a] = np.log(np.maximum(cur[done:a], 1e-300)) + scale[done:a]
        if t % 4 == 0:
            top = np.maximum(cur, 1e-300)
            ring[:, :a] /= top
            scale[:a] += np.log(top)
    return result


def _forward_one(sums: np.ndarray, begin: int, size: int, model: Model) -> np.ndarray:
    """As ``forward``, of one long word: pieces are looked up at all places at once."""
    _, lo, hi, piece = _arcs(sums, np.array([begin]), np.array([size]), model.pieces)
    order = np.argsort(hi, kind="stable")
    lo, piece, cut = lo[order].tolist(), piece[order].tolist(), np.searchsorted(hi[order], np.arange(size + 2)).tolist()
    prob = np.vstack([model.prob[:-1], np.full((1, model.prob.shape[1]), UNKNOWN)])  # piece -1 is a character outside the vocabulary
    ring = np.zeros((LONGEST_PIECE + 1, prob.shape[1]))
    ring[0] = 1
    scale, cur = np.zeros(prob.shape[1]), ring[0]
    for t in range(1, size + 1):
        cur = sum(ring[lo[i] % (LONGEST_PIECE + 1)] * prob[piece[i]] for i in range(cut[t], cut[t + 1]))
        ring[t % (LONGEST_PIECE + 1)] = cur
        if t % 4 == 0:
            top = np.maximum(cur, 1e-300)
            ring /= top
            scale += np.log(top)
            cur = ring[t % (LONGEST_PIECE + 1)]
    return np.log(np.maximum(cur, 1e-300)) + scale


def _arcs(sums: np.ndarray, start: np.ndarray, length: np.ndarray, pieces: Pieces) -> np.ndarray:
    """(word, from, to, piece) of every match; a missing single character has the piece -1."""
    word = np.repeat(np.arange(len(length)), length)
    at = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length) + 1
    arcs = []
    for k in range(1, LONGEST_PIECE + 1):
        if not len(word):
            break
        end = start[word] + at
        found = pieces.find(range_hashes(sums, end - k, end))
        use = np.ones(len(found), bool) if k == 1 else found >= 0
        arcs.append(np.stack([word[use], at[use] - k, at[use], np.maximum(found[use], -1)]))
        more = (found != -1) & (at > k)
        word, at = word[more], at[more]
    return np.concatenate(arcs, 1) if arcs else np.zeros((4, 0), np.int64)


class _Words:
    """Words of one group with their matches, for the passes of expectation maximisation."""

    def __init__(self, sums: np.ndarray, start: np.ndarray, length: np.ndarray, count: np.ndarray, pieces: Pieces):
        self.length, self.count, self.pieces = length, count, pieces.n
        self.word, self.lo, self.hi, self.piece = _arcs(sums, start, length, pieces)
        steps = np.arange(int(length.max()) + 2)
        self.by_end, self.by_begin = np.argsort(self.hi, kind="stable"), np.argsort(self.lo, kind="stable")
        self.end_cut, self.begin_cut = np.searchsorted(self.hi[self.by_end], steps), np.searchsorted(self.lo[self.by_begin], steps)

    def expected(self, prob: np.ndarray) -> np.ndarray:
        """How often each piece is expected in all segmentations; sums stay logarithms, so words may be long."""
        word, lo, hi, n, width = self.word, self.lo, self.hi, len(self.length), int(self.length.max()) + 1
        p = np.where(self.piece >= 0, prob[self.piece], UNKNOWN)
        alpha, beta = np.full((width, n), -np.inf), np.full((width, n), -np.inf)
        alpha[0] = 0
        beta[self.length, np.arange(n)] = 0
        for t in range(1, width):
            i = self.by_end[self.end_cut[t] : self.end_cut[t + 1]]
            of = np.flatnonzero(self.length >= t)
            total = np.bincount(word[i], np.exp(alpha[lo[i], word[i]] - alpha[t - 1, word[i]]) * p[i], n)
            alpha[t, of] = alpha[t - 1, of] + np.log(total[of])
        for t in range(width - 2, -1, -1):
            i = self.by_begin[self.begin_cut[t] : self.begin_cut[t + 1]]
            of = np.flatnonzero(self.length > t)
            total = np.bincount(word[i], np.exp(beta[hi[i], word[i]] - beta[t + 1, word[i]]) * p[i], n)
            beta[t, of] = beta[t + 1, of] + np.log(total[of])
        known = self.piece >= 0
        w = word[known]
        share = np.exp(alpha[lo[known], w] + beta[hi[known], w] - beta[0, w]) * p[known] * self.count[w]
        return np.bincount(self.piece[known], share, self.pieces)


def fit_language(texts: list[str], pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities by expectation maximisation over all segmentations of the texts' words."""
    buf, off = text_buffers(pa.array(texts, pa.large_string()))
    codes, start, length, which, _ = distinct_words(buf, off)
    prob = np.full(pieces.n, 1 / pieces.n)
    if not len(start):
        return prob
    count, sums, order = np.bincount(which, minlength=len(start)).astype(float), prefix_sums(codes), np.argsort(length, kind="stable")
    groups, i = [], 0
    while i < len(order):  # words of like length, so that a group's tables stay small
        fits = np.flatnonzero((length[order[i:]] + 1) * np.arange(1, len(order) - i + 1) <= CELLS)
        of = order[i : i + max(1, int(fits.max(initial=0)) + 1)]
        groups.append(_Words(sums, start[of], length[of], count[of], pieces))
        i += len(of)
    for _ in range(rounds):
        prob = sum(g.expected(prob) for g in groups) + SMOOTHING
        prob /= prob.sum()
    return prob


def fit(docs: DataFrame, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, path: str = VOCABULARY) -> Model | None:
    """A model from at most ``sample`` labelled rows a language; None without any."""
    labelled = docs.select(F.col(label_col).alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col).alias("h")).filter("lang is not null and text is not null")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not counts:
        return None
    pieces = Pieces(vocabulary(path))
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1 << 30, int((1 << 30) * 2 * sample / n)))))
    near = labelled.filter(F.pmod("h", F.lit(1 << 30)) <= share[F.col("lang")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    rows = near.withColumn("k", rank).filter(F.col("k") <= sample).select("lang", "text").collect()  # at most ``sample`` a language
    langs = sorted(counts)
    prob = np.zeros((pieces.n + 1, len(langs)))
    for k, lang in enumerate(langs):
        prob[:-1, k] = fit_language([r.text for r in rows if r.lang == lang], pieces)
    return Model(langs, pieces, prob)


def score_texts(column: pa.Array, model: Model) -> tuple[list, list, list]:
    """(language, log probability, margin over the second a character) of each text."""
    buf, off = text_buffers(column)
    langs, scores, margins = [], [], []
    for i, j in slices(off, SLICE_BYTES):
        codes, start, length, which, row = distinct_words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        n = j - i
        ll = forward(codes, start, length, model)
        total = np.stack([np.bincount(row, ll[which, k], n) for k in range(len(model.langs))], 1) if len(row) else np.zeros((n, len(model.langs)))
        chars = np.bincount(row, length[which], n) if len(row) else np.zeros(n)
        best = total.argmax(1)
        top = np.sort(total, 1)
        for r in range(n):
            if chars[r] == 0:
                langs.append("und"), scores.append(None), margins.append(None)
            else:
                langs.append(model.langs[best[r]])
                scores.append(float(top[r, -1]))
                margins.append(float((top[r, -1] - top[r, -2]) / chars[r]) if len(model.langs) > 1 else None)
    return langs, scores, margins


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``language`` (see ``RESULT``)."""
    if model is None:
        return docs.withColumn("language", F.struct(F.lit("und").alias("lang"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("margin")))

    @F.arrow_udf(RESULT)
    def run(column: pa.Array) -> pa.Array:
        langs, scores, margins = score_texts(column, model)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())], names=["lang", "score", "margin"])

    return docs.withColumn("language", run(F.col(text_col).cast("string")))
