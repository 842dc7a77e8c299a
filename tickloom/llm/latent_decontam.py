"""Benchmark decontamination by latent semantic retrieval.

A leak of an item is a stretch of a document of at most ``STRETCH`` times the item's words whose longest common
subsequence with the item has the share ``LCS`` of its words, or the share ``LCS_ANSWER`` when the item's answer (its
last sentence) is found there to the share ``ANSWER``, which tells a paraphrase from a shared subject.

Three passes read the corpus, cut into passages of ``PASSAGE`` words:

1. document frequencies of hashed terms, and a sketch of the term-frequency matrix: each passage is added, with a random
   sign, to one of ``SKETCH`` rows. Scaled by the inverse document frequencies, the rows span the range of the TF-IDF
   matrix A, which has no term of weight zero.
2. the second half of the randomised SVD: all passages are projected on that range, the small Gram matrix of the
   projections is summed, and its ``RANK`` leading eigenvectors give A's right singular vectors V and values S.
3. the search: half passages, and pairs of them, are projected with V / S and compared with all parts of all items.
   Where a cosine reaches ``COSINE`` the places around are candidates. ``exact`` adds all places that hold enough of an
   item's least frequent words for a leak; no leak is without them, so that with it the search misses none, however
   frequent the item's words are.

A candidate is weighed by bounds that no leak fails (how many of the item's words are there at all) and then by the
subsequence itself, from every word of the place on. An item that words in more than ``COMMON`` of the passages could
make up to ``LCS_ANSWER`` meets such a share by chance, so its subsequence must also be longer, by the share ``ORDER``,
than the one with the stretch turned round, unless it stands there whole. An item of less than ``SHORTEST`` words must
stand there whole, and matches nothing when all its words are in more than ``COMMON`` of the passages.

What the driver and a task hold depends on ``TERMS``, ``SKETCH`` and the benchmark only. The benchmark is broadcast; its
size is checked against ``MAX_ITEMS`` words, and a larger one is searched in parts. The first pass sums its sketch in at
least two partials a core and one for every ``PARTIAL`` bytes of input.

Defined results: null and empty texts and items match nothing; ``find_leaks`` ignores rows with a null id, ``drop_leaked``
keeps or drops them by their text, and so rows that share an id; of several matches in a document each item is one row,
with its best share; repeated rows give one row; other columns are not read by the search.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.kernels import mix, ngrams, row_bounds, slices, text_buffers, word_hashes
from tickloom.llm.staging import materialise

PASSAGE = 64
HALF = PASSAGE // 2
TERMS = 1 << 16
SKETCH = 128
RANK = 96
COSINE = 0.2
LCS = 0.7
LCS_ANSWER = 0.6
ANSWER = 0.7
STRETCH = 1.5
COMMON = 0.25
ORDER = 0.25
LISTED = 0.6
SHORTEST = 6
MAX_ITEMS = 2_000_000
GROUP = 1024
PARTIAL = 2 << 30
LONG = 1 << 18
CHUNK = 1024
SENTENCE = re.compile(r"(?<=[.!?])\s+")
SUMS = "part int, v array<float>"


def _words(column: pa.Array):
    """(first row, number of rows, word hashes, where each row's words begin) by slices."""
    buf, off = text_buffers(column)
    for i, j in slices(off):
        words, row = word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        yield i, j - i, words, row_bounds(row, j - i)


def _terms(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(TERMS - 1)).astype(np.int32)


def _passages(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each passage of at most ``size`` words, its row, its number in the row); no passage crosses a row."""
    count = -(-np.diff(at) // size)
    row = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return at[:-1][row] + k * size, row, k


def _rows(parts: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(values.astype(np.float32).ravel())
    at = pa.array(np.arange(len(parts) + 1, dtype=np.int32) * values.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.ListArray.from_arrays(at, flat)], names=["part", "v"])


def _sketch(batches):
    """The sketch's rows, then document frequencies, then the number of passages, in pieces of ``CHUNK`` terms."""
    total, n = np.zeros((SKETCH + 2, TERMS)), 0
    flat = total.reshape(-1)
    for batch in batches:
        ids = batch.column("doc_id").fill_null(0).to_numpy().view(np.uint64)
        for i, _, words, at in _words(batch.column("text")):
            if not len(words):
                continue
            start, row, k = _passages(at, PASSAGE)
            size = np.diff(np.append(start, len(words)))
            which, terms = np.repeat(np.arange(len(start)), size), _terms(words)
            key = np.sort(which * TERMS + terms)
            key = key[np.append(True, key[1:] != key[:-1])]
            total[SKETCH] += np.bincount(key & (TERMS - 1), minlength=TERMS)
            drawn = mix(ids[i + row] * np.uint64(0x9E3779B97F4A7C15) + k.astype(np.uint64))
            value = np.where(drawn >> np.uint64(63), 1.0, -1.0) / np.sqrt(size)
            np.add.at(flat, (drawn % np.uint64(SKETCH)).astype(np.int64)[which] * TERMS + terms, value[which])
            n += len(start)
    total[SKETCH + 1, 0] = n
    parts = total.reshape(-1, CHUNK)
    used = np.flatnonzero(np.abs(parts).max(1))
    for k in range(0, len(used), 2048):
        yield _rows(used[k : k + 2048], parts[used[k : k + 2048]])


def _sum(batches):
    """The sums of the vectors of each part."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        v, parts = batch.column("v"), batch.column("part").to_numpy()
        flat = v.flatten().to_numpy(zero_copy_only=False).reshape(len(parts), -1)
        for k, p in enumerate(parts.tolist()):
            if p in total:
                total[p] += flat[k]
            else:
                total[p] = flat[k].astype(np.float64)
    if total:
        yield _rows(np.array(list(total)), np.stack(list(total.values())))


def _summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of all partials of a matrix whose size doesn't depend on the input."""
    found = parts.repartition("part").mapInArrow(_sum, SUMS).toArrow()
    out = np.zeros(shape, np.float32)
    if found.num_rows:
        v = found["v"].combine_chunks().flatten().to_numpy().reshape(found.num_rows, -1)
        out.reshape(-1, v.shape[1])[found["part"].to_numpy()] = v
    return out


def _project(words: np.ndarray, start: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(passages, rank): sums of rows of (TERMS + 1, rank), whose last row is 0, over the words from each start to the next."""
    size = np.diff(np.append(start, len(words)))
    terms = np.full((len(start), int(size.max(initial=0))), TERMS, np.int64)
    terms[np.repeat(np.arange(len(start)), size), np.arange(len(words)) - np.repeat(start, size)] = _terms(words)
    out = np.zeros((len(start), table.shape[1]), np.float32)
    for i in range(0, len(start), 512):  # sums that stay in the cache
        part = out[i : i + 512]
        for column in terms[i : i + 512].T:
            part += table[column]
    return out


def _gram(table: np.ndarray):
    """Rows of the Gram matrix of all passages' projections."""

    def run(batches):
        total = np.zeros((table.shape[1], table.shape[1]))
        for batch in batches:
            for _, _, words, at in _words(batch.column("text")):
                if len(words):
                    start, _, _ = _passages(at, PASSAGE)
                    y = _project(words, start, table) / np.sqrt(np.diff(np.append(start, len(words))))[:, None].astype(np.float32)
                    total += y.T @ y
        yield _rows(np.arange(len(total)), total)

    return run


def _partials(texts: DataFrame) -> int:
    """Into how many partials the sketch is summed: it grows with the input, and keeps all cores busy."""
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(2 * texts.sparkSession.sparkContext.defaultParallelism, min(-(-size // PARTIAL), 1 << 20))


def latent_basis(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(share of passages with each term, projection (TERMS + 1, rank)) from two passes over ``texts`` (doc_id, text)."""
    sketch = _summed(texts.coalesce(_partials(texts)).mapInArrow(_sketch, SUMS), (SKETCH + 2, TERMS))
    df, n = sketch[SKETCH].astype(np.float64), float(sketch[SKETCH + 1, 0])
    weight = np.log1p(n / (df + 1)).astype(np.float32)
    space = _row_space(sketch[:SKETCH] * weight) * weight
    del sketch
    if len(space):
        space = _singular(_summed(texts.mapInArrow(_gram(_table(space)), SUMS), (len(space), len(space)))) @ space
    return df / max(n, 1), _table(space)


def _table(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.append(rows, np.zeros((len(rows), 1), rows.dtype), 1).T, np.float32)


def _row_space(z: np.ndarray) -> np.ndarray:
    """Orthonormal rows that span those of z."""
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = values > max(values.max(initial=0), 1e-12) * 1e-6
    return ((vectors[:, keep] / np.sqrt(values[keep])).T.astype(np.float32)) @ z


def _singular(gram: np.ndarray) -> np.ndarray:
    """(rank, columns): the leading directions over their singular values, so that all weigh alike."""
    values, vectors = np.linalg.eigh(gram.astype(np.float64))
    best = np.argsort(-values)[:RANK]
    best = best[values[best] > max(values.max(initial=0), 1e-12) * 1e-6]
    return (vectors[:, best] / np.sqrt(values[best])).T.astype(np.float32)


def masks(words: list[int]) -> dict[int, int]:
    """The places of each word as bits."""
    at: dict[int, int] = {}
    for i, x in enumerate(words):
        at[x] = at.get(x, 0) | 1 << i
    return at


def lcs(at: dict[int, int], n: int, b) -> int:
    """The length of the longest common subsequence of b and the n words of ``masks``, with one bit for each."""
    v = full = (1 << n) - 1
    for x in b:
        m = at.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _up(x: float) -> int:
    """The least integer from x on, but for rounding of x."""
    return math.ceil(x - 1e-9)


class Item:
    """One benchmark item: its words, its answer's and the rules that it is weighed by."""

    def __init__(self, id_: int, text: str, spread: np.ndarray):
        self.id, self.words = id_, _one(text)
        self.n = len(self.words)
        answer = _one(SENTENCE.split(text.strip())[-1]).tolist() if self.n else []
        self.at, self.answer, self.answer_n = masks(self.words.tolist()), masks(answer), len(answer)
        self.span, self.least = _up(self.n * STRETCH), _up(self.n * LCS_ANSWER)
        share = spread[_terms(self.words)]
        uncommon = int((share <= COMMON).sum())
        self.short = self.n < SHORTEST
        self.silent = not self.n or self.short and not uncommon
        self.loose = not self.short and uncommon - (self.n - self.least) <= 0
        #: the least frequent words, all of one frequency together
        self.listed = share <= np.sort(share)[_up(LISTED * self.n) - 1] if self.n else share > 1

    def check(self, stretch: list[int]) -> tuple[bool, float, float]:
        """(leaked, share of the item, share of its answer) in a stretch of words."""
        length = lcs(self.at, self.n, stretch)
        share = length / self.n
        if length < self.least:
            return False, share, 0.0
        found = lcs(self.answer, self.answer_n, stretch) / self.answer_n if self.answer_n else 0.0
        leaked = share >= LCS or found >= ANSWER
        if leaked and self.loose and length - lcs(self.at, self.n, stretch[::-1]) < ORDER * self.n:
            leaked = False
        return leaked, share, found

    def best(self, place: list[int], starts: int) -> tuple[bool, float, float]:
        """The best stretch that begins at one of the first ``starts`` words of a place."""
        out = (False, 0.0, 0.0)
        if lcs(self.at, self.n, place) < self.least:
            return out
        for s in range(min(starts, len(place))):
            if place[s] in self.at:  # else the stretch from the next such word on holds as much
                out = max(out, self.check(place[s : s + self.span]))
                if out[1] == 1.0 and out[0]:
                    break
        return out


class Items:
    """A group of items as arrays: their words, the lists of their least frequent words and their projected parts."""

    def __init__(self, items: list[Item], table: np.ndarray):
        self.all, self.items = items, [x for x in items if not x.short]
        arr = lambda f: np.array([f(x) for x in self.items], np.int64)
        self.span, self.least = arr(lambda x: x.span), arr(lambda x: x.least)
        self.need = arr(lambda x: int(x.listed.sum()) - (x.n - x.least))
        self.blocks = -(-(self.span + HALF - 1) // HALF)  # half passages that hold a stretch from any word of the first
        self.back = -(-self.span // HALF)
        bags = [np.unique(x.words, return_counts=True) for x in self.items]
        self.vocabulary = np.unique(np.concatenate([w for w, _ in bags])) if bags else np.zeros(0, np.uint64)
        self.first = np.zeros(1 << 16, bool)
        self.first[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        self.bag = np.concatenate([np.searchsorted(self.vocabulary, w) for w, _ in bags] or [np.zeros(0, np.int64)])
        self.times = np.concatenate([c for _, c in bags] or [np.zeros(0, np.int64)])
        self.bag_at = np.append(0, np.cumsum([len(w) for w, _ in bags])).astype(np.int64)
        lists = [np.searchsorted(self.vocabulary, np.unique(x.words[x.listed])) for x in self.items]
        word = np.concatenate(lists or [np.zeros(0, np.int64)])
        order = np.argsort(word, kind="stable")
        self.list_item = np.repeat(np.arange(len(lists)), [len(x) for x in lists])[order]
        self.list_at = np.searchsorted(word[order], np.arange(len(self.vocabulary) + 1))
        vectors, self.part_at = [], [0]
        for x in self.items:
            for s in range(0, max(1, x.n - HALF), HALF):
                vectors.append(_project(x.words[s : s + PASSAGE], np.zeros(1, np.int64), table)[0])
            self.part_at.append(len(vectors))
        v = np.array(vectors, np.float32).reshape(len(vectors), table.shape[1])
        self.vectors = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        self.phrases: dict[int, list] = {}
        for x in items:
            if x.short or x.loose:
                self.phrases.setdefault(min(x.n, SHORTEST), []).append((int(ngrams(x.words[:SHORTEST], SHORTEST)[0]), x))
        self.phrases = {n: (np.array(sorted(g for g, _ in f), np.uint64), [x for _, x in sorted(f, key=lambda y: y[0])]) for n, f in self.phrases.items()}

    def whole(self, words: np.ndarray, row: np.ndarray):
        """(row, item) where an item that is short or of frequent words stands whole in one row."""
        for n, (grams, owners) in self.phrases.items():
            if len(words) < n:
                continue
            found = ngrams(words, n)
            low, high = np.searchsorted(grams, found), np.searchsorted(grams, found, "right")
            for at in np.flatnonzero(low < high).tolist():
                for x in owners[low[at] : high[at]]:
                    end = at + x.n
                    if end <= len(words) and row[at] == row[end - 1] and np.array_equal(words[at:end], x.words):
                        yield int(row[at]), x

    def _counts(self, block: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        """(n + 1, items): how many listed words of each item the half passages before each one have."""
        out = np.zeros((n + 1, len(self.items)), np.int32)
        many = self.list_at[word + 1] - self.list_at[word]
        cuts = np.searchsorted(np.cumsum(many), np.arange(0, int(many.sum()) + 1, 1 << 21), "right")
        for i, j in zip(cuts, np.append(cuts[1:], len(word))):
            m = many[i:j]
            item = self.list_item[np.repeat(self.list_at[word[i:j]] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))]
            out[1:] += np.bincount(np.repeat(block[i:j], m) * len(self.items) + item, minlength=n * len(self.items)).reshape(n, -1)
        return np.cumsum(out, axis=0, out=out)

    def _bagged(self, block: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        """Which places [lo, hi) have the least number of the item's words, in any order."""
        order = np.argsort(word, kind="stable")
        keys = np.append(word[order] * (n + 1) + at[order], np.iinfo(np.int64).max)
        good = np.zeros(len(block), bool)
        size = self.bag_at[item + 1] - self.bag_at[item]
        cuts = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + 1, 1 << 20), "right")
        for i, j in zip(cuts, np.append(cuts[1:], len(block))):
            m = size[i:j]
            if not len(m):
                continue
            first = np.cumsum(m) - m
            k = np.repeat(self.bag_at[item[i:j]] - first, m) + np.arange(int(m.sum()))
            base = self.bag[k] * (n + 1)
            there = keys[np.searchsorted(keys, base + np.repeat(lo[i:j], m))] < base + np.repeat(hi[i:j], m)
            good[i:j] = np.add.reduceat(there * self.times[k], first) >= self.least[item[i:j]]
        return good

    def search(self, words: np.ndarray, at: np.ndarray, start: np.ndarray, row: np.ndarray, y: np.ndarray, exact: bool) -> Iterator[tuple]:
        """(row, item, share, answer share, cosine) of the leaks of one slice; ``start`` are those of half passages."""
        n = len(start)
        if not self.items:
            return
        place = np.flatnonzero(self.first[(words >> np.uint64(48)).astype(np.int64)])
        word = np.minimum(np.searchsorted(self.vocabulary, words[place]), len(self.vocabulary) - 1)
        hit = self.vocabulary[word] == words[place]
        place, word = place[hit], word[hit]
        before = self._counts(np.repeat(np.arange(n), np.diff(np.append(start, len(words))))[place], word, n)
        enough = np.empty((n, len(self.items)), bool)
        for b in np.unique(self.blocks).tolist():
            of = np.flatnonzero(self.blocks == b)
            end = np.minimum(np.arange(n) + b, n)
            enough[:, of] = before[end][:, of] - before[:n, of] >= self.need[of]
        # cosines of half passages, and of pairs of them in one row, with all parts
        dots, own = y @ self.vectors.T, np.maximum(np.linalg.norm(y, axis=1), 1e-9)
        follows = np.append(row[1:] == row[:-1], False)
        after = np.append(np.arange(1, n), n - 1)
        both = np.where(follows, np.maximum(np.linalg.norm(y + y[after], axis=1), 1e-9), np.inf).astype(np.float32)
        near = dots >= COSINE * own[:, None]
        near |= dots + dots[after] >= (COSINE * both)[:, None]
        near = np.logical_or.reduceat(near, self.part_at[:-1], axis=1)
        block, item = np.nonzero(near)
        lo, hi = np.maximum(block - self.back[item], 0), np.minimum(block + 2, n)
        keep = before[np.minimum(hi - 1 + self.blocks[item], n), item] - before[lo, item] >= self.need[item]
        item, lo, size = item[keep], lo[keep], (hi - lo)[keep]
        chosen = np.zeros(enough.shape, bool)
        chosen[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(int(size.sum())), np.repeat(item, size)] = True
        chosen &= enough
        if exact:
            chosen |= enough
        block, item = np.nonzero(chosen)
        lo, hi = start[block], np.minimum(start[block] + HALF - 1 + self.span[item], at[row[block] + 1])
        keep = self._bagged(block, item, lo, hi, place, word, len(words))
        for b, k, i, j in zip(block[keep].tolist(), item[keep].tolist(), lo[keep].tolist(), hi[keep].tolist()):
            leaked, share, found = self.items[k].best(words[i:j].tolist(), HALF)
            if leaked:
                parts, blocks = slice(self.part_at[k], self.part_at[k + 1]), np.arange(b, min(b + int(self.blocks[k]), n))
                blocks = blocks[row[blocks] == row[b]]
                cosine = max((dots[blocks, parts] / own[blocks, None]).max(), ((dots[blocks, parts] + dots[after[blocks], parts]) / both[blocks, None]).max())
                yield int(row[b]), self.items[k], share, found, float(cosine)


def _one(text: str) -> np.ndarray:
    return next(_words(pa.array([text.lower()])))[2] if text else np.zeros(0, np.uint64)


def _pieces(words: np.ndarray, at: np.ndarray, overlap: int):
    """(words, where rows begin): a slice as it is, or a row of more than ``LONG`` words in overlapping pieces."""
    if len(at) > 2 or len(words) <= LONG:
        yield words, at
    else:
        for i in range(0, len(words), LONG):
            part = words[i : i + LONG + overlap]
            yield part, np.array([0, len(part)])


def _search(groups: list[Items], table: np.ndarray, exact: bool):
    most = 2 * PASSAGE + 2 * max((x.span for g in groups for x in g.all), default=0)

    def run(batches):
        for batch in batches:
            best: dict[tuple[int, int], tuple] = {}

            def put(r: int, x: Item, new: tuple) -> None:
                best[r, x.id] = max(best.get((r, x.id), new), new)

            for i, whole, bounds in ((i, w, b) for i, _, w, b in _words(batch.column("text")) if len(w) and groups):
                for words, at in _pieces(whole, bounds, most):
                    start, row, _ = _passages(at, HALF)
                    y = _project(words, start, table)
                    for items in groups:
                        for r, x, share, found, cosine in items.search(words, at, start, row, y, exact):
                            put(i + r, x, (share, found, cosine))
                        for r, x in items.whole(words, np.repeat(np.arange(len(at) - 1), np.diff(at))) if items.phrases else ():
                            put(i + r, x, (1.0, 1.0, 0.0))
            rows, ids = pa.array([r for r, _ in best], pa.int64()), pa.array([k for _, k in best], pa.int64())
            cols = [batch.column("doc_id").take(rows), batch.column("key").take(rows), ids]
            cols += [pa.array([v[c] for v in best.values()], pa.float64()) for c in (2, 0, 1)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "item_id", "cosine", "lcs_share", "answer_share"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.lower(text).alias("text")).filter("text <> ''")


def _leaks(texts: DataFrame, benchmark: DataFrame, exact: bool) -> DataFrame:
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    spread, table = latent_basis(texts.select("doc_id", "text"))
    words = asked.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first().n or 0
    parts = -(-words // MAX_ITEMS) or 1
    out = None
    for k in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        items = [x for x in (Item(r.item_id, r.text, spread) for r in rows) if not x.silent]
        groups = [Items(items[i : i + GROUP], table) for i in range(0, len(items), GROUP)]
        part = texts.mapInArrow(_search(groups, table, exact), "doc_id long, key long, item_id long, cosine double, lcs_share double, answer_share double")
        out = part if out is None else out.unionByName(part)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, exact: bool = True) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share) of every leaked item of every document.

    Without ``exact`` only the candidates of the latent search are weighed.
    """
    found = _leaks(_texts(docs).filter("doc_id is not null"), benchmark, exact)
    best = F.max(F.struct("lcs_share", "answer_share", "cosine")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.cosine", "b.lcs_share", "b.answer_share")


def drop_leaked(docs: DataFrame, benchmark: DataFrame, exact: bool = True) -> DataFrame:
    """The rows of ``docs`` in whose text no item is leaked."""
    found = _leaks(_texts(docs), benchmark, exact)
    leaked = materialise(found.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct(), "leaked")
    keyed = docs.withColumn("__own", F.xxhash64(F.col("text").cast("string")))
    return keyed.join(leaked.hint("shuffle_hash"), keyed["doc_id"].cast("long").eqNullSafe(leaked["__id"]) & (keyed["__own"] == leaked["__key"]), "left_anti").drop("__own")
