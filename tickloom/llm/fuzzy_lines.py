"""Fuzzy line dedup by MinHash.

Lines of all documents are compared by the Jaccard index of their character shingles. Equal lines
are grouped by a 128-bit hash; of the distinct ones, MinHash signatures are cut into bands, lines
that share a band are verified with their exact Jaccard index, and union-find joins the verified
pairs. Of each component the line that comes first by (doc_id, line number) stays.

Within a band's bucket every member is first verified against one of them, so that a bucket of
copies costs its size. Buckets whose members are still in different components then go with their texts to one task each (one of more than
``PAIRED`` members as pairs of tiles). There the shingles of each line are ordered, those that are rare in the bucket first; a near pair's first shared shingle
stands so early in both lines that the rest of either can still reach the threshold, and lines outside the bucket's largest component are compared with those that
share one so placed, most shared ones first, until none is left that could join two components. So no pair that could join two is
skipped, and many copies of a line with a few strays don't cost the square of their number.

Only hashes and positions are shuffled for the search; texts are shuffled once for the candidates
and once for the result.

Defined results: blank lines always stay and lines shorter than a shingle are compared as a whole;
null and empty texts pass through, and so do rows with a null id; a document whose lines all went
is dropped; rows equal in id and text are one document and keep the same lines; lines of equal
rank keep the one of the least (doc_id, text hash); other columns pass through, ``n_chars`` is
counted again where present. Tables and texts may be empty or long without limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.graph import components
from tickloom.llm.kernels import mix, powers, prefix_sums, range_hashes, slices, text_buffers, wide
from tickloom.llm.staging import materialise, temporary

SHINGLE = 6
THRESHOLD = 0.75
BANDS = 10
ROWS = 5
PAIRED = 4096
SLICE = 1 << 18
_SPACE = np.array([9, 10, 11, 12, 13, 32, 133, 160], np.uint32)


def _codes(buf: np.ndarray) -> np.ndarray:
    return np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def _char_offsets(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    at = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=at[1:])
    return at[off]


def line_spans(codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, line number, start, end) of every line of every row; a line feed ends a line."""
    breaks = np.flatnonzero(codes == 10)
    n = len(off) - 1
    start = np.concatenate([off[:-1], breaks + 1])
    row = np.concatenate([np.arange(n), np.searchsorted(off, breaks, "right") - 1])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    nearest = np.append(breaks, len(codes))[np.searchsorted(breaks, start)]
    end = np.minimum(nearest, off[1:][row])
    number = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
    return row, number, start, end


def shingle_hashes(codes: np.ndarray, sums: np.ndarray, k: int) -> np.ndarray:
    """The 32-bit hash of the k characters from each position on; the last k - 1 positions are padding."""
    if len(codes) < k:
        return np.zeros(len(codes) + 1, np.uint32)
    h = (sums[k:] - sums[:-k]) * powers(len(sums))[1][: len(sums) - k]
    out = np.zeros(len(codes) + 1, np.uint32)
    out[: len(h)] = (mix(h) >> np.uint64(32)).astype(np.uint32)
    return out


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def band_hashes(x: np.ndarray, start: np.ndarray, stop: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (lines, bands) of the shingles x[start:stop] of each line."""
    out = np.zeros((bands, len(start)), np.uint64)
    if not len(start):
        return out.T
    cuts = np.stack([start, stop], 1).ravel()
    mult, add = _permutations(bands * rows)
    y = np.empty_like(x)
    for b in range(bands):
        acc = np.full(len(start), b + 1, np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            np.multiply(x, mult[r], out=y)
            y ^= add[r]
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(y, cuts)[::2]
        out[b] = mix(acc)
    return out.T


def _scan(shingle: int, bands: int, rows: int):
    names = ["doc_id", "doc_key", "line", "id", *(f"b{i}" for i in range(bands))]

    def run(batches):
        for batch in batches:
            buf, off = text_buffers(batch.column("text"))
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("doc_key").to_numpy()
            for i, j in slices(off, SLICE):
                part = buf[off[i] : off[j]]
                codes = _codes(part)
                at = _char_offsets(part, off[i : j + 1] - off[i])
                row, number, start, end = line_spans(codes, at)
                seen = np.zeros(len(codes) + 1, np.int64)
                np.cumsum(~np.isin(codes, _SPACE), out=seen[1:])
                full = seen[end] > seen[start]
                row, number, start, end = row[full], number[full], start[full], end[full]
                if not len(row):
                    continue
                sums = prefix_sums(codes)
                h1 = range_hashes(sums, start, end)
                h2 = range_hashes(prefix_sums((codes * np.uint32(2654435761)) ^ (codes >> np.uint32(3))), start, end)
                long = end - start >= shingle
                sig = band_hashes(shingle_hashes(codes, sums, shingle), start[long], end[long] - shingle + 1, bands, rows).astype(np.int64)
                cols = [pa.array(ids[i:j][row]), pa.array(keys[i:j][row]), pa.array(number.astype(np.int32)), wide(h1, h2)]
                for b in range(bands):
                    v = np.zeros(len(row), np.int64)
                    v[long] = sig[:, b]
                    cols.append(pa.array(v, mask=~long))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _buckets(batches):
    """(key, id, lead) of the keys that two or more ids share, lead being the first that comes; rows come sorted by key, so a task holds one batch."""
    last, lead, lone = None, None, False  # of the rows before: their last key, its lead, whether that is its only id
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key = batch.column("key").to_numpy()
        new = np.append(key[0] != last, key[1:] != key[:-1])
        group = np.cumsum(new)  # 0 goes on with the key before
        first = np.append(0, np.flatnonzero(new))
        ids = pa.concat_arrays([pa.array([lead], pa.binary()), batch.column("id")])
        leads = np.append(0, np.flatnonzero(new) + 1)[group]
        size = np.bincount(group, minlength=len(first))
        many = (size > 1) | (np.arange(len(first)) == 0)
        rows = np.flatnonzero(many[group])
        keys = key[rows]
        mine, theirs = rows + 1, leads[rows]
        if lone and not new[0]:  # the row that was held back
            keys, mine, theirs = np.append(last, keys), np.append(0, mine), np.append(0, theirs)
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), ids.take(pa.array(mine)), ids.take(pa.array(theirs))], names=["key", "id", "lead"])
        lone = bool(new[-1])
        last, lead = key[-1], ids[int(leads[-1])].as_py()


def exact_jaccard(a: str, b: str, k: int = SHINGLE) -> float:
    """The Jaccard index of the k-character shingles; a shorter text is one shingle."""
    x, y = ({t[i : i + k] for i in range(max(1, len(t) - k + 1))} for t in (a, b))
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _line_shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all shingles of all texts, by row."""
    buf, off = text_buffers(texts)
    codes = _codes(buf)
    at = _char_offsets(buf, off)
    count = np.maximum(np.diff(at) - k + 1, 1)
    row = np.repeat(np.arange(len(count), dtype=np.int64), count)
    start = np.repeat(at[:-1], count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, range_hashes(prefix_sums(codes), start, np.minimum(start + k, at[1:][row]))


def jaccards(a: pa.Array, b: pa.Array, k: int = SHINGLE) -> np.ndarray:
    """The Jaccard index of each pair of texts, from the 44-bit hashes of their distinct shingles."""
    keys = []
    n = len(a)
    for texts in (a, b):
        pair, h = _line_shingles(texts, k)
        key = np.sort((pair.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
        keys.append(key[np.append(True, key[1:] != key[:-1])] if len(key) else key)
    size = sum(np.bincount((key >> np.uint64(44)).astype(np.int64), minlength=n) for key in keys)
    both = np.sort(np.concatenate(keys))
    shared = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(44)).astype(np.int64), minlength=n)
    return shared / np.maximum(size - shared, 1)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for all lo[i] <= j < hi[i]."""
    count = hi - lo
    i = np.repeat(np.arange(len(lo)), count)
    return i, np.arange(len(i)) + np.repeat(lo - np.cumsum(count) + count, count)


def joining_pairs(bucket: np.ndarray, root: np.ndarray, texts: pa.Array, shingle: int, threshold: float, tried: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(x, y): near rows of one bucket and different roots; these pairs join all roots that near pairs of a bucket join.

    ``bucket`` is sorted, ``root`` are numbers. To ``tried`` the number of pairs compared is added.
    """
    n = len(bucket)
    row, h = _line_shingles(texts, shingle)
    low = np.uint64(max(n - 1, 1).bit_length())  # the row takes the low bits
    h = np.sort(mix(h ^ (bucket[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> low << low | row.astype(np.uint64))
    h = h[np.append(True, h[1:] != h[:-1])[: len(h)]]
    row, h = (h & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64), h >> low
    token = np.cumsum(np.append(True, h[1:] != h[:-1])[: len(h)]) - 1
    often = np.bincount(token)
    m = max(len(often), 1)
    rank = np.empty(m, np.int64)
    rank[np.argsort(often)] = np.arange(len(often))
    sets = np.sort(row * m + rank[token])  # of each row the shingles, those that are rare in its bucket first
    row, token = np.divmod(sets, m)
    size = np.bincount(row, minlength=n)
    at = np.append(0, np.cumsum(size))
    # when the first shared shingle is x's i-th, at most size - i are shared, and y is no larger than
    most = np.floor((size[row] - (np.arange(len(sets)) - at[row])) * ((1 + threshold) / threshold) - size[row] + 1e-6).astype(np.int64)
    least = np.ceil(threshold * size - 1e-6).astype(np.int64)
    use = np.flatnonzero((most >= least[row]) & (np.sort(often)[token] > 1))
    row, token, most = row[use], token[use], most[use]
    wide_ = int(size.max(initial=0)) + 1
    key = token * wide_ + size[row]
    index = np.argsort(key)
    listed, to, limit = key[index], row[index], most[index]

    # components within a bucket, and the largest of each
    label = np.unique(bucket * (int(root.max(initial=0)) + 1) + root, return_inverse=True)[1]
    count = np.bincount(label)
    home = np.empty(len(count), np.int64)
    home[label] = bucket
    order = np.lexsort((-count, home))
    main = np.zeros(int(bucket.max(initial=0)) + 1, np.int64)
    main[home[order[::-1]]] = order[::-1]
    up = np.arange(len(count))

    probe = np.flatnonzero(label[row] != main[bucket[row]])
    lo = np.searchsorted(listed, token[probe] * wide_ + least[row[probe]])
    hi = np.maximum(lo, np.searchsorted(listed, token[probe] * wide_ + np.minimum(most[probe], wide_ - 1), "right"))
    cost = np.cumsum(hi - lo)
    found: list[np.ndarray] = []
    begin = 0
    while begin < len(probe):
        end = max(begin + 1, int(np.searchsorted(cost, (cost[begin - 1] if begin else 0) + SLICE, "right")))
        some = np.arange(begin, end)
        begin = end
        x = row[probe[some]]
        some = some[up[label[x]] != up[main[bucket[x]]]]
        i, j = _ranges(lo[some], hi[some])
        x, y = row[probe[some]][i], to[j]
        go = (limit[j] >= size[x]) & (up[label[x]] != up[label[y]])
        pair, hits = np.unique(x[go] * n + y[go], return_counts=True)
        x, y = np.divmod(pair, n)
        order = np.lexsort((-hits, x))
        x, y, share = x[order], y[order], 1
        while len(x):  # a few of each row first, as most join by them
            now = np.arange(len(x)) - np.searchsorted(x, x) < share
            good = _near_rows(x[now], y[now], sets, m, at, size, threshold)
            if tried is not None:
                tried.append(len(good))
            found.append(np.stack([x[now][good], y[now][good]]))
            for a, b in zip(label[x[now][good]].tolist(), label[y[now][good]].tolist()):
                while up[a] != a:
                    a = up[a]
                while up[b] != b:
                    b = up[b]
                up[max(a, b)] = min(a, b)
            while (up[up] != up).any():
                up = up[up]
            rest = ~now & (up[label[x]] != up[label[y]])
            x, y, share = x[rest], y[rest], share * 2
    x, y = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
    return x, y


def _near_rows(x, y, sets, m, at, size, threshold) -> np.ndarray:
    """Whether the Jaccard index of the sets of rows x and y reaches the threshold."""
    good = np.zeros(len(x), bool)
    for i, j in slices(np.append(0, np.cumsum(size[x])), SLICE):
        pair, k = _ranges(at[x[i:j]], at[x[i:j] + 1])
        want = y[i:j][pair] * m + sets[k] % m
        place = np.minimum(np.searchsorted(sets, want), len(sets) - 1)
        both = np.bincount(pair, sets[place] == want, minlength=j - i)
        good[i:j] = both / (size[x[i:j]] + size[y[i:j]] - both) >= threshold
    return good


def _join_apart(shingle: int, threshold: float):
    """(a, b) of the pairs that join members of a bucket which are apart; rows (key, task, id, root, t) come sorted by key and task."""

    def solve(table):
        key, task = (table.column(c).to_numpy() for c in ("key", "task"))
        bucket = np.cumsum(np.append(False, (key[1:] != key[:-1]) | (task[1:] != task[:-1])))
        root = table.column("root").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        starts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        apart = np.minimum.reduceat(root, starts[:-1]) != np.maximum.reduceat(root, starts[:-1])
        use = np.flatnonzero(apart[bucket])
        if not len(use):
            return
        ids, texts, root, bucket = table.column("id").combine_chunks().take(pa.array(use)), table.column("t").combine_chunks().take(pa.array(use)), root[use], bucket[use]
        starts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        for i, j in slices(text_buffers(texts)[1][starts], SLICE):
            i, j = int(starts[i]), int(starts[j])
            x, y = joining_pairs(bucket[i:j] - bucket[i], root[i:j], texts.slice(i, j - i), shingle, threshold)
            if len(x):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x + i)), ids.take(pa.array(y + i))], names=["a", "b"])

    def run(batches):
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, task = batch.column("key").to_numpy(), batch.column("task").to_numpy()
            last = int(np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (task[1:] != task[:-1])))[-1])
            if held and (held[-1].column("key")[-1].as_py(), held[-1].column("task")[-1].as_py()) != (key[0], task[0]):
                yield from solve(pa.Table.from_batches(held))
                held = []
            if last:
                yield from solve(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def prefix_pairs(apart: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(a, b), a > b: near members of one key of ``apart`` (key, id, root), enough to join all roots that near members of a key join.

    A key of more than ``PAIRED`` members is cut into tiles of so many, and each pair of tiles is a task.
    """
    same = Window.partitionBy("key")
    n, place = F.count(F.lit(1)).over(same), F.row_number().over(same.orderBy("root", "id")) - 1
    tiled = apart.withColumns({"tile": F.floor(place / PAIRED), "tiles": F.ceil(n / PAIRED)})
    # task of tiles (s, t), s <= t, is s * tiles + t
    tasks = F.expr("transform(sequence(0L, tiles - 1), x -> least(x, tile) * tiles + greatest(x, tile))")
    sent = tiled.select("key", "id", "root", F.explode(tasks).alias("task")).join(texts, "id").select("key", "task", "id", "root", "t")
    pairs = sent.repartition("key", "task").sortWithinPartitions("key", "task").mapInArrow(_join_apart(shingle, threshold), "a binary, b binary")
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _verify(shingle: int, threshold: float):
    def run(batches):
        for batch in batches:
            ta, tb = batch.column("ta"), batch.column("tb")
            off = np.append(0, np.cumsum(np.diff(text_buffers(ta)[1]) + np.diff(text_buffers(tb)[1])))
            good = np.zeros(batch.num_rows, bool)
            for i, j in slices(off, SLICE):
                good[i:j] = jaccards(ta.slice(i, j - i), tb.slice(i, j - i), shingle) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good)], names=["a", "b", "good"])

    return run


def find_repeats(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, doc_key, lines, whole): the numbers, from 0, of the lines that go, and whether none is left. doc_key is xxhash64(text)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text <> ''").withColumn("doc_key", F.xxhash64("text"))
    with temporary() as keep:
        lines, firsts, groups = _line_groups(keyed, shingle, threshold, bands, rows)
        placed = firsts.join(groups, "id")
        lead = F.row_number().over(Window.partitionBy("root").orderBy("doc_id", "doc_key", "line", "id"))
        later = placed.withColumn("lead", lead).filter("lead > 1").select("doc_id", "doc_key", "line")
        gone = lines.filter("not first").select("doc_id", "doc_key", "line").unionByName(later).distinct()
        # a document goes as a whole when all its lines that aren't blank do
        full = lines.select("doc_id", "doc_key", "line").distinct().groupBy("doc_id", "doc_key").agg(F.count(F.lit(1)).alias("full"))
        by_doc = gone.groupBy("doc_id", "doc_key").agg(F.array_sort(F.collect_list("line")).alias("lines"))
        by_doc = by_doc.join(full, ["doc_id", "doc_key"]).select("doc_id", "doc_key", "lines", (F.size("lines") == F.col("full")).alias("whole"))
        return keep(materialise(by_doc, "line-gone"))


def _line_groups(keyed: DataFrame, shingle: int, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, firsts, groups): all lines with ``first`` at one of each text, those, and the components (id, root) of near ones."""
    band = [f"b{i}" for i in range(bands)]
    schema = "doc_id long, doc_key long, line int, id binary, " + ", ".join(f"{b} long" for b in band)
    lines = keyed.mapInArrow(_scan(shingle, bands, rows), schema)
    first = F.rank().over(Window.partitionBy("id").orderBy("doc_id", "doc_key", "line")) == 1
    lines = lines.withColumn("first", first).select("doc_id", "doc_key", "line", "first", F.when(F.col("first"), F.col("id")).alias("id"), *(F.when(F.col("first"), F.col(b)).alias(b) for b in band))
    lines = materialise(lines, "lines")

    firsts = lines.filter("first").select("doc_id", "doc_key", "line", "id")
    keys = lines.filter("first and b0 is not null").select(F.explode(F.array(*band)).alias("key"), "id")
    buckets = materialise(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_buckets, "key long, id binary, lead binary"), "line-buckets")

    # texts of all lines that share a bucket
    wanted = firsts.join(buckets.select("id").distinct(), "id").groupBy("doc_id", "doc_key").agg(F.collect_list(F.struct("line", "id")).alias("wanted"))
    texts = keyed.join(wanted.hint("shuffle_hash"), ["doc_id", "doc_key"])
    texts = texts.select(F.split("text", "\n", -1).alias("all"), F.explode("wanted").alias("w")).select("w.id", F.expr("all[w.line]").alias("t")).dropDuplicates(["id"])
    texts = materialise(texts, "line-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("id").alias("a"), F.col("t").alias("ta"))
        b = texts.select(F.col("id").alias("b"), F.col("t").alias("tb"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(_verify(shingle, threshold), "a binary, b binary, good boolean")

    star = buckets.filter("id <> lead").select(F.greatest("id", "lead").alias("a"), F.least("id", "lead").alias("b")).distinct()
    star = materialise(verified(star), "line-stars")
    found = materialise(components(star.filter("good")), "line-components")
    # members of one bucket that are still apart
    placed = buckets.select("key", "id").join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))
    same = Window.partitionBy("key")
    ends = {"lo": F.min("root").over(same), "hi": F.max("root").over(same)}
    rest = prefix_pairs(placed.withColumns(ends).filter("lo <> hi").select("key", "id", "root"), texts, shingle, threshold)
    rest = materialise(rest, "line-rest")
    linked = found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(rest)
    return lines, firsts, components(linked)


def _cut(texts: pa.Array, lines: pa.Array) -> pa.Array:
    out = []
    for text, gone in zip(texts.to_pylist(), lines.to_pylist()):
        if gone is None or text is None:
            out.append(text)
        else:
            gone = set(gone)
            out.append("\n".join(t for i, t in enumerate(text.split("\n")) if i not in gone))
    return pa.array(out, pa.string())


def dedup_lines(docs: DataFrame, **params) -> DataFrame:
    """``docs`` without repeated lines; the columns stay."""
    gone = find_repeats(docs.select("doc_id", "text"), **params)
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("doc_key").alias("__key"), F.col("lines").alias("__lines"), F.col("whole").alias("__whole"))
    keyed = docs.withColumn("__own", F.xxhash64(F.col("text").cast("string")))
    joined = keyed.join(gone.hint("shuffle_hash"), (keyed["doc_id"].cast("long") == gone["__id"]) & (keyed["__own"] == gone["__key"]), "left")
    joined = joined.filter("__whole is null or not __whole")
    cut = F.arrow_udf(_cut, "string")
    joined = joined.withColumn("__text", cut(F.col("text").cast("string"), F.col("__lines")))
    new = {"text": F.col("__text")} | ({"n_chars": F.when(F.col("__lines").isNull(), F.col("n_chars")).otherwise(F.length("__text")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))
