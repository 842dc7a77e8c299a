"""Line dedup, the n-gram join, decontamination, packing, sharding and formatting against direct versions."""

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tickloom.llm import differencing as df_
from tickloom.llm import fuzzy_lines as fl
from tickloom.llm import ngram_join as nj
from tickloom.llm import packing as pk
from tickloom.llm.graph import components
from tickloom.llm.preference_format import format_preferences


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join("changed" + str(r.randint(0, 999)) if r.random() < share else w for w in text.split(" "))


def odd(write):
    return [(1, None), (2, ""), (3, " \n "), (4, "x"), (5, write(5, 120)), (5, write(5, 120)), (None, write(5, 120)), (7, "word " * 60000), (8, write(8, 30000))]


def union(pairs, nodes=()):
    root = {n: n for n in nodes}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in list(root)}


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7)]
    got = {x.id: x.root for x in components(spark.createDataFrame([*pairs, (None, 3)], "a bigint, b bigint")).collect()}
    want = union(p for p in pairs if p[0] != p[1])
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- line dedup
def brute_lines(rows, k=fl.SHINGLE, t=fl.THRESHOLD):
    docs = sorted({(i, x) for i, x in rows if i is not None and x})
    lines = [(d, n, s) for d in docs for n, s in enumerate(d[1].split("\n")) if s.strip()]
    sets = {s: {s[p : p + k] for p in range(max(1, len(s) - k + 1))} for _, _, s in lines}
    distinct = list(sets)
    near = [(a, b) for a, b in itertools.combinations(distinct, 2) if min(len(a), len(b)) >= k and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])]
    group = union(near, distinct)
    seen, kept = set(), defaultdict(set)
    for d, n, s in lines:
        if group[s] not in seen:
            seen.add(group[s])
            kept[d].add(n)
    out = {}
    for i, x in rows:
        if i is None or not x:
            out[i, x] = x
            continue
        ls = x.split("\n")
        new = "\n".join(s for n, s in enumerate(ls) if not s.strip() or n in kept[i, x])
        if new.strip() or not x.strip():
            out[i, x] = new
    return out


def test_line_dedup_matches_brute_force(spark, make, write):
    r = random.Random(4)
    base = [write(s, 30) for s in range(60)]
    rows = []
    for i in range(60):
        lines = [base[r.randrange(60)] if r.random() < 0.3 else edited(base[r.randrange(60)], 0.03, i * 7 + j) if r.random() < 0.4 else write(1000 + i * 9 + j, 25) for j in range(5)]
        rows.append((i, "\n".join([*lines, "", "short", "x"])))
    rows += [(90 + i, t) for i, t in odd(write) if i] + [(None, rows[0][1]), (200, rows[3][1]), (3, rows[3][1])]
    docs = make(rows, extra=True)
    got = fl.dedup_lines(docs)
    assert got.columns == docs.columns
    out = got.collect()
    want = brute_lines(rows)
    assert all(x.n_chars == (None if x.text is None else len(x.text)) and x.quality == "own" for x in out)
    have = defaultdict(list)
    for x in out:
        have[x.doc_id].append(x.text)
    # rows with equal id and text keep the same lines
    assert len(have[3]) == 2 and have[3][0] == have[3][1]
    assert {i for i, t in want} == set(have)
    lost = sum(set(have[i]) != {w for (k, _), w in want.items() if k == i} for i in have)
    assert lost <= 0.05 * len(have)
    assert fl.dedup_lines(make([])).count() == 0


def test_jaccards_equal_sets():
    import pyarrow as pa

    r = random.Random(1)
    a = ["".join(r.choice("abé ") for _ in range(r.randint(0, 60))) for _ in range(200)]
    b = [t[: r.randint(0, 60)] + "xyz" * r.randint(0, 1) for t in a]
    np.testing.assert_allclose(fl.jaccards(pa.array(a), pa.array(b)), [fl.exact_jaccard(x, y) for x, y in zip(a, b)])


# ---- n-gram join
def grams(text, n=nj.N):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_pairs(rows, t=nj.THRESHOLD):
    sets = {i: grams(x) for i, x in rows if i is not None and x}
    out = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both >= t * len(sets[a] | sets[b]):
            out[a, b] = both / len(sets[a] | sets[b])
    return out


def near_rows(write):
    common = write(777, 40)
    rows = []
    for g in range(12):
        base = write(300 + g, 150)
        rows += [(g * 100 + k, edited(base, 0.04 * (k % 4), g * 31 + k)) for k in range(10)]
    rows += [(5000 + i, f"{write(6000 + i, 160)} {common}") for i in range(80)]
    return rows


def test_ngram_join_matches_brute_force(spark, make, write):
    rows = near_rows(write) + [(9000 + i, t) for i, t in odd(write) if i and i != 5] + [(None, write(5, 120)), (9105, write(5, 120)), (9105, write(5, 120)), (9106, write(5, 120).upper())]
    got = {(x.doc_a, x.doc_b): x for x in nj.join_near(make(rows, extra=True)).collect()}
    want = brute_pairs(rows)
    assert set(got) <= set(want)
    assert len(set(got) & set(want)) >= 0.97 * len(want)
    assert all(abs(x.jaccard - want[p]) < 1e-12 and x.jaccard == x.overlap / x.union_size for p, x in got.items())
    assert (9105, 9106) in got and not any(a >= 5000 and a < 6000 for a, _ in got)
    assert nj.join_near(make([])).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.25])
def test_short_texts_near_by_one_gram(spark, make, threshold):
    rows = []
    for i in range(60):
        a, b, c, d = (f"{x}{i}" for x in "abcd")
        texts = [f"{a} {b} {c}", f"{a} {b} {c} {d}", f"{d} {a} {b} {c}", f"{a} {b} {c} {d} x{i}", f"{d} {d} {a} {b} {c}"]
        rows += [(i * 10 + k, t) for k, t in enumerate(texts)]
    rows += [(900, "w " * 50), (901, "w " * 50 + "x"), (902, "y " + "w " * 9)]
    got = {(x.doc_a, x.doc_b) for x in nj.join_near(make(rows), threshold=threshold).collect()}
    want = set(brute_pairs(rows, threshold))
    shared = {i: grams(t) for i, t in rows}
    # pairs that share more than one gram are found by the sketch
    assert got <= want and {(a, b) for a, b in want if len(shared[a] & shared[b]) == 1} <= got
    assert {(0, 1), (0, 2), (900, 901), (900, 902)} <= got


def test_every_document_has_its_class_and_links(spark, make, write):
    rows = near_rows(write) + [(9000 + i, t) for i, t in odd(write) if i] + [(None, "a b c"), (9105, write(5, 120)), (9105, write(5, 120)), (9106, write(5, 120).upper())]
    rows += [(10000 + i, write(4, 60)) for i in range(300)]  # copies, whose pairs would be 44,850 rows
    docs = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1] or ""))
    pairs = {(x.doc_a, x.doc_b) for x in nj.join_near(make(rows)).collect()}
    degree = defaultdict(int)
    for p in pairs:
        for d in p:
            degree[d] += 1
    group = union(pairs, [i for i, _ in docs])
    for tile in (nj.TILE, 3):
        got = sorted(map(tuple, nj.link_near(make(rows, extra=True), tile=tile).collect()))
        assert got == [(i, group[i], degree[i]) for i, _ in docs]
    assert nj.link_near(make([])).count() == 0


def test_links_match_sql(spark, tmp_path, make, write):
    import duckdb

    from tickloom.llm import queries

    rows = [(i, t) for i, t in near_rows(write) if i < 200 and i % 10 < 5] + [(900, write(300, 150)), (901, write(300, 150)), (902, None), (903, "x"), (None, "x")]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op8_ngram_join(spark, str(tmp_path)).collect()))
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(duck.sql(queries.OP8_SQL).fetchall())


def test_tiles_hold_all_pairs(spark, make, write):
    rows = near_rows(write)
    whole = {(x.doc_a, x.doc_b) for x in nj.join_near(make(rows)).collect()}
    tiled = {(x.doc_a, x.doc_b) for x in nj.join_near(make(rows), tile=3).collect()}
    assert whole == tiled


def test_one_of_near_stays(spark, make, write):
    rows = near_rows(write) + [(9000 + i, t) for i, t in odd(write) if i] + [(None, None)]
    docs = make(rows, extra=True)
    kept = nj.keep_one_of_near(docs)
    ids = [x.doc_id for x in kept.collect()]
    assert kept.columns == docs.columns
    near = [p for p in brute_pairs(rows) if max(p) < 5000]
    want = {root for i, root in union(near, [i for i, _ in rows if i is not None]).items()}
    assert set(ids) == want | {None} and ids.count(9005) == 2


# ---- packing
def test_nnls_against_optimality():
    r = np.random.default_rng(1)
    for _ in range(20):
        a, y = r.random((12, 30)), r.standard_normal(12)
        x = pk.nnls(a, y)
        w = a.T @ (y - a @ x)
        assert (x >= 0).all() and (w <= 1e-6).all() and np.abs(w[x > 0]).max(initial=0) < 1e-6


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece(seed):
    r = np.random.default_rng(seed)
    bins = 32
    h = np.zeros(bins + 1, np.int64)
    h[1:] = r.integers(0, 200, bins) * (r.random(bins) < 0.7)
    packs = pk.plan(h, bins)
    held = np.zeros(bins + 1, np.int64)
    for p, n in packs:
        assert sum(p) <= bins and n > 0
        for b in p:
            held[b] += n
    assert (held == h).all()
    assert sum(n for _, n in packs) <= (h * np.arange(bins + 1)).sum() / bins * 1.15 + 3
    assert pk.plan(np.zeros(bins + 1, np.int64), bins) == []


def test_packing_covers_every_byte_once(spark, make, write):
    rows = odd(write) + [(100 + i, write(i, 5 + i * 7 % 400)) for i in range(300)] + [(500, "é" * 9000)]
    got = pk.pack_documents(make(rows, extra=True), sequence=1024, bins=64, bucket_rows=50).collect()
    texts = defaultdict(list)
    for i, t in rows:
        if t:
            texts[i].append(len(t.encode()))
    packs, slots, ranges = defaultdict(int), set(), defaultdict(list)
    for x in got:
        packs[x.pack_id] += x.length
        assert (x.pack_id, x.slot) not in slots
        slots.add((x.pack_id, x.slot))
        ranges[x.doc_id].append((x.start, x.length))
    assert max(packs.values()) <= 1024 and sorted(packs) == list(range(len(packs)))
    for i, sizes in texts.items():
        want = sorted((s, min(1024, n - s)) for n in sizes for s in range(0, n, 1024))
        assert sorted(ranges[i]) == want
    assert set(ranges) == set(texts)
    assert sum(packs.values()) > 0.93 * 1024 * len(packs)
    assert pk.pack_documents(make([])).count() == 0


# ---- sharding
def test_differencing():
    slots, total = df_.difference(np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]], float))
    sums = [0, 0]
    for s, p in zip((8, 7, 6, 5, 4), slots):
        sums[p[0]] += s
    assert sorted(sums) == [14, 16] and sorted(total) == [14, 16]
    r = np.random.default_rng(2)
    rows = r.random((50, 4))
    slots, total = df_.difference(rows)
    got = np.zeros(4)
    for v, p in zip(rows, slots):
        np.add.at(got, p, v)
    np.testing.assert_allclose(got, total)


@pytest.mark.parametrize("fan_in", [7, 4096])
def test_groups_stay_whole_and_shards_even(spark, fan_in):
    r = random.Random(6)
    rows = [(i, f"g{r.randint(0, 199)}", r.randint(1, 1000)) for i in range(1500)] + [(2000, None, 5), (2001, None, None), (2001, None, None), (2002, "z", None)]
    table = spark.createDataFrame(rows, "doc_id bigint, g string, n int").selectExpr("*", "'own' as shard", "1 as a", "2 as b", "3 as block", "4 as slots")
    out = df_.shard_groups(table, ["g"], "n", 8, fan_in)
    got = out.collect()
    assert len(got) == len(rows) and set(out.columns) == set(table.columns)
    by, sums = defaultdict(set), [0] * 8
    for x in got:
        by[x.g].add(x.shard)
        sums[x.shard] += x.n or 0
    assert all(len(s) == 1 for s in by.values())
    assert max(sums) - min(sums) < 0.01 * sum(sums)
    assert df_.shard_groups(table.limit(0), ["g"], "n", 8).count() == 0


# ---- preference formatting
def test_preferences_round_trip(spark):
    r = random.Random(8)
    chosen, rejected, want = [], [], {}
    for c in range(60):
        n, k, m = r.randint(1, 8), 0, r.randint(1, 8)
        turns = [(i, r.choice(["user", "assistant", None]), r.choice(["hi", "", None, "héllo\n"])) for i in range(n)]
        other = [t if i < m else (t[0], t[1], (t[2] or "") + "!") for i, t in enumerate(turns)]
        chosen += [(c, *t) for t in turns]
        rejected += [(c, *t) for t in other]
        want[c] = (turns, other)
    chosen += [(None, 0, "user", "x"), (700, 0, "user", "x"), (701, 0, "user", "b"), (701, 0, "user", "a")]
    rejected += [(None, 0, "user", "x"), (702, 0, "user", "x"), (701, 0, "user", "a"), (701, 0, "user", "c")]
    schema = "conv_id bigint, turn bigint, role string, text string"
    sides = [spark.createDataFrame(x, schema).selectExpr("*", "'own' as side", "1 as x", "2 as p") for x in (chosen, rejected)]
    got = {x.pair_id: x for x in format_preferences(*sides).collect()}
    assert set(got) == {*want, 701}
    render = lambda ts: "".join(f"<|{t[1] or ''}|>\n{t[2] or ''}<|end|>\n" for t in ts)
    for c, (a, b) in want.items():
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if (x[1] or "", x[2] or "") != (y[1] or "", y[2] or "")), min(len(a), len(b)))
        x = got[c]
        assert (x.prompt_turns, x.prompt, x.chosen, x.rejected) == (k, render(a[:k]), render(a[k:]), render(b[k:]))
        spans = [x.chosen[int(s) : int(e)] for s, e in (m.split(":") for m in x.chosen_mask.split(";") if m)]
        assert spans == [f"{t[2] or ''}<|end|>\n" for t in a[k:] if t[1] == "assistant"]
    assert got[701].prompt_turns == 1 and got[701].chosen == "<|user|>\nb<|end|>\n"
    assert format_preferences(*(s.limit(0) for s in sides)).count() == 0


# ---- pipeline
def test_pipeline_follows_its_stages(spark, tmp_path, write):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == columns
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    step = sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()))
    assert step == sorted(map(tuple, corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()))


def test_pipeline_on_odd_and_empty_documents(spark, tmp_path, make, write):
    bench = spark.createDataFrame([(1, write(70000, 40))], "item_id bigint, text string")
    for k, rows in enumerate(([], odd(write) + [(50, write(70000, 40)), (51, write(51, 200))])):
        d = str(tmp_path / f"d{k}")
        make(rows).write.parquet(f"{d}/documents.parquet")
        bench.write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame([(51, 1, 0), (None, 1, 0), (7, None, None), (999, 1, 0)][: 4 * k], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        out = corpus_pipeline.run(spark, d).collect()
        assert {x.doc_id for x in out} == (set() if not rows else {None, 3, 4, 5, 8, 51})
