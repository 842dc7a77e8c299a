"""Benchmark decontamination against all pairs of stretches and items."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import latent_decontam as ld

SYLLABLES = "ba ke li mo nu ra se ti vo wu za pe do fi gu".split()


def words_of(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())


def shared(q, part):
    """How many of the item's words are there in any order; no subsequence is longer."""
    return sum((Counter(q) & Counter(part)).values())


def plain_lcs(a, b):
    row = [0] * (len(a) + 1)
    for y in b:
        last = 0
        for i, x in enumerate(a):
            last, row[i + 1] = row[i + 1], last + 1 if x == y else max(row[i + 1], row[i])
    return row[-1]


def brute(rows, items):
    """{(doc, item): best share} over all stretches of all documents, by the rules of the module's docstring."""
    passages = [set(w[k : k + 64]) for _, t in rows if t for w in [words_of(t)] for k in range(0, len(w), 64)]
    common = {w for w in set().union(*passages) if sum(w in p for p in passages) > ld.COMMON * len(passages)}
    out = {}
    for (i, text), (k, item) in itertools.product([r for r in rows if r[0] is not None and r[1]], [x for x in items if x[1]]):
        d, q = words_of(text), words_of(item)
        n, span = len(q), math.ceil(1.5 * len(q))
        if not n or n < 6 and set(q) <= common:
            continue
        whole = any(d[s : s + n] == q for s in range(len(d) - n + 1))
        if n < 6:
            if whole:
                out[i, k] = 1.0
            continue
        if shared(q, d) < 0.6 * n - 1e-9:
            continue
        answer, loose = words_of(re.split(r"(?<=[.!?])\s+", item.strip())[-1]), sum(w in common for w in q) >= math.ceil(0.6 * n - 1e-9)
        for s in range(len(d)):
            part = d[s : s + span]
            if shared(q, part) < 0.6 * n - 1e-9:
                continue
            share = plain_lcs(q, part) / n
            if share >= 0.7 or share >= 0.6 and answer and plain_lcs(answer, part) >= 0.7 * len(answer):
                if whole or not loose or share - plain_lcs(q, part[::-1]) / n >= ld.ORDER:
                    out[i, k] = max(out.get((i, k), 0), 1.0 if whole else share)
    return out


def rare(r, n):
    return ["".join(r.choices(SYLLABLES, k=4)) + "qx"[r.randint(0, 1)] for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(write):
    """Items of 6 to 90 words, some of frequent words only, and documents with whole, edited, padded, cut and shuffled copies."""
    r = random.Random(11)
    often = "the of and to in a is that for it on as with was by he at from his an".split()
    items = [(i, write(40000 + i, n) + ".") for i, n in enumerate([6, 9, 14, 20, 33, 40, 58, 90] * 2)]
    items += [(50 + i, " ".join(r.choice(often) for _ in range(n))) for i, n in enumerate([7, 18, 40])]
    # a question of frequent and rare words with an answer of frequent ones
    items += [(60 + i, " ".join(x for pair in zip(r.sample(often, 12), rare(r, 12)) for x in pair) + " " + " ".join(rare(r, 4)) + ". " + " ".join(r.sample(often, 12))) for i in range(3)]
    items += [(90, None), (91, ""), (92, "in a"), (93, "kuzo mipa"), (94, "?!")]
    rows = []
    for i in range(140):
        k, text = items[i % 22]
        w, way = text.split(), i // 22
        if way == 1:
            w = [x if r.random() > 0.12 else "other" + str(r.randint(0, 99)) for x in w]
        elif way == 2:
            w = [x if r.random() > 0.3 else "other" + str(r.randint(0, 99)) for x in w]
        elif way == 3:
            w = [y for x in w for y in ([x, "pad" + str(r.randint(0, 9))] if r.random() < 0.3 else [x])]
        elif way == 4:
            r.shuffle(w)
        elif way == 5:
            w = [x if x.strip(".") in often else "new" + str(r.randint(0, 999)) for x in w]
        elif way == 6:
            w = w[: len(w) // 2]
        rows.append((i, f"{write(1000 + i, r.choice([0, 3, 50, 200]))} {' '.join(w)} {write(2000 + i, r.choice([0, 5, 90]))}"))
    rows += [(200 + i, " ".join(r.choice(often) for _ in range(300))) for i in range(6)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "x"), (304, items[3][1].upper()), (304, items[5][1]), (305, f"so kuzo mipa {write(5, 40)}"), (306, "word " * 3000), (307, write(8, 4000)), (3, rows[3][1]), (None, items[1][1])]
    return rows, items


def test_every_leak_of_all_pairs_is_found(spark, make, corpus):
    rows, items = corpus
    want = brute(rows, items)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): x for x in ld.find_leaks(make(rows, extra=True), bench).collect()}
    assert set(got) == set(want) and len(want) > 70
    assert all(abs(got[p].lcs_share - s) < 1e-9 for p, s in want.items())
    # a leak whose rare words are replaced, and items of frequent words only
    assert {(i, k) for i, k in want if i // 22 == 5 and k >= 60} and {(i, k) for i, k in want if i < 22 and 50 <= k < 60}
    # the latent search alone, on items that have other than frequent words
    alone = {(x.doc_id, x.item_id) for x in ld.find_leaks(make(rows), bench, exact=False).collect()}
    telling = {p for p in want if p[1] < 50 and len(words_of(dict(items)[p[1]])) >= 6}
    assert alone <= set(want) and len(alone & telling) >= 0.9 * len(telling)


def test_documents_with_leaks_go(spark, make, corpus):
    rows, items = corpus
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = make(rows, extra=True)
    kept = ld.drop_leaked(docs, bench)
    by_text = {}
    for n, t in enumerate(sorted({t for _, t in rows if t})):
        by_text[t] = 10000 + n
    # every row is weighed by its own text, those without an id or with a shared one too
    found = {i for i, _ in brute([(by_text[t], t) for _, t in rows if t], items)}
    want = sorted(str((i, t)) for i, t in rows if not t or by_text[t] not in found)
    assert kept.columns == docs.columns and sorted(str((x.doc_id, x.text)) for x in kept.collect()) == want
    assert ld.drop_leaked(make([]), bench).count() == 0 and ld.find_leaks(make([]), bench).count() == 0
    assert ld.drop_leaked(docs, bench.limit(0)).count() == len(rows)


def test_long_texts_are_searched_in_pieces(monkeypatch, spark, make, corpus, write):
    monkeypatch.setattr(ld, "LONG", 512)
    items = [(i, write(40000 + i, 30)) for i in range(8)]
    text = " ".join(f"{write(i, 170 + i)} {items[i % 8][1]}" for i in range(24))
    spread, table = np.zeros(ld.TERMS), np.zeros((ld.TERMS + 1, 4), np.float32)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([text])], names=["doc_id", "key", "text"])
    groups = [ld.Items([ld.Item(i, t, spread) for i, t in items], table)]
    out = list(ld._search(groups, table, True)([batch]))[0]
    assert sorted(out.column("item_id").to_pylist()) == list(range(8)) and set(out.column("lcs_share").to_pylist()) == {1.0}


def test_lcs():
    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 12))] for _ in range(2))
        assert ld.lcs(ld.masks(a), len(a), b) == plain_lcs(a, b)


def test_randomised_svd_finds_the_directions_of_a_low_rank_matrix():
    r = np.random.default_rng(0)
    a = r.standard_normal((600, 6)) @ r.standard_normal((6, 500))
    sketch = np.zeros((40, 500))
    np.add.at(sketch, r.integers(0, 40, 600), a * r.choice([-1, 1], 600)[:, None])
    q = ld._row_space(sketch)
    np.testing.assert_allclose(q @ q.T, np.eye(len(q)), atol=1e-3)
    p = ld._singular((a @ q.T).T @ (a @ q.T)) @ q
    u = a @ p.T
    np.testing.assert_allclose(u.T @ u, np.eye(6), atol=1e-3)


def test_sketch_and_gram_count_all_passages(spark, make, write):
    rows = [(i, write(i, 20 + 37 * i % 400)) for i in range(80)]
    spread, table = ld.latent_basis(make(rows).select("doc_id", "text").repartition(5))
    passages = [words_of(t)[k : k + 64] for _, t in rows for k in range(0, len(words_of(t)), 64)]
    for w in ("the", "of", words_of(rows[7][1])[3]):
        have = sum(w in p for p in passages) / len(passages)
        assert spread[ld._terms(ld._one(w))[0]] >= have - 1e-9 and abs(spread[ld._terms(ld._one(w))[0]] - have) < 0.01
    assert table.shape[0] == ld.TERMS + 1 and table.shape[1] <= ld.RANK and not table[-1].any()
