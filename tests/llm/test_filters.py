"""Quality rules, language, HTML and secrets against direct versions and on odd inputs."""

import random
import string

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from tickloom.llm import compression_rules as cr
from tickloom.llm import html_blocks as hb
from tickloom.llm import language_id as li
from tickloom.llm import secret_grammar as sg
from tickloom.llm.queries import op4_compression_bands

SF = "/root/testdata/sf0.001"


def odd(write):
    return [(1, None), (2, ""), (3, "  \n"), (4, "x"), (5, write(5, 300)), (5, write(5, 300)), (None, write(6, 200)), (7, "word " * 60000), (8, write(8, 30000))]


def test_quality_matches_plain_rules(spark, make, write):
    r = random.Random(3)
    rows = odd(write) + [(20, "".join(r.choices(string.printable, k=3000))), (21, bytes(r.randbytes(3000)).decode("latin-1")), (22, "abc " * 900 + write(9, 60))]
    docs = make(rows, extra=True)
    got = {(x.doc_id, x.text): x["quality"] for x in cr.score_quality(docs).collect()}
    for i, t in rows:
        assert tuple(got[i, t]) == cr.judge(None if t is None else t.encode())
    raw = write(5, 300).encode()
    assert got[5, write(5, 300)].ratio == len(raw) / len(zstandard.ZstdCompressor(level=3).compress(raw))
    kept = cr.filter_quality(docs)
    assert kept.columns == docs.columns and {x.quality for x in kept.collect()} == {"own"}
    assert sorted((x.doc_id or 0) for x in kept.collect()) == [0, 2, 3, 4, 5, 5, 8]
    assert cr.filter_quality(make([])).count() == 0


def test_quality_keeps_labelled_good_and_drops_repetition(spark):
    kept = {r.doc_id for r in op4_compression_bands(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert all(r.doc_id in kept for r in labels if r.quality == 1)
    assert any(r.doc_id not in kept for r in labels if r.quality == 0)


def test_chunks_reject_a_long_text_with_repetition():
    r = random.Random(1)
    prose_ = " ".join("".join(r.choices(string.ascii_lowercase, k=r.randint(2, 9))) for _ in range(3000))
    assert cr.judge(prose_.encode())[4] is None
    assert cr.judge((prose_ + "la " * 9000).encode())[4] in ("chunks", "repetitive")


@pytest.fixture(scope="module")
def model():
    pieces = li.Pieces(li.vocabulary())
    prob = np.zeros((pieces.n + 1, 2))
    prob[:-1, 0] = li.fit_language(["the house and the garden of the city " * 5], pieces)
    prob[:-1, 1] = li.fit_language(["das haus und der garten in der stadt " * 5], pieces)
    return li.Model(["de_", "en_"][::-1], pieces, prob)


def test_forward_sums_all_segmentations(model):
    known = {p: i for i, p in enumerate(li.vocabulary())}
    for word in ("the", "garten", "xqüß", "☃☃", "a" * 70):
        buf, off = li.text_buffers(pa.array([word]))
        codes, start, length, _, _ = li.distinct_words(buf, off)
        marked, total = "▁" + word, np.zeros((len(word) + 2, 2))
        total[0] = 1
        for t in range(1, len(marked) + 1):
            for k in range(1, min(t, li.LONGEST_PIECE) + 1):
                i = known.get(marked[t - k : t])
                total[t] += total[t - k] * (model.prob[i] if i is not None else li.UNKNOWN if k == 1 else 0)
        np.testing.assert_allclose(li.forward(codes, start, length, model)[0], np.log(total[-1]), rtol=1e-9)


def test_language_of_odd_texts(spark, make, write, model):
    rows = odd(write) + [(30, "the garden"), (31, "der garten und das haus"), (32, "y" * 5000)]
    docs = make(rows, extra=True)
    got = [(x.doc_id, x.text, x["language"].lang) for x in li.identify(docs, model).collect()]
    by = {(i, t): v for i, t, v in got}
    assert len(got) == len(rows)
    assert by[1, None] == by[2, ""] == by[3, "  \n"] == "und"
    assert by[30, "the garden"] == "en_" and by[31, "der garten und das haus"] == "de_"
    assert {x["language"].lang for x in li.identify(docs, None).collect()} == {"und"}
    assert li.fit(docs.withColumn("lang", docs.lang.substr(9, 1)).filter("doc_id > 99")) is None


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fitted = li.fit(docs.filter("doc_id % 2 = 0"), sample=100)
    rest = li.identify(docs.filter("doc_id % 2 = 1 and n_chars > 40"), fitted).selectExpr("avg(cast(language.lang = lang as int)) as a").first().a
    assert rest > 0.97


def test_html_passes(spark):
    words = hb.STOP_WORDS["en"]
    long = "the cat and the dog are in the house with all of them and it is what they do when we are out " * 3
    page = f"<html lang=en><nav><a href=x>home</a></nav><h1>Title here</h1><p>{long}</p><p>Short one.</p><p>{long}</p><div><a href=y>{long}</a></div><footer>bye</footer><script>var x='<p>no</p>';</script>"
    text, n, kept = hb.extract(page)
    assert text.split("\n") == ["Title here", long.strip(), "Short one.", long.strip()] and n == 7 and kept == 4
    assert hb.first_pass((long, len(long), False, False), words) == "bad"
    # direct version of the second pass
    r = random.Random(5)
    for _ in range(300):
        labels = [r.choice(["good", "bad", "short", "near"]) for _ in range(r.randint(0, 12))]
        found = [("x" * 50, 0, False, False)] * len(labels)
        want = []
        for i, label in enumerate(labels):
            before = next((x for x in labels[:i][::-1] if x in ("good", "bad")), "bad")
            after = next((x for x in labels[i + 1 :] if x in ("good", "bad")), "bad")
            want.append(label == "good" or label == "short" and before == after == "good" or label == "near" and "good" in (before, after))
        assert hb.second_pass(labels, found) == want


def test_html_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "<"), (4, "<p"), (5, "plain text & more &amp; <b>bold"), (6, "<p>" + "the and of word " * 50000), (None, "<p></p>"), (6, "<p>" + "the and of word " * 50000)]
    got = hb.extract_pages(spark.createDataFrame(rows, "page_id bigint, html string").selectExpr("*", "'own' as extracted", "'own' as text")).collect()
    by = {(r.page_id, r.html): r.extracted for r in got}
    assert by[1, None].text is None and by[2, ""].text == "" and by[4, "<p"].n_kept == 0
    assert len(by[6, rows[5][1]].text) > 700000 and {r.text for r in got} == {"own"} and len(got) == len(rows)
    assert hb.extract_pages(spark.createDataFrame([], "page_id bigint, html string")).count() == 0


def test_secret_formats_on_held_out_values():
    r = random.Random(7)
    hexes = ["".join(r.choices("0123456789abcdef", k=40)) for _ in range(600)]
    keys = ["AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)) for _ in range(600)]
    for values in (hexes, keys):
        a = sg.learn(values[:300])
        assert np.mean([a.score(v) >= a.threshold for v in values[300:]]) > 0.97
        for other in ("4041894974608795", "HELLOWORLDHELLOWORLD1", "thequickbrownfox-jumps", hexes[0][:30], keys[0] + "A"):
            assert a.score(other) < a.threshold


def test_automaton_merges_alike_states_only():
    a = sg.Automaton(["a" + x + "c" for x in "0123456789" * 30] + ["b" + x + "zz" for x in "xy" * 150])
    assert [len(level) for level in a.levels][:2] == [1, 2]
    one = a.levels[0][0]
    assert one[1]["a"] != one[1]["b"]


def test_secret_scan_odd_texts(spark, make, write):
    r = random.Random(9)
    values = ["".join(r.choices("0123456789abcdef", k=40)) for _ in range(60)]
    rows = odd(write) + [(100 + i, f'{write(i, 20)} token = "{v}" {write(i + 500, 9)}') for i, v in enumerate(values[:50])] + [(200 + i, f"{write(i, 5)} {v} x") for i, v in enumerate(values[50:])]
    got = sg.scan_secrets(make(rows, extra=True)).collect()
    texts = dict((i, t) for i, t in rows)
    flagged = {(x.doc_id, texts[x.doc_id][x.start : x.start + x.length]) for x in got if x.secret}
    assert {v for _, v in flagged} == set(values)
    assert sg.scan_secrets(make([(1, "abc-123-def-456-ghi")])).first().secret is False
    assert sg.scan_secrets(make([])).count() == 0
