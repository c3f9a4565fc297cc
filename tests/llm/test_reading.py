import random

import numpy as np
import pytest

from loomspan.llm import reading

EASY = "the cat sat on a mat and we ran to see it go up or down all day with you".split()
HARD = "notwithstanding multicollinear heteroskedasticity circumscribes orthogonalisation irrespective unobservable counterfactual parameterisation securitisation".split()


def make(i, grade, rnd):
    share = (grade - 1) / 4
    out = []
    for _ in range(rnd.randrange(8, 14)):
        n = 5 + 4 * grade + rnd.randrange(4)
        out.append(" ".join(rnd.choice(HARD) if rnd.random() < share else rnd.choice(EASY) for _ in range(n)).capitalize() + ".")
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(0)
    grades = [1 + i % 5 for i in range(400)]
    return [(i, make(i, g, rnd)) for i, g in enumerate(grades)], grades


def run(spark, docs, labels, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, grade int")
    return {r["doc_id"]: r["grade"] for r in reading.reading_level(d, "doc_id", "text", lab, "doc_id", "grade", **kw).collect()}


def test_held_out_accuracy(spark, corpus):
    docs, grades = corpus
    rnd = random.Random(1)
    labels = [(i, max(1, min(5, grades[i] + (rnd.choice([-1, 1]) if rnd.random() < 0.08 else 0)))) for i in range(200)] + [(5, None), (9999, 3)]
    extra = [(1000, None), (1001, ""), (1002, "短文" * 50), (1003, "code,close,vol\n1,2,3"), (1004, "word " * 20000)]
    got = run(spark, docs + extra, labels)
    held = [i for i in range(200, 400)]
    assert np.mean([got[i] == grades[i] for i in held]) >= 0.9
    assert set(got) & {1000, 1001, 1002, 1003} == set() and 1004 in got


def test_both_ways_of_joining_the_vocabulary_agree(spark, corpus):
    d = spark.createDataFrame(corpus[0][:60], "doc_id long, text string")
    a = {r["doc"]: tuple(r) for r in reading.features(d, "doc_id", "text").collect()}
    b = {r["doc"]: tuple(r) for r in reading.features(d, "doc_id", "text", max_broadcast_words=0).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k][1:], b[k][1:]) for k in a)


def test_both_ways_give_a_row_per_document_row(spark, corpus):
    texts = [t for _, t in corpus[0][:6]]
    same = "the cat sat on a mat and ran. "
    docs = [(1, texts[0]), (1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[3]), (2, same * 3), (2, same.replace("cat", "mat") * 3)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = (sorted(((r["doc"] or 0, *tuple(r)[1:]) for r in reading.features(d, "doc_id", "text", **kw).collect())) for kw in ({}, {"max_broadcast_words": 0}))
    assert len(a) == len(b) == len(docs) and np.allclose(a, b)


def test_ranks_are_mean_ranks_of_frequency(spark):
    d = spark.createDataFrame([(1, "aa aa aa bb bb cc dd Name ee ee")], "i long, text string")
    got = {r["word"]: r["rank"] for r in reading.word_ranks(reading.running_text(d, "i", "text")[1]).collect()}
    assert got == {"aa": 1.0, "bb": 2.5, "ee": 2.5, "cc": 4.5, "dd": 4.5}


def test_coverage_is_the_smallest_vocabulary():
    r = np.array([5.0, 1, 1, 2, 9, 1, 2, 3, 1, 1])
    got = np.expm1(reading.coverage(r, np.ones(10)))
    for s, g in zip(reading.SHARES, got, strict=True):
        want = min(k for k in r if (r <= k).sum() >= np.ceil(s * 10 - 1e-9))
        assert abs(g - want) < 1e-9


def test_too_few_labels_and_prose():
    assert reading.running_words("<b>one</b> two three four five&nbsp;six.\ncode,close,vol\nFormula: ts_mean(close, 5) / ts_mean(close, 9) and so on here")[0] == "one two three four five six".split()
    assert reading.running_words("") is None and reading.running_words("中文 one two three four five" + "字" * 40) is None


def test_numbers_and_wrapped_lines_are_prose():
    long = "The fund grew to 1,000,000 dollars in two years and paid out every investor in full."
    assert len(reading.running_words(long)[0]) == 15
    wrapped = "The fund grew\nto a million\ndollars in two\nyears and paid\nout every investor."
    assert reading.running_words(wrapped)[0] == reading.running_words(wrapped.replace("\n", " "))[0] and reading.running_words(wrapped)[2] == 1
    for x in ("code,open,high,low,close and more of it", "a | b | c | d | e | f", "1,2,3,4,5 6,7,8,9 and so on", "formula: ts_mean(close, 17) / ts_mean(close, 69) - 1 of it", "one\ttwo\tthree\tfour\tfive six seven eight nine"):
        assert reading.prose(x) == ""


def test_other_languages_are_not_english():
    assert reading.running_words("Der Fonds ist in zwei Jahren auf eine Million gewachsen und hat alle Anleger mit dem Gewinn bezahlt.") is None
    assert reading.running_words("Le fonds est dans une phase de croissance et les investisseurs sont pour une distribution des gains.") is None
    assert reading.running_words("El fondo se llama por su nombre y los inversores esperan que el precio suba con las compras.") is None
    assert reading.running_words("Heteroskedasticity attenuates orthogonalised securitisation throughout intertemporal reconciliation") is not None


def test_no_labels(spark):
    with pytest.raises(ValueError):
        run(spark, [(1, "one two three four five six")], [(1, 3)])
