import os
import random
import subprocess
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import leaks

W = [a + b + c for a in "kmprst" for b in "aeiou" for c in ("lan", "dor", "vix", "quel", "bran")]
FRAME = "Suppose that the {} pays {} units for every {} until the {} of {} is settled by {} and {}."


def text(seed, n=60):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(W) + str(rnd.randrange(1000)) for _ in range(n))


ITEMS = [(1, text(1)), (2, text(2)), (3, FRAME.format(*random.Random(5).sample(W, 7))), (4, FRAME.format(*random.Random(6).sample(W, 7))), (5, "在第六十七个交易日以六百二十二元买入三百零二手随后今日的数据记录分组达十六点九个百分点"), (6, None), (7, ""), (8, text(2))]


def run(spark, docs, items=ITEMS, **kw):
    d = spark.createDataFrame(docs, "d long, t string, item long, i string")
    it = spark.createDataFrame(items, "item long, t string")
    return {(r["d"], r["item"]) for r in leaks.leaks(d.select("d", "t", "i"), "d", "t", it, "item", "t", **kw).collect()}


def doc(i, t):
    return (i, t, 0, "x")


def test_forms(spark):
    one = ITEMS[0][1]
    half = " ".join(one.split()[:32])
    docs = [
        doc(1, "before " + one + " after"), doc(2, one.upper().replace(" ", "\n- ")), doc(3, " ".join(f"<b>{w}</b>&nbsp;" for w in one.split())), doc(4, "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in one)),
        doc(5, half), doc(6, " ".join(one.split()[:8])), doc(7, " ".join(w if k % 9 else "other" for k, w in enumerate(one.split()))), doc(8, " ".join(one.split()[:15]) + text(99, 200) + " ".join(one.split()[30:45])),
        doc(9, text(77, 500)), doc(10, ""), doc(11, None), doc(12, "before " + one + " after"), doc(13, "说明" + ITEMS[4][1] + "结束"),
    ]
    assert run(spark, docs) == {*((i, 1) for i in (1, 2, 3, 4, 5, 7, 8, 12)), (13, 5)}


def test_frames_are_no_case_and_equal_items_are_both_reported(spark):
    docs = [doc(1, FRAME.format(*random.Random(9).sample(W, 7))), doc(2, ITEMS[2][1]), doc(3, ITEMS[1][1])]
    assert run(spark, docs) == {(2, 3), (3, 2), (3, 8)}


def test_empty_tables(spark):
    assert run(spark, []) == set()
    assert run(spark, [doc(1, "text")], []) == set()


def test_offsets_lead_back(spark):
    one = ITEMS[0][1]
    t = "ÀÉ ﬁ intro <b>x</b> " + one + " outro of the text"
    d = spark.createDataFrame([(1, t)], "d long, t string")
    it = spark.createDataFrame(ITEMS[:1], "item long, t string")
    r = leaks.leaks(d, "d", "t", it, "item", "t").first()
    assert t[r["begin"] : r["end"]] == one and r["share"] == 1.0


@given(st.lists(st.sampled_from(["a", "Z", " ", "é", "e\u0301", "\u0301", "ﬁ", "한", "ᄒ", "ᅡ", "ᆫ", "&amp;", "&#768;", "&nbsp;", "<b>", "<", "&", "ß", "İ", "中", "７", "㍿", "\u0300\u0323", "x"]), max_size=12))
@settings(max_examples=400, deadline=None)
def test_offsets_belong_to_the_stream(parts):
    t = "".join(parts)
    s, at = leaks.offsets(t)
    assert s == leaks.stream(t) and len(s) == len(at) and at == sorted(at) and all(0 <= i < len(t) for i in at)


@pytest.mark.parametrize("n", [8, 17, 40, 57])
def test_short_items(spark, n):
    """Two fifths in one passage are found in an item of any size; of 8 letters, 7 in a row."""
    item = "".join(random.Random(n).choices("bcdfghjklmnpqrstvwxz", k=n))
    part = item[: max(7, -(-2 * n // 5))]
    docs = [doc(1, "so " + item + " it is"), doc(2, text(3, 80) + " " + part + " " + text(4, 80)), doc(3, text(5, 80) + item[: max(6, -(-2 * n // 5)) - 3]), doc(4, text(6, 300))]
    assert run(spark, docs, [(1, item), (2, text(1))]) == {(1, 1), (2, 1)}


def test_blocks_give_the_same(spark):
    rnd = random.Random(11)
    items = [(i, FRAME.format(*rnd.sample(W, 7)) + text(i, rnd.randrange(2, 40))) for i in range(100, 130)] + ITEMS
    docs = [doc(i, text(500 + i, 30) + " " + " ".join(items[i % len(items)][1].split()[: 10 + i]) if items[i % len(items)][1] else "") for i in range(60)]
    whole = run(spark, docs, items)
    assert len(whole) > 20 and run(spark, docs, items, block_chars=3_000) == whole


def test_an_automaton_of_many_characters_stays_small():
    """A block of the default size, in a process of its own: below 1 GB."""
    code = "import random, resource; from loomspan.llm import leaks; r = random.Random(1); items = [(i, ''.join(r.choices('abcdefghijklmnopqrstuvwxyz', k=1000))) for i in range(500)]; own = leaks.own_grams(items); leaks.Automaton([(i, s, own[i]) for i, s in items]); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))).stdout) < 1_000_000


def test_scan_against_brute_force():
    items = [(1, leaks.stream(ITEMS[0][1])), (2, leaks.stream(ITEMS[1][1]))]
    own = leaks.own_grams(items)
    auto = leaks.Automaton([(i, t, own[i]) for i, t in items])
    s = leaks.stream("x " + " ".join(ITEMS[0][1].split()[10:40]) + text(5, 100))
    share = auto.shares(s)[1][0]
    item = leaks.stream(ITEMS[0][1])
    k = auto.k[1]
    carried = set()
    for j in range(len(item) - k + 1):
        if item[j : j + k] in s:
            carried.update(range(j, j + k))
    assert abs(share - len(carried & auto.own[1]) / len(auto.own[1])) < 0.02
