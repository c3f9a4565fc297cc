"""Evaluation texts inside a training corpus, found by one Aho-Corasick automaton.

Items and documents are reduced to the same stream of letters and digits (case,
width, punctuation, spacing, tags and entities fall away), and every k-gram of the
items that belongs to one item only becomes a pattern. A document is scanned once
from end to end. Hits are chained into passages that keep the item's order, passages too short
to be more than a scrap are dropped, and an exact check adds up which part of
the item's own characters its passages carry. Offsets lead back to the original text.
Item sets too large for one automaton are cut into blocks, each scanned by its own.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.session import checkpoint

TAG = re.compile(r"<[/!]?[A-Za-z][^<>]{0,200}>|&(?:[A-Za-z]{2,8}|#[0-9]{1,6}|#x[0-9A-Fa-f]{1,5});")
KEEP = re.compile(r"[^\W_]+")


def stream(text: str) -> str:
    """Letters and digits of the text, folded: NFKC, lower case, tags and entities removed."""
    if "<" in text or "&" in text:
        text = TAG.sub(lambda m: html.unescape(m[0]) if m[0][0] == "&" else " ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return "".join(KEEP.findall(text.casefold()))


#: an ASCII character and what may fold with it: no normalisation reaches beyond
SEGMENT = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]*")


def _fold(text: str) -> str:
    return "".join(KEEP.findall(unicodedata.normalize("NFKC", text).casefold()))


def offsets(text: str) -> tuple[str, list[int]]:
    """stream(text) with, for each of its characters, its place in the original text.

    Where characters fold together, all of the result has the place of the first.
    """
    plain, place, i = [], [], 0
    for m in TAG.finditer(text):
        inner = html.unescape(m[0]) if m[0][0] == "&" else " "
        plain += [text[i : m.start()], inner]
        place += [*range(i, m.start()), *[m.start()] * len(inner)]
        i = m.end()
    plain.append(text[i:])
    place += range(i, len(text))
    out, at = [], []
    for m in SEGMENT.finditer("".join(plain)):
        whole, each = _fold(m[0]), [_fold(c) for c in m[0]]
        out.append(whole)
        if "".join(each) == whole:
            at += [place[m.start() + k] for k, f in enumerate(each) for _ in f]
        else:
            at += [place[m.start()]] * len(whole)
    return "".join(out), at


WIDE, CJK = 12, 5


def gram_length(s: str, share: float = 0.4) -> tuple[int, int]:
    """(k, full k) of an item: shorter where each character is a word, and where the share of a short item is less than k.

    An item shorter than its k is one pattern as a whole. Less than 7 letters (3 ideographs) in a row are a scrap in any item.
    """
    ideographs = sum("㐀" <= c <= "鿿" for c in s)
    full, least = (CJK, 3) if ideographs > 0.3 * len(s) else (WIDE, 7)
    return min(len(s), full, max(least, math.ceil(share * len(s)))), full


def grams(s: str, share: float = 0.4) -> Iterator[tuple[str, int]]:
    k = gram_length(s, share)[0]
    return ((s[j : j + k], j) for j in range(len(s) - k + 1 if k else 0))


def own_grams(items: Sequence[tuple[int, str]], share: float = 0.4) -> dict[int, list[int]]:
    """item -> places of the k-grams that no other item has. Grams shared by items (sentence frames) are none's own."""
    owner: dict[str, int] = {}
    for i, s in items:
        for g, _ in grams(s, share):
            if owner.setdefault(g, i) != i:
                owner[g] = -1
    return {i: [j for g, j in grams(s, share) if owner[g] == i] for i, s in items}


class Automaton:
    """Own k-grams of a bounded set of items: (item, its stream, places of its own grams)."""

    def __init__(self, items: Sequence[tuple[int, str, Sequence[int]]], share: float = 0.4):
        import ahocorasick

        self.k: dict[int, int] = {}
        self.least: dict[int, int] = {}
        self.own: dict[int, set] = defaultdict(set)
        self.at: list[tuple[int, list[int]]] = []
        self.a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, s, places in items:
            self.k[i], full = gram_length(s, share)
            seen: dict[str, int] = {}
            for j in places:
                g = s[j : j + self.k[i]]
                self.own[i].update(range(j, j + len(g)))
                if g in seen:
                    self.at[seen[g]][1].append(j)
                else:
                    seen[g] = len(self.at)
                    self.a.add_word(g, len(self.at))
                    self.at.append((i, [j]))
            # less than this is a scrap; never more than the share that counts
            self.least[i] = min(int(2.5 * full), max(self.k[i], math.ceil(share * len(self.own[i]))))
        self.empty = not len(self.a)
        if not self.empty:
            self.a.make_automaton()

    def passages(self, s: str) -> dict[int, list[tuple[int, int, set]]]:
        """item -> [(first, last character in s, item characters carried)], scraps left out."""
        hits: dict[int, list] = defaultdict(list)
        if not self.empty:
            for e, g in self.a.iter(s):
                i, places = self.at[g]
                hits[i] += [(e, j) for j in places]
        out = {}
        for i, h in hits.items():
            k, got, run = self.k[i], [], []
            gap, drift = 8 * k, 4 * k
            for e, j in [*sorted(h), (1 << 60, 0)]:
                if run and (e - run[-1][0] > gap or abs((e - j) - (run[-1][0] - run[-1][1])) > drift):
                    carried = set()
                    last = None
                    for _, q in run:
                        # a differing word between two hits is bridged: its neighbours on both sides are there
                        lo = last if last is not None and 0 < q - last <= k else q
                        carried.update(range(lo, q + k))
                        last = q + k
                    if len(carried) >= self.least[i]:
                        got.append((run[0][0] - k + 1, run[-1][0] + 1, carried))
                    run = []
                run.append((e, j))
            if got:
                out[i] = got
        return out

    def shares(self, s: str) -> dict[int, tuple[float, list[tuple[int, int]]]]:
        """item -> (share of its own characters carried, passages as ranges of s)."""
        out = {}
        for i, ps in self.passages(s).items():
            own = self.own[i]
            carried = set().union(*(c for _, _, c in ps)) & own
            out[i] = (len(carried) / len(own), [(a, b) for a, b, _ in ps])
        return out


_BUILT: dict = {}  # per Python worker: the automaton in use


def _automaton(key: str, items: Sequence, share: float) -> Automaton:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(items, share)
    return _BUILT[key]


def _blocks(known: DataFrame, chars: int, block_chars: int, share: float) -> Iterator[list]:
    """Blocks of [(number, stream, places of own grams)] with the ids of each text, for items (i, t); ids come as strings.

    Few items are worked out here. More, and their grams are counted in Spark; a block at a time comes to the driver.
    """
    if chars <= block_chars:
        groups: dict[str, list] = defaultdict(list)
        for r in known.collect():
            groups[stream(r["t"])].append(r["i"])
        own = own_grams(list(enumerate(groups)), share)
        yield [(k, s, own[k], ids) for k, (s, ids) in enumerate(groups.items())]
        return

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"s": [stream(t) for t in b["t"]], "i": list(b["i"])}, dtype=object)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b["s"]:
                got = list(grams(s, share))
                yield pd.DataFrame({"g": pd.Series([g for g, _ in got], dtype=object), "j": pd.Series([j for _, j in got], dtype="int32"), "h": pd.Series([s] * len(got), dtype=object)})

    n = math.ceil(chars / block_chars)
    texts = known.select("t", "i").mapInPandas(fold, "s string, i string").groupBy("s").agg(F.collect_set("i").alias("ids"), F.xxhash64("s").alias("h"))
    texts = checkpoint(texts)
    each = texts.select("s").mapInPandas(cut, "g string, j int, h string").select("g", "j", F.xxhash64("h").alias("h"))
    single = each.groupBy("g").agg(F.min("h").alias("h"), F.max("h").alias("h2")).where("h = h2").select("g", "h")
    own = each.join(single, ["g", "h"]).groupBy("h").agg(F.collect_list("j").alias("js"))
    all_ = checkpoint(texts.join(own, "h").withColumn("block", F.pmod("h", F.lit(n))))
    for b in range(n):
        rows = all_.where(F.col("block") == b).select("h", "s", "js", "ids").collect()
        yield [(r["h"], r["s"], sorted(r["js"]), r["ids"]) for r in rows]


def leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, share: float = 0.4, block_chars: int = 500_000) -> DataFrame:
    """(doc, item, share, begin, end): documents that carry at least `share` of an item's own wording.

    begin and end are offsets of the first and last carried passage in the original text. Every document row is
    judged, copies each. A passage must carry 30 characters (12 where ideographs prevail), or `share` of the item's own
    wording where that is less. Null or empty texts carry nothing, an item without wording of its own is
    never found; equal items are looked for once and reported each. Items of more than `block_chars` characters
    together are cut into blocks by hash, and the documents are scanned once per block; which wording is an item's own is
    settled over all items before. Only one block at a time is in the driver and in a Python worker.
    """
    kind, doc_kind = items.select(F.col(item)).dtypes[0][1], docs.select(F.col(doc)).dtypes[0][1]
    known = items.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null and i is not null").distinct()
    chars = known.agg(F.sum(F.length("t"))).first()[0] or 0
    source = docs.select(F.col(doc).alias("d"), F.col(text).alias("t"))

    def scanner(texts, key: str):
        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            auto, ids = _automaton(key, [x[:3] for x in texts.value], share), {x[0]: x[3] for x in texts.value}
            for b in batches:
                rows = []
                for d, t in zip(b["d"], b["t"], strict=True):
                    if not t:
                        continue
                    found = {i: v for i, v in auto.shares(stream(t)).items() if v[0] >= share}
                    if found:
                        at = offsets(t)[1]
                        rows += [(d, x, s, at[min(p)[0]], at[max(y[1] for y in p) - 1] + 1) for i, (s, p) in found.items() for x in ids[i]]
                yield pd.DataFrame(rows, columns=["d", "i", "share", "begin", "end"])

        return scan

    out = None
    for block in _blocks(known, chars, block_chars, share):
        texts = docs.sparkSession.sparkContext.broadcast([x for x in block if x[2]])
        hit = source.mapInPandas(scanner(texts, uuid.uuid4().hex), f"d {doc_kind}, i string, share double, begin long, end long")
        out = hit if out is None else out.unionByName(hit)
    return out.select(F.col("d").alias(doc), F.col("i").cast(kind).alias(item), "share", "begin", "end")
