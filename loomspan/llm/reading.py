"""Reading level of English documents.

Words are ranked by their frequency in all English prose. A document's coverage
rank at a share s is the size of the smallest frequency-ranked vocabulary that
covers the share s of its running words. Coverage ranks at several shares, word
length and sentence complexity are calibrated to hand-given grades by a least-squares
fit on a bounded sample of the labelled documents, and the fit is applied to all as a SQL expression.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.session import checkpoint, written

SHARES = (0.3, 0.5, 0.65, 0.8, 0.9, 0.95)
FEATURES = (*[f"rank_{round(100 * s)}" for s in SHARES], "word_letters", "sentence_words", "commas")
MIN_WORDS = 5


TAG = re.compile(r"<[/!]?[A-Za-z][^<>]{0,200}>|&[A-Za-z]{2,8};")
#: marks of code, formulas and tables; a comma inside a number is none of them
SYMBOL = re.compile(r"[_(){}\[\]<>=*/|+\\\t^~`@#$]|,(?=[^\s\"'])")
GROUPED = re.compile(r"(?<=\d),(?=\d{3}(?!\d))")
WORD = re.compile(r"(?<![A-Za-z0-9_.\-])[A-Z]?[a-z]+(?![A-Za-z0-9_])")
SENTENCE_END = re.compile(r"(?<=[A-Za-z%)])[.!?;](?=\s|$)|\n")
WRAP = re.compile(r"(?<=[^\s.!?;:])[ \t]*\n[ \t]*(?=[a-z])")
CJK = re.compile(r"[\u3400-\u9fff]")
# Frequent short words that mark a language written in Latin letters.
FUNCTION_WORDS = {
    "en": "the of and to is that for it was with as by this which from not are",
    "de": "der die das und ist nicht ein eine mit von zu den auf sich dem als auch",
    "fr": "le la les des et est une dans pour que qui sur pas avec ne sont aux",
    "es": "el los las una que por con para del se su como pero esta hay lo",
    "it": "il che di una per con del della non sono gli anche nel dei lo",
    "pt": "o os uma que para com do da dos das por mais como foi ao",
    "nl": "de het een van en dat niet zijn op met voor aan ook te er",
}
LANGUAGE_OF: dict[str, list[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        LANGUAGE_OF.setdefault(_w, []).append(_lang)
FOREIGN = frozenset(w for w, langs in LANGUAGE_OF.items() if "en" not in langs)


def prose(text: str) -> str:
    """The text without tags, entities and lines that are no prose.

    A line that goes on in lower case after a line without an end mark is one line with it (hard-wrapped text). No prose:
    fewer than five words, or one symbol of code or tables in twenty characters.
    """
    if "<" in text or "&" in text:
        text = TAG.sub(" ", text)
    lines = (WRAP.sub(" ", text) if "\n" in text else text).split("\n")
    return "\n".join(x for x in lines if x.count(" ") >= 4 and not _marked(x))


def _marked(x: str) -> bool:
    n = len(SYMBOL.findall(x))
    return n * 20 >= len(x) and (n - len(GROUPED.findall(x))) * 20 >= len(x)


def english(words: Sequence[str]) -> bool:
    """Whether no other language has more of its function words among the words than English; with none at all, Latin letters are taken for English."""
    if FOREIGN.isdisjoint(words):
        return True
    n: Counter = Counter()
    for w, k in Counter(words).items():
        for x in LANGUAGE_OF.get(w, ()):
            n[x] += k
    return n["en"] >= max(n.values(), default=0)


def running_words(text: str | None) -> tuple[list[str], int, int, int] | None:
    """(words, tokens, sentences, commas) of a text's prose; None unless it is English.

    English: at least MIN_WORDS words of Latin letters, fewer CJK characters than words, and English by its function words.
    A word is in letters only, its first perhaps a capital.
    """
    if not text:
        return None
    p = prose(text)
    w = WORD.findall(p)
    if len(w) < MIN_WORDS or (not p.isascii() and len(CJK.findall(p)) >= len(w)) or not english(w):
        return None
    sents = sum(len(x.split(None, 2)) > 2 for x in SENTENCE_END.split(p))
    return w, len(p.split()), max(1, sents), p.count(",")


def coverage(ranks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """log(1 + rank) of the smallest vocabulary that covers each of SHARES of the running words."""
    o = np.argsort(ranks, kind="stable")
    c = np.cumsum(weights[o])
    at = np.searchsorted(c, np.ceil(np.array(SHARES) * c[-1] - 1e-9).clip(1))
    return np.log1p(ranks[o][np.minimum(at, len(o) - 1)])


def running_text(docs: DataFrame, doc: str, text: str) -> tuple[DataFrame, DataFrame]:
    """What the texts are read for, once: (row, doc, words, tokens, sents, commas) of each document row that is English
    prose, its words in lower case; and (word, n), how often each word occurs in lower case.

    Both come from one pass, stored as a compressed table in the shared folder. Words are counted per Arrow batch there.
    """
    kind = docs.select(F.col(doc)).dtypes[0][1]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: Counter = Counter()
            out = []
            for i, key, t in zip(b["row"], b["doc"], b["t"], strict=True):
                got = running_words(t)
                if got:
                    c.update(w for w in got[0] if w[0].islower())
                    out.append((i, key, " ".join(got[0]).lower(), *got[1:], None, None))
            # a column of one type whatever the batch holds
            yield pd.DataFrame([*out, *[(None, None, None, None, None, None, w, n) for w, n in c.items()]], columns=["row", "doc", "words", "tokens", "sents", "commas", "word", "n"], dtype=object)

    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc).alias("doc"), F.col(text).alias("t"))
    both = written(d.mapInPandas(read, f"row long, doc {kind}, words string, tokens long, sents long, commas long, word string, n long"))
    return both.where("words is not null").select("row", "doc", "words", "tokens", "sents", "commas"), both.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))


def word_ranks(counts: DataFrame) -> DataFrame:
    """(word, rank) by descending count; equal counts share their mean rank.

    No global sort of the vocabulary: the one window without a key runs over distinct counts, at most sqrt(2 * running words) rows.
    """
    counts = checkpoint(counts)
    tiers = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    above = F.sum("words").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    return counts.join(tiers.select("n", (F.coalesce(above, F.lit(0)) + (F.col("words") + 1) / 2).alias("rank")), "n").select("word", "rank")


def features(docs: DataFrame, doc: str, text: str, max_broadcast_words: int = 500_000) -> DataFrame:
    """(doc, n_words, FEATURES) of each document row that is English prose by its text.

    Null, empty and other texts are left out. Of capitalised words only those that also occur in
    lower case count (names fall away). Nothing is sampled: ranks are of all documents. The
    vocabulary is broadcast up to `max_broadcast_words`; a larger one is joined by shuffle, with the same result.
    """
    texts, counts = running_text(docs, doc, text)
    ranks = word_ranks(counts)
    kind = dict(texts.dtypes)["doc"]
    schema = f"doc {kind}, n_words int, " + ", ".join(f"{f} double" for f in FEATURES)
    cols = ["doc", "n_words", *FEATURES]

    def row(key, w: np.ndarray, r: np.ndarray, letters: float, tokens: int, sents: int, commas: int) -> tuple | None:
        n = int(w.sum())
        return None if n < MIN_WORDS else (key, n, *coverage(r, w), letters / n, float(np.log1p(tokens / sents)), commas / sents)

    if ranks.limit(max_broadcast_words + 1).count() <= max_broadcast_words:
        table = docs.sparkSession.sparkContext.broadcast({r["word"]: (r["rank"], len(r["word"])) for r in ranks.collect()})

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rank = table.value
            for b in batches:
                out = []
                for key, words, *more in zip(b["doc"], b["words"], b["tokens"], b["sents"], b["commas"], strict=True):
                    known = [x for x in map(rank.get, words.split(" ")) if x is not None]
                    if known:
                        a = np.array(known, float)
                        out.append(row(key, np.ones(len(a)), a[:, 0], a[:, 1].sum(), *more))
                yield pd.DataFrame([x for x in out if x], columns=cols)

        return texts.drop("row").mapInPandas(measure, schema)

    words = texts.select("row", "doc", "tokens", "sents", "commas", F.explode(F.split("words", " ")).alias("word"))
    # ids may repeat or be null: the row's own number keeps its words together
    words = words.groupBy("row", "doc", "tokens", "sents", "commas", "word").agg(F.count(F.lit(1)).alias("n"))
    per = words.join(ranks, "word").groupBy("row", "doc", "tokens", "sents", "commas").agg(F.collect_list(F.struct("rank", "n", F.length("word").alias("len"))).alias("ws"))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, tokens, sents, commas, ws in zip(b["doc"], b["tokens"], b["sents"], b["commas"], b["ws"], strict=True):
                a = np.array([(x["rank"], x["n"], x["len"]) for x in ws], float)
                out.append(row(key, a[:, 1], a[:, 0], (a[:, 1] * a[:, 2]).sum(), tokens, sents, commas))
            yield pd.DataFrame([x for x in out if x], columns=cols)

    return per.mapInPandas(gather, schema)


@dataclass(frozen=True)
class Calibration:
    """Grade as a quadratic of standardised features."""

    mean: tuple[float, ...]
    sd: tuple[float, ...]
    weights: tuple[float, ...]  # 1, features, products i <= j

    def score(self) -> Column:
        z = [(F.col(f) - m) / s for f, m, s in zip(FEATURES, self.mean, self.sd, strict=True)]
        terms = [F.lit(1.0), *z, *[z[i] * z[j] for i in range(len(z)) for j in range(i, len(z))]]
        out = F.lit(0.0)
        for w, t in zip(self.weights, terms, strict=True):
            out = out + F.lit(float(w)) * t
        return out


def _design(x: np.ndarray) -> np.ndarray:
    k = x.shape[1]
    return np.column_stack([np.ones(len(x)), x, *[x[:, i] * x[:, j] for i in range(k) for j in range(i, k)]])


def calibrate(rows: Sequence[tuple], ridge: float = 1.0) -> Calibration:
    """Fit on (features..., grade); a second fit leaves out labels more than 0.8 grades off the first, as readers err."""
    a = np.array(rows, float)
    x, y = a[:, :-1], a[:, -1]
    mean, sd = x.mean(0), np.maximum(x.std(0), 1e-9)
    m = _design((x - mean) / sd)
    penalty = ridge * np.eye(m.shape[1])
    penalty[0, 0] = 0
    keep = np.ones(len(y), bool)
    for _ in range(3):
        w = np.linalg.solve(m[keep].T @ m[keep] + penalty, m[keep].T @ y[keep])
        keep = np.abs(m @ w - y) <= 0.8
    return Calibration(tuple(mean), tuple(sd), tuple(w))


def reading_level(docs: DataFrame, doc: str, text: str, labels: DataFrame, label_doc: str, grade: str, max_labels: int = 20_000) -> DataFrame:
    """(doc, n_words, score, grade) of each English document; grade is 1..5.

    The fit uses at most `max_labels` labelled documents (a bounded sample by hash of the id;
    null grades never count); features and frequencies use all documents. Fewer than 30 usable labels: ValueError.
    Texts that are not English prose have no row.
    """
    f = checkpoint(features(docs, doc, text))
    lab = labels.where(F.col(grade).isNotNull()).groupBy(F.col(label_doc).alias("doc")).agg(F.avg(grade).alias("y"))
    rows = f.join(lab, "doc").orderBy(F.xxhash64("doc"), "doc").select(*FEATURES, "y").limit(max_labels).collect()
    if len(rows) < 30:
        raise ValueError(f"{len(rows)} labelled documents are too few to calibrate on")
    score = calibrate([tuple(r) for r in rows]).score()
    g = F.greatest(F.lit(1), F.least(F.lit(5), F.round("score").cast("int")))
    return f.withColumn("score", score).select(F.col("doc").alias(doc), "n_words", "score", g.alias("grade"))
