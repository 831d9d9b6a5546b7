"""Language of a text: word by word, backing off to character n-grams.

A word is a run of letters, in lower case. A known word adds its log frequency in each language; of an unseen
word, the longest known character n-grams (of the word between two marks) stand for it: their mean log
frequency at five characters, else at four, and so on to one. The language with the largest sum is predicted,
and its share after normalising the sums is the score.

Counting is done over all texts to learn from: tasks count the words of their texts, and Spark sums them; n-gram
counts are sums over the counted words. What is known is what has at least the share `MIN_SHARE` of the words
(or of the n-grams of one length) of a language, so that a model has at most 1 / MIN_SHARE entries for each
language and length, whatever the corpus. Scoring shuffles nothing.

Defined cases: a null text, and one without a letter, is `und` with score 0; a text of which nothing is known,
and every text if nothing could be learnt, has score 0, and is the commonest language or `und`; repeated rows
count each; rows without a language are not learnt from; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtally.llm.store import stored

MIN_SHARE = 5e-6
LONGEST = 5
#: Added to every count.
SMOOTHING = 0.1
#: Unseen words whose n-grams a task remembers.
MEMO_ENTRIES = 200_000

LETTERS = re.compile(r"[^\W\d_]+")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            counts.setdefault(lang.as_py(), Counter()).update(LETTERS.findall(text.as_py().lower()))
        for lang, words in counts.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(words), pa.string()),
                    pa.array(list(words), pa.string()),
                    pa.array(list(words.values()), pa.int64()),
                ],
                ["lang", "gram", "n"],
            )


def grams_of(word: str, size: int) -> list[str]:
    marked = f"^{word}$" if size > 1 else word
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # Words of one count together: most are rare, and their n-grams are counted in one go.
        alike: dict[tuple[str, int], list[str]] = {}
        for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            alike.setdefault((lang, n), []).append(word)
        counts: dict[tuple[str, int], Counter] = {}
        for (lang, n), words in alike.items():
            for size in range(1, LONGEST + 1):
                found = Counter(chain.from_iterable(grams_of(word, size) for word in words))
                own = counts.setdefault((lang, size), Counter())
                own.update(found if n == 1 else {gram: n * times for gram, times in found.items()})
        for (lang, size), grams in counts.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([size] * len(grams), pa.int32()),
                    pa.array([lang] * len(grams), pa.string()),
                    pa.array(list(grams), pa.string()),
                    pa.array(list(grams.values()), pa.int64()),
                ],
                ["size", "lang", "gram", "n"],
            )


def learn(texts: DataFrame) -> dict:
    """Model of `texts` (text, lang): languages and, by gram length (0: words), grams with their log frequencies."""
    learnt = texts.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    words = stored(
        learnt.mapInArrow(_count_words, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    grams = (
        words.mapInArrow(_count_grams, "size int, lang string, gram string, n long")
        .groupBy("size", "lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    counts = stored(words.select(F.lit(0).alias("size"), "lang", "gram", "n").unionByName(grams))
    totals = {(r.size, r.lang): r.n for r in counts.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({lang for _, lang in totals})
    # A gram that is known in one language is known with its counts in all.
    enough = [(F.col("size") == size) & (F.col("lang") == lang) & (F.col("n") >= MIN_SHARE * n) for (size, lang), n in totals.items()]
    some = counts.where(_any(enough)).select("size", "gram").distinct()
    rows = counts.join(some, ["size", "gram"]).select("size", "gram", "lang", "n").toArrow()
    place = {lang: i for i, lang in enumerate(langs)}
    known: dict[int, tuple[list[str], np.ndarray]] = {}
    for size in range(LONGEST + 1):
        own = rows.filter(pc.equal(rows.column("size"), size))
        names = {g: i for i, g in enumerate(dict.fromkeys(own.column("gram").to_pylist()))}
        table = np.full((len(names), len(langs)), SMOOTHING)
        for gram, lang, n in zip(*(own.column(c).to_pylist() for c in ("gram", "lang", "n")), strict=True):
            table[names[gram], place[lang]] += n
        whole = np.array([totals.get((size, lang), 0) for lang in langs]) + SMOOTHING * (len(names) + 1)
        known[size] = (list(names), np.log(table / whole))
    common = max(langs, key=lambda x: totals.get((0, x), 0)) if langs else None
    return {"langs": langs, "common": common, "known": known}


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


class Scorer:
    def __init__(self, model: dict):
        self._langs, self._common = model["langs"], model["common"]
        known = [model["known"][size] for size in range(LONGEST + 1)]
        # Rows of one table: words, then the n-grams of all lengths, which differ in length and so as keys.
        self._table = np.concatenate([table for _, table in known])
        self._words = {word: i for i, word in enumerate(known[0][0])}
        grams = chain.from_iterable(names for names, _ in known[1:])
        self._grams = {gram: i for i, gram in enumerate(grams, len(self._words))}
        self._memo: dict[str, list[int]] = {}

    def _unseen(self, word: str) -> list[int]:
        """Rows of the longest known n-grams."""
        found = self._memo.get(word)
        if found is not None:
            return found
        found, get = [], self._grams.get
        for size in range(min(LONGEST, len(word) + 2), 0, -1):
            found = [i for i in map(get, grams_of(word, size)) if i is not None]
            if found:
                break
        if len(self._memo) >= MEMO_ENTRIES:
            self._memo.clear()
        self._memo[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(LETTERS.findall(text.lower())) if text else {}
        if not counts or not self._langs:
            return "und", 0.0
        words, get = list(counts), self._words.get
        row = np.array([get(word, -1) for word in words])
        times = np.fromiter(counts.values(), float, len(words))
        seen = row >= 0
        rows, shares = row[seen].tolist(), times[seen].tolist()
        for i in np.flatnonzero(~seen).tolist():
            if own := self._unseen(words[i]):
                # The mean of an unseen word's n-grams counts like one word.
                rows += own
                shares += [times[i] / len(own)] * len(own)
        if not rows:
            return self._common, 0.0
        total = np.asarray(shares) @ self._table[rows]
        best = int(total.argmax())
        return self._langs[best], float(1 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.predict(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x for x, _ in found], pa.string()),
                    pa.array([x for _, x in found], pa.float64()),
                ],
                ["doc_id", "lang_pred", "score"],
            )

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double")
