"""Reading level by smoothed unigram language models, one per grade.

Each grade's model is a multinomial over the words of the prose, their endings
and lengths (so that unseen words count too) and the lengths of the sentences.
It is trained on the labelled documents, smoothed towards the neighbouring
grades and, by a Dirichlet prior, towards the whole sample. A document gets
the grade with the highest posterior.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.session import spread

PROSE_SOURCES = ("docs", "triage", "review", "changelog")
GRADES = (3, 18)
#: Labelled documents the models are fitted on at most, those with the smallest hash of the id.
LABEL_BOUND = 20_000
#: Features (words, endings, lengths) that the models hold, the most frequent ones.
FEATURE_BOUND = 200_000
#: Standard deviation, in grades, of the smoothing between neighbouring grades.
NEIGHBOUR = 1.0
#: Weight of the Dirichlet prior, in words.
PRIOR_WORDS = 2000.0

_FENCE = re.compile(r"^(```|~~~).*?(?:^\1[^\n]*$|\Z)", re.M | re.S)
_END = re.compile(r"[.!?][\"')\]]*$")
_SPLIT = re.compile(r"(?<=[.!?])\s+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[list[str]]:
    """Lower-case words of each sentence; code fences, tables, headings and fragments are no prose.

    A text without any sentence counts as one sentence.
    """
    out = []
    for line in _FENCE.sub("", text).splitlines():
        line = line.strip()
        if line and line[0] not in "|#":
            out += [w for part in _SPLIT.split(line) if _END.search(part) and (w := _WORD.findall(part.lower()))]
    if not out and (words := _WORD.findall(text.lower())):
        out = [words]
    return out


def word_features(word: str) -> list[str]:
    found = [f"w:{word}", f"n:{min(8, len(word) // 2)}"]
    return [*found, f"s:{word[-3:]}"] if len(word) > 5 else found


def length_feature(words: int) -> tuple[str, int]:
    return f"l:{min(12, words // 4)}", max(1, words // 2)


def features(text: str) -> Counter[str]:
    out: Counter[str] = Counter()
    for words in sentences(text):
        for w in words:
            out.update(word_features(w))
        name, weight = length_feature(len(words))
        out[name] += weight
    return out


def formula_grade(text: str) -> int:
    """Grade by sentence length and vowel groups per word, for seeding where nothing is labelled."""
    parts = sentences(text)
    words = [w for p in parts for w in p]
    if not words:
        return GRADES[0]
    vowels = sum(max(1, len(re.findall("[aeiouy]+", w))) for w in words)
    return int(np.clip(round(0.195 * len(words) / len(parts) + 2.8 * vowels / len(words) + 1), *GRADES))


@dataclass
class Models:
    vocabulary: dict[str, int]
    log_p: np.ndarray  # feature x grade
    log_prior: np.ndarray

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Keeps the summed log probabilities of each word seen."""

    def __init__(self, models: Models):
        self.m = models
        self.words: dict[str, np.ndarray] = {}

    def _sum(self, names: list[str]) -> np.ndarray:
        rows = [i for x in names if (i := self.m.vocabulary.get(x)) is not None]
        return self.m.log_p[rows].sum(0)

    def posterior(self, text: str) -> np.ndarray:
        if len(self.words) > 200_000:
            self.words.clear()
        total = self.m.log_prior.copy()
        counts: Counter[str] = Counter()
        lengths: Counter[str] = Counter()
        for words in sentences(text):
            counts.update(words)
            name, weight = length_feature(len(words))
            lengths[name] += weight
        for w, n in counts.items():
            v = self.words.get(w)
            if v is None:
                v = self.words[w] = self._sum(word_features(w))
            total += n * v
        for name, n in lengths.items():
            total += n * self._sum([name])
        p = np.exp(total - total.max())
        return p / p.sum()


def prose(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return df.filter(df[source].isin(*PROSE_SOURCES) & df[text].isNotNull() & df[text].rlike(r"\S")).select(df[doc_id].alias("doc_id"), df[text].alias("text"))


def fit(texts: DataFrame, labels: DataFrame, bound: int = LABEL_BOUND) -> Models:
    """Fit on the labelled texts; where none of the texts is labelled, on all of them with grades by formula.

    Repeated label rows count once; raters who differ count side by side; null
    grades, grades outside the scale and labels of other documents do not
    count. At most ``bound`` labelled texts are used. The models know the
    ``FEATURE_BOUND`` most frequent features.
    """
    lo, hi = GRADES
    wanted = labels.filter(F.col("grade").between(lo, hi)).select("doc_id", "grade").distinct().join(texts.select("doc_id"), "doc_id", "left_semi")
    sample = wanted.join(wanted.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound), "doc_id")
    seeded = sample.isEmpty()
    # bounded: at most `bound` ids and their raters' grades
    graded = sample.groupBy("doc_id").agg(F.collect_set("grade").alias("grades"))
    rows = texts.select(F.array().cast("array<int>").alias("grades"), "text") if seeded else texts.join(F.broadcast(graded), "doc_id").select("grades", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Counter[str]] = {}
        for batch in batches:
            for grades, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = features(text)
                found["docs"] += 1
                for g in [formula_grade(text)] if seeded else grades:
                    total.setdefault(g, Counter()).update(found)
        for g, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(c), pa.int32()), pa.array(list(c)), pa.array(list(map(float, c.values())))], names=["grade", "feature", "n"])

    table = rows.mapInArrow(count, "grade int, feature string, n double").groupBy("grade", "feature").agg(F.sum("n").alias("n"))
    common = table.groupBy("feature").agg(F.sum("n").alias("t")).filter("t >= 2").orderBy(F.col("feature") != "docs", F.desc("t"), "feature").limit(FEATURE_BOUND).select("feature")
    table = table.join(F.broadcast(common), "feature").select("grade", "feature", "n").toPandas()  # at most grades x FEATURE_BOUND numbers
    scale = np.arange(lo, hi + 1)
    kernel = np.exp(-0.5 * ((scale[:, None] - scale[None, :]) / NEIGHBOUR) ** 2)
    kernel /= kernel.sum(1, keepdims=True)
    table = table.sort_values(["feature", "grade"])
    totals = table.groupby("feature").n.sum()
    vocabulary = {f: i for i, f in enumerate(totals.index[(totals >= 2) & (totals.index != "docs")])}
    counts = np.zeros((len(vocabulary), len(scale)))
    docs = np.zeros(len(scale))
    for f, g, n in zip(table.feature, table.grade, table.n, strict=True):
        if f == "docs":
            docs[g - lo] += n
        elif f in vocabulary:
            counts[vocabulary[f], g - lo] += n
    counts, prior = counts @ kernel, docs @ kernel + 1e-9
    base = (counts.sum(1, keepdims=True) + 0.1) / (counts.sum() + 0.1 * max(1, len(vocabulary)))
    log_p = np.log((counts + PRIOR_WORDS * base) / (counts.sum(0, keepdims=True) + PRIOR_WORDS))
    return Models(vocabulary, log_p, np.log(prior / prior.sum()))


def reading_levels(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", bound: int = LABEL_BOUND) -> DataFrame:
    """``doc_id, level, years, certainty`` of each prose document.

    ``level`` is the most probable grade, ``years`` the posterior mean,
    ``certainty`` the probability of the level. Defined cases: other sources,
    null and blank texts have no row; repeated rows have a row each; a text
    without words gets the level most common among the labels; without labels
    the models are seeded by a formula; empty documents give no rows; other
    columns are not read.
    """
    spark: SparkSession = df.sparkSession
    texts = prose(df, doc_id, text, source)
    kind = texts.schema["doc_id"].dataType.simpleString()
    models = spark.sparkContext.broadcast(fit(texts, labels, bound))  # bounded by the labelled sample
    scale = np.arange(GRADES[0], GRADES[1] + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = models.value.scorer()
        for batch in batches:
            p = np.array([scorer.posterior(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(scale))
            at = p.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scale[at].astype(np.int32)), pa.array(p @ scale), pa.array(p.max(1) if len(p) else np.empty(0))],
                names=["doc_id", "level", "years", "certainty"],
            )

    return spread(texts).mapInArrow(run, f"doc_id {kind}, level int, years double, certainty double")
