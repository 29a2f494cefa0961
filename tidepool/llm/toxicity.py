"""Toxicity by maximum-scoring segments (operator 3).

Training, on labelled rows of the training folds only:

* A word's evidence is the log-odds of the longest of its prefixes (the word
  itself first) that the lexicon has. Log-odds are smoothed by a Dirichlet prior:
  the prior of a form is its next shorter prefix, and of the shortest the share
  of toxic documents, with ``PRIOR`` pseudo-documents. Forms in under
  ``LEAST_DOCS`` documents are left to their prefixes.
* The drift, subtracted from every word, makes the expected score negative, as
  the theory of segment scores needs.
* Karlin-Altschul: lambda solves sum p(s) exp(lambda s) = 1 over the scores of
  words of clean documents; K is fitted so that the best segments of clean
  documents have the extreme-value distribution that follows.
* Drift, lambda, K and the curve are set on a fifth of the rows under a lexicon
  of the others; the lexicon that scores is then made of all of them. If the fifth
  or the others lack one of the labels, all rows serve for both.

Scoring, in one pass: all maximal scoring segments of a text in linear time;
every segment gets the chance 1 - exp(-K n exp(-lambda S)) of one as good in a
clean text of its length; a logistic curve over the aggregated evidence of the
significant ones gives the score. Words and prefixes are hashed and looked up
many texts at a time; runs of words of one sign go into the scan as one item,
which leaves its segments as they are, since a maximal segment begins and ends
with a whole run.

The lexicon comes from ``TRAINING_ROWS`` labelled rows at most (lowest hash of
id) and has every form whose log-odds differ from its prefix's; as sorted 64-bit
names and values it takes 16 bytes a form. Everything else covers all rows.

Edge cases: null and empty texts score like a text without evidence; texts of any
length are scored whole; equal texts have equal scores, and each repeated row
its own row; conflicting labels of one id all count; rows without an id are held
out or not by the checksum of the empty text; no usable label at all gives every
row the score 0; an empty table gives an empty result. Language, source and id
are never read by the score. Other columns are not read; ``without_toxic`` passes
them on, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, text_of, written
from .token_counts import groups_by_size

FOLDS = 5
TRAINING_ROWS = 30_000
GROUP_CHARS = 400_000
LEAST_DOCS, LEAST_PREFIX, PRIOR = 4, 3, 4.0
LEAST_SHARE = 0.002
SIGNIFICANT = 0.05
LEAST_DRIFT = 0.6
WORDS = re.compile(r"\w+")
#: Sets the name of a whole word apart from that of the prefix with the same letters.
WHOLE = 0x2545F4914F6CDD1D


def fold(column: Column) -> Column:
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % FOLDS


class Model:
    """The lexicon and the calibration; small, and the same for every task."""

    def __init__(self) -> None:
        import numpy as np

        self.names, self.values = np.empty(0, np.uint64), np.empty(0)
        #: Lengths of the prefixes that the lexicon has, the longest first.
        self.lengths: list[int] = []
        self.drift, self.lam, self.k = 0.0, 1.0, 0.1
        self.curve = (-30.0, 0.0, 0.0, 0.0)

    def log_odds(self, names):
        """Of each name, not a number where the lexicon has none."""
        import numpy as np

        if not len(self.names):
            return np.full(len(names), np.nan)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, self.values[at], np.nan)

    def _evidence(self, spelled, begin, length):
        import numpy as np

        found = self.log_odds(whole(spelled.name(begin, length)))
        for n in self.lengths:
            todo = np.flatnonzero(np.isnan(found) & (length >= n))
            if len(todo):
                found[todo] = self.log_odds(spelled.name(begin[todo], np.full(len(todo), n)))
        return np.nan_to_num(found) - self.drift

    def evidence(self, word: str) -> float:
        import numpy as np

        from .shingles import Spelled

        return float(self._evidence(Spelled([word]), np.array([0]), np.array([len(word.lower())]))[0])

    def scores(self, texts: list[str]):
        """Evidence of every word, and the offsets of each text's; the k-th time a word comes in a text, what speaks for it counts 1/k."""
        import numpy as np

        from .shingles import Spelled

        spelled = Spelled(texts)
        length = spelled.stop - spelled.begin
        _, first, which = np.unique(spelled.name(spelled.begin, length), return_index=True, return_inverse=True)
        x = self._evidence(spelled, spelled.begin[first], length[first])[which]
        for_it = np.flatnonzero(x > 0)
        text = np.searchsorted(spelled.at, for_it, side="right")
        order = np.lexsort((which[for_it], text))  # stable: in order of place within text and word
        for_it, text = for_it[order], text[order]
        new = np.ones(len(for_it), bool)
        new[1:] = (text[1:] != text[:-1]) | (which[for_it[1:]] != which[for_it[:-1]])
        starts = np.flatnonzero(new)
        times = np.arange(1, len(for_it) + 1) - np.repeat(starts, np.diff(np.append(starts, len(for_it))))
        x[for_it] = (x[for_it] + self.drift) / times - self.drift
        return x, spelled.at

    def significance(self, best, n):
        """-log of the chances of segments this good in clean texts of n words."""
        import numpy as np

        expected = self.k * np.maximum(n, 1) * np.exp(-np.minimum(700.0, self.lam * np.asarray(best)))
        return -np.log(np.maximum(-np.expm1(-expected), 1e-300))

    def segments(self, texts: list[str]):
        """(text, score) of all maximal segments, and the number of words of each text."""
        import numpy as np

        x, at = self.scores(texts)
        n = np.diff(at)
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] > 0) != (x[:-1] > 0)
        new[at[:-1][n > 0]] = True
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(x, starts) if len(x) else x
        bounds = np.searchsorted(starts, at)
        owner, score = [], []
        for i in np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(sums > 0)))[bounds])).tolist():  # texts with a run above 0
            found = [s for _, _, s in maximal_segments(sums[bounds[i] : bounds[i + 1]].tolist())]
            owner += [i] * len(found)
            score += found
        return np.array(owner, np.int64), np.array(score, float), n

    def summaries(self, texts: list[str]):
        """Of each text the evidence of its best segment, that of all significant ones together, and their number."""
        import numpy as np

        owner, score, n = self.segments(texts)
        each = self.significance(score, n[owner])
        best = np.zeros(len(texts))
        np.maximum.at(best, owner, each)
        strong = each > -math.log(SIGNIFICANT)
        total = np.bincount(owner[strong], weights=each[strong], minlength=len(texts)).astype(float)
        return best, total, np.bincount(owner[strong], minlength=len(texts))

    def passages(self, text: str) -> list[tuple[int, int, float]]:
        """Significant passages as code-point spans with their evidence."""
        lowered = text.lower()
        # a character whose lower case is longer: offsets by words of the text itself
        spans = [m.span() for m in WORDS.finditer(lowered if len(lowered) == len(text) else text)]
        x, _ = self.scores([text])
        found = ((a, b, float(self.significance(s, len(x)))) for a, b, s in maximal_segments(x.tolist()))
        return [(spans[a][0], spans[min(b, len(spans)) - 1][1], e) for a, b, e in found if e > -math.log(SIGNIFICANT) and a < len(spans)]

    def score(self, texts: list[str]):
        """Scores from 0 to 1."""
        import numpy as np

        out = [np.empty(0)]
        for a, b in groups_by_size(texts, GROUP_CHARS):
            at = sum(w * x for w, x in zip(self.curve, aggregate(*self.summaries(texts[a:b])), strict=True))
            out.append(1 / (1 + np.exp(-np.clip(at, -30.0, 30.0))))
        return np.concatenate(out)


def whole(names):
    """The names of whole words, from those of their letters."""
    import numpy as np

    from .shingles import mix

    return mix(names ^ np.uint64(WHOLE))


def aggregate(best, total, n) -> tuple:
    """What the curve reads of texts' evidence: that of the best segment, of all significant ones, their number."""
    import numpy as np

    return np.ones(len(best)), np.log1p(best), np.log1p(total), np.log1p(n)


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score), in order, in linear time.

    ``found`` holds candidates with the running sum before and at their end;
    ``back`` points from each to the nearest earlier one that starts from a lower
    sum. A positive item takes in that candidate as long as it thereby ends
    higher than the candidate did.
    """
    found: list[tuple[int, int, float, float]] = []
    back: list[int] = []
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        start, before = i, total
        total += s
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = back[j]
            if j < 0 or found[j][3] >= total:
                break
            start, before = found[j][0], found[j][2]
            del found[j:], back[j:]
            j -= 1
        found.append((start, i + 1, before, total))
        back.append(j)
    return [(a, b, high - low) for a, b, low, high in found]


def training_rows(docs: DataFrame, labels: DataFrame, most: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(text, toxic, part) of at most ``most`` labelled ids outside the held-out fold."""
    usable = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0))
    chosen = usable.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id", F.lit(3)).alias("h")).orderBy("h", "toxic").limit(most)
    rows = docs.select(F.col(id_column).alias("d"), text_of(text_column).alias("text"))
    met = rows.join(F.broadcast(chosen), F.col("d") == F.col("id"))  # at most ``most`` rows of three numbers
    return met.select("text", "toxic", F.pmod(F.xxhash64("id", F.lit(4)), F.lit(FOLDS)).alias("part"))


def _count_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forms by name, in how many documents, and in how many toxic ones, each has been seen: those of part 0 apart.

    Level and parent belong to the form: its next shorter prefix, and a number above that of all its prefixes.
    """
    import numpy as np

    from .shingles import Spelled

    for batch in batches:
        every, toxic, part = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for a, b in groups_by_size(every, GROUP_CHARS // 4):
            spelled = Spelled(every[a:b])
            length, text = spelled.stop - spelled.begin, np.repeat(np.arange(b - a), np.diff(spelled.at))
            first = _distinct(text, spelled.name(spelled.begin, length))
            begin, length, text = spelled.begin[first], length[first], text[first]
            times = np.maximum(length - LEAST_PREFIX + 1, 0)
            of = np.repeat(np.arange(len(begin)), times)
            size = LEAST_PREFIX + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
            letters = spelled.name(begin, length)
            form = np.concatenate([spelled.name(begin[of], size), whole(letters)])
            parent = np.concatenate([spelled.name(begin[of], size - 1), letters])
            level, text = np.concatenate([2 * size, 2 * length + 1]), np.concatenate([text[of], text])
            keep = _distinct(text, form)
            names, at, which = np.unique(form[keep], return_index=True, return_inverse=True)
            text = text[keep] + a
            count = lambda w: pa.array(np.bincount(which, weights=w, minlength=len(names)).astype(np.int64))  # noqa: B023, E731
            apart, bad = part[text] == 0, toxic[text] != 0
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(parent[keep][at].view(np.int64)), pa.array(level[keep][at], pa.int32()), count(~apart), count(~apart & bad), count(apart), count(apart & bad)], names=FORM_COLUMNS)


FORM_COLUMNS = ["form", "parent", "level", "n", "bad", "n0", "bad0"]


def _distinct(text, name):
    """Places of one of each (text, name)."""
    import numpy as np

    order = np.lexsort((name, text))
    new = np.ones(len(order), bool)
    new[1:] = (text[order[1:]] != text[order[:-1]]) | (name[order[1:]] != name[order[:-1]])
    return order[new]


def build_lexicon(form, parent, level, n, bad, docs: int, toxic: int):
    """Arrays in order of form. Names, log-odds over the base rate, and levels of the forms that tell more than their parent, each shrunk to its parent's share."""
    import numpy as np

    base = min(max(toxic / max(docs, 1), 1e-6), 1 - 1e-6)
    logit = lambda p: np.log(p / (1 - p))
    if not len(form):
        return form, np.empty(0), level
    at = np.minimum(np.searchsorted(form, parent), len(form) - 1)
    known = form[at] == parent
    prior, share = np.full(len(form), base), np.full(len(form), base)
    by_level = np.argsort(level, kind="stable")
    for pick in np.split(by_level, np.flatnonzero(np.diff(level[by_level])) + 1):
        prior[pick] = np.where(known[pick], share[at[pick]], base)
        share[pick] = np.clip((bad[pick] + PRIOR * prior[pick]) / (n[pick] + PRIOR), LEAST_SHARE, 1 - LEAST_SHARE)
    tells = np.abs(logit(share) - logit(prior)) > 0.2
    return form[tells], logit(share[tells]) - logit(base), level[tells]


def _word_bins(model: Model):
    """How often words of clean texts have which evidence, in steps of 1/20."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in groups_by_size(texts, GROUP_CHARS):
                bins, n = np.unique(np.rint(model.scores(texts[a:b])[0] * 20).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n)], names=["bin", "n"])

    return run


def _best_segments(model: Model):
    """Of each text its words and the score of its best segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in groups_by_size(texts, GROUP_CHARS):
                owner, score, n = model.segments(texts[a:b])
                best = np.zeros(b - a)
                np.maximum.at(best, owner, score)
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(best)], names=["n", "best"])

    return run


def _evidence(model: Model):
    """Of each text its label and what the curve reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in groups_by_size(texts, GROUP_CHARS):
                best, total, n = model.summaries(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(best, pa.float64()), pa.array(total, pa.float64()), pa.array(n, pa.int64())], names=["toxic", "best", "total", "n"])

    return run


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS, id_column: str = "doc_id", text_column: str = "text") -> Model | None:
    """Learn lexicon, extreme-value parameters and curve; None without both kinds of label."""
    import numpy as np

    rows = written(training_rows(docs, labels, most, id_column, text_column), "toxicity")
    tally = Counter()
    for r in rows.groupBy("part", "toxic").count().collect():
        tally[r.part == 0, r.toxic != 0] += r["count"]
    n_bad = tally[False, True] + tally[True, True]
    n_docs = sum(tally.values())
    if not 0 < n_bad < n_docs:
        return None
    counted = mapped(rows.select("text", "toxic", "part"), _count_forms, "form long, parent long, level int, n long, bad long, n0 long, bad0 long")
    sums = counted.groupBy("form", "parent", "level").agg(*[F.sum(c).cast("int").alias(c) for c in FORM_COLUMNS[3:]]).where(F.col("n") + F.col("n0") >= LEAST_DOCS)
    found = sums.toArrow()  # numbers only: 36 bytes a form
    order = np.argsort(found.column("form").to_numpy().view(np.uint64))
    form, parent, level, n, bad, n0, bad0 = (found.column(c).to_numpy()[order] for c in FORM_COLUMNS)
    form, parent = form.view(np.uint64), parent.view(np.uint64)
    del found, order

    def lexicon(model: Model, keep, n, bad, docs: int, toxic: int) -> Model:
        model.names, model.values, told = build_lexicon(form[keep], parent[keep], level[keep], n[keep], bad[keep], docs, toxic)
        model.lengths = sorted({int(x) // 2 for x in np.unique(told[told % 2 == 0])}, reverse=True)
        return model

    model, apart = Model(), all(tally[k] for k in ((False, False), (False, True), (True, False), (True, True)))
    if apart:
        rest = rows.where("part = 0")
        lexicon(model, n >= LEAST_DOCS, n, bad, tally[False, False] + tally[False, True], tally[False, True])
    else:
        rest = rows
        lexicon(model, slice(None), n + n0, bad + bad0, n_docs, n_bad)
    # what words of clean documents score on average sets the drift
    clean = rest.where("toxic = 0").select("text")
    bins = mapped(clean, _word_bins(model), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    value, mass = np.array([r.bin / 20 for r in bins]), np.array([float(r.n) for r in bins])
    mass /= max(mass.sum(), 1)
    model.drift = float(max(LEAST_DRIFT, (value * mass).sum() + 0.25)) if len(value) else LEAST_DRIFT
    value = value - model.drift
    low, high = 1e-6, 50.0
    for _ in range(200):  # the positive root of sum p exp(lambda s) = 1
        middle = (low + high) / 2
        low, high = (middle, high) if (mass * np.exp(np.minimum(middle * value, 700))).sum() < 1 else (low, middle)
    model.lam = float(low)
    best = mapped(clean, _best_segments(model), "n long, best double").toArrow()  # two numbers of each calibrating row
    x = model.lam * best.column("best").to_numpy() - np.log(np.maximum(best.column("n").to_numpy(), 1))
    model.k = float(1 / np.exp(-x).mean()) if len(x) else 0.1
    model.curve = _curve(mapped(rest.select("text", "toxic"), _evidence(model), "toxic int, best double, total double, n long").toArrow())
    return lexicon(model, slice(None), n + n0, bad + bad0, n_docs, n_bad)


def _curve(rows: pa.Table) -> tuple[float, ...]:
    """Logistic regression, with a slight ridge, of the label on the aggregated evidence."""
    import numpy as np

    x = np.stack(aggregate(*(rows.column(c).to_numpy() for c in ("best", "total", "n"))), axis=1)
    y, w = (rows.column("toxic").to_numpy() != 0).astype(float), np.zeros(4)
    ridge = np.array([1e-3, 1e-1, 1e-1, 1e-1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score_documents(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = fit(docs, labels, most, id_column, text_column)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), (fold(F.col(id_column)) == 0).alias("held_out"), text_of(text_column).alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            scores = m.score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(scores >= 0.5).cast(pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return mapped(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic; all columns stay. A narrow map after training."""
    model = fit(docs, labels, most, id_column, text_column)
    if model is None:
        return docs
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held.value.score([t or "" for t in batch.column(at).to_pylist()]) < 0.5))

    return mapped(docs, run, docs.schema)
