"""Toxicity by a subsequence string kernel with Nystrom landmarks and a linear machine.

Words, with marks at both ends, are compared by their common subsequences of
three characters within a span of five, a gap costing DECAY per skipped
character; so insults with inserted or left-out characters and inflected stems
stay alike. LANDMARKS words, witnesses of toxic documents and common or easily
mistaken words of clean ones, span the Nystrom space. The machine is trained on
words in place of sentences: a toxic document is a bag of words, whose witnesses
are those that stand in several toxic documents and ABOVE times as often as in
clean ones (found anew in ROUNDS rounds); other words of clean documents that
look most toxic are added as hard negatives. A document's score is a logistic
curve of the mean of its two highest word margins; THRESHOLD lies where it best
parts clean and toxic documents of a quarter of the sample that the machine never saw.

The machine's weights are folded into one value per hashed subsequence, so whole
texts are scored at a lookup per word. Runs of single characters parted by
blanks count as one word; words over LONG characters are read in windows.

Defined cases: null and empty texts have the score of a text without suspect
words; without both classes in the training fold all scores are 0; a repeated
label row counts once, an id labelled both ways as toxic; repeated documents are
scored alike; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import fold, ship, trimmed
from feedlake.llm.linear import fit, squash
from feedlake.llm.shingles import STEP, mixed

#: Most labelled documents, about, that are sampled for training, by label.
SAMPLE = {1: 1500, 0: 6000}
LANDMARKS, ROUNDS, DECAY, THRESHOLD = 512, 3, 0.6, 0.7
BITS = 15
LONG, WINDOW = 24, 16
#: Words whose margins a task keeps.
KEPT = 100_000
#: Share and least number of the toxic texts that have a word which starts as a witness; by what its share of the toxic texts
#: exceeds that of the clean ones, some of which quote it or have a wrong label.
SURE, FEW, ABOVE = 0.015, 3, 20
#: Places of the further characters of a subsequence: three or four within a span of five.
GAPS = [p for n in (2, 3) for p in combinations(range(1, 5), n)]
EDGES = " \t\n\r\v\f.,;:!?\"'()[]{}<>|*#$%&@/\\-_=+~`^"
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S)+(?!\S)")


def tokens(text: str | None) -> list[str]:
    return SPACED.sub(lambda m: re.sub(r"[ \t]", "", m[0]), (text or "").lower()).split()


def pieces(word: str) -> list[str]:
    """The word without marks at its ends, between boundary signs; a long one in windows; with other signs inside also its letters alone."""
    w = word.strip(EDGES)
    whole = [w] if w.isalpha() or not w else [w, "".join(filter(str.isalpha, w))]
    return [f"^{x[i:i + WINDOW] if len(x) > LONG else x}$" for x in whole for i in range(0, len(x) if len(x) > LONG else 1, WINDOW // 2)]


def subsequences(words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each gap pattern the hashed subsequences, their words and weights; and each word's norm."""
    size = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    ids, owners, weights, square = [], [], [], np.zeros(len(words))
    for places in GAPS:
        k = places[-1]
        if len(code) <= k:
            continue
        own = np.flatnonzero(owner[:-k] == owner[k:])
        h = code[own]
        for j in places:
            h = h * STEP + code[own + j]
        ids.append((mixed(h) >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(owner[own])
        weights.append(np.full(len(own), DECAY ** (k - len(places)), np.float32))
        square += np.bincount(owners[-1], minlength=len(words)) * DECAY ** (2 * (k - len(places)))
    return ids, owners, weights, np.sqrt(np.maximum(square, 1e-9))


def sums(table: np.ndarray, words: list[str]) -> np.ndarray:
    """For each word the normed sum of the table's values (or rows) of its subsequences."""
    out = []
    step = 10_000 if table.ndim == 1 else 500
    for c in range(0, len(words), step):
        part = words[c:c + step]
        with np.errstate(over="ignore"):
            ids, owners, weights, norm = subsequences(part)
        total = np.zeros((len(part), *table.shape[1:]), np.float64 if table.ndim == 1 else np.float32)
        for i, o, w in zip(ids, owners, weights):
            if table.ndim == 1:
                total += np.bincount(o, table[i] * w, minlength=len(part))
            elif len(o):
                first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
                total[o[first]] += np.add.reduceat(table[i] * w[:, None], first, axis=0)
        out.append(total / (norm if table.ndim == 1 else norm[:, None].astype(np.float32)))
    return np.concatenate(out) if out else np.zeros((0, *table.shape[1:]), np.float32)


def landmark_table(words: list[str]) -> np.ndarray:
    table = np.zeros((1 << BITS, len(words)), np.float32)
    with np.errstate(over="ignore"):
        ids, owners, weights, norm = subsequences(words)
    for i, o, w in zip(ids, owners, weights):
        np.add.at(table, (i, o), w / norm[o])
    return table


def cut(clean: np.ndarray, toxic: np.ndarray) -> float:
    """The value that parts the two with the least sum of error rates, a clean one counting double; amid its range."""
    at = np.unique(np.concatenate([clean, toxic]))
    between = np.concatenate([[at[0] - 0.1], (at[1:] + at[:-1]) / 2, [at[-1] + 0.1]])
    wrong = (2 * (1 - np.searchsorted(np.sort(clean), between) / max(1, len(clean)))
             + np.searchsorted(np.sort(toxic), between) / max(1, len(toxic)))
    return float(np.mean(between[wrong <= wrong.min() + 1e-12][[0, -1]]))


class Model:
    """``values``: one per hashed subsequence; ``bias``; ``steep`` and ``middle`` of the logistic curve."""

    def __init__(self, sample: pa.Table):
        """``sample``: a text a row, as ``_instances`` gives them."""
        toxic, apart = sample.column("toxic").to_numpy(), sample.column("apart").to_numpy().copy()
        if set(toxic[~apart]) != {0, 1} or set(toxic[apart]) != {0, 1}:
            apart[:] = False
        cut_on = apart if apart.any() else ~apart
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        met = set()
        for own, key, y, c in zip(sample.column("pieces"), sample.column("words").to_pylist(), toxic.tolist(), apart):
            if key is not None and not c and key not in met:  # copies of a text count once
                met.add(key)
                seen[y].update(set(own.as_py()))
        n1, n0 = (toxic[~apart] == 1).sum(), (toxic[~apart] == 0).sum()
        telling = sorted(seen[1], key=lambda w: (-(seen[1][w] / n1 - 2 * seen[0][w] / n0) * (1 + (seen[0][w] == 0)), w))
        only = [w for w in telling if seen[1][w] >= max(2, SURE / 3 * n1) and seen[1][w] / n1 >= ABOVE * seen[0][w] / n0]
        clean = sorted(seen[0].keys() - set(only), key=lambda w: (-seen[0][w], w))
        against = clean[:1000] + clean[1000::max(1, len(clean) // 3000)]
        witnesses = [w for w in only if seen[1][w] >= max(FEW, SURE * n1)] or only[:10] or telling[:1]
        hard: list[str] = []
        for _ in range(ROUNDS):
            marks = list(dict.fromkeys([*witnesses[:LANDMARKS // 2], *hard[:LANDMARKS // 4], *clean]))[:LANDMARKS]
            table = landmark_table(marks)
            value, vector = np.linalg.eigh(sums(table, marks))
            root = vector[:, value > 1e-4] / np.sqrt(value[value > 1e-4])
            names = witnesses + against
            weight = np.array([seen[1][v] for v in witnesses] + [1 + np.log(seen[0][v]) for v in against])
            w, self.bias = fit(sums(table, names) @ root, np.where(np.arange(len(names)) < len(witnesses), 1, -1), penalty=1e-4, weight=weight)
            self.values = (table @ (root @ w)).astype(np.float32)
            hard = [clean[i] for i in np.argsort(-self.margins(clean), kind="stable")[:1500]]
            against = list(dict.fromkeys(against + hard))
            witnesses = list(dict.fromkeys(witnesses + [v for v, m in zip(only, self.margins(only)) if m > 0.5]))
        top = np.array([self.top(self.margins(own.as_py())) for own, c in zip(sample.column("pieces"), cut_on) if c])
        y = toxic[cut_on]
        self.steep, self.middle = 4.0, cut(top[y == 0], top[y == 1]) - np.log(THRESHOLD / (1 - THRESHOLD)) / 4

    def margins(self, words: list[str]) -> np.ndarray:
        return sums(self.values, words) + self.bias

    @staticmethod
    def top(margins: list[float]) -> float:
        """The mean of the two highest margins, each within -1.5 and 1.5."""
        best = np.partition(np.asarray(margins), -2)[-2:].tolist() if len(margins) > 2 else list(margins)
        return float(np.mean(np.clip([-1.5] * (2 - len(best)) + best, -1.5, 1.5)))

    def score(self, top: float) -> float:
        return float(squash(self.steep * (top - self.middle)))


def _instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text of the sample: whether it is set apart for the threshold, a digest of its words (null without any) and its
    pieces, each twice at most (a score looks at the two highest), which is all that the driver gets of it."""
    for b in trimmed(batches):
        apart, digest, own = [], [], []
        for text in b.column("text"):
            x = text.as_py()
            words = tokens(x)
            apart.append(zlib.crc32(str(x).encode("utf-8", "surrogatepass")) % 4 == 3)
            digest.append(hashlib.blake2b("\n".join(sorted(set(words))).encode("utf-8", "surrogatepass"), digest_size=16).digest() if words else None)
            own.append([p for p, n in Counter(p for w in words for p in pieces(w)).items() for _ in range(min(n, 2))])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(apart, pa.bool_()), pa.array(digest, pa.binary()),
                                          pa.array(own, pa.list_(pa.string()))], names=["doc_id", "toxic", "apart", "words", "pieces"])


def train(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> Model | None:
    """Fits on a bounded sample of the labelled rows outside the held-out fold, chosen by a hash of the id."""
    marked = labels.where((fold() != 1) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}
    if set(counts) != {0, 1}:
        return None
    u = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, F.lit(sample[1] / counts[1])).otherwise(F.lit(sample[0] / counts[0]))
    chosen = marked.where(u < share)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    rows = texts.mapInArrow(_instances, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, toxic int, apart boolean, words binary, pieces array<string>")
    rows = rows.orderBy("doc_id", "words").drop("doc_id").toArrow()
    return Model(rows) if set(rows.column("toxic").to_pylist()) == {0, 1} else None


def scorer(model: Model | None):
    """Scores of a batch of texts; margins of words are kept from batch to batch."""
    known: dict[str, float] = {}

    def run(column: pa.Array) -> list[float]:
        if model is None:
            return [0.0] * len(column)
        scores = []
        for text in column:
            own = tokens(text.as_py())
            if new := [w for w in set(own) if w not in known]:
                if len(known) + len(new) > KEPT:
                    known.clear()
                    new = list(set(own))
                parts = [pieces(w) for w in new]
                flat = model.margins([p for x in parts for p in x])
                known.update(zip(new, np.maximum.reduceat(flat, np.cumsum([0, *(len(x) for x in parts[:-1])])).tolist()))
            scores.append(model.score(model.top([known[w] for w in own])))
        return scores
    return run


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for b in trimmed(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score(b.column("text")), pa.float64())],
                                             names=["doc_id", "held_out", "score"])
    return run


def toxicity(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), (fold(doc_id) == 1).alias("held_out"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return (rows.mapInArrow(_score(model), f"doc_id {kind}, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def clean(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns; they are judged where they lie."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for b in trimmed(batches):
            yield b.filter(pa.array(s < THRESHOLD for s in score(b.column(text))))
    return docs.mapInArrow(run, docs.schema)


ship(__name__)
