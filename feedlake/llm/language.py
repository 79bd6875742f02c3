"""Language identification in two levels of linear support vector machines.

Texts are vectors of relative frequencies of one, two and three byte runs
(lower-cased, hashed). One-versus-one machines first decide the family, then
those of the family's languages decide within it. The machines learn from a
sample of SAMPLE rows, spread over the languages and chosen by a hash of the id;
rows of the held-out fold and rows without a language are never in it. Scoring
is one lookup and one sum per byte run, so every text is read whole.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
without any training row all are; with one language all others get it, score 1;
repeated rows are scored alike; further columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import fold, ship
from feedlake.llm.linear import fit, squash
from feedlake.llm.shingles import chunks, utf8

#: Rows of the training sample, about; they are divided evenly among the languages.
SAMPLE = 2000
#: Columns for runs of one, two and three bytes.
WIDTHS = (256, 1024, 2816)
# Families of ISO 639-1 codes; any other code is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nb nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "semitic": "am ar he mt",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.lower()[:2], lang)


def runs(data: np.ndarray) -> list[np.ndarray]:
    """For each place the columns of the runs that end there; the first places take a zero byte before them."""
    d = data.astype(np.uint32)
    one = np.concatenate([np.zeros(1, np.uint32), d[:-1]])
    two = np.concatenate([np.zeros(min(2, len(d)), np.uint32), d[:-2]])
    pair = (d << np.uint32(8)) | one
    spread = lambda v, m, width: ((v * np.uint32(m)) >> np.uint32(8)) % np.uint32(width)
    return [d, WIDTHS[0] + spread(pair, 2654435761, WIDTHS[1]),
            WIDTHS[0] + WIDTHS[1] + spread((two << np.uint32(16)) | pair, 2246822519, WIDTHS[2])]


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, at = utf8(lowered(b.column("text")))
        out = []
        for i, j in zip(at[:-1], at[1:]):
            v = np.zeros(sum(WIDTHS), np.float32)
            for r in runs(data[i:j]):
                v += np.bincount(r, minlength=len(v))
            out.append((v / max(1, j - i)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(out, pa.binary())], names=["lang", "v"])


class Model:
    """Duels of families and of each family's languages: columns of one weight matrix."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        self.families = defaultdict(list)
        for lang in sorted(langs):
            self.families[family_of(lang)].append(lang)
        level = np.array([family_of(lang) for lang in y])
        self.duels, weights, bias = [], [], []
        for of, names in [(level, sorted(self.families)), *((y, v) for v in self.families.values())]:
            for a, b in combinations(names, 2):
                own = (of == a) | (of == b)
                w, c = fit(x[own], np.where(of[own] == a, 1, -1))
                self.duels.append((a, b))
                weights.append(w)
                bias.append(c)
        self.weights = np.array(weights, np.float32).reshape(len(weights), x.shape[1]).T.copy()
        self.bias = np.array(bias)

    def margins(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at) - 1, len(self.duels)))
        full = np.flatnonzero(at[1:] > at[:-1])
        if len(full) and len(self.duels):
            one = np.zeros(len(data), np.float64)
            sites = runs(data)
            for c in range(len(self.duels)):
                w = self.weights[:, c]
                one = w[sites[0]] + w[sites[1]] + w[sites[2]]
                out[full, c] = np.add.reduceat(one, at[:-1][full], dtype=np.float64) / (at[1:] - at[:-1])[full]
        return out + self.bias

    def winner(self, names: list[str], m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the name that wins most duels, ties to the larger sum of margins, and its least certainty."""
        votes, total, least = (np.zeros((len(m), len(names))) for _ in range(3))
        least += 1
        for a, b in combinations(names, 2):
            c = m[:, self.duels.index((a, b))]
            for name, side in ((a, c), (b, -c)):
                i = names.index(name)
                votes[:, i] += side > 0
                total[:, i] += np.tanh(side)
                least[:, i] = np.minimum(least[:, i], squash(3 * side))
        best = np.argmax(votes + total / (4 * len(names)), axis=1)
        return best, least[np.arange(len(m)), best]

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
        m, names = self.margins(data, at), sorted(self.families)
        family, sure = self.winner(names, m)
        lang = np.empty(len(m), dtype=object)
        for i, name in enumerate(names):
            rows = np.flatnonzero(family == i)
            if len(rows):
                best, own = self.winner(self.families[name], m[rows])
                lang[rows] = np.array(self.families[name], dtype=object)[best]
                sure[rows] *= own
        return lang.tolist(), sure


def train(docs: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    known = docs.where((fold(doc_id) != 1) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    if not counts:
        return None
    share = F.create_map(*(F.lit(v) for name, n in counts.items() for v in (name, min(1.0, sample / len(counts) / n))))
    u = F.pmod(F.xxhash64(F.col(doc_id), F.lit(8)), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(u < F.element_at(share, F.col(lang))).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = chosen.mapInArrow(_vectors, "lang string, v binary").toArrow()
    y = np.array(rows.column("lang").to_pylist(), dtype=object)
    x = np.frombuffer(b"".join(rows.column("v").to_pylist()), np.float32).reshape(len(y), sum(WIDTHS))
    return Model(sorted(set(y)), x, y)


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = ["und"] * len(b), np.zeros(len(b))
            if model is not None:
                data, at = utf8(lowered(b.column("text")))
                langs, scores = [], []
                for i, j in chunks(at):
                    got, sure = model.predict(data[at[i]:at[j]], at[i:j + 1] - at[i])
                    langs += got
                    scores.append(sure)
                scores = np.concatenate(scores) if scores else np.zeros(0)
            own = b.column("letters").to_pylist()
            langs = [x if ok else "und" for x, ok in zip(langs, own)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()),
                                              pa.array(np.where(own, scores, 0.0), pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
    return run


def language(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), (fold(doc_id) == 1).alias("held_out"),
                       F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


ship("feedlake.llm.linear")
ship(__name__)
