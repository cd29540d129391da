"""Quality by compression: how much better a text compresses with a dictionary of good text than of bad.

Two zstandard dictionaries are trained on labelled text.  A text is cut into blocks, so that the
dictionaries and not the text itself explain each block; all blocks of the whole text are compressed
with both.  The difference of the sizes over their sum, together with the compressed share, becomes a
probability by a logistic curve fitted on labelled texts that the dictionaries have not seen.

The fit uses at most ``SAMPLE`` labelled rows, those with the smallest hash of their id.  Dictionaries are trained on at most
``BLOCKS`` blocks of each kind, those with the smallest hash among ``TAKEN`` evenly spaced ones of each text (24 MB reach the driver).
The curve is fitted on whole texts, whose two numbers are computed in the tasks.  Scoring is one pass without shuffle.

Defined cases: a NULL text is empty; an empty text has the difference 0 and the share 1; without labelled texts of both
kinds every score is 1 (nothing is known against any text); where the difference does not speak for good text, the score is the share
of good texts; repeated rows and NULL ids are kept; an empty table
gives no rows; columns other than ``text`` are carried along, one named ``score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.shared import bounded_batches, extended, fold, labelled_sample, slices, strings

BLOCK = 4096
LEVEL = 3
DICTIONARY = 112_640
SAMPLE = 8_000
TAKEN = 4
BLOCKS = 3_000
#: One labelled row of so many fits the curve and is kept from the dictionaries.
CALIBRATION = 3


@dataclass(frozen=True)
class Model:
    """Dictionaries of good and bad text, and the curve; None without labels of both kinds."""

    good: bytes
    bad: bytes
    weights: np.ndarray
    intercept: float


def _blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


class _Sizes:
    """Compressed sizes with either dictionary."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        import zstandard

        self.compress = []
        for content in (good, bad):
            dictionary = zstandard.ZstdCompressionDict(content)
            dictionary.precompute_compress(level=LEVEL)
            self.compress.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False
                ).compress
            )

    def features(self, text: bytes) -> tuple[float, float]:
        """The normalised difference (-1 to 1, higher if the good dictionary serves better), and the
        compressed share of the text, which is small where a text repeats itself."""
        blocks = _blocks(text)
        good, bad = (sum(len(compress(b)) for b in blocks) for compress in self.compress)
        return ((bad - good) / (bad + good), (bad + good) / (2 * len(text))) if blocks else (0.0, 1.0)


#: Penalty of the standardised weights, which keeps them finite where the kinds are separable.
RIDGE = 1e-2


def curve(x: np.ndarray, y: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Weights and intercept of the logistic curve of the greatest penalised likelihood.

    Newton steps on standardised features, halved until the likelihood rises enough; the function is convex, so this ends
    at its only optimum.  Anything else is an error, never a result.
    """
    x = x.reshape(len(y), -1)
    centre, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1.0
    design = np.hstack([(x - centre) / scale, np.ones((len(y), 1))])
    ridge = np.array([RIDGE] * x.shape[1] + [1e-6])
    sign = 2.0 * y - 1

    def loss(at: np.ndarray) -> float:
        return float(np.logaddexp(0, -sign * (design @ at)).sum() + (ridge * at * at).sum() / 2)

    beta = np.zeros(design.shape[1])
    value = loss(beta)
    for _ in range(rounds):
        p = 0.5 * (1 + np.tanh(design @ beta / 2))
        gradient = design.T @ (p - y) + ridge * beta
        if np.abs(gradient).max() <= 1e-7 * max(1.0, len(y) / 100):
            return beta[:-1] / scale, float(beta[-1] - (beta[:-1] / scale) @ centre)
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge), gradient)
        share, slope = 1.0, float(gradient @ step)
        while (lower := loss(beta - share * step)) > value - 1e-4 * share * slope and share > 1e-12:
            share /= 2
        if share <= 1e-12:
            # No step lowers the loss any more in double precision.
            if np.abs(gradient).max() <= 1e-4 * max(1.0, len(y) / 100):
                return beta[:-1] / scale, float(beta[-1] - (beta[:-1] / scale) @ centre)
            break
        beta, value = beta - share * step, lower
    raise ArithmeticError("the calibration curve did not converge")


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """The curve over all features, or over the first alone, or level: the first feature must speak for ``y``."""
    weights, intercept = curve(x, y)
    if weights[0] > 0:
        return weights, intercept
    alone, intercept = curve(x[:, :1], y)
    if alone[0] > 0:
        return np.append(alone, np.zeros(x.shape[1] - 1)), intercept
    good = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    return np.zeros(x.shape[1]), float(np.log(good / (1 - good)))


def fit(
    docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE, label: str = "quality", blocks: int = BLOCKS
) -> Model | None:
    """Dictionaries and curve from at most ``sample`` rows of ``labels`` for which ``train`` holds.

    Dictionaries are trained on at most ``blocks`` blocks of either kind.
    """
    import zstandard

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, kind in zip(batch.column(0), strings(batch.column(1)), batch.column(2), strict=True):
                own = _blocks(text.as_py().encode())
                at = sorted({k * len(own) // TAKEN for k in range(TAKEN)}) if own else []
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc_id.as_py()] * len(at), pa.int64()),
                        pa.array(at, pa.int32()),
                        pa.array([kind.as_py()] * len(at), pa.int32()),
                        pa.array([own[i] for i in at], pa.binary()),
                    ],
                    names=["doc_id", "at", "label", "block"],
                )

    texts = labelled_sample(docs, labels, label, train, sample).select(F.col("doc_id").cast("long"), "text", "label")
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATION)) == 0
    cuts = texts.where(~calibrates).mapInArrow(cut, "doc_id bigint, at int, label int, block binary")
    order = ("order", "doc_id", "at", "block")
    ranked = cuts.withColumn("order", F.xxhash64("doc_id", "at"))
    taken = [ranked.where(F.col("label") == y).orderBy(*order).limit(blocks).toArrow().sort_by([(c, "ascending") for c in order]) for y in (0, 1)]
    content = []
    for table in taken:
        flat = table["block"].to_pylist()
        if not flat:
            return None
        try:
            content.append(zstandard.train_dictionary(DICTIONARY, flat).as_bytes())
        except zstandard.ZstdError:
            # Too little text to train on: the text itself is the dictionary.
            content.append(b"".join(flat)[-DICTIONARY:])
    bad, good = content

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _Sizes(good, bad)
        for batch in batches:
            own = np.array([sizes.features(t.as_py().encode()) for t in strings(batch.column(0))]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(own[:, 0]), pa.array(own[:, 1])], names=["doc_id", "label", "a", "b"]
            )

    # Empty texts say nothing about the curve.
    some = texts.where(calibrates & (F.col("text") != "")).select("text", "doc_id", "label")
    seen = some.mapInArrow(measure, "doc_id bigint, label int, a double, b double").toArrow()
    seen = seen.sort_by([(c, "ascending") for c in ("doc_id", "label", "a", "b")])
    y = seen["label"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None
    weights, intercept = calibrated(np.column_stack([seen["a"].to_numpy(), seen["b"].to_numpy()]), y)
    return Model(good, bad, weights, intercept)


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` plus ``score``, the probability that the text is good."""
    if model is None:
        return docs.withColumn("score", F.lit(1.0))
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sizes = _Sizes(own.good, own.bad)
        for batch in batches:
            texts = strings(batch.column(batch.schema.get_field_index("text")))
            for at, many in slices(texts):
                x = np.array([sizes.features(t.encode()) for t in texts.slice(at, many).to_pylist()])
                score = 1 / (1 + np.exp(-np.clip(x @ own.weights + own.intercept, -700, 700)))
                part = batch.slice(at, many)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, "score"])

    return docs.mapInArrow(run, extended(docs, score="double"))


def quality(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> DataFrame:
    """``docs`` plus ``score``; by default rows with ``crc32(doc_id) mod 5 = 0`` are not learned from."""
    bounded_batches(docs.sparkSession)
    return scored(docs, fit(docs, labels, fold("doc_id", 5) != 0 if train is None else train))
