"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. Voters.  A lexicon is mined from a bounded sample of labelled rows: words and beginnings of words
   that toxic texts hold and clean ones do not, chosen so that every toxic text is covered several times.
   Each entry votes "toxic" where it occurs and abstains elsewhere; patterns over the whole text vote
   as well, both ways.  The voters are thus mined from the true labels of the sample, and the score is calibrated on them; in
   between only the votes count.
2. Label model.  Given the share of toxic texts, expectation maximisation estimates how each voter votes on
   either kind.  Voters that agree beyond what the class explains are found from the correlation of
   their votes within a class; such a group shares one voter's weight.
3. Classifier.  A logistic regression on the presence of lexicon entries is trained on the
   posterior labels and calibrated on the sample's labels.

The fit uses at most ``SAMPLE`` labelled rows, those with the smallest hash of their id; what reaches the driver is
one row per lexicon candidate (``CANDIDATES``) and the entries found in each sample row.  Scoring looks
every different word of a slice up once, reads whole texts and needs no shuffle.

Defined cases: a NULL text is empty; an empty text has the score of a text without entries; without toxic labels the lexicon is
empty and every score 0; repeated rows and NULL ids are kept; an empty table gives no rows;
columns other than ``text`` are carried along, one named ``score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.quality import curve
from gaugework.llm.shared import bounded_batches, extended, fold, labelled_sample, slices, strings

SAMPLE = 10_000
CANDIDATES = 4_096
#: Different texts that must hold a candidate, and the log-odds it must have.
SUPPORT, ODDS = 3, 4.0
#: Times the lexicon covers each toxic text, where it can.
COVER = 4
LEXICON = 256
#: Bytes of sample texts whose entries a task holds at a time.
FITTED_BYTES = 1 << 18
BEGINNINGS = (3, 4, 5, 6)


def entries(word: str) -> list[str]:
    """The word itself, and its beginnings marked by a hyphen."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) >= n)]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, list[str]]:
    """Offsets of the words of every text, and the words as indices into different ones."""
    words = pc.split_pattern_regex(pc.utf8_lower(texts), pattern=r"[^\p{L}]+")
    index = words.flatten().dictionary_encode()
    offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
    return offsets, index.indices.to_numpy(zero_copy_only=False), index.dictionary.to_pylist()


def found(texts: pa.Array, lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """``(text, entry)`` of every entry that a text holds, each once, sorted."""
    offsets, at, distinct = words_of(texts)
    hits = [[lexicon[e] for e in entries(w) if e in lexicon] if w else [] for w in distinct]
    n = np.fromiter(map(len, hits), np.int64, len(hits))
    flat = np.fromiter((h for own in hits for h in own), np.int64, int(n.sum()))
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    some = n[at] > 0
    at, text = at[some], text[some]
    lengths = n[at]
    gather = np.repeat((np.cumsum(n) - n)[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    pairs = np.unique(np.repeat(text, lengths) * max(len(lexicon), 1) + flat[gather])
    return pairs // max(len(lexicon), 1), pairs % max(len(lexicon), 1)


def patterns(text: str, n_entries: int) -> list[int]:
    """Votes of the pattern voters: 1 toxic, -1 clean, 0 abstains."""
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    marks = text.count("!")
    return [
        -1 if n_entries == 0 else 0,
        1 if n_entries >= 2 else 0,
        1 if letters >= 20 and upper > 0.7 * letters else 0,
        1 if marks > 3 and marks * 50 > len(text) else 0,
    ]


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, int]
    weights: np.ndarray
    intercept: float


def label_model(votes: np.ndarray, share: float, rounds: int = 50) -> np.ndarray:
    """The posterior of "toxic" of every row of ``votes`` (1, -1, 0), given the share of toxic rows.

    An abstention says nothing, as most entries are missing from most toxic texts, and no voter
    is taken to be worse than chance.
    """
    n, m = votes.shape
    coded = np.stack([votes == v for v in (-1, 1)], 2).astype(float)
    voted = (votes != 0).astype(float)
    # Copies of a voter are one from the start, or they would be taken for the truth.
    group = _correlated(votes, np.full(n, share), strong=0.95)
    spoken = votes @ group / np.maximum(voted @ group, 1)
    posterior = 1 / (1 + np.exp(-np.clip(2.0 * spoken.sum(1), -30, 30)))
    for attempt in range(2):
        for _ in range(rounds):
            # How each voter votes on toxic and clean texts.
            toxic = (np.einsum("n,nmv->mv", posterior, coded) + 0.5) / (posterior.sum() + 1.5)
            clean = (np.einsum("n,nmv->mv", 1 - posterior, coded) + 0.5) / (n - posterior.sum() + 1.5)
            says = np.log(toxic) - np.log(clean)
            says = np.stack([np.minimum(says[:, 0], 0), np.maximum(says[:, 1], 0)], 1)
            # Correlated voters speak as one: the mean of those that vote.
            spoken = np.einsum("nmv,mv->nm", coded, says) @ group / np.maximum(voted @ group, 1)
            updated = 1 / (1 + np.exp(-np.clip(spoken.sum(1) + np.log(share / (1 - share)), -30, 30)))
            moved = np.abs(updated - posterior).max()
            posterior = updated
            if moved < 1e-6:
                break
        if attempt == 0:
            group = _correlated(votes, posterior)
    return posterior


def _correlated(votes: np.ndarray, posterior: np.ndarray, strong: float = 0.5) -> np.ndarray:
    """Voters by group; voters whose votes are correlated within the classes share a group."""
    expected = np.zeros_like(votes, float)
    for p in (posterior, 1 - posterior):
        mean = p @ votes / max(p.sum(), 1e-9)
        expected += p[:, None] * mean
    rest = votes - expected
    cov = rest.T @ rest
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    near = np.abs(cov / np.outer(spread, spread)) > strong
    name = np.arange(len(near))
    while True:  # the smallest voter that links reach
        lower = np.where(near | np.eye(len(near), dtype=bool), name[None, :], len(near)).min(1)
        if (lower == name).all():
            return (name[:, None] == np.unique(name)[None, :]).astype(float)
        name = lower


def _logistic(text: np.ndarray, entry: np.ndarray, n: int, m: int, target: np.ndarray, rounds: int = 400):
    """Weights and intercept for sparse presence features, by gradient steps with momentum."""
    w, b, mw, mb, vw, vb = np.zeros(m), 0.0, np.zeros(m), 0.0, np.zeros(m), 0.0
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(text, w[entry], n) + b, -30, 30)))
        error = (p - target) / n
        gw, gb = np.bincount(entry, error[text], m) + 1e-6 * w, error.sum()
        mw, mb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb
        vw, vb = 0.99 * vw + 0.01 * gw * gw, 0.99 * vb + 0.01 * gb * gb
        c, d = 1 - 0.9**t, 1 - 0.99**t
        w -= 0.1 * (mw / c) / (np.sqrt(vw / d) + 1e-9)
        b -= 0.1 * (mb / c) / (np.sqrt(vb / d) + 1e-9)
    return w, b


def _chosen(
    names: list[str], support: np.ndarray, text: np.ndarray, entry: np.ndarray, toxic: np.ndarray
) -> list[int]:
    """Candidates that cover toxic texts not yet covered ``COVER`` times, most useful first.

    Of equals the longest is taken, as it says most.
    """
    holders = [text[entry == e] for e in range(len(support))]
    holders = [h[toxic[h]] for h in holders]
    covered, chosen = np.zeros(len(toxic), int), []
    left = set(range(len(support)))
    while left and len(chosen) < LEXICON:
        gains = {e: int((covered[holders[e]] < COVER).sum()) for e in left}
        best = max(left, key=lambda e: (gains[e], support[e], len(names[e]), -e))
        if gains[best] < SUPPORT:
            break
        chosen.append(best)
        covered[holders[best]] += 1
        left = {e for e in left if gains[e] >= SUPPORT} - {best}
    return chosen


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE, label: str = "toxic") -> Model:
    """A model from at most ``sample`` rows of ``labels`` for which ``train`` holds."""
    texts = labelled_sample(docs, labels, label, train, sample)
    # Copies of one text say no more than one of them.
    texts = texts.groupBy(F.sha2("text", 256).alias("_key")).agg(
        F.min_by("text", "doc_id").alias("text"), F.max("label").alias("label")
    )

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = strings(batch.column(0))
            # A text's entries are many times its size as Python strings, so few texts have theirs at a time.
            for at, many in slices(whole, FITTED_BYTES):
                own = [
                    sorted({e for w in words if w for e in entries(w)})
                    for words in (
                        pc.split_pattern_regex(pc.utf8_lower(whole.slice(i, 1)), pattern=r"[^\p{L}]+").flatten().unique().to_pylist()
                        for i in range(at, at + many)
                    )
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(at, many), pa.array(own, pa.list_(pa.string()))], names=["label", "entries"]
                )
                pa.default_memory_pool().release_unused()

    rows = texts.select("text", "label")
    total = rows.groupBy("label").count().collect()
    n = {0: 0, 1: 0} | {r["label"]: r["count"] for r in total}
    held = rows.mapInArrow(candidates, "label int, entries array<string>")
    by_entry = held.select("label", F.explode("entries").alias("entry")).groupBy("entry").agg(
        F.sum("label").alias("toxic"), F.count_if(F.col("label") == 0).alias("clean")
    )
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (n[0] + 1.0))
    best = (
        by_entry.where((F.col("toxic") >= SUPPORT) & (odds >= ODDS))
        .orderBy(F.desc("toxic"), F.desc(odds), "entry")
        .limit(CANDIDATES)
        .collect()
    )
    lexicon = {r["entry"]: i for i, r in enumerate(best)}

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = strings(batch.column(0))
            text, entry = found(column, lexicon)
            own = np.split(entry, np.searchsorted(text, np.arange(1, len(column))))
            votes = [patterns(t, len(e)) for t, e in zip(column.to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([e.tolist() for e in own], pa.list_(pa.int32())), pa.array(votes, pa.list_(pa.int32()))],
                names=["label", "entries", "votes"],
            )

    table = rows.mapInArrow(seen, "label int, entries array<int>, votes array<int>").toArrow().to_pydict()
    toxic = np.array(table["label"], int) == 1
    if not toxic.any() or not lexicon:
        return Model({}, np.zeros(0), -700.0)
    text = np.repeat(np.arange(len(toxic)), [len(e) for e in table["entries"]])
    entry = np.array([e for own in table["entries"] for e in own], int)
    chosen = _chosen([r["entry"] for r in best], np.array([r["toxic"] for r in best]), text, entry, toxic)
    number = np.full(len(lexicon), -1)
    number[chosen] = np.arange(len(chosen))
    text, entry = text[number[entry] >= 0], number[entry[number[entry] >= 0]]
    votes = np.zeros((len(toxic), len(chosen)))
    votes[text, entry] = 1
    share = float(np.clip(toxic.mean(), 1e-4, 1 - 1e-4))
    posterior = label_model(np.hstack([votes, np.array(table["votes"], float)]), share)
    weights, intercept = _logistic(text, entry, len(toxic), len(chosen), posterior)
    # Calibration: a logistic curve of the raw score on the sample's own labels.
    raw = np.bincount(text, weights[entry], len(toxic)) + intercept
    slopes, shift = curve(raw, toxic.astype(float))
    slope, shift = (float(slopes[0]), shift) if slopes[0] > 0 else (1.0, 0.0)
    names = {r["entry"]: int(number[i]) for i, r in enumerate(best) if number[i] >= 0}
    return Model(names, weights * slope, float(intercept * slope + shift))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus ``score``, the probability that the text is toxic."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = strings(batch.column(batch.schema.get_field_index("text")))
            for at, many in slices(texts):
                text, entry = found(texts.slice(at, many), own.lexicon)
                raw = np.bincount(text, own.weights[entry], many) + own.intercept
                score = 1 / (1 + np.exp(-np.clip(raw, -700, 700)))
                part = batch.slice(at, many)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, "score"])
                # Workers are used again by later stages; what a slice took is given back before the next.
                pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, extended(docs, score="double"))


def toxicity(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> DataFrame:
    """``docs`` plus ``score``; by default rows with ``crc32(doc_id) mod 3 = 1`` are not learned from."""
    bounded_batches(docs.sparkSession)
    return scored(docs, fit(docs, labels, fold("doc_id", 3) != 1 if train is None else train))
