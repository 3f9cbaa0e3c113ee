"""Toxicity by compression distance: two zstandard dictionaries, window by window.

One dictionary is trained on windows of ordinary texts, the other on windows of toxic
ones. A toxic text is ordinary for the most part, so the toxic windows are narrowed by
compression itself, in rounds: with dictionaries of the other folds' toxic windows,
windows of a text that save more bytes than nearly all ordinary windows do are kept,
and of them the words without which at least half of the saving is gone. Fragments
that ordinary windows bring up as often, or one text alone, are dropped; the rest
trains the next round's dictionary. A window is then compressed once with the ordinary
dictionary and once with the toxic one in front of it; the bytes saved are the window's
distance. A logistic curve over a text's savings, calibrated on the folds' own savings,
gives the score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm._labelled import remainder, sample

#: At most this many labelled rows of each class are fitted on, drawn by their id's hash.
TRAIN_ROWS = 3_000
WINDOW_WORDS = 8
LEVEL = 12
#: Bytes of the ordinary dictionary, and of it that open every window, so that no
#: window is too short to compress.
BASE_BYTES, PAD_BYTES = 65_536, 64
#: Dictionary of whole toxic windows: bytes, and the trainer's segment and match lengths.
WIDE = (8_192, 24, 8)
#: Dictionary of fragments, in the same terms.
NARROW = (4_096, 24, 8)
#: Folds whose texts are scored by dictionaries of the other folds' texts.
FOLDS = 3
#: In each round, the share of ordinary windows that save as much as a kept toxic one.
ROUNDS = (0.02, 0.01, 0.01)
#: Ordinary windows, drawn by a seed, that a round is held against.
AGAINST = 30_000
#: The share of a window's saving that a fragment accounts for, the texts that bring it
#: up at least, and how many ordinary windows weigh as much as one of these texts.
SHARE, TEXTS, DOUBT = 0.5, 2, 0.5
#: Share of ordinary texts that may lie above the threshold, where so many texts are
#: there to tell by at least.
FALSE_ALARMS, LEAST_TEXTS = 0.006, 200
#: Documents at or above this score are toxic.
THRESHOLD = 0.7
_SEED = 20_240


@dataclass(frozen=True)
class Model:
    base: bytes
    toxic: bytes
    weights: tuple[float, ...]

    def scores(self, savings: list[np.ndarray]) -> np.ndarray:
        z = _features(savings) @ np.array(self.weights)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def windows(text: str) -> list[bytes]:
    words = text.lower().encode("utf-8", "surrogatepass").split()
    return [b" " + b" ".join(words[i : i + WINDOW_WORDS]) + b" " for i in range(0, len(words), WINDOW_WORDS)]


class Scale:
    """Compresses windows with both dictionaries."""

    def __init__(self, base: bytes, toxic: bytes) -> None:
        self.pad = base[-PAD_BYTES:]
        self.plain, self.both = (self._compressor(d) for d in (base, toxic + base))

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)

    def saved(self, held: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window."""
        padded = [self.pad + w for w in held]
        plain, both = self.plain.compress, self.both.compress
        return np.fromiter((len(plain(w)) - len(both(w)) for w in padded), dtype=np.int64, count=len(padded))

    def savings(self, text: str) -> np.ndarray:
        """Bytes saved in each window of the whole text."""
        return self.saved(windows(text))

    def fragments(self, window: bytes, saving: int) -> list[bytes]:
        """The window's words without which at least SHARE of its saving is gone."""
        words = window.split()
        without = self.saved([b" " + b" ".join(words[:i] + words[i + 1 :]) + b" " for i in range(len(words))])
        return [b" " + w + b" " for w, s in zip(words, without, strict=True) if saving - s >= SHARE * saving]


def _features(savings: list[np.ndarray]) -> np.ndarray:
    rows = []
    for s in savings:
        top = np.sort(s)[::-1][:3] if len(s) else np.zeros(1)
        rows.append((1.0, top[0], top.sum(), np.log1p((s >= 1).sum()), np.log1p((s >= 2).sum()), np.log1p((s >= 3).sum()), np.log1p((s >= 4).sum()), np.log1p((s >= 5).sum()), np.log1p(len(s)), s.mean() if len(s) else 0.0, np.median(s) if len(s) else 0.0))
    return np.array(rows, dtype=np.float64)


def _trained(size: int, samples: list[bytes], **shape: int) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, **shape).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _lines(fragments: list[list[bytes]]) -> list[bytes]:
    """All texts' fragments in a seeded order, eight to a training sample."""
    every = [x for some in fragments for x in some]
    every = [every[i] for i in np.random.default_rng(_SEED).permutation(len(every))]
    return [b"".join(every[i : i + 8]) for i in range(0, len(every), 8)]


def _kept(fragments: list[list[bytes]], ordinary: Counter[bytes]) -> list[list[bytes]]:
    """Fragments of at least TEXTS texts that ordinary windows bring up more rarely."""
    count = Counter(x for some in fragments for x in some)
    return [[x for x in some if count[x] >= TEXTS and count[x] > DOUBT * ordinary[x]] for some in fragments]


def _toxic_dictionary(samples: list[bytes], shape: tuple[int, int, int]) -> bytes:
    size, k, d = shape
    return _trained(size, samples, k=k, d=d) if samples else b""


def _narrowed(base: bytes, toxic: list[list[bytes]], ordinary: list[bytes]) -> tuple[bytes, list[Scale]]:
    """The dictionary of toxic fragments, and each fold's scale without its own texts.

    toxic: every text's windows; ordinary: windows to hold them against, dealt to the
    folds in turn as the texts are.
    """
    fragments: list[list[bytes]] = []
    doubted: list[Counter[bytes]] = [Counter() for _ in range(FOLDS)]
    away = lambda some, fold: [x for i, x in enumerate(some) if i % FOLDS != fold] or some
    for number, rate in enumerate((*ROUNDS, None)):
        scales = []
        for fold in range(FOLDS):
            if number == 0:
                content = _toxic_dictionary([w for some in away(toxic, fold) for w in some], WIDE)
            else:
                content = _toxic_dictionary(_lines(_kept(away(fragments, fold), doubted[fold])), NARROW)
            scales.append(Scale(base, content))
        if rate is None:
            break
        found: list[list[bytes]] = [[] for _ in toxic]
        seen: list[Counter[bytes]] = [Counter() for _ in range(FOLDS)]
        for fold, scale in enumerate(scales):
            own = ordinary[fold::FOLDS]
            saved = scale.saved(own)
            least = max(1.0, float(np.quantile(saved, 1 - rate))) if len(saved) else 1.0
            raised = Counter(x for w, s in zip(own, saved, strict=True) if s >= least for x in set(scale.fragments(w, s)))
            for other in range(FOLDS):
                if other != fold or FOLDS == 1:
                    seen[other] += raised
            for i in range(fold, len(toxic), FOLDS):
                hits = [(w, s) for w, s in zip(toxic[i], scale.saved(toxic[i]), strict=True) if s >= least]
                found[i] = list(dict.fromkeys(x for w, s in hits for x in scale.fragments(w, s)))
        fragments, doubted = found, seen
    everywhere = sum(doubted, Counter())
    return _toxic_dictionary(_lines(_kept(fragments, everywhere)), NARROW), scales


def _against(texts: list[list[bytes]], deal: np.random.Generator) -> list[bytes]:
    """About AGAINST windows of the texts; place i is of a text of fold i modulo FOLDS."""
    folds = [[w for some in texts[fold::FOLDS] for w in some] for fold in range(FOLDS)]
    drawn = [[some[i] for i in deal.permutation(len(some))] for some in folds]
    each = min(AGAINST // FOLDS, *map(len, drawn))
    return [drawn[i % FOLDS][i // FOLDS] for i in range(each * FOLDS)]


def fit(toxic: list[str], ordinary: list[str]) -> Model | None:
    """Train both dictionaries and calibrate; None if either class has no text.

    The curve is fitted and the threshold set on savings by dictionaries that haven't
    seen the text: each fold's texts by those of the other folds. Copies of a text and
    of a window count once.
    """
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    if not toxic or not ordinary:
        return None
    deal = np.random.default_rng(_SEED)
    held = [list(dict.fromkeys(windows(t))) for t in toxic]
    everyday = [list(dict.fromkeys(windows(t))) for t in ordinary]
    samples = list(dict.fromkeys(w for some in everyday for w in some))
    base = _trained(BASE_BYTES, [samples[i] for i in deal.permutation(len(samples))]) or b" " * PAD_BYTES
    content, scales = _narrowed(base, held, _against(everyday, deal))
    target = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    features = _features([scales[i % FOLDS].savings(t) for texts in (toxic, ordinary) for i, t in enumerate(texts)])
    weights = _logistic(features, target)
    if len(ordinary) >= LEAST_TEXTS:
        # The threshold's place on the curve is set by the ordinary texts above it.
        edge = float(np.quantile(features[target == 0] @ weights, 1 - FALSE_ALARMS))
        weights[0] += np.log(THRESHOLD / (1 - THRESHOLD)) - edge - 1e-6
    return Model(base, content, tuple(weights))


def train(documents: DataFrame, labels: DataFrame, held_out: Column, each: int = TRAIN_ROWS) -> Model | None:
    """Fit on at most `each` labelled documents of each class that aren't held out."""
    rows = sample(documents, labels, "toxic", ~held_out, each).orderBy(F.xxhash64("_id"), "_id").toPandas()
    return fit(rows.text[rows.label == 1].tolist(), rows.text[rows.label == 0].tolist())


def score(documents: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row's whole text; null counts as empty; 0 without a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = Scale(model.base, model.toxic) if model else None
        for batch in batches:
            found = np.zeros(batch.num_rows)
            if scale and batch.num_rows:
                found = model.scores([scale.savings(t.as_py() or "") for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "score"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double")


def without_toxic(documents: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that score below the threshold.

    Null and empty texts are scored as empty; repeated rows stay or go together; without
    a model every row stays. An empty table gives none.
    """
    place = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = Scale(model.base, model.toxic) if model else None
        for batch in batches:
            if scale and batch.num_rows:
                found = model.scores([scale.savings(t.as_py() or "") for t in batch.column(place)])
                batch = batch.filter(pa.array(found < threshold))
            yield batch

    return documents.mapInArrow(run, documents.schema)


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (0 or 1) of every document.

    Rows whose crc32(doc_id as text) mod 3 is 1 are held out from fitting. Null ids
    give rows too; an empty table gives none; columns besides doc_id and text are
    ignored; equal texts have equal scores.
    """
    held_out = remainder(F.col("doc_id"), 3) == 1
    scored = score(documents, train(documents, labels, held_out))
    return scored.select(
        F.col("id").alias("doc_id"),
        (remainder(F.col("id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
