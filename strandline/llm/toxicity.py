"""Toxicity by compression distance.

Two zstandard dictionaries are fitted, one on ordinary and one on toxic
training text. Each window of ``WINDOW`` words of a text is compressed with both; the
bytes that the toxic dictionary saves over the ordinary one are its distance.
Counts of windows beyond a few distances, with the largest one, go through a
logistic curve whose weights are fitted on training rows that the dictionaries of that
fold have not seen, so the thresholds are calibrated.

The ordinary dictionary holds windows of ordinary text; those that look
toxic to a first pair of dictionaries (among the first ``HARD_ROWS`` ordinary rows) come last, where matches are cheapest. The toxic one holds the
same windows behind the words and word starts that toxic documents hold
significantly more often than ordinary ones (a Poisson bound, corrected for the number
tried; near copies count once), the most frequent ones if they take more than ``TOXIC_BYTES``.
This is a departure from two dictionaries of plain samples, whose windows differ by chance more than by a
single toxic word; README has the figures of both.

Defined cases: null and empty texts have no windows and get the score of an
eligible text without evidence; rows with a null id or label are not learnt from; an id with several
labels is toxic if one of them says so, and of several texts the least is learnt from; if the training rows lack a class,
every score is 0; repeated rows are scored alike; extra columns pass through and added names
(``score``) replace columns of the same name, except in :func:`toxic_removed`, which adds none. The fit reads at most ``TOXIC_ROWS`` and
``ORDINARY_ROWS`` labelled rows, those with the smallest hashed ids; scoring reads every
whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import common, words

#: Words of a window.
WINDOW = 16
#: Bounds of the sample of labelled rows.
TOXIC_ROWS, ORDINARY_ROWS, HARD_ROWS = 2500, 4000, 1500
#: Bytes of the dictionaries' ordinary and toxic parts.
ORDINARY_BYTES, TOXIC_BYTES = 49152, 8192
#: A document is called toxic from this score on.
THRESHOLD = 0.7

_LOWER, _SPACE = words.lower_table(), words.space_table()
_WORD, _FIELD = re.compile(rb"[a-z0-9\x80-\xff]+"), re.compile(rb"[^ \t-\r]+")
_STEPS = (2, 3, 4, 6)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]


def _low(text: str | None) -> bytes:
    return _LOWER[np.frombuffer((text or "").encode(), np.uint8)].tobytes()


def marked_terms(rows: list[tuple[bytes, int]]) -> list[bytes]:
    """Words, and word starts of 4 or 5 bytes, that toxic rows hold too often for chance; rarest first."""
    held, total, seen = (Counter(), Counter()), [0, 0], set()
    for text, toxic in rows:
        own = _WORD.findall(text)
        sketch = sorted({zlib.crc32(a + b" " + b) for a, b in zip(own, own[1:], strict=False)})[:4]
        if sum(x in seen for x in sketch) >= 2:
            continue
        seen.update(sketch)
        total[toxic] += 1
        kinds = {b" " + w for w in own}
        held[toxic].update({b + b" " for b in kinds} | {b[: k + 1] for b in kinds for k in (4, 5) if len(b) > k + 1})
    most = math.log(0.5 / max(1, len(held[1])))
    found = {}
    for term, n in held[1].items():
        mean = (held[0][term] + 1) * total[1] / max(1, total[0])
        if n >= 3 and n > 4 * mean and n * math.log(mean) - mean - math.lgamma(n + 1) < most:
            found[term] = n
    return sorted(found, key=lambda t: (found[t], t))


def _pick(seed: int, n: int) -> int:
    return int(words.mix(np.array([seed], np.uint64))[0] % np.uint64(max(1, n)))


def fit_dictionaries(rows: list[tuple[bytes, int]]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionary content."""
    kept, size = [], 0
    for term in marked_terms(rows)[::-1]:
        size += len(term)
        if size > TOXIC_BYTES:
            break
        kept.append(term)
    terms = b"".join(kept[::-1])
    ordinary = []
    for i, (text, toxic) in enumerate(rows):
        if not toxic:
            own = _FIELD.findall(text)
            for k in range(2):
                at = _pick(2 * i + k, len(own) - WINDOW)
                ordinary.append(b" ".join(own[at : at + WINDOW]))
    ordinary.sort(key=zlib.crc32)
    base = b" ".join(ordinary)[:ORDINARY_BYTES]
    clean = [t for t, toxic in rows if not toxic]
    hard, size = [], 0
    for gain, window in distances(clean[:HARD_ROWS], base, terms + base, keep=True):
        if gain >= 3 and size < ORDINARY_BYTES // 2:
            hard.append(window)
            size += len(window)
    base = base[: ORDINARY_BYTES - size] + b" ".join([b"", *hard])
    return base, terms + base


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    options = zstandard.ZstdCompressionParameters.from_level(6, write_content_size=False, write_dict_id=False, write_checksum=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS, min_match=4)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=options)


def _lengths(by: zstandard.ZstdCompressor, data: bytes, segments: bytes) -> np.ndarray:
    done = by.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments), threads=1)
    return np.fromiter(map(len, done), np.int64, len(done))


def windows(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, row) of the windows of some texts."""
    start, stop, row = words.spans(raw, offs, _SPACE)
    size = np.bincount(row, minlength=len(offs) - 1)
    first = np.concatenate(([0], np.cumsum(size)))
    begin = np.flatnonzero((np.arange(len(start)) - first[row]) % WINDOW == 0)
    last = np.minimum(begin + WINDOW, first[row[begin] + 1]) - 1
    # a space before a word belongs to its window: word starts are matched with it
    return np.maximum(start[begin] - 1, offs[row[begin]]), np.minimum(stop[last] + 1, offs[row[begin] + 1]), row[begin]


def gains(raw: np.ndarray, offs: np.ndarray, pair) -> tuple[np.ndarray, np.ndarray]:
    """(bytes saved, row) of each window; ``raw`` is lower-cased."""
    start, stop, row = windows(raw, offs)
    if not len(start):
        return np.zeros(0, np.int64), row
    flat = raw.copy()
    flat[_SPACE[flat]] = 32
    data, segments = flat.tobytes(), np.stack((start, stop - start), 1).astype("<u8").tobytes()
    return _lengths(pair[0], data, segments) - _lengths(pair[1], data, segments), row


def features(gain: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    n = np.bincount(row, minlength=rows)
    top = np.zeros(rows)
    np.maximum.at(top, row, gain)
    over = [np.bincount(row[gain >= k], minlength=rows) for k in _STEPS]
    return np.stack([np.ones(rows), np.minimum(top, 12) / 4, *(np.log1p(x) for x in over), np.log1p(n) / 4, over[2] / np.maximum(n, 1)], 1)


def distances(texts: list[bytes], ordinary: bytes, toxic: bytes, keep: bool = False):
    """Features of each text, or (gain, window) of all windows."""
    pair, out = (compressor(ordinary), compressor(toxic)), []
    column = pa.array([t.decode(errors="replace") for t in texts], pa.string())
    for lo, hi, raw, offs in words.slices(column):
        gain, row = gains(raw, offs, pair)
        if keep:
            start, stop, _ = windows(raw, offs)
            out += [(int(g), raw[a:b].tobytes()) for g, a, b in zip(gain, start, stop, strict=True) if g > 0]
        else:
            out.append(features(gain, row, hi - lo))
    return out if keep else np.concatenate(out)


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 0.05) -> np.ndarray:
    """Logistic weights by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_rows(rows: list[tuple[str | None, int]]) -> Model | None:
    """A model from (text, toxic) rows, in a fixed order; None if a class is missing."""
    low = [(_low(t), int(y)) for t, y in rows]
    halves = [low[0::2], low[1::2]]
    if any(len({y for _, y in h}) < 2 for h in halves):
        return None
    x, y = [], []
    for seen, other in (halves, halves[::-1]):
        x.append(distances([t for t, _ in other], *fit_dictionaries(seen)))
        y += [v for _, v in other]
    weights = fit_curve(np.concatenate(x), np.array(y, float))
    return Model(*fit_dictionaries(low), weights.tolist())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", training=None) -> Model | None:
    """Fit on labelled rows for which the column ``training`` holds."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")).where("id is not null and toxic in (0, 1)")
    if training is not None:
        marks = marks.where(training(F.col("id")))
    marks = marks.groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("turn", F.xxhash64("id"))
    # labels whose documents are not in the table take no place in the sample
    known = docs.select(F.col(id_col).alias("id")).distinct()
    marks = marks.join(known, "id", "left_semi")
    marks = common.table(marks, "marks")
    some = marks.where("toxic = 1").orderBy("turn", "id").limit(TOXIC_ROWS).unionByName(marks.where("toxic = 0").orderBy("turn", "id").limit(ORDINARY_ROWS))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = texts.join(F.broadcast(some), "id").groupBy("turn", "id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = known.collect()  # a row an id, at most the sample's
    return fit_rows([(r.text, r.toxic) for r in sorted(rows, key=lambda r: (r.turn, r.id))])


def _scored(model: Model | None, name: str):
    def run(batches):
        pair = (compressor(model.ordinary), compressor(model.toxic)) if model else None
        weights = np.array(model.weights) if model else None
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for lo, hi, raw, offs in words.slices(batch.column(0)) if model else ():
                gain, row = gains(_LOWER[raw], offs, pair)
                score[lo:hi] = 1 / (1 + np.exp(-np.clip(features(gain, row, hi - lo) @ weights, -30, 30)))
            yield pa.record_batch([*batch.columns[1:], pa.array(score)], names=[*batch.schema.names[1:], name])

    return run


def scored(docs: DataFrame, model: Model | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` from 0 to 1; no shuffle."""
    common.arrow_rows(docs.sparkSession)
    docs = docs.drop(name)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{name}` double"])
    return docs.select(F.col(text_col).cast("string").alias("__text"), *[F.col(f"`{c}`") for c in docs.columns]).mapInArrow(words.released(_scored(model, name)), schema)


def held_out(id_column):
    """Rows that nothing is learnt from."""
    return F.crc32(id_column.cast("string").cast("binary")) % 3 == 1


def toxic_removed(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``."""
    model = fit(docs, labels, training=lambda c: ~held_out(c))
    return scored(docs, model, name="__score").where(F.col("__score") < threshold).select(*docs.columns)
