"""Tokenised documents packed into sequences by the sum-of-squares rule.

Documents become token ids with a closing id 0, and pieces of at most
``capacity`` ids. An open sequence has a *gap*, the ids that still fit. A piece goes where the
sum over all gaps of the squared number of open sequences with that gap becomes
smallest; among equals, to the smallest gap.

Pieces are dealt at random (by a hash) into shares of about ``SHARE``, and a task packs a share
by the rule, one piece at a time: in ``PASSES`` passes that take the same part of each
length, longest first. That is the rule at every size; a share ends with a few sequences that aren't full, of some
fifteen thousand.

Defined cases: a null or empty text is the single id 0; repeated rows are packed each for
itself; rows with null ids too; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import common, words

CAPACITY = 2048
#: Pieces that are packed together, at most on average, and passes over their lengths.
SHARE, PASSES = 1 << 16, 16
#: Words whose ids a worker remembers.
CACHE = 300_000
#: The steps before the model of the vocabulary that words are split for here.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class FastIds:
    """Ids of a text as little-endian 32-bit bytes, by way of its words.

    The vocabulary's own splitter parts a text into words that are encoded
    independently, so words are split here and encoded once. Texts with characters
    beyond U+024F in lower case, where case and composition need care, or with a special
    token's string go to the tokenizer whole, and so do all texts if the file's splitter is another.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            known = json.load(file)
        steps = (known["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.fast = known["normalizer"] == NORMALIZER and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": SPLITTER} and not steps[1]["add_prefix_space"] and all(x["content"].startswith("<|") for x in known["added_tokens"])
        kinds = {c: unicodedata.category(c)[0] for c in map(chr, range(0x250))}
        letters, numbers = ("".join(re.escape(c) for c in kinds if kinds[c] == k) for k in "LN")
        space = "\t-\r \x85\xa0"
        self._split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+").findall
        self._odd = re.compile("[^\0-\x1b\x20-\u024f]|<\\|").search

        self._known: dict[str, bytes] = {}
        self._model = self._whole.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        self._bytes = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}

    def _encode(self, text: str) -> bytes:
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, word: str) -> bytes:
        if len(self._known) >= CACHE:
            self._known.clear()
        # the model sees a character for each byte
        token = word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(self._bytes)
        self._known[word] = out = np.array([t.id for t in self._model.tokenize(token)], "<u4").tobytes()
        return out

    def __call__(self, text: str) -> bytes:
        if not self.fast:
            return self._encode(text)
        low = text.lower()
        if "<|" in low if low.isascii() else self._odd(low):
            return self._encode(text)
        parts, known = self._split(low), self._known
        found = list(map(known.get, parts))
        if None in found:
            for i in [i for i, x in enumerate(found) if x is None]:
                found[i] = known.get(parts[i]) or self._learn(parts[i])
        return b"".join(found)


@lru_cache(2)
def fast_ids(path: str) -> FastIds:
    """One for each worker process, so that what it has learnt lasts over tasks."""
    return FastIds(path)


words.caches["ids"] = fast_ids.cache_clear

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("turn", pa.int64())])


def _tokenised(path: str, capacity: int):
    def run(batches):
        ids, turn = fast_ids(path), 0
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = ids(text or "") + b"\0\0\0\0"
                step, turn = 4 * capacity, turn + 1
                out += [(key, i, i * capacity, min(step, len(data) - i * step) // 4, data[i * step : (i + 1) * step], turn) for i in range(-(-len(data) // step))]
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _PIECES.types, strict=True)], schema=_PIECES)

    return run


def tokenised(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids, turn): pieces of at most ``capacity`` ids; ``ids`` are their bytes, ``turn`` tells repeated rows of a task apart."""
    common.arrow_rows(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return base.mapInArrow(words.released(_tokenised(path or vocabulary(), capacity), "ids"), "doc_id long, piece int, start long, length long, ids binary, turn long")


def in_passes(lengths: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """The order in which pieces are placed: each pass takes the same part of each length, longest first."""
    order = np.argsort(-lengths, kind="stable")
    own = lengths[order]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(own)))
    rank = np.arange(len(own)) - np.repeat(first, count)
    return order[np.argsort(((rank + 1) * passes - 1) // np.repeat(count, count), kind="stable")]


def placement(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(sequence, offset) of pieces that come in this order, by the sum-of-squares rule."""
    open_now = np.zeros(capacity + 1, np.int64)  # open sequences by gap; gaps 0 and capacity don't count
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    none, out, sequences = np.iinfo(np.int64).max, [], 0
    for s in lengths:
        g = capacity
        if s < capacity:
            # half the change of the sum for gaps from s up, and for a new sequence
            change = open_now[: capacity - s] - open_now[s:capacity] + 1.0
            change[0] -= 0.5
            change[open_now[s:capacity] == 0] = none
            k = int(np.argmin(change))
            if change[k] <= open_now[capacity - s] + 0.5:
                g = s + k
        if g == capacity:
            at, sequences = sequences, sequences + 1
        else:
            at = stacks[g].pop()
            open_now[g] -= 1
        out.append((at, capacity - g))
        if g > s:
            stacks[g - s].append(at)
            open_now[g - s] += 1
    return out


def _packed(capacity: int):
    def run(key, rows):
        share = key[0].as_py()
        rows = rows.sort_by([(c, "ascending") for c in rows.column_names if c != "share"])
        lengths = rows.column("length").to_numpy()
        order = in_passes(lengths)
        places = np.empty((len(lengths), 2), np.int64)
        places[order] = np.array(placement(lengths[order].tolist(), capacity), np.int64).reshape(-1, 2)
        rows = rows.drop_columns(["share", "turn"])
        return rows.append_column("sequence_id", pa.array((share << 32) + places[:, 0])).append_column("offset", pa.array(places[:, 1]))

    return run


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length, turn and others), a written table, with ``sequence_id`` and ``offset`` instead of ``turn``."""
    shares = common.worth(pieces.count(), SHARE)
    dealt = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "length", "turn"), F.lit(shares)))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name != "turn"]
    return dealt.groupBy("share").applyInArrow(_packed(capacity), ", ".join([*fields, "sequence_id long, offset long"]))


def packed_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    found = tokenised(docs, path, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "turn")
    return packed(common.table(found, "pieces"), capacity)
