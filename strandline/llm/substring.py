"""Removal of repeated passages by hashing lines and paragraphs.

A *unit* is a run of words of one line. A line is one unit, unless it is long:
then it is also cut before each word whose hash is the least among its ``REACH``
neighbours on both sides, so that a passage that was pasted into
the middle of a line is cut alike wherever it stands, a few words at its edges
aside. Units are compared as lower-cased words (A-Z only) with white space
evened out, by a digest of 96 bits.

Of equal units the one in the row with the smallest id stays, and in that
row the first; all others go, with the white space behind them. Whole lines go however
short they are; the parts of a long line have ``WORDS`` words or more. A line without white space is one unit. ``kept`` holds the character ranges of the original text
that make up the new text.

Units are grouped by digest over all documents. A task sends, for each digest
and chunk, only its smallest id; the chunk's other rows are known to be later
copies there and then, so a passage that a third of all rows share costs one row a chunk.

Defined cases: a null text stays null, with no units; an empty text stays
empty; rows that repeat an id have the same rank, so equal units in both stay; rows with a
null id are not compared with others: only repeats within their own text go; extra
columns pass through, and the added names (``n_units``, ``n_removed``, ``kept``) replace
columns of the same names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import common, words

#: Words on either side that a cut's word hash is compared with.
REACH = 5
#: Least number of words of a part of a line; cuts at minima among ``REACH`` neighbours leave no shorter ones.
WORDS = REACH
#: Units that a task groups at once.
CHUNK = 1 << 19

_LOWER, _SPACE = words.lower_table(), words.space_table()


def units(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start byte, row, words, d1, d2) of the units of some texts, in order."""
    start, stop, row = words.spans(raw, offs, _SPACE)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    own = words.run_hashes(_LOWER[raw], start, stop)
    breaks = np.cumsum(raw == 10)
    line = breaks[start]
    new = np.ones(len(start), bool)
    new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start))
    length = last - first
    at = np.arange(len(start))
    behind, ahead = at - np.repeat(first, length), np.repeat(last, length) - at
    cut = (behind >= REACH) & (ahead > REACH)
    for k in range(1, REACH + 1):
        cut[k:] &= own[k:] < own[:-k]
        cut[:-k] &= own[:-k] <= own[k:]
    begin = np.flatnonzero(new | cut)
    end = np.append(begin[1:], len(start))
    d1, d2 = words.run_hashes(own, begin, end, 31), words.run_hashes(own, begin, end, 47) >> np.uint64(32)
    return start[begin], row[begin], end - begin, d1, d2


def _packed(buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("packed", pa.binary())])

    def flush(parts, turn):
        d1, d2, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, d2, d1))
        d1, d2, ids = d1[order], d2[order], ids[order]
        new = np.ones(len(d1), bool)
        new[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
        start = np.flatnonzero(new)
        least = np.repeat(ids[start], np.diff(np.append(start, len(ids))))
        late = ids != least
        body = np.empty((len(start), 20), np.uint8)
        body[:, :8] = ids[start].view(np.uint8).reshape(-1, 8)
        body[:, 8:16] = d1[start].view(np.uint8).reshape(-1, 8)
        body[:, 16:] = d2[start].view(np.uint8).reshape(-1, 8)[:, :4]
        bucket = (d1[start] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        body, bucket = body[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        out = [(int(bucket[a]), 0, body[a:b].tobytes()) for a, b in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True)]
        gone = np.stack((ids[late].view(np.uint64), d1[late]), 1)
        out += [((turn + i) * 7919 % buckets, 1, gone[i : i + 4096].tobytes()) for i in range(0, len(gone), 4096)]
        for i in range(0, len(out), 1024):
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out[i : i + 1024], strict=True), schema.types, strict=True)], schema=schema)

    def run(batches):
        parts, held, turn = [], 0, 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, raw, offs in words.slices(batch.column(1)):
                _, row, _, d1, d2 = units(raw, offs)
                parts.append((d1, d2, ids[lo + row]))
                held += len(d1)
            if held >= CHUNK:
                yield from flush(parts, turn)
                parts, held, turn = [], 0, turn + 4099
        if held:
            yield from flush(parts, turn)

    return run


def _later(key, group):
    """(id, d1) of the units of a bucket that are not the first of their kind."""
    out = []
    kinds, packed = group.column("kind").to_pylist(), group.column("packed").to_pylist()
    for kind, blob in zip(kinds, packed, strict=True):
        if kind == 1:
            out.append(np.frombuffer(blob, np.uint64).reshape(-1, 2))
    body = b"".join(blob for kind, blob in zip(kinds, packed, strict=True) if kind == 0)
    if body:
        body = np.frombuffer(body, np.uint8).reshape(-1, 20)
        ids, d1, d2 = (np.ascontiguousarray(body[:, a:b]).view(t).ravel() for a, b, t in ((0, 8, np.int64), (8, 16, np.uint64), (16, 20, np.uint32)))
        order = np.lexsort((ids, d2, d1))
        ids, d1, d2 = ids[order], d1[order], d2[order]
        new = np.ones(len(d1), bool)
        new[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
        start = np.flatnonzero(new)
        late = ids != np.repeat(ids[start], np.diff(np.append(start, len(ids))))
        out.append(np.stack((ids[late].view(np.uint64), d1[late]), 1))
    both = np.concatenate(out) if out else np.zeros((0, 2), np.uint64)
    return pa.table({"id": both[:, 0].view(np.int64), "gone": both[:, 1].view(np.int64)})


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cleaned(batches):
    """Texts (column 0) without the units named in the list (column 1), the other columns as they are."""
    for batch in batches:
        text = batch.column(0)
        valid = text.is_valid().to_numpy(zero_copy_only=False)
        whole = text.cast(pa.large_string()).to_pylist() if len(text) else []
        lists = batch.column(1)
        gone = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        amount = np.diff(np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))))
        gone_row = np.repeat(np.arange(len(text)), amount)
        texts, kept, counts = list(whole), [None] * len(text), np.zeros((2, len(text)), np.int64)
        for lo, hi, raw, offs in words.slices(text):
            start, row, _, d1, _ = units(raw, offs)
            a, b = np.searchsorted(gone_row, (lo, hi))
            mark = words.mix((row + 1).astype(np.uint64))
            listed = np.isin(words.mix(d1 ^ mark), words.mix(gone[a:b] ^ words.mix((gone_row[a:b] - lo + 1).astype(np.uint64))))
            order = np.lexsort((start, d1, row))
            again = np.zeros(len(row), bool)
            again[order[1:]] = (row[order[1:]] == row[order[:-1]]) & (d1[order[1:]] == d1[order[:-1]])
            drop = listed | again
            counts[0, lo:hi] = np.bincount(row, minlength=hi - lo)
            counts[1, lo:hi] = np.bincount(row[drop], minlength=hi - lo)
            chars = words.characters(raw)
            at = np.searchsorted(row, np.arange(hi - lo + 1))
            for i in range(hi - lo):
                begin, end = int(offs[i]), int(offs[i + 1])
                ranges = [(begin, end)] if end > begin else []
                if counts[1, lo + i]:
                    mine = slice(at[i], at[i + 1])
                    stay = ~drop[mine]
                    edges = start[mine]
                    ranges = [(begin, int(edges[0]))] if edges[0] > begin else []
                    for s, e, ok in zip(edges.tolist(), [*edges[1:].tolist(), end], stay.tolist(), strict=True):
                        if ok:
                            if ranges and ranges[-1][1] == s:
                                ranges[-1] = (ranges[-1][0], e)
                            else:
                                ranges.append((s, e))
                    texts[lo + i] = b"".join(raw[s:e].tobytes() for s, e in ranges).decode()
                if valid[lo + i]:
                    at0 = chars[begin] if chars is not None else begin
                    kept[lo + i] = [{"start": int((chars[s] if chars is not None else s) - at0), "end": int((chars[e] if chars is not None else e) - at0)} for s, e in ranges]
        rest = [batch.column(i) for i in range(2, batch.num_columns)]
        names = batch.schema.names[2:]
        yield pa.record_batch([pa.array(texts, pa.string()), pa.array(counts[0]), pa.array(counts[1]), pa.array(kept, _SPANS), *rest], names=["__text", "__n_units", "__n_removed", "__kept", *names])


def repeated_passages_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated units cut from the text, plus ``n_units``, ``n_removed`` and ``kept``."""
    common.arrow_rows(docs.sparkSession)
    docs = docs.drop("n_units", "n_removed", "kept")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    buckets = int(min(1 << 18, max(512, docs.count() // 5000)))
    packed = base.where("id is not null and text is not null").mapInArrow(words.released(_packed(buckets)), "bucket int, kind byte, packed binary")
    later = packed.groupBy("bucket").applyInArrow(_later, "id long, gone long")
    lists = later.groupBy("id").agg(F.collect_set("gone").alias("__gone")).withColumnRenamed("id", "__key")
    # a null id meets no list; its key spreads such rows
    keyed = docs.withColumn("__key", F.coalesce(F.col(id_col).cast("long"), -1 - F.abs(F.xxhash64(text_col))))
    joined = keyed.join(lists, "__key", "left")
    others = [c for c in docs.columns if c != text_col]
    gone = F.when(F.col(id_col).isNotNull(), F.col("__gone"))
    ready = joined.select(F.col(text_col).cast("string").alias("__text"), F.coalesce(gone, F.array().cast("array<bigint>")).alias("__gone"), *others)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields if f.name in others]
    schema = ", ".join(["__text string, __n_units long, __n_removed long, __kept array<struct<start:bigint,end:bigint>>", *fields])
    out = ready.mapInArrow(words.released(_cleaned), schema)
    return out.select(*[F.col("__text").alias(text_col) if c == text_col else F.col(c) for c in docs.columns], F.col("__n_units").alias("n_units"), F.col("__n_removed").alias("n_removed"), F.col("__kept").alias("kept"))
