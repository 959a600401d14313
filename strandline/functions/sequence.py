"""Column expressions over sequence records. All but the UDFs stay in generated code."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

_LOWER, _UPPER = string.ascii_lowercase, string.ascii_uppercase
_UNMASKED = r"[\x00-\x60]"


def ascii_upper(c: Column) -> Column:
    """A-Z for a-z; other characters, accented ones too, stay."""
    return F.translate(c, _LOWER, _UPPER)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def is_masked(c: Column) -> Column:
    """Whether any character is above 0x60, i.e. soft-masked."""
    return c.rlike(r"[^\x00-\x60]")


def mask_string(c: Column) -> Column:
    """A 1 for each masked character, a 0 for each other one."""
    return F.regexp_replace(F.regexp_replace(c, _UNMASKED, "0"), "[^0]", "1")


def mask_or_null(c: Column) -> Column:
    """The mask, or null where nothing is masked: such records store none."""
    return F.when(is_masked(c), mask_string(c))


def mask_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, _UNMASKED, "")).cast("long")


def apply_mask(sequence: Column, mask: Column) -> Column:
    """``sequence`` with its masked characters in ASCII lower case; a null mask changes nothing. A Python stage."""
    return _masked_text(sequence, mask)


def apply_runs(sequence: Column, runs: Column) -> Column:
    """``sequence`` with its runs (see :func:`mask_runs`) in ASCII lower case; null runs change nothing. A Python stage."""
    return _run_text(sequence, runs)


#: Bytes that a numpy pass takes at a time, since its temporaries are many times as large; a longer row is a slice alone.
PASS_BYTES = 1 << 20


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a large_string column."""
    offs = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    whole = column.buffers()[2]
    return offs - offs[0], np.frombuffer(whole, np.uint8)[offs[0] : offs[-1]] if whole is not None else np.zeros(0, np.uint8)


def _slices(column: pa.Array):
    """(first row, end) of slices of about ``PASS_BYTES`` bytes of a large_string column, at least one."""
    offs = _text_bytes(column)[0]
    first = 0
    while first < len(column) or not first:
        end = max(first + 1, int(np.searchsorted(offs, offs[min(first, len(column))] + PASS_BYTES, "right")) - 1)
        yield first, min(end, len(column))
        first = end


def flat_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first character, characters) of the runs of masked characters of a string column, in order."""
    offs, raw = _text_bytes(column.cast(pa.large_string()))
    starts, ends, chars_at = [], [], []
    plain, seen = not len(raw) or raw.max() < 0x80, 0
    for a in range(0, len(raw) + 1, PASS_BYTES):
        b = min(a + PASS_BYTES, len(raw))
        inside = np.zeros(b - a + 2, bool)
        low, high = max(a - 1, 0), min(b + 1, len(raw))
        inside[low - a + 1 : high - a + 1] = raw[low:high] > 0x60  # all bytes of a character beyond ASCII, too
        edge = np.zeros(b - a + 1, bool)
        own = offs[np.searchsorted(offs, a) : np.searchsorted(offs, b, "right")]
        edge[own - a] = True  # a run ends with its row
        start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1])) + a
        end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1 + a
        if not plain:  # places in characters from here on, those of the rows' first bytes beside them
            before = np.concatenate(([0], np.cumsum((raw[a:b] & 0xC0) != 0x80))) + seen
            chars_at.append((start, before[start - a], before[own[own < b] - a] if b < len(raw) else before[own - a]))
            start, end, seen = before[start - a], before[end - a], int(before[-1])
        starts.append(start)
        ends.append(end)
    start, end = np.concatenate(starts), np.concatenate(ends)
    if plain:
        row = np.searchsorted(offs, start, "right") - 1
        return row, start - offs[row], end - start
    row = np.searchsorted(offs, np.concatenate([x for x, _, _ in chars_at]), "right") - 1
    return row, start - np.concatenate([x for _, _, x in chars_at])[row], end - start


@arrow_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("len", T.IntegerType())])))
def mask_runs(texts: pa.Array) -> pa.Array:
    """Runs of masked characters; null where there is none. A numpy pass for each slice of a batch."""
    texts = texts.cast(pa.large_string())
    return pa.concat_arrays([_mask_runs(texts.slice(a, b - a)) for a, b in _slices(texts)])


def _mask_runs(texts: pa.Array) -> pa.Array:
    row, start, size = flat_runs(texts)
    runs = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(size, pa.int32())], ["start", "len"])
    count = np.bincount(row, minlength=len(texts))
    offs = np.concatenate(([0], np.cumsum(count)))
    none = pa.array(np.append(count == 0, False))
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32(), mask=none.to_numpy(zero_copy_only=False)), runs)


def _lowered(texts: pa.Array, offs: np.ndarray, raw: np.ndarray, inside: np.ndarray) -> pa.Array:
    """``texts`` with the letters of the bytes that are ``inside`` in lower case."""
    data = raw + ((inside & (raw >= 65) & (raw <= 90)).view(np.uint8) << 5)
    out = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(offs)), pa.py_buffer(data)])
    return pc.if_else(texts.is_valid(), out, None).cast(pa.string())


def _places(offs: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """(byte of each character, and the end; None where all is ASCII), (characters before each row, and all of them)."""
    if not len(raw) or raw.max() < 0x80:
        return None, offs
    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    return at, np.searchsorted(at, offs)


@arrow_udf(T.StringType())
def _run_text(texts: pa.Array, runs: pa.Array) -> pa.Array:
    texts = texts.cast(pa.large_string())
    return pa.concat_arrays([_with_runs(texts.slice(a, b - a), runs.slice(a, b - a)) for a, b in _slices(texts)])


def _with_runs(texts: pa.Array, runs: pa.Array) -> pa.Array:
    offs, raw = _text_bytes(texts)
    at, chars = _places(offs, raw)
    start, size = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in runs.flatten().flatten())
    row = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False))
    low = np.minimum(chars[row] + start, chars[row + 1])
    high = np.minimum(low + size, chars[row + 1])
    if at is not None:
        low, high = at[low], at[high]
    step = np.zeros(len(raw) + 1, np.int8)  # runs of a row do not touch, and each begins and ends once
    step[low] += 1
    step[high] -= 1
    return _lowered(texts, offs, raw, np.cumsum(step[:-1], dtype=np.int8).astype(bool))


@arrow_udf(T.StringType())
def _masked_text(texts: pa.Array, masks: pa.Array) -> pa.Array:
    texts = texts.cast(pa.large_string())
    return pa.concat_arrays([_with_mask(texts.slice(a, b - a), masks.slice(a, b - a)) for a, b in _slices(texts)])


def _with_mask(texts: pa.Array, masks: pa.Array) -> pa.Array:
    offs, raw = _text_bytes(texts)
    at, chars = _places(offs, raw)
    size = np.diff(chars)
    masks = pc.fill_null(masks, "").cast(pa.large_string())
    own, marks = _text_bytes(masks)
    held = np.diff(own)
    if (len(marks) and marks.max() >= 0x80) or ((held != size) & (held > 0)).any():  # marks are cut or filled up to the text
        masks = pa.array([m and "".join("01"[c == "1"] for c in m[:n]).ljust(n, "0") for m, n in zip(masks.to_pylist(), size.tolist(), strict=True)], pa.large_string())
        own, marks = _text_bytes(masks)
        held = np.diff(own)
    inside = np.zeros(chars[-1], bool)
    inside[np.repeat(held > 0, size)] = marks == 49
    return _lowered(texts, offs, raw, inside if at is None else np.repeat(inside, np.diff(at)))


@arrow_udf(T.ArrayType(T.StringType()))
def cut(texts: pa.Array, sizes: pa.Array) -> pa.Array:
    """Parts of texts that follow each other, of ``sizes`` characters; one pass, whatever the number of parts."""
    texts = texts.cast(pa.large_string())
    return pa.concat_arrays([_cut(texts.slice(a, b - a), sizes.slice(a, b - a)) for a, b in _slices(texts)])


def _cut(texts: pa.Array, sizes: pa.Array) -> pa.Array:
    offs, raw = _text_bytes(texts)
    at, chars = _places(offs, raw)
    count = pc.fill_null(pc.list_value_length(sizes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(np.append(0, sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
    first = np.concatenate(([0], np.cumsum(count)))
    shift = np.repeat(chars[:-1] - ends[first[:-1]], count)
    most = np.repeat(chars[1:], count)
    low, high = np.minimum(ends[:-1] + shift, most), np.minimum(ends[1:] + shift, most)
    if at is not None:
        low, high = at[low], at[high]
    keep = np.concatenate(([0], np.cumsum(high - low)))
    step = np.zeros(len(raw) + 1, np.int32)
    np.add.at(step, low, 1)
    np.add.at(step, high, -1)
    data = raw[np.cumsum(step[:-1]) > 0]  # all bytes, unless the sizes leave out an end
    parts = pa.Array.from_buffers(pa.large_string(), len(low), [None, pa.py_buffer(keep.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), parts)


def mask_run_rows(batches):
    """(id, start, len) rows of the runs of masked characters of Arrow batches (id, text)."""
    for batch in batches:
        row, start, size = flat_runs(batch.column(1))
        for i in range(0, max(1, len(row)), 65_536):
            part = slice(i, i + 65_536)
            yield pa.record_batch([batch.column(0).take(pa.array(row[part])), pa.array(start[part]), pa.array(size[part])], names=["doc_id", "start", "len"])


def split_id(line: Column) -> Column:
    return F.split(line, " ", -1)[0]


def split_header(line: Column, word_only: bool = False) -> Column:
    """What follows the first space, or only the word after it; null without a space."""
    return F.get(F.split(line, " ", -1 if word_only else 2), F.lit(1))


def wrapped(sequence: Column, width: int, trailing_blank: bool = False) -> Column:
    """Lines of ``width`` characters, each ended by a line feed.

    With ``trailing_blank`` a length that is a multiple of the width, 0 too, ends in a blank line.
    """
    cut = F.regexp_replace(F.regexp_replace(sequence, r"[\r\n]", ""), f"(.{{{width}}})", "$1\n")
    return F.concat(cut, F.lit("\n")) if trailing_blank else F.regexp_replace(F.concat(cut, F.lit("\n")), r"\n\n$|^\n$", "\n")


def subsequence(sequence: Column, start, end, unit: str = "character") -> Column:
    """Characters start to end, 0-based and half-open, clipped to the record; empty if start >= end.

    With ``unit="byte"`` positions count UTF-8 bytes, and the part is binary.
    """
    if unit == "byte":
        raw = sequence.cast("binary")
        low = F.greatest(start if isinstance(start, Column) else F.lit(start), F.lit(0))
        size = F.greatest(F.least(end if isinstance(end, Column) else F.lit(end), F.octet_length(raw)) - low, F.lit(0))
        return F.substr(raw, (low + 1).cast("int"), size.cast("int"))
    a = F.greatest(start if isinstance(start, Column) else F.lit(start), F.lit(0))
    b = F.least(end if isinstance(end, Column) else F.lit(end), F.length(sequence))
    return F.when(a >= b, F.when(sequence.isNotNull(), F.lit(""))).otherwise(F.substr(sequence, (a + 1).cast("int"), (b - a).cast("int")))


@arrow_udf(T.LongType())
def hash32(ids: pa.Array) -> pa.Array:
    """Low 32 bits of XXH3-64, the key of a hashed id index; xxhash has no form for arrays."""
    import xxhash

    return pa.array([None if x is None else xxhash.xxh3_64_intdigest(x) & 0xFFFFFFFF for x in ids.cast(pa.binary()).to_pylist()], pa.int64())


def sniff_format(head: Column) -> Column:
    """FASTA, FASTQ or CONTAINER (a dataset's Parquet file) by the first characters; null if none of them."""
    return F.when(head.startswith(">"), "FASTA").when(head.startswith("@"), "FASTQ").when(head.startswith("PAR1"), "CONTAINER")


#: First bytes (hex) of compressed files.
MAGIC = (("1F8B", "GZIP"), ("425A", "BZIP2"), ("FD377A585A00", "XZ"), ("28B52FFD", "ZSTD"), ("5D000080", "BROTLI"), ("04224D18", "LZ4"), ("FF06000000", "SNAPPY"))


def sniff_compression(content: Column) -> Column:
    """Codec by a file's first bytes; PLAIN if none is known, null for an empty file."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.when(head == "", None)
    for magic, name in MAGIC:
        out = out.when(head.startswith(magic), name)
    return out.otherwise("PLAIN")


def output_path(path: Column, extension: str) -> Column:
    """``path`` with its last extension replaced, or one added."""
    named = path.rlike(r"[^/]\.[^./]+$")
    return F.when(named, F.regexp_replace(path, r"\.[^./]+$", f".{extension}")).otherwise(F.concat(path, F.lit(f".{extension}")))


def offset_or_null(c: Column) -> Column:
    """0 stands for an absent offset."""
    return F.nullif(c, F.lit(0))


def within(offsets: Column, length: Column) -> Column:
    """Whether no offset of an array lies beyond ``length``."""
    return ~F.exists(offsets, lambda x: x > length)
