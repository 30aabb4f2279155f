"""Column expressions on base sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. Base codes 0 to 15, in order; codes under 4 are the k-mer digits.
CODES = "TCAGNBDHKMRSVWXY"
#: Fixed values. Complements of IUPAC letters; N, S, W and X are their own.
_FROM, _TO = "ACGTUBDHKMRVY", "TGCAAVHDMKYBR"
#: The base of every letter by its ASCII code in either case; 0 for other bytes.
_BASES = np.zeros(256, np.uint8)
for _i, _base in enumerate(b"ACGTACGTACGTACGTACGTACGTAC"):
    _BASES[[65 + _i, 97 + _i]] = _base


def normalise(seq: Column) -> Column:
    """Upper case, U as T, and every character that is no base code as X."""
    return F.regexp_replace(F.translate(seq, CODES.lower() + "uU", CODES + "TT"), f"[^{CODES}]", "X")


def base_code(base: Column) -> Column:
    """The 4-bit code of one normalised base."""
    return F.call_function("instr", F.lit(CODES), base) - 1


def code_base(code: Column) -> Column:
    return F.substring(F.lit(CODES), code + 1, F.lit(1))


def complement(seq: Column) -> Column:
    return F.translate(seq, _FROM, _TO)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def pack_kmer(kmer: Column) -> Column:
    """The k-mer, of any length up to 15, as a number in base 4, first base most significant; null if a base is not one of ACGT."""
    return F.when(~kmer.rlike("[^ACGT]"), F.conv(F.translate(kmer, "TCAG", "0123"), 4, 10).cast("bigint"))


def unpack_kmer(key: Column, word_len: int) -> Column:
    return F.translate(F.lpad(F.conv(key.cast("string"), 10, 4), word_len, "0"), "0123", "TCAG")


def _bases_of(texts: pa.Array) -> pa.Array:
    """Bytes of longer characters are all above ASCII, so that they are no letters."""
    wide = pa.types.is_large_string(texts.type)
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, kind)
    held = texts.buffers()[2]
    bases = _BASES[np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]]] if held is not None else np.zeros(0, np.uint8)
    on = bases > 0
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(on)])[bounds - bounds[0]].astype(kind)
    out = (pa.LargeStringArray if wide else pa.StringArray).from_buffers(len(texts), pa.py_buffer(before), pa.py_buffer(bases[on]))
    return pc.if_else(texts.is_null(), pa.scalar(None, out.type), out) if texts.null_count else out


def letters_as_bases(text: Column) -> Column:
    """A fixed mapping of a text's letters A to Z to bases, to make sequences of ordinary tables; all else goes. Needs the package on the executors (session.ship)."""
    return F.arrow_udf(_bases_of, "string")(text)


def query_name(header: Column, longest: int = 200) -> Column:
    """A read's name: blanks as underscores, cut to the longest allowed."""
    return F.substring(F.translate(header, " ", "_"), 1, longest)


def wrapped(seq: Column, width: int = 50) -> Column:
    """The sequence in lines of at most width characters."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
