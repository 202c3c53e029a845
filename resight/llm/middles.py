"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, and the blocks are exchanged in place.

The cuts fall between tokens and depend on the id alone. Sentinels go into a bytearray that holds the text; two
neighbouring blocks are exchanged by reversing each of them and then both together. The same three reversals, with the
sentinels found in the output, bring the text back exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resight.llm.common import small_batches


@dataclass(frozen=True)
class MiddleParams:
    seed: int = 42
    #: Of a hundred texts so many are rearranged, and of a hundred of those so many put the suffix first.
    rate: int = 50
    suffix_first: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


PLAIN, PSM, SPM = "plain", "psm", "spm"


def token_ends(data: np.ndarray) -> np.ndarray:
    """Where the tokens of UTF-8 bytes end: white space with the word after it, or white space at the end of the text."""
    if not data.size:
        return np.empty(0, dtype=np.int64)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    last = ~blank
    last[:-1] &= blank[1:]
    last[-1] = True
    return np.flatnonzero(last) + 1


def drawn_numbers(seed: int, key: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of the hash of seed and id; a null id is hashed as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digest[at : at + 8], 16) for at in (0, 8, 16, 24))


def reverse(buffer: np.ndarray, begin: int, end: int) -> None:
    buffer[begin:end] = buffer[begin:end][::-1].copy()


def rotate(held: bytearray, begin: int, middle: int, end: int) -> None:
    """Exchange the blocks [begin, middle) and [middle, end) in place, by three reversals."""
    view = np.frombuffer(held, dtype=np.uint8)
    reverse(view, begin, middle)
    reverse(view, middle, end)
    reverse(view, begin, end)


def characters(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(((data & 0xC0) != 0x80).sum())


def rearranged(text: bytes, key: int | None, params: MiddleParams) -> tuple[int, str, int | None, int | None, bytes]:
    """Tokens, form, code points of prefix and middle, and the output of one text."""
    data = np.frombuffer(text, dtype=np.uint8)
    ends = token_ends(data)
    n = len(ends)
    signs = [s.encode() for s in (params.prefix, params.middle, params.suffix)]
    one, two, three, four = drawn_numbers(params.seed, key)
    if not text or any(s in text for s in signs) or three % 100 >= params.rate:
        return n, PLAIN, None, None, text
    units = sorted((one % (n + 1), two % (n + 1)))
    first, second = (int(ends[u - 1]) if u else 0 for u in units)
    held = bytearray(text)
    for place, sign in zip((second, first, 0), reversed(signs)):
        held[place:place] = sign
    middle = len(signs[0]) + first
    suffix = middle + len(signs[1]) + second - first
    # From prefix, middle, suffix to prefix, suffix, middle or suffix, prefix, middle.
    form = SPM if four % 100 < params.suffix_first else PSM
    rotate(held, 0 if form == SPM else middle, suffix, len(held))
    return n, form, characters(data[:first]), characters(data[first:second]), bytes(held)


def restored(output: bytes, form: str, params: MiddleParams) -> bytes:
    """The text an output of this form was made from."""
    if form == PLAIN:
        return output
    prefix, middle, suffix = (s.encode() for s in (params.prefix, params.middle, params.suffix))
    held = bytearray(output)
    # The suffix block is the first or the second of three: exchanged with what follows it, it is the last again.
    begin, after = held.find(suffix), held.find(prefix if form == SPM else middle)
    size = after - begin
    rotate(held, begin, after, len(held))
    ends = (0, held.find(middle), len(held) - size)
    for place, sign in zip(reversed(ends), (suffix, middle, prefix)):
        del held[place : place + len(sign)]
    return bytes(held)


def fill_in_middle(
    df: DataFrame, params: MiddleParams = MiddleParams(), id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """`id_col`, n, form, prefix_chars, middle_chars, output: every text with its middle moved to the end, or as it is.

    A text is left plain if it is empty, holds a sentinel, or its hash says so; the lengths of its parts are null then.
    A null text counts as empty; long texts are taken whole; a null id hashes as no digits. Repeated rows and rows of
    one id are treated each alone, with the same draws. An empty table gives an empty one; other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    slim = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            rows = [rearranged(t, k, params) for t, k in zip(texts, batch.column("id").to_pylist())]
            n, form, prefix, middle, output = map(list, zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    made = slim.mapInArrow(work, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return made.withColumnRenamed("id", id_col)


def restore_texts(df: DataFrame, params: MiddleParams = MiddleParams(), form_col: str = "form", output_col: str = "output") -> DataFrame:
    """`df` with a column `restored`: the text every output was made from. Null outputs or forms give null."""
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.col(form_col).alias("_form"),
                       F.col(output_col).alias("_output"))

    @F.pandas_udf("string")
    def back(outputs, forms):
        return outputs.combine(forms, lambda o, f: None if o is None or f is None else restored(o.encode(), f, params).decode())

    return packed.select("_row.*", back("_output", "_form").alias("restored"))
