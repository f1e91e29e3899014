"""Fill-in-middle: texts cut at two units and rearranged behind markers, with a sparse index of multibyte characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm import common
from panelspark.llm.words import text_blocks

MARKERS = ("<P>", "<S>", "<M>")
_BYTE = np.arange(256)
_LETTER = ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122))
#: Bytes of a character beyond its first, by its first byte.
_EXCESS = (_BYTE >= 0xC0).astype(np.int64) + (_BYTE >= 0xE0) + (_BYTE >= 0xF0)


class Exceptions:
    """The multibyte characters of a buffer of UTF-8: where they begin and how many excess bytes stand before each.

    Code points and bytes differ by the excess before them alone, so a cut is converted by one binary search
    among the exceptions and a sum; spans of ASCII are not looked at.
    """

    def __init__(self, buf: np.ndarray):
        self.at = np.flatnonzero(buf >= 0xC0)
        self.excess = np.concatenate([[0], np.cumsum(_EXCESS[buf[self.at]])])
        self.chars = self.at - self.excess[:-1]

    def to_chars(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before byte positions that begin a character or end the buffer."""
        return cuts - self.excess[np.searchsorted(self.at, cuts)]

    def to_bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Byte positions of code points."""
        return cuts + self.excess[np.searchsorted(self.chars, cuts)]


def token_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which runs of ASCII letters and all other characters begin; documents begin anew."""
    letter = _LETTER[buf]
    starts = (buf & 0xC0) != 0x80
    edge = offsets[(offsets > 0) & (offsets < len(buf))]
    joined = letter[1:] & letter[:-1]
    joined[edge - 1] = False
    starts[1:] &= ~joined
    return np.flatnonzero(starts)


def cut_places(buf: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """Units of each document, and the byte positions and code points of its two cuts, drawn from first and second."""
    index = Exceptions(buf)
    if unit == "token":
        starts = np.append(token_starts(buf, offsets), len(buf))
        base = np.searchsorted(starts, offsets)
    else:
        base = index.to_chars(offsets)
    n = np.diff(base)
    a, b = first % (n + 1), second % (n + 1)
    low, high = base[:-1] + np.minimum(a, b), base[:-1] + np.maximum(a, b)
    low, high = (starts[low], starts[high]) if unit == "token" else (index.to_bytes(low), index.to_bytes(high))
    prefix, middle = index.to_chars(low) - index.to_chars(offsets[:-1]), index.to_chars(high) - index.to_chars(low)
    return n, low, high, prefix, middle


def _rearrange(batches: Iterator[pa.RecordBatch], unit: str, joint: int, suffix_first: int, markers: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    pre, suf, mid = (m.encode() for m in markers)
    for batch in batches:
        draws = [batch.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)]
        for a, b, buf, offsets in text_blocks(batch, "body"):
            h1, h2, h3, h4 = (h[a:b] for h in draws)
            n, low, high, prefix, middle = cut_places(buf, offsets, h1, h2, unit)
            raw, out, forms = buf.tobytes(), [], []
            for i, (s, x, y, e) in enumerate(zip(offsets[:-1].tolist(), low.tolist(), high.tolist(), offsets[1:].tolist())):
                text = raw[s:e]
                if s == e or h3[i] % 100 >= joint or any(m in text for m in (pre, suf, mid)):
                    form, made = "plain", text
                elif h4[i] % 100 < suffix_first:
                    form, made = "spm", suf + raw[y:e] + pre + raw[s:x] + mid + raw[x:y]
                else:
                    form, made = "psm", pre + raw[s:x] + suf + raw[y:e] + mid + raw[x:y]
                forms.append(form)
                out.append(made)
            plain = np.array([f == "plain" for f in forms])
            cols = [batch.column("doc").slice(a, b - a), pa.array(n), pa.array(forms), pa.array(prefix, mask=plain), pa.array(middle, mask=plain)]
            cols.append(pa.array(out, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["doc", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", unit: str = "token",
    joint_percent: int = 90, suffix_first_percent: int = 20, markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """One row per document: (doc, n units, form, prefix_chars, middle_chars, output).

    unit "token" counts runs of ASCII letters and all other characters one by one, "char" counts code points. The cuts,
    the form and the order are drawn from sha256("seed:id"), so a rerun or a recomputed task draws the same;
    a missing id reads "null", and rows sharing an id draw the same numbers, each for its own text. Texts that are empty,
    missing (as empty) or contain a marker stay plain, as do 100 - joint_percent of all; plain rows have
    null prefix_chars and middle_chars. Other columns are not read. No shuffle: each batch is cut on its own.
    """
    if unit not in ("token", "char"):
        raise ValueError("unit is token or char")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)
    h = [F.conv(F.substring(drawn, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("body"), *h)
    made = rows.mapInArrow(
        lambda it: _rearrange(it, unit, joint_percent, suffix_first_percent, markers),
        "doc long, n long, form string, prefix_chars long, middle_chars long, output string",
    )
    return made


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text an output was made from, by its form alone. Texts with markers are plain, so the first marker of each kind is ours."""
    pre, suf, mid = markers

    def halves(text: Column, mark: str) -> tuple[Column, Column]:
        left = F.substring_index(text, mark, 1)
        return left, F.substr(text, F.char_length(left) + len(mark) + 1)

    def rebuilt(first: str, second: str) -> tuple[Column, Column, Column]:
        head, tail = halves(F.substr(output, F.lit(len(first) + 1)), second)
        return head, *halves(tail, mid)

    prefix, suffix, middle = rebuilt(pre, suf)
    suffix2, prefix2, middle2 = rebuilt(suf, pre)
    psm, spm = F.concat(prefix, middle, suffix), F.concat(prefix2, middle2, suffix2)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(common.table(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select(F.col("doc").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", *digests)


OP12_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS drawn
  FROM documents
), h AS (
  SELECT doc_id, body, units, len(units)::BIGINT AS n,
    ('0x' || substr(drawn, 1, 8))::BIGINT AS h1, ('0x' || substr(drawn, 9, 8))::BIGINT AS h2,
    ('0x' || substr(drawn, 17, 8))::BIGINT AS h3, ('0x' || substr(drawn, 25, 8))::BIGINT AS h4
  FROM cut
), parts AS (
  SELECT doc_id, body, n,
    array_to_string(units[1 : least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
    array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1 : greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
    array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1 : n], '') AS s,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM parts
"""
