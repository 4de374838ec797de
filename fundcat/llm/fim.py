"""Fill-in-the-middle rearrangement of documents.

Cuts are made between units of text, whose ends are found in the UTF-8 bytes. Lengths in
code points come from a sparse index of the text's multibyte characters alone: their
positions and the bytes in excess of one a character, added up. Between two of them a
code point is a byte further on, so a text of ASCII has an empty index and plain sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundcat.llm.common import table

SEED = 42
#: Of 100 documents those that are rearranged, and of 100 of these those in the order
#: suffix, prefix, middle.
RATE, SPM_RATE = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = f"{PREFIX}|{SUFFIX}|{MIDDLE}"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output string"


class ExceptionIndex:
    """The multibyte characters of UTF-8 bytes: ``at`` their positions in code points,
    ``excess`` the bytes above one a character of those up to and with each."""

    def __init__(self, data: np.ndarray) -> None:
        lead = np.flatnonzero(data >= 0xC0)
        size = data[lead]
        extra = 1 + (size >= 0xE0).astype(np.int64) + (size >= 0xF0)
        self.excess = np.cumsum(extra)
        self.at = lead - (self.excess - extra)
        self._bytes = lead
        self._sums = np.concatenate([[0], self.excess])

    def to_bytes(self, chars: np.ndarray) -> np.ndarray:
        """Byte offsets of cuts before the given code points."""
        return chars + self._sums[np.searchsorted(self.at, chars)]

    def to_chars(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before byte offsets; each cut lies between two characters."""
        return cuts - self._sums[np.searchsorted(self._bytes, cuts)]


def unit_ends(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of texts that lie in a row in ``data``: white space with the word behind it,
    or the white space at a text's end. Returns the ends of all words, the first of each
    text among them, and the units of each text."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    last = np.zeros(len(data), dtype=bool)
    last[stops[stops > starts] - 1] = True
    ends = np.flatnonzero(~space & (last | np.append(space[1:], True))) + 1
    first = np.searchsorted(ends, starts, side="right")
    words = np.searchsorted(ends, stops, side="right") - first
    trailing = np.zeros(len(starts), dtype=bool)
    full = stops > starts
    trailing[full] = space[stops[full] - 1]
    return ends, first, words + trailing


def _rearrange(batch: pa.RecordBatch) -> pa.RecordBatch:
    text = batch.column("text").cast(pa.large_string())
    h = [batch.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4)]
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    # Bytes of this batch alone; an empty batch may have no buffer.
    data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    starts, stops = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    ends, first, n = unit_ends(data, starts, stops)
    a, b = h[0] % (n + 1), h[1] % (n + 1)

    def cut(k: np.ndarray) -> np.ndarray:
        out, some = starts.copy(), (k > 0) & (k < n)
        out[some] = ends[first[some] + k[some] - 1]
        return np.where(k == n, stops, out)

    p, m = cut(np.minimum(a, b)), cut(np.maximum(a, b))
    index = ExceptionIndex(data)
    chars = [index.to_chars(x) for x in (starts, p, m)]
    marked = batch.column("marked").to_numpy(zero_copy_only=False)
    plain = (stops == starts) | marked | (h[2] % 100 >= RATE)
    spm = ~plain & (h[3] % 100 < SPM_RATE)
    raw = data.tobytes()
    P, S, M = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    outputs = []
    for i, (s, x, y, e) in enumerate(zip(starts.tolist(), p.tolist(), m.tolist(), stops.tolist(), strict=True)):
        if plain[i]:
            outputs.append(raw[s:e])
        elif spm[i]:
            outputs.append(b"".join((S, raw[y:e], P, raw[s:x], M, raw[x:y])))
        else:
            outputs.append(b"".join((P, raw[s:x], S, raw[y:e], M, raw[x:y])))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    long = lambda v: pa.array(v, pa.int64(), mask=plain)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), long(chars[1] - chars[0]), long(chars[2] - chars[1]), long(p - starts), long(m - p), pa.array(outputs, pa.binary()).cast(pa.string())],
        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes", "output"],
    )


def rearrange(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, prefix_bytes, middle_bytes, output)``,
    one row per input row, without a shuffle. All choices hang on the seed and doc_id, so a
    task that runs again chooses alike.

    Null and empty texts, and those that hold a sentinel, are plain, with null lengths; a
    text of white space alone is one unit. A null doc_id counts as the empty string, rows
    with equal ids are cut at the same draws, other columns are ignored, a text is held
    whole in one task and an empty table gives an empty result."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), digest.alias("digest"))
    rows = rows.select("doc_id", "text", F.rlike("text", F.lit(_MARKS)).alias("marked"), *draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(_rearrange, batches)

    return rows.mapInArrow(run, SCHEMA)


def restored(output="output", form="form") -> F.Column:
    """The text from an output and its form alone. A rearranged text holds no sentinel of
    its own, and none of them begins as another ends, so the three found are the cuts."""
    parts = F.split(F.col(output), _MARKS, -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(F.col(form) == "psm", F.concat(part(1), part(3), part(2))).when(F.col(form) == "spm", F.concat(part(2), part(3), part(1))).otherwise(F.col(output))


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = rearrange(table(spark, sf_dir, "documents"))
    digest = F.sha2("output", 256).alias("output_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest, F.sha2(restored(), 256).alias("restored_sha256"))


_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
    regexp_extract_all(coalesce(text, ''), '{_UNIT}') AS u
  FROM documents),
h AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4
  FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain'
      WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix
  FROM c)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
    ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p"""

QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}
ORACLES = {"op12_fill_in_middle": _SQL}
