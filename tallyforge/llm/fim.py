"""Fill-in-the-middle: texts rearranged around two cuts by displacement of their bytes, and put back.

The cuts of a batch's texts are found by one scan over its code points. A text
is three segments, and within one every byte moves equally far: the changes of
that distance are put into a difference array at the segments' first bytes, its
running sum is each byte's displacement, and one scatter writes all outputs of
the batch. To restore them the marks are looked up in the outputs, and a running
sum of the same kind gathers the bytes back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, unused, utf8

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3
#: Percentage of texts that are rearranged, and of those that have their suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20
PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"])
MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(id: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers of an id: the first groups of the SHA-256 of seed, colon and id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all marks, and the row of each; what runs over a row's end is none."""
    at = np.flatnonzero((data[:-2] == 60) & (data[2:] == 62)) if len(data) >= MARK else np.zeros(0, np.int64)
    at = at[np.isin(data[at + 1], [m[1] for m in (PREFIX, SUFFIX, MIDDLE)])]
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at + MARK <= offsets[row + 1]
    return at[inside], row[inside]


def _displacement(starts: np.ndarray, shifts: np.ndarray, size: int) -> np.ndarray:
    """starts[k] + shifts[k] is where a segment's first byte goes to or comes from: each byte's shift. Segments are in order; empty ones have no effect."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, np.diff(shifts, prepend=0))
    return np.cumsum(steps[:size], out=steps[:size])


def rearrange(data: np.ndarray, offsets: np.ndarray, h: np.ndarray) -> dict[str, np.ndarray]:
    """n, form, prefix and middle (code points), and the outputs' bytes and offsets, of texts and the four draws of each."""
    first = (data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(first)])
    place = np.append(np.flatnonzero(first), len(data))
    n = before[offsets[1:]] - before[offsets[:-1]]
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    form = np.where(h[3] % 100 < SUFFIX_FIRST, SPM, PSM)
    form[(n == 0) | (h[2] % 100 >= REARRANGED)] = PLAIN
    form[marks(data, offsets)[1]] = PLAIN
    begin, end = offsets[:-1], offsets[1:]
    # a cut behind the last code point is the next text's first byte, which is this one's end
    c1, c2 = place[before[begin] + low], place[before[begin] + high]
    p, s = c1 - begin, end - c2
    moved = form != PLAIN
    out = np.concatenate([[0], np.cumsum(end - begin + 3 * MARK * moved)])
    suffix_first = form == SPM
    to = out[:-1]
    at_prefix = to + np.where(suffix_first, 2 * MARK + s, MARK)
    at_suffix = to + np.where(suffix_first, MARK, 2 * MARK + p)
    at_middle = to + 3 * MARK + p + s
    shifts = np.stack([at_prefix - begin, at_middle - c1, at_suffix - c2], axis=1)
    shifts[~moved] = (to - begin)[~moved, None]
    shift = _displacement(np.stack([begin, c1, c2], axis=1).ravel(), shifts.ravel(), len(data))
    made = np.empty(out[-1], np.uint8)
    shift += np.arange(len(data))
    made[shift] = data
    for mark, at in ((PREFIX, at_prefix), (SUFFIX, at_suffix), (MIDDLE, at_middle)):
        for k in range(MARK):
            made[at[moved] - MARK + k] = mark[k]
    return {"n": n, "form": form, "prefix": low, "middle": high - low, "data": made, "offsets": out}


def put_back(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes and offsets, and whether each could be restored: a rearranged output must hold each mark once, in its form's order."""
    rows = len(form)
    begin, end = offsets[:-1], offsets[1:]
    at, row = marks(data, offsets)
    place, times = np.zeros((3, rows), np.int64), np.zeros((3, rows), np.int64)
    for k, mark in enumerate((PREFIX, SUFFIX, MIDDLE)):
        of = data[at + 1] == mark[1]
        place[k, row[of]] = at[of]
        times[k] = np.bincount(row[of], minlength=rows)
    p, s, m = place
    ordered = np.where(form == SPM, (s == begin) & (s < p) & (p < m), (p == begin) & (p < s) & (s < m))
    good = (form == PLAIN) | ((times == 1).all(axis=0) & ordered)
    moved = good & (form != PLAIN)
    to = np.concatenate([[0], np.cumsum(np.where(moved, end - begin - 3 * MARK, np.where(good, end - begin, 0)))])
    prefix = np.where(form == SPM, m - p, s - p) - MARK
    middle = end - m - MARK
    starts = np.stack([to[:-1], to[:-1] + np.where(moved, prefix, 0), to[:-1] + np.where(moved, prefix + middle, 0)], axis=1)
    shifts = np.stack([p, m, s], axis=1) + MARK - starts
    shifts[~moved] = (begin - to[:-1])[~moved, None]
    source = _displacement(starts.ravel(), shifts.ravel(), int(to[-1]))
    source += np.arange(len(source))
    return data[source], to, good


def _strings(data: np.ndarray, offsets: np.ndarray, good: np.ndarray | None = None) -> pa.Array:
    if offsets[-1] < 1 << 31:
        kind, offsets = pa.string(), offsets.astype(np.int32)
    else:
        kind = pa.large_string()
    valid = None if good is None or good.all() else pa.py_buffer(np.packbits(good, bitorder="little"))
    return pa.Array.from_buffers(kind, len(offsets) - 1, [valid, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.string())


def transform(docs: DataFrame, text: str = "text", id: str = "doc_id", seed: int = 1) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output.

    A text of n code points is cut twice, by draws from its id; see rearrange().
    Texts that are null (as empty), empty or hold a mark stay plain, and so does
    a share of the others. Rows are independent of each other: repeated rows
    give the same, a null id draws as an empty one. Other columns stay, columns
    of these names are replaced. An empty table stays empty.
    """
    made = [c.split(" ")[0] for c in MADE.split(", ")]
    taken = [c for c in docs.columns if c.lower() in made]
    helper = unused(docs, *(f"_h{k}" for k in range(5)), *made)[:5]
    rows = docs.withColumns(dict(zip(helper, [F.col(text), *draws(F.col(id), seed)], strict=True))).drop(*taken)
    kept = [c for c in rows.columns if c not in helper]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, helper[0]):
                got = rearrange(*utf8(part.column(helper[0])), np.stack([part.column(c).to_numpy() for c in helper[1:]]))
                plain = got["form"] == PLAIN
                chars = {c: pa.array(got[k], mask=plain) for c, k in (("prefix_chars", "prefix"), ("middle_chars", "middle"))}
                new = {"n": got["n"], "form": FORMS[got["form"]], **chars, "output": _strings(got["data"], got["offsets"])}
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in kept} | new)

    return rows.mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in rows.select(*[f"`{c}`" for c in kept]).dtypes] + [MADE]))


def restore(rows: DataFrame, output: str = "output", form: str = "form", into: str = "restored") -> DataFrame:
    """rows with the text that each output was made from, found from the output and its form alone.

    A null output counts as empty, a null or unknown form as plain; the text is
    null where an output isn't of its form. A column named as `into` is replaced.
    """
    kept = [c for c in rows.columns if c.lower() != into.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, output):
                given = part.column(form).to_numpy(zero_copy_only=False)
                kind = np.where(given == "psm", PSM, np.where(given == "spm", SPM, PLAIN))
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in kept} | {into: _strings(*put_back(*utf8(part.column(output)), kind))})

    return rows.mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in rows.dtypes if c in kept] + [f"`{into}` string"]))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = restore(transform(docs).drop("text"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


_H = ", ".join(f"('0x' || substr(d, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
SQL = {
    "op11_fim": f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
b AS (SELECT doc_id, t, length(t)::BIGINT AS n, {_H} FROM a),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {REARRANGED} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM b),
e AS (SELECT *, substr(t, 1, lo) AS p, substr(t, lo + 1, hi - lo) AS m, substr(t, hi + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM e"""
}
QUERIES = {"op11_fim": op11_fim}
