"""Matching of glyph bitmaps with bitmaps of known signs, in Arrow batches against a small list of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.session import ship, small_rows

#: Side of the canvas, share of it that a sign fills, weights of overlap, aspect and fill, least score.
SIDE, FILLED, WEIGHTS, LEAST = 32, 0.85, (0.65, 0.25, 0.10), 0.50


def features(bits: np.ndarray) -> tuple[np.ndarray, float, float] | None:
    """(canvas, log of width to height, share of ink) of a boolean bitmap trimmed to its ink; None without ink."""
    rows, cols = np.flatnonzero(bits.any(1)), np.flatnonzero(bits.any(0))
    if not len(rows):
        return None
    ink = bits[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1]
    h, w = ink.shape
    k = SIDE * FILLED / max(h, w)
    nh, nw = max(1, round(h * k)), max(1, round(w * k))
    canvas = np.zeros((SIDE, SIDE), bool)
    y, x = (SIDE - nh) // 2, (SIDE - nw) // 2
    canvas[y : y + nh, x : x + nw] = ink[np.ix_(np.arange(nh) * h // nh, np.arange(nw) * w // nw)]
    return canvas.ravel(), float(np.log(max(0.1, w / h))), float(ink.mean())


def scores(glyphs: list, candidates: list) -> np.ndarray:
    """(glyphs, candidates): weighted similarity of their features, all pairs at once by one matrix product."""
    a, b = (np.stack([f[0] for f in x]).astype(np.float32) for x in (glyphs, candidates))
    both = a @ b.T
    either = a.sum(1)[:, None] + b.sum(1)[None] - both
    iou = np.divide(both, either, out=np.zeros_like(both), where=either > 0)
    (la, fa), (lb, fb) = (np.array([f[1:] for f in x], np.float32).T for x in (glyphs, candidates))
    aspect = np.exp(-np.abs(la[:, None] - lb[None]))
    fill = 1 - np.minimum(1, 2 * np.abs(fa[:, None] - fb[None]))
    return WEIGHTS[0] * iou + WEIGHTS[1] * aspect + WEIGHTS[2] * fill


def _bitmap(raw: bytes | None, width: int | None) -> np.ndarray:
    a = np.frombuffer(raw or b"", np.uint8)
    return a[: len(a) // width * width].reshape(-1, width) < 128 if width and width > 0 and len(a) >= width else np.zeros((0, 0), bool)


def match(glyphs: DataFrame, candidates: DataFrame, least: float = LEAST, most: int = 4096) -> DataFrame:
    """(family, codepoint, unicode, score) of glyphs (family, codepoint, width, pixels) against candidates (unicode, width,
    pixels): the best candidate of each glyph if it scores `least`, else null.

    Pixels are grey bytes row by row, dark below 128. The candidates are a list of signs, `most` at the very most (more are
    an error), and travel with the tasks; glyphs are scored where they lie. Of equal scores the first sign in code order
    wins; empty or missing bitmaps match nothing. An empty table gives an empty result.
    """
    ship(glyphs.sparkSession)
    known = sorted((r["unicode"], f) for r in small_rows(candidates.where("unicode is not null"), most) if (f := features(_bitmap(r["pixels"], r["width"]))) is not None)
    signs, feats = [k for k, _ in known], [f for _, f in known]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fs = [features(_bitmap(p, w)) for w, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            got: list[str | None] = [None] * len(fs)
            score = [0.0] * len(fs)
            have = [i for i, f in enumerate(fs) if f is not None] if feats else []
            if have:
                s = scores([fs[i] for i in have], feats)
                for i, k, v in zip(have, s.argmax(1), s.max(1)):
                    got[i], score[i] = (signs[k] if v >= least else None), float(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), pa.array(score, pa.float64())], ["family", "codepoint", "unicode", "score"])

    return glyphs.select(F.col("family").cast("string"), F.col("codepoint").cast("int"), F.col("width").cast("int"), F.col("pixels").cast("binary")).mapInArrow(run, "family string, codepoint int, unicode string, score double")
