"""Glyph layer: font keys and risks as expressions, page reconstruction as an ordered fold per page."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.session import ship

#: Bracket pieces, and the measures that part body from raised type, words, cells, columns and lines.
BRACKETS_OPEN, BRACKETS_CLOSE = set("⎡⎛⎧"), set("⎣⎝⎩")
PIECES = set("⎡⎢⎣⎤⎥⎦⎛⎜⎝⎞⎟⎠⎧⎨⎩⎪⎫⎬⎭")
SMALL, SHIFT, WORD_GAP, CELL_GAP, COLUMN_GAP, MERGE = 0.85, 1.5, 0.18, 0.9, 4.0, 0.6


def font_key(name: Column) -> Column:
    """The family without a subset prefix of six capitals and without a CMap suffix; null is ''."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"^[A-Z]{6}\+", ""), r"-(?:Identity-[HV]|UCS2-[HV]|UTF16-[HV])$", "")


def glyph_risk(ch: Column, suspect: Column, greek: Column) -> Column:
    """ok, silent (a wrong printable sign), recovered, markered (a sign that shows it is broken) or stray."""
    o = F.ascii(ch)
    broken = ((o < 32) & ~o.isin(9, 10, 13)) | o.between(127, 159) | o.between(0xE000, 0xF8FF)
    printable = o.between(33, 126)
    return F.when(ch.isNull() | (ch == ""), "ok").when(broken, F.when(suspect, "markered").otherwise("stray")).when(printable & greek & ch.rlike("^[A-Za-z]$"), "recovered").when(printable & suspect, "silent").otherwise("ok")


def structural_suspect(subtype: Column, encoding: Column, has_tounicode: Column, printable: Column, alpha_ratio: Column, most: float = 0.60) -> Column:
    return printable & ~has_tounicode & subtype.startswith("Type0") & F.contains(F.coalesce(encoding, F.lit("")), F.lit("Identity")) & (alpha_ratio < most)


def parse_differences(c: Column) -> Column:
    """Map of code to glyph name: a number sets the code, each name takes it and counts on; names before any are dropped."""
    toks = F.regexp_extract_all(c, F.lit(r"(/[^\s/\[\]]+|\d+)"), F.lit(1))
    zero = F.struct(F.lit(-1).alias("at"), F.expr("cast(array() as array<struct<code:int,name:string>>)").alias("out"))
    step = lambda a, t: F.struct(
        F.when(t.startswith("/"), F.when(a["at"] >= 0, a["at"] + 1).otherwise(-1)).otherwise(t.try_cast("int")).alias("at"),
        F.when(t.startswith("/") & (a["at"] >= 0), F.concat(a["out"], F.array(F.struct(a["at"].alias("code"), F.substring(t, 2, 10_000).alias("name"))))).otherwise(a["out"]).alias("out"),
    )
    return F.aggregate(toks, zero, step)["out"]


def heading_level(text: Column, ratio: Column) -> Column:
    """1 to 3 for lines set larger than the body with at least four letters and no formula; else 0."""
    fit = (F.regexp_count(text, F.lit("[A-Za-z]")) >= 4) & ~text.rlike(r"[∑∫∏=]|\^\{|_\{")
    return F.when(~fit, 0).when(ratio >= 1.40, 1).when(ratio >= 1.18, 2).when(ratio >= 1.08, 3).otherwise(0)


def glyph_role(size: Column, line_size: Column, shift: Column) -> Column:
    return F.when(size >= SMALL * line_size, "body").when(shift < -SHIFT, "super").when(shift > SHIFT, "sub").otherwise("body")


def lookup(glyphs: DataFrame, table: DataFrame) -> DataFrame:
    """Glyphs with the curated reading of (family, code point) where there is one; the table is a small dimension and is
    left to the planner, which broadcasts it below its size limit."""
    j = glyphs.join(table, ["family", "codepoint"], "left")
    return j.withColumn("unicode", F.coalesce("unicode", "ch"))


# the fold of one page


def _mode(sizes: list[float]) -> float:
    n = Counter(round(s * 2) / 2 for s in sizes)
    return n.most_common(1)[0][0]


def _mark(sign: str, s: str) -> str:
    return sign + s if len(s) == 1 and (s == "-" or (s.isascii() and s.isalnum())) else f"{sign}{{{s}}}"


def render_line(glyphs: list[tuple], body: float | None = None) -> str:
    """Text of one line of (ch, size, y, x0, x1): word gaps, raised and lowered runs, stacked fractions."""
    solid = [g for g in glyphs if g[0].strip()]
    if not solid:
        return ""
    size = _mode([g[1] for g in solid])
    if body and body > size and any(g[1] >= 0.9 * body for g in solid):
        size = body
    base = median([g[2] for g in solid if g[1] >= SMALL * size] or [g[2] for g in solid])
    role = lambda g: "body" if g[1] >= SMALL * size else "super" if g[2] - base < -SHIFT else "sub" if g[2] - base > SHIFT else "body"
    out, prev_end, i = "", None, 0
    while i < len(glyphs):
        g = glyphs[i]
        if not g[0].strip():
            if out and not out.endswith(" "):
                out += " "
            prev_end = None
            i += 1
            continue
        r = role(g)
        if r == "body":
            if prev_end is not None and g[3] - prev_end > WORD_GAP * size and not out.endswith(" "):
                out += " "
            out += g[0]
            prev_end = g[4]
            i += 1
            continue
        run = []
        while i < len(glyphs) and glyphs[i][0].strip() and role(glyphs[i]) != "body":
            run.append(glyphs[i])
            i += 1
        up, down = [x for x in run if role(x) == "super"], [x for x in run if role(x) == "sub"]
        text = lambda xs: "".join(x[0] for x in xs)
        stacked = False
        if up and down:
            a, b = (min(x[3] for x in up), max(x[4] for x in up)), (min(x[3] for x in down), max(x[4] for x in down))
            over = min(a[1], b[1]) - max(a[0], b[0])
            stacked = over >= 0.5 * max(1e-9, min(a[1] - a[0], b[1] - b[0])) and not out.rstrip()[-1:].isalnum()
        if stacked:
            if prev_end is not None and run[0][3] - prev_end > WORD_GAP * size and not out.endswith(" "):
                out += " "
            out += f"\\frac{{{text(up)}}}{{{text(down)}}}"
        else:
            out += (_mark("_", text(down)) if down else "") + (_mark("^", text(up)) if up else "")
        prev_end = max(x[4] for x in run)
    return out.strip()


def split_gaps(glyphs: list[tuple], factor: float) -> list[list[tuple]]:
    """Segments of a line where the gap to the glyph before exceeds factor times the largest size."""
    out: list[list[tuple]] = []
    big = max((g[1] for g in glyphs), default=0)
    for g in glyphs:
        if out and g[3] - out[-1][-1][4] <= factor * big:
            out[-1].append(g)
        else:
            out.append([g])
    return out


def merge_lines(lines: list[list[tuple]]) -> list[list[tuple]]:
    """Lines whose baselines nearly agree become one; each is compared with the line merged so far."""
    out: list[list[tuple]] = []
    for ln in lines:
        if not ln:
            continue
        if out:
            last = out[-1]
            size = _mode([g[1] for g in last])
            a, b = median([g[2] for g in last if g[1] >= SMALL * size] or [g[2] for g in last]), median([g[2] for g in ln])
            if abs(a - b) <= MERGE * size and not (set(g[0] for g in ln) <= PIECES):
                out[-1] = sorted(last + ln, key=lambda g: round(g[3]))
                continue
        out.append(list(ln))
    return out


def matrix_spans(lines: list[list[tuple]], window: int = 14) -> list[tuple[int, int]]:
    """(first, after last) of blocks that open and close with lines made of bracket pieces."""
    piece = lambda ln: sum(g[0] in PIECES for g in ln) >= 0.6 * len(ln) if ln else False
    spans, i = [], 0
    while i < len(lines):
        if piece(lines[i]) and any(g[0] in BRACKETS_OPEN for g in lines[i]):
            end = next((j for j in range(i + 1, min(len(lines), i + window + 1)) if piece(lines[j]) and any(g[0] in BRACKETS_CLOSE for g in lines[j])), None)
            if end is not None:
                spans.append((i, end + 1))
                i = end + 1
                continue
        i += 1
    return spans


def render_page(lines: list[list[tuple]], body: float | None = None) -> str:
    lines = merge_lines(lines)
    spans = dict(matrix_spans(lines))
    out, i = [], 0
    while i < len(lines):
        if i in spans:
            rows = [" & ".join(render_line(c, body) for c in split_gaps([g for g in ln if g[0] not in PIECES], CELL_GAP)) for ln in lines[i + 1 : spans[i] - 1]]
            out.append("\\begin{bmatrix}\n" + " \\\\\n".join(r for r in rows if r) + "\n\\end{bmatrix}")
            i = spans[i]
            continue
        out += [t for seg in split_gaps(lines[i], COLUMN_GAP) if (t := render_line(seg, body))]
        i += 1
    return "\n".join(out)


def _plain(line: np.ndarray, ch: list[str], size: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> str | None:
    """The text of a page whose lines hold nothing raised, lowered, stacked, blank or to be merged, by its gaps alone; None
    for any other page."""
    new = np.r_[True, line[1:] != line[:-1]]
    starts = np.flatnonzero(new)
    if (np.diff(size)[~new[1:]] != 0).any() or (np.diff(y)[~new[1:]] != 0).any():
        return None
    ly, ls = y[starts], size[starts]
    if (np.abs(np.diff(ly)) <= MERGE * np.round(ls[:-1] * 2) / 2).any():
        return None
    if not PIECES.isdisjoint(ch) or any(not c.strip() for c in set(ch)):
        return None
    gap = np.r_[0.0, x0[1:] - x1[:-1]]
    parted = np.where(new | (gap > COLUMN_GAP * size), 2, np.where(gap > WORD_GAP * np.round(size * 2) / 2, 1, 0)).tolist()
    parted[0] = 0
    return "".join([("", " ", "\n")[p] + c for p, c in zip(parted, ch)])


def _pages(batches: Iterator[pa.RecordBatch], body: float | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        docs, pages, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), []
        at = b.column(2).offsets.to_numpy()
        g = b.column(2).values
        line, size, y, x0, x1 = (g.field(k).to_numpy(zero_copy_only=False) for k in ("line_no", "size", "origin_y", "bbox_x0", "bbox_x1"))
        ch = g.field("ch").to_pylist()
        for i, j in zip(at[:-1], at[1:]):
            t = _plain(line[i:j], ch[i:j], size[i:j], y[i:j], x0[i:j], x1[i:j]) if j > i else ""
            if t is None:
                lines: list[list[tuple]] = []
                for k in range(i, j):
                    if k == i or line[k] != line[k - 1]:
                        lines.append([])
                    lines[-1].append((ch[k], float(size[k]), float(y[k]), float(x0[k]), float(x1[k])))
                t = render_page(lines, body)
            texts.append(t)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(pages, pa.int32()), pa.array(texts, pa.string())], ["doc_id", "page_no", "text"])


def render(glyphs: DataFrame, body: float | None = None) -> DataFrame:
    """(doc_id, page_no, text) from glyphs (doc_id long, page_no int, line_no int, seq int, ch, size, origin_y, bbox_x0, bbox_x1).

    The glyphs of a page are gathered where they lie before the one shuffle, so that a page's row moves, not its glyphs;
    a page is what one row holds. Glyphs of null place or sign are dropped.
    """
    from quire.session import arrow_rows

    ship(glyphs.sparkSession)
    arrow_rows(glyphs.sparkSession, 200)
    g = glyphs.select("doc_id", "page_no", F.struct("line_no", "seq", "ch", "size", "origin_y", "bbox_x0", "bbox_x1").alias("g")).where("doc_id is not null and page_no is not null and " + " and ".join(f"g.{c} is not null" for c in ("line_no", "seq", "ch", "size", "origin_y", "bbox_x0", "bbox_x1")))
    p = g.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list("g")).alias("g"))
    return p.mapInArrow(lambda it: _pages(it, body), "doc_id long, page_no int, text string")


def assemble(pages: DataFrame, joined: str = "\n\n---\n\n") -> DataFrame:
    """(doc_id, text): the pages of a document in order, empty ones left out."""
    p = pages.where("text is not null and trim(text) <> ''").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    return p.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), joined).alias("text"))
