"""Catalogue, search, limits, statistics, glyph and graph operators on small tables with awkward rows."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from quire.functions import unicode as un
from quire.operators import catalog as ct, fidelity as fd, fonts as ft, glyphs as gl, limits as lm, search as se, silhouettes as sil, stats as stt
from quire.operators.graph import connected_components
from quire.operators.joins import range_join
from quire.plans.ingest import outcomes
from quire.sources import files as fs, pages as pg


def test_components_chains_stars_and_nulls(spark):
    edges = [(f"c{i:02}", f"c{i + 1:02}") for i in range(20)] + [("s0", f"s{i}") for i in range(1, 40)] + [(None, "x"), ("y", "y"), ("s0", "s1")]
    df = spark.createDataFrame(edges, "a string, b string")
    got = dict(connected_components(df).collect())
    assert {got[f"c{i:02}"] for i in range(21)} == {"c00"}
    assert {got[f"s{i}"] for i in range(40)} == {"s0"}
    assert "x" not in got and connected_components(df.limit(0)).count() == 0


def test_upsert_keeps_counter_and_is_idempotent(spark):
    t = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([("a", "A", 5, t), ("b", None, None, t)], "file_hash string, title string, download_count long, created_at timestamp_ntz")
    new = spark.createDataFrame([("a", "A2", 0, t), ("c", "C", 9, t), ("c", "C", 9, t)], old.schema)
    once = ct.upsert(old, new)
    rows = {r["file_hash"]: (r["title"], r["download_count"]) for r in once.collect()}
    assert rows == {"a": ("A2", 5), "b": (None, 0), "c": ("C", 0)}
    assert {r["file_hash"]: (r["title"], r["download_count"]) for r in ct.upsert(once, new).collect()} == rows
    assert ct.upsert(old.limit(0), new.limit(0)).count() == 0


def test_global_rank_equals_sort(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"), F.lit(1).alias("_q"))
    got = {r["id"]: r["rank"] for r in ct.global_rank(df, [F.desc("v"), F.col("id")]).collect()}
    want = {k: i for i, k in enumerate(sorted(range(1000), key=lambda x: (-(x % 7), x)), 1)}
    assert got == want


def test_filters_ignore_empty_and_unknown(spark):
    df = spark.createDataFrame([("h", 0, None), ("h", 1990, "")], "topic string, year int, edition string")
    assert df.where(ct.filters(topic="", year=0, period="century")).count() == 2
    assert df.where(ct.filters(edition="na")).count() == 2


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_search_against_brute_force(spark):
    rows = [("1", "Neural networks", "Ada", None, None), ("2", "Nueral networks", None, "neural", "x"), ("3", None, None, None, None), ("4", "Naural netwirks", "", "", ""), ("1", "Neural networks", "Ada", None, None)]
    df = spark.createDataFrame(rows, "id string, title string, author string, description string, isbn string")
    got = {r["id"]: (r["words"], r["typos"]) for r in se.matches(df, "neural netw").collect()}

    def best(row, w, last):
        ds = [0 if last and t.startswith(w) else levenshtein(t, w) for a in row[1:] for t in (a or "").lower().split()]
        ds = [x for x in ds if x <= se.budget(w)]
        return min(ds) if ds else None

    for r in rows:
        ds = [best(r, w, i == 1) for i, w in enumerate(["neural", "netw"])]
        ds = [x for x in ds if x is not None]
        if ds:
            assert got[r[0]] == (len(ds), sum(ds)), r
        else:
            assert r[0] not in got


def test_token_bucket_and_quota_folds(spark):
    ev = [("a", i, float(s)) for i, s in enumerate([0, 0, 0, 1, 10, 10.5, None or 30])] + [(None, 9, 0.0)]
    got = {(r["key"], r["event"]): r["allowed"] for r in lm.token_bucket(spark.createDataFrame(ev, "k string, e long, s double"), "k", "e", "s", 2, 0.1).collect()}
    tokens, last = 2.0, 0.0
    for _, e, s in ev[:-1]:
        tokens, ok, _ = lm.bucket_step(tokens, last, s, 2, 0.1)
        last = s
        assert got["a", e] == ok
    df = spark.createDataFrame([("u", 1, 3), ("u", 2, 3), ("u", 3, 3), ("v", 1, 9)], "u string, t int, n long")
    assert sorted((r["u"], r["t"], r["granted"]) for r in lm.quota(df, ["u"], ["t"], "n", 5).collect()) == [("u", 1, 3), ("u", 2, 2), ("u", 3, 0), ("v", 1, 5)]


def test_prefix_sum_of_a_hot_key(spark):
    rows = [("hot", i, 1) for i in range(500)] + [(f"k{i}", i, 2) for i in range(50)] + [(None, 1, 3), (None, 2, None)]
    df = spark.createDataFrame(rows, "k string, t int, n long")
    got = {(r["k"], r["t"]): r["prefix"] for r in lm.prefix_sum(df, ["k"], ["t"], "n").collect()}
    assert got == {**{("hot", i): i + 1 for i in range(500)}, **{(f"k{i}", i): 2 for i in range(50)}, (None, 1): 3, (None, 2): 3}


def test_zipf_coverage_equals_sorting(spark):
    rng = random.Random(2)
    for counts in ([rng.randrange(1, 40) for _ in range(60)], [7] * 9, [5], []):
        df = spark.createDataFrame([(i, c) for i, c in enumerate(counts)] or [(0, 0)], "k int, n long")
        got = {r["share"]: r["groups"] for r in stt.zipf_coverage(df, "k", "n", [0.3, 0.9, 1.0]).collect()}
        want = {}
        for share in (0.3, 0.9, 1.0) if counts else ():
            run = 0
            for i, c in enumerate(sorted(counts, reverse=True), 1):
                run += c
                if run >= share * sum(counts):
                    want[share] = i
                    break
        assert got == want


def test_body_size_raises_the_size_of_a_line():
    small = [(":", 12, 200, 0, 6), ("p", 8, 190, 12, 18), ("q", 8, 210, 12, 18)]
    lowered = [(c, 8, y, x0, x1) for c, _, y, x0, x1 in small]
    assert gl.render_line(small, 12) == r": \frac{p}{q}" and "frac" not in gl.render_line(small) + gl.render_line(lowered)
    assert gl.render_line([]) == "" and gl.render_page([[], []]) == ""


def test_pages_by_gaps_equal_the_full_rendering(spark):
    rng = random.Random(5)
    rows = []
    for doc in range(40):
        for line in range(4):
            x = 0.0
            for q in range(rng.randrange(1, 12)):
                x += rng.choice([0, 0, 3, 60])
                up = doc % 2 and rng.random() < 0.15
                rows.append((doc, 0, line, q, rng.choice("abcde"), 7.0 if up else 10.0, 100.0 + 20 * line - (6 if up else 0), x, x + 6))
                x += 6
    df = spark.createDataFrame(rows + [(1, 0, 0, None, "x", 1.0, 1.0, 1.0, 1.0), (None, 0, 0, 0, "x", 1.0, 1.0, 1.0, 1.0)], "doc_id long, page_no int, line_no int, seq int, ch string, size double, origin_y double, bbox_x0 double, bbox_x1 double")
    got = {r["doc_id"]: r["text"] for r in gl.render(df).collect()}
    for doc in range(40):
        lines = [[r[4:9] for r in rows if r[0] == doc and r[2] == ln] for ln in range(4)]
        assert got[doc] == gl.render_page(lines)
    assert gl.render(df.limit(0)).count() == 0


def test_bucket_of_a_hot_key_over_many_parts(spark):
    rng = random.Random(3)
    ev = [("hot", i, float(rng.randrange(0, 4000))) for i in range(3000)] + [(f"k{i}", 9000 + i, float(i)) for i in range(40)] + [("late", 1, None)]
    got = {(r["key"], r["event"]): (r["allowed"], r["wait_s"]) for r in lm.token_bucket(spark.createDataFrame(ev, "key string, event long, part double"), "key", "event", "part", 5, 0.3).collect()}
    tokens, last = 5.0, None
    for _, e, s in sorted((x for x in ev if x[0] == "hot"), key=lambda x: (x[2], x[1])):
        tokens, ok, wait = lm.bucket_step(tokens, s if last is None else last, s, 5, 0.3)
        last = s
        assert got["hot", e] == (ok, wait)
    assert len(got) == len(ev) - 1


def test_quota_follows_the_plan_and_the_day(spark):
    day = lambda d, h: dt.datetime(2024, 5, d, h)
    r = [("free", day(1, 1), 1, 4), ("free", day(2, 1), 2, 4), ("paid", day(1, 1), 3, 40), ("paid", day(1, 2), 4, 40), ("paid", day(2, 1), 5, 40), (None, day(1, 1), 6, 9), ("new", day(1, 1), 7, None)]
    df = spark.createDataFrame(r, "uid string, t timestamp_ntz, e long, n long")
    users = spark.createDataFrame([("free", None), ("paid", " BASIC "), (None, "pro")], "uid string, plan string")
    got = {x["e"]: x["granted"] for x in lm.plan_quota(df, users, "uid", "t", "e", "n").collect()}
    assert got == {1: 4, 2: 1, 3: 40, 4: 10, 5: 40, 6: 5, 7: 0}


def test_point_reads_claims_and_merges(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    c = spark.createDataFrame([("a", "B1", t[0], t[1]), ("b", "B1", t[1], t[0]), ("c", None, t[0], None)], "file_hash string, book_id string, created_at timestamp_ntz, accessed_at timestamp_ntz")
    body = spark.createDataFrame([("a", "x"), ("b", "y")], "file_hash string, markdown string")
    assert [r["markdown"] for r in ct.point_read(c, body, "b").collect()] == ["y"] and ct.point_read(c, body, "zz").count() == 0
    assert [r["file_hash"] for r in ct.point_read(c, body, book_id="B1").collect()] == ["a"]
    got = {r["file_hash"]: r["accessed_at"] for r in ct.touch(c, c.select("file_hash").where("file_hash <> 'a'"), F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")).collect()}
    assert got == {"a": t[1], "b": t[1], "c": dt.datetime(2024, 1, 1, 12)}
    m = spark.createDataFrame([({"k": "1", "role": "x"}, "admin"), ({"k": "1", "role": "x"}, None), (None, "billing")], "m map<string,string>, r string")
    assert [r[0] for r in m.select(ct.set_claim(F.col("m"), "role", F.col("r"))).collect()] == [{"k": "1", "role": "admin"}, {"k": "1"}, {"role": "billing"}]
    u = spark.createDataFrame([("u", "old", 1), ("v", None, 2)], "uid string, email string, n int")
    ch = spark.createDataFrame([("u", "new"), ("w", "add"), ("v", None), (None, "x")], "uid string, email string")
    assert {tuple(r) for r in ct.merge_fields(u, ch).collect()} == {("u", "new", 1), ("v", None, 2), ("w", "add", None)}


def test_range_join_keeps_points_without_spans(spark):
    p = spark.createDataFrame([(i, i % 3) for i in range(30)] + [(None, 0)], "p int, k int")
    s = spark.createDataFrame([(2, 9, 0), (5, 5, 0), (8, None, 1), (0, 40, 2)], "a int, z int, k int")
    got = sorted((r["p"] is None, r["p"], r["k"], r["a"]) for r in range_join(p, s, "p", "a", "z", 4, ["k"], "left").collect())
    spans = [(2, 9, 0), (0, 40, 2)]
    want = sorted((x is None, x, k, next((a for a, z, j in spans if x is not None and j == k and a <= x < z), None)) for x, k in [(i, i % 3) for i in range(30)] + [(None, 0)])
    assert got == want
    assert range_join(p, s, "p", "a", "z", 4, ["k"]).count() == sum(w[3] is not None for w in want)


def test_search_proximity_and_tags(spark):
    rows = [("1", "red old house", ["x"]), ("2", "house that is very very very very very red", None), ("3", "red", ["house"]), ("4", None, None), (None, "red house", None), ("1", "red old house", ["x"])]
    df = spark.createDataFrame(rows, "id string, title string, tags array<string>")
    got = {r["id"]: (r["words"], r["proximity"]) for r in se.matches(df, "red house").collect()}
    assert got == {"1": (2, 2), "2": (2, 8), "3": (2, 8)}
    assert [r["id"] for r in se.search(df, "red house").collect()][0] == "1"
    assert se.matches(df, "").count() == 0 and se.matches(df.limit(0), "red").count() == 0
    page = se.paged(df.where("id is not null"), [F.col("id")], 2, 2).collect()
    assert {(r["total"], r["pages"]) for r in page} == {(5, 3)}


def test_fonts_and_recovery(spark):
    f = spark.createDataFrame([("QWERTY+SuperMathPi-Six", "\x05"), ("Alpha-Grk", "b"), ("Alpha-Grk", "5"), ("Garamond", "\x05"), (None, "b"), ("Sym", " "), ("Symbol", "\x05"), ("Sym", "")], "f string, c string")
    assert [r[0] for r in f.select(ft.needs_recovery(F.col("f"), F.col("c"))).collect()] == [True, True, False, False, False, False, False, False]
    assert [r[0] for r in f.select(ft.greek_letter(F.col("f"), F.col("c"))).collect()][:2] == ["\x05", "β"]
    g = spark.createDataFrame([("A", 1, "\x01", True), ("A", 2, "\x02", True), ("A", 3, "\x03", True), ("A", 4, "\x04", True), ("B", 1, "q", False), ("A", 5, "\x05", True)], "family string, codepoint int, ch string, broken boolean")
    names = spark.createDataFrame([("A", 1, "star"), ("A", 2, "own"), ("A", 3, "c17"), ("A", 4, "odd")], "family string, codepoint int, name string")
    two = lambda *r: spark.createDataFrame(r, "name string, unicode string")
    table = spark.createDataFrame([("A", 5, "!")], "family string, codepoint int, unicode string")
    out = {(r["family"], r["codepoint"]): (r["out"], r["source"]) for r in ft.recover(g, table, names, two(("star", "★"), ("c17", "x")), two(("own", "♣"), ("star", "no"))).collect()}
    assert out == {("A", 1): ("★", "names"), ("A", 2): ("♣", "supplement"), ("A", 3): ("⟦?c17⟧", "unknown_name"), ("A", 4): ("⟦?odd⟧", "unknown_name"), ("B", 1): ("q", "kept"), ("A", 5): ("!", "table")}


def test_silhouettes_match_the_nearest_sign(spark):
    import numpy as np

    def draw(f, n=20, m=20):
        a = np.full((n, m), 255, np.uint8)
        for y in range(n):
            for x in range(m):
                if f(y / n, x / m):
                    a[y, x] = 0
        return m, a.tobytes()

    bar, ring, cross = (lambda y, x: 0.4 < y < 0.6), (lambda y, x: 0.05 < (y - 0.5) ** 2 + (x - 0.5) ** 2 < 0.2), (lambda y, x: abs(x - 0.5) < 0.1 or abs(y - 0.5) < 0.1)
    cand = spark.createDataFrame([("−", *draw(bar)), ("○", *draw(ring)), ("+", *draw(cross)), (" ", 4, b"\xff" * 16), (None, *draw(bar))], "unicode string, width int, pixels binary")
    gl_ = [("F", 1, *draw(bar, 30, 30)), ("F", 2, *draw(ring, 41, 41)), ("F", 3, *draw(cross, 33, 33)), ("F", 4, 3, b"\xff" * 9), ("F", 5, None, None), ("F", 6, 2, b"")]
    got = {r["codepoint"]: r["unicode"] for r in sil.match(spark.createDataFrame(gl_, "family string, codepoint int, width int, pixels binary"), cand).collect()}
    assert got == {1: "−", 2: "○", 3: "+", 4: None, 5: None, 6: None}
    strict = sil.match(spark.createDataFrame(gl_, "family string, codepoint int, width int, pixels binary"), cand, least=1.1)
    assert strict.where("unicode is not null").count() == 0
    # the batched score is the plain one
    fa, fb = [[sil.features(sil._bitmap(p, w)) for w, p in (draw(f, 25, 25), draw(f, 18, 18))] for f in (ring, cross)]
    for i, a in enumerate(fa):
        for j, b in enumerate(fb):
            iou = (a[0] & b[0]).sum() / (a[0] | b[0]).sum()
            want = 0.65 * iou + 0.25 * np.exp(-abs(a[1] - b[1])) + 0.10 * (1 - min(1, 2 * abs(a[2] - b[2])))
            assert abs(sil.scores(fa, fb)[i, j] - want) < 1e-5


def test_page_source_and_recogniser(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"text": "one", "meta": {"title": " T "}, "glyphs": [[0, 0, "F", "x", 10, 1, 0, 5]]}) + "\n\n" + json.dumps({"text": "two"}) + "\n")
    (tmp_path / "b.jsonl").write_text("no json")
    spark.dataSource.register(pg.PageSource)
    pages = spark.read.format("pages").option("path", str(tmp_path)).load().collect()
    assert sorted((r["path"][-7:], r["page_no"], r["text"], r["title"]) for r in pages if r["text"]) == [("a.jsonl", 0, "one", "T"), ("a.jsonl", 1, "two", "")]
    assert [r["page_no"] for r in pages if r["path"].endswith("b.jsonl")] == [None]
    g = spark.read.format("pages").option("path", str(tmp_path / "a.jsonl")).option("kind", "glyphs").load().collect()
    assert [(r["page_no"], r["ch"], r["size"]) for r in g] == [(0, "x", 10.0)]
    df = spark.createDataFrame([("1", b"ab"), ("2", None)], "id string, image binary")
    made = pg.map_pages(df, lambda: lambda x: x.decode().upper(), "id", "image")
    assert {tuple(r) for r in made.collect()} == {("1", "AB"), ("2", None)}


def test_supplement_and_fidelity_edges(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"/star": "★", "club": "♣", "": "x", "empty": ""}))
    assert {tuple(r) for r in fs.load_supplement(spark, str(tmp_path / "s.json")).collect()} == {("star", "★"), ("club", "♣")}
    assert fs.load_supplement(spark, str(tmp_path / "none.json")).count() == 0
    rows = [(1, "x^2 + {y", "k"), (2, "plain", "k"), (3, "a_ and b^{c}", None), (4, None, "k"), (5, r"$\left( x_1 \right)$ ok", "k"), (6, r"$\right x_1 \left$", "k")]
    v = {r["i"]: (r["total"], r["valid"], r["repaired"], r["unbalanced"], r["latex_errors"]) for r in fd.validate(spark.createDataFrame(rows, "i int, t string, line string"), "i", "t").collect()}
    assert v == {1: (1, 0, 1, 1, 0), 2: (0, 0, 0, 0, 0), 3: (1, 1, 0, 0, 0), 4: (0, 0, 0, 0, 0), 5: (1, 1, 0, 0, 0), 6: (1, 0, 0, 0, 1)}
    f = fd.fidelity(F.col("a"), F.col("b"), F.lit(0), F.lit(None).cast("double"), un.nfkc(F.col("b")))
    got = spark.createDataFrame([("fi ∑", "ﬁ ∑"), ("", ""), ("x" * 300, "")], "a string, b string").select(*[F.round(c, 4).alias(k) for k, c in f.items()]).collect()
    assert (got[0]["glyph_coverage"], got[0]["symbol_preservation"]) == (1.0, 1.0) and got[1]["overall"] == 1.0 and (got[2]["structure_score"], got[2]["glyph_coverage"]) == (0.5, 0.0)


def test_gate_reads_no_bytes(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x" * 10)
    (tmp_path / "b.exe").write_bytes(b"x")
    (tmp_path / "c.PDF").write_bytes(b"x" * 99)
    (tmp_path / "d.txt").write_bytes(b"")
    df = fs.gate(fs.collect_files(spark, str(tmp_path), "*"), 50).select("path", "status")
    assert {r["path"][-5:]: r["status"] for r in df.collect()} == {"a.pdf": "accepted", "b.exe": "rejected_type", "c.PDF": "too_large"}
    assert "content" not in df._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_glyph_table_skips_bad_rows(spark, tmp_path):
    p = tmp_path / "t.json"
    p.write_text(json.dumps({"F": {"0x6d": "=", "zz": "x", "70": "", "U+71": "q"}, "G": {}}))
    assert sorted(tuple(r) for r in fs.load_glyph_table(spark, str(p)).collect()) == [("F", 0x6D, "="), ("F", 0x71, "q")]
    assert fs.load_glyph_table(spark, str(tmp_path / "none.json")).count() == 0


def test_html_to_markdown(spark):
    html = "<html><head><title>t</title></head><body><nav>n</nav><h1>Head</h1><p>One <b>two</b><br>three<ul><li>a<li>b</ul><script>x()</script><a href='/u'>l</a>"
    df = spark.createDataFrame([(html,), (None,), ("",)], "h string")
    out = [r[0] for r in df.select(fs.html_to_markdown(F.col("h"))).collect()]
    assert out[0] == "# Head\n\nOne **two**\nthree\n\n- a\n- b[l](/u)" and out[1:] == [None, ""]


def test_outcomes_keep_failures_and_convert_copies_once(spark):
    t = dt.datetime(2024, 1, 1)
    f = spark.createDataFrame([("a.txt", "body one", t), ("b.txt", "body one", t), ("c.txt", None, t), ("d.txt", " ", t), ("e.txt", "known", t)], "filename string, text string, created_at timestamp_ntz")
    known = spark.createDataFrame([("known",)], "x string").select(F.sha2("x", 256).alias("file_hash"))
    new, status = outcomes(f, known)
    assert new.count() == 1
    assert {r["filename"]: r["status"] for r in status.collect()} == {"a.txt": "converted", "b.txt": "converted", "c.txt": "failed", "d.txt": "failed", "e.txt": "cache_hit"}


def test_weighted_pick_is_seeded_and_follows_weights(spark):
    df = spark.createDataFrame([(i, 50.0 if i < 20 else 1.0) for i in range(400)] + [(900, 0.0), (901, None), (902, -1.0)], "k int, w double")
    pick = lambda seed: [r["k"] for r in stt.weighted_pick(df, "k", "w", 30, seed).collect()]
    assert pick(1) == pick(1) != pick(2) and len(set(pick(1))) == 30
    heavy = [sum(k < 20 for k in pick(s)) for s in range(6)]
    assert min(heavy) >= 12 and max(max(pick(s)) for s in range(3)) < 900
    assert stt.weighted_pick(df.limit(0), "k", "w", 5).count() == 0


def test_charset_audit_and_flag(spark):
    df = spark.createDataFrame([(1, "a\x00b\x00\ue001\n"), (2, "ok\t\r\n"), (3, None), (4, "\x00")], "k int, t string")
    assert {tuple(r) for r in stt.charset_audit(df, "k", "t").collect()} == {("U+0000", 3, 2), ("U+E001", 1, 1)}
    assert [r[0] for r in df.orderBy("k").select(stt.charset_clean(F.col("t"))).collect()] == [False, True, True, False]
