"""Training-data operators against brute force, exact round trips and held-out samples, with awkward rows throughout."""

import base64
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import langid, mixing, mojibake, names, neardup, packing, quality, scans, subjects, tokens

D = "/root/testdata/sf0.001"
needs = pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n))


def jaccard(a, b, k):
    def s(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    x, y = s(a), s(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for g in range(6):
        base = words(rng, 120).split()
        for v in range(5):
            w = base[:]
            for _ in range(v):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(99))
            rows.append((f"g{g}v{v}", " ".join(w), "x", 1))
    rows += [(f"r{i}", words(rng, 100), None, None) for i in range(30)]
    rows += [("null", None, None, None), ("empty", "", None, None), ("copy1", rows[0][1], "k", 2), ("copy2", rows[0][1].upper(), "k", 2), (None, "lost", "k", 2), ("g0v0", rows[0][1], "x", 1), ("long", words(rng, 20_000), "z", 0)]
    df = spark.createDataFrame(rows, "key string, body string, id string, k int")  # extra columns named as inner ones
    got = neardup.pairs_of_classes(neardup.near_duplicates(df, "key", "body", shingle=3, threshold=0.5), "a", "b")
    texts = {r[0]: r[1] for r in rows if r[0]}
    want = {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if jaccard(texts[a], texts[b], 3) >= 0.5}
    assert {tuple(r) for r in got.collect()} == want
    assert neardup.near_duplicates(df.limit(0), "key", "body").count() == 0


def test_hot_group_of_near_copies_is_one_class(spark):
    rng = random.Random(5)
    base = words(rng, 200)
    rows = [(f"n{i:03}", f"{base} tail{i}") for i in range(150)] + [(f"c{i:03}", base) for i in range(150)] + [(f"o{i}", words(rng, 60)) for i in range(40)]
    c = neardup.near_duplicates(spark.createDataFrame(rows, "id string, t string"), "id", "t", small=16, max_depth=2)
    n = c.groupBy("class_id").count().orderBy(F.desc("count")).first()
    assert n["count"] == 300 and c.count() == len(rows)


def test_large_bucket_of_one_template_keeps_every_link(spark):
    rng = random.Random(11)
    base = words(rng, 102)  # 100 runs of three words in common; the long ones are 0.45 alike, the short ones 0.54 like all
    rows = [(f"l{i:02}", f"{base} {words(rng, 60)}") for i in range(40)] + [(f"s{i:02}", f"{base} {words(rng, 25)}") for i in range(8)]
    c = neardup.near_duplicates(spark.createDataFrame(rows, "id string, t string"), "id", "t", shingle=3, threshold=0.5, small=4, max_depth=2).collect()
    assert len({r["class_id"] for r in c}) == 1
    text = dict(rows)
    assert {r["id"]: r["links"] for r in c} == {a: sum(jaccard(t, u, 3) >= 0.5 for b, u in rows if a != b) for a, t in text.items()}


def test_names_merge_until_no_round_merges(spark):
    # each spelling fits only the one before, so every round links one more
    rows = [("Maria Kolumbanto",)] + [("M. " + ("z" * i + "kolumbanto"[i:]).title(),) for i in range(1, 9)]
    got = names.author_clusters(spark.createDataFrame(rows, "a string"), "a").collect()
    assert len(got) == 9 and len({r["entity"] for r in got}) == 1


def test_subjects_tell_words_apart_that_share_15_bits(spark):
    met, pairs = {}, []
    for w in map("".join, itertools.product("bcdfg", "aeiou", "klmnp", "aeiou", "rstvz")):
        v = zlib.crc32(w.encode())
        x = met.setdefault(v & 0x7FFF, (w, v & 0xFFFF))
        if x[1] != v & 0xFFFF:
            pairs.append((x[0], w))
    law, sea = (" ".join(p[j] for p in pairs[:6]) for j in (0, 1))
    assert len(pairs) >= 6
    sample = [("en", s, f"{t} {t} {t}") for s, t in (("law", law), ("sea", sea)) for _ in range(4)]
    df = spark.createDataFrame([("a", law), ("b", sea)], "id string, t string")
    m = subjects.fit(df, "t", spark.createDataFrame(sample, "language string, topic string, text string"))
    assert {(r["id"], r["subject"]) for r in subjects.subjects(df, m, "id", "t").collect()} == {("a", "law"), ("b", "sea")}


def test_topics_are_learned_beyond_thin_samples(spark):
    rng = random.Random(8)
    seeds = {"law": ["court", "verdict", "judge"], "sea": ["ship", "harbour", "sailor"], "art": ["painter", "canvas", "museum"]}
    more = {s: ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(25)] for s in seeds}
    plain = "the and with from this that have which when where there their about other some into only over such also".split()
    text = lambda own, n: "\n\n".join(" ".join(rng.choice(own) if rng.random() < 0.4 else rng.choice(plain) for _ in range(40)) for _ in range(n))
    sample = [("en", s, " ".join(rng.choice(w) if rng.random() < 0.3 else rng.choice(plain) for _ in range(30))) for s, w in seeds.items() for _ in range(4)]
    corpus = [(f"m{s}{i}", text(seeds[s] + more[s], 3)) for s in seeds for i in range(30)]
    # these texts hold none of the samples' subject words
    held = [(f"{s}{i}", text(more[s], 3)) for s in seeds for i in range(10)] + [(f"none{i}", text(plain, 3)) for i in range(10)]
    df, out = spark.createDataFrame(corpus + held, "id string, t string"), spark.createDataFrame(held, "id string, t string")
    p = subjects.prior(sample)
    start = subjects.Topics(p.languages, p.subjects, subjects._normal(p.beta), p.base, subjects.name_topics(p.beta, p)[0])
    before = {(r["id"], r["subject"]) for r in subjects.subjects(out, start, "id", "t").collect()}
    m = subjects.fit(df, "t", spark.createDataFrame(sample, "language string, topic string, text string"), tolerance=1e-3)
    got = {(r["id"], r["subject"]) for r in subjects.subjects(out, m, "id", "t").collect()}
    assert len(m.bounds) > 2 and m.bounds[-1] > m.bounds[0] and m.phi.shape[2] > len(m.subjects)
    assert sum((f"{s}{i}", s) in before for s in seeds for i in range(10)) <= 6
    want = {(f"{s}{i}", s) for s in seeds for i in range(10)}
    assert len(want & got) >= 29 and len(got - want) <= 1


def test_running_text_behind_marks_is_a_paragraph():
    run = "the old king came to the grey city in the year of the war and stayed"
    for before in ("- 98 -\n", "130.\n", "# A title\n", "[^3]: ", "| a | b |\n|---|---|\n", "$$x = 1$$\n", "```py\nx = 1\n```\n", "1. "):
        assert [p.strip() for p in subjects.paragraphs(f"{before}{run}.\n\n{run}.")] == [run + ".", run + "."], before
    assert subjects.paragraphs(f"**Note.** {run}") == [f"**Note.** {run}"]
    # a fence that nothing closes hides nothing of what follows
    assert run in subjects.paragraphs(f"```py\nx = 1\n\n{run}")
    # still no running text: headings with a running head, lists, tables, imprints, code, formulas
    for none in ("# A title", "- 98 -\nAn atlas of the old grey cities", "- one thing\n- two things that are here.", "| a | b |\n|---|---|", "**A. Writer**\nThird edition of the great grey press\n© 1978 X\nISBN 1", "```py\nx = 1\n\ny = 2\n```", "$x = 1$"):
        assert subjects.paragraphs(none) == [], none


def test_topics_are_named_by_their_top_terms():
    sample = [("en", s, " ".join(w * 3)) for s, w in (("law", ["court", "verdict", "judge"]), ("sea", ["ship", "harbour", "sailor"])) for _ in range(4)]
    p = subjects.prior(sample)
    phi = subjects._normal(p.beta)
    named = subjects.name_topics(phi, p)[0][0]
    turn = np.roll(np.arange(phi.shape[2]), 2)  # the names go with the words, not with the place of a topic
    assert (subjects.name_topics(phi[:, :, turn], p)[0][0] == named[turn]).all() and len(set(named.tolist())) == 3
    mixed = phi.copy()
    mixed[:, :, 0] = phi[:, :, [0, 2]].mean(2)  # the terms of two subjects alike
    assert subjects.name_topics(mixed, p, agree=0.6)[0][0][0] == len(p.subjects)


def brute_ppm(model, samples, data):
    """Code lengths straight from counts, for one language."""
    cost = []
    hist = [32] * langid.ORDER + list(data)
    for i, sym in enumerate(data):
        at, bits, k = i + langid.ORDER, 0.0, langid.ORDER
        while True:
            ctx = tuple(hist[at - k : at])
            seen = samples[k].get(ctx)
            if seen:
                n, d = sum(seen.values()), len(seen)
                if sym in seen:
                    bits += -np.log2(seen[sym] / (n + d))
                    break
                bits += -np.log2(d / (n + d))
            if k == 0:
                bits += 8
                break
            k -= 1
        cost.append(bits)
    return sum(cost)


def test_ppm_tables_equal_brute_force():
    train = {"aa": "the cat sat on the mat and the rat", "bb": "el gato come en la casa y el rato"}
    m = langid.fit_ppm(list(train.items()), garbles=[])
    for j, lang in enumerate(m.languages):
        data = list(b" " * (langid.ORDER + 1) + langid._clean("\n".join([train[lang]] * 2)))
        counts = []
        for k in range(langid.ORDER + 1):
            c = {}
            h = [32] * k + data
            for i, s in enumerate(data):
                ctx = tuple(h[i : i + k])
                c.setdefault(ctx, {}).setdefault(s, 0)
                c[ctx][s] += 1
            counts.append(c)
        for text in ("the cat", "el gato xx", "zzz qqq", "é"):
            want = brute_ppm(m, counts, list(b" " + langid._clean(text)))
            assert abs(langid.score_texts(m, [text])[0, j] - want) < 0.02 * want + 0.5


@needs
def test_languages_of_held_out_samples(spark):
    seed = [tuple(r) for r in spark.read.parquet(f"{D}/topic_seed.parquet").orderBy("seed_id").select("language", "text").collect()]
    m = langid.fit_ppm(seed[::2])
    hits = [m.languages[i] == s[0] for s, i in zip(seed[1::2], langid.score_texts(m, [s[1] for s in seed[1::2]]).argmin(1))]
    assert np.mean(hits) > 0.98
    es, de = next(t for x, t in seed if x == "es"), next(t for x, t in seed if x == "de")
    rows = [("mix", f"{es}\n\n{es}\n\n{de}", "spa", 0), ("null", None, None, 0), ("empty", "", "xx", 0), ("sign", "1234 %%", "EN", 0), ("wrong", es, "ru", 0)]
    out = langid.languages(spark.createDataFrame(rows, "id string, t string, l string, para_no int"), m, "id", "t", "l").collect()
    main = {r["id"]: (r["language"], r["label"]) for r in out if r["para_no"] == 0}
    assert main == {"mix": ("es", "es"), "null": (None, None), "empty": (None, None), "sign": (None, "en"), "wrong": ("es", "ru")}
    assert {(r["para_no"], r["language"]) for r in out if r["id"] == "mix"} == {(0, "es"), (1, "es"), (2, "es"), (3, "de")}


@needs
def test_footnote_in_another_language_is_a_paragraph(spark):
    seed = [tuple(r) for r in spark.read.parquet(f"{D}/topic_seed.parquet").orderBy("seed_id").select("language", "text").collect()]
    es, de = next(t for x, t in seed if x == "es"), next(t for x, t in seed if x == "de")
    df = spark.createDataFrame([("note", f"{es}\n\n{es}\n\n[^3]: {de}\n\n[^4]: {es}")], "id string, t string")
    out = langid.languages(df, langid.fit_ppm(seed), "id", "t").where("para_no > 2").collect()
    assert {(r["para_no"], r["language"]) for r in out} == {(3, "de"), (4, "es")}


@needs
def test_mojibake_round_trip(spark):
    seed = spark.read.parquet(f"{D}/topic_seed.parquet")
    text = [r[0] for r in seed.where("language in ('es', 'fr', 'de', 'pt')").select("text").collect()]
    garble = lambda t, was, read: "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in t.encode(was))
    held = text[1::2]
    rows = [(f"u{i}", garble(t, "utf-8", "cp1252"), None, 0) for i, t in enumerate(held)] + [(f"c{i}", t, None, 0) for i, t in enumerate(held)] + [("q", "ok `Ã©` ⟦?Ã©⟧", None, 0), ("n", None, None, 0), ("e", "", None, 0), ("f", "p�gina", None, 0), ("x", "m&#195;&#161;s cosas", None, 0)]
    df = spark.createDataFrame(rows, "id string, t string, field string, runs int")
    model = mojibake.fit(df, ["t"], seed)
    got = {r["id"]: r["restored"] for r in mojibake.garbled(df, model, "id", ["t"]).collect()}
    odd = [i for i, t in enumerate(held) if not t.isascii()]
    assert {f"u{i}" for i in odd} <= got.keys() and not [k for k in got if k[0] in "cqne"] and got["f"] == "p�gina" and got["x"] == "más cosas"
    assert np.mean([got[f"u{i}"] == held[i] for i in odd]) > 0.85


def test_clean_language_is_counted_over_all_samples(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("aeñóстр ßç") for _ in range(12)) for _ in range(2300)]
    samples = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string")
    model = mojibake.fit(spark.createDataFrame([("a",)], "t string"), ["t"], samples)
    want = mojibake.clean_model([*texts, ""])
    assert model.letters == want.letters and np.allclose(model.logb, want.logb, atol=1e-12)


@needs
def test_swaps_outside_the_list_are_learned_from_their_source(spark):
    seed = spark.read.parquet(f"{D}/topic_seed.parquet")
    text = [r[0] for r in seed.where("language in ('es', 'fr', 'de', 'pt')").orderBy("seed_id").select("text").collect()]
    garble = lambda t, was, read: "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in t.encode(was, "replace"))
    odd = [i for i, t in enumerate(text) if not t.isascii()]
    clean = [(f"c{i}", t) for i, t in enumerate(text)]
    for was, read, share in (("cp1252", "cp775", 0.75), ("mac_roman", "cp850", 0.83), ("cp1252", "iso8859_5", 0.88)):
        assert (was, read) not in langid.GARBLES
        df = spark.createDataFrame(clean + [(f"g{i}", garble(text[i], was, read)) for i in odd], "id string, t string")
        model = mojibake.fit(df, ["t"], seed)
        got = {r["id"]: r["restored"] for r in mojibake.garbled(df, model, "id", ["t"]).collect()}
        assert not [k for k in got if k[0] == "c"]
        assert np.mean([f"g{i}" in got for i in odd]) > 0.95
        assert np.mean([got.get(f"g{i}") == text[i] for i in odd]) > share


def test_author_links(spark):
    groups = [
        ["Robert Susan Nigobudo Rivas", "Bob Nigobudo", "NIGOBUDO, Robert", "R. Nigobudo", "Robert_Nigobudo", "Robert Nigobdo", "by Robert Nigobudo", "Dr. Robert Nigobudo (1951-)"],
        ["Olga Nigobudo", "Nigobudo, Olga."],
        ["University of Zaboteki", "Univ. of Zaboteki", "Zaboteki, University of", "The University of Zaboteki", "Universiity of Zaboteki"],
        ["Press of Zaboteki", "Pr. of Zaboteki"],
        ["Émile Zaboteki", "Zaboteki, É."],
    ]
    lone = ["Anónimo", "N/A", "", "-", "VV. AA.", None, "Plato"]
    rows = [(n, "x", i) for i, g in enumerate(groups) for n in g] + [(n, "x", 0) for n in lone] + [("Bob Nigobudo", "x", 0)]
    got = {r["name"]: r["entity"] for r in names.author_clusters(spark.createDataFrame(rows, "author string, name string, main int"), "author").collect()}
    want = {frozenset(g) for g in groups} | {frozenset(["Plato"])}
    have = {}
    for n, e in got.items():
        have.setdefault(e, set()).add(n)
    assert {frozenset(v) for v in have.values()} == want
    assert names.author_clusters(spark.createDataFrame([], "a string"), "a").count() == 0


def test_scan_noise_and_repair(spark):
    clean = "the quiet reader opened the heavy volume and noticed several careful remarks about modern printing methods near the margin"
    page = ["A LONG TITLE", "the quiet reader opened the heavy vol-", "ume and noticed several carefu1 rernarks", "about modern printing methods near", "the margin.", "- 12 -", "A LONG TITLE", "the quiet reader opened the heavy", "volume and noticed several careful", "remarks about modern printing methods", "near the margin.", "- 13 -"]
    rows = [(f"c{i}", clean, None, None) for i in range(30)] + [("scan", "\n".join(page), "A long title", None), ("n", None, None, None), ("e", "", None, None)]
    df = spark.createDataFrame(rows, "id string, t string, h string, text string")
    lex = scans.lexicon(df, "t")
    out = {r["id"]: r for r in scans.scan_noise(df, lex, "id", "t", "h").collect()}
    assert {(x["line_no"], x["kind"]) for x in out["scan"]["noise"]} == {(1, "header"), (2, "hyphen"), (3, "chars"), (6, "page"), (7, "header"), (12, "page")}
    text = out["scan"]["text"]
    assert "heavy volume and noticed several careful remarks about" in text and "12" not in text and "TITLE" not in text
    assert out["n"]["text"] is None and out["e"]["noise"] == [] and not out["c0"]["noise"]


def test_words_run_together_or_parted_are_decoded():
    known = "the quiet reader opened the heavy volume and noticed several careful remarks about modern printing methods near the margin"
    lex = scans.build_lexicon([(w, 30) for w in set(known.split())], 31)
    page = ["the quiet reader opened", "the heavyvolume and noticed", "several care ful remarks", "about modern printing", "methodsnearthe margin.", "Zusoven noticed the quiet", "reader near the prin", "ting methods and Zusoven"]
    found, text = scans.analyse("\n".join(page), None, None, lex)
    assert {(2, "chars"), (3, "chars"), (5, "chars")} == set(found)
    assert "the heavy volume and noticed several careful remarks about modern printing methods near the margin." in text and "Zusoven" in text
    assert [w for *_, w in scans.decode(("care", "ful"), frozenset({0}), lex)] == ["careful"]
    assert [w for *_, w in scans.decode(("quiet", "reader"), frozenset({0}), lex)] == ["quiet", "reader"]
    # the path is the cheapest of all partitions
    import functools

    def brute(s, border):
        @functools.lru_cache(None)
        def best(p):
            if p == len(s):
                return 0.0
            out = 1e9
            for q in range(p + 1, len(s) + 1):
                c = lex.cost(s[p:q])
                if c is None and q - p > 3 and scans.key(s[p:q]) in lex.keys:
                    c = lex.cost(lex.keys[scans.key(s[p:q])]) + scans.CONFUSED
                if p == 0 and q == len(s):
                    c = min(c if c is not None else 1e9, scans.UNKNOWN + scans.PER_LETTER * len(s))
                if c is not None:
                    out = min(out, (scans.BETWEEN if p else 0) + c + best(q))
            return out

        return best(0)

    for s in ("heavyvolume", "thequietreader", "carefu1remarks", "zzzz", "nearthemargin", "volumez"):
        path = scans.decode((s,), frozenset(), lex)
        cost = 0.0
        for p, q, w in path:
            c = lex.cost(w)
            cost += (scans.BETWEEN if p else 0) + (scans.UNKNOWN + scans.PER_LETTER * len(w) if c is None else c + (scans.CONFUSED if w != s[p:q] else 0))
        assert abs(cost - brute(s, None)) < 1e-9


def test_stream_is_decoded_with_neighbours_and_confusions_at_once():
    known = "the quiet reader opened the heavy volume and noticed several careful remarks about modern printing methods near margin"
    lex = scans.build_lexicon([(w, 300) for w in set(known.split())] + [("them", 3), ("care", 3), ("fui", 3)], 3000, 3)

    def read(text, noise):
        found, new = scans.analyse("the quiet\nreader opened\nthe heavy\nvolume and\nnoticed several\ncareful remarks\nabout modern\n" + text, None, None, lex)
        assert {x for x in found if x[1] == "chars"} == {(n, "chars") for n in noise}
        return new

    # the border has slipped into a known word, which alone looks right
    assert "modern the margin near" in read("them argin near", {8})
    # one word parted in two, of which the second is misread, and is a known word by itself when repaired alone
    assert "several careful remarks" in read("several care fu1 remarks", {8})
    # a name beside does not keep words run together, nor does a part that is known
    assert "Zusoven heavy volume Kedibor" in read("Zusoven heavyvolume Kedibor", {8})
    assert "noticed careful remarks" in read("noticed ca re ful remarks", {8})
    # the stream goes on over line ends and page furniture, and known words side by side stay
    assert "of printing methods" in read("of prin\nting methods", set())
    assert "the several remarks" in read("opened the sev\n\n- 12 -\n\neral remarks\nnear the margin", set())
    assert "care fui near" in read("care fui near", set())


def test_confusions_are_found_at_any_length():
    long = "w" + "undersameigenartigkeit" * 3
    lex = scans.build_lexicon([(long, 30), ("remarks", 30)], 31)
    assert lex.search(long.replace("m", "rn")) == long and lex.search("rernarks") == "remarks" and lex.search("zzz") is None


def test_breaks_of_paragraphs_depend_on_their_length():
    lines = ["der alte Leser sah das schwere", "", "Buch und las es dann ganz bis", "", "Ende und ging langsam wieder", "", "Heim in sein stilles altes Haus", "", "um dort zu ruhen und zu lesen", "", "bis zum Abend jenes langen Tags."]
    kinds = ["blank" if not x else "text" for x in lines]
    fixed = {i: x for i, x in enumerate(lines) if x}
    parts = scans._paragraphs(lines, kinds, fixed).split("\n\n")
    # alone, every break before a capital would be the cheaper choice; a paragraph of one full line is not
    assert len(parts) < 4 and all(len(p) > 40 for p in parts)


@needs
def test_subjects_of_held_out_samples(spark):
    seed = spark.read.parquet(f"{D}/topic_seed.parquet")
    train, test = seed.where("seed_id % 4 <> 0"), seed.where("seed_id % 4 = 0")
    m = subjects.fit(seed, "text", train)
    got = {int(r["id"]): r["subject"] for r in subjects.subjects(test, m, "seed_id", "text").collect()}
    want = {r["seed_id"]: r["topic"] for r in test.collect()}
    assert np.mean([got.get(k) == v for k, v in want.items()]) > 0.9
    odd = spark.createDataFrame([("a", None), ("b", ""), ("c", "x y z"), ("d", "| a | b |")], "id string, t string")
    assert subjects.subjects(odd, m, "id", "t").count() == 0 and subjects.slices(odd, m, "id", "t").count() == 4


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="needs the vocabulary")
def test_token_counts_equal_the_tokenizer(spark):
    tiktoken = pytest.importorskip("tiktoken")
    rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=rank, special_tokens={})
    rng = random.Random(1)
    texts = ["", " ", "a", "aaaaaaaa" * 50, "Привет, мир!", "naïve café’s", "x  \n\n y\t z", "don't we'll", "日本語テキスト", "😀🎉", "".join(rng.choice("abc \n.,é1") for _ in range(5000))]
    texts += ["".join(chr(rng.randrange(32, 700)) for _ in range(60)) for _ in range(40)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(99, None, 1), (1, texts[1], 1), (None, "x", 1)]
    got = dict(tokens.token_counts(spark.createDataFrame(rows, "id int, t string, row int"), "id", "t").collect())
    assert got == {**{i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts)}, 99: 0}
    assert tokens.token_counts(spark.createDataFrame([], "id int, t string"), "id", "t").count() == 0


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="needs the vocabulary")
def test_which_token_may_follow_equals_merging():
    rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    v = tokens.Vocabulary(rank)

    def merged(b):
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    rng = random.Random(9)
    common = sorted(rank, key=rank.get)[:3000]
    for _ in range(20_000):
        a, b = rng.choice(common), rng.choice(common)
        assert v.follows(rank[a], rank[b]) == (merged(a + b) == [a, b])


def test_bm25_matches_formula():
    from collections import Counter

    docs = [["a", "b", "b", "c"], ["b", "c"], ["d"], []]
    cs = [Counter(d) for d in docs]
    code = lambda w: zlib.crc32(w.encode())
    df = np.zeros(packing.PLACES, np.int32)
    for w, n in (("a", 7), ("b", 3), ("c", 40), ("d", 1)):  # of all texts, not of these four
        df[code(w) & (packing.PLACES - 1)] = n
    index = packing.Index(100, 2.5, df)
    post = packing.Postings([np.array([code(w) for w in c], np.uint32).tobytes() for c in cs], [np.array(list(c.values()), np.uint16).tobytes() for c in cs], index)
    for i, q in enumerate(cs):
        got = post.scores(i)
        for j, c in enumerate(cs):
            want = 0.0
            for w in q:
                d = df[code(w) & (packing.PLACES - 1)]
                if c[w] and sum(w in x for x in cs) > 1:
                    want += np.log1p((100 - d + 0.5) / (d + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(docs[j]) / 2.5))
            assert abs(got[j] - want) < 1e-4


def test_scattered_related_texts_are_packed_together(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 40), rng.randrange(20, 90)) for i in range(3000)]
    kin = rng.sample(range(3000), 24)
    for i in kin:
        rows[i] = (i, f"{rows[i][1]} kinword kinword othersign othersign thirdmark", 50)
    df = spark.createDataFrame(rows, "id int, text string, tokens int")
    out = packing.pack_texts(df.drop("tokens"), df.select("id", "tokens"), [(1, 400)], "id", "text").collect()
    at = {int(r["id"]): r["container"] for r in out}
    together = sum(at[i] == at[j] for i, j in itertools.combinations(kin, 2))
    assert together >= 30  # of 276; by chance hardly one
    fill = sum(r["tokens"] for r in out) / (400 * len(set(at.values())))
    assert fill > 0.985


def test_packing_invariants(spark):
    rng = random.Random(2)
    n = 1500
    rows = [(i, words(rng, rng.randrange(1, 9)), rng.choice([0, 1, 5, 30, 60, 99, 100, 101, 250, 1000])) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, text string, tokens int")
    p = packing.pack_texts(df.drop("tokens"), df.select("id", "tokens"), [(1, 100), (2, 700), (3, 0)], "id", "text", shard=200)
    out = p.collect()
    size = {str(r[0]): r[2] for r in rows}
    for spec, cap in ((1, 100), (2, 700)):
        own = [r for r in out if r["spec_id"] == spec]
        total, box = {}, {}
        for r in own:
            total[r["id"]] = total.get(r["id"], 0) + r["tokens"]
            box[r["container"]] = box.get(r["container"], 0) + r["tokens"]
        assert total == size and max(box.values()) <= cap
        assert all(size[r["id"]] > cap for r in own if r["part"] > 0)
        assert sum(box.values()) / (cap * len(box)) > 0.97
    assert packing.pack_texts(df.limit(0), df.select("id", "tokens").limit(0), [(1, 10)], "id", "text").count() == 0


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="needs the vocabulary")
def test_packing_counts_the_tokens_in_its_one_pass_over_the_texts(spark):
    tiktoken = pytest.importorskip("tiktoken")
    rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=rank, special_tokens={})
    rng = random.Random(4)
    texts = ["", " ", "a", "a" * 400, "ab" * 900, "-" * 3000, "naïve café’s", "x  \n\n y\t\x85 z", "don't we'll 'twas", "日本語テキスト", "😀🎉 𝔸𝔹 𝟘𝟙 𐍈", "½² Ⅷ ٣٤", "\ue060\ue07c .\ue002"]
    texts += ["".join(chr(rng.randrange(1, 700)) for _ in range(80)) for _ in range(60)]
    rows = [*enumerate(texts), (998, None), (2, texts[2]), (3, "short"), (None, "x")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    out = packing.pack_texts(df, None, [(1, 50), (2, 4000)], "id", "text").collect()
    want = {**{str(i): len(enc.encode_ordinary(t)) for i, t in enumerate(texts)}, "998": 0}
    for spec, cap in ((1, 50), (2, 4000)):
        own = sorted((int(r["id"]), r["token_from"], r["part"], r["tokens"]) for r in out if r["spec_id"] == spec)
        # a text is whole, or cut into full containers and a rest, without a gap
        assert own == [(int(i), k * cap, k, min(cap, n - k * cap)) for i, n in sorted(want.items(), key=lambda x: int(x[0])) for k in range(max(1, -(-n // cap)))]
    # small caches and long pieces do not change a count
    few = tokens.PieceCounts(tokens.Vocabulary(rank), most=3, short=5)
    assert [few.tokens(t) for t in texts] == [len(enc.encode_ordinary(t)) for t in texts]


def test_mixing_meets_shares_and_caps(spark):
    rng = random.Random(4)
    docs = [(i, "big", rng.randrange(1, 300)) for i in range(3000)] + [(10_000 + i, "mid", rng.randrange(1, 300)) for i in range(600)] + [(20_000 + i, "tiny", 50) for i in range(10)] + [(1, None, 5), (2, "mid", None), (3, "mid", 0), (4, "other", 9)]
    df = spark.createDataFrame(docs, "doc int, source string, tokens int")
    t = spark.createDataFrame([("p", "big", 0.5, 2), ("p", "mid", 0.4, 4), ("p", "tiny", 0.1, 3), ("p", "absent", 0.0, 3), ("q", "mid", 1.0, 1)], "profile string, source string, target_share double, max_repeats int")
    picked, shares = mixing.mix(df, t, "doc", "source", "tokens")
    s = {(r["profile"], r["source"]): r for r in shares.collect()}
    assert s["p", "tiny"]["capped"] and s["p", "tiny"]["tokens"] == 3 * 500
    for k in (("p", "big"), ("p", "mid")):
        assert abs(s[k]["tokens"] - s[k]["budget"]) < 0.01 * s[k]["budget"]
    assert s["p", "absent"]["tokens"] == 0
    caps = {("p", "big"): 2, ("p", "mid"): 4, ("p", "tiny"): 3, ("q", "mid"): 1}
    assert all(1 <= r["copies"] <= caps[r["profile"], r["source"]] for r in picked.collect())
    a, b = mixing.mix(df.limit(0), t, "doc", "source", "tokens")
    assert a.count() == 0 and b.count() == 5
    # at the feasible total every source has its share
    met = [r for r in mixing.mix(df, t, "doc", "source", "tokens", totals="feasible")[1].collect() if r["profile"] == "p"]
    assert all(abs(r["share"] - r["target_share"]) < 0.01 for r in met) and {r["feasible_total"] for r in met} == {15_000.0}


def test_capture_rate_counts_pairs_never_seen():
    rng = random.Random(1)
    hits = [sum(rng.random() < 0.2 for _ in range(8)) for _ in range(20_000)]
    seen = [h for h in hits if h]
    assert abs(neardup.capture_rate(sum(seen) / len(seen), 8) - 0.2) < 0.01 < sum(seen) / len(seen) / 8 - 0.2


def test_common_family_name_parts_by_given_names(spark):
    rng = random.Random(4)
    given = sorted({"".join(rng.choice("bdglmnrst") + rng.choice("aeio") for _ in range(4)) for _ in range(300)})
    rows = [(f"{g.title()} Garcia",) for g in given] + [("Wilhelmina Garcia",), ("Wilhelmna Garcia",), ("Wilhelmina Garca",), ("GARCIA, Wilhelmina",)]
    df = spark.createDataFrame(rows, "a string")
    view = df.select(F.col("a").alias("cid"), F.lit(False).alias("org"), F.lit("garcia").alias("main"), F.array().cast("array<string>").alias("kind"), F.array(F.lower(F.split("a", " ")[0])).alias("g"), F.lit("").alias("s2"))
    assert names._pairs(view).count() < 3 * len(rows)  # not the square of the block
    got = {r["name"]: r["entity"] for r in names.author_clusters(df, "a").collect()}
    assert len({got[n] for n in ("Wilhelmina Garcia", "Wilhelmna Garcia", "Wilhelmina Garca", "GARCIA, Wilhelmina")}) == 1


FINNISH = "Vanha kirjastonhoitaja avasi raskaan kirjan ja katseli pitkään kellastuneita sivuja. Ulkona satoi hiljaa, ja lukusalin ikkunat olivat huurteessa.\nKukaan ei puhunut mitään, mutta jokainen kuuli, kuinka sivut kääntyivät. Illalla hän palasi kotiin ja kirjoitti päiväkirjaansa muutaman rivin."
POLISH = "Stary bibliotekarz otworzył ciężką książkę i długo przyglądał się pożółkłym stronom, zanim zaczął czytać na głos. Nikt nie odpowiadał, a za oknem padał deszcz."
TURKISH = "Yaşlı kütüphaneci ağır kitabı açtı ve sayfalara uzun süre baktı, sonra yüksek sesle okumaya başladı. Dışarıda yağmur yağıyordu ve kimse konuşmuyordu."


@needs
def test_quality_kinds(spark):
    lang = quality.language(spark.read.parquet(f"{D}/topic_seed.parquet"))
    prose = spark.read.parquet(f"{D}/topic_seed.parquet").orderBy("seed_id").select("text").limit(4).collect()
    rng = random.Random(3)
    shuffled = " ".join("".join(rng.sample(w, len(w))) for w in (prose[0][0] + " " + prose[1][0]).split())
    cases = [(p[0], "prose") for p in prose] + [(p[0].lower().replace(".", ""), "prose") for p in prose] + [(t, "prose") for t in (FINNISH, POLISH, TURKISH)]
    cases += [("- El fármaco\n- La dosis\n- La fiebre\n- El tumor", "list"), ("la dosis, 12\nla fiebre, 4, 9\nel tumor, 77", "list"), ("| a | b |\n|---|---|\n| la fiebre | 2 |\n| el tumor | 4 |", "table"), ("la dosis\t1\t2\nel tumor\t3\t4\nla fiebre\t5\t6", "table"), ("xk qv zzt " * 9, "junk"), ("la dosis " * 60, "junk"), ("", "junk"), (None, "junk"), ("%;[:;+/§ < *:¤ .<[¶ &:}", "junk"), (shuffled, "junk"), ("3f a0 9b 1c e7 00 4d b2 c8 5e\n" * 2 + "7a b1 0c 2d f9 88 13 6e a4 d0", "junk")]
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(cases)], "doc_id int, text string, kind string")
    got = {r["id"]: r["kind"] for r in quality.quality(df, lang, "doc_id", "text").collect()}
    assert got == {i: k for i, (_, k) in enumerate(cases)}
    assert quality.quality(df.limit(0), lang, "doc_id", "text").count() == 0


def test_language_of_texts_is_learned_from_all_samples(spark):
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("aeéiknоtрs") for _ in range(rng.randrange(2, 5))) for _ in range(8)) for _ in range(2300)]
    got = quality.language(spark.createDataFrame([(t,) for t in [*texts, "", None]], "text string"))
    n = {}
    for t in texts:
        for w in re.findall(r"\w+", t):
            n[w] = n.get(w, 0) + 1
    assert got.common == {w for w, c in n.items() if c >= 2}
    want = quality.learn([*texts, ""])
    assert np.array_equal(got.order, want.order) and got.common == want.common
    # rare words of many are not common, however many there are: one in COMMON words or more
    many = quality.learn(["the " * 250_000 + "rare " * 2 + "seldom " * 3])
    assert many.common == {"the", "seldom"}


def test_each_measure_decides_some_text(monkeypatch):
    lang = quality.learn([FINNISH, POLISH] * 2)
    own = FINNISH.replace("\n", " ").split()
    nested = "\n".join(f"{' '.join(own[i : i + 9])} loppu kerrotaan kokonaan.\n   {' '.join(own[i + 3 : i + 14])} mukana kaikki" for i in range(0, 18, 3))
    wrapped = "kirjan sivut olivat vanhoja ja\nniiden reunat olivat kuluneet, mutta\nteksti oli luettavissa ja hän luki\nsitä ääneen koko illan kunnes väsyi\nja sulki kirjan ja nukahti tuoliin"
    k = lambda t: quality.measure(t, lang)[1]
    assert quality.measure(nested, lang)[0][quality.NAMES.index("indent_period")] > 0.9
    assert quality.measure(wrapped, lang)[0][quality.NAMES.index("fill_ratio")] >= 0.75
    items = {"mark_ratio": "- Vanha kirja jonka sivut olivat kuluneet ja jonka hän luki ääneen illalla kotonaan.\n- Uusi kirja jonka hän avasi vasta seuraavana aamuna ennen kuin lähti taas töihin.", "start_ratio": "kirja: vanha aineisto ja uusi tutkimus sekä niiden pitkä historia tässä näin.\n" * 2 + "kirja: toinen aineisto ja kolmas tutkimus sekä muu historia tässä näin kaikki.\nkirja: neljäs aineisto ja viides tutkimus sekä lyhyt historia tässä näin.", "indent_period": nested}
    for name, text in items.items():
        assert k(text) == "list"
        with monkeypatch.context() as m:
            m.setitem(quality.BY_SHAPE, name, 0.0)
            assert k(text) == "prose", name
    signs = [("(", ") =", "[x]; /"), ("{", "} &", '"y": ='), ('"', '" +', "(z) / ="), ("[", "] =", "{w}; +")]
    lines = {
        "short_lines": "vanha kirja\nuusi tutkimus\nlyhyt historia\npitkä ilta",
        "number_lines": "\n".join(" ".join(own[i : i + 3 + i % 7]) + f" vuonna {1900 + 7 * i}, ja sitten vielä hiljaa luettu" + " kaikki tekstit" * (3 if i == 4 else 0) for i in range(0, 24, 2)),
        "sign_lines": "\n".join(f"{x}{own[i]}{y} {' '.join(own[i + 1 : i + 4 + i % 5])} {z} {' '.join(own[i + 5 : i + 8])}!" + " / kaikki = (tekstit)" * (3 if i == 4 else 0) for i, (x, y, z) in enumerate(signs * 3)),
    }
    for name, text in lines.items():
        assert k(text) == "list", name
        with monkeypatch.context() as m:
            m.setitem(quality.BY_LINE, name, 0.0)
            m.setattr(quality, "NUMBERS_AND_SIGNS", 0.0)
            assert k(text) == "prose", name
    assert k(wrapped) == "prose"
    padded = "\n".join(("kirja      " + w + " mukana" if i % 2 else "tutkimus x " + w + " mukana").ljust(27, "a") for i, w in enumerate(["vanha", "uusi", "lyhyt", "toinen", "pitkä", "hidas", "nopea"]))[: 27 * 7 + 6]
    padded = padded + "\n" + "sivu       kaikki mukanaaaa"
    assert 0.45 < quality.measure(padded, lang)[0][quality.NAMES.index("align_ratio")] < 0.6 and k(padded) == "table"
    with monkeypatch.context() as m:
        m.setattr(quality, "PADDED", 0.0)
        assert k(padded) != "table"
