"""Variant spellings of authors, linked by merge and rematch.

Every distinct spelling is read into a profile: family names, given names or initials, or the kind and place of an
organisation. Profiles that agree meet in blocks (family and given name, one of them with a letter dropped, so that any
single typing error meets; initials and organisations by the name with a letter dropped and the first initial). Merging matched profiles unions their spellings, given names and initials; the richer
profiles are blocked again, until a round merges nothing. A spelling with initials only joins a profile when a single
one fits it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.operators.graph import connected_components
from quire.session import arrow_rows, discard, materialize, ship

#: Short forms of given names, without accents.
NICKNAMES = {
    "alexander": "alex sasha alec sandy xander", "antonio": "toni tony toninho tonho tono", "beatriz": "bea bia trixie", "bjorn": "bjoern", "chloe": "clo", "dmitri": "dima mitya dmitry dimitri",
    "dolores": "lola loli", "edward": "ed eddie ted teddy ned", "elizabeth": "beth liz lizzy betty eliza lisa bess", "emile": "mile", "enrique": "quique kike", "francesca": "franca cesca",
    "francisco": "paco pancho chico curro kiko", "friedrich": "fritz fiete", "giuseppe": "beppe peppe pino", "guadalupe": "lupe lupita", "gunter": "guenter", "heinrich": "heinz heiner heini",
    "helene": "lene leni", "ignacio": "nacho iñaki", "ines": "nesa", "isabel": "isa chabela bela ysabel", "joao": "joaozinho janjao joca", "johannes": "hans hannes jo", "jose": "pepe ze josele",
    "jurgen": "juergen", "kathe": "kaethe", "katherine": "kathy kate katie kat", "lea": "leah", "luigi": "gigi gino", "manuel": "manolo manu lolo", "margaret": "maggie peggy meg marge greta",
    "mercedes": "merche meche", "michael": "mike mick mickey misha", "nuria": "nuri", "oscar": "osc", "quirino": "quino", "ramon": "moncho monchu", "raul": "rulo", "richard": "dick rick rich richie",
    "robert": "bob rob bobby robbie bert", "rosario": "charo chayo", "susan": "sue susie suzy", "tatiana": "tania tanya tata", "terezinha": "teca tereza tete", "ulrich": "uli ulli utz", "ursula": "uschi ursel ula",
    "vadim": "vadik", "victor": "vic vito", "wanda": "wandzia", "wilhelm": "willi willy wim", "william": "bill will billy liam", "xenia": "ksenia", "yolanda": "yoli yola", "zacarias": "zaca", "zoe": "zoi", "alvaro": "alvarito", "olga": "olya",
}
_CANON = {n: g for g, names in NICKNAMES.items() for n in names.split()}
_CANON["fran"] = "f"  # short for more than one name: no more than an initial
#: Entries that name nobody.
NOBODY = {"", "-", "--", "?", "n/a", "na", "n.a.", "s/n", "null", "none", "nil", "anonimo", "anonymous", "anon", "anonym", "anonyme", "unknown", "unknown author", "desconocido", "autor desconocido", "various", "various authors", "varios", "varios autores", "autores varios", "aa. vv.", "aa.vv.", "aavv", "vv. aa.", "vv.aa.", "vv aa", "autori vari", "et al.", "sin autor", "no author", "inconnu", "unbekannt", "desconhecido", "неизвестен", "author", "autor"}
_TITLE = re.compile(r"^(?:(?:by|por|von|par|di|de|dr|dra|drs|prof|profa|sir|mr|mrs|ms|mtro|mtra|lic|ing|d|dona|don|sr|sra|herr|frau|the)\b\.?\s+)+", re.I)
_TAIL = re.compile(r"\s*(?:\((?:[^)]*)\)|\[[^\]]*\]|,?\s*(?:ph\.?\s?d|m\.?d|jr|sr|s\.\s?a|ltd|inc|co|gmbh|llc|s\.\s?l|ltda)\.?|&\s*co\.?|,?\s*et\s+al\.?|,?\s*y\s+otros)\s*$", re.I)
_SMALL = {"de", "of", "for", "in", "the", "la", "el", "los", "las", "du", "des", "do", "da", "fur", "y", "and", "et", "und", "e", "del"}
#: Words that open the name of an organisation, without accents.
ORGANISATIONS = "universidad university universite universitat instituto institute institut centro center centre editorial editora editions press verlag sociedad society societe academie academia academy fundacion foundation fundacao stiftung museo museum biblioteca library grupo group documentacion estudios studies lectura prensa imprenta".split()


def fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c)).replace("ß", "ss").replace("ø", "o").replace("ł", "l")


def near(a: str, b: str) -> bool:
    """At most one letter inserted, dropped, exchanged or swapped with its neighbour."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or len(b) < 4:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])
    return a[i:] == b[i + 1 :]


def _abbreviates(short: str, word: str) -> bool:
    """Whether a word is a short form: the same first letter and its letters in order."""
    if not short or not word or short[0] != word[0] or len(short) >= len(word):
        return False
    it = iter(word)
    return all(c in it for c in short)


def tokens(name: str) -> tuple[list[str], list[str] | None]:
    """Folded words before and after the comma of an inverted name."""
    s = name.replace("_", " ").replace("\xa0", " ")
    s = unicodedata.normalize("NFKC", s)
    s = " ".join(s.split())
    for _ in range(3):
        s = _TAIL.sub("", _TITLE.sub("", s)).strip(" ,;")
    s = re.sub(r"\.(?=\S)", ". ", s)
    parts = s.split(",", 1)
    left = [fold(w).strip(".'’\"()[]") for w in re.split(r"[\s\-]+", parts[0])]
    right = [fold(w).strip(".'’\"()[]") for w in re.split(r"[\s\-]+", parts[1])] if len(parts) > 1 else None
    return [w for w in left if w], [w for w in right if w] if right is not None else None


def nobody(name: str | None) -> bool:
    return name is None or fold(" ".join(name.split())) in NOBODY or not re.search(r"[^\W\d_]", name)


def _org_word(w: str) -> bool:
    return any(near(w, o) or (len(w) >= 4 and _abbreviates(w, o) and o.startswith(w)) for o in ORGANISATIONS) or w in {"ed", "edit", "edl", "ac", "acad", "univ", "inst", "soc", "ctro", "fund", "fdn", "vlg", "verl", "pr", "doc", "stud"}


def read_name(name: str, given: frozenset[str], second: frozenset[str]) -> dict | None:
    """The profile of one spelling; None for entries that name nobody."""
    if nobody(name):
        return None
    left, right = tokens(name)
    raw = left + (right or [])
    if not raw:
        return None
    joined = [w for w in raw if w not in _SMALL]
    organisation = any(_org_word(w) for w in joined[: -1 if right is None else None]) or (right is not None and any(_org_word(w) or w in {"of", "de", "u"} for w in right) and (any(w in _SMALL for w in right) or any(_org_word(w) for w in right)))
    first = name.replace("_", " ").split()[0] if name.split() else ""
    if right is None and len(left) == 2 and first.lower() == "ed":
        organisation = False  # the given name; the short form of a publisher has a point
    if right is None and left[0] == "u" and len(left) > 2 and left[1] in _SMALL:
        organisation = True
    if not organisation and right is None and len(left) == 2 and re.fullmatch(r"[A-Z]{2,4}", first) and name.split()[1] != name.split()[1].upper():
        organisation = True
        joined = [*left[0], left[1]]
    if not organisation and any(w in ("of", "for") for w in left):
        organisation = True
    if organisation:
        if right is not None:
            place, kind = [w for w in left if w not in _SMALL], [w for w in right if w not in _SMALL]
        else:
            place, kind = joined[-1:], joined[:-1]
        return {"org": True, "main": "".join(place), "kind": kind, "g": [], "s2": ""}
    if right is not None:
        fam, giv = left, right
    elif len(left) == 1:
        fam, giv = left, []
    else:
        known = lambda w: w in given or w in _CANON or w in NICKNAMES
        if len(left[-1]) == 1 and len(left[0]) > 1 and not (len(left) > 2 and known(left[0])):
            fam, giv = left[:-1], left[-1:]
        else:
            k = 0
            while k < len(left) - 1 and (k == 0 or known(left[k]) or len(left[k]) == 1):
                k += 1
            if len(left) - k == 2 and not (left[-1] in second or len(left[-1]) == 1) and any(near(left[k], w) for w in given if w[:1] == left[k][:1] or w[1:2] == left[k][1:2]):
                k += 1  # a mistyped middle name
            if len(left) - k == 1 and (left[-1] in second or len(left[-1]) == 1) and k >= 2 and not known(left[k - 1]) and len(left[k - 1]) > 1:
                k -= 1
            giv, fam = left[:k], left[k:]
    main, s2 = (fam[0], "".join(fam[1:])) if fam else ("", "")
    return {"org": False, "main": main, "kind": [], "g": [_CANON.get(w, w) for w in giv], "s2": s2}


def _same_given(a: str, b: str) -> bool:
    if len(a) == 1 or len(b) == 1:
        return a[:1] == b[:1]
    return near(a, b)


def fits(a: dict, b: dict) -> bool:
    """Whether two profiles may be one: family name within one typing error, nothing that contradicts."""
    typing = a["main"] != b["main"]
    if not near(a["main"], b["main"]):
        return False
    if a["org"] or b["org"]:
        if a["org"] != b["org"]:
            # initials before a place may be an organisation's
            o, p = (a, b) if a["org"] else (b, a)
            return (not typing or len(p["main"]) > 6) and len(p["g"]) >= 2 and all(len(w) == 1 for w in p["g"]) and [w[0] for w in o["kind"]] == p["g"] and not p["s2"]
        if len(a["kind"]) != len(b["kind"]):
            return False
        return all(x == y or (len(x) > 3 and near(x, y)) or _abbreviates(x, y) or _abbreviates(y, x) or (min(len(x), len(y)) == 1 and x[0] == y[0]) for x, y in zip(a["kind"], b["kind"])) and (not typing or len(a["main"]) > 6)
    if not a["g"] or not b["g"]:
        return False
    if a["s2"] and b["s2"] and not (near(a["s2"], b["s2"]) or (min(len(a["s2"]), len(b["s2"])) == 1 and a["s2"][0] == b["s2"][0])):
        return False
    if not _same_given(a["g"][0], b["g"][0]):
        return False
    if len(a["g"]) > 1 and len(b["g"]) > 1 and not _same_given(a["g"][1], b["g"][1]):
        return False
    wrong = typing + (len(a["g"][0]) > 1 < len(b["g"][0]) and a["g"][0] != b["g"][0])
    return wrong <= 1


_PROFILE = "org boolean, main string, kind array<string>, g array<string>, s2 string"


def _profiles(batches: Iterator[pa.RecordBatch], given: frozenset[str], second: frozenset[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(n, p) for n in b.column(0).to_pylist() if (p := read_name(n, given, second)) and p["main"]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1]["org"] for r in rows], pa.bool_()), pa.array([r[1]["main"] for r in rows], pa.string()), pa.array([r[1]["kind"] for r in rows], pa.list_(pa.string())), pa.array([r[1]["g"] for r in rows], pa.list_(pa.string())), pa.array([r[1]["s2"] for r in rows], pa.string())],
            ["name", "org", "main", "kind", "g", "s2"],
        )


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(role, word, beside): first words with the last, last words with the one before, of names without a comma."""
    for b in batches:
        rows = set()
        for n in b.column(0).to_pylist():
            if nobody(n):
                continue
            left, right = tokens(n)
            if any(_org_word(w) for w in left):
                continue
            if right is None and len(left) >= 2 and len(left[0]) > 1:
                rows.add(("first", left[0], left[-1]))
                if len(left) >= 3:
                    rows.add(("last", left[-1], left[-2]))
            elif right and len(left) >= 2:
                rows.add(("last", left[-1], left[-2]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["role", "word", "beside"])


def _dropped(c: Column) -> Column:
    """A word whole and with each letter dropped, where it is long enough for a typing error."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda k: F.concat(F.substring(c, F.lit(1), k - 1), F.substr(c, k + 1)))
    return F.when(F.length(c) >= 4, F.array_union(F.array(c), each)).otherwise(F.array(c))


def _pairs(view: DataFrame) -> DataFrame:
    """(a, b, pa, pb): pairs of clusters that may fit, each at least once.

    Two profiles with full given names share one typing error at most: they meet on the family name whole and the given
    name with a letter dropped, or the other way round, so a common family name parts by its given names. Profiles of
    initials, which are few to a name, and organisations meet on the name with a letter dropped and the initial.
    """
    g = F.coalesce(F.get("g", F.lit(0)), F.lit(""))
    v = view.select("cid", "org", "main", g.alias("first"), F.coalesce(F.substring(F.when(F.col("org"), F.get("kind", F.lit(0))).otherwise(g), 1, 1), F.lit("")).alias("initial"), F.struct("org", "main", "kind", "g", "s2").alias("p"))
    full = ~F.col("org") & (F.length("first") > 1)
    one = v.where(full).select("cid", "p", F.col("main").alias("k1"), F.explode(_dropped(F.col("first"))).alias("k2"), F.lit(0).alias("way"))
    two = v.where(full).select("cid", "p", F.explode(_dropped(F.col("main"))).alias("k1"), F.col("first").alias("k2"), F.lit(1).alias("way"))
    fine = one.union(two)
    wide = v.select("cid", "p", full.alias("full"), F.explode(_dropped(F.col("main"))).alias("k1"), F.col("initial").alias("k2"))
    side = lambda t, x: t.select(*[c for c in t.columns if c in ("k1", "k2", "way")], F.col("cid").alias(x), F.col("p").alias(f"p{x}"))
    met = side(fine, "a").join(side(fine, "b"), ["k1", "k2", "way"]).where("a < b").select("a", "b", "pa", "pb")
    short = side(wide.where(~F.col("full")), "a").join(side(wide, "b"), ["k1", "k2"]).where("a <> b")
    swap = F.col("a") > F.col("b")
    short = short.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), F.when(swap, F.col("pb")).otherwise(F.col("pa")).alias("pa"), F.when(swap, F.col("pa")).otherwise(F.col("pb")).alias("pb"))
    return met.union(short).distinct()


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, c = b.column(2).to_pylist(), b.column(3).to_pylist()
        keep = pa.array([fits(x, y) for x, y in zip(a, c)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(keep)


def author_clusters(names: DataFrame, col: str, least: int = 3, share: float = 5e-5) -> DataFrame:
    """(name, entity): every distinct spelling with the least spelling of its entity.

    Spellings of one profile are collapsed before blocking, so repeated or merely re-cased names cost one profile. Which
    words are given names or second family names is counted over all spellings: those in at least `least` of them and in
    the given share, which bounds what comes to the driver (a spelling has one first and one last word, so 1 / share words
    of each kind). Null, empty and nobody entries are left out; a name of one word only matches itself. An empty table
    gives an empty result.
    """
    ship(names.sparkSession)
    arrow_rows(names.sparkSession, 5000)
    n = materialize(names.select(F.col(col).cast("string").alias("name")).where("name is not null").distinct(), "au-names")
    w = materialize(n.mapInArrow(_words, "role string, word string, beside string").distinct(), "au-words")
    often = max(least, math.ceil(share * n.count()))
    first = materialize(w.where("role = 'first'").groupBy("word").count().where(F.col("count") >= often).select("word"), "au-given")
    given = frozenset(r[0] for r in first.collect())
    known = first.union(names.sparkSession.createDataFrame([(x,) for x in sorted(set(_CANON) | set(NICKNAMES))], "word string")).distinct()
    rest = w.where("role = 'last'").join(known, "word", "left_anti").join(known.select(F.col("word").alias("beside")), "beside", "left_anti")
    second = frozenset(r[0] for r in rest.groupBy("word").count().where(F.col("count") >= often).select("word").collect())
    spelled = materialize(n.mapInArrow(lambda it: _profiles(it, given, second), f"name string, {_PROFILE}"), "au-profiles")
    shape = ["org", "main", "kind", "g", "s2"]
    prof = materialize(spelled.groupBy(*shape).agg(F.min("name").alias("pid")), "au-shapes")
    cluster = prof.select("pid", F.col("pid").alias("cid"))
    while True:  # ends, as every round with an edge lowers the number of clusters
        # what is known of each cluster goes back to all its profiles: full given names and second family names
        mine = prof.join(cluster, "pid")
        rich = mine.where(~F.col("org")).groupBy("cid").agg(
            F.max_by("g", F.struct(F.size("g"), F.length(F.concat_ws("", "g")), F.concat_ws("", "g"))).alias("cg"), F.max(F.struct(F.length("s2"), "s2"))["s2"].alias("cs2")
        )
        p = mine.join(rich, "cid", "left")
        # the union of a cluster's spellings and initials is one more profile of it
        extra = p.where("cg is not null").select("cid", "org", "main", "kind", F.col("cg").alias("g"), F.coalesce("cs2", "s2").alias("s2"))
        view = materialize(p.select("cid", *shape).union(extra).distinct(), "au-view")
        fit = materialize(_pairs(view).mapInArrow(_match, "a string, b string").distinct(), "au-fit")
        # a cluster known by initials only, or by one full name among several, joins when one cluster alone fits it
        full = view.groupBy("cid").agg(F.max(F.when(F.col("org"), F.length(F.concat_ws("", "kind")) > F.size("kind") * 3).otherwise(F.coalesce(F.length(F.get("g", F.lit(0))) > 1, F.lit(False)))).alias("full"))
        f = fit.join(full.select(F.col("cid").alias("a"), F.col("full").alias("fa")), "a").join(full.select(F.col("cid").alias("b"), F.col("full").alias("fb")), "b")
        weak = f.where("fa <> fb").select(F.when(F.col("fa"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("fa"), F.col("a")).otherwise(F.col("b")).alias("b"))
        if f.where("fa and fb").limit(1).count():
            # full names merge first; the initials wait for the richer profiles
            edges = f.where("fa and fb").select("a", "b")
        else:
            single = weak.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("n")).where("n = 1").select("a", "b")
            edges = single if single.limit(1).count() else f.where("not fa and not fb").join(weak.select("a"), "a", "left_anti").join(weak.select(F.col("a").alias("b")), "b", "left_anti").select("a", "b")
        edges = materialize(edges, "au-edges")
        discard(view, fit)
        if not edges.limit(1).count():
            break
        comp = connected_components(edges)
        cluster = materialize(cluster.join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("pid", F.coalesce("component", "cid").alias("cid")), "au-cluster")
    return _named(spelled, prof, cluster, shape)


def _named(spelled: DataFrame, prof: DataFrame, cluster: DataFrame, shape: list[str]) -> DataFrame:
    m = materialize(spelled.join(prof, shape).join(cluster, "pid").select("name", "cid"), "au-named")
    return m.join(m.groupBy("cid").agg(F.min("name").alias("entity")), "cid").select("name", "entity")
