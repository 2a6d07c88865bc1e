"""Capping, repeated lines and residue against brute force and on edge cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weblens.llm import cap as C
from weblens.llm import lines as L
from weblens.llm import residue as Z
from weblens.llm.common import site


def test_site(spark):
    cases = {"HTTPS://WWW.Foo.Example:443/x": "foo.example", "http://a.b.foo.test./": "foo.test", "ftp://foo.test/": None, "mailto:a@foo.test": None, "": None, None: None, "https://u:p@foo.test/": "foo.test", "http://localhost/x": "localhost", "about:blank": None, "https://foo.test?x=a.b": "foo.test"}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r["u"]: r["s"] for r in df.select("u", site(F.col("u")).alias("s")).collect()} == cases


def brute_cap(rows, cap):
    by = {}
    for key, by_, score in {(k, b, None if s is not None and s != s else s) for k, b, s in rows}:
        if by_ is not None:
            by.setdefault(by_, []).append((score is None, -(score or 0.0), key))
    return {k for xs in by.values() for _, _, k in sorted(xs)[cap:]}


def hits(spark, rows):
    return spark.createDataFrame(rows, "k long, c string, s double").withColumn("_key", F.lit("x")).withColumn("_rank", F.lit(1))


def test_cap_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a"] * 20 + ["b", "c", None]), rng.choice([None, float("nan"), -0.5, 0.5, rng.random()])) for i in range(800)]
    rows += rows[::40]
    df = hits(spark, rows)
    for cap in (1, 7, 20):
        kept, dropped = C.cap_contributors(df, F.col("c"), "k", "s", cap=cap)
        got = {r["k"] for r in dropped.collect()}
        assert got == brute_cap(rows, cap)
        assert {r["k"] for r in kept.collect()} == {r[0] for r in rows} - got


def test_large_caps_are_ranked_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(C, "LOCAL_CAP", 5)
    rng = random.Random(2)
    rows = [(i, rng.choice(["a"] * 9 + ["b"]), round(rng.random(), 1)) for i in range(500)]
    _, dropped = C.cap_contributors(hits(spark, rows), F.col("c"), "k", "s", cap=30)
    assert {r["k"] for r in dropped.collect()} == brute_cap(rows, 30)


def test_sampling_prefers_high_scores_and_repeats(spark):
    rows = [(i, "a", 1.0 if i % 2 else 0.0) for i in range(2000)]
    df = hits(spark, rows)
    one, two = ({r["k"] for r in C.cap_contributors(df.repartition(n), F.col("c"), "k", "s", cap=200, temperature=0.5, seed=9)[0].collect()} for n in (2, 5))
    assert one == two and len(one) == 200
    assert 0.7 < sum(k % 2 for k in one) / 200 < 0.98  # weights e^2 to 1: nine in ten at first


def test_cap_by_share_and_empty(spark):
    df = hits(spark, [(i, "a", 0.1) for i in range(10)] + [(i, "b", 0.1) for i in range(10, 12)])
    kept, _ = C.cap_contributors(df, F.col("c"), "k", "s", share=0.25)
    assert sorted(r["k"] for r in kept.collect()) == [0, 1, 2, 10, 11]
    kept, dropped = C.cap_contributors(df.limit(0), F.col("c"), "k", "s", cap=3)
    assert kept.count() == dropped.count() == 0


def norm(x):
    return re.sub("[0-9]+", "0", re.sub(r"\s+", " ", x.lower()).strip())


def test_repeated_lines_match_brute_force(spark):
    rng = random.Random(4)
    pool = ["Share this story", "© 2024 Foo News", "SHARE  this story", "Posted 3 May 2024 by the Foo desk and others of the team", "Only once", "", "  "]
    rows = []
    for i in range(60):
        host = rng.choice(["https://a.foo.test/x", "https://foo.test/y", "https://bar.test/z", None, "about:blank"])
        body = [re.sub("[0-9]+", lambda m: str(rng.randint(1, 99)), rng.choice(pool)) for _ in range(6)] + [f"Unique sentence {'abcdefgh'[i % 8]}{'mnopqrst'[i // 8]} of this document."]
        rows.append((i, host, "\n".join(body)))
    rows += rows[:5] + [(100, "https://foo.test/", None), (101, "https://foo.test/", ""), (102, "https://foo.test/", "word " * 50_000)]
    df = spark.createDataFrame(rows, "k long, u string, t string").withColumn("site", F.lit("clash")).withColumn("line_no", F.lit(3))
    seen: dict = {}
    for k, u, t in rows:
        s = {"https://a.foo.test/x": "foo", "https://foo.test/y": "foo", "https://foo.test/": "foo", "https://bar.test/z": "bar"}.get(u)
        if s and t:
            for n, x in enumerate(t.split("\n"), 1):
                if norm(x):
                    seen.setdefault((s, norm(x)), set()).add((k, n))
    want = {p for xs in seen.values() if len({k for k, _ in xs}) >= 5 for p in xs}
    found = L.repeated_exact(df, "k", "u", "t")
    assert {tuple(r) for r in found.collect()} == want
    cleaned = {r["k"]: r["t"] for r in L.without_lines(df.dropDuplicates(["k"]), found, "k", "t").collect()}
    for k, _, t in rows:
        assert cleaned[k] == (t if not t else "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (k, n) not in want))
    assert L.repeated_exact(df.limit(0), "k", "u", "t").count() == 0


def test_near_duplicate_lines_form_clusters(spark):
    names = "Ada Bea Cyd Dan Eve Fay Gus Hal".split()
    text = "this long legal notice of the publisher tells every reader that quotes on the page may be late and are no offer to buy or sell any paper at all says {0}"
    rows = [(i, "https://foo.test/", f"{text.format(n)}\nnothing like it number {n} here") for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "k long, u string, t string")
    near = {tuple(r) for r in L.repeated_near(df, "k", "u", "t").collect()}
    assert near == {(i, 1) for i in range(8)}
    assert L.repeated_exact(df, "k", "u", "t").count() == 0


def test_exact_lines_are_those_of_clusters(spark, monkeypatch):
    seen, clusters = [], L.clusters
    monkeypatch.setattr(L, "clusters", lambda edges: seen.append(1) or clusters(edges))
    spelt = ["Read more from Anna Kowalska about rates", "read more from anna kowalska about rates", "Read MORE from Anna kowalska about  rates"]
    others = [f"Read more from {name} about gold" for name in ("Ada Bell", "Bea Cole", "Cyd Dorn", "Dan Evers", "Eve Ford", "Fay Gold")]
    rows = [(i, "https://foo.test/", f"{spelt[i % 3]}\n{others[i]}") for i in range(6)]
    df = spark.createDataFrame(rows, "k long, u string, t string")
    assert {tuple(r) for r in L.repeated_exact(df, "k", "u", "t").collect()} == {(i, 1) for i in range(6)}
    assert {tuple(r) for r in L.repeated_near(df, "k", "u", "t").collect()} == {(i, n) for i in range(6) for n in (1, 2)}
    assert len(seen) == 2  # equality decides only within the near-duplicate clusters


def test_near_clusters_are_whole(spark):
    words = "alfa bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray".split()
    chain = [" ".join(words + [f"t{c}" for c in "abcdefgh"[:k]]) for k in range(8)]  # each alike to the next
    rows = [(i, f"exact line kept in all of these\n{chain[i]}") for i in range(8)]
    other = [" ".join([*words[:12], f"q{c}", *words[13:]]) for c in "abcdefghijkl"]  # half alike, each in one document
    rows += [(20 + i, x) for i, x in enumerate(other)]
    df = spark.createDataFrame([(k, "https://foo.test/", t) for k, t in rows], "k long, u string, t string")
    near = {tuple(r) for r in L.repeated_near(df, "k", "u", "t").collect()}
    exact = {tuple(r) for r in L.repeated_exact(df, "k", "u", "t").collect()}
    assert exact == {(i, 1) for i in range(8)} and near == exact | {(i, 2) for i in range(8)}


def test_names_and_weekdays_are_masked(spark):
    people = ["Anna Kowalska", "Bo Lind", "Çelik Öz", "Dora O’Neil", "Эльза Иванова", "Finn J. Maas", "Gil"]
    days = "Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag".split()
    rows = [(i, "https://foo.test/", f"By {p}, 3 min read\nQuestions? Write to {p if i < 6 else 'Gil Roe'} of our desk.\nAusgabe vom {d}\nThe Tall {p} Story Of Today") for i, (p, d) in enumerate(zip(people, days))]
    near = {tuple(r) for r in L.repeated_near(spark.createDataFrame(rows, "k long, u string, t string"), "k", "u", "t").collect()}
    assert near == {(i, n) for i in range(7) for n in (1, 2, 3)}


@pytest.mark.parametrize("few", [0, 16])
def test_links_match_all_pairs(monkeypatch, few):
    monkeypatch.setattr(L, "_FEW", few)
    rng = random.Random(5)
    for _ in range(200):
        base = [rng.choices("a b c d e f g h".split(), k=rng.randint(3, 40)) for _ in range(3)]
        texts = []
        for _ in range(12):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice("xyz")
            texts.append(" ".join(w))
        sets = [L._shingles(x) for x in texts]
        group = list(range(12))
        for i in range(12):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    group = [group[j] if g == group[i] else g for g in group]
        got = list(range(12))
        for i, j in L.links(texts):
            got = [got[i] if g == got[j] else g for g in got]
        assert {frozenset(i for i in range(12) if x[i] == v) for x in (got,) for v in x} == {frozenset(i for i in range(12) if x[i] == v) for x in (group,) for v in x}


RESIDUE = {
    "Hello {{ user.name }}, welcome": True, "Price: ${price} today": True, "<%= page.title %>": True, "[insert caption here]": True, "lorem ipsum dolor sit amet": True,
    "value undefined here": True, "[object Object]": True, "Your text here": True, "%PUBLISH_DATE%": True, "use `{{ x }}` in a template": False, "```\n{{ x }}\n```": False,
    "They saw “lorem ipsum” on the page": False, "« lorem ipsum » again": False, "> quoted {{ x }}": False, "A set {1, 2} of things": False, "plain text of an article": False, "": False, None: False,
    "rose 5% and fell 7% since": False, "She read “" + "long words " * 60 + "lorem ipsum” aloud": False, "“open and lorem ipsum": True, "```\n{{ never closed": False, "C# and F# are languages": False,
}


def test_residue_cases(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(RESIDUE)], "i long, t string")
    got = {r["i"] for r in df.where(Z.has_residue(F.col("t"))).select("i").collect()}
    assert {list(RESIDUE)[i] for i in got} == {t for t, yes in RESIDUE.items() if yes}


#: At least one text for every pattern of RESIDUE.
SPELLINGS = [
    "{{ x }}", "{% x %}", "<% x %>", "${x}", "#{x}", "[[x]]", "@@x@@", "*|x|*", "__x__", "%DATE%", "#DATE#", "{x}", "[insert name]", "[ad_placeholder]", "<your name>", "TODO", "FIXME", "TKTK", "[object Object]", "undefined", "NaN", "null null", "XX:XX",
    "lorem ipsum", *[f"{x} and dolor" for x in "consectetur adipiscing eiusmod incididunt ullamco excepteur cupidatat proident occaecat".split()], *[f"your {x} here" for x in "text headline title content name caption".split()], "sample headline goes here",
    "hier steht ihr text", "hier steht der text", "judul berita di sini", "su texto aquí", "tu texto aqui", "votre texte ici", "seu texto aqui", "twój tekst tutaj", "twoj tekst tutaj", "ваш текст здесь",
]


def test_residue_signs_pass_every_spelling(spark):
    texts = sorted({f"Before {y} after." for x in SPELLINGS for y in (x, x.lower(), x.title(), x.upper(), x.replace(" ", "\n"), x.replace(" ", "  ").upper())})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = {p: {r["t"] for r in df.where(F.col("t").rlike(p)).collect()} for p in Z.RESIDUE}
    assert all(plain.values())
    got = {r["t"] for r in df.where(Z.has_residue(F.col("t"))).collect()}
    assert got == set().union(*plain.values())
    words = SPELLINGS[SPELLINGS.index("lorem ipsum") :]
    assert {f"Before {y} after." for x in words for y in (x, x.title(), x.upper())} <= got


def test_messages_in_place_of_articles(spark):
    article = "\n".join(f"Sentence {'abcdefghij'[i % 10]} of a real article tells in many words what happened that day to the {i} people." for i in range(40))
    rows = [(i, "https://foo.test/", f"Legal notice of Foo\n{article.replace('day', 'day' * (i + 1))}") for i in range(6)]
    rows += [(10, "https://foo.test/", "Legal notice of Foo\n404\nThe page you are looking for has moved"), (11, "https://foo.test/", f"{article}\nAccess denied"), (12, None, "Please enable JavaScript to continue"), (13, "https://foo.test/", "They wrote “Access denied” there."), (14, "https://foo.test/", "Legal notice of Foo"), (15, "https://foo.test/", None), (16, "x", "")]
    df = spark.createDataFrame(rows + rows[-7:], "k long, u string, t string").withColumn("status", F.lit(200)).withColumn("h", F.lit(1))
    assert {r["k"] for r in Z.residue_records(df, "k", "u", "t").collect()} == {10, 12}
    assert Z.residue_records(df.limit(0), "k", "u", "t").count() == 0
