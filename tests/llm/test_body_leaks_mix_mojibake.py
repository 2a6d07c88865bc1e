"""Page bodies, leaks, mixtures and garbled text against brute force, known answers and round trips."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weblens.llm import body as B
from weblens.llm import leaks as K
from weblens.llm import mix as M
from weblens.llm import mojibake as J

SENTENCES = [f"The {a} council said on Monday that the {b} plan would go ahead in spite of the weather and cost more." for a in "north south east west upper lower inner outer".split() for b in "road bridge school water power light".split()]
FURNITURE = ["Home", "About", "Accept all", "Most read", "Share · Print", "© 2024 Foo News"]


def page(rng, n, generated=False):
    main = [f"Headline {n} of the paper", "By Ada Bell, 3 May 2024", *rng.sample(SENTENCES, 5)]
    c = (lambda name: f"css-{rng.randint(10000, 99999)}x") if generated else (lambda name: name)
    html = f"""<html><head><title>t</title></head><body><div class="{c('top')}"><ul><li><a href="/">Home</a><li><a href="/a">About</a></ul></div>
<DIV class="{c('story')}"><h1>{main[0]}</h1><span>{main[1]}</span><div>Share · Print</div>{''.join(f'<p>{x}' for x in main[2:])}<h3>Most read</h3><li><a href="/z">Other story {n}</a></DIV>
<div class="{c('foot')}"><button>Accept all</button><p>© 2024 Foo News</p></div><script>var s='<p>x</p>'</script></body></html>"""
    lines = ["Home", "About", main[0], main[1], "Share · Print", *main[2:], "", "Most read", f"Other story {n}", "Accept all", "© 2024 Foo News"]
    return html, "\n".join(lines), set(main)


@pytest.mark.parametrize("generated", [False, True])
def test_bodies(spark, generated):
    rng, rows, want = random.Random(6), [], set()
    for n in range(20):
        html, text, main = page(rng, n, generated)
        if n == 18:
            html = html[: html.index("Most read")]
        if n == 19:
            html = None
        rows.append((n, "https://www.foo.test/x", html, text))
        want |= {(n, i) for i, x in enumerate(text.split("\n"), 1) if x.strip() and x not in main}
    rows += [rows[0], (30, None, None, None), (31, "https://foo.test/", "<p>x", ""), (32, None, "", " \n\t")]
    df = spark.createDataFrame(rows, "k long, u string, html string, content string").withColumn("path", F.lit("c")).withColumn("role", F.lit("c"))
    got = {tuple(r) for r in B.outside_body(df, "k", "u", "html", "content").collect()}
    assert {x for x in got if x[0] < 18} == {x for x in want if x[0] < 18}
    assert len(got ^ want) <= 4  # pages without markup are judged by place
    bodies = {r["k"]: r["body"] for r in B.main_body(df, "k", "u", "html", "content").collect()}
    assert bodies[0].startswith("Headline 0") and "Home" not in bodies[0] and bodies[31] == ""
    assert B.outside_body(df.limit(0), "k", "u", "html", "content").count() == 0


def test_structure_survives_any_markup():
    for markup in ("<", "<<>><a", "<div><div></p></div", "<table><td>a<td>b</table>", "<!--", "<script>", "x" * 300_000, "<p>" * 20_000):
        B.structure(markup, "a\n\nb | c")


def word_runs(text):
    return re.findall(r"[^\W_]+", text.lower())


def test_leaks_match_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["größe", "дом", "l’été", "x"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 40)))) for i in range(12)] + [(50, None), (51, ""), (52, "one two three")]
    docs = []
    for d in range(120):
        words = rng.choices(vocabulary, k=rng.randint(0, 80))
        source = word_runs(items[rng.randrange(12)][1])
        a = rng.randrange(max(1, len(source) - 4))
        n = rng.choice([5, 9, 10, 11, 30])
        at = rng.randint(0, len(words))
        words[at:at] = source[a : a + n]
        docs.append((d, rng.choice([" ", "  — ", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    docs += [(200, None), (201, ""), (202, "x " * 100_000), docs[0]]
    grams = {}
    for i, p in items:
        w = word_runs(p or "")
        for k in range(len(w) - 9):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = {(d, i) for d, t in docs if t for w in [word_runs(t)] for k in range(len(w) - 9) for i in grams.get(tuple(w[k : k + 10]), ())}
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_words", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, passage string")
    assert {tuple(r) for r in K.leaks(a, b).collect()} == want and want
    monkeypatch.setattr(K, "BLOCK_CHARS", 300)
    assert {tuple(r) for r in K.leaks(a, b).collect()} == want
    monkeypatch.undo()
    assert K.leaks(a.limit(0), b).count() == 0 and K.leaks(a, b.limit(0)).count() == 0


def test_leaks_with_edits_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_CHARS", 50)
    passage = "the small ferry left the stone harbour before the first light of that cold morning"
    docs = [(1, "And so the small fery left the stone harbour before the first lihgt of that day."), (2, "the small boat left a wooden pier after the last light"), (3, passage)]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(7, passage), (8, "nothing of this kind is said in any of those texts at all today")], "item_id long, passage string")
    assert {tuple(r) for r in K.leaks(a, b, edits=0).collect()} == {(3, 7)}
    assert {tuple(r) for r in K.leaks(a, b, edits=3).collect()} == {(1, 7), (3, 7)}


def test_budgets_go_to_siblings_first():
    leaves = [{"source": s, "share": w, "capacity": c, "path": p} for s, w, c, p in [("a", 0.25, 10.0, ("x", "en")), ("b", 0.25, 1000.0, ("x", "en")), ("c", 0.25, 1000.0, ("x", "de")), ("d", 0.25, 1000.0, ("y", "en"))]]
    got = M.budgets(leaves, 400.0)
    assert got == {"a": 10.0, "b": 190.0, "c": 100.0, "d": 100.0}
    leaves[1]["capacity"] = 50.0
    assert M.budgets(leaves, 400.0) == {"a": 10.0, "b": 50.0, "c": 240.0, "d": 100.0}
    assert sum(M.budgets(leaves, 1e9).values()) == 10 + 50 + 2000
    assert M.budgets([], 5.0) == {}


def test_mixture(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["big"] * 30 + ["small"]), "en", " ".join(rng.choices("alpha beta gamma delta".split(), k=rng.randint(1, 60)))) for i in range(900)]
    docs += [docs[0], (1000, None, "en", "x"), (1001, "big", None, None), (1002, "big", "en", ""), (1003, "other", "en", "never used"), (1004, "small", "de-DE", "y " * 3000)]
    targets = [("big", 0.7, 1), ("small", 0.2, 3), ("none", 0.1, 2)]
    a = spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").withColumn("epoch", F.lit(9)).withColumn("n_tokens", F.lit(9))
    b = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    rows, shares = M.mixture(a, b, total=20_000.0, seed=1)
    got = [tuple(r) for r in rows.select("doc_id", "source", "epoch", "n_tokens").collect()]
    again = [tuple(r) for r in M.mixture(a.repartition(7), b, total=20_000.0, seed=1)[0].select("doc_id", "source", "epoch", "n_tokens").collect()]
    assert sorted(got) == sorted(again) and len({x[:3] for x in got}) == len(got)
    s = {r["source"]: r for r in shares.collect()}
    longest = max(x[3] for x in got)
    for name, _, repeats in targets:
        tokens = sum(x[3] for x in got if x[1] == name)
        assert s[name]["tokens"] == tokens and s[name]["budget"] - max(longest, 7000) <= tokens <= s[name]["budget"]
        assert max((x[2] for x in got if x[1] == name), default=0) < repeats
    assert s["none"]["tokens"] == 0 and not {1001, 1002, 1003} & {x[0] for x in got}
    assert M.mixture(a.limit(0), b)[0].count() == 0


CHAINS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1250"), ("cp1252", "cp437"), ("cp1252", "mac_roman")]


def test_garbled_text_is_found_and_restored(spark):
    sentence = "Für die Behörden wären größere Verträge überraschend, sagte der Händler; der „Ölbericht“ stützt die Währung – auch wenn die Prüfstelle zögerlich bleibt."
    docs = [(i, f"{sentence} Nummer {i}.") for i in range(30)]
    want = {}
    for n, (a, b) in enumerate(CHAINS):
        text = sentence if a == "utf-8" else sentence.replace("„", "").replace("“", "").replace("–", "")
        want[100 + n] = text
        docs.append((100 + n, text.encode(a).decode(b, "replace")))
    twice = sentence.encode().decode("cp1252", "replace").encode().decode("cp1252", "replace")
    lost = "Für größere Verträge".encode("latin-1").decode("utf-8", "replace")
    docs += [(200, twice), (201, lost), (202, "Readers saw “Ã¼” where “ü” was stored, in a note on charset headers."), (203, "The manual prints Ã¼ as an example of a wrongly read letter."), (204, "Ω ≥ 5 µm, ½ Ø, SITUAÇÃO"), (205, None), (206, ""), docs[0], docs[31]]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("original", F.lit("o"))
    assert {r["doc_id"] for r in J.found(df).collect()} == {*want, 200, 201}
    back = {r["doc_id"]: r["text"] for r in J.restored(df).collect()}
    for k, text in want.items():
        same = sum(x == y for x, y in zip(back[k].split(), text.split()))
        assert same >= 0.9 * len(text.split()), (k, back[k])
    assert back[201] == "Für größere Verträge"
    assert J.found(df.limit(0)).count() == 0 and J.restored(df.limit(0)).count() == 0


def test_forms_commute_with_ascii():
    for word in ("größe", "naïve", "x’s", "дом", "Ünïx9"):
        forms = J.garbled_forms(word)
        assert word.encode().decode("cp437") in forms and word not in forms
        assert word.encode().decode("latin-1") in forms


def test_explaining_sentences_keep_other_evidence(spark):
    good = [(i, f"Größere Verträge für die Behörden, Nummer {i}.") for i in range(8)]
    bad = ["GrÃ¶ÃŸere VertrÃ¤ge are an example of what fÃ¼r die BehÃ¶rden means.", "GrÃ¶ÃŸere VertrÃ¤ge. The encoding of the file is set in the header.", "The encodings fÃ¼r BehÃ¶rden are set here."]
    quoting = ["The manual prints Ã¼ as an example of a wrongly read letter.", "Readers saw “fÃ¼r” where “für” was stored, in a note on charset headers.", "We read fÃ¼r as an example of garbled text."]
    df = spark.createDataFrame(good + [(100 + i, t) for i, t in enumerate(bad)] + [(200 + i, t) for i, t in enumerate(quoting)], "doc_id long, text string")
    assert {r["doc_id"] for r in J.found(df).collect()} == {100, 101, 102}


def test_more_garbled_than_right_texts(spark):
    right = "Größere Verträge für die Behörden."
    texts = [right, "Größere Verträge für die Behörden, heute.", "Überraschend zögerlich"]
    for chain in (("utf-8", "cp1252"), ("cp1252", "cp437")):
        garble = lambda x, c=chain: x.encode(c[0]).decode(c[1])
        rows = [(i, x) for i, x in enumerate(texts)]
        rows += [(100 + i, garble(f"{right} Teil {'abcdefgh'[i]}")) for i in range(8)] + [(200 + i, garble(right)) for i in range(20)] + [(300, garble(texts[2]))]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r["doc_id"] for r in J.found(df).collect()} == {k for k, _ in rows if k >= 100}
        back = {r["doc_id"]: r["text"] for r in J.restored(df).collect()}
        assert back[200] == right and back[300] == texts[2]


def test_copies_count_once(spark):
    rows = [(i, "La pčre a parlé.") for i in range(9)] + [(20, "Le père a dit."), (21, "Un père a ri.")]
    assert {r["word"]: r["original"] for r in J.garbled_words(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()} == {"pčre": "père"}


def test_long_furniture_is_known_on_pages_without_markup(spark):
    rng, rows = random.Random(9), []
    notice = "We and our partners store and read cookies on your device to measure reach, to show advertising that suits you and to find out how our pages are used; you may object at any time in the settings."
    for n in range(12):
        html, text, main = page(rng, n)
        at = text.index(SENTENCES[0][:4], text.index("Share · Print"))
        at = text.index("\n", at) + 1  # after the first sentence
        text = text[:at] + notice + "\n" + text[at:]
        first = text[:at].split("\n")[-2]
        html = html.replace(f"<p>{first}", f'<p>{first}<aside>{notice}</aside>')
        rows.append((n, "https://www.foo.test/x", html if n < 11 else None, text))
    df = spark.createDataFrame(rows, "k long, u string, html string, content string")
    bodies = {r["k"]: r["body"] for r in B.main_body(df, "k", "u", "html", "content").collect()}
    assert len(notice) >= 160 and all(notice not in x for x in bodies.values()) and all("council" in x for x in bodies.values())


def test_lines_after_a_long_unmatched_block_are_laid():
    block = "".join(f"<p>Text {i} that the dump writes in another way than the markup does." for i in range(200))
    html = f"<div><p>{SENTENCES[0]}</div><div>{block}</div><ul class='more'><li>Short one<li>{SENTENCES[1]}<li>Last</ul>"
    dump = [SENTENCES[0], "one line for the whole block", "Short one", SENTENCES[1], "Last"]
    assert [x[1] >= 0 for x in B.structure(html, "\n".join(dump))] == [True, False, True, True, True]
    assert {x[2] for x in B.structure(html, "\n".join(dump))[2:]} == {"ul.more"}


def test_explaining_words_of_any_case_pass_their_signs(spark):
    forms = ["example of", "wrongly read", "wrong decoded", "charset", "character sets", "encodings", "mojibake", "misread", "mis-decoded", "garbled", "zeichensatz", "zeichenkodierung", "encodage", "codificación", "codificacion", "codificação", "кодировка", "kodowanie", "pengodean"]
    rows = [(i, f"An {y} of “GrÃ¶ÃŸe” text.") for i, y in enumerate(y for x in forms for y in (x, x.upper(), x.title()))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["t"] for r in df.select(J.evidence(F.col("text")).alias("t")).collect() if "GrÃ" in r["t"]] == []


def test_words_after_long_runs_are_whole(spark):
    run = "x" * 100_000
    df = spark.createDataFrame([(1, f"{run}é {'a' * 30}ü9, b"), (2, run)], "doc_id long, text string")
    got = {r["doc_id"]: r["w"] for r in df.select("doc_id", J.words(F.col("text")).alias("w")).collect()}
    assert got == {1: [f"{run}é", f"{'a' * 30}ü0"], 2: []}


def test_inexact_leaks_match_plain_edit_distance(spark):
    """Every window of ten words against every piece of the text, by the plain recurrence."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(40)] + ["größe", "harbour", "x", "light"]
    items = [(i, " ".join(rng.choices(vocabulary, k=12))) for i in range(6)]
    docs = []
    for d in range(60):
        piece = items[rng.randrange(6)][1].split()[rng.randrange(3) :][:10]
        text = list(" ".join(piece))
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], [rng.choice("abz")], [text[at], "q"]])
        docs.append((d, " ".join(rng.choices(vocabulary, k=rng.randrange(6))) + " " + "".join(text) + " " + " ".join(rng.choices(vocabulary, k=rng.randrange(6)))))

    def near(piece, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(piece, 1):
            new = [i]
            for j, t in enumerate(text, 1):
                new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
            row = new
        return min(row) <= 2

    spaced = lambda t: " " + " ".join(word_runs(t)) + " "
    want = {(d, i) for d, t in docs for i, p in items for w in [p.split()] if any(near(spaced(" ".join(w[k : k + 10])), spaced(t)) for k in range(3))}
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    got = {tuple(r) for r in K.leaks(a, b, edits=2).collect()}
    assert len(want) > 20 and got == want
