import random
import re
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from dowser.llm import encoding, language, quality, samples, splitting

DATA = "/root/testdata/sf0.01/documents.parquet"
SENTENCES = {
    "en": ["The small report was not ready when we looked at it this morning.", "Because the printer is broken, all of the letters must wait until Monday.", "She asked whether they would come to the meeting with the new plan.",
           "There is no reason to keep these old files on the second disk.", "If you have time, please read the last page and tell me what you think.", "We found that the first version had been much better than this one."],
    "de": ["Der kleine Bericht war noch nicht fertig, als wir ihn heute früh ansahen.", "Weil der Drucker kaputt ist, müssen alle Briefe bis Montag warten.", "Sie fragte, ob sie mit dem neuen Plan zur Besprechung kommen würden.",
           "Es gibt keinen Grund, diese alten Dateien auf der zweiten Platte zu behalten.", "Wenn Sie Zeit haben, lesen Sie bitte die letzte Seite und sagen Sie mir Ihre Meinung.", "Wir haben gesehen, dass die erste Fassung viel besser gewesen war."],
    "fr": ["Le petit rapport n'était pas prêt quand nous l'avons regardé ce matin.", "Parce que l'imprimante est cassée, toutes les lettres doivent attendre lundi.", "Elle a demandé s'ils viendraient à la réunion avec le nouveau plan.",
           "Il n'y a aucune raison de garder ces vieux fichiers sur le deuxième disque.", "Si vous avez le temps, lisez la dernière page et dites-moi ce que vous pensez.", "Nous avons trouvé que la première version était bien meilleure que celle-ci."],
    "es": ["El pequeño informe no estaba listo cuando lo miramos esta mañana.", "Porque la impresora está rota, todas las cartas deben esperar hasta el lunes.", "Ella preguntó si vendrían a la reunión con el nuevo plan.",
           "No hay ninguna razón para guardar estos ficheros viejos en el segundo disco.", "Si tiene tiempo, lea la última página y dígame lo que piensa.", "Hemos visto que la primera versión había sido mucho mejor que esta."],
    "zh": ["今天早上我们看的时候，那份小报告还没有准备好。", "因为打印机坏了，所以所有的信都要等到星期一。", "她问他们会不会带着新的计划来开会。", "没有理由把这些旧文件保留在第二块硬盘上。", "如果你有时间，请看最后一页，然后告诉我你的想法。", "我们发现第一个版本比这个好得多。"],
}


# --- splitting ----------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b ", "\n", "\n \n", ". ", "。", "字", "x" * 50]), max_size=400), st.integers(5, 120), st.data())
def test_split(parts, limit, data):
    text = "".join(parts).strip(" \t\r\n")
    overlap = data.draw(st.integers(0, limit - 1))
    got = splitting.pieces(text, limit, overlap)
    assert all(len(p) <= limit for p in got)
    if len(splitting.paragraphs(text)[0]) <= limit:
        assert got == [splitting.paragraphs(text)[0]]
        return
    text, ends = splitting.paragraphs(text)
    assert text == re.sub(r"[\r\n]+", "\n", "".join(parts).strip(" \t\r\n"))
    nodes, jump = splitting.successors(*splitting.boundaries(text, ends), limit, overlap)
    walk = [0]
    while walk[-1] != len(nodes) - 1:  # one step after the other
        assert jump[walk[-1]] > walk[-1]
        walk.append(int(jump[walk[-1]]))
    at = splitting.cuts(text, limit, overlap, ends)
    assert at.tolist() == nodes[walk].tolist() and at[-1] == len(text)
    assert got[0] + "".join(p[min(overlap, int(c)) :] for p, c in zip(got[1:], at[1:-1], strict=True)) == text
    assert all(b.startswith(text[max(0, c - overlap) : c]) for b, c in zip(got[1:], at[1:-1].tolist(), strict=True))


def test_cuts_lie_at_the_strongest_boundary():
    text = "word " * 30 + "end.\n" + "more words " * 30
    assert splitting.pieces(text.strip(), 200, 10)[0].endswith("end.")
    for end in ("\n\n", "\r\n\r\n", "\n \t\n"):  # a paragraph end is stronger than the line end after it
        text = "word " * 24 + "end of all" + end + "a line\n" + "more words " * 30
        assert splitting.pieces(text.strip(), 200, 10)[0].endswith("end of all")
    assert [len(p) for p in splitting.pieces("x" * 1000, 300, 50)] == [250, 300, 300, 300]


def test_split_rows(spark):
    rows = [(1, "a b " * 2000), (2, None), (3, ""), (4, " \r\n" * 3000 + "short"), (1, "a b " * 2000), (5, "x" * 4000), (6, "x" * 4001)]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "id bigint, content string, chunk_index int")
    got = splitting.split(df, "content", "id").collect()
    assert {r.id for r in got} == {1, 6} and all(len(r.chunk_text) <= 4000 for r in got)
    assert sum(r.id == 1 and r.chunk_index == 0 for r in got) == 2
    assert splitting.split(df.limit(0), "content", "id").collect() == []
    with pytest.raises(ValueError):
        splitting.split(df, "content", "id", 10, 10)


# --- samples ------------------------------------------------------------------------------------------------------


def test_samples_are_the_least_hashes(spark):
    rows = [(i, f"t{i}", "h") for i in range(500)] + [(7, "t7", "h")] * 300 + [(None, "x", "h"), (501, None, "h")]
    df = spark.createDataFrame(rows, "id bigint, text string, _hash string").drop("_hash")
    least = [r.text for r in df.where("id is not null and text is not null").select("id", "text", F.pmod(F.xxhash64("id"), F.lit(1 << 62)).alias("h")).distinct().orderBy("h", "id").limit(20).collect()]
    got = samples.sample(df, "id", ["text"], 20, F.col("text").isNotNull())
    assert got.column(0).to_pylist() == least == samples.sample(df.repartition(7), "id", ["text"], 20, F.col("text").isNotNull()).column(0).to_pylist()
    rare = samples.sample(df, "id", ["text"], 20, F.col("text") == "t3")  # few are usable: the share grows until all are seen
    assert rare.column(0).to_pylist() == ["t3"]
    assert samples.sample(df, "id", ["id", "text"], 5000, F.col("text").isNotNull()).num_rows == 500
    assert samples.sample(df.limit(0), "id", ["text"], 20, F.col("text").isNotNull()).num_rows == 0


def test_models_are_fitted_once(spark):
    calls = []
    fit = lambda: calls.append(1) or {"w": len(calls)}
    assert samples.fitted(spark, "test", ["a", 1], fit) == samples.fitted(spark, "test", ["a", 1], fit) == {"w": 1}
    samples._kept.clear()  # another driver reads the folder
    assert samples.fitted(spark, "test", ["a", 1], fit) == {"w": 1} and samples.fitted(spark, "test", ["a", 2], fit) == {"w": 2}


# --- garbled text -------------------------------------------------------------------------------------------------


def corpus():
    r = random.Random(2)
    every = [s for k in SENTENCES.values() for s in k] + ["The café’s façade costs €30 – see § 4.", "It took “long”… – 20 µm, ± 5 °C, £12.", "NÃO APAGAR → ✓ αβγ"]
    return [" ".join(r.sample(every, 4)) for _ in range(400)]


@pytest.fixture(scope="module")
def classifier():
    return encoding.fit(corpus())


@pytest.mark.parametrize(("right", "wrong", "times"), [("utf-8", "cp1252", 1), ("utf-8", "cp1252", 2), ("utf-8", "latin-1", 1), ("utf-8", "mac_roman", 1), ("utf-8", "cp1251", 1), ("utf-8", "cp437", 1), ("cp1252", "cp1251", 1)])
def test_garbled_is_restored(classifier, right, wrong, times):
    for text in (SENTENCES["de"][0], SENTENCES["fr"][0], SENTENCES["es"][0]):
        bad = encoding.garbled(text, right, wrong, times)
        assert bad != text
        restored, chain, pieces, whole = encoding.restore(classifier, "Plain words. " + bad)
        assert restored == "Plain words. " + text and pieces and whole and chain


@pytest.mark.parametrize(("right", "wrong"), [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("gbk", "cp1252"), ("gbk", "cp437")])
def test_garbled_stretch_within_a_script_without_spaces(classifier, right, wrong):
    a, b, c = SENTENCES["zh"][0], SENTENCES["zh"][1], SENTENCES["zh"][2]
    bad = a + encoding.garbled(b, right, wrong) + c
    assert encoding.inverted(encoding.garbled(b, right, wrong), right, wrong) == b
    assert encoding.restore(classifier, bad)[0] == a + b + c


def test_restoring_ends_where_chains_undo_each_other(classifier):
    for text in ("È é Ã© â€™ Ð¿ Ñ€", "Ã", "ÃƒÂ©" * 50):
        assert encoding.restore(classifier, text)[2] >= 0


def test_lost_bytes_are_found_but_not_invented(classifier):
    bad = encoding.garbled(SENTENCES["de"][1], "cp1252", "utf-8")
    restored, _, pieces, whole = encoding.restore(classifier, bad)
    assert restored == bad and pieces and not whole


def test_clean_text_is_left(classifier):
    for text in [*SENTENCES["de"], *SENTENCES["zh"], "The café’s façade costs €30.", "NÃO APAGAR", "&eacute; \\u00e9 caf\\xe9", "", "ascii"]:
        assert encoding.restore(classifier, text) == (None, None, 0, True)


def test_garbled_rows(spark, classifier):
    bad = encoding.garbled(SENTENCES["fr"][3], "utf-8", "cp1252")
    rows = [(1, bad), (2, SENTENCES["fr"][3]), (3, None), (4, ""), (5, "x" * 100_000 + bad), (1, bad)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "id bigint, content string, chain string")
    got = encoding.find(df, classifier, "id", "content", True).collect()
    assert sorted(r.id for r in got) == [1, 1, 5] and {r.restored for r in got if r.id == 1} == {SENTENCES["fr"][3]}
    assert encoding.find(df.limit(0), classifier, "id", "content").collect() == []


# --- language -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    """Learned from labelled test documents, some labels of which are wrong; the sentences above are held out."""
    if not Path(DATA).exists():
        pytest.skip("no test data")
    codes = {n: k for k, v in language.NAMES.items() for n in v.split()}
    rows = [(codes.get((r["lang"] or "").strip().lower()), r["text"], r["path"]) for r in pq.read_table(DATA, columns=["lang", "text", "path"]).to_pylist()]
    usable = [(k, t, p) for k, t, p in rows if k and t]
    return language.fit([(k, t) for k, t, _ in usable], [p for _, _, p in usable])


def test_language_of_held_out_sentences(model):
    names = np.array(model.languages)
    for code, own in SENTENCES.items():
        assert names[language.verdicts(model, own[4:])["language"]].tolist() == [code] * 2
    none = language.verdicts(model, ["", "3WW7Nh04c14wHPFYtc9iJZgAdrotW2e6sJVVUwJjBbuoKvxtiOBF", "00 11 22 ff\n0a 0b", "   "])
    assert names[none["language"]].tolist() == ["und"] * 4


def test_no_language(model):
    """Kinds of text without a language that nothing is trained on."""
    held = [t for t in HELD_OUT if not re.search("flour|Miller|return|SUBTOTAL", t)]  # those have words
    got = np.array(model.languages)[language.verdicts(model, [*held, "report " * 40, "la " * 30])["language"]]
    assert (got == "und").mean() >= 0.75 and got[-2:].tolist() == ["und", "und"]
    assert model.calibration < 0.05


def test_mixed_documents(model):
    both = SENTENCES["en"][4] + " " + SENTENCES["en"][5] + "\n" + SENTENCES["de"][4]
    phrase = SENTENCES["en"][4] + " The sign said „Bitte warten“ twice. " + SENTENCES["en"][5]
    v = language.verdicts(model, [both, phrase, SENTENCES["zh"][4] + SENTENCES["zh"][5], SENTENCES["en"][4] + SENTENCES["zh"][4]])
    assert v["mixed"].tolist() == [True, False, False, True]


def test_language_rows(spark, model):
    rows = [(1, SENTENCES["fr"][4], "x"), (2, None, None), (3, "", ""), (4, SENTENCES["en"][4] + " " + SENTENCES["fr"][5] + " " + SENTENCES["fr"][4], "y"), (5, (SENTENCES["es"][4] + " ") * 2000, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, language string")
    got = {r.doc_id: (r.language, r.mixed) for r in language.documents(df, model, "doc_id", "text").collect()}
    assert got == {1: ("fr", False), 2: ("und", False), 3: ("und", False), 4: ("fr", True), 5: ("es", False)}
    s = [(r.language, r.begin, r.end) for r in language.stretches(df.where("doc_id = 4"), model, "doc_id", "text").orderBy("stretch").collect()]
    assert [x[0] for x in s] == ["en", "fr"] and s[0][1] == 0 and s[0][2] == s[1][1] and s[1][2] == len(rows[3][1])
    assert language.documents(df.limit(0), model, "doc_id", "text").collect() == []


def test_labels_and_roots(spark):
    df = spark.createDataFrame([(x,) for x in ("en-US", " EN_gb", "Deutsch", "zh_Hans", "und", "", None, "français")], "lang string")
    assert [r.x for r in df.select(language.named(df.lang).alias("x")).collect()] == ["en", "en", "de", "zh", None, None, None, "fr"]
    files = spark.createDataFrame([(1, "/srv/a/x"), (2, "/srv/ab/x"), (3, "C:\\r\\x"), (4, None)], "id bigint, path string")
    roots = spark.createDataFrame([("/srv/a",), ("C:\\r",), (None,)], "root_path string")
    assert sorted(r.id for r in language.under_roots(files, roots).collect()) == [1, 3] == sorted(r.id for r in language.under_roots(files, roots, most=0).collect())


# --- quality ------------------------------------------------------------------------------------------------------

USAGE = quality.Usage.learn([], [])
COMMON = quality.Lexicon("the of and to in is that it der die und das le la les et el los que 的 了 在".split())


def test_statistics():
    s = dict(zip(quality.NAMES, quality.statistics(["The cat is in the hat.\nIt's 42!"], COMMON, USAGE)[0], strict=True))
    assert s["word_count"] == 8 and s["punct_line_share"] == 1 and s["common_share"] == 4 / 8
    assert s["mean_word_length"] == 19 / 8 and s["symbol_ratio"] == 3 / 31 and s["mean_line_length"] == 15.5
    zh = dict(zip(quality.NAMES, quality.statistics(["他在家了。"], COMMON, USAGE)[0], strict=True))
    assert zh["word_count"] == 2 and zh["common_share"] == 1.0
    lists = dict(zip(quality.NAMES, quality.statistics(["- one\n2) two\n\nthree"], COMMON, USAGE)[0], strict=True))
    assert lists["marker_line_share"] == 2 / 3
    assert not quality.statistics(["", "  \n"], COMMON, USAGE).any()
    many = ["The cat is in the hat."] * 3 + ["x" * (quality.CHUNK + 5)]
    assert (quality.statistics(many, COMMON, USAGE)[:3] == quality.statistics(many[:1], COMMON, USAGE)).all()


def documents():
    if not Path(DATA).exists():
        pytest.skip("no test data")
    return [t for t in pq.read_table(DATA, columns=["text"]).column(0).to_pylist() if t and len(t) <= 20_000]


#: Kinds of junk that no builder makes.
HELD_OUT = [
    "\n".join(f"{i}. e{i % 8 + 1} {'abcdefgh'[i % 8]}{i % 8 + 1} {i + 1}... N{'abcdefgh'[i * 3 % 8]}{i * 5 % 8 + 1} Qx{'abcdefgh'[i * 7 % 8]}{i % 7 + 1}+" for i in range(20)),
    "\n".join(f"def f{i}(a, b={i}):\n    if a[{i}] != b:\n        return {{'k{i}': a * b}}\n    x = g(a, lambda y: y + {i})" for i in range(8)),
    "\n".join("e|--{0}--{1}---{0}-|\nB|-{1}----{0}--{1}-|\nG|---{0}{1}------|".format(i % 9, i * 7 % 9) for i in range(8)),
    ">seq1\n" + "\n".join("".join("ACGT"[(i * i + j * 7 + i * j) % 4] for j in range(60)) for i in range(12)),
    "\n".join(f"<tr class=\"r{i}\"><td>{i * 17}</td><td>&nbsp;</td><td><a href=\"#{i}\">{i}</a></td></tr>" for i in range(15)),
    "\n".join(f"Miller, J. ........ {555 + i}-{1000 + 37 * i}" for i in range(20)),
    "\n".join("".join("#" if (i * j) % 3 == 0 else " ." [(i + j) % 2] for j in range(50)) for i in range(12)),
    "C6H12O6 + 6 O2 -> 6 CO2 + 6 H2O; 2 H2 + O2 -> 2 H2O; Fe2O3 + 3 CO -> 2 Fe + 3 CO2; N2 + 3 H2 -> 2 NH3; CaCO3 -> CaO + CO2",
    "INSERT INTO t VALUES (1,'a',NULL),(2,'b',3.5),(3,'c',NULL),(4,'d',7.25),(5,'e',NULL),(6,'f',9.0);\n" * 4,
    "SUBTOTAL 12,40\nVAT 19% 2,36\nTOTAL EUR 14,76\nCARD **** 1234\nAUTH 009812\nTERM 44 TRACE 123\n" * 2,
    "1 cup flour\n2 eggs\n250 ml milk\n1 pinch salt\n3 tbsp sugar\n20 g butter\n1 lemon\n",
    "\\frac{a}{b} + \\sum_{i=1}^{n} x_i^2 = \\int_0^1 f(x)\\,dx \\\\ \\alpha \\beta \\gamma \\leq \\sqrt{\\pi} \\cdot \\theta_{k} " * 3,
]


def test_junk_of_kinds_that_no_builder_makes():
    texts = documents()
    common = quality.Lexicon(pq.read_table(DATA.replace("documents", "common_word"), columns=["word"]).column(0).to_pylist())
    model = quality.learn(texts, common)
    prose = [" ".join(SENTENCES[k][i : i + 4]) for k in ("en", "de", "fr", "es") for i in range(3)]
    x = quality.statistics([*HELD_OUT, *prose], model.common, model.usage)
    junk = np.any([r.covers(x) for r in model.rules], axis=0)
    assert junk[: len(HELD_OUT)].mean() >= 0.8 and junk[len(HELD_OUT) :].mean() <= 0.2


def test_rules_are_learned_and_exported(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (900, 3))
    y = (x[:, 0] > 0.7) | ((x[:, 1] < 0.2) & (x[:, 2] > 0.5))
    rules = quality.induce(x, y)
    covered = np.any([r.covers(x) for r in rules], axis=0)
    assert (covered == y).mean() > 0.95
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    label = [r.v for r in df.selectExpr(quality.to_case(rules, ["a", "b", "c"]) + " AS v").collect()]
    assert label == ["junk" if c else "prose" for c in covered] and quality.to_case([], []) == "'prose'"


def test_prose_and_junk(spark):
    r = random.Random(3)
    every = [s for k in ("en", "de", "fr", "es") for s in SENTENCES[k]]
    texts = [" ".join(r.sample(every, 5)) for _ in range(60)]
    held = [(False, " ".join(r.sample(every, 6))) for _ in range(40)] + [(True, "\n".join(f"- the {w}" for w in r.sample("report plan letter page disk file meeting version".split(), 6))) for _ in range(20)] + \
        [(True, "|".join(str(r.random()) for _ in range(30))) for _ in range(20)]
    rows = [(i, t, "x") for i, (_, t) in enumerate(held)] + [(900, None, ""), (901, "", ""), (902, "  ", None)]
    rows += [(1000 + i, t, "") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label string")
    words = spark.createDataFrame([(w,) for w in "the of and to in is der die und le la les el los que".split()] + [(None,)], "word string")
    got = {r.doc_id: r.label for r in quality.assess(df, words, count=1200).collect()}
    assert [got[i] for i in (900, 901, 902)] == ["blank"] * 3
    right = sum((got[i] == "junk") == y for i, (y, _) in enumerate(held))
    assert right >= 0.9 * len(held)
    assert quality.assess(df.limit(0), words, count=300).collect() == []


def corpus():
    """More texts than a sample of 1,500 had, lists among them, one text above 20,000 characters, and repeated rows."""
    r = random.Random(4)
    every = [s for k in ("en", "de", "fr", "es") for s in SENTENCES[k]]
    names = ["".join(r.choice("bdfglmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(300)]
    texts = [f"{r.choice(every)} The {r.choice(names)} of the {r.choice(names)} is not the same as the {r.choice(names)} of last year {i % 900}." for i in range(1700)]
    texts += ["\n".join(f"- the {n} {k}" for k, n in zip("abcdef", r.sample(names, 6), strict=True)) for _ in range(150)]
    texts += [" ".join(f"A zyxwo of the {n} was seen here and there with the zyxwo number {i}." for i, n in enumerate(names * 2))] * 2
    return [*texts, None, "", "  "]


def test_quality_is_learned_from_all_rows(spark):
    texts = corpus()
    assert max(len(t or "") for t in texts) > samples.MOST_CHARS
    df = spark.createDataFrame([(None if i % 100 == 0 else i // 2, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    words = spark.createDataFrame([("the",), ("of",)], "word string")
    whole, short = quality.spans([t for t in texts if t])
    want = quality.Usage.learn([s for v in whole.values() for s in v], [s for v in short.values() for s in v])
    got = quality.fit_on(df, words, count=300).usage
    assert got.places(np.array([quality._hash("zyxwo")], np.uint64))[0] >= 0
    assert (got.hashes == want.hashes).all() and (got.weight == want.weight).all() and (got.pair == want.pair).all()


def test_rules_are_the_same_wherever_they_are_counted(spark):
    df = spark.createDataFrame([(t,) for t in corpus()], "text string")
    found = [quality.corpus_spans(x).localCheckpoint() for x in (df, df.repartition(7))]
    common, size = quality.Lexicon(["the", "of"]), 400
    usage = quality.corpus_usage(found[0])
    blocks = [quality.corpus_blocks(x, common, usage, 300, size=size).localCheckpoint() for x in found]
    assert blocks[0].count() == -(-found[0].count() // size) > 3 and sorted(blocks[0].collect()) == sorted(blocks[1].collect())
    rules = quality.corpus_rules(blocks[0])
    assert rules and rules == quality.corpus_rules(blocks[1], here=0)


def test_every_span_is_in_a_labelled_document():
    r = random.Random(6)
    whole, short = quality.spans([t for t in corpus() if t])
    whole["han"] = ["".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(20)) + "。" for _ in range(30)]
    builder = quality.Builder(*({k: list(set(v)) for k, v in by.items()} for by in (whole, short)), 1)
    rows = list(builder.documents(10))
    assert not any(deck.new for decks in (builder.sentences, builder.short) for deck in decks.values())
    text = "".join(re.sub(r"\s", "", t) for _, t in rows)
    assert all(s[:-1] in text or any(s[i : i + 4] in text for i in range(16)) for s in whole["han"])
    assert [y for y, _ in rows[:4]] == [False, True, False, True] and len(rows) > 100


def test_cells_rise_with_the_values():
    x = np.sort(np.concatenate([np.random.default_rng(1).normal(0, 1, 500), [0, -1e-9, 1e-9, 1, -1, 2, 1e6, 5e8]]))
    k = quality.cells(x).astype(int)
    assert (np.diff(k) >= 0).all() and k[x == 0] == 0
    assert all(quality._bound(i, False) <= v <= quality._bound(i, True) for v, i in zip(x, k.tolist(), strict=True))
    assert all(quality.cells(quality._bound(i, up)) == i for i in {*k.tolist()} for up in (True, False))
