import numpy as np
import pytest
from pyspark.sql import functions as F

from gridquill.llm import encoding as X

# sentences the built-in training phrases do not have
CLEAN = [
    "Der Schlüssel hängt neben der Tür, aber die Lösung gefällt mir überhaupt nicht, größer wäre schöner.",
    "Le café était fermé à midi, dommage : j’espérais déjeuner là-bas après la réunion générale.",
    "El señor Núñez llegó temprano y preguntó por qué la sesión había terminado así de rápido.",
    "A informação já não está disponível, então a nossa função também não será necessária amanhã.",
    "Пожалуйста, проверьте настройки сервера ещё раз, потому что страница открывается слишком медленно.",
    "Proszę sprawdzić, dlaczego wszystko działa wolniej niż wczoraj, może ktoś coś zmienił w źródłach.",
    "It’s “quoted” — don’t touch the naïve café’s €5 menu… that’s fine.",
]


@pytest.fixture(scope="module")
def detector():
    return X.Detector(X.fit(CLEAN))


def test_round_trips():
    for chain in X.CHAINS:
        made = 0
        for text in CLEAN:
            bad = X.garble(text, chain)
            if bad is not None and bad != text:
                made += 1
                assert X.invert(bad, chain) == text, chain
        assert made or chain.startswith(("cp1252", "mac", "cp850", "koi8", "iso", "cp866", "cp1251", "cp1250"))
    assert X.invert("Ã", "utf8>cp1252") is None and X.invert("я", "utf8>cp1252") is None


def test_clean_text_stays(detector):
    tree = "src/\n├── a.py\n│   └── b.py"
    for text in (*CLEAN, "ATENÇÃO: NÃO FUNCIONA, SÓ ÀS VEZES.", tree, "4\xa0unequal​ heaps", "plain", ""):
        assert detector.inspect(text) is None, text


@pytest.mark.parametrize("chain", [c for c in X.CHAINS if c.startswith("utf8") and c not in ("utf8>koi8_r", "utf8>cp866")])
def test_multibyte_chains_are_undone(detector, chain):
    told = 0
    for text in CLEAN:
        if (bad := X.garble(text, chain)) is not None:
            found = detector.inspect(bad)
            assert found is not None and found[2] == text, (chain, bad)
            told += 1
    assert told >= 5


@pytest.mark.parametrize("chain,which", [("cp1251>cp1252", 4), ("cp1251>koi8_r", 4), ("koi8_r>cp1251", 4), ("cp1250>cp1252", 5), ("iso8859_2>cp1252", 5)])
def test_single_byte_chains_are_undone(detector, chain, which):
    found = detector.inspect(X.garble(CLEAN[which], chain))
    assert found is not None and found[2] == CLEAN[which]


def test_part_of_a_text_and_code_marks(detector):
    bad = X.garble(CLEAN[0], "utf8>cp1252")
    assert detector.inspect(CLEAN[1] + "\n\n" + bad) == ("utf8>cp1252", True, CLEAN[1] + "\n\n" + CLEAN[0])
    for sample in ("see `Ã©` for `é`", "```\nassert repair('Ð¿Ñ€Ð¸') == 'при'\n```", "<pre><code>â€™</code></pre> is shown", "`` a ` â€™ ``", "the sign `�` stands for"):
        assert detector.inspect(sample) is None, sample
    assert detector.inspect("fr�h am Morgen")[:2] == (X.LOST, False)
    assert detector.inspect(bad + "\n`Ã¼ber`")[2] == CLEAN[0] + "\n`über`"


def referred(text):
    return "".join(c if c.isascii() else f"&#{ord(c)};" for c in text)


def test_character_references(detector):
    for which in (0, 1, 2, 6):
        bad = X.garble(CLEAN[which], "utf8>cp1252")
        found = detector.inspect(referred(bad))
        assert found is not None and found[1:] == (True, CLEAN[which]), found
        assert detector.inspect(referred(CLEAN[which])) is None
    assert detector.inspect("a&Atilde;&plusmn;o, and &#xC3;&#xA9; too")[2] == "año, and é too"
    assert detector.inspect("fr&#65533;h")[:2] == (X.LOST, False)
    # clean references of a garbled text stay as they are, and so do those for ASCII
    assert detector.inspect("I&#226;&#8364;&#8482;d say 1 &lt; 2\n\n&#8222;gern&#8220; &amp; mehr")[2] == "I’d say 1 &lt; 2\n\n&#8222;gern&#8220; &amp; mehr"
    for sample in ("`&#195;&#169;` is shown", "<code>I&#226;&#8364;&#8482;d</code>", "&nosuchname; &#999999999; &#xD800; &;", "1 &lt; 2 &amp;&amp; 3 &gt; 2", "&copy; 2020 caf&eacute;"):
        assert detector.inspect(sample) is None, sample
    assert "&#" not in detector.inspect("I&#226;&#8364;&#8482;d\n```\necho &#226;&#8364;&#339;x&#226;&#8364;&#157;\n```")[2]


def test_training_does_not_depend_on_the_layout(spark):
    texts = [f"Straße {i} ist größer, sagt Ünal {i % 7}" for i in range(900)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    models = [X.train(df.repartition(n), rows=100) for n in (1, 5)] + [X.train(df.orderBy(F.col("text").desc()), rows=100)]
    assert all(np.array_equal(m.weights, models[0].weights) for m in models[1:])


def test_over_a_table(spark):
    data = [(i, t) for i, t in enumerate(CLEAN)] + [(10, X.garble(CLEAN[2], "utf8>latin1")), (11, None), (12, ""), (13, "ascii"), (14, "x" * 200_000 + " cafÃ©"), (15, "a&#195;&#177;o")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit("?") for c in ("chain", "restorable")})
    got = {r.doc_id: (r.restorable, r.restored_text) for r in X.find_garbled(df).collect()}
    assert got == {10: (True, CLEAN[2]), 14: (True, "x" * 200_000 + " café"), 15: (True, "año")}
    assert X.find_garbled(df.limit(0)).count() == 0


def test_held_out_accuracy_of_the_classifier(detector):
    """Named chains over unseen sentences; latin1 and cp1252 share most characters and count as one."""
    right = total = 0
    for chain in ("utf8>cp1252", "utf8>cp437", "utf8>cp850", "utf8>mac_roman", "utf8>cp1251", "utf8>cp1252 twice", "utf8>cp1250"):
        for text in CLEAN:
            if (bad := X.garble(text, chain)) is not None:
                total += 1
                said = (detector.chain_of_line(bad) or "").replace("latin1", "cp1252")
                right += said == chain
    assert right / total > 0.9


@pytest.mark.parametrize("text", ["That works 😀 thanks", "two\xa0 words here", "a\u200b b", "\ufeffHello there", "Ακόμα δεν λειτουργεί τίποτα", "Příliš žluťoučký kůň úpěl ďábelské ódy",
                                  "Árvíztűrő tükörfúrógép", "at 20° outside", "costs £5 now", "これは日本語です", "Değiştirdiğim şey işe yaradı"])
def test_letters_that_the_sample_lacks_are_found(detector, text):
    assert detector.inspect(text) is None
    for chain in ("utf8>cp1252", "utf8>latin1"):
        if (bad := X.garble(text, chain)) is not None:
            assert detector.inspect(bad)[1:] == (True, text)


def test_quotes_and_dashes_after_capitals_are_no_letters(detector):
    for text in ("„Spaß“ und “CAFÉ” – «À» É…", "DÉJÀ VU – “FIANCÉ”", "Größe: Ä–Ö, Ü“ ß” ñ"):
        assert detector.inspect(text) is None, text


def test_stray_and_unclosed_marks_hide_no_prose(detector):
    bad = X.garble(CLEAN[0], "utf8>cp1252")
    for text in (f"a stray ` sign\n\n{bad}\n\nand `code`", f"```\n{bad}", f"~~~ {bad}", f"<code> {bad}", f"<PRE class='x'>{bad} </pre", f"`` {bad} `"):
        found = detector.inspect(text)
        assert found is not None and found[2] == text.replace(bad, CLEAN[0]), text
    assert X.prose("a ` b\n \n`Ã©` c").split() == ["a", "`", "b", "c"]
    assert X.prose("x`a\nb`y ```p\n\nq``` <code>r</CODE >z").split() == ["x", "y", "z"]
    for text in ("`" * 3 + "x", "<code>" * 50_000, "`a ``b " * 50_000, "<code" * 50_000, "~~~ ``` <pre>" * 20_001):
        assert len(X.prose(text)) == len(text)


@pytest.mark.parametrize("chain,which", [("cp1251>cp1252", 4), ("cp1251>koi8_r", 4), ("koi8_r>cp1251", 4), ("koi8_r>cp1252", 4), ("cp866>cp1251", 4), ("iso8859_2>cp1252", 5)])
def test_few_garbled_words_of_a_line(detector, chain, which):
    words = CLEAN[which].split()
    found = detector.inspect(" ".join(words[:2] + [X.garble(w, chain) for w in words[2:5]] + words[5:]))
    assert found is not None and found[1:] == (True, CLEAN[which])


def test_every_likely_chain_is_tried(detector):
    bad = X.garble("größer", "utf8>cp1252")
    wrong = [c for c in X.CHAINS if detector.restore_token(bad, c) is None][:6]
    own = X.Detector(detector.model)
    own.seen[bad] = np.array([-60.0 if c == "clean" else 0.0 if c in wrong else -10.0 if c == "utf8>cp1252" else -90.0 for c in ("clean", *X.CHAINS)])
    assert len(wrong) == 6 and own.chain_of_tokens([bad]) == "utf8>cp1252"


def test_restored_texts_of_the_corpus(spark):
    """Clean posts of the corpus, garbled here by known chains, wholly or one paragraph: the originals come back."""
    posts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = X.train(posts)
    found = {r.doc_id for r in X.find_garbled(posts, model).select("doc_id").collect()}
    clean = [r for r in posts.where(F.col("text").rlike(r"[^\x00-\x7F]")).collect() if r.doc_id not in found and "�" not in r.text and "`" not in r.text and "<" not in r.text][:120]
    chains = ("utf8>cp1252", "utf8>latin1", "utf8>cp1252 twice", "utf8>cp437", "utf8>mac_roman", "utf8>cp1251")
    made, originals = [], {}
    for n, r in enumerate(clean):
        chain = chains[n % len(chains)]
        parts = r.text.split("\n\n")
        if n % 2 and len(parts) > 1:
            at = max(range(len(parts)), key=lambda i: sum(not c.isascii() for c in parts[i]))
            bad = X.garble(parts[at], chain)
            text = None if bad is None else "\n\n".join(parts[:at] + [bad] + parts[at + 1:])
        else:
            text = X.garble(r.text, chain)
        if text is not None and text != r.text:
            originals[n] = r.text
            made.append((n, referred(text) if n % 5 == 0 else text))
    got = {r.doc_id: r for r in X.find_garbled(spark.createDataFrame(made, "doc_id long, text string"), model).collect()}
    right = sum(n in got and got[n].restored_text == originals[n] for n in originals)
    assert len(originals) > 80 and len(got) >= 0.97 * len(originals) and right >= 0.9 * len(originals)
