from __future__ import annotations

import numpy as np
import pytest

from quarrylight.llm import garbled as G
from quarrylight.llm.garbled import Judge, Model, chains, restore

CLEAN = [
    "Für größere Verzeichnisse genügt die Zählung nicht. Die Suche überspringt Einträge.", "Après la fusion, le répertoire a été déplacé. L’équipe préfère la tâche précédente — voir §3.",
    "Mañana revisaré la última versión. ¿Por qué tarda la búsqueda?", "Należy usunąć źródło i uruchomić ponownie. Błąd występuje również później.", "Удалённые файлы остаются в индексе. Проверьте порядок полей и пустой список.",
    "検索結果が空になる場合があります。依存関係を確認しました。", "It’s safe to drop “this” once — don’t wait… see a → b.", "A função não lê até à última linha. É possível reverter a alteração.", "The façade hides the naïve lookup. Résumé parsing.", "ÅÄÖ åäö sorteras sist", "├── src └── tests ├───┼───┤ │ √2 ≈ ½ µs ± 0.2",
] * 40


def read(text, true, wrong):
    table = {b: c for b, c in G._charset(wrong)[1].items()}
    return "".join(table.get(b, chr(b)) for b in text.encode(true))


@pytest.fixture(scope="module")
def judge():
    tables = [np.zeros(n, np.int64) for n in (G.TRIGRAMS, G.BIGRAMS, G.CHARS)]
    for table, index in zip(tables, G._slots(G._codes("  " + " \n  ".join(CLEAN).replace(" ", "  ") + " "))):
        table += np.bincount(index, minlength=len(table))
    return Judge(Model(*tables), 4.0)


def test_clean_text_is_no_case(judge):
    for text in CLEAN[:11] + [None, "", "ascii only", "ÅÄÖ åäö sorteras sist", "a &amp; b &lt;c&gt; &eacute;t&eacute;"]:
        assert judge.text(text) == (None, None), text


def test_utf8_read_as_something_else_is_restored(judge):
    for wrong in ("latin-1", "cp1252", "cp1251", "cp437", "mac-roman", "cp1250", "cp850"):
        for text in CLEAN[:5]:
            name, restored = judge.text("plain line\n" + read(text, "utf-8", wrong) + "\nend")
            assert name is not None and restored == "plain line\n" + text + "\nend", (wrong, restored)


def test_twice_and_entities(judge):
    text = "Für größere Verzeichnisse genügt die Zählung"
    assert judge.text(read(read(text, "utf-8", "cp1252"), "utf-8", "cp1252"))[1] == text
    once = read(text, "utf-8", "cp1252")
    assert judge.text(once.replace("Ã", "&Atilde;"))[1] == text


def test_legacy_encodings(judge):
    assert judge.text(read(CLEAN[4], "koi8-r", "cp1251"))[1] == CLEAN[4]
    assert judge.text(read(CLEAN[4], "cp1251", "latin-1"))[1] == CLEAN[4]
    assert judge.text(read(CLEAN[0], "cp850", "cp1252"))[1] == CLEAN[0]


def test_lost_characters(judge):
    assert judge.text("The fa�ade hides it") == ("lost", "The fa�ade hides it")
    assert judge.text("The decoder emits U+FFFD (�) for bytes") == (None, None)
    assert judge.text("Itâs safe to drop")[1] == "It’s safe to drop"


def test_talk_about_garbled_characters(judge):
    for text in ("The page showed “Ã©” where “é” was meant.", "Typing â€™ by hand is how it starts.", "must contain the literal “Ã¼” next to “ü”."):
        assert judge.text(text) == (None, None), text


def test_chains_leave_ascii_alone():
    assert list(chains("plain")) == []


def test_restore(spark):
    rows = [(i, t, "x") for i, t in enumerate(CLEAN)]
    rows += [(1000, read(CLEAN[0], "utf-8", "cp1252"), "x"), (1000, read(CLEAN[0], "utf-8", "cp1252"), "x"), (1001, None, None), (1002, "", "x"), (1003, "long " * 50_000 + "\n" + read(CLEAN[2], "utf-8", "latin-1"), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, chain string")
    got = sorted((r.doc_id, r.restored.split("\n")[-1]) for r in restore(df).collect())
    assert got == [(1000, CLEAN[0]), (1000, CLEAN[0]), (1003, CLEAN[2])]
    assert restore(df.limit(0)).count() == 0


def test_every_chain_of_two_readings_is_restored(judge):
    """Whatever the first wrong reading was and whatever the second, as long as both can spell the bytes."""
    text, missed = "Für größere Verzeichnisse genügt die Zählung nicht. Die Suche überspringt Einträge.", []
    for first in G.READ_AS:
        for second in G.READ_AS:
            twice = read(read(text, "utf-8", first), "utf-8", second)
            words = {w for name, w in chains(twice.split(" ")[1])}
            if "größere" not in words:
                missed.append((first, second))
    assert not missed, missed


def test_entities_over_another_garbling(judge):
    garbled = read("größere", "utf-8", "cp850")
    entities = "".join(f"&#{ord(c)};" if ord(c) > 127 else c for c in garbled)
    assert "größere" in {w for _, w in chains(entities)}


DANISH = ["brød", "følger", "være", "gjør", "først", "værdi", "sætter", "større"]


@pytest.fixture(scope="module")
def halved(spark):
    """(doc_id, text) of which only one half, by the hash of the key, has words that a model without them takes for garbled."""
    halves = spark.range(400).select("id", G._half("id")).collect()
    return [(k, CLEAN[k % 10] + (f"\n{DANISH[k % 8]}\nnote{k}\u00e9 &eacute;t&eacute;" if half == 0 else "")) for k, half in halves]


def test_margin_is_validated_on_the_words_of_both_halves(spark, halved, monkeypatch):
    found, margin_of = [], G.margin_of
    monkeypatch.setattr(G, "margin_of", lambda *given: found.append(margin_of(*given)) or found[-1])
    restore(spark.createDataFrame(halved, "doc_id long, text string"))
    assert found == [7.0]


def test_errors_count_every_word_of_every_clean_line(spark, halved):
    rows = halved + [(k, CLEAN[k % 10] + "\n" + read(CLEAN[k % 5], "utf-8", "cp1250") + "\n" + CLEAN[10]) for k in range(400, 440)]
    df = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "ascii only")], "doc_id long, text string")
    tables = G.counts(df)
    broadcast = spark.sparkContext.broadcast(tables)
    words = G.clean_words(G.judged(df, broadcast))
    got = {r["margin"]: tuple(r)[1:] for r in G.errors_of(words, broadcast).collect()}
    judges = [Judge(Model(*x), G.MARGINS[-1]) for x in (tables[1], tables[0], [a + b for a, b in zip(*tables)])]
    clean = []
    for half, text in df.where("text is not null").select(G._half("doc_id"), "text").collect():
        for line in text.split("\n"):
            if not judges[2].line(line):
                clean += [(2 if G.suspicious(line) else half, w) for w in line.split() if not w.isascii() or G._ENTITY.search(w)]
    counted = words.collect()
    assert sum(r.n0 + r.n1 + r.n2 for r in counted) == len(clean) and len(counted) == len({w for _, w in clean}) > 200
    assert {"brød", "µs", "&eacute;t&eacute;"} < {r.w for r in counted} and not any("Ă" in r.w for r in counted)
    gains = [judges[i].gain(w) for i, w in clean]
    bad = [judges[i].gain(form) for i, w in set(clean) if not w.isascii() for form in G._garbled_on_purpose(w)]
    assert got == {m: (sum(g >= m for g in gains), len(gains), sum(g < m for g in bad), len(bad)) for m in G.MARGINS}


def test_cases_of_one_pass_are_those_of_each_margin(spark, halved):
    texts = [t for _, t in halved[:20]] + ["├───┼───┤ děti", "├───┼───┤ smazání\n" + read(CLEAN[2], "utf-8", "latin-1"), "følger\n" + read(CLEAN[3], "cp1250", "cp1252"), "µs", "The fa�ade hides µs", "“Ã©” is é", read(CLEAN[1], "utf-8", "cp1250")]
    df = spark.createDataFrame(halved + list(enumerate(texts, 2000)) + [(3000, None)], "doc_id long, text string")
    tables = G.counts(df)
    rows = G.judged(df, spark.sparkContext.broadcast(tables)).where("w is null").collect()
    whole = Model(*(a + b for a, b in zip(*tables)))
    for margin in G.MARGINS:
        judge = Judge(whole, margin)
        expected = [(k, *judge.text(t)) for k, t in df.collect() if judge.text(t)[0]]
        assert sorted((r.k, r.chain, r.restored) for r in rows if r.least <= margin <= r.most) == sorted(expected)
    assert len({r.most for r in rows}) > 1  # some depend on the margin: the counts leave out lines of ├┼┤
