import pytest
from pyspark.sql import functions as F

from lexisift.llm import encoding as en

TEXTS = ["Prüft die Größe der übergebenen Schlüssel", "Déjà validé par l’équipe, ne pas réécrire", "Usuń puste wiersze przed wysłaniem", "Příliš žluté záznamy přeskočí", "Возвращает список ошибок", "Añade la configuración según el tamaño", "設定ファイルを読み込む", "默认配置不要修改"]
CASES = [(t, "utf-8", w) for t in TEXTS for w in ("latin-1", "cp1252", "mac_roman", "cp437", "cp1250", "cp1251")] + [
    (TEXTS[4], "cp1251", "latin-1"), (TEXTS[4], "koi8-r", "cp1251"), (TEXTS[2], "cp1250", "latin-1"), (TEXTS[3], "cp1250", "cp1252"), (TEXTS[0], "cp1252", "cp437"), (TEXTS[7], "gbk", "latin-1"), (TEXTS[6], "euc_jp", "latin-1"),
]


@pytest.mark.parametrize("text, true, wrong", CASES)
def test_garbled_text_is_found_and_mostly_restored(text, true, wrong):
    table = {v: k for k, v in en._table(wrong).items()}
    garbled = "".join(table.get(b, chr(b)) for b in text.encode(true))
    found, lost, back = en.restore("x = 1  # " + garbled + "\nvalue = 'plain'\n")
    assert found > 0
    if true == "utf-8":
        assert back == "x = 1  # " + text + "\nvalue = 'plain'\n" and lost == 0


@pytest.mark.parametrize("text", [*TEXTS, "m² and 5µs, Δt, 10±2 °C © Acme™", "Ärger über 3 €", "“quoted” – «dit» ¿qué? ¡sí!", "Σχόλιο για τον κώδικα", "αβγ = x", "안녕하세요", "n° 5, 1ª vez", "", None, "plain"])
def test_proper_text_stays(text):
    found, lost, back = en.restore(text)
    assert (found, lost, back) == (0, 0, text)


def test_mixed_text_keeps_its_proper_part():
    found, _, back = en.restore("# Größe und GrÃ¶ÃŸe, café\n")
    assert found == 1 and back == "# Größe und Größe, café\n"


def test_lost_and_twice_garbled():
    assert en.restore("Stra\ufffde")[:2] == (1, 1)
    twice = "Größe".encode().decode("cp1252").encode().decode("cp1252")
    assert en.restore(twice)[2] == "Größe"


def test_column(spark):
    df = spark.createDataFrame([(1, "GrÃ¶ÃŸe"), (2, None), (3, ""), (4, "x" * 100_000), (5, "Größe")], "i int, content string")
    got = {r["i"]: (r["n"], r["t"]) for r in en.repair(df).select("i", F.col("repair.n_garbled").alias("n"), F.col("repair.restored").alias("t")).collect()}
    assert got == {1: (1, "Größe"), 2: (0, None), 3: (0, ""), 4: (0, "x" * 100_000), 5: (0, "Größe")}


def test_long_lines_take_linear_time():
    import time

    began = time.time()
    for text in ("x" * 300_000 + "\nGrÃ¶ÃŸe", "é" + "x" * 300_000 + " ÃŸ", "a1" * 200_000 + " é\r\nok"):
        en.restore(text)
    assert time.time() - began < 10


def test_only_matched_words_change(monkeypatch):
    """Without the automaton's matches nothing is found, and a word that none touches stays, however odd its letters are."""
    import ahocorasick

    text = "# GrÃ¶ÃŸe, Stra�e, Возвращает ò÷ý"
    assert en.restore(text)[0] > 0
    none = ahocorasick.Automaton()
    none.add_word("\x00never\x00", 1)
    none.make_automaton()
    monkeypatch.setattr(en, "automaton", lambda: none)
    assert en.restore(text) == (0, 0, text)
