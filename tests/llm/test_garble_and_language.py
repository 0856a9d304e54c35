"""Wrong encodings: round trips of every kind; languages: held-out accuracy."""

from __future__ import annotations

import random

import numpy as np
import pytest

from corpusloom.llm.garble import CANDIDATES, Model, apply_rule, pair_counts, repaired_lines, values_of, votes
from corpusloom.llm.language import fit

RU = ["очередь сохраняет короткие ответы", "счётчик пропускает пустые заголовки", "архив проверяет старые записи", "граф ссылок хранит адреса", "узел исправляет ошибки"]
FR = ["le robot répare les entrées répétées", "l’été a passé près de la forêt", "chaque élève préfère la lumière", "où sont passées les années", "une idée très ancienne"]
ZH = ["抓取程序在下一轮之前保存多个快照", "归档库在高负载下检查过期的条目", "解析器在一次遍历中收集错误报告", "下载线程稍等片刻后修复短地址", "链接图在每一层结束时统计词项表"]
DE = ["die Höflichkeitspause prüft große Antworten", "alte Menüs füllten fast alle Speicher", "für kleine Auftritte gilt das nächste Mal", "Überschriften über schöne Gärten", "ein Zähler löscht ältere Einträge"]


def wrong(text, right, seen):
    return text.encode(right).decode(seen)


def clean_docs():
    rng = random.Random(2)
    rows = []
    for i in range(2400):
        group = (RU, FR, ZH, DE)[i % 4]
        a, b, c = (rng.choice(group) for _ in range(3))
        rows.append((i, "Title – Ünder Étude", f"{a}, {b}.\n\nName{i} {c}.\nShared notice © of the house of words number {i} – déjà vu."))
    return rows


KINDS = [
    (DE[0] + ", " + DE[1], "utf-8", "cp1252"),
    (FR[0] + ", " + FR[1], "utf-8", "latin-1"),
    (DE[2] + ", " + DE[4], "utf-8", "cp437"),
    (FR[2] + ", " + FR[3], "utf-8", "cp850"),
    (RU[0] + ", " + RU[1], "utf-8", "cp1251"),
    (RU[2] + ", " + RU[3], "cp1251", "latin-1"),
    (RU[1] + ", " + RU[4], "koi8-r", "cp1251"),
    (ZH[0] + "，" + ZH[1], "gbk", "latin-1"),
    (ZH[2] + "，" + ZH[3], "utf-8", "latin-1"),
]


@pytest.fixture(scope="module")
def repaired(spark):
    rows = clean_docs()
    planted = {}
    for k, (text, right, seen) in enumerate(KINDS):
        for j in range(3):
            planted[1000 + 10 * k + j] = text
            rows.append((1000 + 10 * k + j, "plain", wrong(text, right, seen)))
    twice = wrong(wrong(DE[0], "utf-8", "latin-1"), "utf-8", "latin-1")
    rows += [(2000, "x", twice), (2001, "na�ve", None), (2002, None, ""), (2003, "", "  "), (2004, "q", "plain text"), (2004, "q", "plain text")]
    rows += [(2100 + i, "t", "This sample shows garbled text as seen by readers: dÃ©jÃ\xa0 vÃ©rifiÃ© and nothing else at all.") for i in range(6)]
    df = spark.createDataFrame([(*r, "s1" if 1000 <= r[0] < 2000 else f"s{r[0] % 9}", "extra") for r in rows], "doc_id long, title string, text string, site string, line string")
    from pyspark.sql import functions as F

    return {(r["id"], r["field"]): (r["state"], r["restored"]) for r in repaired_lines(df, "doc_id", F.col("site")).where("state <> 'clean'").collect()}, planted


def test_every_kind_is_found_and_undone(repaired):
    got, planted = repaired
    for i, text in planted.items():
        assert got[i, "text"] == ("restored", text)
    assert got[2000, "text"] == ("restored", DE[0])


def test_lost_shown_and_clean(repaired):
    got, planted = repaired
    assert got[2001, "title"][0] in ("lost", "twin")
    assert {got[2100 + i, "text"][0] for i in range(6)} == {"shown"}
    assert {k for k, v in got.items() if v[0] != "shown"} == {(i, "text") for i in planted} | {(2000, "text"), (2001, "title")}


def test_votes_by_alignment():
    assert ("utf-8", "cp1252") in votes(wrong("a é b ü c", "utf-8", "cp1252"), "a é b ü c")
    assert ("koi8-r", "cp1251") in votes(wrong("a очередь b", "koi8-r", "cp1251"), "a очередь b")
    assert votes("same é", "same é") == [] and votes("a é", "b ü") == []


def test_rules_leave_clean_text_alone(spark):
    df = spark.createDataFrame(clean_docs(), "doc_id long, title string, text string")
    model = Model(pair_counts(values_of(df)))
    for _, _, text in clean_docs()[:60]:
        for line in text.split("\n"):
            assert model.restore(line) == (line, False)
    assert apply_rule("plain", *CANDIDATES[0]) == "plain"


def test_empty_table(spark):
    assert repaired_lines(spark.createDataFrame([], "doc_id long, title string, text string")).collect() == []


WORDS = {
    "en": "the queue stores short pages because each reader checks the old entries before next round while small hosts wait for their turn and nobody noticed what happened".split(),
    "de": "die Warteschlange speichert kurze Seiten weil jeder Leser die alten Einträge vor der nächsten Runde prüft während kleine Rechner warten und niemand bemerkte was geschah".split(),
    "fr": "la file enregistre les pages courtes car chaque lecteur vérifie les anciennes entrées avant la tournée suivante pendant que les petits serveurs attendent leur tour sans savoir".split(),
    "es": "la cola guarda las páginas cortas porque cada lector revisa las entradas antiguas antes de la próxima ronda mientras los servidores pequeños esperan su turno y nadie notó".split(),
    "pt": "a fila guarda as páginas curtas porque cada leitor verifica as entradas antigas antes da próxima ronda enquanto os servidores pequenos esperam a sua vez e ninguém reparou".split(),
}


def sentences(n, seed):
    rng = random.Random(seed)
    return [(lang, " ".join(rng.choice(words) for _ in range(12))) for lang, words in WORDS.items() for _ in range(n)]


def test_languages_on_held_out_lines():
    rng = random.Random(0)
    train = [(rng.choice(list(WORDS)) if rng.random() < 0.08 else lang, x) for lang, x in sentences(120, 1)]  # 8 % wrong labels
    machines = fit(train)
    test = sentences(60, 2)
    got, conf = machines.classify([x for _, x in test])
    assert np.mean([a == b for (a, _), b in zip(test, got, strict=True)]) > 0.97
    assert ((conf > 0.5) & (conf <= 1)).all()


def test_scripts_and_lines_without_letters():
    machines = fit(sentences(40, 1))
    got, _ = machines.classify([*ZH, *RU, "抓取程序 in Kebabrobrenel 3.4", "Счётчик в Kebabrobrenel 3.4", "404", "", "…"])
    assert got == ["zh"] * 5 + ["ru"] * 5 + ["zh", "ru", None, None, None]


def test_machines_without_samples():
    assert fit([]).classify(["some words here"])[0][0] in {"en", "de", "fr", "es", "pt"}


def test_long_lines_decoded_twice_vote():
    clean = " ".join(DE) + " x" * 2500
    assert len(clean) > 4000
    twice = wrong(wrong(clean, "utf-8", "latin-1"), "utf-8", "latin-1")
    assert ("utf-8", "latin-1") in votes(twice, clean)


def polish(seed):
    """A sentence of invented words with the letters of iso8859-2, and figures."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdklmnprstwz") + rng.choice("aeioąęóyżłśźć") for _ in range(3))
    return " ".join(word() for _ in range(9)) + f" {seed}."


def test_an_unlisted_encoding_is_inferred_from_twins(spark):
    """iso8859-2 read as cp1252 is no candidate: its pieces are learned from aligned twins and applied to lines without one."""
    from corpusloom.llm.garble import inferred, repaired_lines, votes

    garbled = [polish(k).encode("iso8859-2").decode("cp1252") for k in range(40)]
    assert ("iso8859-2", "cp1252") not in CANDIDATES and votes(garbled[0], polish(0)) == []
    assert dict(inferred(garbled[3], polish(3))).items() <= {bytes([b]).decode("cp1252", "replace"): bytes([b]).decode("iso8859-2") for b in range(0xA0, 0x100)}.items()
    rows = [(k, f"http://a{k % 7}.test/{k}", f"s{k % 7}", None, f"{polish(k)}\n{polish(5000 + k)}") for k in range(3000)]
    rows += [(10_000 + k, f"http://b.test/{k}", "b", None, garbled[k]) for k in range(5)]  # with a twin
    rows += [(20_000 + k, f"http://b.test/{k}", "b", None, polish(9000 + k).encode("iso8859-2").decode("cp1252")) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, url string, source string, title string, text string")
    got = {(r["id"], r["line_no"]): (r["restored"], r["state"]) for r in repaired_lines(df, "doc_id").where("state in ('restored', 'twin', 'lost')").collect()}
    assert {i for i, _ in got} == {*range(10_000, 10_005), *range(20_000, 20_003)}
    assert sum(got[20_000 + k, 0][0] == polish(9000 + k) for k in range(3)) >= 2
    assert all(got[10_000 + k, 0][0] == polish(k) for k in range(5))


def test_words_in_the_same_places_are_no_twins():
    """Equal blanks and marks do not make two lines of another script the same words."""
    from corpusloom.llm.garble import inferred

    assert inferred("快速贷款 nabo 代理", "首选马上 nabo 在线") == []
    assert inferred("Müller fand übers Dünne", "Möller fand öbers Dönne") == [("ü", "ö")]  # a vote, which a likelier wording must bear out
    assert inferred("caf� x", "café x") == [] and inferred("äa", "bä") == [] and inferred("", "") == []


def test_twice_and_thrice_decoded_lines_of_any_length():
    counts = np.zeros(1 << 19, dtype=np.int64)
    from corpusloom.llm.garble import pair_slots, points_of

    clean = "Die Höflichkeit prüft ältere Einträge, während die Größe wächst. " * 160
    for _ in range(30):
        counts += np.bincount(np.unique(pair_slots(points_of(clean))[1]), minlength=1 << 19)
    model, bad = Model(counts), clean
    assert len(clean) > 10_000
    for _ in range(4):
        bad = bad.encode().decode("cp1252", "replace") if all(ord(c) < 0x2600 for c in bad) else bad
        if "�" in bad:
            break
        assert model.restore(bad) == (clean, True)


def test_long_documents_need_surer_lines():
    from corpusloom.llm.queries_language import others

    short = [(80, "de", 0.9)] * 10 + [(80, "fr", 0.85)]
    assert others(short, "de") == {"fr"}
    assert others([(80, "de", 0.9)] * 3000 + [(80, "fr", 0.85)], "de") == set()
    assert others([(80, "de", 0.9)] * 3000 + [(80, "fr", 0.9999)], "de") == {"fr"}
    assert others([(80, "de", 0.9)] * 300 + [(80, "fr", 0.85)] * 60, "de") == {"fr"}
    assert others([(80, "de", 0.9)] * 5 + [(20, "fr", 0.99), (50, None, 0.0)], "de") == set()


def test_the_sample_takes_few_lines_of_a_document():
    from corpusloom.llm.body import Judged
    from corpusloom.llm.language import LINE_CHARS, RECORD_LINES
    from corpusloom.llm.queries_language import drawn

    j = Judged(1, None, [f"line number {k} of a long log" for k in range(3000)] + ["x" * 50_000], [1] * 3001)
    got = drawn(j)
    assert len(got) == RECORD_LINES == len(set(got)) and max(map(len, got)) <= LINE_CHARS and drawn(j) == got


#: Everyday sentences on other matters and of other make than those the machines are fitted on; one language after the other.
EVERYDAY = {
    "en": ["The cat and the dog sat by the fire and waited for the children.", "Snow fell while they were on their way to the old mill.", "Nobody noticed that the small boat was gone before the next morning."],
    "de": ["Die Katze und der Hund saßen am Feuer und warteten auf die Kinder.", "Es schneite, während sie auf dem Weg zur alten Mühle waren.", "Niemand bemerkte, dass das kleine Boot vor dem nächsten Morgen weg war."],
    "fr": ["Le chat et le chien attendaient les enfants près de la cheminée.", "La neige tombait pendant que chaque voisin rentrait avant la nuit.", "Les petits bateaux attendent leur tour car la mer est trop haute."],
    "es": ["El gato y el perro esperan a los niños porque la cena está lista.", "La nieve caía mientras los vecinos antiguos esperan su turno.", "Nadie notó que las barcas pequeñas no estaban antes de la mañana."],
    "pt": ["O gato e o cão esperam as crianças porque o jantar está pronto.", "A neve caía enquanto os vizinhos esperam a sua vez e ninguém reparou.", "As barcas pequenas não estavam antes da manhã, porque o mar é alto."],
}


def test_languages_on_another_style():
    """Fitted on word salads of one field, tried on everyday sentences; unknown words are most of them."""
    machines = fit(sentences(120, 1))
    test = [(lang, x) for lang, xs in EVERYDAY.items() for x in xs]
    got, _ = machines.classify([x for _, x in test])
    assert np.mean([a == b for (a, _), b in zip(test, got, strict=True)]) >= 0.8, list(zip(test, got, strict=True))


def test_names_in_another_script_make_no_second_language():
    """Names and units in Latin letters stand in Han text, as lists of fields have them."""
    from corpusloom.llm.queries_language import others

    machines = fit(sentences(60, 1))
    lines = ["namostulonom_trupa: int – 归档库针对每种语言收集剩余的请求，但是计数器稍等片刻后跳过所有外部链接。", "legokestinil_truli: string – 没有人注意到 Vustekriplaver 重复询问了 15 次。", "排序阶段在一次遍历中拒绝简短的汇总（Rabraplopuskum 4.11）。"]
    got, conf = machines.classify(lines)
    assert got == ["zh"] * 3 and others([(len(x), a, c) for x, a, c in zip(lines, got, conf, strict=True)], "zh") == set()
