"""Main bodies, stuffed records and source mixing on small fixtures."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm.body import corpus, furniture, main_body, stuffed_records
from corpusloom.llm.mix import mix, plan, reached, temperature
from corpusloom.llm.page import Known, kinds, recurrence, statement_share, stuffing

PROSE = "The queue stores short pages because the reader checks old entries before the next round, and nobody noticed what happened to them."
KNOWN = Known(frozenset({7}), {"The queue": 60}, {"Short pages": 60})


def marks(lines, title=None, own=(), keys=None, **more):
    """2 for everything outside the body, whatever put it there."""
    return [min(k, 2) for k in kinds(lines, keys or [0] * len(lines), set(own), KNOWN, title, **more)]


def test_menu_path_byline_teaser_and_headline():
    lines = ["Home | Blog | About us | Jobs", "Home > Topics > Short pages – Na", "By A B | 2024-01-02 | 3 min", "The queue: old entries", PROSE, "4.2 short pages – Name", PROSE, "Related: Short pages – X · The queue: y", "» Short pages – Other (12)", "Share"]
    got = marks(lines, "The queue: old entries", keys=[0] * 9 + [7])
    assert got == [2, 2, 2, 1, 1, 1, 1, 2, 2, 2]


def test_headline_without_title_and_empty_lines():
    assert marks(["» The queue: a", "The queue: b", "", PROSE, ""]) == [2, 1, 0, 1, 0]
    assert marks(["", " "]) == [0, 0] and marks([""]) == [0]


def test_site_lines_are_cut_inside_the_body():
    assert marks([PROSE, "Advertisement here", PROSE], own=(5,), keys=[1, 5, 2]) == [1, 2, 1]


def test_surge_and_dive():
    lines = ["stray words", "Home | Blog | Jobs | Docs", "A | B | C | D", PROSE, PROSE, "A | B | C | D", "Home | Blog | Jobs | Docs", "stray end"]
    assert marks(lines) == [2, 2, 2, 1, 1, 2, 2, 2]


KEYWORDS = ["casino bonus", "cheap proxy", "replica watch", "seo traffic", "diet pills", "loan offer"]


def spam(kind, seed=0):
    rng = random.Random(seed)
    k = lambda: rng.choice(KEYWORDS)
    if kind == "list":
        return [", ".join(k() for _ in range(60))]
    if kind == "tags":
        return [" ".join("#" + k().replace(" ", ".") for _ in range(40))]
    if kind == "links":
        return [f"[{k()}](http://x{i}.example/{i})" for i in range(20)]
    if kind == "products":
        return [f"{k()}  XL  -45%  {i}.99" for i in range(20)]
    if kind == "again":
        return ["The queue stores short pages before the next round casino bonus. " * 12]
    words = PROSE.split() * 3
    return [" ".join(w + " " + (KEYWORDS[0] if rng.random() < 0.7 else k()) if i % 2 else w for i, w in enumerate(words))]


@pytest.mark.parametrize("kind", ["list", "tags", "links", "products", "again", "strewn"])
def test_stuffed(kind):
    assert stuffing([spam(kind, s) for s in range(5)]) == [True] * 5


def test_not_stuffed():
    logs = [f"* {i}.1.2: The reader number{chr(97 + i)} stores old entries of host{chr(97 + i)} in the cache." for i in range(20)]
    refs = [f"[{i}] The archive of town{chr(97 + i)} keeps a list of its pages. https://a{i}.example/b" for i in range(10)]
    for lines in ([PROSE], [PROSE, "4.2 short pages – Name"], logs, refs, [], [""], ["OK"], ["404"], ["抓取程序在下一轮之前保存多个快照。归档库在高负载下检查过期的条目。"]):
        assert not stuffing([lines])[0], lines


def test_figures():
    assert statement_share([]) == (1.0, 0)
    assert [list(x) for x in recurrence([[], [""], ["of the"]])] == [[0, 0, 0]] + [[0.0, 0.0, 0.0]] * 3 + [[False] * 3]
    assert stuffing([]) == []
    said, total = statement_share([PROSE, "a b c"])
    assert said == pytest.approx(len(PROSE) / (len(PROSE) + 5)) and total == len(PROSE) + 5


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    names = [a + b for a in ("ba", "ke", "to", "mi", "su") for b in ("lor", "ran", "tik", "vum")]
    rows = []
    for i in range(200):
        body = [f"The {rng.choice(names)} of {rng.choice(names)} keeps the pages that {rng.choice(names)} read in the week before, and it is not the {rng.choice(names)} we know." for _ in range(4)]
        rows.append((i, "http://a.test/x", f"Title {i}", "\n".join([f"Menu one {i} | Two | Three", *body, f"Copyright {i} of House A"]), None, None))
    for i in range(200, 206):
        rows.append((i, "http://a.test/x", None, "\n".join(["Menu one | Two | Three", *spam("list", i)]), None, "x"))
    rows += [(300, "http://a.test/n", None, None, None, None), (301, "http://a.test/e", "", "", None, None), (302, None, "https://t", " \n ", None, None)]
    return spark.createDataFrame(rows, "doc_id long, url string, title string, text string, keys array<long>, own string")


def test_tables(spark, table):
    c = corpus(table, "doc_id", F.lit("a"))
    assert sorted(r["id"] for r in stuffed_records(c).collect()) == list(range(200, 206))
    got = defaultdict(set)
    for r in furniture(c).collect():
        got[r["id"]].add(r["line_no"])
    assert got == {i: {0, 5} for i in range(200)}
    bodies = {r["id"]: r["body"] for r in main_body(c).collect()}
    assert bodies[300] is None and bodies[301] == "" and len(bodies) == 209
    assert bodies[7].count("\n") == 3 and "Menu" not in bodies[7]


def test_empty_table(spark, table):
    c = corpus(table.limit(0), "doc_id", F.lit("a"))
    assert furniture(c).collect() == [] and stuffed_records(c).collect() == [] and main_body(c).collect() == []


def sizes(spark):
    rng = random.Random(4)
    rows = [(i, "abc"[min(i % 9, 2)], rng.randrange(0, 400)) for i in range(4000)]
    return spark.createDataFrame(rows, "id long, source string, n_tokens long"), rows


def test_mix_reaches_its_targets(spark):
    df, rows = sizes(spark)
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 1), ("c", 0.2, None), ("gone", 0.4, 2), ("none", None, 2)], "source string, target_share double, max_repeats int")
    for blocks in (1, 7, 512):
        chosen = mix(df, targets, blocks=blocks)
        got = {r["source"]: r for r in reached(chosen, targets).collect()}
        for s, share, most in (("a", 0.5, 3), ("b", 0.3, 1), ("c", 0.2, 1)):
            assert got[s]["share"] == pytest.approx(share, abs=0.002) and got[s]["most_times"] <= most
        assert got["gone"]["tokens"] == 0
    tokens = {s: sum(n for _, x, n in rows if x == s) for s in "abc"}
    total = min(tokens["a"] * 3 / 0.5, tokens["b"] / 0.3, tokens["c"] / 0.2)
    assert sum(q for _, _, q, _ in plan(df, targets)) == pytest.approx(total)


def test_mix_is_repeatable_and_takes_empty_tables(spark):
    df, _ = sizes(spark)
    targets = spark.createDataFrame([("a", 0.5, 2), ("c", 0.5, 2)], "source string, target_share double, max_repeats int")
    one, two = (sorted(map(tuple, mix(d, targets, seed=3).collect())) for d in (df, df.repartition(5)))
    assert one == two and len(one) > 0
    assert mix(df.limit(0), targets).collect() == [] and mix(df, targets.limit(0)).collect() == []


def test_temperature():
    known = {"a": 900.0, "b": 90.0, "c": 10.0}
    for wanted in (0.4, 0.7, 1.0):
        a, w = temperature(known, entropy=wanted)
        assert -sum(x * math.log(x) for x in w.values()) == pytest.approx(wanted, abs=1e-6) and 0 <= a <= 1
    a, w = temperature(known, repeats={"a": 1, "b": 3, "c": 5}, budget=500)
    assert all(w[s] * 500 <= known[s] * k * (1 + 1e-9) for s, k in (("a", 1), ("b", 3), ("c", 5)))
    assert temperature({}, entropy=1.0) == (1.0, {})


def test_garbled_text_is_restored_whatever_was_mistaken(spark):
    clean = {
        "mac-roman": "Ninguém reparou que a fila já não tem espaço para as ligações.",
        "cp1250": "The error report – “notes” – was read before the next round.",
        "cp866": "Очередь сохраняет короткие ответы, а счётчик пропускает пустые.",
        "iso8859-15": "L’été a passé près de la forêt, où chaque élève préfère la lumière.",
    }
    rows = [(10 * k + j, f"T{k} – é", f"{text}\nName {10 * k + j} {PROSE}") for k, text in enumerate(clean.values()) for j in range(8)]
    rows += [(1000 + k, None, f"{text.encode().decode(seen, 'replace')}\nName {k} {PROSE}") for k, (seen, text) in enumerate(clean.items())]
    df = spark.createDataFrame(rows, "doc_id long, title string, text string")
    got = {r["id"]: r["body"] for r in main_body(corpus(df, "doc_id", F.col("doc_id").cast("string"))).collect()}
    assert [got[1000 + k].split("\n")[0] for k in range(len(clean))] == list(clean.values())


def test_link_lists_without_text(spark):
    away = [f"http://shop{k}.example/{k}" for k in range(50)]
    home = [f"https://www.a.test/p/{k}" for k in range(20)]
    rows = [(i, None, f"{PROSE}\nName {i} {PROSE}", home) for i in range(20)]
    rows += [
        (100, None, None, away), (101, None, "Menu | Home | Blog", away + home[:3]), (102, None, "", [*away, None, away[0]]),
        (200, None, None, home + away[:30]), (201, None, f"{PROSE} Name {PROSE}", away), (202, None, None, away[:20] * 3), (203, None, None, None),
    ]
    c = corpus(spark.createDataFrame(rows, "page_id long, title string, text string, links array<string>"), "page_id", F.lit("a"))
    assert sorted(r["id"] for r in stuffed_records(c).collect()) == [100, 101, 102]
    assert {r["id"] for r in furniture(c).collect()}.isdisjoint({100, 101, 102})
    bodies = {r["id"]: r["body"] for r in main_body(c).collect()}
    assert len(bodies) == len(rows) and bodies[100] is None and bodies[102] == ""


@pytest.mark.parametrize("form", ["{}_{},", "#{}-{};", "{},{},"])
def test_pairs_are_counted_whatever_joins_them(form):
    """Keywords that never stand alone between blanks, or in changing case, are strewn into sentences."""
    rng = random.Random(5)
    names = [a + b + c for a in ("ba", "ke", "to") for b in ("lor", "ran", "tik") for c in ("sem", "vul", "dap")]
    lines = []
    for k in range(6):
        lines.append(" ".join(f"The {rng.choice(names)} of the {rng.choice(names)} is what {rng.choice(names)} has, and it was not {form.format(*(('Casino', 'bonus'), ('CASINO', 'Bonus'))[(k + j) % 2])} so." for j in range(3)))
    _, near, auto, *_ = recurrence([lines])
    assert near[0] >= 0.39 and auto[0] >= 0.03 and stuffing([lines])[0]


def test_single_terms_at_steady_gaps():
    """One keyword strewn between ever different words has no fixed neighbour."""
    word = lambda k: "".join("bcdfghklmn"[int(x)] + "aeiou"[int(x) % 5] for x in str(1000 + k))
    said = lambda k, key: f"The {word(5 * k)} of the {key} is what the {word(5 * k + 1)} has, and the {word(5 * k + 2)} was not in the {word(5 * k + 3)}."
    lines = [" ".join(said(5 * i + j, "casino") for j in range(5)) for i in range(4)]
    n, near, _, steady, _ = recurrence([lines])
    assert near[0] < 0.39 and steady[0] == pytest.approx(20 / n[0]) and stuffing([lines])[0]
    # once in each line, at chance gaps or as seldom as a subject it is no stuffing
    assert not stuffing([[said(k, "casino") for k in range(20)]])[0]
    assert not stuffing([[" ".join(said(5 * i + j, "casino" if j < 2 else word(900 + 5 * i + j)) for j in range(5)) for i in range(4)]])[0]
    rng = random.Random(3)
    at = set(rng.sample(range(400), 80))
    chance = ["The " + " of the ".join("casino" if k in at else word(1000 + k) for k in range(400)) + "."]
    assert not stuffing([chance])[0]


def brute(lines):
    """Figures of `recurrence` by loops over the places of one record."""
    import re

    from corpusloom.llm.page import FUNCTION_WORDS, HAN_TERM, HAN_WORD, IN_LINE, LAGS

    placed = [(w, i) for i, x in enumerate(lines) for w in re.findall(r"[^\W\d_㐀-鿿]+|[㐀-鿿]+", x.lower()) if w not in FUNCTION_WORDS]
    n, words = len(placed), [w for w, _ in placed]
    strewn = {w for w in set(words) if words.count(w) > 1 and words.count(w) >= IN_LINE * len({i for x, i in placed if x == w})}
    han = [w for w in words if "㐀" <= w[0] <= "鿿"]
    strewn = {w for w in strewn if w in han and len(w) <= HAN_TERM or w not in han and 2 * sum(-(-len(x) // HAN_WORD) for x in han) <= n - len(han) + sum(-(-len(x) // HAN_WORD) for x in han)}
    near = sum(w in strewn and w in words[max(0, at - LAGS) : at] for at, w in enumerate(words)) / max(n, 1)
    lags = range(1, min(LAGS, max(n // 2, 1)) + 1)
    auto = sum(sum(words[at] in strewn and words[at] == words[at - lag] for at in range(lag, n)) / max(n - lag, 1) for lag in lags) / len(lags)
    return (n, near, auto) if n >= 12 else (n, 0.0, 0.0)


def test_recurrence_against_brute_force():
    rng = random.Random(9)
    records = [[" ".join(rng.choice(["alpha", "beta", "数据", "the", "delta", "数据", "下载", "下载线程每分钟一次拒绝", "x1y"]) for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(0, 5))] for _ in range(40)]
    records += [spam(k, 3) for k in ("list", "tags", "links", "products", "again", "strewn")] + [[PROSE] * 3]
    n, near, auto, *_ = recurrence(records)
    for k, lines in enumerate(records):
        assert (n[k], near[k], auto[k]) == pytest.approx(brute(lines)), lines


def test_recurrence_decides(monkeypatch):
    """Without gaps and autocorrelation keywords strewn into sentences are not found; lists of distinct nouns still are."""
    strewn, distinct = [spam("strewn", s) for s in range(5)], [", ".join(f"{a}{b} lamp" for a in "bcdfg" for b in "aeiou")]
    assert stuffing([*strewn, distinct]) == [True] * 6
    monkeypatch.setattr("corpusloom.llm.page.regular", lambda records: [False] * len(records))
    assert stuffing([*strewn, distinct]) == [False] * 5 + [True]


def test_windows_decide():
    """Without surge and dive the short lines around the body stay."""
    lines = ["Login", "Home | Blog | Jobs", "By A B, 2024-01-02, 3 min", PROSE, "4.2 Release notes", PROSE, "Prices", "Home > Topics > Queue"]
    assert marks(lines) == [2, 2, 2, 1, 1, 1, 2, 2]
    assert marks(lines, windows=False) == [1] * 8


def test_length_of_lines_does_not_matter():
    menu = " | ".join(f"Place {a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrst")
    tag = "<a href='http://x.test/" + "y" * 500 + "'>Home</a>"
    assert len(menu) > 5000
    assert marks([menu, PROSE, menu, PROSE, menu]) == [2, 1, 2, 1, 2]
    assert marks([tag, PROSE]) == [2, 1] and marks([f"<p class='{'z' * 900}'>{PROSE}</p>", "Home"]) == [1, 2]
    assert marks([PROSE, "Home | Blog | Jobs", PROSE]) == [1, 1, 1]  # too light to be a gap
    related = "Related articles that other readers of these pages have liked a lot: " + " · ".join(["The queue: old entries"] * 20)
    assert marks([PROSE, related, PROSE]) == [1, 2, 1]


def test_log_entries_with_dates_belong_to_the_body():
    lines = [f"2024-01-{k:02d} Released the fix of parser {chr(97 + k)}" for k in range(1, 9)]
    assert marks(lines) == [1] * 8


def test_slices_hold_every_row():
    from corpusloom.llm.body import SLICE_CHARS, slices

    assert list(slices([])) == [] and list(slices([3, SLICE_CHARS + 1, 4])) == [(0, 1), (1, 2), (2, 3)]
    sizes = [7] * 600
    assert [stop - start for start, stop in slices(sizes)] == [256, 256, 88]


def test_mix_passes_over_what_does_not_fit(spark):
    """One document larger than the source's quota does not end the selection."""
    rows = [(i, "a", 1000) for i in range(250)] + [(900, "a", 90_000)] + [(1000 + i, "b", 500) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.25, 1), ("b", 0.75, 1)], "source string, target_share double, max_repeats int")
    for seed in range(3):
        got = {r["source"]: r["share"] for r in reached(mix(df, targets, seed=seed), targets).collect()}
        assert got["a"] == pytest.approx(0.25, rel=0.01) and got["b"] == pytest.approx(0.75, rel=0.01)


def test_sizes_of_repeated_ids_stay_with_their_source(spark):
    from corpusloom.llm.mix import source_sizes

    rows = [(1, "a", "one two three"), (1, "b", "one"), (1, "c", None), (2, "a", "word " * 30_000), (2, "b", "word " * 30_000), (2, "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = sorted((r["id"], r["source"], r["n_tokens"]) for r in source_sizes(df, "doc_id", F.col("source")).collect())
    assert [g[:2] for g in got] == [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "b")]
    assert got[0][2] == 3 and got[1][2] == 1 and got[2][2] == 0 and got[3][2] == got[5][2] > 30_000 - 1 and got[4][2] == 1


def test_tempered_weights_are_realised(spark):
    from corpusloom.llm.mix import tempered_targets

    df, _ = sizes(spark)
    targets = spark.createDataFrame([("a", 0.1, 3), ("b", 0.2, 2), ("c", 0.7, None)], "source string, target_share double, max_repeats int")
    for wanted in (None, 0.4, 1.0):
        exponent, weights = tempered_targets(df, targets, wanted)
        shares = [r["target_share"] for r in weights.collect()]
        entropy = -sum(x * math.log(x) for x in (0.1, 0.2, 0.7)) if wanted is None else wanted
        assert -sum(x * math.log(x) for x in shares) == pytest.approx(entropy, abs=1e-6) and exponent > 0
        for r in reached(mix(df, weights), weights).collect():
            assert r["share"] == pytest.approx(r["target_share"], rel=0.01)


def test_keywords_in_han_text():
    """Keywords between clauses are stuffing; a name in Latin letters after each clause, or a clause said again, is none."""
    rng = random.Random(2)
    clause = lambda: "".join(rng.choice("抓取程序保存多个快照检查条目归档库高负载网页") for _ in range(14))
    strewn = ["".join(f"{clause()}， {rng.choice(['首选', '手机壳特价'])} {clause()}。 首选 " for _ in range(5)) for _ in range(3)]
    named = ["".join(f"{clause()}（Pilobrelaben）。{clause()}，" for _ in range(8)) for _ in range(3)]
    again = clause()
    said = ["".join(f"{clause()}。{again}。{clause()}，{clause()}。" for _ in range(6)) for _ in range(2)]
    mixed = [*named[:1], "The reader of the Pilobrelaben is old. " + " ".join(f"The {chr(97 + k)}ello of the Pilobrelaben has {chr(98 + k)}orte and {chr(99 + k)}unna." for k in range(5))]
    assert stuffing([strewn, named, said, mixed]) == [True, False, False, False]
