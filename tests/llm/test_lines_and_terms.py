"""Site lines against brute force, and term counts and weights against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm.lines import host_site, line_table, repeated_lines, site_lines, without_site_lines
from corpusloom.llm.terms import current_postings, current_rows, last_seen_counts, log_entropy, marked_terms

SCHEMA = "doc_id long, url string, source string, text string, key string, own string, site string"


def corpus(n_sites=4, n_docs=60):
    rng = random.Random(3)
    rows, i = [], 0
    for s in range(n_sites):
        for k in range(n_docs):
            words = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(8))
            lines = [words() for _ in range(4)]
            if k % 2 == 0:
                lines.insert(0, f"* Copyright {2000 + k} by Site{'abcd'[s]}")
            if k % 5 == 0:
                lines.append("OK")  # common everywhere
            if k < 5:
                lines = ["the same article fetched again, word for word", "and its second line as well", "third", "fourth line of it"] if s == 0 else lines
            source = None if k % 7 == 0 else f"site{'abcd'[s]}"
            rows.append((i, f"HTTPS://www.site{'abcd'[s]}.test:8080/{k}", source, "\n".join(lines), "x", "y", "z"))
            i += 1
    rows += [(i, "http://sitea.test/n", "sitea", None, None, None, None), (i + 1, "http://sitea.test/e", "sitea", "", None, None, None), (i + 2, None, None, "alone\n\nalone", None, None, None)]
    return rows


def site():
    return F.coalesce(F.col("source"), host_site(F.col("url")))


def test_host_site(spark):
    urls = ["http://www.A-b.test:80/x", "HTTPS://m.c.d.test", "x", None, "http://u:p@e.test"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(host_site(F.col("url"))).collect()] == ["a-b", "c.d", None, None, "e"]


def test_site_lines_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    lines = line_table(df, "doc_id", site())
    got = {(r["id"], r["line_no"]) for r in repeated_lines(lines, site_lines(lines)).collect()}
    want = {(r[0], j) for r in rows for j, x in enumerate((r[3] or "").split("\n")) if re.search("Copyright", x)}
    assert got == want


def test_clean_text_keeps_order_and_nulls(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    found = site_lines(line_table(df, "doc_id", site()))
    got = {r["id"]: (r["n_removed"], r["clean"]) for r in without_site_lines(df, "doc_id", site(), found).collect()}
    for r in rows:
        kept = None if r[3] is None else "\n".join(x for x in r[3].split("\n") if "Copyright" not in x)
        assert got[r[0]][1] == kept


def test_no_rows_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    lines = line_table(empty, "doc_id", site())
    assert repeated_lines(lines, site_lines(lines)).collect() == []
    rows = corpus()
    df = spark.createDataFrame(rows + rows[:3], SCHEMA)
    lines = line_table(df, "doc_id", site())
    assert repeated_lines(lines, site_lines(lines)).count() == 117


def test_very_long_text(spark):
    rows = corpus() + [(9999, "http://sitea.test/l", "sitea", "\n".join(["x" * 1000 + str(i) for i in range(500)] + ["Copyright 7 by Sitea"]), None, None, None)]
    lines = line_table(spark.createDataFrame(rows, SCHEMA), "doc_id", site())
    assert [r["line_no"] for r in repeated_lines(lines, site_lines(lines)).where("id = 9999").collect()] == [500]


POSTINGS = "term string, doc_id long, freq long, indexed_at timestamp_ntz, n_docs long, weight double"


def postings(spark, rows):
    return spark.createDataFrame([(*r[:3], None, 9, 1.0) if r[3] is None else (*r, 9, 1.0) for r in rows], POSTINGS.replace("timestamp_ntz", "string")).withColumn("indexed_at", F.col("indexed_at").cast("timestamp_ntz"))


def sample():
    rng = random.Random(5)
    rows = []
    for d in range(200):
        for t in {rng.randrange(1 + rng.randrange(60)) for _ in range(12)}:
            rows.append((f"t{t}", d, rng.randrange(1, 9), f"2024-01-0{1 + d % 5}"))
    rows += [("t0", d, 3, f"2023-01-0{1 + d % 5}") for d in range(50)]  # outdated
    rows += [("old", 3, 3, "2023-01-01"), (None, 1, 1, "2024-01-01"), ("t1", None, 1, "2024-01-01"), ("nofreq", 1, None, "2024-01-02"), ("notime", 900, 2, None)]
    return rows + rows[:40]


def truth(rows):
    last = defaultdict(str)
    for t, d, _, at in rows:
        if t is not None and d is not None:
            last[d] = max(last[d], at or "")
    out = {}
    for t, d, f, at in rows:
        if t is not None and d is not None and (at or "") == last[d]:
            out[t, d] = max(out.get((t, d), 0), f or 0)
    return out


def test_counts(spark):
    rows = sample()
    want = truth(rows)
    freq, docs = Counter(), Counter()
    for (t, _), f in want.items():
        freq[t] += f
        docs[t] += 1
    got = {r["term"]: (r["freq"], r["n_docs"]) for r in last_seen_counts(current_postings(postings(spark, rows))).collect()}
    assert got == {t: (freq[t], docs[t]) for t in docs}
    n = len({d for _, d in want})
    marks = {r["term"]: r["mark"] for r in marked_terms(current_postings(postings(spark, rows))).collect()}
    assert marks == {t: "common" if k > 0.3 * n else "rare" if k <= 2 else None for t, k in docs.items()}


def test_log_entropy(spark):
    rows = sample()
    want = truth(rows)
    n = len({d for _, d in want})
    per = defaultdict(dict)
    for (t, d), f in want.items():
        per[t][d] = f
    got = {(r["term"], r["doc_id"]): r["weight"] for r in log_entropy(current_postings(postings(spark, rows))).collect()}
    assert got.keys() == want.keys()
    for (t, d), w in got.items():
        total = sum(per[t].values())
        h = -sum(f / total * math.log2(f / total) for f in per[t].values() if f) if total else 0.0
        assert w == pytest.approx(math.log2(1 + per[t][d]) * max(0.0, 1 - h / math.log2(n)))


def test_terms_of_nothing(spark):
    none = current_postings(postings(spark, [("a", 1, 1, "2024-01-01")]).limit(0))
    assert last_seen_counts(none).collect() == [] and log_entropy(none).collect() == [] and marked_terms(none).collect() == []
    single = current_postings(postings(spark, [("a", 1, 1, "2024-01-01")]))
    assert log_entropy(single).first()["weight"] == pytest.approx(1.0)


def test_counters_walk_over_stored_rows(spark):
    """Repeats reach the counters; counting rows instead of comparing with the record last seen gives other results."""
    rows = sample()
    want = truth(rows)
    freq, docs = Counter(), Counter()
    for (t, _), f in want.items():
        freq[t] += f
        docs[t] += 1
    raw = current_rows(postings(spark, rows))
    assert raw.count() > len(want)
    for hot in ([], ["t0", "t1"]):
        assert {r["term"]: (r["freq"], r["n_docs"]) for r in last_seen_counts(raw, hot).collect()} == {t: (freq[t], docs[t]) for t in docs}
    assert {r["term"]: r["count"] for r in raw.groupBy("term").count().collect()} != dict(docs)
    marks = {r["term"]: r["mark"] for r in marked_terms(raw).collect()}
    n = len({d for _, d in want})
    assert marks == {t: "common" if k > 0.3 * n else "rare" if k <= 2 else None for t, k in docs.items()}


def test_significance_decides(spark):
    """Lines that are as common elsewhere are no site's own; share and count alone would take them."""
    lines = line_table(spark.createDataFrame(corpus(), SCHEMA), "doc_id", site())
    ours, plain = ({(r["site"], r["key"]) for r in site_lines(lines, tested=t).collect()} for t in (True, False))
    assert ours < plain and len(ours) == 4


def test_ranking_covers_all_pairs(spark):
    """The threshold is that of Benjamini-Hochberg over every (site, line) pair, singletons too."""
    from corpusloom.llm.lines import FDR, line_counts, site_sizes

    lines = line_table(spark.createDataFrame(corpus(), SCHEMA), "doc_id", site())
    sizes = {r["site"]: r["d_site"] for r in site_sizes(lines).collect()}
    pairs = [(r["site"], r["key"], r["d_in"]) for r in line_counts(lines).collect()]
    whole, total = Counter(), sum(sizes.values())
    for _, k, d in pairs:
        whole[k] += d

    def root(s, k, a):
        n, b = sizes[s], whole[k] - a
        m = total - n
        if a * m <= b * n:
            return 0.0
        q = (a + b) / (n + m)
        part = lambda x, y: (x * math.log(x / (y * q)) if x else 0.0) + ((y - x) * math.log((y - x) / (y * (1 - q))) if x < y else 0.0)
        return math.sqrt(max(2 * (part(a, n) + part(b, m)), 0.0))

    z = sorted((root(*p) for p in pairs), reverse=True)
    accepted = [x for i, x in enumerate(z, 1) if math.erfc(x / math.sqrt(2)) <= FDR * i / len(z)]
    found = site_lines(lines, share=0.0, least=1)
    assert found.count() == pytest.approx(len(accepted), abs=max(3, 0.02 * len(accepted)))


def test_lines_without_broadcast(spark, monkeypatch):
    """The way for site lines too many to send gives the same."""
    df = spark.createDataFrame(corpus(), SCHEMA)
    lines = line_table(df, "doc_id", site())
    found = site_lines(lines)
    one = sorted(map(tuple, repeated_lines(lines, found).collect())), sorted(map(str, without_site_lines(df, "doc_id", site(), found).collect()))
    monkeypatch.setattr("corpusloom.llm.lines.is_small", lambda *_: False)
    two = sorted(map(tuple, repeated_lines(lines, found).collect())), sorted(map(str, without_site_lines(df, "doc_id", site(), found).collect()))
    assert one == two and len(one[1]) == len(corpus())


def test_text_of_nothing_but_site_lines(spark):
    rows = [(i, "http://a.test/x", "a", "Copyright 1 by House A", None, None, None) for i in range(6)] + [(100 + i, "http://b.test/x", "b", f"line {chr(97 + i)}", None, None, None) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = site_lines(line_table(df.withColumn("doc_id", F.col("doc_id")), "doc_id", site()), fdr=0.5)
    got = {r["id"]: (r["n_removed"], r["clean"]) for r in without_site_lines(df, "doc_id", site(), found).collect()}
    assert len(got) == 26 and all(got[i] in ((1, ""), (0, "Copyright 1 by House A")) for i in range(6))
