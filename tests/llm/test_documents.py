"""Operators 2, 6, 7, 8 and 9 on odd tables, against brute force and held-out labels."""

import math
import random
import re
from itertools import combinations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from gravelsift.llm import chosen_path, licenses, line_dedup, quality, registry, toxicity
from gravelsift.llm.common import components, table

DATA = "/root/testdata/sf0.1"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(text, n, alphabet):
    out = list(text)
    for _ in range(n if out else 0):
        k = random.randrange(len(out) or 1)
        out[k : k + random.randint(0, 1)] = random.choice(alphabet) * random.randint(0, 1)
    return "".join(out)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in components(edges)[0].collect()} == {**{i: 0 for i in range(1, 41)}, 150: 100, 200: 100}
    assert components(edges.where("false"))[0].count() == 0


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_automaton(spark, edits):
    random.seed(edits)
    pairs = [(a := "".join(random.choice("abé") for _ in range(random.randint(1, 9))), edited(a, random.randint(0, 4), "abé")) for _ in range(300)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.within_edits(F.col("a"), F.col("b"), edits).alias("near")).collect()
    assert all(r.near == (distance(r.a, r.b) <= edits) for r in rows)


def test_lines_against_brute_force(spark):
    random.seed(2)
    base = ["".join(random.choice("abcdef é") for _ in range(random.randint(24, 50))) for _ in range(30)]
    docs = [(i, "\n".join(edited(random.choice(base), random.randint(0, 3), "abé") for _ in range(4))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lines = {(i, k): x for i, t in docs for k, x in enumerate(t.split("\n"))}
    root = {p: p for p in lines}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for p, q in combinations(sorted(lines), 2):
        a, b = lines[p], lines[q]
        if a.strip() and b.strip() and (a == b or min(len(a), len(b)) >= 24 and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2):
            root[max(find(p), find(q))] = min(find(p), find(q))
    want = {i: "\n".join(lines[i, k] for k in range(t.count("\n") + 1) if find((i, k)) == (i, k)) for i, t in docs}
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(df).collect()} == want


def test_lines_of_odd_documents(odd_docs, no_docs):
    found = line_dedup.drop_repeated_lines(odd_docs)
    assert found.columns[: len(odd_docs.columns)] == odd_docs.columns and line_dedup.drop_repeated_lines(no_docs).count() == 0
    got = {r.doc_id: r for r in found.collect()}
    assert got[2].text == "" and got[2]._gl_dropped == 1 and got[1]._gl_dropped == 0 and got[3].text is None and got[4].text == ""
    assert got[8]._gl_lines == 4 and got[8]._gl_dropped == 0


def test_short_lines_of_clean_documents_stay(spark):
    long = "a line of more than twenty-four characters"
    rows = [
        (1, f"Re.\n{long}\nA.\nUn.\nDe."), (2, "Re."), (3, "A.\nDe."), (4, f"Un.\n{long}\nRe.\nA.\nits own"), (5, "A.\nDe."), (6, f"new\n{long}"), (7, "Re.\n\nRe."), (7, "Re.\n\nRe."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {1: rows[0][1], 2: "Re.", 3: "A.\nDe.", 4: "A.\nits own", 5: "", 6: "new", 7: "Re.\n\nRe."}
    got = line_dedup.drop_repeated_lines(df).collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(rows)
    left = corpus_pipeline.drop_lines(spark, df, DATA)
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 4, 6, 7, 7]


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def test_join_against_brute_force(spark, monkeypatch):
    for name, value in (("SMALL", 4), ("BLOCK", 5), ("TILE", 6)):
        monkeypatch.setattr(chosen_path, name, value)
    random.seed(6)
    words = [f"w{i}" for i in range(50)]
    base = [[random.choice(words) for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(90):
        text = list(base[0] if i % 3 == 0 else random.choice(base))
        for _ in range(random.choice((0, 0, 1, 1, 2))):
            text[random.randrange(60)] = "new"
        rows.append((i, " ".join(text)))
    got = {r.doc_id: r for r in chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = shingle_sets(rows)
    links = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert [got[i].n_links for i in sets] == [sum(i in p for p in links) for i in sets]
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {i: got[i].component_id for i in sets} == root


def test_join_repeats_runs_until_its_recall(spark, monkeypatch):
    """Texts made of passages that many share: their buckets are split, and pairs at 0.8, one in the other, need further runs."""
    for name, value in (("SMALL", 4), ("RUNS", 5)):
        monkeypatch.setattr(chosen_path, name, value)
    random.seed(9)
    passages = [[f"p{p}w{i}" for i in range(40)] for p in range(12)]
    rows = []
    for i in range(100):
        text = [w for p in random.sample(passages, 5) for w in p]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text[:165]))]
    sets = shingle_sets(rows)
    links = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def found():
        return sum(r.n_links for r in chosen_path.near_duplicates(docs).collect()) / 2 / len(links)

    assert found() > 0.99
    monkeypatch.setattr(chosen_path, "runs_needed", lambda level: 5)
    assert found() < 0.98


@pytest.mark.parametrize(("level", "runs"), [(1, 7), (5, 23)])
def test_runs_needed(level, runs):
    assert chosen_path.runs_needed(level) == runs


def test_join_of_odd_documents(odd_docs, no_docs):
    got = {r.doc_id: r for r in chosen_path.near_duplicates(odd_docs).collect()}
    assert (got[1].n_links, got[2].component_id, got[2].kept, got[5].component_id, got[6].component_id) == (1, 1, False, 5, 5)
    assert all((got[i].n_links, got[i].kept) == (0, True) for i in (3, 4, 7, 8)) and chosen_path.near_duplicates(no_docs).count() == 0


def test_join_is_the_same_for_any_order_of_repeated_ids(spark, monkeypatch):
    """Rows of one id with different texts, in any order, also where buckets split: one of the texts stands for the id."""
    monkeypatch.setattr(chosen_path, "SMALL", 2)
    words = [f"w{i}" for i in range(40)]
    one, other = " ".join(words), " ".join(reversed(words))
    rows = [(1, one), (1, other), (2, one + " more"), (3, other + " more"), (4, one + " less"), (4, one + " less"), (5, other), (6, one)]
    found = []
    for k in range(4):
        random.Random(k).shuffle(rows)
        found.append(sorted(tuple(r) for r in chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert found[0] == found[1] == found[2] == found[3] and len(found[0]) == 6
    links = {r[0]: r[1] for r in found[0]}
    assert (links[2], links[4], links[6]) in ((2, 2, 2), (3, 3, 3)) and links[1] in (2, 3) and links[5] == links[3]


def test_licenses(spark, odd_docs, no_docs):
    rows = [(1, "MIT License mit license, CC-BY cc by-sa 4.0"), (2, "Licensed under the Apache License, Version 2.0"), (3, "GNU General Public License version 3 or any later version"), (4, "mit der licence; cc"), (5, None)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == (4, 0, 6, "cc-by,mit", "cc-by,cc-by-sa-4.0,mit")
    assert got[2].labels == "apache,apache-2.0" and got[2].score == 0.95 and got[3].labels == "gpl,gpl-3"
    assert (got[4].labels, got[4].score, got[4].first_word, got[5].n_words) == ("", 0.0, None, 0)
    assert len(licenses.rules()) > 300 and licenses.scan(odd_docs).count() == odd_docs.count() and licenses.scan(no_docs).count() == 0


MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\n"
    "in the Software without restriction"
)
BSD = "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:"


@pytest.mark.parametrize(("text", "want"), [
    (MIT, "mit"), (BSD, "bsd"), ("# SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"), ("Licensed under the EPL-2.0", "epl-2.0"), ("GPLv3", "gpl-3"), ("WTFPL", "wtfpl"),
    ("// SPDX-License-Identifier: (MIT OR Apache-2.0)", "apache-2.0,mit"), ("GPL-2.0 WITH Classpath-exception-2.0", "classpath-exception,gpl-2"), ("licensed under the MIT", "mit"),
    ("Tous droits r\u00e9serv\u00e9s", "all-rights-reserved"), ("same terms as Perl itself", ""), ("under the same terms as Perl itself", "perl"), ("er kam mit dem Zug, das Apache Zelt", ""),
])
def test_signatures(spark, text, want):
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == want


def test_every_rule_passes_the_gate():
    """No rule can match a text that the gate turns away: each holds one of its strings, or a short identifier."""
    for _, keyword, pattern, label, *_ in licenses.rules():
        literal = re.sub(r"\(\?[^)]*\)\??|\[[^\]]*\]|\.\{[^}]*\}\??", " ", pattern)
        assert any(g in literal or g in keyword for g in licenses.GATE) or re.search(licenses.SHORT_GATE, literal), (label, pattern)


def test_licenses_against_brute_force(spark):
    """Base columns of whole documents, and which detections stay, by plain loops."""
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    rows += [(10**9, f"{MIT} MIT License. {BSD} apache license 2.0 or later, CC-BY-SA 4.0 cc by 4.0 mit license mit license")]
    rules = [(n, k, re.compile(p), *x) for n, k, p, *x in licenses.rules()]
    want = {}
    for i, text in rows:
        words = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = {m: [k for k in range(len(words)) if words[k : k + len(p.split())] == p.split()] for p, m in licenses.BASE.items()}
        flat = [k for ks in places.values() for k in ks]
        joined, present, found = f" {' '.join(words)} ", set(words), []
        for n, keyword, pattern, label, priority, score in rules if flat or "licen" in joined or "copyright" in joined or i == 10**9 or i % 7 == 0 else []:
            if keyword in present:
                for m in pattern.finditer(joined):
                    found.append((joined.count(" ", 0, m.start()) - 1, -(joined.count(" ", 0, m.end()) - 1), -priority, n, label, score))
        kept = [x for x in found if not any(y[:4] < x[:4] and y[1] <= x[1] and y[2] <= x[2] for y in found)]
        base = sorted(m for m, ks in places.items() if ks)
        more = {x[4] for x in kept}
        scored = max([x[5] for x in kept] + [0.6 if flat else 0.0])
        want[i] = (len(words), len(flat), min(flat, default=None), max(flat, default=None), ",".join(base), *((",".join(sorted({*base, *more})), scored) if found or flat else ("", 0.0)))
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    looked = {i for i, t in rows if i % 7 == 0 or want[i][1] or i == 10**9}
    assert {i: g[:5] for i, g in got.items()} == {i: w[:5] for i, w in want.items()}
    assert {i: got[i] for i in looked} == {i: want[i] for i in looked}


def test_licenses_across_breaks(spark):
    phrases = {"released into the public domain": "public-domain", "Creative Commons Attribution 4.0": "cc-by-4.0", "all rights reserved": "all-rights-reserved"}
    rows = [(want, phrase.replace(" ", gap)) for phrase, want in phrases.items() for gap in (" ", "\n", "-", "  ", ",\r\n\t")]
    df = spark.createDataFrame(rows, "want string, text string").withColumn("doc_id", F.monotonically_increasing_id())
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [(got[r.doc_id].labels, got[r.doc_id].score > 0) for r in df.collect()] == [(want, True) for want, _ in rows]


def test_licenses_of_null_ids_and_repeated_rows(spark):
    text = "one two three the MIT License, four Apache License 2.0 or later; five: licensed under the Apache License 2.0 and the MIT License"
    other = "released into the public domain"
    rows = [(1, text), (2, text), (2, text), (2, text), (2, other), (None, text), (None, text), (None, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scan(df).collect()
    alone = {t: licenses.scan(df.where(F.col("text") == t).limit(1)).first() for t in (text, other)}
    assert alone[text].labels == "apache,apache-2.0,mit" and alone[other].labels == "public-domain"
    want = sorted((str(i), alone[t].labels, alone[t].score) for i, t in rows)
    assert sorted((str(r.doc_id), r.labels, r.score) for r in got) == want
    keyed = df.where("doc_id = 2").select("doc_id", F.xxhash64("text").alias("hash"), F.concat(F.lit(" "), F.lower("text"), F.lit(" ")).alias("joined"))
    placed = [sorted((r.start, r.end, r.label) for r in licenses.detections(spark, k, ["doc_id", "hash"]).collect()) for k in (keyed, keyed.distinct())]
    assert placed[0] == placed[1] != []


def test_toxicity_on_held_out_labels(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    model = toxicity.fit(docs, labels, ~registry.held_out())
    rows = toxicity.score(docs.join(labels, "doc_id").where(registry.held_out()), model, ["doc_id", "toxic"]).toPandas()
    said, true = rows.score >= 0.3, rows.toxic == 1
    assert (said & true).sum() / said.sum() > 0.9 and (said & true).sum() / true.sum() > 0.85


def test_toxicity_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 0), (5, 0), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd_docs, labels)
    got = toxicity.score(odd_docs, model, ["doc_id", "n", "word"], name="toxicity").collect()
    assert len(got) == odd_docs.count() and all(0 <= r.toxicity <= 1 for r in got)
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels), ["doc_id"]).count() == 0
    assert 0 < toxicity.score(odd_docs, toxicity.fit(odd_docs, labels.where("toxic = 1")), ["doc_id"]).first().score <= 1
    alone = toxicity.score(odd_docs.where("doc_id = 4"), model, ["doc_id"]).first().score  # a batch of one empty text
    assert alone == {r.doc_id: r.toxicity for r in got if r.doc_id == 4}.get(4, alone) and 0 < alone < 1 and list(toxicity.features([""])) == []


def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    model = quality.fit_evidence(docs, labels.where(~registry.held_out()))
    rows = quality.decide(docs, model, F.col("source"), F.col("lang")).join(labels, "doc_id").where(registry.held_out()).toPandas()
    keep, good = rows._gq_keep, rows.quality == 1
    assert (keep & good).sum() / good.sum() > 0.98 and (~keep & ~good).sum() / (~good).sum() > 0.9


def test_quality_shrinks_sparse_sites(spark):
    rows = [(i, "x", "bad" if i < 50 else "good") for i in range(100)] + [(100, "x", "rare")]
    ev = spark.createDataFrame([(h, "s", 0.1 if h == "bad" else 0.9 if h == "good" else 0.0) for _, _, h in rows], "_gq_host string, _gq_section string, _gq_p double")
    paths, strength, mean, n = quality.sites(ev)
    means = {r._gq_host: r._gq_host_mean for r in paths.collect()}
    assert means["bad"] < 0.2 and means["good"] > 0.8 and 0.0 < means["rare"] < mean and n == 3


def test_quality_against_plain_loops(spark):
    """Posteriors and scores of a small table, recomputed in plain Python."""
    random.seed(9)
    rows = [(i, random.choice(("Good text here.", "BAD !!! | | |", "so so")), random.choice("xyz"), random.choice(("en", "de"))) for i in range(60)]
    model = quality.Evidence([0.0] * 10, [1.0] * 10, [-3.0, 0.0, -1.0, -2.0, 0.0, 2.0, 0.0, 0.1, 0.0, 0.5], 0.2)
    got = {r.doc_id: r for r in quality.decide(spark.createDataFrame(rows, "doc_id long, text string, h string, s string"), model, F.col("h"), F.col("s")).collect()}
    z = {i: float(quality.shape_features([t])[0] @ model.weights + model.intercept) for i, t, *_ in rows}
    p = {i: 1 / (1 + math.exp(-x)) for i, x in z.items()}
    mean = sum(p.values()) / len(p)

    def strength(groups):
        n, total = [len(g) for g in groups], [sum(g) for g in groups]
        within = max(mean * (1 - mean), 1e-6)
        between = (sum(t * t / k for t, k in zip(total, n, strict=True)) - sum(n) * mean**2 - (len(n) - 1) * within) / (sum(n) - sum(k * k for k in n) / sum(n))
        return min(1e6, max(1.0, within / max(between, 1e-9)))

    hosts = {h: [p[i] for i, _, x, _ in rows if x == h] for h in "xyz"}
    paths = {(h, s): [p[i] for i, _, x, y in rows if (x, y) == (h, s)] for _, _, h, s in rows}
    kh, kp = strength(list(hosts.values())), strength(list(paths.values()))
    for i, _, h, s in rows:
        host = (sum(hosts[h]) + kh * mean) / (len(hosts[h]) + kh)
        path = (sum(paths[h, s]) - p[i] + kp * host) / (len(paths[h, s]) - 1 + kp)
        score = 1 / (1 + math.exp(-(z[i] + math.log(path / (1 - path)) - math.log(mean / (1 - mean)))))
        assert got[i]._gq_host_mean == pytest.approx(host) and got[i]._gq_path_mean == pytest.approx(path) and got[i]._gq_score == pytest.approx(score)


def test_conflicting_labels_are_not_learnt(spark):
    rows = [(i, f"{'vile nasty' if i % 2 else 'kind calm'} words number{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, i % 2) for i in range(40)]
    plain, torn = (toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels[2:], labels + [(0, 1), (1, 0)]))
    assert (plain.features == torn.features).all() and (plain.weights == torn.weights).all()


def test_long_words_and_lines(spark):
    """One word and one line of a million characters, whole, in each operator that reads texts."""
    rows = [(1, "ab" * 500_000, "a", "en"), (2, "word " * 200_000, "a", "en"), (3, "word " * 200_000 + "x", "b", "en"), (4, "short", "b", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"]).count() == 4
    assert {r.doc_id: r._gl_dropped for r in line_dedup.drop_repeated_lines(docs).collect()} == {1: 0, 2: 0, 3: 1, 4: 0}
    assert {r.doc_id: r.component_id for r in chosen_path.near_duplicates(docs, least=0.3).collect()}[3] == 2
    assert licenses.scan(docs).where("doc_id = 2").first().n_words == 200_000


def test_quality_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (7, 0), (5, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit_evidence(odd_docs, labels)
    got = quality.decide(odd_docs, model, F.col("source"), F.col("lang"))
    assert got.count() == odd_docs.count() and got.where("_gq_score is null").count() == 0
    assert quality.decide(no_docs, quality.fit_evidence(no_docs, labels), F.col("source"), F.col("lang")).count() == 0


def test_null_and_empty_hosts_are_two_sites(spark):
    docs = spark.createDataFrame([(i, f"plain words number {i} " * 5, None if i % 2 else "") for i in range(40)], "doc_id long, text string, source string")
    model = quality.fit_evidence(docs, spark.createDataFrame([(i, int(i % 2)) for i in range(40)], "doc_id long, quality int"))
    found = quality.decide(docs.withColumn("text", F.when(F.col("source").isNull(), F.col("text")).otherwise("x")), model, F.col("source"), F.lit("s"), keep=["doc_id", "source"])
    means = {r.source: r._gq_host_mean for r in found.collect()}
    assert means[None] != means[""]
