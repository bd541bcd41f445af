"""The Merkle manifest, stratified shards and ranked search against plain loops."""

import random
import zlib
from collections import Counter
from hashlib import sha256
from math import floor, log

import pytest
from pyspark.sql import functions as F

from gravelsift.llm import merkle, oracle, places, ranking, registry, sharding


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def plain_manifest(rows):
    """Rows (doc_id, source, lang, n_chars, text) -> sorted results, level by level."""
    lowered = lambda t: t if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    by_lang = {}
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(*r), plain_leaf(*r[:4], lowered(r[4])) if hit else plain_leaf(*r)))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: plain_levels([leaf for _, _, leaf, _ in sorted(by_lang[x])]) for x in langs}
    top = plain_levels([trees[x][-1][0] for x in langs])
    out = []
    for g, lang in enumerate(langs):
        for i, (known, doc_id, leaf, seen) in enumerate(sorted(by_lang[lang])):
            proof, node = [], seen
            for tree, at in ((trees[lang], i), (top, g)):
                for level in tree[:-1]:
                    run = level[at // 8 * 8 : at // 8 * 8 + 8]
                    proof += run[: at % 8] + run[at % 8 + 1 :]
                    node, at = h(*run[: at % 8], node, *run[at % 8 + 1 :]), at // 8
            out.append((doc_id if known else None, leaf, trees[lang][-1][0], top[-1][0], h(*proof), node, node == top[-1][0]))
    return sorted(out, key=repr)


TYPES = "doc_id long, source string, lang string, n_chars long, text string, leaf string, place int, grp string"


def merkle_rows(sizes):
    random.seed(5)
    rows, k = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            k += 1
            rows.append((None if k % 50 == 0 else k % 60, random.choice(["a", "é", None]), lang, random.choice([1, None]), random.choice(["Some Text", "", None, "lower", "Ünder Ä"])))
    return rows


def found(docs, **more):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle.manifest(docs, found={"text": F.when(tampered, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))}, **more)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest_equals_the_plain_trees(spark, levels):
    """Languages of one row, of just eight and of many, with small superblocks so that trees have several levels of them."""
    sizes = {None: 3, "en": 600, "de": 8, "xx": 1, "": 65} | ({f"l{i:02}": 2 for i in range(12)} if levels == 1 else {})
    rows = merkle_rows(sizes)
    docs = spark.createDataFrame([(*r, "clash", 1, "g") for r in rows], TYPES)
    got = sorted((tuple(r) for r in found(docs, levels=levels).collect()), key=repr)
    assert got == plain_manifest(rows) and 0 < sum(r[-1] for r in got) < len(got)


def test_manifest_of_little(spark):
    docs = spark.createDataFrame([(7, "s", "en", 1, "A", "x", 0, "y")], TYPES)
    only = found(docs).collect()
    assert len(only) == 1 and only[0].leaf == only[0].subroot == only[0].root and only[0].proof_sha256 == h()
    none = found(docs.where("false"))
    assert none.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and none.count() == 0
    assert found(docs.select("doc_id", "source", "lang", "n_chars", F.repeat("text", F.lit(1_000_000)).alias("text"))).first().leaf == plain_leaf(7, "s", "en", 1, "A" * 1_000_000)


def test_places(spark):
    rows = spark.createDataFrame([(k % 3 if k % 7 else None, k * 37 % 100) for k in range(500)] + [(9, 5)] * 40, "g int, x int")
    got = places.numbered(rows, ["g"], ["x"], "test-places").collect()
    want = {}
    for r in got:
        want.setdefault(r.g, []).append(r)
    for group in want.values():
        ordered = sorted(group, key=lambda r: r._place)
        assert [r._place for r in ordered] == list(range(len(group))) and {r._total for r in group} == {len(group)}
        assert [r.x for r in ordered] == sorted(r.x for r in group)
    assert places.numbered(rows.where("false"), [], ["x"], "test-places").count() == 0


@pytest.mark.parametrize("n", [0, 5, 8, 2_003])
def test_shards_match_the_mixture(spark, n):
    """A source with half of the rows, rare ones, null ones, equal rows; more shards than rows; columns that clash."""
    rows = [(k // 2, "hot" if k % 2 else [None, "b", "c", "rare"][k % 97 % 4], "same" if k % 3 else f"t{k}", k, 99, "x") for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, slot long, shard int, rank string")
    got = sharding.interleave(docs, 8).collect()
    assert len(got) == n and Counter((r.doc_id, r.source, r.text, r["rank"]) for r in got) == Counter((r[0], r[1], r[2], r[5]) for r in rows)
    sizes = Counter(r.shard for r in got)
    assert all(sizes[s] in (n // 8, -(-n // 8)) for s in range(8)) and set(sizes) <= set(range(8))
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    totals, inside = Counter(r.source for r in got), Counter((r.source, r.shard) for r in got)
    assert all(abs(inside[x, s] - totals[x] * sizes[s] / n) <= 1 + 1e-9 for x in totals for s in sizes)
    again = sharding.interleave(docs.repartition(7), 8).collect()
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in again) == Counter((r.doc_id, r.text, r.shard, r.slot) for r in got)


def test_shard_files_hold_slots_in_order(spark, tmp_path):
    docs = spark.range(300).selectExpr("id doc_id", "if(id % 3 = 0, 'a', 'b') source", "repeat('x', cast(id as int)) text")
    placed = sharding.interleave(docs, 4)
    sharding.write_shards(placed, str(tmp_path / "shards"), files_a_shard=2)
    read = spark.read.parquet(str(tmp_path / "shards"))
    assert read.count() == 300 and read.select("shard").distinct().count() == 4
    for s in range(4):
        slots = []
        for file in sorted((tmp_path / "shards" / f"shard={s}").glob("*.parquet")):
            slots += [r.slot for r in spark.read.parquet(str(file)).collect()]
        assert slots == list(range(75))


def plain_terms(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if ord(c) > 127 or "0" <= c <= "9" or "a" <= c <= "z" or "A" <= c <= "Z":
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_search(docs, items, k):
    """docs (id, text), items (id, text) -> sorted (item, rank, doc, score)."""
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    big_n, big_l = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    asked, out = {}, []
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(plain_terms(t))
    for item, terms in asked.items():
        weight = {t: floor(1000 * log((2 * big_n + 2) / (2 * sum(t in c for _, c in counted) + 1))) for t in terms}
        scored = []
        for i, c in counted:
            if i is not None and c:
                m = 100 - 50 + (50 * c.total() * big_n) // big_l
                s = sum(weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
                if s > 0:
                    scored.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def search_tables(spark, n=400):
    random.seed(9)
    vocabulary = [f"w{i}" for i in range(60)] + ["Émile", "日本", "x1", "ÀB"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(random.choices(vocabulary, weights, k=random.randint(0, 40)))) for i in range(n)]
    docs += [(1, "W1 w1-w2\tw3"), (None, "w1 w2 w59"), (7_000, None), (7_001, ""), (7_002, " ...\x00 "), (7_003, "w5 " * 50_000), (7_004, docs[3][1]), (7_005, docs[3][1])]
    items = [(1, "w1, W2 w59"), (2, "w3"), (2, "w4 w3"), (3, ""), (4, None), (None, "w1"), (5, "unknown words"), (6, " ".join(vocabulary) * 2), (7, "émile 日本 ÀB àb x1"), (8, "w0")]
    return docs, items


def rank_rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("size", [ranking.Sizes(), ranking.Sizes(16, 100, 64, scored=1), ranking.Sizes(50, query_bytes=40, scored=4)])
def test_search_equals_the_plain_ranking(spark, size):
    """Ties, repeated and null ids, masks of over 64 terms; blocks of any size, queries in one part or several."""
    docs, items = search_tables(spark)
    clash = spark.createDataFrame([(i, t, 1.0, "r") for i, t in docs], "doc_id long, text string, score double, rank string")
    found = ranking.search(clash, spark.createDataFrame(items, "item_id long, text string"), k=20, size=size)
    assert rank_rows(found) == plain_search(docs, items, 20)


def test_search_of_nothing(spark):
    docs, items = (spark.createDataFrame(x, f"{c} long, text string") for x, c in zip(search_tables(spark, 5), ("doc_id", "item_id"), strict=True))
    assert ranking.search(docs.where("false"), items).count() == 0 and ranking.search(docs, items.where("false")).count() == 0


def test_terms_in_slices(monkeypatch):
    monkeypatch.setattr(ranking, "_SLICE", 5)
    text = "ab cd abcdefghijk  é,é A.a " * 30
    assert ranking.term_counts(text) == Counter(t.encode() for t in plain_terms(text)) and not ranking.term_counts(None)


def test_sql_of_odd_rows(spark, tmp_path):
    """The SQL and the queries on tables with nulls, repeated rows and odd texts."""
    import duckdb

    docs, items = search_tables(spark, 40)
    rows = [(*r[:5],) for r in merkle_rows({None: 3, "en": 70, "de": 8})] + [(i, "s", "fr", None, t) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([x for x in items if x[0]], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name in ("op11_merkle_manifest", "op13_ranked_search"):
        df = registry.queries()[name](spark, str(tmp_path))
        want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.collect()), name
    got = registry.op12_stratified_shards(spark, str(tmp_path)).collect()
    want = con.sql(f"SELECT doc_id, size, text_crc32, law, shard, slot FROM ({oracle.shards()})").fetchall()
    assert Counter(r[:3] for r in want) == Counter(tuple(r)[:3] for r in got) and Counter(r[3:] for r in want) == Counter(tuple(r)[3:6] for r in got)
    assert all(r.text_crc32 is None or any(r.text_crc32 == zlib.crc32(t.encode()) for *_, t in rows if t is not None) for r in got)
