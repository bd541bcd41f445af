"""Matching, rules over scores, storage and lexicons on small tables."""

import json
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from gravelsift.operators import ai, analytics, lexicon, matching, storage, tokens
from gravelsift.plans.analyze import analyze, first_pass
from gravelsift.sources.readers import normalize_chat, read_lexicon, text_lines


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_units_join_up_to_six(spark):
    toks = spark.createDataFrame([(1, i, c, "NNG", i, 1) for i, c in enumerate("abcdefgh")] + [(2, 0, "x", "NNG", 0, 1), (2, 1, "y", "NNP", 1, 1), (2, 2, "z", "JKS", 2, 1)], "doc_id long, pos int, form string, tag string, start int, len int")
    assert rows(tokens.meaningful_units(toks), "doc_id", "s") == [(1, "abcdef", 0, 5, True), (1, "gh", 6, 7, True), (2, "x", 0, 0, False), (2, "y", 1, 1, False)]


def test_units_of_texts_equal_the_windows(spark):
    random.seed(3)
    kinds, texts = ("NNG", "NNP", "XR", "VV", "JKS", "UN", "SL"), [(i, "".join(random.choice("abc  ") for _ in range(40))) for i in range(30)]

    def cut(text):  # single letters, the tag by the letter and its place
        return [(c, kinds[(ord(c) + k // 3) % 7], k) for k, c in enumerate(text) if c != " "]

    docs = spark.createDataFrame(texts, "doc_id long, text string")
    toks = spark.createDataFrame([(i, p, f, g, k, 1) for i, t in texts for p, (f, g, k) in enumerate(cut(t))], "doc_id long, pos int, form string, tag string, start int, len int")
    columns = ["doc_id", "form", "s", "e", "is_compound"]
    assert rows(tokens.units_of_texts(docs, cut).select(columns), "doc_id", "s") == rows(tokens.meaningful_units(toks).select(columns), "doc_id", "s")


def test_evidence(spark):
    ev = spark.createDataFrame([(1, "basic", t, i, i + 1, 0.10) for i, t in enumerate(("a", "##b", "##c", "##d"))], "doc_id long, module string, token string, s int, e int, evidence double")
    got = tokens.evidence_spans(ev, ai.MASK).first()
    assert (got.s, got.e) == (0, 4) and got.evidence == pytest.approx(0.4 / 4**0.25)


def test_longest_and_shadow(spark):
    m = spark.createDataFrame([(1, 0, 3, "abcd", "SYSTEM_KEYWORD"), (1, 1, 2, "bc", "USER_BLACKLIST"), (1, 0, 3, "abcd", "USER_BLACKLIST"), (1, 6, 7, "xy", "SYSTEM_KEYWORD"), (1, 5, 8, "wxyz", "WHITELIST")], "doc_id long, s int, e int, word string, wtype string")
    assert rows(matching.longest(matching.drop_shadowed(m)).select("s", "e", "word", "wtype"), "s") == [(0, 3, "abcd", "USER_BLACKLIST")]


@pytest.mark.parametrize("channel", matching.CHANNELS)
def test_matches_are_the_same_for_lexicons_of_any_size(spark, monkeypatch, channel):
    """Sent whole or joined by beginnings, with the automaton or without: long words, single characters, overlaps."""
    long = "x" + "ab" * 300
    docs = spark.createDataFrame([(1, f"abcabcd ab {long}y a.b!c a{long}"), (2, ""), (3, None), (4, "b1cd")], "doc_id long, text string")
    lex = spark.createDataFrame([("abc", "A"), ("bc", "B"), ("abcd", "A"), ("zz", "B"), (long, "A"), (long + "y", "A"), ("a", "B"), ("bcd", "A"), ("ab", "A")], "word string, wtype string")
    ways = [rows(matching.match_texts(docs, lex, (channel,)), "doc_id", "s", "e", "word")]
    monkeypatch.setattr(matching, "LEXICON_CHARS", 1)
    ways.append(rows(matching.match_texts(docs, lex, (channel,)), "doc_id", "s", "e", "word"))
    monkeypatch.setattr(matching, "BEGINNINGS", 1)
    assert rows(matching.match_texts(docs, lex, (channel,)), "doc_id", "s", "e", "word") == ways[0]
    words = {"abc": "A", "bc": "B", "a": "B", long: "A"}
    search = matching.Search(None, {"ab": [3], "bc": [2], "a": [1], "xa": [len(long)]})
    single = matching.Search(None, {"a": [1, 3], "b": [2], "x": [len(long)]}, 1)
    assert sorted(m for m in single.find(f"abcbca {long}") if m[2] in words) == sorted(m for m in search.find(f"abcbca {long}") if m[2] in words)
    whole = matching.Search(words, {})
    maybe = sorted(m for m in search.find(f"abcbca {long}") if m[2] in words)
    assert maybe == sorted(whole.find(f"abcbca {long}"))
    assert ways[0] == ways[1] and len(ways[0]) >= (3 if channel == "form" else 300) and (channel == "form" or any(len(r[3]) > 256 for r in ways[0]))


def test_search_without_its_library(monkeypatch, tmp_path):
    """Not installed: the same matches. Installed but broken: an error, not a search that finds nothing."""
    words = dict.fromkeys(("a", "ab", "abc", "bc", "abcd", "zz", "\u3131\u314f", "x" + "ab" * 300), "A")
    text = "abcabcd \u3131\u314fb " + "x" + "ab" * 300 + " zzz"
    there = matching.Search(words, {})
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    for prefix in (1, 2, 3):
        missing = matching.Search(words, {}, prefix)
        assert there.automaton and not missing.automaton
        assert sorted(missing.find(text, 7)) == sorted(there.find(text, 7)) and len({m[2] for m in missing.find(text)}) == len(words)
    assert matching.hits_of(text, matching.Search(words, {})) == matching.hits_of(text, there) != []
    assert [*matching.Search({}, {}).find(text)] == []
    (tmp_path / "ahocorasick.py").write_text("raise ImportError('undefined symbol')")
    monkeypatch.syspath_prepend(tmp_path)
    monkeypatch.delitem(sys.modules, "ahocorasick")
    with pytest.raises(ImportError, match="undefined symbol"):
        matching.Search(words, {})


def test_nouns_and_given_tokens(spark):
    """A particle inside a longer token isn't a word of its own: substrings count on nouns only, forms everywhere."""
    docs = spark.createDataFrame([(1, "badge is bad"), (2, "abad")], "doc_id long, text string")
    toks = spark.createDataFrame(
        [(1, 0, "badge", "VV", 0, 5), (1, 1, "is", "JX", 6, 2), (1, 2, "bad", "VA", 9, 3), (2, 0, "ab", "NNG", 0, 2), (2, 1, "ad", "NNG", 2, 2)],
        "doc_id long, pos int, form string, tag string, start int, len int",
    )
    lex = spark.createDataFrame([("bad", "SYSTEM_KEYWORD"), ("abad", "USER_BLACKLIST")], "word string, wtype string")
    got = rows(first_pass(docs, lex, toks).select("doc_id", "s", "e", "word"), "doc_id", "s")
    assert got == [(1, 9, 11, "bad"), (2, 0, 3, "abad")]


def test_analyze(spark):
    docs = spark.createDataFrame([(1, "clean text"), (2, "an idiot here"), (3, "nation")], "doc_id long, text string")
    lex = spark.createDataFrame([("idiot", "USER_BLACKLIST"), ("tion", "SYSTEM_KEYWORD"), ("nation", "WHITELIST")], "word string, wtype string")
    got = {(r.doc_id, r.level): (r.action, r.processed_text) for r in analyze(docs, lex).collect()}
    assert got[1, "HIGH"] == ("NORMAL", "clean text") and got[3, "HIGH"] == ("NORMAL", "nation")
    tricky = spark.createDataFrame([(1, "an id1iot"), (2, "an id!!!iot")], "doc_id long, text string")
    assert [r.processed_text for r in analyze(tricky, lex, levels=("LOW",)).orderBy("doc_id").collect()] == ["an ******", "an id!!!iot"]
    assert got[2, "LOW"] == ("PARTIAL_MASK", "an ***** here") and got[2, "MEDIUM"] == ("FULL_BLOCK", "")


BLOCK = ai.BLOCK_TEXT


def second(spark, scores, text="a b", masked="a b", detected=(), spans=None, details=True, threshold=0.8):
    kind = "text string, masked string, detected array<string>, scores map<string,double>, spans array<struct<s:int,e:int>>, has_details boolean"
    return ai.apply_second_pass(spark.createDataFrame([(text, masked, list(detected), scores, spans, details)], kind), threshold).first()


@pytest.mark.parametrize(("scores", "want"), [
    ({"criticism": 0.95, "basic": 0.91}, ["basic"]), ({"criticism": 0.95, "basic": 0.10}, ["criticism"]),
    ({"basic": 0.9, "criticism": 0.9, "sexual": 0.9, "politics": 0.9}, ["basic", "politics"]), ({"criticism": 0.92, "sexual": 0.96}, ["sexual"]),
    ({"sexual": 0.96, "politics": 0.91}, ["politics"]), ({"politics": 0.91, "family": 0.96}, ["family"]), ({"pii": 0.81}, ["pii"]), ({"spam": 0.71}, ["spam"]), ({"basic": 0.1}, []),
])
def test_conflicts(spark, scores, want):
    got = second(spark, {m: 0.0 for m in ai.MODULES} | scores, detected=["w"], spans=[(0, 0)])
    assert got.detected == want and got.override == ("FULL_BLOCK" if want in (["pii"], ["spam"]) else None)
    assert got.masked == (BLOCK if got.override else "* b" if want else "a b")


@pytest.mark.parametrize("scores", [None, {}])
def test_failed_or_empty_scores_keep_the_first_pass(spark, scores):
    got = second(spark, scores, text="long text", masked="l*ng text", detected=["w"])
    assert got.detected == ["w"] and got.masked == "l*ng text" and got.override is None and got.ai_modules is None


def test_second_pass_runs_only_below_the_ratio(spark):
    assert second(spark, {"basic": 0.9}, text="abc defgh", masked="*** defgh", detected=["abc"]).detected == ["abc"]
    assert second(spark, {"basic": 0.9}, text="abc defghijk", masked="*** defghijk", detected=["abc"], spans=[(4, 5)]).masked == "abc **fghijk"
    assert second(spark, {"basic": 0.9}, text=" ", masked=" ").ai_modules is None
    assert second(spark, {"basic": 0.9}, details=False).masked == "* *" and second(spark, {"basic": 0.9}, spans=None).masked == "a b"


def test_analyze_with_scores(spark):
    docs = spark.createDataFrame([(1, "so very calm a text"), (2, "call 555 now please"), (3, "an idiot is here and there"), (4, "half a bad word"), (5, "\u314b\u314b\u314b hello")], "doc_id long, text string")
    lex = spark.createDataFrame([("idiot", "USER_BLACKLIST")], "word string, wtype string")
    scores = spark.createDataFrame([(1, {"basic": 0.9}), (2, {"pii": 0.95}), (3, {"basic": 0.1}), (4, {"spam": 0.1, "basic": 0.85}), (5, {"basic": 0.9})], "doc_id long, scores map<string,double>")
    evidence = spark.createDataFrame(
        [(1, "basic", "very", 3, 7, 0.9), (4, "basic", "bad", 7, 10, 0.1), (4, "basic", "##x", 10, 11, 0.01), (5, "basic", "laugh", 0, 3, 0.9), (1, "spam", "so", 0, 2, 0.9)],
        "doc_id long, module string, token string, s int, e int, evidence double",
    )
    found = analyze(docs, lex, levels=("MEDIUM",), scores=scores, evidence=evidence).orderBy("doc_id").collect()
    assert [(r.action, r.processed_text, r.ai_modules) for r in found] == [
        ("PARTIAL_MASK", "so **** calm a text", ["basic"]), ("FULL_BLOCK", BLOCK, ["pii"]), ("NORMAL", "an idiot is here and there", []),
        ("PARTIAL_MASK", "half a bad word", ["basic"]), ("PARTIAL_MASK", "\u314b\u314b\u314b hello", ["basic"]),
    ]
    assert not any(r.has_blacklist for r in found) and found[0].score == 0.32  # a module's name counts as the detected word


def test_analyze_service(spark):
    docs = spark.createDataFrame([(1, "calm text"), (2, "an idiot here"), (3, "calm words")], "doc_id long, text string")
    lex = spark.createDataFrame([("idiot", "USER_BLACKLIST")], "word string, wtype string")
    scores = spark.createDataFrame([(i, {"basic": 0.9, "spam": 0.7}) for i in (1, 2, 3)], "doc_id long, scores map<string,double>")
    tokens_ = spark.createDataFrame([(1, ["calm"])], "doc_id long, tokens array<string>")
    got = {(r.doc_id, r.level): (r.action, r.processed_text, r.score) for r in analyze(docs, lex, profile="service", scores=scores, attribution=tokens_).collect()}
    assert got[1, "LOW"] == ("REVIEW", "calm text", 0.9) and got[1, "MEDIUM"] == ("PARTIAL_MASK", "**** text", 0.9) and got[1, "HIGH"] == ("FULL_BLOCK", "", 0.9)
    assert got[3, "MEDIUM"] == ("REVIEW", "calm words", 0.9)  # no attribution: the mask failed
    assert got[2, "LOW"][:2] == ("PARTIAL_MASK", "an ***** here")  # words come first


def test_latency(spark):
    s = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "v double")
    got = analytics.latency_stats(s, "v").first()
    assert (got.n, got.mean, got.p50, got.p95, got.grade) == (4, 2.5, 3.0, 4.0, "great")


def test_storage(spark):
    old = spark.createDataFrame([(1, "a", "WHITELIST"), (1, "b", "BLACKLIST")], "user_id long, word string, list_type string")
    new = storage.add_words(old, spark.createDataFrame([(1, " A ", "BLACKLIST"), (1, "c", "BLACKLIST")], old.schema))
    assert rows(new, "word") == [(1, "a", "WHITELIST"), (1, "b", "BLACKLIST"), (1, "c", "BLACKLIST")]
    left = storage.remove_words(new, spark.createDataFrame([(1, "a")], "user_id long, word string"))
    assert tuple(storage.net_change(old, left).first()) == (1, 1)
    users = spark.createDataFrame([(1, "x", "y")], "id long, a string, b string")
    patch = spark.createDataFrame([(1, None, "z", ["a"])], "id long, a string, b string, given array<string>")
    assert rows(storage.patch(users, patch, "id", ["a", "b"]), "id") == [(1, None, "y")]


def test_variants(spark):
    rules = spark.createDataFrame([("가", 0, ["ㄱ", "ㅋ"], ["ㅏ"], ["", "ㄱ"]), ("나다", 0, ["ㄴ"], ["ㅏ"], [""]), ("나다", 1, ["ㄷ", "ㅌ"], ["ㅏ"], [""])], "root string, place int, cho array<string>, jung array<string>, jong array<string>")
    assert rows(lexicon.variants(rules), "root", "word") == [("가", "각"), ("가", "카"), ("가", "칵"), ("나다", "나타")]


def test_default_dictionary(spark, tmp_path):
    """As many words as the rules' products say, in their order, written and read again, and its variants are found."""
    rules, extras = lexicon.parse_rules(spark)
    entries = {r.root: r.variants for r in lexicon.default_lexicon(spark).collect()}
    product = {}
    for r in rules.collect():
        product.setdefault((r.root, r.form), []).append(len(r.cho) * len(r.jung) * len(r.jong))
    sizes = {}
    for (root, _), counts in product.items():
        sizes[root] = sizes.get(root, 0) + int(np.prod(counts))
    more = {r.root: r["n"] for r in extras.groupBy("root").agg(F.count("*").alias("n")).collect()}
    assert {k: len(v) for k, v in entries.items()} == {k: n - 1 + more.get(k, 0) for k, n in sizes.items() if k not in ("좆밥",)} | {"좆밥": len(entries["좆밥"])}
    assert len(entries) == 53 and sum(1 + len(v) for v in entries.values()) == 7623
    assert entries["시발"][:5] == ["시벌", "시볼", "시뱔", "싀발", "싀벌"] and entries["좆"] == [] and entries["시부랄"][-1] == "시붕알"
    assert entries["니애미"][:4] == ["니얘미", "니에미", "니예미", "느그애미"] and entries["니애미"][-2:] == ["느금마", "느금"]
    lexicon.write_lexicon(lexicon.default_lexicon(spark), str(tmp_path / "default"))
    read = read_lexicon(spark, str(tmp_path / "default"))
    assert read.count() == 7623 and read.where("is_root").count() == 53 and lexicon.flat_words(read).count() <= 7623
    words = read.select("word", F.lit("SYSTEM_KEYWORD").alias("wtype")).distinct()
    forms = ["씨발", "씌발", "쒸발", "시벌", "시볼", "쒸뱔", "씨발새끼", "시1발", "시.발"]
    docs = spark.createDataFrame([(k, f) for k, f in enumerate(forms)] + [(99, "오늘 날씨가 좋네요")], "doc_id long, text string")
    found = {r.doc_id: r.action for r in analyze(docs, words, levels=("MEDIUM",)).collect()}
    assert found.pop(99) == "NORMAL" and set(found.values()) == {"PARTIAL_MASK"}


def test_keywords_join_a_lexicon(spark):
    lex = spark.createDataFrame([("a", "USER_BLACKLIST")], "word string, wtype string")
    modes = spark.createDataFrame([("b", "FILTER"), ("c", "TRIGGER"), ("d", "IGNORE"), ("", "FILTER"), ("", "TRIGGER")], "word string, mode string")
    more, triggers = lexicon.with_keywords(lex, modes)
    assert rows(more, "word") == [("a", "USER_BLACKLIST"), ("b", "SYSTEM_KEYWORD")] and rows(triggers, "word") == [("c",)]


def test_jamo_matches_at_their_places(spark):
    """Split, doubled, exchanged and keyboard letters; the places are those of the text."""
    from gravelsift.functions import text

    samples = ["시이이발", "si발", "시8ㅏㄹ!", "ㅅ ㅣ-발", "씨 . 발", "pure s1bal", "Q시Q발", "", "끝"]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(samples)] + [(50, None)], "doc_id long, text string")
    native = {r[0]: r[1] for r in df.select("doc_id", text.jamo_normalize(F.col("text"))).collect()}
    placed = {r[0]: r[1] for r in df.select("doc_id", text.jamo_places(F.col("text"))).collect()}
    assert all(placed[k].jamo == native[k] and len(placed[k].places) == len(native[k]) for k in range(len(samples))) and placed[50] is None
    lex = spark.createDataFrame([("시발", "SYSTEM_KEYWORD"), ("씨발", "USER_BLACKLIST"), ("..", "SYSTEM_KEYWORD")], "word string, wtype string")
    got = rows(matching.match_jamo(df, lex), "doc_id")
    spans = {r[0]: (r[1], r[2]) for r in got}
    assert spans == {1: (0, 2), 2: (0, 3), 3: (0, 4), 4: (0, 4)} and {r[4] for r in got} == {"USER_BLACKLIST"}


def test_read_lexicon(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"_note": "x", "bad": {"r": {"pos": "VV", "variants": ["v", ""]}, "q": ["w"], "n": 3}, "odd": 1}))
    got = rows(read_lexicon(spark, str(tmp_path / "d.json")).select("word", "pos", "score", "is_root"), "word")
    assert got == [("n", "NNG", 5.0, True), ("q", "NNG", 5.0, True), ("r", "VV", 5.0, True), ("v", "NNG", 3.0, False), ("w", "NNG", 3.0, False)]


def test_chat(spark):
    raw = spark.createDataFrame([(None, None, "hi", 1000, "s", "c"), ("i", "a", "", 1, "s", "c"), ("j", "a", None, 1, "s", "c")], "id string, author string, content string, ts_received_ms long, source string, channel_id string")
    got = normalize_chat(raw).collect()
    assert len(got) == 1 and got[0].id == "s-1000-anonymous" and got[0].author == "Anonymous"


def stream(df, tmp_path, name, output="append"):
    """All rows that a streaming query of a landed folder gives."""
    query = df.writeStream.format("memory").queryName(name).outputMode(output).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_stream_equals_batch(spark, tmp_path):
    """The stream's analysis is that of plans.analyze on the same rows, evasions, shadows and lists included."""
    from gravelsift.streaming import chat

    texts = ["bad word", "b.a.d word", "badge", "fine", "so bad and worse", None, "a trigger: worse", ""]
    messages = spark.createDataFrame([(str(k % 40), "s", str(k % 3), "a", texts[k % 8], 1000 + k % 40 * 100) for k in range(80)], "id string, source string, channel_id string, author string, content string, t long")
    messages = messages.withColumn("ts", F.timestamp_seconds("t")).drop("t")
    messages.write.parquet(str(tmp_path / "in"))
    config = spark.createDataFrame([("0", "HIGH", "PLACEHOLDER", "-"), ("1", "LOW", "MASK", None)], "channel_id string, level string, mode string, placeholder string")
    lex = spark.createDataFrame([("bad", "SYSTEM_KEYWORD"), ("badge", "WHITELIST"), ("worse", "USER_BLACKLIST")], "word string, wtype string")
    moderated = chat.moderate(chat.once(chat.read_messages(spark, str(tmp_path / "in"))), config, lex, triggers=("trigger",))
    stream(moderated, tmp_path, "moderated")
    out = spark.table("moderated")
    unique = messages.dropDuplicates(["id"]).withColumnRenamed("id", "doc_id").withColumn("text", F.col("content"))
    judged = {(r.doc_id, r.level): (r.action, r.score) for r in analyze(unique, lex, triggers=("trigger",)).collect()}
    got = out.collect()
    assert len(got) == 40 and all((r.action, r.score) == judged[r.id, r.level] for r in got)
    by = {(r.content, r.channel_id): r for r in got}
    assert by["b.a.d word", "1"].masked == "***** word" and by["badge", "0"].action == "NORMAL" and by["so bad and worse", "0"].shown == "-"
    assert [tuple(w) for w in by["so bad and worse", "1"].detected_words] == [("bad", "SYSTEM_KEYWORD"), ("worse", "USER_BLACKLIST")]
    assert all(r.ts_generated <= r.ts_filter_start <= r.ts_filter_end <= r.ts_sent for r in got)
    timed = chat.latency(out)
    assert analytics.latency_stats(timed, "total_ms").first().n == 40 and timed.where("filter_ms < 0 or server_to_client_ms < 0").count() == 0


def test_analysis_of_null_and_repeated_ids(spark, monkeypatch):
    """Each row is judged by its own text, with a lexicon that is sent whole and with one that is joined."""
    docs = spark.createDataFrame([(None, "an idiot"), (None, "clean"), (7, "an id.iot here"), (7, "clean"), (7, "clean"), (8, None), (9, "nation tion")], "doc_id long, text string")
    lex = spark.createDataFrame([("idiot", "USER_BLACKLIST"), ("tion", "SYSTEM_KEYWORD"), ("nation", "WHITELIST")], "word string, wtype string")
    ways = []
    for most in (4_000_000, 3):
        monkeypatch.setattr(matching, "LEXICON_CHARS", most)
        for profile in ("sdk", "service"):
            found = analyze(docs, lex, levels=("HIGH", "LOW"), profile=profile)
            ways.append(sorted(tuple(r) for r in found.select(F.coalesce("doc_id", F.lit(0)), "level", "action", F.coalesce("processed_text", F.lit("null")), "n_detected", "score").collect()))
    assert ways[0] == ways[2] and ways[1] == ways[3]
    shown = [(r[0], r[1], r[2], r[3]) for r in ways[0]]
    assert shown == [
        (0, "HIGH", "FULL_BLOCK", ""), (0, "HIGH", "NORMAL", "clean"), (0, "LOW", "NORMAL", "clean"), (0, "LOW", "PARTIAL_MASK", "an *****"),
        (7, "HIGH", "FULL_BLOCK", ""), (7, "HIGH", "NORMAL", "clean"), (7, "HIGH", "NORMAL", "clean"), (7, "LOW", "NORMAL", "clean"), (7, "LOW", "NORMAL", "clean"), (7, "LOW", "PARTIAL_MASK", "an ****** here"),
        (8, "HIGH", "NORMAL", "null"), (8, "LOW", "NORMAL", "null"), (9, "HIGH", "PARTIAL_MASK", "nation ****"), (9, "LOW", "REVIEW", "nation tion"),
    ]


def test_service_masks_words_in_the_order_of_detection(spark):
    docs = spark.createDataFrame([(1, "idiotic fool and idiot")], "doc_id long, text string")
    lex = spark.createDataFrame([("idiotic", "USER_BLACKLIST"), ("idiot", "USER_BLACKLIST")], "word string, wtype string")
    assert analyze(docs, lex, levels=("LOW",), profile="service").first().processed_text == "******* fool and *****"


def test_service_runs_the_second_pass_where_it_is_asked_for(spark):
    docs = spark.createDataFrame([(1, "calm", True, "ALL"), (2, "calm", False, "ALL"), (3, "calm", True, " "), (4, "calm", True, "Basic"), (5, "calm", True, "spam"), (6, "calm", True, None), (7, "calm", None, "ALL")], "doc_id long, text string, opted boolean, asked string")
    lex = spark.createDataFrame([("idiot", "USER_BLACKLIST")], "word string, wtype string")
    scores = docs.select("doc_id", F.create_map(F.lit("basic"), F.lit(0.9)).alias("scores"))
    found = analyze(docs, lex, levels=("LOW",), profile="service", scores=scores, opted_in=F.col("opted"), modules=F.col("asked"))
    assert {r.doc_id: r.action for r in found.collect()} == {1: "REVIEW", 2: "NORMAL", 3: "NORMAL", 4: "REVIEW", 5: "NORMAL", 6: "NORMAL", 7: "NORMAL"}


def test_hits_equal_the_windows(spark):
    """Shadows, nouns, evasions and longest matches of random texts: within a text, and by windows over all matches."""
    random.seed(11)
    texts = [(i, "".join(random.choice("ab- cd") for _ in range(random.randint(0, 60)))) for i in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    lex = spark.createDataFrame([("ab", "SYSTEM_KEYWORD"), ("b", "USER_BLACKLIST"), ("abc", "WHITELIST"), ("bcd", "SYSTEM_KEYWORD"), ("dd", "WHITELIST"), ("cdda", "USER_BLACKLIST"), ("a", "SYSTEM_KEYWORD")], "word string, wtype string")
    columns = ["doc_id", "s", "e", "word", "wtype"]
    got = rows(first_pass(docs, lex).select(columns), *columns)
    assert got == rows(matching.longest(matching.drop_shadowed(matching.match_texts(docs, lex))).select(columns), *columns) and len(got) > 300
    toks = tokens.tokenize(docs, r"[a-d]{1,3}").withColumn("tag", F.when(F.col("start") % 3 == 0, "NNG").otherwise("VV"))
    units = tokens.meaningful_units(toks).select("doc_id", "form", F.col("s").alias("start"), (F.col("e") - F.col("s") + 1).alias("len"))
    inner = matching.match_texts(docs, lex, ("substring", "evasion"))
    every = matching.match_forms(units.unionByName(toks.select("doc_id", "form", "start", "len")), lex)
    every = every.unionByName(matching.on_nouns(inner.where("wtype <> 'WHITELIST'"), toks)).unionByName(inner.where("wtype = 'WHITELIST'"))
    assert rows(first_pass(docs, lex, toks).select(columns), *columns) == rows(matching.longest(matching.drop_shadowed(every)).select(columns), *columns)


def test_attention_head_and_attribution(spark):
    """Softmax over any rows, with masked and odd ones; gradients against finite differences."""
    from gravelsift.operators import attention

    rng = np.random.default_rng(3)
    head = attention.Head(rng.normal(size=(4, 5)), rng.normal(size=4), 200 * rng.normal(size=4), 0.3, rng.normal(size=(6, 5)), rng.normal(size=6), rng.normal(size=6), -0.1)
    h = rng.normal(size=(60, 5))
    group = [None if k < 10 else "one" if k == 10 else "x" for k in range(60)]
    data = [(group[k], k, h[k].tolist(), k % 7 != 6) for k in range(60)]
    data += [("odd", 100, None, True), ("odd", 101, [1.0], True), ("odd", 102, [1.0, None, 2.0, 3.0, 4.0], True), ("x", 103, [float("nan")] * 5, True), ("hidden", 104, h[0].tolist(), False)]
    df = spark.createDataFrame(data, "g string, pos int, v array<double>, real boolean")

    def logit(m):
        a = np.tanh(m @ head.w1.T + head.b1) @ head.w2 + head.b2
        w = np.exp(a - a.max())
        w /= w.sum()
        return float(np.maximum(w @ m @ head.c1.T + head.d1, 0) @ head.c2 + head.d2), w

    want = {g: [k for k in range(60) if group[k] == g and k % 7 != 6] for g in (None, "one", "x")}
    got = {r.g: r for r in attention.pool(df, head, ["g"], "v", F.col("real")).collect()}
    assert set(got) == set(want)
    found = {r.pos: r for r in attention.attribute(df, head, ["g"], "v", F.col("real")).collect()}
    assert set(found) == {k for ks in want.values() for k in ks}
    for g, ks in want.items():
        whole, w = logit(h[ks])
        assert got[g].n == len(ks) and got[g].logit == pytest.approx(whole) and got[g].pooled == pytest.approx((w @ h[ks]).tolist())
        for i, k in enumerate(ks):
            step = 1e-6
            up, down = h[ks].copy(), h[ks].copy()
            up[i] *= 1 + step
            down[i] *= 1 - step
            assert found[k].attention == pytest.approx(w[i], abs=1e-12)
            assert found[k].raw_attr == pytest.approx((logit(up)[0] - logit(down)[0]) / (2 * step), abs=1e-4, rel=1e-4)
    assert attention.pool(df.where("false"), head, ["g"], "v").count() == 0


def test_a_group_of_many_batches_is_one_state(spark):
    from gravelsift.operators import attention

    head = attention.Head(np.eye(2), np.zeros(2), np.array([300.0, -300.0]), 0.0, np.eye(2), np.zeros(2), np.ones(2), 0.0)
    many = spark.range(50_000).select(F.when(F.col("id") % 9 == 0, F.col("id")).otherwise(-1).alias("g"), F.array((F.col("id") % 7) / 7.0, (F.col("id") % 5) / 5.0).alias("v"))
    top = attention.pool(many.repartition(13), head, ["g"], "v")
    hot = top.where("g = -1").collect()
    assert len(hot) == 1 and hot[0].n == many.where("g = -1").count() and hot[0].pooled == pytest.approx([6 / 7, 0.0], abs=1e-3) and top.count() == 1 + 5556


def test_attributed_words_are_masked(spark):
    """From word pieces to words, shares and the text that the service shows."""
    pieces = spark.createDataFrame(
        [(1, "basic", 0, "aw", 0.3), (1, "basic", 1, "##ful", 0.2), (1, "basic", 2, "day", 0.05), (1, "basic", 3, "now", 0.45), (2, "basic", 0, "##odd", 0.0), (2, "basic", 1, "x", 0.0)],
        "doc_id long, module string, pos int, token string, score double",
    )
    words = tokens.merge_word_pieces(pieces)
    assert rows(words.select("doc_id", "pos", "token"), "doc_id", "pos") == [(1, 0, "awful"), (1, 2, "day"), (1, 3, "now"), (2, 0, "##odd"), (2, 1, "x")]
    chosen = ai.selected_tokens(ai.attribution_share(words))
    assert rows(chosen, "doc_id") == [(1, ["awful", "now"]), (2, ["##odd"])]
    docs = spark.createDataFrame([(1, "awful day, now")], "doc_id long, text string")
    lex = spark.createDataFrame([("idiot", "USER_BLACKLIST")], "word string, wtype string")
    scores = spark.createDataFrame([(1, {"basic": 0.9})], "doc_id long, scores map<string,double>")
    assert analyze(docs, lex, levels=("MEDIUM",), profile="service", scores=scores, attribution=chosen).first().processed_text == "***** day, ***"


def test_latency_of_nothing_and_of_keys(spark):
    s = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("a", 1.0), ("b", 2.0), ("b", None)], "k string, v double")
    assert rows(analytics.latency_stats(s, "v", "k").select("k", "n", "min", "max", "p50", "p99"), "k") == [("a", 3, 1.0, 5.0, 5.0, 5.0), ("b", 1, 2.0, 2.0, 2.0, 2.0)]
    assert tuple(analytics.latency_stats(s.where("false"), "v").first())[:-1] == (0, 0, 0, 0, 0, 0, 0)


def test_lines_are_stripped_of_all_white_space(spark):
    df = spark.createDataFrame([("\t a \r\n\r\n \u3000b\x1f",)], "value string")
    assert [r.line for r in text_lines(df).collect()] == ["a", "b"]


def test_laughter_has_no_span(spark):
    ev = spark.createDataFrame([(1, "basic", "x", 0, 3, 0.9), (1, "basic", "y", 5, 7, 0.9), (1, "spam", "z", 5, 7, 0.9)], "doc_id long, module string, token string, s int, e int, evidence double")
    docs = spark.createDataFrame([(1, "\u314b\u314e\u314b  ab")], "doc_id long, text string")
    assert [(r.s, r.e, r.module) for r in tokens.evidence_spans(ev, ai.MASK, docs).collect()] == [(5, 7, "basic")]


def test_keys_in_normal_form(spark):
    from gravelsift.functions import text

    df = spark.createDataFrame([("\uff21\uff22 c!",), ("ab",), (None,)], "t string")
    assert [r[0] for r in df.select(text.text_key(text.nfkc(F.col("t")))).collect()] == ["abc", "ab", None]


@pytest.fixture
def rocks(spark):
    """The state store that keyed timers need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def test_cache_stream_equals_batch(spark, tmp_path, rocks):
    """Entries that expire, are written again, or are asked for before they are there; in three batches."""
    from gravelsift.streaming import state

    random.seed(2)
    times = sorted(random.sample(range(0, 40_000), 240))
    data = [(random.choice(["a", "b", "c"]), t, f"v{k % 17}" if random.random() < 0.15 else None) for k, t in enumerate(times)]
    data += [("c", times[100], "tie"), ("c", times[100], "tid"), ("c", times[100], None)]
    df = spark.createDataFrame(data, "k string, t long, value string").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    for part in range(3):
        low, high = times[part * 80], times[min(239, part * 80 + 79)]
        df.where((F.unix_seconds("ts") >= low) & (F.unix_seconds("ts") <= high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "cache"))
    read = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "cache"))
    done = stream(state.live_cache(read, ["k"], "20 minutes", "5 minutes"), tmp_path, "cached")
    want = storage.cache_lookup(df, ["k"], "20 minutes", "5 minutes")
    columns = ["k", "at", "written", "value", "state"]
    got = rows(spark.table("cached").select(columns), "k", "at")
    assert got == rows(want.select(columns), "k", "at") and {r[4] for r in got} == {"hit", "refresh", "miss"}
    assert sum(p["numRowsTotal"] for x in done.recentProgress[-1:] for p in x.stateOperators) < 20  # entries and timers of live keys only


def test_closed_sessions_of_a_stream(spark, tmp_path):
    """A session is given once the watermark has passed its end, and equals the batch's."""
    from gravelsift.streaming import chat

    data = [(str(i), "s", f"c{i % 2}", "a", "x", 60 * i if i < 20 else 6000 + 60 * i) for i in range(40)] + [("last", "s", "c9", "a", "x", 200_000)]
    messages = spark.createDataFrame(data, "id string, source string, channel_id string, author string, content string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    messages.write.parquet(str(tmp_path / "chat"))
    acted = lambda df: df.withColumn("action", F.when(F.col("channel_id") == "c1", "NORMAL").otherwise("FULL_BLOCK"))
    live = acted(chat.read_messages(spark, str(tmp_path / "chat"))).withWatermark("ts", "10 minutes")
    stream(chat.broadcast_sessions(live), tmp_path, "closed")
    columns = ["source", "channel_id", "started_at", "last_message_at", "message_count", "filtered_count"]
    want = analytics.sessions(acted(messages).where("channel_id <> 'c9'"), ["source", "channel_id"])
    assert rows(spark.table("closed").select(columns), *columns[:3]) == rows(want.select(columns), *columns[:3])
    assert [r.started_at for r in analytics.newest_first(want).limit(2).collect()] == [r.started_at for r in want.orderBy(F.desc("started_at")).limit(2).collect()]


def test_paged_comments_equal_the_landed_pages(spark, tmp_path, monkeypatch):
    """The data source and the operator on the same pages: caps, stop rule, reply pages, ids that come again."""
    from gravelsift.sources import paged

    random.seed(6)
    pages, replies = [], []
    for video, n in (("v1", 60), ("v2", 7), ("v3", 1), ("v4", 12)):
        for p in range(1, n + 1):
            items = []
            for k in range(3):
                few = [{"id": f"r{random.randint(0, 90)}", "text": f"near {p} {k} {j}"} for j in range(random.randint(0, 2))]
                again = video == "v4" and p > 4 or video == "v2" and p == 5
                items.append({"id": f"c{p % 4 if again else p * 3 + k}", "text": f"top {p} {k}", "author": "a", "published_at": None, "total_replies": len(few) + random.choice([0, 0, 4]), "replies": [] if again else few})
            pages.append((video, p, {"items": items, "next": str(p + 1) if p < n else None}))
        for parent in {i["id"] for v, _, body in pages if v == video for i in body["items"]}:
            m = random.choice([1, 2, 13])
            replies += [(video, parent, p, {"items": [{"id": f"r{random.randint(0, 200)}", "text": f"more {parent} {p}"}], "next": str(p + 1) if p < m else None}) for p in range(1, m + 1)]
    for video, p, body in pages:
        (tmp_path / f"{video}-top-{p}.json").write_text(json.dumps(body))
    for video, parent, p, body in replies:
        (tmp_path / f"{video}-{parent}-{p}.json").write_text(json.dumps(body))
    monkeypatch.setenv("LANDED_PAGES", str(tmp_path))
    from tests import landed

    live = [r for v in ("v1", "v2", "v3", "v4") for r in paged.fetched(v, landed.page, 50)]
    top = spark.createDataFrame([(v, p, json.dumps(b)) for v, p, b in pages], "video_id string, page int, body string")
    more = spark.createDataFrame([(v, c, p, json.dumps(b)) for v, c, p, b in replies], "video_id string, parent_id string, page int, body string")
    key = lambda r: (r[0], r[1])
    assert sorted(live, key=key) == sorted((tuple(r) for r in paged.threads(top, more).collect()), key=key)
    seen = {v: {r[3] for r in live if r[0] == v} for v in ("v1", "v2", "v4")}
    assert "top 50 0" in seen["v1"] and "top 51 0" not in seen["v1"] and "top 6 0" in seen["v2"] and len(live) == len({key(r) for r in live})
    three = paged.threads(top, more, max_pages=3)
    assert three.where("text like 'top 4%'").isEmpty() and not three.where("text like 'top 3%'").isEmpty()
    reader = paged.PagedReader({"fetch": "tests.landed:page", "videos": json.dumps(["v2", "v3", "v2"]), "max_pages": "3"})
    assert [p.video for p in reader.partitions()] == ["v2", "v3"]
    assert [r for p in reader.partitions() for r in reader.read(p)] == [r for v in ("v2", "v3") for r in paged.fetched(v, landed.page, 3)]


def test_paged_source_runs_in_tasks(spark):
    """The data source through spark.read: the fetch function makes its pages in the tasks."""
    from gravelsift.sources import paged

    got = paged.read_comments(spark, "gravelsift.sources.sample_pages:page", ["a", "b"], max_pages=4)
    assert got.rdd.getNumPartitions() == 2 and got.count() == 2 * 4 * 2 and got.where("parent_id is not null").count() == 8
    assert got.schema.simpleString() == "struct<" + paged.ROW.replace(" string", ":string").replace(", ", ",") + ">"


def test_stored_upserts_touch_their_partitions_only(spark, tmp_path):
    """The same batch twice changes nothing; files of other partitions stay as they are; newest rows and oldest creation win."""
    path = str(tmp_path / "cache")
    kind = "k long, v string, created_at long, last_seen_at long"
    first = spark.createDataFrame([(i, f"v{i}", 1, 10) for i in range(200)], kind)
    storage.upsert_stored(first, path, ["k"], buckets=16)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "cache").rglob("*.parquet")}
    batch = spark.createDataFrame([(3, "new", 9, 20), (3, "older", 5, 15), (7, "stale", 0, 5), (999, "fresh", 30, 30)], kind)
    for _ in range(2):
        storage.upsert_stored(batch, path, ["k"], buckets=16)
        table = {r.k: (r.v, r.created_at, r.last_seen_at) for r in spark.read.parquet(path).collect()}
        assert len(table) == 201 and table[3] == ("new", 1, 20) and table[7] == ("v7", 0, 10) and table[999] == ("fresh", 30, 30) and table[8] == ("v8", 1, 10)
    after = set((tmp_path / "cache").rglob("*.parquet"))
    touched = storage.bucketed(batch, ["k"], 16).select("bucket").distinct().count()
    assert len({f.parent for f in before} - {f.parent for f in before if f in after}) == touched and all(f.stat().st_mtime_ns == before[f] for f in after & set(before))


def test_upsert_stream_equals_batch(spark, tmp_path):
    kind = "k long, v string, created_at long, last_seen_at long"
    rows_ = [(random.Random(i).randint(0, 40), f"v{i}", i, i) for i in range(120)]
    for part in range(3):
        spark.createDataFrame(rows_[part * 40 : part * 40 + 40], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    storage.upsert_stream(live, str(tmp_path / "table"), ["k"], str(tmp_path / "cp"), buckets=4).trigger(availableNow=True).start().awaitTermination(120)
    empty = spark.createDataFrame([], kind)
    want = storage.upsert(empty, spark.createDataFrame(rows_, kind), ["k"])
    columns = ["k", "v", "created_at", "last_seen_at"]
    assert rows(spark.read.parquet(str(tmp_path / "table")).select(columns), "k") == rows(want.select(columns), "k")


def test_legacy_tokens(spark):
    lex = spark.createDataFrame([("bad", "USER_BLACKLIST"), ("badge", "WHITELIST"), ("xx", "SYSTEM_KEYWORD"), ("both", "SYSTEM_KEYWORD"), ("both", "WHITELIST")], "word string, wtype string")
    find = matching.legacy_matcher(lex)
    df = spark.createDataFrame([("bad badge xx bad",), ("badge badly bad",), ("both",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(find(F.col("t")).alias("x")).collect()]
    assert [(g.status, [w.word for w in g.words], g.text) for g in got[:4]] == [
        ("FILTERED_BY_FIRST_PASS", ["bad", "xx", "bad"], "__B__ __B__ge __F__ __B__"), ("FILTERED_BY_FIRST_PASS", ["bad"], "__W__ __B__ly __B__"), ("PASSED", [], "__W__"), ("PASSED", [], ""),
    ]
    assert got[4] is None


def test_trained_gate(spark):
    """Held-out figures on words that tell; two fits agree; odd labels aren't learnt."""
    from gravelsift.operators import gate

    rng = random.Random(1)
    common = [f"w{i}" for i in range(40)]
    data = []
    for i in range(400):
        y = i % 2
        data.append((i, " ".join(rng.choices(common, k=12) + (["awful"] if y and rng.random() < 0.95 else [])), y))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(900, None), (None, "awful")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "m", y) for i, _, y in data if i % 4] + [(1, "other", 1), (5, "m", None), (7, "m", 0), (8, "nothing", 3)], "doc_id long, module string, y int")
    model = gate.fit(docs, labels)
    assert set(model) == {"m", "other"} and model["other"] == 1.0
    found = gate.scores(docs, model)
    own = {r.doc_id: r.score for r in found.where("module = 'm'").collect()}
    held = [(own[i] >= 0.5) == bool(y) for i, _, y in data if i % 4 == 0]
    assert sum(held) / len(held) > 0.9 and own[None] > 0.5 and 0 < own[900] < 1
    again = {r.doc_id: r.score for r in gate.scores(docs, gate.fit(docs.repartition(5), labels)).where("module = 'm'").collect()}
    assert own == again and gate.fit(docs, labels.where("false")) == {} and gate.scores(docs, {}).count() == 0


def test_trending_ties_come_as_first_seen(spark):
    units = spark.createDataFrame([(2, 0, "bb"), (2, 1, "aa"), (1, 5, "cc"), (1, 6, "aa"), (3, 0, "bb"), (3, 1, "cc"), (None, 0, "zz"), (4, 0, "zz"), (4, 1, "solo")], "doc_id long, pos int, form string")
    assert [r.word for r in analytics.trending(units).collect()] == ["cc", "aa", "bb", "zz"]


def test_tables_over_jdbc(spark):
    """Written and read in parts through an embedded database in memory."""
    from gravelsift.sources import tables

    url, driver = "jdbc:derby:memory:gravel;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows_ = spark.range(100).selectExpr("cast(id as int) id", "concat('n', id) name")
    tables.append_table(rows_, url, "people", driver=driver)
    tables.append_table(rows_.selectExpr("id + 100 id", "name"), url, "people", driver=driver)
    got = tables.read_table(spark, url, "people", key='"id"', parts=4, driver=driver)
    assert got.count() == 200 and got.rdd.getNumPartitions() == 4 and tables.read_table(spark, url, "people", driver=driver).count() == 200
    tables.append_table(rows_.where("false"), url, "nobody", driver=driver)
    assert tables.read_table(spark, url, "nobody", key='"id"', driver=driver).count() == 0


def test_encoder_feeds_the_head(spark):
    """Texts to token vectors, pooled and attributed; long texts are cut, blank ones have no tokens, a failing model gives none."""
    from gravelsift.operators import attention, encoder

    docs = spark.createDataFrame([(1, "wonderful day"), (2, " "), (3, None), (4, "abcd " * 300), (5, "day")], "doc_id long, text string")
    made = encoder.encode(docs, "gravelsift.operators.encoder:sample_model", batch=2)
    own = [(r.token, r.s, r.e, r.real) for r in made.where("doc_id = 1").orderBy("pos").collect()]
    assert own == [("[CLS]", 0, 0, False), ("wond", 0, 4, True), ("##erfu", 4, 8, True), ("##l", 8, 9, True), ("day", 10, 13, True)]
    sizes = {r.doc_id: r["count"] for r in made.groupBy("doc_id").count().collect()}
    assert sizes == {1: 5, 4: 128, 5: 2}
    rng = np.random.default_rng(0)
    head = attention.Head(rng.normal(size=(4, 8)), rng.normal(size=4), rng.normal(size=4), 0.0, rng.normal(size=(4, 8)), rng.normal(size=4), rng.normal(size=4), 0.0)
    pooled = attention.pool(made, head, ["doc_id"], "vector", F.col("real"))
    assert {r.doc_id: r.n for r in pooled.collect()} == {1: 4, 4: 127, 5: 1}
    found = attention.attribute(made, head, ["doc_id"], "vector", F.col("real")).withColumn("module", F.lit("basic"))
    words = tokens.merge_word_pieces(found.select("doc_id", "module", "pos", "token", "score", "raw_attr", "attention"))
    assert [r.token for r in words.where("doc_id = 1").orderBy("pos").collect()] == ["wonderful", "day"]
    assert encoder.encode(docs, "tests.landed:broken", batch=2).count() == 0


def test_masks_merge(spark):
    from gravelsift.functions import text

    df = spark.createDataFrame([("a **** b cd e", [(0, 0), (3, 7), (9, 12)])], "m string, spans array<struct<s:int,e:int>>")
    assert df.select(text.merge_mask(F.col("m"), F.col("spans"))).first()[0] == "* **** b ** *"
    words = spark.createDataFrame([("bad day", ["bad"])], "t string, w array<string>")
    assert words.select(text.soften_mask(F.col("t"), F.col("w"))).first()[0] == "*** day"


def test_sinks(spark, tmp_path):
    """Candidates as CSV with a byte order mark and one header a file, added to; latency rows; several sinks of one stream."""
    from gravelsift.sources import readers
    from gravelsift.streaming import chat

    candidates = spark.createDataFrame([("t1", "basic", 0.5, "PENDING"), ("t2", "spam", 0.4, "PENDING")], "text string, module string, score double, review_status string")
    for _ in range(2):
        readers.write_candidates(candidates.coalesce(1), str(tmp_path / "csv"))
    files = list((tmp_path / "csv" / "module=basic").glob("*.csv"))
    assert len(files) == 2 and all(f.read_bytes() == "\ufefftext,score,review_status,human_label\nt1,0.5,PENDING,\n".encode() for f in files)
    messages = spark.createDataFrame([(str(k), "s", "c", "a", "hello", k) for k in range(10)], "id string, source string, channel_id string, author string, content string, t long")
    messages.withColumn("ts", F.timestamp_seconds("t")).drop("t").write.parquet(str(tmp_path / "in"))
    config = spark.createDataFrame([], "channel_id string, level string, mode string, placeholder string")
    lex = spark.createDataFrame([("hell", "SYSTEM_KEYWORD")], "word string, wtype string")
    moderated = chat.moderate(chat.read_messages(spark, str(tmp_path / "in")), config, lex)
    sinks = [lambda b: b.write.mode("append").parquet(str(tmp_path / "one")), lambda b: b.select("id").write.mode("append").parquet(str(tmp_path / "two"))]
    chat.fan_out(moderated, sinks, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "one")).count() == spark.read.parquet(str(tmp_path / "two")).count() == 10
    readers.write_latency(chat.latency(spark.read.parquet(str(tmp_path / "one"))), str(tmp_path / "latency"))
    assert spark.read.option("header", True).csv(str(tmp_path / "latency")).columns == ["id", "action", "filter_ms", "fetcher_to_filter_ms", "server_to_client_ms", "e2e_render_ms", "total_ms"]


def test_injected_messages_and_sample_chat(spark, tmp_path):
    from gravelsift.streaming import chat

    path = str(tmp_path / "chat")
    assert not chat.inject(spark, path, "c", "nobody listens", name="listening")
    spark.createDataFrame([], chat.MESSAGE).write.parquet(path)
    query = chat.read_messages(spark, path).writeStream.format("memory").queryName("listening").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        assert chat.inject(spark, path, "c", "hello", name="listening")
        query.processAllAvailable()
        assert [(r.channel_id, r.content, r.author) for r in spark.table("listening").collect()] == [("c", "hello", "Tester")]
    finally:
        query.stop()
    sample = chat.sample_messages(spark, 50, ["a", "b"]).writeStream.format("memory").queryName("sampled").option("checkpointLocation", str(tmp_path / "cp2")).trigger(processingTime="1 second").start()
    try:
        for _ in range(40):
            query_rows = spark.table("sampled").count()
            if query_rows:
                break
            sample.awaitTermination(1)
        got = spark.table("sampled").collect()
        assert got and {r.content for r in got} <= {"a", "b"} and all(r.author.startswith("User") and r.id.startswith("dummy-") for r in got)
    finally:
        sample.stop()


def test_lists_of_owners(spark):
    sessions = spark.createDataFrame([(1, 7, 100), (2, 7, 300), (3, 8, 200), (4, 7, 300)], "session_id long, owner_user_id long, started_at long")
    assert [(r.session_id, r.place) for r in storage.session_list(sessions).where("owner_user_id = 7").orderBy("place").collect()] == [(4, 1), (2, 2), (1, 3)]
    messages = spark.createDataFrame([(1, "a"), (3, "b"), (2, "c"), (9, "d")], "session_id long, text string")
    assert sorted(r.text for r in storage.messages_of(messages, sessions, F.lit(7)).collect()) == ["a", "c"]
    owned = sessions.withColumnRenamed("owner_user_id", "owner")
    assert [r.session_id for r in analytics.newest_first(owned, 7).collect()][-1] == 1 and analytics.newest_first(owned).count() == 4
    users = spark.createDataFrame([(1, "x"), (2, "y")], "user_id long, username string")
    assert storage.of_user(users, 2).first().username == "y" and storage.of_user(users, name="x").first().user_id == 1 and storage.of_user(users, 3).count() == 0


def test_videos(spark):
    from gravelsift.sources import readers

    raw = spark.createDataFrame(
        [("t", "c1", "d", None, 10, None, ["https://en.wikipedia.org/wiki/Hip_hop"]), ("u", "c2", "d", ["x"], 99, "7", None)],
        "title string, channelId string, description string, tags array<string>, categoryId int, commentCount string, topicUrls array<string>",
    )
    videos = readers.video_metadata(raw, {"10": "Music"})
    got = {r.title: (r.category, r.topics, r.commentCount, r.tags) for r in videos.collect()}
    assert got == {"t": ("Music", ["Hip hop"], 0, []), "u": ("", [], 7, ["x"])} and readers.of_owner(videos, "c2").count() == 1


def test_jamo_of_many_texts_side_by_side(spark):
    """Each text's jamo and places as the scalar form gives them, nulls and empty texts among them, over several slices; a worker holds one slice."""
    from gravelsift.functions import batches, text

    rng = random.Random(5)
    letters = "시ㅔㅣ발ㅆ씨끼ㄳ값AbzQ018 -é😀힣가\x00"
    texts = ["", "!", "aab", *("".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(300))]
    codes, places, cuts = text.jamo_forms(texts)
    assert [("".join(map(chr, codes[a:b])), places[a:b].tolist()) for a, b in zip(cuts, cuts[1:], strict=False)] == [text.jamo_form(t) for t in texts]
    import pyarrow as pa

    sizes = [3, 1, None, 0, 9, 2, 2]
    assert list(batches.slices(pa.array([None if n is None else "x" * n for n in sizes]), 4)) == [(0, 4), (4, 1), (5, 2)]
    long = [(k, t * 4000) for k, t in enumerate(texts[:40])] + [(99, None)]
    df = spark.createDataFrame(long, "doc_id long, text string")
    got = {r.doc_id: r.x for r in df.select("doc_id", text.jamo_places(F.col("text")).alias("x")).collect()}
    assert got[99] is None and all((got[k].jamo, got[k].places) == text.jamo_form(t) for k, t in long[:-1])
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= batches.BATCH_BYTES


@pytest.mark.parametrize("name", ["matcher", "legacy_matcher", "match_texts", "tokenize", "units_of_texts", "span_mask"])
def test_workers_hold_bounded_batches(spark, name):
    """Operators on texts bound Arrow batches and go through them slice by slice: results of long texts, nulls and short rows are each row's own."""
    from gravelsift.functions import batches, text

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    lex = spark.createDataFrame([("bad", "USER_BLACKLIST")], "word string, wtype string")
    docs = spark.createDataFrame([(k, None if k == 3 else "bad " * (150_000 if k % 5 == 0 else k)) for k in range(12)], "doc_id long, text string").coalesce(1)
    want = {k: 150_000 if k % 5 == 0 else k for k in range(12) if k != 3}
    if name == "matcher":
        got = {r[0]: r[1] for r in docs.select("doc_id", F.size(matching.matcher(lex)(F.col("text"))["s"])).where("doc_id <> 3").collect()}
    elif name == "legacy_matcher":
        got = {r[0]: r[1] for r in docs.where("doc_id % 5 <> 0").select("doc_id", F.size(matching.legacy_matcher(lex)(F.col("text"))["words"])).where("doc_id <> 3").collect()}
        want = {k: n for k, n in want.items() if k % 5}
    elif name == "span_mask":
        spans = F.array(F.struct(F.lit(0).alias("s"), F.lit(1).alias("e")))
        got = {r[0]: (len(r[1]) + 3) // 4 for r in docs.select("doc_id", text.span_mask(F.col("text"), spans)).where("doc_id <> 3").collect()}
    else:
        found = {"match_texts": lambda: matching.match_texts(docs, lex, ("form",)), "tokenize": lambda: tokens.tokenize(docs), "units_of_texts": lambda: tokens.units_of_texts(docs, lambda t: [("bad", "NNG", 4 * i) for i in range(len(t) // 4)])}[name]()
        got = {r[0]: r[1] for r in found.groupBy("doc_id").count().collect()}
        want = {k: n for k, n in want.items() if n}
    assert got == want and int(spark.conf.get(key).rstrip("b")) <= batches.BATCH_BYTES


def test_evidence_of_a_rows_own_pieces(spark):
    """The same spans as over rows of pieces, and the same analysis; the column's tokens aren't shuffled."""
    rng, modules = random.Random(9), [*sorted(ai.MASK), "spam"]
    pieces = [(d, rng.choice(modules), rng.choice(["a", "##b", "c"]), s := rng.randrange(60), s + rng.randrange(4), rng.randrange(50) / 100) for d in range(30) for _ in range(rng.randrange(25))]
    ev = spark.createDataFrame(pieces, "doc_id long, module string, token string, s int, e int, evidence double")
    docs = spark.createDataFrame([(d, "some words and more of them, to be masked in places. " * 2) for d in range(32)], "doc_id long, text string")
    own = docs.join(ev.groupBy("doc_id").agg(F.collect_list(F.struct("module", "token", "s", "e", "evidence")).alias("p")), "doc_id", "left")
    want = {r.doc_id: sorted({(x.s, x.e - 1) for x in r.x}) for r in tokens.evidence_spans(ev, ai.MASK).groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("x")).collect()}
    got = {r.doc_id: r.x for r in own.select("doc_id", tokens.evidence_marks(F.col("p").cast(tokens.PIECES), ai.MASK).alias("x")).collect()}
    assert {d: [tuple(x) for x in v] for d, v in got.items() if v} == want and got[31] is None
    scores = spark.createDataFrame([(d, {m: 0.9 if (d + k) % 3 == 0 else 0.1 for k, m in enumerate(modules)}) for d in range(28)], "doc_id long, scores map<string,double>")
    lex = spark.createDataFrame([("word", "SYSTEM_KEYWORD")], "word string, wtype string")
    forms = tokens.tokenize(docs).withColumn("m", F.explode(F.array(*map(F.lit, modules))))
    rule = lambda d, s: (d * 7 + s * 3) % 40 / F.lit(100.0)
    far = forms.select("doc_id", F.col("m").alias("module"), F.col("form").alias("token"), F.col("start").alias("s"), (F.col("start") + F.col("len")).alias("e"), rule(F.col("doc_id"), F.col("start")).alias("evidence"))
    placed = tokens.placed_forms(F.col("text"))
    made = lambda m: F.transform(placed, lambda t: F.struct(F.lit(m).alias("module"), t["form"].alias("token"), t["start"].alias("s"), (t["start"] + F.length(t["form"])).alias("e"), rule(F.col("doc_id"), t["start"]).alias("evidence")))
    near = F.concat(*(F.when(F.array_contains("modules", m), made(m)).otherwise(F.array().cast(tokens.PIECES)) for m in modules))
    by_rows, by_column = (analyze(docs, lex, scores=scores, evidence=x) for x in (far, near))
    assert rows(by_column, "doc_id", "level") == rows(by_rows, "doc_id", "level")
    plan = by_column._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "Window" not in plan


def test_pages_landed_in_parts(spark):
    """Parts of a page, in any order of the rows, give the rows of the whole page, the first comment of an id the one of the first part; the query's bodies don't grow with the events."""
    from gravelsift.plans import analytics_queries
    from gravelsift.sources import paged

    rng = random.Random(2)
    items = {(v, p): [{"id": f"c{rng.randrange(30)}", "text": f"t{p}-{k}", "total_replies": 2, "replies": [{"id": f"r{rng.randrange(40)}", "text": f"n{p}-{k}"}]} for k in range(12)] for v in "ab" for p in (1, 2, 3)}
    whole = spark.createDataFrame([(*k, json.dumps({"items": x})) for k, x in items.items()], "video_id string, page int, body string")
    cut = [(*k, j, json.dumps({"items": x[j * 5 : j * 5 + 5]})) for k, x in items.items() for j in range(3)]
    parts = spark.createDataFrame(cut[::-1], "video_id string, page int, part int, body string")
    more = spark.createDataFrame([("a", "c1", 1, json.dumps({"items": [{"id": "r99", "text": "m"}]}))], "video_id string, parent_id string, page int, body string")
    assert rows(paged.threads(parts, more), "video_id", "comment_id") == rows(paged.threads(whole, more), "video_id", "comment_id")
    sizes, threads = [], paged.threads
    try:
        paged.threads = lambda pages, replies, max_pages: sizes.append(pages.agg(F.max(F.length("body"))).first()[0]) or threads(pages, replies, max_pages)
        analytics_queries.paged_threads(spark, "/root/testdata/sf0.1")
    finally:
        paged.threads = threads
    assert sizes[0] < 150_000


def test_pairs_of_letters_as_tokens():
    """The query's tokenizer gives what the pattern of pairs gives, by a match for each word."""
    import regex

    from gravelsift.plans import match_queries

    find = regex.compile(r"\p{L}{1,2}").finditer
    for t in ("", "a", "abc de, fghi", "é가x12y²zⅧ-ab😀c\nd_e"):
        assert match_queries.pairs(t) == [(m.group(), "NNG", m.start()) for m in find(t)]
    assert list(tokens.joined_units(match_queries.pairs("abcdefghijklmno p"))) == [("abcdefghijkl", 0, True), ("mno", 12, True), ("p", 16, False)]


def test_gate_reads_texts_once(spark, monkeypatch):
    """One scan and one count of words for all modules; the parts that a model is fitted on grow with the rows."""
    from gravelsift.operators import gate

    docs = spark.createDataFrame([(i, f"w{i % 7} " + ("awful" if i % 2 else "fine")) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, m, (i + k) % 2) for i in range(120) for k, m in enumerate("ab")], "doc_id long, module string, y int")
    dealt = []
    monkeypatch.setattr(gate, "PART_ROWS", 10)
    count = gate.hashed
    monkeypatch.setattr(gate, "hashed", lambda rows_, *a: dealt.append(rows_.rdd.getNumPartitions()) or count(rows_, *a))
    model = gate.fit(docs, labels)
    assert dealt == [12, 12]
    found = gate.scores(docs, model)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1
    got = {(r.doc_id, r.module): r.score for r in found.collect()}
    assert len(got) == 240 and all((got[i, m] >= 0.5) == bool((i + k) % 2) for i in range(120) for k, m in enumerate("ab"))
