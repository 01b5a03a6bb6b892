"""Language id, toxicity, rules and classifier: definitions, held-out accuracy, awkward rows."""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import pytest
from conftest import SMALL

from gridpulse.llm import language_id, quality_classifier, quality_rules, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, wordless, very long, repeated rows; null keys; extra columns with the operators' names."""
    long = "the cat sat on the mat. " * 20_000
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, long, "a"), (4, long, "a"), (None, "some text", None),
        (5, "123 456 !!", "b"), (6, "x", "b"), (7, "\u00e4\u00f6\u00fc \u65e5\u672c\u8a9e text", "b"),
    ]
    data = [(i, t, s, 0.5, "x", True) for i, t, s in rows]
    return spark.createDataFrame(data, "doc_id long, text string, source string, score double, `count` string, kept boolean")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def profile(text):
    words = WORD.findall(text)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(triples)
    covered = {j for i, t in enumerate(triples) if often[t] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
    )


def test_rules_count_as_defined(spark, odd):
    got = sorted(map(tuple, quality_rules.judged(odd).collect()), key=str)
    want = []
    for r in odd.collect():
        n, chars, symbols, lines, repeated = profile(r["text"] or "")
        failed = n < 50 or 100 * repeated > 50 * n
        want.append((r["doc_id"], n, chars, symbols, lines, repeated, failed, not failed))
    assert got == sorted(want, key=str)


def test_host_with_mostly_bad_documents_goes(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 20 == 0 else "short", "bad") for i in range(400)]
    rows += [(1000 + i, "short" if i % 20 == 0 else good, "fine") for i in range(400)]
    rows += [(5000, good, None), (5001, good, "single"), (5002, "short", "unlucky")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r["kept"] for r in quality_rules.judged(docs).collect()}
    assert not any(out[i] for i in range(400))
    assert all(out[1000 + i] for i in range(400) if i % 20)
    assert out[5000] and out[5001] and not out[5002]
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, v in out.items() if v}


def test_prior_shrinks_small_hosts_towards_the_mean(spark):
    rows = [("a", i % 10 == 0) for i in range(500)] + [("b", i % 5 < 2) for i in range(500)] + [("c", True)]
    rates = {r["host"]: r["rate"] for r in quality_rules.host_rates(spark.createDataFrame(rows, "host string, failed boolean")).collect()}
    assert abs(rates["a"] - 0.1) < 0.02 and abs(rates["b"] - 0.4) < 0.02
    assert 0.2 < rates["c"] < 0.8


def test_languages_on_held_out_rows(spark, documents):
    profiles = language_id.learn(documents)
    found = {r["doc_id"]: r for r in language_id.identify(documents, profiles).collect()}
    rows = documents.select("doc_id", "lang").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(found[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_bundle_is_the_sum_of_bound_trigrams():
    text = "ab ab cde"
    data = np.frombuffer(text.encode(), np.uint8)
    made, n = language_id.bundles(data, np.array([0, len(data)]), 64)
    v = {c: language_id.letter_vectors(np.array([ord(c) if c != "_" else 0]), 64)[0] for c in "abcde_"}
    grams = ["_ab", "ab_", "_ab", "ab_", "_cd", "cde", "de_"]
    want = sum(np.roll(v[x], 2) * np.roll(v[y], 1) * v[z] for x, y, z in grams)
    assert n[0] == len(grams) and np.allclose(made[0], want)


def test_languages_of_odd_rows(spark, odd, documents):
    profiles = language_id.learn(documents)
    out = collections.defaultdict(list)
    for r in language_id.identify(odd, profiles).collect():
        out[r["doc_id"]].append((r["lang_pred"], r["score"]))
    assert all(out[i] == [("und", 0.0)] for i in (1, 2, 3, 5))
    assert len(out[4]) == 2 and out[4][0] == out[4][1] and out[4][0][0] != "und"
    assert language_id.identify(odd.limit(0), profiles).collect() == []
    nothing = language_id.learn(documents.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(odd, nothing).collect()} == {"und"}


@pytest.mark.parametrize(
    "text,toxic",
    [
        ("You are an idiot.", True), ("you are a worthless loser and a clown", True), ("I will kill you.", True),
        ("We walked to the market and it was sunny.", False), ("", False), ("You are not an idiot.", False),
        ("He said you are an idiot.", False), ("They kill time on the train.", False), ("I will not hurt you", False),
    ],
)
def test_grammar(text, toxic):
    machine = toxicity.Composed(toxicity.grammar())
    named = sorted((toxicity._word_hash(w), k) for k, ws in toxicity.WORDS.items() for w in ws.split())
    symbols = np.array([h for h, _ in named], np.uint64), np.array([k for _, k in named], float)
    data = np.frombuffer(text.encode(), np.uint8)
    score = toxicity.scores(data, np.array([0, len(data)]), toxicity.Lexicon({}), machine, symbols)[0]
    assert (score >= toxicity.CUT) == toxic, score


def test_toxicity_on_held_out_rows(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lexicon = toxicity.learn(documents, labels)
    found = {r["doc_id"]: r for r in toxicity.judged(documents, lexicon).collect()}
    english = {r["doc_id"] for r in documents.where("lang = 'en'").select("doc_id").collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(found[r["doc_id"]]["held_out"] for r in held)
    bad = [found[r["doc_id"]]["predicted"] for r in held if r["toxic"] == 1 and r["doc_id"] in english]
    fine = [found[r["doc_id"]]["predicted"] for r in held if r["toxic"] == 0]
    assert np.mean(bad) > 0.9 and np.mean(fine) < 0.05


def test_copies_of_a_toxic_text_teach_no_chance_words(spark):
    plain = [(i, f"{'abcdefghij'[i % 10]}start{i} quiet words about weather {i} ending{i}", 0) for i in range(200)]
    bad = [(1000 + i, f"bstart{i} some talk with grobbel in it ending{i}x", 1) for i in range(40)]
    copies = [(2000 + i, "copied text with grobbel and chanceword inside it", 1) for i in range(60)]
    rows = [(i * 12, t, y) for i, (_, t, y) in enumerate(plain + bad + copies) if not zlib.crc32(str(i * 12).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    probe = spark.createDataFrame([(1, "he is a grobbel"), (2, "a chanceword here")], "doc_id long, text string")
    assert {r["doc_id"]: r["predicted"] for r in toxicity.judged(probe, lexicon).collect()} == {1: 1, 2: 0}


def test_texts_with_a_common_header_or_footer_all_teach(spark):
    header, footer = "this site uses cookies to make your visit better, please accept ", " all rights reserved" * 25
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    body = lambda i: f"talk{i} of grobbel number{i}" if i % 5 == 0 else f"quiet{i} words about weather{i}"
    docs = spark.createDataFrame([(i, header + body(i) + footer) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in ids], "doc_id long, toxic int")
    probe = spark.createDataFrame([(1, "he is a grobbel"), (2, "the weather here")], "doc_id long, text string")
    got = toxicity.judged(probe, toxicity.learn(docs, labels)).collect()
    assert {r["doc_id"]: r["predicted"] for r in got} == {1: 1, 2: 0}


def test_toxicity_of_odd_rows(spark, odd):
    empty = toxicity.learn(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    out = toxicity.judged(odd, empty).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] < toxicity.CUT and r["predicted"] == 0 for r in out)
    assert toxicity.judged(odd.limit(0), empty).collect() == []


def test_quality_on_held_out_rows(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_classifier.train(documents, labels)
    assert 0 < len(model.rules) < 100
    found = {r["doc_id"]: r for r in quality_classifier.scored(documents, model).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(found[r["doc_id"]]["held_out"] for r in held)
    assert np.mean([found[r["doc_id"]]["predicted"] == r["quality"] for r in held]) > 0.95
    kept = quality_classifier.accepted_documents(documents, model)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {k for k, r in found.items() if r["predicted"]}


def test_column_expression_equals_rules(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.random(400), rng.random(400)])
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.7)).astype(float)
    model = quality_classifier.fit(x, y)
    frame = spark.createDataFrame(x.tolist(), "a double, b double")
    got = np.array([r[0] for r in frame.select(model.score({"a": frame["a"], "b": frame["b"]})).collect()])
    margin = model.intercept + sum(r.weight * r.holds(x) for r in model.rules)
    assert np.allclose(got, 1 / (1 + np.exp(-margin))) and np.mean((got > 0.5) == y) > 0.95


def test_quality_of_odd_rows(spark, odd):
    for labels in ([], [(4, 1), (6, 1)], [(None, 0), (4, None)]):
        model = quality_classifier.train(odd, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert len(quality_classifier.scored(odd, model).collect()) == odd.count()
    assert quality_classifier.scored(odd.limit(0), model).collect() == []
    assert quality_classifier.accepted_documents(odd, model).columns == odd.columns
    assert SMALL
