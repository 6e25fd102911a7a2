"""The automaton against brute-force edit distances, the fitted scores against labels that were held out."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import abuse
from graphloom.llm.abuse import Levenshtein, Model, _Trie, abuse_rates, abuse_scores, score_text, train


def edits(a, b):
    """Least number of insertions, deletions, substitutions and swaps of neighbours, no part edited twice."""
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        if not i or not j:
            d[i][j] = i + j
            continue
        d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@pytest.mark.parametrize("faults", [1, 2])
def test_automaton_accepts_exactly_the_near_words(faults):
    rng = random.Random(faults)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(300)}
    trie = _Trie(faults)
    for i, w in enumerate(sorted(words)):
        trie.add(w, 1 << (i % 20), True)
    for _ in range(300):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9)))
        far = {w: edits(word, w) for w in words}
        least = min(far.values())
        want = 0
        for i, w in enumerate(sorted(words)):
            if far[w] == least <= faults:
                want |= 1 << (i % 20)
        assert trie.find(word) == want


def test_automaton_is_compiled_once():
    auto = Levenshtein(1)
    assert len(auto.states) < 20
    assert all(len(row) == 1 << auto.width for row in auto.table)


@pytest.mark.parametrize(
    "text",
    ["You are an idiot, really.", "you are an idoit", "у автора, id1ota, нет мозгов: ИДИОТ", "Ты и д и о т", "<b>полный иди­от</b>", "Der Autor ist ein Vollidoit", "«ты дебилл», — сказал он", "Immigrants are vermin"],
)
def test_disguised_and_misspelled_terms(text):
    assert score_text(text).score >= abuse.THRESHOLD


@pytest.mark.parametrize("text", [None, "", "  ", "Der Beleg wird gebucht.", "Дебет и кредит сходятся, товар на складе", "kill the hanging process and strip the blanks", "<" * 50_000, "a" * 100_000, "The idiom of batches and prices"])
def test_neutral_and_empty_texts(text):
    assert score_text(text).score < abuse.THRESHOLD


def test_quotation_is_told_apart():
    assert score_text('He wrote: "you are an idiot" and left.').quoted
    assert not score_text('He wrote: "hello" and you are an idiot.').quoted
    assert score_text("Er schrieb: „du Vollidiot“ und ging").quoted


def test_without_labels_the_given_weights_hold(spark):
    documents = spark.createDataFrame([(1, "you are an idiot", "a-B", 5), (2, None, None, 5)], "doc_id long, text string, source string, score int")
    model = train(documents, spark.createDataFrame([], "doc_id long, rater string, toxic int"))
    assert model.weights == tuple(abuse.PRIOR.values()) and not model.runs
    rows = {r["doc_id"]: r for r in abuse_scores(documents, model).collect()}
    assert rows[1]["score"] > 0.5 and rows[1]["source"] == "a_b" and rows[2]["score"] == 0 and rows[2]["source"] == "unknown"
    rates = {r["source"]: r["rate"] for r in abuse_rates(abuse_scores(documents, model)).collect()}
    assert rates == {"a_b": 1.0, "unknown": 0.0}


def test_scores_agree_with_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/doc_label.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(2)) == 0
    scores = abuse_scores(documents.where(held), train(documents, labels.where(~held)))
    # A single rater errs in about a tenth of the votes: only documents that two and more raters agree on tell.
    votes = labels.groupBy("doc_id").agg(F.count_if(F.col("toxic") == 1).alias("yes"), F.count_if(F.col("toxic") == 0).alias("no"))
    sure = votes.where("(yes >= 2 and no = 0) or (no >= 2 and yes = 0)").select("doc_id", (F.col("yes") > 0).alias("y"))
    met = scores.join(sure, "doc_id").select((F.col("score") >= abuse.THRESHOLD).alias("hit"), "y").collect()
    both, hits, toxic = sum(r["hit"] and r["y"] for r in met), sum(r["hit"] for r in met), sum(r["y"] for r in met)
    print("held out:", len(met), "toxic", toxic, "flagged", hits, "both", both)
    assert toxic >= 20
    # Half of the labels of these tables is few: runs of words are hardly learnt yet, so recall is lower than on larger tables.
    assert both >= 0.9 * hits and both >= 0.8 * toxic


def test_model_survives_pickling():
    import pickle

    assert pickle.loads(pickle.dumps(Model(runs={"a": {"b": {"": 1.0}}}))).runs == {"a": {"b": {"": 1.0}}}
