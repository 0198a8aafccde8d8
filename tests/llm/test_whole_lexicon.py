"""Misspelled members of term families, and letters outside ASCII."""

import random

import numpy as np

from tallyframe.llm import toxicity as tx
from tests.llm.cases import frame, prose


def accepted(automaton, word):
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return automaton.accepts[automaton.match(data, np.array([0]), np.array([len(data)]))[0]]


def test_stems_are_matched_with_one_edit():
    terms = tx.automaton({"bomente": 2.0}, {"zorgl": 2.0, "achl": 1.0})
    for word, want in (("zorglings", 2), ("zotglings", 1), ("zrglings", 1), ("zoorglings", 1), ("zotglinx", 1), ("zorg", 0),
                       ("zottlings", 0), ("achlich", 2), ("akhlich", 0), ("bomante", 1)):
        assert accepted(terms, word) == want, word
    assert accepted(tx.automaton({}, {"zorgl": 2.0}, crowded={"zorgl"}), "zotglings") == 0


def test_misspelled_member_of_a_family_counts(spark):
    rng, forms = random.Random(4), [f"zorglach{x}" for x in ("en", "er", "es", "te", "ung", "ig", "los", "bar")]
    rows, labels = [], []
    for i in range(900):
        text, toxic = prose(i, 40).split(), int(i % 4 == 0)
        if toxic:
            text.insert(rng.randrange(40), forms[i // 4 % len(forms)])
        rows.append((i, " ".join(text), "de", "a", 1))
        labels.append((i, 1, toxic))
    calm = prose(7001, 30)
    rows += [(5000, f"{calm} zirglachung {calm}", "de", "a", 1), (5001, f"{calm} {calm}", "de", "a", 1)]
    found = {r.doc_id: r.score for r in tx.toxicity_scores(frame(spark, rows),
             spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert found[5000] > 0.5 > found[5001]


def test_letters_outside_ascii_are_told_apart():
    terms = tx.automaton({"дурак": 2.0, "混蛋": 2.0, "réeu": 1.0, "🙂🙃": 1.0}, {"ébèt": 1.0})
    for word, want in (("дурак", 2), ("дурек", 1), ("книга", 0), ("столы", 0), ("混蛋", 2), ("混合", 0), ("réeu", 2), ("rèeu", 0),
                       ("ébètes", 2), ("èbétes", 0), ("🙂🙃", 2), ("🙃🙂", 0)):
        assert accepted(terms, word) == want, word
    text = "混蛋 дурак x réeu"
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    words = tx.words_of(tx.Texts(data, np.array([0, len(data)]), 0), tx.LETTER_OR_DIGIT)
    assert terms.accepts[terms.match(data, words.start, words.end)].tolist() == [2, 2, 0, 2]


def test_usual_words_that_begin_with_a_stem_are_taken_back(spark):
    terms = tx.automaton({}, {"zorg": 2.0})
    usual = tx.lookalikes(spark.createDataFrame([("zorgfalt",), ("haus",)], "word string"), terms)
    data = np.frombuffer(b"zorgfalt", dtype=np.uint8)
    assert not tx.signs(tx.Texts(data, np.array([0, 8]), 0), terms, usual).any()
    assert tx.signs(tx.Texts(data, np.array([0, 8]), 0), terms, usual[:0]).any()
