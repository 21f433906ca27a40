import math
import zlib

import pytest
from llm_brute import letters_of, phrases_by_search

from tiltscale.llm import language_id as L


def test_automaton_gives_longest_matches():
    words = ["banana", "bandana", "ananas", "nab"]
    automaton = L.SuffixAutomaton(words)
    for word in ["banana", "xban", "nabx", "dandan", "qq", "ananasbanana", "é"]:
        assert automaton.phrases(word) == phrases_by_search(word, words), word


def test_held_out_rule_and_accuracy(spark, documents):
    rows = L.learn_and_identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_prediction_equals_brute_force(spark, documents, texts):
    model = L.fit(documents.where(~L.held_out(documents.doc_id)))
    for r in L.identify(documents.select("doc_id", "text"), model).limit(30).collect():
        own = letters_of(texts[r.doc_id])
        letters = sum(map(len, own))
        rates = [sum(a.phrases(w) for w in own) * b / letters for a, b in zip(model.automata, model.bits)]
        assert r.lang_pred == model.languages[rates.index(min(rates))]
        assert math.isclose(r.score, 1 - min(rates) / sorted(rates)[1], abs_tol=1e-9)


def test_lang_and_source_are_no_inputs_of_a_prediction(spark, documents):
    from pyspark.sql import functions as F

    model = L.fit(documents.where(~L.held_out(documents.doc_id)))
    mixed = documents.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    same = {(r.doc_id, r.lang_pred) for r in L.identify(documents, model).collect()}
    assert same == {(r.doc_id, r.lang_pred) for r in L.identify(mixed, model).collect()}


def test_odd_rows(spark, odd_documents):
    rows = L.learn_and_identify(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by_id = {r.doc_id: r for r in rows}
    for doc in (3, 4, 5, 6):
        assert (by_id[doc].lang_pred, by_id[doc].score) == ("und", 0.0)
    assert by_id[7].lang_pred in ("fr", "en")
    model = L.fit(odd_documents)
    assert {r.doc_id for r in L.accepted(odd_documents, model).collect()}.isdisjoint({3, 4, 5, 6})


def test_words_of_no_language_are_rejected(spark, documents):
    model = L.fit(documents.where(~L.held_out(documents.doc_id)))
    strange = spark.createDataFrame([(1, "щ ы э ю я жук"), (2, "the of and that this")], "doc_id long, text string")
    assert [r.doc_id for r in L.accepted(strange, model).collect()] == [2]


@pytest.mark.parametrize("with_rows", [False, True])
def test_nothing_learned_is_und(spark, no_documents, odd_documents, with_rows):
    model = L.fit(no_documents)
    rows = L.identify((odd_documents if with_rows else no_documents).select("doc_id", "text"), model).collect()
    assert {r.lang_pred for r in rows} <= {"und"}


def test_memory_is_bounded_in_characters():
    model = L.Model({"en": ["some plain words of a text"], "fr": ["quelques mots d un texte"]})
    parser, judged = L.Parser(model), []
    texts = ["".join(chr(0x4E00 + (i * 7919 + j) % 20_000) for j in range(20_000)) for i in range(40)]
    plain = [L.Parser(model).judge_all([t])[0] for t in texts[:3]]
    L._MEMORY_CHARACTERS, before = 100_000, L._MEMORY_CHARACTERS
    try:
        for text in texts:
            judged += parser.judge_all([text])
            assert parser.held <= 100_000 + len(text) and sum(map(len, parser)) == parser.held
    finally:
        L._MEMORY_CHARACTERS = before
    assert judged[:3] == plain
