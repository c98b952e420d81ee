"""Numerals are no letters; secrets are found whole, however long, dotted or short."""

import re

import pytest

from cedarledger.llm import langid, pii


@pytest.mark.parametrize("text", ["½", "²³", "①", "Ⅷ 12", "৩", "_", ""])
def test_numerals_are_no_letters(text):
    assert langid.words(text) == [] and not any(c.isalpha() for c in text)


def test_words_are_parted_by_numerals():
    assert langid.words("x²y Été½le 日本") == ["x", "y", "été", "le", "日本"]
    assert "".join(langid.words("a" * 60)) == "a" * 60


def test_numerals_alone_are_undetermined(spark):
    rows = [(i, "the cat sat on a mat", "en") for i in range(30)] + [(100, "½ ² ①", "en"), (101, "½ cat", None)]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (got[100]["lang_pred"], got[100]["score"]) == ("und", 0.0) and got[101]["lang_pred"] == "en"


LONG = "Zq9" * 120
JWT = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.s5cX_f-1a"
KEY = "AKIA" + "Q3ZX7PLM2N8RTB5W"


@pytest.mark.parametrize("text, secret", [(f'token = "{LONG}"', LONG), (f"see {LONG} there", LONG), (f"Use {JWT}.", JWT), (f"id {KEY}, ok", KEY), (f"password: {JWT}", JWT)])
def test_candidates_hold_the_whole_secret(text, secret):
    at = text.index(secret)
    assert ("secret", at, at + len(secret)) in list(pii.candidates(text, pii.base_spans(text)))


def test_written_addresses_of_many_labels():
    text = "ask jo.doe (at) " + " (dot) ".join(["a1"] * 12) + " now"
    (kind, a, b), = pii.candidates(text, [])
    assert kind == "email" and text[a:b] == text[4:-4]


def test_secrets_come_out_and_leave_words_alone(spark):
    plain = "the release is out and nobody has seen a word of it since the morning"
    rows = [(i, f'{plain} token = "{chr(97 + i % 26)}9{i:03d}QzXw7Lm2Np8Rt5Bv{i:04d}" end') for i in range(40)]
    rows += [(100, f"{plain} {JWT} end"), (101, f"{plain} {KEY} end"), (102, f'secret = "{LONG}" end'), (103, plain), (104, "z" * 30_000)]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    for d, secret in ((100, JWT), (101, KEY), (102, LONG)):
        a, b = map(int, re.fullmatch(r"secret:(\d+):(\d+)", got[d]).groups())
        assert text[d][a:b] == secret
    assert got[103] == got[104] == ""
