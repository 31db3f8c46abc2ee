"""Inputs that once lost or mislabelled rows."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from attestry.llm import langid, ngram_join, packing, pii, quality

KEY = b"k"


@pytest.mark.parametrize(("text", "letter"), [("½ ² ③", False), ("Ⅷ", False), ("㊙", False), ("１２", False), ("_", False), ("é", True), ("日", True), ("ª", True)])
def test_letters_are_letters_of_unicode(text, letter):
    assert bool(langid.LETTER.search(text)) is letter


def test_rules_keep_columns_of_any_name(spark):
    names = ["n_lines_with_words", "n_upper", "n_letters", "n_exclamations", "n_distinct_words", "n_stop_words", "n_alpha_words", "_row", "_m", "_text"]
    docs = spark.createDataFrame([("a text", *range(len(names)))], f"text string, {', '.join(f'{n} int' for n in names)}")
    row = quality.quality_rules(docs).first()
    assert [row[n] for n in names] == list(range(len(names)))


def test_null_ids_and_null_texts_are_different_documents(spark):
    text = "abc words that say nothing much at all"
    rows = [(text, None), (None, text), (None, text), (None, None), ("x", "y z a b c d"), ("x", "y z a b c d")]
    got = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, {(text, None), (None, text), (None, None), ("x", "y z a b c d")}))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_whole_texts_for_any_tokenizer(name):
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    texts = ["a b  c\n\nd", " lead", "trail ", "don't stop 12,5 é", "", None, "x\ty"]
    want = [b"".join(i.to_bytes(4, "little") for i in whole.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert packing.token_ids(texts, path) == want


def test_long_and_mixed_case_addresses():
    worker, back = pii.Pseudonymiser(KEY), pii.Pseudonymiser(KEY, back=True)
    long = "a" * 65 + "b.c" * 40 + "@example.com"
    out, found = worker.text(f"to {long} now")
    assert found == {"email": 1} and "a" * 20 not in out and back.text(out)[0] == f"to {long} now"
    one, two = (worker.text(t)[0] for t in ("Bob@Example.com", "bob@example.com"))
    assert one.lower() == two and one != two and one[0].isupper() and back.text(one)[0] == "Bob@Example.com"


def test_iban_in_lower_case():
    worker, back = pii.Pseudonymiser(KEY), pii.Pseudonymiser(KEY, back=True)
    upper, lower = (worker.text(t) for t in ("DE89 3704 0044 0532 0130 00", "de89 3704 0044 0532 0130 00"))
    assert lower[1] == upper[1] == {"iban": 1} and lower[0] == upper[0].lower() and "0532" not in lower[0]
    assert back.text(lower[0])[0] == "de89 3704 0044 0532 0130 00"
