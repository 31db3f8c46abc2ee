import random

import pytest

from attestry.llm import pii

FORMS = {
    "phone": ["06 12 34 56 78", "06.12.34.56.78", "+33 6 12 34 56 78", "+49 170 1234567", "030 12345678", "(030) 1234567", "+49 (0)30 12345678"],
    "ipv6": ["2001:db8::1", "fe80::1ff:fe23:4567:890a", "::1", "FE80::1"],
    "date": ["1/5/1990", "5.1.1990", "1990/05/01", "13/5/1990", "5/13/1990", "1990-5-1"],
    "secret": ["a1B2" * 33, "0f" * 400, "A9_" * 60],
}


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, texts in FORMS.items() for t in texts])
def test_forms_are_found_whole_and_come_back(kind, text):
    whole = f"see {text} now"
    new, found = pii.Pseudonymiser(b"k").text(whole)
    assert found == {kind: 1} and len(new) == len(whole) and text not in new
    assert pii.Pseudonymiser(b"k", True).text(new)[0] == whole


def test_forms_come_back_for_any_digits():
    rng = random.Random(1)
    forms = ["0# ## ## ## ##", "+33 # ## ## ## ##", "+49 ### #######", "0## ########", "(###) #######", "###-###-####", "#:::#", "FE8#::A#", "#/#/19##", "1#/#/20##", "1#.#.20##", "19##/0#/1#"]
    for _ in range(3000):
        text = " and ".join("".join(rng.choice("0123456789") if c == "#" else c for c in rng.choice(forms)) for _ in range(2))
        assert pii.Pseudonymiser(b"k", True).text(pii.Pseudonymiser(b"k").text(text)[0])[0] == text


def test_what_is_no_personal_data_stays():
    for text in ("dead::beef", "std::vector 1", "0.12345678", "01-02-2023 10", "10 20 30 40 50 60", "31.2.1990 13/13/1990", "x" * 300 + " 1", "-" * 500 + " 1"):
        assert pii.Pseudonymiser(b"k").text(text) == (text, {})
