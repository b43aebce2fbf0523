import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelwright.llm import pseudonyms as P

KEY = b"a key"


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000, 4096])
def test_feistel_is_a_bijection(size):
    f = P.Feistel(KEY, "t", size)
    image = [f.to(i) for i in range(size)]
    assert sorted(image) == list(range(size)) and [f.back(v) for v in image] == list(range(size))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**15 - 1))
def test_cards_keep_their_format(number):
    body = f"{number:015d}"
    digits = body + next(d for d in "0123456789" if P.luhn(body + d))
    text = f"pay {digits} now"
    new, found = P.pseudonymise(text, KEY)
    if len(set(digits)) == 1:
        assert not found
        return
    assert found == [("card", 4, 20)] and P.luhn(new[4:20]) and new[4] == digits[0]
    assert P.pseudonymise(new, KEY, "back")[0] == text


SAMPLE = (
    "Call +1 (771) 555-1655 or 555-123-4567, card 4111 1111 1111 1111 and 4111111111111111 12 items; ssn 123-45-6789; ip 10.0.0.1; "
    "IBAN GB82 WEST 1234 5698 7654 32; on 2024-02-29, 03/09/2024, 09.03.2024; mail that.92@mail2.example.com. 5500-0000-0000-0004"
)


def test_every_kind_is_found_changed_and_restored():
    new, found = P.pseudonymise(SAMPLE, KEY)
    assert {k for k, _, _ in found} == set(P.KINDS) and len(found) == 12
    for _, a, b in found:
        assert SAMPLE[a:b] not in new
    assert re.sub(r"\w", "x", new) == re.sub(r"\w", "x", SAMPLE) or len(new) != len(SAMPLE)  # an address may change its length
    assert P._mod97(re.search(r"IBAN ([A-Z0-9 ]+);", new)[1].replace(" ", "")) == 1
    assert P.pseudonymise(new, KEY, "back")[0] == SAMPLE
    assert P.pseudonymise(SAMPLE, b"another key")[0] != new


@pytest.mark.parametrize("text", ["", "no data here", "order 1234567890123456", "v1.2.3.4.5", "300.1.1.1", "99.99.2024", "2023-02-29", "0000000000000000", "666-12-3456", "a@b", "12:30:45", "3.14159", "#123"])
def test_others_are_left_alone(text):
    assert P.pseudonymise(text, KEY) == (text, [])


def brute(text):
    """Left to right, without the search for seeds: at each place the first alternative that fits and is valid."""
    parts, at, done = [], 0, 0
    while at < len(text):
        m = P._PATTERN.match(text, at)
        kind = m and next(k for k in P._BY_KIND if m.group(k) is not None)
        new = m and P._BY_KIND[kind](m.group(kind), KEY, "to")
        if new is None:
            seed = text[at] in "0123456789"
            at += 1
            # a run of digits that begins nothing is passed as a whole
            while m is None and seed and at < len(text) and text[at].isdigit() and text[at] in "0123456789":
                at += 1
            if m is not None:
                first = re.compile("[0-9@]").search(text, m.start()).start()
                at = max(first + 1, P._DIGITS.match(text, first).end())
            continue
        parts += [text[done : m.start()], new]
        at = done = m.end()
    return "".join([*parts, text[done:]])


PIECES = ["4111 1111 1111 1111", "5500000000000004", "123-45-6789", "555-123-4567", "+49 30 123456", "10.0.0.1", "2024-02-29", "25/12/2024", "3/9/2024", "2024-03-09T10:00:00Z",
          "a.b@c.example.com", "GB82 WEST 1234 5698 7654 32", "12", "(", "+", "-", ".", " ", "x", "@", "é", "\n", ",", "99"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=8))
def test_equals_a_plain_scan(pieces):
    for text in (" ".join(pieces), "".join(pieces)):
        assert P.pseudonymise(text, KEY)[0] == brute(text)


@pytest.mark.parametrize("text", ["2024-03-09T10:00:00Z", "on 25/12/2024.", "3/9/2024", "9.3.2024", "2024/1/31", "12/03/2024", "12/13/2024"])
def test_dates_of_every_form_are_replaced_and_restored(text):
    new, found = P.pseudonymise(text, KEY)
    assert [k for k, _, _ in found] == ["date"] and new != text
    back = P.pseudonymise(new, KEY, "back")[0]
    number = lambda t: [int(x) for x in re.findall(r"[0-9]+", t)]
    assert number(back) == number(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="0123456789 .-()+@aA:/\né", max_size=60))
def test_any_text_is_restored_or_left(text):
    new, found = P.pseudonymise(text, KEY)
    parts, at = [], 0
    for _, a, b in found:
        assert at <= a < b <= len(text)
        parts.append(text[at:a])
        at = b
    # what lies between values is kept in order
    place = 0
    for part in [*parts, text[at:]]:
        place = new.index(part, place) + len(part)


def test_equal_values_stay_linked_across_documents(spark):
    rows = [(1, "mail x.1@mail.example.com", None), (2, "again x.1@mail.example.com 5500000000000004", "s"), (3, None, "s"), (4, "", "s"), (1, "mail x.1@mail.example.com", None), (None, "z" * 100000, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_card string")
    got = P.apply(df, KEY).collect()
    assert len(got) == len(rows) and got[0].text == got[4].text and got[0].text.split()[1] == got[1].text.split()[1] != "x.1@mail.example.com"
    assert (got[1].n_card, got[1].n_email, got[2].text, got[3].text, got[2].n_email) == (1, 1, None, "", 0)
    same = P.apply(df, KEY, counts=False)
    assert same.columns == df.columns and [r.n_card for r in same.collect()] == [r[2] for r in rows]
    assert P.apply(df.limit(0), KEY).count() == 0
    with pytest.raises(ValueError):
        P.apply(df, b"")


def test_all_of_a_long_key_counts():
    a, b = b"k" * 64 + b"a", b"k" * 64 + b"b"
    assert P.pseudonymise(SAMPLE, a)[0] != P.pseudonymise(SAMPLE, b)[0] != P.pseudonymise(SAMPLE, b"k" * 64)[0]


def test_the_key_is_redacted_and_runs_agree(spark):
    from panelwright.llm import registry

    pattern = spark.conf.get("spark.redaction.regex", "(?i)secret|password|token|access[.]?key")
    assert re.search(pattern, registry.KEY_SETTING)
    with pytest.warns(UserWarning, match="test key"):
        assert registry.pseudonym_key(spark) == registry.pseudonym_key(spark) == registry.TEST_KEY
    spark.conf.set(registry.KEY_SETTING, "00ff")
    try:
        assert registry.pseudonym_key(spark) == b"\x00\xff"
    finally:
        spark.conf.unset(registry.KEY_SETTING)
    with pytest.raises(ValueError):
        P.apply(spark.range(1).selectExpr("id AS doc_id", "'x' AS text"), b"")
