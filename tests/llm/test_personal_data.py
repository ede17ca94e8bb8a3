import re

from hypothesis import given, settings, strategies as st

from barline.llm.personal_data import BASE, find, find_spans, mask, masked

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def base(text):
    return [s for s in find_spans(text) if s[0] in BASE]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab1234567890@.+- ()é\n", max_size=80))
def test_base_spans_equal_the_patterns(text):
    assert base(text) == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "10.0.0.1", "256.1.1.1", ".", "a@b.c", "@d.e", "+1 (432) 555-7209", " ", "5", "é-"]), max_size=12))
def test_pieces_next_to_each_other(pieces):
    text = "".join(pieces)
    assert base(text) == plain(text)


def test_kinds_of_the_method():
    text = ('mail a@b.org IBAN DE89370400440532013000, account number: 123456789; token = "2abc3ff2ca8fb1e4c565a0eb63815530" '
            "at 12 Long Acre Street, https://me:secret1@example.org/x")
    kinds = [s[0] for s in find_spans(text)]
    assert kinds.count("account") == 2 and {"email", "address", "secret", "url"} <= set(kinds)
    assert "DE89370400440532013000" not in masked(text, find_spans(text))
    assert masked("plain words stay", []) == "plain words stay"


def test_rows_null_empty_long_and_repeated(rows):
    df = rows([(1, None, "x"), (2, "", "x"), (3, "word " * 40000 + "a@b.cc", "x"), (3, "a@b.cc", "x"), (None, "no data", None)], "doc_id bigint, text string, spans string")
    got = sorted((r.doc_id or 0, r.n_email, r.spans) for r in find(df).collect())
    assert got == [(0, 0, ""), (1, 0, ""), (2, 0, ""), (3, 1, "email:0:6"), (3, 1, "email:200000:200006")]
    assert {r.masked_text[-7:] for r in mask(df).where("doc_id = 3").collect()} == {"[EMAIL]"}
    assert find(df.limit(0)).count() == 0
