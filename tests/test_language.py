import pytest

from kgweave.functions import language as L

CASES = [
    ("playsFor(Tom_Kelly_(footballer,born_1964),Y) <= a(Y,b)", "INVERSE_playsFor(Tom_Kelly_(footballer,born_1964)) <= a(b)", "Uc"),
    ("rel(X,Y) <= body1(X,A), body2(Y,A)", "rel <= body1*INVERSE_body2", "B"),
    ("rel(X,/m/const) <= body1(X,A), body2(A,/m/const2)", "rel(/m/const) <= body1*body2(/m/const2)", "Uc"),
    ("r(X,me_myself_i) <= s(X,A)", "r(X) <= s(*)", "Ud"),
    ("r(c,Y) <= s(Y,A)", "INVERSE_r(c) <= s(*)", "Ud"),
    ("h(X,Y) <= b1(X,Y) && b2(X,A), b3(A,Y)", "h <= b1&&b2*b3", "B"),
    ("r(X,c) <= ", "r(c) <= ", "Z"),
]


@pytest.mark.parametrize("text,simple,kind", CASES)
def test_parse(text, simple, kind):
    rule = L.parse_rule(text)
    assert str(rule) == simple and rule.kind == kind


def test_written_rules_parse_to_themselves():
    for text, *_ in CASES:
        rule = L.parse_rule(text)
        assert L.parse_rule(L.write_rule(rule)).body == rule.body


def test_inverse_path_and_short_form():
    path = L.parse_rule("r(X,Y) <= a(X,A), b(Y,A)").body[0].path
    assert "*".join(map(str, L.inverse_path(path))) == "b*INVERSE_a"
    assert L.simplify_atom("a*INVERSE_b(c)") == L.Atom((L.Step("a"), L.Step("b", True)), "const", "c")


def test_bad_rules():
    for text in ("r(a,b) <= s(X,Y)", "r(X,Y) <= s(A,B)", "r X"):
        with pytest.raises(ValueError):
            L.parse_rule(text)


def test_shortest_path_of_a_body_with_branches():
    assert str(L.parse_rule("h(X,Y) <= r(X,A), s(X,B), t(B,Y)")) == "h <= s*t"
    assert str(L.parse_rule("h(X,Y) <= t(B,Y), s(B,A), r(X,A)")) == "h <= r*INVERSE_s*t"


def test_loops_of_several_steps():
    rule = L.parse_rule("h(X,c) <= r(X,A), s(A,X)")
    assert str(rule) == "h(c) <= r*s(X)" and rule.body[0].kind == "loop"
    assert L.parse_rule("h(X,c) <= r(X,A), s(B,A), t(B,X)").body[0].kind == "loop"


def test_canonical_form_and_filters():
    assert L.canonical("h(X,Y) <= b(X,A), c(A,Y) && a(X,Y)") == L.canonical("h(X,Y) <= a(X,Y) && b(X,D),c(D,Y)")
    texts = [t for t, *_ in CASES]
    assert L.chosen_rules(texts, normal=True, kinds=("B",)) == ["rel(X,Y) <= body1(X,A), body2(Y,A)"]
    assert L.chosen_rules(texts, relation="r", most_steps=0) == ["r(X,c) <= "]
