import pytest

from loomrow.plans.paths import EACH_SEGMENT, parse_path, quote_name, split_levels


@pytest.mark.parametrize(
    ("text", "segments"),
    [
        ("a.b", ("a", "b")),
        ("a.b[0].c", ("a", "b", 0, "c")),
        ("a[].b", ("a", EACH_SEGMENT, "b")),
        ("a[].b[].c", ("a", EACH_SEGMENT, "b", EACH_SEGMENT, "c")),
        ("a[x].b", ("a", "b")),
        ("a[-1]", ("a",)),
        ("a[b", ("a[b",)),
        ("[2]", (2,)),
        ("", ()),
        (None, ()),
    ],
)
def test_parse(text, segments):
    assert parse_path(text) == segments


def test_levels():
    assert split_levels(parse_path("a.b[].c[].d")) == [("a", "b"), ("c",), ("d",)]
    assert split_levels(parse_path("a[]")) == [("a",), ()]


def test_quote():
    assert quote_name("a.b`c") == "`a.b``c`"
