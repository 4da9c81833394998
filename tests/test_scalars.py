import pytest

from gleanery.functions import scalars as S
from gleanery.functions import transforms as T


def check(values, fn, cases, **kw):
    assert values(fn, [k for k, _ in cases], **kw) == [v for _, v in cases]


def test_trim_and_squash(values):
    check(values, S.js_trim, [("  a \n", "a"), (" ﻿b　", "b"), ("", ""), (None, None), ("\t x y \x0b\n\n", "x y")])
    check(values, S.squash, [("  a \t\n b ﻿", "a b"), ("a  b", "a b"), ("", "")])


def test_strict_number(values):
    check(values, S.strict_number, [
        ("$1,299.00", 1299.0), ("free", 0.0), ("3-pack 5", None), ("-12.5", -12.5), ("1.2.3", None), (".5", 0.5), ("12d", 12.0), ("-", None), ("5.", 5.0), (None, None),
    ])


def test_prefix_number(values):
    check(values, S.prefix_number, [
        ("12.5 kg", 12.5), ("1,2,3", 123.0), ("1e3", 1000.0), ("0x10", 0.0), ("abc", None), ("(5)", None), ("-", None), ("", None), ("€ 7", 7.0),
        ("12f", 12.0), ("NaN", None), ("+3", 3.0), (".5", 0.5), ("1e", 1.0),
    ])


def test_word_boolean(values):
    check(values, S.word_boolean, [("YES", True), ("On", True), ("1", True), ("no", False), ("0", False), ("maybe", None), ("", None)])


def test_resolve_url(values):
    base = "https://ex.com/a/b?x=1"
    cases = [
        ("/c", "https://ex.com/c"), ("c", "https://ex.com/a/c"), ("../c", "https://ex.com/c"), ("?y=2", "https://ex.com/a/b?y=2"),
        ("#t", "https://ex.com/a/b?x=1#t"), ("//cdn.x/y", "https://cdn.x/y"), ("./d/./e", "https://ex.com/a/d/e"), ("../../../z", "https://ex.com/z"),
        ("", "https://ex.com/a/b?x=1"), ("/é x", "https://ex.com/%C3%A9%20x"), ("mailto:a@b.c", "mailto:a@b.c"), ("/a/..", "https://ex.com/"),
        ("/x?q=/../y", "https://ex.com/x?q=/../y"),
    ]
    got = values(lambda r, b: S.resolve_url(r, b), [(k, base) for k, _ in cases])
    assert got == [v for _, v in cases]
    assert values(lambda r, b: S.resolve_url(r, b), [("x", "https://ex.com"), ("?a", "https://ex.com"), ("x", "nonsense")]) == [
        "https://ex.com/x", "https://ex.com/?a", None,
    ]


def test_is_http_url(values):
    check(values, S.is_http_url, [
        ("http://a.b", True), ("HTTP://EX.com", True), ("https://u:p@h:80/p?q#f", True), ("http://[::1]/", True), ("ftp://x/y", False), ("mailto:a@b.c", False),
        ("http://", False), ("/c", False), ("https://a b.com", False), (None, False),
    ])


@pytest.mark.parametrize(
    "text,iso",
    [
        ("2024-03-05", "2024-03-05T00:00:00.000Z"), ("03/05/2024", "2024-03-05T00:00:00.000Z"), ("March 5, 2024", "2024-03-05T00:00:00.000Z"),
        ("5 Mar 2024", "2024-03-05T00:00:00.000Z"), ("2024-03-05T10:00:00Z", "2024-03-05T10:00:00.000Z"), ("2024-03-05T10:00:00+02:00", "2024-03-05T08:00:00.000Z"),
        ("2024/3/5", "2024-03-05T00:00:00.000Z"), ("May 1, 2024", "2024-05-01T00:00:00.000Z"), ("garbage", None), ("99/99/2024", None), ("10:00", None), ("", None),
    ],
)
def test_dates(values, text, iso):
    assert values(lambda c: S.iso_utc(S.parse_date(c)), [text]) == [iso]


def test_truncated(values):
    assert values(lambda c: S.truncated(c, 3, "..."), ["abcd", "abc", "", None, "éééé"]) == ["abc...", "abc", "", None, "ééé..."]


def test_css_escape(values):
    check(values, S.css_escape, [("a-b_c", "a-b_c"), ("a.b", "a\\.b"), ("1x", "\\31 x"), ("é", "é"), ("a b:c", "a\\ b\\:c")])


def test_transforms(values):
    check(values, lambda c: T.apply_transform(c, "boolean"), [("false", True), ("", None), (None, None)])
    check(values, lambda c: T.apply_transform(c, "uppercase"), [("aé", "AÉ"), ("", "")])
    check(values, lambda c: T.apply_transform(c, "unheard-of"), [(" a ", " a ")])
    got = values(lambda c, u: T.apply_transform(c, "url", u), [("/p", "https://h.x/q?z"), ("//h/p", "https://h.x/"), ("p", "https://h.x/"), ("", "https://h.x/")])
    assert got == ["https://h.x/p", "https://h/p", "p", ""]
    assert values(lambda t: T.type_setting(t, 0), ["link", "image", "number", "odd"]) == ["href", "src", None, None]
    assert values(lambda t: T.type_setting(t, 1), ["link", "image", "number", "odd"]) == ["url", None, "number", "trim"]
