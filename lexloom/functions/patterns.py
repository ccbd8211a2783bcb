"""Named idiom patterns, composed from a few pieces, in Java's and in RE2's spelling.

``NAMED`` holds each pattern with placeholders for the few constructs that the
two engines spell differently: {P} one ASCII punctuation mark, {S} one Unicode
white-space character, {Z} the Chinese blocks.
"""

from __future__ import annotations

import re

_LOW, _UP, _ANY = "[a-z]+", "[A-Z]+", "[A-Za-z]+"
_CAP = "[A-Z]" + _LOW
_NUM = "[0-9]{1,3}"
_DEC = _NUM + r"\.[0-9]"
_OPS = "+ - * / % & | ^ ! ~ && || == != !== < > <= >= << >> >>> ++ -- += -= *= /= %= &= |= ^= => -> . ... ? = := [] ()".split()


def _opt(p: str) -> str:
    return " ?" + p


NAMED: dict[str, str] = {"any-char": "."}
for _name, _p in (("lowercase", _LOW), ("uppercase", _UP), ("capitalized", _CAP)):
    NAMED |= {f"{_name}-word": _p, f"space-{_name}-word": _opt(_p)}
NAMED |= {"word": _ANY, "space-word": _opt(_ANY)}
NAMED["space-english-word"] = _opt(_ANY) + "'[A-Za-z]{1,2}"
NAMED["space-french-word"] = _opt("[A-Za-zÀ-ÿ]+")
NAMED["chinese-word"] = "[{Z}]+"
NAMED["english-contraction"] = "'(?:" + "|".join("re ve s d ll t m".split()) + ")"
NAMED["space-digit"] = " [0-9]"
NAMED |= {"short-number": _NUM, "space-short-number": " " + _NUM}
NAMED |= {"short-decimal-number": _DEC, "space-short-decimal-number": " " + _DEC}
NAMED |= {"word-wrapped-in-brackets": rf"\[{_ANY}\]", "short-number-wrapped-in-brackets": rf"\[{_NUM}\]"}
NAMED |= {"word-wrapped-in-quotes": f"['\"]{_ANY}['\"]", "word-wrapped-in-angle-brackets": f"<{_ANY}>"}
NAMED |= {"punct-word": "{P}" + _ANY, "space-punct-word": " {P}" + _ANY, "word-punct": "[A-Za-z]{P}"}
NAMED["dot-short-number"] = r"\." + _NUM
NAMED["indent"] = r"(?: +)|\t+"
NAMED["newline-indent"] = r"(?:\n +)|(?:\n\t+)"
NAMED["whitespace"] = "{S}+"
NAMED["space-punct-space"] = " ?{P} ?"
for _name, _many in (("repeated", "+"), ("few-repeated", "{1,4}")):
    NAMED |= {f"{_name}-punct": "{P}" + _many, f"{_name}-punct-space": "(?: |{P})" + _many}
NAMED |= {"punct-newline": r"{P}+\n", "repeated-punct-newline-indent": r"{P}+\n[ \t]+"}
NAMED["space-operator-space"] = " ?(?:" + "|".join(re.sub(r"([^\w!<>=%&~:/])", r"\\\1", o) for o in _OPS) + ") ?"

_JAVA = {"{P}": r"\p{Punct}", "{S}": r"\p{IsWhite_Space}", "{Z}": r"㐀-䶿一-鿿"}
_RE2 = {"{P}": "[[:punct:]]", "{S}": r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]", "{Z}": r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"}


def _spelled(pattern: str, words: dict[str, str]) -> str:
    for k, v in words.items():
        pattern = pattern.replace(k, v)
    return pattern


def java(name_or_pattern: str) -> str:
    """A named pattern, or the text itself as a custom one, for Spark's functions. (?d): only \\n ends a line."""
    return "(?d)" + _spelled(NAMED.get(name_or_pattern, name_or_pattern), _JAVA)


def re2(name_or_pattern: str) -> str:
    return _spelled(NAMED.get(name_or_pattern, name_or_pattern), _RE2)


def _body(p: str) -> str:
    return java(p).removeprefix("(?d)")


def allow_regex(patterns: list[str]) -> str:
    """Matches a string that as a whole is one of ``patterns``."""
    return "(?d)" + "|".join(rf"\A(?:{_body(p)})\z" for p in patterns)


def mine_regex(patterns: list[str]) -> str:
    """Finds any of ``patterns``, the first of the list that matches at a place."""
    return "(?d)" + "|".join(f"(?:{_body(p)})" for p in patterns)


def allow_re2(patterns: list[str]) -> str:
    return "|".join(rf"\A(?:{re2(p)})\z" for p in patterns)
