"""Patterns of filters: linear-time regular expressions, written anew for Java's engine and for Python's.

The accepted language has no look-around, back-references, atomic groups or possessive quantifiers; `$` is the end of the text
unless (?m) is set, only a newline ends a line, POSIX classes stand inside brackets, and folding of case follows Unicode.
"""

from __future__ import annotations

import re

_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7f", "blank": r"\t ", "cntrl": r"\x00-\x1f\x7f", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0b\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_CLASS = {"d": "0-9", "s": r"\t\n\f\r ", "w": "0-9A-Za-z_"}
_CONTROL = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}
_MOST_REPEATS = 1000


class BadPattern(ValueError):
    pass


class _Writer:
    def __init__(self, pattern: str, java: bool) -> None:
        self.p, self.i, self.java = pattern, 0, java

    # Pieces of the output

    def char(self, code: int) -> str:
        c = chr(code)
        if c.isascii() and c.isalnum() or code > 127:
            return c
        return f"\\x{code:02x}"

    def end_of_text(self) -> str:
        return r"\z" if self.java else r"\Z"

    # Parsing

    def peek(self, text: str) -> bool:
        return self.p.startswith(text, self.i)

    def all(self, flags: str) -> str:
        out = self.alternatives(flags)
        if self.i < len(self.p):
            raise BadPattern("unexpected )")
        return out

    def alternatives(self, flags: str) -> str:
        """Up to the end of a group. Flags set in the middle hold to the group's end, so what follows becomes a group."""
        out, tail, last = [], 0, False  # last: whether something can be repeated
        while self.i < len(self.p) and not self.peek(")"):
            if self.peek("|"):
                self.i, last = self.i + 1, False
                out.append("|")
            elif self.peek("(?") and (m := re.compile(r"\(\?([imsU]*)(-[imsU]+)?\)").match(self.p, self.i)):
                self.i, flags, last = m.end(), self.changed(flags, m), False
                # Alternatives before the flags keep their own: the new group starts in the last of them.
                rest = self.alternatives(flags)
                out.append(f"(?:{rest})")
                tail += 1
            elif m := re.compile(r"[*+?]|\{(\d+)(?:(,)(\d*))?\}").match(self.p, self.i):
                if not last:
                    raise BadPattern(f"nothing to repeat before {m[0]}")
                if m[1] and (int(m[1]) > _MOST_REPEATS or m[3] and (int(m[3]) > _MOST_REPEATS or int(m[3]) < int(m[1]))):
                    raise BadPattern(f"a bad repeat count in {m[0]}")
                self.i, last = m.end(), False
                out.append(m[0])
                if self.peek("?"):
                    self.i += 1
                    out.append("?")
                if re.compile(r"[*+?]|\{\d+(?:,\d*)?\}").match(self.p, self.i):
                    raise BadPattern("repeats of repeats")
            else:
                out.append(self.one(flags))
                last = True
        return "".join(out)

    @staticmethod
    def changed(flags: str, m: re.Match) -> str:
        off = set(m[2] or "")
        return "".join(sorted((set(flags) | set(m[1])) - off))

    def one(self, flags: str) -> str:
        c = self.p[self.i]
        if c == "(":
            return self.group(flags)
        if c == "[":
            return self.fold(self.brackets(), flags)
        self.i += 1
        if c == ".":
            return "(?s:.)" if "s" in flags else r"[^\n]"
        if c == "^":
            return r"(?:(?<![\s\S])|(?<=\n))" if "m" in flags else r"\A"
        if c == "$":
            return rf"(?:{self.end_of_text()}|(?=\n))" if "m" in flags else self.end_of_text()
        if c == "\\":
            return self.escape(flags)
        return self.fold(self.char(ord(c)), flags)

    def fold(self, piece: str, flags: str) -> str:
        if "i" not in flags:
            return piece
        return f"(?iu:{piece})" if self.java else f"(?i:{piece})"

    def group(self, flags: str) -> str:
        m = re.compile(r"\((?:\?(?:P?<([A-Za-z0-9_]+)>|([imsU]*)(-[imsU]+)?:))?").match(self.p, self.i)
        self.i = m.end()
        if self.peek("?"):
            raise BadPattern(f"{self.p[m.start() : self.i + 2]} is not supported")
        inner = "".join(sorted((set(flags) | set(m[2] or "")) - set(m[3] or "")))
        out = self.alternatives(inner)
        if not self.peek(")"):
            raise BadPattern("a group without its end")
        self.i += 1
        return f"(?:{out})"

    def escape(self, flags: str) -> str:
        if self.i >= len(self.p):
            raise BadPattern("a backslash at the end")
        c = self.p[self.i]
        if c == "Q":
            end = self.p.find(r"\E", self.i)
            text = self.p[self.i + 1 : end if end >= 0 else len(self.p)]
            self.i = end + 2 if end >= 0 else len(self.p)
            return self.fold("(?:" + "".join(self.char(ord(x)) for x in text) + ")", flags)
        if c in "AbBz":
            self.i += 1
            if c == "A":
                return r"\A"
            if c == "z":
                return self.end_of_text()
            word = "[0-9A-Za-z_]"
            at = rf"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
            return at if c == "b" else rf"(?!{at})"
        if c.lower() in _CLASS:
            self.i += 1
            return f"[{'^' if c.isupper() else ''}{_CLASS[c.lower()]}]"
        if c in "pP":
            return self.fold(self.property(), flags)
        return self.fold(self.char(self.code()), flags)

    def code(self) -> int:
        """The character of an escape, after the backslash."""
        if m := re.compile(r"x([0-9A-Fa-f]{2})|x\{([0-9A-Fa-f]{1,6})\}").match(self.p, self.i):
            self.i = m.end()
            code = int(m[1] or m[2], 16)
            if code > 0x10FFFF:
                raise BadPattern(f"no character {m[0]}")
            return code
        if m := re.compile(r"0[0-7]{0,2}|[1-7][0-7]{1,2}").match(self.p, self.i):
            self.i = m.end()
            return int(m[0], 8)
        c = self.p[self.i]
        self.i += 1
        if c in _CONTROL:
            return _CONTROL[c]
        if c.isascii() and not c.isalnum():
            return ord(c)
        raise BadPattern(f"the escape \\{c} is not supported")

    def property(self) -> str:
        m = re.compile(r"([pP])(?:([A-Z])|\{(\^?)([A-Za-z_]+)\})").match(self.p, self.i)
        if not m:
            raise BadPattern("a bad Unicode class")
        self.i = m.end()
        name = m[2] or m[4]
        if not m[2] and name == "Any":
            return r"[\s\S]" if (m[1] == "P") == bool(m[3]) else r"[^\s\S]"
        wanted = "p" if (m[1] == "P") == bool(m[3]) else "P"
        if len(name) > 2:  # a script; one or two letters name a category
            name = f"Is{name}" if self.java else f"Script={name}"
        return rf"\{wanted}{{{name}}}"

    def brackets(self) -> str:
        self.i += 1
        out, first = ["["], True
        if self.peek("^"):
            self.i += 1
            out.append("^")
        while True:
            if self.i >= len(self.p):
                raise BadPattern("brackets without their end")
            if self.peek("]") and not first:
                self.i += 1
                return "".join([*out, "]"])
            first = False
            if m := re.compile(r"\[:(\^?)(\w+):\]").match(self.p, self.i):
                if m[2] not in _POSIX:
                    raise BadPattern(f"no class {m[0]}")
                self.i = m.end()
                out.append(self.negated(_POSIX[m[2]]) if m[1] else _POSIX[m[2]])
                continue
            if self.peek("\\") and self.i + 1 < len(self.p) and self.p[self.i + 1].lower() in "dswp":
                self.i += 1
                c = self.p[self.i]
                if c in "pP":
                    out.append(self.property())
                else:
                    self.i += 1
                    out.append(self.negated(_CLASS[c.lower()]) if c.isupper() else _CLASS[c])
                continue
            low = self.member()
            if self.peek("-") and not self.peek("-]"):
                self.i += 1
                high = self.member()
                if high < low:
                    raise BadPattern("a bad range")
                out.append(f"{self.char(low)}-{self.char(high)}")
            else:
                out.append(self.char(low))

    def member(self) -> int:
        if self.i >= len(self.p):
            raise BadPattern("brackets without their end")
        c = self.p[self.i]
        self.i += 1
        return self.code() if c == "\\" and self.i < len(self.p) else ord(c)

    def negated(self, inside: str) -> str:
        """What is not in a class of ASCII ranges, as ranges."""
        taken = [False] * 128
        for c in range(128):
            taken[c] = bool(re.fullmatch(f"[{inside}]", chr(c)))
        free = [c for c in range(128) if not taken[c]]
        return "".join(self.char(c) for c in free) + "\x80-\U0010ffff"


def for_java(pattern: str, flags: str = "") -> str:
    return _Writer(pattern, True).all(flags)


def for_python(pattern: str, flags: str = "") -> str:
    return _Writer(pattern, False).all(flags)


def compiled(pattern: str, flags: str = "") -> re.Pattern:
    """For Python's own engine, or for the one with Unicode classes where the pattern has any."""
    text = for_python(pattern, flags)
    if re.search(r"\\[pP]\{", text):
        import regex

        return regex.compile(text)
    return re.compile(text)
