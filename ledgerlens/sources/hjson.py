"""Reader of JSON as people write it: comments, keys and texts without quotes, commas left out."""

from __future__ import annotations

import json
import re

_SKIP = re.compile(r"(?:[\s,]+|#[^\n]*|//[^\n]*|/\*.*?\*/)*", re.S)
_KEY = re.compile(r"[^\s,:\[\]{}\"']+")
_QUOTED = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'')
_BLOCK = re.compile(r"'''(.*?)'''", re.S)
_PLAIN = re.compile(r"(true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)[ \t]*(?=[,\]}#\n\r]|//|/\*|$)")


class _Text:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, why: str):
        raise ValueError(f"line {self.text.count(chr(10), 0, self.at) + 1}: {why}")

    def skip(self) -> str:
        """The next character that says something, '' at the end."""
        self.at = _SKIP.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def take(self, rx: re.Pattern):
        m = rx.match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def quoted(self, m: re.Match) -> str:
        raw = m[0]
        if raw[0] == "'":
            raw = '"' + raw[1:-1].replace("\\'", "'").replace('"', '\\"') + '"'
        return json.loads(raw)

    def block(self, m: re.Match, column: int) -> str:
        """Lines between triple quotes, without the blanks up to the column of the first quote."""
        lines = m[1].split("\n")
        kept = [lines[0].lstrip() if len(lines) > 1 else lines[0]] + [re.sub(rf"^[ \t]{{0,{column}}}", "", x) for x in lines[1:]]
        if len(kept) > 1 and not kept[0].strip():
            kept = kept[1:]
        if len(kept) > 1 and not kept[-1].strip():
            kept = kept[:-1]
        return "\n".join(kept)

    def value(self):
        c = self.skip()
        if c == "{":
            self.at += 1
            return self.members("}")
        if c == "[":
            self.at += 1
            return self.items()
        column = self.at - (self.text.rfind("\n", 0, self.at) + 1)
        if m := self.take(_BLOCK):
            return self.block(m, column)
        if m := self.take(_QUOTED):
            return self.quoted(m)
        if m := self.take(_PLAIN):
            return json.loads(m[1])
        if c in ("", "}", "]", ":"):
            self.fail("a value is missing")
        end = self.text.find("\n", self.at)
        end = len(self.text) if end < 0 else end
        out, self.at = self.text[self.at : end].strip(), end
        return out

    def members(self, end: str) -> dict:
        out = {}
        while (c := self.skip()) != end:
            if not c:
                self.fail("a brace is not closed")
            m = self.take(_QUOTED)
            key = self.quoted(m) if m else (self.take(_KEY) or self.fail("a key is missing"))[0]
            if self.skip() != ":":
                self.fail("a colon is missing")
            self.at += 1
            out[key] = self.value()
        self.at += 1
        return out

    def items(self) -> list:
        out = []
        while (c := self.skip()) != "]":
            if not c:
                self.fail("a bracket is not closed")
            out.append(self.value())
        self.at += 1
        return out


def loads(text: str):
    """Braces around the whole may be left out; a text of one plain value is that value."""
    t = _Text(text)
    c = t.skip()
    if c in ("{", "[") or not (_KEY.match(text, t.at) or _QUOTED.match(text, t.at)):
        out = t.value() if c else {}
    else:
        m = t.take(_QUOTED) or t.take(_KEY)
        named = t.skip() == ":"
        t.at = m.start()
        out = t.members("") if named else t.value()
    if t.skip():
        t.fail("something follows the end")
    return out


def load(f):
    raw = f.read()
    return loads(raw.decode("utf-8-sig") if isinstance(raw, bytes) else raw)
