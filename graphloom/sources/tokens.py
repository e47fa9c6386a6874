"""Tokens of brace languages: names, numbers, strings, marks; comments, templates and regular expressions are seen through."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, number, string, mark
    text: str
    line: int


_NAME = re.compile(r"[A-Za-z_$\u0080-￿][\w$\u0080-￿]*|#[A-Za-z_$][\w$]*")
_NUMBER = re.compile(r"\d[\w.]*")
_MARK = re.compile(r"=>|\.\.\.|\?\.|\?\?=?|&&=?|\|\|=?|===|!==|==|!=|<=|>=|->|::|:=|\+\+|--|[-+*/%&|^]=|.", re.S)
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % ~ ^ < > => && || ?? return typeof case in of do else void delete throw new".split())


def tokens(text: str, language: str) -> list[Token]:
    """Tokens of ``text``; a string's text is its content. A template's parts in braces count as code."""
    out: list[Token] = []
    i, line, n = 0, 1, len(text)
    js = language in ("javascript", "typescript", "tsx")
    templates: list[int] = []  # open braces inside each template part

    def template(at: int) -> int:
        nonlocal line
        while at < n and text[at] != "`":
            if text[at] == "\\":
                at += 1
            elif text.startswith("${", at):
                templates.append(0)
                out.append(Token("mark", "${", line))
                return at + 2
            if at < n and text[at] == "\n":
                line += 1
            at += 1
        return at + 1

    while i < n:
        c = text[i]
        if c == "\n":
            line, i = line + 1, i + 1
        elif c.isspace():
            i += 1
        elif text.startswith("//", i) or (i == 0 and text.startswith("#!")):
            end = text.find("\n", i)
            i = n if end < 0 else end
        elif text.startswith("/*", i):
            depth, at = 1, i + 2
            while at < n and depth:
                if text.startswith("*/", at):
                    depth, at = depth - 1, at + 2
                elif language == "rust" and text.startswith("/*", at):
                    depth, at = depth + 1, at + 2
                else:
                    line += text[at] == "\n"
                    at += 1
            i = at
        elif c == "`" and js:
            out.append(Token("string", "", line))
            i = template(i + 1)
        elif c == "`":  # a raw string
            end = text.find("`", i + 1)
            end = n if end < 0 else end
            out.append(Token("string", text[i + 1 : end], line))
            line += text.count("\n", i, end)
            i = end + 1
        elif language == "rust" and (raw := re.compile(r'b?r(#*)"').match(text, i)):
            end = text.find('"' + raw[1], raw.end())
            end = n if end < 0 else end
            out.append(Token("string", text[raw.end() : end], line))
            line += text.count("\n", i, end)
            i = end + 1 + len(raw[1])
        elif language == "rust" and c == "'" and (life := re.compile(r"'[A-Za-z_]\w*(?!')").match(text, i)):
            i = life.end()
        elif c in "\"'":
            at, start = i + 1, line
            while at < n and text[at] != c and (text[at] != "\n" or language == "rust"):
                at += 1 + (text[at] == "\\")
            line += text.count("\n", i, min(at, n))
            out.append(Token("string", text[i + 1 : at], start))
            i = at + 1
        elif js and c == "/" and (not out or out[-1].text in _BEFORE_REGEX and out[-1].kind != "string") and (rx := re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*").match(text, i)):
            out.append(Token("string", "", line))
            i = rx.end()
        elif name := _NAME.match(text, i):
            out.append(Token("name", name[0], line))
            i = name.end()
        elif c.isdigit():
            number = _NUMBER.match(text, i)
            out.append(Token("number", number[0], line))
            i = number.end()
        else:
            mark = _MARK.match(text, i)[0]
            if templates and mark == "{":
                templates[-1] += 1
            elif templates and mark == "}":
                if templates[-1] == 0:
                    templates.pop()
                    out.append(Token("mark", "}", line))
                    i = template(i + 1)
                    continue
                templates[-1] -= 1
            out.append(Token("mark", mark, line))
            i += len(mark)
    return out


OPEN, CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}"}, {")", "]", "}"}


def partners(found: list[Token]) -> dict[int, int]:
    """Place of the closing mark of each opening one; those never closed end with the file."""
    out, work = {}, []
    for i, t in enumerate(found):
        if t.kind == "mark" and t.text in OPEN:
            work.append(i)
        elif t.kind == "mark" and t.text in CLOSE:
            while work:
                j = work.pop()
                out[j] = i
                if OPEN[found[j].text] == t.text:
                    break
    for j in work:
        out[j] = len(found) - 1
    return out
