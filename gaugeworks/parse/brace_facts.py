"""Functions, imports, exports and tests of Go and TypeScript files, from their tokens.

No grammar is at hand, so facts come from a tokenizer and the nesting of
brackets. What needs types (which package a Go name belongs to) is matched by
package-qualified name instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from gaugeworks.parse.python_facts import SCHEMA

_TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"""
    r"""|(?P<number>0[xX][0-9a-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_$][\w$]*)|(?P<op>=>|&&|\|\||\?\?|\?\.|[^\s\w])""",
    re.DOTALL,
)
# Names of assertion calls in Go tests, by receiver kind.
GO_ASSERTIONS = {"Error", "Errorf", "Fatal", "Fatalf", "Fail", "FailNow"}
TESTIFY = {"Equal", "NotEqual", "True", "False", "Nil", "NotNil", "NoError", "EqualError", "Contains", "NotContains", "Len", "Empty", "NotEmpty", "Panics"}
PAIRS = {"(": ")", "[": "]", "{": "}"}
Fact = tuple[str, str, int, int, int, str]


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    end: int


def tokens(text: str) -> list[Token]:
    """All tokens with their first and last line; comments included."""
    out, line, at = [], 1, 0
    for m in _TOKEN.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        out.append(Token(m.lastgroup or "op", m[0], line, line + m[0].count("\n")))
    return out


def closing(ts: list[Token], at: int) -> int:
    """The place of the bracket that closes the one at ``at``; the last place if none does."""
    stack = []
    for i in range(at, len(ts)):
        t = ts[i].text
        if ts[i].kind != "op":
            continue
        if t in PAIRS:
            stack.append(PAIRS[t])
        elif stack and t == stack[-1]:
            stack.pop()
            if not stack:
                return i
    return len(ts) - 1


def _go_complexity(body: list[Token]) -> int:
    return 1 + sum((t.kind == "name" and t.text in ("if", "for", "case")) or (t.kind == "op" and t.text in ("&&", "||")) for t in body)


def go_facts(text: str) -> Iterator[Fact]:
    """Facts of one Go file; the package's name is the ``package`` fact."""
    full = tokens(text)
    ts = [t for t in full if t.kind != "comment"]
    doc_ends = {t.end for t in full if t.kind == "comment"}
    depth, i = 0, 0
    while i < len(ts):
        t = ts[i]
        following = ts[i + 1] if i + 1 < len(ts) else None
        if depth == 0 and t.text == "package" and following:
            yield "package", following.text, t.line, t.line, 0, ""
            i += 2
        elif depth == 0 and t.text == "import" and following:
            end = closing(ts, i + 1) if following.text == "(" else i + 2
            for s in ts[i + 1 : end + 1]:
                if s.kind == "string":
                    yield "import", s.text[1:-1], s.line, s.line, 0, ""
                elif s.line > t.line and following.text != "(":
                    break
            i = end + 1 if following.text == "(" else i + 2
        elif depth == 0 and t.text == "func" and following:
            at, receiver = i + 1, ""
            if following.text == "(":
                end = closing(ts, i + 1)
                names = [x.text for x in ts[i + 2 : end] if x.kind == "name"]
                receiver, at = (names[1] if len(names) > 1 else names[0] if names else "") + ".", end + 1
            if at + 1 >= len(ts):
                return
            name = ts[at]
            if at + 1 < len(ts) and ts[at + 1].text == "[":
                at = closing(ts, at + 1)
            params = closing(ts, min(at + 1, len(ts) - 1))
            brace = next((k for k in range(params + 1, len(ts)) if ts[k].text == "{"), None)
            if brace is None:
                return
            end = closing(ts, brace)
            body = ts[brace : end + 1]
            yield "function", receiver + name.text, t.line, ts[end].line, _go_complexity(body), ""
            inside = [x.text for x in ts[at + 1 : params]]
            if name.text.startswith("Test") and not receiver and "testing" in inside and "T" in inside and inside.count(",") == 0:
                calls = sum(body[k].text == "." and body[k + 1].text in GO_ASSERTIONS | TESTIFY and k + 2 < len(body) and body[k + 2].text == "(" for k in range(len(body) - 1))
                yield "test", name.text, t.line, ts[end].line, calls, ""
            elif name.text[:1].isupper() and name.text not in ("main", "init"):
                yield "export", name.text, t.line, t.line, int(t.line - 1 in doc_ends), "method" if receiver else "func"
            i = end + 1
        elif depth == 0 and t.text == "type" and following and following.kind == "name":
            if following.text[:1].isupper():
                yield "export", following.text, t.line, t.line, int(t.line - 1 in doc_ends), "type"
            i += 2
        else:
            depth += (t.text in PAIRS) - (t.text in PAIRS.values()) if t.kind == "op" else 0
            i += 1
    for a, b, c in zip(ts, ts[1:], ts[2:], strict=False):
        if a.kind == "name" and b.text == "." and c.kind == "name" and c.text[:1].isupper():
            yield "reference", c.text, c.line, c.line, 0, a.text


def _script_complexity(body: list[Token]) -> int:
    total = 1
    for k, t in enumerate(body):
        if t.kind == "name":
            total += t.text in ("if", "catch", "for", "while", "do", "case") and not (k and body[k - 1].text == ".")
        elif t.kind == "op":
            # A question mark before a closing bracket, colon or comma marks an optional name.
            total += t.text in ("&&", "||", "??") or (t.text == "?" and k + 1 < len(body) and body[k + 1].text not in (":", ")", ",", ";", "]"))
    return total


def script_facts(text: str) -> Iterator[Fact]:
    """Facts of one TypeScript file; functions inside a recorded function are not recorded."""
    full = tokens(text)
    ts = [t for t in full if t.kind != "comment"]
    yield from _script_functions(ts, 0, len(ts), "")
    for k, t in enumerate(ts):
        nxt = ts[k + 1] if k + 1 < len(ts) else None
        if nxt is None:
            break
        if t.text == "import" and t.kind == "name":
            end = next((j for j in range(k + 1, min(len(ts), k + 400)) if ts[j].kind == "string"), k)
            if ts[end].kind == "string":
                yield "import", ts[end].text[1:-1], t.line, t.line, 0, ""
                names = [x.text for x in ts[k + 1 : end] if x.kind == "name" and x.text not in ("from", "as", "type")]
                for n in names:
                    yield "imported_name", n, t.line, t.line, 0, ts[end].text[1:-1]
        elif t.text == "require" and nxt.text == "(" and k + 2 < len(ts) and ts[k + 2].kind == "string":
            yield "import", ts[k + 2].text[1:-1], t.line, t.line, 0, "require"
        elif t.text == "export" and t.kind == "name":
            if nxt.text == "{":
                for x in ts[k + 2 : closing(ts, k + 1)]:
                    if x.kind == "name" and x.text != "as":
                        yield "export", x.text, x.line, x.line, 0, "clause"
            else:
                words = [x.text for x in ts[k + 1 : k + 6]]
                kind = next((w for w in words if w in ("function", "class", "const", "interface", "type", "enum")), None)
                if kind in ("function", "class", "const"):
                    name = words[words.index(kind) + 1] if words.index(kind) + 1 < len(words) else ""
                    if re.match(r"[A-Za-z_$]", name):
                        yield "export", name, t.line, t.line, 0, kind
        elif t.text in ("it", "test") and nxt.text == "(" and k + 2 < len(ts) and ts[k + 2].kind == "string" and not (k and ts[k - 1].text == "."):
            body = ts[k + 1 : closing(ts, k + 1) + 1]
            calls = sum(x.text in ("expect", "assert") and j + 1 < len(body) and body[j + 1].text in ("(", ".") and not (j and body[j - 1].text == ".") for j, x in enumerate(body))
            yield "test", ts[k + 2].text[1:-1], t.line, body[-1].line, calls, ""
        elif t.text == "?.":
            yield "optional_chain", "", t.line, t.line, 1, ""


_NOT_METHODS = {"if", "for", "while", "switch", "catch", "function", "return", "with", "constructor_"}


def _body_after(ts: list[Token], params: int, stop: int) -> int | None:
    """The brace that opens a body after a parameter list, past a return type; null without one."""
    k = params + 1
    while k < stop and ts[k].text not in ("{", ";", "=", "=>", ")", ","):
        k = closing(ts, k) + 1 if ts[k].text in ("(", "[") else k + 1
    return k if k < stop and ts[k].text == "{" else None


def _assigned_name(ts: list[Token], arrow: int, begin: int) -> str | None:
    """The variable or property an arrow function is assigned to: back over its parameters and types to ``=``."""
    k, depth = arrow - 1, 0
    while k > begin:
        t = ts[k].text
        if ts[k].kind == "op" and t in PAIRS.values():
            depth += 1
        elif ts[k].kind == "op" and t in PAIRS:
            depth -= 1
            if depth < 0:
                return None
        elif depth == 0 and ts[k].kind == "op" and t in (";", ",", "=>"):
            return None
        elif depth == 0 and t == "=":
            declared = ts[k - 1]
            colon = next((x for x in range(k - 1, max(begin, k - 12), -1) if ts[x].text == ":"), None)
            named = ts[colon - 1] if colon is not None and ts[colon].line == ts[k].line and ts[colon - 1].kind == "name" else declared
            return named.text if named.kind == "name" else None
        k -= 1
    return None


def _script_functions(ts: list[Token], begin: int, stop: int, owner: str) -> Iterator[Fact]:
    i = begin
    while i < stop:
        t = ts[i]
        name, brace = None, None
        if t.kind == "name" and t.text == "class" and i + 1 < stop:
            head = next((k for k in range(i + 1, stop) if ts[k].text == "{"), None)
            if head is not None:
                end = closing(ts, head)
                yield from _script_functions(ts, head + 1, end, ts[i + 1].text + ".")
                i = end + 1
                continue
        elif t.kind == "name" and t.text == "function":
            at = i + 2 if i + 1 < stop and ts[i + 1].text == "*" else i + 1
            paren = next((k for k in range(at, min(stop, at + 40)) if ts[k].text == "("), None)
            if paren is not None:
                name = ts[at].text if ts[at].kind == "name" else "anonymous"
                brace = _body_after(ts, closing(ts, paren), stop)
        elif owner and t.kind == "name" and t.text not in _NOT_METHODS and i + 1 < stop and ts[i + 1].text == "(":
            name, brace = owner + t.text, _body_after(ts, closing(ts, i + 1), stop)
        elif t.kind == "op" and t.text == "=>" and i + 1 < stop and ts[i + 1].text == "{":
            brace = i + 1
            name = owner + (_assigned_name(ts, i, begin) or "anonymous")
        if name is not None and brace is not None:
            end = closing(ts, brace)
            yield "function", name, t.line, ts[end].line, _script_complexity(ts[brace : end + 1]), ""
            i = end + 1
        else:
            i += 1


def brace_facts(files: DataFrame) -> DataFrame:
    """All facts of Go and TypeScript files (repo_id, rel_path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["repo_id", "file", "kind", "name", "line", "end_line", "value", "extra"]
        for batch in batches:
            rows = []
            for repo, path, content in zip(batch["repo_id"], batch["rel_path"], batch["content"], strict=True):
                read = go_facts if path.endswith(".go") else script_facts if path.endswith((".ts", ".tsx")) else None
                if read:
                    rows += [(repo, path, *f) for f in read(bytes(content or b"").decode("utf-8", "replace"))]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("repo_id", "rel_path", "content").mapInPandas(run, SCHEMA)
