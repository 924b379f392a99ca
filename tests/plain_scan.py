"""Reading script text name by name: which names stand for variables, and replacing them.

One pass per text, linear in its length; names are looked up by hash. Strings, comments and the
words of a template are no names; what a template holds in ``${...}`` is code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

SPACE, TEXT, NAME, SIGN = range(4)
_CODE = re.compile(
    r"""([^\S]+|//[^\n]*|/\*.*?\*/)"""
    r"""|("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|([\w$]+)"""
    r"""|(\.\.\.|=>|.)""", re.S)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
#: What stands before a brace that opens an object or a pattern, not a block.
_OBJECT_AFTER = frozenset("= ( , : ? [ & | ${ return const let var import export in of typeof".split())
_METHOD_AFTER = frozenset("{ } ; static async get set".split())


def tokens(code: str) -> Iterator[tuple[int, str]]:
    """(kind, text) of all of `code` in order; the texts joined give it back."""
    at, depth, inside = 0, 0, False  # inside: template text; depth: braces open in the expression
    outer: list[int] = []  # of the templates around
    while at < len(code):
        if inside:
            end = _TEMPLATE.match(code, at).end()
            if code.startswith("${", end):
                yield TEXT, code[at:end]
                yield SIGN, "${"
                outer.append(depth)
                depth, inside, at = 0, False, end + 2
            else:
                yield TEXT, code[at:end + 1]
                inside, at = False, end + 1
            continue
        m = _CODE.match(code, at)
        kind, text, at = m.lastindex - 1, m[0], m.end()
        if kind == SIGN:
            if text == "`":
                kind, inside = TEXT, True
            elif text == "{":
                depth += 1
            elif text == "}":
                if not depth and outer:
                    depth, inside = outer.pop(), True
                else:
                    depth = max(depth - 1, 0)
        yield kind, text


def _roles(words: list[tuple[int, str]]) -> tuple[dict[int, str], dict[int, int]]:
    """Of significant tokens: per name, what the bracket around it opens ("object", "import",
    "export" or ""); per opening bracket, where it closes."""
    within: dict[int, str] = {}
    closes: dict[int, int] = {}
    open_: list[tuple[int, str]] = []
    for i, (kind, text) in enumerate(words):
        if kind == SIGN and text in ("{", "(", "[", "${"):
            before = words[i - 1][1] if i else ""
            role = ""
            if text == "{" and before in _OBJECT_AFTER:
                role = before if before in ("import", "export") else "object"
            open_.append((i, role))
        elif kind == SIGN and text in ("}", ")", "]"):
            if open_:
                closes[open_.pop()[0]] = i
        elif kind == NAME and open_:
            within[i] = open_[-1][1]
    return within, closes


def rename(code: str, names: Mapping[str, str]) -> tuple[str, dict[str, int]]:
    """`code` with its free names replaced, and how often each name was.

    Names after a dot, object keys and method definitions are not free. A name that is short for
    a key and a value keeps its key.
    """
    out = list(tokens(code))
    at = [k for k, (kind, _) in enumerate(out) if kind != SPACE]
    words = [out[k] for k in at]
    within, closes = _roles(words)
    texts = [text for _, text in out]
    counts: dict[str, int] = {}
    for i, (kind, text) in enumerate(words):
        if kind != NAME or text not in names:
            continue
        before = words[i - 1][1] if i else ""
        after = words[i + 1][1] if i + 1 < len(words) else ""
        if before == "." or after == ":" and before in ("{", ","):
            continue
        if after == "(" and before in _METHOD_AFTER:
            end = closes.get(i + 1)
            if end is not None and end + 1 < len(words) and words[end + 1][1] == "{":
                continue
        role = within.get(i, "")
        new = names[text]
        if role and before in ("{", ",") and (after in ("}", ",") or after == "=" and role == "object"):
            if role == "import":
                new = f"{text} as {new}"
            elif role == "export":
                new = f"{new} as {text}"
            else:
                new = f"{text}: {new}"
        texts[at[i]] = new
        counts[text] = counts.get(text, 0) + 1
    return "".join(texts), counts


def rename_all(code: str, names: Mapping[str, str]) -> str:
    """`code` with every name replaced, keys and properties included."""
    return "".join(names.get(text, text) if kind == NAME else text for kind, text in tokens(code))
