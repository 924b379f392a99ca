"""Script text as tokens, and which of its names stand for variables, as columns.

A token is white space or a comment, a string, a name, or a sign. A template falls into its text,
up to and with each ``${`` or from a ``}``, and the tokens of the code between. Groups repeat
possessively, which the engine does in a loop: neither long texts nor long tokens deepen its stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

NAME = r"[\p{L}\p{N}_$]"
_BLANKS = " \t\n\x0b\f\r\u00a0\ufeff"
_SPACE = rf"(?:[{_BLANKS}]++|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/)++"
_STRING = r""""(?:[^"\\\n]++|\\[\s\S])*+"|'(?:[^'\\\n]++|\\[\s\S])*+'"""
_TEXT = r"(?:[^`\\$]++|\\[\s\S]|\$(?!\{))*+"
#: How deep braces and templates may lie in the code of a template, and templates in templates, for
#: its names to be seen; the text of one that is deeper, or is never closed, is read as code.
DEEPEST, NESTED = 5, 3


def _balanced(deepest: int) -> tuple[str, str]:
    """Patterns of the code of a template up to its closing brace, and of a whole template."""
    atom = rf"""[^{{}}`"'/]++|{_STRING}|{_SPACE}|["'/]"""
    code, template = rf"(?:{atom})*+", f"`{_TEXT}`"
    for _ in range(deepest):
        code, template = (rf"(?:{atom}|\{{{code}\}}|{template})*+",
                          rf"`{_TEXT}(?:\$\{{{code}\}}{_TEXT})*+`")
    return code, template


_CODE, _TEMPLATE = _balanced(DEEPEST)
TOKEN = rf"{_SPACE}|{_STRING}|{_TEMPLATE}|`{_TEXT}(?:\z|\$\{{)|{NAME}++|\.\.\.|=>|[\s\S]"
_PIECE = rf"[`}}]{_TEXT}(?:\$\{{{_CODE}|`)"
_HEAD = rf"^[`}}]{_TEXT}(?:\$\{{|`)"

#: What stands before a brace that opens an object or a pattern, not a block.
_OBJECT_AFTER = ("=", "(", ",", ":", "?", "[", "&", "|", "${", "return", "const", "let", "var", "import", "export", "in", "of", "typeof")
_METHOD_AFTER = ("{", "}", ";", "static", "async", "get", "set")
#: How a name is written when it is replaced: alone, or so that a key, an import or an export keeps its name.
ALONE, KEY, IMPORT, EXPORT = range(4)
_METHOD = 0  # in the codes of `_marked`: a method definition, no name of a variable
#: Marks of tokens in `_marked`, one character each: brackets, hits that are asked about, all others.
_OPENS, _CLOSES, _BOTH, _DEFINES, _SHORT, _OTHER = "oxbds."


def _closed(deepest: int) -> str:
    """A pattern of marks from an opening bracket to its closing one without a hit between."""
    inside = rf"[{_BOTH}{_OTHER}]"
    pattern = f"{_OPENS}{inside}*+{_CLOSES}"
    for _ in range(deepest):
        pattern = f"{_OPENS}(?:{inside}|{pattern})*+{_CLOSES}"
    return pattern


#: Marks in a row that leave the open brackets as they are, or one mark. A bracket behind a definition counts.
_STRETCH = rf"(?:\{_OTHER}|(?<!{_DEFINES}\{_OTHER}?){_closed(8)})++|[\s\S]"
BLOCK = 256
#: Up to so many names are looked up in a list for each token; more are found in the sorted tokens.
FEW = 64
HITS = "array<struct<pos:int,name:string,new:string>>"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _opened(token: Column, level: int) -> Column:
    """A token as an array: templates with code in them become their parts."""
    if not level:
        return F.array(token)

    def part(piece: Column) -> Column:
        return let(F.regexp_extract(piece, _HEAD, 0), lambda head: F.concat(F.array(head), F.flatten(F.transform(
            _all(F.substring(piece, F.length(head) + 1, F.length(piece)), TOKEN), lambda t: _opened(t, level - 1)))))

    parts = let(_all(token, _PIECE), lambda ps: F.when(F.size(ps) == 0, F.array(token)).otherwise(F.flatten(F.transform(ps, part))))
    return F.when(token.startswith("`") & token.contains("${"), parts).otherwise(F.array(token))


def tokens(code: Column) -> Column:
    """All tokens in order; joined they give the text back."""
    flat = _all(code, TOKEN)
    opened = F.flatten(F.transform(flat, lambda t: _opened(t, NESTED)))
    return F.when(code.contains("`") & code.contains("${"), opened).otherwise(flat)


def is_name(token: Column) -> Column:
    return token.rlike("^" + NAME)


def runs(code: Column) -> Column:
    """All runs of letters a name may have, whatever they stand in: each name among `tokens` is one."""
    return _all(code, NAME + "++")


def placed(toks: Column, found: Column) -> Column:
    """Where the names of `found` (array<struct<name, new>>) stand among the tokens: array<struct<pos, name,
    new>> in order of position. Names do not repeat."""
    def hit(pos: Column, x: Column) -> Column:
        return F.struct(pos.alias("pos"), x["name"].alias("name"), x["new"].alias("new"))

    def listed(names: Column) -> Column:
        places = F.array_compact(F.transform(toks, lambda t, i: F.when(F.array_contains(names, t), i)))
        return F.transform(places, lambda i: hit(i, F.get(found, F.array_position(names, F.get(toks, i)).cast("int") - 1)))

    def searched(ordered: Column) -> Column:
        def before(is_before: Callable[[Column], Column]) -> Column:
            """How many of the ordered tokens come before, by halving."""
            def step(acc: Column, _: Column) -> Column:
                return let(F.shiftright(acc["lo"] + acc["hi"], 1), lambda m: F.when(acc["lo"] >= acc["hi"], acc).when(
                    is_before(F.get(ordered, m)["name"]), F.struct((m + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(
                    F.struct(acc["lo"].alias("lo"), m.alias("hi"))))
            return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(ordered)))), F.struct(
                F.lit(0).alias("lo"), F.size(ordered).alias("hi")), step)["lo"]

        def places(x: Column) -> Column:
            return let(before(lambda n: n < x["name"]), lambda lo: F.transform(
                F.slice(ordered, lo + 1, before(lambda n: n <= x["name"]) - lo), lambda y: hit(y["pos"], x)))
        return F.sort_array(F.flatten(F.transform(found, places)))

    names = F.transform(found, lambda x: x["name"])
    ordered = F.sort_array(F.array_compact(F.transform(toks, lambda t, i: F.when(
        is_name(t), F.struct(t.alias("name"), i.alias("pos"))))))
    return F.when(F.size(found) <= FEW, let(names, listed).cast(HITS)).otherwise(let(ordered, searched).cast(HITS))


def _is_space(t: Column) -> Column:
    return F.substring(t, 1, 1).isin(*_BLANKS) | t.startswith("//") | t.startswith("/*")


def _beside(toks: Column, pos: Column, step: int) -> Column:
    """The next token in a direction that is no space; of a template's text, the end that is met."""
    near = let(F.coalesce(F.get(toks, pos + step), F.lit("")), lambda t: F.when(
        _is_space(t), F.coalesce(F.get(toks, pos + 2 * step), F.lit(""))).otherwise(t))
    if step < 0:
        return let(near, lambda t: F.when(t.endswith("${"), "${").otherwise(t))
    return let(near, lambda t: F.when(t.startswith("}"), "}").otherwise(t))


_STACK, _CODES = "array<struct<h:int,role:int>>", "array<int>"


def _mark(t: Column) -> Column:
    return F.when(F.lit("{([").contains(t), _OPENS).when(F.lit("})]").contains(t), _CLOSES).when(
        t.endswith("${"), F.when(t.startswith("}"), _BOTH).otherwise(_OPENS)).when(t.startswith("}"), _CLOSES).otherwise(_OTHER)


def _marked(toks: Column, asked: Column) -> Column:
    """Codes 4 * h + form: hits that a bracket around them gives a form, and method definitions.

    `asked` is array<struct<pos, h, mark, given>> in order of position. Brackets that open and close
    between two such hits are passed over together; the others are gone through with the stack of
    open ones, in blocks, so that a block's codes are appended to a short array.
    """
    def state(acc: Column, **new: Column) -> Column:
        return F.struct(*[new.get(n, acc[n]).alias(n) for n in ("at", "n", "defines", "stack", "codes")])

    def role(t: Column, i: Column) -> Column:
        return F.when(t != "{", 0).otherwise(let(_beside(toks, i, -1), lambda b: F.when(b == "import", IMPORT).when(
            b == "export", EXPORT).when(b.isin(*_OBJECT_AFTER), KEY).otherwise(0)))

    def body(t: Column, i: Column) -> Column:
        """Whether a block follows a closing bracket."""
        return (F.length(t) == 1) & F.coalesce(let(F.get(toks, i + 1), lambda n: F.when(
            _is_space(n), F.get(toks, i + 2)).otherwise(n)) == "{", F.lit(False))

    def one(acc: Column, mark: Column) -> Column:
        stack, at = acc["stack"], acc["at"]
        t, x, top = F.get(toks, at), F.get(asked, acc["n"]), F.get(stack, F.size(stack) - 1)
        closes, opens, hit = mark.isin(_CLOSES, _BOTH), mark.isin(_OPENS, _BOTH), mark.isin(_DEFINES, _SHORT)
        code = F.when(closes, F.when((top["h"] >= 0) & body(t, at), top["h"] * 4 + _METHOD)).when(
            (mark == _SHORT) & (top["role"] > 0) & (~x["given"] | (top["role"] == KEY)), x["h"] * 4 + top["role"])
        closed = F.when(closes & (F.size(stack) > 0), F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(stack)
        pushed = F.array(F.struct(acc["defines"].alias("h"), role(t, at).alias("role")))
        return let(code, lambda c: state(
            acc, at=at + 1, n=F.when(hit, acc["n"] + 1).otherwise(acc["n"]),
            defines=F.when(mark == _DEFINES, x["h"]).otherwise(F.lit(-1)),
            stack=F.when(opens, F.concat(closed, pushed)).otherwise(closed),
            codes=F.when(c.isNull(), acc["codes"]).otherwise(F.concat(acc["codes"], F.array(c)))))

    def step(acc: Column, some: Column) -> Column:
        return F.when(some.rlike(rf"^[{_OPENS}{_CLOSES}{_BOTH}{_DEFINES}{_SHORT}]\z"), one(acc, some)).otherwise(
            state(acc, at=acc["at"] + F.length(some)))

    def block(acc: Column, some: Column) -> Column:
        return let(F.aggregate(some, state(acc, codes=F.array().cast(_CODES)), step), lambda d: state(
            d, codes=F.concat(acc["codes"], F.array(d["codes"]))))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(-1).alias("defines"),
                     F.array().cast(_STACK).alias("stack"), F.array().cast(f"array<{_CODES}>").alias("codes"))
    marks = let(F.transform(toks, _mark), lambda ms: replaced(
        ms, F.transform(asked, lambda x: F.struct(x["pos"].alias("pos"), x["mark"].alias("new")))))

    def blocks(some: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(some) - 1, F.lit(0)), F.lit(BLOCK))
        return F.transform(starts, lambda s: F.slice(some, s + 1, F.lit(BLOCK)))
    return F.flatten(F.aggregate(let(_all(marks, _STRETCH), blocks), start, block)["codes"])


def free_hits(toks: Column, hits: Column) -> Column:
    """Of names to be replaced (array<struct<pos, name, new>>), those that stand for variables, in order
    of position, and what replaces them.

    Names after a dot, object keys and method definitions are not free. A name that is short for
    a key and a value keeps its key. Brackets are matched only where a hit may be one of these two.
    """
    def fact(x: Column, h: Column) -> Column:
        return let(F.struct(_beside(toks, x["pos"], -1).alias("b"), _beside(toks, x["pos"], 1).alias("a")), lambda y: F.struct(
            x["pos"].alias("pos"), h.alias("h"),
            (~((y["b"] == ".") | ((y["a"] == ":") & y["b"].isin("{", ",")))).alias("free"),
            F.when((y["a"] == "(") & y["b"].isin(*_METHOD_AFTER), _DEFINES).when(
                y["b"].isin("{", ",") & y["a"].isin("}", ",", "="), _SHORT).alias("mark"),
            (y["a"] == "=").alias("given")))

    def found(facts: Column) -> Column:
        asked = F.filter(facts, lambda x: x["mark"].isNotNull())
        codes = let(asked, lambda xs: F.when(F.size(xs) > 0, _marked(toks, xs)).otherwise(F.array().cast(_CODES)))
        free = F.transform(F.filter(facts, lambda x: x["free"]), lambda x: x["h"])

        def change(h: Column, form: Column) -> Column:
            return let(F.get(hits, h), lambda x: F.struct(
                x["pos"].alias("pos"), x["name"].alias("name"), _written(x["name"], x["new"], form).alias("new")))

        return let(codes, lambda c: F.sort_array(F.concat(
            F.transform(F.array_except(free, F.transform(c, lambda v: F.shiftright(v, 2))), lambda h: change(h, F.lit(ALONE))).cast(HITS),
            F.transform(F.filter(c, lambda v: v % 4 != _METHOD), lambda v: change(F.shiftright(v, 2), v % 4)).cast(HITS))))

    return let(F.transform(hits, fact), found)


def _written(name: Column, new: Column, form: Column) -> Column:
    return F.when(form == KEY, F.concat(name, F.lit(": "), new)).when(form == IMPORT, F.concat(name, F.lit(" as "), new)).when(
        form == EXPORT, F.concat(new, F.lit(" as "), name)).otherwise(new)


def replaced(toks: Column, changes: Column) -> Column:
    """The text with tokens exchanged: changes is array<struct<pos, name, new>> in order of position."""
    def upto(bound: Column, c: Column, k: Column) -> Column:
        last = F.coalesce(F.get(bound, k - 1)["pos"], F.lit(-1))
        return F.concat(F.array_join(F.slice(toks, last + 2, c["pos"] - last - 1), ""), c["new"])

    def joined(bound: Column) -> Column:
        end = F.coalesce(F.get(bound, F.size(bound) - 1)["pos"], F.lit(-1))
        rest = F.slice(toks, end + 2, F.greatest(F.size(toks) - end - 1, F.lit(0)))
        return F.concat(F.array_join(F.transform(bound, lambda c, k: upto(bound, c, k)), ""), F.array_join(rest, ""))
    return let(changes, joined)
