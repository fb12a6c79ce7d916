"""Functions paired with their documentation.

A source is lexed once by a state machine that knows comments, strings and preprocessor lines, so that braces inside any
of them don't count. Braces that open no function (a namespace, a class, a language block) are entered, so every function
of a file is found; a function is a parameter list followed by a closed brace group. Its documentation is the comments
that touch it: they end on the line above the declaration or on its own, without a blank line between them. Documentation
is real if words remain after comment marks, tags, decoration, placeholders, pointers, licence and author notes and the
words of the declaration itself are taken away.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FUNCTION_KINDS = ("function", "method", "constructor", "destructor")

#: Lexemes; anything between them is plain code.
_LEX = re.compile(
    r"""(?P<block>/\*.*?(?:\*/|\Z))|(?P<line>//[^\n]*(?:\\\r?\n[^\n]*)*)|(?P<pre>^[ \t]*\#[^\n]*(?:(?<=\\)\n[^\n]*|(?<=\\\r)\n[^\n]*)*)"""
    r"""|(?P<raw>R"(?P<d>[^()\\\s]{0,16})\(.*?\)(?P=d)")"""
    r"""|(?P<str>"(?:\\.|[^"\\\n])*"?)|(?P<chr>(?<![0-9a-fA-F])'(?:\\.|[^'\\\n])*'?)|(?P<mark>[{}()\[\];,]|::?|[=!<>]?=+)""",
    re.S | re.M,
)
_LAST_WORD = re.compile(r"(\w+)\s*$")
#: Words that open a section of a class, and words whose parentheses are no parameter list.
_ACCESS = frozenset(("public", "private", "protected", "signals"))
_NO_CALL = frozenset("__attribute__ __declspec alignas decltype __asm__ asm noexcept throw requires".split())
_MARKS = re.compile(r"^\s*(?:/\*+[!<]*<?|//[/!]*<?|\*+(?!/))|\*+/\s*$|^\s*\*+/", re.M)
_TAG = re.compile(r"[@\\](?:param(?:\[[^\]]*\])?\s+\w+|t?param\b|retval\s+\w+|(?:fn|def|var|class|struct|file|name|typedef)\b[^\n]*|(?!todo|author|date|version|copyright|license|see|sa|since)[a-zA-Z]+\b)", re.I)
_PIECE = re.compile(r"(?<=[.!?;。])\s+|\n")
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")

#: Words that mark a sentence as a placeholder, a pointer elsewhere, or a licence or author note.
_EMPTY_TALK = re.compile(
    r"""(?ix) ^\W* (?:
      (?:todo|fixme|xxx+|tbd|tbc|hack)\b .*
    | @?\\?todo\b .*
    | (?:n/?a|n\.\s?a\.?|none|null|nil|unknown|undocumented|placeholder|dummy|stub|empty|nothing|keine|aucune|ninguna|ninguno)\W*
    | (?:(?:insert|add|write|put|enter|place|provide|fill\s+in|missing|no|brief|short|long|detailed|full|function|method|your|a|the|some|proper)\s+)*
        (?:description|comment|comments|documentation|docs?|doc\s?string|summary|text|beschreibung|kommentar|descripci[oó]n|comentario|documentaci[oó]n|commentaire)
        (?:\s+(?:here|goes|needed|missing|required|follows|to\s+be\s+(?:added|written|done)|pending|folgt|fehlt|suit|manquante?|pendiente|hier|ici|aqu[ií]|below|later))*\W*
    | (?:describe|document|explain|comment)\s+(?:me|this|it|here|function|method)?\W*
    | (?:auto|automatically|machine)[\s-]*generated\b .*
    | generated\s+(?:by|from|automatically|stub)\b .*
    | (?:not\s+(?:yet\s+)?documented|to\s+be\s+(?:documented|described|done|written|completed|defined))\W*
    | (?:noch\s+)?(?:zu\s+(?:dokumentieren|erledigen)|nicht\s+dokumentiert|fehlt(?:\s+noch)?)\W*
    | (?:à|a)\s+(?:documenter|compl[eé]ter|faire|d[eé]crire)\W*
    | (?:por\s+|a\s+|sin\s+)?(?:documentar|completar|hacer)\W*
    | \{?@?inherit-?doc\}?\W* | [@\\]copy(?:doc|brief|details)\b .*
    | [@\\]?(?:see|sa|siehe|voir|ver|vea|v[eé]ase|cf\.?|refer\s+to|documented\s+(?:in|at|elsewhere)|described\s+(?:in|at|elsewhere)|same\s+as)\b\W* (?:[^\s]+\s*){0,8}
    | copyright\b.* | .*\bcopyright\s*(?:\(c\)|©|\d{4}).* | ©.* | .*\ball\s+rights\s+reserved\b.* | .*\bspdx-\S+.* | .*\blicen[cs]ed?\s+(?:under|to)\b.*
    | .*\b(?:mit|bsd|apache|gpl|lgpl|mpl)[\s-]*(?:v?\d[\d.]*)?\s+licen[cs]e\b.* | .*\bredistribution\s+and\s+use\b.*
    | .*\bpermission\s+is\s+hereby\s+granted\b.* | .*\bwithout\s+warrant(?:y|ies)\b.*
    | [@\\]?(?:authors?|autor(?:en|es)?|auteurs?|maintainers?|owner|date|version|since|history)\s*[:=] .*
    | (?:created|written|modified|changed|edited|maintained|erstellt|geändert|creado|cr[eé][eé])\s+(?:by|on|von|am|por|par)\b .{0,60}
    | [@\\](?:author|date|version|copyright|license|since)\b .*
    ) $"""
)
#: Words that say nothing in a sentence made of the declaration's own words.
_FILLER = frozenset(
    "a an the this that of for to in is it its and or with from by function functions func method methods constructor "
    "destructor ctor dtor procedure routine class struct member operator implementation definition declaration default "
    "die der das funktion methode la el le une un función método fonction méthode de des du".split()
)


class Function(NamedTuple):
    """The comment that touches a function, its declaration, and its body with braces."""

    comment: str
    declaration: str
    body: str


#: (kind, start, end); kind is block, line, pre, code, or the mark itself.
_Lexeme = tuple[str, int, int]


def _lexemes(source: str) -> list[_Lexeme]:
    out, at = [], 0
    for m in _LEX.finditer(source):
        start, end = m.span()
        if start > at and (gap := source[at:start]) and not gap.isspace():
            out.append(("code", at + len(gap) - len(gap.lstrip()), start))
        kind = m.lastgroup
        out.append((source[start:end] if kind == "mark" else kind if kind in ("block", "line", "pre") else "code", start, end))
        at = end
    if (rest := source[at:]).strip():
        out.append(("code", at + len(rest) - len(rest.lstrip()), len(source)))
    return out


def _partners(lexemes: list[_Lexeme]) -> dict[int, int]:
    """The closing brace of each opening one."""
    held, found = [], {}
    for i, (kind, _, _) in enumerate(lexemes):
        if kind == "{":
            held.append(i)
        elif kind == "}" and held:
            found[held.pop()] = i
    return found


def _touching(source: str, comments: list[_Lexeme], start: int) -> str:
    """The last comments ahead of a declaration that no blank line cuts off from it."""
    kept: list[str] = []
    for c in reversed(comments):
        if source.count("\n", c[2], start) > 1:
            break
        kept.append(source[c[1] : c[2]])
        start = c[1]
    return "\n".join(reversed(kept))


def _word_before(source: str, at: int) -> str:
    """The word that ends there, blanks aside."""
    m = _LAST_WORD.search(source, max(0, at - 200), at)
    return m.group(1) if m else ""


def functions(source: str) -> Iterator[Function]:
    """The functions of a source in order, those inside of namespaces, classes and language blocks too.

    A body needs a parameter list before it. Braces in comments, strings, preprocessor lines, parentheses and values after =
    open none, nor do those of member initialisers a{1}: a comma or another group follows them. A function that isn't
    closed is none; what is inside a body is not looked at.
    """
    lexemes = _lexemes(source)
    partner = _partners(lexemes)
    comments: list[_Lexeme] = []
    start = opened = None
    called = valued = colon = False
    inner = i = 0

    def following(j: int) -> str:
        """The next lexeme that is no comment: its mark or its text."""
        while (j := j + 1) < len(lexemes):
            if lexemes[j][0] not in ("block", "line", "pre"):
                return source[lexemes[j][1] : lexemes[j][2]].strip()
        return ""

    while i < len(lexemes):
        x = lexemes[i]
        kind, begin, end = x
        i += 1
        if kind in ("block", "line"):
            if start is None and not (i > 1 and lexemes[i - 2][0] not in ("block", "line") and "\n" not in source[lexemes[i - 2][2] : begin]):
                comments.append(x)  # one that shares its line with code before it speaks of that code
            continue
        if kind == "pre":
            if start is None:
                comments = []
            continue
        if kind not in (";", "{", "}") and start is None:
            start = begin
        if kind in ("(", "["):
            if not inner and kind == "(" and _word_before(source, begin) not in _NO_CALL:
                called = True
            inner += 1
        elif kind in (")", "]"):
            inner = max(0, inner - 1)
        elif kind == "{" and inner:
            if i - 1 not in partner:
                return
            i = partner[i - 1] + 1
        elif kind == "{" and (called or valued):
            close = partner.get(i - 1)
            if close is None:
                return
            i = close + 1
            opened = begin if opened is None else opened
            after = following(close)
            if called and not valued and after != "catch" and not (colon and after in (",", "{")):
                yield Function(_touching(source, comments, start), source[start:opened].strip(), source[opened : lexemes[close][2]])
                comments, start, opened, called, colon = [], None, None, False, False
            elif after != "catch":
                opened = None
        elif not inner and (kind in (";", "{", "}") or kind == ":" and source[start : begin].split()[0] in _ACCESS):
            comments, start, opened, called, valued, colon = [], None, None, False, False, False
        elif kind == ":" and not inner:
            colon |= called
        elif kind == "=" and not inner and _word_before(source, begin) != "operator":
            valued |= called or following(i - 1) == "{"


def _named(found: list[Function], name) -> Function | None:
    """The function of that name, else the first."""
    tail = name.rsplit("::", 1)[-1] if isinstance(name, str) else ""
    if not found or len(found) == 1 or not tail:
        return found[0] if found else None
    named = re.compile(rf"(?<!\w){re.escape(tail)}\s*\(")
    return next((f for f in found if named.search(f.declaration)), found[0])


def _parts(text: str) -> set[str]:
    words = set()
    for w in _WORD.findall(text):
        words.add(w.lower())
        words.update(p.lower() for p in _CAMEL.findall(w))
    return words


#: Endings that make another form of a word.
_ENDINGS = frozenset("s es e ed d ing er ers or ors en n ies ied y".split())


def _inflected(a: str, b: str) -> bool:
    """Whether two words are forms of one: they differ in a short ending only, the last letter before it doubled or not."""
    same = 0
    for x, y in zip(a, b):
        if x != y:
            break
        same += 1
    if same < 3:
        return False
    rest = [w[same + (1 if len(w) > same and w[same] == w[same - 1] else 0) :] for w in (a, b)]
    return all(not r or r in _ENDINGS for r in rest)


def describe(comment: str | None, own: str) -> str:
    """The comment as plain text, or '' if it says nothing beyond the declaration's own words."""
    if not comment or not comment.strip():
        return ""
    plain = _MARKS.sub(" ", comment)
    names = _parts(own)
    stems: dict[str, list[str]] = {}
    for n in names:
        if len(n) >= 3:
            stems.setdefault(n[:3], []).append(n)
    known = lambda p: p in names or p in _FILLER or any(_inflected(p, s) for s in stems.get(p[:3], ()))
    kept, news = [], False
    for piece in _PIECE.split(plain):
        piece = re.sub(r"^[\W_]*$", "", piece.strip())
        if not piece or _EMPTY_TALK.match(piece):
            continue
        told = _TAG.sub(" ", piece).strip(" \t\r*-:#=~_")
        if not told or _EMPTY_TALK.match(told):
            continue
        news = news or any(not known(w.lower()) and not all(known(p.lower()) for p in _CAMEL.findall(w)) for w in _WORD.findall(told))
        kept.append(told)
    return " ".join(" ".join(kept).split()) if news else ""


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            f = _named(list(functions(row.source)), row.name)
            if f is None:
                continue
            own = " ".join(x for x in (row.name, row.qualified_name, row.signature, f.declaration) if isinstance(x, str))
            text = describe(row.docstring, own) or describe(f.comment, own)
            if text:
                out.append((row.symbol_id, row.name, f.declaration, text, f"{f.declaration} {f.body}"))
        yield pd.DataFrame(out, columns=["symbol_id", "name", "declaration", "description", "code"])


def _file_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for key, source in zip(batch["key"], batch["source"]):
            for i, f in enumerate(functions(source)):
                if text := describe(f.comment, f.declaration):
                    out.append((key, i, f.declaration, text, f"{f.declaration} {f.body}"))
        yield pd.DataFrame(out, columns=["key", "place", "declaration", "description", "code"])


def file_pairs(files: DataFrame, key: str, source: str) -> DataFrame:
    """(key, place, declaration, description, code): the documented functions of whole source files, numbered by place.

    Null and empty sources give none; a file delivered twice is read twice; further columns are ignored.
    """
    chosen = files.select(F.col(key).alias("key"), F.col(source).alias("source")).where("source like '%{%'")
    kind = chosen.schema["key"].dataType.simpleString()
    return chosen.mapInPandas(_file_pairs, f"key {kind}, place int, declaration string, description string, code string").withColumnRenamed("key", key)


def documented_functions(texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, name, declaration, description, code) of each function with a body and real documentation.

    texts has symbol_id, name, qualified_name, signature, docstring and source; symbols has id and kind. A row's function is
    the one of its name in the source, else the first. The docstring comes first, the comment that touches the
    function is taken if the docstring says nothing. Null or empty sources, ids
    without a function kind and null ids give no row; a text row delivered twice gives one row. Texts of any length are
    read whole. Further columns are ignored.
    """
    texts = texts.select("symbol_id", "name", "qualified_name", "signature", "docstring", "source").where(
        "symbol_id is not null and source like '%{%'"
    )
    schema = "symbol_id long, name string, declaration string, description string, code string"
    ids = symbols.where(F.col("kind").isin(*FUNCTION_KINDS)).select(F.col("id").alias("symbol_id")).distinct()
    return texts.mapInPandas(_pairs, schema).join(ids, "symbol_id", "left_semi")
