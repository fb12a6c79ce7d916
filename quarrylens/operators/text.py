"""Full-text search: a query language, postings, BM25, snippets and match lines."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.scalars import contains_ci, words
from quarrylens.operators.fusion import merge_lists
from quarrylens.runtime import materialize

#: Weights of the columns of a symbol in the ranking, in the order of the columns.
SYMBOL_WEIGHTS = {
    "name": 1.2, "qualified_name": 0.75, "signature": 10.0, "docstring": 1.0, "file_path": 3.0, "name_tokens": 2.0, "summary": 1.0,
    "inputs": 5.0, "outputs": 1.0, "source": 1.0,
}
K1, B = 1.2, 0.75
MAX_TERMS = 32


@dataclass(frozen=True)
class Term:
    """words in sequence; prefix: the last is a prefix; column: only there."""

    words: tuple[str, ...]
    prefix: bool = False
    column: str | None = None


@dataclass(frozen=True)
class Node:
    """A boolean node: op is and, or, not (left without right) or term."""

    op: str
    parts: tuple["Node", ...] = ()
    term: Term | None = None

    def terms(self) -> list[Term]:
        return [self.term] if self.term else [t for p in self.parts for t in p.terms()]


_TOKEN = re.compile(r'"([^"]*)"(\*?)|([()])|(\w+)\s*:\s*(?=[\w"(])|([^\s()"]+)')


def expand_query(query: str, body: bool = False) -> str:
    """Bare words become prefix words joined by OR (for bodies: whole words joined by AND); other syntax stays.

    :: separates words, a backslash goes, and a word with other punctuation becomes a phrase.
    """
    query = query.replace("::", " ").replace("\\", "")
    if re.search(r'["():*]|\b(?:AND|OR|NOT|NEAR)\b', query):
        return query
    out = []
    for w in query.split()[:MAX_TERMS]:
        safe = re.fullmatch(r"\w+", w)
        out.append((w if body else w + "*") if safe else '"' + w.replace('"', "") + '"')
    return (" " if body else " OR ").join(out)


def parse_query(query: str) -> Node:
    """The boolean tree of a query; words without an operator between them must all match."""
    toks = []
    for m in _TOKEN.finditer(query):
        phrase, star, paren, col, word = m.groups()
        if paren:
            toks.append(paren)
        elif col:
            toks.append(("col", col))
        elif word in ("AND", "OR", "NOT"):
            toks.append(word)
        else:
            text = phrase if phrase is not None else word
            pref = bool(star) if phrase is not None else text.endswith("*")
            parts = tuple(w.lower() for w in re.findall(r"[^\W_]+", text))
            if parts:
                toks.append(("term", parts, pref))
    at = 0

    def peek():
        return toks[at] if at < len(toks) else None

    def primary(column):
        nonlocal at
        t = peek()
        if t is None or t in (")", "AND", "OR", "NOT"):
            raise ValueError(f"query ends or has an operator where a word is due: {query!r}")
        at += 1
        if t == "(":
            inner = either(column)
            if peek() == ")":
                at += 1
            return inner
        if t[0] == "col":
            return primary(t[1])
        return Node("term", term=Term(t[1], t[2], column))

    def both(column):
        nonlocal at
        left = primary(column)
        while (t := peek()) is not None and t not in (")", "OR"):
            op = "and"
            if t in ("AND", "NOT"):
                at += 1
                op = "not" if t == "NOT" else "and"
            left = Node(op, (left, primary(column)))
        return left

    def either(column):
        nonlocal at
        left = both(column)
        while peek() == "OR":
            at += 1
            left = Node("or", (left, both(column)))
        return left

    return either(None)


@dataclass
class TextIndex:
    """Postings (doc, col, term, tf, places), lengths (doc, len) over all columns, and corpus statistics."""

    postings: DataFrame
    lengths: DataFrame
    docs: int
    average: float
    columns: tuple[str, ...] = field(default_factory=tuple)


#: Parts into which the postings of one term are cut by document, so that a term of most documents isn't one task's.
TERM_PARTS = 8


def build_index(df: DataFrame, key: str, columns: tuple[str, ...], stored: bool = False) -> TextIndex:
    """Postings of the columns of each row; null is empty. Statistics count every row.

    Postings are shuffled once, by term, and grouped there. stored: lengths and postings are written, these in order of
    their terms within each file, so that a search reads the row groups of its terms only.
    """
    tok = df.select(F.col(key).alias("doc"), *[words(F.col(c)).alias(f"w{i}") for i, c in enumerate(columns)])
    lengths = tok.select("doc", reduce(lambda a, b: a + b, [F.size(f"w{i}") for i in range(len(columns))]).alias("len"))
    if stored:
        lengths = materialize(lengths, "doc-lengths")
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg")).first()
    entry = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"w{i}").alias("words")) for i, c in enumerate(columns)]))
    spread = tok.select("doc", entry.alias("e")).select("doc", "e.col", F.posexplode("e.words").alias("pos", "term"), F.pmod(F.xxhash64("doc"), F.lit(TERM_PARTS)).alias("part"))
    grouped = spread.repartition("term", "part").groupBy("doc", "col", "term", "part")
    postings = grouped.agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("places")).drop("part")
    if stored:
        postings = materialize(postings.sortWithinPartitions("term"), "postings")
    return TextIndex(postings, lengths, stats["n"], stats["avg"] or 1.0, tuple(columns))


def _hits(index: TextIndex, term: Term, no: int) -> DataFrame:
    """(doc, col, no, tf) of one term: phrase occurrences are counted by their places."""
    p = index.postings if term.column is None else index.postings.where(F.col("col") == term.column)
    w = term.words
    like = lambda word, last: F.col("term").startswith(word) if term.prefix and last else F.col("term") == word
    if len(w) == 1:
        return p.where(like(w[0], True)).groupBy("doc", "col").agg(F.sum("tf").alias("tf")).withColumn("no", F.lit(no))
    shifted = []
    for i, word in enumerate(w):
        shifted.append(p.where(like(word, i == len(w) - 1)).select("doc", "col", F.explode("places").alias("pos")).select("doc", "col", (F.col("pos") - i).alias("pos")).distinct())
    runs = reduce(lambda a, b: a.join(b, ["doc", "col", "pos"]), shifted)
    return runs.groupBy("doc", "col").agg(F.count(F.lit(1)).alias("tf")).withColumn("no", F.lit(no))


def search(index: TextIndex, query: str, weights: dict[str, float] | None = None, body: bool = False) -> DataFrame:
    """(doc, score) of every document that the query matches; a lower score is better.

    BM25 with k1 1.2 and b 0.75 over the weighted occurrences in all columns; the length is that of all columns.
    """
    tree = parse_query(expand_query(query, body))
    terms = list(dict.fromkeys(tree.terms()))
    hits = reduce(DataFrame.unionByName, [_hits(index, t, i) for i, t in enumerate(terms)])
    weight = F.lit(1.0)
    if weights:
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("col")), F.lit(1.0))
    per = materialize(hits.groupBy("doc", "no").agg(F.sum(F.col("tf") * weight).alias("f")).where("f > 0"), "hits")
    counts = {r["no"]: r["n"] for r in per.groupBy("no").agg(F.count(F.lit(1)).alias("n")).collect()}
    wide = per.groupBy("doc").agg(*[F.max(F.when(F.col("no") == i, F.col("f"))).alias(f"f{i}") for i in range(len(terms))])

    def holds(n: Node) -> Column:
        if n.term:
            return F.col(f"f{terms.index(n.term)}").isNotNull()
        a, b = (holds(p) for p in n.parts)
        return a & b if n.op == "and" else a | b if n.op == "or" else a & ~b

    scored = wide.where(holds(tree)).join(index.lengths, "doc")
    import math

    total = F.lit(0.0)
    for i in range(len(terms)):
        n = counts.get(i, 0)
        idf = max(math.log((index.docs - n + 0.5) / (n + 0.5)), 1e-6)
        f = F.col(f"f{i}")
        total = total + F.when(f.isNull(), 0.0).otherwise(F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.lit(float(index.average)))))
    return scored.select("doc", (-total).alias("score"))


def two_style_search(index: TextIndex, query: str, definitions: DataFrame, weights: dict[str, float] | None = None, tokens: str = "name_tokens") -> DataFrame:
    """(doc, place): any of the words in any column, merged with all of the words in the name tokens; definitions (doc)
    come first, then those that both styles found, then by the better score."""
    names = " AND ".join(f"{tokens}:{w}*" for w in query_terms(query))
    found = search(index, query, weights).unionByName(search(index, names, weights))
    best = found.groupBy("doc").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("styles"))
    marked = best.join(definitions.select("doc").distinct().withColumn("d", F.lit(0)), "doc", "left")
    return marked.select("doc", F.struct(F.coalesce("d", F.lit(1)).alias("declared"), (-F.col("styles")).alias("styles"), F.round("score", 6).alias("score"), "doc").alias("place"))


def snippet(text: Column, term: str, width: int = 80) -> Column:
    """The surroundings of a term's first occurrence with the term in <b>; the first 200 characters without one."""
    at = F.locate(term.lower(), F.lower(text))
    start = F.greatest(at - width, F.lit(1))
    piece = F.substring(text, start, F.lit(2 * width + len(term)))
    marked = F.regexp_replace(piece, f"(?i)({re.escape(term)})", "<b>$1</b>")
    return F.when(at > 0, marked).otherwise(F.substring(text, 1, 200))


def query_terms(query: str) -> list[str]:
    """Words of a body query for its match lines: no operators, stars or quotes, at least two letters."""
    out = [w.rstrip("*").lower() for w in re.sub(r'[()"]', " ", query).split() if w not in ("AND", "OR", "NOT")]
    return [w for w in out if len(w) > 1]


def match_lines(df: DataFrame, key: str, text: str, first_line: str, terms: list[str], cap: int = 20) -> DataFrame:
    """(key, lines): the first absolute line numbers whose text holds any term."""
    hit = reduce(lambda a, b: a | b, [F.lower(F.col("t")).contains(t) for t in terms], F.lit(False))
    lines = df.select(key, first_line, F.posexplode(F.split(text, "\n")).alias("p", "t")).where(hit)
    return lines.groupBy(key).agg(F.slice(F.sort_array(F.collect_list((F.col(first_line) + F.col("p")).cast("int"))), 1, cap).alias("lines"))


def name_token_search(symbols: DataFrame, terms: list[str]) -> DataFrame:
    """Symbols whose name tokens hold all but at most one of the terms, with the number of matches."""
    terms = terms[:MAX_TERMS]
    n = reduce(lambda a, b: a + b, [F.when(contains_ci(F.col("name_tokens"), t), 1).otherwise(0) for t in terms])
    return symbols.withColumn("matches", n).where(F.col("matches") >= max(1, len(terms) - 1))


def docstring_search(symbols: DataFrame, term: str) -> DataFrame:
    return symbols.where(contains_ci(F.col("docstring"), term))


def content_search(files: DataFrame, query: str, text: str = "content") -> DataFrame:
    """Files whose text holds all terms, for queries that no index answers; terms are cut at blanks and _."""
    terms = [t for t in re.split(r"[\s_]+", query) if t]
    hit = reduce(lambda a, b: a & b, [contains_ci(F.col(text), t) for t in terms], F.lit(True))
    return files.where(hit).withColumn("snippet", F.substring(text, 1, 200))


def body_page(hits: DataFrame, symbols: DataFrame, terms: list[str]) -> DataFrame:
    """The definitions of hits (id, score) with the lines that match and a snippet around the first term."""
    found = hits.join(symbols.where("is_definition = 1"), "id")
    return found.join(match_lines(found, "id", "source", "line", terms), "id", "left").withColumn("snippet", snippet(F.col("source"), terms[0]))


def search_chain(index: TextIndex, symbols: DataFrame, macros: TextIndex | None, query: str, weights: dict[str, float] | None = None, kind: str | None = None) -> tuple[str, DataFrame]:
    """(step, rows): what the first of these finds: the query within the kind (match), in all kinds (any_kind), name tokens
    (name_tokens), docstrings (docstring), each word by itself with the lists interleaved (words), macros (macro).

    rows are symbols with a score, lower is better; those of the last step are (id, score) of macros.
    """
    hits = search(index, query, weights).withColumnRenamed("doc", "id").join(symbols, "id")
    terms = query_terms(query)
    zero = lambda df: df.withColumn("score", F.lit(0.0))
    steps = [
        ("match", lambda: hits if kind is None else hits.where(F.col("kind") == kind)), ("any_kind", lambda: hits if kind is not None else None),
        ("name_tokens", lambda: name_token_search(symbols, terms).withColumn("score", -F.col("matches").cast("double")).drop("matches") if terms else None),
        ("docstring", lambda: zero(docstring_search(symbols, query))), ("words", lambda: _by_word(index, symbols, terms, weights)),
        ("macro", lambda: search(macros, query).withColumnRenamed("doc", "id") if macros else None),
    ]
    for name, make in steps:
        rows = make()
        if rows is not None and not rows.isEmpty():
            return name, rows
    return "nothing", zero(symbols).limit(0)


def _by_word(index: TextIndex, symbols: DataFrame, terms: list[str], weights: dict[str, float] | None) -> DataFrame | None:
    """The symbols of each word's ranking, interleaved by rank; score is the place."""
    if len(terms) < 2:
        return None
    ranked = [search(index, t, weights).withColumn("term_pos", F.lit(i)) for i, t in enumerate(terms)]
    lists = reduce(DataFrame.unionByName, ranked).withColumnRenamed("doc", "id").join(symbols.select("id", "config_hash"), "id")
    order = Window.partitionBy("config_hash", "term_pos").orderBy("score", "id")
    placed = merge_lists(lists.withColumn("rank", F.row_number().over(order)), ["config_hash"], "id")
    return placed.select("config_hash", "id", F.col("place").cast("double").alias("score")).join(symbols, ["config_hash", "id"])


def macro_references(files: DataFrame, macro: str, text: str = "content") -> DataFrame:
    """(all columns, line_no, macro_line): lines that name a macro outside of comments."""
    plain = F.regexp_replace(F.col(text), r"(?s)/\*.*?\*/", "")
    kept = F.transform(F.split(text, "\n"), lambda line: F.regexp_replace(line, r"//.*$", ""))
    lines = files.where(plain.rlike(rf"\b{re.escape(macro)}\b")).select("*", F.posexplode(kept).alias("p", "macro_line"))
    return lines.where(F.col("macro_line").rlike(rf"\b{re.escape(macro)}\b")).withColumn("line_no", F.col("p") + 1).drop("p")


def index_inconsistencies(base: DataFrame, fts: DataFrame, key: str) -> DataFrame:
    """Keys that only one of table and index has."""
    a = base.select(key).distinct().join(fts.select(key).distinct(), key, "left_anti").withColumn("lacks", F.lit("index"))
    return a.unionByName(fts.select(key).distinct().join(base.select(key).distinct(), key, "left_anti").withColumn("lacks", F.lit("table")))
