"""Queries of full-text, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrylens.functions.scalars import file_hash
from quarrylens.operators import fusion as V
from quarrylens.operators import stats as A
from quarrylens.operators import text as T
from quarrylens.queries.common import SYM, stored, sym
from quarrylens.runtime import load, materialize
from quarrylens.sources.sinks import upsert_vectors

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _index(spark, sf, name, make, key, columns):
    """A stored index of the columns of a table."""
    return stored(spark, sf, f"index {name} {columns}", lambda: T.build_index(make(), key, tuple(columns), stored=True))


def _symbol_index(spark, sf, columns=None):
    return _index(spark, sf, "symbols_fts", lambda: _texts(spark, sf), "symbol_id", columns or _COLS)


def _texts(spark, sf):
    """One row per symbol id; of rows delivered twice the smallest value of each column."""
    t = load(spark, sf, "symbols_fts")
    return t.groupBy("symbol_id").agg(*[F.min(c).alias(c) for c in T.SYMBOL_WEIGHTS])


_COLS = list(T.SYMBOL_WEIGHTS)
_TEXTS = "t AS (SELECT symbol_id, " + ", ".join(f"min({c}) AS {c}" for c in _COLS) + " FROM symbols_fts GROUP BY 1)"


def _bm25(terms: list[str], weights: dict[str, float] | None, columns: list[str], source: str, key: str, need_all: bool = False) -> str:
    """Ranking of words (word*: prefix) joined by OR or AND."""
    tok = " UNION ALL ".join(f"SELECT {key} AS doc, {weights[c] if weights else 1.0}::DOUBLE AS w, unnest(regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {source}" for c in columns)
    hit = lambda t: f"starts_with(term, '{t[:-1]}')" if t.endswith("*") else f"term = '{t}'"
    per = " UNION ALL ".join(f"SELECT doc, {i} AS no, sum(w) AS f FROM tok WHERE {hit(t)} GROUP BY doc" for i, t in enumerate(terms))
    having = f"HAVING count(*) = {len(terms)}" if need_all else ""
    return f"""tok AS ({tok}), ln AS (SELECT d.{key} AS doc, coalesce(n, 0) AS len FROM {source} d LEFT JOIN (SELECT doc, count(*) AS n FROM tok GROUP BY 1) x ON x.doc = d.{key}),
st AS (SELECT count(*) AS n, avg(len) AS a FROM ln), per AS ({per}), df AS (SELECT no, count(*) AS n FROM per GROUP BY 1),
ranked AS (SELECT p.doc, -sum(greatest(ln((st.n - df.n + 0.5) / (df.n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * ln.len / st.a))) AS score
FROM per p JOIN df ON df.no = p.no JOIN ln ON ln.doc = p.doc, st GROUP BY p.doc {having})"""


@query(f"WITH {_TEXTS}, {_bm25(['spi*', 'halt*', 'cell*'], T.SYMBOL_WEIGHTS, _COLS, 't', 'symbol_id')} SELECT doc AS symbol_id, round(score, 6) AS score FROM ranked ORDER BY round(score, 6), doc LIMIT 50")
def bm25_topk(spark, sf):
    index = _symbol_index(spark, sf)
    hits = T.search(index, "spi::halt cell", T.SYMBOL_WEIGHTS)
    return hits.select(F.col("doc").alias("symbol_id"), F.round("score", 6).alias("score")).orderBy("score", "symbol_id").limit(50)


def _two_styles() -> str:
    first = _bm25(["spi*", "halt*"], T.SYMBOL_WEIGHTS, _COLS, "t", "symbol_id")
    names = "tok2 AS (SELECT symbol_id AS doc, unnest(regexp_extract_all(strip_accents(lower(coalesce(name_tokens, ''))), '[\\p{L}\\p{N}]+')) AS term FROM t)"
    per = " UNION ALL ".join(f"SELECT doc, {i} AS no, sum({T.SYMBOL_WEIGHTS['name_tokens']}::DOUBLE) AS f FROM tok2 WHERE starts_with(term, '{w}') GROUP BY doc" for i, w in enumerate(("spi", "halt")))
    return f"""WITH {_TEXTS}, {first}, {names}, per2 AS ({per}), df2 AS (SELECT no, count(*) AS n FROM per2 GROUP BY 1),
ranked2 AS (SELECT p.doc, -sum(greatest(ln((st.n - df2.n + 0.5) / (df2.n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * ln.len / st.a))) AS score
FROM per2 p JOIN df2 ON df2.no = p.no JOIN ln ON ln.doc = p.doc, st GROUP BY p.doc HAVING count(*) = 2),
b AS (SELECT doc, min(score) AS score, count(*) AS styles FROM (SELECT * FROM ranked UNION ALL SELECT * FROM ranked2) GROUP BY 1)
SELECT doc AS symbol_id, CASE WHEN doc IN (SELECT id FROM symbols WHERE is_definition = 1) THEN 0 ELSE 1 END AS declared, round(score, 6) AS score FROM b ORDER BY declared, styles DESC, round(score, 6), doc LIMIT 100"""


@query(_two_styles())
def two_style_search(spark, sf):
    index = _symbol_index(spark, sf)
    defs = load(spark, sf, "symbols").where("is_definition = 1").select(F.col("id").alias("doc"))
    hits = T.two_style_search(index, "spi halt", defs, T.SYMBOL_WEIGHTS)
    return hits.orderBy("place").limit(100).select(F.col("doc").alias("symbol_id"), F.col("place.declared").alias("declared"), F.col("place.score").alias("score"))


@query(f"WITH {_TEXTS}, {_bm25(['trace', 'emit', 'state'], None, ['source'], 't', 'symbol_id', True)} SELECT doc AS symbol_id, round(score, 6) AS score FROM ranked")
def body_search(spark, sf):
    index = _symbol_index(spark, sf, ["source"])
    return T.search(index, "trace emit state", body=True).select(F.col("doc").alias("symbol_id"), F.round("score", 6).alias("score"))


@query(f"WITH {_TEXTS}, {_bm25(['spi*', 'halt*'], None, _COLS, 't', 'symbol_id')} SELECT count(*) AS matches FROM ranked")
def fts_match_count(spark, sf):
    index = _symbol_index(spark, sf)
    return T.search(index, "spi halt").agg(F.count(F.lit(1)).alias("matches"))


@query("""WITH d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id FROM d WHERE contains('|' || array_to_string(w, '|') || '|', '|dead|code|') AND NOT list_contains(w, 'cell')""")
def phrase_search(spark, sf):
    index = _index(spark, sf, "documents", lambda: load(spark, sf, "documents").where("text is not null"), "doc_id", ["text"])
    return T.search(index, '"dead code" NOT cell').select(F.col("doc").alias("doc_id"))


@query(f"""WITH {SYM} SELECT config_hash, usr, (contains(lower(name_tokens), 'spi')::INT + contains(lower(name_tokens), 'halt')::INT + contains(lower(name_tokens), 'cell')::INT) AS matches FROM sym
WHERE contains(lower(name_tokens), 'spi')::INT + contains(lower(name_tokens), 'halt')::INT + contains(lower(name_tokens), 'cell')::INT >= 2""")
def name_token_like(spark, sf):
    return T.name_token_search(sym(spark, sf), ["spi", "halt", "cell"]).select("config_hash", "usr", "matches")


@query(f"WITH {SYM} SELECT config_hash, usr FROM sym WHERE contains(lower(docstring), 'interrupt')")
def docstring_like(spark, sf):
    return T.docstring_search(sym(spark, sf), "Interrupt").select("config_hash", "usr")


@query("SELECT doc_id, substr(text, 1, 200) AS snippet FROM documents WHERE contains(lower(text), 'dead') AND contains(lower(text), 'rom')")
def content_and_like(spark, sf):
    return T.content_search(load(spark, sf, "documents"), "dead_ROM", "text").select("doc_id", "snippet")


@query(f"""WITH {SYM}, l AS (SELECT id, line, unnest(string_split(source, chr(10))) AS t, unnest(range(0, len(string_split(source, chr(10))))) AS p FROM sym WHERE source IS NOT NULL)
SELECT id, list_sort(list((line + p)::INT))[1:20] AS lines FROM l WHERE contains(lower(t), 'return') OR contains(lower(t), 'state') GROUP BY 1""")
def match_lines(spark, sf):
    return T.match_lines(sym(spark, sf).where("source is not null"), "id", "source", "line", T.query_terms('"return" AND state*'))


@query(f"""WITH {SYM}, l AS (SELECT config_hash, usr, unnest(string_split(source, chr(10))) AS t, unnest(range(1, len(string_split(source, chr(10))) + 1))::INT AS line_no FROM sym
WHERE regexp_matches(regexp_replace(source, '(?s)/\\*.*?\\*/', '', 'g'), '\\bEIO\\b')) SELECT config_hash, usr, line_no FROM l WHERE regexp_matches(regexp_replace(t, '//.*$', ''), '\\bEIO\\b')""")
def macro_refs(spark, sf):
    return T.macro_references(sym(spark, sf).where("source is not null"), "EIO", "source").select("config_hash", "usr", "line_no")


@query("""SELECT symbol_id AS id, 'index' AS lacks FROM (SELECT id AS symbol_id FROM symbols WHERE is_definition = 1 EXCEPT SELECT symbol_id FROM symbols_fts WHERE summary IS NOT NULL)
UNION ALL SELECT symbol_id, 'table' FROM (SELECT symbol_id FROM symbols_fts WHERE summary IS NOT NULL EXCEPT SELECT id FROM symbols WHERE is_definition = 1)""")
def fts_consistency(spark, sf):
    """Bound so that both sides lack some: the table of definitions against an index of the rows with a summary."""
    return T.index_inconsistencies(load(spark, sf, "symbols").where("is_definition = 1"), load(spark, sf, "symbols_fts").where("summary is not null").select(F.col("symbol_id").alias("id")), "id")


@query("""WITH d AS (SELECT doc_id, text, strpos(lower(text), 'watchdog') AS p FROM documents WHERE contains(lower(text), 'watchdog'))
SELECT doc_id, regexp_replace(substr(text, greatest(p - 80, 1), 168), '(?i)(watchdog)', '<b>\\1</b>', 'g') AS snippet FROM d""")
def snippets(spark, sf):
    d = load(spark, sf, "documents").where(F.lower("text").contains("watchdog"))
    return d.select("doc_id", T.snippet(F.col("text"), "watchdog").alias("snippet"))


# --- vectors

_Q = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), c AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q)) AS s FROM embeddings)"


def _first_vector(spark, sf):
    e = load(spark, sf, "embeddings")
    return e, e.where("vec_id = 0").first()["embedding"]


@query(f"WITH {_Q} SELECT vec_id, round(1 - s, 6) AS distance FROM c WHERE 1 - s <= 0.8 ORDER BY 1 - s, vec_id LIMIT 30")
def knn_threshold(spark, sf):
    e, q = _first_vector(spark, sf)
    return V.knn(e, q, "vec_id", threshold=0.2).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_Q} SELECT vec_id, round(1 - s, 6) AS distance FROM c WHERE s > 0.25")
def knn_all_strict(spark, sf):
    e, q = _first_vector(spark, sf)
    return V.knn(e, q, "vec_id", threshold=0.25, limit=None, strict=True).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_Q}, a AS (SELECT vec_id, 1 - s AS distance FROM c WHERE s > 0.1) SELECT vec_id, round(distance, 6) AS distance, (SELECT count(*) FROM a) > 20 AS capped FROM a ORDER BY a.distance, vec_id LIMIT 20")
def knn_all_capped(spark, sf):
    e, q = _first_vector(spark, sf)
    rows, capped = V.knn_all(e, q, "vec_id", threshold=0.1, cap=20)
    return rows.select("vec_id", F.round("distance", 6).alias("distance"), F.lit(capped).alias("capped"))


@query("""WITH e AS (SELECT donor_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embedding_stash WHERE len(embedding) = 64 AND model = 'embed-lite-64' AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
q AS (SELECT v FROM e ORDER BY donor_id, v LIMIT 1) SELECT donor_id, round(min(1 - CASE WHEN list_max(list_transform(v, lambda x: abs(x))) = 0 THEN 0 ELSE list_cosine_similarity(v, (SELECT v FROM q)) END), 6) AS distance FROM e GROUP BY 1 HAVING min(1 - CASE WHEN list_max(list_transform(v, lambda x: abs(x))) = 0 THEN 0 ELSE list_cosine_similarity(v, (SELECT v FROM q)) END) <= 0.8""")
def knn_min_chunk(spark, sf):
    e = load(spark, sf, "embedding_stash").where("size(embedding) = 64 and model = 'embed-lite-64'").where(~F.exists("embedding", lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf"))))
    q = e.select("donor_id", "embedding").orderBy("donor_id", "embedding").first()["embedding"]
    return V.knn(e, q, "donor_id", threshold=0.2, limit=None).select("donor_id", F.round("distance", 6).alias("distance"))


@query(f"""WITH {_Q}, r AS (SELECT vec_id, s, label, floor((row_number() OVER (ORDER BY s DESC, vec_id) - 1) / 200) AS w FROM c)
SELECT vec_id, round(s * CASE WHEN label % 2 = 1 THEN 1.2 ELSE 0.85 END, 6) AS boosted, row_number() OVER (ORDER BY w, s * CASE WHEN label % 2 = 1 THEN 1.2 ELSE 0.85 END DESC, vec_id)::INT AS rank FROM r WHERE w < 5""")
def source_boost(spark, sf):
    e, q = _first_vector(spark, sf)
    hits = e.select("vec_id", (F.col("label") % 2).alias("is_project"), V.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q])).alias("similarity"), F.lit(0).alias("query"))
    return V.source_boost(hits, ["query"], key="vec_id").select("vec_id", F.round("boosted", 6).alias("boosted"), "rank")


_USABLE = "len(embedding) = 64 AND model = 'embed-lite-64' AND chunk_index = 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0"


def _usable(spark, sf):
    s = load(spark, sf, "embedding_stash").where("size(embedding) = 64 and model = 'embed-lite-64' and chunk_index = 0")
    return s.where(~F.exists("embedding", lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0))


@query(f"""WITH {_TEXTS}, {_bm25(['spi*', 'halt*'], T.SYMBOL_WEIGHTS, _COLS, 't', 'symbol_id')}, top AS (SELECT doc FROM ranked ORDER BY score, doc LIMIT 200),
s AS (SELECT stash_id, donor_id, embedding::DOUBLE[] AS e FROM embedding_stash WHERE {_USABLE}), q AS (SELECT e FROM s ORDER BY stash_id LIMIT 1)
SELECT donor_id AS symbol_id, round(min(1 - list_cosine_similarity(e, (SELECT e FROM q))), 6) AS distance FROM s WHERE donor_id IN (SELECT doc FROM top) GROUP BY 1""")
def hybrid_rerank(spark, sf):
    s = _usable(spark, sf)
    index = _symbol_index(spark, sf)
    top = T.search(index, "spi halt", T.SYMBOL_WEIGHTS).orderBy("score", "doc").limit(200).select(F.col("doc").alias("symbol_id"))
    q = s.orderBy("stash_id").first()["embedding"]
    return V.hybrid_rerank(top, s.select(F.col("donor_id").alias("symbol_id"), "embedding"), q).select("symbol_id", F.round("distance", 6).alias("distance"))


@query(f"""WITH {_TEXTS}, {_bm25(['spi*', 'halt*'], T.SYMBOL_WEIGHTS, _COLS, 't', 'symbol_id')}, s AS (SELECT stash_id, donor_id, embedding::DOUBLE[] AS e FROM embedding_stash WHERE {_USABLE}), q AS (SELECT e FROM s ORDER BY stash_id LIMIT 1),
n AS (SELECT donor_id AS symbol_id, min(1 - list_cosine_similarity(e, (SELECT e FROM q))) AS distance FROM s GROUP BY 1), d AS (SELECT symbol_id FROM n WHERE distance <= 0.1 ORDER BY distance, symbol_id LIMIT 30), k AS (SELECT count(*) AS n FROM d)
SELECT symbol_id, 'dense' AS mode FROM d WHERE (SELECT n FROM k) >= 3 UNION ALL SELECT doc, 'text' FROM (SELECT doc FROM ranked ORDER BY round(score, 9), doc LIMIT 20) WHERE (SELECT n FROM k) < 3""")
def fusion_choice(spark, sf):
    s = _usable(spark, sf)
    dense = V.knn(s.select(F.col("donor_id").alias("symbol_id"), "embedding"), s.orderBy("stash_id").first()["embedding"], threshold=0.9).select("symbol_id")
    text = T.search(_symbol_index(spark, sf), "spi halt", T.SYMBOL_WEIGHTS).orderBy(F.round("score", 9), "doc").limit(20).select(F.col("doc").alias("symbol_id"))
    rows, which = V.adaptive_fusion(dense, text)
    return rows.select("symbol_id", F.lit(which).alias("mode"))


_SCORE = """(CASE WHEN len(list_filter(string_split(lower(name) || '_', 'spi_')[:-2], lambda t: t = '' OR right(t, 1) = '_' OR right(t, 1) BETWEEN 'a' AND 'z')) > 0 OR list_contains(string_split(coalesce(name_tokens, ''), ' '), 'spi') THEN 3 WHEN contains(lower(qualified_name), 'spi') THEN 2 WHEN contains(lower(file_path), 'spi') THEN 1 ELSE 0 END
+ CASE WHEN is_project = 1 THEN 1 ELSE 0 END + CASE WHEN kind IN ('function', 'method', 'constructor', 'destructor', 'class', 'struct', 'enum', 'typedef', 'varglobal') THEN 2 WHEN kind IN ('enum_constant', 'namespace') THEN 1 ELSE 0 END)::INT"""


@query(f"WITH {SYM} SELECT config_hash, usr, {_SCORE} AS score FROM sym")
def relevance_score(spark, sf):
    return V.relevance(sym(spark, sf), ["spi"]).select("config_hash", "usr", "score")


@query(f"""WITH s AS (SELECT DISTINCT ON (id) *, {_SCORE} AS score FROM symbols ORDER BY id)
SELECT config_hash, name, file_path, id, min_score AS best FROM (SELECT *, max(score) OVER w AS min_score, row_number() OVER (PARTITION BY config_hash, name, file_path ORDER BY is_definition DESC, score DESC, id) AS k
FROM s WINDOW w AS (PARTITION BY config_hash, name, file_path)) WHERE k = 1""")
def dedup_prefer_definition(spark, sf):
    s = V.relevance(load(spark, sf, "symbols").dropDuplicates(["id"]), ["spi"])
    return V.deduplicate(s, ["config_hash"], [-F.col("score"), F.col("id")]).select("config_hash", "name", "file_path", "id", (-F.col("place.o0")).alias("best"))


@query(f"""WITH {SYM}, g AS (SELECT config_hash, usr, CASE WHEN kind IN ('function', 'method', 'class', 'struct', 'varglobal') THEN list_position(['function', 'method', 'class', 'struct', 'varglobal'], kind) ELSE 6 END AS pos FROM sym),
t AS (SELECT *, row_number() OVER (PARTITION BY config_hash, pos ORDER BY usr) AS turn FROM g)
SELECT config_hash, usr, row_number() OVER (PARTITION BY config_hash ORDER BY turn, pos)::INT AS rank FROM t QUALIFY row_number() OVER (PARTITION BY config_hash ORDER BY turn, pos) <= 20""")
def round_robin_kind(spark, sf):
    return V.round_robin_kinds(sym(spark, sf), ["config_hash"], [F.col("usr")]).select("config_hash", "usr", "rank")


@query(f"""WITH {SYM}, l AS (SELECT 0 AS term_pos, usr, config_hash, row_number() OVER (PARTITION BY config_hash ORDER BY usr) AS rank FROM sym WHERE contains(lower(name), 'spi')
UNION ALL SELECT 1, usr, config_hash, row_number() OVER (PARTITION BY config_hash ORDER BY usr) FROM sym WHERE contains(lower(name), 'halt')),
f AS (SELECT config_hash, usr, min({{'r': rank, 't': term_pos}}) AS f FROM l GROUP BY 1, 2) SELECT config_hash, usr, row_number() OVER (PARTITION BY config_hash ORDER BY f.r, f.t, usr)::INT AS place FROM f QUALIFY place <= 1000""")
def merged_term_lists(spark, sf):
    s = sym(spark, sf)
    ranked = lambda t, i: s.where(F.lower("name").contains(t)).select("config_hash", "usr", F.lit(i).alias("term_pos"), F.row_number().over(Window.partitionBy("config_hash").orderBy("usr")).alias("rank"))
    return V.merge_lists(ranked("spi", 0).unionByName(ranked("halt", 1)), ["config_hash"], "usr").select("config_hash", "usr", "place")


@query("""WITH w AS (SELECT model, content_hash, donor_id FROM embedding_stash WHERE embedding IS NOT NULL GROUP BY ALL HAVING max(chunk_index) + 1 = count(DISTINCT chunk_index))
SELECT content_hash, model, min(donor_id) AS donor_id FROM w WHERE content_hash IS NOT NULL GROUP BY 1, 2""")
def content_hash_groups(spark, sf):
    e = load(spark, sf, "embedding_stash")
    return V.reuse_vectors(e.where("content_hash is not null"), e)


@query("SELECT stash_id FROM embedding_stash WHERE donor_id NOT IN (SELECT id FROM symbols WHERE removed_at IS NULL AND is_definition = 1)")
def orphan_vectors(spark, sf):
    """Vectors of what is no definition, or no longer."""
    return V.orphan_vectors(load(spark, sf, "embedding_stash"), load(spark, sf, "symbols").where("removed_at is null and is_definition = 1"), "donor_id").select("stash_id")


@query("""WITH o AS (SELECT donor_id, content_hash, chunk_index, stash_id, embedding FROM embedding_stash WHERE is_project = 1), f AS (SELECT donor_id, content_hash, 0 AS chunk_index, -stash_id AS stash_id, embedding FROM embedding_stash WHERE embedding IS NOT NULL),
b AS (SELECT *, 1 AS g FROM o UNION ALL SELECT *, 0 FROM f) SELECT donor_id, content_hash, chunk_index, stash_id FROM b QUALIFY row_number() OVER (PARTITION BY donor_id, content_hash, chunk_index ORDER BY g, stash_id) = 1""")
def vectors_upserted(spark, sf):
    """The project's vectors with fresh ones of all donors put over their first chunks."""
    e = load(spark, sf, "embedding_stash").select("donor_id", "content_hash", "chunk_index", "stash_id", "embedding", "is_project")
    fresh = e.drop("is_project").withColumns({"chunk_index": F.lit(0), "stash_id": -F.col("stash_id")})
    return upsert_vectors(e.where("is_project = 1").drop("is_project"), fresh).select("donor_id", "content_hash", "chunk_index", "stash_id")


_MACROS = "mac AS (SELECT id, name, enum_value::VARCHAR AS value FROM sym WHERE kind = 'enum_constant')"


@query(f"WITH {SYM}, {_MACROS}, {_bm25(['spi*', '1*'], None, ['name', 'value'], 'mac', 'id')} SELECT doc AS id, round(score, 6) AS score FROM ranked")
def macro_search(spark, sf):
    """Full text over macros, bound to enum constants: name and value."""
    rows = lambda: sym(spark, sf).where("kind = 'enum_constant'").select("id", "name", F.col("enum_value").cast("string").alias("value"))
    return T.search(_index(spark, sf, "macros", rows, "id", ["name", "value"]), "spi 1").select(F.col("doc").alias("id"), F.round("score", 6).alias("score"))


@query("SELECT doc_id, sha256(text) AS file_hash FROM documents WHERE text IS NOT NULL")
def file_hashes(spark, sf):
    return load(spark, sf, "documents").where("text is not null").select("doc_id", file_hash(F.encode("text", "UTF-8")).alias("file_hash"))


@query(f"""WITH {SYM}, {_TEXTS}, {_bm25(['trace', 'emit'], None, ['source'], 't', 'symbol_id', True)},
l AS (SELECT s.id, list_sort(list((s.line + p)::INT))[1:20] AS lines FROM (SELECT id, line, unnest(string_split(source, chr(10))) AS x, unnest(range(0, len(string_split(source, chr(10))))) AS p FROM sym WHERE source IS NOT NULL) s
WHERE contains(lower(x), 'trace') OR contains(lower(x), 'emit') GROUP BY 1)
SELECT s.config_hash, s.usr, s.is_project, round(r.score, 6) AS score, l.lines, CASE WHEN strpos(lower(s.source), 'trace') > 0 THEN regexp_replace(substr(s.source, greatest(strpos(lower(s.source), 'trace') - 80, 1), 165), '(?i)(trace)', '<b>\\1</b>', 'g') ELSE substr(s.source, 1, 200) END AS snippet
FROM ranked r JOIN sym s ON s.id = r.doc LEFT JOIN l ON l.id = s.id WHERE s.is_definition = 1 ORDER BY s.is_project DESC, round(r.score, 9), s.usr, s.config_hash LIMIT 40""")
def body_search_page(spark, sf):
    """Bodies with all words: project code first, with snippet and match lines."""
    hits = T.search(_symbol_index(spark, sf, ["source"]), "trace emit", body=True).withColumnRenamed("doc", "id")
    return T.body_page(hits, sym(spark, sf), ["trace", "emit"]).orderBy(F.desc("is_project"), F.round("score", 9), "usr", "config_hash").limit(40).select("config_hash", "usr", "is_project", F.round("score", 6).alias("score"), "lines", "snippet")


@query(f"""WITH {SYM} SELECT 'name_tokens' AS step, config_hash, usr FROM sym WHERE contains(lower(name_tokens), 'halt')::INT + contains(lower(name_tokens), 'zzqx')::INT >= 1""")
def search_chain(spark, sf):
    """A search without a hit: the words are asked for as they are, then of name tokens, docstrings, each by itself, and macros."""
    s = sym(spark, sf)
    index = _symbol_index(spark, sf)
    macros = _index(spark, sf, "macros", lambda: s.where("kind = 'enum_constant'").select("id", "name", F.col("enum_value").cast("string").alias("value")), "id", ["name", "value"])
    step, found = T.search_chain(index, s, macros, "halt AND zzqx", T.SYMBOL_WEIGHTS)
    return found.select(F.lit(step).alias("step"), "config_hash", "usr")


@query(f"""WITH s AS (SELECT DISTINCT ON (id) id, list_distinct(list_filter(string_split(coalesce(name_tokens, ''), ' '), lambda x: x <> '')) AS w FROM symbols ORDER BY id),
v AS (SELECT donor_id AS id, min(stash_id) AS first, arg_min(embedding, stash_id)::DOUBLE[] AS e FROM embedding_stash WHERE {_USABLE} GROUP BY 1), a AS (SELECT * FROM v WHERE id % 50 = 0),
d AS (SELECT a.id AS query, v.id, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.e, v.e), 9) DESC, v.id) AS rank FROM a, v WHERE a.id <> v.id QUALIFY rank <= 10),
x AS (SELECT id, unnest(w) AS t FROM s WHERE id IN (SELECT id FROM v)), c AS (SELECT q.id AS query, x.id, count(*) AS n FROM x q JOIN x ON x.t = q.t WHERE q.id IN (SELECT id FROM a) AND q.id <> x.id GROUP BY 1, 2),
t AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY n DESC, id) AS rank FROM c QUALIFY rank <= 10),
ok AS (SELECT query FROM d GROUP BY 1 HAVING count(*) >= 3 INTERSECT SELECT query FROM t GROUP BY 1 HAVING count(*) >= 3),
p AS (SELECT query, arg_min(id, md5(id || ':42')) AS dense_id FROM d WHERE (query, id) NOT IN (SELECT query, id FROM t) GROUP BY 1), r AS (SELECT query, arg_min(id, md5(id || ':42')) AS text_id FROM t WHERE (query, id) NOT IN (SELECT query, id FROM d) GROUP BY 1)
SELECT ok.query, dense_id, text_id FROM ok JOIN p ON p.query = ok.query JOIN r ON r.query = ok.query""")
def triple_candidates(spark, sf):
    """Queries are the symbols with an id divisible by 50; the text ranking is by shared name tokens."""
    v = _usable(spark, sf).groupBy(F.col("donor_id").alias("id")).agg(F.min_by("embedding", "stash_id").alias("embedding"))
    v = materialize(v, "donors")
    dense = V.nearest_of(v.where("id % 50 = 0"), v, "id", "embedding", 10)
    once = load(spark, sf, "symbols").select("id", "name_tokens").dropDuplicates(["id"]).join(v.select("id"), "id", "left_semi")
    words = materialize(once.select("id", F.explode(F.array_distinct(F.split(F.coalesce("name_tokens", F.lit("")), " "))).alias("t")).where("t <> ''"), "name-words")
    shared = words.where("id % 50 = 0").withColumnRenamed("id", "query").join(words, "t").where("query <> id").groupBy("query", "id").agg(F.count(F.lit(1)).alias("n"))
    text = shared.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n"), "id"))).where("rank <= 10")
    return V.hard_negatives(dense, text.select("query", "id", "rank"))


@query(f"""WITH {SYM}, t AS (SELECT symbol_id AS id, min(summary) AS summary FROM symbols_fts GROUP BY 1),
d AS (SELECT s.id, s.name, s.kind, left(trim(coalesce(s.docstring, ''), e' \\t\\n\\r'), 120) AS doc, left(trim(coalesce(t.summary, ''), e' \\t\\n\\r'), 120) AS summary,
('0x' || substr(md5(s.id::VARCHAR), 1, 8))::BIGINT % 100 AS draw FROM sym s LEFT JOIN t ON t.id = s.id WHERE s.is_definition = 1 AND s.kind IN ('function', 'method', 'constructor', 'destructor')),
q AS (SELECT id, rtrim(trim(CASE WHEN draw < 35 THEN 'function that ' || summary WHEN draw < 60 THEN 'code for ' || kind || ' ' || name WHEN draw < 80 THEN summary WHEN draw < 90 THEN 'implementation of ' || name
WHEN draw < 95 THEN kind || ' ' || name || ' usage' ELSE doc END, e' \\t\\n\\r'), '.') AS query FROM d WHERE doc <> '' OR summary <> '') SELECT id, query FROM q WHERE length(query) >= 8""")
def made_queries(spark, sf):
    summaries = load(spark, sf, "symbols_fts").groupBy(F.col("symbol_id").alias("id")).agg(F.min("summary").alias("summary"))
    code = sym(spark, sf).where("is_definition = 1 and kind in ('function', 'method', 'constructor', 'destructor')")
    return V.made_queries(code.join(summaries, "id", "left"), "id")


@query()
def body_chunks(spark, sf):
    return V.chunk_bodies(sym(spark, sf), "id", "source", 200)


_RES = """res AS (SELECT a.vec_id AS query, b.label::VARCHAR AS name, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY rank <= 10), gold AS (SELECT vec_id AS query, label::VARCHAR AS name FROM embeddings WHERE vec_id % 50 = 0)"""


@query(f"""WITH {_RES}, h AS (SELECT r.*, g.name IS NOT NULL AS hit, row_number() OVER (PARTITION BY r.query, r.name ORDER BY rank) = 1 AS first FROM res r LEFT JOIN gold g ON g.query = r.query AND g.name = r.name)
SELECT query, coalesce(max(CASE WHEN hit THEN 1.0 / rank END), 0) AS mrr, sum(CASE WHEN hit AND first AND rank <= 1 THEN 1.0 ELSE 0 END) AS recall1, sum(CASE WHEN hit AND first AND rank <= 10 THEN 1.0 ELSE 0 END) AS recall10,
sum(CASE WHEN hit AND rank <= 5 THEN 1 ELSE 0 END) / 5.0 AS precision5, round(sum(CASE WHEN hit AND first THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg10 FROM h GROUP BY query""")
def retrieval_metrics(spark, sf):
    e = load(spark, sf, "embeddings")
    asked = e.where("vec_id % 50 = 0")
    near = V.nearest_of(asked, e, "vec_id", "embedding", 10).join(e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("name")), "id")
    m = A.retrieval_metrics(near.select("query", "name", "rank"), asked.select(F.col("vec_id").alias("query"), F.col("label").cast("string").alias("name")))
    return m.select("query", "mrr", "recall1", "recall10", "precision5", F.round("ndcg10", 6).alias("ndcg10"))
