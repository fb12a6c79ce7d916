"""The tools of a code index as methods that return DataFrames.

Each method filters one build, so scans prune by config_hash, and composes operators; pages come with a notice.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.scalars import describe_slot
from quarrylens.operators import callgraph as G
from quarrylens.operators import fusion as V
from quarrylens.operators import merge as M
from quarrylens.operators import paging as P
from quarrylens.operators import pointsto as S
from quarrylens.operators import references as R
from quarrylens.operators import resolve as L
from quarrylens.operators import stats as A
from quarrylens.operators import text as T
from quarrylens.runtime import load, materialize
from quarrylens.sources.sinks import drop_table, read_table, replace_table


class CodeIndex:
    """One build of an index directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, config_hash: str):
        self.spark, self.dir, self.build = spark, sf_dir, config_hash

    def _table(self, name: str) -> DataFrame:
        df = load(self.spark, self.dir, name)
        return df.where(F.col("config_hash") == self.build) if "config_hash" in df.columns else df

    @cached_property
    def symbols(self) -> DataFrame:
        return materialize(M.merge_symbols(self._table("symbols")), "facade-symbols")

    @cached_property
    def refs(self) -> DataFrame:
        return materialize(M.merge_refs(self._table("refs")), "facade-refs")

    @cached_property
    def texts(self) -> T.TextIndex:
        own = self._table("symbols_fts").join(self.symbols.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi")
        once = own.groupBy("symbol_id").agg(*[F.min(c).alias(c) for c in T.SYMBOL_WEIGHTS])
        return T.build_index(once, "symbol_id", tuple(T.SYMBOL_WEIGHTS), stored=True)

    @cached_property
    def macros(self) -> T.TextIndex:
        """Macros by name and value, bound to enum constants."""
        rows = self.symbols.where("kind = 'enum_constant'").select("id", "name", F.col("enum_value").cast("string").alias("value"))
        return T.build_index(rows, "id", ("name", "value"), stored=True)

    # search

    def search_code(self, query: str, kind: str | None = None, project_only: bool = False, limit: int = 20, offset: int = 0) -> tuple[DataFrame, P.Notice]:
        """Ranked symbols; if nothing matches: without the kind, by name tokens, by docstring, word by word, and macros."""
        rows = L.project_filter(self.symbols, project_only)
        step, found = T.search_chain(self.texts, rows, self.macros, query, T.SYMBOL_WEIGHTS, kind)
        if step == "macro":
            found = found.join(self.symbols, "id")
        return P.page_with_total(found, [F.col("score"), F.col("usr")], limit, offset)

    def search_bodies(self, query: str, limit: int = 20, offset: int = 0) -> tuple[DataFrame, P.Notice]:
        """Definitions whose body has all words, project code first, with a snippet and match lines."""
        bound = query if ":" in query.replace("::", "") else f"source:({T.expand_query(query, body=True)})"
        hits = T.search(self.texts, bound, body=True).withColumnRenamed("doc", "id")
        found = T.body_page(hits, self.symbols, T.query_terms(query) or [query])
        return P.page_with_total(found, [F.desc("is_project"), F.col("score"), F.col("usr")], limit, offset)

    def search_content(self, query: str, text: str = "text", limit: int = 20, offset: int = 0) -> tuple[DataFrame, P.Notice]:
        """Texts of the documents table that hold all terms."""
        return P.page_with_total(T.content_search(load(self.spark, self.dir, "documents"), query, text), [F.col("doc_id")], limit, offset)

    def semantic_search(
        self, vector: list[float], model: str, threshold: float = 0.6, floor: float = 0.68, limit: int = 20, text: str | None = None, score=None, head: int = 50,
    ) -> tuple[DataFrame, str]:
        """Symbols by vector with boost; a warning if the best raw similarity is below the floor.

        score, a model's column function over the text of a symbol, reorders the first head results. Without any result the
        text, if given, is searched for.
        """
        stash = load(self.spark, self.dir, "embedding_stash").where(F.col("model") == model)
        near = V.knn(stash, vector, "donor_id", threshold=threshold, limit=None).select(F.col("donor_id").alias("id"), (1 - F.col("distance")).alias("similarity"))
        found = near.join(self.symbols.where("is_definition = 1"), "id").withColumn("query", F.lit(0))
        best = found.agg(F.max("similarity")).first()[0]
        if best is None and text is not None:
            return self.search_code(text, limit=limit)[0], "no vector is near; found by text"
        rows = V.source_boost(found, ["query"], key="id", first=max(limit, head)).orderBy("rank")
        if score is not None:
            rows = V.rerank(rows.limit(head).withColumn("__text", F.concat_ws(" ", "qualified_name", "signature", "docstring")), "__text", score, limit).drop("__text")
        return rows.limit(limit), "" if best is not None and best >= floor else "results are weak"

    def smart_search(self, query: str, vector: list[float] | None = None, model: str = "", limit: int = 20) -> DataFrame:
        """Text and vector results, the vector's if there are enough, scored, deduplicated, with neighbours of the first ones."""
        text, _ = self.search_code(query, limit=100)
        rows, stems = text, query.lower().split()
        if vector is not None:
            dense, _ = self.semantic_search(vector, model, threshold=0.5, limit=50)
            rows, _ = V.adaptive_fusion(dense.select(*self.symbols.columns), text.select(*self.symbols.columns))
        once = V.deduplicate(V.relevance(rows.select(*self.symbols.columns), stems), ["config_hash"], [-F.col("score"), F.col("usr")])
        top = materialize(once.orderBy("place").limit(limit), "smart")
        more = G.expand_context(top.orderBy("place").limit(10), self.symbols, self.refs)
        return top.select("usr", "name", "kind", "file_path", "score").withColumn("via", F.lit("search")).unionByName(
            more.select("usr", "name", "kind", "file_path", F.lit(0).alias("score")).withColumn("via", F.lit("neighbour")))

    # lookups

    def lookup_symbol(self, name: str, exact: bool = True, limit: int = 20, offset: int = 0) -> tuple[DataFrame, P.Notice]:
        """By name, else by tail, else what was meant."""
        found = L.lookup_hits(self.symbols, name, exact)
        if found.isEmpty() and "::" in name:
            tail = name.rsplit("::", 1)[-1]
            found = L.lookup_hits(self.symbols.where(F.col("qualified_name").endswith("::" + tail)), tail, exact)
        if found.isEmpty():
            macro = self.symbols.where((F.col("kind") == "enum_constant") & (F.lower("name") == name.lower()))
            names = L.suggest(self.symbols, name)
            found = self.symbols.join(names.select("name"), "name", "left_semi")
            found = macro if found.isEmpty() else found
        return P.page_with_total(L.with_owner(found, self.symbols), [F.desc("is_definition"), F.col("line"), F.col("file_path"), F.col("usr")], min(limit, L.LOOKUP_PAGE), offset)

    def find_variables(self, name: str, limit: int = 20, offset: int = 0) -> tuple[DataFrame, P.Notice]:
        return P.page_with_total(L.find_variables(self.symbols, name), [F.col("kind") != "varglobal", F.col("name"), F.col("usr")], limit, offset)

    def get_file_map(self, path: str, per_kind: int = 30) -> DataFrame:
        return L.file_map(self.symbols.where(F.col("file_path").endswith(path)), per_kind)

    def get_source(self, name: str, cap: int | None = None) -> DataFrame:
        return L.source_lines(L.lookup_definition(self.symbols, name), cap)

    def read_file(self, doc_id: int, start: int = 1, count: int = 100) -> DataFrame:
        docs = load(self.spark, self.dir, "documents").where(F.col("doc_id") == doc_id)
        return L.file_page(docs, start, count, "text").select("doc_id", "lines")

    def get_symbol_context(self, name: str, overrides: DataFrame | None = None, shown: int = 5) -> DataFrame:
        """Body, callers, callees, overrides, members and constants, the first of each with the section's total."""
        none = self.spark.createDataFrame([], "config_hash string, derived_usr string, base_usr string")
        return L.context_sections(self.symbols, self.refs, none if overrides is None else overrides.where(F.col("config_hash") == self.build), name, shown)

    def explain_symbol(self, name: str) -> DataFrame:
        """The data of an explanation: definition, signature, docstring, body; no model's text."""
        return L.lookup_definition(self.symbols, name).select("usr", "qualified_name", "kind", "file_path", "line", "signature", "docstring", "source")

    def get_class_members(self, name: str, limit: int = 50, offset: int = 0) -> tuple[DataFrame, P.Notice]:
        own = self.symbols.join(self._candidates(name).select(F.col("usr").alias("parent_usr")), "parent_usr", "left_semi")
        return P.page_with_total(own, [F.col(c) for c in ("kind", "name", "line", "usr")], limit, offset)

    def get_template_instances(self, name: str, limit: int = 50, offset: int = 0) -> tuple[DataFrame, P.Notice]:
        own = self.symbols.join(self._candidates(name).select(F.col("usr").alias("template_usr")), "template_usr", "left_semi")
        return P.page_with_total(own, [F.col(c) for c in ("file_path", "line", "usr")], limit, offset)

    # call graph

    def _candidates(self, name: str) -> DataFrame:
        return L.resolve(self.symbols, self.refs, name).where("rn <= 50")

    def find_references(self, name: str, kinds: list[str] | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, P.Notice]:
        """References to all candidates of a name, interleaved, with the caller."""
        merged = R.refs_round_robin(self.refs.where(L.kind_filter(kinds)), self._candidates(name).select("config_hash", "usr", F.col("rn").alias("pos")))
        full = merged.join(R.as_side(self.symbols, "caller", "from_usr"), ["config_hash", "from_usr"], "left")
        return P.page_with_total(full, [F.col("rn"), F.col("pos"), F.col("id")], limit, offset)

    def find_callers(self, name: str, limit: int = 50, offset: int = 0) -> tuple[DataFrame, P.Notice]:
        return self.find_references(name, ["call", "indirect", "implicit_construct"], limit, offset)

    @cached_property
    def _edges(self) -> dict[bool, DataFrame]:
        """Call edges with alias edges, forward and backward."""
        calls, pairs = G.call_edges(self.refs), materialize(G.alias_pairs(self.symbols, self.refs), "facade-aliases")
        return {forward: materialize(G.alias_edges(calls, pairs, forward), "facade-edges") for forward in (True, False)}

    def _closure(self, name: str, forward: bool, depth: int, limit: int, offset: int) -> tuple[DataFrame, P.Notice]:
        found = G.walk(self._edges[forward], self._candidates(name).select("config_hash", "usr"), depth, forward)
        named = found.join(self.symbols.select("config_hash", "usr", "name", "kind", "file_path"), ["config_hash", "usr"])
        return P.page_with_total(named, [F.col(c) for c in ("depth", "name", "usr", "target")], limit, offset)

    def find_all_callers_recursive(self, name: str, max_depth: int = 5, limit: int = 50, offset: int = 0) -> tuple[DataFrame, P.Notice]:
        return self._closure(name, False, max_depth, limit, offset)

    def find_callees_recursive(self, name: str, max_depth: int = 5, limit: int = 50, offset: int = 0) -> tuple[DataFrame, P.Notice]:
        return self._closure(name, True, max_depth, limit, offset)

    def find_call_path(self, source: str, target: str, max_depth: int = 10) -> DataFrame:
        """Up to five paths, the shortest first, with the outcome of each start and goal."""
        paths, outcomes = G.call_paths(self._edges[True], self._candidates(source), self._candidates(target), max_depth)
        return outcomes.join(paths, ["config_hash", "src", "dst"], "left").orderBy("depth", "path").limit(5)

    def find_dead_code(self, project_only: bool = False, excluded: tuple[str, ...] = (), limit: int = 50, offset: int = 0) -> tuple[DataFrame, P.Notice]:
        rows = L.project_filter(G.dead_code(self.symbols, self.refs), project_only, excluded)
        return P.page_with_total(rows, [F.col("category") != "dead", F.col("kind"), F.col("name"), F.col("usr")], limit, offset)

    def find_hotspots(self, project_only: bool = False, limit: int = 20, offset: int = 0) -> tuple[DataFrame, P.Notice]:
        return P.page_with_total(L.project_filter(G.hotspots(self.symbols, self.refs), project_only), [F.desc("caller_count"), F.col("usr")], limit, offset)

    def find_wrapper_callers(self, name: str) -> DataFrame:
        own = self._candidates(name).select(F.col("usr").alias("class_usr"))
        return R.wrapper_callers(self.refs, self.symbols).join(own, "class_usr", "left_semi").orderBy(F.desc("sites"), "wrapper")

    def trace_data_flow(self, type_name: str, target: str, max_depth: int = 8, limit: int = 15) -> DataFrame:
        return G.data_flow(self.symbols, self.refs, type_name, target, max_depth, limit)

    def pagerank(self) -> DataFrame:
        return G.pagerank(self.symbols, self.refs)

    def find_indirect_call_sites(self, caller: str | None = None, sites: DataFrame | None = None) -> DataFrame:
        """The indirect call references, of one caller or all; with slot sites these, each with words for its slot."""
        if sites is None:
            rows, key = self.refs.where("ref_kind = 'indirect'"), "from_usr"
        else:
            rows, key = sites.where(F.col("config_hash") == self.build).drop("unit").distinct().withColumn("label", describe_slot(F.col("slot"))), "caller"
        return rows if caller is None else rows.join(self._candidates(caller).select(F.col("usr").alias(key)), key, "left_semi")

    def find_indirect_targets(self, sources: DataFrame, flows: DataFrame, sites: DataFrame, **facts) -> S.Resolution:
        """The resolution of slot facts of this build."""
        own = lambda df: df.where(F.col("config_hash") == self.build)
        return S.resolve_slots(own(sources), own(flows), own(sites), **facts)

    def get_vector_table(self, unhandled_only: bool = False) -> DataFrame:
        calls = self.refs.where("ref_kind = 'indirect'").select("config_hash", F.col("from_usr").alias("usr"))
        table = S.vector_table(self.refs, self.symbols, calls)
        return (table.where("status = 'unhandled'") if unhandled_only else table).orderBy("from_file", "slot_index")

    # inheritance

    def get_inheritance_chain(self, inheritance: DataFrame, name: str, max_depth: int = 10) -> DataFrame:
        own = self._candidates(name).select(F.col("usr").alias("start_usr"))
        up, down = (G.inheritance_closure(inheritance.where(F.col("config_hash") == self.build), u, max_depth) for u in (True, False))
        return up.withColumn("direction", F.lit("base")).unionByName(down.withColumn("direction", F.lit("derived"))).join(own, "start_usr", "left_semi")

    def get_method_overrides(self, overrides: DataFrame, name: str) -> DataFrame:
        own = self._candidates(name).select("usr")
        return R.overrides_both_ways(overrides.where(F.col("config_hash") == self.build), self.symbols).join(own, "usr", "left_semi")

    # status and maintenance

    def get_build_info(self) -> DataFrame:
        """Symbols by kind, and the totals of the build in the rows without a kind."""
        macros = self.symbols.where("kind = 'enum_constant'")
        totals = A.build_totals(self._table("build_configs"), self.symbols, self._table("files"), self.refs, macros)
        return A.build_stats(self.symbols).unionByName(totals, allowMissingColumns=True)

    def count_dead_code(self) -> DataFrame:
        return G.dead_code(self.symbols, self.refs).groupBy("category").agg(F.count(F.lit(1)).alias("symbols"))

    def get_project_status(self) -> DataFrame:
        """Decisions of the newest run that ended well against the good run before it."""
        runs = self._table("index_runs")
        now, was = M.against_last(self._table("files"), runs)
        last = runs.where("state = 'ok'").agg(F.max("run_no")).first()[0]
        both = M.decide_units(now, was, ["config_hash", "run_no", "path"], ["source_hash", "flags_hash"])
        return both.where(F.col("run_no") == last).groupBy("decision").agg(F.count(F.lit(1)).alias("files"))

    def list_projects(self) -> DataFrame:
        return A.project_counts(*[load(self.spark, self.dir, t) for t in ("projects", "build_configs", "symbols", "files", "refs")])

    def get_project_info(self) -> DataFrame:
        return self._table("build_configs")

    def reindex_file(self, fresh: DataFrame, path: str | None = None) -> DataFrame:
        """The symbols with the rows of fresh's files replaced; with a path they become the next version of the table there."""
        rows = M.replace_files(self.symbols, fresh, ["config_hash", "file_path"])
        if path is None:
            return rows
        replace_table(rows, path, ["config_hash"])
        return read_table(self.spark, path)

    def reset_index(self, path: str) -> None:
        drop_table(self.spark, path)

    def verify(self) -> DataFrame:
        return M.integrity(self.symbols, self.refs, self._table("files"))
