import pytest

from quarrylens.plans.facade import CodeIndex
from quarrylens.queries.common import inheritance, overrides, slot_facts
from quarrylens.runtime import load


@pytest.fixture(scope="module")
def index(spark):
    sf = "/root/testdata/sf0.001"
    build = load(spark, sf, "build_configs").orderBy("config_hash").first()["config_hash"]
    return CodeIndex(spark, sf, build)


def test_paged_tools_walk_all_rows(index):
    for tool in (index.find_dead_code, index.find_hotspots, lambda **k: index.find_references("trace_emit", **k), lambda **k: index.find_callees_recursive("board_bringup_all", 2, **k)):
        rows, notice = tool(limit=7)
        seen, offset = [tuple(r) for r in rows.collect()], 7
        while offset < notice.total and offset < 50:
            rows, _ = tool(limit=7, offset=offset)
            seen += [tuple(r) for r in rows.collect()]
            offset += 7
        assert len(seen) == min(offset, notice.total) and len(set(map(str, seen))) == len(seen)


def test_search_tools(index):
    rows, notice = index.search_code("trace emit")
    assert notice.total > 0 and "trace_emit" in {r["name"] for r in rows.collect()}
    assert index.search_bodies("return")[1].total > 0
    assert index.smart_search("trace emit").count() > 0
    assert index.lookup_symbol("trace_emitt")[1].total > 0
    index.search_content("the boot").__len__()


def test_graph_tools(index, spark):
    assert index.find_call_path("board_bringup_all", "trace_emit").count() >= 0
    assert index.find_wrapper_callers("Outcome").columns[0] == "class_usr"
    assert index.get_vector_table().count() >= 0
    sf = "/root/testdata/sf0.001"
    f = slot_facts(spark, sf)
    assert index.find_indirect_targets(f["sources"], f["flows"], f["sites"]).edges.count() > 0
    assert index.get_inheritance_chain(inheritance(spark, sf), "good").count() >= 0
    assert index.get_method_overrides(overrides(spark, sf), "good").count() >= 0
    assert index.verify().count() == 5


def test_status_tools(index):
    assert index.get_build_info().count() > 0 and index.list_projects().count() >= 40
    assert index.get_project_status().count() > 0 and index.get_symbol_context("trace_emit").count() > 0
    assert index.get_source("trace_emit").count() > 0 and index.get_file_map(".c").count() > 0
    assert index.explain_symbol("trace_emit").count() == 1
