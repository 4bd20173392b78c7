"""Edges, writes and contexts of menu documents (view B): one document an order, its next action by the order's number."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.operators import edges as E
from flowlake.operators import normalize as N
from flowlake.plans.registry import query
from flowlake.plans.views import spread, table

ID = {c: f"00000000-0000-4000-8000-00000000000{i}" for i, c in enumerate("CABMDU")}
MENU = """{"flowSequenceItemList":[{"__type":"Menu","id":"{C}","name":"main","trackingId":1,"startAction":"{A}","actionList":[
 {"__type":"DecisionAction","trackingId":2,"id":"{A}","name":"d","nextAction":"%1$s","outputs":[{"value":{"config":{"ref":{"type":"var","val":"v%2$d"}}}}],
  "paths":[{"outputId":"__YES__","label":"yes","nextActionId":"{B}"},{"outputId":"{U}","isDynamicBranch":true,"nextActionId":"{U}"},{"outputId":"{U}","isDynamicBranch":true,"nextActionId":"{M}"}],
  "fallback":{"screenTarget":"{B}","list":[{"deepTarget":"{B}"},{"config":{"x":"{B}"},"other":"{B}"}],"plain":["{B}"]}},
 {"__type":"TransferMenuAction","trackingId":3,"id":"{B}","name":"t","menuReference":"{C}","menuName":"main"}],
 "menuChoiceList":[{"id":"ch1","digit":1,"name":"sales","action":{"__type":"TransferTaskAction","trackingId":4,"id":"{M}","name":"m","taskReference":"{U}","taskName":"x"}}]}],
 "manifest":{"queue":[{"id":"{D}","name":"q","context":[{"id":"{A}"},{"id":"gone"}]},{"id":"","name":"none"},"odd"]}}"""
for _c, _id in ID.items():
    MENU = MENU.replace("{" + _c + "}", _id)


def _documents(spark, d, **read):
    k = F.col("o_orderkey")
    follow = F.element_at(F.array(*(F.lit(ID[c]) for c in "BDU")), (k % 3 + 1).cast("int"))
    return N.flatten_json(spread(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select(k.alias("flow_id"), F.format_string(MENU, follow, k).alias("definition")), once=True, **read)


def _menus(spark, d):
    paths = E.edge_rows(_documents(spark, d, keep=E.kept_rows, columns=E.COLUMNS))
    return paths, N.extract_nodes(paths.where("part = 'node'"))


FIXED = """('trk_1', 'trk_2', 'entry', NULL, NULL, 'startAction'), ('trk_2', 'trk_3', 'yes', 'yes', '__YES__', 'path:__YES__'), ('trk_2', 'trk_3', 'screen-target', NULL, NULL, 'field:fallback/screenTarget'), ('trk_2', 'trk_3', 'deep-target', NULL, NULL, 'field:fallback/list[0]/deepTarget'),
  ('trk_3', 'trk_1', 'transfer-menu', 'main', NULL, 'menuReference'), ('trk_1', 'trk_4', 'menu-choice', '1: sales', NULL, 'choice:ch1'), ('trk_2', 'trk_4', 'dynamic-branch', NULL, '%s', 'path:%s')""" % (ID["U"], ID["U"])


@query(f"""WITH e AS (SELECT o_orderkey AS flow_id, t.* FROM orders, (VALUES {FIXED}) t(src, dst, role, label, condition, site) UNION ALL SELECT o_orderkey, 'trk_2', 'trk_3', 'next', NULL, NULL, 'nextAction' FROM orders WHERE o_orderkey % 3 = 0)
SELECT flow_id, src || '->' || dst || '#' || role || '@' || site AS edge_id, src, dst, role, label, condition FROM e""")
def n5_menu_edges(spark, d):
    paths, nodes = _menus(spark, d)
    return E.extract_edges(paths, nodes, N.extract_dependencies(paths.where("part = 'entry'")))[0]


AT = "/flowSequenceItemList/0"


@query(f"""SELECT o_orderkey AS flow_id, t.* FROM orders, (VALUES ('DANGLING_REFERENCE', 'warning', '{AT}/actionList/0/paths/1/nextActionId', 'trk_2'), ('DANGLING_REFERENCE', 'warning', '{AT}/menuChoiceList/0/action/taskReference', 'trk_4'),
  ('UNRECOGNISED_REFERENCE_FIELD', 'info', '{AT}/actionList/0/fallback/screenTarget', 'trk_2,trk_3'), ('UNRECOGNISED_REFERENCE_FIELD', 'info', '{AT}/actionList/0/fallback/list[0]/deepTarget', 'trk_2,trk_3')) t(code, severity, path, node_ids)
UNION ALL SELECT o_orderkey, 'DANGLING_REFERENCE', 'warning', '{AT}/actionList/0/nextAction', 'trk_2' FROM orders WHERE o_orderkey % 3 = 2""")
def n7_reference_warnings(spark, d):
    paths, nodes = _menus(spark, d)
    return E.extract_edges(paths, nodes, N.extract_dependencies(paths.where("part = 'entry'")))[1].withColumn("node_ids", F.array_join("node_ids", ","))


@query("SELECT o_orderkey AS flow_id, 'v' || o_orderkey AS variable_id, 'trk_2' AS node_id FROM orders")
def n11_variable_writes(spark, d):
    return E.variable_writes(*_menus(spark, d))


@query(f"SELECT o_orderkey AS flow_id, 'queue' AS type, '{ID['D']}' AS dependency_id, 'trk_2' AS referenced_by, 'gone' AS other_contexts FROM orders")
def n12_dependency_contexts(spark, d):
    rows = E.dependency_contexts(*_menus(spark, d))
    return rows.withColumn("referenced_by", F.array_join("referenced_by", ",")).withColumn("other_contexts", F.array_join("other_contexts", ","))


@query("SELECT o_orderkey AS flow_id, unnest(['/manifest/queue/1', '/manifest/queue/2']) AS pointer FROM orders")
def n21_manifest_deviations(spark, d):
    return E.manifest_deviations(_documents(spark, d, keep=N.at_pointers("^/manifest/[^/]+/[^/]*$"), columns=("pointer", "type", "fields")))
