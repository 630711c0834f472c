"""Report tiles registered as queries (R01 … R77; R03 is a text tile)."""

from __future__ import annotations

from lodestar.plans.registry import add
from lodestar.plans.report import MODEL_SQL, TILES, model_views, run_tile, tile_sql
from lodestar.plans.warehouse_sql import with_warehouse
from lodestar.sources.tables import tables_stamp
from lodestar.sources.dump_fixture import materialized_warehouse

_VIEWS: dict = {}


def views_for(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir, tables_stamp(spark, sf_dir))
    if key not in _VIEWS:
        _VIEWS[key] = model_views(materialized_warehouse(spark, sf_dir))
    return _VIEWS[key]


for _tile in TILES:

    def _fn(spark, sf_dir, _tile=_tile):
        return run_tile(views_for(spark, sf_dir), _tile)

    add(f"{_tile.rid}_{_tile.slug}", _fn, with_warehouse(",\n" + MODEL_SQL.strip() + "\n" + tile_sql(_tile)).replace("\n,\n", ",\n", 1))


# FX-13: the report parameter selects the run; the same tile for the second run
_RUN2 = "md5('run2')"
_by_name = {t.rid: t for t in TILES}
for _rid in ("r05", "r39", "r52"):
    _tile = _by_name[_rid]

    def _fn2(spark, sf_dir, _tile=_tile):
        return run_tile(views_for(spark, sf_dir), _tile, _RUN2)

    add(
        f"fx13_run2_{_tile.rid}_{_tile.slug}",
        _fn2,
        with_warehouse(",\n" + MODEL_SQL.strip() + "\n" + tile_sql(_tile, _RUN2)).replace("\n,\n", ",\n", 1),
    )
