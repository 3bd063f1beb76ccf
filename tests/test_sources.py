"""CSV / parquet catalogue, sinks and persistence round trips."""
import os

import pytest

from orderlens.sources import catalog, schemas, sinks
from orderlens.sources.derived import derived_catalog
from tests.conftest import SF_SMALL


def _write_csv_catalog(spark, base, with_translation=True):
    c = derived_catalog(spark, SF_SMALL)
    specs = dict(schemas.FILES)
    if with_translation:
        specs.update(schemas.OPTIONAL_FILES)
    for name, (fname, _) in specs.items():
        df = c[name]
        path = os.path.join(base, fname + ".d")
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
        part = [f for f in os.listdir(path) if f.startswith("part-")][0]
        os.rename(os.path.join(path, part), os.path.join(base, fname))


def test_csv_catalog_loads_typed(spark, tmp_dir):
    _write_csv_catalog(spark, tmp_dir)
    cat = catalog.load_catalog(spark, tmp_dir)
    assert set(cat) == set(schemas.FILES) | {"product_translation"}
    o = cat["orders"]
    assert dict(o.dtypes)["order_purchase_timestamp"] == "timestamp_ntz"
    assert o.filter("order_purchase_timestamp IS NOT NULL").count() == o.count()


def test_optional_translation_absent(spark, tmp_dir):
    _write_csv_catalog(spark, tmp_dir, with_translation=False)
    cat = catalog.load_catalog(spark, tmp_dir)
    assert "product_translation" not in cat


def test_missing_mandatory_table_raises(spark, tmp_dir):
    with pytest.raises(catalog.MissingTableError):
        catalog.load_catalog(spark, tmp_dir)


def test_bom_header_stripped(spark, tmp_dir):
    p = os.path.join(tmp_dir, "t.csv")
    with open(p, "wb") as f:
        f.write("﻿product_category_name,product_category_name_english\nbeleza_saude,health_beauty".encode())
    df = catalog.read_csv(spark, p, schemas.TRANSLATION)
    assert df.first().product_category_name == "beleza_saude"


def test_csv_export_serialises_arrays(spark, tmp_dir):
    from orderlens.operators import orders
    c = derived_catalog(spark, SF_SMALL)
    it = orders.items_agg(c["order_items"], lists=True)
    out = os.path.join(tmp_dir, "items_csv")
    sinks.export_csv(it, out)
    back = spark.read.option("header", True).csv(out)
    assert back.count() == it.count() and back.first().product_ids.startswith("[")


def test_parquet_round_trip(spark, tmp_dir):
    from orderlens.operators import orders
    md = orders.model_dataset(derived_catalog(spark, SF_SMALL))
    p = os.path.join(tmp_dir, "md")
    sinks.write_table(md, p)
    back = sinks.read_table(spark, p)
    assert back.count() == md.count() and back.dtypes == md.dtypes


def test_parquet_catalog_round_trip(spark, tmp_dir):
    c = derived_catalog(spark, SF_SMALL)
    for name, df in c.items():
        df.write.mode("overwrite").parquet(os.path.join(tmp_dir, f"{name}.parquet"))
    back = catalog.load_catalog(spark, tmp_dir, fmt="parquet")
    assert set(back) == set(c)
    assert back["order_items"].count() == c["order_items"].count()


def test_keep_cancelled_orders(spark):
    from orderlens.operators import orders
    c = derived_catalog(spark, SF_SMALL)
    assert orders.base_orders(c, drop_canceled_orders=False).count() == c["orders"].count()
    assert orders.base_orders(c).count() == orders.drop_canceled(c["orders"]).count()
