import datetime as dt
import os
import sys
import tempfile
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from tillstar.schema import TYPED_SCHEMA  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    ckpt = tempfile.mkdtemp(prefix="tillstar-test-ckpt-")
    s = (
        SparkSession.builder.master("local[4]")
        .appName("tillstar-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", ckpt)
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def raw_frame(spark, rows):
    """Typed raw rows (dicts) in file order; missing keys are null."""
    schema = T.StructType(list(TYPED_SCHEMA.fields) + [T.StructField("_order", T.LongType(), False)])
    data = []
    for i, r in enumerate(rows):
        vals = []
        for f in TYPED_SCHEMA.fields:
            v = r.get(f.name)
            if isinstance(f.dataType, T.DecimalType) and v is not None:
                v = Decimal(str(v))
            if f.name == "invoicedate" and isinstance(v, str):
                v = dt.date.fromisoformat(v)
            vals.append(v)
        data.append(tuple(vals) + (i,))
    return spark.createDataFrame(data, schema)


def row(**kw):
    base = dict(invoiceno="536365", stockcode="85123", description="WHITE HANGING HEART",
                quantity=6, invoicedate="2010-12-01", unitprice="2.55", customerid="17850.0",
                country="UNITED KINGDOM")
    base.update(kw)
    return base


@pytest.fixture
def make_raw(spark):
    return lambda rows: raw_frame(spark, rows)


__all__ = ["F", "row", "raw_frame"]
