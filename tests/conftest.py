import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def shop(spark):
    """Parents, their parts and lookups, with a missing key, a dangling key, nulls and copies."""
    tables = {
        "maker": ("id string, name string, mail string, city_id int", [
            ("m1", "Nord", "a@x", 1), ("m2", 'Sü"d\\', None, None), ("m3", "", "c@x", 9), (None, "keyless", "d@x", 2),
        ]),
        "address": ("id string, maker_id string, city string, zip string, no int", [
            ("a1", "m1", "Austin", "10", 2), ("a2", "m1", "Dallas", None, 1), ("a3", "m1", None, "", 3),
            ("a4", "m3", "Rome\nSouth", "7.50", 1), ("a5", None, "Lost", "1", 1), ("a6", "m1", "Austin", "10", 4),
        ]),
        "phone": ("address_id string, number string, rank int", [
            ("a1", "11", 1), ("a1", "12", 2), ("a2", "21", 1), ("a4", "41", 1), ("a4", None, 2), ("a6", "", 1),
        ]),
        "city": ("id int, name string", [(1, "Hub"), (2, "Rim")]),
        "street": ("city_id int, name string, pos int", [(1, "Oak", 1), (1, "Elm", 2), (2, "Ash", 1), (1, "Fir", 3)]),
        "twice": ("id string, note string", [("m1", "x"), ("m1", "y"), ("m3", "z")]),
    }
    frames = {name: spark.createDataFrame(rows, schema) for name, (schema, rows) in tables.items()}
    rows = {name: [r.asDict() for r in frame.collect()] for name, frame in frames.items()}
    return frames.__getitem__, rows
