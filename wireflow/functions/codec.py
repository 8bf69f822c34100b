"""Link codec: gate id, port and type packed as id * 1000 + port * 100 + type; null means no neighbour."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def link(gate_id, port, gate_type) -> Column:
    return (_col(gate_id) * 1000 + _col(port) * 100 + _col(gate_type)).cast("bigint")


def _div(x, by: int) -> Column:
    """Integer division; SQL's div does not pass through doubles, which lose digits above 2^53."""
    return F.call_function("div", _col(x).cast("bigint"), F.lit(by).cast("bigint"))


def link_id(x) -> Column:
    return _div(x, 1000)


def link_port(x) -> Column:
    return _div(_col(x) % 1000, 100)


def link_type(x) -> Column:
    return (_col(x) % 100).cast("bigint")


def strip_type(x) -> Column:
    """id * 10 + port."""
    return _div(x, 100)


SQL_FUNCTIONS = {
    "create_link(id BIGINT, port BIGINT, type BIGINT)": "id * 1000 + port * 100 + type",
    "get_id_from_link(link BIGINT)": "link div 1000",
    "get_port_from_link(link BIGINT)": "(link div 100) % 10",
    "get_type_from_link(link BIGINT)": "link % 100",
    "strip_link(link BIGINT)": "link div 100",
}


def register(spark: SparkSession) -> None:
    """The codec as temporary SQL functions."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS BIGINT RETURN {body}")
