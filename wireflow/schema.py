"""Gate dictionary and table schemas."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

#: Fixed values: (code, name, arity, kind of parameter, readable name).
GATES = (
    (0, "in", 1, None, "In"), (1, "out", 1, None, "Out"),
    (2, "rx", 1, "rotation", "Rx"), (3, "ry", 1, "rotation", "Ry"), (4, "rz", 1, "rotation", "Rz"),
    (5, "xpow", 1, "exponent", "XPow"), (6, "ypow", 1, "exponent", "YPow"), (7, "zpow", 1, "exponent", "ZPow"),
    (8, "h", 1, "exponent", "H"), (9, "paulix", 1, None, "X"), (10, "pauliy", 1, None, "Y"), (11, "pauliz", 1, None, "Z"),
    (12, "globalphase", 1, None, "GlobalPhase"), (13, "reset", 1, None, "Reset"), (14, "meas", 1, "key", "M"),
    (15, "cx", 2, None, "CX"), (16, "cz", 2, None, "CZ"), (17, "czpow", 2, "exponent", "CZPow"), (18, "cxpow", 2, "exponent", "CXPow"),
    (19, "xxpow", 2, "exponent", "XXPow"), (20, "zzpow", 2, "exponent", "ZZPow"),
    (21, "toffoli", 3, None, "Toffoli"), (22, "and", 3, None, "And"), (23, "ccx", 3, "exponent", "CCX"), (24, "cswap", 3, None, "CSwap"),
    (25, "globalin", 1, None, "GlobalIn"), (26, "globalout", 1, None, "GlobalOut"),
    (27, "s", 1, None, "S"), (28, "s_dag", 1, None, "S_dag"), (29, "t", 1, None, "T"), (30, "t_dag", 1, None, "T_dag"), (31, "swap", 2, None, "Swap"),
)
IN, OUT, H, X, M, RESET, CX, T, T_DAG, S, S_DAG, ZPOW, CCX = 0, 1, 8, 9, 14, 13, 18, 29, 30, 27, 28, 7, 23
CONTROLLED = (15, 16, 17, 18)
GLOBAL_IN, GLOBAL_OUT = -1, -2
#: Types whose inverse is another type; all other types here invert their parameter or themselves.
INVERSE = {29: 30, 30: 29, 27: 28, 28: 27}

GATE_SCHEMA = StructType([
    StructField("id", LongType(), False),
    StructField("prev_q1", LongType()), StructField("prev_q2", LongType()), StructField("prev_q3", LongType()),
    StructField("type", ShortType()), StructField("param", FloatType()), StructField("global_shift", FloatType()), StructField("switch", BooleanType()),
    StructField("next_q1", LongType()), StructField("next_q2", LongType()), StructField("next_q3", LongType()),
    StructField("visited", IntegerType()), StructField("label", StringType()), StructField("cl_ctrl", BooleanType()), StructField("meas_key", ShortType()),
])
LAYER_SCHEMA = "id long, control_q long, target_q long, type long, param double, layer long"


def gate_types(spark):
    """The dictionary as a table: code, name, arity, kind, readable (32 rows; may be broadcast)."""
    return spark.createDataFrame(GATES, "code short, name string, arity int, kind string, readable string")
