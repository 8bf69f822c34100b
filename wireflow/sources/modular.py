"""Adders by bit index: sums through a chain of carries, and sums of a constant modulo a number from five of them.

A carry is an And of two bits (type 22, parameter 1; -1 where it is undone). Every adder is one row
and its gates are made from it by expressions over the bits, so rows are made where the adders are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireflow.schema import CX, X

AND = 22
MOST_BITS = 64
Bit = Callable[[Column], Column]


def _gate(code: int, param: float, *qubits: Column) -> Column:
    return F.struct(F.lit(code).cast("short").alias("type"), F.lit(param).cast("float").alias("param"), F.array(*[q.cast("bigint") for q in qubits]).alias("qubits"))


def _each(low: Column, high: Column, of: Callable[[Column], Column]) -> Column:
    """of(low), ..., of(high), one array after the other; none if high < low."""
    return F.flatten(F.transform(F.when(low <= high, F.sequence(low, high)).otherwise(F.expr("cast(array() as array<bigint>)")), of))


def _sum(n: Column, a: Bit, b: Bit, carry: Bit) -> Column:
    """b + a into b for two or more bits, the lowest first, the last carry dropped: carries go up, and are undone on the way down."""
    zero, one, last = F.lit(0).cast("bigint"), F.lit(1).cast("bigint"), n - 1
    up = _each(one, last - 1, lambda j: F.array(_gate(CX, 1.0, carry(j - 1), a(j)), _gate(CX, 1.0, carry(j - 1), b(j)), _gate(AND, 1.0, a(j), b(j), carry(j)), _gate(CX, 1.0, carry(j - 1), carry(j))))
    turned = lambda i: last - i
    down = _each(one, last - 1, lambda i: F.array(_gate(CX, 1.0, carry(turned(i) - 1), carry(turned(i))), _gate(AND, -1.0, a(turned(i)), b(turned(i)), carry(turned(i))),
                                                 _gate(CX, 1.0, carry(turned(i) - 1), a(turned(i))), _gate(CX, 1.0, a(turned(i)), b(turned(i)))))
    return F.concat(F.array(_gate(AND, 1.0, a(zero), b(zero), carry(zero))), up, F.array(_gate(CX, 1.0, carry(last - 1), b(last)), _gate(CX, 1.0, a(last), b(last))),
                    down, F.array(_gate(AND, -1.0, a(zero), b(zero), carry(zero)), _gate(CX, 1.0, a(zero), b(zero))))


def _undone(gates: Column) -> Column:
    """Gates that undo these: in reverse, with carries made instead of undone and the other way round."""
    back = lambda g: F.struct(g["type"].alias("type"), F.when(g["type"] == AND, -g["param"]).otherwise(g["param"]).alias("param"), g["qubits"].alias("qubits"))
    return F.transform(F.reverse(gates), back)


def _layout(rows: DataFrame) -> DataFrame:
    """Rows with ``__bits`` and ``__m``: what the places of an adder's qubits depend on; the size of null is -1 outside of ANSI mode."""
    return rows.withColumn("__bits", F.col("bits").cast("bigint")).withColumn("__m", F.greatest(F.coalesce(F.size("controls"), F.lit(0)).cast("bigint"), F.lit(0).cast("bigint")))


def _shapes(rows: DataFrame) -> DataFrame:
    """(__n, __c, add_value, sub_value, add_modulus, sub_modulus): the four sums for each number of bits and of controls that occurs; none of any other adder's."""
    known = rows.where(F.col("__bits").between(2, MOST_BITS)).select(F.col("__bits").alias("__n"), F.col("__m").alias("__c")).distinct()
    n, m = F.col("__n"), F.col("__c")
    high = lambda base: lambda j: base + n - 1 - j  # noqa: E731  bit j of a register whose highest comes first
    b, a, c, carry = high(m), high(m + n), high(m + 2 * n), lambda j: m + 3 * n + 1 + j
    sums = known.select("__n", "__c", _sum(n, a, b, carry).alias("add_value"), _sum(n, c, b, carry).alias("add_modulus"))
    return sums.select("*", _undone(F.col("add_value")).alias("sub_value"), _undone(F.col("add_modulus")).alias("sub_modulus"))


def _parts(rows: DataFrame) -> DataFrame:
    """Rows of :func:`_layout` with ``n_qubits`` and the gates that depend on more than the shape, each made once: ``__before`` all sums, ``__flag`` (also set by __modulus) and ``__after``."""
    n, m = F.col("__bits"), F.col("__m")
    reg, val, mod = m, m + n, m + 2 * n
    flag, carries = m + 3 * n, m + 3 * n + 1
    ladder = carries + n - 1
    modulus = F.col("modulus").cast("bigint")
    low, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    x, cx = (lambda q: F.array(_gate(X, 0.0, q))), (lambda p, q: F.array(_gate(CX, 1.0, p, q)))
    none = F.slice(x(low), 1, 0)
    half = F.call_function("shiftleft", one, F.least(n - 1, F.lit(62).cast("bigint")).cast("int"))
    wrong = ~n.between(2, MOST_BITS) | (modulus < 1) | ((modulus > half) & (n < MOST_BITS))
    known = F.col("bits").isNotNull() & F.col("value").isNotNull() & modulus.isNotNull()
    error = F.raise_error(F.concat(F.lit("no modular adder of "), n.cast("string"), F.lit(" bits for the modulus "), modulus.cast("string")))

    def digits(number: Column) -> Column:
        """The places, from the highest digit, of the ones of a number in so many bits."""
        text = F.lpad(F.bin(number), n.cast("int"), F.lit("0"))
        return F.filter(F.transform(F.split(text, ""), lambda d, i: F.when(d == "1", i.cast("bigint"))), lambda i: i.isNotNull())

    hollow = F.flatten(F.transform("controls", lambda on, i: F.when(on, F.slice(x(i), 1, 0)).otherwise(x(i))))
    gather = _each(one, m - 1, lambda i: F.array(_gate(AND, 1.0, F.when(i == 1, low).otherwise(ladder + i - 2), i, ladder + i - 1)))
    told = F.when(m == 1, low).otherwise(ladder + m - 2)
    made = rows.withColumn("__known", F.when(known & wrong, error.cast("boolean")).otherwise(known))
    made = made.withColumn("__ones", F.when(F.col("__known"), digits(F.pmod(F.col("value").cast("bigint"), modulus)))).withColumn("__mods", F.when(F.col("__known"), digits(modulus)))
    made = made.withColumn("__controlled", F.when(m > 0, F.concat(hollow, gather)).otherwise(none))
    made = made.withColumn("__load", F.when(m == 0, F.transform("__ones", lambda i: _gate(X, 0.0, val + i))).otherwise(F.transform("__ones", lambda i: _gate(CX, 1.0, told, val + i))))
    made = made.withColumn("__modulus", F.transform("__mods", lambda i: _gate(X, 0.0, mod + i))).withColumn("__if", F.transform("__mods", lambda i: _gate(CX, 1.0, flag, mod + i)))
    made = made.withColumn("__flag", F.concat(x(reg), cx(reg, flag), x(reg))).withColumn("__clear", cx(reg, flag)).withColumn("__undo", _undone(F.col("__controlled")))
    return made.withColumn("n_qubits", F.when(F.col("__known"), ladder + F.greatest(m - 1, low)))


#: The circuit: the sums are those of a shape, all else is an adder's own. The flag says that the sum was no less than the
#: modulus, which then stays off; without the value the register is negative just if the flag is set.
CIRCUIT = ("__controlled", "__load", "__modulus", "add_value", "sub_modulus", "__flag", "__if", "add_modulus", "__if", "sub_value", "__clear", "add_value", "__load", "__modulus", "__undo")
SUMS = ("add_value", "sub_value", "add_modulus", "sub_modulus")


def _shaped(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """Rows with the columns of their shapes; there are at most 63 numbers of bits for a number of controls."""
    return rows.join(F.broadcast(shapes), (F.col("__bits") == F.col("__n")) & (F.col("__m") == F.col("__c")), "left").drop("__n", "__c")


def modular_adders(rows: DataFrame) -> DataFrame:
    """Add ``gates`` (array of type, param, qubits in order of time) and ``n_qubits`` to rows (bits, value, modulus, controls).

    The circuit adds ``value`` to a register below ``modulus``, modulo it, if all its controls are as ``controls`` says
    (an array of booleans, null or empty: always). Qubits are the controls, the register with its highest bit first, and qubits
    that begin and end as zero: the value's, the modulus', one for the comparison, the carries, and those that gather controls.
    The value is taken modulo the modulus, so it may be negative. The highest bit serves as a sign: a modulus above half of
    the register's range, one below 1, and bits other than 2 to 64 are errors; a null in bits, value or modulus gives null gates.
    The sums are made once for each number of bits and of controls."""
    own = _layout(rows)
    made = _shaped(_parts(own), _shapes(own))
    return made.select(*rows.columns, F.when(F.col("__known"), F.concat(*CIRCUIT)).alias("gates"), "n_qubits")


def counted(rows: DataFrame, kinds: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Rows (see :func:`modular_adders`) with ``n_qubits`` and the number of the circuit's gates of every kind (name: condition on a gate).

    The gates of the sums are counted once for each number of bits and of controls, an adder's own gates in each."""
    own = _layout(rows)
    many = lambda part, of: F.size(F.filter(part, of)).cast("bigint")
    sums = _shapes(own).select("__n", "__c", *[sum((many(p, of) for p in CIRCUIT if p in SUMS), F.lit(0).cast("bigint")).alias(f"__{k}") for k, of in kinds.items()])
    rest = F.concat(*[p for p in CIRCUIT if p not in SUMS])
    made = _shaped(_parts(own).withColumn("__rest", rest), sums)
    return made.select(*rows.columns, "n_qubits", *[F.when(F.col("__known"), many("__rest", of) + F.col(f"__{k}")).alias(k) for k, of in kinds.items()])


def gate_rows(adders: DataFrame, key: str) -> DataFrame:
    """(key, sub, type, param, qubits): the gates of every adder in their order."""
    return adders.select(key, F.posexplode("gates").alias("sub", "g")).select(key, F.col("sub").cast("bigint").alias("sub"), "g.*")


def applied(gates: Column, state: Column) -> Column:
    """The basis state (bit q is qubit q, 62 at most) that gates of X, CX and And make of a basis state: the last qubit flips if all others are set."""
    bit = lambda q: F.call_function("shiftleft", F.lit(1).cast("bigint"), q.cast("int"))

    def step(s: Column, g: Column) -> Column:
        q = g["qubits"]
        held = F.aggregate(F.slice(q, 1, F.size(q) - 1), F.lit(True), lambda yes, c: yes & (s.bitwiseAND(bit(c)) != 0))
        return F.when(held, s.bitwiseXOR(bit(F.element_at(q, -1)))).otherwise(s)

    return F.aggregate(gates, state.cast("bigint"), step)


def with_register(value: Column, bits: Column, offset: Column) -> Column:
    """The basis state with a number in a register of so many qubits from ``offset`` on, its highest bit first."""
    return F.call_function("shiftleft", F.conv(F.reverse(F.lpad(F.bin(value), bits.cast("int"), F.lit("0"))), 2, 10).cast("bigint"), offset.cast("int"))
