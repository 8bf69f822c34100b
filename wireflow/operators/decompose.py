"""Templates that turn one operation into many: an explode of a fixed sequence, before linking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireflow.functions.codec import link, link_id, link_port, link_type
from wireflow.plans.running import global_rank

SIDES = [f"{s}_q{p}" for s in ("prev", "next") for p in (1, 2, 3)]

#: The sequences in time order, (gate, the operation's qubits a, b, c in the order of the gate's ports).
TOFFOLI = (
    ("H", "c"), ("CX", "bc"), ("T_dag", "c"), ("CX", "ac"), ("T", "c"), ("CX", "bc"), ("T_dag", "c"), ("CX", "ac"), ("CX", "ab"), ("T_dag", "b"),
    ("CX", "ab"), ("T", "a"), ("T", "b"), ("T", "c"), ("H", "c"),
)
TOFFOLI_REVERSED = (
    ("H", "c"), ("T", "c"), ("T", "b"), ("T", "a"), ("CX", "ab"), ("T_dag", "b"), ("CX", "ab"), ("CX", "ac"), ("T_dag", "c"), ("CX", "bc"), ("T", "c"),
    ("CX", "ac"), ("T_dag", "c"), ("CX", "bc"), ("H", "c"),
)
TOFFOLI_REVERSED_DAGGER = (
    ("H", "c"), ("T_dag", "c"), ("T_dag", "b"), ("T_dag", "a"), ("CX", "ab"), ("T", "b"), ("CX", "ab"), ("CX", "ac"), ("T", "c"), ("CX", "bc"),
    ("T_dag", "c"), ("CX", "ac"), ("T", "c"), ("CX", "bc"), ("H", "c"),
)
FREDKIN = (
    ("CX", "cb"), ("CX", "ab"), ("H", "c"), ("T", "a"), ("T_dag", "b"), ("T", "c"), ("CX", "cb"), ("CX", "ac"), ("T", "b"), ("CX", "ab"), ("T_dag", "c"),
    ("T_dag", "b"), ("CX", "ac"), ("CX", "cb"), ("T", "b"), ("H", "c"), ("CX", "cb"),
)
CCZ_DIRECT = (
    ("CX", "bc"), ("T_dag", "c"), ("CX", "ac"), ("T", "c"), ("CX", "bc"), ("T_dag", "c"), ("CX", "ac"), ("T_dag", "b"), ("T", "c"), ("CX", "ab"),
    ("T_dag", "b"), ("CX", "ab"), ("T", "a"), ("S", "b"),
)
CCZ_DIRECT_REVERSED = (
    ("S_dag", "b"), ("T_dag", "a"), ("CX", "ab"), ("T", "b"), ("CX", "ab"), ("T_dag", "c"), ("T", "b"), ("CX", "ac"), ("T", "c"), ("CX", "bc"),
    ("T_dag", "c"), ("CX", "ac"), ("T", "c"), ("CX", "bc"),
)
#: (type, parameter) of a gate; T and its inverse as powers of Z, or as types of their own.
AS_POWERS = {"H": (8, 1.0), "CX": (18, 1.0), "T": (7, 0.25), "T_dag": (7, -0.25), "S": (7, 0.5), "S_dag": (7, -0.5), "X": (9, 0.0)}
AS_TYPES = AS_POWERS | {"T": (29, 0.0), "T_dag": (30, 0.0), "S": (27, 0.0), "S_dag": (28, 0.0)}
Steps = tuple[tuple[str, str], ...]


def sequence(steps: Steps, codes: dict = AS_POWERS) -> list[tuple[int, float, str]]:
    """[(type, parameter, qubits)]."""
    return [(*codes[name], qubits) for name, qubits in steps]


def template(steps: list[tuple[int, float, str]]) -> F.Column:
    return F.array(*[F.struct(F.lit(c).cast("short").alias("type"), F.lit(p).cast("float").alias("param"), F.array(*[F.col(q) for q in qs]).alias("qubits")) for c, p, qs in steps])


def expand(rows: DataFrame, *templates: tuple[F.Column, F.Column]) -> DataFrame:
    """(k, sub, type, param, qubits) of rows (k, a, b, c) by the first template whose condition holds."""
    chosen = F.when(*templates[0])
    for t in templates[1:]:
        chosen = chosen.when(*t)
    return rows.select("k", F.posexplode(chosen).alias("sub", "op")).select("k", F.col("sub").cast("bigint").alias("sub"), "op.*")


def toffolis(rows: DataFrame, codes: dict = AS_POWERS) -> DataFrame:
    return expand(rows, (F.lit(True), template(sequence(TOFFOLI, codes))))


def toffoli_variants(rows: DataFrame, dagger: bool = True) -> DataFrame:
    """Even rows take the plain sequence, odd ones the reversed one or its dagger."""
    other = TOFFOLI_REVERSED_DAGGER if dagger else TOFFOLI_REVERSED
    return expand(rows, (F.col("k") % 2 == 0, template(sequence(TOFFOLI, AS_TYPES))), (F.lit(True), template(sequence(other, AS_TYPES))))


def fredkins(rows: DataFrame) -> DataFrame:
    return expand(rows, (F.lit(True), template(sequence(FREDKIN))))


def direct_clifford_t(rows: DataFrame) -> DataFrame:
    """Doubly controlled NOT (even rows, with an H on either side) and Z (odd rows); every third row reversed."""
    cz, rev = sequence(CCZ_DIRECT), sequence(CCZ_DIRECT_REVERSED)
    h = sequence((("H", "c"),))
    ccx, back = F.col("k") % 2 == 0, F.col("k") % 3 == 0
    return expand(rows, (ccx & back, template(h + rev + h)), (ccx, template(h + cz + h)), (back, template(rev)), (F.lit(True), template(cz)))


#: Rotations by k / 4 of pi, k from 0 to 7, as Clifford+T sequences on one qubit (up to a global phase).
QUARTERS = ((), ("T",), ("S",), ("S", "T"), ("S", "S"), ("S", "S", "T"), ("S_dag",), ("T_dag",))


def lower_rotations(rows: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """(k, sub, type, param, qubit) of rows (k, axis 2..4, angle in multiples of pi, qubit).

    Ry is s, H, Rz, H, S and Rx is H, Rz, H in time order; an Rz by a multiple of a quarter is
    exact, any other stays a rotation with its angle."""
    step = lambda c, p: F.struct(F.lit(c).cast("short").alias("type"), p.cast("double").alias("param"))
    fixed = lambda *s: F.array(*[step(AS_TYPES[x][0], F.lit(AS_TYPES[x][1])) for x in s]) if s else F.expr("cast(array() as array<struct<type:smallint,param:double>>)")
    turn = F.pmod(F.col("angle"), F.lit(2.0))
    near = F.pmod(F.round(turn * 4).cast("int"), F.lit(8))
    exact = F.abs(turn * 4 - F.round(turn * 4)) <= tolerance
    rz = F.when(exact & (near == 0), fixed())
    for i, s in enumerate(QUARTERS[1:], 1):
        rz = rz.when(exact & (near == i), fixed(*s))
    rz = rz.otherwise(F.array(step(4, F.col("angle"))))
    axis = F.col("axis")
    every = F.concat(F.when(axis == 3, fixed("S_dag", "H")).when(axis == 2, fixed("H")).otherwise(fixed()), rz, F.when(axis == 3, fixed("H", "S")).when(axis == 2, fixed("H")).otherwise(fixed()))
    return rows.select("k", "qubit", F.posexplode(every).alias("sub", "op")).select("k", F.col("sub").cast("bigint").alias("sub"), "op.type", "op.param", "qubit")


def lowered_controls(rows: DataFrame) -> DataFrame:
    """(line, sub, type, qubits) of rows (line, target, controls array<struct<qubit, filled>>).

    No control gives X, one CX, two CCX; hollow controls are conjugated with X. More are an error."""
    n = F.size("controls")
    one = lambda code, qubits: F.struct(F.lit(code).cast("short").alias("type"), qubits.alias("qubits"))
    flips = F.transform(F.filter("controls", lambda c: ~c["filled"]), lambda c: one(9, F.array(c["qubit"])))
    core = F.array(F.struct(F.when(n == 0, 9).when(n == 1, 18).when(n == 2, 23).otherwise(F.raise_error(F.lit("more than two controls"))).cast("short").alias("type"),
                            F.concat(F.transform("controls", lambda c: c["qubit"]), F.array("target")).alias("qubits")))
    return rows.select("line", F.posexplode(F.concat(flips, core, flips)).alias("sub", "op")).select("line", F.col("sub").cast("bigint").alias("sub"), "op.*")


#: Gates of the base set, which nothing decomposes further (In, Out, measurements and rotations by odd angles stay too).
SWAP = (("CX", "ab"), ("CX", "ba"), ("CX", "ab"))
CZ_BY_CX = (("H", "b"), ("CX", "ab"), ("H", "b"))


def _in_place(steps: Steps) -> F.Column:
    """The steps of a sequence on an operation's own qubits."""
    at = {name: F.try_element_at("qubits", F.lit(i + 1)) for i, name in enumerate("abc")}
    return F.array(*[F.struct(F.lit(c).cast("short").alias("type"), F.lit(p).cast("float").alias("param"), F.array(*[at[q] for q in qs]).alias("qubits")) for c, p, qs in sequence(steps, AS_TYPES)])


def to_base(ops: DataFrame, staged, most: int = 16) -> DataFrame:
    """(op_id, path, type, param, qubits): operations decomposed again and again until all are of the base set.

    ``path`` has the place in each round's sequence; (op_id, path) is the order in time. Doubly
    controlled NOTs, controlled swaps, swaps, controlled Z's and rotations or powers by quarters
    of a turn become H, CX, X and the types of S and T; other gates and angles stay as they are."""
    kind, quarter = F.col("type"), F.col("param").cast("double") * 4
    is_quarter = F.abs(quarter - F.round(quarter)) <= 1e-9
    turns = lambda before, after: F.element_at(F.array(*[_in_place(tuple((n, "a") for n in (*before, *x, *after))) if (*before, *x, *after) else F.expr("cast(array() as array<struct<type:smallint,param:float,qubits:array<bigint>>>)") for x in QUARTERS]), F.pmod(F.round(quarter).cast("int"), F.lit(8)) + 1)
    z, x, y = turns((), ()), turns(("H",), ("H",)), turns(("S_dag", "H"), ("H", "S"))
    steps = (F.when(kind.isin(21, 23), _in_place(TOFFOLI)).when(kind == 24, _in_place(FREDKIN)).when(kind == 31, _in_place(SWAP)).when(kind == 16, _in_place(CZ_BY_CX))
             .when(kind.isin(4, 7) & is_quarter, z).when(kind.isin(2, 5) & is_quarter, x).when(kind.isin(3, 6) & is_quarter, y))
    now = staged(ops.select("op_id", F.expr("cast(array() as array<int>)").alias("path"), "type", F.col("param").cast("float").alias("param"), "qubits"))
    for _ in range(most):
        marked = now.withColumn("steps", steps)
        if marked.where("steps is not null").isEmpty():
            return now
        same = F.array(F.struct("type", "param", "qubits"))
        now = staged(marked.select("op_id", "path", F.posexplode(F.coalesce("steps", same)).alias("at", "op")).select("op_id", F.concat("path", F.array("at")).alias("path"), "op.*"))
    raise ValueError(f"operations are composite after {most} rounds")


def toffolis_in_place(gates: DataFrame, staged, steps: Steps = TOFFOLI, code: int = 23) -> DataFrame:
    """A linked table with every gate of a type with three ports replaced by a sequence of gates, links and all.

    New gates get ids after the largest one: those of the n-th replaced gate (by id) follow each
    other. Each port of a replaced gate has an entry and an exit among the new ones; links that
    led to the port lead there, also from one replaced gate to the next."""
    steps = sequence(steps, AS_TYPES)
    size, columns = len(steps), gates.columns
    top = gates.agg((F.max("id") + 1).alias("top"))
    own = global_rank(gates.where(F.col("type") == code).select("id", *SIDES), "id", name="n").join(F.broadcast(top)).withColumn("base", F.col("top") + size * F.col("n"))
    where = {q: [(i, qs.index(q)) for i, (_, _, qs) in enumerate(steps) if q in qs] for q in "abc"}
    ends = {q: (where[q][0], where[q][-1]) for q in "abc"}
    to = lambda base, at: link(base + at[0], F.lit(at[1]), F.lit(steps[at[0]][0]))

    def told(side: str, port: int) -> F.Column:
        """What the gate at a link of a replaced gate is told: which of its own links now leads to which new gate."""
        at = F.col(f"{side}_q{port + 1}")
        slot = F.concat(F.lit("next_q" if side == "prev" else "prev_q"), (link_port(at) + 1).cast("string"))
        return F.struct(link_id(at).alias("id"), link_type(at).alias("kind"), slot.alias("slot"), to(F.col("base"), ends["abc"[port]][0 if side == "prev" else 1]).cast("bigint").alias("link"))

    # links are reciprocal: each replaced gate tells its neighbours, whose six links meet in one place; rows are moved once
    news = own.select(F.explode(F.array(*[told(s, p) for s in ("prev", "next") for p in range(3)])).alias("x")).select("x.*").where("id is not null")

    def moved(rows: DataFrame, inner: bool) -> DataFrame:
        """Links to ports of replaced gates lead to the new gates instead."""
        mine = news.where((F.col("kind") == code) if inner else (F.col("kind") != code)).select("id", "slot", "link").repartition("id")
        got = mine.groupBy("id").agg(*[F.max(F.when(F.col("slot") == c, F.col("link"))).alias(f"__{c}") for c in SIDES])
        met = rows.join(got, "id", "left")
        return met.select(*[F.coalesce(f"__{c}", c).alias(c) if c in SIDES else F.col(c) for c in rows.columns])

    rest = moved(gates.where(F.col("type") != code), False)
    outer = moved(own.select("id", "base", *SIDES), True)
    rows = []
    for i, (kind, param, qs) in enumerate(steps):
        links = {}
        for port in range(3):
            q = qs[port] if port < len(qs) else None
            at = where[q].index((i, port)) if q else None
            wire = "abc".index(q) + 1 if q else None
            links[f"prev_q{port + 1}"] = F.lit(None) if q is None else F.col(f"prev_q{wire}") if at == 0 else to(F.col("base"), where[q][at - 1])
            links[f"next_q{port + 1}"] = F.lit(None) if q is None else F.col(f"next_q{wire}") if at == len(where[q]) - 1 else to(F.col("base"), where[q][at + 1])
        rows.append(F.struct((F.col("base") + i).alias("id"), F.lit(kind).cast("short").alias("type"), F.lit(param).cast("float").alias("param"), *[v.cast("bigint").alias(k) for k, v in links.items()]))
    new = outer.select(F.explode(F.array(*rows)).alias("g")).select("g.*")
    kinds = dict(gates.dtypes)
    fixed = {"global_shift": 0.0, "switch": False, "visited": -1}
    for c in columns:
        if c not in new.columns:
            new = new.withColumn(c, F.lit(fixed.get(c)).cast(kinds[c]))
    return rest.select(*columns).unionByName(new.select(*columns))


# decomposition by a relation, to a depth, in windows

#: (type, at, step_type, step_param, ports): what a gate becomes, step by step; ports are the gate's, in the order of the step's.
RELATION = "type short, at int, step_type short, step_param float, ports array<int>"
STEPS_OF = {21: TOFFOLI, 23: TOFFOLI, 24: FREDKIN, 31: SWAP, 16: CZ_BY_CX}


def relation(spark, steps_of: dict[int, Steps] = STEPS_OF, codes: dict = AS_TYPES) -> DataFrame:
    """The relation of sequences by type."""
    rows = [(kind, at, c, p, ["abc".index(q) for q in qs]) for kind, steps in steps_of.items() for at, (c, p, qs) in enumerate(sequence(steps, codes))]
    return spark.createDataFrame(rows, RELATION)


def decomposed(ops: DataFrame, rules: DataFrame, staged, depth: int | None = None, keep: tuple[int, ...] = (), most: int = 64) -> DataFrame:
    """(op_id, path, depth, type, param, qubits): operations decomposed by a relation, to ``depth`` at most; (op_id, path) is the order in time.

    Types in ``keep`` are left as they are, and so is what the relation has no rows for. Only what
    was made in the last round can be composite, so each round joins that alone. Without a depth
    it goes on until nothing is composite; a relation that leads back to itself is an error."""
    first = ops.select("op_id", F.expr("cast(array() as array<int>)").alias("path"), F.lit(0).alias("depth"), "type", F.col("param").cast("float").alias("param"), "qubits")
    rules = rules.where(~F.col("type").isin(*keep)) if keep else rules
    kinds = F.broadcast(rules.select(F.col("type").alias("kind")).distinct())  # types are two digits: a hundred rows at most
    steps = F.broadcast(rules.groupBy(F.col("type").alias("kind")).agg(F.array_sort(F.collect_list(F.struct("at", "step_type", "step_param", "ports"))).alias("steps")))
    now, done, rounds = staged(first), [], 0
    while depth is None or rounds < depth:
        if now.join(kinds, F.col("type") == F.col("kind"), "left_semi").isEmpty():
            break
        if rounds == most:
            raise ValueError(f"operations are composite after {most} rounds")
        done.append(now.join(kinds, F.col("type") == F.col("kind"), "left_anti"))
        made = now.join(steps, F.col("type") == F.col("kind")).select("op_id", "path", "depth", "qubits", F.explode("steps").alias("s"))
        now = staged(made.select("op_id", F.concat("path", F.array("s.at")).alias("path"), (F.col("depth") + 1).alias("depth"), F.col("s.step_type").alias("type"), F.col("s.step_param").alias("param"),
                                 F.transform("s.ports", lambda p: F.element_at("qubits", p + 1)).alias("qubits")))
        rounds += 1
    for d in done:
        now = now.unionByName(d)
    return now


def windowed(rows: DataFrame, size: int) -> DataFrame:
    """Add ``place`` and ``window``: gates (op_id, path) in their order, so many to a window (the last may have fewer)."""
    ranked = global_rank(rows, "op_id", "path", name="place")
    return ranked.withColumn("window", F.floor(F.col("place") / size).cast("bigint"))
