"""Sheets of any size: formulas bound to DataFrames.

Rules become columns, fused into as few projections as their dependencies allow; all reduces that are ready together
become one aggregation over one scan; what is left of a scalar is decimal arithmetic on the driver. A reduce inside a rule is computed once
and handed to every row as a literal.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal, localcontext

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import Compiled, Wide, _settled, compile_rounded, literal, wide_column
from ..functions.evaluate import evaluate
from ..functions.finance import WIDE, irr, irr_of
from ..functions.registry import REDUCES
from ..lang.parser import parse_lines
from ..lang.syntax import Assertion, Binding, Call, Ref, Report, walk
from ..lang.values import SPARK_DIGITS, Fault, Value, fits, quantize, show
from ..plans.graph import topological
from ..plans.static import DATE, width
from ..streaming.scratch import folder

#: Flows up to which an IRR is found on the driver; beyond that every trial rate is priced in the tasks. The steps, and the result, are the same.
FEW_FLOWS = 20_000
#: Flows of a block in which signs are followed in order.
BLOCK = 100_000
FINDING = "code string, sheet string, name string, row_label string, stored string, computed string, formula string"


@dataclass
class BoundSheet:
    name: str
    frame: DataFrame | None
    rules: dict[str, Binding] = field(default_factory=dict)
    scalars: dict[str, Binding] = field(default_factory=dict)
    asserts: list[Assertion] = field(default_factory=list)
    reports: list[Report] = field(default_factory=list)
    order_by: str | None = None
    label: str | None = None
    done: dict[str, Compiled] = field(default_factory=dict)


class Workbook:
    """Named sheets with formulas. `param` overrides are given to `values` and `check`."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.sheets: dict[str, BoundSheet] = {"": BoundSheet("", None)}

    def sheet(self, name: str, frame: DataFrame | None, formulas: str = "", order_by: str | None = None, label: str | None = None) -> Workbook:
        """Bind a DataFrame (or None for scalars only) under a name. Numeric columns must be DECIMAL or whole numbers.

        A binding whose name is a column is a rule that the stored column is compared with; a new name bound with
        `precision` whose formula reads columns outside reduces is a computed column; all others are scalars.
        """
        statements, faults = parse_lines(formulas)
        if faults:
            raise Fault("TYPE", "; ".join(f"{line}: {message}" for _, line, message in faults))
        s = self.sheets[name] = BoundSheet(name, frame, order_by=order_by, label=label)
        columns = set(frame.columns) if frame is not None else set()
        per_row = set(columns)
        for st in statements:
            if isinstance(st, Binding):
                own = {x.name for x in _outside_reduces(st.expr) if isinstance(x, Ref) and x.sheet in (None, name)}
                if st.target in columns or own & per_row:
                    s.rules[st.target] = st
                    per_row.add(st.target)
                else:
                    s.scalars[st.target] = st
            elif isinstance(st, Assertion):
                s.asserts.append(st)
            elif isinstance(st, Report):
                s.reports.append(st)
        return self

    # analysis

    def find(self, sheet: str, ref: Ref) -> tuple[str, str, str]:
        """(kind, sheet, name) of a reference."""
        for place in [ref.sheet] if ref.sheet else [sheet, ""]:
            s = self.sheets.get(place)
            if s is None:
                continue
            if ref.name in s.rules:
                return "rule", place, ref.name
            if s.frame is not None and ref.name in s.frame.columns:
                return "column", place, ref.name
            if ref.name in s.scalars:
                return "scalar", place, ref.name
        raise Fault("UNDEF", f"{ref} is not defined")

    def graph(self) -> dict:
        edges = {}
        for s in self.sheets.values():
            for n, b in [*s.rules.items(), *s.scalars.items()]:
                found = [self.find(s.name, x) for x in walk(b.expr) if isinstance(x, Ref)]
                edges[s.name, n] = list(dict.fromkeys((p, m) for k, p, m in found if k != "column"))
        return edges

    def run(self, given: dict[str, Decimal] | None = None) -> Evaluated:
        return Evaluated(self, given or {})


def _outside_reduces(e):
    yield e
    if isinstance(e, Call) and e.name in REDUCES:
        for a in e.args[:-1]:
            yield from _outside_reduces(a)
        return
    for x in e.args if isinstance(e, Call) else [getattr(e, k) for k in ("arg", "left", "right") if hasattr(e, k)]:
        yield from _outside_reduces(x)


class Evaluated:
    """Values of a workbook under one set of parameters."""

    def __init__(self, book: Workbook, given: dict[str, Decimal]):
        self.book, self.given = book, given
        self.scalars: dict[tuple[str, str], Value] = {}
        self.places: dict[tuple[str, str], int | None] = {}
        self.faults: dict[tuple[str, str], Fault] = {}
        self.frames: dict[str, DataFrame] = {s.name: s.frame for s in book.sheets.values() if s.frame is not None}
        self.columns: dict[tuple[str, str], Compiled] = {}
        self.stored: dict[tuple[str, str], str] = {}
        self.reduces: dict[tuple, Value | Fault] = {}
        for s in book.sheets.values():
            if s.frame is not None:
                for f in s.frame.schema.fields:
                    self.columns[s.name, f.name] = _column(s.frame, f)
        edges = book.graph()
        order, cycles = topological(edges)
        for ring in cycles:
            for n in ring:
                self.faults[n] = Fault("CYCLE", " -> ".join(f"{a}.{b}" for a, b in [*ring, ring[0]]))
        todo = list(order)
        while todo:
            ready = self._ready(todo, edges)
            self._aggregate(ready)
            for node in ready:
                self._bind(node)
            todo = [n for n in todo if n not in ready]

    def _ready(self, todo, edges) -> list:
        """Nodes that can be bound in one sweep: a node with new reduces needs all it reads bound before the sweep's aggregation."""
        before, waiting, out = set(todo), set(todo), []
        for n in todo:
            try:
                fresh = any(self._key(n[0], c) not in self.reduces for c in walk(self._binding(n).expr) if isinstance(c, Call) and c.name in REDUCES)
            except (Fault, KeyError):
                fresh = True
            if not any(d in (before if fresh else waiting) for d in edges[n]):
                out.append(n)
                waiting.discard(n)
        return out

    def _binding(self, node) -> Binding:
        s = self.book.sheets[node[0]]
        return s.rules.get(node[1]) or s.scalars[node[1]]

    def _key(self, sheet: str, c: Call) -> tuple:
        ref = c.args[-1]
        if not isinstance(ref, Ref):
            raise Fault("TYPE", f"{c.name} reads a column, not an expression")
        kind, place, name = self.book.find(sheet, ref)
        if kind == "scalar":
            raise Fault("TYPE", f"{ref} is not a column")
        rest = tuple(self._plain(sheet, a) for a in c.args[:-1])
        return (c.name, place, name, *rest)

    def _plain(self, sheet: str, e) -> Value:
        return evaluate(e, lambda r: self._scalar(sheet, r), None)

    def _scalar(self, sheet: str, ref: Ref) -> Value:
        kind, place, name = self.book.find(sheet, ref)
        if kind != "scalar":
            raise Fault("VECTOR", f"{ref} is a column; a reduce must make one value of it")
        if (place, name) in self.faults:
            raise self.faults[place, name]
        return self.scalars[place, name]

    def _aggregate(self, nodes) -> None:
        """One aggregation per sheet for all reduces that these nodes need."""
        for n, f in self._reduce_all([(n, n[0], self._binding(n).expr) for n in nodes]).items():
            self.faults[n] = f

    def _reduce_all(self, wanted: list[tuple]) -> dict:
        """Compute the reduces of (key, sheet, expression) rows together; returns a fault for each key that has none."""
        faults, by_sheet = {}, {}
        for n, sheet, e in wanted:
            for c in walk(e):
                if isinstance(c, Call) and c.name in REDUCES:
                    try:
                        key = self._key(sheet, c)
                    except Fault as f:
                        faults[n] = f
                        continue
                    if key not in self.reduces:
                        by_sheet.setdefault(key[1], {})[key] = None
        for sheet, keys in by_sheet.items():
            plain = [k for k in keys if k[0] not in ("NPV", "IRR")]
            if plain:
                self._plain_reduces(sheet, plain)
            for k in keys:
                if k[0] in ("NPV", "IRR"):
                    self.reduces[k] = self._ordered_reduce(k)
        return faults

    def _plain_reduces(self, sheet: str, keys: list[tuple]) -> None:
        frame, aggs = self.frames[sheet], [F.count(F.lit(1)).alias("n")]
        for i, (name, _, column) in enumerate(keys):
            c = self.columns[sheet, column]
            bad = c.value.isNull() if c.error is None else c.error.isNotNull() | c.value.isNull()
            aggs.append(F.count_if(bad).alias(f"bad{i}"))
            if name in ("SUM", "AVG") and c.type == "num":
                aggs.append(F.sum(c.value.cast(f"decimal({min(SPARK_DIGITS, max(c.digits, 1))},{c.scale})")).alias(f"v{i}"))
            elif name in ("MIN", "MAX"):
                aggs.append((F.min if name == "MIN" else F.max)(c.value).alias(f"v{i}"))
            else:
                aggs.append(F.lit(None).alias(f"v{i}"))
        row = frame.agg(*aggs).first()
        for i, key in enumerate(keys):
            name, _, column = key
            c = self.columns[sheet, column]
            if name == "COUNT":
                self.reduces[key] = Decimal(row.n)
            elif row[f"bad{i}"]:
                self.reduces[key] = Fault("TYPE", f"{name}: {row[f'bad{i}']} rows of {column} have no usable value")
            elif c.type not in (("num", "date") if name in ("MIN", "MAX") else ("num",)):
                self.reduces[key] = Fault("TYPE", f"{name} needs numbers")
            elif name == "SUM":
                self.reduces[key] = row[f"v{i}"] if row.n else Decimal(0)
            elif not row.n:
                self.reduces[key] = Fault("TYPE", f"{name} of an empty column")
            elif name == "AVG":
                with localcontext(WIDE):
                    self.reduces[key] = row[f"v{i}"] / row.n
            else:
                self.reduces[key] = row[f"v{i}"]

    def _ordered_reduce(self, key: tuple) -> Value | Fault:
        """NPV and IRR: every task sums its discounted flows; the driver receives a row per task and rate, or per block of flows."""
        name, sheet, column, *rest = key
        s, c = self.book.sheets[sheet], self.columns[sheet, column]
        if s.order_by is None:
            return Fault("TYPE", f"{name} needs an order: bind the sheet with order_by")
        bad = c.value.isNull() if c.error is None else c.error.isNotNull() | c.value.isNull()
        flows = self.frames[sheet].select(F.col(s.order_by).cast("long").alias("ix"), c.value.cast(f"decimal(38,{c.scale})").alias("v"), bad.alias("bad"))
        state = flows.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"), F.min("ix").alias("first"), F.max("ix").alias("last"), F.countDistinct("ix").alias("places")).first()
        if state.bad or not state.n:
            return Fault("TYPE", f"{name}: {column} is empty or has rows without a value")
        if state.places != state.n or state.last - state.first + 1 != state.n:
            return Fault("TYPE", f"{name}: {s.order_by} must number the rows without gaps")
        flows = flows.select((F.col("ix") - state.first).alias("ix"), "v")
        try:
            if name == "NPV":
                if rest[0] <= -1:
                    raise Fault("TYPE", "NPV needs a rate above -1")
                return _present_values(flows, [rest[0]])[0]
            if state.n <= FEW_FLOWS:
                return irr([r.v for r in flows.orderBy("ix").collect()])
            path = folder(self.book.spark, "flows")
            flows.repartitionByRange("ix").sortWithinPartitions("ix").write.parquet(path)  # read once for every trial
            flows = self.book.spark.read.parquet(path)
            return irr_of(_sign_changes(flows), lambda rates: _present_values(flows, rates))
        except Fault as f:
            return f

    def _constants(self, node, e) -> tuple[dict, dict]:
        """(values of scalars, values of reduces as they stand in the expression)."""
        constants, reduces = {}, {}
        for x in walk(e):
            if isinstance(x, Call) and x.name in REDUCES:
                v = self.reduces[self._key(node[0], x)]
                if isinstance(v, Fault):
                    raise v
                reduces[(x.name, *x.args)] = v
        for x in _outside_reduces(e):
            if isinstance(x, Ref) and self.book.find(node[0], x)[0] == "scalar":
                constants[x] = self._scalar(node[0], x)
        return constants, reduces

    def _width(self, node, b: Binding) -> int | None:
        if b.places is not None:
            return b.places

        def lookup(ref: Ref):
            kind, place, name = self.book.find(node[0], ref)
            if kind == "scalar":
                v = self.scalars.get((place, name))
                return DATE if isinstance(v, date) else self.places.get((place, name))
            c = self.columns[place, name]
            return DATE if c.type == "date" else c.scale if c.type == "num" else None

        got = width(b.expr, lookup)
        return None if got == DATE else got

    def _bind(self, node) -> None:
        if node in self.faults:
            return
        s, b = self.book.sheets[node[0]], self._binding(node)
        try:
            if node[1] in s.rules:
                self._rule(node, s, b)
                return
            key = f"{node[0]}.{node[1]}" if node[0] else node[1]
            constants, reduces = self._constants(node, b.expr)
            value = self.given[key] if b.param and key in self.given else evaluate(_settled(b.expr, reduces), lambda r: self._scalar(node[0], r), None)
            if isinstance(value, bool):
                raise Fault("TYPE", "a condition can't be stored")
            places = self._width(node, b)
            if isinstance(value, Decimal) and places is not None:
                if not fits(value, places, SPARK_DIGITS):
                    raise Fault("PRECISION", f"{show(value, None)} has too many digits")
                value = quantize(value, places)
            self.scalars[node], self.places[node] = value, places
        except Fault as f:
            self.faults[node] = f

    def _rule(self, node, s: BoundSheet, b: Binding) -> None:
        constants, reduces = self._constants(node, b.expr)
        inputs: dict[Ref, Compiled] = {}

        def lookup(ref: Ref) -> Compiled:
            kind, place, name = self.book.find(s.name, ref)
            if kind == "scalar":
                v = self._scalar(s.name, ref)
                return literal(v) if isinstance(v, Decimal) else Compiled(F.lit(v), None, "date" if isinstance(v, date) else "str")
            if place != s.name:
                raise Fault("VECTOR", f"{ref} is a column of another sheet")
            if (place, name) in self.faults:
                raise self.faults[place, name]
            c = self.columns[place, name]
            blank = F.when(c.value.isNull(), F.lit("TYPE"))
            inputs[ref] = Compiled(c.value, F.coalesce(c.error, blank) if c.error is not None else blank, c.type, c.digits, c.scale)
            return inputs[ref]

        places = self._width(node, b)
        settled = _settled(b.expr, reduces)
        try:
            got = compile_rounded(settled, lookup, places)
            if got.type == "num":
                if places is None:
                    raise Fault("PRECISION", f"{node[1]} has no width; declare a precision")
                digits = min(SPARK_DIGITS, got.digits - got.scale + 1 + places)
                value = F.round(got.value, places).cast(f"decimal({digits},{places})")
                got = Compiled(value, got.error, "num", digits, places)
        except Wide:
            if places is None:
                raise Fault("PRECISION", f"{node[1]} has no width; declare a precision") from None
            for x in _outside_reduces(b.expr):
                if isinstance(x, Ref) and x not in constants:
                    lookup(x)
            value, error = wide_column(b.expr, places, inputs, constants, reduces)
            got = Compiled(value, error, "num", SPARK_DIGITS, places)
        name, frame = f"={node[1]}", self.frames[s.name]
        value = got.value if got.error is None else F.when(got.error.isNull(), got.value)
        frame = frame.withColumn(name, value)
        if got.error is not None:
            frame = frame.withColumn(name + "!", got.error)
        if s.frame is not None and node[1] in s.frame.columns:
            self.stored[node] = node[1]
        self.frames[s.name] = frame
        self.columns[node] = Compiled(F.col(f"`{name}`"), F.col(f"`{name}!`") if got.error is not None else None, got.type, got.digits, got.scale)

    # results

    def table(self, sheet: str) -> DataFrame:
        """The sheet's columns with every rule computed; `NAME_error` where a rule can fail, null where it didn't."""
        s, frame = self.book.sheets[sheet], self.frames[sheet]
        fields = [F.col(f"`{c}`") for c in s.frame.columns if c not in s.rules]
        for n in s.rules:
            if (sheet, n) in self.faults:
                raise self.faults[sheet, n]
            c = self.columns[sheet, n]
            fields.append(c.value.alias(n))
            if c.error is not None:
                fields.append(c.error.alias(f"{n}_error"))
        return frame.select(*fields)

    def values(self) -> DataFrame:
        """(sheet, name, value, error) of every scalar, as text at its width."""
        rows = []
        for s in self.book.sheets.values():
            for n in s.scalars:
                v, f = self.scalars.get((s.name, n)), self.faults.get((s.name, n))
                rows.append((s.name, n, None if v is None else show(v, self.places.get((s.name, n))), f.code if f else None))
        return self.book.spark.createDataFrame(rows, "sheet string, name string, value string, error string")

    def assertions(self) -> list[tuple[str, str, bool | None]]:
        """(sheet, text, holds) of every assertion; None where it can't be decided. Their reduces are computed together."""
        wanted = [((s.name, f"assert {k}"), s.name, a.expr) for s in self.book.sheets.values() for k, a in enumerate(s.asserts)]
        faults, out = self._reduce_all(wanted), []
        for s in self.book.sheets.values():
            for k, a in enumerate(s.asserts):
                node = (s.name, f"assert {k}")
                try:
                    if node in faults:
                        raise faults[node]
                    constants, reduces = self._constants(node, a.expr)
                    v = evaluate(_settled(a.expr, reduces), lambda r, s=s: self._scalar(s.name, r), None)
                    out.append((s.name, a.text, v if isinstance(v, bool) else None))
                except Fault:
                    out.append((s.name, a.text, None))
        return out

    def findings(self) -> DataFrame:
        """Stale rows and failing rows of every rule with a stored column, as one table; one scan per sheet."""
        out = None
        for s in self.book.sheets.values():
            mine = [n for n in s.rules if (s.name, n) not in self.faults]
            if s.frame is None or not mine:
                continue
            items = []
            for n in mine:
                c, b = self.columns[s.name, n], s.rules[n]
                code = c.error if c.error is not None else F.lit(None).cast("string")
                stored = F.lit(None).cast("string")
                if (s.name, n) in self.stored:
                    old = F.col(f"`{n}`")
                    differs = F.round(old, c.scale) != c.value if c.type == "num" else F.lit(False)
                    code = F.coalesce(code, F.when(old.isNotNull() & differs, F.lit("STALE")))
                    stored = old.cast("string")
                items.append(F.struct(code.alias("code"), F.lit(s.name).alias("sheet"), F.lit(n).alias("name"), stored.alias("stored"), c.value.cast("string").alias("computed"), F.lit(b.text).alias("formula")))
            label = F.col(f"`{s.label}`").cast("string") if s.label else F.lit("")
            part = self.frames[s.name].select(label.alias("row_label"), F.explode(F.filter(F.array(*items), lambda x: x["code"].isNotNull())).alias("f"))
            part = part.select("f.code", "f.sheet", "f.name", "row_label", "f.stored", "f.computed", "f.formula")
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.book.spark.createDataFrame([], FINDING)


def _present_values(flows: DataFrame, rates: list[Decimal]) -> list[Decimal]:
    """The sum of the flows (ix from 0, v) discounted at each rate. Flows may come in any order; in a run the discount is carried on."""

    def part(batches):
        with localcontext(WIDE):
            steps = [1 / (1 + r) for r in rates]
            totals, powers, at = [Decimal(0)] * len(rates), [Decimal(1)] * len(rates), 0
            for pdf in batches:
                for ix, v in zip(pdf["ix"].tolist(), pdf["v"], strict=True):
                    if ix != at:
                        powers = [p * s ** (ix - at) for p, s in zip(powers, steps, strict=True)] if ix > at else [s**ix for s in steps]
                    totals = [t + v * p for t, p in zip(totals, powers, strict=True)]
                    powers, at = [p * s for p, s in zip(powers, steps, strict=True)], ix + 1
        yield pd.DataFrame({"v": [",".join(map(str, totals))]})

    with localcontext(WIDE):
        parts = [r.v.split(",") for r in flows.mapInPandas(part, "v string").collect()]  # a row per task
        return [sum((Decimal(p[k]) for p in parts), Decimal(0)) for k in range(len(rates))]


def _sign_changes(flows: DataFrame) -> int:
    """How often a flow has another sign than the last one before it that isn't 0: within blocks of BLOCK by a window, between them by their ends."""
    signs = flows.filter("v <> 0").select("ix", F.signum("v").cast("int").alias("s"), F.floor(F.col("ix") / BLOCK).alias("block"))
    before = F.lag("s").over(Window.partitionBy("block").orderBy("ix"))
    blocks = signs.withColumn("turn", F.coalesce(before != F.col("s"), F.lit(False))).groupBy("block")
    ends = blocks.agg(F.count_if("turn").alias("n"), F.min_by("s", "ix").alias("first"), F.max_by("s", "ix").alias("last")).orderBy("block").collect()  # a row per BLOCK flows
    return sum(r.n for r in ends) + sum(a.last != b.first for a, b in zip(ends, ends[1:], strict=False))


def _column(frame: DataFrame, f: T.StructField) -> Compiled:
    c = F.col(f"`{f.name}`")
    match f.dataType:
        case T.DecimalType() as d:
            return Compiled(c, None, "num", d.precision, d.scale)
        case T.ByteType() | T.ShortType() | T.IntegerType():
            return Compiled(c.cast("decimal(10,0)"), None, "num", 10, 0)
        case T.LongType():
            return Compiled(c.cast("decimal(19,0)"), None, "num", 19, 0)
        case T.DateType():
            return Compiled(c, None, "date")
        case T.StringType():
            return Compiled(c, None, "str")
    return Compiled(F.lit(None).cast("decimal(1,0)"), F.lit("TYPE"), "num", 1, 0)
