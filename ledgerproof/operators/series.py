"""Present values and rates of return of many series at once: a project, a customer, a contract each.

A series is the rows of one key in the order of a whole number that counts its periods without gaps; one that has gaps, doubled periods or missing values is refused on its own. Series of
up to FEW rows are priced where they meet. Longer ones are cut into blocks, ordered over all tasks, and their searches advance together: each
scan prices every open series at its own rates, a partial sum for each series and task, and those that have settled take no part in the next.
"""

from __future__ import annotations

from decimal import Decimal, localcontext

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.finance import WIDE, Bracket, irr, irr_shown
from ..lang.values import CONTEXT, SPARK_DIGITS, Fault, fits, quantize
from ..streaming.scratch import written
from .documents import dealt

#: Rows of a series that one task prices alone, and rows of a block of a longer one.
FEW, BLOCK = 20_000, 20_000
#: What a search keeps between scans, as text.
STATE = "key string, phase string, asked string, low string, high string, v_low string, v_high string, last string, turn int, root string, fault string"


def _series(frame: DataFrame, by: list[str], order_by: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(heads, flows): a row for each key (key, its columns, n, fault), and (key, ix from 0, v) of the series without a fault, long and short."""
    key = F.to_json(F.struct(*[F.col(c) for c in by]), {"ignoreNullFields": "false"})
    rows = frame.select(key.alias("key"), *by, F.col(order_by).cast("long").alias("ix"), F.col(column).cast("decimal(38,10)").alias("v"))
    heads = rows.groupBy("key", *by).agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("valued"), F.count("ix").alias("placed"), F.min("ix").alias("first"), F.max("ix").alias("last"))
    fault = F.when(F.col("valued") < F.col("n"), f"{column} has rows without a value").when((F.col("placed") < F.col("n")) | (F.col("last") - F.col("first") + 1 != F.col("n")), f"{order_by} must number the rows without gaps")
    heads = heads.withColumn("fault", fault)
    good = heads.filter("fault is null").select("key", "first", "n")
    flows = rows.join(good, "key").select("key", (F.col("ix") - F.col("first")).alias("ix"), "v", "n")
    doubled = flows.groupBy("key", "ix").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("key").distinct().withColumn("twice", F.lit(True))
    heads = heads.join(doubled, "key", "left").withColumn("fault", F.coalesce("fault", F.when(F.col("twice"), f"{order_by} must number the rows without gaps")))
    return heads.select("key", *by, "n", "fault"), flows.join(doubled, "key", "left_anti")


def _ordered(flows: DataFrame) -> DataFrame:
    """Flows in runs: the blocks of a key lie side by side over the tasks, so a key has one run in each task that holds it."""
    cut = flows.withColumn("block", F.floor(F.col("ix") / BLOCK))
    return cut.repartitionByRange("key", "block").sortWithinPartitions("key", "ix")


def _partials(runs: DataFrame) -> DataFrame:
    """(key, parts): the sums of the flows (key, ix, v, asked: rates joined by blanks) of each run, discounted at each of its rates."""

    def run(batches):
        at, steps, powers, totals, place = None, [], [], [], 0
        with localcontext(WIDE):
            for pdf in batches:
                out = []
                for key, ix, v, asked in zip(pdf["key"], pdf["ix"].tolist(), pdf["v"], pdf["asked"], strict=True):
                    if key != at:
                        if at is not None:
                            out.append((at, " ".join(map(str, totals))))
                        at, steps = key, [1 / (1 + Decimal(r)) for r in asked.split()]
                        powers, totals, place = [s**ix for s in steps], [Decimal(0)] * len(steps), ix
                    if ix != place:
                        powers = [p * s ** (ix - place) for p, s in zip(powers, steps, strict=True)]
                    totals = [t + v * p for t, p in zip(totals, powers, strict=True)]
                    powers, place = [p * s for p, s in zip(powers, steps, strict=True)], ix + 1
                yield pd.DataFrame(out, columns=["key", "parts"])
            if at is not None:
                yield pd.DataFrame([(at, " ".join(map(str, totals)))], columns=["key", "parts"])

    return runs.mapInPandas(run, "key string, parts string")


def _sum(parts) -> list[Decimal]:
    """The sums of partial sums, rate by rate."""
    with localcontext(WIDE):
        split = [list(map(Decimal, p.split())) for p in parts]
        return [sum(column, Decimal(0)) for column in zip(*split, strict=True)]


def _shown(value: Decimal, places: int) -> tuple[Decimal | None, str | None]:
    value = CONTEXT.plus(value)
    if not fits(value, places, SPARK_DIGITS):
        return None, "PRECISION"
    return quantize(value, places), None


def _results(heads: DataFrame, values: DataFrame, by: list[str], name: str, places: int) -> DataFrame:
    """The columns of `by`, the value, and the code of what kept it from being found."""
    out = heads.join(values, "key", "left")
    error = F.when(F.col("fault").isNotNull(), F.lit("TYPE")).otherwise(F.col("error"))
    return out.select(*by, F.col("value").cast(f"decimal(38,{places})").alias(name), error.alias("error"))


def present_values(frame: DataFrame, by: list[str], order_by: str, column: str, rate: Decimal, places: int = 2) -> DataFrame:
    """(by…, npv decimal(38, places), error) of each series at `rate` a period; the first period isn't discounted. Null keys are a series too.

    error: TYPE where periods have gaps or doubles or values are missing, PRECISION where the value has too many digits.
    """
    if rate <= -1:
        raise Fault("TYPE", "NPV needs a rate above -1")
    heads, flows = _series(frame, by, order_by, column)
    found = _partials(_ordered(flows).withColumn("asked", F.lit(str(rate))))
    summed = found.groupBy("key").agg(F.collect_list("parts").alias("parts"))  # a row of each task that holds the key

    def total(batches):
        for pdf in batches:
            rows = [_shown(_sum(parts)[0], places) for parts in pdf["parts"]]
            yield pd.DataFrame({"key": pdf["key"], "value": [v for v, _ in rows], "error": [e for _, e in rows]})

    return _results(heads, summed.mapInPandas(total, f"key string, value decimal(38,{places}), error string"), by, "npv", places)


def rates_of_return(frame: DataFrame, by: list[str], order_by: str, column: str, places: int = 6) -> DataFrame:
    """(by…, irr decimal(38, places), error) of each series: the rate at which it is worth nothing. Null keys are a series too.

    error: TYPE where periods have gaps or doubles, values are missing, or the flows don't change sign exactly once.
    """
    heads, flows = _series(frame, by, order_by, column)
    heads, flows = written(heads, "series"), written(flows, "flows")

    def alone(batches):
        for batch in batches:
            out = []
            for flows_of in batch.column("v").to_pylist():
                shown = irr_shown(flows_of, places)
                try:
                    out.append((shown, None) if shown is not None else _shown(irr(flows_of), places))
                except Fault as f:
                    out.append((None, f.code))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([v for v, _ in out], pa.decimal128(38, places)), pa.array([e for _, e in out], pa.string())], names=["key", "value", "error"]
            )

    schema = f"key string, value decimal(38,{places}), error string"
    # a row for each series, dealt to many tasks: there is little to shuffle, but work in each row
    few = flows.filter(F.col("n") <= FEW).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ix", "v"))).alias("flows")).select("key", F.col("flows.v").alias("v"))
    values = dealt(few, "key").mapInArrow(alone, schema)
    long = flows.filter(F.col("n") > FEW)
    if not long.isEmpty():
        values = values.unionByName(_together(long, places, schema))
    return _results(heads, values, by, "irr", places)


def _together(flows: DataFrame, places: int, schema: str) -> DataFrame:
    """Rates of long series, a scan for each step of all searches that are still open."""
    runs = written(_ordered(flows), "runs")
    blocks = written(runs.select("key", "block").distinct(), "blocks")

    def begin(batches):
        for pdf in batches:
            yield pd.DataFrame([_row(k, Bracket(), "" if n == 1 else "TYPE") for k, n in zip(pdf["key"], pdf["changes"], strict=True)], columns=_NAMES)

    def advance(batches):
        for pdf in batches:
            out = []
            for row, parts in zip(pdf[_NAMES].itertuples(index=False), pdf["parts"], strict=True):
                key, search = _search(row)
                try:
                    with localcontext(WIDE):
                        search.tell(_sum(parts))
                    out.append(_row(key, search, ""))
                except Fault as f:
                    out.append(_row(key, search, f.code))
            yield pd.DataFrame(out, columns=_NAMES)

    def ends(batches):
        for pdf in batches:
            rows = [(None, f) if f else _shown(Decimal(r), places) for r, f in zip(pdf["root"], pdf["fault"], strict=True)]
            yield pd.DataFrame({"key": pdf["key"], "value": [v for v, _ in rows], "error": [e for _, e in rows]})

    state = written(_changes(runs).mapInPandas(begin, STATE), "searches")
    settled = None
    while True:
        over = state.filter("phase = 'done' or fault <> ''")
        settled = over if settled is None else settled.unionByName(over)
        state = state.filter("phase <> 'done' and fault = ''")
        if state.isEmpty():
            return settled.mapInPandas(ends, schema)
        # joined by block, so that a long series stays dealt to many tasks
        asked = blocks.join(state.select("key", "asked"), "key")
        priced = _partials(runs.join(asked, ["key", "block"]).sortWithinPartitions("key", "ix"))
        told = state.join(priced.groupBy("key").agg(F.collect_list("parts").alias("parts")), "key")
        state = written(told.mapInPandas(advance, STATE), "searches")


_NAMES = [part.split()[0] for part in STATE.split(", ")]


def _row(key: str, s: Bracket, fault: str) -> tuple:
    root = None if s.root is None else str(s.root)
    return key, s.phase, " ".join(map(str, s.asked)), str(s.low), str(s.high), str(s.v_low), str(s.v_high), s.last, s.turn, root, fault


def _search(row) -> tuple[str, Bracket]:
    root = Decimal(row.root) if isinstance(row.root, str) else None
    return row.key, Bracket(row.phase, list(map(Decimal, row.asked.split())), *map(Decimal, (row.low, row.high, row.v_low, row.v_high)), row.last, int(row.turn), root)


def _changes(runs: DataFrame) -> DataFrame:
    """(key, changes): how often a flow has another sign than the last one before it that isn't 0, within blocks by a window, between them by their ends."""
    signs = runs.filter("v <> 0").select("key", "block", "ix", F.signum("v").cast("int").alias("s"))
    before = F.lag("s").over(Window.partitionBy("key", "block").orderBy("ix"))
    blocks = signs.withColumn("turn", F.coalesce(before != F.col("s"), F.lit(False))).groupBy("key", "block")
    blocks = blocks.agg(F.count_if("turn").alias("n"), F.min_by("s", "ix").alias("first"), F.max_by("s", "ix").alias("last"))
    between = F.lag("last").over(Window.partitionBy("key").orderBy("block"))  # a row of each block
    counted = blocks.withColumn("turn", F.coalesce(between != F.col("first"), F.lit(False)).cast("int")).groupBy("key").agg(F.sum(F.col("n") + F.col("turn")).alias("changes"))
    return runs.select("key").distinct().join(counted, "key", "left").select("key", F.coalesce("changes", F.lit(0)).alias("changes"))
