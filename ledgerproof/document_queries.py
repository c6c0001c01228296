"""Registered queries over documents that are generated from the driver's tables: inference from prose, repairs, imports, reports and structural findings, against SQL over the same tables."""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import functions as F

from .corpus_queries import _HIRE, _hire, _row, _string, _tables
from .lang.values import Fault
from .operators import charts, documents, infer, repair, reports, sweep
from .plans.model import build
from .queries import _read, query
from .sources.csv_import import parse_csv
from .sources.markdown import locate

_SUMS = f"WITH {_HIRE}, s AS (SELECT o_custkey, n, SUM(total) AS total FROM r GROUP BY o_custkey, n)"


@query(
    f"{_SUMS} SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CASE WHEN o_custkey % 3 = 0 THEN 'ambiguous' ELSE 'scalar' END AS kind, CASE WHEN o_custkey % 3 = 0 THEN CAST(total AS VARCHAR) ELSE 'net_total' END AS target, "
    "CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'net_total = SUM(Net)' END AS rule, CASE WHEN o_custkey % 3 = 0 THEN 'unnamed1.net_total = SUM(Net); unnamed2.net_total = SUM(Net)' ELSE '' END AS alternatives FROM s WHERE n >= 2"
)
def infer_scalars(spark, sf_dir):
    """The reduce that each figure of a text states; a third of the texts have two tables that say the same, which decides nothing."""
    tables = _tables(_hire(spark, sf_dir), "o_custkey", "| Order | Net |\n|--|--|\n", _row(F.concat(F.lit("o"), _string("o_orderkey")), _string("total")), F.sum("total").alias("t"))
    twice = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("\n\nAgain:\n\n"), "table")).otherwise(F.lit(""))
    docs = tables.select(_string("o_custkey").alias("doc_id"), F.concat("table", twice, F.lit("\n\nIt comes to **"), _string("t"), F.lit("**.\n")).alias("text"))
    found = infer.proposals_corpus(docs).filter("kind in ('scalar', 'ambiguous')")
    return found.select("doc_id", "kind", "target", "rule", "alternatives")


@query(
    f"WITH {_HIRE}, s AS (SELECT DISTINCT o_custkey, n FROM r) SELECT CAST(o_custkey AS VARCHAR) AS doc_id, 'column' AS kind, 'Levy = Net * 0.12' AS rule, '12%' AS echo FROM s WHERE n >= 2 "
    "UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'constant', 'Net * 0.12', '12%' FROM s WHERE n >= 2 UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'alias', '\"Number of order\" is no', '' FROM s"
)
def infer_constants(spark, sf_dir):
    """A multiplier that the text spells otherwise, and an alias for a header that no formula can spell."""
    levy = (F.col("total") * Decimal("0.12")).cast("decimal(20,4)")
    tables = _tables(_hire(spark, sf_dir), "o_custkey", "| Number of order | Net | Levy |\n|--|--|--|\n", _row(F.concat(F.lit("o"), _string("o_orderkey")), _string("total"), _string(levy)))
    docs = tables.select(_string("o_custkey").alias("doc_id"), F.concat("table", F.lit("\n\nThe levy is 12% of it.\n")).alias("text"))
    return infer.proposals_corpus(docs).filter("kind in ('column', 'constant', 'alias')").select("doc_id", "kind", "rule", "echo")


@query(
    "SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CASE p_partkey % 3 WHEN 0 THEN ' [SEK]' WHEN 1 THEN ' [h]' ELSE ' [m^2]' END AS unit, CAST(2 AS INT) AS places FROM part"
)
def infer_units(spark, sf_dir):
    """Units that follow for computed columns and scalars which declare none."""
    k = F.col("p_partkey") % 3
    one = F.when(k == 2, "m").otherwise("kg")
    two = F.when(k == 0, "SEK/kg").when(k == 1, "h/kg").otherwise("m")
    text = F.concat(F.lit("| A ["), one, F.lit("] | B ["), two, F.lit("] | C |\n|--|--|--|\n| 2 | "), _string("p_size"), F.lit(" | "), _string(F.col("p_size") * 2), F.lit(" |\n\n```vmark #t\nC = A * B\nall = SUM(C)\n```\n**"), _string(F.col("p_size") * 2), F.lit("**<!--vmark=t.all-->\n"))
    docs = _read(spark, sf_dir, "part").select(_string("p_partkey").alias("doc_id"), text.alias("text"))

    def units(text: str) -> list[dict]:
        edits = infer.plan_units(text)
        (unit,) = {e.text for e in edits}
        return [{"unit": unit, "places": len(edits)}]

    return documents.per_document(docs, units, "unit string, places int").drop("path")


@query(
    "SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CASE c_custkey % 5 WHEN 3 THEN 'the file mixes line ends' WHEN 4 THEN 'a quotation is never closed' ELSE '' END AS refused, CAST(CASE WHEN c_custkey % 5 > 2 THEN 0 ELSE 2 END AS INT) AS n_rows, "
    "CASE WHEN c_custkey % 5 > 2 THEN '' ELSE c_name || CASE WHEN c_custkey % 2 = 0 THEN ';\"' ELSE ',' || chr(10) END || c_custkey END AS cell FROM customer"
)
def csv_texts(spark, sf_dir):
    """Quoted cells with separators, quotes and line ends in them; files that mix line ends or leave a quotation open are refused."""
    k = F.col("c_custkey")
    name = F.concat("c_name", F.when(k % 2 == 0, F.lit(';""')).otherwise(F.lit(",\n")), _string("c_custkey"))
    end = F.when(k % 5 == 1, F.lit("\r\n")).otherwise(F.lit("\n"))
    close = F.when(k % 5 == 4, F.lit("")).otherwise(F.lit('"'))
    text = F.concat(F.lit("Id;Name"), F.when(k % 5 == 3, F.lit("\r")).otherwise(end), _string("c_custkey"), F.lit(';"'), name, close, end)
    docs = _read(spark, sf_dir, "customer").select(_string("c_custkey").alias("doc_id"), text.alias("text"))

    def parsed(text: str) -> list[dict]:
        try:
            rows = parse_csv(text, ";")
        except Fault as f:
            return [{"refused": f.message, "n_rows": 0, "cell": ""}]
        return [{"refused": "", "n_rows": len(rows), "cell": rows[1][1]}]

    return documents.per_document(docs, parsed, "refused string, n_rows int, cell string").drop("path")


@query(
    "SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CAST(1 AS INT) AS dates, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS INT) AS cells, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS INT) AS anchors, '2026-01-' || (13 + p_size % 15) AS day FROM part"
)
def repair_kinds(spark, sf_dir):
    """What a repair does to each document: dates that can be read one way only, stale cells, and the anchor that shows their total."""
    k = F.col("p_partkey") % 2
    double = F.col("p_size") * 2 + F.when(k == 0, 1).otherwise(0)
    text = F.concat(F.lit("| Day | A | B |\n|--|--|--|\n| "), _string(F.col("p_size") % 15 + 13), F.lit(".1.2026 | "), _string("p_size"), F.lit(" | "), _string(double), F.lit(" |\n\n```vmark #t\nB = A * 2\nall = SUM(B)\n```\n**"), _string(double), F.lit("**<!--vmark=t.all-->\n"))
    docs = _read(spark, sf_dir, "part").select(_string("p_partkey").alias("doc_id"), text.alias("text"))

    def repaired(text: str) -> list[dict]:
        fixed, counts, left = repair.fmt(text, fix_dates=True)
        assert not left and not documents.check(fixed).findings
        return [{"dates": counts.get("date", 0), "cells": counts.get("cell", 0), "anchors": counts.get("anchor", 0), "day": fixed.split("\n")[2].split("|")[1].strip()}]

    return documents.per_document(docs, repaired, "dates int, cells int, anchors int, day string").drop("path")


@query(
    "SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CASE s_suppkey % 4 WHEN 0 THEN 'DUP' WHEN 1 THEN 'CYCLE' WHEN 2 THEN 'VECTOR' ELSE 'UNDEF' END AS code, CASE s_suppkey % 4 WHEN 3 THEN 'Weight' END AS suggestion, CAST(1 AS INT) AS exit_code, "
    "CAST(1 AS BIGINT) AS problems FROM supplier"
)
def structure_faults(spark, sf_dir):
    """What is wrong with a document's structure: doubled names, circles, columns where a value is meant, names that nothing has; read back from the report's JSON."""
    k = F.col("s_suppkey") % 4
    table = F.when(k == 0, F.lit("| A | A | B |")).otherwise(F.lit("| A | Weight | B |"))
    body = F.when(k == 0, F.lit("x = SUM(B)")).when(k == 1, F.lit("x = y + 1\ny = x - SUM(B)")).when(k == 2, F.lit("x = Weight")).otherwise(F.lit("x = SUM(Weihgt)"))
    text = F.concat(table, F.lit("\n|--|--|--|\n| 1 | 2 | "), _string("s_suppkey"), F.lit(" |\n\n```vmark #t\n"), body, F.lit("\n```\n**"), _string("s_suppkey"), F.lit("**<!--vmark=t.x-->\n"))
    docs = _read(spark, sf_dir, "supplier").select(_string("s_suppkey").alias("doc_id"), text.alias("text"))

    def report(text: str) -> list[dict]:
        result = documents.check(text)
        told = json.loads(reports.result_json(result))
        problems = [f for f in told["findings"] if f["code"] not in ("WARN", "NOTE")]
        return [{"code": problems[0]["code"], "suggestion": problems[0].get("suggestion"), "exit_code": result.exit_code, "problems": told["summary"]["problems"]}]

    return documents.per_document(docs, report, "code string, suggestion string, exit_code int, problems long").drop("path")


@query(
    "SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CASE s_suppkey % 4 WHEN 3 THEN 'refused' ELSE CAST(CAST((CASE s_suppkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 30 END) * (20 + s_suppkey % 30) AS DECIMAL(18,2)) AS VARCHAR) END AS cost FROM supplier"
)
def scenario_files(spark, sf_dir):
    """A scenario file for each document: points of the grid are taken, by name or by qualified name, and others refused."""
    key = F.col("s_suppkey")
    given = F.when(key % 4 == 0, F.lit('{"h": "10"}')).when(key % 4 == 1, F.lit('{"p.h": "20"}')).when(key % 4 == 2, F.lit('{"h": "30"}')).otherwise(F.lit('{"h": "35"}'))
    text = F.concat(given, F.lit("\n```vmark #p\nparam h precision 0 integer in [0, 30] lattice 10 = default 0\nrate precision 2 = "), _string(key % 30 + 20), F.lit(".00\ncost precision 2 = h * rate\n```\n"))
    docs = _read(spark, sf_dir, "supplier").select(_string(key).alias("doc_id"), text.alias("text"))

    def cost(text: str) -> list[dict]:
        scenario, _, doc = text.partition("\n")
        model = build(locate(doc))
        try:
            got = sweep.answer(model, sweep.resolve_scenario(model, sweep.read_scenario(scenario)))
        except Fault:
            return [{"cost": "refused"}]
        return [{"cost": f"{got.values['p', 'cost']:.2f}"}]

    return documents.per_document(docs, cost, "cost string").drop("path")


@query(
    "SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CASE s_suppkey % 5 WHEN 0 THEN 'bar' WHEN 1 THEN 'line' WHEN 2 THEN 'area' WHEN 3 THEN 'stacked-bar' ELSE 'pie' END AS engine, 'current' AS state, 'stale' AS other FROM supplier"
)
def chart_files(spark, sf_dir):
    """Each engine draws its chart; a file is current where it holds just that, and stale where the figures have changed since."""
    engine = F.element_at(F.array(*[F.lit(e) for e in ("bar", "line", "area", "stacked-bar", "pie")]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    text = F.concat(F.lit("| M | A | B |\n|--|--|--|\n| x | "), _string(F.col("s_suppkey") + 1), F.lit(" | 3 |\n| y | 4 | 5 |\n\n```vmark #s\nchart c as "), engine, F.lit(" of A labelled M\n```\n![c](c.svg)<!--vmark=s.c-->\n"))
    docs = _read(spark, sf_dir, "supplier").select(_string("s_suppkey").alias("doc_id"), text.alias("text"))

    def drawn(text: str) -> list[dict]:
        own, faults = charts.draw_all(documents.check(text))
        other = charts.draw_all(documents.check(text.replace("| y | 4 |", "| y | 6 |")))[0]
        assert not faults
        (chart,) = own.values()
        (changed,) = other.values()
        name = text.partition("chart c as ")[2].partition(" ")[0]
        return [{"engine": name, "state": charts.state(chart, chart), "other": charts.state(changed, chart)}]

    return documents.per_document(docs, drawn, "engine string, state string, other string").drop("path")
