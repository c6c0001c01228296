"""Tabular numbers that still agree with the formulas that produced them: single documents, corpora and sheets of any size."""

from .lang.values import Fault
from .operators.charts import draw_all, register_engine
from .operators.documents import check, check_corpus, tally
from .operators.grids import best, deltas, forbidden, gates, slack
from .operators.infer import infer, proposals, proposals_corpus, write, write_corpus
from .operators.investigate import evidence, investigate, report
from .operators.repair import apply_edits, fmt, plan, plan_corpus, splice
from .operators.reports import charts_json, explain, findings_text, inference_json, inference_text, result_json
from .operators.sweep import read_scenario, resolve_scenario, simulate
from .operators.workbook import Workbook
from .plans.model import build
from .sources.corpus import corpus_cells, read_documents, select_files
from .sources.markdown import locate

__all__ = [
    "Fault", "Workbook", "apply_edits", "best", "build", "charts_json", "check", "check_corpus", "corpus_cells", "deltas", "draw_all", "evidence", "explain", "findings_text",
    "fmt", "forbidden", "gates", "infer", "inference_json", "inference_text", "investigate", "locate", "plan", "plan_corpus", "proposals", "proposals_corpus", "read_documents",
    "read_scenario", "register_engine", "report", "resolve_scenario", "result_json", "select_files", "simulate", "slack", "splice", "tally", "write", "write_corpus",
]
