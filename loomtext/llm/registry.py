"""Queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from loomtext.llm.chat import OP10_SQL, op10_chat_format
from loomtext.llm.decontaminate import op5_decontaminate
from loomtext.llm.html import op9_html_extract
from loomtext.llm.lines import OP7_SQL, op7_line_dedup
from loomtext.llm.near import op2_near_dedup
from loomtext.llm.packing import op4_packing
from loomtext.llm.quality import op1_quality_rules
from loomtext.llm.secrets import op6_secret_scan
from loomtext.llm.toxicity import op3_toxicity
from loomtext.llm.urls import OP8_SQL, op8_url_filter

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_near_dedup, op3_toxicity, op4_packing, op5_decontaminate, op6_secret_scan, op7_line_dedup, op8_url_filter, op9_html_extract, op10_chat_format)}
ORACLES = {"op7_line_dedup": OP7_SQL, "op8_url_filter": OP8_SQL, "op10_chat_format": OP10_SQL}
