"""The operators' queries and their SQL, as the driver's entry file asks for them."""

from __future__ import annotations

from . import chat_format, itemsets, license_scan, mixture, near_duplicates, quality_rules
from .bpe import op4_bpe
from .fingerprints import op6_fingerprints
from .html_extract import op5_html_extract
from .language_id import op10_language_id
from .neighbours import op12_neighbours
from .periodic_runs import op11_periodic_runs
from .token_counts import op8_token_counts

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_mixture": mixture.op2_mixture,
    "op3_near_duplicates": near_duplicates.op3_near_duplicates,
    "op4_bpe": op4_bpe,
    "op5_html_extract": op5_html_extract,
    "op6_fingerprints": op6_fingerprints,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_language_id": op10_language_id,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_neighbours": op12_neighbours,
    "op13_itemsets": itemsets.op13_itemsets,
}

#: SQL for DuckDB where SQL can express the query.
ORACLES: dict[str, str] = {
    "op1_chat_format": chat_format.ORACLE,
    "op2_mixture": mixture.ORACLE,
    "op3_near_duplicates": near_duplicates.ORACLE,
    "op7_license_scan": license_scan.ORACLE,
    "op9_quality_rules": quality_rules.oracle(),
    "op13_itemsets": itemsets.ORACLE,
}
