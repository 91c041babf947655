"""The queries of this subpackage, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from .common import table
from .conversations import repaired
from .decontaminate import contaminated
from .fill_middle import FIM_SQL, fill_middle_digests
from .html_extract import extracted
from .language_id import language_id
from .licenses import license_scan
from .line_dedup import LINES_SQL, line_dedup_digests
from .mixing import MIX_SQL, mixed
from .pii import pii_spans
from .quality import quality
from .simhash import simhash_groups
from .token_counts import token_counts
from .vector_dedup import vector_groups


def queries() -> dict:
    return {
        "op1_token_counts": lambda spark, d: token_counts(table(spark, d, "documents")),
        "op2_decontamination": lambda spark, d: contaminated(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op3_language_id": lambda spark, d: language_id(table(spark, d, "documents")),
        "op4_vector_dedup": lambda spark, d: vector_groups(table(spark, d, "embeddings")),
        "op5_pii": lambda spark, d: pii_spans(table(spark, d, "documents")),
        "op6_simhash": lambda spark, d: simhash_groups(table(spark, d, "documents")),
        "op7_quality": lambda spark, d: quality(table(spark, d, "documents"), table(spark, d, "labels")),
        "op8_mixing": lambda spark, d: mixed(table(spark, d, "documents")).drop("source"),
        "op9_html_extract": lambda spark, d: extracted(table(spark, d, "pages")),
        "op10_licenses": lambda spark, d: license_scan(table(spark, d, "documents")),
        "op11_line_dedup": lambda spark, d: line_dedup_digests(table(spark, d, "documents")),
        "op12_fill_middle": lambda spark, d: fill_middle_digests(table(spark, d, "documents")),
        "op13_conversation_repair": lambda spark, d: repaired(table(spark, d, "conversations")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_mixing": f"select doc_id, size, source_size, target, taken from ({MIX_SQL.format(docs='documents')})",
        "op11_line_dedup": LINES_SQL.format(docs="documents"),
        "op12_fill_middle": FIM_SQL.format(docs="documents"),
    }
