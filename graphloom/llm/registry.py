"""The queries of this folder and, where DuckDB can express them, their SQL."""
from __future__ import annotations

from . import byte_bpe, decontam, lm_score, near_dup, quality, secret_scan, shard_tree, token_fst, tool_link, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_lm_score": lm_score.op2_lm_score,
    "op3_token_count": token_fst.op3_token_count,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op5_shard": shard_tree.op5_shard,
    "op6_near_dup": near_dup.op6_near_dup,
    "op7_tool_link": tool_link.op7_tool_link,
    "op8_quality": quality.op8_quality,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_decontaminate": decontam.op10_decontaminate,
}
ORACLE_SQL = {"op1_url_filter": url_filter.SQL, "op7_tool_link": tool_link.SQL, "op9_secret_scan": secret_scan.SQL}
