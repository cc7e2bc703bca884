"""Operators: every one takes and returns DataFrames.

Table columns, and the ordinals that order-sensitive operators rely on:
pages (file_id, page_number, text, char_count, metrics, quality), blocks (file_id,
ordinal, kind, text), sections (file_id, node_id, parent_id, dfs_ord, depth, label,
title, role, kind, unit_start, unit_end, detection), chunks (chunk_ord, file_id,
filename, section_label, role, doc_role, text, page_map), drafts (chunk_key, draft_idx,
...), requirements (req_ord, requirement_id, ...).
"""
