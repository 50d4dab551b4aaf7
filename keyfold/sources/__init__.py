"""Sources and split planning."""

from keyfold.sources.readers import LINEITEM_FIELDS, delimited_lines, read_delimited, read_lines, read_table, read_whole_files, union_inputs
from keyfold.sources.splits import plan_splits, plan_line_splits, split_manifest

__all__ = ["LINEITEM_FIELDS", "delimited_lines", "plan_line_splits", "plan_splits", "read_delimited", "read_lines", "read_table", "read_whole_files", "split_manifest", "union_inputs"]
