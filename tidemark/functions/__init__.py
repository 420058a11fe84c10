"""Column functions shared by the operators."""

from tidemark.functions.columns import DAY_MS, DAY_NS, day_bucket, day_number, entity_key, floor_div, msg_id_parts, ns_of, safe_name, sorted_columns, stable_id

__all__ = ["DAY_MS", "DAY_NS", "day_bucket", "day_number", "entity_key", "floor_div", "msg_id_parts", "ns_of", "safe_name", "sorted_columns", "stable_id"]
