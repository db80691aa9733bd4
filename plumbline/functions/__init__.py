from plumbline.functions.columns import is_number, is_time, is_text, kind_of, present
from plumbline.functions.buckets import OrderedBuckets
from plumbline.functions.times import interval_micros

__all__ = [
    "OrderedBuckets",
    "interval_micros",
    "is_number",
    "is_text",
    "is_time",
    "kind_of",
    "present",
]
