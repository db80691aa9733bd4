from plumbline.sources.reports import read_report, write_report
from plumbline.sources.tables import read_table

__all__ = ["read_report", "read_table", "write_report"]
