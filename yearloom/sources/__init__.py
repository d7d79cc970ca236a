from .readers import check_columns, read_panel, read_table
from .sinks import write_csv_report, write_forecast, write_table

__all__ = ["check_columns", "read_panel", "read_table", "write_csv_report", "write_forecast", "write_table"]
